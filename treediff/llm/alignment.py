"""Alignment of two tokenizers' tokens over one text, by a dangling-suffix transducer."""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from treediff.llm.bpe import byte_letters
from treediff.llm.common import read, stash
from treediff.llm.pieces import SPACE, binaries, joined, model, places, slices, source_of

#: White space beside a space, or a space at an end: such texts aren't cut into words.
UNEVEN = "[\\pZ\\t-\\r\\x{1c}-\\x{1f}\\x{85}] | [\\pZ\\t-\\r\\x{1c}-\\x{1f}\\x{85}]|^ | $"
#: Bytes of texts that are aligned together and make a block; a longer text is one alone.
TOGETHER = 4_000_000
#: Characters of words that the first tokenizer gets as one text.
LINE = 20_000


class State(dict):
    """Which side leads, and its bytes that the other side hasn't matched; maps the next token of the side that is behind
    (of the first side, where nothing dangles) to the state after it."""

    __slots__ = ("behind", "dangling")

    def __init__(self, behind: int, dangling: bytes):
        super().__init__()
        self.behind, self.dangling = behind, dangling


class Transducer:
    """Steps through two sequences of tokens that spell the same bytes; transitions are worked out once each."""

    def __init__(self, first: list[bytes], second: list[bytes]):
        self.spelled = (first, second)
        self.states = {(0, b""): State(0, b"")}

    def step(self, state: State, token: int) -> State:
        piece, side, ahead = self.spelled[state.behind][token], state.behind, state.dangling
        if ahead.startswith(piece):
            side, left = side, ahead[len(piece) :]
        elif piece.startswith(ahead):
            side, left = 1 - side, piece[len(ahead) :]
        else:
            raise ValueError(f"{piece!r} stands against {ahead!r}")
        key = (side if left else 0, left)
        new = self.states.get(key)
        if new is None:
            new = self.states[key] = State(*key)
        state[token] = new
        return new

    def ends(self, first: list[int], second: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of tokens of either side at the end of each group: where nothing dangles."""
        start = state = self.states[0, b""]
        step, i, j, n = self.step, 0, 0, len(first)
        at_first, at_second = [], []
        while i < n or j < len(second):
            if state.behind:
                token = second[j]
                j += 1
            else:
                token = first[i]
                i += 1
            after = state.get(token)
            state = step(state, token) if after is None else after
            if state is start:
                at_first.append(i)
                at_second.append(j)
        return np.array(at_first, np.int64), np.array(at_second, np.int64)


class Aligned:
    """What a slice of texts gives: for each text the numbers of its tokens and its words' groups, for each distinct word the rest."""

    of_text: np.ndarray  # offsets of texts in words
    words: np.ndarray  # places in the distinct words
    n: tuple[np.ndarray, np.ndarray]  # tokens of each distinct word
    links: np.ndarray  # first id << 32 | second id of each group, word by word
    groups: pa.Array  # text of each distinct word's groups, each group with its semicolon
    of_word: np.ndarray  # offsets of words in links

    def totals(self, values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values[self.words])])
        return sums[self.of_text[1:]] - sums[self.of_text[:-1]]

    def texts_links(self) -> tuple[np.ndarray, np.ndarray]:
        """(offsets by text, places in links)."""
        lengths = np.diff(self.of_word)[self.words]
        return np.concatenate([[0], np.cumsum(lengths)])[self.of_text], places(self.of_word[self.words], lengths)

    def texts_groups(self) -> tuple[np.ndarray, pa.Buffer]:
        """(offsets by text, bytes): the groups of each text with a last semicolon."""
        picked = self.groups.take(pa.array(self.words))
        ends = np.frombuffer(picked.buffers()[1], "<i4", len(picked) + 1, picked.offset * 4) if len(picked) else np.zeros(1, "<i4")
        return ends[self.of_text].astype(np.int64), picked.buffers()[2] or pa.py_buffer(b"")


class Aligner:
    """Two vocabularies: a byte-level one of the tokenizers library, and a model of pieces.

    Neither vocabulary has a token across the place before a single space
    between other characters, so a text is cut there and each distinct word of
    an Arrow batch is encoded and aligned once; texts with other white space
    beside a space, or with the sign for it, are aligned whole.
    """

    def __init__(self, first: str, second: bytes):
        data = json.loads(first)
        letters = {ord(c): b for b, c in byte_letters().items()}
        special = {t["content"] for t in data["added_tokens"]}
        spelled = {i: bytes(letters[ord(c)] for c in t) for t, i in data["model"]["vocab"].items() if t not in special}
        self.library = Tokenizer.from_str(first)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True
        self.pieces = model(second)
        size = max(spelled) + 1
        self.tables = [spelled.get(i, b"") for i in range(size)], self.pieces.spoken
        self.lengths = [np.array([len(x) for x in t], np.int64) for t in self.tables]
        self.transducer = Transducer(*self.tables)
        # An id as text with what follows it: the next id of its side, the other side, or the next group.
        self.shown = pa.array([f"{i}{mark}" for n, marks in ((size, ",|"), (self.pieces.size, ",;")) for mark in marks for i in range(n)], pa.string())

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, int]:
        """(offsets, words, distinct words, how many of these may stand side by side)."""
        blank = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        whole = pc.or_(pc.match_substring_regex(texts, UNEVEN), pc.match_substring(texts, SPACE)).to_numpy(zero_copy_only=False) & ~blank
        whole |= ~blank & (not self.pieces.cuts)
        listed = pc.split_pattern(texts.take(pa.array(np.flatnonzero(~whole & ~blank))), " ")
        flat = pc.list_flatten(listed).dictionary_encode()
        counts = np.zeros(len(texts), np.int64)
        counts[~whole & ~blank] = pc.list_value_length(listed).to_numpy(zero_copy_only=False)
        counts[whole] = 1
        at, own, n = np.empty(int(counts.sum()), np.int64), np.repeat(whole, counts), len(flat.dictionary)
        at[~own] = flat.indices.to_numpy(zero_copy_only=False)
        at[own] = n + np.arange(int(whole.sum()))
        return np.concatenate([[0], np.cumsum(counts)]), at, pa.concat_arrays([flat.dictionary, texts.take(pa.array(np.flatnonzero(whole)))]), n

    def first_ids(self, spaced: str, ends: np.ndarray, side_by_side: int) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the first tokenizer for words in `spaced`, each with a space before it; ends: by characters, from 0."""
        cut = np.searchsorted(ends[: side_by_side + 1], np.arange(0, ends[side_by_side], LINE))
        at = ends[np.unique(np.concatenate([cut, np.arange(side_by_side, len(ends))]))].tolist()
        coded = self.library.encode_batch_fast([spaced[a:b] for a, b in zip(at, at[1:])], add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, np.int64), *[x.ids for x in coded]]).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(self.lengths[0][ids])])

    def align(self, texts: pa.Array) -> Aligned:
        out = Aligned()
        texts = pc.fill_null(texts.cast(pa.string()), "")
        out.of_text, out.words, words, side_by_side = self.words(texts)
        spaced = pc.binary_join_element_wise(" ", words, "")
        whole, ends = joined(spaced), np.concatenate([[0], np.cumsum(pc.utf8_length(spaced).to_numpy(zero_copy_only=False).astype(np.int64))])
        spelled, byte_ends = whole.encode(), np.concatenate([[0], np.cumsum(pc.binary_length(spaced).to_numpy(zero_copy_only=False).astype(np.int64))])
        a, a_bytes = self.first_ids(whole, ends, side_by_side)
        b_offsets, b = self.pieces.ids(words)
        b = b.astype(np.int64)
        b_bytes = np.concatenate([[0], np.cumsum(self.lengths[1][b])])
        a_offsets = np.searchsorted(a_bytes, byte_ends)
        # Words whose tokens don't spell them have no tokens.
        texts_of = [b"".join(map(t.__getitem__, ids.tolist())) for t, ids in zip(self.tables, (a, b))]
        ok = np.ones(len(words), bool)
        if texts_of[0] != spelled or texts_of[1] != spelled or not np.array_equal(b_bytes[b_offsets], byte_ends):
            for k in range(len(words)):
                want = spelled[byte_ends[k] : byte_ends[k + 1]]
                ok[k] = all(x[y[o[k]] : y[o[k + 1]]] == want for x, y, o in zip(texts_of, (a_bytes, b_bytes), (a_offsets, b_offsets)))
            a, a_offsets = a[np.repeat(ok, np.diff(a_offsets))], np.concatenate([[0], np.cumsum(np.diff(a_offsets) * ok)])
            b, b_offsets = b[np.repeat(ok, np.diff(b_offsets))], np.concatenate([[0], np.cumsum(np.diff(b_offsets) * ok)])
        if not ok.all():  # and so do the texts that such a word is in
            bad = np.concatenate([[0], np.cumsum(~ok[out.words])])
            good = bad[out.of_text[1:]] == bad[out.of_text[:-1]]
            out.words = out.words[np.repeat(good, np.diff(out.of_text))]
            out.of_text = np.concatenate([[0], np.cumsum(np.diff(out.of_text) * good)])
        at_a, at_b = self.transducer.ends(a.tolist(), b.tolist())
        out.links = (a[at_a - 1] << 32) | b[at_b - 1]
        out.n = np.diff(a_offsets), np.diff(b_offsets)
        out.of_word = np.searchsorted(at_a, a_offsets, "right")
        # Ids in the order of groups, the first side's before the second's, each with its mark.
        n_a, n_b = np.diff(np.concatenate([[0], at_a])), np.diff(np.concatenate([[0], at_b]))
        marked = np.empty(len(a) + len(b), np.int64)
        a_at, b_at = np.arange(len(a)) + np.repeat(at_b - n_b, n_a), np.arange(len(b)) + np.repeat(at_a, n_b)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[at_a - 1], last_b[at_b - 1] = len(self.tables[0]), len(self.tables[1])
        marked[a_at], marked[b_at] = a + last_a, 2 * len(self.tables[0]) + b + last_b
        shown = self.shown.take(pa.array(marked))
        text_ends = np.frombuffer(shown.buffers()[1], "<i4", len(shown) + 1, shown.offset * 4) if len(shown) else np.zeros(1, "<i4")
        out.groups = pa.Array.from_buffers(pa.string(), len(words), [None, pa.py_buffer(text_ends[a_offsets + b_offsets].astype("<i4")), shown.buffers()[2] or pa.py_buffer(b"")])
        return out


@functools.lru_cache(maxsize=2)
def aligner(first: str, second: bytes) -> Aligner:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Aligner(first, second)


def _sources(docs: DataFrame, first: str, second: str):
    with open(first, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read()), source_of(docs, second)


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def align(docs: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, groups (`a1,a2|b1;a3|b2,b3`), links (array of struct(a, b): the tokens that end each group) of each row of docs.

    first, second: the vocabulary files; the first one gets a space and the
    text, the second one the text, before which it sets a space itself. Null
    and empty texts, and those that the tokens of either side don't spell, have
    no tokens: zeros and nothing. Very long texts are aligned whole; repeated
    rows give repeated rows; an empty table gives none; extra columns aren't read.
    """
    sources = _sources(docs, first, second)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = aligner(*[s.value for s in sources])
        for batch in batches:
            for at, n in slices(batch.column(1), TOGETHER):
                part = batch.slice(at, n)
                found = use.align(part.column(1))
                offsets, links = found.texts_links()
                pairs = found.links[links]
                ends, data = found.texts_groups()
                groups = pc.utf8_rtrim(binaries(ends, np.frombuffer(data, np.uint8), pa.string()), ";")
                both = pa.StructArray.from_arrays([pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32))], ["a", "b"])
                cols = [part.column(0), pa.array(found.totals(found.n[0])), pa.array(found.totals(found.n[1])), groups, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), both)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_a", "n_b", "groups", "links"])

    return _rows(docs, key, text).mapInArrow(run, "doc_id long, n_a long, n_b long, groups string, links array<struct<a:int,b:int>>")


PARTS = "block long, doc_id long, n_a long, n_b long, n_links long, groups_sha256 string, at array<int>, times array<int>, pairs array<long>, held array<long>"
COUNTED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def _parts(sources):
    """A block for each slice of texts: a row for each of its texts, with the places of its pairs among the block's, and a row with these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, block = aligner(*[s.value for s in sources]), TaskContext.get().partitionId() << 32
        schema = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
                            ("at", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("pairs", pa.list_(pa.int64())), ("held", pa.list_(pa.int64()))])
        for batch in batches:
            for at, n in slices(batch.column(1), TOGETHER):
                part = batch.slice(at, n)
                found = use.align(part.column(1))
                pairs, own = np.unique(found.links, return_inverse=True)
                offsets, links = found.texts_links()
                code = np.repeat(np.arange(n, dtype=np.int64) * max(1, len(pairs)), np.diff(offsets)) + own[links]
                code.sort()
                first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
                times, code = np.diff(np.concatenate([first, [len(code)]])), code[first]
                of_text, place = np.searchsorted(code, np.arange(n + 1, dtype=np.int64) * max(1, len(pairs))), code % max(1, len(pairs))
                ends, data = found.texts_groups()
                view = memoryview(data)
                sha = [hashlib.sha256(view[a : b - 1]).hexdigest() if b > a else "" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                cols = [pa.array(np.full(n, block)), part.column(0), pa.array(found.totals(found.n[0])), pa.array(found.totals(found.n[1])), pa.array(np.diff(offsets)), pa.array(sha, pa.string()),
                        _lists(of_text, place, pa.int32()), _lists(of_text, times, pa.int32()), pa.nulls(n, schema.field("pairs").type), pa.nulls(n, schema.field("held").type)]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)
                held = np.bincount(place, times, len(pairs)).astype(np.int64)
                yield pa.RecordBatch.from_pylist([{"block": block, "pairs": pairs, "held": held}], schema)
                block += 1

    return run


def _sum_up(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """The texts of a block with the corpus-wide counts of its pairs."""
    n, best = (np.zeros(counts.num_rows, np.int64) for _ in range(2))
    place = counts["place"].to_numpy()
    n[place], best[place] = counts["n"].to_numpy(), counts["best"].to_numpy(zero_copy_only=False)
    at, times = docs["at"].combine_chunks(), docs["times"].combine_chunks()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(at).to_numpy(zero_copy_only=False).astype(np.int64))])
    at, times = pc.list_flatten(at).to_numpy(), pc.list_flatten(times).to_numpy().astype(np.int64)
    summed = lambda x: np.diff(np.concatenate([[0], np.cumsum(times * x[at])])[ends])
    cols = [docs["doc_id"], docs["n_a"], docs["n_b"], docs["n_links"], docs["n_links"], pa.array(summed(best)), pa.array(summed(n)), docs["groups_sha256"]]
    return pa.table(cols, names=[c.split()[0] for c in COUNTED.split(", ")])


def count_links(docs: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """COUNTED of each row of docs: its tokens, groups and links, how many of its links are the best for their second token, and the sum of their counts.

    Links meet their counts by blocks: the texts of a slice (at most TOGETHER
    bytes, or one text) share one list of distinct pairs, which is summed up over the corpus
    and comes back to the block once. So what is shuffled goes with the blocks'
    distinct pairs and not with the links, a pair that every text has is one row
    a block, and no table is broadcast. Rows as in `align`.
    """
    parts = stash(_rows(docs, key, text).mapInArrow(_parts(_sources(docs, first, second)), PARTS), "alignment")
    held = parts.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "held")).alias("place", "x"))
    held = held.select(F.col("block").alias("of_block"), "place", F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))
    counts = held.groupBy("pair").agg(F.sum("held").alias("n"))
    best = F.max("n").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))))
    counts = counts.withColumn("best", F.col("n") == best)
    known = held.drop("held").join(counts, "pair").select("of_block", "place", "n", "best")
    texts = parts.where("pairs is null").drop("pairs", "held")
    return texts.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(_sum_up, COUNTED)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_links(read(spark, sf_dir, "documents"), *default_paths())
