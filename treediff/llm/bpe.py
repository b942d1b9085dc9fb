"""BPE encoding and decoding with a public vocabulary, by a pair occurrence index."""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from treediff.llm.common import read
from treediff.llm.pieces import binaries, places, slices

#: Words whose ids a worker keeps at most.
CACHED_WORDS = 600_000
#: Characters for which this module's own splitting is used: printable ASCII, Latin-1 and the
#: Latin extensions, and common white space. Other texts take the vocabulary file's splitter.
PLAIN = regex.compile("[\\t-\\r -~\\u00a0-\\u024f]*")
#: A fixed value: the vocabulary's pattern of words.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself where it prints, else the next of 256, 257, ..."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Bpe:
    """One vocabulary file: words to ids, texts to ids, ids to text."""

    def __init__(self, source: str):
        data = json.loads(source)
        model = data["model"]
        self.library = Tokenizer.from_str(source)
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.letter_byte = {ord(c): b for b, c in letters.items()}
        self.inner = [vocab[letters[b]] for b in range(256)]
        self.final = [vocab[letters[b] + end] for b in range(256)]
        self.rules = []
        self.rank: dict[tuple[int, int], int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rules.append((vocab[a], vocab[b], vocab[a + b]))
            self.rank.setdefault(self.rules[-1][:2], r)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")") if self.special else None
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        shown = [self.token.get(i, "") for i in range(max(self.token) + 1)]
        self.said = pa.array([x + " " for x in shown] + shown, pa.string())  # the second half: as the last token of a text
        self.cache: dict[str, bytes] = {}

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word.

        All words' symbols lie in one list. The index has for each pair that a
        rule merges the positions of its left symbols; ranks are applied in
        ascending order, each to all its positions, left ones first, and the
        lists of the pairs that arise beside a merge are extended. Should such a
        pair have a lower rank than the current one, that rank comes first.
        """
        symbol, after, before, heads = [], [], [], []
        for w in words:
            s = len(symbol)
            heads.append(s)
            symbol += [self.inner[b] for b in w[:-1]]
            symbol.append(self.final[w[-1]])
            after += [*range(s + 1, s + len(w)), -1]
            before += [-1, *range(s, s + len(w) - 1)]
        rank, index = self.rank, {}
        for i, j in enumerate(after):
            if j >= 0 and (r := rank.get((symbol[i], symbol[j]))) is not None:
                index.setdefault(r, []).append(i)
        active = list(index)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            places = index.pop(r, None)
            if places is None:
                continue
            places.sort()
            left, right, new = self.rules[r]
            for n, i in enumerate(places):
                j = after[i]
                if symbol[i] != left or j < 0 or symbol[j] != right:
                    continue  # another merge has taken one of the two
                symbol[i], symbol[j] = new, -1
                k, h, lower = after[j], before[i], False
                after[i] = k
                if k >= 0:
                    before[k] = i
                    if (q := rank.get((new, symbol[k]))) is not None:
                        if q not in index:
                            heapq.heappush(active, q)
                        index.setdefault(q, []).append(i)
                        lower |= q < r
                if h >= 0 and (q := rank.get((symbol[h], new))) is not None:
                    if q not in index:
                        heapq.heappush(active, q)
                    index.setdefault(q, []).append(h)
                    lower |= q < r
                if lower:
                    index[r] = places[n + 1 :] + index.get(r, [])
                    heapq.heappush(active, r)
                    break
        out = []
        for i in heads:
            ids = []
            while i >= 0:
                ids.append(symbol[i])
                i = after[i]
            out.append(ids)
        return out

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens, normalised as the vocabulary asks."""
        if PLAIN.fullmatch(text):
            return WORD.findall(unicodedata.normalize("NFC", text).lower())
        normal = self.library.normalizer.normalize_str(text)
        return [bytes(self.letter_byte[ord(c)] for c in w).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def learn(self, words: set[str]) -> None:
        """Put the ids of all these words into the cache, new ones through one index."""
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        new = [w for w in words if w not in self.cache]
        for w, ids in zip(new, self.merge([w.encode() for w in new])):
            self.cache[w] = np.array(ids, "<u4").tobytes()

    def pieces(self, text: str) -> list[str | bytes]:
        """Words, and the ids of special tokens as bytes, in order."""
        if not self.special or "<|" not in text:
            return self.words(text)
        out: list[str | bytes] = []
        for part in self.cut.split(text):
            out += [np.array([self.special[part]], "<u4").tobytes()] if part in self.special else self.words(part)
        return out

    def chunks(self, keys: list[str]) -> list[bytes]:
        """Ids of each chunk, all new words through one index."""
        pieces = [self.pieces(k) for k in keys]
        self.learn({w for p in pieces for w in p if type(w) is str})
        find = self.cache
        return [find[p[0]] if len(p) == 1 and type(p[0]) is str else b"".join([find[w] if type(w) is str else w for w in p]) for p in pieces]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of texts.

        No word and no special token goes across a space or a line feed, and
        neither does the normalisation: texts are cut there, and each distinct
        chunk is taken apart and encoded once.
        """
        listed = pc.split_pattern(pc.replace_substring(pc.fill_null(texts.cast(pa.string()), ""), "\n", " "), " ")
        of_text = np.concatenate([[0], np.cumsum(pc.list_value_length(listed).to_numpy(zero_copy_only=False).astype(np.int64))])
        flat = pc.list_flatten(listed).dictionary_encode()
        coded = self.chunks(flat.dictionary.to_pylist())
        at, lengths = flat.indices.to_numpy(zero_copy_only=False), np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        ids, starts = np.frombuffer(b"".join(coded), "<u4"), np.concatenate([[0], np.cumsum(lengths)])
        own = lengths[at]
        return np.concatenate([[0], np.cumsum(own)])[of_text], ids[places(starts[at], own)]

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> pa.Array:
        """The texts of ids: their tokens, joined by spaces."""
        code = ids.astype(np.int64)
        code[offsets[1:][offsets[1:] > offsets[:-1]] - 1] += len(self.said) // 2
        said = self.said.take(pa.array(code))
        ends = np.frombuffer(said.buffers()[1], "<i4", len(said) + 1, said.offset * 4) if len(said) else np.zeros(1, "<i4")
        return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(ends[offsets].astype("<i4")), said.buffers()[2] or pa.py_buffer(b"")])


@functools.lru_cache(maxsize=2)
def vocabulary(source: str) -> Bpe:
    return Bpe(source)


def _code(source):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(source.value)
        for batch in batches:
            for at, n in slices(batch.column(1)):
                part = batch.slice(at, n)
                offsets, ids = bpe.encode(part.column(1))
                cols = [part.column(0), pa.array(np.diff(offsets)), binaries(4 * offsets, ids, pa.binary()), bpe.decode(offsets, ids)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids", "decoded"])

    return run


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit), decoded (string) of each row of docs.

    path: the vocabulary file, read by the driver and broadcast (its size is the
    vocabulary's). A null text counts as empty and has no ids; texts of any
    length are encoded whole. Repeated rows
    give repeated rows; an empty table gives none; extra columns aren't read.
    """
    with open(path, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_code(source), "doc_id long, n_tokens long, ids binary, decoded string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digest(coded: DataFrame) -> DataFrame:
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(encode(read(spark, sf_dir, "documents"), default_path()))
