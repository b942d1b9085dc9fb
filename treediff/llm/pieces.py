"""SentencePiece encoding and decoding for models of merges: a score-ordered agenda of adjacent symbol pairs."""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treediff.llm.common import read

#: Symbols up to which chunks of one length are merged side by side; longer ones have a heap each.
SIDE_BY_SIDE = 40
#: Bytes of texts that are encoded together; a longer text is encoded alone.
TOGETHER = 8_000_000
#: The sign for a space inside models, and what stands for a byte that is no character.
SPACE, LOST = "\u2581", "\ufffd"
NONE = np.int64(2**62)


def places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each stretch, one after another."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def slices(texts: pa.Array, most: int = TOGETHER) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of slices of at most that many bytes, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to - at
        at = to


def binaries(offsets: np.ndarray, data: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype("<i4")), pa.py_buffer(np.ascontiguousarray(data))])


def joined(texts: pa.Array) -> str:
    """All texts of an array, none of them null, as one."""
    if not len(texts):
        return ""
    ends = np.frombuffer(texts.buffers()[1], "<i4", len(texts) + 1, texts.offset * 4)
    return texts.buffers()[2][int(ends[0]) : int(ends[-1])].to_pybytes().decode() if ends[-1] > ends[0] else ""


class Pieces:
    """One model file: texts to ids, ids to text.

    A text is cut into chunks before each run of spaces and before each line
    feed. As no piece of the model goes across such a place (else `cuts` is
    false, and a text is one chunk), chunks are merged apart from each other:
    each distinct one of an Arrow batch once, and each is compared with the
    library. A chunk's key leaves out the one space before it, unless the chunk
    begins with a line feed.
    """

    def __init__(self, source: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto.FromString(source)
        spec, kinds = model.normalizer_spec, proto.ModelProto.SentencePiece
        known = {kinds.NORMAL, kinds.CONTROL, kinds.UNKNOWN, kinds.BYTE}
        if model.trainer_spec.model_type != model.trainer_spec.BPE or not {p.type for p in model.pieces} <= known:
            raise ValueError("only models of merges without pieces of the user's own can be used")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that leave texts as they are, but for a space before them, can be used")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=source)
        self.begin, self.end, self.size = self.library.bos_id(), self.library.eos_id(), len(model.pieces)
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.byte_id = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        if len(self.byte_id) < 256:
            raise ValueError("the model must write unknown characters as bytes")
        spoken = {i: bytes([b]) for b, i in self.byte_id.items()} | {i: p.replace(SPACE, " ").encode() for p, i in normal.items()}
        self.spoken = [spoken.get(i, b"") for i in range(self.size)]
        self.is_byte, self.is_silent = np.zeros(self.size, bool), np.array([not x for x in self.spoken])
        self.is_byte[list(self.byte_id.values())] = True
        first = [x[1:] if x[:1] == b" " and not b else x for x, b in zip(self.spoken, self.is_byte)]
        self.said = pa.array(self.spoken + first, pa.binary())  # the second half: as the first piece of a text
        self.cuts = not any(SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1) for p in normal)

        # Symbols: pieces, then characters that only longer pieces have, then one for all other characters;
        # a character of one byte that is in no piece is that byte's piece.
        inner = sorted({c for p in normal for c in p} - normal.keys())
        self.symbol = normal | {c: self.size + k for k, c in enumerate(inner)}
        self.unknown = self.size + len(inner)
        self.of_char = np.full(0x110000, self.unknown, np.int32)
        for b in range(128):
            self.of_char[b] = self.byte_id[b]
        for p, s in self.symbol.items():
            if len(p) == 1:
                self.of_char[ord(p)] = s
        self.of_char[32] = self.symbol[SPACE]
        # Pairs: (left, right) to the place of their piece in the order of scores, and the piece.
        order = {x: k for k, x in enumerate(sorted({model.pieces[i].score for i in normal.values()}, reverse=True))}
        self.pairs = {}
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if a is not None and b is not None:
                    self.pairs[a, b] = (order[model.pieces[i].score], i)
        keys = np.array([a * (self.unknown + 1) + b for a, b in self.pairs], np.int64)
        by = np.argsort(keys)
        self.keys = np.append(keys[by], NONE)
        self.rank = np.append(np.array([r for r, _ in self.pairs.values()], np.int64)[by], NONE)
        self.made = np.append(np.array([i for _, i in self.pairs.values()], np.int32)[by], 0)

    def agenda(self, symbols: list[int]) -> list[int]:
        """The symbols of one chunk after all merges: a heap of pairs by score, ties to the left; a pair that is gone is passed over."""
        after, before, heap = [*range(1, len(symbols)), -1], [*range(-1, len(symbols) - 1)], []

        def add(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (found := self.pairs.get((symbols[i], symbols[j]))):
                heapq.heappush(heap, (found[0], i, symbols[i], symbols[j], j, found[1]))

        for i in range(len(symbols) - 1):
            add(i, i + 1)
        while heap:
            _, i, left, right, j, new = heapq.heappop(heap)
            if symbols[i] != left or after[i] != j or symbols[j] != right:
                continue
            symbols[i], symbols[j] = new, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            add(before[i], i)
            add(i, after[i])
        return [s for s in symbols if s >= 0]

    def _entries(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places in the table of pairs, the last one for pairs that make no piece."""
        key = left.astype(np.int64) * (self.unknown + 1) + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, at, len(self.keys) - 1)

    def agendas(self, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, their symbols after all merges) of chunks of one length, a row each.

        A row's entries are its agenda: in each step every row takes its best
        entry (by score, ties to the left), the two symbols become one and the
        entries beside it are renewed. Rows without an entry are done.
        """
        rows = np.arange(len(symbols))
        entry = self._entries(symbols[:, :-1], symbols[:, 1:])
        while symbols.shape[1] > 1:
            rank = self.rank[entry]
            at = rank.argmin(axis=1)
            going = rank[np.arange(len(rows)), at] < NONE
            if not going.all():
                yield rows[~going], symbols[~going]
                rows, symbols, entry, at = rows[going], symbols[going], entry[going], at[going]
                if not len(rows):
                    return
            every, n = np.arange(len(rows)), symbols.shape[1]
            new = self.made[entry[every, at]]
            symbols = symbols[np.arange(n) != (at + 1)[:, None]].reshape(len(rows), n - 1)
            symbols[every, at] = new
            entry = entry[np.arange(n - 1) != at[:, None]].reshape(len(rows), n - 2)
            has = np.flatnonzero(at > 0)
            entry[has, at[has] - 1] = self._entries(symbols[has, at[has] - 1], new[has])
            has = np.flatnonzero(at < n - 2)
            entry[has, at[has]] = self._entries(new[has], symbols[has, at[has] + 1])
        yield rows, symbols

    def _written(self, symbols: list[int], surface: str) -> list[int]:
        """Ids of symbols; those that are no pieces are written as the bytes of their characters."""
        ids, at = [], 0
        for s in symbols:
            if s < self.size:
                ids.append(s)
                at += len(self.spoken[s].decode())
            else:
                ids += [self.byte_id[b] for b in surface[at].encode()]
                at += 1
        return ids

    def surfaces(self, keys: pa.Array) -> pa.Array:
        """Chunks as they are merged: with the space that their keys leave out."""
        if not self.cuts:
            return keys
        own = pc.starts_with(pc.utf8_ltrim(keys, " "), "\n")
        return pc.if_else(own, keys, pc.binary_join_element_wise(" ", keys, ""))

    def merged(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of chunks; ValueError where the library has others."""
        surfaces = self.surfaces(keys)
        lengths = pc.utf8_length(surfaces).to_numpy(zero_copy_only=False).astype(np.int64)
        whole, starts = joined(surfaces), np.concatenate([[0], np.cumsum(lengths)])
        symbols = self.of_char[np.frombuffer(whole.encode("utf-32-le"), "<u4")]
        counts, done = np.zeros(len(lengths), np.int64), []
        order = np.argsort(lengths, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
            n = int(lengths[group[0]]) if len(group) else 0
            if n > SIDE_BY_SIDE:
                found = [(group[k : k + 1], np.array([self.agenda(symbols[starts[i] : starts[i] + n].tolist())], np.int32)) for k, i in enumerate(group.tolist())]
            elif n:
                found = [(group[rows], m) for rows, m in self.agendas(symbols[starts[group][:, None] + np.arange(n)])]
            else:
                found = []
            for rows, m in found:
                odd = (m >= self.size).any(axis=1)
                for r in np.flatnonzero(odd).tolist():
                    ids = self._written(m[r].tolist(), whole[starts[rows[r]] : starts[rows[r] + 1]])
                    counts[rows[r]] = len(ids)
                    done.append((rows[r : r + 1], np.array([ids])))
                counts[rows[~odd]] = m.shape[1]
                done.append((rows[~odd], m[~odd]))
        offsets = np.concatenate([[0], np.cumsum(counts)])
        ids = np.empty(offsets[-1], "<u4")
        for rows, m in done:
            ids[offsets[rows][:, None] + np.arange(m.shape[1])] = m
        blank = pc.equal(pc.utf8_ltrim(surfaces, " "), "").to_numpy(zero_copy_only=False)
        self.check(whole, starts, np.flatnonzero(blank), offsets, ids)
        return offsets, ids

    def check(self, whole: str, starts: np.ndarray, blank: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> None:
        """Compare distinct chunks (one after another in `whole`) with the library: hundreds of them in each text that it gets.

        It sets a space before each text, which is left out where the text has one
        itself, and is one id more before a line feed. Chunks of spaces alone
        (`blank`), which would run into the next one, are texts of their own.
        """
        n, space = len(starts) - 1, self.symbol[SPACE]
        cut = np.searchsorted(starts, np.arange(2000, len(whole), 2000)) if self.cuts else np.arange(n)
        cut = np.unique(np.concatenate([[0, n], cut, blank, blank + 1])).astype(np.int64)
        texts, wanted, at = [], [], starts[cut].tolist()
        for a, b, x, y in zip(at, at[1:], offsets[cut].tolist(), offsets[cut[1:]].tolist()):
            text, own = whole[a:b], ids[x:y].tolist()
            if text == " ":
                text, own = " \n", [*own, self.byte_id[10]]
            texts.append(text[1:] if text[0] == " " else text)
            wanted.append(own if text[0] == " " else [space, *own])
        found = self.library.encode(texts, num_threads=1)
        if found != wanted:
            wrong = next(t for t, f, w in zip(texts, found, wanted) if f != w)
            raise ValueError(f"the library has other ids for some of {wrong[:200]!r}")

    def chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(offsets, chunks, keys): each text's chunks as places in the distinct keys."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if pc.any(pc.match_substring(texts, SPACE)).as_py():
            texts = pc.replace_substring(texts, SPACE, " ")
        if self.cuts:
            spread = pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " "))
            fed = pc.replace_substring(texts, "\n", " \n")
            listed = pc.split_pattern(fed, " ")
            if (odd := np.flatnonzero(spread.to_numpy(zero_copy_only=False))).size:
                rare = [[c[1:] for c in re.findall(" *[^ ]+| +$", " " + x)] for x in fed.take(pa.array(odd)).to_pylist()]
                by = np.arange(len(texts))
                by[odd] = len(texts) + np.arange(len(odd))
                listed = pa.concat_arrays([listed, pa.array(rare, listed.type)]).take(pa.array(by))
            counts = pc.list_value_length(listed).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.list_flatten(listed).dictionary_encode()
        else:
            counts = np.ones(len(texts), np.int64)
            flat = pc.binary_join_element_wise(" ", texts, "").dictionary_encode()
        at = flat.indices.to_numpy(zero_copy_only=False)
        if (blank := pc.equal(texts, "").to_numpy(zero_copy_only=False)).any():  # an empty text has no chunk
            at = at[~np.repeat(blank, counts)]
            counts[blank] = 0
        return np.concatenate([[0], np.cumsum(counts)]), at, flat.dictionary

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of texts, without begin and end."""
        of_text, at, keys = self.chunks(texts)
        offsets, ids = self.merged(keys)
        lengths = np.diff(offsets)[at]
        return np.concatenate([[0], np.cumsum(lengths)])[of_text], ids[places(offsets[at], lengths)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of texts, each between the ids of begin and end."""
        offsets, ids = self.ids(texts)
        n = np.arange(len(offsets))
        out, inner = np.empty(len(ids) + 2 * n[-1], "<u4"), np.ones(len(ids) + 2 * n[-1], bool)
        new = offsets + 2 * n
        inner[new[:-1]] = inner[new[1:] - 1] = False
        out[new[:-1]], out[new[1:] - 1] = self.begin, self.end
        out[inner] = ids
        return new, out

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> pa.Array:
        """The texts of ids: the first piece's one leading space goes; bytes that are no characters are LOST one by one."""
        loud = np.flatnonzero(~self.is_silent[ids])
        inside = np.searchsorted(loud, offsets)
        some = inside[:-1] < inside[1:]
        gaps = np.flatnonzero(np.diff(loud) > 1) + 1  # an id without a text parts the bytes beside it
        if not np.isin(gaps, inside).all():
            return self._slowly(offsets, ids)
        code = ids[loud].astype(np.int64)
        code[inside[:-1][some]] += self.size
        said = self.said.take(pa.array(code))
        ends = np.frombuffer(said.buffers()[1], "<i4", len(said) + 1, said.offset * 4) if len(said) else np.zeros(1, "<i4")
        text = pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(ends[inside].astype("<i4")), said.buffers()[2] or pa.py_buffer(b"")])
        try:
            text.validate(full=True)
        except pa.ArrowInvalid:
            return self._slowly(offsets, ids)
        return text

    def _slowly(self, offsets: np.ndarray, ids: np.ndarray) -> pa.Array:
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            text, run, begun = [], b"", False
            for i in [*ids[a:b].tolist(), None]:
                if i is not None and self.is_byte[i]:
                    run, begun = run + self.spoken[i], True
                    continue
                while run:
                    for n in (1, 2, 3, 4):
                        try:
                            c, run = run[:n].decode(), run[n:]
                            break
                        except UnicodeDecodeError:
                            continue
                    else:
                        c, run = LOST, run[1:]
                    text.append(c)
                if i is not None and (part := self.spoken[i].decode()):
                    text.append(part if begun else part.removeprefix(" "))
                    begun = True
            out.append("".join(text))
        return pa.array(out, pa.string())


@functools.lru_cache(maxsize=2)
def model(source: bytes) -> Pieces:
    return Pieces(source)


def _code(source):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(source.value)
        for batch in batches:
            for at, n in slices(batch.column(1)):
                part = batch.slice(at, n)
                offsets, ids = pieces.encode(part.column(1))
                cols = [part.column(0), pa.array(np.diff(offsets)), binaries(4 * offsets, ids, pa.binary()), pieces.decode(offsets, ids)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids", "decoded"])

    return run


def source_of(docs: DataFrame, path: str):
    """The model file, read by the driver and broadcast: its size is the model's."""
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit, begin and end included), decoded (string) of each row of docs.

    A null text counts as empty and has the ids of begin and end only. Very long
    texts are encoded whole, chunk by chunk; a chunk of any length has its own
    heap. Repeated rows give repeated rows; an empty table gives none; extra
    columns aren't read. ValueError where the library has other ids for a chunk.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_code(source_of(docs, path)), "doc_id long, n_tokens long, ids binary, decoded string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(read(spark, sf_dir, "documents"), default_path())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
