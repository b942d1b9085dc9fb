"""Exact removal of passages that occur more than once, by super-k-mer partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treediff.llm.bytewords import mix, run_hashes, sliding_min, word_bounds
from treediff.llm.common import column, free_names, partitions, read

WINDOW = 35
#: Words of the m-mers whose smallest hash deals out a window.
MINIMISER = 3
#: Bytes of text that a task takes at once.
CHUNK = 4_000_000
#: Buckets for each shuffle partition: what one call of the counting step holds.
BUCKETS = 4
PACKED = "bucket int, texts binary, places binary, done binary"
#: Bytes of text of a bucket that are counted at once; more are dealt out to parts by their next minimiser.
SPLIT = 24_000_000
#: Bytes of runs that a task remembers as sent, so that a passage of many texts goes out once a task.
REMEMBERED = 16_000_000
RANGES = "doc_id long, mark long, first int, last int"


def _pack(*columns: np.ndarray) -> bytes:
    """int64 columns of one length, byte by byte position so that they compress."""
    rows = np.stack(columns).astype(np.int64)
    return zstandard.compress(np.ascontiguousarray(rows.view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1)).tobytes(), 3)


def _unpack(blob: bytes, columns: int) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return np.ascontiguousarray(flat.reshape(columns, 8, -1).transpose(0, 2, 1)).view(np.int64)[:, :, 0]


def super_kmers(texts: list[bytes], window: int, m: int, salt: int = 0) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows of a text that share a minimiser.

    Returns the joined words, the words' starts and ends in it, and for each run
    its text, its first word (in the joined words), its number of words and its
    minimiser's hash; the offsets of the texts' words are starts of the texts.
    Another salt gives another order of m-mers, and so other minimisers.
    """
    split = [t.split() for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    buf = b" ".join(b" ".join(w) for w in split if w)
    starts, ends, b = word_bounds(buf)
    doc = np.repeat(np.arange(len(texts)), counts)
    none = np.empty(0, np.int64)
    if len(doc) < window:
        return buf, starts, ends, none, none, none, np.empty(0, np.uint64)
    h = run_hashes(b, starts, ends)
    at = np.arange(len(h) - m + 1)
    grams = run_hashes(h, at, at + m)
    low = sliding_min(mix(grams ^ np.uint64(salt)) if salt else grams, window - m + 1)
    inside = doc[: len(low)] == doc[window - 1 :]
    new = inside.copy()
    new[1:] &= (low[1:] != low[:-1]) | ~inside[:-1] | (doc[1 : len(low)] != doc[: len(low) - 1])
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    length = np.bincount(run[inside], minlength=len(first)) + window - 1
    return buf, starts, ends, doc[first], first, length, low[first]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[tuple[int, int]]]]:
    texts, rows, size = [], [], 0
    for batch in batches:
        for key, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
            texts.append(text.as_py() or b"")
            rows.append((key, mark))
            size += len(texts[-1])
            if size >= CHUNK:
                yield texts, rows
                texts, rows, size = [], [], 0
    if texts:
        yield texts, rows


class Sent:
    """Runs that a task has sent out, by their words: the place of each, and whether it is known to repeat."""

    def __init__(self) -> None:
        self.runs: dict[bytes, list] = {}
        self.size = 0

    def again(self, run: bytes, place: tuple[int, int, int, int], known: bool) -> tuple[bool, list | None]:
        """Whether the run has gone out before; if so, and for the first time, the place that it had then."""
        found = self.runs.get(run)
        if found is None:
            if self.size > REMEMBERED:
                self.runs.clear()
                self.size = 0
            self.runs[run] = [place, known]
            self.size += len(run) + 200
            return False, None
        first, found[1] = None if found[1] else found[0], True
        return True, first


def deal_out(window: int, m: int, buckets: int):
    """Texts to packed runs: a row for each chunk and bucket.

    A run's text goes out once a task (as far as REMEMBERED reaches). Runs that a
    task has twice are known to repeat: their places travel on, already decided
    (`done`), in a row of some bucket; a text whose run repeats within its chunk
    goes out marked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = Sent()
        for n, (texts, rows) in enumerate(_chunks(batches)):
            buf, starts, ends, doc, first, length, low = super_kmers(texts, window, m)
            if not len(first):
                continue
            keys, marks = np.array(rows, np.int64).T
            offset = np.concatenate([[0], np.cumsum([len(t.split()) for t in texts])])
            bucket = (low % np.uint64(buckets)).astype(np.int64)
            s, e = starts[first].tolist(), ends[first + length - 1].tolist()
            seen: dict[bytes, int] = {}
            same = np.fromiter((seen.setdefault(buf[x:y], k) for k, (x, y) in enumerate(zip(s, e))), np.int64, len(s))
            twice = np.bincount(same, minlength=len(s)) > 1
            place = np.stack([keys[doc], marks[doc], first - offset[doc], first - offset[doc] + length])
            own = np.flatnonzero(same == np.arange(len(s)))
            gone, before = np.zeros(len(s), bool), []
            for k in own.tolist():
                gone[k], old = sent.again(buf[s[k] : e[k]], tuple(place[:, k].tolist()), bool(twice[k]))
                if old is not None:
                    before.append(old)
            again = np.flatnonzero((twice | gone)[same])
            own = own[~gone[own]]
            own = own[np.argsort(bucket[own], kind="stable")]
            out = []
            for part in np.split(own, np.flatnonzero(np.diff(bucket[own])) + 1) if len(own) else ():
                blob = zstandard.compress(b"\n".join([buf[s[k] : e[k]] for k in part.tolist()]), 3)
                out.append((int(bucket[part[0]]), blob, _pack(*place[:3, part], twice[part].astype(np.int64)), None))
            done = [place[:, again]] + ([np.array(before, np.int64).T] if before else [])
            done = np.concatenate(done, axis=1)
            if done.shape[1]:
                out.append((int((int(keys[0]) * 31 + n) % buckets), None, None, _pack(*done)))
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "texts", "places", "done"])

    return run


def repeated_windows(buf: bytes, window: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs parted by line feeds: the run of each word, and whether the window that starts at a word repeats.

    Windows are sorted by hash; neighbours of equal hash are compared byte by
    byte, so that the groups are those of equal words. known: runs that occur
    elsewhere too.
    """
    starts, ends, b = word_bounds(buf)
    run = np.concatenate([[0], np.cumsum(b[starts[1:] - 1] == 10)])
    n = len(starts) - window + 1
    valid = np.flatnonzero(run[:n] == run[window - 1 :])
    h = run_hashes(run_hashes(b, starts, ends), valid, valid + window)
    order = np.argsort(h, kind="stable")
    h, where = h[order], valid[order]
    repeats = np.zeros(len(starts), bool)
    repeats[valid] = known[run[valid]]
    close = np.flatnonzero(h[1:] == h[:-1])
    spell = lambda k: buf[starts[where[k]] : ends[where[k] + window - 1]]
    equal = np.zeros(len(close), bool)
    for k in range(0, len(close), 1 << 16):  # a part at a time as lists
        i = where[close[k : k + (1 << 16)]]
        j = where[close[k : k + (1 << 16)] + 1]
        bounds = zip(starts[i].tolist(), ends[i + window - 1].tolist(), starts[j].tolist(), ends[j + window - 1].tolist())
        equal[k : k + len(i)] = [buf[a:b] == buf[c:d] for a, b, c, d in bounds]
    repeats[where[close[equal]]] = True
    repeats[where[close[equal] + 1]] = True
    for k in close[~equal].tolist():  # texts of one hash that differ: that hash's windows by their own bytes
        lo, hi = np.searchsorted(h, h[k], "left"), np.searchsorted(h, h[k], "right")
        groups: dict[bytes, list[int]] = {}
        for j in range(lo, hi):
            groups.setdefault(spell(j), []).append(j)
        for group in groups.values():
            if len(group) > 1:
                repeats[where[group]] = True
    return run, repeats


def _repeats(buf: bytes, places: np.ndarray, window: int) -> np.ndarray:
    """Runs and their places (key, mark, first word, known) to ranges of the words of their repeated windows."""
    key, mark, first, known = places
    runs, repeats = repeated_windows(buf, window, known.astype(bool))
    heads = np.concatenate([[0], np.flatnonzero(np.diff(runs)) + 1])
    hit = np.flatnonzero(repeats & ~known.astype(bool)[runs])
    if not len(hit):
        return np.empty((4, 0), np.int64)
    new = np.concatenate([[True], (np.diff(hit) > 1) | (np.diff(runs[hit]) > 0)])
    lo = hit[new]
    hi = hit[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(hit) - 1]])]
    r = runs[lo]
    at = first[r] - heads[r]
    return np.stack([key[r], mark[r], at + lo, at + hi + window])


def _split(blobs: list[tuple[bytes, bytes]], size: int, window: int, m: int, level: int) -> list[list[tuple[bytes, bytes]]]:
    """Packed runs dealt out to parts by their minimiser under another order of m-mers: equal windows come together again."""
    parts: list[list[tuple[bytes, bytes]]] = [[] for _ in range(2 * size // SPLIT + 2)]
    for texts, packed in blobs:
        runs, places = zstandard.decompress(texts).split(b"\n"), _unpack(packed, 4)
        buf, starts, ends, run, first, length, low = super_kmers(runs, window, m, salt=0x9E37 + level)
        offset = np.concatenate([[0], np.cumsum([len(r.split()) for r in runs])])
        part = (low % np.uint64(len(parts))).astype(np.int64)
        s, e = starts[first].tolist(), ends[first + length - 1].tolist()
        for p in np.unique(part).tolist():
            own = np.flatnonzero(part == p)
            place = places[:, run[own]].copy()
            place[2] += first[own] - offset[run[own]]
            parts[p].append((zstandard.compress(b"\n".join([buf[s[k] : e[k]] for k in own.tolist()]), 3), _pack(*place)))
    return parts


def _count(blobs: list[tuple[bytes, bytes]], window: int, m: int, level: int = 0) -> Iterator[np.ndarray]:
    size = sum(zstandard.frame_content_size(t) for t, _ in blobs)
    if size > SPLIT and level < 4:  # four orders: what stays together then has the same words nearly everywhere
        for part in _split(blobs, size, window, m, level):
            if part:
                yield from _count(part, window, m, level + 1)
    elif blobs:
        buf = b"\n".join([zstandard.decompress(t) for t, _ in blobs])
        yield _repeats(buf, np.concatenate([_unpack(p, 4) for _, p in blobs], axis=1), window)


def count_windows(window: int, m: int):
    """A bucket's packed runs to ranges of words to remove: doc_id, mark, first and last (exclusive)."""

    def run(table: pa.Table) -> pa.Table:
        out = [_unpack(x, 4) for x in table.column("done").drop_null().to_pylist()]
        packed = table.filter(pa.compute.is_valid(table.column("texts")))
        out += _count(list(zip(packed.column("texts").to_pylist(), packed.column("places").to_pylist())), window, m)
        rows = np.concatenate(out, axis=1) if out else np.empty((4, 0), np.int64)
        return pa.table({"doc_id": rows[0], "mark": rows[1], "first": rows[2].astype(np.int32), "last": rows[3].astype(np.int32)})

    return run


def _cut(text_at: int, replace: bool, carry: bool):
    """Rows (ranges in the last column) with their numbers of words and of removed ones, and the kept words.

    replace: they take the text's place where words are removed; else they are a column of their own.
    carry: with the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                texts, ranges = batch.column(text_at), batch.column(batch.num_columns - 1)
                n, gone, kept = [], [], []
                for text, cuts in zip(texts.cast(pa.binary()), ranges):
                    raw = text.as_py()
                    w = (raw or b"").split()
                    n.append(len(w))
                    if cuts.is_valid and len(cuts):
                        lo, hi = cuts.values.field(0).to_numpy(), cuts.values.field(1).to_numpy()
                        edge = np.zeros(len(w) + 1, np.int64)
                        np.add.at(edge, lo, 1)
                        np.add.at(edge, hi, -1)
                        stay = np.cumsum(edge[:-1]) == 0
                        w = [w[k] for k in np.flatnonzero(stay).tolist()]
                    gone.append(n[-1] - len(w))
                    kept.append(raw if replace and not gone[-1] else b" ".join(w))
                words = pa.array(kept, pa.binary()).cast(pa.string())
                columns = list(batch.columns[:-1])
                if replace:
                    columns[text_at] = words
                if not carry:
                    del columns[text_at]
                columns += [pa.array(n, pa.int64()), pa.array(gone, pa.int64())] + ([] if replace else [words])
                yield pa.RecordBatch.from_arrays(columns, [f"c{k}" for k in range(len(columns))])

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, m: int = MINIMISER, replace: bool = False, carry_text: bool = True) -> DataFrame:
    """docs without the words of every window that also starts elsewhere.

    A window is `window` consecutive words of one text; windows are judged on
    the input. Three columns follow those of docs: __n_words, __n_removed and
    __kept, the words that stay, joined by spaces. With `replace` two follow, and
    the words that stay take the place of the texts that lose any; other texts
    (nulls too) stay as they are. Without `carry_text` the text's column is left out.

    Null, blank and shorter texts lose nothing; all copies of a repeated passage
    go, those of repeated rows too; texts may be of any length. All columns of
    docs are carried, whatever their names: where docs has one of the new names,
    that gets more underscores (the new columns are always the last). A null key
    is a key of its own; an empty table gives no rows.

    Runs of windows travel to the bucket of their minimiser as compressed text;
    ranges of words come back by key and a 64-bit hash of the text, which keeps
    apart different texts that have one key; equal rows share one set of ranges.
    """
    n = partitions(docs.sparkSession)
    names = free_names(docs, "__n_words", "__n_removed", *([] if replace else ["__kept"]))
    own, body = column(docs, key), F.coalesce(column(docs, text), F.lit(""))
    id_of, mark = F.coalesce(own.cast("long"), F.lit(0)), F.xxhash64(body, own.isNull())
    packed = docs.select(id_of.alias("doc_id"), mark.alias("mark"), body.alias("text")).mapInArrow(deal_out(window, m, n * BUCKETS), PACKED)
    ranges = packed.groupBy("bucket").applyInArrow(count_windows(window, m), RANGES)
    ranges = ranges.groupBy(F.col("doc_id").alias("i"), F.col("mark").alias("h")).agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    whole = docs.select(*[column(docs, c).alias(f"c{k}") for k, c in enumerate(docs.columns)], id_of.alias("id"), mark.alias("mark"))
    joined = whole.join(ranges, (whole["id"] == ranges["i"]) & (whole["mark"] == ranges["h"]), "left").drop("id", "mark", "i", "h")
    at, left = docs.columns.index(text), [c for c in docs.columns if carry_text or c != text]
    extra = [F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("r"), *([] if replace else [F.lit("").alias("k")])]
    schema = docs.limit(0).select(*[column(docs, c) for c in left], *extra).toDF(*[f"c{k}" for k in range(len(left) + len(names))]).schema
    for f in schema.fields:
        f.nullable = True
    return joined.mapInArrow(_cut(at, replace, carry_text), schema).toDF(*left, *names)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), carry_text=False)
    return out.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.sha2("__kept", 256).alias("kept_sha256"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT u, unnest(range(1, len(w) - {WINDOW - 2})) AS i, w FROM d WHERE len(w) >= {WINDOW}),
g AS (SELECT u, i, count(*) OVER (PARTITION BY array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS c FROM p),
x AS (SELECT DISTINCT u, unnest(range(i, i + {WINDOW})) AS j FROM g WHERE c > 1),
k AS (SELECT u, list(j) AS gone FROM x GROUP BY u),
s AS (SELECT u, string_agg(t, ' ' ORDER BY j) AS kept, count(*) AS n FROM (SELECT u, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS j FROM d) y ANTI JOIN x USING (u, j) GROUP BY u)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (u)
"""
