"""Near-duplicates by SimHash: fingerprints, links and their components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treediff.llm.common import column, free_names, partitions, read, stash
from treediff.llm.components import EDGES, components

SHINGLE, MOST_BITS, SEED = 4, 4, 42
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Fingerprints that differ in at most 4 bits share at least 4 of their 8 bytes.
LEAST_BYTES = 8 - MOST_BITS
#: Parts that the rows of one fingerprint are dealt to where rows and fingerprints meet.
SALTS = 64


def byte_triples() -> list[tuple[int, int, int]]:
    """Positions to index by: any 4 of the 8 bytes contain one of these 20 triples.

    Turan's construction: three groups of positions; triples within a group,
    and two of a group with one of the next.
    """
    groups = ((0, 1, 2), (3, 4, 5), (6, 7))
    found = [t for g in groups for t in combinations(g, 3)]
    for i, g in enumerate(groups):
        found += [tuple(sorted((*pair, x))) for pair in combinations(g, 2) for x in groups[(i + 1) % 3]]
    return found


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64 bits, each set where over half of the text's shingle hashes have it; 0 for a text without words."""
    w = (text or b"").translate(LOWER).split()
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(joined)]
    hash_of, total, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(w) - shingle + 1
    for k in range(0, n, 65536):  # bounded memory for very long texts
        h = np.fromiter((hash_of(joined[s:e], SEED) for s, e in zip(starts[k : min(k + 65536, n)], ends[k + shingle - 1 : k + 65536 + shingle - 1])), np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        prints = np.fromiter((fingerprint(x.as_py()) for x in texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64()), *batch.columns[2:]], ["doc_id", "fp", *batch.schema.names[2:]])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): one row per row of docs, fp as a signed long."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def linked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (positions) of a spanning forest of the links among the fingerprints x.

    Each fingerprint is compared with those that no link has reached so far;
    shared bytes are tallied first and only pairs with enough are verified.
    """
    left, a, b = np.arange(len(x)), [], []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            p = front.pop()
            diff = x[left] ^ x[p]
            shared = (diff.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            near = np.zeros(len(left), bool)
            likely = np.flatnonzero(shared >= LEAST_BYTES)
            near[likely] = np.bitwise_count(diff[likely]) <= MOST_BITS
            hit = left[near]
            if len(hit):
                a.append(hit)
                b.append(np.full(len(hit), p))
                front += hit.tolist()
                left = left[~near]
    empty = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _postings_to_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting lists, one after another (rows come sorted by key), as links: a list of m fingerprints gives at most m - 1 of them."""
    held: list[np.ndarray] = []  # the list that the last batch broke off in
    last = None
    a, b, size = [], [], 0

    def add(x: np.ndarray) -> None:
        nonlocal size
        i, j = linked(x)
        if len(i):
            a.append(x[i].view(np.int64))
            b.append(x[j].view(np.int64))
            size += len(i)

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
        a.clear(), b.clear()
        return out

    for batch in batches:
        key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if not len(key):
            continue
        starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
        ends = np.append(starts[1:], len(key))
        if last is not None and key[0] != last:
            if sum(map(len, held)) > 1:
                add(np.concatenate(held))
            held = []
        if len(starts) > 1:
            if len(held):
                held.append(fp[: ends[0]])
                add(np.concatenate(held))
                held = []
            elif ends[0] > 1:
                add(fp[: ends[0]])
            middle = slice(1, len(starts) - 1)
            for s, e in zip(starts[middle][ends[middle] - starts[middle] > 1].tolist(), ends[middle][ends[middle] - starts[middle] > 1].tolist()):
                add(fp[s:e])
        held.append(fp[starts[-1] :])
        last = key[-1]
        if size > 100_000:
            yield flush()
            size = 0
    if sum(map(len, held)) > 1:
        add(np.concatenate(held))
    if a:
        yield flush()


def links(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) to edges (a, b) that connect all pairs of at most 4 differing bits."""
    byte = lambda i: F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255))

    def posting(k: int, t: tuple[int, int, int]) -> Column:
        value = F.lit(k).cast("long")
        for i in t:
            value = F.shiftleft(value, 8).bitwiseOR(byte(i))
        return value

    keys = F.explode(F.array(*[posting(k, t) for k, t in enumerate(byte_triples())]))
    rows = prints.select(keys.alias("key"), "fp")
    return rows.repartition(partitions(prints.sparkSession), "key").sortWithinPartitions("key").mapInArrow(_postings_to_edges, EDGES)


def _grouped(docs: DataFrame, key: str, text: str, marked: bool) -> DataFrame:
    """(doc_id, fp, component_id, root) and, if marked, a hash of the text (mark) of each row; root is a fingerprint of the component."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")
    mark = ["mark"] if marked else []
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text")) if marked else rows
    prints = rows.mapInArrow(_fingerprints, "doc_id long, fp long" + ", mark long" * marked)
    each = stash(prints.select("doc_id", "fp", *mark, salt), "fingerprints")
    salted = stash(each.groupBy("fp", "salt").agg(F.min("doc_id").alias("first")), "salted")
    distinct = stash(salted.groupBy("fp").agg(F.min("first").alias("first")), "distinct")
    roots = stash(components(links(distinct.select("fp"))), "roots")
    groups = roots.join(distinct, roots.v == distinct.fp).groupBy("root").agg(F.min("first").alias("low"))
    low = roots.join(groups, "root").select(F.col("v").alias("fp"), "low", "root")
    of = distinct.join(low, "fp", "left").select("fp", F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("low")).alias("component_id"), F.coalesce("root", "fp").alias("root"))
    of = salted.select("fp", "salt").join(of, "fp").select(F.col("fp").alias("p"), F.col("salt").alias("s"), "component_id", "root")
    return each.join(of, (each.fp == of.p) & (each.salt == of.s)).select("doc_id", "fp", "component_id", "root", *mark)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fp (signed long), component_id.

    Fingerprints of at most 4 differing bits are linked; component_id is the
    smallest doc_id reachable over links, the row's own included. Null and blank
    texts have fingerprint 0, linked like any other. Equal rows are all
    returned; an empty table gives no rows; a null doc_id never becomes a
    component_id unless a component has no other. Extra columns aren't read.

    Copies collapse to one fingerprint before the search, whose index lists
    distinct fingerprints by the values of three bytes at fixed positions. Rows
    and fingerprints meet by fingerprint and a salt of the row, so that the rows
    of a frequent one spread; it is repeated for the salts that its rows have.
    """
    return _grouped(docs, key, text, False).drop("root")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each component one row of docs: the one of its smallest key (and there of the smallest hash of the text), equal rows once; rows without a key stay.

    Keys may be shared by rows of different components: each row is judged by
    its own component. All columns of docs are carried, whatever their names.
    Null and blank texts are near-duplicates of one another; an empty table gives
    no rows.
    """
    own = column(docs, key)
    groups = _grouped(docs.where(own.isNotNull()).select(own.alias("doc_id"), column(docs, text).alias("text")), "doc_id", "text", True)
    name, hashed = free_names(docs, "kept", "hashed")
    chosen = groups.groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("x")).select(F.col("x.doc_id").alias(name), F.col("x.mark").alias(hashed)).distinct()
    kept = docs.join(chosen, (own == chosen[name]) & (F.xxhash64(column(docs, text)) == chosen[hashed]), "left_semi")
    return kept.dropDuplicates([key, text]).unionByName(docs.where(own.isNull()))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
