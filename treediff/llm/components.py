"""Connected components of an edge table, without collecting it anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treediff.llm.common import stash

EDGES = "a long, b long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (v, smallest vertex of v's component) that connect what the given edges connect."""
    v, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(v))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    own = root != np.arange(len(v))
    return v[own], v[root[own]]


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as a forest; never more edges than came in."""
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy()])
        b = np.concatenate([b, batch.column(1).to_numpy()])
        a, b = forest(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b long) to (v, root): each vertex of an edge with the smallest vertex it can reach.

    Large-star and small-star steps in turn until the edges stay as they are;
    each step's table is written, each group is reduced to its smallest
    neighbour by a map-side minimum, and no step makes more edges than it got.
    """

    def settled(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().mapInArrow(_shrink, EDGES), "edges")
    state = settled(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("v")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = large.where("a <> b")
        low = large.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
        small = large.join(low, F.col("a") == F.col("v"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("v").alias("a"), F.col("m").alias("b")))
        e = stash(small.where("a <> b").distinct(), "edges")
        before, state = state, settled(e)
        if state == before:
            break
    roots = e.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("root"))
    return roots.unionByName(e.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())
