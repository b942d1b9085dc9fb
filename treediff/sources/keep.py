"""Lists of kept row ids: as ranges, and as the sorted binary lists of older passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treediff.operators import frontier
from treediff.sources import files, tables

#: Ids of an index that are looked at together, as a power of two.
CELL = 16
#: Ranges that go to the scan as a filter at most; beyond that the shards' own first and last ids do.
PUSHED = 200


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, body in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = body.as_buffer()
            if raw.size % 8:
                raise ValueError(f"keep list of {raw.size} bytes, no multiple of 8: {path}")
            ids = np.frombuffer(raw, "<u8")
            if len(ids) and (ids[1:] <= ids[:-1]).any():
                raise ValueError(f"keep list isn't sorted: {path}")
            if len(ids) and ids[-1] >> 63:
                raise ValueError(f"keep list has ids beyond 63 bits: {path}")
            for k in range(0, len(ids), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + (1 << 16)].astype(np.int64))], ["row_id"])


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    """(row_id) of every *.keep below a folder: little-endian 64-bit ids, ascending. A missing folder is empty; torn or unsorted lists fail the query."""
    if not tables.exists(spark, path):
        return spark.createDataFrame([], "row_id long")
    return files.contents(spark, path, "*.keep").select("path", "content").mapInArrow(_ids, "row_id long")


def ranges(ids: DataFrame) -> DataFrame:
    """(start, end) of kept ids, end exclusive; repeats change nothing."""
    return frontier.runs(ids.select(F.col("row_id").alias("idx")))


def write_keep(ids: DataFrame, path: str) -> None:
    """Kept ids as sorted ranges: neighbours that are all kept take one row."""
    ranges(ids).repartitionByRange("start").sortWithinPartitions("start").write.mode("errorifexists").option("compression", "zstd").parquet(path)


def read_keep(spark: SparkSession, path: str) -> DataFrame:
    """The ranges of a keep list; a missing one is empty, overlapping or empty ranges fail the query."""
    if not tables.exists(spark, path):
        return spark.createDataFrame([], "start long, end long")
    rows = spark.read.schema("start long, end long").parquet(path)
    bad = F.col("start").isNull() | F.col("end").isNull() | (F.col("start") >= F.col("end"))
    return rows.withColumn("end", F.when(bad, F.raise_error(F.lit("keep list has a range that ends before it starts")).cast("long")).otherwise(F.col("end")))


def covering(kept: DataFrame, most: int = PUSHED) -> list[tuple[int, int]]:
    """At most `most` ranges that hold all kept ones: cells of ids in a row, else each shard's first and last id; beyond that the first and the last of all."""
    shard, cell = F.shiftrightunsigned("start", 40), F.shiftrightunsigned("start", CELL)
    last = F.shiftrightunsigned(F.col("end") - 1, CELL)
    cells = frontier.runs(kept.select(F.explode(F.sequence(cell, last)).alias("idx")))
    found = cells.limit(most + 1).collect()
    if len(found) <= most:
        return [(r["start"] << CELL, r["end"] << CELL) for r in found]
    found = kept.groupBy(shard.alias("shard")).agg(F.min("start").alias("start"), F.max("end").alias("end")).limit(most + 1).collect()
    if len(found) <= most:
        return [(r["start"], r["end"]) for r in found]
    r = kept.agg(F.min("start"), F.max("end")).first()
    return [(r[0], r[1])]


def delta(current: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of an index whose ids lie in kept ranges, with all their columns.

    A few ranges that hold all kept ids are a filter of the scan, which leaves
    row groups out by their statistics; then rows meet the exact ranges by the
    cell that both lie in, so no list is broadcast unless Spark finds it small.
    """
    pushed = F.lit(False)
    for start, end in covering(kept):
        pushed = pushed | ((F.col("row_id") >= start) & (F.col("row_id") < end))
    cell = F.shiftrightunsigned("row_id", CELL)
    cells = F.sequence(F.shiftrightunsigned("start", CELL), F.shiftrightunsigned(F.col("end") - 1, CELL))
    near = kept.select(F.explode(cells).alias("k_cell"), F.col("start").alias("k_start"), F.col("end").alias("k_end"))
    on = (cell == F.col("k_cell")) & (F.col("row_id") >= F.col("k_start")) & (F.col("row_id") < F.col("k_end"))
    return current.where(pushed).join(near, on, "left_semi")
