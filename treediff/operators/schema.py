"""The canonical index: its columns, which of them must be there, and checks of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treediff.functions import entries as E

FORMAT_VERSION, CONTRACT_VERSION = 1, 1
REQUIRED = ("row_id", "path", "size", "mode", "file_type")
#: Fixed: names and types of the canonical index.
CANONICAL = T.StructType(
    [
        T.StructField("row_id", T.LongType(), False),
        T.StructField("path", T.BinaryType(), False),
        T.StructField("size", T.LongType(), False),
        T.StructField("mtime_sec", T.LongType()),
        T.StructField("mtime_nsec", T.IntegerType()),
        T.StructField("atime_sec", T.LongType()),
        T.StructField("atime_nsec", T.IntegerType()),
        T.StructField("mode", T.LongType(), False),
        T.StructField("uid", T.LongType()),
        T.StructField("gid", T.LongType()),
        T.StructField("nlink", T.LongType()),
        T.StructField("inode", T.DecimalType(20, 0)),
        T.StructField("fsid", T.DecimalType(20, 0)),
        T.StructField("xattr_blob", T.BinaryType()),
        T.StructField("symlink_target", T.BinaryType()),
        T.StructField("file_type", T.ShortType(), False),
    ]
)


def conform(df: DataFrame, wanted: T.StructType = CANONICAL) -> DataFrame:
    """Columns by name in the canonical types; absent optional ones are null, others are dropped; ValueError for absent required ones."""
    if missing := [c for c in REQUIRED if c not in df.columns]:
        raise ValueError(f"required columns are missing: {', '.join(missing)}")
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def check_rows(index: DataFrame, strict: bool = False) -> DataFrame:
    """The index with corrupt_reason; strict: a corrupt row fails the query."""
    reason = E.corrupt_reason(F.col("file_type"), F.col("mode"))
    if strict:
        reason = F.when(reason.isNotNull(), F.raise_error(F.concat(F.lit("row "), F.col("row_id").cast("string"), F.lit(": "), reason)).cast("string"))
    return index.withColumn("corrupt_reason", reason)


def check_shards(index: DataFrame, stamped: str = "stamped_shard") -> DataFrame:
    """(stamped shard, first_row_id, named_shard, ok): does a shard's first row name the shard that it is stamped with?"""
    first = index.groupBy(F.col(stamped).alias("stamped")).agg(F.min("row_id").alias("first_row_id"))
    return first.withColumn("named_shard", E.shard_of(F.col("first_row_id"))).withColumn("ok", F.col("named_shard") == F.col("stamped"))
