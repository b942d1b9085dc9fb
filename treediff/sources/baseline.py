"""Baselines bucketed and sorted by path: a diff against one shuffles the new side alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a bucket's file.
BUCKET_BYTES = 128 << 20


def buckets_for(spark: SparkSession, total_bytes: int) -> int:
    """Buckets of about BUCKET_BYTES, a power of two, and no fewer than the shuffles' partitions: Spark deals out anew what has fewer."""
    need = max(total_bytes // BUCKET_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return 1 << (need - 1).bit_length()


def write_baseline(index: DataFrame, name: str, buckets: int, path: str | None = None) -> None:
    """The index as a table with one sorted file a bucket. The one shuffle that it takes is saved by each diff that reads it."""
    out = index.repartition(buckets, "path").write.bucketBy(buckets, "path").sortBy("path").option("compression", "zstd").mode("errorifexists")
    (out.option("path", path) if path else out).saveAsTable(name)


def read_baseline(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
