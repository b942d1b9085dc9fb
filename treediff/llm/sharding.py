"""Shards by jump consistent hashing, without a ring table; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treediff.llm.common import read

#: Fixed values of the published algorithm: the generator's multiplier, and 2^64.
MULTIPLIER = "2862933555777941757"
TWO_64 = "18446744073709551616"
#: Buckets that a shard's rows are numbered in, so that no task numbers a whole shard.
SLOT_BUCKETS = 1024
#: Slots that one row is spread into at once.
COPIES = 4096
#: Rows of the table of buckets up to which it is broadcast; there are SLOT_BUCKETS for each shard.
BROADCAST_ROWS = 65_536


def jump_hash(key: Column, shards: int) -> Column:
    """The shard in [0, shards) of a 64-bit key, as published by Lamping and Veach.

    The generator's 64-bit arithmetic runs on decimal(38,0), which holds every
    product exactly. A key takes about log(shards) steps: all keys take a few
    more than that, and only those that haven't landed then go on, to `shards`
    steps at most. A null key counts as 0.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    dec = lambda x: F.expr(f"cast({x} as decimal(20,0))")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(F.when(key < 0, key.cast("decimal(20,0)") + dec(TWO_64)).otherwise(key.cast("decimal(20,0)")).cast("decimal(20,0)").alias("k"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def step(s: Column, _: Column) -> Column:
        k = ((s["k"] * F.expr(f"cast({MULTIPLIER} as decimal(19,0))") + F.lit(1)) % dec(TWO_64)).cast("decimal(20,0)")
        top = F.shiftright(F.floor(k / F.expr("cast(2 as decimal(1,0))")).cast("long"), 32)
        j = F.floor((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / (top + 1).cast("double"))).cast("long")
        going = s["j"] < shards
        return F.struct(F.when(going, k).otherwise(s["k"]).alias("k"), F.when(going, s["j"]).otherwise(s["b"]).alias("b"), F.when(going, j).otherwise(s["j"]).alias("j"))

    few = min(shards + 1, 12 + 2 * shards.bit_length())
    end = F.aggregate(F.sequence(F.lit(1), F.lit(few)), start, step)
    if few <= shards:
        rest = F.sequence(F.lit(few + 1), F.lit(shards + 1))
        end = F.element_at(F.transform(F.array(end), lambda s: F.when(s["j"] >= shards, s).otherwise(F.aggregate(rest, s, step))), 1)
    return F.aggregate(F.array(end), F.lit(0).cast("long"), lambda _, s: s["b"]).cast("int")


def shard_documents(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `key`: the key and the number of shards alone decide. size is the
    text's UTF-8 bytes plus 1. A null text counts as empty (size 1, crc 0), a
    null key hashes as 0. Slots number the rows of a shard without gaps, by
    bucket, key, crc and size; equal rows get neighbouring slots, and an empty
    table gives no rows. Other columns of docs are not read.

    Texts stay where they are: only key, size and crc are shuffled, equal
    triples as one row with a count, and each (shard, bucket) is numbered alone;
    the buckets' offsets are one row per bucket of a shard.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    each = docs.select(F.col(key).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    each = each.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    each = each.withColumns({"shard": jump_hash(F.col("doc_id"), shards), "grown_shard": jump_hash(F.col("doc_id"), shards + 1), "bucket": F.pmod(F.coalesce(F.col("doc_id"), F.lit(0)).cast("long") + F.col("text_crc32"), F.lit(SLOT_BUCKETS)).cast("int")})
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    placed = each.withColumn("before", F.sum("copies").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("copies"))
    # at most shards x SLOT_BUCKETS rows: counted, then summed up in one window per shard
    starts = each.groupBy("shard", "bucket").agg(F.sum("copies").alias("rows"))
    starts = starts.withColumn("start", F.sum("rows").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")).drop("rows")
    first = F.col("start") + F.col("before")
    placed = placed.join(F.broadcast(starts) if shards * SLOT_BUCKETS <= BROADCAST_ROWS else starts, ["shard", "bucket"])
    # copies of an equal row come apart in parts of COPIES, so that no row carries a huge array
    parts = F.explode(F.sequence(first, first + F.col("copies") - 1, F.lit(COPIES).cast("long")))
    placed = placed.select("doc_id", "size", "text_crc32", "shard", "grown_shard", (first + F.col("copies")).alias("end"), parts.alias("part"))
    slots = F.explode(F.sequence("part", F.least(F.col("part") + COPIES, F.col("end")) - 1)).alias("slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slots, "grown_shard")


def op10_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"))


#: CRC-32 by a table of bytes, the jumps as a recursion in 128-bit integers.
SQL = """
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
d AS (SELECT row_number() OVER () AS u, doc_id, encode(coalesce(text, '')) AS b FROM documents),
c AS (SELECT u, doc_id, (octet_length(b) + 1)::BIGINT AS size,
  xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(b), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32 FROM d, t),
g AS (SELECT u, (coalesce(doc_id, 0)::HUGEINT + 18446744073709551616) % 18446744073709551616 AS k, 0::BIGINT AS j FROM d
  UNION ALL SELECT u, k2, floor((j + 1)::DOUBLE * (2147483648::DOUBLE / (k2 // 8589934592 + 1)::DOUBLE))::BIGINT FROM (SELECT u, j, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k2 FROM g WHERE j < 9) x),
s AS (SELECT u, max(j) FILTER (j < 8)::INT AS shard, max(j) FILTER (j < 9)::INT AS grown_shard FROM g GROUP BY u)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY ((coalesce(doc_id, 0) + text_crc32) % 1024 + 1024) % 1024, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
FROM c JOIN s USING (u)
"""
