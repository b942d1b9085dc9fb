"""Work lists in a fixed order, what of them is done, and where to go on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treediff.sources import tables

#: Entries of a list that are looked at together.
BLOCK = 1 << 20


def write_work(rows: DataFrame, path: str, order: str = "path") -> int:
    """Number the rows by `order` (idx from 0, without gaps), write them, and note how many there are; returns that.

    Sorted by ranges: each range numbers its own rows, and the ranges' counts,
    a row each, are added up. The note is written last: a list without one, or
    of another length than noted, is torn.
    """
    spark = rows.sparkSession
    side = f"{path}.ranges"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, order).sortWithinPartitions(order)
    place = F.monotonically_increasing_id()  # the range above 33 bits, the position below
    ranged.withColumn("_at", place).write.mode("overwrite").parquet(side)
    held = spark.read.parquet(side).withColumns({"_range": F.shiftright("_at", 33), "_own": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    starts = held.groupBy(F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    starts = starts.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = held.join(F.broadcast(starts.drop("_n")), F.col("_range") == F.col("_r")).withColumn("idx", F.col("_start") + F.col("_own"))
    out.drop("_at", "_range", "_own", "_r", "_start").sortWithinPartitions("idx").write.mode("errorifexists").parquet(path)
    total = spark.read.parquet(path).count()
    tables.write_json(spark, f"{path}.json", {"entries": total})
    fs, p = tables.fs_of(spark, side)
    fs.delete(p, True)
    return total


def read_work(spark: SparkSession, path: str, begin: int = 0) -> DataFrame:
    """The entries from `begin` on; ValueError for a torn list. Entries before `begin` are left out by the files' statistics."""
    note = tables.read_json(spark, f"{path}.json")
    if note is None:
        raise ValueError(f"torn work list: {path} was never finished")
    found = spark.read.parquet(path)
    if (n := found.count()) != note["entries"]:  # from the footers
        raise ValueError(f"torn work list: {path} has {n} entries of {note['entries']}")
    if begin > note["entries"]:
        raise ValueError(f"the work list is shorter than the recorded frontier ({begin})")
    return found.where(F.col("idx") >= begin)


def runs(done: DataFrame, block: int = BLOCK) -> DataFrame:
    """(start, end) of the runs of finished entries (idx), end exclusive; repeats change nothing.

    Islands within blocks first; then only the runs that touch a block's border,
    at most two a block, are put together over the whole list.
    """
    b = F.floor(F.col("idx") / block).cast("long")
    one = done.select("idx").distinct().withColumn("b", b)
    one = one.withColumn("island", F.col("idx") - F.row_number().over(Window.partitionBy("b").orderBy("idx")))
    each = one.groupBy("b", "island").agg(F.min("idx").alias("start"), (F.max("idx") + 1).alias("end")).drop("island")
    at_border = (F.col("start") == F.col("b") * block) | (F.col("end") == (F.col("b") + 1) * block)
    border, w = each.where(at_border), Window.orderBy("start")
    border = border.withColumn("first", F.coalesce(F.lag("end").over(w) != F.col("start"), F.lit(True)).cast("int"))
    border = border.withColumn("run", F.sum("first").over(w)).groupBy("run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return each.where(~at_border).select("start", "end").unionByName(border.select("start", "end"))


def frontier(done: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row: entries done, the frontier (all before it are done), how far entries have been issued, and how many of these are unfinished."""
    r = runs(done, block)
    n = F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0))
    front, issued = F.coalesce(F.max(F.when(F.col("start") == 0, F.col("end"))), F.lit(0)), F.coalesce(F.max("end"), F.lit(0))
    return r.agg(n.alias("done"), front.alias("frontier"), issued.alias("issued")).withColumn("unfinished", F.col("issued") - F.col("done"))


def unfinished(done: DataFrame, block: int = BLOCK) -> DataFrame:
    """(start, end) between the frontier and the last issued entry: what a resumed run reads again. By neighbours of runs, by ranges of blocks."""
    r = runs(done, block)
    b = r.withColumn("b", F.floor(F.col("start") / block).cast("long"))
    before = F.lag("end").over(Window.partitionBy("b").orderBy("start"))
    tops = b.groupBy(F.col("b").alias("t_b")).agg(F.max("end").alias("top"))
    tops = tops.withColumn("earlier", F.max("top").over(Window.orderBy("t_b").rowsBetween(Window.unboundedPreceding, -1))).drop("top")
    holes = b.withColumn("before", before).join(tops, F.col("b") == F.col("t_b"))
    return holes.select(F.coalesce("before", "earlier", F.lit(0)).alias("start"), F.col("start").alias("end")).where("start < end")


def resume(spark: SparkSession, path: str, done: DataFrame) -> DataFrame:
    """The entries that are left, read from the frontier on; ValueError where more is done than there is work."""
    at = frontier(done).first()
    work = read_work(spark, path, at["issued"]).sparkSession  # the note is checked against what was issued
    left = work.read.parquet(path).where(F.col("idx") >= at["frontier"])
    later = done.where(F.col("idx") >= at["frontier"]).select(F.col("idx").alias("d_idx"))
    return left.join(later, F.col("idx") == F.col("d_idx"), "left_anti")


def record(results: DataFrame, out: str, batch: int) -> None:
    """Results (idx, ...) of one batch, then the note that vouches for them; a batch that was cut off before its note is written anew."""
    results.write.mode("overwrite").parquet(f"{out}/batch-{batch:010d}")
    tables.write_json(results.sparkSession, f"{out}/notes/{batch:010d}.json", {"batch": batch})


def recorded(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """The results of all batches that have their note; what an interrupted run left beside them isn't read."""
    names = [p.rsplit("/", 1)[1].removesuffix(".json") for p in tables.children(spark, f"{out}/notes", "*.json")]
    return spark.read.schema(schema).parquet(*[f"{out}/batch-{n}" for n in names]) if names else spark.createDataFrame([], schema)
