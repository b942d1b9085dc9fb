"""Two snapshots of a tree: classes of their paths, the delta, the counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treediff.functions import entries as E

NEW, DIRTY, PENDING, UNCHANGED, DELETED = "NEW", "DIRTY", "PENDING", "UNCHANGED", "DELETED"


_PAIR = "struct<sec:bigint,nsec:int>"


def projected(index: DataFrame, side: str, *more: Column) -> DataFrame:
    """What the diff compares: path, row_id and the tuple of type, size, mtime and ctime; absent optional columns are null."""
    have = set(index.columns)
    has = lambda c: c if c in have else "cast(null as bigint)"
    exact = f"if({has('ctime_sec')} is not null and {has('ctime_nsec')} is not null, struct(cast({has('ctime_sec')} as bigint) as sec, cast({has('ctime_nsec')} as int) as nsec), cast(null as {_PAIR}))"
    mtime = f"if({has('mtime_sec')} is not null, struct(cast({has('mtime_sec')} as bigint) as sec, coalesce(cast({has('mtime_nsec')} as int), 0) as nsec), cast(null as {_PAIR}))"
    if "ctime_us" in have:
        ctime = F.coalesce(F.expr(exact), F.when(F.col("ctime_us").isNotNull(), E.split_us(F.col("ctime_us"))))
        seen = F.struct(F.expr("cast(file_type as int)").alias("file_type"), F.expr("cast(size as bigint)").alias("size"), F.expr(mtime).alias("mtime"), ctime.alias("ctime"))
    else:
        seen = F.expr(f"struct(cast(file_type as int) as file_type, cast(size as bigint) as size, {mtime} as mtime, {exact} as ctime)")
    return index.select(F.expr(f"path as {side}_path"), F.expr(f"row_id as {side}_row_id"), seen.alias(f"{side}_seen"), *more)


def _marked(cur: DataFrame, pending: DataFrame | None, path: str) -> DataFrame:
    """cur with `waits`: whether its path is pending. Both are dealt out by the path, as the join that follows needs it."""
    if pending is None:
        return cur.withColumn("waits", F.lit(False))
    p = pending.select(F.col("path").alias("pending_path")).distinct()
    return cur.join(p, F.col(path) == F.col("pending_path"), "left").withColumn("waits", F.col("pending_path").isNotNull()).drop("pending_path")


def _class() -> Column:
    return F.expr(f"case when base_path is null then '{NEW}' when not (cur_seen <=> base_seen) then '{DIRTY}' when waits then '{PENDING}' else '{UNCHANGED}' end")


def classify(baseline: DataFrame, current: DataFrame, pending: DataFrame | None = None) -> DataFrame:
    """(path, class, row_id, baseline_row_id): one row for each path of either side.

    Paths are unique on each side by contract. Null times equal null times.
    Pending matters only where nothing has changed. Pending paths mark the current
    side before the full outer join, so each side is dealt out once by its path,
    with no more than what is compared, and no row has a null key.
    """
    cur, base = _marked(projected(current, "cur"), pending, "cur_path"), projected(baseline, "base")
    both = cur.join(base, F.col("cur_path") == F.col("base_path"), "full")
    kind = F.when(F.col("cur_path").isNull(), DELETED).otherwise(_class())
    return both.select(F.expr("coalesce(cur_path, base_path) as path"), kind.alias("class"), F.expr("cur_row_id as row_id"), F.expr("base_row_id as baseline_row_id"))


def kept_rows(baseline: DataFrame, current: DataFrame, pending: DataFrame | None = None) -> DataFrame:
    """The current rows that are new, dirty or pending, with all their columns: the current side meets the narrow baseline once."""
    own = F.struct(*[F.col(f"`{c}`") for c in current.columns]).alias("own")
    cur = _marked(projected(current, "cur", own), pending, "cur_path")
    both = cur.join(projected(baseline, "base"), F.col("cur_path") == F.col("base_path"), "left")
    return both.where(_class() != UNCHANGED).select("own.*")


def class_counts(classes: DataFrame) -> DataFrame:
    of = lambda name, *k: F.expr(f"count_if(class in ({', '.join(map(repr, k))})) as {name}")
    return classes.agg(
        F.expr("count(baseline_row_id) as baseline_rows"), F.expr("count(row_id) as current_rows"), of("new", NEW), of("dirty_tuple", DIRTY),
        of("dirty_pending", PENDING), of("unchanged", UNCHANGED), of("deleted", DELETED), of("keep_rows", NEW, DIRTY, PENDING),
    )


def keep_list(classes: DataFrame) -> DataFrame:
    return classes.where(F.col("class").isin(NEW, DIRTY, PENDING)).select("row_id")


def deleted(classes: DataFrame) -> DataFrame:
    return classes.where(F.col("class") == DELETED).select("path")


def delta(current: DataFrame, keep: DataFrame) -> DataFrame:
    """The kept rows with all their columns and ids."""
    return current.join(keep, "row_id", "left_semi")


def check_delta(delta_rows: DataFrame, keep: DataFrame) -> None:
    """ValueError unless there is a row for each kept id."""
    if (got := delta_rows.count()) != (want := keep.count()):
        raise ValueError(f"{want} rows are kept, {got} found")


def may_cut_over(counts: DataFrame) -> DataFrame:
    """Gate 1: nothing left to copy or to delete."""
    return counts.select((F.col("keep_rows") + F.col("deleted") == 0).alias("converged"))


def duplicate_paths(index: DataFrame) -> DataFrame:
    """Paths that an index has more than once, against its contract."""
    return index.groupBy("path").agg(F.count("*").alias("rows")).where("rows > 1")
