"""A source tree against its copy: mismatches, counts, contents to compare."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treediff.functions import entries as E

#: Fixed: kinds of mismatches in the order of reports.
KINDS = ("missing", "extra", "special_not_copied", "file_type", "size", "mode", "owner", "mtime", "symlink_target", "content", "read_error")
ATTRIBUTES = ("path", "file_type", "size", "mode", "uid", "gid", "mtime_sec", "mtime_nsec", "symlink_target")


@dataclass(frozen=True)
class Contract:
    """Which attributes a copy must have preserved."""

    mode: bool = True
    owner: bool = True
    mtime: bool = True


#: Fixed: types of the attributes.
TYPES = {"path": "string", "symlink_target": "binary", "file_type": "int", "mtime_nsec": "int"}


def side(index: DataFrame, name: str) -> DataFrame:
    have = set(index.columns)
    return index.selectExpr(*[f"{c if c in have else f'cast(null as {TYPES.get(c, 'bigint')})'} as {name}_{c}" for c in ATTRIBUTES])


def _wrong(contract: Contract) -> dict[str, tuple[str, ...]]:
    """Each kind of mismatch: when it is one, and what was expected and found, as SQL over both sides' attributes."""
    here, there = "src_path is not null", "dst_path is not null"
    both = f"{here} and {there}"
    matched = f"{both} and src_file_type = dst_file_type"
    file, plain = f"{matched} and src_file_type = 1", f"{matched} and src_file_type <> 3"
    names = " ".join(f"when {k} then '{v}'" for k, v in E.REPORT_NAMES.items())
    kind = lambda s: f"case {s}_file_type {names} end"
    perm = lambda s: f"(cast({s}_mode as bigint) & {E.PERMISSION_MASK}L)"
    octal = lambda s: f"lpad(conv(cast({perm(s)} as string), 10, 8), 4, '0')"
    fits = lambda c: f"(src_{c} is null or src_{c} <=> dst_{c})"
    owner = lambda s: f"concat(coalesce(cast({s}_uid as string), '-'), ':', coalesce(cast({s}_gid as string), '-'))"
    micros = lambda s: f"coalesce({s}_mtime_nsec, 0) div 1000"
    when = lambda s: f"if({s}_mtime_sec is not null, concat(cast({s}_mtime_sec as string), '.', lpad(cast({micros(s)} as string), 6, '0')), null)"
    special = "coalesce(src_file_type in (4, 5, 6, 7), false)"
    yes = lambda x: "true" if x else "false"
    return {
        "missing": (f"{here} and not ({there}) and not {special}",),
        "extra": (f"{there} and not ({here})",),
        "special_not_copied": (f"{here} and not ({there}) and {special}",),
        "file_type": (f"{both} and src_file_type <> dst_file_type", kind("src"), kind("dst")),
        "size": (f"{file} and src_size <> dst_size", "src_size", "dst_size"),
        "mode": (f"{yes(contract.mode)} and {plain} and {perm('src')} <> {perm('dst')}", octal("src"), octal("dst")),
        "owner": (f"{yes(contract.owner)} and {plain} and not ({fits('uid')} and {fits('gid')})", owner("src"), owner("dst")),
        "mtime": (f"{yes(contract.mtime)} and {file} and src_mtime_sec is not null and not (src_mtime_sec <=> dst_mtime_sec and {micros('src')} = {micros('dst')})", when("src"), f"coalesce({when('dst')}, '-')"),
    }


def joined(source: DataFrame, dest: DataFrame, contract: Contract = Contract()) -> DataFrame:
    """A row for each path of either tree, with its mismatches (array, and as a bit a kind in `flags`), whether it matched, and what of its content is to compare.

    A mismatch of types stands alone. Times are compared to the microsecond, for
    files only; modes by their permission bits; an owner that the source doesn't
    name can't be wrong; of symlinks only the target is compared.
    """
    both = side(source, "src").join(side(dest, "dst"), F.expr("src_path = dst_path"), "full")
    text = lambda x, k: f"cast({x[k]} as string)" if len(x) > k else "cast(null as string)"
    wrong = _wrong(contract)
    found = [f"if({x[0]}, struct('{k}' as kind, {text(x, 1)} as expected, {text(x, 2)} as actual), null)" for k, x in wrong.items()]
    flags = " + ".join(f"if({x[0]}, {1 << KINDS.index(k)}, 0)" for k, x in wrong.items())
    matched = "src_path is not null and dst_path is not null and src_file_type = dst_file_type"
    todo = f"case when {matched} and src_file_type = 1 and src_size = dst_size and src_size > 0 then 'file' when {matched} and src_file_type = 3 then 'symlink' end"
    return both.selectExpr(
        "coalesce(src_path, dst_path) as path", f"filter(array({', '.join(found)}), x -> x is not null) as mismatches", "src_path is not null as in_source", "dst_path is not null as in_dest",
        f"coalesce({matched}, false) as matched", f"{todo} as todo", "src_size as size", f"{flags} as flags",
    )


def mismatches(rows: DataFrame) -> DataFrame:
    return rows.select("path", F.explode("mismatches").alias("m")).select("path", "m.*")


def todo(rows: DataFrame) -> DataFrame:
    """What is left to read on both sides: files of equal size, and symlinks."""
    return rows.where("todo is not null").select("path", F.col("todo").alias("kind"), "size")


def counts(rows: DataFrame) -> DataFrame:
    """One row; made from the flags, so that no mismatch's texts are built."""
    each = [f"count_if(flags & {1 << KINDS.index(k)} <> 0) as {k}" for k in KINDS[:8]]
    sums = (
        "count_if(in_source) as source_entries", "count_if(in_dest) as dest_entries", "count_if(matched) as matched", *each, "coalesce(sum(cast(bit_count(flags) as bigint)), 0) as mismatches",
        "count_if(todo = 'file') as files_to_read", "coalesce(sum(if(todo = 'file', size, null)), 0) as bytes_to_read", "count_if(todo = 'symlink') as symlinks_to_read",
    )
    return rows.agg(*map(F.expr, sums))


def tally(found: DataFrame) -> DataFrame:
    """Mismatches by kind, in the order of reports."""
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    return found.groupBy("kind").agg(F.count("*").alias("n")).withColumn("rank", rank).orderBy("rank")


def samples(found: DataFrame, limit: int = 100) -> DataFrame:
    """The first mismatches of a report, by path and kind."""
    return found.orderBy("path", "kind").limit(limit)


def compare_digests(work: DataFrame, source: DataFrame, dest: DataFrame) -> DataFrame:
    """(path, kind, expected, actual, detail) of contents to compare.

    source and dest: path, sha256, bytes, error. Errors come first; equal bytes
    and digests match and give no row; a length that isn't the index's says so.
    """
    one = lambda df, n: df.select(*[F.col(c).alias(f"{n}_{c}") for c in ("path", "sha256", "bytes", "error")])
    rows = work.join(one(source, "s"), F.col("path") == F.col("s_path"), "left").join(one(dest, "d"), F.col("path") == F.col("d_path"), "left")
    gone = lambda n: F.when(F.col(f"{n}_path").isNull(), "not read").otherwise(F.col(f"{n}_error"))
    failed = F.when(gone("s").isNotNull() & gone("d").isNotNull(), "both").when(gone("s").isNotNull(), "source").when(gone("d").isNotNull(), "destination")
    same = (F.col("s_sha256") == F.col("d_sha256")) & (F.col("s_bytes") == F.col("d_bytes"))
    text = lambda n: F.concat(F.lit("sha256:"), F.col(f"{n}_sha256"), F.lit(" ("), F.col(f"{n}_bytes").cast("string"), F.lit(" bytes)"))
    stale = F.when((F.col("s_bytes") != F.col("size")) | (F.col("d_bytes") != F.col("size")), "index is stale")
    kind = F.when(failed.isNotNull(), "read_error").when(~same, "content")
    rows = rows.withColumn("found", kind).where("found is not null")
    plain = F.col("found") == "content"
    return rows.select("path", F.col("found").alias("kind"), F.when(plain, text("s")).alias("expected"), F.when(plain, text("d")).alias("actual"), F.when(plain, stale).otherwise(failed).alias("detail"))


def compare_targets(links: DataFrame) -> DataFrame:
    """(path, kind, expected, actual) of symlinks; links: path, source_target, dest_target as bytes, null where one couldn't be read."""
    bad = F.when(F.col("source_target").isNull() | F.col("dest_target").isNull(), "read_error").when(F.col("source_target") != F.col("dest_target"), "symlink_target")
    return links.withColumn("kind", bad).where("kind is not null").select("path", "kind", E.path_lossy(F.col("source_target")).alias("expected"), E.path_lossy(F.col("dest_target")).alias("actual"))


def content_counts(work: DataFrame, found: DataFrame) -> DataFrame:
    rows = work.select(F.lit("work").alias("kind"), "size").unionByName(found.select("kind", F.lit(0).alias("size")))
    of = lambda k: F.count_if(F.col("kind") == k)
    return rows.agg(of("work").alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), *[of(k).alias(k) for k in ("content", "read_error", "symlink_target")])


def status(n_mismatches: Column, complete: Column) -> Column:
    return F.when(~complete, "interrupted").when(n_mismatches == 0, "pass").otherwise("fail")


def remaining(work: DataFrame, done: DataFrame) -> DataFrame:
    """Resume: work without a result yet."""
    return work.join(done.select("path").distinct(), "path", "left_anti")


def ordered(rows: DataFrame, bucket: str, path: str = "path") -> DataFrame:
    """Rows with their position by path within a bucket, as reports list what is missing."""
    from pyspark.sql.window import Window

    return rows.withColumn("position", F.row_number().over(Window.partitionBy(bucket).orderBy(path)))
