"""Raw scan parts to the canonical index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treediff.functions import entries as E


def raw_path(df: DataFrame) -> Column:
    """The path as bytes: path_bytes where the part has it, else the text."""
    return F.coalesce(F.col("path_bytes"), F.col("path").cast("binary")) if "path_bytes" in df.columns else F.col("path").cast("binary")


def _has(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def canonicalise(raw: DataFrame, root: str, shard: Column, row: Column, strict: bool = True) -> DataFrame:
    """One select: ids, paths below the root, times, types and modes; covered legacy columns are renamed, others pass through.

    strict: a path outside the root or an unknown type fails the query; else
    such rows have a null path or mode. row: the row's position in its shard,
    for Parquet parts the hidden column _metadata.row_index.
    """
    path = E.strip_root(raw_path(raw).cast("string"), root)
    mode = E.canonical_mode(F.col("file_type"), F.col("permissions"))
    if strict:
        path = F.coalesce(path, F.raise_error(F.concat(F.lit("path outside the root: "), E.path_lossy(raw_path(raw)))).cast("string"))
        mode = F.coalesce(mode, F.raise_error(F.concat(F.lit("unknown file type: "), F.coalesce(F.col("file_type"), F.lit("null")))).cast("long"))
    m = E.time_pair(_has(raw, "mtime_sec", "long"), _has(raw, "mtime_nsec", "int"), _has(raw, "mtime_us", "long"))
    a = E.time_pair(_has(raw, "atime_sec", "long"), _has(raw, "atime_nsec", "int"), _has(raw, "atime_us", "long"))
    own = {
        "row_id": E.make_row_id(shard, row), "path": path.cast("binary"), "size": F.col("size").cast("long"), "mtime_sec": m["sec"], "mtime_nsec": m["nsec"],
        "atime_sec": a["sec"], "atime_nsec": a["nsec"], "mode": mode, "file_type": E.pick(F.col("file_type"), E.WALKER_TYPES).cast("short"),
    }
    for name, kind in (("uid", "long"), ("gid", "long"), ("nlink", "long"), ("inode", "decimal(20,0)"), ("fsid", "decimal(20,0)"), ("symlink_target", "binary")):
        own[name] = _has(raw, name, kind).cast(kind)
    legacy = {"path": "path_legacy", "file_type": "file_type_mime"}
    covered = {"path_bytes", "permissions", "mtime_us", "atime_us", *own} - set(legacy)
    rest = [F.col(c).alias(legacy.get(c, c)) for c in raw.columns if c in legacy or c not in covered]
    return raw.select(*[c.alias(k) for k, c in own.items()], *rest)


def exclude_directories(index: DataFrame, patterns: list[str], path: str = "path") -> DataFrame:
    """The index without the directories whose name matches a glob, and without all below them.

    Names of files and whole paths never match. In a tree every name above a
    path's last one is a directory's, so each row is judged by its own path: one
    scan, and nothing is joined or shuffled, whatever the depth. A directory that
    the index itself doesn't list excludes what lies below it as well.
    """
    from treediff.functions.texts import glob_pattern

    if not patterns:
        return index
    pattern = "|".join(f"(?:{glob_pattern(p)})" for p in patterns)
    names = F.split(F.col(path).cast("string"), "/")
    above = F.exists(F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(0))), lambda n: n.rlike(pattern))
    own = (F.col("file_type") == 2) & F.element_at(names, -1).rlike(pattern)
    return index.where(~F.coalesce(above | own, F.lit(False)))
