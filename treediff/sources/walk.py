"""A local tree as a table: a data source that reads directories in parallel and tells vanished from unreadable ones."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from treediff.functions.entries import WALKER_TYPES

#: Fixed: the raw scan's columns; `problem` is null for entries, else vanished or unreadable, with the system's text in `detail`.
RAW = (
    "path string, path_bytes binary, file_type string, permissions int, size long, mtime_sec long, mtime_nsec int, atime_sec long, atime_nsec int, ctime_sec long, ctime_nsec int, "
    "uid long, gid long, nlink long, inode decimal(20,0), fsid decimal(20,0), symlink_target binary, problem string, detail string"
)
_ARROW = pa.schema(
    [("path", pa.string()), ("path_bytes", pa.binary()), ("file_type", pa.string()), ("permissions", pa.int32()), ("size", pa.int64()), ("mtime_sec", pa.int64()), ("mtime_nsec", pa.int32()),
     ("atime_sec", pa.int64()), ("atime_nsec", pa.int32()), ("ctime_sec", pa.int64()), ("ctime_nsec", pa.int32()), ("uid", pa.int64()), ("gid", pa.int64()), ("nlink", pa.int64()),
     ("inode", pa.decimal128(20, 0)), ("fsid", pa.decimal128(20, 0)), ("symlink_target", pa.binary()), ("problem", pa.string()), ("detail", pa.string())]
)
_KINDS = {stat.S_IFREG: "file", stat.S_IFDIR: "directory", stat.S_IFLNK: "symlink", stat.S_IFIFO: "fifo", stat.S_IFSOCK: "socket", stat.S_IFBLK: "block_device", stat.S_IFCHR: "char_device"}
BATCH = 5000


def entry(path: bytes) -> tuple:
    """One entry's row; OSError where it can't be read."""
    s = os.lstat(path)
    pair = lambda ns: divmod(ns, 1_000_000_000)
    target = os.readlink(path) if stat.S_ISLNK(s.st_mode) else None
    name = _KINDS[stat.S_IFMT(s.st_mode)]
    return (path.decode(errors="replace"), path, name, stat.S_IMODE(s.st_mode), s.st_size, *pair(s.st_mtime_ns), *pair(s.st_atime_ns), *pair(s.st_ctime_ns), s.st_uid, s.st_gid, s.st_nlink, s.st_ino, s.st_dev, target, None, None)


def problem(path: bytes, e: OSError) -> tuple:
    """A row for what couldn't be read: gone since it was listed, or there and unreadable."""
    kind = "vanished" if isinstance(e, (FileNotFoundError, NotADirectoryError)) else "unreadable"
    return (path.decode(errors="replace"), path, *[None] * 15, kind, e.strerror or type(e).__name__)


def below(path: bytes, deep: bool, retries: int) -> Iterator[tuple]:
    """The entries of a directory and, with `deep`, of all below it, by a stack of its own; a failed listing is tried again."""
    waiting = [path]
    while waiting:
        folder = waiting.pop()
        for left in reversed(range(retries + 1)):
            try:
                names = sorted(os.listdir(folder))
                break
            except OSError as e:
                if left == 0 or isinstance(e, (FileNotFoundError, NotADirectoryError, PermissionError)):
                    yield problem(folder, e)
                    names = []
                    break
        for name in names:
            one = os.path.join(folder, name)
            try:
                row = entry(one)
            except OSError as e:
                yield problem(one, e)
                continue
            yield row
            if deep and row[2] == "directory":
                waiting.append(one)


@dataclass
class Part(InputPartition):
    """Directories whose entries a task lists: all that lies below them (deep), or only what they hold."""

    directories: list[bytes]
    deep: bool
    itself: bool = False


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.fsencode(options["path"].removeprefix("file://")).rstrip(b"/") or b"/"
        self.tasks, self.retries = int(options.get("tasks", 64)), int(options.get("retries", 2))

    def partitions(self) -> list[Part]:
        """Directories are listed level by level, each level at once, until there are enough of them for the tasks.

        The levels above are read as they are, without what lies below; the
        driver holds the names of the last level's directories alone.
        """
        level, upper = [self.root], []
        while level and len(level) < self.tasks:
            down = []
            for folder in level:
                try:
                    with os.scandir(folder) as found:
                        down += sorted(e.path for e in found if e.is_dir(follow_symlinks=False))
                except OSError:
                    pass  # the task that lists it says so
            upper += level
            if not down:
                level = []
                break
            level = down
        parts = [Part([d for d in level[k :: self.tasks]], True) for k in range(min(self.tasks, len(level)))]
        parts += [Part(upper[k : k + 256], False) for k in range(0, len(upper), 256)]
        return [Part([self.root], False, True), *parts]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        rows = []

        def found() -> Iterator[tuple]:
            if part.itself:
                try:
                    yield entry(self.root)
                except OSError as e:
                    yield problem(self.root, e)
                return
            for d in part.directories:
                yield from below(d, part.deep, self.retries)

        for row in found():
            rows.append(row)
            if len(rows) == BATCH:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


class Tree(DataSource):
    """spark.read.format("tree").load("/a/folder"): every entry of a folder that all executors see, in the columns of a raw scan.

    Options: tasks (64), retries (2: how often a listing that fails is tried
    again). Symlinks are never followed; names that are no UTF-8 are whole in
    path_bytes. A folder without entries gives the row of itself.
    """

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def read_tree(spark: SparkSession, path: str, tasks: int = 64, retries: int = 2) -> DataFrame:
    spark.dataSource.register(Tree)
    return spark.read.format("tree").option("tasks", tasks).option("retries", retries).load(path)


def problems(tree: DataFrame) -> DataFrame:
    return tree.where("problem is not null").select("path", "problem", "detail")


def accept(tree: DataFrame) -> DataFrame:
    """The entries of a walk that read every directory; ValueError names up to ten that couldn't be read.

    What vanished while the walk ran is no fault: it was being deleted. An
    unreadable directory or entry is, as all below it would count as deleted.
    """
    bad = tree.where("problem = 'unreadable'").select("path", "detail").orderBy("path").limit(11).collect()
    if bad:
        raise ValueError("the walk is incomplete: " + "; ".join(f"{r['path']}: {r['detail']}" for r in bad[:10]) + (", and more" if len(bad) > 10 else ""))
    return tree.where("problem is null").drop("problem", "detail")


def walk_counts(tree: DataFrame) -> DataFrame:
    """One row: entries of each type, bytes of files, what vanished and what couldn't be read."""
    of = lambda k: F.count_if(F.col("file_type") == k)
    return tree.agg(
        F.count_if(F.col("problem").isNull()).alias("entries"), *[of(k).alias(k) for k in WALKER_TYPES], F.coalesce(F.sum(F.when(F.col("file_type") == "file", F.col("size"))), F.lit(0)).alias("bytes"),
        F.count_if(F.col("problem") == "vanished").alias("vanished"), F.count_if(F.col("problem") == "unreadable").alias("unreadable"),
    )
