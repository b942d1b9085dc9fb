"""Files of any store that Spark reads: lists, digests, and streams on the executors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import xxhash
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schemes whose files executors open as streams, and what Arrow calls them; files of other stores come through Spark's reader.
STREAMS = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs"}
PIECE = 8 << 20


def fs_of(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def qualified(spark: SparkSession, path: str) -> str:
    fs, p = fs_of(spark, path)
    return fs.makeQualified(p).toString()


def streams(spark: SparkSession, path: str) -> bool:
    """Whether executors can open the files of this path's store as streams."""
    return qualified(spark, path).split(":", 1)[0] in STREAMS


def store_of(path: str) -> tuple[FileSystem, str]:
    """Arrow's file system of a file, and its name there. ValueError for a store that Arrow doesn't know."""
    scheme, _, rest = path.partition(":")
    if scheme not in STREAMS:
        raise ValueError(f"executors can't open files of {scheme}: as streams")
    if scheme == "file":  # Hadoop writes file:/a and file:///a
        return FileSystem.from_uri("file:///")[0], "/" + rest.lstrip("/")
    return FileSystem.from_uri(f"{STREAMS[scheme]}:{rest}")


def contents(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, length, modified, content): whole files as rows, for stores without streams; a file of 2 GB or more fails the query.

    Spark's reader leaves files without bytes out; they are added here.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    found = reader.load(path).withColumnRenamed("modificationTime", "modified")
    plain = lambda x: re.sub("^file:/+", "file:/", x)
    names = {plain(unquote(x)) for x in found.inputFiles()}  # Spark's driver has listed them already
    if len(names) == found.select("path").count():
        return found
    names -= {plain(r["path"]) for r in found.select("path").collect()}
    times = {n: fs_of(spark, n)[0].getFileStatus(fs_of(spark, n)[1]).getModificationTime() / 1000 for n in names}
    empty = spark.createDataFrame([(n, 0, t, b"") for n, t in sorted(times.items())], "path string, length long, t double, content binary")
    return found.unionByName(empty.select("path", "length", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("modified"), "content"))


def listed(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, length, modified) of the files below a folder; contents aren't read."""
    return contents(spark, path, pattern).select("path", "length", "modified")


def spread(files: DataFrame, files_a_task: int = 1000) -> DataFrame:
    """A list of files dealt out to tasks by its length."""
    tasks = max(1, min(10_000, files.count() // files_a_task + files.sparkSession.sparkContext.defaultParallelism))
    return files.repartition(tasks)


HASHES = {"sha256": hashlib.sha256, "xxh3_128": xxhash.xxh3_128}


def _pieces(path: str, body: bytes | None) -> Iterator[bytes]:
    if body is not None:
        yield body
        return
    store, name = store_of(path)
    with store.open_input_stream(name) as f:
        while piece := f.read(PIECE):
            yield piece


def _hash(names: tuple[str, ...]):
    """Files piece by piece (or whole, where the reader has brought them); one that can't be read has an error in place of its digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, length, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found, error = [HASHES[n]() for n in names], None
                try:
                    for piece in _pieces(path, body.as_py()):
                        for d in found:
                            d.update(piece)
                except (OSError, ValueError) as e:
                    error = str(e)
                rows.append((path, *[None if error else d.hexdigest() for d in found], length, error))
            kinds = (pa.string(), *[pa.string()] * len(names), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["path", *names, "bytes", "error"])

    return run


def content_hashes(spark: SparkSession, path: str, names: tuple[str, ...] = ("sha256", "xxh3_128"), files_a_task: int = 1000) -> DataFrame:
    """path, a digest by each of the names (of HASHES), bytes and error of the files below a folder, each read once."""
    if streams(spark, path):
        rows = spread(listed(spark, path), files_a_task).select("path", "length", F.lit(None).cast("binary").alias("content"))
    else:
        rows = contents(spark, path).select("path", "length", "content")
    return rows.mapInArrow(_hash(names), f"path string, {''.join(f'{n} string, ' for n in names)}bytes long, error string")


def digests(spark: SparkSession, path: str, files_a_task: int = 1000) -> DataFrame:
    """(path, sha256, bytes, error) of the files below a folder.

    Where Arrow knows the store, executors read them as streams and no file is
    ever a row; else Spark's own reader brings them, one row a file.
    """
    if streams(spark, path):
        return content_hashes(spark, path, ("sha256",), files_a_task)
    return contents(spark, path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), F.lit(None).cast("string").alias("error"))


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)
