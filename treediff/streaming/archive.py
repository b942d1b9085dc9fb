"""Finished jobs' logs moved into an archive: copied, compared, then deleted."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treediff.sources import files, tables

MOVED = "path string, to string, bytes long, sha256 string"


def _copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each file into its place in the archive, by a file beside it; its digest is that of the bytes read."""
    for batch in batches:
        rows = []
        for path, to in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            (store, name), (there, place) = files.store_of(path), files.store_of(to)
            side, sha, size = f"{place}.{uuid.uuid4().hex}.tmp", hashlib.sha256(), 0
            there.create_dir(place.rsplit("/", 1)[0], recursive=True)
            with store.open_input_stream(name) as f, there.open_output_stream(side) as out:
                while piece := f.read(files.PIECE):
                    sha.update(piece)
                    size += len(piece)
                    out.write(piece)
            there.move(side, place)
            rows.append((path, to, size, sha.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.string()))], ["path", "to", "bytes", "sha256"])


def _folder(job: str) -> str:
    return f"job={job}"


def copy_job(spark: SparkSession, log: str, archive: str, job: str) -> DataFrame:
    """MOVED: the files of a job's log, copied into the archive by the executors; written again by every run."""
    root = files.qualified(spark, f"{log}/{_folder(job)}")
    target = files.qualified(spark, f"{archive}/{_folder(job)}")
    inside = F.substring("path", len(root.replace("file:///", "file:/")) + 1, 1 << 20)
    own = F.regexp_replace("path", "^file:/+", "file:/")
    found = files.listed(spark, root).select(own.alias("path")).where(~F.col("path").rlike(r"(\.tmp|\.crc)$"))
    return files.spread(found.select("path", F.concat(F.lit(target.replace("file:///", "file:/")), inside).alias("to"))).mapInArrow(_copy, MOVED)


def archive_job(spark: SparkSession, log: str, archive: str, job: str, stop_after: str | None = None) -> dict:
    """Move a job's chunks from the log into the archive; returns {"chunks", "bytes"} of this run. Safe to repeat.

    Files are copied first; then the archive's digests are read back and
    compared, and only files whose copy is whole are deleted, so a crash at any
    point leaves each event in the log, in the archive or in both. A chunk that
    has come meanwhile stays for the next run. ValueError where a copy differs.
    `stop_after` (copy or compare) ends a run there, as a crash would.
    """
    root = f"{log}/{_folder(job)}"
    if not tables.exists(spark, root):
        return {"chunks": 0, "bytes": 0}
    moved = copy_job(spark, log, archive, job).persist()
    try:
        total = moved.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()
        if stop_after == "copy":
            return {"chunks": 0, "bytes": 0}
        if total["n"]:
            there = files.digests(spark, f"{archive}/{_folder(job)}").select(F.regexp_replace("path", "^file:/+", "file:/").alias("a_path"), F.col("sha256").alias("a_sha256"))
            wrong = moved.join(there, F.col("to") == F.col("a_path"), "left").where(~F.col("sha256").eqNullSafe(F.col("a_sha256"))).first()
            if wrong:
                raise ValueError(f"the copy of {wrong['path']} differs from it")
        if stop_after == "compare":
            return {"chunks": 0, "bytes": 0}
        for r in moved.select("path").collect():  # a name a chunk
            fs, p = tables.fs_of(spark, r["path"])
            fs.delete(p, False)
        _drop_empty(spark, root)
        return {"chunks": total["n"], "bytes": total["b"]}
    finally:
        moved.unpersist()


def _drop_empty(spark: SparkSession, folder: str) -> None:
    """Remove folders in which no chunk is left."""
    for path in tables.children(spark, folder):
        fs, p = tables.fs_of(spark, path)
        if fs.getFileStatus(p).isDirectory() and not [c for c in tables.children(spark, path) if not c.rsplit("/", 1)[1].startswith(("_", "."))]:
            fs.delete(p, True)
    if not [c for c in tables.children(spark, folder) if not c.rsplit("/", 1)[1].startswith(("_", "."))]:
        fs, p = tables.fs_of(spark, folder)
        fs.delete(p, True)


def archive_jobs(spark: SparkSession, log: str, archive: str, jobs: DataFrame) -> dict:
    """All jobs of `jobs` (job), as `coordination.archivable` names them; a job that fails doesn't keep the others, its error is raised at the end."""
    total, errors = {"chunks": 0, "bytes": 0}, []
    for r in jobs.select("job").distinct().orderBy("job").toLocalIterator():
        try:
            total = {k: total[k] + n for k, n in archive_job(spark, log, archive, r["job"]).items()}
        except Exception as e:
            errors.append(f"{r['job']}: {e}")
    if errors:
        raise ValueError("; ".join(errors[:10]))
    return total
