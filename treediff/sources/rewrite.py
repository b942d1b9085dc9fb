"""Scan parts to stamped index shards, one file each, part by part: a rerun redoes only what isn't there whole."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treediff.functions import entries as E
from treediff.operators.canonical import canonicalise
from treediff.operators.schema import CANONICAL, CONTRACT_VERSION, FORMAT_VERSION
from treediff.sources import files, footers, tables

REPORT, CHECKPOINTS, REPORT_VERSION = "rewrite-report.json", "_checkpoints", 1
#: Bytes of rows that become one row group.
ROW_GROUP = 32 << 20
CHECKPOINT = "part string, shard_index long, input_bytes long, input_modified timestamp, output_bytes long, output_sha256 string, rows long"
_CHECKPOINT_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.timestamp("us", "UTC"), pa.int64(), pa.string(), pa.int64()]


class _Shard:
    """One shard's file, written beside its place and moved over it once it is whole, with its checkpoint behind it."""

    def __init__(self, root: str, part: str, schema: pa.Schema, sign: dict, version: str):
        self.store, base = files.store_of(root)
        self.part, self.sign, self.version = part, sign, version
        self.place, self.side = f"{base}/{part}", f"{base}/{part}.{uuid.uuid4().hex}.partial"
        self.record = f"{base}/{CHECKPOINTS}/{part}.json"
        self.rows, self.held, self.size = 0, [], 0
        self.out = self.store.open_output_stream(self.side)
        self.writer = pq.ParquetWriter(self.out, schema, compression="zstd")

    def add(self, batch: pa.RecordBatch) -> None:
        self.held.append(batch)
        self.rows, self.size = self.rows + batch.num_rows, self.size + batch.nbytes
        if self.size >= ROW_GROUP:
            self.flush()

    def flush(self) -> None:
        if self.held:
            table = pa.Table.from_batches(self.held)
            self.writer.write_table(table, row_group_size=max(1, table.num_rows))
            self.held, self.size = [], 0

    def close(self) -> tuple:
        """The shard's checkpoint, after file and record are in place."""
        self.flush()
        stamps = {"format_version": FORMAT_VERSION, "contract_version": CONTRACT_VERSION, "shard_index": self.sign["shard"], "walker_version": self.version, "row_count": self.rows}
        self.writer.add_key_value_metadata({footers.STAMPS[k]: str(v) for k, v in stamps.items()})
        self.writer.close()
        self.out.close()
        sha, size = hashlib.sha256(), 0
        with self.store.open_input_stream(self.side) as f:
            while piece := f.read(files.PIECE):
                sha.update(piece)
                size += len(piece)
        self.store.move(self.side, self.place)
        row = (self.part, self.sign["shard"], self.sign["bytes"], self.sign["modified"], size, sha.hexdigest(), self.rows)
        record = dict(zip([c.split()[0] for c in CHECKPOINT.split(", ")], row)) | {"input_modified": self.sign["modified"].astimezone(UTC).isoformat()}
        with self.store.open_output_stream(self.record + ".partial") as f:
            f.write(json.dumps(record).encode())
        self.store.move(self.record + ".partial", self.record)
        return row

    def drop(self) -> None:
        self.out.close()
        self.store.delete_file(self.side)


def _writer(root: str, version: str, names: list[str]):
    """Rows sorted by part and position, a sign before each part's first one; yields a checkpoint a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        try:
            for batch in batches:
                rows, sign, at = batch.select(names), batch.column("sign"), 0
                for k in [*sign.is_valid().to_numpy(zero_copy_only=False).nonzero()[0].tolist(), batch.num_rows]:
                    if k > at:
                        now.add(rows.slice(at, k - at))
                    if k < batch.num_rows:
                        if now is not None:
                            done.append(now.close())
                            now = None
                        now = _Shard(root, batch.column("part")[k].as_py(), rows.schema, sign[k].as_py(), version)
                    at = k + 1
            if now is not None:
                done.append(now.close())
                now = None
        finally:
            if now is not None:
                now.drop()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else [[]] * len(_CHECKPOINT_TYPES), _CHECKPOINT_TYPES)], [c.split()[0] for c in CHECKPOINT.split(", ")])

    return run


def parts_of(spark: SparkSession, scan: str) -> DataFrame:
    """(part, path, input_bytes, input_modified, shard_index) of a scan's files; shards are numbered by name."""
    from pyspark.sql.window import Window

    found = files.listed(spark, scan, "*.parquet").withColumn("part", files.name_of(F.col("path")))
    n = F.row_number().over(Window.orderBy("part")) - 1  # a row a file
    return found.select("part", "path", F.col("length").alias("input_bytes"), F.col("modified").alias("input_modified"), n.cast("long").alias("shard_index"))


def checkpoints_of(spark: SparkSession, out: str) -> DataFrame:
    folder = f"{out}/{CHECKPOINTS}"
    if not tables.children(spark, folder, "*.json"):
        return spark.createDataFrame([], CHECKPOINT)
    return spark.read.schema(CHECKPOINT).option("mode", "FAILFAST").option("pathGlobFilter", "*.json").json(folder)


def states(spark: SparkSession, parts: DataFrame, out: str) -> DataFrame:
    """Parts and checkpoints with their state: done, to_do, changed (another input), broken (another output), orphan (no input).

    done takes all of: the input's size and time, the shard's number, and the
    output's size, digest, footer rows and stamped number.
    """
    c = checkpoints_of(spark, out)
    c = c.select(*[F.col(k).alias(f"c_{k}") for k in c.columns])
    both = parts.join(c, F.col("part") == F.col("c_part"), "full")
    if tables.children(spark, out, "*.parquet"):
        found = files.digests(spark, out).where(F.col("path").endswith(".parquet")).select(files.name_of(F.col("path")).alias("o_part"), F.col("sha256").alias("o_sha256"), F.col("bytes").alias("o_bytes"))
        foot = footers.read_footers(spark, out).select(files.name_of(F.col("path")).alias("f_part"), F.col("rows").alias("f_rows"), footers.stamp("shard_index").cast("long").alias("f_shard"))
        both = both.join(found, F.col("c_part") == F.col("o_part"), "left").join(foot, F.col("c_part") == F.col("f_part"), "left")
    else:
        both = both.withColumns({k: F.lit(None).cast(t) for k, t in (("o_sha256", "string"), ("o_bytes", "long"), ("f_rows", "long"), ("f_shard", "long"))})
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    input_ = same("input_bytes", "c_input_bytes") & same("input_modified", "c_input_modified") & same("shard_index", "c_shard_index")
    output = same("o_bytes", "c_output_bytes") & same("o_sha256", "c_output_sha256") & same("f_rows", "c_rows") & same("f_shard", "c_shard_index")
    state = F.when(F.col("part").isNull(), "orphan").when(F.col("c_part").isNull(), "to_do").when(~input_, "changed").when(~output, "broken").otherwise("done")
    return both.select(F.coalesce("part", "c_part").alias("part"), "path", "input_bytes", "input_modified", "shard_index", state.alias("state"))


def _refuse_strangers(spark: SparkSession, out: str, names: set[str]) -> None:
    """ValueError for anything in the output folder that isn't a shard, its partial, the report or the checkpoints; partials go."""
    for path in tables.children(spark, out):
        name = os.path.basename(path.rstrip("/"))
        partial = name.endswith(".partial") and (name.rsplit(".", 2)[0] in names or name.removesuffix(".partial") in names)
        if partial:
            fs, p = files.fs_of(spark, path)
            fs.delete(p, False)
        elif name not in names | {REPORT, CHECKPOINTS}:
            raise ValueError(f"unexpected entry in the output folder: {path}")


def rewrite(spark: SparkSession, scan: str, out: str, root: str, version: str, resume: bool = False, only: int | None = None) -> dict:
    """Rewrite a scan's raw parts below `root` into index shards of the same names, stamped in their footers; returns the report.

    Each part is one file whose rows keep their order, and is committed alone: a
    file beside its place, moved over it, then a checkpoint with the input's
    size and time and the output's size, digest and rows. With `resume`, parts
    whose checkpoint still holds are not touched; absent, changed and broken
    ones are written anew, and leftover partials go. ValueError for an output
    folder that isn't empty (without resume) or has strange entries, for
    checkpoints whose input is gone, and for a report of other folders, root or
    version. A part without rows gives a shard without rows. `only`: stop after
    that many parts, as an interrupted run would.

    Executors write to `out` themselves, so its store must be one that Arrow
    knows. Rows are shuffled once by part; a part is the unit of a task.
    """
    scan, out = files.qualified(spark, tables.scan_dir(spark, scan)), files.qualified(spark, out)
    files.store_of(out)
    parts = parts_of(spark, scan).persist()
    names = {r["part"] for r in parts.select("part").collect()}  # a name a file
    if not names:
        raise ValueError(f"no parts in {scan}")
    fs, p = files.fs_of(spark, f"{out}/{CHECKPOINTS}")
    if tables.children(spark, out):
        if not resume:
            raise ValueError(f"the output folder isn't empty: {out}")
        _refuse_strangers(spark, out, names)
    context = {"version": REPORT_VERSION, "input": scan, "output": out, "root": root, "walker_version": version}
    old = tables.read_json(spark, f"{out}/{REPORT}")
    if old and any(old.get(k) != v for k, v in context.items()):
        raise ValueError("the report in the output folder is of another rewrite")
    fs.mkdirs(p)
    tables.write_json(spark, f"{out}/{REPORT}", context | {"complete": False})
    found = states(spark, parts, out).persist()
    if orphan := found.where("state = 'orphan'").orderBy("part").first():
        raise ValueError(f"a checkpoint's part is no longer in the scan: {orphan['part']}")
    todo = found.where("state <> 'done'")
    if only is not None:
        todo = todo.orderBy("part").limit(only)
    signs = todo.select("part", F.lit(-1).cast("long").alias("at"), F.struct(F.col("shard_index").alias("shard"), F.col("input_bytes").alias("bytes"), F.col("input_modified").alias("modified")).alias("sign"))
    paths = [r["path"] for r in todo.select("path").collect()]  # a path a file, as Spark's reader takes them
    if paths:
        raw = spark.read.parquet(*paths).withColumns({"part": F.col("_metadata.file_name"), "at": F.col("_metadata.row_index")})
        raw = raw.join(F.broadcast(todo.select("part", "shard_index")), "part")
        rows = canonicalise(raw, root, F.col("shard_index"), F.col("at"))
        own = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in CANONICAL]
        both = rows.select("part", "at", *own).unionByName(signs, allowMissingColumns=True)
        tasks = max(1, min(len(paths), 10_000))
        both.repartition(tasks, "part").sortWithinPartitions("part", "at").mapInArrow(_writer(out, version, CANONICAL.names), CHECKPOINT).write.format("noop").mode("overwrite").save()
    done = checkpoints_of(spark, out)
    total = done.agg(F.count("*").alias("n"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("output_bytes"), F.lit(0)).alias("bytes")).first()
    report = context | {"complete": total["n"] == len(names), "shards": total["n"], "total_rows": total["rows"], "total_output_bytes": total["bytes"], "updated": datetime.now(UTC).isoformat()}
    tables.write_json(spark, f"{out}/{REPORT}", report)
    parts.unpersist()
    found.unpersist()
    return report

