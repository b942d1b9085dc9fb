"""Indexes, JSON lines, keep lists and manifests: sources and sinks."""

from __future__ import annotations

import json
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treediff.functions import entries as E
from treediff.operators.schema import CANONICAL, FORMAT_VERSION, check_rows, conform
from treediff.sources import files
from treediff.sources.files import digests, fs_of  # noqa: F401

#: Fixed: fields of the line records.
FAILURES = "row_id long, shard string, path_b64 string, error string, phase string, ts string"
DOWNGRADES = "row_id long, shard string, path_b64 string, downgrade string, ts string"
DELETIONS = "path_b64 string, ts string"
MISMATCHES = "path_b64 string, path_lossy string, kind string, expected string, actual string, detail string"
CLAIMS = "host string, claimed_utc string, epoch long, state string"
ROW_GROUP = 32 << 20
TOP = 2**63 - 1
#: Whose a manifest is.
IDENTITY = ("run_id", "source", "dest")


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = fs_of(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str, pattern: str = "*") -> list[str]:
    fs, p = fs_of(spark, f"{path}/{pattern}")
    return sorted(s.getPath().toString() for s in fs.globStatus(p) or [])


def scan_dir(spark: SparkSession, path: str) -> str:
    """The folder of a scan's parts: the path itself, or the one folder in its scans/; ValueError for none or several."""
    if children(spark, path, "*.parquet"):
        return path
    found = [d for d in children(spark, f"{path}/scans", "*") if children(spark, d, "*.parquet")]
    if len(found) != 1:
        raise ValueError(f"{len(found)} scans in {path}")
    return found[0]


def read_index(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A canonical index, checked by name and type; strict: a corrupt row fails the query, else it says why in corrupt_reason."""
    index = check_rows(conform(spark.read.parquet(path)), strict)
    return index.drop("corrupt_reason") if strict else index


def write_index(index: DataFrame, path: str) -> None:
    """One folder for each shard; an empty index still has its schema."""
    df = index.withColumn("shard_index", E.shard_of(F.col("row_id")))
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).partitionBy("shard_index").mode("errorifexists").parquet(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every *.jsonl of a folder; a missing folder is empty, a bad record fails the query."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").option("pathGlobFilter", "*.jsonl").json(path)


def write_lines(df: DataFrame, path: str, stem: str, epoch: int) -> str:
    """Records of one flush in a folder named by stem and epoch: a second writer of the same epoch fails instead of doubling them."""
    out = f"{path}/{stem}-e{epoch}"
    df.write.mode("errorifexists").json(out)
    return out


def with_paths(records: DataFrame) -> DataFrame:
    return records.withColumn("path", F.unbase64("path_b64")).withColumn("path_lossy", E.path_lossy(F.col("path")))


def pending(failures: DataFrame, downgrades: DataFrame) -> DataFrame:
    """Paths that the next delta must have: failed ones and torn copies, each once."""
    torn = downgrades.where(F.col("downgrade").contains("TORN_COPY"))
    return failures.select("path_b64").unionByName(torn.select("path_b64")).distinct().select(F.unbase64("path_b64").alias("path"))


SHARDS = T.StructType([T.StructField("path", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("sha256", T.StringType())])


def manifest_errors(shards: DataFrame, total_rows: int, total_bytes: int, version: int = FORMAT_VERSION) -> DataFrame:
    """(path, why) of a manifest's shards (path, rows, bytes, sha256), and of its totals under a null path."""
    unsafe = F.col("path").startswith("/") | F.col("path").contains("\\") | F.exists(F.split("path", "/"), lambda x: x.isin("", ".", ".."))
    why = F.array(
        F.when(F.lit(version) != FORMAT_VERSION, "format version"), F.when(F.coalesce(unsafe, F.lit(True)), "unsafe path"), F.when(F.coalesce(F.col("bytes") <= 0, F.lit(True)), "no bytes"),
        F.when(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "sha256"),
    )
    each = shards.select("path", F.explode(F.filter(why, lambda x: x.isNotNull())).alias("why"))
    twice = shards.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path", F.lit("listed twice").alias("why"))
    whole = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(20,0)")), F.lit(0).cast("decimal(38,0)"))
    sums = shards.agg(whole("rows").alias("r"), whole("bytes").alias("b"), F.count("*").alias("n"))
    dec = lambda n: F.lit(str(n)).cast("decimal(38,0)")
    over = (F.col("r") > dec(TOP)) | (F.col("b") > dec(TOP))
    why = F.when(F.col("n") == 0, "no shards").when(over, "totals overflow").when((F.col("r") != dec(total_rows)) | (F.col("b") != dec(total_bytes)), "totals")
    off = sums.select(F.lit(None).cast("string").alias("path"), why.alias("why")).where("why is not null")
    return each.unionByName(twice).unionByName(off)


def write_manifest(spark: SparkSession, root: str, identity: dict, shards: DataFrame) -> dict:
    """The manifest of the shards below root (path, rows, bytes, sha256), with their totals and whose they are: run_id, source, dest.

    The list of shards is a table beside it, so that neither the driver nor one file holds them all.
    """
    shards.select(*[F.col(f.name).cast(f.dataType) for f in SHARDS]).write.mode("errorifexists").json(f"{root}/manifest-shards")
    sums = read_shards(spark, root).agg(F.count("*").alias("n"), F.coalesce(F.sum("rows"), F.lit(0)).alias("r"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()
    value = {"format_version": FORMAT_VERSION, **{k: identity[k] for k in IDENTITY}, "shards": sums["n"], "total_rows": sums["r"], "total_bytes": sums["b"]}
    write_json(spark, f"{root}/manifest.json", value)
    return value


def read_shards(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(SHARDS).option("mode", "FAILFAST").json(f"{root}/manifest-shards")


def shards_of(spark: SparkSession, folder: str) -> DataFrame:
    """SHARDS of the Parquet files below a folder, named from there: digests from their bytes, rows from their footers."""
    from treediff.sources import footers

    base = urlparse(files.qualified(spark, folder)).path.rstrip("/") + "/"
    own = lambda c: F.substring_index(F.regexp_replace(c, "^[a-z0-9]+:/*", "/"), base, -1)
    foot = footers.read_footers(spark, folder).select(own("path").alias("f_path"), "rows")
    found = digests(spark, folder).where(F.col("path").endswith(".parquet")).select(own("path").alias("path"), "bytes", "sha256")
    return found.join(foot, F.col("path") == F.col("f_path"), "left").select("path", "rows", "bytes", "sha256")


def load_manifest(spark: SparkSession, root: str, identity: dict | None = None, folder: str | None = None, shown: int = 10) -> tuple[dict, DataFrame] | None:
    """(manifest, its shards) once all of it has been checked; None where there is none.

    ValueError for another format version, for another run, source or destination
    than `identity`, for shards that the rules of manifest_errors refuse, and,
    with `folder`, for shards that the files below it don't bear out.
    """
    value = read_json(spark, f"{root}/manifest.json")
    if value is None:
        return None
    if value["format_version"] != FORMAT_VERSION:
        raise ValueError(f"manifest of format version {value['format_version']}")
    if wrong := [k for k in IDENTITY if identity and value.get(k) != identity[k]]:
        raise ValueError(f"the manifest's {wrong[0]} is {value.get(wrong[0])!r}, not {identity[wrong[0]]!r}")
    shards = read_shards(spark, root)
    bad = manifest_errors(shards, value["total_rows"], value["total_bytes"], value["format_version"])
    if folder:
        bad = bad.unionByName(verify_shards(spark, folder, shards))
    found = bad.orderBy("path", "why").limit(shown + 1).collect()
    if found:
        raise ValueError("manifest: " + "; ".join(f"{r['path']}: {r['why']}" for r in found[:shown]) + (", and more" if len(found) > shown else ""))
    return value, shards


def verify_shards(spark: SparkSession, root: str, shards: DataFrame) -> DataFrame:
    """(path, why) of a manifest's shards that the files below root don't bear out: absent, or of another size, digest or number of rows.

    Digests are read as streams on the executors; rows are those of the files' footers.
    """
    from treediff.sources import footers

    base = fs_of(spark, root)[1].toUri().getPath().rstrip("/") + "/"
    own = F.substring_index(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), base, -1)
    found = files.digests(spark, root).select(own.alias("f_path"), F.col("sha256").alias("f_sha"), F.col("bytes").alias("f_bytes"), "error")
    rows = footers.read_footers(spark, root).select(own.alias("r_path"), F.col("rows").alias("f_rows"))
    both = shards.join(found, F.col("path") == F.col("f_path"), "left").join(rows, F.col("path") == F.col("r_path"), "left")
    why = F.array(
        F.when(F.col("f_path").isNull(), "absent"), F.when(F.col("error").isNotNull(), "unreadable"), F.when(F.col("f_bytes") != F.col("bytes"), "size"), F.when(F.col("f_sha") != F.col("sha256"), "digest"),
        F.when(F.col("f_path").isNotNull() & F.col("f_sha").eqNullSafe(F.col("sha256")) & (F.coalesce("f_rows", F.lit(-1)) != F.col("rows")), "rows"),
    )
    return both.select("path", F.explode(F.filter(why, lambda x: x.isNotNull())).alias("why"))


def write_snapshot(snapshot: DataFrame, root: str, version: int, keep: int = 5) -> None:
    """A snapshot of jobs under its version; one that exists isn't replaced; beyond the newest `keep`, old ones go."""
    spark = snapshot.sparkSession
    snapshot.write.mode("errorifexists").option("compression", "zstd").parquet(f"{root}/snapshot-{version:020d}")
    for old in [p for p in children(spark, root, "snapshot-*") if exists(spark, f"{p}/_SUCCESS")][:-keep]:
        fs, p = fs_of(spark, old)
        fs.delete(p, True)


def read_snapshot(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The newest whole snapshot; an empty one where there is none."""
    whole = [p for p in children(spark, root, "snapshot-*") if exists(spark, f"{p}/_SUCCESS")]
    return spark.read.schema(schema).parquet(whole[-1]) if whole else spark.createDataFrame([], schema)


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """A small JSON file, written under a name of its own and renamed over its place: readers see the old one or the new one."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs, p = fs_of(spark, path)
    side = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(side, False)
    out.write(bytearray(json.dumps(value, sort_keys=True), "utf-8"))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(side), fs.makeQualified(p), over)
    except Exception:
        fs.delete(side, False)
        raise


def read_json(spark: SparkSession, path: str) -> dict | None:
    if not exists(spark, path):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def commit_pass(spark: SparkSession, root: str, number: int, keep: int = 2) -> None:
    """Make a pass the baseline, then remove all but the newest `keep` ones."""
    write_json(spark, f"{root}/baseline.json", {"pass": number})
    passes = sorted((int(urlparse(p).path.rsplit("-", 1)[1]), p) for p in children(spark, root, "pass-*"))
    for n, p in passes:
        if n <= number - keep:
            fs, q = fs_of(spark, p)
            fs.delete(q, True)


def fail_pass(spark: SparkSession, root: str, number: int, stamp: str) -> str:
    """Move a pass that has failed aside, under a name that no pass has; returns it. Its number is free again."""
    fs, p = fs_of(spark, f"{root}/pass-{number}")
    to = f"{root}/failed-{number}-{stamp}"
    if not fs.rename(p, fs_of(spark, to)[1]):
        raise ValueError(f"pass {number} can't be moved to {to}")
    return to


def purge_scan(spark: SparkSession, root: str) -> bool:
    """Delete the raw scan of a work folder, once a manifest of its shards stands; returns whether it did. An index can't be without either."""
    if not exists(spark, f"{root}/manifest.json"):
        raise ValueError(f"no manifest in {root}: its scan is still needed")
    fs, p = fs_of(spark, f"{root}/scan")
    return bool(fs.exists(p) and fs.delete(p, True))


def empty_index(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CANONICAL)
