"""Parquet footers as a table: stamps, rows, columns and row groups of each file, without its pages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treediff.functions import entries as E
from treediff.operators.schema import CONTRACT_VERSION, FORMAT_VERSION, REQUIRED, check_rows, conform
from treediff.sources import files

#: Fixed: keys of the footer's stamps.
STAMPS = {
    "format_version": "migration.format_version", "contract_version": "migration.contract_version", "shard_index": "migration.shard_index",
    "walker_version": "migration.walker_version", "row_count": "migration.row_count",
}
FOOTERS = (
    "path string, bytes long, modified timestamp, rows long, columns array<string>, stamps map<string,string>, "
    "groups array<struct<rows:long,bytes:long,first_id:long,last_id:long>>, error string"
)
_GROUP = pa.struct([("rows", pa.int64()), ("bytes", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())])
_TYPES = [pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.int64(), pa.list_(pa.string()), pa.map_(pa.string(), pa.string()), pa.list_(_GROUP), pa.string()]
_NAMES = ["path", "bytes", "modified", "rows", "columns", "stamps", "groups", "error"]


def parsed(source) -> tuple:
    """(rows, columns, stamps, row groups) of a file or of its tail; the ids are the statistics of row_id, null where there are none."""
    found = pq.read_metadata(source)
    names = found.schema.to_arrow_schema().names
    stamps = {k.decode(errors="replace"): v.decode(errors="replace") for k, v in (found.metadata or {}).items() if k.startswith(b"migration.")}
    at = [c for c in range(found.num_columns) if found.schema.column(c).path == "row_id"]
    groups = []
    for g in map(found.row_group, range(found.num_row_groups)):
        ids = g.column(at[0]).statistics if at else None
        ids = ids if ids is not None and ids.has_min_max else None
        groups.append({"rows": g.num_rows, "bytes": g.total_byte_size, "first_id": int(ids.min) if ids else None, "last_id": int(ids.max) if ids else None})
    return found.num_rows, names, list(stamps.items()), groups


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, length, modified and, for stores without streams, the file's tail."""
    for batch in batches:
        rows = []
        for path, size, modified, tail in zip(*[c.to_pylist() for c in batch.columns]):
            try:
                if tail is None:
                    store, name = files.store_of(path)
                    with store.open_input_file(name) as f:
                        found = (*parsed(f), None)
                else:
                    found = (*parsed(pa.BufferReader(tail)), None)
            except (OSError, ValueError, pa.ArrowException) as e:
                found = (None, None, None, None, f"{type(e).__name__}: {e}"[:300])
            rows.append((path, size, modified, *found))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)


def read_footers(spark: SparkSession, path: str, files_a_task: int = 1000) -> DataFrame:
    """FOOTERS of every *.parquet below a folder; a file without a footer has an error in place of the rest.

    Executors read only the tails. Where Arrow doesn't know the store, Spark's
    reader cuts the tail off, so that Python gets no pages.
    """
    if files.streams(spark, path):
        found = files.spread(files.listed(spark, path, "*.parquet"), files_a_task).withColumn("tail", F.lit(None).cast("binary"))
    else:
        # the last eight bytes: the footer's length, low byte first, and the format's name
        byte = lambda k: F.conv(F.hex(F.substring("content", k, 1)), 16, 10).cast("long")
        size = byte(-8) + byte(-7) * 256 + byte(-6) * 65536 + byte(-5) * 16777216 + 8
        whole = F.col("length") < 12
        tail = F.when(whole, F.col("content")).otherwise(F.expr("substring(content, -least(tail_size, length), least(tail_size, length))"))
        found = files.contents(spark, path, "*.parquet").withColumn("tail_size", F.coalesce(size, F.lit(8)).cast("int")).select("path", "length", "modified", tail.alias("tail"))
    return found.mapInArrow(_read, FOOTERS)


def stamp(name: str):
    return F.element_at("stamps", STAMPS[name])


def footer_findings(footers: DataFrame) -> DataFrame:
    """(path, severity, why): what a reader has to refuse (error), and what it only reports (warning).

    A file that can't be read, absent required columns and another format
    version, or one that is no number, are errors; an absent format version,
    another contract version and a stamped number of rows that isn't the
    footer's are warnings.
    """
    format_, contract, counted = stamp("format_version"), stamp("contract_version"), stamp("row_count")
    number = lambda c: F.when(c.rlike("^[0-9]{1,18}$"), c.cast("long"))
    finding = lambda severity, when, why: F.when(when, F.struct(F.lit(severity).alias("severity"), why.alias("why")))
    readable, said = F.col("error").isNull(), lambda text, c: F.concat(F.lit(text), F.coalesce(c.cast("string"), F.lit("null")))
    found = F.array(
        finding("error", ~readable, said("unreadable: ", F.col("error"))),
        *[finding("error", readable & ~F.array_contains("columns", c), F.lit(f"column missing: {c}")) for c in REQUIRED],
        finding("error", readable & format_.isNotNull() & ~F.coalesce(number(format_) == FORMAT_VERSION, F.lit(False)), said("format version ", format_)),
        finding("warning", readable & format_.isNull(), F.lit("no format version")),
        finding("warning", readable & F.coalesce(number(contract) != CONTRACT_VERSION, F.lit(False)), said("contract version ", contract)),
        finding("warning", readable & F.coalesce(number(counted) != F.col("rows"), F.lit(False)), F.concat(said("stamped with rows: ", counted), F.lit(", has "), F.col("rows").cast("string"))),
    )
    return footers.select("path", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("path", "x.*")


def wrong_shards(footers: DataFrame) -> DataFrame:
    """(path, stamped, first_id): files whose first row id, by their row groups' statistics, names another shard than their stamp."""
    first = F.array_min(F.transform("groups", lambda g: g["first_id"]))
    rows = footers.select("path", stamp("shard_index").cast("long").alias("stamped"), first.alias("first_id"))
    return rows.where(F.col("stamped").isNotNull() & F.col("first_id").isNotNull() & (E.shard_of(F.col("first_id")) != F.col("stamped")))


def open_index(spark: SparkSession, path: str, strict: bool = True, shown: int = 10) -> tuple[DataFrame, DataFrame]:
    """(index, warnings): a canonical index whose footers have been checked first; ValueError names what must be refused.

    strict: a corrupt row fails the query, else it says why in corrupt_reason.
    """
    found = footer_findings(read_footers(spark, path))
    bad = found.where("severity = 'error'").orderBy("path", "why").limit(shown + 1).collect()
    if bad:
        raise ValueError("; ".join(f"{r['path']}: {r['why']}" for r in bad[:shown]) + (", and more" if len(bad) > shown else ""))
    index = check_rows(conform(spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)), strict)
    return (index.drop("corrupt_reason") if strict else index), found.where("severity = 'warning'")
