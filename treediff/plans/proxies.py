"""File-tree tables made from the driver's tables by integer expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treediff.functions.entries import TYPE_BITS

#: Snapshot of a tree: a row for each order.
INDEX = f"""
SELECT o_orderkey AS k, (o_custkey % 4) * 1099511627776 + o_orderkey AS row_id, o_custkey % 4 AS shard,
  '/c' || CAST(o_custkey AS VARCHAR(20)) || '/o' || CAST(o_orderkey AS VARCHAR(20)) AS path, o_orderkey * 37 % 100003 AS size,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderkey % 86400 END AS mtime_sec,
  CAST(CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE (o_orderkey % 1000) * 1000 END AS INT) AS mtime_nsec,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderkey % 86400 + 60 END AS atime_sec, CAST(o_orderkey % 7 AS INT) AS atime_nsec,
  CAST(1 + o_orderkey % 7 AS INT) AS file_type,
  CAST(CASE 1 + o_orderkey % 7 {" ".join(f"WHEN {k} THEN {v}" for k, v in TYPE_BITS.items())} END AS BIGINT) + o_orderkey % 4096 AS mode,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_custkey % 50 END AS uid, o_custkey % 20 AS gid,
  1 + o_orderkey % 3 AS nlink, CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_orderkey % 500 END AS inode,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_custkey % 3 END AS fsid
FROM orders"""
_REST = "shard, mtime_sec, {ns} AS mtime_nsec, atime_sec, atime_nsec, {ft} AS file_type, {mode} AS mode, {uid} AS uid, gid, nlink, inode, fsid"
_SAME = _REST.format(ns="mtime_nsec", ft="file_type", mode="mode", uid="uid")
#: The same tree later: some entries gone, some changed, some new.
CURRENT = f"""
SELECT k, row_id, path, size + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS size, {_SAME} FROM ({INDEX}) i WHERE k % 7 <> 0
UNION ALL SELECT k, row_id + 549755813888, path || '.new', size, {_SAME} FROM ({INDEX}) i WHERE k % 11 = 0"""
#: A faulty copy of the tree.
DEST = f"""
SELECT k, row_id, path, size + CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END AS size, {_REST.format(
    ns="CAST(CASE WHEN k % 15 = 0 THEN mtime_nsec + 1000 ELSE mtime_nsec END AS INT)", ft="CAST(CASE WHEN k % 25 = 0 THEN 1 + file_type % 7 ELSE file_type END AS INT)",
    mode="CASE WHEN k % 12 = 0 THEN mode + 1 - 2 * (mode % 2) ELSE mode END", uid="CASE WHEN k % 14 = 0 THEN uid + 1 ELSE uid END",
)} FROM ({INDEX}) i WHERE k % 9 <> 0
UNION ALL SELECT k, row_id + 549755813888, path || '.extra', size, {_SAME} FROM ({INDEX}) i WHERE k % 16 = 0"""
PENDING = f"SELECT path FROM ({INDEX}) i WHERE k % 3 = 0"
#: Kinds by user and event, for the folds over the log.
KINDS = ("ProgressDelta", "JobCreated", "WorkerJoined", "ErrorEmitted", "JobPaused", "JobResumed", "VerifyStarted", "VerifyCompleted", "ProgressSync", "WorkerFenced", "ClaimConflictResolved", "JobPhaseChanged", "WorkerLeft")
#: An event log: a row for each event, jobs and workers from the user.
LOG = f"""
SELECT event_id AS seq, at_us, CASE WHEN event_id % 17 < 5 THEN 'ProgressDelta' ELSE CASE event_id % 13 {" ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(KINDS))} END END AS kind,
  'job' || CAST(user_id % 20 AS VARCHAR(20)) AS job, 'w' || CAST(user_id AS VARCHAR(20)) AS worker,
  CASE WHEN event_id % 11 = 0 THEN 'w0' END AS from_worker, CASE WHEN event_id % 3 = 0 THEN event_id * 7 % 1000 END AS client_seq,
  event_id % 50 AS files, event_id * 31 % 100000 AS bytes, event_id % 3 AS errors, CASE WHEN event_id % 2 = 0 THEN 'Scanning' ELSE 'Copying' END AS to_phase,
  event_id % 2 AS mismatches, event_type AS class, '/p' || CAST(event_id % 40 AS VARCHAR(20)) AS path, event_id % 2 = 0 AS retryable, CAST(NULL AS VARCHAR(10)) AS reason
FROM timed_events"""
#: Latency samples in whole µs.
SAMPLES = "SELECT event_id, user_id, at_us, event_type AS op, CASE WHEN user_id % 2 = 0 THEN 'source' ELSE 'dest' END AS side, CAST(floor(value * 1000) AS BIGINT) AS duration_us FROM timed_events WHERE value IS NOT NULL"
_DUCK_TIMES = "(SELECT *, epoch_us(ts) AS at_us FROM events)"


#: The columns of orders and events that the tables above are made from: a read with a schema looks at no file.
READ = {"orders": "o_orderkey long, o_custkey long", "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"}


def views(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One of the above over the tables of a folder."""
    read = lambda t: spark.read.schema(READ[t]).parquet(f"{sf_dir}/{t}.parquet")
    if "timed_events" in sql:
        return spark.sql(sql.replace("timed_events", "{timed}"), timed=read("events").selectExpr("*", "unix_micros(cast(ts as timestamp)) as at_us"))
    return spark.sql(sql.replace("FROM orders", "FROM {orders}"), orders=read("orders"))


def duck(sql: str) -> str:
    return sql.replace("timed_events", _DUCK_TIMES)
