"""Queries over results, commands, roots, rates and replays."""

from __future__ import annotations

from pyspark.sql import functions as F

from treediff.functions import decisions as D
from treediff.functions import entries as E
from treediff.functions import texts as X
from treediff.operators import canonical, coordination, events, planning, reconcile, telemetry
from treediff.plans import jobs
from treediff.plans.proxies import INDEX, LOG, SAMPLES, duck, views
from treediff.sources import tables

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = duck(sql)
        return f

    return add


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


# columns


@query("SELECT o_orderkey, row_number() OVER () - 1 AS row_index, (o_custkey % 4) * 1099511627776 + row_number() OVER () - 1 AS row_id FROM orders")
def row_offsets(spark, d):
    rows = _table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("_metadata.row_index").alias("row_index"))
    return rows.select("o_orderkey", "row_index", E.make_row_id(F.col("o_custkey") % 4, F.col("row_index")).alias("row_id"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '/b' || p_partkey ELSE '/t' || p_partkey END AS path FROM part")
def path_bytes(spark, d):
    raw = _table(spark, d, "part").select("p_partkey", F.concat(F.lit("/t"), F.col("p_partkey").cast("string")).alias("path"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("/b"), F.col("p_partkey").cast("string")).cast("binary")).alias("path_bytes"))
    return raw.select("p_partkey", E.path_lossy(canonical.raw_path(raw)).alias("path"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '/exp/f' || c_custkey WHEN 1 THEN '/exp/f' || c_custkey WHEN 2 THEN '/f' || c_custkey ELSE '/f' || c_custkey END AS joined,
  CASE WHEN c_custkey % 5 <> 0 THEN '/d/.f' || c_custkey || '.h.' || (c_custkey % 9) || '.partial' END AS partial, CASE WHEN c_custkey % 5 = 0 THEN 'EISDIR' END AS partial_error FROM customer""")
def joined_roots(spark, d):
    k = F.col("c_custkey")
    f = F.concat(F.lit("/f"), k.cast("string"))
    root = F.element_at(F.array(*map(F.lit, ("/exp/", "exp", "/", ""))), (k % 4 + 1).cast("int"))
    partial = X.partial_path(F.when(k % 5 == 0, F.concat(F.lit("/d"), f, F.lit("/"))).otherwise(F.concat(F.lit("/d"), f)), F.lit("h"), k % 9)
    return _table(spark, d, "customer").select("c_custkey", X.join_root(root, f).alias("joined"), partial["path"].alias("partial"), partial["error"].alias("partial_error"))


@query("""SELECT s_suppkey, 'nfs://' || CASE s_suppkey % 3 WHEN 0 THEN '10.0.0.' || s_suppkey % 250 WHEN 1 THEN '[2001:db8::' || printf('%x', s_suppkey % 250 + 1) || ']' ELSE
  'nas' END || '/x' AS url FROM supplier""")
def url_addresses(spark, d):
    k = F.col("s_suppkey")
    host = F.when(k % 3 == 0, F.concat(F.lit("[::FFFF:10.0.0."), (k % 250).cast("string"), F.lit("]"))).when(k % 3 == 1, F.concat(F.lit("[2001:0DB8:0:0:0:0:0:"), F.hex(k % 250 + 1), F.lit("]"))).otherwise("NAS.")
    return _table(spark, d, "supplier").select("s_suppkey", X.url_text(X.with_address(X.url_parts(F.concat(F.lit("nfs://"), host, F.lit("/x/"))))).alias("url"))


@query("""SELECT event_id, event_id % 2 = 0 AND event_id % 3 = 0 AS option, CASE WHEN event_id % 2 = 0 AND (event_id % 3 = 0 OR event_id % 5 = 0) THEN 'SELF_TARGET' END AS self_target,
  CASE WHEN event_id % 7 = 0 THEN 'error' WHEN event_id % 4 = 1 THEN 'replay' ELSE 'conflict' END AS symlink_exists, CASE WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN
  'StoreUnreachable' WHEN event_id % 2 = 0 THEN 'Fenced' WHEN event_id % 5 = 0 THEN 'Interrupted' ELSE 'Clean' END AS outcome,
  (CASE WHEN event_id % 11 = 0 THEN 2 WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN 4 WHEN event_id % 2 = 0 THEN 3 ELSE 0 END)::INT AS code, (event_id % 60 * 250)::BIGINT AS
  wait_low, (event_id % 60 * 500)::BIGINT AS wait_high,
  CASE WHEN event_id % 5 = 0 THEN 'refuse' WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 'refuse' WHEN event_id % 3 = 0 AND event_id % 4 <> 1 THEN 'refuse' ELSE 'allow' END AS
  verdict FROM events""")
def run_decisions(spark, d):
    e = F.col("event_id")
    two, three, five = e % 2 == 0, e % 3 == 0, e % 5 == 0
    out, wait = D.run_outcome(two, three, five, e % 11 == 0), D.race_backoff(e % 60)
    links = D.link_exists(F.when(e % 7 != 0, (e % 4).cast("string")), F.lit("1"))
    seen = F.element_at(F.array(*map(F.lit, ("visible", "absent", "unknown", "visible"))), (e % 4 + 1).cast("int"))
    return _table(spark, d, "events").select(
        "event_id", D.effective(two, three).alias("option"), D.self_target(two, F.when(three, F.lit("/a")).otherwise("/b"), F.lit("/a"), F.when(five, F.lit("/p")).otherwise("/q"), F.lit("/p")).alias("self_target"),
        links.alias("symlink_exists"), out["outcome"].alias("outcome"), out["code"].alias("code"), wait["low"].alias("wait_low"), wait["high"].alias("wait_high"), D.separation(five, three, two, seen).alias("verdict"),
    )


# trees

#: Directories of customers, of their days and of some orders, and files below them.
_TREE = """SELECT CAST(2 AS INT) AS file_type, '/c' || CAST(o_custkey AS VARCHAR(20)) AS path FROM orders GROUP BY o_custkey
UNION ALL SELECT CAST(2 AS INT), '/c' || CAST(o_custkey AS VARCHAR(20)) || '/d' || CAST(o_orderkey % 10 AS VARCHAR(9)) FROM orders GROUP BY o_custkey, o_orderkey % 10
UNION ALL SELECT CAST(1 + o_orderkey % 2 AS INT), '/c' || CAST(o_custkey AS VARCHAR(20)) || '/d' || CAST(o_orderkey % 10 AS VARCHAR(9)) || '/o' || CAST(o_orderkey AS VARCHAR(20)) FROM orders"""


@query(f"""SELECT path FROM ({_TREE}) t WHERE NOT regexp_matches(split_part(path, '/', 2), '^c[^/]*7$') AND NOT regexp_matches(split_part(path, '/', 3), '^d[37]$') AND NOT
  (file_type = 2 AND regexp_matches(split_part(path, '/', 4), '^o[^/]*5$'))""")
def excluded_trees(spark, d):
    tree = spark.sql(_TREE.replace("FROM orders", "FROM {orders}"), orders=_table(spark, d, "orders"))
    return canonical.exclude_directories(tree, ["c*7", "d[37]", "o*5"]).select("path")


@query(f"SELECT row_id FROM ({INDEX}) i WHERE file_type = 2 AND inode IN (SELECT DISTINCT o_orderkey % 50 FROM orders)")
def directories_by_inode(spark, d):
    return coordination.directories_by_inode(views(spark, d, INDEX), _table(spark, d, "orders").select((F.col("o_orderkey") % 50).alias("inode"))).select("row_id")


_CHAIN = "SELECT '/a' || CAST(c_custkey AS VARCHAR(20)) AS path, c_custkey % {0} AS handle, c_custkey % 3 AS fsid, c_custkey * {1} AS fileid FROM customer"


@query(f"""WITH a AS ({_CHAIN.format(9973, 2)}), b AS ({_CHAIN.format(9967, 3)}) SELECT a.path, b.path AS r_path, 'handle' AS "by" FROM a JOIN b USING (handle) UNION ALL SELECT
  a.path, b.path, 'identity' FROM a JOIN b ON a.fsid = b.fsid AND a.fileid = b.fileid""")
def ancestor_overlap(spark, d):
    side = lambda m, k: spark.sql(_CHAIN.format(m, k).replace("FROM customer", "FROM {c}"), c=_table(spark, d, "customer"))
    return coordination.ancestor_overlap(side(9973, 2), side(9967, 3), True).select("path", "r_path", "by")


@query("SELECT DISTINCT '10.0.' || l_suppkey % 100 AS address FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT '10.0.' || l_suppkey % 100 FROM lineitem WHERE l_returnflag = 'R'")
def shared_addresses(spark, d):
    names = _table(spark, d, "lineitem").select(F.col("l_returnflag").alias("name"), F.concat(F.lit("10.0."), (F.col("l_suppkey") % 100).cast("string")).alias("address"))
    return coordination.shared_addresses(names, "A", "R")


_MISSING = f"SELECT path, hash_bucket, row_number() OVER (PARTITION BY hash_bucket ORDER BY path)::INT AS position FROM (SELECT path, k % 16 AS hash_bucket FROM ({INDEX}) i WHERE k % 9 = 0) x"


@query(_MISSING)
def missing_in_order(spark, d):
    rows = views(spark, d, INDEX).where("k % 9 = 0").select("path", (F.col("k") % 16).alias("hash_bucket"))
    return reconcile.ordered(rows, "hash_bucket")


# contents


@query("""SELECT count(*) AS entries, sum(strlen(coalesce(text, '')))::BIGINT AS bytes, count(*) FILTER (doc_id % 17 <> 0 AND doc_id % 13 <> 0 AND doc_id % 5 = 0) AS content,
  count(*) FILTER (doc_id % 17 = 0 OR doc_id % 13 = 0) AS read_error, 0::BIGINT AS symlink_target,
  CASE WHEN count(*) FILTER (doc_id % 17 = 0 OR doc_id % 13 = 0 OR doc_id % 5 = 0) = 0 THEN 'pass' ELSE 'fail' END AS status FROM documents""")
def content_counts(spark, d):
    from treediff.plans.trees import _digests

    work, src, dst = _digests(spark, d)
    out = reconcile.content_counts(work, reconcile.compare_digests(work, src, dst))
    return out.withColumn("status", reconcile.status(F.col("content") + F.col("read_error") + F.col("symlink_target"), F.lit(True)))


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'read_error' ELSE 'symlink_target' END AS kind, CASE WHEN p_partkey % 7 <> 0 THEN '/t' || p_partkey END AS expected, '/t' || p_size AS actual FROM part WHERE p_partkey % 7 = 0 OR p_partkey <> p_size")
def symlink_targets(spark, d):
    b = lambda x: F.concat(F.lit("/t"), x.cast("string")).cast("binary")
    links = _table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.when(F.col("p_partkey") % 7 != 0, b(F.col("p_partkey"))).alias("source_target"), b(F.col("p_size")).alias("dest_target"))
    return reconcile.compare_targets(links).withColumnRenamed("path", "p_partkey")


@query("SELECT '/' || doc_id AS path, strlen(coalesce(text, ''))::BIGINT AS size FROM documents WHERE doc_id % 3 <> 0")
def content_resume(spark, d):
    work = _table(spark, d, "documents").select(F.concat(F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"), "doc_id")
    return reconcile.remaining(work.drop("doc_id"), work.where("doc_id % 3 = 0"))


# transfers

_RESULTS = """SELECT o_orderkey AS row_id, o_custkey % 8 AS shard, CASE o_orderkey % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'fenced' WHEN 2 THEN 'special' ELSE 'ok' END AS outcome,
  o_orderkey % 6 = 0 AS torn, o_orderkey % 1000 AS bytes FROM orders"""
_SUMS = "count(*) FILTER (outcome = 'ok') AS files_ok, count(*) FILTER (outcome = 'failed') AS files_failed, count(*) FILTER (outcome = 'fenced') AS files_fenced, count(*) FILTER (outcome = 'special') AS special, count(*) FILTER (outcome = 'ok' AND torn) AS torn, coalesce(sum(bytes) FILTER (outcome = 'ok'), 0)::BIGINT AS bytes_ok"


def _results(spark, d):
    return spark.sql(_RESULTS.replace("FROM orders", "FROM {orders}"), orders=_table(spark, d, "orders"))


@query(f"SELECT shard, {_SUMS} FROM ({_RESULTS}) r GROUP BY shard")
def copy_outcomes(spark, d):
    return planning.outcomes(_results(spark, d), "shard")


@query(f"""WITH s AS (SELECT shard, {_SUMS} FROM ({_RESULTS}) r GROUP BY shard), t AS (SELECT count(*) AS shards_done, sum(files_ok)::BIGINT AS files_ok, sum(files_failed)::BIGINT
  AS files_failed, sum(torn)::BIGINT AS torn, sum(special)::BIGINT AS special, sum(bytes_ok)::BIGINT AS bytes_ok FROM s)
SELECT *, 'complete' AS state, 'complete: ' || shards_done || '/8 shards, ' || files_ok || ' files ok (' || torn || ' torn), ' || files_failed || ' failed' || CASE WHEN special >
  0 THEN ', ' || special || ' special NOT copied' ELSE '' END || ', ' || bytes_ok || ' bytes moved' AS line FROM t""")
def copy_summary(spark, d):
    return planning.copy_summary(planning.outcomes(_results(spark, d), "shard"), 8)


@query("""SELECT o_orderkey AS row_id, 'EARLY_EOF' AS kind FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT o_orderkey, 'TORN_COPY' FROM orders WHERE o_orderkey % 6 = 0 UNION
  ALL SELECT o_orderkey, 'SYMLINK_TIME_NFSV3' FROM orders WHERE o_orderkey % 9 = 0""")
def result_downgrades(spark, d):
    k = F.col("o_orderkey")
    at = lambda t: F.struct(k.alias("size"), F.struct(t.alias("sec"), F.lit(5).alias("nsec")).alias("mtime"), F.when(k % 3 != 0, t).alias("ctime"))
    rows = _table(spark, d, "orders").select(k.alias("row_id"), (k % 50 + 10).alias("size"), (k % 50 + F.when(k % 4 == 0, 9).otherwise(10)).alias("bytes_copied"), at(k).alias("pre"), at(F.when(k % 6 == 0, k + 1).otherwise(k)).alias("post"), (k % 9 == 0).alias("symlink_times_refused"))
    return planning.copy_downgrades(rows)


@query("""SELECT o_orderkey AS row_id, 'SIZE_CHANGED' AS kind FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 4 = 1""")
def changed_sizes(spark, d):
    k = F.col("o_orderkey")
    none = F.lit(None).cast("struct<size:bigint>")
    rows = _table(spark, d, "orders").select(k.alias("row_id"), k.alias("size"), (k + F.when(k % 4 == 0, -1).when(k % 4 == 1, 1).otherwise(0)).alias("bytes_copied"), none.alias("pre"), none.alias("post"), F.lit(False).alias("symlink_times_refused"))
    return planning.copy_downgrades(rows, unchanged_size=True)


@query(f"SELECT row_id, [0, 2, 3, 5][((row_number() OVER (PARTITION BY shard ORDER BY row_id) - 1) % 4 + 1)::INT]::INT AS slot FROM ({INDEX}) i")
def live_placement(spark, d):
    return planning.placement(views(spark, d, INDEX), 6, dead=(1, 4)).select("row_id", "slot")


@query(f"""SELECT shard, k // 1000 AS batch, min(row_id) AS row_first, max(row_id) AS row_last, count(*) AS files, sum(size)::BIGINT AS bytes, count(*) FILTER (file_type = 1) AS
  files_read, count(*) FILTER (file_type = 2) AS dirs, count(*) FILTER (k % 13 = 0) AS failures FROM ({INDEX}) i GROUP BY 1, 2""")
def batch_audit(spark, d):
    rows = views(spark, d, INDEX).withColumns({"batch": F.expr("k div 1000"), "strategy": F.when(F.col("file_type") == 1, "read").when(F.col("file_type") == 2, "dir").otherwise("other"), "failed": F.col("k") % 13 == 0})
    n = lambda k: F.coalesce(F.element_at("strategy_counts", k), F.lit(0))
    return planning.batch_audit(rows).select("shard", "batch", "row_first", "row_last", "files", "bytes", n("read").alias("files_read"), n("dir").alias("dirs"), "failures")


@query("""WITH x AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <> l_orderkey % 5)
SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) = l_linenumber AS released FROM x""")
def contiguous_chunks(spark, d):
    c = _table(spark, d, "lineitem").where("l_linenumber <> l_orderkey % 5").select("l_orderkey", "l_linenumber").distinct().select("l_orderkey", "l_linenumber", ((F.col("l_linenumber") - 1) * 100).alias("offset"), F.lit(100).alias("length"))
    return planning.contiguous_prefix(c, "l_orderkey").select("l_orderkey", "l_linenumber", "released")


@query("""SELECT DISTINCT path FROM (SELECT '/p' || l_partkey % 500 AS path FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT '/p' || l_partkey % 700 FROM lineitem WHERE
  l_linenumber = 2 AND l_quantity > 25) x""")
def pending_paths(spark, d):
    line = _table(spark, d, "lineitem")
    b64 = lambda m: F.base64(F.concat(F.lit("/p"), (F.col("l_partkey") % m).cast("string")).cast("binary")).alias("path_b64")
    failed = line.where("l_linenumber = 1").select(b64(500))
    lowered = line.where("l_linenumber = 2").select(b64(700), F.when(F.col("l_quantity") > 25, '"TORN_COPY"').otherwise('"NULL_OWNER"').alias("downgrade"))
    return tables.pending(failed, lowered).select(E.path_lossy(F.col("path")).alias("path"))


@query("SELECT count(*) AS parts, sum(o_custkey)::BIGINT AS rows, sum(CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE 0 END)::BIGINT AS rows_done FROM orders")
def rewrite_totals(spark, d):
    return coordination.report_totals(_table(spark, d, "orders").select(F.col("o_orderkey").alias("part"), F.col("o_custkey").alias("rows"), F.when(F.col("o_orderkey") % 3 == 0, "done").otherwise("to_do").alias("state")))


@query("""SELECT side, count(*) AS addresses, string_agg(a || ' x' || n, ', ' ORDER BY a) AS list FROM (SELECT side, a, count(*) AS n FROM (SELECT 'source' AS side, CASE WHEN
  s_suppkey % 5 = 0 THEN 'host name' ELSE '10.0.0.' || s_suppkey % 5 END AS a FROM supplier
  UNION ALL SELECT 'dest', '10.0.1.' || s_suppkey % 3 FROM supplier) x GROUP BY 1, 2) y GROUP BY side""")
def connection_tally(spark, d):
    k = F.col("s_suppkey")
    return coordination.connection_tally(_table(spark, d, "supplier").select(F.when(k % 5 != 0, F.concat(F.lit("10.0.0."), (k % 5).cast("string"))).alias("source"), F.concat(F.lit("10.0.1."), (k % 3).cast("string")).alias("dest")))


# workers and commands


@query(f"SELECT job, sum(files)::BIGINT AS files, sum(bytes)::BIGINT AS bytes, sum(errors)::BIGINT AS errors FROM ({LOG}) l WHERE kind = 'ProgressDelta' GROUP BY job")
def progress_by_job(spark, d):
    return events.totals(views(spark, d, LOG), "job")


@query("SELECT conv_id AS job, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT - 1 AS position, turn AS worker FROM conversations WHERE turn % 3 <> 1")
def workers_in_order(spark, d):
    c = _table(spark, d, "conversations")
    jobs_ = c.where("turn % 3 <> 1").groupBy(F.col("conv_id").alias("job")).agg(F.array_sort(F.collect_list("turn")).alias("w"))
    jobs_ = jobs_.select("job", F.concat("w", F.array(F.lit(10**9).cast("long"))).alias("assigned_workers"))  # an id that no worker has
    return coordination.workers_of(jobs_, c.select(F.col("turn").alias("worker")).distinct())


@query("SELECT user_id AS worker FROM events GROUP BY user_id HAVING user_id % 3 = 0 AND (SELECT max(epoch_us(ts)) FROM events) - max(epoch_us(ts)) >= 3600000000")
def evictable_workers(spark, d):
    seen = _table(spark, d, "events").groupBy(F.col("user_id").alias("worker")).agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("last_us"))
    now = seen.agg(F.max("last_us")).first()[0]  # a parameter of the sweep: the clock
    state = F.when(F.col("worker") % 3 == 0, "Disconnected").otherwise("Fenced")
    return coordination.evictable(seen.withColumn("state", state), F.lit(now), 3_600_000_000).select("worker")


@query("SELECT o_custkey AS job, CASE WHEN bool_and(o_orderkey % 5 <> 4) THEN CASE WHEN bool_or(o_orderkey % 5 = 3) THEN 'Failed' ELSE 'Completed' END END AS ends_as FROM orders GROUP BY 1")
def job_ends(spark, d):
    o = F.col("o_orderkey") % 5
    tallied = _table(spark, d, "orders").groupBy(F.col("o_custkey").alias("job")).agg(F.count("*").alias("total_shards"), F.count_if(o == 3).alias("failed"), F.count_if(o < 3).alias("completed"))
    return coordination.job_end(tallied.withColumn("all_terminal", F.col("failed") + F.col("completed") == F.col("total_shards"))).select("job", "ends_as")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 100 + 5 < 60")
def expired_leases(spark, d):
    return coordination.expired_leases(_table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 100).alias("expires_at")), F.lit(60)).select("o_orderkey")


_BEATS = "SELECT user_id, event_id, event_id % 4 = 0 OR event_id % 19 = 0 OR event_id % 23 = 0 AS reset, event_id % 29 = 0 AND event_id % 19 <> 0 AND event_id % 23 <> 0 AS lost_own, event_id % 31 = 0 AS clock FROM events"


@query(f"""SELECT event_id, (sum((NOT reset)::INT) OVER (PARTITION BY user_id, run ORDER BY event_id))::BIGINT AS failures, (sum((NOT reset)::INT) OVER (PARTITION BY user_id, run
  ORDER BY event_id)) >= 3 OR lost_own OR clock AS fenced
FROM (SELECT *, sum(reset::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM ({_BEATS}) b) x""")
def fenced_beats(spark, d):
    e = F.col("event_id")
    held, lost = F.when(e % 19 != 0, 1), F.when(e % 23 == 0, 2).when(e % 29 == 0, 1)
    beats = _table(spark, d, "events").select("user_id", e.alias("at"), (e % 4 == 0).alias("ok"), held.alias("held_claim"), lost.alias("lost_claim"), F.when(e % 31 == 0, 100).otherwise(10).alias("wall_s"), F.lit(0).alias("mono_s"))
    return coordination.fence_runs(beats, "user_id", F.lit(3), F.lit(60)).select(F.col("at").alias("event_id"), "failures", "fenced")


_PH = "['Planned', 'Copying', 'Paused', 'Completed', 'Failed']"


@query(f"""WITH c AS (SELECT o_orderkey AS command_id, ['pause', 'resume', 'cancel', 'drain', 'retry-failed', 'dance'][(o_orderkey % 6 + 1)::INT] AS command, CASE WHEN o_orderkey
  % 40 = 0 THEN 'a/b' ELSE 'j' || o_custkey END AS job FROM orders),
  j AS (SELECT 'j' || c_custkey AS job, {_PH}[(c_custkey % 5 + 1)::INT] AS phase FROM customer WHERE c_custkey % 11 <> 0),
  x AS (SELECT command_id, command, CASE WHEN command = 'dance' THEN 'unknown_command' WHEN contains(c.job, '/') THEN 'invalid_job_id' WHEN j.job IS NULL THEN 'job_not_found'
    WHEN NOT CASE command WHEN 'retry-failed' THEN TRUE WHEN 'resume' THEN phase = 'Paused' WHEN 'cancel' THEN phase NOT IN ('Completed', 'Failed') ELSE phase IN ('Planned',
  'Copying') END THEN 'invalid_phase' END AS error FROM c LEFT JOIN j USING (job))
SELECT *, CASE WHEN error IS NULL THEN CASE command WHEN 'pause' THEN 'JobPaused' WHEN 'drain' THEN 'JobPaused' WHEN 'resume' THEN 'JobResumed' WHEN 'cancel' THEN 'JobCancelled'
  END END AS event FROM x""")
def command_results(spark, d):
    order = F.array(*map(F.lit, ("pause", "resume", "cancel", "drain", "retry-failed", "dance")))
    k = F.col("o_orderkey")
    asked = _table(spark, d, "orders").select(k.alias("command_id"), F.element_at(order, (k % 6 + 1).cast("int")).alias("command"), F.when(k % 40 == 0, "a/b").otherwise(F.concat(F.lit("j"), F.col("o_custkey").cast("string"))).alias("job"))
    phases = F.array(*map(F.lit, ("Planned", "Copying", "Paused", "Completed", "Failed")))
    have = _table(spark, d, "customer").where("c_custkey % 11 <> 0").select(F.concat(F.lit("j"), F.col("c_custkey").cast("string")).alias("job"), F.element_at(phases, (F.col("c_custkey") % 5 + 1).cast("int")).alias("phase"))
    return coordination.decide_commands(asked, have).select("command_id", "command", "error", "event")


@query("""SELECT o_orderkey, 'audit/' || strftime(o_orderdate, '%Y-%m-%d') || '/' || lpad((row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m-%d') ORDER BY o_orderdate,
  o_orderkey) + coalesce(t.top, 0))::VARCHAR, 20, '0') || '.jsonl' AS key
FROM orders LEFT JOIN (SELECT strftime(o_orderdate, '%Y-%m-%d') AS d, max(o_orderkey % 7) AS top FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) t ON t.d = strftime(o_orderdate, '%Y-%m-%d')""")
def audit_rows(spark, d):
    o = _table(spark, d, "orders")
    taken = o.where("o_orderkey % 2 = 0").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), (F.col("o_orderkey") % 7).alias("seq"))
    return coordination.audit_keys(o.select("o_orderkey", F.col("o_orderdate").alias("at")), taken, tie="o_orderkey").select("o_orderkey", "key")


@query(f"SELECT DISTINCT 'j' || c_custkey AS job FROM customer WHERE c_custkey % 5 >= 3 AND c_custkey % 4 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def archivable_jobs(spark, d):
    phases = F.array(*map(F.lit, ("Planned", "Copying", "Paused", "Completed", "Failed")))
    name = lambda c: F.concat(F.lit("j"), F.col(c).cast("string")).alias("job")
    have = _table(spark, d, "customer").select(name("c_custkey"), F.element_at(phases, (F.col("c_custkey") % 5 + 1).cast("int")).alias("phase"), "c_custkey")
    return coordination.archivable(have, have.where("c_custkey % 4 <> 0"), _table(spark, d, "orders").where("o_orderkey % 3 = 0").select(name("o_custkey"))).select("job")


# logs


@query(jobs.SQL["phase_fold"])
def replayed_jobs(spark, d):
    """A snapshot in the middle of the log and all events behind and before it give the whole fold."""
    log = views(spark, d, LOG)
    out = events.replay(events.snapshot_jobs(log.where("seq <= 400")), log)
    return out.withColumn("assigned_workers", F.array_join("assigned_workers", ","))


@query(jobs.FOLD + """, s AS (SELECT job, "at" - "at" % 3600000000 AS tick_us, phase, fd, bd, n FROM g WHERE n > 0),
  e AS (SELECT job, tick_us, arg_max(phase, n) AS phase, arg_max(fd, n) AS files_done, arg_max(bd, n) AS bytes_done FROM s GROUP BY 1, 2),
  a AS (SELECT *, lag(files_done) OVER w AS pf, lag(bytes_done) OVER w AS pb FROM e WHERE phase IN ('Planned', 'Scanning', 'Copying', 'Verifying', 'Cutover') WINDOW w AS
  (PARTITION BY job ORDER BY tick_us))
SELECT job, tick_us, files_done, bytes_done FROM a WHERE pf IS DISTINCT FROM files_done OR pb IS DISTINCT FROM bytes_done""")
def progress_syncs(spark, d):
    return events.progress_syncs(views(spark, d, LOG), 3_600_000_000)


@query(f"""WITH RECURSIVE r AS (SELECT job, class, seq, at_us, row_number() OVER (PARTITION BY job ORDER BY seq) AS n FROM ({LOG}) l WHERE kind = 'ErrorEmitted'),
  g AS (SELECT job, n, at_us AS start FROM r WHERE n = 1 UNION ALL SELECT r.job, r.n, CASE WHEN at_us - start >= 3600000000 THEN at_us ELSE start END FROM g JOIN r ON r.job = g.job AND r.n = g.n + 1)
SELECT job, class, seq, start AS window_us, row_number() OVER (PARTITION BY job, start, class ORDER BY seq) <= 2 AS shown FROM g JOIN r USING (job, n)""")
def shown_errors(spark, d):
    return events.error_cap(views(spark, d, LOG), 2, 3_600_000_000)


@query(f"SELECT job, sum(files)::BIGINT AS files, sum(bytes)::BIGINT AS bytes FROM ({LOG}) l WHERE kind = 'ProgressDelta' GROUP BY job")
def capped_totals(spark, d):
    """What leading and trailing frames add up to is what came in."""
    return events.capped_progress(views(spark, d, LOG), 3_600_000_000).groupBy("job").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))


@query(f"SELECT seq, kind, worker FROM ({LOG}) l WHERE seq > 100")
def merged_log(spark, d):
    log = views(spark, d, LOG).select("seq", "kind", "worker")
    return events.merge(log.where("seq > 100 and seq <= 600"), log.where("seq > 500 and seq <= 900"), log.where("seq > 850"))


_HIST = f"(SELECT side, at_us - at_us % 30000000 AS window_us, {jobs._BUCKET} AS bucket, count(*) AS n, sum(duration_us)::BIGINT AS sum_us, max(duration_us) AS max_us FROM ({SAMPLES}) s GROUP BY 1, 2, 3)"
_Q = lambda q: f"(SELECT CASE WHEN b = 99 THEN greatest(t.max_us, {jobs._UP}) ELSE least({jobs._UP}, greatest(t.max_us, 1)) END FROM (SELECT min(bucket)::BIGINT AS b FROM c WHERE c.side = t.side AND c.window_us = t.window_us AND cum >= greatest(1, ceil(t.n * {q}))) x)::BIGINT"


@query(f"""WITH h AS (SELECT * FROM {_HIST} h), c AS (SELECT *, sum(n) OVER (PARTITION BY side, window_us ORDER BY bucket) AS cum FROM h), t AS (SELECT side, window_us,
  sum(n)::BIGINT AS n, sum(sum_us)::BIGINT AS sum_us, max(max_us) AS max_us FROM h GROUP BY 1, 2)
SELECT *, sum_us // n AS mean_us, {_Q(0.5)} AS p50_us, {_Q(0.95)} AS p95_us, {_Q(0.99)} AS p99_us FROM t""")
def latency_windows(spark, d):
    return telemetry.window_quantiles(views(spark, d, SAMPLES), ["side"])
