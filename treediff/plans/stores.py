"""Queries over footers, work lists, reads, keep lists and attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from treediff.functions import entries as E
from treediff.operators import coordination, frontier, planning
from treediff.plans.proxies import INDEX, duck, views
from treediff.sources import footers, keep

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = duck(sql)
        return f

    return add


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query("\nUNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows, (SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}') AS columns FROM {t}" for t in _TABLES))
def footer_rows(spark, d):
    """Rows and columns of the tables by their footers, without a scan."""
    found = footers.read_footers(spark, d).withColumn("name", F.regexp_extract("path", r"/(\w+)\.parquet(/[^/]*)?$", 1)).where(F.col("name").isin(*_TABLES))
    return found.groupBy("name").agg(F.sum("rows").alias("rows"), F.max(F.size("columns")).cast("long").alias("columns"))


@query("\nUNION ALL ".join(f"SELECT '{t}' AS name, '{s}' AS severity, '{w}' AS why FROM (SELECT 1)" for t in ("orders", "part") for s, w in [*(("error", f"column missing: {c}") for c in ("row_id", "path", "size", "mode", "file_type")), ("warning", "no format version")]))
def footer_findings(spark, d):
    """What a reader of indexes says of two tables that are none."""
    found = footers.read_footers(spark, d).where(F.col("path").rlike(r"/(orders|part)\.parquet"))
    return footers.footer_findings(found).select(F.regexp_extract("path", r"/(\w+)\.parquet", 1).alias("name"), "severity", "why").distinct()


#: Reads of orders' files: a line is one read; some come twice, short, or find the end.
_READS = """SELECT l_orderkey AS file, (l_linenumber - 1) * 100 AS "offset", 100 AS wanted, CASE WHEN l_partkey % 11 = 0 THEN 0 WHEN l_partkey % 5 = 0 THEN 60 ELSE 100 END AS
  length FROM lineitem WHERE l_suppkey % 7 <> 0
UNION ALL SELECT l_orderkey, (l_linenumber - 1) * 100 + 20, 50, 50 FROM lineitem WHERE l_suppkey % 5 = 0"""
_SIZES = "SELECT o_orderkey AS file, 100 * (1 + o_custkey % 7) AS size FROM orders"
_HELD = f"""ends AS (SELECT s.file, least(s.size, coalesce(r.short, s.size)) AS e FROM ({_SIZES}) s LEFT JOIN (SELECT file, min("offset") AS short FROM ({_READS}) x WHERE length =
  0 GROUP BY file) r USING (file)),
one AS (SELECT file, "offset" AS o, max(length) AS n FROM ({_READS}) x WHERE length > 0 GROUP BY file, "offset"),
held AS (SELECT file, o, n, coalesce(max(o + n) OVER (PARTITION BY file ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM one),
inside AS (SELECT h.*, e FROM held h JOIN ends USING (file) WHERE o < e),
gaps AS (SELECT file, before AS "offset", o - before AS length FROM inside WHERE o > before
  UNION ALL SELECT file, coalesce(t, 0), e - coalesce(t, 0) FROM ends LEFT JOIN (SELECT file, max(o + n) AS t FROM inside GROUP BY file) i USING (file) WHERE coalesce(t, 0) < e)"""


def _reads(spark, d):
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    reads = spark.sql(_READS.replace('"offset"', "`offset`").replace("FROM lineitem", "FROM {line}"), line=line)
    sizes = spark.sql(_SIZES.replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{d}/orders.parquet"))
    return reads.select("file", F.col("offset").cast("long"), "wanted", F.col("length").cast("long")), sizes.select("file", F.col("size").cast("long"))


@query(f'WITH {_HELD} SELECT file, "offset", length FROM gaps')
def read_gaps(spark, d):
    return planning.gaps(*_reads(spark, d))


@query(f"""WITH {_HELD}, first AS (SELECT file, min("offset") AS hole FROM gaps GROUP BY file),
s AS (SELECT i.file, max(CASE WHEN hole IS NULL OR o < hole THEN o + n END) AS delivered, sum(CASE WHEN o >= hole THEN greatest(0, o + n - greatest(o, before)) END) AS buffered
  FROM inside i LEFT JOIN first USING (file) GROUP BY i.file)
SELECT e.file, e.e AS "end", coalesce(delivered, 0) AS delivered, coalesce(buffered, 0)::BIGINT AS buffered, hole IS NULL AS drained FROM ends e LEFT JOIN s USING (file) LEFT JOIN
  first USING (file)""")
def read_progress(spark, d):
    return planning.delivered(*_reads(spark, d))


_DONE = "SELECT o_orderkey AS idx FROM orders WHERE o_custkey % 9 <> 4 AND (o_orderkey < 8000 OR o_orderkey % 3 = 0)"
_RUNS = f"SELECT min(idx) AS start, max(idx) + 1 AS e FROM (SELECT idx, idx - row_number() OVER (ORDER BY idx) AS g FROM (SELECT DISTINCT idx FROM ({_DONE}) d) x) y GROUP BY g"


def _done(spark, d):
    return spark.sql(_DONE.replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{d}/orders.parquet"))


@query(f'SELECT start, e AS "end" FROM ({_RUNS}) r')
def work_runs(spark, d):
    return frontier.runs(_done(spark, d), 1024)


@query(f"""SELECT sum(e - start)::BIGINT AS done, coalesce(max(CASE WHEN start = 0 THEN e END), 0) AS frontier, max(e) AS issued, (max(e) - sum(e - start))::BIGINT AS unfinished FROM ({_RUNS}) r""")
def work_frontier(spark, d):
    return frontier.frontier(_done(spark, d), 1024)


@query(f'SELECT * FROM (SELECT coalesce(lag(e) OVER (ORDER BY start), 0) AS start, start AS "end" FROM ({_RUNS}) r) x WHERE start < "end"')
def work_unfinished(spark, d):
    return frontier.unfinished(_done(spark, d), 1024)


@query(f"SELECT row_id, path, size FROM ({INDEX}) i WHERE row_id % 1099511627776 < 5000 AND row_id % 10 <> 3 OR row_id % 977 = 0")
def kept_delta(spark, d):
    index = views(spark, d, INDEX)
    ids = index.where("row_id % 1099511627776 < 5000 AND row_id % 10 <> 3 OR row_id % 977 = 0").select("row_id")
    return keep.delta(index, keep.ranges(ids)).select("row_id", "path", "size")


#: Attributes of parts packed as length and bytes; some torn.
@query("""SELECT p_partkey, p_partkey % 4 = 0 AS bad, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 1 END + 1 AS attrs, 'user.brand' AS name, p_brand AS value,
  CASE WHEN p_partkey % 4 = 0 THEN 'value beyond the end at byte ' || (18 + length(p_brand)) END AS error FROM part""")
def attribute_blobs(spark, d):
    packed = lambda c: F.concat(F.unhex(F.lpad(F.hex(F.octet_length(c)), 8, "0")), F.encode(c, "UTF-8"))
    rows = spark.read.parquet(f"{d}/part.parquet")
    blob = F.concat(packed(F.lit("user.brand")), packed(F.col("p_brand")), packed(F.lit("user.type")), packed(F.col("p_type")))
    cut = F.expr("substring(blob, 1, octet_length(blob) - 1)")
    rows = rows.withColumn("blob", blob).withColumn("x", E.attributes(F.when(F.col("p_partkey") % 4 == 0, cut).otherwise(F.col("blob"))))
    first = F.element_at("x.attrs", 1)
    return rows.select("p_partkey", F.col("x.error").isNotNull().alias("bad"), F.size("x.attrs").alias("attrs"), F.decode(first["name"], "UTF-8").alias("name"), F.decode(first["value"], "UTF-8").alias("value"), F.col("x.error").alias("error"))



_CLAIMS = """SELECT 'j' || (l_suppkey % 40) AS job, l_orderkey AS shard, CASE WHEN l_suppkey % 40 = 3 AND l_partkey % 50 = 0 THEN 'failed' WHEN l_suppkey % 40 < 20 OR l_partkey %
  3 > 0 THEN 'completed' ELSE 'active' END AS state, l_linenumber AS epoch
  FROM lineitem WHERE l_suppkey % 40 < 38"""
_SHARDS = "SELECT 'j' || (l_suppkey % 40) AS job, l_orderkey AS shard, sum(l_linenumber) AS rows, sum(l_partkey) AS bytes FROM lineitem GROUP BY l_suppkey % 40, l_orderkey"
_JOBS = "SELECT 'j' || s_suppkey AS job, CASE s_suppkey % 5 WHEN 0 THEN 'Completed' WHEN 1 THEN 'Paused' ELSE 'Copying' END AS phase, s_suppkey * 97 AS files_done, s_suppkey * 10 AS bytes_done FROM supplier WHERE s_suppkey < 40"


def _of(spark, d, sql, *names):
    for n in names:
        sql = sql.replace(f"FROM {n}", "FROM {" + n + "}")
    return spark.sql(sql, **{n: spark.read.parquet(f"{d}/{n}.parquet") for n in names})


@query(f"""WITH c AS (SELECT job, shard, max(row(epoch, state))[2] AS state FROM ({_CLAIMS}) x GROUP BY job, shard),
t AS (SELECT job, count(*) AS n, count(*) FILTER (state = 'completed') AS done, count(*) FILTER (state = 'failed') AS failed, coalesce(sum(rows) FILTER (state = 'completed'),
  0)::BIGINT AS r, coalesce(sum(bytes) FILTER (state = 'completed'), 0)::BIGINT AS b FROM ({_SHARDS}) s LEFT JOIN c USING (job, shard) GROUP BY job),
x AS (SELECT * FROM ({_JOBS}) j JOIN t USING (job) WHERE phase <> 'Completed')
SELECT job, 'ProgressSync' AS kind, greatest(r, files_done) AS files, greatest(b, bytes_done) AS bytes, NULL AS reason FROM x WHERE r > files_done OR b > bytes_done
UNION ALL SELECT job, CASE WHEN failed = 0 THEN 'JobCompleted' ELSE 'JobFailed' END, NULL, NULL, CASE WHEN failed > 0 THEN failed || ' of ' || n || ' shards failed' END FROM x
  WHERE done + failed = n""")
def reconciled_jobs(spark, d):
    return coordination.reconcile_jobs(_of(spark, d, _JOBS, "supplier"), _of(spark, d, _SHARDS, "lineitem"), _of(spark, d, _CLAIMS, "lineitem"))


_WANTED = "SELECT l_orderkey AS shard, 'h' || l_suppkey AS host, l_linenumber % 3 AS at, CASE WHEN l_partkey % 4 > 0 THEN 't' || (l_orderkey % 5) END AS observed_tag FROM lineitem"
_HELD_CLAIMS = "SELECT o_orderkey AS shard, CASE o_custkey % 6 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'active' END AS state, o_custkey % 9 AS epoch, 't' || (o_orderkey % 5) AS claim_tag, o_custkey % 4 > 0 AS stale FROM orders WHERE o_orderkey % 3 > 0"


@query(f"""WITH x AS (SELECT w.*, h.state, h.epoch, h.stale, h.shard IS NULL AS free, h.shard IS NULL OR (h.state = 'active' AND h.stale AND w.observed_tag IS NOT DISTINCT FROM h.claim_tag) AS fits
  FROM ({_WANTED}) w LEFT JOIN ({_HELD_CLAIMS}) h ON w.shard = h.shard),
y AS (SELECT *, fits AND row_number() OVER (PARTITION BY shard, fits ORDER BY "at", host, observed_tag NULLS FIRST) = 1 AS f FROM x)
SELECT shard, host, "at", observed_tag, CASE WHEN free AND f THEN 'acquired' WHEN free THEN 'contended' WHEN state <> 'active' THEN 'over: ' || state WHEN f THEN 'won' WHEN stale
  THEN 'lost_race' ELSE 'contended' END AS outcome,
  CASE WHEN f THEN coalesce(epoch, 0) + 1 END AS new_epoch FROM y""")
def decided_claims(spark, d):
    return coordination.decide_claims(_of(spark, d, _WANTED, "lineitem"), _of(spark, d, _HELD_CLAIMS, "orders"))


_PAIRS = """SELECT c_custkey AS pair, c_custkey % 11 = 0 AS identity_overlap, c_custkey % 5 = 0 AS handle_overlap, c_custkey % 3 > 0 AS same_server, CASE c_custkey % 4 WHEN 0 THEN
  'visible' WHEN 1 THEN 'unknown' ELSE 'absent' END AS probe,
  CASE WHEN c_custkey % 7 > 0 THEN c_custkey % 600 END AS fileid, CASE WHEN c_custkey % 13 > 0 THEN c_custkey % 3 END AS fsid FROM customer"""


@query(f"""WITH p AS (SELECT *, identity_overlap OR (handle_overlap AND (same_server OR probe <> 'absent')) AS bad FROM ({_PAIRS}) x),
f AS (SELECT pair, min(i.path) AS found FROM p JOIN ({INDEX}) i ON i.file_type = 2 AND i.inode = p.fileid AND coalesce(i.fsid = p.fsid, TRUE) WHERE NOT bad AND same_server GROUP BY pair)
SELECT p.pair, CASE WHEN bad OR found IS NOT NULL THEN 'refuse' ELSE 'allow' END AS verdict, found,
  CASE WHEN identity_overlap THEN 'one directory by identity' WHEN handle_overlap AND same_server THEN 'one directory by handle' WHEN bad THEN 'equal handles, probe ' || probe
  WHEN found IS NOT NULL THEN 'the destination''s root lies in the source' END AS reason
FROM p LEFT JOIN f USING (pair)""")
def proven_separation(spark, d):
    pairs = _of(spark, d, _PAIRS, "customer")
    return coordination.prove_separation(pairs, views(spark, d, INDEX)).select("pair", "verdict", "found", "reason")
