"""Queries over names, events, latencies, shards and workers."""

from __future__ import annotations

from pyspark.sql import functions as F

from treediff.functions import decisions as D
from treediff.functions import texts as X
from treediff.operators import coordination, events, telemetry
from treediff.plans.proxies import LOG, SAMPLES, duck, views

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


_URL = "'nfs://' || CASE WHEN page_id % 2 = 0 THEN 'NAS' ELSE 'nas.' END || CAST(page_id % 5 AS VARCHAR(9)) || CASE page_id % 3 WHEN 0 THEN ':2049' WHEN 1 THEN ':3000' ELSE '' END || '//export///p' || CAST(page_id AS VARCHAR(9)) || '/' || CASE WHEN page_id % 4 = 0 THEN '?b=2&a=1&b=2' ELSE '' END"


@query("""SELECT page_id, 'nfs://' || CASE WHEN page_id % 2 = 0 THEN 'nas' ELSE 'nas.' END || page_id % 5 || CASE page_id % 3 WHEN 1 THEN ':3000' ELSE '' END || '/export/p' ||
  page_id || CASE WHEN page_id % 4 = 0 THEN '?a=1&b=2' ELSE '' END AS url FROM pages""")
def url_canonical(spark, d):
    return _table(spark, d, "pages").select("page_id", X.url_text(X.url_parts(F.expr(_URL))).alias("url"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Same' WHEN 1 THEN 'DestInsideSource' WHEN 2 THEN 'SourceInsideDest' ELSE 'Disjoint' END AS relation, CASE c_custkey % 4
  WHEN 0 THEN 'identical' WHEN 1 THEN 'source_prefix' WHEN 2 THEN 'dest_prefix' END AS overlap FROM customer""")
def path_relation(spark, d):
    key = F.col("c_custkey").cast("string")
    a = F.concat(F.lit("/a/"), key)
    k = F.col("c_custkey") % 4
    s = F.when(k == 2, F.concat(a, F.lit("/x"))).when(k == 3, F.concat(a, F.lit("y"))).otherwise(a)
    t = F.when(k == 1, F.concat(a, F.lit("/x"))).otherwise(a)
    return _table(spark, d, "customer").select("c_custkey", X.relate_paths(s, t).alias("relation"), X.roots_overlap(s, t).alias("overlap"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size::BIGINT * 1024 WHEN 1 THEN p_size::BIGINT * 1000000 WHEN 2 THEN p_size::BIGINT * 1073741824 END AS bytes,
  CASE WHEN u >= 1000000 THEN printf('%.1f', u / 1e6) || 's' WHEN u >= 10000 THEN (u // 1000) || 'ms' WHEN u >= 1000 THEN printf('%.1f', u / 1000.0) || 'ms' ELSE u || 'µs' END AS
  took FROM (SELECT *, p_partkey * p_size * 13 AS u FROM part) p""")
def sizes_and_durations(spark, d):
    unit = F.element_at(F.array(*map(F.lit, (" KiB", "MB", " GiB", " parsecs"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return _table(spark, d, "part").select("p_partkey", X.parse_size(F.concat(F.col("p_size").cast("string"), unit)).alias("bytes"), X.duration_text(F.col("p_partkey") * F.col("p_size") * 13).alias("took"))


_PHASES = [(a, b, events.allowed(a, b)) for a in D.PHASES for b in D.PHASES]


@query("SELECT o_orderkey, f AS old, t AS new, CASE WHEN f IN ('Completed', 'Failed', 'Cancelled') OR f = t THEN FALSE WHEN t IN ('Completed', 'Failed', 'Cancelled') THEN TRUE WHEN t = 'Paused' THEN TRUE WHEN f = 'Paused' THEN TRUE ELSE list_position(p, f) < list_position(p, t) END AS allowed, CASE WHEN t = 'Paused' THEN 'pause' WHEN t IN ('Completed', 'Failed', 'Cancelled') THEN 'cancel' ELSE 'run' END AS mode FROM (SELECT o_orderkey, p, p[o_orderkey % 9 + 1] AS f, p[o_orderkey // 9 % 9 + 1] AS t FROM (SELECT o_orderkey, ['Planned', 'Scanning', 'Copying', 'Verifying', 'Cutover', 'Paused', 'Completed', 'Failed', 'Cancelled'] AS p FROM orders) a) b")
def phase_rules(spark, d):
    names = F.array(*map(F.lit, D.PHASES))
    rows = _table(spark, d, "orders").select("o_orderkey", F.element_at(names, F.expr("cast(o_orderkey % 9 + 1 as int)")).alias("old"), F.element_at(names, F.expr("cast((o_orderkey div 9) % 9 + 1 as int)")).alias("new"))
    return rows.withColumns({"allowed": D.transition_allowed(F.col("old"), F.col("new")), "mode": D.control_mode(F.col("new"))})


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 AND (event_id % 5 <> 0 OR event_id % 2 = 0) THEN 'Fatal' ELSE 'WorkerLocal' END AS scope, greatest(1, (event_id % 600) //
  greatest(1, user_id % 40))::BIGINT AS retries, least(30, CASE WHEN event_id % 9 >= 5 THEN 30 ELSE 1 << (event_id % 9)::INT END)::BIGINT AS backoff,
  CASE WHEN event_id % 4 = 0 THEN 'error' WHEN event_id % 6 = 1 THEN 'replay' ELSE 'conflict' END AS exists_as, CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 130 WHEN
  3 THEN 143 ELSE 1 END AS code FROM events""")
def decision_codes(spark, d):
    e = F.col("event_id")
    outcome = F.element_at(F.array(*map(F.lit, ("success", "completed_with_failures", "sigint", "sigterm", "fatal"))), (e % 5 + 1).cast("int"))
    return _table(spark, d, "events").select(
        "event_id", D.error_scope(e % 3 == 0, F.when(e % 5 == 0, "NFS: Command Timed Out").otherwise("stale handle"), e % 2 == 0).alias("scope"), D.retry_budget(e % 600, F.col("user_id") % 40).alias("retries"), D.backoff_seconds(e % 9).alias("backoff"),
        D.link_exists(F.when(e % 4 != 0, e % 6), F.lit(1)).alias("exists_as"), D.exit_code(outcome).alias("code"),
    )


@query("SELECT c_custkey, 'log/job/' || lpad(c_custkey::VARCHAR, 20, '0') || '.jsonl' AS key, c_custkey AS seq, CASE c_custkey % 4 WHEN 0 THEN 'empty' WHEN 1 THEN 'slash' WHEN 2 THEN 'reserved' END AS job_error, 'node' || c_custkey % 7 AS machine FROM customer")
def keys_and_ids(spark, d):
    c = F.col("c_custkey")
    key = X.seq_key("log/job/", c)
    job = F.when(c % 4 == 0, "").when(c % 4 == 1, "a/b").when(c % 4 == 2, "_cluster").otherwise("job")
    return _table(spark, d, "customer").select("c_custkey", key.alias("key"), X.key_seq(key).alias("seq"), X.job_id_error(job).alias("job_error"), X.machine_name(F.concat(F.lit("node"), (c % 7).cast("string"), F.lit("-"), c.cast("string")), c).alias("machine"))


_BUCKET = "CASE WHEN duration_us < 1 THEN 0 WHEN duration_us >= 16777216 THEN 99 ELSE (length(bin(duration_us)) - 1) * 4 + (CASE WHEN length(bin(duration_us)) >= 3 THEN (duration_us >> (length(bin(duration_us)) - 3)) ELSE (duration_us << (3 - length(bin(duration_us)))) END & 3) END::INT"
_HIST = f"(SELECT side, op, {_BUCKET} AS bucket, count(*) AS n, sum(duration_us)::BIGINT AS sum_us, max(duration_us) AS max_us FROM ({SAMPLES}) s GROUP BY 1, 2, 3)"


@query(f"SELECT * FROM {_HIST} h")
def latency_hist(spark, d):
    return telemetry.histogram(views(spark, d, SAMPLES), ["side", "op"])


_UP = "(CASE WHEN b = 99 THEN 16777216 WHEN b >= 8 THEN (1 << (b // 4)) + ((b % 4) + 1) * (1 << (b // 4 - 2)) - 1 ELSE (1 << (b // 4 + 1)) - 1 END)"
_Q = lambda q: f"(SELECT CASE WHEN b = 99 THEN greatest(t.max_us, {_UP}) ELSE least({_UP}, greatest(t.max_us, 1)) END FROM (SELECT min(bucket)::BIGINT AS b FROM c WHERE c.side = t.side AND c.op = t.op AND cum >= greatest(1, ceil(t.n * {q}))) x)::BIGINT"


@query(f"""WITH h AS (SELECT * FROM {_HIST} h), c AS (SELECT *, sum(n) OVER (PARTITION BY side, op ORDER BY bucket) AS cum FROM h), t AS (SELECT side, op, sum(n)::BIGINT AS n,
  sum(sum_us)::BIGINT AS sum_us, max(max_us) AS max_us FROM h GROUP BY 1, 2)
SELECT *, sum_us // n AS mean_us, {_Q(0.5)} AS p50_us, {_Q(0.95)} AS p95_us, {_Q(0.99)} AS p99_us FROM t""")
def latency_quantiles(spark, d):
    return telemetry.quantiles(telemetry.histogram(views(spark, d, SAMPLES), ["side", "op"]), ["side", "op"])


@query(f"SELECT side, sum(duration_us)::BIGINT AS busy_us, sum(duration_us) * 100.0::DOUBLE / (8 * 60000000.0::DOUBLE) AS busy_pct FROM ({SAMPLES}) s GROUP BY side")
def busy_share(spark, d):
    return telemetry.busy_share(views(spark, d, SAMPLES), 60_000_000, 8)


_CUM = f"(SELECT user_id, event_id, at_us, sum(duration_us) OVER (PARTITION BY user_id ORDER BY at_us, event_id)::BIGINT AS bytes FROM ({SAMPLES}) s)"


@query(f"""WITH c AS (SELECT user_id, at_us, max(bytes) AS bytes FROM {_CUM} c GROUP BY 1, 2), w AS (SELECT *, min(at_us) OVER r AS f_us, min(bytes) OVER r AS f_b, count(*) OVER r
  AS in_window FROM c WINDOW r AS (PARTITION BY user_id ORDER BY at_us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW))
SELECT user_id, at_us, in_window, CASE WHEN in_window >= 2 AND at_us > f_us THEN (bytes - f_b) / ((at_us - f_us) / 1e6::DOUBLE) / 1048576.0::DOUBLE ELSE 0.0::DOUBLE END AS mib_s FROM w""")
def rolling_throughput(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("at_us", "event_id")
    grown = views(spark, d, SAMPLES).withColumn("bytes", F.sum("duration_us").over(w)).groupBy("user_id", "at_us").agg(F.max("bytes").alias("bytes"))
    return telemetry.rolling_throughput(grown, ["user_id"], 3600, ts="at_us").select("user_id", "at_us", "in_window", "mib_s")


@query(f"SELECT user_id, at_us - at_us % 60000000 AS window_us, count(*) AS n, sum(duration_us)::BIGINT AS bytes FROM ({SAMPLES}) s GROUP BY 1, 2")
def tumbling_progress(spark, d):
    return telemetry.tumbling(views(spark, d, SAMPLES), ["user_id"], 60_000_000, {"bytes": "duration_us"}, ts="at_us")


@query(f"SELECT worker, seq, greatest(bytes - coalesce(lag(bytes) OVER (PARTITION BY worker ORDER BY seq), 0), 0)::BIGINT AS bytes FROM ({LOG}) l")
def counter_steps(spark, d):
    return telemetry.counter_steps(views(spark, d, LOG), ["worker"], "seq", ["bytes"])


_CAP = 2


@query(f"""WITH e AS (SELECT * FROM ({LOG}) l WHERE kind = 'ErrorEmitted'), f AS (SELECT job, class, min(seq) AS s FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER
  (PARTITION BY job ORDER BY s) AS k FROM f)
SELECT e.job, CASE WHEN k <= {_CAP} THEN e.class ELSE '(overflow)' END AS class, count(*) AS n, arg_min(at_us, seq) AS first_us, arg_max(at_us, seq) AS last_us, arg_max(retryable,
  seq) AS retryable FROM e JOIN r USING (job, class) GROUP BY 1, 2""")
def error_buckets(spark, d):
    return events.error_buckets(views(spark, d, LOG), _CAP)


@query(f"""WITH RECURSIVE e AS (SELECT * FROM ({LOG}) l WHERE kind = 'ErrorEmitted'), f AS (SELECT job, class, min(seq) AS s FROM e GROUP BY 1, 2),
  c AS (SELECT job, class, CASE WHEN row_number() OVER (PARTITION BY job ORDER BY s) <= {_CAP} THEN class ELSE '(overflow)' END AS counted FROM f),
  r AS (SELECT job, counted, path, row_number() OVER (PARTITION BY job, counted ORDER BY seq) AS n FROM e JOIN c USING (job, class)),
  g AS (SELECT job, counted, n, [path] AS held FROM r WHERE n = 1
    UNION ALL SELECT r.job, r.counted, r.n, CASE WHEN list_contains(held, path) THEN held ELSE list_append(held, path)[-10:] END FROM g JOIN r ON r.job = g.job AND r.counted =
  g.counted AND r.n = g.n + 1)
SELECT job, counted AS class, array_to_string(arg_max(held, n), ',') AS samples FROM g GROUP BY 1, 2""")
def error_samples(spark, d):
    return events.error_samples(views(spark, d, LOG), classes=_CAP).withColumn("samples", F.array_join("samples", ","))


@query(f"SELECT worker, sum(files)::BIGINT AS files, sum(bytes)::BIGINT AS bytes, sum(errors)::BIGINT AS errors FROM ({LOG}) l WHERE kind = 'ProgressDelta' GROUP BY worker")
def progress_by_worker(spark, d):
    return events.totals(views(spark, d, LOG), "worker")


@query(f"SELECT coalesce(from_worker, worker) AS worker, max(client_seq) AS client_seq FROM ({LOG}) l WHERE client_seq IS NOT NULL GROUP BY 1")
def client_marks(spark, d):
    return events.client_marks(views(spark, d, LOG))


@query(f"""WITH m AS (SELECT coalesce(from_worker, worker) AS w, max(client_seq) AS mark FROM ({LOG}) l WHERE client_seq IS NOT NULL AND seq <= 500 GROUP BY 1)
SELECT seq FROM ({LOG}) l LEFT JOIN m ON coalesce(from_worker, worker) = w WHERE seq > 500 AND (client_seq IS NULL OR mark IS NULL OR client_seq > mark)""")
def unseen_events(spark, d):
    log = views(spark, d, LOG)
    return events.unseen(log.where("seq > 500"), events.client_marks(log.where("seq <= 500"))).select("seq")


@query(f"""WITH b AS (SELECT seq // 10 AS batch, seq AS position, kind, worker, 'w' || substr(worker, 2) AS caller, client_seq FROM ({LOG}) l WHERE client_seq IS NOT NULL),
x AS (SELECT *, CASE WHEN kind NOT IN ('ProgressDelta', 'ErrorEmitted', 'WorkerFenced', 'WorkerLeft', 'JobCreated') THEN 'kind' WHEN client_seq <= lag(client_seq) OVER (PARTITION
  BY batch ORDER BY position) THEN 'order' END AS why FROM b)
SELECT batch, arg_min(why, position) AS why FROM x WHERE why IS NOT NULL GROUP BY batch""")
def rejected_batches(spark, d):
    rows = views(spark, d, LOG).where("client_seq is not null").select(F.expr("seq div 10").alias("batch"), F.col("seq").alias("position"), "kind", "worker", F.col("worker").alias("caller"), "client_seq")
    return events.rejected_batches(rows, ["ProgressDelta", "ErrorEmitted", "WorkerFenced", "WorkerLeft", "JobCreated"])


_LEVEL = "list_position(['Planned', 'Scanning', 'Copying', 'Verifying', 'Cutover'], {})".format
_ENDS = "('Completed', 'Failed', 'Cancelled')"
#: One event on a job's state, in two steps: the phase that it asks for, then the state behind it.
_ASKS = """CASE WHEN kind = 'JobPaused' THEN 'Paused' WHEN kind = 'VerifyStarted' THEN 'Verifying' WHEN kind = 'JobPhaseChanged' THEN to_phase
  WHEN kind = 'JobResumed' AND phase = 'Paused' THEN coalesce(split_part(list_filter(hist, lambda h: NOT starts_with(h, 'Paused>'))[-1], '>', 1), 'Scanning')
  WHEN kind = 'VerifyCompleted' THEN CASE WHEN mismatches > 0 THEN 'Failed' ELSE 'Cutover' END WHEN kind = 'ProgressDelta' AND phase = 'Planned' THEN 'Copying' END"""
_MOVES = f"""(kind <> 'JobCreated' AND phase IS NOT NULL AND ask IS NOT NULL AND ask <> phase AND phase NOT IN {_ENDS} AND (ask IN {_ENDS} OR (ask = 'Paused' AND {_LEVEL("phase")} > 0)
  OR ({_LEVEL("ask")} > 0 AND (phase = 'Paused' OR {_LEVEL("phase")} < {_LEVEL("ask")}))))"""


#: The fold of a job's events as a recursion: a row of g for each event, with the state behind it.
FOLD = f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY seq) AS n FROM ({LOG}) l),
  g AS (SELECT DISTINCT job, 0::BIGINT AS n, NULL::VARCHAR AS phase, 0::BIGINT AS ft, 0::BIGINT AS bt, 0::BIGINT AS fd, 0::BIGINT AS bd, 0::BIGINT AS et, 0::BIGINT AS cr, 0 AS tr,
  []::VARCHAR[] AS hist, []::VARCHAR[] AS aw, NULL::BIGINT AS last, NULL::BIGINT AS "at" FROM r
  UNION ALL SELECT job, m, CASE WHEN kind = 'JobCreated' THEN 'Planned' WHEN moves THEN ask ELSE phase END, CASE WHEN kind = 'JobCreated' THEN files ELSE ft END, CASE WHEN kind =
  'JobCreated' THEN bytes ELSE bt END,
    CASE WHEN made THEN 0 WHEN kind = 'ProgressDelta' THEN fd + files WHEN kind = 'ProgressSync' THEN greatest(fd, files) ELSE fd END, CASE WHEN made THEN 0 WHEN kind =
  'ProgressDelta' THEN bd + bytes WHEN kind = 'ProgressSync' THEN greatest(bd, bytes) ELSE bd END,
    CASE WHEN made THEN 0 WHEN kind = 'ProgressDelta' THEN et + errors ELSE et END, CASE WHEN made THEN 0 WHEN kind = 'ClaimConflictResolved' THEN cr + 1 ELSE cr END, CASE WHEN
  made THEN 0 WHEN moves THEN tr + 1 ELSE tr END,
    CASE WHEN made THEN []::VARCHAR[] WHEN moves THEN list_append(hist, phase || '>' || ask || '@' || at_us)[-256:] ELSE hist END,
    CASE WHEN made THEN []::VARCHAR[] WHEN kind = 'WorkerJoined' AND NOT list_contains(aw, worker) THEN list_append(aw, worker) ELSE aw END, seq, at_us
  FROM (SELECT *, {_MOVES} AS moves FROM (SELECT g.job, g.phase, ft, bt, fd, bd, et, cr, tr, hist, aw, r.n AS m, r.kind, r.files, r.bytes, r.errors, r.at_us, r.worker, r.seq,
  r.kind = 'JobCreated' OR g.phase IS NULL AS made, {_ASKS} AS ask FROM g JOIN r ON r.job = g.job AND r.n = g.n + 1) x) y)"""


@query(FOLD + """
SELECT job, phase, ft AS files_total, bt AS bytes_total, fd AS files_done, bd AS bytes_done, et AS errors_total, cr AS conflicts_resolved, tr AS transitions, array_to_string(hist,
  ',') AS history, array_to_string(aw, ',') AS assigned_workers, last AS last_seq
FROM g WHERE phase IS NOT NULL QUALIFY row_number() OVER (PARTITION BY job ORDER BY n DESC) = 1""")
def phase_fold(spark, d):
    return events.fold_jobs(views(spark, d, LOG)).withColumn("assigned_workers", F.array_join("assigned_workers", ","))


@query(f"""WITH e AS (SELECT *, sum((kind = 'WorkerJoined')::INT) OVER (PARTITION BY worker ORDER BY seq) AS j FROM ({LOG}) l), f AS (SELECT *, max(j) OVER (PARTITION BY worker) AS last FROM e),
g AS (SELECT *, sum(CASE WHEN kind = 'ProgressDelta' THEN files ELSE 0 END) OVER o AS sf, sum(CASE WHEN kind = 'ProgressDelta' THEN bytes ELSE 0 END) OVER o AS sb FROM f WHERE j =
  last AND j > 0 WINDOW o AS (PARTITION BY worker ORDER BY seq))
SELECT worker, arg_max(CASE kind WHEN 'WorkerJoined' THEN 'Idle' WHEN 'WorkerLeft' THEN 'Disconnected' WHEN 'WorkerFenced' THEN 'Fenced' END, seq) FILTER (kind IN ('WorkerJoined',
  'WorkerLeft', 'WorkerFenced')) AS state,
  (max(sf) + greatest(0, coalesce(max(files - sf) FILTER (kind = 'ProgressSync'), 0)))::BIGINT AS files_done, (max(sb) + greatest(0, coalesce(max(bytes - sb) FILTER (kind =
  'ProgressSync'), 0)))::BIGINT AS bytes_done,
  min(at_us) FILTER (kind = 'WorkerJoined') AS joined_us FROM g GROUP BY worker""")
def worker_states(spark, d):
    return events.fold_workers(views(spark, d, LOG))


@query(f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY job, worker ORDER BY seq) AS n FROM ({LOG}) l WHERE kind = 'ProgressDelta'),
  g AS (SELECT job, worker, n, at_us AS opened, 1 AS leads FROM r WHERE n = 1
    UNION ALL SELECT r.job, r.worker, r.n, CASE WHEN r.at_us - opened >= 3600000000 THEN r.at_us ELSE opened END, (r.at_us - opened >= 3600000000)::INT FROM g JOIN r ON r.job =
  g.job AND r.worker = g.worker AND r.n = g.n + 1),
  f AS (SELECT r.*, leads, sum(leads) OVER (PARTITION BY g.job, g.worker ORDER BY g.n) AS frame FROM g JOIN r USING (job, worker, n))
SELECT job, worker, max(seq) AS seq, CASE leads WHEN 1 THEN 'leading' ELSE 'trailing' END AS edge, sum(files)::BIGINT AS files, sum(bytes)::BIGINT AS bytes, arg_max(at_us, n) AS
  at_us FROM f GROUP BY job, worker, frame, leads""")
def capped_progress(spark, d):
    return events.capped_progress(views(spark, d, LOG), 3_600_000_000)


@query(f"SELECT job, count(*) AS conflicts FROM ({LOG}) l WHERE kind = 'ClaimConflictResolved' GROUP BY job")
def conflict_counts(spark, d):
    return events.conflicts(views(spark, d, LOG))


@query(f"SELECT seq, kind, job FROM ({LOG}) l WHERE seq > 300 ORDER BY seq LIMIT 200")
def events_since(spark, d):
    return events.since(views(spark, d, LOG), 300).select("seq", "kind", "job")


@query("SELECT c_custkey, c_name, (SELECT max(c_custkey) FROM (SELECT c_custkey FROM customer WHERE c_custkey > 40 ORDER BY 1 LIMIT 25) x) AS next_cursor FROM customer WHERE c_custkey > 40 ORDER BY c_custkey LIMIT 25")
def pagination(spark, d):
    return events.page(_table(spark, d, "customer"), "c_custkey", 40, 25).select("c_custkey", "c_name", "next_cursor")


@query(f"SELECT seq, worker FROM (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY seq DESC) AS r FROM ({LOG}) l) x WHERE r <= 2")
def newest_history(spark, d):
    return events.newest(views(spark, d, LOG), "seq", 2, "worker").select("seq", "worker")


_NOW = "(SELECT max(epoch_us(ts)) FROM events)"


@query(f"SELECT 'w' || user_id AS worker, max(epoch_us(ts)) AS last_us, 'no heartbeat for ' || ({_NOW} - max(epoch_us(ts))) // 1000000 || 's' AS reason FROM events GROUP BY user_id HAVING {_NOW} - max(epoch_us(ts)) > 90000000")
def liveness_sweep(spark, d):
    log = views(spark, d, LOG)
    now = log.agg(F.max("at_us")).first()[0]  # a parameter of the sweep: the clock, here the last event's time
    return coordination.silent_workers(log.groupBy("worker").agg(F.max("at_us").alias("last_us")), F.lit(now))


_STATE = "CASE o_orderkey % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'active' ELSE 'failed' END"


def _shards(spark, d):
    manifest = _table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("shard")).agg(F.count("*").alias("rows"), F.sum("l_linenumber").alias("bytes")).withColumn("position", F.col("shard"))
    claims = _table(spark, d, "orders").where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("shard"), F.expr(_STATE).alias("state"), (F.col("o_custkey") % 30).alias("host"), (F.col("o_orderkey") % 700).alias("claimed_at"), (F.col("o_orderkey") % 5).alias("claim_tag"))
    return manifest, claims


@query(f"""WITH m AS (SELECT l_orderkey AS shard, count(*) AS r, sum(l_linenumber)::BIGINT AS b FROM lineitem GROUP BY 1), c AS (SELECT o_orderkey AS shard, {_STATE} AS state FROM
  orders WHERE o_orderkey % 4 <> 0), j AS (SELECT * FROM m LEFT JOIN c USING (shard))
SELECT count(*) AS total_shards, count(*) FILTER (state = 'completed') AS completed, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'active') AS active,
  coalesce(sum(r) FILTER (state = 'completed'), 0)::BIGINT AS rows_completed,
  coalesce(sum(b) FILTER (state = 'completed'), 0)::BIGINT AS bytes_completed, count(*) FILTER (state IN ('completed', 'failed')) = count(*) AS all_terminal FROM j""")
def shard_tally(spark, d):
    return coordination.tally(*_shards(spark, d))


def _targets(spark, d):
    manifest, claims = _shards(spark, d)
    host = F.col("id")
    progress = spark.range(0, 25).select(host.alias("host"), (host * 30).alias("progress_at"), (host % 4 * 20).alias("progress_heartbeat"), F.when(host % 7 != 0, host % 5).alias("held_tag"))
    return coordination.targets(manifest, claims, progress, F.lit(800), 300, 60)


_TARGETS = f"""(WITH m AS (SELECT DISTINCT l_orderkey AS shard FROM lineitem), c AS (SELECT o_orderkey AS shard, {_STATE} AS state, o_custkey % 30 AS holder, o_orderkey % 700 AS
  cat, o_orderkey % 5 AS tag FROM orders WHERE o_orderkey % 4 <> 0),
p AS (SELECT h AS holder, h * 30 AS pat, h % 4 * 20 AS hb, CASE WHEN h % 7 <> 0 THEN h % 5 END AS held FROM range(25) r(h)), j AS (SELECT m.shard, state, cat, tag, pat, hb, held
  FROM m LEFT JOIN c USING (shard) LEFT JOIN p USING (holder))
SELECT shard, shard AS position, CASE WHEN state IS NULL THEN 'free' WHEN state <> 'active' THEN state WHEN CASE WHEN pat IS NULL THEN 800 - cat > 120 OR 800 - cat > 300 WHEN hb =
  0 THEN FALSE WHEN held IS NOT DISTINCT FROM tag THEN 800 - pat > 2 * hb ELSE 800 - cat > 2 * hb END THEN 'stale' ELSE 'held' END AS target_state FROM j)"""


@query(f"SELECT shard, position, target_state FROM {_TARGETS} t")
def target_states(spark, d):
    return _targets(spark, d)


@query(f"SELECT (SELECT min(shard) FROM {_TARGETS} t WHERE target_state IN ('free', 'stale')) AS next_shard, FALSE AS all_terminal")
def next_target(spark, d):
    return coordination.next_target(_targets(spark, d))


_WORKERS = "SELECT conv_id * 100 + turn AS worker, conv_id % 40 AS job, 'h' || CAST(turn AS VARCHAR(9)) || '-' || CAST(conv_id AS VARCHAR(9)) AS host, conv_id AS pid, conv_id * 3 AS started, CASE WHEN conv_id % 6 = 0 THEN 'Disconnected' ELSE 'Idle' END AS state FROM conversations"


@query(f"SELECT worker FROM ({_WORKERS}) w WHERE state <> 'Disconnected' AND job < 10 AND EXISTS (SELECT 1 FROM (SELECT DISTINCT conv_id % 40 AS aj, turn AS aturn FROM conversations WHERE conv_id < 10) a WHERE aj = job AND 'h' || aturn = split_part(host, '-', 1) AND pid <> aj)")
def stale_registrations(spark, d):
    w = spark.sql(_WORKERS.replace("FROM conversations", "FROM {c}"), c=_table(spark, d, "conversations"))
    return coordination.stale_registrations(w, w.where("pid < 10")).select("worker")


@query(f"SELECT worker, job FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY worker DESC) AS epoch_rank FROM ({_WORKERS}) w) x WHERE epoch_rank = 1")
def latest_claims(spark, d):
    w = spark.sql(_WORKERS.replace("FROM conversations", "FROM {c}"), c=_table(spark, d, "conversations"))
    return coordination.latest_claims(w.withColumnRenamed("job", "shard").withColumn("epoch", F.col("worker"))).select("worker", F.col("shard").alias("job"))


@query("SELECT o_orderkey AS part, CASE WHEN o_orderkey % 5 = 0 THEN 'to_do' WHEN o_orderkey % 3 = 0 THEN 'changed' ELSE 'done' END AS state FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'orphan' FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 5 <> 0")
def checkpoint_states(spark, d):
    o = _table(spark, d, "orders").select(F.col("o_orderkey").alias("part"), F.col("o_custkey").alias("fingerprint"))
    done = o.where("part % 5 <> 0").withColumn("fingerprint", F.col("fingerprint") + F.when(F.col("part") % 3 == 0, 1).otherwise(0))
    return coordination.checkpoints(o.where("part % 2 = 0"), done)


@query("""SELECT 'source ' || user_id % 4 AS who, CASE WHEN sum((event_id % 7 <> 0)::INT) + sum((event_id % 7 = 0)::INT) > 0 THEN sum((event_id % 7 = 0)::INT) * 100.0::DOUBLE /
  count(*) ELSE 0.0 END AS failure_pct FROM events GROUP BY user_id % 4""")
def failure_share(spark, d):
    e = _table(spark, d, "events").groupBy((F.col("user_id") % 4).alias("u")).agg(F.count_if(F.col("event_id") % 7 != 0).alias("ok"), F.count_if(F.col("event_id") % 7 == 0).alias("failed"))
    return e.select(F.concat(F.lit("source "), F.col("u").cast("string")).alias("who"), telemetry.failure_percent(F.col("ok"), F.col("failed")).alias("failure_pct"))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN event_id % 3 = 0 THEN 'FailureRate' END AS why, (event_id % 2 = 0)::INT AS p FROM events),
  r AS (SELECT *, sum((why IS NULL)::INT) OVER (PARTITION BY user_id ORDER BY t, why NULLS FIRST, p ROWS UNBOUNDED PRECEDING) AS run FROM e),
  c AS (SELECT *, sum(p) OVER w - first_value(p) OVER w AS probes FROM r WINDOW w AS (PARTITION BY user_id, run, why IS NULL ORDER BY t, p ROWS UNBOUNDED PRECEDING))
SELECT user_id, t AS at, why, (CASE WHEN why IS NULL THEN 300 ELSE least(1800, 300 * (1 << least(probes, 10)::INT)) END)::INT AS cooldown, CASE WHEN why IS NOT NULL THEN t +
  least(1800, 300 * (1 << least(probes, 10)::INT))::BIGINT * 1000000 END AS until FROM c""")
def backpressure_fold(spark, d):
    rows = _table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), F.when(F.col("event_id") % 3 == 0, "FailureRate").alias("degraded"), (F.col("event_id") % 2 == 0).alias("probing"))
    return telemetry.backpressure(rows, "user_id")
