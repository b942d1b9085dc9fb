"""Queries over trees: diff, delta, canonical index, reconcile, content, planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from treediff.functions import entries as E
from treediff.operators import canonical, diff, planning, reconcile, schema
from treediff.plans.proxies import CURRENT, DEST, INDEX, PENDING, duck, views

QUERIES, SQL = {}, {}
_TUPLE = "(c.file_type, c.size, CASE WHEN c.mtime_sec IS NULL THEN NULL ELSE c.mtime_sec END, CASE WHEN c.mtime_sec IS NULL THEN NULL ELSE coalesce(c.mtime_nsec, 0) END)"
_SAME = " AND ".join(f"{x} IS NOT DISTINCT FROM {x.replace('c.', 'b.')}" for x in ("c.file_type", "c.size", "c.mtime_sec", "CASE WHEN c.mtime_sec IS NULL THEN NULL ELSE coalesce(c.mtime_nsec, 0) END"))
_CLASSES = f"""(SELECT coalesce(c.path, b.path) AS path, c.row_id AS row_id, b.row_id AS baseline_row_id,
  CASE WHEN c.path IS NULL THEN 'DELETED' WHEN b.path IS NULL THEN 'NEW' WHEN NOT ({_SAME}) THEN 'DIRTY' WHEN c.path IN ({PENDING}) THEN 'PENDING' ELSE 'UNCHANGED' END AS class
  FROM ({CURRENT}) c FULL JOIN ({INDEX}) b ON c.path = b.path)"""


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = duck(sql)
        return f

    return add


def _classes(spark, d):
    return diff.classify(views(spark, d, INDEX), views(spark, d, CURRENT), views(spark, d, PENDING))


@query(f"""SELECT count(baseline_row_id) AS baseline_rows, count(row_id) AS current_rows, count(*) FILTER (class = 'NEW') AS new, count(*) FILTER (class = 'DIRTY') AS dirty_tuple,
  count(*) FILTER (class = 'PENDING') AS dirty_pending, count(*) FILTER (class = 'UNCHANGED') AS unchanged, count(*) FILTER (class = 'DELETED') AS deleted, count(*) FILTER (class
  IN ('NEW', 'DIRTY', 'PENDING')) AS keep_rows FROM {_CLASSES} x""")
def diff_counts(spark, d):
    return diff.class_counts(_classes(spark, d))


@query(f"SELECT path, class, row_id, baseline_row_id FROM {_CLASSES} x")
def diff_rows(spark, d):
    return _classes(spark, d)


@query(f"SELECT path FROM ({INDEX}) i WHERE k % 7 = 0")
def diff_deleted(spark, d):
    return diff.deleted(_classes(spark, d))


@query(f"SELECT path, row_id FROM {_CLASSES} x WHERE class = 'PENDING'")
def diff_pending(spark, d):
    return _classes(spark, d).where("class = 'PENDING'").select("path", "row_id")


@query(f"SELECT * FROM ({CURRENT}) c WHERE row_id IN (SELECT row_id FROM {_CLASSES} x WHERE class IN ('NEW', 'DIRTY', 'PENDING'))")
def delta_rows(spark, d):
    return diff.kept_rows(views(spark, d, INDEX), views(spark, d, CURRENT), views(spark, d, PENDING))


@query(f"SELECT row_id FROM {_CLASSES} x WHERE class IN ('NEW', 'DIRTY', 'PENDING')")
def keep_list(spark, d):
    return diff.keep_list(_classes(spark, d))


@query(f"SELECT (SELECT count(*) FROM {_CLASSES} x WHERE class <> 'UNCHANGED') = 0 AS converged")
def cutover_gate(spark, d):
    return diff.may_cut_over(diff.class_counts(_classes(spark, d)))


@query("SELECT '/c' || o_custkey AS path, count(*) AS rows FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_paths(spark, d):
    return diff.duplicate_paths(spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("/c"), F.col("o_custkey").cast("string")).alias("path")))


#: A raw scan part below /src, some rows outside it or of unknown types.
_RAW = f"""SELECT k, CASE WHEN k % 41 = 0 THEN '/srcs' || path WHEN k % 43 = 0 THEN '/src' ELSE '/src' || path END AS path, size, row_id, shard,
  CASE file_type WHEN 1 THEN 'file' WHEN 2 THEN 'directory' WHEN 3 THEN 'symlink' WHEN 4 THEN 'fifo' WHEN 5 THEN 'socket' WHEN 6 THEN 'block_device' ELSE 'Char_Device' END AS file_type,
  CAST(k % 8192 AS INT) AS permissions, CASE WHEN k % 3 = 0 THEN mtime_sec END AS mtime_sec, mtime_nsec, (k - 7000) * 1500 AS mtime_us, uid, gid FROM ({INDEX}) i"""


@query(f"""SELECT k, shard * 1099511627776 + k AS row_id, CASE WHEN path = '/src' THEN '/' WHEN path LIKE '/src/%' THEN substr(path, 5) END AS path, path AS path_legacy, file_type AS file_type_mime,
  CASE WHEN mtime_sec IS NOT NULL AND mtime_nsec IS NOT NULL THEN mtime_sec ELSE CAST(floor(mtime_us / 1000000) AS BIGINT) END AS mtime_sec,
  CAST(CASE WHEN mtime_sec IS NOT NULL AND mtime_nsec IS NOT NULL THEN mtime_nsec ELSE (mtime_us % 1000000 + 1000000) % 1000000 * 1000 END AS INT) AS mtime_nsec,
  CAST(CASE file_type WHEN 'file' THEN 32768 WHEN 'directory' THEN 16384 WHEN 'symlink' THEN 40960 WHEN 'fifo' THEN 4096 WHEN 'socket' THEN 49152 WHEN 'block_device' THEN 24576
  END + permissions % 4096 AS BIGINT) AS mode FROM ({_RAW}) r""")
def canonical_projection(spark, d):
    raw = views(spark, d, _RAW).drop("row_id")
    out = canonical.canonicalise(raw, "/src", F.col("shard"), F.col("k"), strict=False)
    return out.select("k", "row_id", E.path_lossy(F.col("path")).alias("path"), "path_legacy", "file_type_mime", "mtime_sec", "mtime_nsec", "mode")


_BAD = f"SELECT k, row_id, CAST(CASE WHEN k % 37 = 0 THEN 0 WHEN k % 38 = 0 THEN 9 ELSE file_type END AS INT) AS file_type, CASE WHEN k % 33 = 0 THEN mode % 4096 ELSE mode END AS mode FROM ({INDEX}) i"


@query(f"""SELECT row_id, CASE WHEN file_type NOT BETWEEN 1 AND 7 THEN 'file_type ' || file_type ELSE 'mode bits disagree with file_type' END AS corrupt_reason
  FROM ({_BAD}) b WHERE k % 37 = 0 OR k % 38 = 0 OR k % 33 = 0""")
def corrupt_rows(spark, d):
    return schema.check_rows(views(spark, d, _BAD)).where("corrupt_reason is not null").select("row_id", "corrupt_reason")


@query("SELECT l_suppkey AS stamped, min(l_suppkey * 1099511627776 + l_orderkey) AS first_row_id, l_suppkey AS named_shard, TRUE AS ok FROM lineitem GROUP BY l_suppkey")
def shard_check(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("stamped_shard"), E.make_row_id(F.col("l_suppkey"), F.col("l_orderkey")).alias("row_id"))
    return schema.check_shards(rows)


@query("SELECT l_orderkey, l_linenumber, l_suppkey * 1099511627776 + l_orderkey AS row_id, l_suppkey AS shard, l_orderkey AS row FROM lineitem")
def rowid_roundtrip(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", E.make_row_id(F.col("l_suppkey"), F.col("l_orderkey")).alias("row_id"))
    return rows.withColumns({"shard": E.shard_of(F.col("row_id")), "row": E.row_of(F.col("row_id"))})


_US = "(event_id - 500) * 999983"


@query(f"SELECT event_id, CAST(floor({_US} / 1000000) AS BIGINT) AS sec, CAST(({_US} % 1000000 + 1000000) % 1000000 * 1000 AS INT) AS nsec FROM events")
def split_us(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", E.split_us(F.expr(_US)).alias("t")).select("event_id", "t.sec", "t.nsec")


@query(f"""SELECT row_id, lpad(printf('%o', mode % 4096), 4, '0') AS mode_text, coalesce(uid::VARCHAR, '-') || ':' || coalesce(gid::VARCHAR, '-') AS owner, mtime_sec || '.' ||
  lpad((mtime_nsec // 1000)::VARCHAR, 6, '0') AS mtime,
  CASE file_type WHEN 1 THEN 'file' WHEN 2 THEN 'dir' WHEN 3 THEN 'symlink' WHEN 4 THEN 'fifo' WHEN 5 THEN 'socket' WHEN 6 THEN 'blockdev' ELSE 'chardev' END AS type_name,
  file_type AS tag, file_type >= 4 AS special,
  '/c' || split_part(path, '/', 2)[2:] AS parent, 2 AS depth, base64(path::BLOB) AS path_b64 FROM ({INDEX}) i""")
def entry_texts(spark, d):
    c = F.col
    return views(spark, d, INDEX).select(
        "row_id", E.mode_text(c("mode")).alias("mode_text"), E.owner_text(c("uid"), c("gid")).alias("owner"), E.time_text(c("mtime_sec"), c("mtime_nsec")).alias("mtime"), E.pick(c("file_type"), E.REPORT_NAMES).alias("type_name"),
        E.tag_of_mode(c("mode")).alias("tag"), E.is_special(c("file_type")).alias("special"), E.parent_dir(c("path")).alias("parent"), E.depth(c("path")).alias("depth"), F.base64(c("path").cast("binary")).alias("path_b64"),
    )


@query(f"""SELECT row_id FROM ({INDEX}) i WHERE NOT EXISTS (SELECT 1 FROM ({INDEX}) g WHERE g.file_type = 2 AND regexp_matches(g.path, '/o[^/]*7$') AND (g.path = i.path OR
  starts_with(i.path, g.path || '/')))
  AND NOT (i.file_type = 2 AND regexp_matches(i.path,
  '/o[^/]*7$'))""".replace("NOT EXISTS (SELECT 1 FROM", "i.path NOT IN (SELECT path FROM").replace(" AND (g.path = i.path OR starts_with(i.path, g.path || '/')))", ")"))
def excluded_directories(spark, d):
    return canonical.exclude_directories(views(spark, d, INDEX), ["o*7"]).select("row_id")


def _joined(spark, d):
    return reconcile.joined(views(spark, d, INDEX), views(spark, d, DEST))


_J = f"(SELECT s.path AS sp, t.path AS dp, s.file_type AS sf, t.file_type AS df, s.size AS ss, t.size AS ds, s.mode % 4096 AS sm, t.mode % 4096 AS dm, s.uid AS su, t.uid AS du, s.gid AS sg, t.gid AS dg, s.mtime_sec AS st, t.mtime_sec AS dt, coalesce(s.mtime_nsec, 0) // 1000 AS sn, coalesce(t.mtime_nsec, 0) // 1000 AS dn FROM ({INDEX}) s FULL JOIN ({DEST}) t ON s.path = t.path)"
_OWN = "coalesce({}::VARCHAR, '-') || ':' || coalesce({}::VARCHAR, '-')"
_M = f"""(SELECT sp AS path, CASE WHEN sf >= 4 THEN 'special_not_copied' ELSE 'missing' END AS kind, NULL::VARCHAR AS expected, NULL::VARCHAR AS actual FROM {_J} j WHERE dp IS NULL
  UNION ALL SELECT dp, 'extra', NULL, NULL FROM {_J} j WHERE sp IS NULL
  UNION ALL SELECT sp, 'file_type', {{n}}[sf], {{n}}[df] FROM {_J} j WHERE sf <> df
  UNION ALL SELECT sp, 'size', ss::VARCHAR, ds::VARCHAR FROM {_J} j WHERE sf = df AND sf = 1 AND ss <> ds
  UNION ALL SELECT sp, 'mode', lpad(printf('%o', sm), 4, '0'), lpad(printf('%o', dm), 4, '0') FROM {_J} j WHERE sf = df AND sf <> 3 AND sm <> dm
  UNION ALL SELECT sp, 'owner', {_OWN.format("su", "sg")}, {_OWN.format("du", "dg")} FROM {_J} j WHERE sf = df AND sf <> 3 AND ((su IS NOT NULL AND su IS DISTINCT FROM du) OR (sg
  IS NOT NULL AND sg IS DISTINCT FROM dg))
  UNION ALL SELECT sp, 'mtime', st || '.' || lpad(sn::VARCHAR, 6, '0'), coalesce(dt || '.' || lpad(dn::VARCHAR, 6, '0'), '-') FROM {_J} j WHERE sf = df AND sf = 1 AND st IS NOT
  NULL AND (dt IS NULL OR st <> dt OR sn <> dn))""".replace("{n}", "['file', 'dir', 'symlink', 'fifo', 'socket', 'blockdev', 'chardev']")


@query(f"SELECT path, kind, expected, actual FROM {_M} m")
def reconcile_mismatches(spark, d):
    return reconcile.mismatches(_joined(spark, d))


@query(f"""SELECT count(sp) AS source_entries, count(dp) AS dest_entries, count(*) FILTER (sf = df) AS matched,
  {", ".join(f"(SELECT count(*) FROM {_M} m WHERE kind = '{k}') AS {k}" for k in reconcile.KINDS[:8])},
  (SELECT count(*) FROM {_M} m) AS mismatches, count(*) FILTER (sf = df AND sf = 1 AND ss = ds AND ss > 0) AS files_to_read, coalesce(sum(ss) FILTER (sf = df AND sf = 1 AND ss =
  ds AND ss > 0), 0)::BIGINT AS bytes_to_read,
  count(*) FILTER (sf = df AND sf = 3) AS symlinks_to_read FROM {_J} j""")
def reconcile_counts(spark, d):
    return reconcile.counts(_joined(spark, d))


@query(f"SELECT sp AS path, CASE sf WHEN 1 THEN 'file' ELSE 'symlink' END AS kind, ss AS size FROM {_J} j WHERE sf = df AND (sf = 3 OR sf = 1 AND ss = ds AND ss > 0)")
def reconcile_todo(spark, d):
    return reconcile.todo(_joined(spark, d))


_RANK = " ".join(f"WHEN '{k}' THEN {n + 1}" for n, k in enumerate(reconcile.KINDS))


@query(f"SELECT kind, count(*) AS n, (CASE kind {_RANK} END)::INT AS rank FROM {_M} m GROUP BY kind")
def mismatch_tally(spark, d):
    return reconcile.tally(reconcile.mismatches(_joined(spark, d)))


@query(f"SELECT path, kind, expected, actual FROM {_M} m ORDER BY path, kind LIMIT 100")
def mismatch_samples(spark, d):
    return reconcile.samples(reconcile.mismatches(_joined(spark, d)))


def _digests(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("t"), "doc_id")
    sha = lambda x: F.sha2(x, 256).alias("sha256")
    none = F.lit(None).cast("string").alias("error")
    src = docs.select("path", sha(F.col("t")), F.octet_length("t").cast("long").alias("bytes"), F.when(F.col("doc_id") % 17 == 0, "EIO").alias("error"))
    dst = docs.where("doc_id % 13 <> 0").withColumn("t", F.when(F.col("doc_id") % 5 == 0, F.concat("t", F.lit("!"))).otherwise(F.col("t"))).select("path", sha(F.col("t")), F.octet_length("t").cast("long").alias("bytes"), none)
    return docs.select("path", F.octet_length("t").cast("long").alias("size")), src, dst


@query("""WITH t AS (SELECT doc_id, coalesce(text, '') AS s, CASE WHEN doc_id % 5 = 0 THEN coalesce(text, '') || '!' ELSE coalesce(text, '') END AS e FROM documents)
SELECT '/' || doc_id AS path, CASE WHEN doc_id % 17 = 0 OR doc_id % 13 = 0 THEN 'read_error' ELSE 'content' END AS kind,
  CASE WHEN doc_id % 17 <> 0 AND doc_id % 13 <> 0 THEN 'sha256:' || sha256(s) || ' (' || strlen(s) || ' bytes)' END AS expected,
  CASE WHEN doc_id % 17 <> 0 AND doc_id % 13 <> 0 THEN 'sha256:' || sha256(e) || ' (' || strlen(e) || ' bytes)' END AS actual,
  CASE WHEN doc_id % 17 = 0 AND doc_id % 13 = 0 THEN 'both' WHEN doc_id % 17 = 0 THEN 'source' WHEN doc_id % 13 = 0 THEN 'destination' ELSE 'index is stale' END AS detail
FROM t WHERE doc_id % 17 = 0 OR doc_id % 13 = 0 OR doc_id % 5 = 0""")
def content_digest_compare(spark, d):
    return reconcile.compare_digests(*_digests(spark, d))


@query("SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def dup_content_groups(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").where("text is not null")
    return docs.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query(f"""SELECT strategy, count(*) AS n FROM (SELECT CASE WHEN file_type = 1 AND inode IS NOT NULL AND row_id <> min(row_id) OVER (PARTITION BY shard, fsid, inode, file_type)
  AND nlink > 1 AND fsid IS NOT NULL THEN 'HardlinkExisting'
  WHEN file_type = 1 AND size = 0 THEN 'Empty' WHEN file_type = 1 THEN 'LibnfsIoUring' WHEN file_type = 3 THEN 'Symlink' WHEN file_type = 2 THEN 'DirAttrs' ELSE 'SpecialNotCopied'
  END AS strategy FROM ({INDEX}) i WHERE NOT (file_type = 1 AND coalesce(nlink, 1) <= 1)
  UNION ALL SELECT CASE WHEN size = 0 THEN 'Empty' ELSE 'LibnfsIoUring' END FROM ({INDEX}) i WHERE file_type = 1 AND coalesce(nlink, 1) <= 1) x GROUP BY strategy""")
def strategy_counts(spark, d):
    rows = views(spark, d, INDEX)
    led = planning.hardlinks(rows, batch="shard").select(F.col("row_id").alias("id"), (~F.col("is_leader")).alias("linked"))
    rows = rows.join(led, F.col("row_id") == F.col("id"), "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    return rows.groupBy(planning.strategy(F.col("linked")).alias("strategy")).agg(F.count("*").alias("n"))


_BIG = "SELECT k, size * size AS size FROM ({}) i".format(INDEX)
_CLASS = "CASE WHEN size < 1048576 THEN {} WHEN size < 1073741824 THEN {} ELSE {} END"


@query(f"SELECT {_CLASS.format(repr('small'), repr('medium'), repr('large'))} AS size_class, count(*) AS n, sum(size)::BIGINT AS bytes FROM ({_BIG}) b GROUP BY 1")
def size_classes(spark, d):
    return views(spark, d, _BIG).groupBy(E.size_class(F.col("size")).alias("size_class")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query(f"SELECT k, {_CLASS.format(repr('small'), repr('medium'), repr('large'))} AS name, {_CLASS.format(131072, 2097152, 4194304)} AS rsize, {_CLASS.format(2, 8, 32)} AS read_depth FROM ({_BIG}) b")
def io_buckets(spark, d):
    return views(spark, d, _BIG).select("k", planning.io_bucket(F.col("size")).alias("b")).select("k", "b.name", "b.rsize", "b.read_depth")


_FILES, _BYTES = 40, 1_000_000


@query(f"""WITH RECURSIVE r AS (SELECT shard, row_id, size, row_number() OVER (PARTITION BY shard ORDER BY row_id) AS n FROM ({INDEX}) i),
  g AS (SELECT shard, row_id, size, n, 0::BIGINT AS batch, 1::BIGINT AS files, size AS used FROM r WHERE n = 1
  UNION ALL SELECT r.shard, r.row_id, r.size, r.n, CASE WHEN files >= {_FILES} OR used + r.size > {_BYTES} THEN batch + 1 ELSE batch END, CASE WHEN files >= {_FILES} OR used +
  r.size > {_BYTES} THEN 1 ELSE files + 1 END,
  CASE WHEN files >= {_FILES} OR used + r.size > {_BYTES} THEN r.size ELSE used + r.size END FROM g JOIN r ON r.shard = g.shard AND r.n = g.n + 1)
SELECT shard, batch, min(row_id) AS row_first, max(row_id) AS row_last, count(*) AS files, sum(size)::BIGINT AS bytes FROM g GROUP BY shard, batch""")
def micro_batches(spark, d):
    return planning.batch_records(planning.micro_batches(views(spark, d, INDEX), files=_FILES, budget=_BYTES))


@query(f"""SELECT row_id, row_number() OVER (PARTITION BY shard ORDER BY turn, head)::INT AS position FROM (SELECT shard, row_id, row_number() OVER (PARTITION BY shard,
  split_part(path, '/', 2) ORDER BY row_id) AS turn,
  min(row_id) OVER (PARTITION BY shard, split_part(path, '/', 2)) AS head FROM ({INDEX}) i) x""")
def interleave_by_parent(spark, d):
    return planning.interleave_by_parent(views(spark, d, INDEX)).select("row_id", "position")


_PAGES = "SELECT page_id AS row_id, 0 AS shard, 2 AS file_type, regexp_replace(url, '^[a-z]+://', '/') AS path FROM pages"


@query(f"SELECT row_id, (length(path) - length(replace(path, '/', '')))::INT AS depth, dense_rank() OVER (ORDER BY length(path) - length(replace(path, '/', '')) DESC)::INT AS level FROM ({_PAGES}) p")
def dir_levels(spark, d):
    rows = spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("row_id"), F.lit(0).alias("shard"), F.lit(2).alias("file_type"), F.regexp_replace("url", "^[a-z]+://", "/").alias("path"))
    return planning.deepest_first(rows).select("row_id", "depth", "level")


@query(f"""SELECT row_id, min(row_id) OVER w AS leader, row_id = min(row_id) OVER w AS is_leader, count(*) OVER w AS group_size, first_value(path) OVER (PARTITION BY shard, fsid,
  inode ORDER BY row_id) AS leader_path FROM ({INDEX}) i
  WHERE file_type = 1 AND nlink > 1 AND fsid IS NOT NULL AND inode IS NOT NULL WINDOW w AS (PARTITION BY shard, fsid, inode)""")
def hardlink_leaders(spark, d):
    return planning.hardlinks(views(spark, d, INDEX), batch="shard").select("row_id", "leader", "is_leader", "group_size", "leader_path")


_T = "{0} || '.' || lpad({1}::VARCHAR, 9, '0')"
_MT, _AT = _T.format("mtime_sec", "coalesce(mtime_nsec, 0)"), _T.format("atime_sec", "atime_nsec")


@query(f"""WITH o AS (SELECT row_id, 1 AS p, 'chown' AS op, uid || ':' || gid AS argument FROM ({INDEX}) i WHERE uid IS NOT NULL AND gid IS NOT NULL UNION ALL SELECT row_id, 2,
  'chmod', lpad(printf('%o', mode % 4096), 4, '0') FROM ({INDEX}) i
  UNION ALL SELECT row_id, 3, 'utimes', CASE WHEN atime_sec IS NULL THEN {_MT} ELSE {_AT} END || '/' || {_MT} FROM ({INDEX}) i WHERE mtime_sec IS NOT NULL)
SELECT row_id, (row_number() OVER (PARTITION BY row_id ORDER BY p) - 1)::INT AS step, op, argument FROM o""")
def attr_plan(spark, d):
    return planning.attribute_plan(views(spark, d, INDEX))


@query(f"""SELECT row_id, 'SPECIAL_NOT_COPIED' AS kind FROM ({INDEX}) i WHERE file_type >= 4 UNION ALL SELECT row_id, 'NULL_OWNER' FROM ({INDEX}) i WHERE file_type < 4 AND uid IS NULL
  UNION ALL SELECT row_id, 'NULL_MTIME' FROM ({INDEX}) i WHERE file_type < 4 AND mtime_sec IS NULL UNION ALL SELECT row_id, 'NULL_ATIME' FROM ({INDEX}) i WHERE file_type < 4 AND
  mtime_sec IS NOT NULL AND atime_sec IS NULL
  UNION ALL SELECT row_id, 'SYMLINK_MODE_NFSV3' FROM ({INDEX}) i WHERE file_type = 3 AND mode % 4096 <> 511
  UNION ALL SELECT min(row_id), 'FSID_UNGROUPED' FROM ({INDEX}) i WHERE file_type = 1 AND nlink > 1 AND inode IS NOT NULL AND fsid IS NULL GROUP BY shard""")
def downgrades(spark, d):
    return planning.downgrades(views(spark, d, INDEX))
