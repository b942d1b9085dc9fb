"""Operators over small tables, with results worked out by hand or by a plain loop."""

import random
import time

import pytest
from pyspark.sql import functions as F

from treediff.functions import decisions as D
from treediff.functions import entries as E
from treediff.functions import texts as X
from treediff.operators import canonical, coordination, diff, events, planning, reconcile, schema, telemetry
from treediff.sources import tables
from treediff.streaming import log

DIFF = "path string, row_id long, size long, mtime_sec long, mtime_nsec int, file_type int, ctime_sec long, ctime_nsec int"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def side(spark, rows):
    return spark.createDataFrame([(p, k, s, m, 0, 1, c, 0) for k, (p, s, m, c) in enumerate(rows)], DIFF)


def test_diff_classes(spark):
    base = side(spark, [("/a", 1, 10, 10), ("/b", 1, 10, 10), ("/c", 1, 10, 10), ("/d", 1, 10, 10), ("/e", 5, 10, 10), ("/g", 1, None, None)])
    cur = side(spark, [("/a", 1, 10, 10), ("/b", 1, 20, 20), ("/c", 1, 10, 30), ("/e", 6, 10, 10), ("/f", 1, 10, 10), ("/g", 1, None, None)])
    got = {r["path"]: r["class"] for r in diff.classify(base, cur, spark.createDataFrame([("/a",), ("/b",)], "path string")).collect()}
    assert got == {"/a": "PENDING", "/b": "DIRTY", "/c": "DIRTY", "/d": "DELETED", "/e": "DIRTY", "/f": "NEW", "/g": "UNCHANGED"}
    c = diff.class_counts(diff.classify(base, cur)).first()
    assert (c["new"], c["dirty_tuple"], c["unchanged"], c["deleted"], c["keep_rows"]) == (1, 3, 2, 1, 4)
    keep = diff.keep_list(diff.classify(base, cur))
    diff.check_delta(diff.delta(cur, keep), keep)
    with pytest.raises(ValueError):
        diff.check_delta(cur, keep)


def test_diff_is_the_same_for_any_partitioning(spark):
    rows = [(f"/f/{i:04d}", 1, 1, 1) for i in range(400)]
    base, cur = side(spark, rows), side(spark, [(p, s + (k % 4 == 0), m, c) for k, (p, s, m, c) in enumerate(rows) if k % 5])
    got = set()
    for n in ("1", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.add(tuple(diff.class_counts(diff.classify(base, cur)).first()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == 1


def test_types_and_modes(spark):
    pairs = spark.createDataFrame([(t, m) for t in E.TYPE_BITS for m in E.TYPE_BITS.values()], "file_type int, mode long").withColumn("row_id", F.lit(1))
    bad = schema.check_rows(pairs).where("corrupt_reason is not null").count()
    assert bad == 42
    with pytest.raises(Exception, match="mode bits"):
        schema.check_rows(pairs, strict=True).collect()
    with pytest.raises(ValueError, match="mode"):
        schema.conform(pairs.drop("mode"))


def test_scalar_functions(spark):
    assert tuple(value(spark, E.split_us(F.lit(-1500)))) == (-1, 998500000)
    assert value(spark, E.strip_root(F.lit("/src-testing/a"), "/src-test")) is None
    assert value(spark, E.strip_root(F.lit("/src-test"), "/src-test")) == "/"
    assert value(spark, E.canonical_mode(F.lit("File"), F.lit(0o644))) is None
    assert value(spark, E.path_lossy(F.lit(b"/fifo-\xff"))) == "/fifo-�"
    assert value(spark, X.parse_size(F.lit("8 GiB"))) == 8 << 30
    assert value(spark, X.parse_size(F.lit("8 furlongs"))) is None
    assert [value(spark, X.duration_text(F.lit(n))) for n in (400, 1400, 4550, 14_000, 1_200_000)] == ["400µs", "1.4ms", "4.5ms", "14ms", "1.2s"]
    parts = X.url_parts(F.lit("NFS://h/x"))
    assert value(spark, parts) is None
    assert value(spark, X.url_text(X.url_parts(F.lit("nfs://[::1]:2049/a//b/?z=1&a=2&z=1")))) == "nfs://[::1]/a/b?a=2&z=1"
    assert tuple(value(spark, X.partial_path(F.lit("/d/f"), F.lit("h"), F.lit(7)))) == ("/d/.f.h.7.partial", None)
    pairs = spark.createDataFrame([(old, new) for old in D.PHASES for new in D.PHASES], "old string, new string")
    for old, new, ok in pairs.select("old", "new", D.transition_allowed(F.col("old"), F.col("new"))).collect():
        assert ok == events.allowed(old, new)


def test_globs(spark):
    names = spark.createDataFrame([("axxcd",), ("bxxcd",), ("axxbd",), ("axxcd\n",)], "n string")
    assert [r["n"] for r in names.where(F.col("n").rlike(X.glob_pattern("a*[!b]?"))).collect()] == ["axxcd", "axxcd\n"]
    assert [r["n"] for r in names.where(F.col("n").rlike(X.glob_pattern("a*[!b]d"))).collect()] == ["axxcd"]
    for bad in ("[ab", "a\\"):
        with pytest.raises(ValueError):
            X.glob_pattern(bad)


def test_excluded_directories_take_what_lies_below(spark):
    rows = [("/a", 2), ("/a/skip7", 2), ("/a/skip7/x", 1), ("/a/skip7/d/skip7", 2), ("/a/skip7/d/skip7/y", 1), ("/a/skip70", 2), ("/skip7", 1), ("/b/skip7\n", 2), ("/b/skip7\n/z", 1)]
    index = spark.createDataFrame([(p.encode(), t) for p, t in rows], "path binary, file_type int")
    want = {"/a", "/a/skip70", "/skip7", "/b/skip7\n", "/b/skip7\n/z"}
    out = canonical.exclude_directories(index, ["skip*7", "no[!x]e"])
    assert {bytes(r["path"]).decode() for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert canonical.exclude_directories(index, []).count() == len(rows) and canonical.exclude_directories(index, ["*"]).count() == 0


def test_the_claim_of_the_highest_epoch_counts(spark):
    manifest = spark.createDataFrame([("a", 1, 10), ("b", 2, 20), ("c", 3, 30)], "shard string, rows long, bytes long")
    claims = spark.createDataFrame([("a", "failed", 1), ("a", "completed", 2), ("b", "completed", 1), ("b", "active", 3), ("x", "failed", 9)], "shard string, state string, epoch long")
    got = coordination.tally(manifest, claims).first()
    assert (got["completed"], got["failed"], got["active"], got["rows_completed"], got["all_terminal"]) == (1, 0, 1, 1, False)
    assert coordination.tally(manifest, claims.where("epoch < 3").drop("epoch")).first()["failed"] == 1


def test_diff_of_mostly_deleted_rows_has_one_shuffle_a_side(spark):
    rows = [(f"/f/{i:04d}", 1, 1, 1) for i in range(500)]
    base, cur = side(spark, rows), side(spark, [(p, s + (k % 20 == 0), m, c) for k, (p, s, m, c) in enumerate(rows) if k % 10 == 0])
    wait = spark.createDataFrame([("/f/0010",), ("/f/0011",)], "path string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        classes, kept = diff.classify(base, cur, wait), diff.kept_rows(base, cur, wait)
        counts = {r["class"]: r["n"] for r in classes.groupBy("class").agg(F.count("*").alias("n")).collect()}
        assert counts == {"DELETED": 450, "DIRTY": 25, "PENDING": 1, "UNCHANGED": 24}
        assert kept.columns == cur.columns and kept.count() == 26
        for df in (classes, kept):
            assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3  # one a side, one for pending paths
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_canonical_projection(spark):
    raw = spark.createDataFrame([("/r", "directory", 0o755, 0, None), ("/r/file.bin", "file", 0o4644, 1234, 1_700_000_000_000_002), ("/r/link", "symlink", 0o777, 1, -1500)], "path string, file_type string, permissions int, size long, mtime_us long")
    rows = canonical.canonicalise(raw, "/r", F.lit(3), F.monotonically_increasing_id() * 0 + 5).orderBy("path").collect()
    assert [bytes(r["path"]) for r in rows] == [b"/", b"/file.bin", b"/link"]
    assert rows[1]["mode"] == 0o104644 and rows[1]["mtime_nsec"] == 2000 and rows[2]["mtime_sec"] == -1 and rows[0]["row_id"] == (3 << 40) | 5
    with pytest.raises(Exception, match="outside the root"):
        canonical.canonicalise(raw, "/other", F.lit(0), F.lit(0)).collect()


TREE = "path string, file_type int, size long, mode long, uid long, gid long, mtime_sec long, mtime_nsec int"


def test_reconcile_kinds(spark):
    src = spark.createDataFrame([("/a", 1, 5, 0o100644, 1, 1, 9, 1999), ("/b", 1, 5, 0o100644, None, 1, None, None), ("/t", 2, 0, 0o040755, 1, 1, 1, 0), ("/p", 4, 0, 0o010644, 1, 1, 1, 0), ("/m", 1, 1, 0o100644, 1, 1, 1, 0)], TREE)
    dst = spark.createDataFrame([("/a", 1, 6, 0o100600, 2, 1, 9, 1000), ("/b", 1, 5, 0o100644, 7, 1, 3, 0), ("/t", 1, 0, 0o100755, 1, 1, 1, 0), ("/x", 1, 0, 0o100755, 1, 1, 1, 0)], TREE)
    rows = reconcile.joined(src, dst)
    got = {(r["path"], r["kind"]) for r in reconcile.mismatches(rows).collect()}
    assert got == {("/a", "size"), ("/a", "mode"), ("/a", "owner"), ("/t", "file_type"), ("/p", "special_not_copied"), ("/m", "missing"), ("/x", "extra")}
    c = reconcile.counts(rows).first()
    assert (c["matched"], c["mismatches"], c["files_to_read"], c["bytes_to_read"]) == (2, 7, 1, 5)


def test_micro_batches_match_a_loop(spark):
    rng = random.Random(3)
    rows = [(s, k, rng.randint(0, 300)) for s in range(3) for k in range(200)] + [(0, 500, 5000), (0, 501, 1)]
    want, state = {}, {}
    for s, k, size in sorted(rows):
        b, n, used = state.get(s, (0, 0, 0))
        if n and (n >= 7 or used + size > 1000):
            b, n, used = b + 1, 0, 0
        state[s], want[s, k] = (b, n + 1, used + size), b
    df = spark.createDataFrame(rows, "shard long, row_id long, size long").repartition(3)
    got = {(r["shard"], r["row_id"]): r["batch"] for r in planning.micro_batches(df, files=7, budget=1000).collect()}
    assert got == want
    assert planning.micro_batches(df.limit(0)).count() == 0


def reference_jobs(rows):
    """A plain restatement of the phase rules, independent of the fold's."""
    order = ["Planned", "Scanning", "Copying", "Verifying", "Cutover"]
    jobs = {}
    for e in rows:
        j = jobs.get(e["job"])
        if e["kind"] == "JobCreated":
            jobs[e["job"]] = {"phase": "Planned", "from": [], "files": 0}
            continue
        if not j:
            continue
        to = {"JobPaused": "Paused", "JobCancelled": "Cancelled", "JobCompleted": "Completed", "JobFailed": "Failed", "VerifyStarted": "Verifying"}.get(e["kind"])
        if e["kind"] == "JobPhaseChanged":
            to = e["to_phase"]
        if e["kind"] == "ProgressSync":
            j["files"] = max(j["files"], e["files"])
        if e["kind"] == "ProgressDelta":
            j["files"] += e["files"]
            to = "Copying" if j["phase"] == "Planned" else None
        if e["kind"] == "VerifyCompleted":
            to = "Failed" if e["mismatches"] else "Cutover"
        if e["kind"] == "JobResumed" and j["phase"] == "Paused":
            to = next((p for p in reversed(j["from"]) if p != "Paused"), "Scanning")
        p = j["phase"]
        ends = ("Completed", "Failed", "Cancelled")
        if to and to != p and p not in ends and (to in ends or to == "Paused" or p == "Paused" or order.index(to) > order.index(p)):
            j["from"].append(p)
            j["phase"] = to
    return {k: (j["phase"], j["files"], len(j["from"])) for k, j in jobs.items()}


def make_log(n=400, seed=5):
    rng, kinds = random.Random(seed), ["JobCreated", "ProgressDelta", "ProgressSync", "JobPaused", "JobResumed", "VerifyStarted", "VerifyCompleted", "JobPhaseChanged", "ErrorEmitted", "WorkerJoined"] + ["ProgressDelta"] * 6
    return [
        {"seq": k + 1, "at_us": k * 300_000, "kind": "JobCreated" if k < 30 and k % 3 == 0 else rng.choice(kinds[1:]), "job": f"j{k % 6}", "worker": f"w{rng.randint(0, 3)}", "from_worker": None, "client_seq": k, "files": rng.randint(0, 9), "bytes": rng.randint(0, 99), "errors": rng.randint(0, 1),
         "to_phase": rng.choice(["Scanning", "Copying", "Verifying"]), "mismatches": int(rng.random() < 0.2), "class": rng.choice("abcd"), "path": f"/p{rng.randint(0, 20)}", "retryable": bool(rng.randint(0, 1)), "reason": None}
        for k in range(n)
    ]


def test_job_fold_matches_a_loop_and_the_stream(spark, tmp_path):
    rows = make_log()
    df = spark.createDataFrame(rows, events.EVENTS).repartition(3)
    got = {r["job"]: (r["phase"], r["files_done"], r["transitions"]) for r in events.fold_jobs(df).collect()}
    assert got == reference_jobs(rows)
    for start in (1, 150, 300):
        part = df.where((F.col("seq") >= start) & (F.col("seq") < {1: 150, 150: 300, 300: 10**6}[start]))
        for job in [f"j{k}" for k in range(6)]:
            log.write_chunk(part.where(F.col("job") == job).drop("job").withColumn("job", F.lit(job)).orderBy("seq"), str(tmp_path / "log"), start, job)
    assert log.read_log(spark, str(tmp_path / "log"), after=390).count() == 10
    assert log.read_log(spark, str(tmp_path / "log"), job="j1").select("job").distinct().count() == 1
    q = log.jobs(log.stream_log(spark, str(tmp_path / "log"))).writeStream.outputMode("update").format("memory").queryName("jobs_now").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = spark.table("jobs_now").groupBy("job").agg(F.max_by(F.struct("phase", "files_done", "transitions"), "last_seq").alias("s")).collect()
    assert {r["job"]: tuple(r["s"]) for r in last} == got
    log.write_chunk(df.where("seq <= 40 and job = 'j0'").orderBy("seq"), str(tmp_path / "log2"), 1, "j0")
    log.write_chunk(df.where("seq > 20 and seq <= 60 and job = 'j0'").orderBy("seq"), str(tmp_path / "log2"), 21, "j0")
    seen = []
    log.follow(log.fresh(log.stream_log(spark, str(tmp_path / "log2"), 1)), lambda batch, _: seen.extend(r["seq"] for r in batch.select("seq").collect()), str(tmp_path / "cp2")).awaitTermination(120)
    assert sorted(seen) == [r["seq"] for r in rows if r["job"] == "j0" and r["seq"] <= 60]


def test_chunks_that_end_before_are_skipped(spark, tmp_path):
    assert log.chunks_since([1, 150, 300], 0) == [1, 150, 300]
    assert log.chunks_since([300, 1, 150], 150) == [150, 300]
    assert log.chunks_since([1, 150, 300], 149) == [1, 150, 300]
    assert log.chunks_since([1, 150, 300], 10**6) == [300] and log.chunks_since([], 5) == []
    assert log.read_log(spark, str(tmp_path / "none")).count() == 0


def test_replay_from_any_snapshot(spark, tmp_path):
    rows = make_log(300, 9)
    df = spark.createDataFrame(rows, events.EVENTS)
    want = sorted(map(str, events.fold_jobs(df).collect()))
    for at in (0, 120, 300):
        tables.write_snapshot(events.snapshot_jobs(df.where(F.col("seq") <= at)), str(tmp_path / "s"), at + 1, keep=2)
        snapshot = tables.read_snapshot(spark, str(tmp_path / "s"), events.SNAPSHOTS)
        assert sorted(map(str, events.replay(snapshot, df).collect())) == want
    assert len(tables.children(spark, str(tmp_path / "s"), "snapshot-*")) == 2
    with pytest.raises(Exception, match="exist"):
        tables.write_snapshot(snapshot, str(tmp_path / "s"), 301)
    assert tables.read_snapshot(spark, str(tmp_path / "none"), events.SNAPSHOTS).count() == 0


def test_capped_stream_loses_nothing(spark, tmp_path):
    df = spark.createDataFrame(make_log(400, 8), events.EVENTS)
    for start in (1, 200):
        df.where((F.col("seq") >= start) & (F.col("seq") < start + 199 + (start > 1))).coalesce(1).write.json(str(tmp_path / "log" / f"{start}"))
    frames = []
    stream = log.stream_log(spark, str(tmp_path / "log"), 1)
    q = log.capped(stream, 5000).writeStream.foreachBatch(lambda b, _: frames.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    want = {(r["job"], r["worker"]): r["f"] for r in df.where("kind = 'ProgressDelta'").groupBy("job", "worker").agg(F.sum("files").alias("f")).collect()}
    got = {}
    for _ in range(90):
        time.sleep(0.5)
        got = {}
        for r in list(frames):
            got[r["job"], r["worker"]] = got.get((r["job"], r["worker"]), 0) + r["files"]
        if got == want:
            break
    q.stop()
    assert got == want  # the timer drains what was retained
    leading = [r["seq"] for r in frames if r["edge"] == "leading"]
    assert len(leading) == len(set(leading)) and len(frames) < df.where("kind = 'ProgressDelta'").count()


def test_errors_beyond_the_cap_share_their_samples(spark):
    rows = [(k, k, "ErrorEmitted", "j", f"c{k % 66}", f"/p{k}") for k in range(132)]
    df = spark.createDataFrame(rows, "seq long, at_us long, kind string, job string, class string, path string").withColumn("retryable", F.lit(True))
    got = {r["class"]: r["samples"] for r in events.error_samples(df).collect()}
    assert len(got) == 65 and got[events.OVERFLOW] == ["/p64", "/p65", "/p130", "/p131"] and got["c0"] == ["/p0", "/p66"]
    assert {r["class"] for r in events.error_buckets(df).collect()} == set(got)


def test_error_windows_match_a_loop(spark):
    rows = make_log(500, 3)
    start, seen, want = {}, {}, {}
    for e in rows:
        if e["kind"] == "ErrorEmitted":
            j = e["job"]
            if j not in start or e["at_us"] - start[j] >= 60_000_000:
                start[j], seen[j] = e["at_us"], {}
            n = seen[j][e["class"]] = seen[j].get(e["class"], 0) + 1
            want[e["seq"]] = (start[j], n <= 1)
    got = {r["seq"]: (r["window_us"], r["shown"]) for r in events.error_cap(spark.createDataFrame(rows, events.EVENTS), 1, 60_000_000).collect()}
    assert got == want and not all(ok for _, ok in want.values())


def test_scope_of_errors(spark):
    rows = spark.createDataFrame([(True, "command timed out", False), (True, "command timed out", True), (True, "corrupt", False), (False, "corrupt", True), (True, None, None)], "fatal boolean, m string, typed boolean")
    assert [r[0] for r in rows.select(D.error_scope(F.col("fatal"), F.col("m"), F.col("typed"))).collect()] == ["WorkerLocal", "Fatal", "Fatal", "WorkerLocal", "Fatal"]


def test_shards_are_checked_against_their_files(spark, tmp_path):
    import hashlib

    for name, n in (("a", 3), ("b", 4), ("c", 5)):
        spark.range(n).coalesce(1).write.parquet(str(tmp_path / name))
    files = {d: next((tmp_path / d).glob("part-*.parquet")) for d in "abc"}
    row = lambda d, rows, extra=0, sha=None: (f"{d}/{files[d].name}", rows, files[d].stat().st_size + extra, sha or hashlib.sha256(files[d].read_bytes()).hexdigest())
    shards = spark.createDataFrame([row("a", 3), row("b", 5), row("c", 5, 1, "0" * 64), ("d/x.parquet", 1, 1, "0" * 64)], tables.SHARDS)
    got = {(r["path"][0], r["why"]) for r in tables.verify_shards(spark, str(tmp_path), shards).collect()}
    assert got == {("b", "rows"), ("c", "size"), ("c", "digest"), ("d", "absent")}


def test_json_is_replaced_whole(spark, tmp_path):
    for k in range(3):
        tables.write_json(spark, str(tmp_path / "x.json"), {"k": k})
        assert tables.read_json(spark, str(tmp_path / "x.json")) == {"k": k}
    assert [p.name for p in tmp_path.iterdir() if p.suffix == ".tmp"] == []


def test_progress_caps_lose_nothing(spark):
    df = spark.createDataFrame(make_log(600, 8), events.EVENTS)
    want = df.where("kind = 'ProgressDelta'").agg(F.sum("files"), F.sum("bytes")).first()
    capped = events.capped_progress(df.withColumn("worker", F.lit("w")), 5_000_000)
    assert tuple(capped.agg(F.sum("files"), F.sum("bytes")).first()) == tuple(want)
    assert capped.count() < df.where("kind = 'ProgressDelta'").count()


def test_error_samples_and_buckets(spark):
    rows = make_log(500, 2)
    df = spark.createDataFrame(rows, events.EVENTS)
    want = {}
    for e in rows:
        if e["kind"] == "ErrorEmitted":
            s = want.setdefault((e["job"], e["class"]), [])
            if e["path"] not in s:
                s.append(e["path"])
                del s[:-3]
    assert {(r["job"], r["class"]): r["samples"] for r in events.error_samples(df, 3).collect()} == want
    assert events.error_buckets(df, 1).groupBy("job").count().where("count > 2").count() == 0


def test_quantiles_match_a_loop(spark):
    rng = random.Random(1)
    us = [int(10 ** rng.uniform(-1, 8)) for _ in range(3000)]
    hist = telemetry.histogram(spark.createDataFrame([("s", u) for u in us], "side string, duration_us long"), ["side"])

    def bucket(u):
        e = u.bit_length() - 1
        return 0 if u < 1 else 99 if e >= 24 else e * 4 + ((u >> (e - 2) if e >= 2 else u << (2 - e)) & 3)

    def upper(b):
        e, s = divmod(b, 4)
        return 1 << 24 if b == 99 else (1 << e) + (s + 1) * (1 << (e - 2)) - 1 if e >= 2 else (1 << (e + 1)) - 1

    b = sorted(map(bucket, us))
    p95 = b[-(-len(b) * 95 // 100) - 1]
    got = telemetry.quantiles(hist, ["side"]).first()
    assert got["n"] == 3000 and got["max_us"] == max(us)
    assert got["p95_us"] == (max(max(us), upper(99)) if p95 == 99 else min(upper(p95), max(us)))


def test_liveness_table(spark):
    cases = [(None, None, None, 100, False), (None, None, None, 300, True), (250, 0, "t", 0, False), (250, 60, "x", 300, True), (250, 60, None, 100, False), (1000, 60, "t", 900, False), (700, 60, "t", 900, True)]
    df = spark.createDataFrame([(i, a, h, t, 1000 - age, "t") for i, (a, h, t, age, _) in enumerate(cases)], "i int, progress_at long, progress_heartbeat long, held_tag string, claimed_at long, claim_tag string")
    got = [r[0] for r in df.orderBy("i").select(coordination.owner_dead(F.lit(1000), F.lit(60))).collect()]
    assert got == [c[-1] for c in cases]


def test_runs_of_failures(spark):
    beats = spark.createDataFrame([("w", k, ok) for k, ok in enumerate([True, False, False, True, False, False, False])], "worker string, at long, ok boolean")
    got = coordination.fence_runs(beats, "worker", F.lit(3)).orderBy("at").collect()
    assert [r["failures"] for r in got] == [0, 1, 2, 0, 1, 2, 3] and [r["fenced"] for r in got][-1]


def test_tables_round_trip(spark, tmp_path):
    index = schema.conform(spark.createDataFrame([((s << 40) | k, f"/f{s}{k}".encode(), k, 0o100644, 1) for s in range(2) for k in range(5)], "row_id long, path binary, size long, mode long, file_type short"))
    tables.write_index(index, str(tmp_path / "i"))
    assert sorted(r["row_id"] for r in tables.read_index(spark, str(tmp_path / "i")).collect()) == sorted(r["row_id"] for r in index.collect())
    assert tables.read_lines(spark, str(tmp_path / "none"), tables.FAILURES).count() == 0
    rows = spark.createDataFrame([(1, "s", "L2E=", "e", "open", "t")], tables.FAILURES)
    tables.write_lines(rows, str(tmp_path / "f"), "host", 1)
    with pytest.raises(Exception, match="exist"):
        tables.write_lines(rows, str(tmp_path / "f"), "host", 1)
    for n in (1, 2, 3):
        (tmp_path / f"t/pass-{n}").mkdir(parents=True)
    tables.commit_pass(spark, str(tmp_path / "t"), 3)
    assert tables.read_json(spark, str(tmp_path / "t/baseline.json")) == {"pass": 3}
    assert not (tmp_path / "t/pass-1").exists() and (tmp_path / "t/pass-2").exists()
    (tmp_path / "blob").write_bytes(b"abc")
    assert tables.digests(spark, str(tmp_path / "blob")).first()["sha256"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    with pytest.raises(ValueError):
        tables.scan_dir(spark, str(tmp_path / "t"))


def test_manifest_errors(spark):
    good = ("a/b.parquet", 5, 10, "0" * 64)
    shards = spark.createDataFrame([good, good, ("../x", 1, 0, "zz")], tables.SHARDS)
    got = {(r["path"], r["why"]) for r in tables.manifest_errors(shards, 11, 21).collect()}
    assert got == {("a/b.parquet", "listed twice"), ("../x", "unsafe path"), ("../x", "no bytes"), ("../x", "sha256"), (None, "totals")}


@pytest.mark.parametrize("cell, turns", [(20, 64), (2, 2), (4, 1)])
def test_interleaving_by_cells_matches_a_loop(spark, monkeypatch, cell, turns):
    monkeypatch.setattr(planning, "CELL", cell)
    monkeypatch.setattr(planning, "TURNS", turns)
    rng = random.Random(cell)
    rows = [(s, k, f"/d{rng.choice([0, 0, 0, 1, 2, k % 50])}/f{k}") for s in (0, 1, None) for k in rng.sample(range(1000), 300)]
    by = {}
    for s, k, p in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        by.setdefault(s, {}).setdefault(p.split("/")[1], []).append(k)
    want = {}
    for s, dirs in by.items():
        order = sorted((t, own[0], k) for own in dirs.values() for t, k in enumerate(own))
        want |= {(s, k): n + 1 for n, (_, _, k) in enumerate(order)}
    df = spark.createDataFrame(rows, "shard long, row_id long, path string").repartition(3)
    assert {(r["shard"], r["row_id"]): r["position"] for r in planning.interleave_by_parent(df).collect()} == want
    slots = {(r["shard"], r["row_id"]): r["slot"] for r in planning.placement(df, 4, (1,)).collect()}
    ids = {s: sorted(k for own in d.values() for k in own) for s, d in by.items()}
    assert slots == {(s, k): (0, 2, 3)[n % 3] for s, x in ids.items() for n, k in enumerate(x)}
