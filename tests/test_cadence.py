"""Chunks by number and age, snapshots behind them, live views, archives and keep lists."""

import glob
import json
import os
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from treediff.functions import entries as E
from treediff.operators import events
from treediff.sources import keep, tables
from treediff.streaming import archive, cadence, log


def rows_of(spark, first, last, jobs=2):
    at = F.col("id")
    kind = F.when(at <= jobs, "JobCreated").otherwise("ProgressDelta")
    cols = {"seq": at, "at_us": at * 1000, "kind": kind, "job": F.concat(F.lit("j"), (at % jobs).cast("string")), "worker": F.lit("w"), "files": F.lit(1).cast("long"), "bytes": at}
    rows = spark.range(first, last + 1).select(*[c.alias(k) for k, c in cols.items()])
    for c in events.EVENTS.split(", "):
        name, kind = c.split()
        if name not in cols:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows.select(*cadence.NAMES)


def put(spark, folder, first, last, **k):
    rows_of(spark, first, last, **k).coalesce(1).write.mode("append").json(folder)


def until(test, seconds=60):
    end = time.time() + seconds
    while time.time() < end:
        if test():
            return True
        time.sleep(0.3)
    return False


def chunks(path):
    out = {}
    for f in glob.glob(f"{path}/job=*/start=*/*.txt"):
        job, start = f.split("/")[-3][4:], int(f.split("/")[-2][6:])
        assert (job, start) not in out
        out[job, start] = [json.loads(x)["seq"] for x in open(f)]
    return out


def test_chunks_are_cut_by_number_then_age_and_restarts_lose_nothing(spark, tmp_path):
    src, path, cp = f"{tmp_path}/src", f"{tmp_path}/log", f"file://{tmp_path}/cp"
    stream = lambda: log.stream_log(spark, src)
    put(spark, src, 1, 250)
    fails = [1]

    def crash():  # once, behind the first batch's chunks
        if fails and chunks(path):
            raise RuntimeError(fails.pop())

    q = cadence.write_log(stream(), path, cp, most=50, age_ms=3_600_000, after=crash)
    assert until(lambda: not q.isActive) and q.exception() is not None
    q = cadence.write_log(stream(), path, cp, most=50, age_ms=3_600_000)
    assert until(lambda: len(chunks(path)) == 4)
    put(spark, src, 251, 260)
    assert until(lambda: q.lastProgress and q.lastProgress["batchId"] >= 1 and cadence.buffered(spark, cp).count() == 60)
    q.stop()
    found = chunks(path)
    assert all(len(v) == 50 and v == sorted(v) and v[0] == k[1] for k, v in found.items())
    assert sorted(sum(found.values(), []) + [r["seq"] for r in cadence.buffered(spark, cp).collect()]) == list(range(1, 261))
    # what is open goes out by age after a restart
    q = cadence.write_log(stream(), path, cp, most=50, age_ms=1)
    put(spark, src, 261, 262)
    assert until(lambda: sum(map(len, chunks(path).values())) == 262)
    q.stop()
    assert Counter(sum(chunks(path).values(), [])) == Counter(range(1, 263))
    back = log.read_log(spark, path)
    assert [r["seq"] for r in back.collect()] == list(range(1, 263))
    assert log.read_log(spark, path, after=200, job="j1").where("seq <= 200").count() == 0


def test_snapshots_are_due_by_number_or_age(spark, tmp_path):
    path, root = f"{tmp_path}/log", f"{tmp_path}/snap"
    write = lambda a, b: cadence.write_cut(rows_of(spark, a, b).select(F.col("job").alias("route"), F.min("seq").over(__import__("pyspark.sql.window").sql.window.Window.partitionBy("job")).alias("start"), "seq", F.to_json(F.struct(*cadence.NAMES)).alias("event")), path)
    take = lambda now: cadence.keep_snapshots(spark, path, root, now, every=100, age_ms=5000, keep=2)
    write(1, 50)
    assert take(0) is None  # too few, too young
    assert take(4999) is None and take(5000) == 50
    assert take(20_000) is None  # nothing new
    write(51, 149)
    assert take(20_001) == 149  # by age, 99 events
    write(150, 249)
    assert take(20_002) == 249  # by number
    # cut off before it was whole: written anew
    os.makedirs(f"{root}/snapshot-{300:020d}/_temporary")
    write(250, 300)
    assert take(60_000) == 300
    assert len(tables.children(spark, root, "snapshot-*")) == 2
    state = tables.read_snapshot(spark, root, events.SNAPSHOTS)
    got = {r["job"]: (r["phase"], r["files_done"]) for r in events.replay(state, log.read_log(spark, path)).collect()}
    assert got == {r["job"]: (r["phase"], r["files_done"]) for r in events.fold_jobs(rows_of(spark, 1, 300)).collect()}


def test_a_client_sees_each_event_once_over_a_restart_and_a_resync_when_it_lags(spark, tmp_path):
    src, path, out, cp = f"{tmp_path}/src", f"{tmp_path}/log", f"{tmp_path}/out", f"{tmp_path}/cp"
    old = rows_of(spark, 1, 40)
    cadence.write_cut(old.where("seq <= 30").select(F.col("job").alias("route"), F.lit(1).alias("start"), "seq", F.to_json(F.struct(*cadence.NAMES)).alias("event")), path)
    tail = old.where("seq > 28").select(F.col("job").alias("route"), "seq", F.to_json(F.struct(*cadence.NAMES)).alias("event"))
    put(spark, src, 35, 60)  # the live rows begin below the catch-up's end
    start = lambda: cadence.subscribe(spark, path, log.stream_log(spark, src, 1), out, cp, since=10, most=100, tail=tail)
    q, seen = start(), lambda: [r["seq"] for r in cadence.frames_of(spark, out).where("frame = 'event'").collect()]
    assert until(lambda: len(seen()) >= 50)
    q.stop()
    assert seen() == list(range(11, 61))
    put(spark, src, 55, 70)
    q = start()
    assert until(lambda: len(seen()) >= 60)
    assert seen() == list(range(11, 71))
    put(spark, src, 71, 400)
    assert until(lambda: cadence.frames_of(spark, out).where("frame = 'resync'").count() == 1)
    q.stop()
    mark = cadence.frames_of(spark, out).where("frame = 'resync'").first()
    assert (mark["seq"], mark["skipped"]) == (301, 230) and seen() == [*range(11, 71), *range(301, 401)]
    assert {r["job"]: r["dropped"] for r in log.dropped(spark, cp).collect()} == {"j0": 3, "j1": 3}
    one = cadence.subscribe(spark, path, log.stream_log(spark, src), f"{out}1", f"{cp}1", since=0, job="j1")
    assert until(lambda: cadence.frames_of(spark, f"{out}1").where("seq > 350").count() > 0)
    one.stop()
    assert all(r["job"] == "j1" for r in cadence.frames_of(spark, f"{out}1").collect())


@pytest.mark.parametrize("crash", ["copy", "compare", "half"])
def test_an_archive_survives_a_crash_between_its_steps(spark, tmp_path, crash):
    path, there = f"{tmp_path}/log", f"{tmp_path}/archive"
    for start in (1, 11, 21):
        log.write_chunk(rows_of(spark, start, start + 9, jobs=1), path, start, "j0")
    log.write_chunk(rows_of(spark, 1, 5, jobs=1), path, 1, "other")
    whole = lambda: Counter(r["seq"] for p in (path, there) for r in log.read_log(spark, p, job="j0").collect())
    if crash == "half":
        archive.archive_job(spark, path, there, "j0", stop_after="compare")
        for f in glob.glob(f"{path}/job=j0/*11/part-*"):
            os.remove(f)
    else:
        archive.archive_job(spark, path, there, "j0", stop_after=crash)
    assert set(whole()) == set(range(1, 31))
    moved = archive.archive_jobs(spark, path, there, spark.createDataFrame([("j0",)], "job string"))
    assert moved["chunks"] >= 2 and not os.path.exists(f"{path}/job=j0") and os.path.exists(f"{path}/job=other")
    assert whole() == Counter(range(1, 31))
    assert archive.archive_job(spark, path, there, "j0") == {"chunks": 0, "bytes": 0}
    assert not glob.glob(f"{there}/**/*.tmp", recursive=True)


def test_keep_lists_prune_and_fail_on_bad_lengths(spark, tmp_path):
    rng = np.random.default_rng(3)
    ids = np.unique(np.concatenate([rng.integers(0, 3000, 400), np.arange(500, 900), (1 << 40) + rng.integers(0, 200_000, 50)])).astype("<u8")
    os.makedirs(f"{tmp_path}/k")
    (tmp_path / "k/a.keep").write_bytes(ids.tobytes())
    (tmp_path / "k/b.keep").write_bytes(b"")
    listed = keep.read_lists(spark, f"{tmp_path}/k")
    assert sorted(r["row_id"] for r in listed.collect()) == ids.tolist()
    keep.write_keep(listed.unionByName(listed.limit(7)), f"{tmp_path}/keep")
    kept = keep.read_keep(spark, f"{tmp_path}/keep")
    assert [x for r in kept.orderBy("start").collect() for x in range(r["start"], r["end"])] == ids.tolist()
    index = spark.range(300_000).select("id", F.when(F.col("id") < 5000, F.col("id")).otherwise((F.col("id") - 5000) + (1 << 40)).alias("row_id"), F.lit("x").alias("path"))
    index.repartitionByRange(4, "row_id").sortWithinPartitions("row_id").write.parquet(f"{tmp_path}/index")
    out = keep.delta(spark.read.parquet(f"{tmp_path}/index"), kept)
    assert sorted(r["row_id"] for r in out.collect()) == ids.tolist() and out.columns == ["id", "row_id", "path"]
    assert "GreaterThanOrEqual(row_id" in out._jdf.queryExecution().executedPlan().toString()
    cells = sorted({int(x) >> 16 for x in ids})
    held = sorted(keep.covering(kept))
    assert [c for a, b in held for c in range(a >> 16, b >> 16)] == cells and len(held) < len(cells) and len(keep.covering(kept, 1)) == 1
    assert keep.delta(spark.read.parquet(f"{tmp_path}/index"), keep.read_keep(spark, f"{tmp_path}/none")).count() == 0
    assert keep.read_lists(spark, f"{tmp_path}/none").count() == 0
    (tmp_path / "k/c.keep").write_bytes(b"1234567")
    with pytest.raises(Exception, match="no multiple of 8"):
        keep.read_lists(spark, f"{tmp_path}/k").count()
    (tmp_path / "k/c.keep").write_bytes(np.array([5, 4], "<u8").tobytes())
    with pytest.raises(Exception, match="isn't sorted"):
        keep.read_lists(spark, f"{tmp_path}/k").count()


def test_attribute_blobs(spark):
    def pack(*pairs):
        return b"".join(len(x).to_bytes(4, "big") + x for p in pairs for x in p)

    two = pack((b"user.a", b"1"), (b"\xff\x00", b""))
    cases = {
        None: (None, None), b"": ([], None), two: ([(b"user.a", b"1"), (b"\xff\x00", b"")], None), two[:-1]: ([(b"user.a", b"1")], "torn value length at byte 15"),
        b"\x00\x00": ([], "torn name length at byte 0"), b"\xff\xff\xff\xff" + b"x" * 20: ([], "name beyond the end at byte 0"), pack((b"n", b"v")) + b"\x00\x00\x00\x01n\x00\x00\x00\x09v": ([(b"n", b"v")], "value beyond the end at byte 10"),
        pack(*[(b"k%d" % k, b"v" * k) for k in range(40)]): ([(b"k%d" % k, b"v" * k) for k in range(40)], None),
    }
    df = spark.createDataFrame([(b,) for b in cases], "b binary").select("b", E.attributes(F.col("b")).alias("x"))
    for r in df.collect():
        want = cases[None if r["b"] is None else bytes(r["b"])]
        if r["b"] is None:
            assert r["x"] is None
        else:
            assert ([(bytes(a["name"]), bytes(a["value"])) for a in r["x"]["attrs"]], r["x"]["error"]) == want


def test_a_jobs_history_keeps_its_last_transitions(spark):
    n = events.HISTORY * 3
    rows = [(1, 1, "JobCreated"), (2, 2, "VerifyStarted")] + [(k, k, "JobPaused" if k % 2 else "JobResumed") for k in range(3, 3 + n)]
    log_ = spark.createDataFrame([(*r, "j") for r in rows], "seq long, at_us long, kind string, job string")
    for c in events.EVENTS.split(", "):
        name, kind = c.split()
        if name not in log_.columns:
            log_ = log_.withColumn(name, F.lit(None).cast(kind))
    got = events.fold_jobs(log_).first()
    assert got["transitions"] == n + 1 and len(got["history"].split(",")) == events.HISTORY
    assert got["history"].split(",")[-1] == f"{'Verifying>Paused' if (n + 2) % 2 else 'Paused>Verifying'}@{n + 2}"


def test_events_of_a_newer_schema_fail_the_reading(spark, tmp_path):
    rows_of(spark, 1, 3, jobs=1).withColumn("schema_version", F.when(F.col("seq") == 2, 2).otherwise(1)).coalesce(1).write.json(f"{tmp_path}/job=j0/{1:020d}")
    with pytest.raises(Exception, match="event of a newer schema: 2"):
        log.read_log(spark, str(tmp_path)).collect()


def test_silent_workers_are_told_once_by_the_clock(spark, tmp_path):
    src, told = f"{tmp_path}/src", []
    put(spark, src, 1, 4)
    q = log.silent(log.stream_log(spark, src), 3000).writeStream.foreachBatch(lambda b, _: told.extend(tuple(r) for r in b.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="1 second").start()
    assert until(lambda: told)
    time.sleep(2)
    q.stop()
    assert told == [("w", "no heartbeat for 3s")]


def test_progress_windows_sum_up_to_the_events(spark, tmp_path):
    src = f"{tmp_path}/src"
    put(spark, src, 1, 3000)
    q = log.progress(log.stream_log(spark, src), "1 second", "0 seconds").writeStream.outputMode("complete").format("memory").queryName("progress_now").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = spark.table("progress_now").collect()
    assert sum(r["files"] for r in rows) == 2998 and {r["window"]["start"].microsecond for r in rows} == {0} and len(rows) == 7


def test_chunks_that_come_out_of_order_are_counted_as_dropped(spark, tmp_path):
    src, seen = f"{tmp_path}/src", []
    start = lambda: log.follow(log.fresh(log.stream_log(spark, src)), lambda b, _: seen.extend(r["seq"] for r in b.collect()), f"{tmp_path}/cp")
    put(spark, src, 51, 60, jobs=1)
    start().awaitTermination(120)
    put(spark, src, 41, 55, jobs=1)
    put(spark, src, 61, 62, jobs=1)
    start().awaitTermination(120)
    assert sorted(seen) == list(range(51, 63))
    assert [tuple(r) for r in log.dropped(spark, f"{tmp_path}/cp").collect()] == [("j0", 62, 15)]
