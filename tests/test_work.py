"""Holes of reads, frontiers of work lists and bucketed baselines against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from treediff.operators import diff, frontier, planning
from treediff.sources import baseline

READS = "file string, offset long, wanted long, length long"


def loop(reads, sizes):
    """Holes and delivered bytes by a byte map."""
    out = {}
    for f, size in sizes.items():
        own = [r for r in reads if r[0] == f]
        end = min([size] + [o for _, o, _, n in own if n == 0])
        have = set()
        for _, o, _, n in own:
            if o < end:
                have |= set(range(o, o + n))
        missing = [b for b in range(end) if b not in have]
        holes = []
        for b in missing:
            if holes and holes[-1][0] + holes[-1][1] == b:
                holes[-1][1] += 1
            else:
                holes.append([b, 1])
        first = missing[0] if missing else None
        got = max([o + n for _, o, _, n in own if n and o < end and (first is None or o < first)], default=0)
        out[f] = (end, got, len([b for b in have if first is not None and b >= first and b >= got]), first is None, [tuple(h) for h in holes])
    return out


@pytest.mark.parametrize("span", [planning.SPAN, 8])
def test_holes_match_a_byte_map(spark, span, monkeypatch):
    monkeypatch.setattr(planning, "SPAN", span)
    rng = random.Random(5)
    sizes = {f"f{k}": rng.choice([0, 1, 20, 60]) for k in range(25)}
    reads = []
    for f, size in sizes.items():
        for o in range(0, size, 5):
            if rng.random() < 0.8:
                reads += [(f, o, 5, rng.choice([5, 5, 5, 2, 3]))] * rng.choice([1, 1, 2])
        if rng.random() < 0.4:
            reads.append((f, rng.randrange(size + 5), 5, 0))
        if rng.random() < 0.3 and size:
            reads.append((f, rng.randrange(size), 9, 9))
    df, s = spark.createDataFrame(reads, READS), spark.createDataFrame(list(sizes.items()), "file string, size long")
    want = loop(reads, sizes)
    holes = {}
    for r in planning.gaps(df, s).orderBy("offset").collect():
        holes.setdefault(r["file"], []).append((r["offset"], r["length"]))
    got = {r["file"]: (r["end"], r["delivered"], r["buffered"], r["drained"], holes.get(r["file"], [])) for r in planning.delivered(df, s).collect()}
    assert got == want


def test_holes_deal_reads_out_without_joins(spark):
    """Rows of reads go by file and offset, then by file and span; a join in between would deal them out again."""
    s = spark.createDataFrame([("a", 150)], "file string, size long")
    df = spark.createDataFrame([("a", 0, 100, 100)], READS)
    for out in (planning.gaps(df, s), planning.delivered(df, s)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("Window") <= 4


@pytest.mark.parametrize("span", [planning.SPAN, 8])
def test_holes_of_files_unlisted_unnamed_or_of_no_size(spark, span, monkeypatch):
    monkeypatch.setattr(planning, "SPAN", span)
    s = spark.createDataFrame([(None, 16), ("none", None), ("cut", None), ("edge", 16), ("idle", 24)], "file string, size long")
    reads = [(None, 0, 8, 8), (None, 12, 4, 4), ("none", 0, 4, 4), ("cut", 8, 4, 4), ("cut", 12, 4, 0), ("edge", 0, 16, 16), ("edge", 16, 8, 8), ("gone", 0, 4, 4), ("gone", 2, 4, 0)]
    df = spark.createDataFrame(reads + [("edge", None, 8, 8)], READS)
    assert {tuple(r) for r in planning.gaps(df, s).collect()} == {(None, 8, 4), ("cut", 0, 8), ("idle", 0, 24)}
    got = {tuple(r) for r in planning.delivered(df, s).collect()}
    assert got == {(None, 16, 8, 4, False), ("none", None, 0, 0, True), ("cut", 12, 0, 4, False), ("edge", 16, 16, 0, True), ("idle", 24, 0, 0, False)}


def test_repeats_short_reads_and_ends(spark):
    s = spark.createDataFrame([("a", 150), ("b", 100), ("c", 0)], "file string, size long")
    df = spark.createDataFrame([("a", 0, 100, 100), ("a", 0, 100, 100), ("a", 100, 50, 50), ("b", 0, 50, 30), ("b", 50, 50, 0)], READS)
    assert [tuple(r) for r in planning.gaps(df, s).collect()] == [("b", 30, 20)]  # nothing at or beyond b's end at 50
    out = planning.contiguous_prefix(df.where("length > 0 and file = 'a'").drop("wanted"))
    assert [r["released"] for r in out.collect()] == [True] * 3
    late = spark.createDataFrame([("x", 0, 10), ("x", 20, 5), ("x", 5, 10), ("x", 25, 1)], "file string, offset long, length long")
    assert {r["offset"]: r["released"] for r in planning.contiguous_prefix(late).collect()} == {0: True, 5: True, 20: False, 25: False}


@pytest.mark.parametrize("block", [4, 16, frontier.BLOCK])
def test_runs_and_frontier_match_a_loop(spark, block):
    rng = random.Random(7)
    for trial in range(6):
        done = sorted({k for k in range(60) if rng.random() < rng.choice([0.3, 0.9, 1.0])} if trial else set())
        df = spark.createDataFrame([(k,) for k in done + done[:5]], "idx long")
        want = []
        for k in done:
            if want and want[-1][1] == k:
                want[-1][1] = k + 1
            else:
                want.append([k, k + 1])
        assert sorted((r["start"], r["end"]) for r in frontier.runs(df, block).collect()) == [tuple(x) for x in want]
        at, front = frontier.frontier(df, block).first(), next(k for k in range(61) if k not in set(done))
        issued = max(done, default=-1) + 1
        assert tuple(at) == (len(done), front, issued, issued - len(done))
        holes = [k for r in frontier.unfinished(df, block).collect() for k in range(r["start"], r["end"])]
        assert sorted(holes) == [k for k in range(issued) if k not in set(done)]


def test_an_interrupted_run_resumes_behind_its_last_note(spark, tmp_path):
    rows = spark.range(500).select(F.format_string("/f%05d", F.col("id")).alias("path"), F.col("id").alias("size"))
    work, out = f"{tmp_path}/work", f"{tmp_path}/out"
    assert frontier.write_work(rows, work) == 500
    listed = [(r["idx"], r["path"]) for r in frontier.read_work(spark, work).orderBy("idx").collect()]
    assert listed == [(k, f"/f{k:05d}") for k in range(500)]
    schema, read = "idx long, sha string", []
    for batch, part in enumerate((F.col("idx") < 200, F.col("idx") % 3 == 0)):
        left = frontier.resume(spark, work, frontier.recorded(spark, out, schema)).where(part)
        read += [r["idx"] for r in left.collect()]
        frontier.record(left.select("idx", F.sha2("path", 256).alias("sha")), out, batch)
    # a batch that was cut off: results without a note
    frontier.read_work(spark, work).limit(7).select("idx", F.lit("cut").alias("sha")).write.parquet(f"{out}/batch-0000000002")
    done = frontier.recorded(spark, out, schema)
    assert frontier.frontier(done).first()["frontier"] == 200
    left = frontier.resume(spark, work, done)
    assert "GreaterThanOrEqual(idx,200)" in left._jdf.queryExecution().executedPlan().toString()
    read += [r["idx"] for r in left.collect()]
    frontier.record(left.select("idx", F.sha2("path", 256).alias("sha")), out, 2)
    assert sorted(read) == list(range(500)) and frontier.recorded(spark, out, schema).count() == 500
    assert frontier.resume(spark, work, frontier.recorded(spark, out, schema)).count() == 0
    with pytest.raises(ValueError, match="shorter"):
        frontier.resume(spark, work, spark.createDataFrame([(600,)], "idx long"))
    part = next((tmp_path / "work").glob("part-*.parquet"))
    part.unlink()
    (tmp_path / "work" / f".{part.name}.crc").unlink()
    with pytest.raises(ValueError, match="torn"):
        frontier.read_work(spark, work)
    (tmp_path / "work.json").unlink()
    with pytest.raises(ValueError, match="never finished"):
        frontier.read_work(spark, work)


INDEX = "path binary, row_id long, size long, mtime_sec long, mtime_nsec int, file_type int"


def test_a_bucketed_baseline_is_not_shuffled(spark, tmp_path):
    n = baseline.buckets_for(spark, 0)
    rows = [(f"/f{k}".encode(), k, k % 5, k, 0, 1) for k in range(3000)]
    odd = spark.createDataFrame(rows, INDEX)
    one = odd.where(F.pmod(F.hash("path"), F.lit(n)) == 0)  # all of one bucket
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for k, base in enumerate((odd, one)):
            name = f"baseline_{k}"
            baseline.write_baseline(base, name, n, f"{tmp_path}/{name}")
            cur = base.where("row_id % 7 <> 0").withColumn("size", F.when(F.col("row_id") % 11 == 0, -1).otherwise(F.col("size"))).unionByName(odd.where("row_id < 5").withColumn("path", F.concat(F.lit(b"/new"), F.col("path"))))
            pending = base.where("row_id % 13 = 0").select("path")
            classes = diff.classify(baseline.read_baseline(spark, name), cur, pending)
            assert tuple(diff.class_counts(classes).first()) == tuple(diff.class_counts(diff.classify(base, cur, pending)).first())
            kept = diff.kept_rows(baseline.read_baseline(spark, name), cur, pending)
            assert kept.count() == diff.kept_rows(base, cur, pending).count()
            for df in (diff.classify(baseline.read_baseline(spark, name), cur), diff.kept_rows(baseline.read_baseline(spark, name), cur)):
                plan = df._jdf.queryExecution().executedPlan().toString()
                assert plan.count("Exchange") == 1 and "Bucketed: true" in plan  # the new side's
            spark.sql(f"DROP TABLE {name}")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
