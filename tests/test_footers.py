"""Footers, stamped shards and the resumable rewrite, over files made here."""

import json
import os
import time
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from treediff.operators.schema import CANONICAL
from treediff.sources import files, footers, rewrite, tables


def shard(path, rows=3, stamps=None, drop=(), first=0):
    t = pa.table({"row_id": pa.array(range(first, first + rows), pa.int64()), "path": [f"/f{k}".encode() for k in range(rows)], "size": [1] * rows, "mode": pa.array([0o100644] * rows, pa.int64()), "file_type": pa.array([1] * rows, pa.int16())})
    stamps = {"format_version": "1", "contract_version": "1", "shard_index": "0", "row_count": str(rows)} if stamps is None else stamps
    t = t.drop_columns(list(drop)).replace_schema_metadata({footers.STAMPS[k]: v for k, v in stamps.items()})
    os.makedirs(os.path.dirname(path), exist_ok=True)
    pq.write_table(t, path, row_group_size=2)


@pytest.fixture
def viewed(spark):
    """A scheme that only Spark's readers know."""
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.impl.disable.cache", "true")
    yield lambda folder: conf.set("fs.viewfs.mounttable.store.link./in", f"file://{folder}") or "viewfs://store/in"


GOOD = {"format_version": "1", "contract_version": "1", "row_count": "3"}


@pytest.mark.parametrize(
    "stamps, drop, want",
    [
        (GOOD, (), set()),
        (GOOD | {"format_version": "2"}, (), {("error", "format version 2")}),
        (GOOD | {"format_version": "one"}, (), {("error", "format version one")}),
        ({"contract_version": "1"}, (), {("warning", "no format version")}),
        (GOOD | {"contract_version": "9"}, (), {("warning", "contract version 9")}),
        (GOOD | {"contract_version": "x"}, (), set()),
        (GOOD | {"row_count": "4"}, (), {("warning", "stamped with rows: 4, has 3")}),
        (GOOD, ("mode", "path"), {("error", "column missing: mode"), ("error", "column missing: path")}),
    ],
)
def test_each_stamp_is_checked(spark, tmp_path, viewed, stamps, drop, want):
    shard(f"{tmp_path}/i/a.parquet", stamps=stamps, drop=drop)
    for root in (f"{tmp_path}/i", viewed(f"{tmp_path}/i")):
        found = footers.footer_findings(footers.read_footers(spark, root)).collect()
        assert {(r["severity"], r["why"]) for r in found} == want
    if any(s == "error" for s, _ in want):
        with pytest.raises(ValueError, match=sorted(w for s, w in want if s == "error")[0]):
            footers.open_index(spark, f"{tmp_path}/i")
    else:
        index, warnings = footers.open_index(spark, f"{tmp_path}/i")
        assert index.count() == 3 and warnings.count() == len(want)


def test_footers_have_rows_groups_and_errors_without_reading_pages(spark, tmp_path, viewed):
    shard(f"{tmp_path}/i/a.parquet", rows=5, first=(7 << 40))
    shard(f"{tmp_path}/i/b.parquet", rows=0)
    (tmp_path / "i/c.parquet").write_bytes(b"no footer here")
    (tmp_path / "i/d.parquet").write_bytes(b"")
    # pages overwritten: the footer still stands
    whole = bytearray((tmp_path / "i/a.parquet").read_bytes())
    whole[4:40] = b"\xff" * 36
    (tmp_path / "i/e.parquet").write_bytes(whole)
    for root in (f"{tmp_path}/i", viewed(f"{tmp_path}/i")):
        found = {r["path"][-9:-8]: r for r in footers.read_footers(spark, root).collect()}
        found = {os.path.basename(r["path"])[0]: r for r in found.values()}
        assert footers.read_footers(spark, root).count() == 5 and len(found) == 5 and found["a"]["rows"] == found["e"]["rows"] == 5 and found["b"]["rows"] == 0
        assert [(g["rows"], g["first_id"], g["last_id"]) for g in found["a"]["groups"]] == [(2, 7 << 40, (7 << 40) + 1), (2, (7 << 40) + 2, (7 << 40) + 3), (1, (7 << 40) + 4, (7 << 40) + 4)]
        assert found["c"]["error"] and found["d"]["error"] and found["a"]["error"] is None
        wrong = {os.path.basename(r["path"]): (r["stamped"], r["first_id"]) for r in footers.wrong_shards(footers.read_footers(spark, root)).collect()}
        assert wrong == {"a.parquet": (0, 7 << 40), "e.parquet": (0, 7 << 40)}
    with pytest.raises(ValueError, match="unreadable"):
        footers.open_index(spark, f"{tmp_path}/i")


def test_digests_of_a_store_without_streams(spark, tmp_path, viewed):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x").write_bytes(b"abc")
    a, b = ([(r["sha256"], r["bytes"], r["error"]) for r in files.digests(spark, root).collect()] for root in (f"{tmp_path}/d", viewed(f"{tmp_path}/d")))
    assert a == b and a[0][1:] == (3, None)
    manifest = spark.createDataFrame([("x", 0, 3, a[0][0])], tables.SHARDS)
    with pytest.raises(ValueError, match="viewfs"):
        files.store_of("viewfs://store/in/x")
    assert manifest.count() == 1


RAW = "path string, file_type string, permissions int, size long, mtime_us long, uid int, gid int, nlink int, inode long"


def scan(spark, folder, parts=3, rows=4):
    for p in range(parts):
        data = [(f"/r/p{p}/f{k}", "file", 0o644, k, 1_700_000_000_000_002, 1, 2, 1, k) for k in range(rows)]
        os.makedirs(folder, exist_ok=True)
        pq.write_table(pa.Table.from_pylist([dict(zip([c.split()[0] for c in RAW.split(", ")], r)) for r in data], schema=pa.schema([("path", pa.string()), ("file_type", pa.string()), ("permissions", pa.int32()), ("size", pa.int64()), ("mtime_us", pa.int64()), ("uid", pa.int32()), ("gid", pa.int32()), ("nlink", pa.int32()), ("inode", pa.int64())])), f"{folder}/part-{p:05d}.parquet", row_group_size=3)


def times(out):
    return {p.name: p.stat().st_mtime_ns for p in Path(out).glob("*.parquet")}


def test_rewrite_stamps_and_orders_shards(spark, tmp_path):
    scan(spark, f"{tmp_path}/in")
    scan(spark, f"{tmp_path}/empty", 1, 0)
    os.rename(f"{tmp_path}/empty/part-00000.parquet", f"{tmp_path}/in/part-00009.parquet")
    report = rewrite.rewrite(spark, f"{tmp_path}/in", f"{tmp_path}/out", "/r", "w1")
    assert (report["complete"], report["shards"], report["total_rows"]) == (True, 4, 12)
    for n, name in enumerate(("part-00000", "part-00001", "part-00002", "part-00009")):
        t = pq.read_table(f"{tmp_path}/out/{name}.parquet")
        assert t["row_id"].to_pylist() == [(n << 40) | k for k in range(t.num_rows)] and t.column_names == CANONICAL.names
        meta = pq.read_metadata(f"{tmp_path}/out/{name}.parquet").metadata
        assert meta[b"migration.shard_index"] == str(n).encode() and meta[b"migration.row_count"] == str(t.num_rows).encode() and meta[b"migration.walker_version"] == b"w1"
    assert footers.footer_findings(footers.read_footers(spark, f"{tmp_path}/out")).count() == 0
    index, _ = footers.open_index(spark, f"{tmp_path}/out")
    assert index.count() == 12 and index.where(F.col("path") == b"/p1/f3").count() == 1
    with pytest.raises(ValueError, match="isn't empty"):
        rewrite.rewrite(spark, f"{tmp_path}/in", f"{tmp_path}/out", "/r", "w1")


def test_rewrite_resumes_valid_shards_and_repairs_broken_ones(spark, tmp_path):
    scan(spark, f"{tmp_path}/in")
    again = lambda **k: rewrite.rewrite(spark, f"{tmp_path}/in", f"{tmp_path}/out", "/r", "w1", resume=True, **k)
    assert again(only=1)["complete"] is False and len(times(f"{tmp_path}/out")) == 1
    first = times(f"{tmp_path}/out")
    assert again()["complete"] is True
    whole = times(f"{tmp_path}/out")
    assert len(whole) == 3 and first.items() <= whole.items()
    # all valid, a leftover partial: nothing is written, the partial goes
    (tmp_path / "out/part-00001.parquet.0f.partial").write_bytes(b"stale")
    time.sleep(0.02)
    again()
    assert times(f"{tmp_path}/out") == whole and not list((tmp_path / "out").glob("*.partial"))
    # broken by size, by bytes, and gone
    size = os.path.getsize(f"{tmp_path}/out/part-00000.parquet")
    with open(f"{tmp_path}/out/part-00000.parquet", "ab") as f:
        f.write(b"corrupt")
    body = bytearray((tmp_path / "out/part-00001.parquet").read_bytes())
    body[10] ^= 1
    (tmp_path / "out/part-00001.parquet").write_bytes(body)
    os.remove(f"{tmp_path}/out/part-00002.parquet")
    assert again()["total_rows"] == 12 and os.path.getsize(f"{tmp_path}/out/part-00000.parquet") == size
    # an input that has changed is rewritten alone
    whole = times(f"{tmp_path}/out")
    scan(spark, f"{tmp_path}/more", 1, 6)
    os.replace(f"{tmp_path}/more/part-00000.parquet", f"{tmp_path}/in/part-00000.parquet")
    assert again()["total_rows"] == 14
    now = times(f"{tmp_path}/out")
    assert now["part-00000.parquet"] != whole["part-00000.parquet"] and now["part-00001.parquet"] == whole["part-00001.parquet"]
    # a part that the scan no longer has
    os.remove(f"{tmp_path}/in/part-00002.parquet")
    with pytest.raises(ValueError, match="strange|unexpected|no longer"):
        again()


def test_rewrite_refuses_strange_entries_and_other_reports(spark, tmp_path):
    scan(spark, f"{tmp_path}/in", 1)
    os.makedirs(f"{tmp_path}/out")
    (tmp_path / "out/operator-notes.txt").write_text("do not overwrite")
    with pytest.raises(ValueError, match="unexpected entry"):
        rewrite.rewrite(spark, f"{tmp_path}/in", f"{tmp_path}/out", "/r", "w1", resume=True)
    os.remove(f"{tmp_path}/out/operator-notes.txt")
    rewrite.rewrite(spark, f"{tmp_path}/in", f"{tmp_path}/out", "/r", "w1", resume=True)
    with pytest.raises(ValueError, match="another rewrite"):
        rewrite.rewrite(spark, f"{tmp_path}/in", f"{tmp_path}/out", "/r", "w2", resume=True)
    assert json.loads((tmp_path / "out/rewrite-report.json").read_text())["complete"] is True


def test_a_failing_part_leaves_the_others_committed_and_no_partial(spark, tmp_path):
    scan(spark, f"{tmp_path}/in", 2)
    bad = pq.read_table(f"{tmp_path}/in/part-00001.parquet").to_pylist()
    bad[2]["path"] = "/elsewhere"
    pq.write_table(pa.Table.from_pylist(bad, schema=pq.read_schema(f"{tmp_path}/in/part-00001.parquet")), f"{tmp_path}/in/part-00001.parquet")
    with pytest.raises(Exception, match="outside the root"):
        rewrite.rewrite(spark, f"{tmp_path}/in", f"{tmp_path}/out", "/r", "w1")
    assert "part-00001.parquet" not in times(f"{tmp_path}/out")
    report = tables.read_json(spark, f"{tmp_path}/out/rewrite-report.json")
    assert report["complete"] is False


WHO = {"run_id": "r1", "source": "nfs://a/x", "dest": "nfs://b/y"}


def test_a_manifest_is_checked_whole(spark, tmp_path):
    work = f"{tmp_path}/work"
    assert tables.load_manifest(spark, work) is None
    for k in range(3):
        shard(f"{work}/shards/s{k}.parquet", rows=k, first=k << 40)
    tables.write_manifest(spark, work, WHO, tables.shards_of(spark, f"{work}/shards"))
    value, shards = tables.load_manifest(spark, work, WHO, f"{work}/shards")
    assert (value["shards"], value["total_rows"]) == (3, 3) and {r["path"]: r["rows"] for r in shards.collect()} == {"s0.parquet": 0, "s1.parquet": 1, "s2.parquet": 2}
    for key in WHO:
        with pytest.raises(ValueError, match=f"manifest's {key}"):
            tables.load_manifest(spark, work, WHO | {key: "other"})
    shard(f"{work}/shards/s1.parquet", rows=2)
    with pytest.raises(ValueError, match="s1.parquet: digest"):
        tables.load_manifest(spark, work, WHO, f"{work}/shards")
    os.remove(f"{work}/shards/s1.parquet")
    with pytest.raises(ValueError, match="s1.parquet: absent"):
        tables.load_manifest(spark, work, WHO, f"{work}/shards")
    good = [("a", 2**62, 5, "0" * 64), ("b", 2**62, 5, "f" * 64)]
    why = lambda rows, r, b: {x["why"] for x in tables.manifest_errors(spark.createDataFrame(rows, tables.SHARDS), r, b).collect()}
    assert why(good, 2**63, 10) == {"totals overflow"} and why(good[:1], 2**62, 5) == set() and why([], 0, 0) == {"no shards"}
    tables.write_json(spark, f"{work}/manifest.json", value | {"format_version": 9})
    with pytest.raises(ValueError, match="format version 9"):
        tables.load_manifest(spark, work)


def test_failed_passes_go_aside_and_scans_go_once_a_manifest_stands(spark, tmp_path):
    for k in (1, 2, 3):
        spark.range(1).write.parquet(f"{tmp_path}/pass-{k}/index")
    os.makedirs(f"{tmp_path}/scan/scans")
    aside = tables.fail_pass(spark, str(tmp_path), 3, "20260101T000000Z")
    assert not os.path.exists(f"{tmp_path}/pass-3") and os.path.exists(f"{aside}/index")
    spark.range(1).write.parquet(f"{tmp_path}/pass-3/index")
    tables.commit_pass(spark, str(tmp_path), 3)
    assert sorted(os.listdir(tmp_path)) == sorted(["baseline.json", ".baseline.json.crc", os.path.basename(aside), "pass-2", "pass-3", "scan"]) or os.path.exists(aside)
    with pytest.raises(ValueError, match="no manifest"):
        tables.purge_scan(spark, str(tmp_path))
    tables.write_json(spark, f"{tmp_path}/manifest.json", {})
    assert tables.purge_scan(spark, str(tmp_path)) and not tables.purge_scan(spark, str(tmp_path)) and not os.path.exists(f"{tmp_path}/scan")


def test_two_digests_in_one_reading(spark, tmp_path, viewed):
    import hashlib

    import xxhash

    (tmp_path / "d").mkdir()
    body = {"x": b"abc" * 1000, "empty": b""}
    for k, v in body.items():
        (tmp_path / "d" / k).write_bytes(v)
    for root in (f"{tmp_path}/d", viewed(f"{tmp_path}/d")):
        got = {os.path.basename(r["path"]): (r["sha256"], r["xxh3_128"], r["bytes"], r["error"]) for r in files.content_hashes(spark, root).collect()}
        assert files.content_hashes(spark, root).count() == files.listed(spark, root).count() == 2
        assert got == {k: (hashlib.sha256(v).hexdigest(), xxhash.xxh3_128_hexdigest(v), len(v), None) for k, v in body.items()}
