"""The tree source over trees made here."""

import os
import socket

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treediff.operators import canonical, diff, schema
from treediff.sources import walk


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "t"
    for d in range(7):
        os.makedirs(root / f"d{d}/e/f")
        for k in range(d):
            (root / f"d{d}/e/f{k}").write_bytes(b"x" * k)
    os.makedirs(root / "d0/empty")
    (root / "d1/e/f/deep").write_bytes(b"deep")
    os.symlink(b"nowhere-\xff", os.fsencode(root / "link"))
    os.symlink("d1", root / "loop")
    os.mkfifo(root / "d2/fifo")
    with open(os.path.join(os.fsencode(root), b"odd-\xff"), "wb") as f:
        f.write(b"123")
    s = socket.socket(socket.AF_UNIX)
    here = os.getcwd()
    os.chdir(root)
    s.bind("sock")
    os.chdir(here)
    yield root
    s.close()


def plain(root):
    """All entries by the standard library's own walk."""
    found = [os.fsencode(root)]
    for d, dirs, names in os.walk(os.fsencode(root), followlinks=False):
        found += [os.path.join(d, n) for n in dirs + names]
    return sorted(found)


@pytest.mark.parametrize("tasks", [1, 3, 64])
def test_every_entry_once_whatever_the_number_of_tasks(spark, tree, tasks):
    got = walk.read_tree(spark, str(tree), tasks)
    assert sorted(bytes(r["path_bytes"]) for r in got.select("path_bytes").collect()) == plain(tree)
    c = walk.walk_counts(got).first()
    assert (c["symlink"], c["fifo"], c["socket"], c["vanished"], c["unreadable"]) == (2, 1, 1, 0, 0)
    assert c["entries"] == len(plain(tree)) and c["bytes"] == sum(os.lstat(p).st_size for p in plain(tree) if os.path.isfile(p) and not os.path.islink(p))


def test_a_walk_becomes_an_index_and_a_diff(spark, tree):
    def index():
        raw = walk.accept(walk.read_tree(spark, str(tree), 4))
        rows = canonical.canonicalise(raw, str(tree), F.lit(0), F.monotonically_increasing_id())
        return schema.conform(rows).persist()

    before = index()
    assert before.count() == len(plain(tree)) and before.where(F.col("path") == b"/link").first()["symlink_target"] == b"nowhere-\xff"
    assert schema.check_rows(before).where("corrupt_reason is not null").count() == 0
    (tree / "d1/e/f/deep").write_bytes(b"deeper")
    os.remove(tree / "d6/e/f5")
    (tree / "new").write_bytes(b"")
    got = {bytes(r["path"]).decode(errors="replace"): r["class"] for r in diff.classify(before, index()).where("class <> 'UNCHANGED'").collect()}
    assert got["/d1/e/f/deep"] == "DIRTY" and got["/d6/e/f5"] == "DELETED" and got["/new"] == "NEW"
    assert set(got) <= {"/d1/e/f/deep", "/d6/e/f5", "/new", "/", "/d6/e"}  # directories whose times have changed


def test_vanished_and_unreadable_are_told_apart(spark, tree, monkeypatch):
    gone, shut = os.fsencode(tree / "d3/e"), os.fsencode(tree / "d4/e")
    true = os.listdir

    def listdir(path):
        if path == gone:
            raise FileNotFoundError(2, "No such file or directory")
        if path == shut:
            raise PermissionError(13, "Permission denied")
        return true(path)

    monkeypatch.setattr(os, "listdir", listdir)
    rows = [r for d in (tree / "d3", tree / "d4") for r in walk.below(os.fsencode(d), True, 0)]
    assert {(r[1], r[17]) for r in rows if r[17]} == {(gone, "vanished"), (shut, "unreadable")}
    monkeypatch.undo()
    frame = lambda rows: spark.createDataFrame(pa.Table.from_batches([walk.TreeReader({"path": "/"})._batch(rows)]))
    kept = [r for r in rows if r[0] != str(tree / "d4/e") or r[17] is None]
    assert walk.accept(frame(kept)).count() == len([r for r in kept if r[17] is None])
    with pytest.raises(ValueError, match="d4/e: Permission denied"):
        walk.accept(frame(rows))


def test_a_listing_that_fails_once_is_tried_again(tree, monkeypatch):
    true, failed = os.listdir, []

    def listdir(path):
        if not failed:
            failed.append(path)
            raise OSError(5, "Input/output error")
        return true(path)

    monkeypatch.setattr(os, "listdir", listdir)
    assert len(list(walk.below(os.fsencode(tree / "d2"), True, 1))) == 5
    failed.clear()
    assert [r[17] for r in walk.below(os.fsencode(tree / "d2"), True, 0)] == ["unreadable"]


def test_a_missing_root_is_a_row_and_limits_stop_early(spark, tmp_path, tree):
    assert [(r["problem"], r["file_type"]) for r in walk.read_tree(spark, f"{tmp_path}/none").collect()] == [("vanished", None)] * 2
    assert walk.read_tree(spark, str(tree)).limit(3).count() == 3
    os.makedirs(tmp_path / "bare")
    assert walk.walk_counts(walk.read_tree(spark, f"{tmp_path}/bare")).first()["directory"] == 1
