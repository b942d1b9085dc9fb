"""Transfer plans: strategies, batches, orders, hardlinks, attribute steps, downgrades."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treediff.functions import entries as E

#: Fixed: sizes and depths by size class, and the budget of a batch.
IO_BUCKETS = {"small": (131072, 131072, 2, 2), "medium": (2097152, 2097152, 8, 8), "large": (4194304, 4194304, 32, 32)}
BATCH_FILES, BATCH_BYTES = 100_000, 8 << 30


def strategy(linked: Column) -> Column:
    """linked: another row of the shard has copied the row's inode already."""
    t = F.col("file_type")
    return (
        F.when((t == 1) & F.col("inode").isNotNull() & linked, "HardlinkExisting").when((t == 1) & (F.col("size") == 0), "Empty").when(t == 1, "LibnfsIoUring")
        .when(t == 3, "Symlink").when(t == 2, "DirAttrs").when(E.is_special(t), "SpecialNotCopied").otherwise("UnknownType")
    )


def io_bucket(size: Column) -> Column:
    """struct(name, rsize, wsize, read_depth, write_depth)."""
    name, out = E.size_class(size), None
    for k, (r, w, rd, wd) in IO_BUCKETS.items():
        s = F.struct(F.lit(k).alias("name"), F.lit(r).alias("rsize"), F.lit(w).alias("wsize"), F.lit(rd).alias("read_depth"), F.lit(wd).alias("write_depth"))
        out = F.when(name == k, s) if out is None else out.when(name == k, s)
    return out


def _batch_numbers(sizes: np.ndarray, files: int, budget: int, state: list[int]) -> np.ndarray:
    """Greedy batches of consecutive rows, a step for each batch; state: batch, rows in it, bytes in it, carried on."""
    out = np.empty(len(sizes), np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.float64 if sizes.sum(dtype=np.float64) > 2**62 else np.int64)])
    batch, n, used = state
    at = 0
    while at < len(sizes):
        # rows that still fit: by number, and by bytes; an empty batch takes its first row whatever its size
        to = min(at + files - n, int(np.searchsorted(ends, ends[at] + budget - used, "right")) - 1)
        if to <= at and n == 0:
            to = at + 1
        if to > at:
            out[at:to] = batch
            n, used = n + to - at, used + int(ends[to] - ends[at])
            at = to
        if at < len(sizes):
            batch, n, used = batch + 1, 0, 0
    state[:] = batch, n, used
    return out


def micro_batches(rows: DataFrame, files: int = BATCH_FILES, budget: int = BATCH_BYTES, shard: str = "shard", order: str = "row_id", size: str = "size") -> DataFrame:
    """(shard, row id, size, batch): a batch closes when it is full or the next row would exceed its bytes; a first row always fits.

    The cut depends on all earlier rows of the shard, so shards are dealt out and
    sorted, and each is read once from its start, with three numbers of state:
    rows stream through and no shard is held in memory.
    """
    schema = f"{shard} long, {order} long, {size} long, batch long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, [0, 0, 0]
        for df in batches:
            out = np.empty(len(df), np.int64)
            ids = df[shard].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1, [len(df)]]) if len(df) else np.array([0])
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if ids[s] != now:
                    now, state = ids[s], [0, 0, 0]
                out[s:e] = _batch_numbers(df[size].to_numpy()[s:e], files, budget, state)
            df["batch"] = out
            yield df

    own = rows.select(F.col(shard).cast("long").alias(shard), F.col(order).cast("long").alias(order), F.col(size).cast("long").alias(size))
    return own.repartition(shard).sortWithinPartitions(shard, order).mapInPandas(run, schema)


def batch_records(batches: DataFrame, shard: str = "shard", order: str = "row_id", size: str = "size") -> DataFrame:
    return batches.groupBy(shard, "batch").agg(F.min(order).alias("row_first"), F.max(order).alias("row_last"), F.count("*").alias("files"), F.sum(size).alias("bytes"))


#: Ids that one window orders at most, as a power of two; turns up to which a turn is cut by such cells.
CELL, TURNS = 20, 64


def _offsets(rows: DataFrame, by: list[str], cells: list[str], least: str | None = None) -> DataFrame:
    """For each (by, cells) of rows how many rows of `by` lie in the cells before it; with `least`, the smallest of that column over `by` as first."""
    whole = Window.partitionBy(*by)
    aggs = [F.count("*").alias("n"), *([F.min(least).alias("first")] if least else [])]
    out = rows.groupBy(*by, *cells).agg(*aggs)
    out = out.withColumn("before", F.sum("n").over(whole.orderBy(*cells).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    return (out.withColumn("first", F.min("first").over(whole)) if least else out).drop("n")


def _meet(rows: DataFrame, offsets: DataFrame, keys: list[str]) -> DataFrame:
    o = offsets.select(*[F.col(k).alias(f"o_{k}") for k in keys], *[c for c in offsets.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"o_{k}"))
    return rows.join(o, on).drop(*[f"o_{k}" for k in keys])


def row_numbers(rows: DataFrame, by: list[str], order: str, name: str) -> DataFrame:
    """row_number over `by` in the order of a column of unique longs, numbered in cells of its values: no window holds more than a cell of a group."""
    cut = rows.withColumn("cell", F.shiftright(order, CELL))
    cut = _meet(cut.withColumn(name, F.row_number().over(Window.partitionBy(*by, "cell").orderBy(order))), _offsets(cut, by, ["cell"]), [*by, "cell"])
    return cut.withColumn(name, (F.col("before") + F.col(name)).cast("long")).drop("cell", "before")


def interleave_by_parent(rows: DataFrame, shard: str = "shard", order: str = "row_id") -> DataFrame:
    """Rows with `position`: one of each directory in turn, directories in the order of their first rows.

    A row's turn is its number in its directory, by cells of ids. The final
    order, by turn and directory, is cut as well: a low turn by cells of the
    directories' first rows, higher ones into 64 parts each time they double (a
    directory has as many rows as its last turn says, so those parts hold a 64th
    of a shard at most). The cells' and parts' counts are added up over a shard.
    """
    by = [shard, "parent"]
    out = rows.withColumn("parent", E.parent_dir(F.col("path").cast("string"))).withColumn("cell", F.shiftright(order, CELL))
    turn = F.row_number().over(Window.partitionBy(*by, "cell").orderBy(order))
    out = _meet(out.withColumn("turn", turn), _offsets(out, by, ["cell"], order), [*by, "cell"])
    out = out.withColumn("turn", F.col("before") + F.col("turn")).drop("before", "cell")
    low, level = F.col("turn") < TURNS, F.floor(F.log2(F.col("turn").cast("double"))).cast("int")
    power = F.expr(f"shiftleft(1L, cast(floor(log2(cast(greatest(turn, {TURNS}) as double))) as int))")
    part = TURNS + (level - TURNS.bit_length() + 1) * 64 + F.floor((F.col("turn") - power) * 64 / power)
    out = out.withColumn("part", F.when(low, F.col("turn")).otherwise(part).cast("long")).withColumn("cell", F.when(low, F.shiftright("first", CELL)).otherwise(0))
    at = F.row_number().over(Window.partitionBy(shard, "part", "cell").orderBy("turn", "first"))
    out = _meet(out.withColumn("position", at), _offsets(out, [shard], ["part", "cell"]), [shard, "part", "cell"])
    return out.withColumn("position", (F.col("before") + F.col("position")).cast("int")).withColumn("turn", F.col("turn").cast("int")).drop("before", "part", "cell")


def deepest_first(rows: DataFrame, shard: str = "shard") -> DataFrame:
    """Directories with their depth and level: level 1 holds a shard's deepest ones. Levels are numbered over the depths, not over the rows."""
    out = rows.where("file_type = 2").withColumn("depth", E.depth(F.col("path").cast("string")))
    depths = out.groupBy(F.col(shard).alias("l_shard"), F.col("depth").alias("l_depth")).agg(F.count("*").alias("n")).drop("n")
    levels = depths.withColumn("level", F.row_number().over(Window.partitionBy("l_shard").orderBy(F.desc("l_depth"))))
    on = F.col(shard).eqNullSafe(F.col("l_shard")) & F.col("depth").eqNullSafe(F.col("l_depth"))
    return out.join(levels, on).drop("l_shard", "l_depth")


def hardlink_key() -> Column:
    links = F.coalesce(F.col("nlink"), F.lit(1)) > 1
    return F.when((F.col("file_type") == 1) & links & F.col("fsid").isNotNull() & F.col("inode").isNotNull(), F.struct("fsid", "inode"))


def hardlinks(rows: DataFrame, batch: str = "batch", order: str = "row_id", ok: Column | None = None) -> DataFrame:
    """Rows that share an inode in their batch, with the leader's id and path: the first row that was copied; the rest link to it.

    ok: whether a row's copy worked, all by default; where none did, the group has no leader.
    """
    ok = F.lit(True) if ok is None else ok
    w = Window.partitionBy(batch, "fsid", "inode")
    led = rows.where(hardlink_key().isNotNull()).withColumn("leader", F.min(F.when(ok, F.col(order))).over(w))
    return led.withColumn("leader_path", F.min_by(F.when(ok, F.col("path")), F.when(ok, F.col(order))).over(w)).withColumn("is_leader", F.col(order) == F.col("leader")).withColumn("group_size", F.count("*").over(w))


def placement(rows: DataFrame, connections: int, dead: tuple[int, ...] = (), order: str = "row_id", shard: str = "shard") -> DataFrame:
    """Round robin over the connections of a shard that aren't dead; ValueError where none is left."""
    live = [k for k in range(connections) if k not in dead]
    if not live:
        raise ValueError("no live connection")
    turn = F.pmod(F.col("_turn") - 1, F.lit(len(live)))
    return row_numbers(rows, [shard], order, "_turn").withColumn("slot", F.element_at(F.array(*map(F.lit, live)), turn.cast("int") + 1)).drop("_turn")


def batch_audit(batches: DataFrame, shard: str = "shard", order: str = "row_id", size: str = "size") -> DataFrame:
    """batch_records with the number of rows by strategy (as a map) and of failures; batches: with strategy and failed."""
    counts = batches.groupBy(shard, "batch", "strategy").agg(F.min(order).alias("a"), F.max(order).alias("z"), F.count("*").alias("n"), F.sum(size).alias("b"), F.count_if("failed").alias("f"))
    return counts.groupBy(shard, "batch").agg(
        F.min("a").alias("row_first"), F.max("z").alias("row_last"), F.sum("n").alias("files"), F.sum("b").alias("bytes"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("strategy", "n")))).alias("strategy_counts"), F.sum("f").alias("failures"),
    )


def copy_summary(shards: DataFrame, total: int, interrupted: bool = False) -> DataFrame:
    """One row over finished shards (files_ok, files_failed, torn, special, bytes_ok), with the state of the copy and its closing line."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("files_ok", "files_failed", "torn", "special", "bytes_ok")]
    state = F.when(F.lit(interrupted), "interrupted").when(F.col("shards_done") == total, "complete").otherwise("stopped")
    special = F.when(F.col("special") > 0, F.format_string(", %d special NOT copied", "special")).otherwise("")
    line = F.concat(F.format_string("%s: %d/%d shards, %d files ok (%d torn), %d failed", "state", "shards_done", F.lit(total), "files_ok", "torn", "files_failed"), special, F.format_string(", %d bytes moved", "bytes_ok"))
    return shards.agg(F.count("*").alias("shards_done"), *sums).withColumn("state", state).withColumn("line", line)


@dataclass(frozen=True)
class Policy:
    """Which attributes a copy carries over."""

    owner: bool = True
    mode: bool = True
    times: bool = True


def attributes(policy: Policy) -> dict[str, Column]:
    on = lambda flag, c: c if flag else F.lit(None)
    pair = lambda n: F.when(F.col(f"{n}_sec").isNotNull(), F.struct(F.col(f"{n}_sec").alias("sec"), F.coalesce(F.col(f"{n}_nsec"), F.lit(0)).alias("nsec")))
    return {"uid": on(policy.owner, F.col("uid")), "gid": on(policy.owner, F.col("gid")), "mode": on(policy.mode, F.col("mode").bitwiseAND(F.lit(E.PERMISSION_MASK).cast("long"))), "mtime": on(policy.times, pair("mtime")), "atime": on(policy.times, pair("atime"))}


def attribute_plan(rows: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(row_id, step, op, argument): chown where both ids are known, chmod, utimes where mtime is; atime is mtime where it isn't known."""
    a = attributes(policy)
    text = lambda t: F.concat(t["sec"].cast("string"), F.lit("."), F.lpad(t["nsec"].cast("string"), 9, "0"))
    step = lambda op, when, arg: F.when(when, F.struct(F.lit(op).alias("op"), arg.alias("argument")))
    steps = []
    if policy.owner:
        steps.append(step("chown", a["uid"].isNotNull() & a["gid"].isNotNull(), F.concat_ws(":", a["uid"].cast("string"), a["gid"].cast("string"))))
    if policy.mode:
        steps.append(step("chmod", a["mode"].isNotNull(), E.mode_text(F.col("mode"))))
    if policy.times:
        steps.append(step("utimes", a["mtime"].isNotNull(), F.concat_ws("/", text(F.coalesce(a["atime"], a["mtime"])), text(a["mtime"]))))
    plan = F.filter(F.array(*steps), lambda x: x.isNotNull())
    return rows.select("row_id", F.posexplode(plan).alias("step", "x")).select("row_id", "step", "x.op", "x.argument")


def downgrades(rows: DataFrame, policy: Policy = Policy(), shard: str = "shard") -> DataFrame:
    """(row_id, kind): what a copy of a row can't keep, as far as the row and the policy tell.

    FSID_UNGROUPED is reported once a shard, for its first such row.
    """
    kind = lambda k, when: F.when(when, F.lit(k))
    copied = ~E.is_special(F.col("file_type"))
    link = F.col("file_type") == 3
    sec = lambda n: F.col(f"{n}_sec")
    found = F.array(
        kind("SPECIAL_NOT_COPIED", ~copied),
        kind("NULL_OWNER", F.lit(policy.owner) & copied & (F.col("uid").isNull() | F.col("gid").isNull())),
        kind("NULL_MTIME", F.lit(policy.times) & copied & sec("mtime").isNull()),
        kind("NULL_ATIME", F.lit(policy.times) & copied & sec("mtime").isNotNull() & sec("atime").isNull()),
        kind("SYMLINK_MODE_NFSV3", F.lit(policy.mode) & link & (F.col("mode").bitwiseAND(F.lit(E.PERMISSION_MASK).cast("long")) != 0o777)),
    )
    each = rows.select("row_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("kind"))
    loose = (F.col("file_type") == 1) & (F.coalesce(F.col("nlink"), F.lit(1)) > 1) & F.col("inode").isNotNull() & F.col("fsid").isNull()
    first = rows.where(loose).groupBy(shard).agg(F.min("row_id").alias("row_id")).select("row_id", F.lit("FSID_UNGROUPED").alias("kind"))
    return each.unionByName(first)


def copy_downgrades(results: DataFrame, unchanged_size: bool = False) -> DataFrame:
    """(row_id, kind) of finished copies; results: row_id, size, bytes_copied, pre, post (structs of size, mtime, ctime), symlink_times_refused."""
    short = F.col("bytes_copied") < F.col("size")
    found = F.array(
        F.when(F.lit(unchanged_size) & (F.col("bytes_copied") != F.col("size")), "SIZE_CHANGED"),
        F.when(F.lit(not unchanged_size) & short, "EARLY_EOF"),
        F.when(~F.col("pre").eqNullSafe(F.col("post")), "TORN_COPY"),
        F.when(F.col("symlink_times_refused"), "SYMLINK_TIME_NFSV3"),
    )
    return results.select("row_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("kind"))


def outcomes(results: DataFrame, *by: str) -> DataFrame:
    """Counts of copy results, by shard or whatever is named; outcome: ok, failed, fenced, special. Torn copies are among the ok ones; only those have bytes."""
    of = lambda k: F.count_if(F.col("outcome") == k)
    return results.groupBy(*by).agg(of("ok").alias("files_ok"), of("failed").alias("files_failed"), of("fenced").alias("files_fenced"), of("special").alias("special"), F.count_if((F.col("outcome") == "ok") & F.col("torn")).alias("torn"), F.coalesce(F.sum(F.when(F.col("outcome") == "ok", F.col("bytes"))), F.lit(0)).alias("bytes_ok"))


#: Bytes of a file whose reads are ordered in one window.
SPAN = 1 << 36


def _intervals(reads: DataFrame, file: str) -> DataFrame:
    """Reads with bytes (file, offset, length), each offset once with its longest read, and `before`: how far the reads before it reach.

    The running maximum is taken within spans of a file, then over the spans'
    maxima, so a file of any number of reads is no single task's.
    """
    span = F.floor(F.col("offset") / SPAN).cast("long")
    one = reads.where("length > 0").groupBy(file, "offset").agg(F.max("length").alias("length")).withColumn("span", span)
    within = Window.partitionBy(file, "span").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    one = one.withColumn("here", F.max(F.col("offset") + F.col("length")).over(within))
    spans = one.groupBy(F.col(file).alias("s_file"), F.col("span").alias("s_span")).agg(F.max(F.col("offset") + F.col("length")).alias("top"))
    earlier = Window.partitionBy("s_file").orderBy("s_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("earlier", F.max("top").over(earlier)).drop("top")
    on = F.col(file).eqNullSafe(F.col("s_file")) & (F.col("span") == F.col("s_span"))
    before = F.greatest(F.coalesce("here", F.lit(0)), F.coalesce("earlier", F.lit(0)))
    return one.join(spans, on).select(file, "offset", "length", before.alias("before"))


def _span(offset: str) -> Column:
    return F.floor(F.col(offset) / SPAN).cast("long")


def _held(reads: DataFrame, sizes: DataFrame, file: str) -> DataFrame:
    """(file, offset, top, before, end, is_end): reads with bytes that begin before their file's end, each offset once, and for each file one row at its end.

    top: where a read ends; before: how far the file's reads before the row reach,
    which at the end's row is how far all reach; end: the size, or where a read
    found the file's end before it (length 0). No joins: the spans' ends and
    what lies before them are put first among the span's reads, so rows are
    dealt out by file and span alone, and a file of any number of reads is no
    single task's. sizes has one row for each file.
    """
    none = F.lit(None).cast("long")
    seen = reads.select(file, _span("offset").alias("span"), F.when(F.col("length") > 0, F.col("offset") + F.col("length")).alias("top"), F.when(F.col("length") == 0, F.col("offset")).alias("end"), F.lit(False).alias("listed"))
    listed = sizes.select(file, none.alias("span"), none.alias("top"), F.col("size").alias("end"), F.lit(True).alias("listed"))
    spans = seen.unionByName(listed).groupBy(file, "span").agg(F.max("top").alias("top"), F.min("end").alias("end"), F.max("listed").alias("listed"))
    of_file = Window.partitionBy(file)
    spans = spans.withColumn("end", F.min("end").over(of_file)).withColumn("known", F.max("listed").over(of_file)).where("known")
    spans = spans.withColumn("span", F.when(F.col("listed"), _span("end")).otherwise(F.col("span")))
    spans = spans.withColumn("earlier", F.max("top").over(of_file.orderBy("span").rangeBetween(Window.unboundedPreceding, -1)))
    firsts = spans.select(file, "span", F.when(F.col("listed"), F.col("end")).alias("offset"), none.alias("top"), "earlier", "end", F.when(F.col("listed"), 1).otherwise(0).alias("part"))
    longest = reads.where("length > 0").groupBy(file, "offset").agg(F.max("length").alias("length"))
    rows = longest.select(file, _span("offset").alias("span"), "offset", (F.col("offset") + F.col("length")).alias("top"), none.alias("earlier"), none.alias("end"), F.lit(2).alias("part"))
    order = Window.partitionBy(file, "span").orderBy("offset", "part")  # a span's first row has no offset
    reach = F.max(F.greatest("top", "earlier")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = firsts.unionByName(rows).withColumn("before", F.greatest(reach, "earlier", F.lit(0).cast("long"))).withColumn("end", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    is_end = F.col("part") == 1
    return rows.where(is_end | ((F.col("part") == 2) & (F.col("offset") < F.col("end")))).select(file, "offset", "top", "before", "end", is_end.alias("is_end"))


def gaps(reads: DataFrame, sizes: DataFrame, file: str = "file") -> DataFrame:
    """(file, offset, length) that is still to be read, in as few rows as there are holes.

    reads: file, offset, wanted, length (bytes that came; 0: the file's end lay at
    or before the offset), in any order, repeats and overlaps included; sizes:
    file, size. A short read leaves the rest of what it wanted; a range that was
    never asked for is a hole as well; nothing at or beyond the file's end is
    asked for again. Files without reads are whole holes, empty ones none.
    """
    missing = _held(reads, sizes, file).where(F.col("offset") > F.col("before"))
    return missing.select(file, F.col("before").alias("offset"), (F.col("offset") - F.col("before")).alias("length"))


def delivered(reads: DataFrame, sizes: DataFrame, file: str = "file") -> DataFrame:
    """(file, end, delivered, buffered, drained): bytes that can be written in order, bytes that wait behind a hole, and whether the file is done.

    A read that begins before the file's end and crosses it counts whole, as its
    bytes were there when they were read.
    """
    fresh = F.greatest(F.lit(0), F.col("top") - F.greatest("offset", "before"))
    hole, reach = F.min(F.when(F.col("offset") > F.col("before"), F.col("before"))), F.max(F.when(F.col("is_end"), F.col("before")))
    sums = _held(reads, sizes, file).groupBy(file).agg(F.max("end").alias("end"), hole.alias("hole"), reach.alias("reach"), F.coalesce(F.sum(F.when(~F.col("is_end"), fresh)), F.lit(0)).alias("held"))
    sums = sums.withColumn("delivered", F.coalesce("hole", "reach"))
    # up to the first hole, or to the last read's end, every byte is held once
    return sums.select(file, "end", "delivered", (F.col("held") - F.col("delivered")).alias("buffered"), F.col("hole").isNull().alias("drained"))


def contiguous_prefix(chunks: DataFrame, file: str = "file") -> DataFrame:
    """Chunks (file, offset, length) with `released`: all bytes before them are there. Repeats and overlaps change nothing."""
    held = _intervals(chunks, file)
    hole = held.where(F.col("offset") > F.col("before")).groupBy(F.col(file).alias("h_file")).agg(F.min("before").alias("hole"))
    rows = chunks.join(hole, F.col(file).eqNullSafe(F.col("h_file")), "left").drop("h_file")
    return rows.withColumn("released", F.col("hole").isNull() | (F.col("offset") <= F.col("hole"))).drop("hole")
