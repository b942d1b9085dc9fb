"""The event log as it is written and followed: chunks cut by number and age, snapshots behind them, and a live view for a client."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from treediff.operators import events as ev
from treediff.sources import tables
from treediff.streaming import log

#: Fixed: events and age at which a chunk is cut and a snapshot is due.
MOST_EVENTS, MOST_AGE_MS = 1000, 300_000
#: Fixed: live events that may wait for a client before it has to start over.
BUS = 1024
#: The route of events that belong to no job.
CLUSTER = "_cluster"
NAMES = [c.split()[0] for c in ev.EVENTS.split(", ")]
CUT = "route string, start long, cut string, seq long, event string"


def cut_chunks(events: DataFrame, most: int = MOST_EVENTS, age_ms: int = MOST_AGE_MS) -> DataFrame:
    """Events by chunk: route, start (the chunk's first seq), cut (full or age), seq, event (JSON).

    A route's chunk stays open until it has `most` events, or until its first
    event has waited for `age_ms`; what is open lies in the state (under `most`
    events a route) and so outlives a restart. A route's events come in order of
    seq; repeats change nothing.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, opened, mark = state.get if state.exists else ("[]", None, -1)
        held, now, out = json.loads(held), state.getCurrentProcessingTimeMs(), []

        def cut(rows: list, why: str) -> None:
            out.extend((key[0], rows[0][0], why, seq, event) for seq, event in rows)

        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values("seq").drop_duplicates("seq")
            for seq, event in zip(rows["seq"].tolist(), rows["event"].tolist()):
                if seq > mark:
                    if not held:
                        opened = now
                    held.append((seq, event))
                    mark = seq
                    if len(held) >= most:
                        cut(held, "full")
                        held = []
        if held and now - opened >= age_ms:
            cut(held, "age")
            held = []
        state.update((json.dumps(held), opened if held else None, mark))
        if held:
            state.setTimeoutDuration(max(1, opened + age_ms - now))
        if out:
            yield pd.DataFrame(out, columns=["route", "start", "cut", "seq", "event"])

    rows = events.select(F.coalesce("job", F.lit(CLUSTER)).alias("route"), "seq", F.to_json(F.struct(*NAMES)).alias("event"))
    return rows.groupBy("route").applyInPandasWithState(step, CUT, "held string, opened long, mark long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def write_cut(chunks: DataFrame, path: str) -> None:
    """One file a chunk, in a folder named by route and first seq: a batch that runs again writes the same ones over themselves."""
    rows = chunks.select(F.col("route").alias("job"), F.lpad(F.col("start").cast("string"), 20, "0").alias("start"), "seq", F.col("event").alias("value"))
    rows = rows.repartition("job", "start").sortWithinPartitions("job", "start", "seq").select("value", "job", "start")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job", "start").text(path)


def buffered(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(route, seq, event) of the events that no chunk has yet, from the state of the stream that cuts them."""
    held = spark.read.format("statestore").load(checkpoint).select("key.route", F.from_json("value.groupState.held", "array<array<string>>").alias("held"))
    return held.select("route", F.explode("held").alias("x")).select("route", F.col("x")[0].cast("long").alias("seq"), F.col("x")[1].alias("event"))


def write_log(events: DataFrame, path: str, checkpoint: str, most: int = MOST_EVENTS, age_ms: int = MOST_AGE_MS, after=None, every: str = "1 second"):
    """Start the stream that writes a log of chunks; after(): called behind each batch, once its chunks are there."""

    def write(batch: DataFrame, _: int) -> None:
        write_cut(batch, path)
        if after is not None:
            after()

    return cut_chunks(events, most, age_ms).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def keep_snapshots(spark: SparkSession, path: str, root: str, now_ms: int, every: int = MOST_EVENTS, age_ms: int = MOST_AGE_MS, keep: int = 5) -> int | None:
    """Write a snapshot of the log's jobs where one is due; its version (the log's last seq), or None.

    Due: `every` seqs or `age_ms` since the last one, and something new. The new
    snapshot goes on from the last one with the chunks behind it, so only these
    are read. A snapshot that was cut off before it was whole is written anew.
    """
    note = tables.read_json(spark, f"{root}/cadence.json")
    if note is None:
        note = {"version": 0, "at_ms": now_ms}
        tables.write_json(spark, f"{root}/cadence.json", note)
    rows = log.read_log(spark, path, after=note["version"])
    last = rows.agg(F.max("seq")).first()[0]
    if last is None or not (last - note["version"] >= every or now_ms - note["at_ms"] >= age_ms):
        return None
    place = f"{root}/snapshot-{last:020d}"
    if not tables.exists(spark, f"{place}/_SUCCESS"):
        fs, p = tables.fs_of(spark, place)
        fs.delete(p, True)
        new = ev.advance(tables.read_snapshot(spark, root, ev.SNAPSHOTS), rows.where(F.col("seq") <= last))
        tables.write_snapshot(new, root, last, keep)
    tables.write_json(spark, f"{root}/cadence.json", {"version": last, "at_ms": now_ms})
    return last


FRAMES = ev.EVENTS + ", frame string, skipped long"


def subscribe(spark: SparkSession, path: str, live: DataFrame, out: str, checkpoint: str, since: int, job: str | None = None, most: int = BUS, tail: DataFrame | None = None, every: str = "1 second"):
    """A client's view of the log: FRAMES below `out`, a folder a batch; starts the stream that goes on with it.

    First the log's events behind `since` (and those that no chunk has yet:
    `tail`, as from `buffered`), up to the last seq that is there now, which is
    noted; then the live ones behind that, each seq of a job once. More than
    `most` events in one live batch are too many: a frame `resync` says how many
    were left out, and the newest ones follow. A restart with the same checkpoint
    goes on where it stopped; batches that run again replace their own frames.
    """
    own = lambda df: df.where(F.col("job") == job) if job else df
    note = tables.read_json(spark, f"{out}/begin.json")
    if note is None:
        rows = log.read_log(spark, path, after=since).select(*NAMES)
        if tail is not None:
            rows = rows.unionByName(tail.where(F.col("seq") > since).select(F.from_json("event", ev.EVENTS).alias("e")).select("e.*")).dropDuplicates(["seq"])
        head = rows.agg(F.coalesce(F.max("seq"), F.lit(since))).first()[0]
        frames = own(rows.where(F.col("seq") <= head)).select("*", F.lit("event").alias("frame"), F.lit(0).cast("long").alias("skipped"))
        frames.write.mode("overwrite").parquet(f"{out}/batch-catch-up")
        tables.write_json(spark, f"{out}/begin.json", {"since": since, "head": head})
    else:
        head = note["head"]

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        n = rows.count()
        frames = rows.select(*NAMES, F.lit("event").alias("frame"), F.lit(0).cast("long").alias("skipped"))
        if n > most:
            newest = rows.select("seq").orderBy(F.desc("seq")).limit(most)
            first = newest.agg(F.min("seq")).first()[0]
            mark = spark.createDataFrame([(first, "resync", n - most)], "seq long, frame string, skipped long")
            frames = frames.where(F.col("seq") >= first).unionByName(mark, allowMissingColumns=True)
        frames.write.mode("overwrite").parquet(f"{out}/batch-{number:010d}")
        rows.unpersist()

    fresh = log.fresh(own(live.where(F.col("seq") > head)))
    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def frames_of(spark: SparkSession, out: str) -> DataFrame:
    """All frames so far: the catch-up's first, then by seq, a resync mark before the event that it stands at."""
    found = [p for p in tables.children(spark, out, "batch-*") if tables.exists(spark, f"{p}/_SUCCESS")]
    return spark.read.schema(FRAMES).parquet(*found).orderBy("seq", F.desc("frame")) if found else spark.createDataFrame([], FRAMES)
