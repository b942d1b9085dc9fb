"""Structured Streaming over the event log: file source, dedup, job state, progress windows, liveness."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from treediff.operators.events import EVENTS, JOBS, Job
from treediff.sources import tables

SCHEMA_VERSION = 1


def write_chunk(events: DataFrame, path: str, start_seq: int, job: str) -> None:
    """A chunk of one job's log, named by its first seq; writing it twice fails."""
    events.coalesce(1).write.mode("errorifexists").json(f"{path}/job={job}/{start_seq:020d}")


def chunks_since(starts: list[int], after: int) -> list[int]:
    """Of a route's chunks by their first seq: all but those whose successor starts at or before `after`."""
    order = sorted(starts)
    return [s for s, then in zip(order, [*order[1:], None]) if then is None or then > after]


def read_log(spark: SparkSession, path: str, after: int = 0, job: str | None = None) -> DataFrame:
    """The log as a table in order of seq; other jobs' folders and chunks that end before `after` aren't read."""
    found = []
    for folder in [f"{path}/job={job}"] if job else tables.children(spark, path, "job=*"):
        names = {int(p.rstrip("/").rsplit("/", 1)[1].removeprefix("start=")): p for p in tables.children(spark, folder, "*[0-9]")}
        found += [names[s] for s in chunks_since(list(names), after)]
    schema = EVENTS + ", schema_version int"
    if not found:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(found)
    newer = F.coalesce(F.col("schema_version") > SCHEMA_VERSION, F.lit(False))
    checked = rows.withColumn("seq", F.when(newer, F.raise_error(F.concat(F.lit("event of a newer schema: "), F.col("seq").cast("string"))).cast("long")).otherwise(F.col("seq")))
    return checked.where(F.col("seq") > after).orderBy("seq")


def stream_log(spark: SparkSession, path: str, chunks: int = 100) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", chunks).json(path)


def fresh(events: DataFrame) -> DataFrame:
    """Each event once, by a high-water mark: a job's chunks come in order of seq, so the state is two numbers a job, however long the log.

    What arrives at or below its job's mark in a later batch is taken for a
    repeat and dropped: a writer must not bring a job's chunks out of order.
    `dropped` tells how many there were.
    """
    names = events.columns

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark, gone = state.get if state.exists else (-1, 0)
        rows = pd.concat(list(batches)).sort_values("seq").drop_duplicates("seq")
        new = rows[rows["seq"] > mark]
        state.update((int(new["seq"].iloc[-1]) if len(new) else mark, gone + len(rows) - len(new)))
        if len(new):
            yield new[names]

    return events.groupBy("job").applyInPandasWithState(step, events.schema, "mark long, dropped long", "append", GroupStateTimeout.NoTimeout)


def dropped(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(job, mark, dropped) of a stream of `fresh` events, from its state."""
    return spark.read.format("statestore").load(checkpoint).select("key.job", "value.groupState.mark", "value.groupState.dropped")


CAPPED = "job string, worker string, seq long, edge string, files long, bytes long, at_us long"


def capped(events: DataFrame, width_ms: int = 1000) -> DataFrame:
    """Progress frames of a live view: one at once, then what comes within the interval summed up behind it.

    State: the last frame's time and the retained sums, by job and worker. Retained
    sums go out when the interval has passed, by an event or by the timer; every
    delta is in one frame or retained.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, seq, files, n, at = state.get if state.exists else (None, None, 0, 0, None)
        out = []

        def drain() -> None:
            nonlocal seq, files, n
            if seq is not None:
                out.append((*key, seq, "trailing", files, n, at))
            seq, files, n = None, 0, 0

        if state.hasTimedOut:
            drain()
        else:
            for e in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
                f, b = (0 if pd.isna(x) else int(x) for x in (e.files, e.bytes))
                if opened is None or e.at_us - opened >= width_ms * 1000:
                    drain()
                    opened, at = int(e.at_us), int(e.at_us)
                    out.append((*key, int(e.seq), "leading", f, b, opened))
                else:
                    seq, files, n, at = int(e.seq), files + f, n + b, int(e.at_us)
        state.update((opened, seq, files, n, at))
        if seq is not None:
            state.setTimeoutDuration(width_ms)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CAPPED.split(", ")])

    rows = events.where("kind = 'ProgressDelta' and job is not null and worker is not null")
    kept = "opened long, seq long, files long, bytes long, at_us long"
    return rows.groupBy("job", "worker").applyInPandasWithState(step, CAPPED, kept, "append", GroupStateTimeout.ProcessingTimeTimeout)


def jobs(events: DataFrame) -> DataFrame:
    """Each job's state after every batch that has events of it; equal to the batch fold over the same log."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        job = Job(json.loads(state.get[0]) if state.exists else None)
        for e in pd.concat(list(batches)).sort_values("seq").to_dict("records"):
            if not job.s or e["kind"] == "JobCreated" or e["seq"] > job.s.get("last_seq", -1):
                job.apply(e)
        if job.s:
            state.update((json.dumps(job.s),))
            yield pd.DataFrame([job.row(key[0])])

    return events.where("job is not null").groupBy("job").applyInPandasWithState(step, JOBS, "state string", "update", GroupStateTimeout.NoTimeout)


def progress(events: DataFrame, every: str = "1 second", late: str = "1 minute") -> DataFrame:
    """Sums of deltas by worker and window of time."""
    at = events.where("kind = 'ProgressDelta'").withColumn("at", F.timestamp_micros("at_us")).withWatermark("at", late)
    return at.groupBy(F.window("at", every), "job", "worker").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))


def silent(events: DataFrame, timeout_ms: int = 90_000) -> DataFrame:
    """(worker, reason) of workers that nothing came from for the timeout, by processing time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], f"no heartbeat for {timeout_ms // 1000}s")], columns=["worker", "reason"])
            return
        for _ in batches:
            pass
        state.update((1,))
        state.setTimeoutDuration(timeout_ms)

    return events.where("worker is not null").groupBy("worker").applyInPandasWithState(step, "worker string, reason string", "seen int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def follow(events: DataFrame, write, checkpoint: str):
    """Run write(batch, id) on each batch of a stream; the checkpoint, in the shared folder, makes it resume where it stopped."""
    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
