"""An ordered event log to the state of jobs, workers and errors; pages and caps over it.

Events are rows of seq (the total order), at_us, kind, job, worker, from_worker,
client_seq and the fields of the kinds, null where a kind hasn't them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treediff.functions.decisions import RANKS, TERMINAL

#: Fixed limits of the state: transitions kept, classes and samples of errors.
HISTORY, CLASSES, SAMPLES, OVERFLOW = 256, 64, 10, "(overflow)"
TOP = 2**63 - 1
#: Kinds that set a phase by themselves.
DIRECT = {"JobPaused": "Paused", "JobCancelled": "Cancelled", "JobCompleted": "Completed", "JobFailed": "Failed", "VerifyStarted": "Verifying"}
JOBS = "job string, phase string, files_total long, bytes_total long, files_done long, bytes_done long, errors_total long, conflicts_resolved long, transitions int, history string, assigned_workers array<string>, last_seq long"
EVENTS = "seq long, at_us long, kind string, job string, worker string, from_worker string, client_seq long, files long, bytes long, errors long, to_phase string, mismatches long, class string, path string, retryable boolean, reason string"


def allowed(old: str, new: str) -> bool:
    """Forward among active phases; Paused from and to those; terminal phases from all others and to none."""
    if old == new or old in TERMINAL:
        return False
    if new in TERMINAL:
        return True
    if new == "Paused":
        return old in RANKS
    return new in RANKS and (old == "Paused" or RANKS[old] < RANKS[new])


class Job:
    """One job's state; events come in order of seq. It starts empty and is made by JobCreated."""

    def __init__(self, state: dict | None = None):
        self.s = state
        self.tick: int | None = None
        self.synced: tuple | None = None

    def move(self, to: str, at: int) -> None:
        s = self.s
        if s and allowed(s["phase"], to):
            s["history"] = [*s["history"], f"{s['phase']}>{to}@{at}"][-HISTORY:]
            s["transitions"] += 1
            s["phase"] = to

    def apply(self, e: dict) -> None:
        kind, s = e["kind"], self.s
        number = lambda k: 0 if pd.isna(e[k]) else int(e[k])
        if kind == SNAPSHOT:
            self.s = json.loads(e["reason"])
            return
        if kind == "JobCreated":
            self.s = s = {"phase": "Planned", "files_total": number("files"), "bytes_total": number("bytes"), "files_done": 0, "bytes_done": 0, "errors_total": 0, "conflicts_resolved": 0, "transitions": 0, "history": [], "assigned_workers": []}
        if not s:
            return
        s["last_seq"] = int(e["seq"])
        at = int(e["at_us"])
        if kind in DIRECT:
            self.move(DIRECT[kind], at)
        elif kind == "JobPhaseChanged":
            self.move(e["to_phase"], at)
        elif kind == "JobResumed" and s["phase"] == "Paused":
            earlier = [h.split(">")[0] for h in s["history"] if not h.startswith("Paused>")]
            self.move(earlier[-1] if earlier else "Scanning", at)
        elif kind == "VerifyCompleted":
            self.move("Failed" if number("mismatches") else "Cutover", at)
        elif kind == "JobTotalsSet":
            s["files_total"], s["bytes_total"] = number("files"), number("bytes")
        elif kind == "ProgressSync":
            s["files_done"], s["bytes_done"] = max(s["files_done"], number("files")), max(s["bytes_done"], number("bytes"))
        elif kind == "ProgressDelta":
            for k, d in (("files_done", "files"), ("bytes_done", "bytes"), ("errors_total", "errors")):
                s[k] = min(TOP, s[k] + number(d))
            if s["phase"] == "Planned":
                self.move("Copying", at)
        elif kind == "WorkerJoined" and not pd.isna(e["worker"]) and e["worker"] not in s["assigned_workers"]:
            s["assigned_workers"].append(e["worker"])
        elif kind == "ClaimConflictResolved":
            s["conflicts_resolved"] += 1

    def row(self, job: str) -> dict:
        return {"job": job, **self.s, "history": ",".join(self.s["history"])}


#: The kind of a row that sets a job's state instead of changing it; its reason is the state as JSON.
SNAPSHOT = "Snapshot"
SNAPSHOTS = "job string, last_seq long, state string"


#: What a job's state is made of.
FOLDED = ("seq", "at_us", "kind", "job", "worker", "files", "bytes", "errors", "to_phase", "mismatches", "reason")


def _runs(df: pd.DataFrame) -> Iterator[dict]:
    """Events of a sorted batch; a job's deltas between two other events come as one, with their sums, the first one's time and the last one's seq."""
    cols = {c: df[c].to_numpy() for c in FOLDED}
    n, delta, job = len(df), cols["kind"] == "ProgressDelta", cols["job"]
    first = np.ones(n, bool)
    first[1:] = ~delta[1:] | ~delta[:-1] | (job[1:] != job[:-1])
    starts = np.flatnonzero(first)
    ends, sums = np.append(starts[1:], n), {}
    for c in ("files", "bytes", "errors"):
        x = df[c].fillna(0)
        rough = np.add.reduceat(x.to_numpy(np.float64), starts)  # tells where 64 bits don't hold the sum
        sums[c] = np.where(rough >= float(TOP), TOP, np.add.reduceat(x.to_numpy(np.int64), starts))
    for k, (i, to) in enumerate(zip(starts.tolist(), ends.tolist())):
        e = {c: v[i] for c, v in cols.items()}
        if delta[i]:
            e["seq"] = cols["seq"][to - 1]
            e |= {c: v[k] for c, v in sums.items()}
        yield e


def _fold(events: DataFrame, schema: str, finish, step=None) -> DataFrame:
    """Ordered folds over jobs: events are dealt out by job and sorted; each streams by with only its state in memory.

    finish(job, state) gives a job's last rows; step(job, state, event) those before an event.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, out = None, Job(), []
        for df in batches:
            for e in df.to_dict("records") if step else _runs(df):
                if e["job"] != now:
                    if state.s:
                        out += finish(now, state)
                    now, state = e["job"], Job()
                if step:
                    out += step(now, state, e)
                state.apply(e)
            if len(out) >= 1000:
                yield pd.DataFrame(out)
                out = []
        if state.s:
            out += finish(now, state)
        if out:
            yield pd.DataFrame(out)

    return events.select(*FOLDED).repartition("job").sortWithinPartitions("job", "seq").mapInPandas(run, schema)


def fold_jobs(events: DataFrame) -> DataFrame:
    """The state of each created job after all events.

    Deltas between two other events of a batch become one, so the fold takes few
    steps. Events of jobs that were never created change nothing.
    """
    return _fold(events.where("job is not null"), JOBS, lambda job, state: [state.row(job)])


def snapshot_jobs(events: DataFrame) -> DataFrame:
    """(job, last_seq, state): what `replay` goes on from."""
    last = lambda job, state: [{"job": job, "last_seq": state.s["last_seq"], "state": json.dumps(state.s)}]
    return _fold(events.where("job is not null"), SNAPSHOTS, last)


def _replayed(snapshot: DataFrame, events: DataFrame, schema: str, finish) -> DataFrame:
    marks = snapshot.select(F.col("job").alias("s_job"), F.col("last_seq").alias("mark"))
    rows = events.where("job is not null").join(marks, F.col("job") == F.col("s_job"), "left").where("mark is null or seq > mark").drop("s_job", "mark")
    start = snapshot.select("job", F.col("last_seq").alias("seq"), F.lit(SNAPSHOT).alias("kind"), F.lit(0).cast("long").alias("at_us"), F.col("state").alias("reason"))
    return _fold(rows.select(*FOLDED).unionByName(start, allowMissingColumns=True), schema, finish)


def replay(snapshot: DataFrame, events: DataFrame) -> DataFrame:
    """The state of each job by a snapshot and the events behind its last_seq; events that the snapshot has seen change nothing."""
    return _replayed(snapshot, events, JOBS, lambda job, state: [state.row(job)])


def advance(snapshot: DataFrame, events: DataFrame) -> DataFrame:
    """The snapshot that a later one replaces it by: (job, last_seq, state) after the events behind it."""
    last = lambda job, state: [{"job": job, "last_seq": state.s["last_seq"], "state": json.dumps(state.s)}]
    return _replayed(snapshot, events, SNAPSHOTS, last)


def progress_syncs(events: DataFrame, tick_us: int = 1_000_000) -> DataFrame:
    """(job, tick_us, files_done, bytes_done): at the end of each tick with events, the absolutes of a job in an active phase, where they differ from the last ones."""

    def sync(job: str, state: Job, tick: int) -> list[dict]:
        now = (state.s["files_done"], state.s["bytes_done"])
        if state.s["phase"] not in RANKS or state.synced == now:
            return []
        state.synced = now
        return [{"job": job, "tick_us": tick, "files_done": now[0], "bytes_done": now[1]}]

    def step(job: str, state: Job, e: dict) -> list[dict]:
        tick = int(e["at_us"]) // tick_us * tick_us
        was = state.tick
        state.tick = tick if was is None else max(was, tick)
        return sync(job, state, was) if state.s and was is not None and tick > was else []

    return _fold(events.where("job is not null"), "job string, tick_us long, files_done long, bytes_done long", lambda job, state: sync(job, state, state.tick), step)


def fold_workers(events: DataFrame) -> DataFrame:
    """Each joined worker's state: without a loop, by windows over its events.

    A join resets a worker, so what counts comes after its last join. The state
    is that of the last event that sets one. Counters add up deltas and are
    lifted to absolutes: with S the running sum of deltas, a counter is
    S + max(0, greatest of (absolute - S at it)), as deltas are never negative.
    """
    sets = F.when(F.col("kind") == "WorkerJoined", "Idle").when(F.col("kind") == "WorkerLeft", "Disconnected").when(F.col("kind") == "WorkerFenced", "Fenced").when(F.col("kind") == "WorkerRecovered", "Idle").when(F.col("kind") == "WorkerStateChanged", F.col("to_phase"))
    order = Window.partitionBy("worker").orderBy("seq")
    joins = F.sum((F.col("kind") == "WorkerJoined").cast("int")).over(order)
    rows = events.where("worker is not null").withColumn("joins", joins).where("joins > 0")
    rows = rows.withColumn("last", F.max("joins").over(Window.partitionBy("worker"))).where("joins = last")
    for c in ("files", "bytes"):
        amount = F.coalesce(F.when(F.col("kind") == "ProgressDelta", F.col(c)), F.lit(0))
        rows = rows.withColumn(f"s_{c}", F.sum(amount).over(order)).withColumn(f"lift_{c}", F.when(F.col("kind") == "ProgressSync", F.col(c) - F.col(f"s_{c}")))
    done = lambda c: (F.max(f"s_{c}") + F.greatest(F.lit(0), F.coalesce(F.max(f"lift_{c}"), F.lit(0)))).alias(f"{c}_done")
    return rows.groupBy("worker").agg(F.max_by(sets, F.when(sets.isNotNull(), F.col("seq"))).alias("state"), done("files"), done("bytes"), F.min(F.when(F.col("kind") == "WorkerJoined", F.col("at_us"))).alias("joined_us"))


def client_marks(events: DataFrame) -> DataFrame:
    """The highest client_seq of each worker; the sender counts before the worker that the event is about."""
    return events.where("client_seq is not null").groupBy(F.coalesce("from_worker", "worker").alias("worker")).agg(F.max("client_seq").alias("client_seq")).where("worker is not null")


def unseen(batch: DataFrame, marks: DataFrame) -> DataFrame:
    """Events of a batch beyond their worker's mark."""
    m = marks.select(F.col("worker").alias("m_worker"), F.col("client_seq").alias("mark"))
    return batch.join(m, F.coalesce("from_worker", "worker") == F.col("m_worker"), "left").where("client_seq is null or mark is null or client_seq > mark").drop("m_worker", "mark")


def rejected_batches(batches: DataFrame, kinds: list[str]) -> DataFrame:
    """(batch, why) of batches that are refused as a whole: a kind that workers may not send, another worker's event, or stamps that don't rise."""
    w = Window.partitionBy("batch").orderBy("position")
    why = F.when(~F.col("kind").isin(kinds), "kind").when(~F.col("worker").eqNullSafe(F.col("caller")), "worker").when(F.col("client_seq") <= F.lag("client_seq").over(w), "order")
    return batches.withColumn("why", why).where("why is not null").groupBy("batch").agg(F.min_by("why", "position").alias("why"))


def totals(events: DataFrame, by: str) -> DataFrame:
    """Sums of deltas by job or worker."""
    deltas = events.where((F.col("kind") == "ProgressDelta") & F.col(by).isNotNull())
    return deltas.groupBy(by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("files", "bytes", "errors")])


def _classes(events: DataFrame, classes: int) -> DataFrame:
    """Errors by job and class, pre-aggregated, with the class that they count under: beyond `classes` of a job, in the order of first errors, that of overflow."""
    each = events.where("kind = 'ErrorEmitted'").groupBy("job", "class").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min_by("at_us", "seq").alias("first_us"), F.max_by("at_us", "seq").alias("last_us"), F.max_by("retryable", "seq").alias("retryable"))
    rank = F.row_number().over(Window.partitionBy("job").orderBy("first_seq"))
    return each.withColumn("counted", F.when(rank <= classes, F.col("class")).otherwise(OVERFLOW))


def error_buckets(events: DataFrame, classes: int = CLASSES) -> DataFrame:
    """Errors by job and class: count, first and last time, and whether the last could be retried.

    Beyond `classes` classes of a job, in the order of their first errors, the
    rest are one class of overflow. Classes are pre-aggregated, so the window
    that ranks them sees one row a class.
    """
    capped = _classes(events, classes).groupBy("job", "counted").agg(F.sum("n").alias("n"), F.min_by("first_us", "first_seq").alias("first_us"), F.max_by("last_us", "last_seq").alias("last_us"), F.max_by("retryable", "last_seq").alias("retryable"))
    return capped.withColumnRenamed("counted", "class")


def error_samples(events: DataFrame, keep: int = SAMPLES, classes: int = CLASSES) -> DataFrame:
    """(job, class, samples): paths of errors, known ones ignored, the oldest out beyond `keep`; an ordered fold with bounded state.

    Classes beyond a job's first `classes` share the samples of overflow, as they share its bucket.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, out = None, [], []
        for df in batches:
            for job, kind, path in zip(df["job"], df["class"], df["path"]):
                if (job, kind) != now:
                    if now:
                        out.append((*now, held))
                    now, held = (job, kind), []
                if path not in held:
                    held = [*held, path][-keep:]
            if len(out) >= 1000:
                yield pd.DataFrame(out, columns=["job", "class", "samples"])
                out = []
        if now:
            yield pd.DataFrame([*out, (*now, held)], columns=["job", "class", "samples"])

    of = _classes(events, classes).select(F.col("job").alias("j"), F.col("class").alias("k"), "counted")
    rows = events.where("kind = 'ErrorEmitted'").select("job", "class", "path", "seq")
    rows = rows.join(of, F.col("job").eqNullSafe(F.col("j")) & F.col("class").eqNullSafe(F.col("k"))).select("job", F.col("counted").alias("class"), "path", "seq")
    return rows.repartition("job", "class").sortWithinPartitions("job", "class", "seq").mapInPandas(run, "job string, class string, samples array<string>")


def error_cap(events: DataFrame, keep: int = 10, width_us: int = 1_000_000) -> DataFrame:
    """(job, class, seq, window_us, shown): which errors of a job a live view shows.

    A window starts with the first error after the last one has passed, shared by
    all classes of the job, and shows `keep` errors of each class. Where windows
    start depends on all errors before: a fold in order with one number of state
    for a job; the rest is a window function.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, start = None, 0
        for df in batches:
            starts = []
            for job, at in zip(df["job"], df["at_us"]):
                if job != now or at - start >= width_us:
                    now, start = job, at
                starts.append(start)
            yield df[["job", "class", "seq"]].assign(window_us=starts)

    rows = events.where("kind = 'ErrorEmitted' and job is not null").select("job", "class", "at_us", "seq")
    rows = rows.repartition("job").sortWithinPartitions("job", "seq").mapInPandas(run, "job string, class string, seq long, window_us long")
    rank = F.row_number().over(Window.partitionBy("job", "window_us", "class").orderBy("seq"))
    return rows.withColumn("shown", rank <= keep)


def conflicts(events: DataFrame) -> DataFrame:
    return events.where("kind = 'ClaimConflictResolved'").groupBy("job").agg(F.count("*").alias("conflicts"))


def since(events: DataFrame, seq: int, limit: int = 200) -> DataFrame:
    """A page of the log after a seq; the limit is kept within 1 and 1000."""
    return events.where(F.col("seq") > seq).orderBy("seq").limit(max(1, min(limit, 1000)))


def page(rows: DataFrame, key: str, after, limit: int) -> DataFrame:
    """The `limit` rows of the smallest keys after a cursor, with the cursor of the next page (null: this is the last one)."""
    found = rows if after is None else rows.where(F.col(key) > after)
    # limit + 1 rows at most, so one task holds the page
    taken = found.orderBy(key).limit(limit + 1).withColumn("at", F.row_number().over(Window.orderBy(key))).withColumn("found", F.count("*").over(Window.partitionBy()))
    last = F.max(F.when(F.col("at") <= limit, F.col(key))).over(Window.partitionBy())
    return taken.withColumn("next_cursor", F.when(F.col("found") > limit, last)).where(F.col("at") <= limit).drop("at", "found")


def newest(rows: DataFrame, order: str, keep: int, by: str) -> DataFrame:
    """The newest `keep` rows of each group: snapshots of a job, passes of a tree, transitions of a history."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("rank") <= keep).drop("rank")


def merge(*logs: DataFrame) -> DataFrame:
    """Catch-up and live events as one log, each seq once."""
    out = logs[0]
    for x in logs[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out.dropDuplicates(["seq"])


def capped_progress(events: DataFrame, width_us: int = 1_000_000) -> DataFrame:
    """Progress frames by job and worker as a live view shows them: one at once, then what comes within the second summed up behind it.

    Frames start where the last one's second has passed, which depends on all
    before: a fold over each worker's events in order, with constant state.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, opened, held, out = None, 0, None, []
        for df in batches:
            for job, worker, at, seq, files, n in df[["job", "worker", "at_us", "seq", "files", "bytes"]].itertuples(index=False):
                if (job, worker) != now or at - opened >= width_us:
                    if held:
                        out.append(held)
                    now = (job, worker)
                    out.append((job, worker, seq, "leading", files, n, at))
                    opened, held = at, None
                else:
                    f, b = (held[4], held[5]) if held else (0, 0)
                    held = (job, worker, seq, "trailing", f + files, b + n, at)
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if held:
            out.append(held)
        if out:
            yield pd.DataFrame(out, columns=names)

    names = ["job", "worker", "seq", "edge", "files", "bytes", "at_us"]
    rows = events.where("kind = 'ProgressDelta' and job is not null and worker is not null").select("job", "worker", "at_us", "seq", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"))
    return rows.repartition("job", "worker").sortWithinPartitions("job", "worker", "seq").mapInPandas(run, "job string, worker string, seq long, edge string, files long, bytes long, at_us long")
