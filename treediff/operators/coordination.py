"""Shards, claims, hosts and roots: who holds what, what comes next, what overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treediff.functions import decisions as D
from treediff.functions import texts as X


def tally(manifest: DataFrame, claims: DataFrame) -> DataFrame:
    """One row of totals over a manifest (shard, rows, bytes) and its claims (shard, state and, where a shard may have several, epoch).

    The claim of the highest epoch counts, of equal ones the last by name; other runs' claims don't.
    """
    epoch = F.col("epoch") if "epoch" in claims.columns else F.lit(0)
    one = claims.groupBy(F.col("shard").alias("claimed")).agg(F.max(F.struct(epoch.alias("epoch"), F.col("state").alias("state")))["state"].alias("state"))
    rows = manifest.join(one, F.col("shard") == F.col("claimed"), "left")
    of = lambda s: F.count_if(F.col("state") == s)
    done = lambda c: F.coalesce(F.sum(F.when(F.col("state") == "completed", F.col(c))), F.lit(0))
    out = rows.agg(F.count("*").alias("total_shards"), of("completed").alias("completed"), of("failed").alias("failed"), of("active").alias("active"), done("rows").alias("rows_completed"), done("bytes").alias("bytes_completed"))
    return out.withColumn("all_terminal", F.col("completed") + F.col("failed") == F.col("total_shards"))


def reconcile_jobs(jobs: DataFrame, manifests: DataFrame, claims: DataFrame) -> DataFrame:
    """(job, kind, files, bytes, reason): the events that heal and end jobs by what their shards' claims say.

    jobs: job, phase, files_done, bytes_done; manifests: job, shard, rows, bytes;
    claims: job, shard, state, epoch (of several, the highest epoch counts; those
    of other shards don't). A job that is over gets none. A ProgressSync comes
    where finished shards hold more rows or bytes than the job knows: progress
    only ever rises, so it carries the larger of the two. Once all of a job's
    shards are over, it is completed, or failed with the number of failed ones.
    Sums stop at the largest long.
    """
    one = claims.groupBy(F.col("job").alias("c_job"), F.col("shard").alias("c_shard")).agg(F.max(F.struct(F.coalesce("epoch", F.lit(0)).alias("epoch"), F.col("state").alias("state")))["state"].alias("state"))
    rows = manifests.join(one, (F.col("job") == F.col("c_job")) & (F.col("shard") == F.col("c_shard")), "left")
    top = F.lit(2**63 - 1).cast("decimal(38,0)")
    done = lambda c: F.least(F.coalesce(F.sum(F.when(F.col("state") == "completed", F.col(c).cast("decimal(20,0)"))), F.lit(0).cast("decimal(38,0)")), top).cast("long")
    of = lambda s: F.count_if(F.col("state") == s)
    sums = rows.groupBy(F.col("job").alias("t_job")).agg(F.count("*").alias("shards"), of("completed").alias("completed"), of("failed").alias("failed"), done("rows").alias("rows"), done("bytes").alias("bytes"))
    live = jobs.where(~F.coalesce(D.is_terminal(F.col("phase")), F.lit(False))).join(sums, F.col("job") == F.col("t_job"))
    files, n = F.greatest("rows", F.coalesce("files_done", F.lit(0))), F.greatest("bytes", F.coalesce("bytes_done", F.lit(0)))
    rises = (F.col("rows") > F.coalesce("files_done", F.lit(0))) | (F.col("bytes") > F.coalesce("bytes_done", F.lit(0)))
    event = lambda kind, files, n, reason: F.struct(F.lit(kind).alias("kind"), files.cast("long").alias("files"), n.cast("long").alias("bytes"), reason.cast("string").alias("reason"))
    none, over = F.lit(None), F.col("completed") + F.col("failed") == F.col("shards")
    why = F.concat(F.col("failed").cast("string"), F.lit(" of "), F.col("shards").cast("string"), F.lit(" shards failed"))
    found = F.array(
        F.when(rises, event("ProgressSync", files, n, none)),
        F.when(over & (F.col("failed") == 0), event("JobCompleted", none, none, none)),
        F.when(over & (F.col("failed") > 0), event("JobFailed", none, none, why)),
    )
    return live.select("job", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("e")).select("job", "e.*")


def decide_claims(requests: DataFrame, held: DataFrame) -> DataFrame:
    """Requests (shard, host, at, observed_tag) with their outcome and the epoch that a winner gets.

    held: shard, state, epoch, claim_tag, stale (its owner is dead or its lease
    is over). A free shard goes to its first request (acquired, epoch 1), the
    others contend; a stale claim goes to the first request that has seen its tag
    (won, one epoch more), the others lose the race; claims that are over stay,
    and live ones are contended. First: by time, then host, then tag.
    """
    h = held.select(F.col("shard").alias("h_shard"), F.col("state").alias("h_state"), F.col("epoch").alias("h_epoch"), F.col("claim_tag").alias("h_tag"), F.col("stale").alias("h_stale"))
    rows = requests.join(h, F.col("shard") == F.col("h_shard"), "left")
    free = F.col("h_shard").isNull()
    stale = ~free & (F.col("h_state") == "active") & F.coalesce("h_stale", F.lit(False))
    fits = free | (stale & F.col("observed_tag").eqNullSafe(F.col("h_tag")))
    rows = rows.withColumn("fits", fits)
    first = F.row_number().over(Window.partitionBy("shard", "fits").orderBy("at", "host", "observed_tag")) == 1
    rows = rows.withColumn("first", F.col("fits") & first)
    outcome = (
        F.when(free & F.col("first"), "acquired").when(free, "contended").when(F.col("h_state") != "active", F.concat(F.lit("over: "), "h_state"))
        .when(F.col("first"), "won").when(stale, "lost_race").otherwise("contended")
    )
    epoch = F.when(F.col("first"), F.coalesce(F.col("h_epoch"), F.lit(0)) + 1).cast("long")
    return rows.withColumns({"outcome": outcome, "new_epoch": epoch}).drop("h_shard", "h_state", "h_epoch", "h_tag", "h_stale", "fits", "first")


def job_end(tallied: DataFrame) -> DataFrame:
    """The phase that a job with all shards terminal goes to."""
    return tallied.withColumn("ends_as", F.when(F.col("all_terminal") & (F.col("total_shards") > 0), F.when(F.col("failed") > 0, "Failed").otherwise("Completed")))


def owner_dead(now: Column, heartbeat: Column) -> Column:
    """Does the holder's progress record show that its claim is dead?

    Columns: claimed_at, claim_tag; of the progress record (nulls: there is none)
    progress_at, progress_heartbeat, held_tag. Young claims get twice a
    heartbeat of grace unless the record names them; times are in seconds, and
    a claim of the future is young.
    """
    older = lambda at, hb: (hb > 0) & (now - at > 2 * hb)
    hb, none = F.col("progress_heartbeat"), F.col("progress_at").isNull()
    holds = F.coalesce(F.col("held_tag") == F.col("claim_tag"), F.lit(False))
    return F.when(none, older(F.col("claimed_at"), heartbeat)).when(hb == 0, False).when(holds, older(F.col("progress_at"), hb)).otherwise(older(F.col("claimed_at"), hb))


def targets(manifest: DataFrame, claims: DataFrame, progress: DataFrame, now: Column, lease: int, heartbeat: int) -> DataFrame:
    """The manifest's shards in order with their state: free, stale, held, completed or failed.

    manifest: shard, position; claims: shard, state, host, claimed_at, claim_tag;
    progress: host, progress_at, progress_heartbeat, held_tag. Where a holder has
    a record, that decides; where it has none, the lease does too.
    """
    c = claims.withColumnRenamed("shard", "claimed").withColumnRenamed("host", "holder")
    rows = manifest.join(c, F.col("shard") == F.col("claimed"), "left").join(progress, F.col("holder") == F.col("host"), "left")
    dead = owner_dead(now, F.lit(heartbeat)) | (F.col("progress_at").isNull() & (now - F.col("claimed_at") > lease))
    state = F.when(F.col("claimed").isNull(), "free").when(F.col("state") != "active", F.col("state")).when(dead, "stale").otherwise("held")
    return rows.select("shard", "position", state.alias("target_state"))


def next_target(found: DataFrame, skip: list[str] | None = None) -> DataFrame:
    """One row: the first free or stale shard outside `skip`, and whether all shards are terminal."""
    can = F.col("target_state").isin("free", "stale") & ~F.col("shard").isin(skip or [])
    return found.agg(F.min_by(F.when(can, F.col("shard")), F.when(can, F.col("position"))).alias("next_shard"), F.coalesce(F.bool_and(F.col("target_state").isin("completed", "failed")), F.lit(True)).alias("all_terminal"))


def latest_claims(history: DataFrame) -> DataFrame:
    """Of each shard the claim of the highest epoch."""
    w = Window.partitionBy("shard").orderBy(F.desc("epoch"))
    return history.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def expired_leases(leases: DataFrame, now: Column, grace: int = 5) -> DataFrame:
    return leases.where(F.col("expires_at") + grace < now)


def fence_runs(beats: DataFrame, by: str, budget: Column, lease: Column | None = None) -> DataFrame:
    """Heartbeats with the failures in a row up to each, and whether one fences the worker.

    beats: by, at, ok; with `lease` (seconds) also held_claim, lost_claim (of a
    beat that was told that a claim is lost, else null), wall_s and mono_s. A
    success resets the run, as does a beat without a claim and one that lost
    another claim than the held one; losing the held one fences at once, as do
    clocks that differ by more than half the lease (a second at least).
    """
    reset = F.col("ok")
    if lease is not None:
        reset = reset | F.col("held_claim").isNull() | F.coalesce(F.col("lost_claim") != F.col("held_claim"), F.lit(False))
    rows = beats.withColumn("reset", reset)
    rows = rows.withColumn("run", F.sum(F.col("reset").cast("int")).over(Window.partitionBy(by).orderBy("at")))
    failed = F.sum((~F.col("reset")).cast("int")).over(Window.partitionBy(by, "run").orderBy("at"))
    fenced = F.col("failures") >= budget
    if lease is not None:
        fenced = fenced | F.coalesce(F.col("lost_claim") == F.col("held_claim"), F.lit(False)) | (F.abs(F.col("wall_s") - F.col("mono_s")) > F.greatest(F.lit(1), F.floor(lease / 2)))
    return rows.withColumn("failures", failed).withColumn("fenced", fenced).drop("run", "reset")


def stale_registrations(workers: DataFrame, arriving: DataFrame) -> DataFrame:
    """Workers of the arriving ones' job and machine that are another process and not yet disconnected.

    Both: job, host, pid, started; workers also worker, state.
    """
    a = arriving.select(F.col("job").alias("a_job"), X.machine_name(F.col("host"), F.col("pid")).alias("a_machine"), F.col("pid").alias("a_pid"), F.col("started").alias("a_started"))
    w = workers.withColumn("machine", X.machine_name(F.col("host"), F.col("pid")))
    on = (F.col("job") == F.col("a_job")) & (F.col("machine") == F.col("a_machine")) & ((F.col("pid") != F.col("a_pid")) | (F.col("started") != F.col("a_started")))
    return w.where(F.col("state") != "Disconnected").join(a, on, "left_semi")


def workers_of(jobs: DataFrame, workers: DataFrame) -> DataFrame:
    """(job, position, worker, ...) in the order of joining; ids without a worker are dropped."""
    return jobs.select("job", F.posexplode("assigned_workers").alias("position", "id")).join(workers.drop("job"), F.col("id") == F.col("worker")).drop("id")


def silent_workers(workers: DataFrame, now: Column, timeout_us: int = 90_000_000) -> DataFrame:
    """Workers (worker, last_us) that haven't been heard of for longer than the timeout, with the reason that goes into the log."""
    gone = now - F.col("last_us")
    return workers.where(gone > timeout_us).withColumn("reason", F.concat(F.lit("no heartbeat for "), ((gone - F.pmod(gone, F.lit(1_000_000).cast("long"))) / 1_000_000).cast("long").cast("string"), F.lit("s")))


def evictable(workers: DataFrame, now: Column, after_us: int = 86_400_000_000) -> DataFrame:
    """Disconnected for a day or more; fenced workers never go."""
    return workers.where((F.col("state") == "Disconnected") & (now - F.col("last_us") >= after_us))


def shared_addresses(names: DataFrame, a: str, b: str) -> DataFrame:
    """Addresses (name, address) that two names share."""
    return names.where(F.col("name") == a).select("address").intersect(names.where(F.col("name") == b).select("address"))


def directories_by_inode(index: DataFrame, wanted: DataFrame) -> DataFrame:
    return index.where("file_type = 2").join(wanted.select(F.col("inode").alias("wanted")), F.col("inode") == F.col("wanted"), "left_semi")


def ancestor_overlap(a: DataFrame, b: DataFrame, one_server: bool) -> DataFrame:
    """Ancestors (path, handle, fsid, fileid) of two roots that are one directory: by handle, or by ids once the servers are one."""
    r = b.select(*[F.col(c).alias(f"r_{c}") for c in ("path", "handle", "fsid", "fileid")])
    by_handle = a.join(r, F.col("handle") == F.col("r_handle")).withColumn("by", F.lit("handle"))
    if not one_server:
        return by_handle
    by_id = a.join(r, (F.col("fsid") == F.col("r_fsid")) & (F.col("fileid") == F.col("r_fileid"))).withColumn("by", F.lit("identity"))
    return by_handle.unionByName(by_id)


def prove_separation(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """pairs with their verdict, reason and, where the source's index decides, the path.

    pairs: identity_overlap, handle_overlap, same_server, probe (visible, absent,
    unknown) and the destination root's own fsid and fileid. What the roots
    themselves allow on one server is looked up in the source's index (path,
    file_type, inode, fsid): a directory of that fileid (and of that fsid, where
    both are known) is the destination's root, so the copy would go into itself.
    Of several the first path is named. The index is read once, for directories
    alone, and meets the few roots by fileid.
    """
    own = D.separation(F.col("identity_overlap"), F.col("handle_overlap"), F.col("same_server"), F.col("probe"))
    rows = pairs.withColumn("own", own)
    wanted = rows.where((F.col("own") == "allow") & F.col("same_server") & F.col("fileid").isNotNull()).select(F.col("fileid").alias("w_fileid"), F.col("fsid").alias("w_fsid")).distinct()
    dirs = index.where("file_type = 2").select(F.col("inode").cast("decimal(20,0)").alias("d_inode"), F.col("fsid").cast("decimal(20,0)").alias("d_fsid"), "path")
    same = (F.col("d_inode") == F.col("w_fileid").cast("decimal(20,0)")) & F.coalesce(F.col("d_fsid") == F.col("w_fsid").cast("decimal(20,0)"), F.lit(True))
    found = wanted.join(dirs, same).groupBy("w_fileid", "w_fsid").agg(F.min("path").alias("found"))
    on = (F.col("own") == "allow") & F.col("same_server") & (F.col("fileid") == F.col("w_fileid")) & F.col("fsid").eqNullSafe(F.col("w_fsid"))
    both = rows.join(found, on, "left")
    why = (
        F.when(F.col("identity_overlap"), "one directory by identity").when(F.col("handle_overlap") & F.col("same_server"), "one directory by handle")
        .when(F.col("own") == "refuse", F.concat(F.lit("equal handles, probe "), F.coalesce("probe", F.lit("unknown")))).when(F.col("found").isNotNull(), "the destination's root lies in the source")
    )
    return both.withColumns({"verdict": F.when(why.isNull(), "allow").otherwise("refuse"), "reason": why}).drop("own", "w_fileid", "w_fsid")


def checkpoints(inputs: DataFrame, done: DataFrame) -> DataFrame:
    """Inputs and checkpoints (part, fingerprint) by state: done, to_do (none), changed (another fingerprint), orphan (no input)."""
    d = done.select(F.col("part").alias("d_part"), F.col("fingerprint").alias("d_print"))
    both = inputs.join(d, F.col("part") == F.col("d_part"), "full")
    state = F.when(F.col("part").isNull(), "orphan").when(F.col("d_part").isNull(), "to_do").when(F.col("fingerprint").eqNullSafe(F.col("d_print")), "done").otherwise("changed")
    return both.select(F.coalesce("part", "d_part").alias("part"), state.alias("state"))


#: Fixed: what a command asks of a job's phase, and the event that it makes (none: an audit row alone).
COMMANDS = {"pause": ("active", "JobPaused"), "drain": ("active", "JobPaused"), "resume": ("paused", "JobResumed"), "cancel": ("not over", "JobCancelled"), "retry-failed": ("any", None)}


def decide_commands(commands: DataFrame, jobs: DataFrame) -> DataFrame:
    """commands (command, job, ...) with `error` (null: accepted) and the `event` that an accepted one makes; jobs: job, phase."""
    j = jobs.select(F.col("job").alias("j_job"), "phase")
    rows = commands.join(j, F.col("job") == F.col("j_job"), "left")
    phase, known, event, fits = F.col("phase"), F.col("command").isin(*COMMANDS), None, None
    may = {"active": D.phase_rank(phase).isNotNull(), "paused": phase == "Paused", "not over": ~D.is_terminal(phase), "any": F.lit(True)}
    for name, (asks, makes) in COMMANDS.items():
        one = F.col("command") == name
        fits = F.when(one, may[asks]) if fits is None else fits.when(one, may[asks])
        event = F.when(one, F.lit(makes)) if event is None else event.when(one, F.lit(makes))
    error = (
        F.when(~known, "unknown_command").when(X.job_id_error(F.col("job")).isNotNull(), "invalid_job_id").when(F.col("j_job").isNull(), "job_not_found").when(~fits, "invalid_phase")
    )
    return rows.withColumn("error", error).withColumn("event", F.when(F.col("error").isNull(), event)).drop("j_job", "phase")


def audit_keys(entries: DataFrame, taken: DataFrame | None = None, at: str = "at", tie: str = "command_id") -> DataFrame:
    """Entries with the key of their audit row, audit/<date>/<number>.jsonl: numbered by day behind the numbers that are taken (date, seq)."""
    date = F.date_format(at, "yyyy-MM-dd")
    rows = entries.withColumn("date", date).withColumn("n", F.row_number().over(Window.partitionBy("date").orderBy(at, tie)))
    start = F.lit(0)
    if taken is not None:
        top = taken.groupBy(F.col("date").alias("t_date")).agg(F.max("seq").alias("top"))
        rows, start = rows.join(top, F.col("date") == F.col("t_date"), "left").drop("t_date"), F.coalesce(F.col("top"), F.lit(0))
    rows = rows.withColumn("seq", (start + F.col("n")).cast("long"))
    return rows.withColumn("key", X.seq_key("", F.col("seq"))).withColumn("key", F.concat(F.lit("audit/"), "date", F.lit("/"), "key")).drop("n", "top")


def archivable(jobs: DataFrame, snapshot: DataFrame, buffered: DataFrame) -> DataFrame:
    """Jobs that may be archived: over, and so in a durable snapshot (job, phase) too, with no event still buffered (job)."""
    safe = snapshot.where(D.is_terminal(F.col("phase"))).select("job")
    return jobs.where(D.is_terminal(F.col("phase"))).join(safe, "job", "left_semi").join(buffered.select("job").distinct(), "job", "left_anti")


def connection_tally(pairs: DataFrame) -> DataFrame:
    """(side, addresses, list): how many addresses each side's connections use, and each with its number of connections; pairs: source, dest."""
    each = pairs.select(F.explode(F.array(F.struct(F.lit("source").alias("side"), F.col("source").alias("a")), F.struct(F.lit("dest").alias("side"), F.col("dest").alias("a")))).alias("x"))
    n = each.groupBy("x.side", F.coalesce("x.a", F.lit("host name")).alias("a")).agg(F.count("*").alias("n"))
    return n.groupBy("side").agg(F.count("*").alias("addresses"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "n"))), lambda x: F.concat(x["a"], F.lit(" x"), x["n"].cast("string"))), ", ").alias("list"))


def report_totals(parts: DataFrame) -> DataFrame:
    """One row over the parts of a rewrite (rows, state): how many, their rows, and those of finished ones."""
    return parts.agg(F.count("*").alias("parts"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("state") == "done", F.col("rows"))), F.lit(0)).alias("rows_done"))
