"""Decisions as columns: phases, exits, retries, conflicts, verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the event protocol.
RANKS = {"Planned": 0, "Scanning": 1, "Copying": 2, "Verifying": 3, "Cutover": 4}
TERMINAL = ("Completed", "Failed", "Cancelled")
PHASES = (*RANKS, "Paused", *TERMINAL)


def is_terminal(phase: Column) -> Column:
    return phase.isin(*TERMINAL)


def phase_rank(phase: Column) -> Column:
    out = None
    for name, k in RANKS.items():
        out = F.when(phase == name, k) if out is None else out.when(phase == name, k)
    return out


def transition_allowed(old: Column, new: Column) -> Column:
    """Forward among active phases, in and out of Paused, into a terminal phase from all others; none out of those."""
    active = phase_rank(old).isNotNull()
    return (
        F.when((old == new) | is_terminal(old), False).when(is_terminal(new), True).when(new == "Paused", active)
        .when(old == "Paused", phase_rank(new).isNotNull()).otherwise(F.coalesce(phase_rank(old) < phase_rank(new), F.lit(False)))
    )


def control_mode(phase: Column) -> Column:
    return F.when(phase == "Paused", "pause").when(is_terminal(phase), "cancel").otherwise("run")


def exit_code(outcome: Column) -> Column:
    """Of a command: success, fatal, completed_with_failures, or stopped by SIGINT or SIGTERM."""
    return F.when(outcome == "success", 0).when(outcome == "completed_with_failures", 2).when(outcome == "sigint", 130).when(outcome == "sigterm", 143).otherwise(1)


def run_outcome(fenced: Column, store_lost: Column, stopped: Column, wedged: Column | bool = False) -> Column:
    """Of a worker's run: struct(outcome, code). A shutdown that hangs exits with 2 whatever the outcome."""
    name = F.when(fenced & store_lost, "StoreUnreachable").when(fenced, "Fenced").when(stopped, "Interrupted").otherwise("Clean")
    return F.struct(name.alias("outcome"), F.when(F.lit(wedged) if isinstance(wedged, bool) else wedged, 2).when(fenced & store_lost, 4).when(fenced, 3).otherwise(0).alias("code"))


def error_scope(fatal: Column, message: Column, typed: Column) -> Column:
    """Fatal errors of a shard stay so, but untyped ones that look like a timeout."""
    timeout = F.lower(message).contains("command timed out") & ~F.coalesce(typed, F.lit(False))
    return F.when(fatal & ~F.coalesce(timeout, F.lit(False)), "Fatal").otherwise("WorkerLocal")


def retry_budget(lease: Column, heartbeat: Column) -> Column:
    each = F.greatest(heartbeat, F.lit(1)).cast("long")
    return F.greatest(F.lit(1).cast("long"), F.floor((lease - F.pmod(lease, each)).cast("decimal(20,0)") / each).cast("long"))


def race_backoff(heartbeat: Column) -> Column:
    """struct(low, high) of the milliseconds to wait after a lost race, drawn from [low, high): a quarter to half a heartbeat of seconds."""
    return F.struct((heartbeat * 250).cast("long").alias("low"), (heartbeat * 500).cast("long").alias("high"))


def backoff_seconds(attempt: Column) -> Column:
    """1, 2, 4, ... seconds, 30 at most."""
    return F.least(F.lit(30).cast("long"), F.pow(F.lit(2.0), F.least(attempt, F.lit(5))).cast("long"))


def self_target(same_server: Column, source: Column, dest: Column, source_parent: Column, partial_parent: Column) -> Column:
    return F.when(same_server & ((source == dest) | (source_parent == partial_parent)), "SELF_TARGET")


def link_exists(own: Column, other: Column) -> Column:
    """A link that is there already: replay where both ids (or targets) are known and equal, conflict where they differ, else the first error."""
    return F.when(own.isNull() | other.isNull(), "error").when(own == other, "replay").otherwise("conflict")


def effective(manifest: Column, host: Column) -> Column:
    return manifest & host


def separation(identity_overlap: Column, handle_overlap: Column, same_server: Column, probe: Column) -> Column:
    """May a copy run between two trees? A handle met on two servers is settled by a probe: only `absent` allows it."""
    doubt = F.when(probe == "absent", "allow").otherwise("refuse")
    return F.when(identity_overlap, "refuse").when(handle_overlap & same_server, "refuse").when(handle_overlap, doubt).otherwise("allow")
