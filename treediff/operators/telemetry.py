"""Latency histograms and quantiles, shares, throughput, progress, backpressure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed: four buckets for each power of two up to 2^24 µs, and one beyond.
OVERFLOW, TOP = 99, 24
MIB = float(1 << 20)


def bucket_of(us: Column) -> Column:
    us = us.cast("long")
    e = F.length(F.bin(us)) - 1
    part = F.floor(us.cast("double") * F.pow(F.lit(2.0), 2 - e)).cast("int").bitwiseAND(F.lit(3))
    return F.when(us < 1, 0).when(e >= TOP, OVERFLOW).otherwise(e * 4 + part).cast("int")


def bucket_upper(bucket: Column) -> Column:
    e = F.floor(bucket / 4).cast("int")
    sub = F.pmod(bucket, F.lit(4)).cast("long")
    two = lambda k: F.pow(F.lit(2.0), k).cast("long")
    return F.when(bucket == OVERFLOW, F.lit(1 << TOP).cast("long")).when(e >= 2, two(e) + (sub + 1) * two(e - 2) - 1).otherwise(two(e + 1) - 1)


def histogram(samples: DataFrame, by: list[str], us: str = "duration_us") -> DataFrame:
    return samples.groupBy(*by, bucket_of(F.col(us)).alias("bucket")).agg(F.count("*").alias("n"), F.sum(us).alias("sum_us"), F.max(us).alias("max_us"))


def quantiles(hist: DataFrame, by: list[str], wanted: dict[str, float] | None = None) -> DataFrame:
    """p50, p95 and p99 of a histogram, with count, sum, mean and max.

    The first bucket whose cumulative count reaches max(1, ceil(n q)) gives its
    upper end, but no more than the greatest sample; the overflow bucket gives
    the greater of the two.
    """
    wanted = wanted or {"p50_us": 0.5, "p95_us": 0.95, "p99_us": 0.99}
    one = Window.partitionBy(*by)
    rows = hist.withColumn("cum", F.sum("n").over(one.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(one)).withColumn("top", F.max("max_us").over(one))
    first = {k: F.min(F.when(F.col("cum") >= F.greatest(F.lit(1), F.ceil(F.col("total") * q)), F.col("bucket"))).alias(k) for k, q in wanted.items()}
    out = rows.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("sum_us").alias("sum_us"), F.max("max_us").alias("max_us"), *first.values())

    def value(k: str) -> Column:
        upper = bucket_upper(F.col(k))
        return F.when(F.col(k) == OVERFLOW, F.greatest("max_us", upper)).otherwise(F.least(upper, F.greatest(F.col("max_us"), F.lit(1)))).cast("long").alias(k)

    mean = F.floor(F.col("sum_us").cast("decimal(20,0)") / F.col("n")).cast("long").alias("mean_us")
    return out.select(*by, "n", "sum_us", "max_us", mean, *[value(k) for k in wanted])


def window_quantiles(samples: DataFrame, by: list[str], width_us: int = 30_000_000, ts: str = "at_us", us: str = "duration_us") -> DataFrame:
    """Histograms of each window of fixed width, with their quantiles: one shuffle of pre-aggregated buckets."""
    start = (F.col(ts) - F.pmod(F.col(ts), F.lit(width_us).cast("long"))).alias("window_us")
    return quantiles(histogram(samples.withColumn("window_us", start), [*by, "window_us"], us), [*by, "window_us"])


def counter_steps(counters: DataFrame, by: list[str], order: str, values: list[str]) -> DataFrame:
    """Growth of cumulative counters from one row to the next, never below 0; the first row's growth is its value."""
    w = Window.partitionBy(*by).orderBy(order)
    return counters.select(*by, order, *[F.greatest(F.col(v) - F.coalesce(F.lag(v).over(w), F.lit(0)), F.lit(0)).alias(v) for v in values])


def busy_share(samples: DataFrame, window_us: int, pairs: int, shared: tuple[str, ...] = ("object_store",)) -> DataFrame:
    """Percent of the window that each side's operations took, of all pairs of connections; sides in `shared` have one."""
    slots = F.when(F.col("side").isin(*shared), 1).otherwise(pairs)
    return samples.groupBy("side").agg(F.sum("duration_us").alias("busy_us")).withColumn("busy_pct", F.col("busy_us") * 100.0 / (slots * F.lit(float(window_us))))


def failure_percent(ok: Column, failed: Column) -> Column:
    return F.when(ok + failed > 0, failed * 100.0 / (ok + failed)).otherwise(0.0)


def rolling_throughput(samples: DataFrame, by: list[str], seconds: int = 60, ts: str = "ts_us", total: str = "bytes") -> DataFrame:
    """MiB/s between the first and last cumulative sample of the last `seconds`; 0 with fewer than two, or without time between them."""
    w = Window.partitionBy(*by).orderBy(ts).rangeBetween(-seconds * 1_000_000, 0)
    us, grown = F.col("last_us") - F.col("first_us"), F.greatest(F.col("last_b") - F.col("first_b"), F.lit(0))
    rows = samples.withColumns({"first_us": F.min(ts).over(w), "last_us": F.col(ts), "first_b": F.min_by(total, ts).over(w), "last_b": F.max_by(total, ts).over(w), "in_window": F.count("*").over(w)})
    return rows.withColumn("mib_s", F.when((F.col("in_window") >= 2) & (us > 0), grown / (us / 1e6) / MIB).otherwise(0.0)).drop("first_us", "last_us", "first_b", "last_b")


def tumbling(samples: DataFrame, by: list[str], width_us: int, sums: dict[str, str], ts: str = "ts_us") -> DataFrame:
    """Sums and counts by windows of fixed width since the epoch."""
    start = (F.col(ts) - F.pmod(F.col(ts), F.lit(width_us).cast("long"))).alias("window_us")
    return samples.groupBy(*by, start).agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])


def trips(shards: DataFrame, threshold_pct: float, floor_mib_s: int) -> DataFrame:
    """Shard outcomes with why they degrade their worker, or null: failures, or a throughput that is known and too low."""
    rate, speed = failure_percent(F.col("files_ok"), F.col("files_failed")), F.col("mib_s")
    why = F.when(rate > threshold_pct, "FailureRate").when((speed > 0) & (F.floor(speed) < floor_mib_s), "ThroughputFloor")
    return shards.withColumns({"failure_pct": rate, "degraded": why})


#: Fixed: seconds of the first cooldown and the longest.
COOLDOWN, LONGEST = 300, 1800


def backpressure(shards: DataFrame, by: str, order: str = "at_us") -> DataFrame:
    """(by, at, why, cooldown, until): the recovery state after each shard outcome of a worker, by windows alone.

    shards: by, order, degraded (null: healthy), probing (was this the probe
    shard?). A healthy outcome resets; a failed probe doubles the cooldown; a
    straggler keeps it. So in a run of degraded outcomes the cooldown has doubled
    once for each probe behind the first. Ties in time are ordered by reason
    (healthy first), then probes last.
    """
    at = [F.col(order), F.asc_nulls_first("degraded"), F.col("probing")]
    healthy = F.col("degraded").isNull()
    rows = shards.withColumn("run", F.sum(healthy.cast("long")).over(Window.partitionBy(by).orderBy(*at).rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(by, "run", healthy).orderBy(*at).rowsBetween(Window.unboundedPreceding, 0)
    probes = F.sum(F.coalesce(F.col("probing"), F.lit(False)).cast("int")).over(inside) - F.first(F.coalesce(F.col("probing"), F.lit(False)).cast("int")).over(inside)
    cooldown = F.when(healthy, COOLDOWN).otherwise(F.least(F.lit(LONGEST), F.pow(F.lit(2.0), F.least(probes, F.lit(10))).cast("int") * COOLDOWN)).cast("int")
    out = rows.withColumn("cooldown", cooldown)
    return out.select(by, F.col(order).alias("at"), F.col("degraded").alias("why"), "cooldown", F.when(~healthy, F.col(order) + F.col("cooldown").cast("long") * 1_000_000).alias("until"))
