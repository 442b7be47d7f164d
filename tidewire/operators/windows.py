"""Analytic windows over ordered rows: rolling, differences, gaps, islands, rates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.operators.stats import met, percentiles

Keys = Sequence[str]


def seconds(ts: str) -> Column:
    """Microsecond timestamp as double seconds."""
    return F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6)


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def running_stats(df: DataFrame, keys: Keys, order: Keys, value: str, size: int) -> DataFrame:
    """Trailing mean, population deviation, minimum and maximum over full windows of ``size`` rows."""
    by = W.partitionBy(*keys).orderBy(*order)
    w = by.rowsBetween(1 - size, 0)
    out = df.withColumns({
        "rolling_mean": F.avg(value).over(w), "rolling_std": F.stddev_pop(value).over(w), "rolling_min": F.min(value).over(w),
        "rolling_max": F.max(value).over(w), "_n": F.row_number().over(by),
    })
    return out.filter(F.col("_n") >= size).drop("_n")


def moving_average(df: DataFrame, keys: Keys, order: Keys, value: str, size: int) -> DataFrame:
    """Trailing mean of ``size`` samples; before the start the first sample is repeated."""
    by = W.partitionBy(*keys).orderBy(*order)
    n, first = F.row_number().over(by), F.first(value).over(by)
    total = F.sum(value).over(by.rowsBetween(1 - size, 0)) + F.greatest(F.lit(size) - n, F.lit(0)) * first
    return df.withColumn("moving_average", total / size)


def exponential_average(df: DataFrame, keys: Keys, order: Keys, value: str, alpha: float, negligible: float = 1e-12) -> DataFrame:
    """y = alpha x + (1 - alpha) y', from the first sample on.

    Written as a fold over the trailing samples whose weight (1 - alpha) ** k is not negligible, so it
    stays a native window and no state runs through a whole trace.
    """
    back = max(1, math.ceil(math.log(negligible) / math.log(1 - alpha))) if alpha < 1 else 1
    by = W.partitionBy(*keys).orderBy(*order)
    held = F.collect_list(value).over(by.rowsBetween(-back, 0))
    fold = F.aggregate(F.slice("_held", 2, back), F.element_at("_held", 1), lambda y, x: F.lit(alpha) * x + F.lit(1 - alpha) * y)
    return df.withColumn("_held", held).withColumn("ema", fold).drop("_held")


def difference(df: DataFrame, keys: Keys, order: Keys, value: str) -> DataFrame:
    """First difference; 0 for the first row."""
    by = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("diff", F.coalesce(F.col(value) - F.lag(value).over(by), F.lit(0.0)))


def differentiate(df: DataFrame, keys: Keys, order: Keys, value: str, dt: float = 1.0) -> DataFrame:
    """Central differences, one-sided at the ends."""
    by = W.partitionBy(*keys).orderBy(*order)
    before, after, v = F.lag(value).over(by), F.lead(value).over(by), F.col(value)
    slope = F.when(before.isNull(), (after - v) / dt).when(after.isNull(), (v - before) / dt).otherwise((after - before) / (2 * dt))
    return df.withColumn("derivative", slope)


def integrate(df: DataFrame, keys: Keys, order: Keys, value: str, dt: float = 1.0, initial: float = 0.0) -> DataFrame:
    """Cumulative trapezoid."""
    by = W.partitionBy(*keys).orderBy(*order)
    part = F.coalesce((F.col(value) + F.lag(value).over(by)) * (dt / 2), F.lit(0.0))
    return df.withColumn("_part", part).withColumn("integral", F.sum("_part").over(by) + initial).drop("_part")


def inter_arrival(df: DataFrame, keys: Keys, order: Keys, at: str) -> DataFrame:
    """Statistics of the time between rows, and RFC 3550 style mean absolute change / 16 smoothing input."""
    by = W.partitionBy(*keys).orderBy(*order)
    gap = df.withColumn("_iat", F.col(at) - F.lag(at).over(by))
    gap = gap.withColumn("_d", F.abs(F.col("_iat") - F.lag("_iat").over(by)))
    return gap.groupBy(*keys).agg(
        F.count("_iat").alias("n"), F.avg("_iat").alias("mean_iat"), F.stddev_pop("_iat").alias("std_iat"),
        F.min("_iat").alias("min_iat"), F.max("_iat").alias("max_iat"), F.avg("_d").alias("mean_change"),
    )


def gaps_by_time(df: DataFrame, keys: Keys, order: Keys, at: str, tolerance: float = 0.5) -> DataFrame:
    """Intervals above median * (1 + tolerance), with the rows that they miss (rounded half to even)."""
    by = W.partitionBy(*keys).orderBy(*order)
    iat = df.withColumn("gap", F.col(at) - F.lag(at).over(by)).withColumn("gap_start", F.lag(at).over(by)).filter("gap is not null")
    usual = percentiles(iat.withColumn("gap", F.col("gap").cast("double")), keys, "gap", (0.5,)).withColumnRenamed("p50", "expected")
    out = met(iat, usual, keys).filter((F.col("expected") > 0) & (F.col("gap") > F.col("expected") * (1 + tolerance)))
    return out.withColumn("missing", (F.bround(F.col("gap") / F.col("expected")) - 1).cast("long"))


def sequence_loss(df: DataFrame, keys: Keys, sequence: str) -> DataFrame:
    """Sequence numbers lost between the first and the last, duplicates, and the loss rate."""
    one = df.filter(F.col(sequence).isNotNull()).groupBy(*keys).agg(
        F.min(sequence).alias("first"), F.max(sequence).alias("last"), F.count("*").alias("received"), F.count_distinct(sequence).alias("_u")
    )
    span = F.col("last") - F.col("first") + 1
    return one.select(
        *keys, "first", "last", "received", (F.col("received") - F.col("_u")).alias("duplicates"), (span - F.col("_u")).alias("lost"), ((span - F.col("_u")) / span).alias("loss_rate")
    )


def sequence_gaps(df: DataFrame, keys: Keys, sequence: str) -> DataFrame:
    """Each run of absent sequence numbers."""
    by = W.partitionBy(*keys).orderBy(sequence)
    nxt = df.select(*keys, sequence).distinct().withColumn("_next", F.lead(sequence).over(by))
    return nxt.filter(F.col("_next") > F.col(sequence) + 1).select(
        *keys, (F.col(sequence) + 1).alias("gap_from"), (F.col("_next") - 1).alias("gap_to"), (F.col("_next") - F.col(sequence) - 1).alias("missing")
    )


def islands(df: DataFrame, keys: Keys, order: Keys, state: Column, at: str, least: int = 1) -> DataFrame:
    """Runs of equal state of ``least`` rows at least: state, rows, first and last ``at``."""
    by = W.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("state", state)
    marked = marked.withColumn("_new", F.when(F.col("state").eqNullSafe(F.lag("state").over(by)), 0).otherwise(1))
    marked = marked.withColumn("run", F.sum("_new").over(by))
    return marked.groupBy(*keys, "run", "state").agg(F.count("*").alias("n"), F.min(at).alias("start"), F.max(at).alias("stop")).filter(F.col("n") >= least)


def sessions(df: DataFrame, keys: Keys, order: Keys, at: str, gap: float) -> DataFrame:
    """Rows grouped where the time between neighbours is at most ``gap``."""
    by = W.partitionBy(*keys).orderBy(*order)
    new = F.when(F.col(at) - F.lag(at).over(by) <= gap, 0).otherwise(1)
    marked = df.withColumn("_new", new).withColumn("session", F.sum("_new").over(by))
    return marked.groupBy(*keys, "session").agg(F.count("*").alias("n"), F.min(at).alias("start"), F.max(at).alias("stop"))


def hopping_throughput(df: DataFrame, at: str, size: str, window: float, step: float | None = None) -> DataFrame:
    """Rows and bytes in windows [s, s + window), from the first row on by ``step`` (half a window);
    only full windows, empty ones included. Each row goes to the windows that hold it: no self join."""
    step = step or window / 2
    bounds = df.agg(F.min(at).alias("_t0"), F.max(at).alias("_t1"))
    count = F.floor((F.col("_t1") - F.col("_t0") - window) / step + 1e-9).cast("long")
    grid = bounds.filter(F.col("_t1") - F.col("_t0") >= window).select("_t0", F.explode(F.sequence(F.lit(0).cast("long"), count)).alias("w"))
    rel = df.crossJoin(F.broadcast(bounds)).withColumn("_r", F.col(at) - F.col("_t0"))  # one row of bounds
    low = F.greatest(F.floor((F.col("_r") - window) / step + 1e-9) + 1, F.lit(0)).cast("long")
    high = F.floor(F.col("_r") / step + 1e-9).cast("long")
    put = rel.filter(low <= high).select(size, F.explode(F.sequence(low, high)).alias("w"))
    sums = put.groupBy("w").agg(F.count("*").alias("n"), F.sum(size).alias("total"))
    out = grid.join(sums, "w", "left").fillna(0, ["n", "total"])
    return out.select("w", (F.col("_t0") + F.col("w") * step).alias("start"), "n", "total", (F.col("total") / window).alias("rate"))


def rate_anomalies(df: DataFrame, keys: Keys, order: Keys, at: str, size: int, threshold: float = 3.0) -> DataFrame:
    """Count windows of ``size`` rows whose rate size / span lies beyond ``threshold`` population deviations of all."""
    by = W.partitionBy(*keys).orderBy(*order)
    span = F.lead(at, size - 1).over(by) - F.col(at)
    rated = df.withColumn("rate", F.when(span > 0, size / span)).filter("rate is not null")
    all_ = rated.groupBy(*keys).agg(F.avg("rate").alias("_m"), F.stddev_pop("rate").alias("_s")).filter("_s > 0")
    return met(rated, all_, keys).withColumn("z", (F.col("rate") - F.col("_m")) / F.col("_s")).filter(F.abs("z") > threshold).drop("_m", "_s")


def cycle_jitter(df: DataFrame, keys: Keys, order: Keys, period: str) -> DataFrame:
    """Cycle-to-cycle jitter (rms and spread of absolute changes) and period jitter per group of periods."""
    by = W.partitionBy(*keys).orderBy(*order)
    c = df.withColumn("_c", F.abs(F.col(period) - F.lag(period).over(by)))
    return c.groupBy(*keys).agg(
        F.count(period).alias("n"), F.sqrt(F.avg(F.col("_c") ** 2)).alias("c2c_rms"), (F.max("_c") - F.min("_c")).alias("c2c_pp"),
        F.avg(period).alias("period_mean"), F.stddev_pop(period).alias("period_std"), (F.max(period) - F.min(period)).alias("period_pp"),
    ).filter("n >= 3")


def time_interval_error(df: DataFrame, keys: Keys, order: Keys, at: str, period: float | None = None) -> DataFrame:
    """Edge time less the ideal (first + n * period); the mean period by default; 3 edges at least."""
    span = df.groupBy(*keys).agg(F.min(at).alias("_a"), F.max(at).alias("_z"), F.count("*").alias("_count")).filter("_count >= 3")
    t = F.lit(period) if period else (F.col("_z") - F.col("_a")) / (F.col("_count") - 1)
    rows = met(df.withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1), span, keys)
    return rows.withColumn("tie", F.col(at) - (F.col("_a") + F.col("_i") * t)).drop("_a", "_z", "_count", "_i")


def transitions(df: DataFrame, keys: Keys, order: Keys, state: str) -> DataFrame:
    """Counts and probabilities of the next state."""
    by = W.partitionBy(*keys).orderBy(*order)
    pairs = df.withColumn("next_state", F.lead(state).over(by)).filter("next_state is not null")
    counts = pairs.groupBy(state, "next_state").agg(F.count("*").alias("n"))
    total = counts.groupBy(state).agg(F.sum("n").alias("_all"))
    return met(counts, total, [state]).withColumn("probability", F.col("n") / F.col("_all")).drop("_all")


def sequences(df: DataFrame, keys: Keys, order: Keys, state: str, length: int, at: str | None = None, within: float | None = None) -> DataFrame:
    """Consecutive states as n-grams with their support; ``within`` bounds their time span."""
    by = W.partitionBy(*keys).orderBy(*order)
    parts = [F.col(state), *[F.lead(state, k).over(by) for k in range(1, length)]]
    grams = df.withColumn("_last", parts[-1]).withColumn("sequence", F.concat_ws(">", *parts))
    if within is not None:
        grams = grams.withColumn("_span", F.lead(at, length - 1).over(by) - F.col(at)).filter(F.col("_span") <= within)
    return grams.filter("_last is not null").groupBy("sequence").agg(F.count("*").alias("n"))


def autocorrelation(df: DataFrame, keys: Keys, order: Keys, value: str, lags: int) -> DataFrame:
    """Mean-removed autocorrelation for lags 0..lags, normalised by lag 0."""
    by = W.partitionBy(*keys).orderBy(*order)
    x = met(df, df.groupBy(*keys).agg(F.avg(value).alias("_m")), keys).withColumn("_x", F.col(value) - F.col("_m"))
    prod = x.select(*keys, *[(F.col("_x") * F.lead("_x", k).over(by)).alias(f"_l{k}") for k in range(lags + 1)])
    sums = prod.groupBy(*keys).agg(*[F.sum(f"_l{k}").alias(f"_l{k}") for k in range(lags + 1)])
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"_l{k}") / F.col("_l0")).alias("acf")) for k in range(lags + 1)])
    return sums.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.lag", "r.acf")


def timing_anomalies(df: DataFrame, keys: Keys, order: Keys, at: str, threshold: float = 3.0) -> DataFrame:
    """Rows whose time since the one before lies beyond ``threshold`` population deviations of all such times."""
    gaps = df.withColumn("gap", F.col(at) - F.lag(at).over(W.partitionBy(*keys).orderBy(*order))).filter("gap is not null")
    side = gaps.agg(F.avg("gap").alias("_m"), F.stddev_pop("gap").alias("_s")).filter("_s > 0")
    return met(gaps, side, []).withColumn("z", (F.col("gap") - F.col("_m")) / F.col("_s")).filter(F.abs("z") > threshold).drop("_m", "_s")


def smoothed_jitter(df: DataFrame, keys: Keys, order: Keys, at: str) -> DataFrame:
    """Interarrival jitter j += (|change of interval| - j) / 16 from j = 0, as a window of the weights that matter."""
    by = W.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("_g", F.col(at) - F.lag(at).over(by)).withColumn("_d", F.abs(F.col("_g") - F.lag("_g").over(by)).cast("double")).filter("_d is not null")
    back = math.ceil(math.log(1e-12) / math.log(15 / 16))
    held = F.collect_list("_d").over(by.rowsBetween(-back, 0))
    return d.withColumn("_h", held).withColumn("jitter", F.aggregate("_h", F.lit(0.0), lambda j, x: j + (x - j) / 16)).drop("_g", "_d", "_h")


def sequence_patterns(df: DataFrame, keys: Keys, order: Keys, state: str, lengths: Sequence[int], least: int) -> DataFrame:
    """Consecutive states of the given lengths that occur at least so often."""
    out = None
    for n in lengths:
        s = sequences(df, keys, order, state, n).filter(F.col("n") >= least).withColumn("length", F.lit(n))
        out = s if out is None else out.unionByName(s)
    return out


def temporal_patterns(df: DataFrame, keys: Keys, order: Keys, state: str, at: str, gap: float, length: int) -> DataFrame:
    """Consecutive states whose neighbours are at most ``gap`` apart, with their count and mean span."""
    by = W.partitionBy(*keys).orderBy(*order)
    times = [F.col(at), *[F.lead(at, k).over(by) for k in range(1, length)]]
    near = F.lit(True)
    for a, b in zip(times[:-1], times[1:], strict=True):
        near = near & (b - a <= gap)
    parts = [F.col(state), *[F.lead(state, k).over(by) for k in range(1, length)]]
    rows = df.select(F.concat_ws(">", *parts).alias("sequence"), near.alias("_ok"), (times[-1] - times[0]).alias("_span")).filter("_ok")
    return rows.groupBy("sequence").agg(F.count("*").alias("n"), F.avg("_span").alias("mean_span"))
