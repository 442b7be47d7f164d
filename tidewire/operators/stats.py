"""Grouped statistics, distributions, outliers and limit checks; native aggregates throughout."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.session import saved

Keys = Sequence[str]


def clean(value: str) -> Column:
    """NaN is a missing sample; aggregates skip nulls."""
    return F.when(~F.isnan(value), F.col(value))


def basic_stats(df: DataFrame, keys: Keys, value: str, ddof: int = 0) -> DataFrame:
    """Count, mean, variance, standard deviation, minimum, maximum and range per group."""
    v = clean(value)
    var = F.var_pop(v) if ddof == 0 else F.var_samp(v)
    return df.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), var.alias("variance"), F.sqrt(var).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"), (F.max(v) - F.min(v)).alias("range"),
    )


#: Relative rank error of the sketch that brackets exact percentiles is one in so many.
SKETCH = 10_000


def met(df: DataFrame, side: DataFrame, keys: Keys) -> DataFrame:
    """``df`` with the columns of ``side`` (one row per group) beside each row; null keys are a group. The
    optimizer broadcasts ``side`` by its size; without keys it has one row."""
    if not keys:
        return df.crossJoin(F.broadcast(side))
    own = side.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in side.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return df.join(own, reduce(Column.__and__, on)).drop(*[f"_k{i}" for i in range(len(keys))])


def percentiles(df: DataFrame, keys: Keys, value: str, at: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Exact, linearly interpolated percentiles, named p05 and so on; null for groups without values.

    A mergeable sketch brackets each percentile between two values a few ten-thousandths of the ranks
    apart. One combining count by value then covers what lies below a bracket as a whole and the values
    inside it singly, so that no group is held or sorted in one task. Groups too small for the sketch's
    error to matter are counted value by value.
    """
    v, eps = clean(value), 3 / SKETCH
    names = [f"p{round(q * 100):02d}" for q in at]
    probes = sorted({min(max(q + e, 0.0), 1.0) for q in at for e in (-eps, eps)})
    place = {p: i for i, p in enumerate(probes)}
    sketch = df.groupBy(*keys).agg(
        F.count(v).alias("_n"), F.percentile_approx(v, probes, SKETCH).alias("_p"), F.min(v).alias("_least"), F.max(v).alias("_most")
    )
    few = F.col("_n") < 2 * SKETCH
    probe = lambda p: F.get("_p", F.lit(place[min(max(p, 0.0), 1.0)])).cast("double")
    brackets = [
        F.struct(
            F.lit(i).alias("i"), F.when(few | F.lit(q <= eps), F.col("_least")).otherwise(probe(q - eps)).cast("double").alias("lo"),
            F.when(few | F.lit(q >= 1 - eps), F.col("_most")).otherwise(probe(q + eps)).cast("double").alias("hi"), (F.lit(float(q)) * (F.col("_n") - 1)).alias("rank"),
        )
        for i, q in enumerate(at)
    ]
    side = sketch.filter("_n > 0").select(*keys, F.array(*brackets).alias("_b"))
    rows = met(df.select(*keys, v.cast("double").alias("_v")).filter("_v is not null"), side, keys)
    inside = F.transform("_b", lambda b: F.when(F.col("_v") <= b.hi, F.struct(b.i.alias("i"), b["rank"].alias("rank"), F.when(F.col("_v") >= b.lo, F.col("_v")).alias("x"))))
    counts = rows.select(*keys, F.explode(F.array_compact(inside)).alias("_c")).groupBy(*keys, "_c.i", "_c.rank", "_c.x").agg(F.count("*").alias("_m"))
    upto = F.sum("_m").over(W.partitionBy(*keys, "i").orderBy(F.col("x").asc_nulls_first()))
    k = F.floor("rank")
    ends = counts.withColumn("_upto", upto).groupBy(*keys, "i").agg(
        F.min(F.when(F.col("_upto") > k, F.col("x"))).alias("_a"), F.min(F.when(F.col("_upto") > F.ceil("rank"), F.col("x"))).alias("_z"), F.first("rank").alias("_r")
    )
    part = F.col("_r") - F.floor("_r")
    found = ends.select(*keys, "i", F.when(part == 0, F.col("_a")).otherwise((1 - part) * F.col("_a") + part * F.col("_z")).alias("_q"))
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, F.col("_q"))).alias(n) for i, n in enumerate(names)])
    if not keys:
        return wide
    own = wide.select(*[F.col(x).alias(f"_k{i}") for i, x in enumerate(keys)], *names)
    on = reduce(Column.__and__, [F.col(x).eqNullSafe(F.col(f"_k{i}")) for i, x in enumerate(keys)])
    return sketch.select(*keys).join(own, on, "left").select(*keys, *names)


def inventory(df: DataFrame, keys: Keys, at: str, value: str, q: float = 0.95) -> DataFrame:
    """Rows, first and last time (microseconds), rows a second and a percentile per group."""
    dur = (F.max(at) - F.min(at)) / 1e6
    seen = df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(at).alias("first_us"), F.max(at).alias("last_us"), ((F.count("*") - 1) / dur).alias("frequency"))
    return met(seen, percentiles(df, keys, value, (q,)), keys)


def quartiles(df: DataFrame, keys: Keys, value: str, k: float = 1.5) -> DataFrame:
    """Quartiles, IQR and Tukey fences."""
    q = percentiles(df, keys, value, (0.25, 0.5, 0.75))
    iqr = F.col("p75") - F.col("p25")
    return q.select(
        *keys, F.col("p25").alias("q1"), F.col("p50").alias("median"), F.col("p75").alias("q3"), iqr.alias("iqr"),
        (F.col("p25") - k * iqr).alias("lower_fence"), (F.col("p75") + k * iqr).alias("upper_fence"),
    )


def weighted_stats(df: DataFrame, keys: Keys, value: str, weight: str, ddof: int = 0) -> DataFrame:
    """Weighted mean and deviation: sqrt(sum w (x - mean)^2 / (sum w - ddof))."""
    x, w = F.col(value), F.col(weight)
    sums = df.groupBy(*keys).agg(F.sum(w).alias("_w"), F.sum(w * x).alias("_wx"), F.sum(w * x * x).alias("_wxx"))
    mean = F.col("_wx") / F.col("_w")
    spread = F.greatest(F.col("_wxx") - F.col("_w") * mean * mean, F.lit(0.0)) / (F.col("_w") - ddof)
    return sums.select(*keys, mean.alias("weighted_mean"), F.sqrt(spread).alias("weighted_std"))


def distribution(df: DataFrame, keys: Keys, value: str) -> DataFrame:
    """RMS, crest factor, population skewness, excess kurtosis and bimodality coefficient."""
    v = clean(value)
    a = df.groupBy(*keys).agg(
        F.count(v).alias("n"), F.sqrt(F.avg(v * v)).alias("rms"), F.max(F.abs(v)).alias("peak"),
        F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"),
    )
    n = F.col("n").cast("double")
    bimodal = (F.col("skewness") ** 2 + 1) / (F.col("kurtosis") + 3 * (n - 1) ** 2 / ((n - 2) * (n - 3)))
    crest = F.when(F.col("rms") > 0, F.col("peak") / F.col("rms"))
    return a.select(*keys, "n", "rms", crest.alias("crest_factor"), "skewness", "kurtosis", F.when(n > 3, bimodal).alias("bimodality"))


def moment(df: DataFrame, keys: Keys, value: str, order: int, central: bool = True) -> DataFrame:
    """k-th central or raw moment; the means are aggregated first and met by each row."""
    if not central:
        return df.groupBy(*keys).agg(F.avg(F.col(value) ** order).alias("moment"))
    rows = met(df.select(*keys, value), df.groupBy(*keys).agg(F.avg(value).alias("_mean")), keys)
    return rows.groupBy(*keys).agg(F.avg((F.col(value) - F.col("_mean")) ** order).alias("moment"))


def histogram(df: DataFrame, keys: Keys, value: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """Counts in equal bins; the last edge is closed. Without bounds each group's own range is used."""
    span = df.groupBy(*keys).agg(
        (F.lit(low) if low is not None else F.min(value)).cast("double").alias("_lo"),
        (F.lit(high) if high is not None else F.max(value)).cast("double").alias("_hi"),
    )
    joined = met(df, span, keys)
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(F.col(value) == F.col("_hi"), bins - 1).otherwise(F.floor((F.col(value) - F.col("_lo")) / width))
    inside = joined.filter((F.col(value) >= F.col("_lo")) & (F.col(value) <= F.col("_hi")))
    return inside.groupBy(*keys, at.cast("int").alias("bin")).agg(
        F.count("*").alias("n"), F.first(F.col("_lo")).alias("_a"), F.first(width).alias("_w")
    ).select(*keys, "bin", (F.col("_a") + F.col("bin") * F.col("_w")).alias("bin_start"), "n")


def correlation(df: DataFrame, keys: Keys, x: str, y: str) -> DataFrame:
    """Pearson r; 0 where a side does not vary."""
    r = F.corr(x, y)
    return df.groupBy(*keys).agg(F.coalesce(F.when(F.isnan(r), 0.0).otherwise(r), F.lit(0.0)).alias("r"))


def regression(df: DataFrame, keys: Keys, x: str, y: str) -> DataFrame:
    """Least-squares slope, intercept and r squared."""
    return df.groupBy(*keys).agg(
        F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
        F.regr_r2(F.col(y), F.col(x)).alias("r2"), F.count("*").alias("n"),
    )


def zscore_outliers(df: DataFrame, keys: Keys, value: str, threshold: float = 3.0) -> DataFrame:
    """Rows with |x - mean| / s (n - 1) above the threshold; groups under 3 rows or without spread have none."""
    side = df.groupBy(*keys).agg(F.count(value).alias("_n"), F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    rows = met(df, side.filter("_n >= 3 and _s >= 1e-12"), keys)
    return rows.withColumn("zscore", (F.col(value) - F.col("_m")) / F.col("_s")).filter(F.abs("zscore") > threshold).drop("_n", "_m", "_s")


def modified_zscore_outliers(df: DataFrame, keys: Keys, value: str, threshold: float = 3.5) -> DataFrame:
    """Rows with 0.6745 |x - median| / MAD above the threshold; a vanishing MAD is replaced by max deviation / (2 threshold)."""
    med = percentiles(df, keys, value, (0.5,)).withColumnRenamed("p50", "_m")
    dev = met(df, med, keys).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    tops = dev.groupBy(*keys).agg(F.max("_d").alias("_top"), F.count("*").alias("_n"))
    mad = met(tops, percentiles(dev, keys, "_d", (0.5,)).withColumnRenamed("p50", "_mad"), keys)
    scale = F.when(F.col("_mad") < 1e-12, F.col("_top") / (2 * threshold)).otherwise(F.col("_mad") / 0.6745)
    z = (F.col(value) - F.col("_m")) / scale
    out = met(dev, mad, keys).withColumn("modified_zscore", F.when((F.col("_n") >= 3) & (scale > 0), z))
    return out.filter(F.abs("modified_zscore") > threshold).drop("_m", "_d", "_mad", "_top", "_n")


def iqr_outliers(df: DataFrame, keys: Keys, value: str, k: float = 1.5) -> DataFrame:
    """Rows outside the Tukey fences of their group (4 rows at least)."""
    fences = quartiles(df, keys, value, k).select(*keys, "lower_fence", "upper_fence")
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    out = met(df, met(fences, n, keys), keys).filter("_n >= 4").drop("_n")
    return out.filter((F.col(value) < F.col("lower_fence")) | (F.col(value) > F.col("upper_fence")))


def clip_outliers(df: DataFrame, keys: Keys, value: str, k: float = 1.5) -> DataFrame:
    """Values moved to their group's nearest Tukey fence."""
    out = met(df, quartiles(df, keys, value, k).select(*keys, "lower_fence", "upper_fence"), keys)
    return out.withColumn(value, F.greatest(F.least(F.col(value), "upper_fence"), "lower_fence")).drop("lower_fence", "upper_fence")


def aggregate_results(df: DataFrame, metrics: Sequence[str], outlier_threshold: float = 3.0) -> DataFrame:
    """Per metric column: count, mean, sample deviation, extremes, quartiles and outliers beyond (threshold / 3) * 1.5 IQR."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("m")).select("m.*")
    stats = long.groupBy("metric").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")
    )
    middle = percentiles(long, ["metric"], "v", (0.25, 0.5, 0.75)).withColumnsRenamed({"p25": "q25", "p50": "median", "p75": "q75"})
    stats = met(stats, middle, ["metric"])
    k = outlier_threshold / 3 * 1.5
    f = F.broadcast(stats.select("metric", "q25", "q75", "n"))
    iqr = F.col("q75") - F.col("q25")
    odd = long.join(f, "metric").filter("n > 3").filter((F.col("v") < F.col("q25") - k * iqr) | (F.col("v") > F.col("q75") + k * iqr))
    return stats.join(odd.groupBy("metric").agg(F.count("*").alias("outliers")), "metric", "left").fillna(0, ["outliers"])


def check_limits(df: DataFrame, keys: Keys, value: str, low: float, high: float) -> DataFrame:
    """Violations and margins of a band per group."""
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(v < low).alias("below"), F.count_if(v > high).alias("above"),
        (F.lit(high) - F.max(v)).alias("upper_margin"), (F.min(v) - F.lit(low)).alias("lower_margin"),
        (F.count_if((v < low) | (v > high)) == 0).alias("passed"),
    )


def normalize(df: DataFrame, keys: Keys, value: str, method: str = "minmax") -> DataFrame:
    """``normalized``: minmax to [0, 1], zscore (population) or by the absolute peak; 0 without spread."""
    v = F.col(value)
    scale = {"minmax": (F.min(v), F.max(v) - F.min(v)), "zscore": (F.avg(v), F.stddev_pop(v)), "peak": (F.lit(0.0), F.max(F.abs(v)))}
    if method not in scale:
        raise ValueError(f"unknown method {method!r}")
    low, size = scale[method]
    rows = met(df, df.groupBy(*keys).agg(low.alias("_low"), size.alias("_size")), keys)
    return rows.withColumn("normalized", F.when(F.col("_size") > 0, (v - F.col("_low")) / F.col("_size")).otherwise(0.0)).drop("_low", "_size")


def drift_segments(df: DataFrame, keys: Keys, order: Sequence[str], x: str, value: str, size: int) -> DataFrame:
    """Regression slope of each run of ``size`` consecutive rows."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    return regression(df.withColumn("segment", F.floor(n / size).cast("long")), [*keys, "segment"], x, value)


def difference_of_means(df: DataFrame, keys: Keys, selector: Column, value: str) -> DataFrame:
    """Mean where the selector holds less the mean where it does not, and Welch's t."""
    v = F.col(value)
    a, b = F.when(selector, v), F.when(~selector, v)
    g = df.groupBy(*keys).agg(
        F.avg(a).alias("m1"), F.avg(b).alias("m0"), F.var_samp(a).alias("v1"), F.var_samp(b).alias("v0"), F.count(a).alias("n1"), F.count(b).alias("n0")
    )
    se = F.sqrt(F.col("v1") / F.col("n1") + F.col("v0") / F.col("n0"))
    d = F.col("m1") - F.col("m0")
    return g.select(*keys, d.alias("difference"), F.when(se > 0, d / se).alias("t"), "n1", "n0")


def numbered(df: DataFrame, keys: Keys, order: Keys, name: str) -> DataFrame:
    """``name``: each row's place, from 0, in its group's order.

    Rows are dealt by ranges of (keys, order) and numbered within each range; the rows of a group in
    earlier ranges are added from one count per group and range. So a long group spreads over tasks.
    """
    spread = df.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id())
    # Written once: ranges are drawn from a sample, and both reads must see the same ones.
    own = saved(spread.withColumn("_i", F.row_number().over(W.partitionBy("_p", *keys).orderBy(*order)) - 1))
    counts = own.groupBy(*keys, "_p").agg(F.count("*").alias("_c"))
    by = W.partitionBy(*keys).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # a row per range of a group
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(by), F.lit(0))).drop("_c")
    return met(own, before, [*keys, "_p"]).withColumn(name, F.col("_i") + F.col("_before")).drop("_p", "_i", "_before")


def latency(df: DataFrame, keys: Keys, delay: str) -> DataFrame:
    """Count, mean, population deviation, extremes and percentiles 50, 95 and 99 of delays of 0 or more."""
    d = df.filter(F.col(delay) >= 0)
    g = d.groupBy(*keys).agg(F.count(delay).alias("n"), F.avg(delay).alias("mean"), F.stddev_pop(delay).alias("std"), F.min(delay).alias("min"), F.max(delay).alias("max"))
    return met(g, percentiles(d, keys, delay, (0.5, 0.95, 0.99)), keys)
