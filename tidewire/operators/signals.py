"""Signals as rows: levels, alignment, trends, distributions, power and limits, written as native aggregates.

A sample is a row with key columns, an order and a value. Group values come from aggregates that meet
the rows again (``stats.met``); only operators on neighbouring samples use ordered windows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.operators.joins import asof_merge
from tidewire.operators.stats import met, percentiles, regression

Keys = Sequence[str]

# ---- time and selection ----------------------------------------------------------------------


def sample_time(index: Column, fs: float, t0: float = 0.0) -> Column:
    """Time of a sample in seconds."""
    return index / F.lit(float(fs)) + F.lit(float(t0))


def durations(df: DataFrame, keys: Keys, fs: float) -> DataFrame:
    """Samples and length (n - 1) / fs of each trace."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), ((F.count("*") - 1) / float(fs)).alias("duration"))


def region(df: DataFrame, at: str, start: float | None = None, stop: float | None = None) -> DataFrame:
    """Rows with start <= at < stop; the filter reaches the scan."""
    df = df if start is None else df.filter(F.col(at) >= start)
    return df if stop is None else df.filter(F.col(at) < stop)


def skip(df: DataFrame, order: Keys, n: int) -> DataFrame:
    """All but the first ``n`` rows by ``order``."""
    return df.orderBy(*order).offset(n)


def batches(df: DataFrame, keys: Keys, order: Keys, size: int) -> DataFrame:
    """``batch``: the number of each run of ``size`` rows of a group."""
    return df.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1) / size).cast("long"))


def trim_idle(df: DataFrame, keys: Keys, at: str, level: str) -> DataFrame:
    """Rows of a digital trace without the leading and trailing run of its first and last level.

    Both ends follow from four aggregates: the first and last place of each level."""
    ends = df.groupBy(*keys).agg(F.min_by(level, at).alias("_a"), F.max_by(level, at).alias("_z"))
    side = met(df, ends, keys).groupBy(*keys).agg(
        F.min(F.when(F.col(level) != F.col("_a"), F.col(at))).alias("_from"), F.max(F.when(F.col(level) != F.col("_z"), F.col(at))).alias("_upto")
    )
    return met(df, side, keys).filter((F.col(at) >= F.col("_from")) & (F.col(at) <= F.col("_upto"))).drop("_from", "_upto")


# ---- levels and digital signals --------------------------------------------------------------


def auto_threshold(df: DataFrame, keys: Keys, value: str) -> DataFrame:
    """``threshold``: the middle between percentiles 10 and 90."""
    p = percentiles(df, keys, value, (0.1, 0.9))
    return p.select(*keys, ((F.col("p10") + F.col("p90")) / 2).alias("threshold"))


def to_digital(df: DataFrame, keys: Keys, value: str, threshold: float | None = None) -> DataFrame:
    """``digital``: value at or above the threshold, by default each trace's own."""
    if threshold is not None:
        return df.withColumn("digital", F.col(value) >= threshold)
    return met(df, auto_threshold(df, keys, value), keys).withColumn("digital", F.col(value) >= F.col("threshold"))


def adaptive_threshold(df: DataFrame, keys: Keys, order: Keys, value: str, size: int) -> DataFrame:
    """``digital`` against the mean of the ``size`` samples around each."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(-(size // 2), size - size // 2 - 1)
    return df.withColumn("threshold", F.avg(value).over(w)).withColumn("digital", F.col(value) >= F.col("threshold"))


def hysteresis(df: DataFrame, keys: Keys, order: Keys, value: str, low: float, high: float) -> DataFrame:
    """``digital``: true from reaching ``high`` until falling below ``low``; before either, false."""
    mark = F.when(F.col(value) >= high, True).when(F.col(value) < low, False)
    by = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("_m", mark).withColumn("digital", F.coalesce(F.last("_m", True).over(by), F.lit(False))).drop("_m")


def align_by_trigger(df: DataFrame, keys: Keys, at: str, value: str, level: float) -> DataFrame:
    """``aligned``: time since the trace's first sample at or above ``level`` whose predecessor is below; traces without one go."""
    by = W.partitionBy(*keys).orderBy(at)
    up = df.withColumn("_b", F.lag(value).over(by)).filter((F.col("_b") < level) & (F.col(value) >= level))
    return met(df, up.groupBy(*keys).agg(F.min(at).alias("_first")), keys).withColumn("aligned", F.col(at) - F.col("_first")).drop("_first")


def channel_skew(edges: DataFrame, keys: Keys, channel: str, at: str, reference: str) -> DataFrame:
    """First edge of each channel less that of the reference channel, per group."""
    first = edges.groupBy(*keys, channel).agg(F.min(at).alias("first"))
    ref = first.filter(F.col(channel) == reference).select(*keys, F.col("first").alias("_ref"))
    return met(first, ref, keys).withColumn("skew", F.col("first") - F.col("_ref")).drop("_ref")


def interpolated(left: DataFrame, right: DataFrame, keys: Keys, at: str, value: str) -> DataFrame:
    """``left`` with ``interpolated``: the right trace's value at each left time, linear between its samples
    and null outside them. Two as-of sorts, whatever the rates."""
    r = right.select(*keys, F.col(at).alias("_rt"), F.col(value).alias("_rv"))
    a = asof_merge(left, r, keys, at, "_rt", ["_rv"]).withColumnsRenamed({"asof_t": "_t0", "asof__rv": "_v0"})
    b = asof_merge(a, r, keys, at, "_rt", ["_rv"], forward=True).withColumnsRenamed({"asof_t": "_t1", "asof__rv": "_v1"})
    part = F.when(F.col("_t1") > F.col("_t0"), (F.col(at) - F.col("_t0")) / (F.col("_t1") - F.col("_t0"))).otherwise(0.0)
    both = F.col("_t0").isNotNull() & F.col("_t1").isNotNull()
    return b.select(*left.columns, F.when(both, F.col("_v0") + part * (F.col("_v1") - F.col("_v0"))).alias("interpolated"))


def downsample(df: DataFrame, keys: Keys, index: str, value: str, factor: int, method: str = "average") -> DataFrame:
    """One value of each ``factor`` samples (index from 0): decimate (the first), average, max or min; an incomplete tail is dropped."""
    v = F.col(value)
    pick = {"decimate": F.min_by(v, F.col(index)), "average": F.avg(v), "max": F.max(v), "min": F.min(v)}[method]
    g = df.groupBy(*keys, F.floor(F.col(index) / factor).alias("idx")).agg(pick.alias("value"), F.count("*").alias("_n"))
    return g.filter(F.col("_n") == factor).drop("_n")


# ---- trends ----------------------------------------------------------------------------------


def detrend(df: DataFrame, keys: Keys, x: str, value: str, method: str = "linear") -> DataFrame:
    """``detrended``: the value less the group's mean or least-squares line."""
    if method == "constant":
        side = df.groupBy(*keys).agg(F.avg(value).alias("_m"))
        return met(df, side, keys).withColumn("detrended", F.col(value) - F.col("_m")).drop("_m")
    side = regression(df, keys, x, value).select(*keys, F.col("slope").alias("_s"), F.col("intercept").alias("_i"))
    return met(df, side, keys).withColumn("detrended", F.col(value) - (F.col("_s") * F.col(x) + F.col("_i"))).drop("_s", "_i")


def piecewise_linear(df: DataFrame, keys: Keys, x: str, value: str, pieces: int) -> DataFrame:
    """Least-squares line of each of ``pieces`` equal stretches of a group's x range."""
    span = df.groupBy(*keys).agg(F.min(x).alias("_a"), F.max(x).alias("_z"))
    part = F.floor((F.col(x) - F.col("_a")) * pieces / (F.col("_z") - F.col("_a"))).cast("int")
    rows = met(df, span.filter("_z > _a"), keys).withColumn("piece", F.least(part, F.lit(pieces - 1)))
    return regression(rows, [*keys, "piece"], x, value)


def regularised_times(df: DataFrame, keys: Keys, order: Keys, at: str) -> DataFrame:
    """``regular``: the time that a constant rate, fitted over the group, gives to each row."""
    rows = df.withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("double"))
    fit = regression(rows.withColumn("_t", F.col(at).cast("double")), keys, "_i", "_t").select(*keys, F.col("slope").alias("_s"), F.col("intercept").alias("_c"))
    return met(rows, fit, keys).withColumn("regular", F.col("_s") * F.col("_i") + F.col("_c")).drop("_i", "_s", "_c")


def cross_correlation(df: DataFrame, keys: Keys, order: Keys, a: str, b: str, lags: int) -> DataFrame:
    """Sum of (a[i] - mean)(b[i + lag] - mean) for lags -lags .. lags, by the square root of both energies."""
    by = W.partitionBy(*keys).orderBy(*order)
    x = met(df, df.groupBy(*keys).agg(F.avg(a).alias("_ma"), F.avg(b).alias("_mb")), keys).withColumns({"_a": F.col(a) - F.col("_ma"), "_b": F.col(b) - F.col("_mb")})
    shift = lambda k: F.lead("_b", k).over(by) if k >= 0 else F.lag("_b", -k).over(by)
    span = range(-lags, lags + 1)
    prod = x.select(*keys, "_a", "_b", *[(F.col("_a") * shift(k)).alias(f"_l{k + lags}") for k in span])
    sums = prod.groupBy(*keys).agg(F.sqrt(F.sum(F.col("_a") ** 2) * F.sum(F.col("_b") ** 2)).alias("_e"), *[F.sum(f"_l{k + lags}").alias(f"_l{k + lags}") for k in span])
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), F.when(F.col("_e") > 0, F.col(f"_l{k + lags}") / F.col("_e")).alias("r")) for k in span])
    return sums.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.lag", "_r.r")


def peak_lag(correlation: DataFrame, keys: Keys) -> DataFrame:
    """The lag of largest absolute correlation (the smallest lag on ties)."""
    top = correlation.groupBy(*keys).agg(F.max(F.struct(F.abs("r").alias("m"), (-F.col("lag")).alias("l"), F.col("r").alias("r"))).alias("_p"))
    return top.select(*keys, (-F.col("_p.l")).alias("peak_lag"), F.col("_p.r").alias("peak"))


def period_of(acf: DataFrame, keys: Keys, least: int = 2) -> DataFrame:
    """First local maximum of an autocorrelation (``lag, acf``) from lag ``least`` on: period and strength."""
    by = W.partitionBy(*keys).orderBy("lag")
    a = acf.withColumns({"_p": F.lag("acf").over(by), "_n": F.lead("acf").over(by)}).filter((F.col("lag") >= least) & (F.col("acf") > F.col("_p")) & (F.col("acf") >= F.col("_n")))
    return a.groupBy(*keys).agg(F.min_by("lag", "lag").alias("period"), F.min_by("acf", "lag").alias("strength"))


# ---- distributions ---------------------------------------------------------------------------


def summary_stats(df: DataFrame, keys: Keys, value: str) -> DataFrame:
    """Count, mean, deviation, extremes, quartiles, median absolute deviation, RMS and crest factor."""
    v = F.col(value)
    base = df.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.sqrt(F.avg(v * v)).alias("rms"), F.max(F.abs(v)).alias("_pk")
    )
    q = percentiles(df, keys, value, (0.25, 0.5, 0.75)).withColumnsRenamed({"p25": "q1", "p50": "median", "p75": "q3"})
    dev = met(df, q.select(*keys, F.col("median").alias("_m")), keys).withColumn("_d", F.abs(v - F.col("_m")))
    mad = percentiles(dev, keys, "_d", (0.5,)).withColumnRenamed("p50", "mad")
    out = met(met(base, q, keys), mad, keys)
    return out.withColumn("crest_factor", F.when(F.col("rms") > 0, F.col("_pk") / F.col("rms"))).drop("_pk")


def fit_distribution(df: DataFrame, keys: Keys, value: str, kind: str = "normal") -> DataFrame:
    """Maximum-likelihood parameters: normal (loc, scale), lognormal (shape, scale; loc 0), exponential and uniform (loc, scale)."""
    v = F.col(value)
    logs = F.log(v)
    parts = {
        "normal": {"loc": F.avg(v), "scale": F.stddev_pop(v)},
        "lognormal": {"shape": F.stddev_pop(logs), "loc": F.lit(0.0), "scale": F.exp(F.avg(logs))},
        "exponential": {"loc": F.min(v), "scale": F.avg(v) - F.min(v)},
        "uniform": {"loc": F.min(v), "scale": F.max(v) - F.min(v)},
    }[kind]
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in parts.items()])


def kolmogorov_smirnov(df: DataFrame, keys: Keys, value: str, kind: str = "uniform") -> DataFrame:
    """Fitted parameters, the largest distance between the empirical and the fitted distribution, and its
    asymptotic p-value; kind exponential or uniform. Values are counted first, so that only distinct ones
    are ordered."""
    fit = fit_distribution(df, keys, value, kind)
    z = (F.col(value) - F.col("loc")) / F.col("scale")
    cdf = F.greatest(F.least(z, F.lit(1.0)), F.lit(0.0)) if kind == "uniform" else 1 - F.exp(-z)
    total = df.groupBy(*keys).agg(F.count(value).alias("_N"))
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    at = counts.withColumn("_upto", F.sum("_c").over(W.partitionBy(*keys).orderBy(value)))
    rows = met(met(at, fit, keys), total, keys).withColumn("_f", cdf)
    far = F.greatest(F.col("_upto") / F.col("_N") - F.col("_f"), F.col("_f") - (F.col("_upto") - F.col("_c")) / F.col("_N"))
    d = rows.groupBy(*keys).agg(F.max(far).alias("ks_statistic"), F.first("_N").alias("_N"))
    lam = F.sqrt("_N") * F.col("ks_statistic")
    p = reduce(Column.__add__, [F.lit(2.0 * (-1) ** (k - 1)) * F.exp(-2 * k * k * lam * lam) for k in range(1, 21)])
    return met(fit, d.withColumn("p_value", F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0))).drop("_N"), keys)


def dagostino_test(df: DataFrame, keys: Keys, value: str) -> DataFrame:
    """D'Agostino-Pearson K squared from skewness and kurtosis; p = exp(-K2 / 2); eight rows at least."""
    v = F.col(value)
    g = df.groupBy(*keys).agg(F.count(v).cast("double").alias("n"), F.skewness(v).alias("_g1"), (F.kurtosis(v) + 3).alias("_b2"))
    n, g1, b2 = F.col("n"), F.col("_g1"), F.col("_b2")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    alpha = F.sqrt(2 / (w2 - 1))
    zs = F.asinh(y / alpha) / F.sqrt(F.log(w2) / 2)
    mean, var = 3 * (n - 1) / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (b2 - mean) / F.sqrt(var)
    sb = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / sb * (2 / sb + F.sqrt(1 + 4 / (sb * sb)))
    t = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    zk = (1 - 2 / (9 * a) - F.signum(t) * F.pow(F.abs(t), F.lit(1 / 3))) / F.sqrt(2 / (9 * a))
    k2 = zs * zs + zk * zk
    return g.filter("n >= 8").select(*keys, k2.alias("statistic"), F.exp(-k2 / 2).alias("p_value"), (F.exp(-k2 / 2) > 0.05).alias("is_normal"))


def kernel_density(df: DataFrame, keys: Keys, value: str, points: int = 100, kernel: str = "gaussian") -> DataFrame:
    """Density at ``points`` places over the group's range (Scott's bandwidth); kernels gaussian, tophat, epanechnikov.

    Values are counted first; each distinct value meets the fixed number of places."""
    v = F.col(value)
    side = df.groupBy(*keys).agg(F.count(v).alias("_n"), F.min(v).alias("_a"), F.max(v).alias("_z"), F.stddev_samp(v).alias("_s"))
    side = side.filter("_n > 1 and _s > 0").withColumn("_h", F.col("_s") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    rows = met(df.groupBy(*keys, value).agg(F.count("*").alias("_c")), side, keys)
    step = (F.col("_z") - F.col("_a")) / (points - 1)
    at = rows.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("_a") + F.col("point") * step)
    u = (F.col("x") - v) / F.col("_h")
    k = {
        "gaussian": F.exp(-u * u / 2) / math.sqrt(2 * math.pi), "tophat": F.when(F.abs(u) <= 1, 0.5).otherwise(0.0),
        "epanechnikov": F.when(F.abs(u) <= 1, 0.75 * (1 - u * u)).otherwise(0.0),
    }[kernel]
    g = at.groupBy(*keys, "point").agg(F.first("x").alias("x"), (F.sum(k * F.col("_c")) / F.first(F.col("_n") * F.col("_h"))).alias("density"))
    return g


def uncertainty(df: DataFrame, keys: Keys, value: str, others: Sequence[float] = (), coverage: float = 2.0) -> DataFrame:
    """Type A uncertainty s / sqrt(n) of the mean, combined in quadrature with ``others``, and expanded."""
    a = F.stddev_samp(value) / F.sqrt(F.count(value))
    g = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), a.alias("type_a"))
    total = F.sqrt(F.col("type_a") ** 2 + F.lit(float(sum(o * o for o in others))))
    return g.withColumn("combined", total).withColumn("expanded", F.col("combined") * coverage)


def posterior(df: DataFrame, keys: Keys, value: str, mean: float, variance: float, noise: float) -> DataFrame:
    """Normal posterior of a mean after all observations; sums are enough, so order does not matter."""
    g = df.groupBy(*keys).agg(F.count(value).alias("n"), F.sum(value).alias("_s"))
    v = 1 / (F.lit(1 / variance) + F.col("n") / F.lit(float(noise)))
    return g.select(*keys, "n", (v * (F.lit(mean / variance) + F.col("_s") / F.lit(float(noise)))).alias("mean"), v.alias("variance"))


def pairwise_correlations(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Pearson r of every pair of fields in one pass; 0 where a side does not vary."""
    pairs = [(a, b) for i, a in enumerate(fields) for b in fields[i + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"_c{i}") for i, (a, b) in enumerate(pairs)])
    r = lambda i: F.coalesce(F.when(~F.isnan(f"_c{i}"), F.col(f"_c{i}")), F.lit(0.0))
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r(i).alias("r")) for i, (a, b) in enumerate(pairs)])).alias("_r")).select("_r.*")


def similarity_scores(df: DataFrame, keys: Keys, a: str, b: str) -> DataFrame:
    """Correlation, cosine, RMS and mean squared difference of two values per group."""
    x, y = F.col(a), F.col(b)
    return df.groupBy(*keys).agg(
        F.corr(a, b).alias("correlation"), (F.sum(x * y) / F.sqrt(F.sum(x * x) * F.sum(y * y))).alias("cosine"), F.avg((x - y) ** 2).alias("mse"), F.sqrt(F.avg((x - y) ** 2)).alias("rms")
    )


# ---- power -----------------------------------------------------------------------------------


def power_profile(df: DataFrame, keys: Keys, order: Keys, v: str, i: str, dt: float, size: int) -> DataFrame:
    """Power, its mean over a centred odd window (zeros beyond the ends) and the energy so far."""
    half = size // 2
    by = W.partitionBy(*keys).orderBy(*order)
    p = df.withColumn("power", F.col(v) * F.col(i))
    return p.withColumns({"average": F.sum("power").over(by.rowsBetween(-half, half)) / (2 * half + 1), "energy": F.sum("power").over(by.rowsBetween(W.unboundedPreceding, 0)) * dt})


def three_phase_power(df: DataFrame, keys: Keys, phases: Sequence[tuple[str, str]]) -> DataFrame:
    """Total active, apparent and reactive power and power factor of (voltage, current) columns."""
    active = [F.avg(F.col(v) * F.col(i)) for v, i in phases]
    apparent = [F.sqrt(F.avg(F.col(v) ** 2)) * F.sqrt(F.avg(F.col(i) ** 2)) for v, i in phases]
    g = df.groupBy(*keys).agg(reduce(Column.__add__, active).alias("active"), reduce(Column.__add__, apparent).alias("apparent"))
    s, p = F.col("apparent"), F.col("active")
    return g.withColumns({"reactive": F.sqrt(F.greatest(s * s - p * p, F.lit(0.0))), "power_factor": F.when(s > 0, p / s).otherwise(0.0)})


def phase_angle(active: Column, apparent: Column) -> Column:
    """Angle between voltage and current in degrees."""
    return F.when(apparent > 0, F.degrees(F.acos(F.greatest(F.least(active / apparent, F.lit(1.0)), F.lit(-1.0)))))


def conduction_loss(i_rms: Column, resistance: float, temperature: float = 25.0, coefficient: float = 0.004) -> Column:
    return i_rms * i_rms * F.lit(resistance * (1 + coefficient * (temperature - 25)))


def multi_output_efficiency(p_in: Column, outputs: Sequence[Column]) -> Column:
    return F.when(p_in > 0, reduce(Column.__add__, outputs) / p_in).otherwise(0.0)


def interpolate_limit(x: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Piecewise linear limit through ascending (x, y) points, constant beyond the ends."""
    out = F.lit(float(points[-1][1]))
    for (a, p), (b, q) in reversed(list(zip(points[:-1], points[1:], strict=True))):
        out = F.when(x < b, F.lit(float(p)) + (x - float(a)) * ((q - p) / (b - a))).otherwise(out)
    return F.when(x <= float(points[0][0]), F.lit(float(points[0][1]))).otherwise(out)


def limit_violations(df: DataFrame, x: str, value: str, points: Sequence[tuple[float, float]]) -> DataFrame:
    """Rows above a limit line (safe operating area, spectrum mask), with the limit and the excess."""
    return df.withColumn("limit", interpolate_limit(F.col(x), points)).withColumn("excess", F.col(value) - F.col("limit")).filter("excess > 0")


def inside_polygon(x: Column, y: Column, corners: Sequence[tuple[float, float]]) -> Column:
    """Whether a point lies in a polygon, by the parity of edges to its right."""
    out = F.lit(False)
    for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]], strict=True):
        if ay != by:
            hit = ((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (y - ay) * ((bx - ax) / (by - ay)) + ax)
            out = out != hit
    return out


def mask_test(df: DataFrame, keys: Keys, x: Column, y: Column, polygons: Sequence[Sequence[tuple[float, float]]]) -> DataFrame:
    """Points, points inside forbidden polygons, and the verdict per group."""
    bad = reduce(Column.__or__, [inside_polygon(x, y, p) for p in polygons])
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(bad).alias("hits"), (F.count_if(bad) == 0).alias("passed"))


def impedance(reflection: Column, z0: float = 50.0) -> Column:
    """Impedance of a reflection coefficient: z0 (1 + r) / (1 - r)."""
    return F.when(reflection < 1, z0 * (1 + reflection) / (1 - reflection))


def insertion_loss(magnitude: Column) -> Column:
    return -20 * F.log10(magnitude)


def duty_distortion(pulses: DataFrame, keys: Keys, start: str, width: str) -> DataFrame:
    """Mean high and low widths of pulses and their difference over the period."""
    gap = F.lead(start).over(W.partitionBy(*keys).orderBy(start)) - (F.col(start) + F.col(width))
    g = pulses.withColumn("_g", gap).filter("_g is not null").groupBy(*keys).agg(F.avg(width).alias("high"), F.avg("_g").alias("low"))
    return g.withColumn("distortion", F.abs(F.col("high") - F.col("low")) / (F.col("high") + F.col("low")))


# ---- text of values --------------------------------------------------------------------------

#: SI prefixes by power of a thousand, and factors of units to their base.
PREFIXES = {-4: "p", -3: "n", -2: "µ", -1: "m", 0: "", 1: "k", 2: "M", 3: "G", 4: "T"}
UNITS = {"s": 1.0, "ms": 1e-3, "us": 1e-6, "ns": 1e-9, "V": 1.0, "mV": 1e-3, "kV": 1e3, "Hz": 1.0, "kHz": 1e3, "MHz": 1e6, "GHz": 1e9, "A": 1.0, "mA": 1e-3, "uA": 1e-6, "W": 1.0, "mW": 1e-3, "kW": 1e3}


def convert_units(value: Column, source: str, target: str) -> Column:
    if source.lstrip("mkMGun") != target.lstrip("mkMGun") and (source, target) not in {("ms", "s"), ("s", "ms")} and source[-1] != target[-1]:
        raise ValueError(f"{source} is no {target}")
    return value * F.lit(UNITS[source] / UNITS[target])


def si_text(value: Column, unit: str, precision: int = 3) -> Column:
    """Value with the prefix that leaves 1 to 999 before the point."""
    power = F.when(value == 0, 0).otherwise(F.greatest(F.least(F.floor(F.log10(F.abs(value)) / 3), F.lit(4)), F.lit(-4)))
    out = None
    for p, name in PREFIXES.items():
        shown = F.format_string(f"%.{precision}f {name}{unit}", value / F.lit(10.0 ** (3 * p)))
        out = F.when(power == p, shown) if out is None else out.when(power == p, shown)
    return out


def percent_text(value: Column, precision: int = 2) -> Column:
    return F.format_string(f"%.{precision}f%%", value * 100)


def decibel_text(value: Column, precision: int = 1) -> Column:
    return F.format_string(f"%.{precision}f dB", value)


def duration_text(seconds: Column) -> Column:
    """Hours, minutes and seconds, the larger ones only where they are not zero."""
    h, m = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60)
    s = F.format_string("%.1fs", seconds % 60)
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m "), s)).when(m > 0, F.concat(m.cast("string"), F.lit("m "), s)).otherwise(s)


# ---- events, zones and circuit measures ------------------------------------------------------


def zone_hits(df: DataFrame, x: Column, y: Column, zones: dict[str, Sequence[tuple[float, float]]]) -> DataFrame:
    """Samples inside zones (polygons), once per zone: ``zone``."""
    hit = F.array_compact(F.array(*[F.when(inside_polygon(x, y, p), F.lit(n)) for n, p in zones.items()]))
    return df.withColumn("zone", F.explode(hit))


def multi_level(df: DataFrame, keys: Keys, value: str, levels: int) -> DataFrame:
    """``level``: the number of the nearest of ``levels`` equally spaced values between percentiles 5 and 95."""
    p = percentiles(df, keys, value, (0.05, 0.95)).select(*keys, F.col("p05").alias("_a"), F.col("p95").alias("_z"))
    at = F.floor((F.col(value) - F.col("_a")) / (F.col("_z") - F.col("_a")) * (levels - 1) + 0.5).cast("int")
    return met(df, p, keys).withColumn("level", F.greatest(F.least(at, F.lit(levels - 1)), F.lit(0))).drop("_a", "_z")


#: Output and input thresholds (V) of logic families: VOH, VOL, VIH, VIL.
FAMILIES = {"TTL": (2.4, 0.4, 2.0, 0.8), "CMOS_5V": (4.44, 0.5, 3.5, 1.5), "LVCMOS_3V3": (2.4, 0.4, 2.0, 0.8), "LVCMOS_2V5": (2.0, 0.4, 1.7, 0.7), "LVCMOS_1V8": (1.35, 0.45, 1.17, 0.63)}


def noise_margins(df: DataFrame, keys: Keys, value: str, family: str = "LVCMOS_3V3") -> DataFrame:
    """High and low noise margins of measured levels (means above VIH and below VIL) against the family's inputs."""
    _, _, vih, vil = FAMILIES[family]
    v = F.col(value)
    g = df.groupBy(*keys).agg(F.avg(F.when(v >= vih, v)).alias("high"), F.avg(F.when(v <= vil, v)).alias("low"))
    return g.withColumns({"nmh": F.col("high") - vih, "nml": F.lit(vil) - F.col("low")})


def constraint_violations(events: DataFrame, keys: Keys, order: Keys, at: str, least: float, most: float) -> DataFrame:
    """Events that follow the one before in less than ``least`` or more than ``most``: the interval and which limit."""
    gap = events.withColumn("interval", F.col(at) - F.lag(at).over(W.partitionBy(*keys).orderBy(*order)))
    kind = F.when(F.col("interval") < least, "too_short").when(F.col("interval") > most, "too_long")
    return gap.withColumn("violation", kind).filter("violation is not null")


def pulse_statistics(pulses: DataFrame, keys: Keys, width: str = "width") -> DataFrame:
    """Count, mean, deviation and extremes of pulse widths."""
    return pulses.groupBy(*keys).agg(F.count(width).alias("n"), F.avg(width).alias("mean"), F.stddev_pop(width).alias("std"), F.min(width).alias("min"), F.max(width).alias("max"))


def capacitance(df: DataFrame, keys: Keys, v: str, i: str, dt: float) -> DataFrame:
    """Charge over the swing of the voltage."""
    q, swing = F.sum(F.col(i)) * dt, F.max(v) - F.min(v)
    return df.groupBy(*keys).agg(q.alias("charge"), swing.alias("swing")).withColumn("capacitance", F.when(F.col("swing") > 0, F.abs("charge") / F.col("swing")))


def switching_loss(df: DataFrame, keys: Keys, v: str, i: str, dt: float, v_least: float, i_least: float) -> DataFrame:
    """Energy and samples while voltage and current both exceed their thresholds, against the whole energy."""
    p, on = F.col(v) * F.col(i), (F.col(v) > v_least) & (F.col(i) > i_least)
    return df.groupBy(*keys).agg((F.sum(F.when(on, p).otherwise(0.0)) * dt).alias("energy"), F.count_if(on).alias("samples"), (F.sum(p) * dt).alias("total"))


def weighted_ensemble(df: DataFrame, keys: Keys, value: str, weight: str) -> DataFrame:
    """Weighted mean of estimates, their weighted deviation and agreement 1 / (1 + cv)."""
    from tidewire.operators.stats import weighted_stats

    g = weighted_stats(df, keys, value, weight)
    cv = F.when(F.col("weighted_mean") != 0, F.abs(F.col("weighted_std") / F.col("weighted_mean"))).otherwise(0.0)
    return g.withColumn("agreement", 1 / (1 + cv))


def frequency_band(df: DataFrame, key: str, at: str, low: float, high: float) -> DataFrame:
    """Rows of ids whose rate (n - 1) / span lies in [low, high]."""
    g = df.groupBy(key).agg(F.count("*").alias("_n"), (F.max(at) - F.min(at)).alias("_d")).filter("_d > 0")
    return df.join(g.filter(((F.col("_n") - 1) / F.col("_d")).between(low, high)).select(key), key, "left_semi")
