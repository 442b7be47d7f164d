"""Queries of the signal, distribution, power and pattern operators on whole driver tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import payload, signals, stats, traces, windows
from tidewire.plans.catalog import BY, BYTES, LINES, events, pages, query, rounded, table

# ---- time and selection ----------------------------------------------------------------------


@query("SELECT event_id, round(event_id / 250.0::DOUBLE + 1.5, 6) AS t FROM events")
def sample_times(spark, sf_dir):
    return rounded(events(spark, sf_dir).select("event_id", signals.sample_time(F.col("event_id"), 250.0, 1.5).alias("t")))


@query("SELECT event_type, count(*) AS n, round((count(*) - 1) / 250.0::DOUBLE, 6) AS duration FROM events GROUP BY 1")
def trace_durations(spark, sf_dir):
    return rounded(signals.durations(events(spark, sf_dir), ["event_type"], 250.0))


@query("SELECT event_id, value FROM events WHERE event_id >= 100 AND event_id < 400")
def region_of_interest(spark, sf_dir):
    return signals.region(events(spark, sf_dir), "event_id", 100, 400).select("event_id", "value")


@query("SELECT event_id FROM (SELECT event_id FROM events ORDER BY ts, event_id OFFSET 100)")
def skipped_rows(spark, sf_dir):
    return signals.skip(events(spark, sf_dir).select("t", "event_id"), ["t", "event_id"], 100).select("event_id")


@query("SELECT event_type, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 64 AS batch, event_id FROM events")
def batched_rows(spark, sf_dir):
    return signals.batches(events(spark, sf_dir), ["event_type"], ["event_id"], 64).select("event_type", "batch", "event_id")


@query("""WITH s AS (SELECT user_id, event_id, value >= 30 AS level FROM events), e AS (SELECT user_id, arg_min(level, event_id) AS a, arg_max(level, event_id) AS z FROM s GROUP BY 1),
 b AS (SELECT s.user_id, min(event_id) FILTER (level <> a) AS f, max(event_id) FILTER (level <> z) AS u FROM s JOIN e USING (user_id) GROUP BY 1) SELECT event_id FROM s JOIN b USING (user_id) WHERE event_id BETWEEN f AND u""")
def trimmed_traces(spark, sf_dir):
    d = events(spark, sf_dir).select("user_id", "event_id", (F.col("value") >= 30).alias("level"))
    return signals.trim_idle(d, ["user_id"], "event_id", "level").select("event_id")


# ---- levels ----------------------------------------------------------------------------------


@query("""WITH q AS (SELECT event_type, (quantile_cont(value, 0.1) + quantile_cont(value, 0.9)) / 2 AS m FROM events GROUP BY 1) SELECT event_id, value >= m AS digital FROM events JOIN q USING (event_type)""")
def digital_levels(spark, sf_dir):
    return signals.to_digital(events(spark, sf_dir), ["event_type"], "value").select("event_id", "digital")


@query("""SELECT event_id, value >= avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) AS digital FROM events""")
def adaptive_levels(spark, sf_dir):
    return signals.adaptive_threshold(events(spark, sf_dir), *BY, "value", 8).select("event_id", "digital")


@query("""SELECT event_id, coalesce(last_value(CASE WHEN value >= 60 THEN true WHEN value < 40 THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS digital FROM events""")
def hysteresis_levels(spark, sf_dir):
    return signals.hysteresis(events(spark, sf_dir), *BY, "value", 40.0, 60.0).select("event_id", "digital")


@query("""WITH l AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events), f AS (SELECT user_id, min(event_id) AS f FROM l WHERE b < 50 AND value >= 50 GROUP BY 1)
 SELECT event_id, event_id - f AS aligned FROM events JOIN f USING (user_id)""")
def aligned_channels(spark, sf_dir):
    return signals.align_by_trigger(events(spark, sf_dir), ["user_id"], "event_id", "value", 50.0).select("event_id", "aligned")


@query("""WITH f AS (SELECT user_id, event_type, min(epoch_us(ts)) AS f FROM events GROUP BY 1, 2) SELECT a.user_id, a.event_type, a.f - b.f AS skew FROM f a JOIN f b ON a.user_id = b.user_id AND b.event_type = 'view'""")
def channel_skew(spark, sf_dir):
    return signals.channel_skew(events(spark, sf_dir), ["user_id"], "event_type", "t", "view").filter("skew is not null").select("user_id", "event_type", "skew")


@query("""WITH l AS (SELECT user_id, event_id, epoch_us(ts)::DOUBLE AS t FROM events WHERE event_type = 'click'), r AS (SELECT user_id, epoch_us(ts)::DOUBLE AS t, min(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1, 2),
 a AS (SELECT l.*, r.t AS t0, r.v AS v0 FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.t >= r.t), b AS (SELECT a.*, r.t AS t1, r.v AS v1 FROM a ASOF LEFT JOIN r ON a.user_id = r.user_id AND a.t <= r.t)
 SELECT event_id, round(CASE WHEN t0 IS NOT NULL AND t1 IS NOT NULL THEN v0 + CASE WHEN t1 > t0 THEN (t - t0) / (t1 - t0) ELSE 0 END * (v1 - v0) END, 6) AS interpolated FROM b""")
def common_rate(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("t", F.col("t").cast("double"))
    right = e.filter("event_type = 'view'").groupBy("user_id", "t").agg(F.min("value").alias("value"))
    left = e.filter("event_type = 'click'").select("user_id", "event_id", "t")
    return rounded(signals.interpolated(left, right, ["user_id"], "t", "value").select("event_id", "interpolated"))


@query("""WITH i AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS k FROM events) SELECT event_type, k // 8 AS idx, round(avg(value), 6) AS value FROM i GROUP BY 1, 2 HAVING count(*) = 8""")
def downsampled(spark, sf_dir):
    i = stats.numbered(events(spark, sf_dir), ["event_type"], ["event_id"], "k")
    return rounded(signals.downsample(i, ["event_type"], "k", "value", 8))


# ---- trends and correlation ------------------------------------------------------------------


@query("""WITH r AS (SELECT event_type, regr_slope(value, event_id) AS s, regr_intercept(value, event_id) AS i FROM events GROUP BY 1) SELECT event_id, round(value - (s * event_id + i), 5) AS detrended FROM events JOIN r USING (event_type)""")
def detrended(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("x", F.col("event_id").cast("double"))
    return rounded(signals.detrend(e, ["event_type"], "x", "value").select("event_id", "detrended"), 5)


@query("""WITH s AS (SELECT event_type, min(event_id)::DOUBLE AS a, max(event_id)::DOUBLE AS z FROM events GROUP BY 1) SELECT event_type, least(floor((event_id - a) * 4 / (z - a)), 3)::INT AS piece, round(regr_slope(value, event_id), 5) AS slope, count(*) AS n FROM events JOIN s USING (event_type) GROUP BY 1, 2""")
def piecewise_fit(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("x", F.col("event_id").cast("double"))
    p = signals.piecewise_linear(e, ["event_type"], "x", "value", 4)
    return p.select("event_type", "piece", F.round("slope", 5).alias("slope"), "n")


@query("""WITH i AS (SELECT event_id, event_type, epoch_us(ts)::DOUBLE AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id)::DOUBLE AS i FROM events), r AS (SELECT event_type, regr_slope(t, i) AS s, regr_intercept(t, i) AS c FROM i GROUP BY 1)
 SELECT event_id, round((s * i + c) / 1e6, 0) AS regular FROM i JOIN r USING (event_type)""")
def regular_times(spark, sf_dir):
    r = signals.regularised_times(events(spark, sf_dir), ["event_type"], ["t", "event_id"], "t")
    return r.select("event_id", F.round(F.col("regular") / 1e6, 0).alias("regular"))


@query("""WITH c AS (SELECT l_suppkey, l_quantity - avg(l_quantity) OVER p AS a, l_extendedprice - avg(l_extendedprice) OVER p AS b, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS i FROM lineitem WINDOW p AS (PARTITION BY l_suppkey)),
 e AS (SELECT l_suppkey, sqrt(sum(a * a) * sum(b * b)) AS e FROM c GROUP BY 1), g AS (SELECT x.l_suppkey, (y.i - x.i)::INT AS lag, sum(x.a * y.b) AS s FROM c x JOIN c y ON x.l_suppkey = y.l_suppkey AND y.i - x.i BETWEEN -2 AND 2 GROUP BY 1, 2) SELECT l_suppkey, lag, round(s / e, 6) AS r FROM g JOIN e USING (l_suppkey)""")
def cross_correlation(spark, sf_dir):
    return rounded(signals.cross_correlation(table(spark, sf_dir, "lineitem"), ["l_suppkey"], LINES, "l_quantity", "l_extendedprice", 2))


@query("""WITH c AS (SELECT l_suppkey, l_quantity - avg(l_quantity) OVER p AS a, l_extendedprice - avg(l_extendedprice) OVER p AS b, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS i FROM lineitem WINDOW p AS (PARTITION BY l_suppkey)),
 e AS (SELECT l_suppkey, sqrt(sum(a * a) * sum(b * b)) AS e FROM c GROUP BY 1), g AS (SELECT x.l_suppkey, (y.i - x.i)::INT AS lag, sum(x.a * y.b) AS s FROM c x JOIN c y ON x.l_suppkey = y.l_suppkey AND y.i - x.i BETWEEN -2 AND 2 GROUP BY 1, 2)
 SELECT l_suppkey, arg_max(lag, abs(s)) AS peak_lag, round(arg_max(s, abs(s)) / any_value(e), 6) AS peak FROM g JOIN e USING (l_suppkey) GROUP BY 1""")
def correlation_peaks(spark, sf_dir):
    c = signals.cross_correlation(table(spark, sf_dir, "lineitem"), ["l_suppkey"], LINES, "l_quantity", "l_extendedprice", 2)
    return rounded(signals.peak_lag(c, ["l_suppkey"]))


_ACF = """WITH x AS (SELECT event_type, value - avg(value) OVER (PARTITION BY event_type) AS x, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events),
 s AS (SELECT a.event_type, (b.i - a.i)::INT AS lag, sum(a.x * b.x) AS s FROM x a JOIN x b ON a.event_type = b.event_type AND b.i - a.i BETWEEN 0 AND 12 GROUP BY 1, 2), c AS (SELECT s.event_type, s.lag, s.s / z.s AS acf FROM s JOIN s z ON s.event_type = z.event_type AND z.lag = 0)"""


@query(f"""{_ACF}, n AS (SELECT *, lag(acf) OVER w AS p, lead(acf) OVER w AS q FROM c WINDOW w AS (PARTITION BY event_type ORDER BY lag)) SELECT event_type, min(lag) AS period, round(arg_min(acf, lag), 6) AS strength FROM n WHERE lag >= 2 AND acf > p AND acf >= q GROUP BY 1""")
def periodicity(spark, sf_dir):
    a = windows.autocorrelation(events(spark, sf_dir), ["event_type"], ["event_id"], "value", 12)
    return rounded(signals.period_of(a, ["event_type"]))


@query("""SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_tax', round(corr(l_quantity, l_tax), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_tax', round(corr(l_extendedprice, l_tax), 6) FROM lineitem""")
def field_correlations(spark, sf_dir):
    return rounded(signals.pairwise_correlations(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]))


@query("""SELECT l_suppkey, round(corr(l_quantity, l_extendedprice / 1000), 6) AS correlation, round(sum(l_quantity * l_extendedprice / 1000) / sqrt(sum(l_quantity * l_quantity) * sum(l_extendedprice / 1000 * l_extendedprice / 1000)), 6) AS cosine, round(avg(pow(l_quantity - l_extendedprice / 1000, 2)), 5) AS mse, round(sqrt(avg(pow(l_quantity - l_extendedprice / 1000, 2))), 5) AS rms FROM lineitem GROUP BY 1""")
def similarity_scores(spark, sf_dir):
    s = signals.similarity_scores(table(spark, sf_dir, "lineitem").withColumn("b", F.col("l_extendedprice") / 1000), ["l_suppkey"], "l_quantity", "b")
    return s.select("l_suppkey", F.round("correlation", 6).alias("correlation"), F.round("cosine", 6).alias("cosine"), F.round("mse", 5).alias("mse"), F.round("rms", 5).alias("rms"))


# ---- distributions ---------------------------------------------------------------------------


@query("""WITH b AS (SELECT event_type, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, sqrt(avg(value * value)) AS rms, max(abs(value)) AS pk, quantile_cont(value, 0.25) AS q1, median(value) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
 m AS (SELECT event_type, median(abs(value - median)) AS mad FROM events JOIN b USING (event_type) GROUP BY 1)
 SELECT event_type, n, round(mean, 6) AS mean, round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max, round(rms, 6) AS rms, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(mad, 6) AS mad, round(pk / rms, 6) AS crest_factor FROM b JOIN m USING (event_type)""")
def summary_statistics(spark, sf_dir):
    return rounded(signals.summary_stats(events(spark, sf_dir), ["event_type"], "value"))


@query("SELECT l_returnflag, round(stddev_pop(ln(l_extendedprice)), 6) AS shape, 0.0::DOUBLE AS loc, round(exp(avg(ln(l_extendedprice))), 3) AS scale FROM lineitem GROUP BY 1")
def lognormal_fit(spark, sf_dir):
    f = signals.fit_distribution(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", "lognormal")
    return f.select("l_returnflag", F.round("shape", 6).alias("shape"), "loc", F.round("scale", 3).alias("scale"))


def _ks(cdf: str, scale: str) -> str:
    tail = " + ".join(f"{2.0 * (-1) ** (k - 1)} * exp({-2 * k * k} * l * l)" for k in range(1, 21))
    return f"""WITH f AS (SELECT event_type, min(value) AS loc, {scale} AS scale, count(value) AS n FROM events GROUP BY 1), c AS (SELECT event_type, value, count(*) AS c FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
 u AS (SELECT c.*, sum(c) OVER (PARTITION BY event_type ORDER BY value) AS u FROM c), z AS (SELECT u.*, f.*, (value - loc) / scale AS z FROM u JOIN f USING (event_type)), d AS (SELECT event_type, max(greatest(u / n - {cdf}, {cdf} - (u - c) / n)) AS d FROM z GROUP BY 1), l AS (SELECT *, sqrt(n) * d AS l FROM d JOIN f USING (event_type))
 SELECT event_type, round(loc, 6) AS loc, round(scale, 6) AS scale, round(d, 6) AS ks_statistic, round(greatest(least({tail}, 1.0), 0.0), 6) AS p_value FROM l"""


@query(_ks("greatest(least(z, 1.0), 0.0)", "max(value) - min(value)"))
def uniform_fit(spark, sf_dir):
    return rounded(signals.kolmogorov_smirnov(events(spark, sf_dir), ["event_type"], "value", "uniform"))


@query(_ks("(1 - exp(-z))", "avg(value) - min(value)"))
def exponential_fit(spark, sf_dir):
    return rounded(signals.kolmogorov_smirnov(events(spark, sf_dir), ["event_type"], "value", "exponential"))


@query("""WITH m AS (SELECT event_type, avg(value) AS m FROM events GROUP BY 1), g AS (SELECT event_type, count(*)::DOUBLE AS n, avg(pow(value - m, 3)) / pow(avg(pow(value - m, 2)), 1.5) AS g1, avg(pow(value - m, 4)) / pow(avg(pow(value - m, 2)), 2) AS b2 FROM events JOIN m USING (event_type) GROUP BY 1),
 a AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS be FROM g), b AS (SELECT *, sqrt(2 * (be - 1)) - 1 AS w2 FROM a),
 c AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(ln(w2) / 2) AS zs, (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb FROM b),
 d AS (SELECT *, 6 + 8 / sb * (2 / sb + sqrt(1 + 4 / (sb * sb))) AS aa FROM c), e AS (SELECT *, (1 - 2 / aa) / (1 + x * sqrt(2 / (aa - 4))) AS t FROM d), k AS (SELECT event_type, n, zs * zs + pow((1 - 2 / (9 * aa) - sign(t) * pow(abs(t), 1.0::DOUBLE / 3)) / sqrt(2 / (9 * aa)), 2) AS k2 FROM e)
 SELECT event_type, round(k2, 4) AS statistic, round(exp(-k2 / 2), 6) AS p_value, exp(-k2 / 2) > 0.05 AS is_normal FROM k WHERE n >= 8""")
def normality(spark, sf_dir):
    d = signals.dagostino_test(events(spark, sf_dir), ["event_type"], "value")
    return d.select("event_type", F.round("statistic", 4).alias("statistic"), F.round("p_value", 6).alias("p_value"), "is_normal")


@query("""WITH s AS (SELECT event_type, count(value) AS n, min(value) AS a, max(value) AS z, stddev_samp(value) * pow(count(value)::DOUBLE, -0.2) AS h FROM events GROUP BY 1), p AS (SELECT event_type, n, h, k, a + k * ((z - a) / 24) AS x FROM s, range(0, 25) r(k))
 SELECT p.event_type, k::INT AS point, round(x, 6) AS x, round(sum(exp(-pow((x - value) / h, 2) / 2) / sqrt(2 * pi())) / any_value(n * h), 8) AS density FROM p JOIN events USING (event_type) GROUP BY 1, 2, 3""")
def kernel_density(spark, sf_dir):
    k = signals.kernel_density(events(spark, sf_dir), ["event_type"], "value", 25)
    return k.select("event_type", "point", F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))


@query("""WITH g AS (SELECT event_type, count(value) AS n, avg(value) AS m, stddev_samp(value) / sqrt(count(value)) AS a FROM events GROUP BY 1) SELECT event_type, n, round(m, 6) AS mean, round(a, 6) AS type_a, round(sqrt(a * a + 0.05), 6) AS combined, round(2 * sqrt(a * a + 0.05), 6) AS expanded FROM g""")
def measurement_uncertainty(spark, sf_dir):
    return rounded(signals.uncertainty(events(spark, sf_dir), ["event_type"], "value", (0.1, 0.2)))


@query("""WITH g AS (SELECT event_type, count(value) AS n, sum(value) AS s FROM events GROUP BY 1) SELECT event_type, n, round((50.0 / 100 + s / 25) / (1.0 / 100 + n / 25.0), 6) AS mean, round(1 / (1.0::DOUBLE / 100 + n / 25.0), 8) AS variance FROM g""")
def sequential_posterior(spark, sf_dir):
    p = signals.posterior(events(spark, sf_dir), ["event_type"], "value", 50.0, 100.0, 25.0)
    return p.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("variance", 8).alias("variance"))


# ---- power and limits ------------------------------------------------------------------------


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_suppkey, l_quantity * l_extendedprice / 1000 AS p FROM lineitem) SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, round(p, 8) AS power, round(sum(p) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 8) AS average, round(sum(p) OVER (w ROWS UNBOUNDED PRECEDING) * 0.001, 8) AS energy
 FROM p WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice)""")
def power_profile(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("i", F.col("l_extendedprice") / 1000)
    p = signals.power_profile(li, ["l_suppkey"], LINES, "l_quantity", "i", 0.001, 5)
    return rounded(p.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "power", "average", "energy"), 8)


@query("""WITH g AS (SELECT l_suppkey, avg(l_quantity * l_tax) + avg(l_quantity * l_discount) + avg(l_tax * l_discount) AS p, sqrt(avg(l_quantity * l_quantity)) * sqrt(avg(l_tax * l_tax)) + sqrt(avg(l_quantity * l_quantity)) * sqrt(avg(l_discount * l_discount)) + sqrt(avg(l_tax * l_tax)) * sqrt(avg(l_discount * l_discount)) AS s FROM lineitem GROUP BY 1)
 SELECT l_suppkey, round(p, 6) AS active, round(s, 6) AS apparent, round(sqrt(greatest(s * s - p * p, 0)), 6) AS reactive, round(p / s, 6) AS power_factor, round(degrees(acos(p / s)), 4) AS angle FROM g""")
def three_phase_power(spark, sf_dir):
    g = signals.three_phase_power(table(spark, sf_dir, "lineitem"), ["l_suppkey"], [("l_quantity", "l_tax"), ("l_quantity", "l_discount"), ("l_tax", "l_discount")])
    g = g.withColumn("angle", F.round(signals.phase_angle(F.col("active"), F.col("apparent")), 4))
    return rounded(g)


_SOA = ((0.0, 100.0), (10.0, 90.0), (25.0, 60.0), (50.0, 20.0))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS x, l_extendedprice / 1000 AS y, CASE WHEN l_quantity <= 0 THEN 100 WHEN l_quantity < 10 THEN 100 + l_quantity * -1.0 WHEN l_quantity < 25 THEN 90 + (l_quantity - 10) * -2.0 WHEN l_quantity < 50 THEN 60 + (l_quantity - 25) * -1.6 ELSE 20 END AS lim FROM lineitem)
 SELECT l_orderkey, l_linenumber, l_partkey, round(lim, 6) AS "limit", round(y - lim, 6) AS excess FROM l WHERE y > lim""")
def safe_operating_area(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("y", F.col("l_extendedprice") / 1000)
    return rounded(signals.limit_violations(li, "l_quantity", "y", _SOA).select("l_orderkey", "l_linenumber", "l_partkey", "limit", "excess"))


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (value > 20 AND value < 40 AND event_id % 100 > 10 AND event_id % 100 < 60) AS hits, count(*) FILTER (value > 20 AND value < 40 AND event_id % 100 > 10 AND event_id % 100 < 60) = 0 AS passed FROM events WHERE value NOT IN (20, 40) AND event_id % 100 NOT IN (10, 60) GROUP BY 1""")
def mask_hits(spark, sf_dir):
    e = events(spark, sf_dir).filter("value not in (20, 40) and event_id % 100 not in (10, 60)")
    box = [(10.0, 20.0), (60.0, 20.0), (60.0, 40.0), (10.0, 40.0)]
    return signals.mask_test(e, ["event_type"], (F.col("event_id") % 100).cast("double"), F.col("value"), [box])


@query("""SELECT l_returnflag, round(sum(l_quantity) * sum(l_quantity) * 0.01 * (1 + 0.004 * 50), 3) AS loss, round((sum(l_tax) + sum(l_discount)) / sum(l_quantity), 8) AS efficiency, round(avg(50 * (1 + l_tax) / (1 - l_tax)), 6) AS impedance, round(avg(-20 * log10((l_tax + 1) / 2)), 6) AS insertion FROM lineitem GROUP BY 1""")
def losses(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.sum("l_quantity").alias("q"), F.sum("l_tax").alias("t"), F.sum("l_discount").alias("d"), F.avg(signals.impedance(F.col("l_tax"))).alias("z"), F.avg(signals.insertion_loss((F.col("l_tax") + 1) / 2)).alias("s")
    )
    return g.select(
        "l_returnflag", F.round(signals.conduction_loss(F.col("q"), 0.01, 75.0), 3).alias("loss"), F.round(signals.multi_output_efficiency(F.col("q"), [F.col("t"), F.col("d")]), 8).alias("efficiency"),
        F.round("z", 6).alias("impedance"), F.round("s", 6).alias("insertion"),
    )


# ---- text of values --------------------------------------------------------------------------


@query("""SELECT event_id, CASE WHEN value * 1000 >= 1000 THEN printf('%.2f kV', value * 1000 / 1000.0) WHEN value * 1000 >= 1 THEN printf('%.2f V', value * 1000) ELSE printf('%.2f mV', value * 1000 * 1000) END AS si, printf('%.2f%%', value / 100 * 100) AS percent, printf('%.2f dB', value) AS decibel,
 CASE WHEN floor(event_id / 3600) > 0 THEN floor(event_id / 3600)::INT || 'h ' || floor(event_id % 3600 / 60)::INT || 'm ' || printf('%.1fs', (event_id % 60)::DOUBLE) WHEN floor(event_id % 3600 / 60) > 0 THEN floor(event_id % 3600 / 60)::INT || 'm ' || printf('%.1fs', (event_id % 60)::DOUBLE) ELSE printf('%.1fs', (event_id % 60)::DOUBLE) END AS duration, round(value / 1000, 8) AS seconds
 FROM events WHERE value > 0.01""")
def value_texts(spark, sf_dir):
    v = F.col("value")
    return events(spark, sf_dir).filter("value > 0.01").select(
        "event_id", signals.si_text(v * 1000, "V", 2).alias("si"), signals.percent_text(v / 100).alias("percent"), signals.decibel_text(v, 2).alias("decibel"),
        signals.duration_text(F.col("event_id").cast("double")).alias("duration"), F.round(signals.convert_units(v, "ms", "s"), 8).alias("seconds"),
    )


# ---- spectra stated as sums ------------------------------------------------------------------

_SAMPLES = """i AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS k FROM events)"""


@query("""WITH i AS (SELECT l_suppkey, l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_suppkey) AS x, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS k, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
 w AS (SELECT l_suppkey, k, n, x * (0.5 - 0.5 * cos(2 * pi() * k / (n - 1))) AS y, 0.5 - 0.5 * cos(2 * pi() * k / (n - 1)) AS w FROM i), s AS (SELECT l_suppkey, any_value(n) AS n, sum(w) AS w FROM w GROUP BY 1),
 d AS (SELECT w.l_suppkey, b, sum(y * cos(2 * pi() * ((b * k) % n) / n)) AS re, sum(y * sin(2 * pi() * ((b * k) % n) / n)) AS im FROM w, range(0, 8) r(b) WHERE b <= n // 2 GROUP BY 1, 2)
 SELECT d.l_suppkey, b AS bin, round(b * 1000.0 / n, 6) AS frequency, round(sqrt(re * re + im * im) / s.w * CASE WHEN b = 0 OR (n % 2 = 0 AND b = n // 2) THEN 1 ELSE 2 END, 4) AS magnitude FROM d JOIN s USING (l_suppkey)""")
def spectrum_lines(spark, sf_dir):
    f = traces.fft(table(spark, sf_dir, "lineitem"), ["l_suppkey"], LINES, "l_extendedprice", 1000.0).filter("bin < 8")
    return f.select("l_suppkey", "bin", F.round("frequency", 6).alias("frequency"), F.round("magnitude", 4).alias("magnitude"))


@query(f"""WITH {_SAMPLES}, n AS (SELECT event_type, count(*) AS n FROM i GROUP BY 1), s AS (SELECT event_type, g, value, k - 64 * g AS j FROM i, range(0, 4000000) r(g) WHERE g IN (k // 64, k // 64 - 1) AND g >= 0), f AS (SELECT s.event_type, g, j, value - avg(value) OVER (PARTITION BY s.event_type, g) AS x FROM s JOIN n USING (event_type) WHERE 64 * g + 128 <= n),
 w AS (SELECT *, x * (0.5 - 0.5 * cos(2 * pi() * j / 128)) AS y FROM f), d AS (SELECT event_type, g, b, sum(y * cos(2 * pi() * ((b * j) % 128) / 128)) AS re, sum(y * sin(2 * pi() * ((b * j) % 128) / 128)) AS im FROM w, range(0, 65) r(b) GROUP BY 1, 2, 3)
 SELECT event_type, b AS bin, round(avg(re * re + im * im) / 48 * CASE WHEN b IN (0, 64) THEN 1 ELSE 2 END, 4) AS density, count(*) AS segments FROM d GROUP BY 1, 2""".replace("FROM i, range(0, 4000000) r(g) WHERE g IN (k // 64, k // 64 - 1) AND g >= 0", "FROM (SELECT event_type, value, k, unnest([k // 64, k // 64 - 1]) AS g FROM i) WHERE g >= 0"))
def welch_lines(spark, sf_dir):
    e = stats.numbered(events(spark, sf_dir), ["event_type"], ["t", "event_id"], "idx")
    p = traces.psd(e, ["event_type"], "idx", "value", 1.0, 128)
    return p.select("event_type", "bin", F.round("density", 4).alias("density"), "segments")


# ---- patterns in payloads --------------------------------------------------------------------


@query(f"""WITH w AS (SELECT page_id, byte, unnest(range(greatest(ceil((pos - 15) / 4)::INT, 0), least(floor(pos / 4)::INT, floor((len - 16) / 4)::INT) + 1)) AS k FROM {BYTES} JOIN (SELECT page_id, octet_length(encode(url)) AS len FROM pages) USING (page_id)),
 c AS (SELECT page_id, k, byte, count(*)::DOUBLE AS n FROM w GROUP BY 1, 2, 3), h AS (SELECT page_id, k, abs(log2(sum(n)) - sum(n * log2(n)) / sum(n)) AS e FROM c GROUP BY 1, 2), d AS (SELECT page_id, k, e - lag(e) OVER (PARTITION BY page_id ORDER BY k) AS change FROM h) SELECT page_id, k::INT AS "window", round(change, 6) AS change FROM d WHERE round(abs(change), 9) > 0.3""")
def entropy_transitions(spark, sf_dir):
    return rounded(payload.entropy_transitions(pages(spark, sf_dir), ["page_id"], "data", 16, 4, 0.3))


@query(f"""WITH w AS (SELECT page_id, byte, unnest(range(greatest(ceil((pos - 31) / 8)::INT, 0), least(floor(pos / 8)::INT, floor((len - 32) / 8)::INT) + 1)) AS k FROM {BYTES} JOIN (SELECT page_id, octet_length(encode(url)) AS len FROM pages) USING (page_id)) SELECT page_id, k::INT AS "window", count(*) FILTER (byte = 101) AS n FROM w GROUP BY 1, 2""")
def sliding_byte_counts(spark, sf_dir):
    return payload.sliding_byte_count(pages(spark, sf_dir), ["page_id"], "data", 101, 32, 8)


@query(f"""SELECT a.byte AS first, b.byte AS second, count(*) AS n FROM {BYTES} a JOIN {BYTES} b ON a.page_id = b.page_id AND b.pos = a.pos + 1 GROUP BY 1, 2""")
def byte_pairs(spark, sf_dir):
    return payload.byte_pairs(pages(spark, sf_dir), "data")


@query("""WITH t AS (SELECT count(*) AS t FROM pages), g AS (SELECT DISTINCT page_id, substr(url, i, n) AS gram FROM (SELECT page_id, url, unnest(range(1, length(url) + 1)) AS i FROM pages), (VALUES (3), (4)) v(n) WHERE i + n <= length(url) + 1) SELECT gram, count(*) AS n, round(count(*) / any_value(t), 6) AS support FROM g, t GROUP BY 1 HAVING count(*) >= 0.5 * any_value(t)""")
def frequent_patterns(spark, sf_dir):
    return rounded(payload.frequent_patterns(pages(spark, sf_dir), ["page_id"], "url", (3, 4), 0.5))


@query("""WITH g AS (SELECT page_id, n, substr(url, i, n) AS gram FROM (SELECT page_id, url, unnest(range(1, length(url) + 1)) AS i FROM pages), (VALUES (4), (5), (6)) v(n) WHERE i + n <= length(url) + 1) SELECT page_id, gram AS sequence, count(*) AS n FROM g GROUP BY 1, 2 HAVING count(*) >= 2""")
def repeated_sequences(spark, sf_dir):
    return payload.repeated_sequences(pages(spark, sf_dir), ["page_id"], "url", (4, 5, 6), 2)


@query("""SELECT item_id, count(*) AS n, count(DISTINCT doc_id) AS documents FROM documents, benchmark b WHERE contains(documents.text, b.text) GROUP BY 1""")
def pattern_counts(spark, sf_dir):
    p = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("p"))
    hits = payload.multi_pattern_search(table(spark, sf_dir, "documents"), p, ["doc_id"], "text", "item_id", "p")
    one = hits.select("item_id", "doc_id").distinct()
    return one.groupBy("item_id").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


@query("""WITH g AS (SELECT user_id, epoch_us(ts) AS t, event_id, event_type FROM events), d AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS d FROM g), s AS (SELECT avg(d) AS m, stddev_pop(d) AS s FROM d) SELECT event_id, round((d - m) / s, 4) AS z FROM d, s WHERE abs((d - m) / s) > 3""")
def timing_anomalies(spark, sf_dir):
    return rounded(windows.timing_anomalies(events(spark, sf_dir), ["user_id"], ["t", "event_id"], "t").select("event_id", "z"), 4)


@query("""WITH RECURSIVE s AS (SELECT event_type, abs(d - lag(d) OVER w)::DOUBLE AS d, row_number() OVER w - 2 AS n, event_id FROM (SELECT event_type, event_id, t, t - lag(t) OVER (PARTITION BY event_type ORDER BY t, event_id) AS d FROM (SELECT event_type, event_id, epoch_us(ts) AS t FROM events)) WINDOW w AS (PARTITION BY event_type ORDER BY t, event_id)),
 r AS (SELECT event_type, n, event_id, d / 16 AS j FROM s WHERE n = 1 UNION ALL SELECT s.event_type, s.n, s.event_id, r.j + (s.d - r.j) / 16 FROM r JOIN s ON s.event_type = r.event_type AND s.n = r.n + 1) SELECT event_id, round(j / 1e6, 3) AS jitter FROM r""")
def rfc3550_jitter(spark, sf_dir):
    j = windows.smoothed_jitter(events(spark, sf_dir), ["event_type"], ["t", "event_id"], "t")
    return j.select("event_id", F.round(F.col("jitter") / 1e6, 3).alias("jitter"))


@query("""WITH p AS (SELECT a.event_id AS a, b.event_id AS b, list_distinct(string_split(a.props, '')) AS x, list_distinct(string_split(b.props, '')) AS y FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND epoch_us(b.ts) - epoch_us(a.ts) BETWEEN 0 AND 86400000000)
 SELECT a, b, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS similarity FROM p WHERE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) > 0.3""")
def content_correlation(spark, sf_dir):
    from tidewire.operators import joins

    e = events(spark, sf_dir)
    a = e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("a"), "t", F.col("props").alias("x"))
    b = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("u"), F.col("event_id").alias("b"), F.col("t").alias("t2"), F.col("props").alias("y"))
    return rounded(joins.content_pairs(a, b, "t", "t2", 86_400_000_000, [("user_id", "u")], "x", "y", 0.3).select("a", "b", "similarity"))


@query("""WITH r AS (SELECT user_id, min(epoch_us(b.ts)) - epoch_us(a.ts) AS d FROM events a JOIN events b USING (user_id) WHERE a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts >= a.ts GROUP BY user_id, a.event_id, a.ts)
 SELECT count(*) AS n, round(avg(d) / 1e6, 3) AS mean, round(stddev_pop(d) / 1e6, 3) AS std, round(min(d) / 1e6, 3) AS min, round(max(d) / 1e6, 3) AS max, round(quantile_cont(d, 0.5) / 1e6, 3) AS p50, round(quantile_cont(d, 0.95) / 1e6, 3) AS p95, round(quantile_cont(d, 0.99) / 1e6, 3) AS p99 FROM r""")
def latency_statistics(spark, sf_dir):
    from tidewire.operators import joins

    e = events(spark, sf_dir)
    left, right = e.filter("event_type = 'view'").select("user_id", "event_id", "t"), e.filter("event_type = 'purchase'").select("user_id", "t")
    d = joins.asof_merge(left, right, ["user_id"], "t", "t", [], forward=True).filter("asof_t is not null").select(((F.col("asof_t") - F.col("t")) / 1e6).alias("d"))
    return rounded(stats.latency(d, [], "d"), 3)


# ---- traces held as arrays: 64 samples of an embedding ---------------------------------------

_E = "x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, 64)) AS k FROM embeddings)"


@query(f"WITH {_E} SELECT vec_id, k AS idx, round(x, 5) AS value FROM x")
def wavelet_round_trip(spark, sf_dir):
    w = traces.analyze(table(spark, sf_dir, "embeddings"), ["vec_id"], "dwt", ["embedding"], levels=4)
    return rounded(traces.inverse_dwt(w, ["vec_id"]), 5)


@query(f"WITH {_E} SELECT vec_id, k // 2 AS idx, round(sum(CASE WHEN k % 2 = 0 THEN x ELSE -x END) / sqrt(2), 5) AS detail FROM x GROUP BY 1, 2")
def wavelet_details(spark, sf_dir):
    w = traces.analyze(table(spark, sf_dir, "embeddings"), ["vec_id"], "dwt", ["embedding"], levels=1).filter("level = 1")
    return w.select("vec_id", F.posexplode("coefficients").alias("idx", "detail")).select("vec_id", F.col("idx").cast("long").alias("idx"), F.round("detail", 5).alias("detail"))


@query(f"""WITH {_E}, d AS (SELECT vec_id, b, sum(x * cos(2 * pi() * ((b * k) % 64) / 64)) AS re, -sum(x * sin(2 * pi() * ((b * k) % 64) / 64)) AS im FROM x, range(0, 33) r(b) GROUP BY 1, 2), g AS (SELECT *, CASE WHEN b IN (0, 32) THEN 1 ELSE 2 END / 64.0::DOUBLE AS w FROM d),
 z AS (SELECT vec_id, k, sum(w * (re * cos(2 * pi() * ((b * k) % 64) / 64) - im * sin(2 * pi() * ((b * k) % 64) / 64))) AS re, sum(w * (re * sin(2 * pi() * ((b * k) % 64) / 64) + im * cos(2 * pi() * ((b * k) % 64) / 64))) AS im FROM g, range(0, 64) r(k) WHERE vec_id % 100 = 0 GROUP BY 1, 2)
 SELECT vec_id, k AS idx, round(sqrt(re * re + im * im), 5) AS envelope FROM z""".replace(" WHERE vec_id % 100 = 0", ""))
def hilbert_envelope(spark, sf_dir):
    return rounded(traces.analyze(table(spark, sf_dir, "embeddings"), ["vec_id"], "hilbert", ["embedding"]).select("vec_id", "idx", "envelope"), 5)


@query(f"""WITH {_E}, w AS (SELECT vec_id, k, (x - avg(x) OVER (PARTITION BY vec_id)) * (0.5 - 0.5 * cos(2 * pi() * k / 64)) AS y FROM x), d AS (SELECT vec_id, b, sum(y * cos(2 * pi() * ((b * k) % 64) / 64)) AS re, sum(y * sin(2 * pi() * ((b * k) % 64) / 64)) AS im FROM w, range(0, 33) r(b) GROUP BY 1, 2)
 SELECT vec_id, b AS bin, round((re * re + im * im) / 24 * CASE WHEN b IN (0, 32) THEN 1 ELSE 2 END, 5) AS density FROM d""")
def periodogram(spark, sf_dir):
    return rounded(traces.analyze(table(spark, sf_dir, "embeddings"), ["vec_id"], "periodogram", ["embedding"]).select("vec_id", "bin", "density"), 5)


@query(f"""WITH {_E}, w AS (SELECT vec_id, k // 8 AS g, k % 8 AS j, x - avg(x) OVER (PARTITION BY vec_id, k // 8) AS y FROM x), d AS (SELECT vec_id, g, b, sum(y * cos(2 * pi() * ((b * j) % 8) / 8)) AS re, sum(y * sin(2 * pi() * ((b * j) % 8) / 8)) AS im FROM w, range(0, 5) r(b) GROUP BY 1, 2, 3)
 SELECT vec_id, b AS bin, round(avg(re * re + im * im) / 8 * CASE WHEN b IN (0, 4) THEN 1 ELSE 2 END, 5) AS density FROM d GROUP BY 1, 2""")
def bartlett_density(spark, sf_dir):
    return rounded(traces.analyze(table(spark, sf_dir, "embeddings"), ["vec_id"], "bartlett", ["embedding"], segments=8).select("vec_id", "bin", "density"), 5)


@query(f"""WITH {_E}, s AS (SELECT vec_id, k, avg(x) OVER (PARTITION BY vec_id ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS t, x, row_number() OVER (PARTITION BY vec_id ORDER BY k) AS n FROM x) SELECT vec_id, k AS idx, round(t, 5) AS trend FROM s WHERE k BETWEEN 2 AND 61""")
def seasonal_trend(spark, sf_dir):
    s = traces.analyze(table(spark, sf_dir, "embeddings"), ["vec_id"], "seasonal", ["embedding"], period=5)
    return rounded(s.filter("idx between 2 and 61").select("vec_id", "idx", "trend"), 5)


@query()
def signal_character(spark, sf_dir):
    return traces.analyze(table(spark, sf_dir, "embeddings"), ["vec_id"], "character", ["embedding"])


@query()
def data_quality(spark, sf_dir):
    return traces.analyze(table(spark, sf_dir, "embeddings"), ["vec_id"], "quality", ["embedding"])


@query()
def spectral_peaks(spark, sf_dir):
    return traces.analyze(table(spark, sf_dir, "embeddings"), ["vec_id"], "peaks", ["embedding"], distance=3, most=3)


@query()
def vector_outliers(spark, sf_dir):
    return traces.row_outliers(table(spark, sf_dir, "embeddings").withColumn("g", F.pmod("vec_id", F.lit(20))), ["g"], ["vec_id"], "embedding", "lof", k=5)
