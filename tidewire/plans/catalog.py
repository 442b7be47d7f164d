"""Queries of the engine's own operators on whole driver tables, each with the SQL that equals it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import joins, mining, payload, protocols, stats, traces, windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("t", windows.micros("ts"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums taken in another order compare equal."""
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


# ---- aggregation -----------------------------------------------------------------------------


@query("""SELECT event_type, count(*) AS n, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us,
 round((count(*) - 1) / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6), 6) AS frequency, round(quantile_cont(value, 0.95), 6) AS p95
 FROM events GROUP BY 1""")
def inventory(spark, sf_dir):
    return rounded(stats.inventory(events(spark, sf_dir), ["event_type"], "t", "value"))


@query("""SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 6) AS variance, round(stddev_pop(value), 6) AS std,
 min(value) AS min, max(value) AS max, round(max(value) - min(value), 6) AS range FROM events GROUP BY 1""")
def basic_stats(spark, sf_dir):
    return rounded(stats.basic_stats(events(spark, sf_dir), ["event_type"], "value")).withColumns({"min": F.col("min"), "max": F.col("max")})


@query("""SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 6) AS p05, round(quantile_cont(l_extendedprice, 0.25), 6) AS p25,
 round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.75), 6) AS p75, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem GROUP BY 1""")
def percentiles(spark, sf_dir):
    return rounded(stats.percentiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice"))


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1)
 SELECT event_type, round(a, 6) AS q1, round(m, 6) AS median, round(b, 6) AS q3, round(b - a, 6) AS iqr, round(a - 1.5 * (b - a), 6) AS lower_fence, round(b + 1.5 * (b - a), 6) AS upper_fence FROM q""")
def quartiles(spark, sf_dir):
    return rounded(stats.quartiles(events(spark, sf_dir), ["event_type"], "value"))


@query("""SELECT l_returnflag, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS weighted_mean,
 round(sqrt((sum(l_quantity * l_extendedprice * l_extendedprice) - sum(l_quantity) * pow(sum(l_quantity * l_extendedprice) / sum(l_quantity), 2)) / sum(l_quantity)), 4) AS weighted_std FROM lineitem GROUP BY 1""")
def weighted_stats(spark, sf_dir):
    return rounded(stats.weighted_stats(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity"), 4)


@query("""WITH m AS (SELECT event_type, avg(value) AS a FROM events GROUP BY 1),
 s AS (SELECT event_type, count(*)::DOUBLE AS n, sqrt(avg(value * value)) AS rms, max(abs(value)) AS peak, avg(pow(value - a, 2)) AS m2, avg(pow(value - a, 3)) AS m3, avg(pow(value - a, 4)) AS m4
 FROM events JOIN m USING (event_type) GROUP BY 1)
 SELECT event_type, n::BIGINT AS n, round(rms, 5) AS rms, round(peak / rms, 5) AS crest_factor, round(m3 / pow(m2, 1.5), 5) AS skewness, round(m4 / (m2 * m2) - 3, 5) AS kurtosis,
 round((pow(m3 / pow(m2, 1.5), 2) + 1) / (m4 / (m2 * m2) - 3 + 3 * pow(n - 1, 2) / ((n - 2) * (n - 3))), 5) AS bimodality FROM s""")
def distribution(spark, sf_dir):
    return rounded(stats.distribution(events(spark, sf_dir), ["event_type"], "value"), 5)


@query("""WITH m AS (SELECT event_type, avg(value) AS a FROM events GROUP BY 1)
 SELECT event_type, round(avg(pow(value - a, 3)), 4) AS moment FROM events JOIN m USING (event_type) GROUP BY 1""")
def central_moment(spark, sf_dir):
    return rounded(stats.moment(events(spark, sf_dir), ["event_type"], "value", 3), 4)


@query("""SELECT l_returnflag, CASE WHEN l_quantity = 50 THEN 9 ELSE floor((l_quantity - 0) / 5.0)::INT END AS bin,
 CASE WHEN l_quantity = 50 THEN 9 ELSE floor((l_quantity - 0) / 5.0)::INT END * 5.0 AS bin_start, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1, 2, 3""")
def histogram(spark, sf_dir):
    return rounded(stats.histogram(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", 10, 0, 50))


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def correlation(spark, sf_dir):
    return rounded(stats.correlation(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"))


@query("""SELECT event_type, round(regr_slope(value, x), 6) AS slope, round(regr_intercept(value, x), 5) AS intercept, round(regr_r2(value, x), 6) AS r2, count(*) AS n
 FROM (SELECT *, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 86400e6 AS x FROM events) GROUP BY 1""")
def trend(spark, sf_dir):
    e = events(spark, sf_dir)
    first = F.broadcast(e.agg(F.min("t").alias("t0")))  # one row
    x = e.crossJoin(first).withColumn("x", (F.col("t") - F.col("t0")) / 86400e6)
    r = stats.regression(x, ["event_type"], "x", "value")
    return r.select("event_type", F.round("slope", 6).alias("slope"), F.round("intercept", 5).alias("intercept"), F.round("r2", 6).alias("r2"), "n")


@query("""SELECT event_id, event_type, round(z, 5) AS zscore FROM (SELECT *, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS z, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type))
 WHERE n >= 3 AND abs(z) > 3""")
def zscore_outliers(spark, sf_dir):
    return rounded(stats.zscore_outliers(events(spark, sf_dir), ["event_type"], "value").select("event_id", "event_type", "zscore"), 5)


@query("""WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1), d AS (SELECT event_id, event_type, value - m AS d FROM events JOIN m USING (event_type)),
 s AS (SELECT event_type, median(abs(d)) AS mad FROM d GROUP BY 1) SELECT event_id, event_type, round(0.6745 * d / mad, 5) AS modified_zscore FROM d JOIN s USING (event_type) WHERE abs(0.6745 * d / mad) > 3.5""")
def modified_zscore_outliers(spark, sf_dir):
    return rounded(stats.modified_zscore_outliers(events(spark, sf_dir), ["event_type"], "value").select("event_id", "event_type", "modified_zscore"), 5)


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1)
 SELECT event_id, event_type, value FROM events JOIN q USING (event_type) WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)""")
def iqr_outliers(spark, sf_dir):
    return stats.iqr_outliers(events(spark, sf_dir), ["event_type"], "value").select("event_id", "event_type", "value")


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1)
 SELECT event_id, round(greatest(least(value, b + 1.5 * (b - a)), a - 1.5 * (b - a)), 6) AS value FROM events JOIN q USING (event_type)""")
def clip_outliers(spark, sf_dir):
    return rounded(stats.clip_outliers(events(spark, sf_dir), ["event_type"], "value").select("event_id", "value"))


@query("""WITH l AS (SELECT 'l_quantity' AS metric, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem),
 s AS (SELECT metric, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, max(v) AS max, quantile_cont(v, 0.25) AS q25, median(v) AS median, quantile_cont(v, 0.75) AS q75 FROM l GROUP BY 1),
 o AS (SELECT metric, count(*) AS k FROM l JOIN s USING (metric) WHERE v < q25 - 1.5 * (q75 - q25) OR v > q75 + 1.5 * (q75 - q25) GROUP BY 1)
 SELECT metric, n, round(mean, 4) AS mean, round(std, 4) AS std, round(min, 4) AS min, round(max, 4) AS max, round(q25, 4) AS q25, round(median, 4) AS median, round(q75, 4) AS q75, coalesce(k, 0) AS outliers FROM s LEFT JOIN o USING (metric)""")
def aggregate_results(spark, sf_dir):
    return rounded(stats.aggregate_results(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]), 4)


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (value < 20) AS below, count(*) FILTER (value > 80) AS above, round(80 - max(value), 6) AS upper_margin,
 round(min(value) - 20, 6) AS lower_margin, count(*) FILTER (value < 20 OR value > 80) = 0 AS passed FROM events GROUP BY 1""")
def check_limits(spark, sf_dir):
    return rounded(stats.check_limits(events(spark, sf_dir), ["event_type"], "value", 20.0, 80.0))


@query("""SELECT event_id, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 6) AS normalized FROM events WINDOW w AS (PARTITION BY event_type)""")
def normalize_data(spark, sf_dir):
    return rounded(stats.normalize(events(spark, sf_dir), ["event_type"], "value").select("event_id", "normalized"))


@query("""SELECT event_type, floor(k / 200)::BIGINT AS segment, round(regr_slope(value, x), 5) AS slope, count(*) AS n FROM
 (SELECT event_type, value, event_id::DOUBLE AS x, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS k FROM events) GROUP BY 1, 2""")
def drift_segments(spark, sf_dir):
    d = stats.drift_segments(events(spark, sf_dir).withColumn("x", F.col("event_id").cast("double")), ["event_type"], ["event_id"], "x", "value", 200)
    return d.select("event_type", "segment", F.round("slope", 5).alias("slope"), "n")


@query("""SELECT event_type, round(avg(value) FILTER (event_id % 2 = 1) - avg(value) FILTER (event_id % 2 = 0), 6) AS difference,
 round((avg(value) FILTER (event_id % 2 = 1) - avg(value) FILTER (event_id % 2 = 0)) / sqrt(var_samp(value) FILTER (event_id % 2 = 1) / count(*) FILTER (event_id % 2 = 1) + var_samp(value) FILTER (event_id % 2 = 0) / count(*) FILTER (event_id % 2 = 0)), 5) AS t,
 count(*) FILTER (event_id % 2 = 1) AS n1, count(*) FILTER (event_id % 2 = 0) AS n0 FROM events GROUP BY 1""")
def difference_of_means(spark, sf_dir):
    d = stats.difference_of_means(events(spark, sf_dir), ["event_type"], F.col("event_id") % 2 == 1, "value")
    return d.select("event_type", F.round("difference", 6).alias("difference"), F.round("t", 5).alias("t"), "n1", "n0")


# ---- windows ---------------------------------------------------------------------------------

BY = (["user_id"], ["t", "event_id"])


@query("""SELECT event_id, round(m, 6) AS rolling_mean, round(s, 5) AS rolling_std, a AS rolling_min, b AS rolling_max FROM (SELECT event_id, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s,
 min(value) OVER w AS a, max(value) OVER w AS b, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE n >= 5""")
def running_stats(spark, sf_dir):
    r = windows.running_stats(events(spark, sf_dir), *BY, "value", 5)
    return r.select("event_id", F.round("rolling_mean", 6).alias("rolling_mean"), F.round("rolling_std", 5).alias("rolling_std"), "rolling_min", "rolling_max")


@query("""SELECT event_id, round((sum(value) OVER w + greatest(4 - row_number() OVER p, 0) * first_value(value) OVER p) / 4, 6) AS moving_average FROM events
 WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id), w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def moving_average(spark, sf_dir):
    return rounded(windows.moving_average(events(spark, sf_dir), *BY, "value", 4).select("event_id", "moving_average"))


@query("""WITH RECURSIVE s AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 r AS (SELECT user_id, event_id, n, value AS y FROM s WHERE n = 1 UNION ALL SELECT s.user_id, s.event_id, s.n, 0.3 * s.value + 0.7 * r.y FROM r JOIN s ON s.user_id = r.user_id AND s.n = r.n + 1) SELECT event_id, round(y, 6) AS ema FROM r""")
def exponential_moving_average(spark, sf_dir):
    return rounded(windows.exponential_average(events(spark, sf_dir), *BY, "value", 0.3).select("event_id", "ema"))


@query("SELECT event_id, round(coalesce(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0), 6) AS diff FROM events")
def first_difference(spark, sf_dir):
    return rounded(windows.difference(events(spark, sf_dir), *BY, "value").select("event_id", "diff"))


@query("""SELECT event_id, round(CASE WHEN a IS NULL THEN b - value WHEN b IS NULL THEN value - a ELSE (b - a) / 2 END, 6) AS derivative FROM (SELECT event_id, value, lag(value) OVER w AS a, lead(value) OVER w AS b
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
def differentiate(spark, sf_dir):
    return rounded(windows.differentiate(events(spark, sf_dir), *BY, "value").select("event_id", "derivative"))


@query("""SELECT event_id, round(sum(p) OVER (PARTITION BY user_id ORDER BY ts, event_id), 5) AS integral FROM
 (SELECT user_id, ts, event_id, coalesce((value + lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 2, 0) AS p FROM events)""")
def integrate(spark, sf_dir):
    return rounded(windows.integrate(events(spark, sf_dir), *BY, "value").select("event_id", "integral"), 5)


@query("""WITH g AS (SELECT event_type, t - lag(t) OVER w AS d, t, event_id FROM (SELECT *, epoch_us(ts) AS t FROM events) WINDOW w AS (PARTITION BY event_type ORDER BY t, event_id)),
 h AS (SELECT *, abs(d - lag(d) OVER (PARTITION BY event_type ORDER BY t, event_id)) AS c FROM g)
 SELECT event_type, count(d) AS n, round(avg(d), 3) AS mean_iat, round(stddev_pop(d), 3) AS std_iat, min(d) AS min_iat, max(d) AS max_iat, round(avg(c), 3) AS mean_change FROM h GROUP BY 1""")
def packet_jitter(spark, sf_dir):
    return rounded(windows.inter_arrival(events(spark, sf_dir), ["event_type"], ["t", "event_id"], "t"), 3)


@query("""WITH g AS (SELECT event_id, event_type, t - lag(t) OVER w AS gap, lag(t) OVER w AS gap_start FROM (SELECT *, epoch_us(ts) AS t FROM events) WINDOW w AS (PARTITION BY event_type ORDER BY t, event_id)),
 m AS (SELECT event_type, median(gap) AS e FROM g WHERE gap IS NOT NULL GROUP BY 1) SELECT event_id, event_type, gap, gap_start, (round_even(gap / e, 0) - 1)::BIGINT AS missing FROM g JOIN m USING (event_type) WHERE e > 0 AND gap > e * 3.0""")
def timestamp_gaps(spark, sf_dir):
    return windows.gaps_by_time(events(spark, sf_dir), ["event_type"], ["t", "event_id"], "t", 2.0).select("event_id", "event_type", "gap", "gap_start", "missing")


@query("""SELECT o_orderstatus, min(o_orderkey) AS first, max(o_orderkey) AS last, count(*) AS received, count(*) - count(DISTINCT o_orderkey) AS duplicates,
 max(o_orderkey) - min(o_orderkey) + 1 - count(DISTINCT o_orderkey) AS lost, round((max(o_orderkey) - min(o_orderkey) + 1 - count(DISTINCT o_orderkey)) / (max(o_orderkey) - min(o_orderkey) + 1), 6) AS loss_rate FROM orders GROUP BY 1""")
def packet_loss(spark, sf_dir):
    return rounded(windows.sequence_loss(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_orderkey"))


@query("""SELECT o_orderstatus, o_orderkey + 1 AS gap_from, n - 1 AS gap_to, n - o_orderkey - 1 AS missing FROM (SELECT o_orderstatus, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS n
 FROM (SELECT DISTINCT o_orderstatus, o_orderkey FROM orders)) WHERE n > o_orderkey + 1""")
def sequence_gaps(spark, sf_dir):
    return windows.sequence_gaps(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_orderkey")


@query("""WITH s AS (SELECT user_id, epoch_us(ts) AS t, event_id, value < 50 AS state FROM events), m AS (SELECT *, CASE WHEN state IS NOT DISTINCT FROM lag(state) OVER w THEN 0 ELSE 1 END AS nw FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
 r AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run FROM m) SELECT user_id, run::BIGINT AS run, state, count(*) AS n, min(t) AS start, max(t) AS stop FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 3""")
def idle_regions(spark, sf_dir):
    return windows.islands(events(spark, sf_dir), *BY, F.col("value") < 50, "t", 3)


@query("""WITH s AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events), m AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 3600000000 THEN 0 ELSE 1 END AS nw FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
 r AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY t, event_id) AS session FROM m) SELECT user_id, session::BIGINT AS session, count(*) AS n, min(t) AS start, max(t) AS stop FROM r GROUP BY 1, 2""")
def gap_sessions(spark, sf_dir):
    return windows.sessions(events(spark, sf_dir), *BY, "t", 3_600_000_000)


@query("""WITH e AS (SELECT epoch_us(ts) AS t, length(props) AS b FROM events), m AS (SELECT min(t) AS t0, max(t) AS t1 FROM e),
 g AS (SELECT t0, unnest(range(0, floor((t1 - t0 - 86400000000) / 43200000000 + 1e-9)::BIGINT + 1)) AS w FROM m)
 SELECT w, (t0 + w * 43200000000)::DOUBLE AS start, count(t) AS n, coalesce(sum(b), 0)::BIGINT AS total, round(coalesce(sum(b), 0) / 86400000000.0, 9) AS rate FROM g LEFT JOIN e ON t >= t0 + w * 43200000000 AND t < t0 + w * 43200000000 + 86400000000 GROUP BY 1, 2""")
def windowed_throughput(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("b", F.length("props"))
    return rounded(windows.hopping_throughput(e, "t", "b", 86_400_000_000.0), 9)


@query("""WITH r AS (SELECT event_id, event_type, 10 / nullif((lead(t, 9) OVER (PARTITION BY event_type ORDER BY t, event_id) - t) / 1e6, 0) AS rate FROM (SELECT *, epoch_us(ts) AS t FROM events)),
 z AS (SELECT event_id, event_type, rate, (rate - avg(rate) OVER w) / stddev_pop(rate) OVER w AS z FROM r WHERE rate IS NOT NULL WINDOW w AS (PARTITION BY event_type)) SELECT event_id, event_type, round(rate, 6) AS rate, round(z, 4) AS z FROM z WHERE abs(z) > 3""")
def message_rate_anomalies(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("s", F.col("t") / 1e6)
    z = windows.rate_anomalies(e.withColumn("s", F.col("t") / 1e6), ["event_type"], ["t", "event_id"], "s", 10)
    return z.select("event_id", "event_type", F.round("rate", 6).alias("rate"), F.round("z", 4).alias("z"))


@query("""WITH p AS (SELECT event_type, t, event_id, (t - lag(t) OVER w)::DOUBLE AS p FROM (SELECT *, epoch_us(ts) AS t FROM events) WINDOW w AS (PARTITION BY event_type ORDER BY t, event_id)),
 c AS (SELECT *, abs(p - lag(p) OVER (PARTITION BY event_type ORDER BY t, event_id)) AS c FROM p WHERE p IS NOT NULL) SELECT event_type, count(p) AS n, round(sqrt(avg(c * c)), 2) AS c2c_rms, max(c) - min(c) AS c2c_pp, round(avg(p), 2) AS period_mean,
 round(stddev_pop(p), 2) AS period_std, max(p) - min(p) AS period_pp FROM c GROUP BY 1 HAVING count(p) >= 3""")
def cycle_to_cycle_jitter(spark, sf_dir):
    from pyspark.sql import Window as W

    by = W.partitionBy("event_type").orderBy("t", "event_id")
    p = events(spark, sf_dir).withColumn("p", (F.col("t") - F.lag("t").over(by)).cast("double")).filter("p is not null")
    return rounded(windows.cycle_jitter(p, ["event_type"], ["t", "event_id"], "p"), 2)


@query("""WITH e AS (SELECT event_id, event_type, epoch_us(ts)::DOUBLE AS t FROM events) SELECT event_id, round(t - (min(t) OVER a + (row_number() OVER (PARTITION BY event_type ORDER BY t, event_id) - 1) * ((max(t) OVER a - min(t) OVER a) / (count(*) OVER a - 1))), 0) AS tie
 FROM e WINDOW a AS (PARTITION BY event_type) QUALIFY count(*) OVER (PARTITION BY event_type) >= 3""")
def time_interval_error(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("t", F.col("t").cast("double"))
    return rounded(windows.time_interval_error(e, ["event_type"], ["t", "event_id"], "t").select("event_id", "tie"), 0)


@query("""WITH p AS (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_state FROM events), c AS (SELECT event_type, next_state, count(*) AS n FROM p WHERE next_state IS NOT NULL GROUP BY 1, 2)
 SELECT event_type, next_state, n, round(n / sum(n) OVER (PARTITION BY event_type), 6) AS probability FROM c""")
def transition_probabilities(spark, sf_dir):
    return rounded(windows.transitions(events(spark, sf_dir), *BY, "event_type"))


@query("""SELECT a || '>' || b || '>' || c AS sequence, count(*) AS n FROM (SELECT event_type AS a, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c, lead(epoch_us(ts), 2) OVER w - epoch_us(ts) AS d FROM events
 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE c IS NOT NULL AND d <= 86400000000 GROUP BY 1""")
def message_sequences(spark, sf_dir):
    return windows.sequences(events(spark, sf_dir), *BY, "event_type", 3, "t", 86_400_000_000)


@query("""WITH x AS (SELECT event_type, event_id, value - avg(value) OVER (PARTITION BY event_type) AS x FROM events), l AS (SELECT event_type, unnest([0, 1, 2]) AS lag, unnest([x * x, x * lead(x) OVER w, x * lead(x, 2) OVER w]) AS p FROM x WINDOW w AS (PARTITION BY event_type ORDER BY event_id)),
 s AS (SELECT event_type, lag, sum(p) AS s FROM l GROUP BY 1, 2) SELECT a.event_type, a.lag, round(a.s / b.s, 6) AS acf FROM s a JOIN s b ON a.event_type = b.event_type AND b.lag = 0""")
def autocorrelation(spark, sf_dir):
    return rounded(windows.autocorrelation(events(spark, sf_dir), ["event_type"], ["event_id"], "value", 2))


# ---- joins -----------------------------------------------------------------------------------


@query("""SELECT event_id, (SELECT min(epoch_us(b.ts)) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.ts >= a.ts) AS asof_t FROM events a WHERE event_type = 'view'""")
def next_response(spark, sf_dir):
    e = events(spark, sf_dir)
    left, right = e.filter("event_type = 'view'").select("user_id", "event_id", "t"), e.filter("event_type = 'purchase'").select("user_id", "t")
    return joins.asof_merge(left, right, ["user_id"], "t", "t", [], forward=True).select("event_id", "asof_t")


@query("""SELECT a.event_id, b.t AS asof_t, b.value AS asof_value FROM (SELECT *, epoch_us(ts) AS t FROM events WHERE event_type = 'click') a ASOF LEFT JOIN
 (SELECT user_id, epoch_us(ts) AS t, min(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.t >= b.t""")
def last_before(spark, sf_dir):
    e = events(spark, sf_dir)
    right = e.filter("event_type = 'view'").groupBy("user_id", "t").agg(F.min("value").alias("value"))
    left = e.filter("event_type = 'click'").select("user_id", "event_id", "t")
    return joins.asof_merge(left, right, ["user_id"], "t", "t", ["value"]).select("event_id", "asof_t", "asof_value")


@query("""WITH e AS (SELECT user_id, event_type, epoch_us(ts) AS t FROM events), p AS (SELECT a.event_type AS kind_a, b.event_type AS kind_b, b.t - a.t AS d FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type <> b.event_type AND b.t > a.t AND b.t - a.t <= 3600000000)
 SELECT kind_a, kind_b, count(*) AS n, round(avg(d), 2) AS mean_delay, round(1 / (1 + stddev_pop(d) / avg(d)), 6) AS confidence FROM p GROUP BY 1, 2 HAVING count(*) >= 2""")
def message_pairs(spark, sf_dir):
    m = joins.message_pairs(events(spark, sf_dir), "t", "event_type", 3_600_000_000, 2, ["user_id"])
    return m.select("kind_a", "kind_b", "n", F.round("mean_delay", 2).alias("mean_delay"), F.round("confidence", 6).alias("confidence"))


@query("""WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS t FROM events), f AS (SELECT event_id, event_type, t, min(CASE WHEN event_type = 'purchase' THEN struct_pack(t := t, i := event_id) END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS p FROM e)
 SELECT event_id, p.t - t AS delay FROM f WHERE event_type = 'click' AND p.t - t <= 86400000000""")
def temporal_correlation(spark, sf_dir):
    return joins.first_follower(events(spark, sf_dir), ["user_id"], "event_type", "t", ["t", "event_id"], "click", "purchase", 86_400_000_000).select("event_id", "delay")


@query("""SELECT event_id FROM (SELECT event_id, max((value > 95)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS h FROM events) WHERE h = 1""")
def trigger_context(spark, sf_dir):
    return joins.context_window(events(spark, sf_dir), *BY, F.col("value") > 95, 2, 1).select("event_id")


@query("""WITH m AS (SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) / 2 AS m FROM events), e AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, epoch_us(ts) < m AS early FROM events, m),
 i AS (SELECT user_id, early, count(*) AS n, CASE WHEN max(t) > min(t) THEN (count(*) - 1) / (max(t) - min(t)) END AS f FROM e GROUP BY 1, 2), a AS (SELECT * FROM i WHERE early), b AS (SELECT * FROM i WHERE NOT early)
 SELECT coalesce(a.user_id, b.user_id) AS id, a.n AS a_n, b.n AS b_n, CASE WHEN a.user_id IS NULL THEN 'new' WHEN b.user_id IS NULL THEN 'disappeared' WHEN abs(b.f - a.f) / a.f > 0.2 THEN 'frequency_changed' ELSE 'same' END AS verdict FROM a FULL JOIN b ON a.user_id = b.user_id""")
def stimulus_response(spark, sf_dir):
    e = events(spark, sf_dir)
    mid = F.broadcast(e.agg(((F.min("t") + F.max("t")) / 2).alias("m")))  # one row
    e = e.crossJoin(mid).withColumn("s", F.col("t") / 1e6)
    return joins.compare_recordings(e.filter("t < m"), e.filter("t >= m"), "user_id", "s")


@query("""SELECT a.o_orderkey, round(a.p - b.p, 4) AS value FROM (SELECT o_orderkey, o_totalprice AS p FROM orders) a JOIN (SELECT l_orderkey, sum(l_extendedprice) AS p FROM lineitem GROUP BY 1) b ON a.o_orderkey = b.l_orderkey""")
def trace_difference(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("p"))
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("p"))
    return rounded(joins.zip_traces(a, b, ["o_orderkey"], "p", F.col("a") - F.col("b")).select("o_orderkey", "value"), 4)


@query("""SELECT n_name, r_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def device_lookup(spark, sf_dir):
    c = joins.lookup(table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"), "c_nationkey", "n_nationkey")
    c = joins.lookup(c, table(spark, sf_dir, "region"), "n_regionkey", "r_regionkey")
    return rounded(c.groupBy("n_name", "r_name").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("balance")), 2)


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_custkey % 3 = l_linenumber % 3)")
def unanswered_ids(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 3).alias("a"))
    li = table(spark, sf_dir, "lineitem").withColumn("b", F.col("l_linenumber") % 3)
    return joins.without_partner(li, o, [("l_orderkey", "o_orderkey"), ("b", "a")]).select("l_orderkey", "l_linenumber", "l_partkey")


@query()
def greedy_request_response(spark, sf_dir):
    e = events(spark, sf_dir)
    return joins.request_response(e.filter("event_type = 'view'"), e.filter("event_type = 'purchase'"), ["user_id"], "t", "event_id", "event_id", 86_400_000_000)


# ---- logs and filters ------------------------------------------------------------------------


@query("""SELECT event_id, ts, event_type, value FROM events WHERE ts BETWEEN (SELECT min(ts) + INTERVAL 1 DAY FROM events) AND (SELECT min(ts) + INTERVAL 3 DAY FROM events) AND event_type IN ('click', 'view')
 AND json_extract(props, '$.k')::INT > 50""")
def log_query(spark, sf_dir):
    from tidewire.operators import logs

    e = table(spark, sf_dir, "events")
    first = e.agg(F.min("ts")).first()[0]
    import datetime as dt

    q = logs.query(e, "ts", first + dt.timedelta(days=1), first + dt.timedelta(days=3), {"event_type": ["click", "view"]})
    return logs.json_field(q, "props", "$.k", lambda k: k.cast("int") > 50).select("event_id", "ts", "event_type", "value")


@query("""SELECT CASE WHEN grouping(event_type) = 0 THEN 'level' WHEN grouping(h) = 0 THEN 'hour' ELSE 'all' END AS grouping, coalesce(event_type, h::VARCHAR, '') AS key, count(*) AS n
 FROM (SELECT event_type, hour(ts) AS h FROM events) GROUP BY GROUPING SETS ((event_type), (h), ())""")
def log_statistics(spark, sf_dir):
    from tidewire.operators import logs

    return logs.statistics(table(spark, sf_dir, "events").withColumn("h", F.hour("ts").cast("string")), {"level": "event_type", "hour": "h"})


@query("""WITH h AS (SELECT ntile(2) OVER (ORDER BY ts, event_id) AS half, (event_type = 'error')::INT AS e FROM events), r AS (SELECT avg(e) FILTER (half = 1) AS a, avg(e) FILTER (half = 2) AS b FROM h)
 SELECT round(a, 6) AS first_rate, round(b, 6) AS second_rate, CASE WHEN b > a * 1.2 THEN 'increasing' WHEN b < a * 0.8 THEN 'decreasing' ELSE 'stable' END AS trend FROM r""")
def error_trend(spark, sf_dir):
    from tidewire.operators import logs

    return rounded(logs.error_trend(table(spark, sf_dir, "events"), ["ts", "event_id"], F.col("event_type") == "error"))


@query("""WITH m AS (SELECT regexp_replace(regexp_replace(url, '0x[0-9a-fA-F]+', '<HEX>', 'g'), '\\d+', '<NUM>', 'g') AS pattern FROM pages) SELECT pattern, count(*) AS n FROM m GROUP BY 1 HAVING count(*) >= 2""")
def log_patterns(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(payload.normalize_log(F.col("url")).alias("pattern"))
    return p.groupBy("pattern").agg(F.count("*").alias("n")).filter("n >= 2")


@query("""SELECT event_id, event_type, value FROM events WHERE value > 90 ORDER BY ts, event_id LIMIT 50 OFFSET 50""")
def paged_messages(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("value > 90").orderBy("ts", "event_id")
    return e.offset(50).limit(50).select("event_id", "event_type", "value")


# ---- payloads --------------------------------------------------------------------------------


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", F.encode("url", "UTF-8").alias("data"))


BYTES = "(SELECT page_id, p AS pos, ('0x' || substr(hex(encode(url)), 2 * p + 1, 2))::INT AS byte FROM (SELECT page_id, url, unnest(range(0, octet_length(encode(url)))) AS p FROM pages))"


@query(f"""WITH c AS (SELECT page_id, byte, count(*)::DOUBLE AS n FROM {BYTES} GROUP BY 1, 2) SELECT page_id, sum(n)::BIGINT AS n, round(abs(log2(sum(n)) - sum(n * log2(n)) / sum(n)), 6) AS entropy FROM c GROUP BY 1""")
def shannon_entropy(spark, sf_dir):
    return rounded(payload.shannon_entropy(pages(spark, sf_dir), ["page_id"], "data"))


@query(f"SELECT byte, count(*) AS n FROM {BYTES} GROUP BY 1")
def byte_histogram(spark, sf_dir):
    return payload.byte_histogram(pages(spark, sf_dir), [], "data")


@query(f"""WITH g AS (SELECT page_id, sum(bit_count(byte)) AS o, count(*) * 8 AS bits FROM {BYTES} GROUP BY 1) SELECT page_id, bits, round(o / bits, 6) AS ones, round(-(o / bits * log2(o / bits) + (1 - o / bits) * log2(1 - o / bits)), 6) AS bit_entropy FROM g""")
def bit_entropy(spark, sf_dir):
    return rounded(payload.bit_entropy(pages(spark, sf_dir), ["page_id"], "data"))


@query(f"""WITH t AS (SELECT count(*) AS total FROM {BYTES}), h AS (SELECT byte, count(*) AS n FROM {BYTES} GROUP BY 1), f AS (SELECT b::INT AS byte, coalesce(n, 0) AS n FROM range(0, 256) r(b) LEFT JOIN h ON byte = b)
 SELECT byte, n, round((n - total / 256.0) / sqrt(total * (1 / 256.0) * (255 / 256.0)), 4) AS z FROM f, t WHERE abs((n - total / 256.0) / sqrt(total * (1 / 256.0) * (255 / 256.0))) > 3""")
def byte_anomalies(spark, sf_dir):
    return rounded(payload.frequency_anomalies(pages(spark, sf_dir).withColumn("k", F.lit(1)), ["k"], "data").drop("k"), 4)


@query("""SELECT g AS gram, count(*) AS n FROM (SELECT substr(url, i, 3) AS g FROM (SELECT url, unnest(range(1, length(url) - 1)) AS i FROM pages)) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100""")
def top_ngrams(spark, sf_dir):
    return payload.top_ngrams(pages(spark, sf_dir), "url", 3)


@query("""WITH c AS (SELECT page_id, substr(url, i, 2) AS g, count(*)::DOUBLE AS n FROM (SELECT page_id, url, unnest(range(1, length(url))) AS i FROM pages) GROUP BY 1, 2)
 SELECT page_id, sum(n)::BIGINT AS n, round(abs(log2(sum(n)) - sum(n * log2(n)) / sum(n)), 6) AS entropy FROM c GROUP BY 1""")
def ngram_entropy(spark, sf_dir):
    return rounded(payload.ngram_entropy(pages(spark, sf_dir), ["page_id"], "url", 2))


@query("""WITH c AS (SELECT substr(url, i, 2) AS gram, count(*) AS n FROM (SELECT url, unnest(range(1, length(url))) AS i FROM pages) GROUP BY 1), m AS (SELECT avg(n) AS m FROM c) SELECT gram, n, round((n - m) / sqrt(m), 4) AS z FROM c, m WHERE abs((n - m) / sqrt(m)) >= 5""")
def unusual_ngrams(spark, sf_dir):
    return rounded(payload.unusual_ngrams(pages(spark, sf_dir), "url", 2, 5.0), 4)


_PROFILE = "(SELECT substr(text, i, 2) AS gram, count(*) AS n FROM (SELECT text, unnest(range(1, length(text))) AS i FROM {0}) GROUP BY 1)"


@query(f"""SELECT round(count(*) FILTER (a > 0 AND b > 0) / count(*), 6) AS jaccard, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) AS cosine, round(sum((a - b) * (a - b) / (a + b)), 2) AS chi_square
 FROM (SELECT coalesce(x.n, 0)::DOUBLE AS a, coalesce(y.n, 0)::DOUBLE AS b FROM {_PROFILE.format("benchmark")} x FULL JOIN {_PROFILE.format("conversations")} y USING (gram))""")
def ngram_profiles(spark, sf_dir):
    a, b = (payload.ngram_counts(table(spark, sf_dir, t), [], "text", 2) for t in ("benchmark", "conversations"))
    c = payload.compare_ngram_profiles(a, b)
    return c.select(F.round("jaccard", 6).alias("jaccard"), F.round("cosine", 6).alias("cosine"), F.round("chi_square", 2).alias("chi_square"))


@query(f"SELECT gram FROM {_PROFILE.format('benchmark')} INTERSECT SELECT gram FROM {_PROFILE.format('conversations')}")
def common_ngrams(spark, sf_dir):
    return payload.common_ngrams(*(payload.ngram_counts(table(spark, sf_dir, t), [], "text", 2) for t in ("benchmark", "conversations")))


@query("""SELECT page_id, i AS pos FROM (SELECT page_id, url, unnest(range(0, greatest(length(url) - 1, 0)))::INT AS i FROM pages) WHERE substr(url, i + 1, 2) = 'th'""")
def pattern_positions(spark, sf_dir):
    return payload.pattern_positions(pages(spark, sf_dir), ["page_id"], "url", "th")


@query("""SELECT doc_id, item_id, i AS pos FROM (SELECT doc_id, text, item_id, p, unnest(range(0, greatest(length(text) - length(p) + 1, 0)))::INT AS i FROM documents, (SELECT item_id, text AS p FROM benchmark) WHERE contains(text, p)) WHERE substr(text, i + 1, length(p)) = p""")
def multi_pattern_search(spark, sf_dir):
    p = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("p"))
    return payload.multi_pattern_search(table(spark, sf_dir, "documents"), p, ["doc_id"], "text", "item_id", "p")


@query(f"""WITH b AS {BYTES}, c AS (SELECT page_id, byte, count(*)::DOUBLE AS n FROM b GROUP BY 1, 2), h AS (SELECT page_id, sum(n)::BIGINT AS n, abs(log2(sum(n)) - sum(n * log2(n)) / sum(n)) AS e FROM c GROUP BY 1),
 p AS (SELECT page_id, avg((byte BETWEEN 32 AND 126 OR byte IN (9, 10, 13))::INT) AS p FROM b GROUP BY 1) SELECT page_id, n, round(e, 6) AS entropy, round(p, 6) AS printable, CASE WHEN e < 0.5 THEN 'constant' WHEN e >= 7.5 THEN 'random' WHEN e >= 6 THEN 'compressed' WHEN p >= 0.9 THEN 'text' ELSE 'structured' END AS kind FROM h JOIN p USING (page_id)""")
def classify_payloads(spark, sf_dir):
    return rounded(payload.classify(pages(spark, sf_dir), ["page_id"], "data"))


@query(f"""WITH w AS (SELECT page_id, byte, unnest(range(greatest(ceil((pos - 31) / 8)::INT, 0), least(floor(pos / 8)::INT, floor((len - 32) / 8)::INT) + 1)) AS k FROM {BYTES} JOIN (SELECT page_id, octet_length(encode(url)) AS len FROM pages) USING (page_id)),
 c AS (SELECT page_id, k, byte, count(*)::DOUBLE AS n FROM w GROUP BY 1, 2, 3) SELECT page_id, k::INT AS "window", sum(n)::BIGINT AS n, round(abs(log2(sum(n)) - sum(n * log2(n)) / sum(n)), 6) AS entropy FROM c GROUP BY 1, 2""")
def sliding_entropy(spark, sf_dir):
    return rounded(payload.sliding_entropy(pages(spark, sf_dir), ["page_id"], "data", 32, 8))


@query(f"""WITH b AS (SELECT * FROM {BYTES}), c AS (SELECT pos, byte, count(*)::DOUBLE AS n FROM b GROUP BY 1, 2), h AS (SELECT pos, sum(n)::BIGINT AS n, abs(log2(sum(n)) - sum(n * log2(n)) / sum(n)) AS e, arg_max(byte, n * 1000 - byte) AS mode FROM c GROUP BY 1),
 s AS (SELECT pos, min(byte) AS min, max(byte) AS max, avg(byte) AS mean, stddev_pop(byte) AS std, count(DISTINCT byte) AS "unique" FROM b GROUP BY 1) SELECT pos::INT AS pos, n, round(e, 5) AS entropy, min, max, round(mean, 5) AS mean, round(std, 5) AS std, "unique", mode FROM h JOIN s USING (pos)""")
def message_columns(spark, sf_dir):
    return rounded(payload.column_stats(pages(spark, sf_dir), "data"), 5)


@query("SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY k) - 1)::INT AS part, message FROM (SELECT page_id, unnest(string_split(url, '/')) AS message, unnest(range(0, len(string_split(url, '/')))) AS k FROM pages) WHERE message <> ''")
def segment_messages(spark, sf_dir):
    return payload.segment(pages(spark, sf_dir), ["page_id"], "url", "/")


@query(f"""SELECT page_id, (sum(byte) % 256)::BIGINT AS sum8, (sum(CASE WHEN pos % 2 = 0 THEN byte * 256 ELSE byte END) % 65536)::BIGINT AS sum16, bit_xor(byte) AS xor8 FROM {BYTES} GROUP BY 1""")
def payload_checksums(spark, sf_dir):
    return payload.checksums(pages(spark, sf_dir), ["page_id"], "data").drop("crc32")


@query()
def crc32_checksums(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.crc32("data").alias("crc32"))


@query()
def fuzzy_search(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("p"))
    return payload.fuzzy_search(table(spark, sf_dir, "documents"), items, ["doc_id"], "text", "item_id", "p", 4)


LINES = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]

# ---- digital, measurements, power ------------------------------------------------------------


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts)::DOUBLE AS t, value AS b, lag(value) OVER w AS a, lag(epoch_us(ts)) OVER w AS ta FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
 SELECT event_id, CASE WHEN a < 50 AND b >= 50 THEN 'rising' ELSE 'falling' END AS edge, round(ta + greatest(least((50 - a) / (b - a), 1), 0) * (t - ta), 0) AS edge_time FROM e WHERE (a < 50 AND b >= 50) OR (a >= 50 AND b < 50)""")
def level_edges(spark, sf_dir):
    e = traces.edges(events(spark, sf_dir), *BY, "value", "t", 50.0)
    return rounded(e.select("event_id", "edge", "edge_time"), 0)


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts)::DOUBLE AS t, value AS b, lag(value) OVER w AS a, lag(epoch_us(ts)) OVER w AS ta FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 x AS (SELECT user_id, a < 50 AS up, ta + greatest(least((50 - a) / (b - a), 1), 0) * (t - ta) AS x FROM e WHERE (a < 50 AND b >= 50) OR (a >= 50 AND b < 50)), n AS (SELECT user_id, up, x, lead(x) OVER w AS y, lead(up) OVER w AS nu FROM x WINDOW w AS (PARTITION BY user_id ORDER BY x))
 SELECT user_id, count(*) AS pulses, round(avg(y - x), -1) AS width FROM n WHERE up AND NOT nu GROUP BY 1""")
def pulse_widths(spark, sf_dir):
    p = traces.pulses(events(spark, sf_dir), *BY, "value", "t", 50.0)
    return rounded(p.groupBy("user_id").agg(F.count("*").alias("pulses"), F.avg("width").alias("width")), -1)


@query("""WITH s AS (SELECT event_id, value, value BETWEEN 30 AND 70 AS i, lag(value BETWEEN 30 AND 70) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS w FROM events)
 SELECT event_id, CASE WHEN i AND NOT w THEN 'entry' WHEN value > 70 THEN 'exit_high' ELSE 'exit_low' END AS crossing FROM s WHERE i <> w""")
def window_trigger(spark, sf_dir):
    return traces.window_crossings(events(spark, sf_dir), *BY, "value", 30.0, 70.0).select("event_id", "crossing")


@query("""SELECT event_id FROM (SELECT event_id, (value >= 50)::INT AS a, lead((value >= 50)::INT, 1) OVER w AS b, lead((value >= 50)::INT, 2) OVER w AS c, lead((value >= 50)::INT, 3) OVER w AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE a = 1 AND b = 0 AND d = 1""")
def pattern_trigger(spark, sf_dir):
    return traces.bit_pattern(events(spark, sf_dir), *BY, F.col("value") >= 50, "10X1").select("event_id")


@query("""SELECT l_orderkey, l_linenumber, ((l_returnflag = 'R')::INT + 2 * (l_linestatus = 'O')::INT + 4 * (l_quantity > 25)::INT)::BIGINT AS word FROM lineitem""")
def bus_words(spark, sf_dir):
    w = traces.pack_bits([F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", F.col("l_quantity") > 25])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", w.alias("word"))


@query("""SELECT o_orderkey, (o_orderkey >> 4) & 255 AS field, CASE WHEN (o_orderkey & 15) >= 8 THEN (o_orderkey & 15) - 16 ELSE o_orderkey & 15 END AS signed_field, bit_count(o_orderkey)::INT AS weight, bit_count(xor(o_orderkey, o_custkey))::INT AS distance FROM orders""")
def bit_fields(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", protocols.extract_bits(k, 4, 8).alias("field"), protocols.extract_bits(k, 0, 4, True).alias("signed_field"), F.bit_count(k).alias("weight"),
        payload.hamming_distance(k, F.col("o_custkey")).alias("distance"),
    )


@query("""WITH i AS (SELECT o_orderkey, (o_orderkey * 7919) % 536870912 AS id FROM orders) SELECT o_orderkey, (id >> 26) & 7 AS priority, CASE WHEN (id >> 16) & 255 < 240 THEN (((id >> 24) & 1) << 16) | (((id >> 16) & 255) << 8) ELSE (((id >> 24) & 1) << 16) | (((id >> 16) & 255) << 8) | ((id >> 8) & 255) END AS pgn,
 CASE WHEN (id >> 16) & 255 < 240 THEN (id >> 8) & 255 ELSE 255 END AS destination, id & 255 AS source FROM i""")
def j1939_fields(spark, sf_dir):
    i = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 7919 % 536870912).alias("id"))
    j = i.select("o_orderkey", protocols.j1939(F.col("id")).alias("j")).select("o_orderkey", "j.*")
    return j.select("o_orderkey", *[F.col(c).cast("long").alias(c) for c in ("priority", "pgn", "destination", "source")])


@query("""WITH p AS (SELECT l_suppkey, l_quantity AS v, l_extendedprice / 1000 AS i, l_quantity * l_extendedprice / 1000 AS p, lag(l_quantity * l_extendedprice / 1000) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS q FROM lineitem),
 g AS (SELECT l_suppkey, avg(p) AS a, sqrt(avg(p * p)) AS rms, max(abs(p)) AS peak, sum(coalesce((p + q) / 2, 0)) AS energy, stddev_pop(p) AS std, sqrt(avg(v * v)) * sqrt(avg(i * i)) AS s FROM p GROUP BY 1)
 SELECT l_suppkey, round(a, 4) AS average, round(rms, 4) AS rms, round(peak, 4) AS peak, round(energy, 3) AS energy, round(std, 4) AS std, round(s, 4) AS apparent, round(sqrt(greatest(s * s - a * a, 0)), 3) AS reactive, round(a / s, 6) AS power_factor FROM g""")
def power_statistics(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("i", F.col("l_extendedprice") / 1000)
    p = traces.power_statistics(li, ["l_suppkey"], LINES, "l_quantity", "i", 1.0)
    digits = {"average": 4, "rms": 4, "peak": 4, "energy": 3, "std": 4, "apparent": 4, "reactive": 3, "power_factor": 6}
    return p.select("l_suppkey", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query("""WITH d AS (SELECT l_suppkey, avg(l_extendedprice) OVER (PARTITION BY l_suppkey) AS dc, l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_suppkey) AS ac FROM lineitem), g AS (SELECT l_suppkey, first(dc) AS dc, max(ac) - min(ac) AS pp, sqrt(avg(ac * ac)) AS rms, max(abs(ac)) AS pk FROM d GROUP BY 1)
 SELECT l_suppkey, round(dc, 4) AS dc, round(pp, 4) AS pp, round(rms, 4) AS rms, round(abs(pp / dc) * 100, 4) AS pp_percent, round(abs(rms / dc) * 100, 4) AS rms_percent, round(CASE WHEN rms > 0 THEN pk / rms END, 4) AS crest FROM g""")
def ripple_statistics(spark, sf_dir):
    return rounded(traces.ripple(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice"), 4)


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)), 5) AS rms, round(list_max(list_transform(embedding, lambda x: abs(x)))::DOUBLE, 5) AS peak, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / len(embedding), 5) AS mean FROM embeddings""")
def vector_measurements(spark, sf_dir):
    v = F.transform("embedding", lambda x: x.cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(F.sqrt(total(F.transform(v, lambda x: x * x)) / F.size(v)), 5).alias("rms"), F.round(F.array_max(F.transform(v, lambda x: F.abs(x))), 5).alias("peak"), F.round(total(v) / F.size(v), 5).alias("mean"),
    )


@query("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS d FROM embeddings) SELECT d::INT AS dim, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM x GROUP BY 1""")
def golden_average(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("dim", "v"))
    return rounded(x.groupBy("dim").agg(F.count("*").alias("n"), F.avg(F.col("v").cast("double")).alias("mean"), F.stddev_pop(F.col("v").cast("double")).alias("std")))


@query("""WITH x AS (SELECT label % 256 AS b, unnest(range(0, len(embedding))) AS s, unnest(embedding)::DOUBLE AS v FROM embeddings), h AS (SELECT g, s, bit_count(xor(b, g))::DOUBLE AS h, v FROM x, range(0, 256) r(g))
 SELECT g::INT AS guess, s::INT AS sample, round(coalesce(CASE WHEN isnan(corr(h, v)) THEN 0 ELSE corr(h, v) END, 0), 6) AS r FROM h GROUP BY 1, 2""")
def correlation_power_analysis(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select((F.col("label") % 256).alias("b"), F.transform("embedding", lambda x: x.cast("double")).alias("s"))
    return rounded(traces.correlation_attack(e, "s", "b", range(256)))


@query()
def waveform_measurements(spark, sf_dir):
    return traces.waveform_measurements(table(spark, sf_dir, "lineitem"), ["l_suppkey"], LINES, "l_extendedprice", 1000.0)


@query()
def amplitude_spectrum(spark, sf_dir):
    return traces.fft(table(spark, sf_dir, "lineitem"), ["l_suppkey"], LINES, "l_extendedprice", 1000.0)


@query()
def welch_density(spark, sf_dir):
    e = stats.numbered(events(spark, sf_dir), ["event_type"], ["t", "event_id"], "idx")
    return traces.psd(e, ["event_type"], "idx", "value", 1.0, 128)


@query()
def lowpass_filter(spark, sf_dir):
    return traces.filtered(events(spark, sf_dir), ["event_type"], ["t", "event_id"], "value", 1.0, "low", 0.1)


# ---- streaming forms run over the same rows --------------------------------------------------


@query("""SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n, round(sum(value), 4) AS total, max(value) AS peak FROM events GROUP BY 1, 2""")
def tumbling_windows(spark, sf_dir):
    from tidewire.streaming import event_time

    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = event_time.tumbling(e, "ts", "1 hour", ["event_type"], "value")
    return w.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"), "peak")


@query("""SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1""")
def distinct_kinds(spark, sf_dir):
    return events(spark, sf_dir).select("user_id", "event_type").distinct().groupBy("user_id").agg(F.count("*").alias("n"))


@query("""SELECT event_id, round(CASE WHEN value > 50 THEN sqrt(value) * 2 + abs(value - 75) ELSE value / 3 END, 6) AS y FROM events""")
def math_expression(spark, sf_dir):
    from tidewire.plans.expressions import compile_expression

    e = events(spark, sf_dir)
    return rounded(e.select("event_id", compile_expression("(sqrt(value) * 2 + abs(value - 75)) if value > 50 else value / 3", {"value": F.col("value")}).alias("y")))


# ---- mining ----------------------------------------------------------------------------------


@query()
def kmeans_clusters(spark, sf_dir):
    return mining.kmeans(table(spark, sf_dir, "embeddings"), "embedding", 8).groupBy("cluster").agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS d FROM embeddings), m AS (SELECT label AS c, d, avg(v) AS m FROM x GROUP BY 1, 2),
 t AS (SELECT vec_id, c, sum((v - m) * (v - m)) AS s FROM x JOIN m USING (d) GROUP BY 1, 2) SELECT vec_id, arg_min(c, s) AS nearest, round(min(s), 6) AS squared_distance FROM t GROUP BY 1""")
def nearest_centroid(spark, sf_dir):
    return rounded(mining.nearest_centroid(table(spark, sf_dir, "embeddings"), "embedding", "label").select("vec_id", "nearest", "squared_distance"))


@query("""WITH s AS (SELECT DISTINCT user_id, event_type FROM events), t AS (SELECT count(DISTINCT user_id) AS total FROM s), n AS (SELECT event_type, count(*) AS k FROM s GROUP BY 1),
 p AS (SELECT x.event_type AS a, y.event_type AS b, count(*) AS n FROM s x JOIN s y ON x.user_id = y.user_id AND x.event_type < y.event_type GROUP BY 1, 2)
 SELECT a, b, p.n AS n, round(p.n / total, 6) AS support, round(p.n / na.k, 6) AS confidence, round(p.n * total / (na.k * nb.k), 6) AS lift FROM p, t, n na, n nb WHERE na.event_type = a AND nb.event_type = b AND p.n >= total * 0.1 AND na.k >= total * 0.1 AND nb.k >= total * 0.1""")
def associations(spark, sf_dir):
    return rounded(mining.frequent_items(table(spark, sf_dir, "events"), ["user_id"], "event_type", 0.1))


@query("""WITH c AS (SELECT event_type, user_id, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2) SELECT event_type, sum(n)::BIGINT AS n, count(*) AS "unique", round(abs(log2(sum(n)) - sum(n * log2(n)) / sum(n)), 6) AS entropy, arg_max(user_id, n * 1000000 + user_id) AS mode FROM c GROUP BY 1""")
def field_profile(spark, sf_dir):
    return rounded(mining.field_profile(table(spark, sf_dir, "events"), ["event_type"], "user_id"))


@query("""WITH w AS (SELECT user_id, event_type, sum(value) AS w FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(w, 6) DESC, event_type) AS r, sum(w) OVER (PARTITION BY user_id) AS s FROM w) SELECT user_id, event_type AS winner, round(w / s, 6) AS confidence FROM r WHERE r = 1""")
def weighted_vote(spark, sf_dir):
    return rounded(mining.vote(table(spark, sf_dir, "events"), ["user_id"], "event_type", "value"))


@query("""SELECT a.conv_id, a.turn, b.turn - a.turn AS latency FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = (SELECT min(turn) FROM conversations c WHERE c.conv_id = a.conv_id AND c.turn > a.turn AND c.role = 'assistant') WHERE a.role = 'user' AND b.role = 'assistant'""")
def conversation_latency(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    left, right = c.filter("role = 'user'").select("conv_id", "turn"), c.filter("role = 'assistant'").select("conv_id", "turn")
    a = joins.asof_merge(left, right, ["conv_id"], "turn", "turn", [], forward=True).filter("asof_t is not null")
    return a.select("conv_id", "turn", (F.col("asof_t") - F.col("turn")).alias("latency"))


@query("""SELECT l.quality, l.toxic, d.lang, count(*) AS n, round(avg(d.n_chars), 4) AS mean_chars FROM documents d JOIN labels l USING (doc_id) GROUP BY 1, 2, 3""")
def label_quality(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return rounded(d.groupBy("quality", "toxic", "lang").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean_chars")), 4)
