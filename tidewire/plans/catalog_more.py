"""Queries of events, zones, circuit measures, flows and message groups, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import checksums
from tidewire.operators import joins, logs, messages, payload, signals, traces, windows
from tidewire.plans.catalog import BY, BYTES, events, pages, query, rounded, table


@query("""SELECT event_id, 'low' AS zone FROM events WHERE value > 10.005 AND value < 30.005 AND event_id % 100 < 49.5 AND event_id % 100 > 0.5 UNION ALL SELECT event_id, 'late' FROM events WHERE value > 20.005 AND value < 90.005 AND event_id % 100 > 39.5 AND event_id % 100 < 80.5""")
def zone_triggers(spark, sf_dir):
    box = lambda a, b, c, d: [(a, c), (b, c), (b, d), (a, d)]
    zones = {"low": box(0.5, 49.5, 10.005, 30.005), "late": box(39.5, 80.5, 20.005, 90.005)}
    return signals.zone_hits(events(spark, sf_dir), (F.col("event_id") % 100).cast("double"), F.col("value"), zones).select("event_id", "zone")


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.95) AS z FROM events GROUP BY 1) SELECT event_id, greatest(least(floor((value - a) / (z - a) * 3 + 0.5), 3), 0)::INT AS level FROM events JOIN q USING (event_type)""")
def multi_level_signal(spark, sf_dir):
    return signals.multi_level(events(spark, sf_dir), ["event_type"], "value", 4).select("event_id", "level")


@query("""WITH g AS (SELECT event_type, avg(value / 30) FILTER (value / 30 >= 2.0) AS high, avg(value / 30) FILTER (value / 30 <= 0.8) AS low FROM events GROUP BY 1) SELECT event_type, round(high, 6) AS high, round(low, 6) AS low, round(high - 2.0, 6) AS nmh, round(0.8 - low, 6) AS nml FROM g""")
def noise_margins(spark, sf_dir):
    return rounded(signals.noise_margins(events(spark, sf_dir).withColumn("v", F.col("value") / 30), ["event_type"], "v"))


@query("""WITH g AS (SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events) SELECT event_id, i AS "interval", CASE WHEN i < 60000000 THEN 'too_short' ELSE 'too_long' END AS violation FROM g WHERE i < 60000000 OR i > 20000000000""")
def timing_constraints(spark, sf_dir):
    v = signals.constraint_violations(events(spark, sf_dir), ["event_type"], ["t", "event_id"], "t", 60_000_000, 20_000_000_000)
    return v.select("event_id", "interval", "violation")


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts)::DOUBLE AS t, value AS b, lag(value) OVER w AS a, lag(epoch_us(ts)) OVER w AS ta FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 x AS (SELECT user_id, a < 50 AS up, ta + greatest(least((50 - a) / (b - a), 1), 0) * (t - ta) AS x FROM e WHERE (a < 50 AND b >= 50) OR (a >= 50 AND b < 50)), n AS (SELECT user_id, up, x, lead(x) OVER w AS y, lead(up) OVER w AS nu FROM x WINDOW w AS (PARTITION BY user_id ORDER BY x)), p AS (SELECT user_id, (y - x) / 1e6 AS width FROM n WHERE up AND NOT nu)
 SELECT user_id, count(width) AS n, round(avg(width), 1) AS mean, round(stddev_pop(width), 1) AS std, round(min(width), 1) AS min, round(max(width), 1) AS max FROM p GROUP BY 1""")
def pulse_statistics(spark, sf_dir):
    p = traces.pulses(events(spark, sf_dir), *BY, "value", "t", 50.0).withColumn("width", F.col("width") / 1e6)
    return rounded(signals.pulse_statistics(p, ["user_id"]), 1)


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts)::DOUBLE AS t, value AS b, lag(value) OVER w AS a, lag(epoch_us(ts)) OVER w AS ta FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 x AS (SELECT user_id, a < 50 AS up, ta + greatest(least((50 - a) / (b - a), 1), 0) * (t - ta) AS x FROM e WHERE (a < 50 AND b >= 50) OR (a >= 50 AND b < 50)), n AS (SELECT user_id, up, x, lead(x) OVER w AS y, lead(up) OVER w AS nu FROM x WINDOW w AS (PARTITION BY user_id ORDER BY x)), p AS (SELECT user_id, x, y - x AS width FROM n WHERE up AND NOT nu),
 g AS (SELECT user_id, width, lead(x) OVER (PARTITION BY user_id ORDER BY x) - (x + width) AS gap FROM p), h AS (SELECT user_id, avg(width) AS high, avg(gap) AS low FROM g WHERE gap IS NOT NULL GROUP BY 1) SELECT user_id, round(high / 1e6, 1) AS high, round(low / 1e6, 1) AS low, round(abs(high - low) / (high + low), 5) AS distortion FROM h""")
def duty_distortion(spark, sf_dir):
    p = traces.pulses(events(spark, sf_dir), *BY, "value", "t", 50.0)
    d = signals.duty_distortion(p, ["user_id"], "start", "width")
    return d.select("user_id", F.round(F.col("high") / 1e6, 1).alias("high"), F.round(F.col("low") / 1e6, 1).alias("low"), F.round("distortion", 5).alias("distortion"))


@query("""SELECT l_suppkey, round(sum(l_tax) * 0.001, 6) AS charge, round(max(l_quantity) - min(l_quantity), 6) AS swing, round(sum(l_tax) * 0.001 / (max(l_quantity) - min(l_quantity)), 9) AS capacitance FROM lineitem GROUP BY 1""")
def capacitance(spark, sf_dir):
    c = signals.capacitance(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_tax", 0.001)
    return c.select("l_suppkey", F.round("charge", 6).alias("charge"), F.round("swing", 6).alias("swing"), F.round("capacitance", 9).alias("capacitance"))


@query("""SELECT l_suppkey, round(coalesce(sum(l_quantity * l_tax) FILTER (l_quantity > 20 AND l_tax > 0.02), 0) * 0.001, 6) AS energy, count(*) FILTER (l_quantity > 20 AND l_tax > 0.02) AS samples, round(sum(l_quantity * l_tax) * 0.001, 6) AS total FROM lineitem GROUP BY 1""")
def switching_loss(spark, sf_dir):
    return rounded(signals.switching_loss(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_tax", 0.001, 20.0, 0.02))


@query("""WITH g AS (SELECT l_returnflag, sum(l_quantity) AS w, sum(l_quantity * l_extendedprice) AS wx, sum(l_quantity * l_extendedprice * l_extendedprice) AS wxx FROM lineitem GROUP BY 1), m AS (SELECT l_returnflag, wx / w AS m, sqrt(greatest(wxx - w * (wx / w) * (wx / w), 0) / w) AS s FROM g) SELECT l_returnflag, round(m, 3) AS weighted_mean, round(s, 3) AS weighted_std, round(1 / (1 + s / m), 6) AS agreement FROM m""")
def ensemble_estimates(spark, sf_dir):
    e = signals.weighted_ensemble(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity")
    return e.select("l_returnflag", F.round("weighted_mean", 3).alias("weighted_mean"), F.round("weighted_std", 3).alias("weighted_std"), F.round("agreement", 6).alias("agreement"))


@query("""WITH g AS (SELECT user_id, (count(*) - 1) / (max(epoch_us(ts) / 1e6) - min(epoch_us(ts) / 1e6)) AS f FROM events GROUP BY 1 HAVING max(ts) > min(ts)), m AS (SELECT 2.0e-5 AS a, 2.7e-5 AS b) SELECT event_id FROM events JOIN g USING (user_id), m WHERE f BETWEEN a AND b""")
def ids_in_frequency_band(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("s", F.col("t") / 1e6)
    return signals.frequency_band(e, "user_id", "s", 2.0e-5, 2.7e-5).select("event_id")


@query("""SELECT user_id % 20 AS batch, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 3) AS seconds, round(avg(value), 6) AS mean_duration, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate, round(count(*) / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6), 9) AS throughput FROM events GROUP BY 1""")
def batch_statistics(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("batch", F.col("user_id") % 20)
    b = logs.batch_summary(e, "batch", "t", F.col("event_type") == "error", F.col("value"))
    digits = {"seconds": 3, "mean_duration": 6, "error_rate": 6, "throughput": 9}
    return b.select("batch", "n", "errors", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query("SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_name LIKE 'red%' AND p_retailprice >= 901")
def protocols_by_name(spark, sf_dir):
    return logs.find_by_name(table(spark, sf_dir, "part"), "p_name", "red*", "p_retailprice", 901.0).select("p_partkey", "p_name", "p_retailprice")


@query("""WITH r AS (SELECT a.user_id, epoch_us(a.ts) AS s, min(epoch_us(b.ts)) AS e FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND b.ts >= a.ts WHERE a.event_type = 'view' GROUP BY a.user_id, a.event_id, a.ts) SELECT user_id, count(*) AS pairs, max(e) - min(s) AS span, max(e - s) AS max_latency FROM r GROUP BY 1""")
def message_flows(spark, sf_dir):
    e = events(spark, sf_dir)
    left, right = e.filter("event_type = 'view'").select("user_id", "event_id", "t"), e.filter("event_type = 'purchase'").select("user_id", "t")
    pairs = joins.asof_merge(left, right, ["user_id"], "t", "t", [], forward=True).filter("asof_t is not null")
    return logs.flows(pairs, "user_id", "t", "asof_t")


@query("""WITH s AS (SELECT event_type AS a, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT a || '>' || b AS sequence, count(*) AS n, 2 AS length FROM s WHERE b IS NOT NULL GROUP BY 1 HAVING count(*) >= 10 UNION ALL SELECT a || '>' || b || '>' || c, count(*), 3 FROM s WHERE c IS NOT NULL GROUP BY 1 HAVING count(*) >= 10""")
def sequence_patterns(spark, sf_dir):
    return windows.sequence_patterns(events(spark, sf_dir), *BY, "event_type", (2, 3), 10)


@query("""WITH s AS (SELECT event_type AS a, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c, epoch_us(ts) AS t, lead(epoch_us(ts)) OVER w AS t2, lead(epoch_us(ts), 2) OVER w AS t3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT a || '>' || b || '>' || c AS sequence, count(*) AS n, round(avg(t3 - t) / 1e6, 2) AS mean_span FROM s WHERE t2 - t <= 86400000000 AND t3 - t2 <= 86400000000 GROUP BY 1""")
def temporal_patterns(spark, sf_dir):
    p = windows.temporal_patterns(events(spark, sf_dir), *BY, "event_type", "t", 86_400_000_000, 3)
    return p.select("sequence", "n", F.round(F.col("mean_span") / 1e6, 2).alias("mean_span"))


@query("SELECT s_nationkey, count(*) AS n, count(*) FILTER (s_suppkey % 4 <> 0) AS matches, round(count(*) FILTER (s_suppkey % 4 <> 0) / count(*), 6) AS rate FROM supplier GROUP BY 1")
def checksum_verification(spark, sf_dir):
    from tidewire.plans.catalog_messages import be, raw

    b = raw("s_name")
    tail = (checksums.checksum(b, "crc16_modbus") + F.when(F.col("s_suppkey") % 4 == 0, 1).otherwise(0)) % 65536
    s = table(spark, sf_dir, "supplier").withColumn("m", F.concat(b, be(tail, 2)))
    return rounded(payload.verify_checksums(s, ["s_nationkey"], "m", "crc16_modbus", 2))


@query(f"""WITH b AS (SELECT page_id, pos // 8 AS w, byte FROM {BYTES}), c AS (SELECT page_id, w, byte, count(*)::DOUBLE AS n FROM b GROUP BY 1, 2, 3), h AS (SELECT page_id, w, sum(n) AS n, abs(log2(sum(n)) - sum(n * log2(n)) / sum(n)) AS e FROM c GROUP BY 1, 2), p AS (SELECT page_id, w, avg((byte BETWEEN 32 AND 126 OR byte IN (9, 10, 13))::INT) AS p FROM b GROUP BY 1, 2),
 k AS (SELECT page_id, w, CASE WHEN e < 0.5 THEN 'constant' WHEN p >= 0.9 THEN 'text' ELSE 'binary' END AS kind FROM h JOIN p USING (page_id, w) WHERE n = 8), r AS (SELECT *, w - row_number() OVER (PARTITION BY page_id, kind ORDER BY w) AS g FROM k) SELECT page_id, kind, min(w)::INT AS first, max(w)::INT AS last FROM r GROUP BY page_id, kind, g""")
def typed_regions(spark, sf_dir):
    return payload.typed_regions(pages(spark, sf_dir), ["page_id"], "data", 8)


@query("""WITH t AS (SELECT count(*) AS t FROM pages), g AS (SELECT (i - 1)::INT AS pos, substr(url, i, n) AS gram FROM (SELECT url, unnest(range(1, length(url) + 1)) AS i FROM pages), (VALUES (4), (6)) v(n) WHERE i + n <= length(url) + 1) SELECT pos, gram, count(*) AS n, round(count(*) / any_value(t), 6) AS share FROM g, t GROUP BY 1, 2 HAVING count(*) >= 10""")
def header_signatures(spark, sf_dir):
    return rounded(payload.signatures(pages(spark, sf_dir), ["page_id"], "url", (4, 6), 10))


@query("""SELECT l_returnflag, count(*) AS n, count(*) FILTER (abs(l_quantity - l_extendedprice / 1000) > 30) AS violations, round(max(abs(l_quantity - l_extendedprice / 1000)), 6) AS max_deviation, round(sqrt(avg(pow(l_quantity - l_extendedprice / 1000, 2))), 5) AS rms_deviation, count(*) FILTER (abs(l_quantity - l_extendedprice / 1000) > 30) = 0 AS passed FROM lineitem GROUP BY 1""")
def trace_comparison(spark, sf_dir):
    c = traces.compare_traces(table(spark, sf_dir, "lineitem").withColumn("b", F.col("l_extendedprice") / 1000), ["l_returnflag"], "l_quantity", "b", 30.0)
    return c.select("l_returnflag", "n", "violations", F.round("max_deviation", 6).alias("max_deviation"), F.round("rms_deviation", 5).alias("rms_deviation"), "passed")


@query("""SELECT page_id, unnest(regexp_extract_all(url, '[0-9]+', 0)) AS match FROM pages""")
def packet_regex(spark, sf_dir):
    return payload.regex_search(pages(spark, sf_dir), ["page_id"], "url", "[0-9]+").select("page_id", "match")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, epoch_us(ts) // 1000000 AS unix FROM events")
def timestamp_texts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.floor(windows.micros("ts") / 1_000_000).alias("unix"))


@query("""WITH r AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(0, 64)) AS k FROM embeddings), d AS (SELECT vec_id, b, sum((v - m) * cos(2 * pi() * ((b * k) % 64) / 64)) AS re, sum((v - m) * sin(2 * pi() * ((b * k) % 64) / 64)) AS im FROM r JOIN (SELECT vec_id, avg(v) AS m FROM r GROUP BY 1) USING (vec_id), range(1, 33) q(b) GROUP BY 1, 2)
 SELECT vec_id, arg_max(b, CASE WHEN b = 32 THEN 1 ELSE 2 END * sqrt(re * re + im * im))::BIGINT AS bin FROM d GROUP BY 1""")
def ripple_frequency(spark, sf_dir):
    s = traces.analyze(table(spark, sf_dir, "embeddings"), ["vec_id"], "spectrum", ["embedding"], name="rectangular").filter("bin > 0")
    return s.groupBy("vec_id").agg(F.max_by("bin", "magnitude").alias("bin"))


@query("""SELECT user_id, count(*) AS n FROM (SELECT user_id, event_id FROM events WHERE event_type = 'view' INTERSECT SELECT user_id, event_id FROM events WHERE value > 50) GROUP BY 1""")
def set_intersection(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.filter("event_type = 'view'").select("user_id", "event_id").intersect(e.filter("value > 50").select("user_id", "event_id")).groupBy("user_id").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, c_mktsegment || ':' || right(c_name, 3) AS message, 1.0 - levenshtein(c_mktsegment, right(c_name, 9)) / greatest(length(c_mktsegment), 9) AS similarity FROM customer""")
def message_similarity(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("tail", F.substring("c_name", -9, 9))
    return c.select("c_custkey", F.concat_ws(":", "c_mktsegment", F.substring("c_name", -3, 3)).alias("message"), payload.similarity(F.col("c_mktsegment"), F.col("tail")).alias("similarity"))


@query()
def multiple_alignment(spark, sf_dir):
    c = table(spark, sf_dir, "supplier").withColumn("m", F.encode("s_name", "UTF-8"))
    return messages.multiple_alignment(c, ["s_nationkey"], ["s_suppkey"], "m")
