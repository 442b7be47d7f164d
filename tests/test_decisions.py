"""Decisions where semantics could go either way; README lists them under the same letters."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.functions import signal as S
from tidewire.operators import joins, logs, mining, payload, protocols, stats, traces, windows
from tidewire.plans.expressions import compile_expression


def test_rolling_extremes_evict_like_the_mean(spark):  # C3
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate([9.0, 1.0, 2.0, 3.0, 4.0])], "k string, i int, v double")
    last = windows.running_stats(df, ["k"], ["i"], "v", 3).orderBy("i").collect()[-1]
    assert (last.rolling_min, last.rolling_max, last.rolling_mean) == (2.0, 4.0, 3.0)


def test_filters_come_before_the_page(spark):  # C6
    df = spark.createDataFrame([(i, f'{{"k": {i % 2}}}') for i in range(20)], "i int, j string")
    kept = logs.json_field(df, "j", "$.k", lambda k: k.cast("int") == 1)
    assert kept.count() == 10 and [r.i for r in logs.page(kept, ["i"], 2, 4).collect()] == [9, 11, 13, 15]


def test_uuids_are_seen_before_their_digits(spark):  # C9
    row = spark.range(1).select(payload.normalize_log(F.lit("id 123e4567-e89b-12d3-a456-426614174000 took 0x1F in 35 'ms'")).alias("m")).first()
    assert row.m == "id <UUID> took <HEX> in <NUM> <STR>"


def test_times_are_compared_as_times(spark):  # C10
    df = spark.sql("select timestamp'2024-01-01 09:00:00' as t union all select timestamp'2024-01-01 10:00:00'")
    import datetime as dt

    assert logs.query(df, "t", dt.datetime(2024, 1, 1, 9, 30)).count() == 1


def test_associations_are_pairs(spark):  # C13
    df = spark.createDataFrame([(g, x) for g in range(4) for x in ("a", "b")] + [(4, "c")], "g int, x string")
    assert [(r.a, r.b, r.n) for r in mining.frequent_items(df, ["g"], "x", 0.5).collect()] == [("a", "b", 4)]


def test_as_of_may_reuse_a_response_and_greedy_matching_does_not(spark):  # C15
    q = spark.createDataFrame([("k", 1.0, 1), ("k", 2.0, 2)], "k string, t double, i int")
    r = spark.createDataFrame([("k", 3.0, 7)], "k string, t double, i int")
    assert [x.asof_t for x in joins.asof_merge(q, r, ["k"], "t", "t", [], forward=True).collect()] == [3.0, 3.0]
    assert joins.request_response(q, r, ["k"], "t", "i", "i", 10.0).count() == 1


def test_little_endian_signals_count_bits_as_dbc_does(spark):  # C17
    row = spark.range(1).select(protocols.can_signal(F.unhex(F.lit("3412000000000000")), 4, 8).alias("v")).first()
    assert row.v == (0x1234 >> 4) & 0xFF


def test_loss_counts_distinct_sequence_numbers(spark):  # C18
    df = spark.createDataFrame([("k", s) for s in (1, 2, 2, 5, None)], "k string, s int")
    r = windows.sequence_loss(df, ["k"], "s").first()
    assert (r.received, r.duplicates, r.lost, r.loss_rate) == (4, 1, 2, 0.4)


def test_vanishing_mad_falls_back_to_the_largest_deviation(spark):  # C19
    df = spark.createDataFrame([("k", 1.0)] * 9 + [("k", 5.0)], "k string, v double")
    assert [r.v for r in stats.modified_zscore_outliers(df, ["k"], "v", 3.4).collect()] == [5.0]


def test_sample_and_population_deviation(spark):  # C20
    df = spark.createDataFrame([("k", float(v)) for v in (1, 2, 3, 4, 40)], "k string, v double")
    assert abs(stats.basic_stats(df, ["k"], "v").first().variance - np.var([1, 2, 3, 4, 40])) < 1e-9
    z = stats.zscore_outliers(df, ["k"], "v", 1.5).first()
    assert abs(z.zscore - (40 - 10) / np.std([1, 2, 3, 4, 40], ddof=1)) < 1e-9


def test_expressions_compare_row_by_row(spark):  # C22
    df = spark.createDataFrame([(1.0,), (9.0,)], "x double").select(compile_expression("1 if x > 5 else 0", {"x": F.col("x")}).alias("y"))
    assert sorted(r.y for r in df.collect()) == [0, 1]


def test_edges_lie_at_the_sample_after_the_crossing(spark):  # C23
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate([0.0, 0.0, 1.0, 1.0])], "k string, i int, v double")
    assert [r.i for r in traces.edges(df, ["k"], ["i"], "v", "i", 0.5).collect()] == [2]


def test_one_definition_of_q():  # C24
    assert S.q_factor(1e-12) == pytest.approx(7.0345, abs=1e-3) and math.isnan(S.q_factor(0.7))
