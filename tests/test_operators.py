"""Operators that SQL states badly or not at all, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.functions import checksums, inference, waveforms
from tidewire.operators import joins, messages, payload, protocols, signals, stats


def test_percentiles_beyond_the_sketch(spark, monkeypatch):
    """Groups larger than the sketch resolves, with ties, skew, nulls and NaN."""
    monkeypatch.setattr(stats, "SKETCH", 200)
    rng = np.random.default_rng(1)
    groups = {"a": rng.lognormal(0, 2, 30_000), "b": rng.integers(0, 5, 20_000).astype(float), "c": np.array([3.0]), "d": np.r_[np.zeros(9_000), rng.normal(size=1_000)], None: rng.normal(size=700)}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("a", None), ("a", float("nan")), ("e", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    at = (0.0, 0.01, 0.05, 0.25, 0.5, 0.95, 1.0)
    got = {r.k: r for r in stats.percentiles(df, ["k"], "v", at).collect()}
    assert set(got) == {*groups, "e"} and got["e"].p50 is None
    for k, x in groups.items():
        for q in at:
            assert abs(got[k][f"p{round(q * 100):02d}"] - np.percentile(x, q * 100)) < 1e-9, (k, q)
    whole = stats.percentiles(df.filter("k = 'a'"), [], "v", (0.5,)).first()
    assert abs(whole.p50 - np.median(groups["a"])) < 1e-9
    plan = stats.percentiles(df, ["k"], "v")._jdf.queryExecution().toString()
    assert " percentile(" not in plan


def test_numbered_rows(spark):
    rows = [(k, i, None) for k in ("a", "b", None) for i in range(0, 500, 3)]
    df = spark.createDataFrame(rows, "k string, t int, x int").repartition(5)
    got = {(r.k, r.t): r.n for r in stats.numbered(df, ["k"], ["t"], "n").collect()}
    assert got == {(k, t): t // 3 for k, t, _ in rows}


def test_crc_of_rows_equals_the_plain_form():
    r = random.Random(3)
    rows = [bytes(r.randrange(256) for _ in range(r.choice([0, 1, 2, 9, 40]))) for _ in range(60)]
    for f in (checksums.CRC8, checksums.CRC8_MAXIM, checksums.CRC16_CCITT, checksums.CRC16_MODBUS, checksums.CRC16_X25, checksums.CRC32):
        assert checksums.crc_of_rows(f, rows).tolist() == [f(x) for x in rows]
    assert checksums.crc_of_rows(checksums.CRC8, []).tolist() == []


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_search_finds_occurrences_anywhere(spark):
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    patterns = [(i, word(30)) for i in range(5)] + [(5, "ab"), (6, None), (7, "")]
    texts = [(0, None), (1, ""), (2, patterns[0][1])]
    for k in range(12):
        p = list(patterns[k % 5][1])
        for _ in range(k % 4):
            at = r.randrange(len(p))
            p[at : at + 1] = r.choice([["x"], [], [p[at], "y"]])
        texts.append((10 + k, word(r.randint(0, 200)) + "".join(p) + word(40)))
    got = {(x.doc, x.id): (x.distance, x.stop) for x in payload.fuzzy_search(
        spark.createDataFrame(texts, "doc int, t string"), spark.createDataFrame(patterns, "id int, p string"), ["doc"], "t", "id", "p", 3).collect()}
    want = {}
    for d, t in texts:
        for i, p in patterns[:5]:
            ends = [(min(edits(p, t[a:z]) for a in range(max(0, z - 34), z + 1)), z) for z in range(len(t or "") + 1)] if t is not None else []
            if ends and min(ends)[0] <= 3:
                want[(d, i)] = min(ends)
    assert got == want and len(want) >= 12


def test_many_patterns_in_parts(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "abcabcab"), (2, "xbcx"), (3, None)], "d int, t string")
    patterns = spark.createDataFrame([(1, "abc"), (2, "bc"), (3, "c"), (4, ""), (5, None), (6, "zz"), (7, "bc")], "i int, p string")
    want = {(1, 1, 0), (1, 1, 3), (1, 2, 1), (1, 2, 4), (1, 3, 2), (1, 3, 5), (2, 2, 1), (2, 3, 2), (1, 7, 1), (1, 7, 4), (2, 7, 1)}
    for size in (8 << 20, 3):
        monkeypatch.setattr(payload, "PATTERN_BYTES", size)
        assert {tuple(r) for r in payload.multi_pattern_search(texts, patterns, ["d"], "t", "i", "p").collect()} == want


def test_group_inference(spark):
    words = spark.createDataFrame([("g", i, list(w)) for i, w in enumerate(["ab", "abab", "ababab"])], "k string, i int, w array<string>")
    rows = messages.state_machines(words, ["k"], ["i"], "w").collect()
    step = {(r.state, r.symbol): r.next_state for r in rows}
    assert step[(step[(0, "a")], "b")] is not None
    msgs = [(0, i, bytes([0xAA, i, 7 * i % 251, 3])) for i in range(12)]
    df = spark.createDataFrame(msgs, "k int, i int, m binary")
    kinds = [(r.start, r.stop, r.kind) for r in messages.inferred_fields(df, ["k"], ["i"], "m").orderBy("start").collect()]
    assert kinds[0] == (0, 1, "constant") and kinds[1][2] == "counter" and kinds[-1] == (3, 4, "constant")
    crcs = spark.createDataFrame([(0, i, m, checksums.CRC8(m)) for _, i, m in msgs], "k int, i int, m binary, c int")
    assert messages.crc_parameters(crcs, ["k"], ["i"], "m", "c", 8).first().poly == 0x07
    aligned = [r.aligned for r in messages.multiple_alignment(df.filter("i < 3"), ["k"], ["i"], "m").collect()]
    assert len({len(a) for a in aligned}) == 1
    tree = {r.row: r.cluster for r in messages.hierarchical_clusters(spark.createDataFrame([(0, i, m) for i, m in enumerate([b"aaaa", b"zzzz", b"aaab", b"zzzy"])], "k int, i int, m binary"), ["k"], ["i"], "m", 2).collect()}
    assert tree == {0: 0, 2: 0, 1: 1, 3: 1}


def test_samples_as_rows_decode_like_arrays(spark):
    line = waveforms.uart_line(b"Hi", 8).tolist()
    rows = spark.createDataFrame([("c", i, int(v)) for i, v in enumerate(line)], "ch string, idx int, level int").repartition(3)
    captures = protocols.sampled(rows, ["ch"], ["idx"], ["level"])
    assert [r.value for r in protocols.decode(captures, ["ch"], "uart", ["level"], fs=8.0, baud=1.0).orderBy("frame").collect()] == [72, 105]


def test_polygons_limits_and_units(spark):
    pts = spark.createDataFrame([(x / 4 + 0.13, y / 4 + 0.11) for x in range(-4, 20) for y in range(-4, 20)], "x double, y double")
    star = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]

    def inside(x, y):
        out = False
        for (ax, ay), (bx, by) in zip(star, [*star[1:], star[0]], strict=True):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                out = not out
        return out

    got = pts.withColumn("h", signals.inside_polygon(F.col("x"), F.col("y"), star)).collect()
    assert [(r.x, r.y) for r in got if r.h != inside(r.x, r.y)] == [] and any(r.h for r in got)
    row = spark.range(1).select(signals.convert_units(F.lit(2.5), "kHz", "Hz").alias("a"), signals.si_text(F.lit(0.0015), "A", 2).alias("b"), signals.duration_text(F.lit(3725.0)).alias("c")).first()
    assert row.a == 2500 and row.b == "1.50 mA" and row.c == "1h 2m 5.0s"
    with pytest.raises(ValueError):
        signals.convert_units(F.lit(1.0), "V", "Hz")


def test_kernel_density_integrates_to_one(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=400)
    df = spark.createDataFrame([("k", float(v)) for v in x] * 2, "k string, v double")
    for kernel in ("gaussian", "epanechnikov", "tophat"):
        d = signals.kernel_density(df, ["k"], "v", 60, kernel).orderBy("point").toPandas()
        area = np.trapezoid(d.density, d.x)
        assert 0.9 < area <= 1.02


def test_shared_folder_is_asked_for_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from tidewire import session

    def fake(master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None))

    with pytest.raises(ValueError):
        session.shared_dir(fake("spark://host:7077"))
    assert session.shared_dir(fake("local[4]"))


def test_without_partner_and_content(spark):
    a = spark.createDataFrame([(1, 2), (2, 3), (None, 1)], "x int, y int")
    b = spark.createDataFrame([(1, 2)], "u int, v int")
    assert {tuple(r) for r in joins.without_partner(a, b, [("x", "u"), ("y", "v")]).collect()} == {(2, 3), (None, 1)}


@pytest.mark.parametrize("metric", ["hamming", "jaccard"])
def test_distance_matrix_in_blocks(spark, monkeypatch, metric):
    """Groups of several blocks: every pair once, and no task makes all pairs of a group."""
    monkeypatch.setattr(messages, "BLOCK", 7)
    rng = np.random.default_rng(3)
    groups = {k: [bytes(rng.integers(0, 3, rng.integers(0, 6)).astype(np.uint8)) for _ in range(n)] for k, n in (("a", 40), ("b", 7), (None, 15), ("c", 1))}
    df = spark.createDataFrame([(k, 100 - n, m) for k, x in groups.items() for n, m in enumerate(x)], "k string, n int, m binary").repartition(3)
    out = messages.distance_matrix(df, ["k"], ["n"], "m", metric)
    want = {(k, i, j): 1 - inference.similarity(x[::-1][i], x[::-1][j], metric) for k, x in groups.items() for j in range(len(x)) for i in range(j)}
    got = out.collect()
    assert len(got) == len(want) and {(r.k, r.i, r.j): r.distance for r in got} == want
    tasks = out.withColumn("t", F.spark_partition_id()).filter("k = 'a'").select("t").distinct().count()
    assert tasks > 1 and out.dtypes == [("k", "string"), ("i", "int"), ("j", "int"), ("distance", "double")]


@pytest.mark.parametrize("metric", ["hamming", "levenshtein"])
def test_distance_matrix_hands_over_a_row_for_each_left_message(spark, monkeypatch, metric):
    """Messages of one length, of many lengths, null and empty: all pairs, made of few rows from Python, and rounded
    as Spark rounds, but before there is a row for each pair."""
    monkeypatch.setattr(messages, "BLOCK", 16)
    rng = np.random.default_rng(4)
    word = lambda n: b"msg" + bytes(rng.integers(0, 3, n).astype(np.uint8))
    groups = {1: [word(9) for _ in range(37)], 2: [word(n) for n in rng.integers(0, 60, 35)] + [None, b""], 3: [b"", b"", None], 4: [word(300) for _ in range(20)]}
    df = spark.createDataFrame([(k, n, m) for k, x in groups.items() for n, m in enumerate(x) if metric == "hamming" or k != 4], "k int, n int, m binary")
    plain, out = (messages.distance_matrix(df, ["k"], ["n"], "m", metric, digits) for digits in (None, 3))
    by = lambda d: {(r.k, r.i, r.j): r.distance for r in d.collect()}
    told = lambda x, y: None if x is None or y is None else 1 - inference.similarity(x, y, metric)
    want = {(k, i, j): told(x[i], x[j]) for k, x in groups.items() if metric == "hamming" or k != 4 for j in range(len(x)) for i in range(j)}
    assert by(plain) == want
    assert by(out) == by(plain.withColumn("distance", F.round("distance", 3)))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan.split("FlatMapGroupsInArrow")[0] and "_codes" in plan and "round(" not in plan


def test_hamming_clusters_hold_distinct_messages_only(spark, monkeypatch):
    """Every row of every group is told its cluster, while a task is handed each message once."""
    seen = []
    real = messages.grouped

    def grouped(df, *rest):
        seen.append(df.count())
        return real(df, *rest)

    monkeypatch.setattr(messages, "grouped", grouped)
    rng = np.random.default_rng(8)
    rows = [(int(k), n, bytes(rng.choice([b"aaaa", b"aaab", b"abbb", b"zzzz", b"aabb"]))) for n, k in enumerate(rng.integers(0, 3, 300))]
    got = messages.hamming_clusters(spark.createDataFrame(rows, "k int, n int, m binary").repartition(4), ["k"], ["n"], "m", 0.3).collect()
    want = {(k, i): c for k in range(3) for i, c in enumerate(inference.cluster_by_hamming([m for g, _, m in rows if g == k], 0.3))}
    assert len(got) == 300 and {(r.k, r.row): r.cluster for r in got} == want and seen == [15]
