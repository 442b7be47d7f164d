import datetime as dt
import io
import struct
import wave

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidewire.operators import joins, logs, payload, stats, windows
from tidewire.plans import pipeline, queries
from tidewire.plans.expressions import compile_expression
from tidewire.sources import files
from tidewire.streaming import event_time


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_queries_and_their_sql_have_names_in_common():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def _shown(v) -> str:
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, np.ndarray)):
        return str([_shown(x) for x in v])
    if pd.isna(v):
        return "-"
    return f"{float(v) + 0.0:.6f}" if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_their_sql(spark, sf_dir, name):
    import duckdb

    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    want = c.execute(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(want)
    rows = lambda d: sorted(tuple(map(_shown, r)) for r in d[sorted(d.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


def test_band_join_has_no_nested_loop(spark):
    a = spark.range(100).select((F.col("id") * 1.5).alias("t"))
    b = spark.range(100).select((F.col("id") * 1.1).alias("u"))
    met = joins.band_join(a, b, "t", "u", 2.0)
    want = sum(0 <= 1.1 * j - 1.5 * i <= 2.0 for i in range(100) for j in range(100))
    assert met.count() == want
    assert "NestedLoop" not in met._jdf.queryExecution().toString() and "Cartesian" not in met._jdf.queryExecution().toString()


def test_asof_takes_the_nearest(spark):
    left = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("b", 2.0)], "k string, t double")
    right = spark.createDataFrame([("a", 1.0, 10), ("a", 4.0, 20), ("a", 9.0, 30)], "k string, t double, v int")
    back = {(r.k, r.t): r.asof_v for r in joins.asof_merge(left, right, ["k"], "t", "t", ["v"]).collect()}
    assert back == {("a", 1.0): 10, ("a", 5.0): 20, ("b", 2.0): None}
    forth = {(r.k, r.t): r.asof_v for r in joins.asof_merge(left, right, ["k"], "t", "t", ["v"], forward=True).collect()}
    assert forth == {("a", 1.0): 10, ("a", 5.0): 30, ("b", 2.0): None}


def test_greedy_matching_uses_each_once(spark):
    q = spark.createDataFrame([("k", 1.0, 1), ("k", 2.0, 2)], "k string, t double, i int")
    s = spark.createDataFrame([("k", 2.5, 7), ("k", 2.6, 8), ("k", 9.0, 9)], "k string, t double, i int")
    got = {(r.request, r.response) for r in joins.request_response(q, s, ["k"], "t", "i", "i", 2.0).collect()}
    assert got == {(1, 7), (2, 8)}


def test_degenerate_statistics(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", float("nan")), ("b", 2.0)], "k string, v double")
    assert {r.k: (r.n, r["std"]) for r in stats.basic_stats(df, ["k"], "v").collect()} == {"a": (2, 0.0), "b": (1, 0.0)}
    assert stats.zscore_outliers(df, ["k"], "v").count() == 0
    assert {r.normalized for r in stats.normalize(df.filter("k = 'a'"), ["k"], "v").collect()} == {0.0}
    assert windows.time_interval_error(df.filter("k = 'a'"), ["k"], ["v"], "v").count() == 0


def test_payload_edges(spark):
    df = spark.createDataFrame([(1, bytearray(b"\0\0\0\0"), ""), (2, bytearray(b""), "aXXbXXc"), (3, bytearray(range(256)), "ab")], "i int, d binary, s string")
    assert {r.i: round(r.entropy, 6) for r in payload.shannon_entropy(df, ["i"], "d").collect()} == {1: 0.0, 3: 8.0}
    assert {r.i: r.kind for r in payload.classify(df, ["i"], "d").collect()} == {1: "constant", 3: "random"}
    best = payload.delimiter_scores(df, "s", ["XX", "b"]).orderBy(F.desc("score")).first()
    assert best.delimiter == "XX" and best["count"] == 2
    assert [r.message for r in payload.segment(df.filter("i = 2"), ["i"], "s", "XX").orderBy("part").collect()] == ["a", "b", "c"]
    same = spark.createDataFrame([(bytearray(b"\xaa\x55\x01"),), (bytearray(b"\xaa\x55\x02"),)], "d binary")
    assert [r.byte for r in payload.common_prefix(same, "d").orderBy("pos").collect()] == [0xAA, 0x55]
    a, b = (payload.byte_histogram(df.filter(f"i = {k}"), [], "d") for k in (1, 3))
    assert payload.compare_distributions(a, b).first().chi_square > 1


def test_logs(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(minutes=i), "ERROR" if i % 3 == 0 else "INFO", f"m{i % 2}", f"read {i} bytes from 0x{i:x}", '{"k": %d}' % i) for i in range(12)]
    df = spark.createDataFrame(rows, "at timestamp, level string, module string, message string, meta string")
    got = logs.query(df, "at", t0 + dt.timedelta(minutes=3), t0 + dt.timedelta(minutes=9), {"level": ["ERROR"]}, {"module": "m*"})
    assert got.count() == 3
    assert logs.json_field(df, "meta", "$.k", lambda k: k.cast("int") >= 10).count() == 2
    s = logs.summary(df, "at", "level", "message", "module").first()
    assert s.pattern == "read <NUM> bytes from <HEX>" and s["count"] == 12 and s.levels == {"ERROR": 4, "INFO": 8} and sorted(s.sources) == ["m0", "m1"]
    assert logs.page(df, ["at"], 2, 5).count() == 5
    assert logs.error_rate(df, "at", F.col("level") == "ERROR", 360).count() == 2


def test_expressions(spark):
    df = spark.createDataFrame([(4.0, 2.0), (9.0, 0.0)], "a double, b double")
    names = {"a": F.col("a"), "b": F.col("b")}
    run = lambda e: [r[0] for r in df.select(compile_expression(e, names)).collect()]
    assert run("sqrt(a) + b ** 2 - 1") == [5.0, 2.0]
    assert run("1 if 0 < b < 3 and not a > 5 else 0") == [1, 0]
    assert run("a / b")[0] == 2.0 and np.isnan(run("a / b")[1])
    for bad in ("__import__('os')", "a.b", "c + 1", "(lambda: 1)()", "[a]"):
        with pytest.raises(ValueError):
            compile_expression(bad, names)


def test_chain_and_registry(spark):
    rows = [("k", i, float(np.sin(2 * np.pi * 5 * i / 200) * 2 + 1)) for i in range(400)]
    trace = pipeline.Trace(spark.createDataFrame(rows, "k string, i long, v double"), ["k"], ["i"], "v", 200.0)
    r = {x["name"]: x.value for x in pipeline.run_chain('load "x" | filter lowpass 20 | measure', lambda _: trace).collect()}
    assert abs(r["frequency"] - 5) < 0.1
    assert pipeline.run_chain("load x | slice i 0.5s 1s | diff | stats", lambda _: trace).first().n == 100
    with pytest.raises(ValueError):
        pipeline.run_chain("load x | nothing", lambda _: trace)
    assert pipeline.seconds("1.5ms") == 1.5e-3 and pipeline.pipe(2, lambda x: x + 1, lambda x: x * 2) == 6 == pipeline.compose(lambda x: x * 2, lambda x: x + 1)(2)

    @pipeline.register("test", "twice")
    def twice(x):
        return 2 * x

    assert pipeline.algorithm("test", "twice")(4) == 8
    with pytest.raises(KeyError):
        pipeline.algorithm("test", "thrice")


def test_files(spark, tmp_path):
    tone = np.sin(np.arange(500) / 9)
    buf = io.BytesIO()
    with wave.open(buf, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes((np.stack((tone, -tone), 1) * 32000).astype("<i2").tobytes())
    (tmp_path / "a.wav").write_bytes(buf.getvalue())
    np.savez(tmp_path / "a.npz", x=tone, sample_rate=100.0)
    (tmp_path / "a.csv").write_text("time,ch1\n" + "\n".join(f"{i / 50},{v}" for i, v in enumerate(tone)))
    (tmp_path / "a.vcd").write_text("$timescale 1ns $end\n$var wire 1 ! clk $end\n$var wire 4 # bus [3:0] $end\n$enddefinitions $end\n#0\n0!\nb1010 #\n#5\n1!\nx!\n")
    (tmp_path / "a.s2p").write_text("# MHz S RI R 50\n! note\n1 1 0 2 0 3 0 4 0\n2 5 1 6 1 7 1 8 1\n")
    (tmp_path / "a.raw").write_bytes(tone.astype("<f4").tobytes())
    w = files.load(spark, f"{tmp_path}/a.wav")
    assert w.count() == 1000 and abs(w.filter("channel = 'ch1' and idx = 20").first().v + tone[20] * 32000 / 32768) < 1e-4
    n = files.load(spark, f"{tmp_path}/a.npz").first()
    assert n.fs == 100 and n.channel == "x"
    c = files.load(spark, f"{tmp_path}/a.csv")
    assert c.count() == 500 and abs(c.first().fs - 50) < 1e-6 and c.first().channel == "ch1"
    v = [(r.channel, r.idx, r.v) for r in files.load(spark, f"{tmp_path}/a.vcd").collect()]
    assert v == [("clk", 0, 0.0), ("bus", 0, 10.0), ("clk", 5, 1.0), ("clk", 5, None)]
    s = {(r.i, r.j): (r.frequency, r.re) for r in files.load(spark, f"{tmp_path}/a.s2p").filter("frequency = 2e6").collect()}
    assert s == {(1, 1): (2e6, 5.0), (2, 1): (2e6, 6.0), (1, 2): (2e6, 7.0), (2, 2): (2e6, 8.0)}
    r = files.read_each(spark, f"{tmp_path}/a.raw", files.raw_parser(), files.SAMPLES)
    assert r.count() == 500
    with pytest.raises(ValueError):
        files.load(spark, "x.unknown")


def test_captures(spark, tmp_path):
    udp = struct.pack(">HHHH", 53, 1024, 12, 0) + b"data"
    ip = bytes([0x45, 0, 0, 20 + len(udp), 0, 0, 0, 0, 64, 17, 0, 0, 10, 0, 0, 1, 10, 0, 0, 2])
    frame = b"\0" * 12 + b"\x08\x00" + ip + udp
    head = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    (tmp_path / "a.pcap").write_bytes(head + struct.pack("<IIII", 5, 250000, len(frame), len(frame)) + frame)
    p = files.load(spark, f"{tmp_path}/a.pcap").first()
    assert (p.timestamp, p.src, p.dst, p.protocol, p.src_port, bytes(p.payload)) == (5.25, "10.0.0.1", "10.0.0.2", "UDP", 53, b"data")
    (tmp_path / "a.asc").write_text("date x\n 0.0100 1 18FEF100x Rx d 2 01 FF\n 0.02 1 123 Rx d 0\n")
    (tmp_path / "a.log").write_text("(1.5) can0 123#DEADBEEF\n")
    got = [(r.timestamp, r.channel, r.arbitration_id, r.is_extended, bytes(r.data)) for r in files.read_can_log(spark, f"{tmp_path}/a.asc").collect()]
    assert got == [(0.01, "1", 0x18FEF100, True, b"\x01\xff"), (0.02, "1", 0x123, False, b"")]
    assert bytes(files.read_can_log(spark, f"{tmp_path}/a.log").first().data) == bytes.fromhex("DEADBEEF")
    row = {"arbitration_id": 256, "message": "Engine", "signal": "Rpm", "start_bit": 8, "length": 16, "big_endian": False, "signed": True, "scale": 0.25, "offset": 1.0, "unit": "rpm"}
    (tmp_path / "a.dbc").write_text(files.dbc_text([row]))
    back = files.read_dbc(spark, f"{tmp_path}/a.dbc").drop("path").first().asDict()
    assert back == row
    (tmp_path / "a.bin").write_bytes(bytes(range(12)))
    assert sorted(bytes(r.data) for r in files.read_fixed_records(spark, f"{tmp_path}/a.bin", 4).collect()) == [bytes(range(i, i + 4)) for i in (0, 4, 8)]
    assert "dissector" in files.dissector_lua("Demo", [("id", 0, 2)]) and "type: u2" in files.kaitai("Demo", [("id", 0, 2)])


def stream(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}")
    return spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{name}").schema).parquet(f"{tmp_path}/{name}")


def test_streams_equal_batches(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(seconds=7 * i), f"k{i % 2}", float(i)) for i in range(60)]
    schema = "ts timestamp, k string, v double"
    live = stream(spark, tmp_path, "a", rows, schema)
    batch = spark.createDataFrame(rows, schema)
    got = event_time.run_available(event_time.tumbling(live, "ts", "1 minute", ["k"], "v"), "w", f"{tmp_path}/c1", "complete")
    want = event_time.tumbling(batch, "ts", "1 minute", ["k"], "v")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    rolled = {(r.k, r.ts): (r.n, r["mean"], r.low, r.high) for r in event_time.run_available(event_time.rolling(live, "k", "ts", "v", 5), "r", f"{tmp_path}/c2").collect()}
    assert len(rolled) == 60
    for k in (0, 1):
        own = [r for r in rows if r[1] == f"k{k}"]
        for i, (t, key, _) in enumerate(own):
            last = [x[2] for x in own[max(0, i - 4) : i + 1]]
            assert rolled[key, t] == (len(last), sum(last) / len(last), min(last), max(last))
    again = stream(spark, tmp_path, "b", rows + rows[:10], schema)
    assert event_time.run_available(event_time.deduplicated(again, "ts", ["ts", "k"]), "d", f"{tmp_path}/c3").count() == 60
    q = stream(spark, tmp_path, "q", [(t0, "a"), (t0 + dt.timedelta(seconds=30), "b")], "ts timestamp, k string")
    s = stream(spark, tmp_path, "s", [(t0 + dt.timedelta(seconds=5), "a"), (t0 + dt.timedelta(seconds=90), "b")], "ts timestamp, k string")
    assert [r.k for r in event_time.run_available(event_time.correlated(q, s, "k", "ts", "20 seconds"), "j", f"{tmp_path}/c4").collect()] == ["a"]
    assert event_time.session_windows(batch, "ts", "10 seconds", ["k"]).count() == 60
