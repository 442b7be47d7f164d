import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewire.functions import checksums as C
from tidewire.operators import messages
from tidewire.operators import protocols as P


def uart_wave(data, per, parity="none"):
    out = [1] * int(per * 3)
    for v in data:
        bits = [v >> k & 1 for k in range(8)]
        bits = [0, *bits, *([sum(bits) % 2] if parity == "even" else [1 - sum(bits) % 2] if parity == "odd" else []), 1]
        out += [b for b in bits for _ in range(int(per))]
    return np.array(out + [1] * int(per * 3))


@settings(deadline=None, max_examples=40)
@given(st.binary(min_size=1, max_size=20), st.sampled_from(["none", "even", "odd"]))
def test_uart_round_trip(data, parity):
    got = list(P.uart(uart_wave(data, 10, parity), 10.0, 1.0, parity=parity))
    assert bytes(f["value"] for f in got) == data and not any(f["errors"] for f in got)


def test_uart_errors_and_spark(spark):
    x = uart_wave(b"A", 10)
    x[30 + 90 : 30 + 100] = 0
    assert list(P.uart(x, 10.0, 1.0))[0]["errors"] == ["framing"]
    rows = [("c", i, int(v)) for i, v in enumerate(uart_wave(b"hello", 10))]
    df = spark.createDataFrame(rows, "ch string, idx long, v int")
    got = P.decode_uart(df, ["ch"], "idx", "v", 10.0, 1.0).orderBy("start").collect()
    assert bytes(r.value for r in got) == b"hello"


@pytest.mark.parametrize("cpol,cpha", [(0, 0), (0, 1), (1, 0), (1, 1)])
def test_spi(cpol, cpha):
    clk, data, cs = [cpol] * 4, [0] * 4, [1] * 4
    for v in b"\xa5\x3c":
        for k in range(7, -1, -1):
            b = v >> k & 1
            clk += [cpol, cpol, 1 - cpol, 1 - cpol] if cpha == 0 else [1 - cpol, 1 - cpol, cpol, cpol]
            data += [b] * 4
            cs += [0] * 4
    assert P.spi(np.array(clk + [cpol] * 2), np.array(data + [0] * 2), np.array(cs + [1] * 2), cpol, cpha) == [0xA5, 0x3C]


def test_i2c():
    scl, sda = [1, 1, 1], [1, 1, 0]
    for v, ack in ((0x50 << 1, 0), (0xAB, 0), (0xCD, 1)):
        for b in [*[v >> k & 1 for k in range(7, -1, -1)], ack]:
            scl += [0, 0, 1, 1, 0]
            sda += [sda[-1], b, b, b, b]
    scl += [0, 1, 1]
    sda += [0, 0, 1]
    assert P.i2c(np.array(scl), np.array(sda)) == [{"address": 0x50, "read": False, "data": [0xAB, 0xCD], "acks": [True, True, False]}]


@settings(deadline=None, max_examples=60)
@given(st.integers(0, 0x7FF), st.binary(max_size=8))
def test_can_round_trip(ident, data):
    x = np.repeat([1] * 12 + P.can_bits(ident, data), 4)
    got = P.can(x, 4.0, 1.0)
    assert [(f["id"], f["extended"], f["data"], f["crc_ok"]) for f in got] == [(ident, False, data, True)]


def test_can_extended():
    x = np.repeat([1] * 12 + P.can_bits(0x18FEF100, b"\x01\x02", True), 4)
    assert [(f["id"], f["extended"], f["data"], f["crc_ok"]) for f in P.can(x, 4.0, 1.0)] == [(0x18FEF100, True, b"\x01\x02", True)]


def test_line_codes_and_frames():
    bits = [1, 0, 0, 1, 1]
    assert P.manchester(np.repeat([x for b in bits for x in ((0, 1) if b else (1, 0))], 4), 8) == bits
    body = b"\x01\x7e\xff\x00"
    body += C.CRC16_X25(body).to_bytes(2, "little")
    raw, n, s = [v >> k & 1 for v in body for k in range(8)], 0, ""
    for b in raw:
        s += str(b)
        n = n + 1 if b else 0
        if n == 5:
            s, n = s + "0", 0
    assert P.hdlc([int(c) for c in "01111110" + s + "01111110"]) == [{"data": body[:-2], "fcs_ok": True}]
    assert P.nrzi([1, 1, 0, 0, 1]) == [1, 0, 1, 0]
    assert P.jtag_states([1, 1, 1, 1, 1, 0, 1, 0, 0])[-3:] == ["SELECT_DR", "CAPTURE_DR", "SHIFT_DR"]
    assert P.lin_id(0x80) == (0, True) and P.lin_checksum(b"\x55\x93\xe5", 0x4A) == 0xE6
    m = bytes([1, 3, 0, 0, 0, 10])
    assert P.modbus_rtu(m + C.CRC16_MODBUS(m).to_bytes(2, "little"))["crc_ok"]
    assert P.modbus_tcp(bytes([0, 1, 0, 0, 0, 6, 1, 0x83, 2]))["exception"]
    low = lambda us: [0] * us + [1] * 70
    assert P.onewire(np.array([1] * 5 + low(500) + low(6) + low(60)), 1e6) == (1, [1, 0])


def test_i2s():
    bck, ws, sd = [], [], []
    stream = [(0, 0x1234), (1, 0x8000), (0, 0x0001), (1, 0xFFFF), (0, 0)]
    prev = [(1, 0)]
    bits = [(s, v >> k & 1) for s, v in stream for k in range(15, -1, -1)]
    for i, (side, _) in enumerate(bits):
        b = (prev + bits)[i][1]
        bck += [0, 1]
        ws += [side] * 2
        sd += [b] * 2
    got = P.i2s(np.array([1, *bck]), np.array([1, *ws]), np.array([0, *sd]))
    assert got[-1] == (1, -1)


@given(st.binary(max_size=40))
def test_checksums(data):
    assert C.CRC32(data) == zlib.crc32(data)
    assert C.CRC16_XMODEM(data) == __import__("binascii").crc_hqx(data, 0)


def test_check_values_and_identification(spark):
    text = b"123456789"
    assert [C.CRC8(text), C.CRC8_MAXIM(text), C.CRC16_CCITT(text), C.CRC16_X25(text), C.CRC16_IBM(text), C.CRC16_MODBUS(text)] == [0xF4, 0xA1, 0x29B1, 0x906E, 0xBB3D, 0x4B37]
    rows = [bytes([i, i * 3 % 256, 7, i ^ 0x55]) for i in range(20)]
    assert C.identify([r + C.CRC16_CCITT(r).to_bytes(2, "big") for r in rows]) == {"algorithm": "crc16_ccitt", "match_rate": 1.0}
    found = C.recover_crc([(r, C.CRC16_MODBUS(r)) for r in rows])
    assert found and all(found(r) == C.CRC16_MODBUS(r) for r in rows) and found.poly == 0x8005
    df = spark.createDataFrame([(bytearray(text),), (None,)], "d binary")
    got = df.select(C.checksum(F.col("d"), "crc16_modbus").alias("m"), C.checksum(F.col("d"), "crc32").alias("c")).collect()
    assert [(r.m, r.c) for r in got] == [(0x4B37, zlib.crc32(text)), (None, None)]


def test_bus_columns(spark):
    df = spark.createDataFrame([(0x18FEF100, bytearray(b"\x12\x34\xff\xfe\x00\x00\x00\x80"))], "id long, d binary")
    r = df.select(P.j1939(F.col("id")).alias("j"), P.can_signal(F.col("d"), 0, 16).alias("le"), P.can_signal(F.col("d"), 7, 16, big=True).alias("be"), P.can_signal(F.col("d"), 16, 16, signed=True, scale=0.5, offset=1).alias("s"), P.can_signal(F.col("d"), 56, 8).alias("top")).first()
    assert (r.j.priority, r.j.pgn, r.j.destination, r.j.source) == (6, 0xFEF1, 255, 0)
    assert (r.le, r.be, r.s, r.top) == (0x3412, 0x1234, (0xFEFF - 0x10000) * 0.5 + 1, 0x80)
    o = spark.range(1).select(P.obd_value(F.lit(0x0C), F.lit(0x1A), F.lit(0xF8)).alias("o")).first().o
    assert (o.name, o.value) == ("engine_rpm", 1726.0)


def test_tcp_reassembly(spark):
    base = (1 << 32) - 3
    parts = [(0, b"abc"), (3, b"def"), (3, b"def"), (5, b"fgh"), (10, b"kl")]
    rows = [("f", i, (base + o) % (1 << 32), bytearray(d)) for i, (o, d) in enumerate(parts)]
    df = spark.createDataFrame(rows, "flow string, n int, seq long, data binary").repartition(2)
    r = P.tcp_streams(df, ["flow"], "seq", "data", "n").first()
    assert bytes(r.stream) == b"abcdefgh\0\0kl" and r.gaps == ["8-10"] and r.retransmits == 1


def test_streams_equal_plain_reassembly_without_python(spark):
    """Flows with repeats, overlaps, holes, empty parts, wrapped numbers and null keys; no flow goes through Python."""
    rng, rows = np.random.default_rng(2), []
    for k in [None, *range(40)]:
        at = (1 << 32) - 20 if k and k % 2 else 1000
        for n in range(int(rng.integers(1, 25))):
            at += int(rng.integers(-6, 9))
            rows.append((k, int(rng.integers(0, 1 << 40)) * 32 + n, at % (1 << 32), bytes(rng.integers(0, 256, rng.integers(0, 7)).astype(np.uint8))))
    df = spark.createDataFrame(rows, "k int, n long, seq long, data binary").repartition(3)
    want_tcp, want_udp = {}, {}
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: r[1])
        rel = [(s - own[0][2] + (1 << 31)) % (1 << 32) - (1 << 31) for _, _, s, _ in own]
        out, gaps, again = bytearray(), [], 0
        for r, d in sorted(((r - min(rel), x[3]) for r, x in zip(rel, own, strict=True)), key=lambda p: p[0]):
            if r > len(out):
                gaps.append(f"{len(out)}-{r}")
                out.extend(bytes(r - len(out)))
            new = d[max(0, len(out) - r) :]
            again += not len(new)
            out.extend(new)
        want_tcp[k] = (bytes(out), len(gaps), gaps, again)
        ranked = sorted(own, key=lambda r: r[2])
        late = sum(i > 0 and own[i][2] < max(r[2] for r in own[:i]) for i in range(len(own)))
        want_udp[k] = (b"".join(r[3] for r in ranked), len(own), late, [f"{a[2] + 1}-{b[2] - 1}" for a, b in zip(ranked[:-1], ranked[1:], strict=True) if b[2] > a[2] + 1])
    tcp, udp = P.tcp_streams(df, ["k"], "seq", "data", "n"), messages.udp_streams(df, ["k"], ["n"], "seq", "data")
    assert {r.k: (bytes(r.stream), r.n_gaps, r.gaps, r.retransmits) for r in tcp.collect()} == want_tcp
    assert {r.k: (bytes(r.stream), r.segments, r.out_of_order, r.gaps) for r in udp.collect()} == want_udp
    assert any(g[3] for g in want_tcp.values()) and any(g[3] for g in want_udp.values())
    assert not any("Pandas" in d._jdf.queryExecution().toString() for d in (tcp, udp))
