"""Protocol decoders: numpy over one channel's samples, applied per channel; bus fields as native columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.functions.checksums import CRC16_MODBUS, CRC16_X25, crc15_can

Frame = dict


def uart(x: np.ndarray, fs: float, baud: float, bits: int = 8, parity: str = "none", stop: int = 1) -> Iterator[Frame]:
    """Start bit, then samples in the middle of each bit; parity and stop errors are reported."""
    per, i = fs / baud, 0
    x = x.astype(bool)
    falls = np.flatnonzero(x[:-1] & ~x[1:]) + 1
    total = 1 + bits + (parity != "none") + stop
    for start in falls:
        if start < i:
            continue
        at = (start + per * (np.arange(total) + 0.5)).astype(int)
        if at[-1] >= len(x) or x[at[0]]:
            continue
        data = x[at[1 : 1 + bits]]
        value, errors = int((data * (1 << np.arange(bits))).sum()), []
        if parity != "none" and (int(data.sum()) + int(x[at[1 + bits]])) % 2 != (parity == "odd"):
            errors.append("parity")
        if not x[at[-stop:]].all():
            errors.append("framing")
        yield {"start": start / fs, "stop": (at[-1] + per / 2) / fs, "value": value, "errors": errors}
        i = at[-1]


def spi(clk: np.ndarray, data: np.ndarray, cs: np.ndarray | None = None, cpol: int = 0, cpha: int = 0, word: int = 8, msb: bool = True) -> list[int]:
    """Words sampled on the edge that mode (cpol, cpha) names; an inactive select drops a partial word."""
    clk, data = clk.astype(bool), data.astype(bool)
    rising = cpol == cpha
    edge = np.flatnonzero((~clk[:-1] & clk[1:]) if rising else (clk[:-1] & ~clk[1:])) + 1
    out, bits, idle = [], [], None if cs is None else np.cumsum(cs.astype(bool))
    last = 0
    for e in edge:
        if idle is not None:
            if idle[e] != idle[last]:
                bits = []
            last = e
            if cs[e]:
                continue
        bits.append(int(data[e]))
        if len(bits) == word:
            seq = bits if msb else bits[::-1]
            out.append(int("".join(map(str, seq)), 2))
            bits = []
    return out


def i2c(scl: np.ndarray, sda: np.ndarray) -> list[Frame]:
    """Transfers: address, direction, data and acknowledgements between start and stop (or restart)."""
    c, d = scl.astype(bool), sda.astype(bool)
    high = c[:-1] & c[1:]
    start, stop = high & d[:-1] & ~d[1:], high & ~d[:-1] & d[1:]
    rise = ~c[:-1] & c[1:]
    out, bits = [], None

    def flush() -> None:
        if bits and len(bits) >= 9:
            frames = [bits[k : k + 9] for k in range(0, len(bits) - 8, 9)]
            values = [int("".join(map(str, f[:8])), 2) for f in frames]
            out.append({"address": values[0] >> 1, "read": bool(values[0] & 1), "data": values[1:], "acks": [f[8] == 0 for f in frames]})

    for k in np.flatnonzero(start | stop | rise):
        if start[k]:
            flush()
            bits = []
        elif stop[k]:
            flush()
            bits = None
        elif bits is not None:
            bits.append(int(d[k + 1]))
    return out


def manchester(x: np.ndarray, per: float, ieee: bool = True) -> list[int]:
    """Bits from the halves of each cell; None of equal halves is kept."""
    n = int(len(x) / per)
    a, b = x[(np.arange(n) * per + per / 4).astype(int)], x[(np.arange(n) * per + 3 * per / 4).astype(int)]
    return [int(q > p) if ieee else int(p > q) for p, q in zip(a, b, strict=True) if p != q]


def unstuff(bits: Sequence[int], run: int) -> list[int]:
    """Drop the bit after ``run`` equal bits."""
    out, last, n, skip = [], None, 0, False
    for b in bits:
        if skip:
            skip, last, n = False, b, 1
            continue
        out.append(b)
        n = n + 1 if b == last else 1
        last = b
        skip = n == run
    return out


def can(x: np.ndarray, fs: float, bitrate: float) -> list[Frame]:
    """CAN 2.0 frames from a bus level (dominant 0), standard and extended ids, CRC-15 checked."""
    per, out, i = fs / bitrate, [], 0
    x = x.astype(int)
    falls = np.flatnonzero((x[:-1] == 1) & (x[1:] == 0)) + 1
    number = lambda b: int("".join(map(str, b)) or "0", 2)
    for s in falls:
        if s < i:
            continue
        at = (s + per * (np.arange(160) + 0.5)).astype(int)
        raw = x[at[at < len(x)]].tolist()
        b = unstuff(raw, 5)
        if len(b) < 34:
            continue
        extended = b[13] == 1
        if extended and len(b) < 54:
            continue
        head = 39 if extended else 19
        ident = number(b[1:12]) << 18 | number(b[14:32]) if extended else number(b[1:12])
        rtr = b[32] if extended else b[12]
        dlc = min(number(b[head - 4 : head]), 8)
        n = 0 if rtr else dlc * 8
        if len(b) < head + n + 15:
            continue
        crc = number(b[head + n : head + n + 15])
        data = bytes(number(b[head + k : head + k + 8]) for k in range(0, n, 8))
        out.append({"start": s / fs, "id": ident, "extended": extended, "data": data, "crc_ok": crc == crc15_can(b[: head + n])})
        i = s + per * (head + n + 15 + 10)
    return out


def can_bits(ident: int, data: bytes, extended: bool = False) -> list[int]:
    """Stuffed bits of a frame, the inverse of :func:`can`."""
    put = lambda v, n: [v >> k & 1 for k in range(n - 1, -1, -1)]
    head = [0, *put(ident >> 18, 11), 1, 1, *put(ident & 0x3FFFF, 18), 0, 0, 0] if extended else [0, *put(ident, 11), 0, 0, 0]
    body = [*head, *put(len(data), 4), *[x for v in data for x in put(v, 8)]]
    body += put(crc15_can(body), 15)
    out, last, n = [], None, 0
    for b in body:
        out.append(b)
        n = n + 1 if b == last else 1
        last = b
        if n == 5:
            out.append(1 - b)
            last, n = 1 - b, 1
    return out + [1, 0, 1] + [1] * 10


def lin_id(pid: int) -> tuple[int, bool]:
    """Frame id and whether the two parity bits of a protected id hold."""
    b = [pid >> k & 1 for k in range(8)]
    return pid & 0x3F, b[6] == b[0] ^ b[1] ^ b[2] ^ b[4] and b[7] == 1 - (b[1] ^ b[3] ^ b[4] ^ b[5])


def lin_checksum(data: bytes, pid: int | None = None) -> int:
    """Classic, or enhanced over the protected id too: inverted sum with carry."""
    total = pid or 0
    for v in data:
        total += v
        if total > 255:
            total -= 255
    return ~total & 0xFF


def hdlc(bits: Sequence[int]) -> list[Frame]:
    """Frames between flags 01111110: zero after five ones dropped, bytes least significant bit first, FCS-16."""
    s = "".join(map(str, bits))
    out = []
    for part in s.split("01111110")[1:-1]:
        raw, n, b = [], 0, []
        for c in part:
            if c == "0" and n == 5:
                n = 0
                continue
            n = n + 1 if c == "1" else 0
            b.append(int(c))
        if len(b) < 24 or len(b) % 8:
            continue
        raw = bytes(sum(v << k for k, v in enumerate(b[i : i + 8])) for i in range(0, len(b), 8))
        out.append({"data": raw[:-2], "fcs_ok": CRC16_X25(raw[:-2]) == int.from_bytes(raw[-2:], "little")})
    return out


def i2s(bck: np.ndarray, ws: np.ndarray, sd: np.ndarray, bits: int = 16) -> list[tuple[int, int]]:
    """Signed (left, right) samples; data begin one clock after the word select changes."""
    edge = np.flatnonzero(~bck[:-1].astype(bool) & bck[1:].astype(bool)) + 1
    w, d = ws[edge].astype(int), sd[edge].astype(int)
    turn = np.flatnonzero(np.diff(w)) + 1
    words = []
    for t in turn:
        part = d[t + 1 : t + 1 + bits]
        if len(part) == bits:
            v = int("".join(map(str, part)), 2)
            words.append((int(w[t]), v - (1 << bits) if v >> (bits - 1) else v))
    left = None
    out = []
    for side, v in words:
        if side == 0:
            left = v
        elif left is not None:
            out.append((left, v))
            left = None
    return out


def jtag_states(tms: Sequence[int]) -> list[str]:
    """TAP controller states after each clock, from Test-Logic-Reset."""
    s, out = "RESET", []
    for b in tms:
        s = TAP[s][b]
        out.append(s)
    return out


#: The IEEE 1149.1 state graph (next state for TMS 0, 1).
TAP = {
    "RESET": ("IDLE", "RESET"), "IDLE": ("IDLE", "SELECT_DR"), "SELECT_DR": ("CAPTURE_DR", "SELECT_IR"), "CAPTURE_DR": ("SHIFT_DR", "EXIT1_DR"),
    "SHIFT_DR": ("SHIFT_DR", "EXIT1_DR"), "EXIT1_DR": ("PAUSE_DR", "UPDATE_DR"), "PAUSE_DR": ("PAUSE_DR", "EXIT2_DR"), "EXIT2_DR": ("SHIFT_DR", "UPDATE_DR"),
    "UPDATE_DR": ("IDLE", "SELECT_DR"), "SELECT_IR": ("CAPTURE_IR", "RESET"), "CAPTURE_IR": ("SHIFT_IR", "EXIT1_IR"), "SHIFT_IR": ("SHIFT_IR", "EXIT1_IR"),
    "EXIT1_IR": ("PAUSE_IR", "UPDATE_IR"), "PAUSE_IR": ("PAUSE_IR", "EXIT2_IR"), "EXIT2_IR": ("SHIFT_IR", "UPDATE_IR"), "UPDATE_IR": ("IDLE", "SELECT_DR"),
}


def onewire(x: np.ndarray, fs: float) -> tuple[int, list[int]]:
    """Resets (low for 480 us or more) and bits (low under 15 us: 1, under 120 us: 0)."""
    x = x.astype(bool)
    fall, rise = np.flatnonzero(x[:-1] & ~x[1:]) + 1, np.flatnonzero(~x[:-1] & x[1:]) + 1
    resets, bits = 0, []
    for f in fall:
        k = np.searchsorted(rise, f)
        if k == len(rise):
            break
        us = (rise[k] - f) / fs * 1e6
        if us >= 480:
            resets += 1
            bits = []
        elif us < 120:
            bits.append(int(us < 15))
    return resets, bits


def nrzi(levels: Sequence[int]) -> list[int]:
    """USB line code: 1 for no change; a stuffed 0 after six ones is dropped."""
    out, n = [], 0
    for a, b in zip(levels[:-1], levels[1:], strict=True):
        bit = int(a == b)
        if n == 6:
            n = 0
            continue
        n = n + 1 if bit else 0
        out.append(bit)
    return out


def modbus_rtu(frame: bytes) -> Frame | None:
    """Address, function, data and whether the CRC holds."""
    if len(frame) < 4:
        return None
    return {"unit": frame[0], "function": frame[1] & 0x7F, "exception": bool(frame[1] & 0x80), "data": frame[2:-2], "crc_ok": CRC16_MODBUS(frame[:-2]) == int.from_bytes(frame[-2:], "little")}


def modbus_tcp(frame: bytes) -> Frame | None:
    if len(frame) < 8 or frame[2:4] != b"\0\0":
        return None
    return {"transaction": int.from_bytes(frame[:2], "big"), "unit": frame[6], "function": frame[7] & 0x7F, "exception": bool(frame[7] & 0x80), "data": frame[8:]}


def decode_uart(df: DataFrame, keys: Sequence[str], index: str, level: str, fs: float, baud: float, **options) -> DataFrame:
    """UART bytes of each channel of digital samples."""
    types = ", ".join(f"`{k}` {t}" for k, t in df.select(*keys).dtypes)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(uart(pdf.sort_values(index)[level].to_numpy(), fs, baud, **options))
        out = pd.DataFrame(rows, columns=["start", "stop", "value", "errors"])
        for i, (k, v) in enumerate(zip(keys, key, strict=True)):
            out.insert(i, k, v)
        return out

    return df.groupBy(*keys).applyInPandas(run, f"{types}, start double, stop double, value int, errors array<string>")


# ---- bus fields as native columns ------------------------------------------------------------


def j1939(ident: Column) -> Column:
    """Priority, PGN, destination (255: all) and source of a 29-bit id."""
    pf, ps = F.shiftright(ident, 16).bitwiseAND(F.lit(0xFF)), F.shiftright(ident, 8).bitwiseAND(F.lit(0xFF))
    page = F.shiftleft(F.shiftright(ident, 24).bitwiseAND(F.lit(1)), 16)
    base = page.bitwiseOR(F.shiftleft(pf, 8))
    return F.struct(
        F.shiftright(ident, 26).bitwiseAND(F.lit(7)).alias("priority"), F.when(pf < 240, base).otherwise(base.bitwiseOR(ps)).alias("pgn"),
        F.when(pf < 240, ps).otherwise(F.lit(255)).alias("destination"), ident.bitwiseAND(F.lit(0xFF)).alias("source"),
    )


def extract_bits(word: Column, start: int, length: int, signed: bool = False) -> Column:
    """Bits start .. start + length - 1 of an integer column (bit 0 least significant)."""
    v = F.shiftrightunsigned(word.cast("long"), start).bitwiseAND(F.lit((1 << length) - 1).cast("long"))
    return F.when(v >= 1 << (length - 1), v - (1 << length)).otherwise(v) if signed else v


def can_signal(data: Column, start: int, length: int, big: bool = False, signed: bool = False, scale: float = 1.0, offset: float = 0.0) -> Column:
    """Physical value of a signal of up to 8 payload bytes. Little endian counts bits from byte 0's lowest;
    big endian ``start`` is the highest bit, counted in each byte from its lowest."""
    hexed = F.rpad(F.hex(data), 16, "0")
    byte = lambda i: F.conv(F.substring(hexed, i * 2 + 1, 2), 16, 10).cast("long")
    value, mask = F.lit(0).cast("long"), (1 << length) - 1
    if big:
        first = start // 8 * 8 + (7 - start % 8)
        places = [(first + k, length - 1 - k) for k in range(length)]
        for i in sorted({p // 8 for p, _ in places}):
            for p, to in places:
                if p // 8 == i:
                    value = value.bitwiseOR(F.shiftleft(F.shiftright(byte(i), 7 - p % 8).bitwiseAND(F.lit(1).cast("long")), to))
    else:
        for i in range(start // 8, (start + length - 1) // 8 + 1):
            move = i * 8 - start
            value = value.bitwiseOR(F.shiftleft(byte(i), move) if move >= 0 else F.shiftrightunsigned(byte(i), -move))
        value = value.bitwiseAND(F.lit(mask).cast("long"))
    if signed:
        value = F.when(value >= 1 << (length - 1), value - (1 << length)).otherwise(value)
    return value * scale + offset


#: OBD-II mode 1 formulas: name, factor of byte A, factor of byte B, offset.
OBD = {
    0x04: ("engine_load", 100 / 255, 0, 0), 0x05: ("coolant_temperature", 1, 0, -40), 0x0A: ("fuel_pressure", 3, 0, 0), 0x0B: ("intake_pressure", 1, 0, 0),
    0x0C: ("engine_rpm", 64, 1 / 4, 0), 0x0D: ("speed", 1, 0, 0), 0x0E: ("timing_advance", 1 / 2, 0, -64), 0x0F: ("intake_temperature", 1, 0, -40),
    0x10: ("maf", 256 / 100, 1 / 100, 0), 0x11: ("throttle", 100 / 255, 0, 0), 0x1F: ("run_time", 256, 1, 0), 0x2F: ("fuel_level", 100 / 255, 0, 0),
    0x42: ("module_voltage", 256 / 1000, 1 / 1000, 0), 0x46: ("ambient_temperature", 1, 0, -40), 0x5C: ("oil_temperature", 1, 0, -40),
}


def obd_value(pid: Column, a: Column, b: Column) -> Column:
    """Name and value of a mode 1 answer; null for unknown ids."""
    name, value = F.lit(None).cast("string"), F.lit(None).cast("double")
    for p, (n, x, y, z) in OBD.items():
        name, value = F.when(pid == p, n).otherwise(name), F.when(pid == p, a * float(x) + b * float(y) + float(z)).otherwise(value)
    return F.struct(name.alias("name"), value.alias("value"))


def tcp_streams(packets: DataFrame, keys: Sequence[str], seq: str, data: str, order: str) -> DataFrame:
    """Reassembled bytes per flow: by sequence relative to the flow's first (modulo 2**32), repeats skipped,
    overlaps trimmed, holes filled with zeros and listed."""
    from tidewire.operators.messages import joined

    flow, arrival = W.partitionBy(*keys), F.col(order).asc_nulls_last()
    rows = packets.select(*dict.fromkeys([*keys, order, seq, data]))
    since = F.col(seq).cast("long") - F.first(seq).over(flow.orderBy(arrival)).cast("long")
    rows = rows.withColumn("_rel", F.pmod(since + (1 << 31), F.lit(1 << 32)) - (1 << 31))
    by = flow.orderBy("_rel", arrival)
    rows = rows.withColumn("_r", F.col("_rel") - F.first("_rel").over(by))
    # How far the segments before reach; of segments that start with the same reach only the last adds bytes.
    reach = F.max(F.col("_r") + F.length(data)).over(by.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_upto", F.coalesce(reach, F.lit(0).cast("long")))
    r, upto = F.col("_r"), F.col("_upto")
    hole = F.greatest(r - upto, F.lit(0))
    skip = F.least(F.greatest(upto - r, F.lit(0)), F.length(data)).cast("int")
    rows = rows.withColumns({"_hole": hole, "_new": F.substring(data, skip + 1, F.length(data) - skip)})
    gap = F.when(F.col("_hole") > 0, F.struct("_upto", F.concat(upto.cast("string"), F.lit("-"), r.cast("string")).alias("gap")))
    gaps = F.transform(F.sort_array(F.collect_list(gap)), lambda g: g.gap)
    part = F.concat(F.unhex(F.repeat(F.lit("00"), F.col("_hole").cast("int"))), "_new")
    return rows.groupBy(*keys).agg(
        joined(upto, part).alias("stream"), F.count_if(F.col("_hole") > 0).cast("int").alias("n_gaps"), gaps.alias("gaps"),
        F.count_if(F.length("_new") == 0).cast("int").alias("retransmits"),
    )


# ---- decoders over traces held as arrays -----------------------------------------------------
# A row is one capture: the levels of each line are an array column, so decoding needs no shuffle.
# ``sampled`` makes such rows of samples that are rows.

#: Payload sizes of the CAN FD length code.
FD_SIZES = (0, 1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 20, 24, 32, 48, 64)


def sampled(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per capture with each value column as an array, in order."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *values))).alias("_s"))
    return rows.select(*keys, *[F.col("_s")[v].alias(v) for v in values])


def can_fd(bits: np.ndarray) -> Frame | None:
    """Id, bit-rate switch and data of the unstuffed fields of a base-format frame."""
    b = np.asarray(bits).astype(int).tolist()
    if len(b) < 22 or b[0] != 0 or b[14] != 1:
        return None
    number = lambda x: int("".join(map(str, x)) or "0", 2)
    size = FD_SIZES[number(b[18:22])]
    if len(b) < 22 + 8 * size:
        return None
    return {"id": number(b[1:12]), "brs": bool(b[16]), "size": size, "data": bytes(number(b[22 + 8 * k : 30 + 8 * k]) for k in range(size))}


def swd(bits: np.ndarray) -> Iterator[Frame]:
    """Transfers of a serial wire line: request with parity, acknowledge, data with parity."""
    b, at = np.asarray(bits).astype(int).tolist(), 0
    number = lambda x: sum(v << k for k, v in enumerate(x))
    while at + 46 <= len(b):
        head = b[at : at + 8]
        if head[0] != 1 or head[6] != 0 or head[7] != 1 or sum(head[1:5]) % 2 != head[5]:
            at += 1
            continue
        read, ack = bool(head[2]), number(b[at + 9 : at + 12])
        start = at + 12 + (not read)
        data, parity = b[start : start + 32], b[start + 32]
        yield {"port": "AP" if head[1] else "DP", "read": read, "address": head[3] << 2 | head[4] << 3, "ack": ack, "value": number(data), "parity_ok": sum(data) % 2 == parity}
        at = start + 33 + read


def lin_frames(data: bytes) -> Frame | None:
    """Id, data and the checks of a frame of bytes after the break: sync, protected id, data, checksum."""
    if len(data) < 4 or data[0] != 0x55:
        return None
    ident, parity = lin_id(data[1])
    return {"id": ident, "parity_ok": parity, "data": data[2:-1], "checksum_ok": data[-1] in (lin_checksum(data[2:-1], data[1]), lin_checksum(data[2:-1]))}


def flexray_header(bits: np.ndarray) -> Frame | None:
    """Indicators, frame id, payload words, header CRC and cycle of the five header bytes."""
    b = np.asarray(bits).astype(int).tolist()
    if len(b) < 40:
        return None
    number = lambda x: int("".join(map(str, x)), 2)
    return {"sync": bool(b[3]), "startup": bool(b[4]), "id": number(b[5:16]), "words": number(b[16:23]), "crc": number(b[23:34]), "cycle": number(b[34:40])}


def decode(df: DataFrame, keys: Sequence[str], protocol: str, lines: Sequence[str], **options) -> DataFrame:
    """Frames of each capture, in order: ``protocol`` names the decoder, ``lines`` its array columns.

    uart (level; fs, baud), spi (clock, data[, select]), i2c (clock, data), can (level; fs, bitrate),
    can_fd (bits), lin (binary), hdlc (bits), i2s (bit clock, word select, data), jtag (TMS), swd (bits),
    manchester (level; per), onewire (level; fs), usb (levels), flexray (bits)."""
    from tidewire.operators.messages import records

    f, schema = DECODERS[protocol]
    number = lambda rows: ({"frame": i, **r} for i, r in enumerate(rows))
    return records(df, keys, lines, lambda *x: number(f(*x, **options)), f"frame int, {schema}")


def _maybe(f):
    return lambda *x: [] if (r := f(*x)) is None else [r]


#: Decoder of each protocol, as rows, and the columns that it gives.
DECODERS = {
    "uart": (lambda x, **o: uart(x, **o), "start double, stop double, value int, errors array<string>"),
    "spi": (lambda *x, **o: ({"word": w} for w in spi(*x, **o)), "word long"),
    "i2c": (lambda c, d: i2c(c, d), "address int, read boolean, data array<int>, acks array<boolean>"),
    "can": (lambda x, **o: can(x, **o), "start double, id long, extended boolean, data binary, crc_ok boolean"),
    "can_fd": (_maybe(can_fd), "id long, brs boolean, size int, data binary"),
    "lin": (_maybe(lin_frames), "id int, parity_ok boolean, data binary, checksum_ok boolean"),
    "hdlc": (lambda x: hdlc(x.astype(int).tolist()), "data binary, fcs_ok boolean"),
    "i2s": (lambda *x, **o: ({"left": a, "right": b} for a, b in i2s(*x, **o)), "`left` int, `right` int"),
    "jtag": (lambda x: ({"state": s} for s in jtag_states(x.astype(int).tolist())), "state string"),
    "swd": (swd, "port string, read boolean, address int, ack int, value long, parity_ok boolean"),
    "manchester": (lambda x, **o: ({"bit": b} for b in manchester(x, **o)), "bit int"),
    "onewire": (lambda x, **o: [{"resets": (r := onewire(x, **o))[0], "bits": r[1]}], "resets int, bits array<int>"),
    "usb": (lambda x: ({"bit": b} for b in nrzi(x.astype(int).tolist())), "bit int"),
    "flexray": (_maybe(flexray_header), "sync boolean, startup boolean, id int, words int, crc int, cycle int"),
}
