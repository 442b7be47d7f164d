"""Parsers of application protocols over bytes: each returns a dict, or None where the bytes are not that protocol."""

from __future__ import annotations

import struct
from collections.abc import Iterator

#: Names of the public standards' codes.
MQTT_TYPES = ("reserved", "connect", "connack", "publish", "puback", "pubrec", "pubrel", "pubcomp", "subscribe", "suback", "unsubscribe", "unsuback", "pingreq", "pingresp", "disconnect", "auth")
COAP_TYPES = ("CON", "NON", "ACK", "RST")
COAP_METHODS = {1: "GET", 2: "POST", 3: "PUT", 4: "DELETE"}
COAP_OPTIONS = {1: "if_match", 3: "uri_host", 4: "etag", 6: "observe", 7: "uri_port", 8: "location_path", 11: "uri_path", 12: "content_format", 14: "max_age", 15: "uri_query", 17: "accept"}
UDS_SERVICES = {
    0x10: "session_control", 0x11: "ecu_reset", 0x14: "clear_diagnostics", 0x19: "read_dtc", 0x22: "read_data", 0x23: "read_memory", 0x27: "security_access", 0x28: "communication_control",
    0x2E: "write_data", 0x2F: "io_control", 0x31: "routine_control", 0x34: "request_download", 0x36: "transfer_data", 0x37: "transfer_exit", 0x3E: "tester_present", 0x85: "control_dtc",
}
UDS_ERRORS = {0x10: "general_reject", 0x11: "service_not_supported", 0x12: "subfunction_not_supported", 0x13: "incorrect_length", 0x22: "conditions_not_correct", 0x31: "out_of_range", 0x33: "access_denied", 0x35: "invalid_key", 0x78: "pending"}
LORA_TYPES = ("join_request", "join_accept", "unconfirmed_up", "unconfirmed_down", "confirmed_up", "confirmed_down", "rejoin", "proprietary")
ETHERCAT_COMMANDS = ("NOP", "APRD", "APWR", "APRW", "FPRD", "FPWR", "FPRW", "BRD", "BWR", "BRW", "LRD", "LWR", "LRW", "ARMW", "FRMW")


def mqtt(data: bytes) -> dict | None:
    """Type, flags, remaining length; topic, packet id and payload of a publish."""
    if len(data) < 2:
        return None
    size = shift = 0
    at = 1
    while True:
        if at >= len(data) or shift > 21:
            return None
        b = data[at]
        size |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if not b & 0x80:
            break
    if len(data) < at + size:
        return None
    kind, flags, body = data[0] >> 4, data[0] & 15, data[at : at + size]
    out = {"type": MQTT_TYPES[kind], "flags": flags, "length": size, "consumed": at + size}
    if kind == 3 and size >= 2:
        n = int.from_bytes(body[:2], "big")
        qos, rest = flags >> 1 & 3, body[2 + n :]
        out |= {"topic": body[2 : 2 + n].decode("utf-8", "replace"), "qos": qos, "retain": bool(flags & 1), "packet_id": int.from_bytes(rest[:2], "big") if qos else None, "payload": rest[2:] if qos else rest}
    return out


def mqtt_stream(data: bytes) -> Iterator[dict]:
    while (m := mqtt(data)) is not None:
        yield m
        data = data[m["consumed"] :]


def topic_matches(pattern: str, topic: str) -> bool:
    """Subscription patterns: ``+`` is one level, a last ``#`` any number of levels."""
    p, t = pattern.split("/"), topic.split("/")
    for i, x in enumerate(p):
        if x == "#":
            return i == len(p) - 1
        if i >= len(t) or x not in ("+", t[i]):
            return False
    return len(p) == len(t)


def coap(data: bytes) -> dict | None:
    """Type, code, message id, token, options and payload."""
    if len(data) < 4 or data[0] >> 6 != 1:
        return None
    n, code = data[0] & 15, data[1]
    if n > 8 or len(data) < 4 + n:
        return None
    out = {"type": COAP_TYPES[data[0] >> 4 & 3], "code": f"{code >> 5}.{code & 31:02d}", "method": COAP_METHODS.get(code), "id": int.from_bytes(data[2:4], "big"), "token": data[4 : 4 + n], "options": [], "payload": b""}
    at, number = 4 + n, 0
    while at < len(data):
        if data[at] == 0xFF:
            out["payload"] = data[at + 1 :]
            break
        d, s = data[at] >> 4, data[at] & 15
        at += 1
        values = []
        for v in (d, s):
            extra = {13: 1, 14: 2}.get(v, 0)
            values.append(v + (int.from_bytes(data[at : at + extra], "big") + (0 if extra == 1 else 255) if extra else 0))
            at += extra
        number += values[0]
        out["options"].append((COAP_OPTIONS.get(number, number), data[at : at + values[1]]))
        at += values[1]
    return out


def uds(data: bytes) -> dict | None:
    """Service, direction and negative response code."""
    if not data:
        return None
    if data[0] == 0x7F and len(data) >= 3:
        return {"service": UDS_SERVICES.get(data[1], hex(data[1])), "response": True, "positive": False, "error": UDS_ERRORS.get(data[2], hex(data[2])), "data": data[3:]}
    response = bool(data[0] & 0x40)
    sid = data[0] & 0xBF
    if sid not in UDS_SERVICES:
        return None
    return {"service": UDS_SERVICES[sid], "response": response, "positive": response, "error": None, "data": data[1:]}


def iso_tp(frames: list[bytes]) -> list[bytes]:
    """Messages of ISO 15765-2 frames: single, first and consecutive; a wrong number drops the message."""
    out, held, size, nxt = [], None, 0, 0
    for f in frames:
        kind = f[0] >> 4
        if kind == 0:
            out.append(f[1 : 1 + (f[0] & 15)])
            held = None
        elif kind == 1:
            size, held, nxt = (f[0] & 15) << 8 | f[1], f[2:], 1
        elif kind == 2 and held is not None:
            if f[0] & 15 != nxt:
                held = None
                continue
            held, nxt = held + f[1:], (nxt + 1) % 16
            if len(held) >= size:
                out.append(held[:size])
                held = None
    return out


def lorawan(data: bytes) -> dict | None:
    """Message type, device address, counter, port, encrypted payload and integrity code."""
    if len(data) < 12:
        return None
    out = {"type": LORA_TYPES[data[0] >> 5], "major": data[0] & 3, "mic": data[-4:]}
    if 2 <= data[0] >> 5 <= 5:
        n = data[5] & 15
        rest = data[8 + n : -4]
        out |= {"address": data[4:0:-1].hex(), "adr": bool(data[5] & 0x80), "ack": bool(data[5] & 0x20), "counter": int.from_bytes(data[6:8], "little"), "options": data[8 : 8 + n], "port": rest[0] if rest else None, "payload": rest[1:]}
    return out


def bacnet(data: bytes) -> dict | None:
    """BACnet/IP: BVLC function, network control and the application message."""
    if len(data) < 6 or data[0] != 0x81 or int.from_bytes(data[2:4], "big") > len(data):
        return None
    control, at = data[5], 6
    if control & 0x20:
        at += 3 + data[at + 2]
    if control & 0x08:
        at += 3 + data[at + 2]
    at += bool(control & 0x20)
    return {"function": data[1], "version": data[4], "control": control, "apdu_type": data[at] >> 4 if at < len(data) else None, "apdu": data[at:]}


def ethercat(data: bytes) -> list[dict]:
    """Datagrams of an EtherCAT frame (after the Ethernet header)."""
    if len(data) < 2 or data[1] >> 4 != 1:
        return []
    out, at = [], 2
    while at + 12 <= len(data):
        command, index, address, info, irq = struct.unpack_from("<BBIHH", data, at)
        n = info & 0x7FF
        body = data[at + 10 : at + 10 + n]
        if len(data) < at + 12 + n:
            break
        out.append({"command": ETHERCAT_COMMANDS[command] if command < len(ETHERCAT_COMMANDS) else str(command), "index": index, "address": address, "irq": irq, "data": body, "counter": int.from_bytes(data[at + 10 + n : at + 12 + n], "little")})
        at += 12 + n
        if not info & 0x8000:
            break
    return out


def opcua(data: bytes) -> dict | None:
    """Message type, chunk, size and secure channel of OPC UA binary."""
    if len(data) < 8 or data[:3] not in (b"HEL", b"ACK", b"ERR", b"OPN", b"CLO", b"MSG") or data[3:4] not in b"FCA":
        return None
    size = int.from_bytes(data[4:8], "little")
    channel = int.from_bytes(data[8:12], "little") if data[:3] in (b"OPN", b"CLO", b"MSG") and len(data) >= 12 else None
    return {"type": data[:3].decode(), "chunk": data[3:4].decode(), "size": size, "complete": len(data) >= size, "channel": channel}


def ble_advertisement(data: bytes) -> dict:
    """Structures of advertising data: flags, names, services and the rest by type."""
    out: dict = {"services": [], "other": {}}
    at = 0
    while at < len(data) and data[at]:
        n, kind = data[at], data[at + 1] if at + 1 < len(data) else 0
        v = data[at + 2 : at + 1 + n]
        if kind == 1:
            out["flags"] = v[0] if v else 0
        elif kind in (8, 9):
            out["name"] = v.decode("utf-8", "replace")
        elif kind in (2, 3):
            out["services"] += [f"{int.from_bytes(v[i : i + 2], 'little'):04x}" for i in range(0, len(v) - 1, 2)]
        elif kind == 0xFF:
            out["manufacturer"], out["manufacturer_data"] = int.from_bytes(v[:2], "little"), v[2:]
        else:
            out["other"][kind] = v
        at += n + 1
    return out


def uuid_text(data: bytes) -> str:
    h = data.hex()
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"
