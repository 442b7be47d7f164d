import struct

from tidewire.functions import network as N


def test_mqtt():
    body = b"\x00\x03a/b" + b"\x00\x07" + b"hello"
    raw = bytes([0x33, len(body)]) + body + b"\xc0\x00"
    a, b = N.mqtt_stream(raw)
    assert (a["type"], a["topic"], a["qos"], a["retain"], a["packet_id"], a["payload"]) == ("publish", "a/b", 1, True, 7, b"hello")
    assert b["type"] == "pingreq" and N.mqtt(b"\x30") is None and N.mqtt(b"\x30\xff\xff\xff\xff\xff") is None
    big = bytes([0x30, 0x80 | 0x48, 0x01]) + b"\x00\x01t" + b"x" * 197
    assert N.mqtt(big)["length"] == 200
    assert N.topic_matches("a/+/c", "a/b/c") and N.topic_matches("a/#", "a/b/c") and not N.topic_matches("a/+", "a/b/c") and not N.topic_matches("a/b/c", "a/b")


def test_coap():
    raw = bytes([0x42, 0x01, 0x12, 0x34, 0xAA, 0xBB, 0xB4]) + b"temp" + bytes([0x0D, 0x02]) + b"x" * 15 + b"\xffdata"
    m = N.coap(raw)
    assert (m["type"], m["method"], m["id"], m["token"], m["payload"]) == ("CON", "GET", 0x1234, b"\xaa\xbb", b"data")
    assert m["options"] == [("uri_path", b"temp"), ("uri_path", b"x" * 15)]
    assert N.coap(b"\x00\x00\x00\x00") is None


def test_diagnostics():
    assert N.uds(b"\x22\xf1\x90")["service"] == "read_data" and N.uds(b"\x62\xf1\x90")["positive"]
    assert N.uds(b"\x7f\x27\x35")["error"] == "invalid_key" and N.uds(b"") is None
    long_ = bytes(range(20))
    frames = [bytes([0x10, 20]) + long_[:6], bytes([0x21]) + long_[6:13], bytes([0x22]) + long_[13:20], bytes([0x03, 1, 2, 3, 0, 0])]
    assert N.iso_tp(frames) == [long_, b"\x01\x02\x03"] and N.iso_tp([frames[0], frames[2]]) == []


def test_field_buses_and_radio():
    lora = bytes([0x40, 0x04, 0x03, 0x02, 0x01, 0x80, 0x05, 0x00, 0x0A, 0xEE, 0xFF, 1, 2, 3, 4])
    m = N.lorawan(lora)
    assert (m["type"], m["address"], m["adr"], m["counter"], m["port"], m["payload"], m["mic"]) == ("unconfirmed_up", "01020304", True, 5, 10, b"\xee\xff", b"\1\2\3\4")
    b = N.bacnet(bytes([0x81, 0x0A, 0, 8, 1, 0, 0x10, 0x08]))
    assert b["function"] == 10 and b["apdu_type"] == 1 and N.bacnet(b"\x00" * 8) is None
    one = struct.pack("<BBIHH", 4, 9, 0x10001, 2 | 0x8000, 0) + b"\xab\xcd" + b"\x01\x00"
    two = struct.pack("<BBIHH", 12, 10, 5, 1, 0) + b"\xee" + b"\x03\x00"
    e = N.ethercat(struct.pack("<H", len(one + two) | 0x1000) + one + two)
    assert [(d["command"], d["data"], d["counter"]) for d in e] == [("FPRD", b"\xab\xcd", 1), ("LRW", b"\xee", 3)]
    o = N.opcua(b"MSGF" + struct.pack("<II", 16, 77) + b"abcd")
    assert (o["type"], o["size"], o["complete"], o["channel"]) == ("MSG", 16, True, 77) and N.opcua(b"GET / HTTP/1.1") is None
    adv = N.ble_advertisement(bytes([2, 1, 6, 5, 9]) + b"Demo" + bytes([3, 3, 0x0F, 0x18, 4, 0xFF, 0x4C, 0, 7]))
    assert (adv["flags"], adv["name"], adv["services"], adv["manufacturer"], adv["manufacturer_data"]) == (6, "Demo", ["180f"], 0x4C, b"\x07")
    assert N.uuid_text(bytes(range(16))) == "00010203-0405-0607-0809-0a0b0c0d0e0f"
