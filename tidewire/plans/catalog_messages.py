"""Round trips: columns of the driver tables are put into messages or line levels, decoded, and compared with the columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions import checksums, waveforms
from tidewire.operators import messages, protocols
from tidewire.plans.catalog import events, query, rounded, table


def be(c: Column, n: int) -> Column:
    """An integer column as ``n`` big-endian bytes."""
    return F.unhex(F.lpad(F.hex(c.cast("long")), 2 * n, "0"))


def le(c: Column, n: int) -> Column:
    parts = [F.shiftrightunsigned(c.cast("long"), 8 * k).bitwiseAND(F.lit(255)) for k in range(n)]
    return F.concat(*[be(p, 1) for p in parts])


def raw(c: str | Column) -> Column:
    return F.encode(F.col(c) if isinstance(c, str) else c, "UTF-8")


def hexed(h: str) -> Column:
    return F.unhex(F.lit(h))


def text(c: str) -> Column:
    return F.decode(F.col(c), "UTF-8")


# ---- application protocols -------------------------------------------------------------------


@query("SELECT conv_id, turn, role AS topic, 1 AS qos, turn::INT AS packet_id, text AS payload FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL")
def mqtt_publications(spark, sf_dir):
    body = F.concat(be(F.octet_length("role"), 2), raw("role"), be(F.col("turn"), 2), raw("text"))
    c = table(spark, sf_dir, "conversations").filter("role is not null and text is not null").withColumn("_body", body).withColumn("_n", F.length("_body"))
    digit = lambda k: be(F.shiftright("_n", 7 * k).bitwiseAND(F.lit(127)) + F.when(F.col("_n") >= 1 << 7 * (k + 1), 128).otherwise(0), 1)
    size = F.concat(digit(0), *[F.when(F.col("_n") >= 1 << 7 * k, digit(k)).otherwise(hexed("")) for k in (1, 2, 3)])
    m = messages.mqtt_packets(c.withColumn("data", F.concat(hexed("32"), size, F.col("_body"))), ["conv_id", "turn"], "data")
    return m.filter("type = 'publish'").select("conv_id", "turn", "topic", "qos", "packet_id", text("payload").alias("payload"))


@query("SELECT c_custkey, 'GET' AS method, c_custkey::INT % 65536 AS id, c_name AS path, c_mktsegment AS payload FROM customer")
def coap_requests(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    option = F.concat(hexed("BD"), be(F.octet_length("c_name") - 13, 1), raw("c_name"))
    data = F.concat(hexed("4001"), be(F.col("c_custkey") % 65536, 2), option, hexed("FF"), raw("c_mktsegment"))
    m = messages.coap_messages(c.withColumn("data", data), ["c_custkey"], "data")
    return m.select("c_custkey", "method", "id", F.decode(F.col("options")[0]["value"], "UTF-8").alias("path"), text("payload").alias("payload"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN 'security_access' ELSE 'read_data' END AS service, o_orderkey % 3 > 0 AS response, o_orderkey % 3 = 1 AS positive,
 CASE WHEN o_orderkey % 3 = 2 THEN 'invalid_key' END AS error, lpad(lower(hex(o_custkey)), 8, '0') AS data FROM orders""")
def uds_services(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    head = F.when(k == 0, hexed("22")).when(k == 1, hexed("62")).otherwise(hexed("7F2735"))
    o = table(spark, sf_dir, "orders").withColumn("data", F.concat(head, be(F.col("o_custkey"), 4)))
    m = messages.uds_messages(o, ["o_orderkey"], "data")
    return m.select("o_orderkey", "service", "response", "positive", "error", F.lower(F.hex("data")).alias("data"))


@query("SELECT conv_id, turn, role || ': ' || text AS message FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL")
def iso_tp_transfers(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("role is not null and text is not null").withColumn("m", raw(F.concat("role", F.lit(": "), "text")))
    frames = messages.records(c, ["conv_id", "turn"], ["m"], lambda m: ({"frame": i, "data": x} for i, x in enumerate(waveforms.iso_tp_frames(m))), "frame int, data binary")
    return messages.iso_tp_messages(frames, ["conv_id", "turn"], ["frame"], "data").select("conv_id", "turn", text("message").alias("message"))


@query("""SELECT s_suppkey, 'unconfirmed_up' AS type, lpad(lower(hex(s_suppkey)), 8, '0') AS address, true AS adr, (s_suppkey % 65536)::INT AS counter, 1 AS port, s_name AS payload FROM supplier""")
def lorawan_uplinks(spark, sf_dir):
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").withColumn("data", F.concat(hexed("40"), le(k, 4), hexed("80"), le(k % 65536, 2), hexed("01"), raw("s_name"), hexed("00000000")))
    return messages.lorawan_frames(s, ["s_suppkey"], "data").select("s_suppkey", "type", "address", "adr", "counter", "port", text("payload").alias("payload"))


@query("SELECT n_nationkey, 10 AS function, 1 AS version, ascii(n_name) >> 4 AS apdu_type, n_name AS apdu FROM nation")
def bacnet_units(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("data", F.concat(hexed("810A"), be(F.length("n_name") + 6, 2), hexed("0100"), raw("n_name")))
    return messages.bacnet_messages(n, ["n_nationkey"], "data").select("n_nationkey", "function", "version", "apdu_type", text("apdu").alias("apdu"))


@query("""SELECT s_suppkey, k AS index, CASE WHEN k = 0 THEN 'FPRD' ELSE 'LWR' END AS command, s_suppkey AS address, CASE WHEN k = 0 THEN s_name ELSE s_nationkey::VARCHAR END AS data, 1 + k AS counter FROM supplier, (VALUES (0), (1)) v(k)""")
def ethercat_frames(spark, sf_dir):
    def datagram(command: str, index: int, data: Column, more: bool) -> Column:
        n = F.length(data)
        return F.concat(hexed(command), be(F.lit(index), 1), le(F.col("s_suppkey"), 4), le(n + (0x8000 if more else 0), 2), hexed("0000"), data, le(F.lit(index + 1), 2))

    both = F.concat(datagram("04", 0, raw("s_name"), True), datagram("0B", 1, raw(F.col("s_nationkey").cast("string")), False))
    s = table(spark, sf_dir, "supplier").withColumn("_b", both).withColumn("data", F.concat(le(F.length("_b").bitwiseOR(F.lit(0x1000)), 2), F.col("_b")))
    return messages.ethercat_datagrams(s, ["s_suppkey"], "data").select("s_suppkey", "index", "command", "address", text("data").alias("data"), "counter")


@query("SELECT c_custkey, 'MSG' AS type, 'F' AS chunk, 12 + length(c_name) AS size, true AS complete, c_custkey AS channel FROM customer")
def opcua_chunks(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("data", F.concat(raw(F.lit("MSGF")), le(F.length("c_name") + 12, 4), le(F.col("c_custkey"), 4), raw("c_name")))
    return messages.opcua_messages(c, ["c_custkey"], "data")


@query("SELECT s_suppkey, 6 AS flags, s_name AS name, lpad(lower(hex(s_suppkey % 65536)), 4, '0') AS service, 76 AS manufacturer, lower(hex(encode(s_name))) AS manufacturer_data FROM supplier")
def ble_names(spark, sf_dir):
    n = F.length("s_name")
    data = F.concat(hexed("020106"), be(n + 1, 1), hexed("09"), raw("s_name"), hexed("0303"), le(F.col("s_suppkey") % 65536, 2), be(n + 3, 1), hexed("FF4C00"), raw("s_name"))
    m = messages.ble_advertisements(table(spark, sf_dir, "supplier").withColumn("data", data), ["s_suppkey"], "data")
    return m.select("s_suppkey", "flags", "name", F.col("services")[0].alias("service"), "manufacturer", F.lower(F.hex("manufacturer_data")).alias("manufacturer_data"))


@query("SELECT s_suppkey, (s_suppkey % 247 + 1)::INT AS unit, 3 AS function, s_suppkey % 5 = 0 AS exception, s_name AS data, s_suppkey % 7 > 0 AS crc_ok FROM supplier")
def modbus_rtu_frames(spark, sf_dir):
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").withColumn("_b", F.concat(be(k % 247 + 1, 1), F.when(k % 5 == 0, hexed("83")).otherwise(hexed("03")), raw("s_name")))
    s = s.withColumn("_c", checksums.checksum(F.col("_b"), "crc16_modbus") + F.when(k % 7 == 0, 1).otherwise(0))
    m = messages.modbus_frames(s.withColumn("data", F.concat("_b", le(F.col("_c") % 65536, 2))), ["s_suppkey"], "data")
    return m.select("s_suppkey", "unit", "function", "exception", text("data").alias("data"), "crc_ok")


@query("SELECT s_suppkey, (s_suppkey % 65536)::INT AS \"transaction\", 9 AS unit, 4 AS function, s_name AS data FROM supplier")
def modbus_tcp_frames(spark, sf_dir):
    data = F.concat(be(F.col("s_suppkey") % 65536, 2), hexed("0000"), be(F.length("s_name") + 2, 2), hexed("0904"), raw("s_name"))
    m = messages.modbus_frames(table(spark, sf_dir, "supplier").withColumn("data", data), ["s_suppkey"], "data", tcp=True)
    return m.select("s_suppkey", "transaction", "unit", "function", text("data").alias("data"))


@query("""WITH p AS (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem), q AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS f FROM p GROUP BY 1, 2),
 a AS (SELECT *, max(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY (l_linenumber * 5) % 7, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS nxt FROM q)
 SELECT l_orderkey, string_agg(f, '' ORDER BY l_linenumber) AS stream, count(*)::INT AS segments, (count(*) FILTER (l_linenumber < top))::INT AS out_of_order, (count(*) FILTER (nxt > l_linenumber + 1))::INT AS gaps FROM a GROUP BY 1""")
def udp_reassembly(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"))
    p = p.select("l_orderkey", "l_linenumber", raw("f").alias("data"), (F.col("l_linenumber") * 5 % 7).alias("arrival"))
    s = messages.udp_streams(p, ["l_orderkey"], ["arrival", "l_linenumber"], "l_linenumber", "data")
    return s.select("l_orderkey", text("stream").alias("stream"), "segments", "out_of_order", F.size("gaps").alias("gaps"))


@query("""WITH q AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2), a AS (SELECT *, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS nxt FROM q)
 SELECT l_orderkey, string_agg(f || CASE WHEN nxt > l_linenumber + 1 THEN repeat('.', (nxt - l_linenumber - 1)::INT) ELSE '' END, '' ORDER BY l_linenumber) AS stream, (count(*) FILTER (nxt > l_linenumber + 1))::INT AS n_gaps, 0 AS retransmits FROM a GROUP BY 1""")
def tcp_reassembly(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"))
    p = p.select("l_orderkey", F.col("l_linenumber").cast("long").alias("seq"), raw("f").alias("data"), (F.col("l_linenumber") * 5 % 7).alias("arrival"))
    s = protocols.tcp_streams(p, ["l_orderkey"], "seq", "data", "arrival")
    return s.select("l_orderkey", F.translate(text("stream"), "\0", ".").alias("stream"), "n_gaps", "retransmits")


# ---- records and schemas ---------------------------------------------------------------------


@query("""SELECT s_suppkey, '0' AS path, 1::BIGINT AS tag, lower(hex(encode(s_name))) AS value FROM supplier UNION ALL SELECT s_suppkey, '1/0', 2, lpad(lower(hex(s_nationkey)), 4, '0') FROM supplier
 UNION ALL SELECT s_suppkey, '1/1', 3, lower(hex(encode(s_name))) FROM supplier""")
def tlv_fields(spark, sf_dir):
    item = lambda tag, v: F.concat(hexed(tag), be(F.length(v), 1), v)
    inner = F.concat(item("02", be(F.col("s_nationkey"), 2)), item("03", raw("s_name")))
    s = table(spark, sf_dir, "supplier").withColumn("data", F.concat(item("01", raw("s_name")), item("30", inner)))
    r = messages.tlv_records(s, ["s_suppkey"], "data", containers=[0x30]).filter("tag <> 48")
    return r.select("s_suppkey", "path", "tag", F.lower(F.hex("value")).alias("value"))


FIELDS = [
    {"name": "key", "type": "uint32"}, {"name": "size", "type": "uint8"}, {"name": "segment", "type": "string", "size_field": "size"}, {"name": "balance", "type": "float64", "endian": "little"},
    {"name": "nation", "type": "uint16", "when": ("segment", "MACHINERY")},
]


@query("SELECT c_custkey AS key, c_mktsegment AS segment, c_acctbal AS balance, CASE WHEN c_mktsegment = 'MACHINERY' THEN c_nationkey::INT END AS nation, NULL::VARCHAR AS error FROM customer")
def schema_round_trip(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit(0).alias("size"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))
    m = messages.encoded(c, [], [f["name"] for f in FIELDS], FIELDS)
    return messages.decoded(m, [], "message", FIELDS, "key long, segment string, balance double, nation int")


# ---- comparison ------------------------------------------------------------------------------

_PAIRS = "(SELECT a.p_name AS x, b.p_name AS y FROM (SELECT DISTINCT p_name FROM part) a, (SELECT DISTINCT p_name FROM part) b WHERE a.p_name < b.p_name)"


def name_pairs(spark, sf_dir):
    n = table(spark, sf_dir, "part").select(F.col("p_name").alias("x")).distinct()
    m = F.broadcast(n.withColumnRenamed("x", "y"))  # part names are a closed list of a few dozen
    return n.join(m, F.col("x") < F.col("y")).withColumns({"a": raw("x"), "b": raw("y")})


@query(f"SELECT x, y, -levenshtein(x, y)::DOUBLE AS score FROM {_PAIRS}")
def global_alignments(spark, sf_dir):
    a = messages.alignments(name_pairs(spark, sf_dir), ["x", "y"], "a", "b", match=0, mismatch=-1, gap=-1)
    return a.select("x", "y", "score")


@query(f"""WITH s AS (SELECT DISTINCT p_name AS x, substr(p_name, i, n) AS s FROM part, range(1, 40) r(i), range(1, 40) q(n) WHERE i + n <= length(p_name) + 1)
 SELECT p.x, p.y, coalesce(max(length(a.s)), 0)::DOUBLE AS score FROM {_PAIRS} p LEFT JOIN s a ON a.x = p.x AND EXISTS (SELECT 1 FROM s b WHERE b.x = p.y AND b.s = a.s) GROUP BY 1, 2""")
def local_alignments(spark, sf_dir):
    a = messages.alignments(name_pairs(spark, sf_dir), ["x", "y"], "a", "b", match=1, mismatch=-100, gap=-100, local=True)
    return a.select("x", "y", "score")


@query(f"""SELECT x, y, round(1 - levenshtein(x, y) / greatest(length(x), length(y)), 6) AS edit, round(len(list_intersect(list_distinct(string_split(x, '')), list_distinct(string_split(y, '')))) / len(list_distinct(list_concat(string_split(x, ''), string_split(y, '')))), 6) AS bytes FROM {_PAIRS}""")
def payload_similarity(spark, sf_dir):
    p = name_pairs(spark, sf_dir)
    e = messages.similarities(p, ["x", "y", "a", "b"], "a", "b", "levenshtein").withColumnRenamed("similarity", "edit")
    j = messages.similarities(e, ["x", "y", "edit"], "a", "b", "jaccard").withColumnRenamed("similarity", "bytes")
    return rounded(j)


@query("""WITH n AS (SELECT c_nationkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i FROM customer) SELECT a.c_nationkey, a.i::INT AS i, b.i::INT AS j, round(hamming(a.c_name, b.c_name) / length(a.c_name), 6) AS distance
 FROM n a JOIN n b ON a.c_nationkey = b.c_nationkey AND a.i < b.i""")
def distance_matrix(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("m", raw("c_name"))
    return messages.distance_matrix(c, ["c_nationkey"], ["c_custkey"], "m", digits=6)


@query(f"""WITH d AS (SELECT x, y, i FROM {_PAIRS}, range(0, 64) r(i) WHERE i < greatest(length(x), length(y)) AND substr(x, i + 1, 1) <> substr(y, i + 1, 1)), g AS (SELECT *, i - row_number() OVER (PARTITION BY x, y ORDER BY i) AS g FROM d)
 SELECT x, y, min(i)::INT AS start, max(i)::INT + 1 AS stop FROM g GROUP BY x, y, g""")
def payload_differences(spark, sf_dir):
    return messages.differences(name_pairs(spark, sf_dir), ["x", "y"], "a", "b")


@query("""WITH s AS (SELECT page_id, substr(url, i, n) AS s, n FROM (SELECT page_id, url, unnest(range(1, length(url) + 1)) AS i FROM pages), range(1, 40) r(n) WHERE i + n <= length(url) + 1), c AS (SELECT page_id, s, n FROM s GROUP BY 1, 2, 3 HAVING count(*) >= 2)
 SELECT p.page_id, coalesce(max(n), 0)::INT AS length FROM pages p LEFT JOIN c USING (page_id) WHERE url IS NOT NULL GROUP BY 1""")
def longest_repeat(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", raw("url").alias("data"))
    return messages.longest_repeats(p, ["page_id"], "data").select("page_id", F.length("repeat").alias("length"))


@query("SELECT page_id, unnest(regexp_extract_all(url, '/[d-f].', 0)) AS match FROM pages")
def byte_regex(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", raw("url").alias("data"))
    return messages.regex_matches(p, ["page_id"], "data", "2f [64-66] ??").select("page_id", text("match").alias("match"))


@query("""WITH w AS (SELECT s_suppkey, i, substr(s_name, i + 1, 4) AS w FROM supplier, range(0, 64) r(i) WHERE i + 4 <= length(s_name))
 SELECT a.s_suppkey, a.i::INT AS a, b.i::INT AS b, round(1 - hamming(a.w, b.w) / 4, 6) AS similarity FROM w a JOIN w b ON a.s_suppkey = b.s_suppkey AND b.i >= a.i + 4 AND hamming(a.w, b.w) <= 1""")
def similar_sequences(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("data", raw("s_name"))
    return rounded(messages.similar_sequences(s, ["s_suppkey"], "data", 4, 1))


# ---- inference -------------------------------------------------------------------------------


@query("""WITH p AS (SELECT g, k FROM (SELECT DISTINCT page_id % 5 AS g FROM pages), range(1, 17) r(k)) SELECT p.g, max(substr(x.url, 1, p.k::INT)) AS magic FROM p JOIN pages x ON x.page_id % 5 = p.g
 WHERE (SELECT count(DISTINCT substr(y.url, 1, p.k::INT)) FROM pages y WHERE y.page_id % 5 = p.g) = 1 GROUP BY p.g""")
def magic_prefixes(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select((F.col("page_id") % 5).alias("g"), raw("url").alias("data"))
    return messages.magic_bytes(p, ["g"], "data").select("g", text("magic").alias("magic"))


@query("SELECT c_nationkey, 2 AS size, 'big' AS endian, 0 AS \"offset\", false AS includes_header, count(*)::INT AS messages FROM customer GROUP BY 1 HAVING count(*) >= 5")
def length_prefix_of_streams(spark, sf_dir):
    part = F.concat(be(F.length("c_name"), 2), raw("c_name"))
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", part.alias("p"))
    s = messages.grouped(c, ["c_nationkey"], ["c_custkey"], ["p"], lambda x: [{"data": b"".join(bytes(v) for v in x)}], "data binary")
    return messages.length_prefixes(s, ["c_nationkey"], "data").filter("messages >= 5").select("c_nationkey", "size", "endian", "offset", "includes_header", "messages")


@query("SELECT s_nationkey, 'crc16_ccitt' AS algorithm, 1.0::DOUBLE AS match_rate FROM supplier GROUP BY 1")
def checksum_identification(spark, sf_dir):
    b = raw("s_name")
    s = table(spark, sf_dir, "supplier").withColumn("m", F.concat(b, be(checksums.checksum(b, "crc16_ccitt"), 2)))
    return messages.checksum_algorithms(s, ["s_nationkey"], ["s_suppkey"], "m")


def _crc_sql(name: str, width: int, poly: int, init: int, reflect: bool, out: int) -> str:
    """A bitwise CRC as nested list reductions."""
    step = f"CASE WHEN a & 1 = 1 THEN xor(a >> 1, {poly}) ELSE a >> 1 END" if reflect else f"CASE WHEN a & {1 << (width - 1)} <> 0 THEN xor(a << 1, {poly}) & {(1 << width) - 1} ELSE (a << 1) & {(1 << width) - 1} END"
    put = "b" if reflect else f"b << {width - 8}"
    return f"xor(list_reduce(list_concat([{init}::BIGINT], bytes), lambda c, b: list_reduce(list_concat([xor(c, {put})], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, z: {step})), {out}) AS {name}"


_CRCS = ", ".join([
    _crc_sql("crc8", 8, 0x07, 0, False, 0), _crc_sql("crc16_ccitt", 16, 0x1021, 0xFFFF, False, 0), _crc_sql("crc16_ibm", 16, 0xA001, 0, True, 0),
    _crc_sql("crc16_modbus", 16, 0xA001, 0xFFFF, True, 0), _crc_sql("crc32", 32, 0xEDB88320, 0xFFFFFFFF, True, 0xFFFFFFFF),
])


@query(f"""WITH b AS (SELECT page_id, list_transform(range(0, octet_length(encode(url))), lambda p: ('0x' || substr(hex(encode(url)), 2 * p + 1, 2))::BIGINT) AS bytes FROM pages WHERE url IS NOT NULL) SELECT page_id, {_CRCS} FROM b""")
def crc_columns(spark, sf_dir):
    p = table(spark, sf_dir, "pages").filter("url is not null").withColumn("d", raw("url"))
    return p.select("page_id", *[checksums.checksum(F.col("d"), n).alias(n) for n in ("crc8", "crc16_ccitt", "crc16_ibm", "crc16_modbus", "crc32")])


@query("""WITH p AS (SELECT event_type AS item, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS successor FROM events) SELECT item, successor, count(*) AS n FROM p WHERE successor IS NOT NULL GROUP BY 1, 2""")
def message_dependencies(spark, sf_dir):
    return messages.dependencies(events(spark, sf_dir), ["user_id"], ["t", "event_id"], "event_type")


_FIRST = """WITH f AS (SELECT c_nationkey, c_mktsegment, min(c_custkey) AS f FROM customer GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY f) - 1 AS c FROM f)
 SELECT c_nationkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::INT AS row, c::INT AS cluster FROM customer JOIN r USING (c_nationkey, c_mktsegment)"""


@query(_FIRST)
def hamming_clusters(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("m", raw(F.rpad("c_mktsegment", 12, " ")))
    return messages.hamming_clusters(c, ["c_nationkey"], ["c_custkey"], "m", 0.1)


@query(_FIRST)
def edit_distance_clusters(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("m", raw("c_mktsegment"))
    return messages.edit_distance_clusters(c, ["c_nationkey"], ["c_custkey"], "m", 0.2)


@query()
def learnt_state_machine(spark, sf_dir):
    e = events(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("t", "event_id", "event_type"))).alias("s"))
    w = e.select(F.lit("all").alias("g"), "user_id", F.transform("s", lambda x: x.event_type).alias("w"))
    return messages.state_machines(w.withColumn("g", F.pmod("user_id", F.lit(50))), ["g"], ["user_id"], "w")


# ---- sampled lines ---------------------------------------------------------------------------


def lines(df, keys, column, f, schema):
    """Levels of each row's line or lines, from ``f`` of its value."""
    return messages.records(df, keys, [column], lambda v: [f(v)], schema)


def spelled(frames, keys, value):
    """Characters of the frames in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("frame", F.char(F.col(value)).alias("c")))), lambda x: x.c)
    return frames.groupBy(*keys).agg(F.array_join(parts, "").alias("message"))


_NAMES = "SELECT s_suppkey, s_name AS message FROM supplier"


@query(_NAMES)
def uart_decoding(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("m", raw("s_name"))
    level = lines(s, ["s_suppkey"], "m", lambda m: {"level": waveforms.uart_line(m, 8, "even").tolist()}, "level array<tinyint>")
    return spelled(protocols.decode(level, ["s_suppkey"], "uart", ["level"], fs=8.0, baud=1.0, parity="even").filter("size(errors) = 0"), ["s_suppkey"], "value")


@query(_NAMES)
def spi_decoding(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("m", raw("s_name"))
    level = lines(s, ["s_suppkey"], "m", lambda m: dict(zip(("clk", "data", "cs"), (x.tolist() for x in waveforms.spi_lines(m)), strict=True)), "clk array<tinyint>, data array<tinyint>, cs array<tinyint>")
    return spelled(protocols.decode(level, ["s_suppkey"], "spi", ["clk", "data", "cs"]), ["s_suppkey"], "word")


@query("SELECT s_suppkey, (s_suppkey % 128)::INT AS address, false AS \"read\", s_name AS message, true AS acknowledged FROM supplier")
def i2c_decoding(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("m", raw("s_name"))
    level = messages.records(s, ["s_suppkey"], ["s_suppkey", "m"], lambda k, m: [dict(zip(("scl", "sda"), (x.tolist() for x in waveforms.i2c_lines(k % 128, m)), strict=True))], "scl array<tinyint>, sda array<tinyint>")
    d = protocols.decode(level, ["s_suppkey"], "i2c", ["scl", "sda"])
    return d.select("s_suppkey", "address", "read", F.array_join(F.transform("data", lambda v: F.char(v)), "").alias("message"), F.forall("acks", lambda a: a).alias("acknowledged"))


@query("SELECT c_custkey, c_custkey * 7 % 2048 AS id, false AS extended, left(c_mktsegment, 8) AS data, true AS crc_ok FROM customer")
def can_decoding(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("m", raw(F.substring("c_mktsegment", 1, 8)))
    level = messages.records(c, ["c_custkey"], ["c_custkey", "m"], lambda k, m: [{"level": waveforms.can_line(k * 7 % 2048, m, 4).tolist()}], "level array<tinyint>")
    d = protocols.decode(level, ["c_custkey"], "can", ["level"], fs=4.0, bitrate=1.0)
    return d.filter("frame = 0").select("c_custkey", "id", "extended", text("data").alias("data"), "crc_ok")


@query("SELECT c_custkey, c_custkey % 2048 AS id, true AS brs, 20 AS size, c_name AS data FROM customer")
def can_fd_decoding(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("m", raw("c_name"))
    bits = messages.records(c, ["c_custkey"], ["c_custkey", "m"], lambda k, m: [{"bits": waveforms.can_fd_bits(k % 2048, m).tolist()}], "bits array<tinyint>")
    d = protocols.decode(bits, ["c_custkey"], "can_fd", ["bits"])
    return d.select("c_custkey", "id", "brs", "size", F.rtrim(F.translate(text("data"), "\0", " ")).alias("data"))


@query("SELECT s_suppkey, (s_suppkey % 60)::INT AS id, true AS parity_ok, left(s_name, 8) AS data, true AS checksum_ok FROM supplier")
def lin_decoding(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("m", raw(F.substring("s_name", 1, 8)))
    f = messages.records(s, ["s_suppkey"], ["s_suppkey", "m"], lambda k, m: [{"f": waveforms.lin_frame(k % 60, m)}], "f binary")
    return protocols.decode(f, ["s_suppkey"], "lin", ["f"]).select("s_suppkey", "id", "parity_ok", text("data").alias("data"), "checksum_ok")


@query("SELECT s_suppkey, s_name AS message, true AS fcs_ok FROM supplier")
def hdlc_decoding(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("m", raw("s_name"))
    bits = lines(s, ["s_suppkey"], "m", lambda m: {"bits": waveforms.hdlc_bits(m).tolist()}, "bits array<tinyint>")
    return protocols.decode(bits, ["s_suppkey"], "hdlc", ["bits"]).select("s_suppkey", text("data").alias("message"), "fcs_ok")


@query("SELECT vec_id, d::INT AS frame, floor(embedding[d + 1]::DOUBLE * 8000)::INT AS \"left\", floor(embedding[d + 33]::DOUBLE * 8000)::INT AS \"right\" FROM embeddings, range(0, 31) r(d)")
def i2s_decoding(spark, sf_dir):
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 8000).cast("int"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.slice(v, 1, 32).alias("l"), F.slice(v, 33, 32).alias("r"))
    names = ("bck", "ws", "sd")
    level = messages.records(e, ["vec_id"], ["l", "r"], lambda a, b: [dict(zip(names, (x.tolist() for x in waveforms.i2s_lines(a.tolist(), b.tolist())), strict=True))], "bck array<tinyint>, ws array<tinyint>, sd array<tinyint>")
    return protocols.decode(level, ["vec_id"], "i2s", list(names)).filter("frame < 31")


@query("""SELECT s_suppkey, unnest(range(0, 6))::INT AS frame, unnest(CASE WHEN s_suppkey % 2 = 0 THEN ['IDLE', 'SELECT_DR', 'CAPTURE_DR', 'SHIFT_DR', 'EXIT1_DR', 'UPDATE_DR'] ELSE ['IDLE', 'SELECT_DR', 'SELECT_IR', 'CAPTURE_IR', 'SHIFT_IR', 'EXIT1_IR'] END) AS state FROM supplier""")
def jtag_states(spark, sf_dir):
    paths = (("IDLE", "SELECT_DR", "CAPTURE_DR", "SHIFT_DR", "EXIT1_DR", "UPDATE_DR"), ("IDLE", "SELECT_DR", "SELECT_IR", "CAPTURE_IR", "SHIFT_IR", "EXIT1_IR"))
    tms = lines(table(spark, sf_dir, "supplier"), ["s_suppkey"], "s_suppkey", lambda k: {"tms": waveforms.jtag_walk(paths[k % 2])}, "tms array<tinyint>")
    return protocols.decode(tms, ["s_suppkey"], "jtag", ["tms"])


@query("SELECT o_orderkey, 'AP' AS port, o_orderkey % 2 = 0 AS \"read\", ((o_orderkey % 4) * 4)::INT AS address, 1 AS ack, (o_custkey * 65537) % 4294967296 AS value, true AS parity_ok FROM orders")
def swd_decoding(spark, sf_dir):
    f = lambda k, v: [{"bits": waveforms.swd_bits(True, k % 2 == 0, k % 4 * 4, v * 65537 % (1 << 32)).tolist()}]
    bits = messages.records(table(spark, sf_dir, "orders"), ["o_orderkey"], ["o_orderkey", "o_custkey"], f, "bits array<tinyint>")
    return protocols.decode(bits, ["o_orderkey"], "swd", ["bits"]).drop("frame")


def packed(frames, keys, lsb=False):
    """Characters of eight bits each, in order."""
    weight = F.lit(1) * F.pow(F.lit(2), (F.col("frame") % 8) if lsb else (7 - F.col("frame") % 8))
    b = frames.groupBy(*keys, F.floor(F.col("frame") / 8).cast("int").alias("byte")).agg(F.sum(F.col("bit") * weight).cast("int").alias("value"))
    return spelled(b.withColumnRenamed("byte", "frame"), keys, "value")


@query(_NAMES)
def manchester_decoding(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("m", raw("s_name"))
    level = lines(s, ["s_suppkey"], "m", lambda m: {"level": waveforms.manchester_line(m, 8).tolist()}, "level array<tinyint>")
    return packed(protocols.decode(level, ["s_suppkey"], "manchester", ["level"], per=8.0), ["s_suppkey"])


@query("SELECT s_suppkey, 1 AS resets, left(s_name, 4) AS message FROM supplier")
def onewire_decoding(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("m", raw(F.substring("s_name", 1, 4)))
    level = lines(s, ["s_suppkey"], "m", lambda m: {"level": waveforms.onewire_line(m).tolist()}, "level array<tinyint>")
    d = protocols.decode(level, ["s_suppkey"], "onewire", ["level"], fs=1e6).select("s_suppkey", "resets", F.posexplode("bits").alias("frame", "bit"))
    return packed(d, ["s_suppkey", "resets"], lsb=True)


@query(_NAMES)
def usb_decoding(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("m", raw("s_name"))
    level = lines(s, ["s_suppkey"], "m", lambda m: {"level": waveforms.nrzi_levels(np.unpackbits(np.frombuffer(m, np.uint8)).tolist()).tolist()}, "level array<tinyint>")
    return packed(protocols.decode(level, ["s_suppkey"], "usb", ["level"]), ["s_suppkey"])


@query("SELECT o_orderkey, true AS sync, false AS startup, (o_orderkey % 2048)::INT AS id, (o_custkey % 128)::INT AS words, (o_custkey % 2048)::INT AS crc, (o_orderkey % 64)::INT AS cycle FROM orders")
def flexray_headers(spark, sf_dir):
    put = lambda c, n: F.lpad(F.bin(c), n, "0")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    word = F.concat(F.lit("00010"), put(k % 2048, 11), put(c % 128, 7), put(c % 2048, 11), put(k % 64, 6))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.transform(F.split(word, ""), lambda x: x.cast("int")).alias("bits"))
    return protocols.decode(o, ["o_orderkey"], "flexray", ["bits"]).drop("frame")


@query("""SELECT o_orderkey, 'engine_rpm' AS name, round((o_orderkey % 256 * 256 + o_custkey % 256) / 4, 6) AS value FROM orders""")
def obd_values(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", protocols.obd_value(F.lit(0x0C), F.col("o_orderkey") % 256, F.col("o_custkey") % 256).alias("v"))
    return rounded(o.select("o_orderkey", "v.name", "v.value"))


@query("""SELECT o_orderkey, (o_custkey % 65536) * 0.5 - 40 AS little, CASE WHEN o_custkey % 65536 >= 32768 THEN o_custkey % 65536 - 65536 ELSE o_custkey % 65536 END * 1.0::DOUBLE AS big FROM orders""")
def can_signals(spark, sf_dir):
    c = F.col("o_custkey") % 65536
    o = table(spark, sf_dir, "orders").withColumn("data", F.concat(hexed("00"), le(c, 2), be(c, 2), hexed("000000")))
    return o.select("o_orderkey", protocols.can_signal(F.col("data"), 8, 16, scale=0.5, offset=-40.0).alias("little"), protocols.can_signal(F.col("data"), 31, 16, big=True, signed=True).alias("big"))


@query("SELECT o_orderkey, md5(o_orderkey::VARCHAR)[1:8] || '-' || md5(o_orderkey::VARCHAR)[9:12] || '-' || md5(o_orderkey::VARCHAR)[13:16] || '-' || md5(o_orderkey::VARCHAR)[17:20] || '-' || md5(o_orderkey::VARCHAR)[21:32] AS uuid FROM orders")
def uuid_strings(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.unhex(F.md5(F.col("o_orderkey").cast("string"))).alias("u"))
    return o.select("o_orderkey", messages.uuid_text("u").alias("uuid"))
