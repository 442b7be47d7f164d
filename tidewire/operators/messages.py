"""DataFrame forms of the message functions: parsers, schemas, alignment, matching and field inference.

``records`` gives zero or more rows per message in Arrow batches, without a shuffle; ``grouped`` hands a
function all messages of one group in order, so a group must fit one task (a conversation, one kind of
message), as for the inference operators that look for regularities across messages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidewire.functions import checksums, inference, network
from tidewire.operators.stats import met, numbered
from tidewire.session import saved

Keys = Sequence[str]


def _values(column: pa.Array) -> Iterable:
    """Python values of a column; lists of numbers as numpy arrays."""
    if not (pa.types.is_list(column.type) or pa.types.is_large_list(column.type)):
        return column.to_pylist()
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.value_lengths().fill_null(0)).cumsum()
    return [None if not ok else flat[a:b] for ok, a, b in zip(column.is_valid().to_pylist(), np.append(0, ends[:-1]), ends, strict=True)]


def records(df: DataFrame, keys: Keys, columns: Sequence[str], f: Callable[..., Iterable[dict]], schema: str) -> DataFrame:
    """The rows that ``f`` gives of each row's ``columns``, beside its keys; a null among them gives none."""
    want = to_arrow_schema(StructType.fromDDL(schema))
    kept = [f"_k{i}" for i in range(len(keys))]
    body = df.select(*[F.col(k).alias(a) for k, a in zip(keys, kept, strict=True)], *[F.col(c).alias(f"_x{i}") for i, c in enumerate(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i, given in enumerate(zip(*(_values(batch.column(f"_x{j}")) for j in range(len(columns))), strict=True)):
                for r in f(*given) if not any(v is None for v in given) else ():
                    rows.append(i)
                    out.append(r)
            found = pa.RecordBatch.from_pylist(out, schema=want)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in kept), *found.columns], names=[*kept, *want.names])

    types = "".join(f"`{a}` {t}, " for a, (_, t) in zip(kept, body.dtypes, strict=False))
    return body.mapInArrow(run, types + schema).toDF(*keys, *want.names)


def _one(f: Callable[..., dict | None]) -> Callable[..., Iterable[dict]]:
    def rows(*given):
        r = f(*given)
        return [] if r is None else [r]

    return rows


def grouped(df: DataFrame, keys: Keys, order: Keys, columns: Sequence[str], f: Callable[..., Iterable[dict]], schema: str) -> DataFrame:
    """The rows that ``f`` gives of each group's columns (lists, in order)."""
    types = "".join(f"`{k}` {t}, " for k, t in df.select(*keys).dtypes)
    names = StructType.fromDDL(schema).names

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable")
        rows = list(f(*(pdf[c].tolist() for c in columns)))
        out = pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names, dtype=object)
        for i, (k, v) in enumerate(zip(keys, key, strict=True)):
            out.insert(i, k, [v] * len(out))
        return out

    return df.select(*dict.fromkeys([*keys, *order, *columns])).groupBy(*keys).applyInPandas(run, types + schema)


# ---- application protocols -------------------------------------------------------------------


def mqtt_packets(df: DataFrame, keys: Keys, data: str) -> DataFrame:
    """Control packets of a byte stream, one after another; a cut one ends it."""
    return records(df, keys, [data], network.mqtt_stream, "type string, flags int, length long, topic string, qos int, retain boolean, packet_id int, payload binary")


def coap_messages(df: DataFrame, keys: Keys, data: str) -> DataFrame:
    def f(x: bytes) -> list[dict]:
        m = network.coap(x)
        return [] if m is None else [{**m, "options": [{"name": str(n), "value": v} for n, v in m["options"]]}]

    return records(df, keys, [data], f, "type string, code string, method string, id int, token binary, options array<struct<name:string,value:binary>>, payload binary")


def uds_messages(df: DataFrame, keys: Keys, data: str) -> DataFrame:
    return records(df, keys, [data], _one(network.uds), "service string, response boolean, positive boolean, error string, data binary")


def iso_tp_messages(df: DataFrame, keys: Keys, order: Keys, data: str) -> DataFrame:
    """Messages put together from a channel's ISO 15765-2 frames, numbered from 0."""
    return grouped(df, keys, order, [data], lambda x: [{"part": i, "message": m} for i, m in enumerate(network.iso_tp([bytes(v) for v in x]))], "part int, message binary")


def lorawan_frames(df: DataFrame, keys: Keys, data: str) -> DataFrame:
    schema = "type string, major int, address string, adr boolean, ack boolean, counter int, options binary, port int, payload binary, mic binary"
    return records(df, keys, [data], _one(network.lorawan), schema)


def bacnet_messages(df: DataFrame, keys: Keys, data: str) -> DataFrame:
    return records(df, keys, [data], _one(network.bacnet), "function int, version int, control int, apdu_type int, apdu binary")


def ethercat_datagrams(df: DataFrame, keys: Keys, data: str) -> DataFrame:
    return records(df, keys, [data], network.ethercat, "command string, index int, address long, irq int, data binary, counter int")


def opcua_messages(df: DataFrame, keys: Keys, data: str) -> DataFrame:
    return records(df, keys, [data], _one(network.opcua), "type string, chunk string, size long, complete boolean, channel long")


def ble_advertisements(df: DataFrame, keys: Keys, data: str) -> DataFrame:
    return records(df, keys, [data], _one(network.ble_advertisement), "flags int, name string, services array<string>, manufacturer int, manufacturer_data binary")


def modbus_frames(df: DataFrame, keys: Keys, data: str, tcp: bool = False) -> DataFrame:
    from tidewire.operators.protocols import modbus_rtu, modbus_tcp

    return records(df, keys, [data], _one(modbus_tcp if tcp else modbus_rtu), "transaction int, unit int, function int, exception boolean, data binary, crc_ok boolean")


def udp_streams(df: DataFrame, keys: Keys, order: Keys, sequence: str, data: str) -> DataFrame:
    """Payloads of a flow put together by sequence number: bytes, segments, those out of order (below the
    largest number that arrived before) and numbers missing between sorted neighbours."""
    arrival, seq = [F.col(c).asc_nulls_last() for c in order], F.col(sequence)
    flow = W.partitionBy(*keys)
    rows = df.select(*dict.fromkeys([*keys, *order, sequence, data]))
    rows = rows.withColumn("_late", seq < F.max(seq).over(flow.orderBy(*arrival).rowsBetween(W.unboundedPreceding, -1)))
    ranked = flow.orderBy(seq, *arrival)
    rows = rows.withColumns({"_next": F.lead(seq).over(ranked), "_at": F.row_number().over(ranked)})
    gap = F.when(F.col("_next") > seq + 1, F.struct("_at", F.concat((seq + 1).cast("string"), F.lit("-"), (F.col("_next") - 1).cast("string")).alias("gap")))
    return rows.groupBy(*keys).agg(
        joined(F.col("_at"), F.col(data)).alias("stream"), F.count("*").cast("int").alias("segments"), F.count_if("_late").cast("int").alias("out_of_order"),
        F.transform(F.sort_array(F.collect_list(gap)), lambda g: g.gap).alias("gaps"),
    )


def joined(at: Column, part: Column) -> Column:
    """Aggregate: the group's binary parts end to end, in the order of ``at``."""
    parts = F.sort_array(F.collect_list(F.struct(at.alias("at"), F.hex(part).alias("part"))))
    return F.unhex(F.array_join(F.transform(parts, lambda p: p.part), ""))


# ---- records and schemas ---------------------------------------------------------------------


def tlv_records(df: DataFrame, keys: Keys, data: str, tag: int = 1, length: int = 1, big: bool = True, containers: Iterable[int] = ()) -> DataFrame:
    """Records of every depth: ``path`` numbers them from 0 within their container."""
    inside = frozenset(containers)

    def walk(found: list[dict], path: str) -> Iterator[dict]:
        for i, r in enumerate(found):
            at = f"{path}{i}"
            yield {"path": at, **r}
            yield from walk(r.get("children", []), at + "/")

    return records(df, keys, [data], lambda x: walk(inference.parse_tlv(x, tag, length, big, inside), ""), "path string, tag long, length long, value binary")


def decoded(df: DataFrame, keys: Keys, data: str, fields: Sequence[dict], schema: str) -> DataFrame:
    """Messages decoded by a list of fields (see ``inference.decode``); one that does not fit has an ``error``."""

    def f(x: bytes) -> list[dict]:
        try:
            return [inference.decode(x, fields)]
        except (ValueError, KeyError) as e:
            return [{"error": str(e)}]

    return records(df, keys, [data], f, f"{schema}, error string")


def encoded(df: DataFrame, keys: Keys, columns: Sequence[str], fields: Sequence[dict], out: str = "message") -> DataFrame:
    """Columns named as the fields, encoded to one binary message."""
    return records(df, keys, columns, lambda *v: [{out: inference.encode(dict(zip(columns, v, strict=True)), fields)}], f"{out} binary")


# ---- comparison ------------------------------------------------------------------------------


def alignments(df: DataFrame, keys: Keys, a: str, b: str, match: float = 1, mismatch: float = -1, gap: float = -1, local: bool = False) -> DataFrame:
    """Global or local alignment of two binary columns: score and both rows as hex, gaps as ``--``."""
    show = lambda s: "".join("--" if v is None else f"{v:02x}" for v in s)

    def f(x: bytes, y: bytes) -> list[dict]:
        m = inference.align(x, y, match, mismatch, gap, local)
        return [{"score": m["score"], "aligned_a": show(m["a"]), "aligned_b": show(m["b"])}]

    return records(df, keys, [a, b], f, "score double, aligned_a string, aligned_b string")


def multiple_alignment(df: DataFrame, keys: Keys, order: Keys, data: str) -> DataFrame:
    """Progressive alignment of a group's messages: a row each, all of one width."""

    def f(x: list) -> list[dict]:
        rows = inference.align_many([bytes(v) for v in x])
        return [{"row": i, "aligned": "".join("--" if v is None else f"{v:02x}" for v in r)} for i, r in enumerate(rows)]

    return grouped(df, keys, order, [data], f, "row int, aligned string")


def similarities(df: DataFrame, keys: Keys, a: str, b: str, metric: str = "ratio") -> DataFrame:
    return records(df, keys, [a, b], lambda x, y: [{"similarity": float(inference.similarity(x, y, metric))}], "similarity double")


def differences(df: DataFrame, keys: Keys, a: str, b: str) -> DataFrame:
    """Regions [start, stop) in which two payloads differ."""
    return records(df, keys, [a, b], lambda x, y: [{"start": p, "stop": q} for p, q in inference.difference(x, y)], "start int, stop int")


#: Messages on either side of a block of distances.
BLOCK = 1024


def half_up(x: float, digits: int) -> float:
    """As Spark's ``round``: the decimal form rounded half up; NaN stays."""
    return x if x != x else float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def distance_matrix(df: DataFrame, keys: Keys, order: Keys, data: str, metric: str = "hamming", digits: int | None = None) -> DataFrame:
    """Distances 1 - similarity of all pairs i < j of a group's messages, rounded half up to ``digits`` if given; null
    if one is null.

    A group is cut into blocks of BLOCK messages against BLOCK, so that its pairs spread over tasks. Python workers
    hand over a row for each left message of a block, with the distinct distances and 16 bits for each pair that
    tell which of them it has; generated code makes the pairs of it."""
    own, block = df.select(*dict.fromkeys([*keys, *order, data])), BLOCK
    rows = numbered(own, keys, [F.col(c).asc_nulls_last() for c in order], "_row").select(*keys, F.floor(F.col("_row") / block).cast("int").alias("_c"), "_row", F.col(data).alias("_m"))
    # A chunk is one row: its messages in order, nulls among them.
    chunks = saved(rows.groupBy(*keys, "_c").agg(F.transform(F.sort_array(F.collect_list(F.struct("_row", "_m"))), lambda r: r["_m"]).alias("_m")))
    last = saved(chunks.groupBy(*keys).agg(F.max("_c").alias("_last")))
    blocks = last.agg(F.sum((F.col("_last") + 1) * (F.col("_last") + 2) / 2)).first()[0] or 1
    c = F.col("_c")
    # A block has its left chunk and its right one, which is the same or a later one.
    at = F.concat(
        F.transform(F.sequence(c, F.col("_last")), lambda j: F.struct(c.alias("i"), j.alias("j"))),
        F.filter(F.transform(F.sequence(F.lit(0), c), lambda i: F.struct(i.alias("i"), c.alias("j"))), lambda p: p.i < c),
    )
    cores = df.sparkSession.sparkContext.defaultParallelism
    dealt = met(chunks.repartition(cores), last, keys).withColumn("_p", F.explode(at)).select(*keys, F.col("_p.i").alias("_x"), F.col("_p.j").alias("_y"), "_c", "_m")
    types = [(k, t) for k, t in dealt.dtypes if k in keys]
    schema = "".join(f"`{k}` {t}, " for k, t in types) + "i int, _first int, _from int, _to int, _codes array<bigint>, _values array<double>"
    want = to_arrow_schema(StructType.fromDDL(schema))

    def listed(a: np.ndarray) -> pa.ListArray:
        """Rows of ``a`` as lists; NaN as null."""
        return pa.ListArray.from_arrays(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1], pa.array(a.ravel(), from_pandas=True))

    def run(t: pa.Table) -> pa.Table:
        m = dict(zip(t.column("_c").to_pylist(), t.column("_m").to_pylist(), strict=True))
        x, y = t.column("_x")[0].as_py(), t.column("_y")[0].as_py()
        left, right, first = m[x], m[y], y * block
        row, end = np.arange(x * block, x * block + len(left)), first + len(right) - 1
        key, out, at = [pa.scalar(t.column(k)[0].as_py(), want.field(k).type) for k in keys], [], 0
        for values, codes in inference.distance_codes(left, right, metric, x == y):
            own = row[at : at + len(codes)]
            at += len(codes)
            own = own[own < end]  # the last message of all has no later one
            n, four = len(own), np.zeros((len(own), -(-len(right) // 4) * 4), "<u2")
            four[:, : len(right)] = codes[:n]
            told = values if digits is None else np.array([half_up(v, digits) for v in values.tolist()])
            places = [own, np.full(n, first), np.maximum(own + 1, first), np.full(n, end)]
            lists = [listed(four.view("<i8")), listed(np.broadcast_to(told, (n, len(told))))]
            out.append(pa.RecordBatch.from_arrays([*[pa.repeat(k, n) for k in key], *[pa.array(p, pa.int32()) for p in places], *lists], schema=want))
        return pa.Table.from_batches(out, schema=want)

    # Blocks are few rows that make many: their number of tasks is set, lest they be put together by size.
    by = [*keys, "_x", "_y"]
    tasks = min(max(8 * cores, min(20_000, int(blocks) // 16)), max(cores, int(blocks)))
    rows = dealt.repartition(tasks, *by).groupBy(*by).applyInArrow(run, schema)
    pairs = rows.withColumn("j", F.explode(F.sequence("_from", "_to"))).withColumn("_p", F.col("j") - F.col("_first"))
    code = F.expr("int(shiftright(get(_codes, shiftright(_p, 2)), shiftleft(_p & 3, 4)) & 65535)")
    return pairs.select(*keys, "i", "j", F.get("_values", code).alias("distance"))


def longest_repeats(df: DataFrame, keys: Keys, data: str) -> DataFrame:
    return records(df, keys, [data], lambda x: [{"repeat": inference.longest_repeat(x)}], "repeat binary")


def regex_matches(df: DataFrame, keys: Keys, data: str, pattern: str) -> DataFrame:
    """Matches of a byte pattern: hex bytes, ``??`` for any byte, ``[aa-bb]`` for a range, ``*`` for any run."""
    import re

    parts = re.findall(r"\[[0-9A-Fa-f]{2}-[0-9A-Fa-f]{2}\]|\?\?|\*|[0-9A-Fa-f]{2}", pattern)
    byte = lambda h: b"\\x" + h.lower().encode()
    whole = b"".join(b"." if p == "??" else b".*?" if p == "*" else b"[" + byte(p[1:3]) + b"-" + byte(p[4:6]) + b"]" if p[0] == "[" else byte(p) for p in parts)
    return records(df, keys, [data], lambda x: [{"pos": m.start(), "match": m.group()} for m in re.finditer(whole, x, re.DOTALL)], "pos int, match binary")


def similar_sequences(df: DataFrame, keys: Keys, data: str, length: int = 4, most: int = 1) -> DataFrame:
    """Pairs of windows of ``length`` bytes of one payload, not overlapping, that differ in at most ``most`` bytes."""

    def f(x: bytes) -> Iterator[dict]:
        b = np.frombuffer(x, np.uint8)
        for shift in range(length, len(b) - length + 1):
            far = np.convolve(b[:-shift] != b[shift:], np.ones(length, int), "valid")
            for i in np.flatnonzero(far <= most).tolist():
                yield {"a": i, "b": i + shift, "similarity": 1 - int(far[i]) / length}

    return records(df, keys, [data], f, "a int, b int, similarity double")


# ---- inference over groups -------------------------------------------------------------------


def inferred_fields(df: DataFrame, keys: Keys, order: Keys, data: str) -> DataFrame:
    """Fields of a group's messages of equal length (ten at least; others give none)."""

    def f(x: list) -> list[dict]:
        m = [bytes(v) for v in x]
        return inference.infer_fields(m) if len(m) >= 10 and len({len(v) for v in m}) == 1 else []

    return grouped(df, keys, order, [data], f, "start int, stop int, kind string, entropy double")


def length_prefixes(df: DataFrame, keys: Keys, data: str) -> DataFrame:
    """The length-prefix hypothesis that explains most of each stream; none, no row."""

    def f(x: bytes) -> list[dict]:
        best = inference.length_prefix(x)
        return [best] if best["score"] > 0 else []

    return records(df, keys, [data], f, "score double, size int, endian string, offset int, includes_header boolean, messages int")


def magic_bytes(df: DataFrame, keys: Keys, data: str, most: int = 16) -> DataFrame:
    """Bytes that open every message of a group; the least and the largest message share them, so two
    aggregates are enough."""
    g = df.groupBy(*keys).agg(F.min(data).alias("_a"), F.max(data).alias("_b"), F.count("*").alias("n"))
    return records(g, [*keys, "n"], ["_a", "_b"], lambda a, b: [{"magic": inference.magic_bytes([a, b], most)}], "magic binary")


def checksum_algorithms(df: DataFrame, keys: Keys, order: Keys, data: str) -> DataFrame:
    """The checksum, held in the last bytes, that fits most messages of a group."""

    return grouped(df, keys, order, [data], lambda x: [checksums.identify([bytes(m) for m in x])], "algorithm string, match_rate double")


def crc_parameters(df: DataFrame, keys: Keys, order: Keys, data: str, crc: str, width: int = 16) -> DataFrame:
    """Parameters of an unknown CRC from messages of equal length and their CRCs."""

    def f(x: list, c: list) -> list[dict]:
        found = checksums.recover_crc([(bytes(m), int(v)) for m, v in zip(x, c, strict=True)], width)
        return [] if found is None else [{"poly": found.poly, "init": found.init, "reflect": found.reflect, "xor_out": found.xor_out}]

    return grouped(df, keys, order, [data, crc], f, "poly long, init long, reflect boolean, xor_out long")


def state_machines(df: DataFrame, keys: Keys, order: Keys, word: str, accepted: str | None = None) -> DataFrame:
    """Transitions of the smallest automaton that RPNI learns from a group's words (arrays of symbols);
    words whose ``accepted`` is false are negative."""

    def f(words: list, good: list | None = None) -> Iterator[dict]:
        good = good or [True] * len(words)
        yes = [tuple(w) for w, g in zip(words, good, strict=True) if g]
        learnt = inference.learn_passive(yes, [tuple(w) for w, g in zip(words, good, strict=True) if not g]).minimized()
        for s, step in sorted(learnt.transitions.items()):
            for c, t in sorted(step.items(), key=lambda p: str(p[0])):
                yield {"state": s, "symbol": str(c), "next_state": t, "accepting": t in learnt.accepting}

    return grouped(df, keys, order, [word, *([accepted] if accepted else [])], f, "state int, symbol string, next_state int, accepting boolean")


def dependencies(df: DataFrame, keys: Keys, order: Keys, item: str) -> DataFrame:
    """Distinct successors of each item within a group, with the number of times they follow."""
    by = W.partitionBy(*keys).orderBy(*order)
    pairs = df.select(F.col(item).alias("item"), F.lead(item).over(by).alias("successor")).filter("successor is not null")
    return pairs.groupBy("item", "successor").agg(F.count("*").alias("n"))


def hamming_clusters(df: DataFrame, keys: Keys, order: Keys, data: str, threshold: float) -> DataFrame:
    """Greedy complete linkage of a group's messages in order. Repeats of a message are in its first one's
    cluster (see ``inference.cluster_by_hamming``), so a task holds the distinct messages of a group only."""
    own = df.select(*dict.fromkeys([*keys, *order, data]))
    rows = numbered(own, keys, [F.col(c).asc_nulls_last() for c in order], "row").select(*keys, F.col("row").cast("int").alias("row"), F.col(data).alias("_m"))
    if threshold < 0:
        return rows.select(*keys, "row", F.col("row").alias("cluster"))
    first = rows.groupBy(*keys, "_m").agg(F.min("row").alias("_first"))
    f = lambda at, x: [{"_m": bytes(m), "cluster": c} for m, c in zip(x, inference.cluster_by_hamming([bytes(m) for m in x], threshold), strict=True)]
    return met(rows, grouped(first, keys, ["_first"], ["_first", "_m"], f, "_m binary, cluster int"), [*keys, "_m"]).select(*keys, "row", "cluster")


def hierarchical_clusters(df: DataFrame, keys: Keys, order: Keys, data: str, clusters: int, metric: str = "hamming", linkage: str = "average") -> DataFrame:
    """Agglomeration of a group's messages until ``clusters`` are left (single, complete or average linkage);
    clusters are numbered by their first message."""

    def f(x: list) -> list[dict]:
        m = [bytes(v) for v in x]
        d = np.array([[0.0 if i == j else 1 - float(inference.similarity(a, b, metric)) for j, b in enumerate(m)] for i, a in enumerate(m)]).reshape(len(m), len(m))
        held = [[i] for i in range(len(m))]
        join = {"single": np.min, "complete": np.max, "average": np.mean}[linkage]
        while len(held) > clusters:
            best = min(((join(d[np.ix_(a, b)]), i, j) for i, a in enumerate(held) for j, b in enumerate(held) if i < j), default=None)
            if best is None:
                break
            held[best[1]] += held.pop(best[2])
        which = {i: c for c, g in enumerate(sorted(held, key=min)) for i in g}
        return [{"row": i, "cluster": which[i]} for i in range(len(m))]

    return grouped(df, keys, order, [data], f, "row int, cluster int")


def edit_distance_clusters(df: DataFrame, keys: Keys, order: Keys, data: str, threshold: float) -> DataFrame:
    """Greedy leader clustering: a message joins the first cluster whose first message is within ``threshold``
    (distance / longer length), else founds one."""

    def f(x: list) -> Iterator[dict]:
        leaders: list[bytes] = []
        for i, v in enumerate(map(bytes, x)):
            hit = next((c for c, l in enumerate(leaders) if 1 - inference.similarity(v, l, "levenshtein") <= threshold), None)
            if hit is None:
                leaders.append(v)
                hit = len(leaders) - 1
            yield {"row": i, "cluster": hit}

    return grouped(df, keys, order, [data], f, "row int, cluster int")


def uuid_text(data: str):
    """Binary of 16 bytes as UUID text; of 2 or 4 bytes as short hex."""
    h = F.lower(F.hex(data))
    long_ = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.when(F.length(data) == 16, long_).otherwise(h)
