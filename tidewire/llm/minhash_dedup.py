"""Operator 6: near-duplicate documents by BagMinHash signatures of weighted word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.components import linked
from tidewire.llm.tables import in_arrow, numbered, picked, small
from tidewire.llm.text import U64, Seen, joined, mix, powers, ragged, salts, shingles, slices, words_of
from tidewire.session import forget, gathered, saved

SHINGLE, SIMILARITY = 5, 0.8
#: 16 bands of 4 registers: a pair at 0.8 shares a band with probability 0.9998.
REGISTERS, ROWS = 64, 4
STEP, POINT = U64(0x9E3779B97F4A7C15), U64(0xD1B54A32D192ED03)


def bag_signatures(items: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """BagMinHash registers (n x m) of n weighted sets; integer weights of at least 1.

    A weight w is the stretch [0, w), cut at 1, 2, 4, 8 and so on. Each stretch of an item has a
    Poisson process of points in time, at a rate equal to its length; a point has a place in the
    stretch and a register, and counts if its place is below w. All randomness comes from the item
    and the stretch, so two sets see the same points as far as their weights agree, and registers,
    which hold the earliest time, agree with probability equal to weighted Jaccard similarity. A
    process ends when its time passes the set's latest register.
    """
    top = np.where(weights > 1, np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64), 0) + 1
    which = np.repeat(np.arange(len(items)), top)
    level = np.arange(len(which)) - np.repeat(np.cumsum(top) - top, top)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    length = np.where(level > 0, low, 1.0)
    seed = mix(items[which] + level.astype(U64) * POINT)
    fill, own = np.minimum(1.0, (weights[which] - low) / length), owner[which].astype(np.int64)
    time = np.zeros(len(which))
    registers = np.full(n * m, np.inf)
    last = np.full(n, np.inf)
    while len(seed):
        seed = seed + STEP
        u = mix(seed)
        time -= np.log(((u >> U64(11)).astype(np.float64) + 1) * 2.0**-53) / length
        on = time < last[own]
        seed, time, length, fill, own = seed[on], time[on], length[on], fill[on], own[on]
        v = mix(u[on] ^ POINT)
        hit = (v >> U64(32)).astype(np.float64) * 2.0**-32 < fill
        np.minimum.at(registers, own[hit] * m + (v[hit] & U64(m - 1)).astype(np.int64), time[hit])
        last = registers.reshape(n, m).max(1)
    return registers.reshape(n, m)


def band_hashes(registers: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bits = registers.view(U64).reshape(len(registers), -1, rows)
    out = np.zeros(bits.shape[:2], U64)
    for j, p in enumerate(powers(0xD6E8FEB86659FD93, rows + 1)[1:]):
        out += mix(bits[:, :, j]) * p
    return mix(out + np.arange(out.shape[1], dtype=U64) * STEP)


def _class(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A hash of each row's whole word sequence: each word mixed with its place, added up. Different texts
    share one by chance only, n of them about n**2 / 2**65 times."""
    n = np.diff(offs)
    out = n.astype(U64)
    some = np.flatnonzero(n)
    if len(some):
        _, k = ragged(n)
        out[some] += np.add.reduceat(mix(h ^ salts(int(n.max()), 5)[k]), offs[:-1][some])
    return mix(out)


def occurrences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle multisets of texts as sets: the k-th occurrence of a shingle is a value of its own."""
    h, offs = words_of(column)
    out = []
    for at, to in zip(offs[:-1], offs[1:], strict=True):
        values, counts = np.unique(shingles(h[at:to], SHINGLE), return_counts=True)
        k = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        out.append(np.sort(mix(np.repeat(values, counts) + k.astype(U64) * POINT)))
    return joined(out)


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``_id, class, size, given, bands`` per row: class is the hash of the words (null without words);
    bands are given once per class and task (see :class:`Seen`), null on its other rows."""
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for whole in batches:
            for batch in slices(whole, "_text"):
                h, offs = words_of(batch.column("_text"))
                n = np.diff(offs)
                cls = _class(h, offs)
                first = seen.new(cls, n > 0)
                bags = [np.unique(shingles(h[offs[i] : offs[i + 1]], SHINGLE), return_counts=True) for i in first]
                bands = np.zeros((0, REGISTERS // ROWS), U64)
                if bags:
                    items, weights = (np.concatenate(x) for x in zip(*bags, strict=True))
                    owner = np.repeat(np.arange(len(bags)), [len(x) for x, _ in bags])
                    bands = band_hashes(bag_signatures(items, weights, owner, len(bags)))
                width, place = bands.shape[1], np.full(batch.num_rows, -1)
                place[first] = np.arange(len(first))
                at = np.concatenate(([0], np.cumsum(np.where(place >= 0, width, 0)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at, mask=np.append(place < 0, False)), pa.array(bands.ravel().view(np.int64)))
                size = np.where(n < SHINGLE, np.minimum(n, 1), n - SHINGLE + 1)
                yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(cls.view(np.int64), mask=n == 0), pa.array(size, pa.int32()), pa.array(place >= 0), lists], names=["_id", "class", "size", "given", "bands"])

    body = picked(docs, _id=doc_id, _text=text)
    return in_arrow(body, run, f"_id {kind}, class long, size int, given boolean, bands array<long>")


def _texts(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``id, text`` for the classes in ``wanted`` (``class, _id``: a document that has it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                same = _class(*words_of(batch.column("_text"))).view(np.int64) == np.asarray(batch.column("class"))
                at = pa.array(np.flatnonzero(same))
                yield pa.RecordBatch.from_arrays([batch.column("class").take(at), batch.column("_text").take(at)], names=["id", "text"])

    body = picked(docs, _doc=doc_id, _text=text)
    asked = body.join(small(wanted), F.col("_doc").eqNullSafe(F.col("_id"))).select("class", "_text")
    return in_arrow(asked, run, "id long, text string")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id, group_id, group_rows, kept`` (and ``_class``, the hash of its words).

    Documents with the same words are one class; classes that share a band and whose multisets of
    five-word shingles have weighted Jaccard of at least ``similarity`` are linked; a group is what
    links connect. ``group_id`` is the smallest id in the group, ``group_rows`` its rows; ``kept`` is
    true for rows with that id. A text of one to four words is one shingle. Null, empty and wordless
    texts are groups of their own and kept. Null ids count as larger than all (a group of null ids
    has a null group_id and its rows are kept). Repeated rows are one class.
    """
    drawn = saved(gathered(sketches(docs, doc_id, text)))
    members = drawn.filter("given").select(F.explode("bands").alias("bucket"), F.col("class").alias("id"), "size")
    sample = drawn.filter("given").groupBy("class").agg(F.min("_id").alias("_id"))

    def texts_of(ids: DataFrame) -> DataFrame:
        # Texts go from the documents to their join; they are not written as files.
        wanted = saved(gathered(sample.join(ids.withColumnRenamed("id", "class"), "class", "left_semi")))
        return _texts(docs, wanted, doc_id, text)

    found = linked(members, texts_of, occurrences, similarity)
    f = found.select(F.col("id").alias("_k"), "component")
    rows = saved(gathered(drawn.select("_id", "class").join(f, F.col("class") == F.col("_k"), "left").select("_id", "class", F.coalesce("component", "class").alias("g"))))
    forget(drawn)
    groups = rows.filter("g is not null").groupBy("g").agg(F.min("_id").alias("group_id"), F.count("*").alias("group_rows"))
    groups = groups.filter("group_rows > 1").withColumnRenamed("g", "_g")
    out = rows.join(groups, F.col("g") == F.col("_g"), "left")
    in_group = F.col("group_rows").isNotNull()
    gid = F.when(in_group, F.col("group_id")).otherwise(F.col("_id"))
    return out.select(
        F.col("_id").alias(doc_id), gid.alias("group_id"), F.coalesce("group_rows", F.lit(1)).alias("group_rows"),
        gid.eqNullSafe(F.col("_id")).alias("kept"), F.col("class").alias("_class"), F.col("g").alias("_group"),
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without those whose group keeps another: one row of each group stays.

    Null, empty and wordless texts stay. Of repeated rows, and of rows of a group that hold its smallest
    id together, one stays. Columns of any name are kept as they are.
    """
    judged = saved(gathered(near_duplicates(docs, doc_id=doc_id, text=text).filter("group_rows > 1")))
    body, at = numbered(docs)
    key, words = at[doc_id], list(body.columns).index(at[text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at[text]):
                h, offs = words_of(batch.column(words))
                c = pa.array(_class(h, offs).view(np.int64), mask=np.diff(offs) == 0)
                yield pa.RecordBatch.from_arrays([*batch.columns, c], names=[*batch.schema.names, "_class"])

    marked = in_arrow(body, run, ", ".join(f"`{c}` {k}" for c, k in body.dtypes) + ", `_class` long")
    out = judged.filter(~F.col("kept")).select(F.col(doc_id).alias("_id"), F.col("_class").alias("_out")).distinct()
    stay = marked.join(small(out), F.col(key).eqNullSafe(F.col("_id")) & F.col("_class").eqNullSafe(F.col("_out")), "left_anti")
    # Several rows of a group can hold its smallest id; of those one stays.
    twice = judged.filter("kept").groupBy(F.col(doc_id).alias("_id"), F.col("_group").alias("_g")).agg(F.count("*").alias("n"), F.collect_set("_class").alias("_classes"))
    twice = small(saved(gathered(twice.filter("n > 1").select("_id", "_g", F.explode("_classes").alias("_again")))))
    tied = stay.join(twice, F.col(key).eqNullSafe(F.col("_id")) & (F.col("_class") == F.col("_again")), "left")
    alone = tied.filter("_g is null").select(*body.columns)
    return alone.unionByName(tied.filter("_g is not null").dropDuplicates(["_g", "_id"]).select(*body.columns)).toDF(*docs.columns)
