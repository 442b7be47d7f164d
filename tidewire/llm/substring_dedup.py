"""Operator 5: repeated passages by prefix-partitioned suffix trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.tables import in_arrow, picked, small
from tidewire.llm.text import U64, grams, hash_spans, mix, ragged, salts, slices, spans, text_buffers, word_numbers
from tidewire.session import forget, saved

WINDOW = 50
#: Words of the prefix that places a suffix. Suffixes of a crowded prefix are placed by all their WINDOW words.
PREFIX = 8
#: Segments of one prefix above which it is crowded: bounds a tree's group to CROWD * 92 words.
CROWD = 8_000
#: Words that a task gathers before it builds their trees; whole prefixes only.
GROUP_WORDS = 400_000
REACH = WINDOW - PREFIX + 1


def _least_in_window(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest (leftmost on ties) of each ``width`` values, by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, span = np.arange(len(values)), 1
    while span * 2 <= width:
        a, b = best[:-span], best[span:]
        best = np.where(values[b] < values[a], b, a)
        span *= 2
    a, b = best[:n], best[width - span : width - span + n]
    return np.where(values[b] < values[a], b, a)


def _run_hashes(h: np.ndarray, lo: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Hash of the ``size`` words from each place ``lo``: each word mixed with its place in the run."""
    if not len(lo):
        return np.zeros(0, U64)
    group, k = ragged(size)
    x = h[lo[group] + k] ^ salts(int(size.max()), seed)[k]
    return np.add.reduceat(mix(x), np.cumsum(size) - size)


@dataclass
class Words:
    """Words of a slice of texts: byte spans, two independent hashes, and rows' offsets into them."""

    b: np.ndarray
    s: np.ndarray
    e: np.ndarray
    h: np.ndarray
    h2: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Words:
        b, offs = text_buffers(column)
        s, e = spans(b, offs)
        return cls(b, s, e, hash_spans(b, s, e), hash_spans(b, s, e, 1), np.searchsorted(s, offs))


def segments(w: Words) -> tuple[np.ndarray, ...]:
    """Cut each row's windows by the prefix that places them.

    Every window of 50 words is placed by the least of its 8-word prefixes, so equal windows are
    placed alike; consecutive windows with one placing prefix form a segment of at most 43 windows.
    Returns row, first window, windows, the prefix's hash and the segment's hash (of its words and the
    prefix's place), which come of independent word hashes.
    """
    h, offs = w.h, w.at
    g = grams(h, PREFIX)
    place = _least_in_window(g, REACH)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    start = np.flatnonzero(np.arange(len(h)) + WINDOW <= offs[1:][row]) if len(h) else np.zeros(0, np.int64)
    at = place[start]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1] + 1) | (at[1:] != at[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(start)))
    lo, at = start[head], at[head]
    seg = mix(_run_hashes(w.h2, lo, count + WINDOW - 1, 2) ^ mix(((at - lo) * 64 + count).astype(U64)))
    return row[lo], lo, count, g[at], seg


def deep_nodes(rank: np.ndarray, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Node of depth WINDOW above each suffix in ``starts``, of the suffix trees of the groups.

    ``rank`` numbers words. Suffixes are ranked by their first 1, 2, 4, ... 32 words (prefix doubling,
    as suffix arrays are built); two overlapping ranks of 32 words rank them by 50. Suffixes of equal
    rank in one group hang below the same internal node, whose label is at least 50 words deep.
    """
    rank, span = rank.astype(U64), 1
    while span * 2 <= WINDOW:
        pair = (rank[:-span] << U64(32)) | rank[span:]
        rank = np.unique(pair, return_inverse=True)[1].astype(U64)
        span *= 2
    pair = (rank[starts] << U64(32)) | rank[starts + WINDOW - span]
    node = np.unique(pair, return_inverse=True)[1]
    return np.unique(node.astype(np.int64) * (int(group.max()) + 1 if len(group) else 1) + group, return_inverse=True)[1]


def _drawn(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                w = Words.of(batch.column("_text"))
                row, lo, _, anchor, seg = segments(w)
                to = pa.array(row)
                cols = [batch.column("_id").take(to), batch.column("_t").take(to), pa.array(anchor.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(lo - w.at[row], pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=["_id", "_t", "anchor", "seg", "lo"])

    return in_arrow(docs, run, "_id long, _t long, anchor long, seg long, lo int")


def _asked_segments(batch: pa.RecordBatch, w: Words) -> tuple[np.ndarray, ...]:
    """The segments that a batch asks for: row, first window, windows, prefix, segment, its last document."""
    row, lo, count, anchor, seg = segments(w)
    want = batch.column("asked")
    item = want.flatten()
    whose = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(want.offsets))).astype(U64)
    k1 = mix(np.asarray(item.field("seg")).view(U64) ^ salts(whose, 3)) ^ np.asarray(item.field("anchor")).view(U64)
    k2 = mix(seg ^ salts(row, 3)) ^ anchor
    order = np.argsort(k1, kind="stable")
    pos = np.minimum(np.searchsorted(k1[order], k2), max(len(k1) - 1, 0))
    hit = np.flatnonzero(k1[order][pos] == k2) if len(k1) else np.zeros(0, np.int64)
    hit = hit[np.sort(np.unique(k2[hit], return_index=True)[1])]
    last = np.asarray(item.field("last"))[order[pos[hit]]] if len(hit) else np.zeros(0, np.int64)
    return row[hit], lo[hit], count[hit], anchor[hit], seg[hit], last


def _texts(asked: DataFrame) -> DataFrame:
    """Text of the segments asked for, with the prefix that places them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                w = Words.of(batch.column("_text"))
                row, lo, count, anchor, seg, last = _asked_segments(batch, w)
                text = [w.b[p:q].tobytes() for p, q in zip(w.s[lo], w.e[lo + count + WINDOW - 2], strict=True)]
                ids = batch.column("_id").take(pa.array(row))
                cols = [pa.array(anchor.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(count, pa.int32()), ids, pa.array(last), pa.array(text, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["anchor", "seg", "count", "first", "last", "text"])

    return in_arrow(asked, run, "anchor long, seg long, count int, first long, last long, text binary")


def _windows(asked: DataFrame) -> DataFrame:
    """Each window of the segments asked for, by two independent hashes of all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                w = Words.of(batch.column("_text"))
                row, lo, count, anchor, seg, last = _asked_segments(batch, w)
                x, off = ragged(count)
                at, width = lo[x] + off, np.full(len(x), WINDOW)
                pair = [pa.array(_run_hashes(h, at, width, 4).view(np.int64)) for h in (w.h, w.h2)]
                ids = batch.column("_id").take(pa.array(row[x]))
                cols = [*pair, pa.array(anchor[x].view(np.int64)), pa.array(seg[x].view(np.int64)), pa.array(off, pa.int32()), ids, pa.array(last[x])]
                yield pa.RecordBatch.from_arrays(cols, names=["w1", "w2", "anchor", "seg", "off", "first", "last"])

    return in_arrow(asked, run, "w1 long, w2 long, anchor long, seg long, off int, first long, last long")


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Build the trees of whole groups (rows come sorted by prefix) and give, for each segment with a
    window that a smaller document has, the smallest document of each of its windows."""
    held: list[pa.RecordBatch] = []
    size = 0

    def build(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        key, count, first, last = (np.asarray(t.column(c)) for c in ("anchor", "count", "first", "last"))
        b, offs = text_buffers(t.column("text").cast(pa.large_binary()))
        s, e = spans(b, offs)
        begin = np.searchsorted(s, offs)[:-1]
        which, place = ragged(count)
        group = np.unique(key, return_inverse=True)[1]
        node = deep_nodes(word_numbers(b, s, e), begin[which] + place, group[which])
        order = np.argsort(node, kind="stable")
        heads = np.flatnonzero(np.append(True, node[order][1:] != node[order][:-1]))
        mins = np.minimum.reduceat(first[which][order], heads)[node]
        useful = np.add.reduceat((mins < last[which]).astype(np.int64), np.cumsum(count) - count) > 0
        at = np.flatnonzero(useful)
        ends = np.concatenate(([0], np.cumsum(count[at]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(mins[useful[which]]))
        to = pa.array(at)
        return pa.RecordBatch.from_arrays([t.column(c).take(to).combine_chunks() for c in ("anchor", "seg")] + [pa.array(np.zeros(len(at)), pa.int32()), lists], names=["anchor", "seg", "off", "mins"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.asarray(batch.column("anchor"))
        if size >= GROUP_WORDS:
            last = np.asarray(held[-1].column("anchor"))[-1]
            cut = int(np.argmax(key != last)) if (key != last).any() else len(key)
            held.append(batch.slice(0, cut))
            if cut < len(key):
                yield build(held)
                held, size = [], 0
                batch = batch.slice(cut)
            else:
                batch = batch.slice(0, 0)
        if batch.num_rows:
            held.append(batch)
            size += int(np.asarray(batch.column("count")).sum()) + WINDOW * batch.num_rows
    if held:
        yield build(held)


def _in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that groups end near GROUP_WORDS words."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            yield batch.slice(at, 1000)


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``_id, _t`` (a document: id and hash of its text) and ``runs``: (``lo``, ``mask``) pairs; bit i of
    ``mask`` says that the window from word lo + i also starts in a document with a smaller id.

    A prefix with more than CROWD segments is crowded: its windows are placed by all their
    50 words, so that a group is one deep node and its smallest document an aggregate. This changes
    the plan, not the result.
    """
    body = picked(docs, _id=doc_id, _text=text).select(F.col("_id").cast("long").alias("_id"), "_text", F.xxhash64("_text").alias("_t"))
    body = body.filter("_id is not null")
    drawn = saved(_drawn(body))
    prefixes = drawn.groupBy(F.col("anchor").alias("_p")).agg(F.min("_id").alias("_a"), F.max("_id").alias("_z"), F.count("*").alias("_n"))
    # A prefix seen in one document only holds no repeat.
    prefixes = saved(prefixes.filter("_a < _z").select("_p", (F.col("_n") > CROWD).alias("_crowded")))
    crowds = small(prefixes.filter("_crowded").select("_p"))
    by_prefix = F.col("anchor") == F.col("_p")
    # Equal segments become one. Crowded prefixes leave before the join on prefixes, which they would skew.
    one = lambda rows: rows.groupBy("anchor", "seg").agg(F.min("_id").alias("first"), F.max("_id").alias("last"))
    calm = one(drawn.join(crowds, by_prefix, "left_anti").join(prefixes.select("_p"), by_prefix, "left_semi"))
    trees = _texts(_asked(body, calm)).repartition("anchor").sortWithinPartitions("anchor")
    kept = "anchor long, seg long, off int, mins array<long>"
    # Documents that share an id can give a segment twice.
    trees = in_arrow(trees, lambda batches: _trees(_in_parts(batches)), kept).dropDuplicates(["anchor", "seg", "off"])
    if crowds.limit(1).count():
        wide = saved(_windows(_asked(body, one(drawn.join(crowds, by_prefix, "left_semi")))))
        least = wide.groupBy("w1", "w2").agg(F.min("first").alias("_least"))
        more = wide.join(least, ["w1", "w2"]).filter("_least < last").select("anchor", "seg", "off", F.array("_least").alias("mins"))
        trees = trees.unionByName(more.dropDuplicates(["anchor", "seg", "off"]))
    trees = saved(trees)
    forget(prefixes)
    met = drawn.select("_id", "_t", "anchor", "seg", "lo").join(trees, ["anchor", "seg"])
    zero = F.lit(0).cast("long")
    mask = F.aggregate(
        F.transform("mins", lambda m, i: F.when(m < F.col("_id"), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(zero)),
        zero, lambda a, x: a.bitwiseOR(x),
    )
    met = met.select("_id", "_t", (F.col("lo") + F.col("off")).alias("lo"), mask.alias("mask")).filter("mask != 0")
    runs = saved(met.groupBy("_id", "_t").agg(F.collect_set(F.struct("lo", "mask")).alias("runs")))
    forget(drawn, trees)
    return runs


def _asked(body: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents with the segments that are to be read from them: each from the first that has it."""
    asked = wanted.groupBy("first").agg(F.collect_list(F.struct("anchor", "seg", "last")).alias("asked"))
    return body.join(asked, F.col("_id") == F.col("first")).select("_id", "_text", "asked")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_words, n_removed, kept_sha256, kept_text``.

    Words are runs of characters other than space and 0x09-0x0D, unchanged, of whole texts (null:
    none). A word goes if a window of 50 words that covers it also starts in a document with a
    smaller id; windows are judged on the input. ``kept_text`` joins the kept words by one space and
    ``kept_sha256`` is the lower-case hex digest of its UTF-8. A row with a null id is smaller or
    larger than none: it keeps its words and removes none elsewhere. Rows with one id are one
    document to each other: they take nothing from one another.
    """
    found = repeats(docs, doc_id, text).withColumnsRenamed({"_id": "_i", "_t": "_u"})
    body = picked(docs, _id=doc_id, _text=text).withColumn("_t", F.xxhash64("_text"))
    joined = body.join(found, (F.col("_id").cast("long") == F.col("_i")) & (F.col("_t") == F.col("_u")), "left").select("_id", "_text", "runs")
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                b, offs = text_buffers(batch.column("_text"))
                s, e = spans(b, offs)
                at = np.searchsorted(s, offs)
                lists = batch.column("runs")
                edges = np.zeros(len(s) + 1, np.int64)
                item = lists.flatten()
                if len(item):
                    lengths = np.asarray(lists.value_lengths().fill_null(0))
                    whose = np.repeat(np.arange(batch.num_rows), lengths)
                    lo = np.asarray(item.field("lo")).astype(np.int64) + at[whose]
                    mask = np.asarray(item.field("mask")).view(U64)
                    for i in range(REACH):
                        p = lo[(mask >> U64(i)) & U64(1) == 1] + i
                        np.add.at(edges, p, 1)
                        np.add.at(edges, p + WINDOW, -1)
                gone = np.cumsum(edges[:-1]) > 0
                raw, digests, kept_texts = b.tobytes(), [], []
                for r in range(batch.num_rows):
                    own = slice(at[r], at[r + 1])
                    keep = ~gone[own]
                    kept = b" ".join([raw[p:q] for p, q in zip(s[own][keep].tolist(), e[own][keep].tolist(), strict=True)])
                    digests.append(hashlib.sha256(kept).hexdigest())
                    kept_texts.append(kept.decode("utf-8"))
                n = np.diff(at)
                total = np.concatenate(([0], np.cumsum(gone)))
                cols = [batch.column("_id"), pa.array(n, pa.int64()), pa.array(total[at[1:]] - total[at[:-1]], pa.int64()), pa.array(digests, pa.string()), pa.array(kept_texts, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[doc_id, "n_words", "n_removed", "kept_sha256", "kept_text"])

    return in_arrow(joined, run, f"`{doc_id}` {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string")
