"""Operator 8: fuzzy line dedup by MinHash over character shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.components import MEMBER, PACKED, PACKS, linked, packs
from tidewire.llm.tables import in_arrow, numbered, picked, small
from tidewire.llm.text import BASE, SPACE, U64, Seen, hash_spans, mix, powers, slices, text_buffers
from tidewire.session import forget, gathered, merged, saved

SHINGLE, SIMILARITY = 6, 0.8
#: 10 bands of 4 bins: lines at 0.8 share a band with probability 0.995.
BANDS, ROWS = 10, 4
BINS = BANDS * ROWS
#: Rows of a few longs each up to which a counted table is broadcast.
IDS = 500_000
#: Lines on either side of a block of comparisons.
CHUNK = 1024
#: Line numbers (4 to 16 bytes each) up to which lists of them are broadcast.
LISTED = 2_000_000


def lines_of(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes), row and number in its row of every line; rows are cut at each line feed."""
    feed = np.flatnonzero(b == 0x0A)
    starts = np.sort(np.concatenate((offs[:-1], feed + 1)))
    ends = np.sort(np.concatenate((offs[1:], feed)))
    counts = np.bincount(np.searchsorted(offs[1:], feed, "right"), minlength=len(offs) - 1)[: len(offs) - 1] + 1
    row = np.repeat(np.arange(len(counts)), counts)
    return starts, ends, row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _characters(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the bytes, and line spans counted in characters."""
    points = np.frombuffer(b.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    inner = np.flatnonzero((b & 0xC0) == 0x80)
    return points, starts - np.searchsorted(inner, starts), ends - np.searchsorted(inner, ends)


def _hashed(points: np.ndarray) -> np.ndarray:
    """Hash of the six characters from each place; places near the end hold fewer.

    Low seven bits of a character fill a byte each; what lies above is rare and is added where it occurs."""
    n = len(points)
    low = np.zeros(n + 8, np.uint8)
    low[:n] = points & np.uint32(0x7F)
    out = np.ndarray((n,), "<u8", low, 0, (1,)) & U64((1 << 8 * SHINGLE) - 1)
    high = np.flatnonzero(points > 0x7F)
    rest = (points[high] >> np.uint32(7)).astype(U64)
    for k, p in enumerate(powers(BASE, SHINGLE + 1)[1:]):
        at = slice(int(np.searchsorted(high, k)), None)
        out[high[at] - k] += rest[at] * p
    out *= U64(BASE)
    out ^= out >> U64(32)
    out *= U64(0xBF58476D1CE4E5B9)
    return out


def _shingled(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Six-character shingles of each line (48-bit hashes below the line's number modulo 65,536), ascending in
    each line, repeats included, and the lines' offsets; a shorter line is one shingle."""
    size, n = ends - starts, len(starts)
    counts = np.where(size >= SHINGLE, size - SHINGLE + 1, np.minimum(size, 1))
    keys = _hashed(points)
    short = np.flatnonzero((size > 0) & (size < SHINGLE))
    keys[starts[short]] = mix(_short(points, starts[short], size[short]) ^ U64(SHINGLE))
    # Runs of places that begin no shingle and of those that do, in turn.
    runs = np.zeros(2 * n + 1, np.int64)
    runs[1::2] = counts
    runs[::2] = np.append(starts, len(points)) - np.append(0, starts + counts)
    own = keys[np.repeat(np.arange(2 * n + 1) % 2 == 1, runs)]
    own >>= U64(16)
    own |= np.repeat((np.arange(n, dtype=U64) & U64(0xFFFF)) << U64(48), counts)
    offs = np.concatenate(([0], np.cumsum(counts)))
    for at in range(0, n, 65_536):
        own[offs[at] : offs[min(at + 65_536, n)]].sort()
    return own, offs


def _distinct(keys: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys that differ from the one before them in their line, and the lines' offsets into those."""
    new = np.empty(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    new[offs[offs < len(keys)]] = True
    places = np.flatnonzero(new)
    return places, np.searchsorted(places, offs)


def line_items(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct six-character shingles (48-bit hashes, in the top bits) of each text; a shorter text is one shingle."""
    b, offs = text_buffers(column)
    keys, offs = _shingled(*_characters(b, offs[:-1], offs[1:]))
    keys <<= U64(16)
    places, offs = _distinct(keys, offs)
    return keys[places], offs


def _short(points: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of lines of fewer characters than a shingle."""
    own = np.zeros(len(starts), U64)
    for j, p in enumerate(powers(BASE, SHINGLE)):
        inside = size > j
        own[inside] += (points[starts[inside] + j].astype(U64) + U64(1)) * p
    return own


def sizes_and_bands(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct six-character shingles of each line, as :func:`line_items` counts them, and the bands of a
    one-permutation MinHash (BINS bins) of them.

    A bin is a range of hashes: where it begins among a line's ascending ones lies its least. An empty bin
    takes the value of a seeded other one."""
    n, none = len(starts), np.uint32(0xFFFFFFFF)
    keys, offs = _shingled(points, starts, ends)
    sizes = np.diff(_distinct(keys, offs)[1])
    edges = (np.arange(BINS, dtype=U64) << U64(48)) // U64(BINS)
    bins = np.full((n, BINS), none)
    for lo in range(0, n, 65_536):
        hi = min(lo + 65_536, n)
        part = keys[offs[lo] : offs[hi]]
        at = np.searchsorted(part, ((np.arange(hi - lo, dtype=U64) << U64(48))[:, None] + edges).ravel())
        held = np.flatnonzero(at < np.append(at[1:], len(part)))
        bins[lo:hi].reshape(-1)[held] = (part[at[held]] >> U64(16)).astype(np.uint32)
    step, first = 0, bins.copy()
    rows = np.flatnonzero((bins == none).any(1) & (bins != none).any(1))
    while len(rows):
        step += 1
        jump = (mix(np.arange(BINS, dtype=U64) + U64(step << 8)) % U64(BINS)).astype(np.int64)
        part, donor = bins[rows], first[rows][:, jump]
        salted = (mix(donor + np.arange(BINS, dtype=U64) * U64(BASE)) >> U64(33)).astype(np.uint32)
        bins[rows] = np.where((part == none) & (donor != none), salted, part)
        rows = rows[(bins[rows] == none).any(1)]
    out = np.zeros((n, BANDS), U64)
    for j, p in enumerate(powers(0xD6E8FEB86659FD93, ROWS + 1)[1:]):
        out += (bins.reshape(n, BANDS, ROWS)[:, :, j].astype(U64) + U64(1)) * p
    return sizes, mix(mix(out) + np.arange(BANDS, dtype=U64) * U64(BASE))


def _blank(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Lines without ink; lines that begin with a space are looked through."""
    out = starts == ends
    some = np.flatnonzero(~out)
    some = some[SPACE[b[starts[some]]]]
    out[some] = [bool(SPACE[b[s:e]].all()) for s, e in zip(starts[some], ends[some], strict=True)]
    return out


def _sketches(docs: DataFrame) -> DataFrame:
    """Per line with ink: ``_id, _t`` (of its document), ``n`` (its number), ``line`` (hash), ``given`` (once per line
    and task, see :class:`Seen`) and, in some rows, ``packs`` of the given lines, by band, with their sizes (distinct shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, names = Seen(), ["_id", "_t", "n", "line", "given", "packs"]
        last: list[pa.Array] = []
        members = np.zeros(0, MEMBER)
        for whole in batches:
            for batch in slices(whole, "_text"):
                b, offs = text_buffers(batch.column("_text"))
                starts, ends, row, number = lines_of(b, offs)
                ink = ~_blank(b, starts, ends)
                if not ink.any():
                    continue
                starts, ends, row, number = starts[ink], ends[ink], row[ink], number[ink]
                hashes = hash_spans(b, starts, ends)
                first = seen.new(hashes)
                points, s, e = _characters(b, starts, ends)
                sizes, bands = sizes_and_bands(points, s[first], e[first])
                new = np.empty(bands.size, MEMBER)
                new["bucket"], new["id"], new["size"] = bands.ravel().view(np.int64), np.repeat(hashes[first].view(np.int64), BANDS), np.repeat(sizes, BANDS)
                given = np.zeros(len(hashes), bool)
                given[first] = True
                if last:
                    # The task's last rows wait, to carry the members that are left.
                    full = len(members) >= PACKED
                    yield pa.RecordBatch.from_arrays([*last, packs(members if full else members[:0], len(last[0]))], names=names)
                    members = members[:0] if full else members
                members = np.concatenate((members, new))
                to = pa.array(row)
                last = [batch.column("_id").take(to), batch.column("_t").take(to), pa.array(number, pa.int32()), pa.array(hashes.view(np.int64)), pa.array(given)]
        if last:
            yield pa.RecordBatch.from_arrays([*last, packs(members, len(last[0]))], names=names)

    kind = dict(docs.dtypes)["_id"]
    return in_arrow(docs, run, f"_id {kind}, _t long, n int, line long, given boolean, packs {PACKS}")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``id, text`` of the lines in ``wanted`` (``line`` and one place of it: ``_id, _t, n``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                b, offs = text_buffers(batch.column("_text"))
                starts, ends, row, _ = lines_of(b, offs)
                head = np.searchsorted(row, np.arange(batch.num_rows))
                asked = batch.column("asked")
                item = asked.flatten()
                places = np.repeat(head, np.diff(np.asarray(asked.offsets))) + np.asarray(item.field("n"))
                ids = np.asarray(item.field("line"))
                keep = hash_spans(b, starts[places], ends[places]).view(np.int64) == ids
                raw = [b[p:q].tobytes().decode("utf-8") for p, q in zip(starts[places[keep]], ends[places[keep]], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(raw, pa.string())], names=["id", "text"])

    asked = saved(gathered(wanted.groupBy("_id", "_t").agg(F.collect_list(F.struct("n", "line")).alias("asked"))))
    a = small(asked.withColumnsRenamed({"_id": "_i", "_t": "_u"}), LISTED, F.size("asked"))
    met = docs.join(a, docs["_id"].eqNullSafe(a["_i"]) & (docs["_t"] == a["_u"])).select("_text", "asked")
    return in_arrow(met, run, "id long, text string")


def repeated_lines(docs: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines to remove: ``_id, _t`` (the document: its id and the hash of its text) and ``removed`` (line
    numbers from 0, ascending), for documents that lose any.

    Texts are cut at line feeds. Lines whose sets of six-character shingles have Jaccard of at least
    ``similarity`` (a shorter line is one shingle) are linked; of what links connect, copies included,
    the line first by (doc_id, number) stays, a null id before all. Blank lines and null texts are
    left alone. Documents that are equal in id and text lose the same lines, those that repeat
    between them included only if an earlier document has them.
    """
    body = picked(docs, _id=doc_id, _text=text).withColumn("_t", F.xxhash64("_text"))
    drawn = saved(merged(_sketches(body), body))
    members = drawn.filter(F.size("packs") > 0).select(F.explode("packs").alias("p")).select("p.part", "p.members")
    places = drawn.filter("given").select("line", "_id", "_t", "n")

    def texts_of(ids: DataFrame) -> DataFrame:
        # Texts are cut out anew where they are used: they go to their join without being written as files.
        place = F.min(F.struct("_id", "_t", "n")).alias("p")
        met = places.join(small(saved(gathered(ids.withColumnRenamed("id", "line"))), IDS), "line", "left_semi")
        return _texts(body, met.groupBy("line").agg(place).select("line", "p._id", "p._t", "p.n"))

    found = linked(members, texts_of, line_items, similarity, CHUNK)
    f = small(found.select(F.col("id").alias("_k"), "component"), IDS)
    rows = drawn.select("_id", "_t", "n", "line").join(f, F.col("line") == F.col("_k"), "left")
    rows = saved(gathered(rows.select("_id", "_t", "n", F.coalesce("component", "line").alias("g"))))
    forget(drawn)
    # A group's first document, then that document's first line of the group; both combine before the shuffle.
    docs_of = rows.groupBy("g").agg(F.min("_id").alias("_i"), F.sum(F.col("_id").isNull().cast("int")).alias("_nulls"), F.count("*").alias("_n"))
    docs_of = saved(gathered(docs_of.filter("_n > 1").select(F.col("g").alias("_g"), F.when(F.col("_nulls") == 0, F.col("_i")).alias("_i"))))
    held = saved(gathered(rows.join(small(docs_of, IDS), F.col("g") == F.col("_g"))))
    forget(rows)
    firsts = held.filter(F.col("_id").eqNullSafe(F.col("_i"))).groupBy(F.col("g").alias("_h")).agg(F.min(F.struct("n", "_t")).alias("_first"))
    lost = held.join(small(saved(gathered(firsts)), IDS), F.col("g") == F.col("_h")).filter(
        ~(F.col("_id").eqNullSafe(F.col("_i")) & (F.col("n") == F.col("_first.n")) & (F.col("_t") == F.col("_first._t")))
    )
    return lost.groupBy("_id", "_t").agg(F.sort_array(F.collect_set("n")).alias("removed"))


def dedup_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_lines`` (null text: 0), ``n_removed`` and ``removed`` (line numbers)."""
    lost = repeated_lines(docs, doc_id=doc_id, text=text).withColumnsRenamed({"_id": "_i", "_t": "_u"})
    feeds = F.octet_length("_text") - F.octet_length(F.replace(F.col("_text"), F.lit("\n"), F.lit("")))
    n = F.coalesce(feeds + 1, F.lit(0))
    own = picked(docs, _id=doc_id, _text=text).select("_id", F.xxhash64("_text").alias("_t"), n.alias("n_lines"))
    out = own.join(lost, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_t") == F.col("_u")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return out.select(F.col("_id").alias(doc_id), "n_lines", F.size(removed).alias("n_removed"), removed.alias("removed"))


def _without(lines: Column, numbers: Column) -> Column:
    """``lines`` without those of the given numbers (ascending, from 0): the runs between them, in linear time."""
    before = lambda i: F.when(i == 0, 0).otherwise(F.get(numbers, i - 1) + 1)
    upto = lambda i, n: F.when(i == F.size(numbers), n).otherwise(F.get(numbers, i))
    # The outer transform gives the array a name, so that it is made once.
    runs = F.transform(
        F.array(lines),
        lambda x: F.flatten(F.transform(F.sequence(F.lit(0), F.size(numbers)), lambda i: F.slice(x, before(i) + 1, upto(i, F.size(x)) - before(i)))),
    )
    return F.get(runs, F.lit(0))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` with the repeated lines out of ``text``; a document that loses every line with ink goes.

    Null and blank texts stay as they are. Repeated rows lose the same lines (see :func:`repeated_lines`).
    Columns of any name are kept as they are.
    """
    lost = saved(gathered(repeated_lines(docs, doc_id=doc_id, text=text).withColumnsRenamed({"_id": "_i", "_t": "_u"})))
    lost = small(lost, LISTED, F.size("removed"))
    body, at = numbered(docs)
    own = F.col(at[text])
    joined = body.join(lost, F.col(at[doc_id]).eqNullSafe(F.col("_i")) & (F.xxhash64(own) == F.col("_u")), "left")
    kept = F.array_join(_without(F.split(own, "\n"), F.col("removed")), "\n")
    changed = F.when(F.col("removed").isNull(), own).otherwise(kept)
    out = joined.withColumn(at[text], changed).filter(F.col("removed").isNull() | own.rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*body.columns).toDF(*docs.columns)
