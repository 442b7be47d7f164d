"""Distributed union-find, and the links that hold within the buckets of a locality-sensitive hash."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.llm.tables import in_arrow
from tidewire.llm.text import slices, text_buffers
from tidewire.session import forget, gathered, saved

#: Contracted edges up to which one task (16 bytes an edge) ends the work; above, rounds over all tasks.
ONE_TASK = 400_000
#: Members of a bucket on either side of a block of comparisons, and distinct values that a step of it multiplies.
CHUNK, WIDE = 256, 4096
#: Rows of a piece up to which its pairs are listed; bytes of text and values worked on at once.
SMALL, STEP = 16, 1 << 17
#: A member of a bucket in a pack, parts that packs are dealt to by bucket, and members that a task packs at once.
MEMBER = np.dtype([("bucket", "<i8"), ("id", "<i8"), ("size", "<i4")])
PARTS, PACKED = 4096, 1 << 18
#: Members of one part (20 bytes each) that a task holds to judge them; a larger part goes on without being thinned out.
HELD = 1 << 21
PACKS = "array<struct<part: int, members: binary>>"


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (id, smallest id connected within these batches)."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while x != r:
            up[x], x = r, up.get(x, x)
        return r

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    ids = [x for x in up if root(x) != x]
    for at in range(0, len(ids), 50_000):
        part = ids[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["id", "component"])


def components(links: DataFrame) -> DataFrame:
    """``id, component`` (smallest id reachable) for each id in ``links`` (two long columns) that is
    not its component's smallest. Loops and repeated or reversed links do no harm; no links, no rows.

    Each task first contracts its own links. While many are left, every node points at its smallest
    neighbour, pointers are followed to their ends, and links are redrawn between those.
    """
    a, b = links.columns
    edges = saved(gathered(in_arrow(links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")), _forest, "id long, component long")))
    known = None
    while edges.count() > ONE_TASK:
        both = edges.union(edges.select("component", "id"))
        point = saved(both.groupBy("id").agg(F.min("component").alias("to")).filter("to < id"))
        while True:
            point = saved(_followed(point, point).withColumn("_moved", F.col("_on").isNotNull()).drop("_on"))
            still = point.filter("_moved").limit(1).count()
            point = point.drop("_moved")
            if not still:
                break
        known = point if known is None else saved(_followed(known, point).drop("_on").unionByName(point))
        a = _followed(edges.select("component", F.col("id").alias("to")), point).select(F.col("to").alias("a"), "component")
        b = _followed(a.select("a", F.col("component").alias("to")), point).select("a", F.col("to").alias("b"))
        edges = saved(in_arrow(b.filter("a != b").distinct(), _forest, "id long, component long"))
    last = saved(in_arrow(edges.coalesce(1), _forest, "id long, component long"))
    if known is None:
        return last
    point = last.withColumnRenamed("component", "to")
    return saved(_followed(known, point).drop("_on").unionByName(point)).withColumnRenamed("to", "component")


def _followed(rows: DataFrame, point: DataFrame) -> DataFrame:
    """``rows`` with ``to`` moved to where ``point`` (``id, to``) sends it; ``_on`` is null where it does not."""
    on = point.select(F.col("id").alias("_k"), F.col("to").alias("_on"))
    met = rows.join(on, F.col("to") == F.col("_k"), "left").drop("_k")
    return met.withColumn("to", F.coalesce("_on", "to"))


#: From a column of texts: the distinct values of each, ascending, joined up, and their offsets.
Items = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def packs(members: np.ndarray, rows: int) -> pa.Array:
    """A column (PACKS) of ``rows`` values whose last one holds ``members`` (of MEMBER) by part of their bucket; the others are null."""
    part = (members["bucket"].view(np.uint64) // np.uint64((1 << 64) // PARTS)).astype(np.int16)
    order = np.argsort(part, kind="stable")
    part, members = part[order], members[order]
    begin = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])
    at = (np.append(begin, len(part)) * MEMBER.itemsize).astype(np.int32)
    data = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(members.tobytes())])
    item = pa.StructArray.from_arrays([pa.array(part[begin], pa.int32()), data], names=["part", "members"])
    offs = np.zeros(rows + 1, np.int32)
    offs[-1] = len(item)
    return pa.ListArray.from_arrays(pa.array(offs, mask=np.arange(rows + 1) < rows - 1), item)


def _ordered(members: np.ndarray) -> np.ndarray:
    """Distinct members by bucket, size and id."""
    b, i, n = (np.ascontiguousarray(members[c]) for c in ("bucket", "id", "size"))
    order = np.lexsort((i, n, b))
    b, i, n = b[order], i[order], n[order]
    new = np.append(True, (b[1:] != b[:-1]) | (i[1:] != i[:-1]) | (n[1:] != n[:-1]))[: len(b)]
    return members[order[new]]


def _neighbours(members: np.ndarray, least: float) -> np.ndarray:
    """Distinct members that have a neighbour of like size in their bucket (see :func:`linked`)."""
    b = np.ascontiguousarray(members["bucket"])
    once = np.sort(b)
    more = once[1:][once[1:] == once[:-1]]  # most buckets hold one member
    if not len(more):
        return members[:0]
    held = _ordered(members[more[np.minimum(np.searchsorted(more, b), len(more) - 1)] == b])
    b, i, n = held["bucket"], held["id"], held["size"]
    fits = (b[1:] == b[:-1]) & (i[1:] != i[:-1]) & (n[:-1] >= n[1:] * least)
    return held[np.append(False, fits) | np.append(fits, False)]


def _unpacked(packed: DataFrame, least: float) -> DataFrame:
    """``bucket, id, size`` of packed members (``part, members``) with a neighbour of like size in their bucket.

    A part of more than half of HELD distinct members is not thinned out: all of it goes on, some perhaps repeated."""

    def rows(members: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(members), 100_000):
            some = members[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(some[c])) for c in MEMBER.names], names=list(MEMBER.names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, whole = np.zeros(0, MEMBER), None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            part = np.asarray(batch.column("part"))
            data, offs = text_buffers(batch.column("members"))
            members, offs = np.frombuffer(data, MEMBER), offs // MEMBER.itemsize
            if part[-1] == last:
                held = np.concatenate((held, members))
            else:
                # Parts lie in order: all but the last one end here.
                first, begin = 0, int(offs[np.searchsorted(part, part[-1])])
                if not whole:
                    first = int(offs[np.searchsorted(part, last, "right")])
                    yield from rows(_ordered(np.concatenate((held, members[:first]))))
                    held = held[:0]
                yield from rows(_neighbours(np.concatenate((held, members[first:begin])), least))
                held, last, whole = members[begin:], part[-1], True
            if len(held) > HELD:
                held = _ordered(held)
                if not whole or len(held) > HELD // 2:
                    yield from rows(held)
                    held, whole = held[:0], False
        yield from rows(_neighbours(held, least) if whole else _ordered(held))

    dealt = packed.repartition("part").sortWithinPartitions("part")
    return in_arrow(dealt, run, "bucket long, id long, size int")


def _met(members: DataFrame, least: float) -> DataFrame:
    """Distinct members that have a neighbour (of like size) in their bucket."""
    keys = [c for c in ("bucket", "id", "size") if c in members.columns]
    order = keys[:0:-1]
    by = W.partitionBy("bucket").orderBy(*order)
    partner = lambda far: (F.lag if far < 0 else F.lead)(F.struct(*order)).over(by)
    seen = members.select(*keys).withColumn("_a", partner(-1)).withColumn("_z", partner(1))

    def fits(c: str) -> Column:
        other = F.col(f"{c}.id") != F.col("id")
        if "size" not in keys:
            return F.coalesce(other, F.lit(False))
        return F.coalesce(other & (F.least("size", f"{c}.size") >= F.greatest("size", f"{c}.size") * F.lit(least)), F.lit(False))

    # Repeated rows lie next to each other; the last of them sees the next member, the first the one before.
    return seen.filter(fits("_a") | fits("_z")).select(*keys).distinct()


def linked(members: DataFrame, texts_of: Callable[[DataFrame], DataFrame], items: Items, least: float, chunk: int | None = None) -> DataFrame:
    """Components (see :func:`components`) of the pairs that share a bucket and are similar.

    ``members`` has ``bucket, id`` (long) and may have ``size`` (int): then pairs whose sizes differ by more
    than the factor ``least`` cannot be similar, and a member whose neighbours by size in its bucket do
    meets no one there. Members with sizes may also come in packs (``part, members``, see :func:`packs`).
    ``texts_of`` takes a table of ids (``id``) and returns ``id,
    text``, of which ``items`` makes sets; similar is a Jaccard of at least ``least``. First all
    members meet their bucket's most central one (that whose buckets hold most). In buckets that
    then hold several components, every member outside the largest one meets all members of others,
    in blocks of chunks (of ``chunk`` members or so). So every pair of a bucket is confirmed, refuted or already connected.
    """
    held = saved(gathered(_unpacked(members, least) if "part" in members.columns else _met(members, least)))
    keys = [c for c in ("bucket", "id", "size") if c in held.columns]
    size = held.groupBy(F.col("bucket").alias("_b")).agg(F.count("*").alias("_n"))
    score = held.join(size, F.col("bucket") == F.col("_b")).groupBy(F.col("id").alias("_i")).agg(F.sum("_n").alias("_score"))
    first, held = held, saved(gathered(held.join(score, F.col("id") == F.col("_i")).select(*keys, "_score")))
    forget(first)
    lead = held.groupBy("bucket").agg(F.max(F.struct("_score", *keys[1:])).alias("_lead"))
    star = held.join(lead, "bucket").filter(F.col("id") != F.col("_lead.id"))
    if "size" in keys:
        star = star.filter(F.least("size", "_lead.size") >= F.greatest("size", "_lead.size") * F.lit(least))
    pairs = saved(gathered(star.select(F.least("id", "_lead.id").alias("a"), F.greatest("id", "_lead.id").alias("b")).distinct()))
    links = saved(gathered(alike(pairs, texts_of(_ends(pairs)), items, least)))
    forget(pairs)
    found = components(links)
    now = held.join(found, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("c"))
    parts = now.groupBy("bucket", "c").agg(F.count("*").alias("n"))
    main = parts.groupBy("bucket").agg(F.max(F.struct("n", "c")).alias("_main"), F.count("*").alias("_k"), F.sum("n").alias("_all"))
    main = main.filter("_k > 1 and _all > 2").select("bucket", F.col("_main.c").alias("_main"), "_all", (F.col("_all") - F.col("_main.n")).alias("_odd"))
    now = saved(gathered(now.join(main, "bucket")))
    forget(held)
    if not now.limit(1).count():
        return found
    more = saved(gathered(_blocks(now, texts_of(now.select("id").distinct()), items, least, chunk or CHUNK)))
    forget(now)
    return components(links.select("a", "b").union(more))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()


def _blocks(members: DataFrame, texts: DataFrame, items: Items, least: float, chunk: int) -> DataFrame:
    """Links between members outside the largest component of a bucket and members of other components."""
    rows, odds = F.ceil(F.col("_all") / chunk), F.ceil(F.col("_odd") / chunk)
    put = lambda i, j, left: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), F.lit(left).alias("left"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    right = F.transform(upto(odds), lambda i: put(i, F.pmod(F.xxhash64("id"), rows), False))
    left = F.transform(upto(rows), lambda j: put(F.pmod(F.xxhash64("id"), odds), j, True))
    dealt = members.withColumn("p", F.explode(F.when(F.col("c") != F.col("_main"), F.concat(left, right)).otherwise(right)))
    dealt = dealt.select(F.xxhash64("bucket", "p.i", "p.j").alias("piece"), F.col("p.left").alias("left"), "id", "c")
    work = dealt.join(texts, "id").select("piece", "left", "id", "c", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for whole in batches:
            for batch in slices(whole, "text", STEP):
                if held:
                    # Pieces are whole when compared: rows that go on with the last piece join it.
                    piece, last = np.asarray(batch.column("piece")), held[-1].column("piece")[-1].as_py()
                    cut = int(np.argmax(piece != last)) if (piece != last).any() else len(piece)
                    held.append(batch.slice(0, cut))
                    if cut == len(piece):
                        continue
                    yield from _forest(_compared(held, items, least))
                    batch = batch.slice(cut)
                held = [batch]
        if held:
            yield from _forest(_compared(held, items, least))

    return in_arrow(work.repartition("piece").sortWithinPartitions("piece"), run, "id long, component long")


def _compared(rows: list[pa.RecordBatch], items: Items, least: float) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of whole pieces: pairs of small ones by merging sets, large ones by matrix products."""
    t = pa.Table.from_batches(rows).combine_chunks()
    piece, left, ids, comp = (np.asarray(t.column(c)) for c in ("piece", "left", "id", "c"))
    own, at, place = np.unique(ids, return_index=True, return_inverse=True)
    values, offs = items(t.column("text").combine_chunks().take(pa.array(at)))
    size = np.diff(offs)[place]
    begin = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
    n = np.diff(np.append(begin, len(piece)))
    x = y = np.zeros(0, np.int64)
    order = np.lexsort((~left, np.repeat(np.arange(len(n)), n)))
    n_left = np.add.reduceat(left.astype(np.int64), begin)
    few = n <= SMALL
    group, i, j = every_pair(np.where(few, n_left, 0), np.where(few, n - n_left, 0))
    x, y = order[begin[group] + i], order[begin[group] + n_left[group] + j]
    use = (comp[x] != comp[y]) & (np.minimum(size[x], size[y]) >= least * np.maximum(size[x], size[y]))
    pairs = np.unique(np.sort(np.stack((place[x[use]], place[y[use]]), 1), axis=1), axis=0)
    p, q = pairs[:, 0], pairs[:, 1]
    both, sizes = intersections(values, offs, p, q), np.diff(offs)
    hit = both >= least * (sizes[p] + sizes[q] - both)
    found = [(own[p[hit]], own[q[hit]])]
    for b, k in zip(begin[~few], n[~few], strict=True):
        at = slice(b, b + k)
        found.append(_products(values, offs, place[at], left[at], comp[at], own, least))
    for a, b in found:
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def every_pair(n_left: np.ndarray, n_right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (group, left place, right place) of groups with the given numbers of left and right rows."""
    total = n_left * n_right
    group = np.repeat(np.arange(len(total)), total)
    k = np.arange(len(group)) - np.repeat(np.cumsum(total) - total, total)
    width = np.maximum(n_right, 1)[group]
    return group, k // width, k % width


def intersections(values: np.ndarray, offs: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets i and j (ascending distinct values between offsets), by sorting
    (pair, top 48 bits of the value)."""
    size = np.diff(offs)
    out = np.zeros(len(i), np.int64)
    upto, at = np.cumsum(size[i] + size[j]), 0
    while at < len(i):
        to = min(at + 65_535, max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + STEP, "right"))))
        keys = []
        for rows in (i[at:to], j[at:to]):
            k, n = np.repeat(np.arange(to - at), size[rows]), size[rows]
            pos = np.arange(len(k)) + np.repeat(offs[rows] - (np.cumsum(n) - n), n)
            keys.append((k.astype(np.uint64) << np.uint64(48)) | (values[pos] >> np.uint64(16)))
        both = np.sort(np.concatenate(keys), kind="stable")  # two ascending runs: a merge
        same = both[1:] == both[:-1]
        out[at:to] = np.bincount((both[1:][same] >> np.uint64(48)).astype(np.int64), minlength=to - at)
        at = to
    return out


def _products(values, offs, place, left, comp, own, least) -> tuple[np.ndarray, np.ndarray]:
    """Links of one large piece, from products of its left and right incidence matrices."""
    size = np.diff(offs)[place]
    owner = np.repeat(np.arange(len(place)), size)
    pos = np.arange(len(owner)) + np.repeat(offs[place] - (np.cumsum(size) - size), size)
    _, code, count = np.unique(values[pos], return_inverse=True, return_counts=True)
    shared = count[code] > 1
    code, owner = code[shared], owner[shared]
    code = np.unique(code, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    x, y = np.flatnonzero(left), np.flatnonzero(~left)
    both = np.zeros((len(x), len(y)))
    to = np.empty(len(place), np.int64)
    to[x], to[y] = np.arange(len(x)), np.arange(len(y))
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, WIDE):
        a, b = np.searchsorted(code, (lo, lo + WIDE))
        mine, who = code[a:b] - lo, owner[a:b]
        p, q = np.zeros((len(x), WIDE), np.float32), np.zeros((len(y), WIDE), np.float32)
        p[to[who[left[who]]], mine[left[who]]] = 1
        q[to[who[~left[who]]], mine[~left[who]]] = 1
        both += p @ q.T
    hit = both >= least * (size[x][:, None] + size[y][None, :] - both)
    hit &= comp[x][:, None] != comp[y][None, :]
    i, j = np.nonzero(hit)
    return own[place[x[i]]], own[place[y[j]]]


def alike(pairs: DataFrame, texts: DataFrame, items: Items, least: float) -> DataFrame:
    """Pairs ``a, b`` whose sets (``items`` of ``texts``) have a Jaccard of at least ``least``."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "x", STEP):
                a, b = np.asarray(batch.column("a")), np.asarray(batch.column("b"))
                _, at, place = np.unique(np.concatenate((a, b)), return_index=True, return_inverse=True)
                both = pa.chunked_array([batch.column("x"), batch.column("y")]).combine_chunks()
                values, offs = items(both.take(pa.array(at)))
                i, j, size = place[: len(a)], place[len(a) :], np.diff(offs)
                fits = np.flatnonzero(np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j]))
                n = intersections(values, offs, i[fits], j[fits])
                keep = pa.array(fits[n >= least * (size[i[fits]] + size[j[fits]] - n)])
                yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])

    met = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return in_arrow(met, run, "a long, b long")
