"""Operator 4: near-duplicate embeddings by lattice hashing with E8."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.components import _forest, components, every_pair
from tidewire.llm.e8 import neighbourhood, products
from tidewire.llm.tables import in_arrow, picked
from tidewire.llm.text import BASE, U64, mix, powers
from tidewire.session import saved

COSINE = 0.95
TABLES, PROBES, SEED = 4, 4, 4
#: Lattice cells per table are those of ``blocks`` projections to 8 dimensions, each scaled by its width: with
#: more blocks unlike vectors meet less often, in more cells. A pair at cosine 0.95 meets in a table with
#: probability 0.86, in some table with 0.9997 (simulated). BLOCKS holds at every size, so that whether a
#: pair meets depends on its vectors alone.
WIDTH = {1: 1.6, 2: 2.0, 3: 2.4}
BLOCKS = 2
#: Residents or visitors of a cell in one piece of work; larger cells are cut into pairs of chunks.
CHUNK = 256
PAIRS = 1 << 17
WORK = 400_000


def units(values: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, large and tiny components included."""
    v = values.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def cells(u: np.ndarray, blocks: int) -> np.ndarray:
    """n x TABLES x (1 + PROBES)**blocks hashed cells of unit vectors; the first of each table is home. A
    vector's cells are the same in any batch, so that they need not travel with it."""
    n, dim = u.shape
    out = np.empty((n, TABLES, (1 + PROBES) ** blocks), U64)
    for t in range(TABLES):
        joint = np.full((n, 1), mix(np.array([t * 1_000_003 + dim], U64))[0])
        for b in range(blocks):
            draw = np.random.default_rng([SEED, t, b, dim]).normal(size=(dim, 8)) / WIDTH[blocks]
            points = np.rint(neighbourhood(products(u, draw), PROBES) * 2).astype(np.int64).view(U64)
            own = mix((points * powers(BASE, 9)[1:]).sum(axis=2, dtype=U64) + U64(b))
            joint = mix(joint[:, :, None] * U64(BASE) + own[:, None, :]).reshape(n, -1)
        out[:, t] = joint
    return out


def _placed(classes: DataFrame, blocks: int) -> DataFrame:
    """A row per class, table and cell it lives in (resident) or probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                lists = batch.column("embedding")
                dims = np.asarray(lists.value_lengths())
                for dim in np.unique(dims):
                    rows = np.flatnonzero(dims == dim)
                    raw = np.asarray(lists.take(pa.array(rows)).flatten()).reshape(len(rows), dim)
                    c = cells(units(raw), blocks).reshape(len(rows), -1)
                    per = c.shape[1]
                    who = pa.array(np.repeat(rows, per))
                    home = np.tile(np.arange(per) % (per // TABLES) == 0, len(rows))
                    cols = [pa.array(c.ravel().view(np.int64)), pa.array(home), batch.column("id").take(who)]
                    yield pa.RecordBatch.from_arrays(cols, names=["cell", "home", "id"])

    return in_arrow(classes.select("id", "embedding"), run, "cell long, home boolean, id long")


def _linker(cosine: float, blocks: int):
    """Work on whole pieces (rows come sorted by piece): count and connect the links found there."""

    per = (1 + PROBES) ** blocks

    def cells_of(vectors: list[np.ndarray]) -> np.ndarray:
        out, dims = np.empty((len(vectors), TABLES, per), U64), np.array([len(v) for v in vectors])
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            for lo in range(0, len(at), 2000):
                out[at[lo : lo + 2000]] = cells(units(np.stack([vectors[i] for i in at[lo : lo + 2000]])), blocks)
        return out.view(np.int64)

    def compare(t: dict[str, np.ndarray], vec: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        values, offs = np.asarray(vec.values), np.asarray(vec.offsets)
        vector = lambda r: values[offs[r] : offs[r + 1]]
        piece, left = t["piece"], t["left"]
        begin = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
        n = np.diff(np.append(begin, len(piece)))
        n_left = np.add.reduceat(left.astype(np.int64), begin) if len(begin) else n
        found: list[tuple[np.ndarray, np.ndarray]] = []
        # Rows of a piece are sorted left before right.
        at = 0
        while at < len(begin):
            size = np.cumsum(n_left[at:] * (n - n_left)[at:] + n_left[at:] ** 2)
            to = at + max(1, int(np.searchsorted(size, PAIRS, "right")))
            b, nl, nr = begin[at:to], n_left[at:to], (n - n_left)[at:to]
            g, i, j = every_pair(nl, nr)
            x, y = b[g] + i, b[g] + nl[g] + j
            g, i, j = every_pair(nl, nl)
            same = (i < j) & t["alone"][b[g]]
            x, y = np.concatenate((x, (b[g] + i)[same])), np.concatenate((y, (b[g] + j)[same]))
            other = t["id"][x] != t["id"][y]
            x, y = x[other], y[other]
            if len(x):
                rows, place = np.unique(np.concatenate((x, y)), return_inverse=True)
                u = [units(vector(r)[None])[0] for r in rows]
                dims = np.array([len(v) for v in u])
                p, q = place[: len(x)], place[len(x) :]
                fits = dims[p] == dims[q]
                x, y, p, q = x[fits], y[fits], p[fits], q[fits]
                width = dims.max()
                flat = np.zeros((len(u), width))
                for r, v in enumerate(u):
                    flat[r, : len(v)] = v
                dots = np.empty(len(x))
                for lo in range(0, len(x), 1 << 15):
                    dots[lo : lo + (1 << 15)] = np.einsum("nd,nd->n", flat[p[lo : lo + (1 << 15)]], flat[q[lo : lo + (1 << 15)]])
                hit = dots >= cosine
                x, y = x[hit], y[hit]
                if len(x):
                    at_rows, place = np.unique(np.concatenate((x, y)), return_inverse=True)
                    # Rows of one id are one vector: its cells are found once.
                    ids, at_id, of_row = np.unique(t["id"][at_rows], return_index=True, return_inverse=True)
                    own = cells_of([vector(at_rows[i]) for i in at_id])
                    place = of_row[place]
                    for lo in range(0, len(x), 1 << 13):
                        s = slice(lo, lo + (1 << 13))
                        a, z = own[place[: len(x)][s]], own[place[len(x) :][s]]
                        # A pair counts where it meets first: in the lowest table, at the home of the smaller id if the other comes there.
                        swap = t["id"][x[s]] > t["id"][y[s]]
                        a, z = np.where(swap[:, None, None], z, a), np.where(swap[:, None, None], a, z)
                        fa, fz = (a[:, :, :1] == z).any(2), (z[:, :, :1] == a).any(2)
                        table = (fa | fz).argmax(1)
                        k = np.arange(len(table))
                        cell = np.where(fa[k, table], a[k, table, 0], z[k, table, 0])
                        first = cell == t["cell"][x[s]]
                        found.append((x[s][first], y[s][first]))
            at = to
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(z) for z in zip(*found, strict=True))

    def flush(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).combine_chunks()
        t = {c: np.asarray(table.column(c)) for c in ("piece", "left", "alone", "id", "m", "cell")}
        chunk = lambda c: table.column(c).combine_chunks() if not isinstance(table.column(c), pa.Array) else table.column(c)
        x, y = compare(t, chunk("vec"))
        if not len(x):
            return
        a, b, ma, mb = t["id"][x], t["id"][y], t["m"][x], t["m"][y]
        ids, place = np.unique(np.concatenate((a, b)), return_inverse=True)
        total = np.zeros(len(ids), np.int64)
        np.add.at(total, place, np.concatenate((mb, ma)))
        none = pa.nulls(len(ids), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total), none], names=["id", "links", "to"])
        pairs = pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        for forest in _forest(iter([pairs])):
            yield pa.RecordBatch.from_arrays([forest.column(0), pa.nulls(forest.num_rows, pa.int64()), forest.column(1)], names=["id", "links", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        work = 0
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                if held and work > WORK // 100:
                    piece, last = np.asarray(batch.column("piece")), np.asarray(held[-1].column("piece"))[-1]
                    cut = int(np.argmax(piece != last)) if (piece != last).any() else len(piece)
                    if cut:
                        held.append(batch.slice(0, cut))
                    if cut < len(piece):
                        yield from flush(held)
                        held, work = [], 0
                        batch = batch.slice(cut)
                    else:
                        continue
                held.append(batch)
                work += batch.num_rows
        if held:
            yield from flush(held)

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding", blocks: int = BLOCKS) -> DataFrame:
    """Per row: ``vec_id, n_links`` (other vectors at ``cosine`` or more), ``component_id`` (smallest id
    reachable by links, its own included) and ``kept`` (vec_id = component_id).

    Vectors that are null, zero or hold null or non-finite components link with nothing, nor do
    vectors of different length. Equal vectors are one class, compared once. A class lives in one
    lattice cell per table and probes the cells next to it; pairs that meet are verified by cosine in
    double precision and counted only where they first meet, so no pair is listed. Cells with many
    classes are cut into pairs of chunks. Repeated rows are vectors of their own; null ids count as
    larger than all.
    """
    kind = dict(vectors.dtypes)[embedding]
    rows = picked(vectors, _id=vec_id, _v=embedding)
    wide = "double" in kind or "float" not in kind
    v = F.col("_v").cast("array<double>" if wide else "array<float>")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = saved(rows.select("_id", F.when(fine, v).alias("embedding")).withColumn("id", F.when(F.col("embedding").isNotNull(), F.xxhash64(F.transform("embedding", lambda x: F.when(x == 0, F.lit(0).cast("double" if wide else "float")).otherwise(x))))))
    valid = rows.filter("embedding is not null")
    classes = saved(valid.groupBy("embedding", "id").agg(F.count("*").alias("m")).groupBy("id").agg(F.first("embedding").alias("embedding"), F.sum("m").alias("m")))
    placed = saved(_placed(classes, blocks))
    # Chunks are as many as a cell's rows need; small cells are one piece.
    count = placed.groupBy("cell").agg(F.sum(F.col("home").cast("long")).alias("nr"), F.sum((~F.col("home")).cast("long")).alias("nv"))
    count = count.filter("nr > 0 and nr + nv > 1").select(F.col("cell").alias("_c"), F.ceil(F.col("nr") / CHUNK).alias("R"), F.ceil(F.col("nv") / CHUNK).alias("V"))
    met = placed.join(count, F.col("cell") == F.col("_c"))
    own = F.pmod(F.xxhash64("id"), F.when(F.col("home"), F.col("R")).otherwise(F.col("V")))
    met = met.withColumn("k", own)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    none = F.array().cast("array<struct<i:long,j:long,left:boolean>>")
    put = lambda i, j, left: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), F.lit(left).alias("left"))
    k, R, V = F.col("k"), F.col("R"), F.col("V")
    # Residents i against residents j >= i (place j), and residents i against visitors j (place R + j).
    resident = F.concat(
        F.transform(F.sequence(k, R - 1), lambda j: put(k, j, True)),
        F.when(k > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(k - 1, F.lit(0))), lambda i: put(i, k, False))).otherwise(none),
        F.when(V > 0, F.transform(upto(F.greatest(V, F.lit(1))), lambda j: put(k, R + j, True))).otherwise(none),
    )
    visitor = F.transform(upto(R), lambda i: put(i, R + k, False))
    dealt = met.withColumn("p", F.explode(F.when(F.col("home"), resident).otherwise(visitor)))
    dealt = dealt.select(
        F.xxhash64("cell", "p.i", "p.j").alias("piece"), F.col("p.left").alias("left"), (F.col("p.i") == F.col("p.j")).alias("alone"),
        F.col("id").alias("_d"), "cell",
    )
    # Only rows of cells where vectors meet take their vector along.
    dealt = dealt.join(classes, F.col("_d") == F.col("id")).select("piece", "left", "alone", "id", "m", "cell", F.col("embedding").alias("vec"))
    work = dealt.repartition("piece").sortWithinPartitions("piece", F.desc("left"))
    links = saved(in_arrow(work, _linker(cosine, blocks), "id long, links long, to long"))
    comps = components(links.filter("to is not null").select("id", "to")).select(F.col("id").alias("_k"), "component")
    linked = links.filter("links is not null").groupBy(F.col("id").alias("_l")).agg(F.sum("links").alias("links"))
    each = classes.select("id", "m").join(linked, F.col("id") == F.col("_l"), "left").join(comps, F.col("id") == F.col("_k"), "left")
    each = saved(each.select(F.col("id").alias("_e"), (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("_g")))
    least = rows.filter("id is not null").groupBy("id").agg(F.min("_id").alias("_least"))
    group = each.join(least, F.col("_e") == F.col("id")).groupBy("_g").agg(F.min("_least").alias("component_id"))
    told = saved(each.join(group.withColumnRenamed("_g", "_h"), F.col("_g") == F.col("_h")).select("_e", "n_links", "component_id"))
    out = rows.select("_id", "id").join(told, F.col("id") == F.col("_e"), "left")
    comp = F.when(F.col("n_links") > 0, F.col("component_id")).otherwise(F.col("_id"))
    return out.select(F.col("_id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), comp.eqNullSafe(F.col("_id")).alias("kept"))
