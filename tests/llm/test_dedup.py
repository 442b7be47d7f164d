import hashlib
import math
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from tests.llm.cases import SCHEMA, corpus, frame, prose, union_find, words
from tidewire.llm import components, embedding_dedup, line_dedup, minhash_dedup, substring_dedup
from tidewire.llm.e8 import SHORTEST, nearest
from tidewire.llm.text import joined


def cut(rows):
    """Brute force of repeated passages."""
    first = {}
    for i, t in rows:
        if i is not None:
            w = words(t)
            for j in range(len(w) - 49):
                k = tuple(w[j : j + 50])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        if i is not None:
            for j in range(len(w) - 49):
                if first[tuple(w[j : j + 50])] < i:
                    gone[j : j + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return Counter(out)


@pytest.mark.parametrize("crowd", [20_000, 1, 0])
def test_repeated_passages(spark, monkeypatch, crowd):
    monkeypatch.setattr(substring_dedup, "CROWD", crowd)
    rows = corpus()
    base = prose(8, 300)
    for n in range(30):
        w = list(base)
        w[n * 9] = f"edit{n}"
        rows.append((100 + n, " ".join(w[n % 7 :]), *(None,) * 7))
    rows.append((200, "same " * 160, *(None,) * 7))
    rows.append((201, "same " * 300, *(None,) * 7))
    got = substring_dedup.remove_repeats(frame(spark, rows).repartition(4)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got) == cut([(r[0], r[1]) for r in rows])
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_tree_groups_cut_between_keys():
    import pyarrow as pa

    def row(anchor, seg, first, last, text, count):
        return {"anchor": anchor, "seg": seg, "count": count, "first": first, "last": last, "text": text.encode()}

    same = " ".join(prose(1, 51))
    rows = [row(1, 10, 1, 1, same, 2), row(1, 11, 5, 9, same, 2), row(2, 12, 7, 7, " ".join(prose(2, 50)), 1)]
    schema = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("count", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("text", pa.binary())])
    old, substring_dedup.GROUP_WORDS = substring_dedup.GROUP_WORDS, 1
    try:
        out = list(substring_dedup._trees(pa.RecordBatch.from_pylist([r], schema) for r in rows))
    finally:
        substring_dedup.GROUP_WORDS = old
    assert [r for b in out for r in b.to_pylist()] == [{"anchor": 1, "seg": 11, "off": 0, "mins": [1, 1]}]


def bag(text):
    w = words(text)
    k = min(5, len(w))
    return Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else None


def near(rows):
    bags = [bag(t) for _, t in rows]
    links = []
    for a, b in combinations(range(len(rows)), 2):
        if bags[a] and bags[b]:
            both = sum((bags[a] & bags[b]).values())
            if both >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - both):
                links.append((a, b))
    return union_find(range(len(rows)), links)


def test_minhash_groups(spark):
    rows = [(r[0], r[1]) for r in corpus()]
    group = near(rows)
    members = defaultdict(list)
    for n, g in group.items():
        members[g].append(rows[n][0])
    want = Counter()
    for n, g in group.items():
        ids = [i for i in members[g] if i is not None]
        gid = (min(ids) if ids else None) if len(members[g]) > 1 else rows[n][0]
        want[(rows[n][0], gid, len(members[g]), gid == rows[n][0])] += 1
    got = Counter((r.doc_id, r.group_id, r.group_rows, r.kept) for r in minhash_dedup.near_duplicates(frame(spark)).collect())
    assert got == want
    kept = minhash_dedup.one_of_each(frame(spark))
    assert kept.columns == frame(spark).columns
    assert kept.count() == len(members)
    assert minhash_dedup.near_duplicates(frame(spark, [])).count() == 0 == minhash_dedup.one_of_each(frame(spark, [])).count()


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(0)
    items = rng.integers(0, 2**63, 60).astype(np.uint64)
    a, b = rng.integers(0, 7, 60), rng.integers(0, 7, 60)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    at, bt = np.flatnonzero(a), np.flatnonzero(b)
    both = minhash_dedup.bag_signatures(np.concatenate((items[at], items[bt])), np.concatenate((a[at], b[bt])), np.repeat([0, 1], [len(at), len(bt)]), 2, 4096)
    assert abs((both[0] == both[1]).mean() - want) < 4 * math.sqrt(want * (1 - want) / 4096)


def test_pieces_by_pairs_and_by_products(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(9)
    rows = []
    for k in range(12):
        for r in range(int(rng.integers(2, 9))):
            base = set(rng.integers(0, 12, 9).tolist())
            rows.append({"piece": k, "left": bool(rng.integers(2)), "id": 100 * k + r, "c": r, "text": " ".join(map(str, sorted(base)))})
    batch = pa.RecordBatch.from_pylist(rows, pa.schema([("piece", pa.int64()), ("left", pa.bool_()), ("id", pa.int64()), ("c", pa.int64()), ("text", pa.string())]))

    def items(column):
        return joined([np.unique(np.array(t.split(), np.uint64)) << np.uint64(20) for t in column.to_pylist()])

    want = set()
    for a in rows:
        for b in rows:
            x, y = set(a["text"].split()), set(b["text"].split())
            if a["piece"] == b["piece"] and a["left"] and not b["left"] and a["id"] != b["id"] and len(x & y) >= 0.8 * len(x | y):
                want.add((min(a["id"], b["id"]), max(a["id"], b["id"])))
    for small, wide in ((16, 4096), (0, 3), (4, 5)):
        monkeypatch.setattr(components, "SMALL", small)
        monkeypatch.setattr(components, "WIDE", wide)
        got = {(min(a, b), max(a, b)) for t in components._compared([batch], items, 0.8) for a, b in zip(*(c.to_pylist() for c in t.columns), strict=True)}
        assert got == want


@pytest.mark.parametrize("chunk", [256, 2])
def test_no_link_in_a_bucket_is_lost(spark, monkeypatch, chunk):
    monkeypatch.setattr(components, "CHUNK", chunk)
    # One bucket: 1 is like none and 7 and 8 are alone; stars around any one member miss links.
    sets = {1: range(0, 9), 2: range(10, 20), 3: range(11, 21), 4: range(12, 22), 5: range(40, 50), 6: range(41, 51), 7: range(60, 70), 8: [0, 10, 40]}
    members = spark.createDataFrame([(9, i, 10) for i in sets] + [(8, 5, 10), (8, 6, 10), (7, 1, 10)], "bucket long, id long, size int")
    texts = spark.createDataFrame([(i, " ".join(map(str, x))) for i, x in sets.items()], "id long, text string")

    def items(column):
        return joined([np.unique(np.array(t.split(), np.uint64)) << np.uint64(20) for t in column.to_pylist()])

    got = {r.id: r.component for r in components.linked(members, lambda ids: texts.join(ids, "id"), items, 0.8).collect()}
    assert got == {3: 2, 4: 2, 6: 5}


@pytest.mark.parametrize("one_task", [400_000, 0])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    rng = np.random.default_rng(1)
    chain = [(i, i + 1) for i in range(1000, 1040)]
    links = chain[::2] + [(b, a) for a, b in chain[1::2]] + [tuple(map(int, rng.integers(0, 90, 2))) for _ in range(60)] + [(5, 5)]
    want = {i: r for i, r in union_find({x for p in links for x in p}, links).items() if i != r}
    df = spark.createDataFrame(links, "a long, b long").repartition(4)
    assert {r.id: r.component for r in components.components(df).collect()} == want
    assert components.components(df.limit(0)).count() == 0


def line_oracle(rows):
    occ = defaultdict(list)
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\n\x0b\x0c\r"):
                occ[line].append((i, n))
    lines = list(occ)
    sets = [{x[j : j + 6] for j in range(max(1, len(x) - 5))} for x in lines]
    links = [(a, b) for a, b in combinations(range(len(lines)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    groups = defaultdict(list)
    for n, g in union_find(range(len(lines)), links).items():
        groups[g] += occ[lines[n]]
    lost = defaultdict(set)
    for places in groups.values():
        first = min(places, key=lambda p: (p[0] is not None, p[0] or 0, p[1]))
        for i, n in places:
            if (i, n) != first:
                lost[i].add(n)
    return lost


def test_lines(spark):
    rows = [(r[0], r[1]) for r in corpus() if r[0] is not None]
    lost = line_oracle(rows)
    df = frame(spark).filter("doc_id is not null")
    got = Counter((r.doc_id, r.n_lines, r.n_removed, tuple(r.removed)) for r in line_dedup.dedup_report(df).collect())
    assert got == Counter((i, 0 if t is None else t.count("\n") + 1, len(lost[i]), tuple(sorted(lost[i]))) for i, t in rows)
    kept = line_dedup.without_repeats(frame(spark))
    assert kept.columns == frame(spark).columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert texts[15] == "unlike" and texts[16] == "other thing" and texts[7] == "" and texts[8] is None and texts[9] == " \n\t " and 11 not in texts
    assert line_dedup.dedup_report(frame(spark, [])).count() == 0 == line_dedup.without_repeats(frame(spark, [])).count()


def test_cells_do_not_depend_on_the_batch():
    u = embedding_dedup.units(np.random.default_rng(11).normal(size=(300, 64)).astype(np.float32))
    whole = embedding_dedup.cells(u, 2)
    for at in ([5], [7, 299, 0], list(range(100, 163))):
        assert (embedding_dedup.cells(embedding_dedup.units(np.random.default_rng(11).normal(size=(300, 64)).astype(np.float32)[at]), 2) == whole[at]).all()


def test_e8_is_nearest():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 8)) * 2
    y = nearest(x)
    assert len(SHORTEST) == 240 and np.allclose((SHORTEST**2).sum(1), 2)
    assert (np.isclose(y * 2, np.rint(y * 2))).all() and (y.sum(1) % 2 == 0).all()
    assert (((x - y) ** 2).sum(1) <= 1 + 1e-9).all()  # the covering radius
    for v in SHORTEST:
        assert (((x - y) ** 2).sum(1) <= ((x - y - v) ** 2).sum(1) + 1e-9).all()


def vectors():
    rng = np.random.default_rng(3)
    out, at = [], 0
    for size in (1, 1, 2, 5, 40):
        c = rng.normal(size=16)
        for _ in range(size):
            v = c + rng.normal(size=16) * 0.12 * np.linalg.norm(c) / 4
            out.append((at, [float(np.float32(x)) for x in v]))
            at += 1
    out += [(at, out[3][1]), (at + 1, out[3][1]), (at + 2, [2 * x for x in out[3][1]]), (at + 3, [1e30 * x for x in out[3][1]])]
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, out[3][1][:8]]
    out += [(at + 10 + i, v) for i, v in enumerate(bad)]
    return out + [(None, out[4][1]), out[5], out[5]]


@pytest.mark.parametrize("blocks,chunk,kind", [(1, 256, "float"), (2, 4, "float"), (1, 3, "double")])
def test_vectors(spark, monkeypatch, blocks, chunk, kind):
    monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
    rows = vectors()
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v) / np.linalg.norm(v) if o else None for (_, v), o in zip(rows, ok, strict=True)]
    links = [(a, b) for a, b in combinations(range(len(rows)), 2) if ok[a] and ok[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    root = union_find(range(len(rows)), links)
    least = {}
    for n, g in root.items():
        if rows[n][0] is not None:
            least[g] = min(least.get(g, rows[n][0]), rows[n][0])
    degree = Counter(x for p in links for x in p)
    want = Counter((rows[n][0], degree[n], least.get(g), least.get(g) == rows[n][0]) for n, g in root.items())
    df = spark.createDataFrame([(*r, 1, "a") for r in rows], f"vec_id long, embedding array<{kind}>, n_links int, kept string").repartition(3)
    got = embedding_dedup.near_vectors(df, blocks=blocks).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == want
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_vectors_meet_in_the_same_cells_at_any_size(spark, monkeypatch):
    """A table told to be large is dealt to the same cells as a small one, with the same results."""
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>")
    real, count, used, got = embedding_dedup._placed, type(df).count, [], []
    monkeypatch.setattr(embedding_dedup, "_placed", lambda classes, blocks: used.append(blocks) or real(classes, blocks))
    for size in (None, 300_000, 10**9):
        told = [size] if size else []
        monkeypatch.setattr(type(df), "count", lambda self, told=told: told.pop() if told else count(self))
        got.append(Counter(map(tuple, embedding_dedup.near_vectors(df).collect())))
    assert len(set(used)) == 1 and got[0] == got[1] == got[2]


@pytest.mark.parametrize("blocks", [1, 2, 3])
def test_lattice_recall_at_the_threshold(spark, blocks):
    rng = np.random.default_rng(5)
    u = rng.normal(size=(400, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    v = rng.normal(size=(400, 64))
    v -= (v * u).sum(1)[:, None] * u
    v /= np.linalg.norm(v, axis=1)[:, None]
    z = 0.951 * u + math.sqrt(1 - 0.951**2) * v
    rows = [(i, x.tolist()) for i, x in enumerate(np.concatenate((u, z)))]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), blocks=blocks).toPandas()
    assert (got.n_links > 0).mean() >= 0.99


assert SCHEMA


def test_line_texts_are_not_written(spark, monkeypatch):
    """Texts of lines go from the documents to their comparison; only numbers are kept in files."""
    kept, real = [], line_dedup.saved
    monkeypatch.setattr(line_dedup, "saved", lambda df: kept.append(df.columns) or real(df))
    lines = ["the quick brown fox jumps over the lazy dog", "the quick brown fox jumps over the lazy dogs", "something else altogether, unlike the others"]
    df = spark.createDataFrame([(1, lines[0]), (2, f"{lines[1]}\n{lines[2]}"), (3, lines[2])], "doc_id long, text string")
    got = {r.doc_id: r.removed for r in line_dedup.dedup_report(df).collect()}
    assert got == {1: [], 2: [0], 3: [0]} and kept and not any("text" in c for c in kept)


def _spans(lines):
    import pyarrow as pa

    from tidewire.llm.text import text_buffers

    b, offs = text_buffers(pa.array(lines, pa.string()))
    return line_dedup._characters(b, offs[:-1], offs[1:])


def test_sizes_and_bands_come_of_one_sort(monkeypatch):
    """Characters are hashed once for both; sizes are those of the sets, equal sets have equal bands."""
    calls, real = [], line_dedup._hashed
    monkeypatch.setattr(line_dedup, "_hashed", lambda points: calls.append(len(points)) or real(points))
    lines = ["", "ab", "abcdef", "aaaaaaaaaaaa", "", "grün und weiß, grün und weiß", "日本語の文字列です。日本語の文字列です。", "\U0001f600" * 9, *prose(7, 200), " ".join(prose(6, 300)), ""]
    for rows in (lines, ["x"] * 65_530 + lines + ["abcabcabc", "abcabcabcabc"], [], [""]):
        calls.clear()
        sizes, bands = line_dedup.sizes_and_bands(*_spans(rows))
        want = [len({x[j : j + 6] for j in range(max(1, len(x) - 5))}) if x else 0 for x in rows]
        assert sizes.tolist() == want and bands.shape == (len(rows), line_dedup.BANDS) and len(calls) == 1
        same = defaultdict(set)
        for x, s in zip(rows, map(tuple, bands.tolist()), strict=True):
            same[frozenset(x[j : j + 6] for j in range(max(1, len(x) - 5)))].add(s)
        assert all(len(s) == 1 for s in same.values()) and len(set().union(*same.values(), set())) == len(same)


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz ", "абвгдежзиклмнопрстуфхцч ", "ab c"])
def test_lines_at_the_threshold_share_a_band(letters):
    rng, pairs = np.random.default_rng(12), []
    while len(pairs) < 3000:
        k = int(rng.integers(2, 9))
        x = rng.choice(list(letters), 54 * k + 5)
        y = x.copy()
        y[np.arange(k) * 54 + 20] = "#"
        pairs.append(("".join(x), "".join(y)))
    _, a = line_dedup.sizes_and_bands(*_spans([x for x, _ in pairs]))
    _, b = line_dedup.sizes_and_bands(*_spans([y for _, y in pairs]))
    cut = lambda x: {x[j : j + 6] for j in range(len(x) - 5)}
    near = np.array([len(cut(x) & cut(y)) >= 0.8 * len(cut(x) | cut(y)) for x, y in pairs])
    missed = 1 - (a == b).any(1)[near].mean()
    assert near.sum() > 20 and missed < 0.012


@pytest.mark.parametrize("held", [1 << 21, 40, 1])
def test_packed_members_meet_as_rows_do(spark, monkeypatch, held):
    """Members in packs, cut anywhere and repeated, are thinned out as rows are; a part too large to judge goes on whole."""
    import pyarrow as pa

    monkeypatch.setattr(components, "HELD", held)
    rng = np.random.default_rng(14)
    n = 3000
    own = np.zeros(n, components.MEMBER)
    own["id"] = rng.integers(-400, 400, n)
    own["size"] = 10 + own["id"] % 37
    own["bucket"] = rng.integers(-(1 << 63), (1 << 63) - 1, 900)[np.minimum(rng.integers(0, 2000, n), 899)]
    own["bucket"][:500] += rng.integers(0, 3, 500)
    members = spark.createDataFrame([tuple(map(int, m)) for m in own], "bucket long, id long, size int")
    want = set(map(tuple, components._met(members, 0.8).collect()))
    assert 0 < len(want) < len(set(map(tuple, own.tolist())))
    cut = [packed for some in np.array_split(own, 7) for packed in components.packs(some, 3).to_pylist()]
    packs = pa.array(cut, pa.list_(pa.struct([("part", pa.int32()), ("members", pa.binary())]))).to_pylist()
    rows = [(m["part"], bytearray(m["members"])) for p in packs if p for m in p]
    assert sum(len(m) for _, m in rows) == n * components.MEMBER.itemsize and packs[0] is None and packs[1] is None
    monkeypatch.setattr(components, "in_arrow", lambda df, run, schema: df.mapInArrow(lambda batches: run(c for b in batches for c in (b.slice(k, 5) for k in range(0, b.num_rows, 5))), schema))
    got = [tuple(r) for r in components._unpacked(spark.createDataFrame(rows, "part int, members binary"), 0.8).collect()]
    assert want <= set(got) <= set(map(tuple, own.tolist()))
    if held > n:
        assert sorted(got) == sorted(want)
    if held == 1:
        assert set(got) > want


def test_members_travel_in_packs(spark, monkeypatch):
    """A line's bands are not rows of a shuffle: each task packs them by parts."""
    kept, real = [], line_dedup.linked
    monkeypatch.setattr(line_dedup, "linked", lambda members, *rest: kept.append((members.columns, members.count())) or real(members, *rest))
    rows = [(i, "\n".join(prose(i % 50, 40))) for i in range(100)]
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_report(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert kept[0][0] == ["part", "members"] and kept[0][1] <= components.PARTS
    assert all(got[i] == 40 for i in range(50, 100))


def test_near_duplicates_write_few_files_and_no_texts(spark, monkeypatch, tmp_path):
    """Tables between the steps go to a file a core at most, whatever the partitions; texts go to none."""
    import os
    from urllib.parse import urlparse

    kept, real = [], components.saved

    def watched(df):
        out = real(df)
        files = [f for f in os.listdir(urlparse(out._saved_at).path) if f.endswith(".parquet")]
        kept.append((df.columns, len(files)))
        return out

    monkeypatch.setattr(components, "saved", watched)
    monkeypatch.setattr(minhash_dedup, "saved", watched)
    words = [f"w{k}" for k in range(60)]
    # Groups of a chain each (a text is like the next one only), so that buckets hold several components.
    rows = [(10 * g + k, " ".join(f"{w}g{g}" for w in words[3 * k : 3 * k + 45])) for g in range(20) for k in range(4)]
    settings = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = {r.doc_id: r.group_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(32)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    group = near(rows)
    assert got == {rows[n][0]: rows[g][0] for n, g in group.items()} and len(set(got.values())) == 20
    assert kept and not any("text" in c for c, _ in kept)
    assert max(n for _, n in kept) <= spark.sparkContext.defaultParallelism


def test_lines_and_stages_write_few_files(spark, monkeypatch, tmp_path):
    """Line dedup and the stages of the pipeline give a file a core at most for small inputs in many parts."""
    import os
    from urllib.parse import urlparse

    import corpus_pipeline
    from tidewire.session import merged

    kept, real, cores = [], components.saved, spark.sparkContext.defaultParallelism

    def watched(df):
        out = real(df)
        kept.append(len([f for f in os.listdir(urlparse(out._saved_at).path) if f.endswith(".parquet")]))
        return out

    for m in (components, line_dedup):
        monkeypatch.setattr(m, "saved", watched)
    rows = [(i, f"this line is number {i} times {i * i}, own of document {i}\nthe line that all documents have in common") for i in range(64)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(32).write.parquet(str(tmp_path / "docs"))
    settings = {
        "spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "4k",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        docs = spark.read.parquet(str(tmp_path / "docs"))
        parts = docs.rdd.getNumPartitions()
        assert parts > 2 * cores and merged(docs, docs).rdd.getNumPartitions() == cores and merged(docs, docs, 1).rdd.getNumPartitions() == parts
        out = corpus_pipeline.dedup_lines(spark, docs, "")
        out.write.parquet(str(tmp_path / "out"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = {i: t if i == 0 else t.split("\n")[0] for i, t in rows}
    assert {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want
    assert max(kept) <= cores and len([f for f in os.listdir(tmp_path / "out") if f.endswith(".parquet")]) <= cores
