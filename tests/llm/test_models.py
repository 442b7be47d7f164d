import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.cases import frame, prose, words
from tidewire.llm import decontamination, lm_score, toxicity
from tidewire.llm.text import SLICE, spans, text_buffers, words_of

BAD = ["Idiot!", "scumsome", "scumother", "trash,", "worthless"]


def labelled(n=600):
    r = np.random.default_rng(4)
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        w = prose(1000 + i, 30 + i % 50)
        for _ in range(1 + i % 4 if toxic else 0):
            w.insert(int(r.integers(0, len(w))), BAD[int(r.integers(0, len(BAD)))])
        docs.append((i, " ".join(w), "en", "s", None, 1, "x", "kept as is", None))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled()
    df = frame(spark, docs)
    some = spark.createDataFrame(labels[:400] + [(None, 1, 1), (3, None, None), (0, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, some)
    got = toxicity.severity(df, model)
    assert "kept" in got.columns and got.columns.count("toxic") == 1
    rows = {r.doc_id: r for r in got.collect()}
    held = [(rows[i].toxic, bool(t)) for i, _, t in labels[400:]]
    assert sum(a == b for a, b in held) / len(held) >= 0.98
    assert not any(a for a, b in held if not b)
    assert (np.diff(model.thresholds) >= 0).all()
    for r in list(rows.values())[:50]:
        assert 0 <= r.severity <= toxicity.GRADES - 1 and r.toxic == (r.p_toxic >= 0.5)
    counts = defaultdict(list)
    for i, t in enumerate(docs):
        if i % 5 == 0:
            counts[1 + i % 4].append(rows[i].severity)
    assert np.mean(counts[4]) > np.mean(counts[1])


def test_toxicity_without_evidence(spark):
    df = frame(spark)
    for rows in ([], [(1, 1, 1)], [(1, 1, 0), (2, 1, 0)]):
        model = toxicity.train(df, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
        got = toxicity.severity(df, model).collect()
        assert len(got) == df.count() and not any(r.toxic for r in got)
    assert toxicity.severity(frame(spark, []), model).count() == 0


def test_ordinal_fit_recovers_thresholds():
    rng = np.random.default_rng(6)
    n, w, th = 6000, np.array([2.0, -1.5, 1.0]), np.array([0.0, 1.0, 2.5])
    x = rng.random((n, 3)) < 0.5
    y = (x @ w + rng.logistic(size=n) > th[:, None]).sum(0)
    row, col = np.nonzero(x)
    weights, thresholds = toxicity._fit_ordinal(row, col, 3, y, 4, ridge=1e-3)
    assert np.abs(weights - w).max() < 0.2 and np.abs(thresholds - th).max() < 0.2


def test_model_likelihood_is_that_of_the_formula():
    net = lm_score.initial(np.arange(lm_score.IDS)[::-1].astype(float))
    ids = np.array([3, 9, 9, 500, 3, 77])
    offs = np.array([0, 4, 4, 6])
    got = net.log_prob(ids, lm_score.windows(ids, offs, lm_score.IDS))
    for row in ((0, 4), (4, 6)):
        for at in range(*row):
            h = net.b.astype(float).copy()
            for j, k in enumerate((-2, -1, 1, 2)):
                word = ids[at + k] if row[0] <= at + k < row[1] else lm_score.IDS
                h += net.A[j].astype(float) * net.E[word]
            z = np.tanh(h) @ net.W + net.c
            c = net.class_of[ids[at]]
            want = z[c] - math.log(np.exp(z).sum()) + net.log_within[ids[at]]
            assert abs(got[at] - want) < 1e-4
    assert abs(np.exp(net.log_within).sum() - lm_score.CLASSES) < 1e-6


def test_gradient_step_is_the_gradient():
    rng = np.random.default_rng(7)
    net = lm_score.initial(rng.integers(0, 50, lm_score.IDS).astype(float))
    net.V = rng.normal(0, 0.3, net.V.shape).astype(np.float32)
    ids, ctx = rng.integers(0, 300, 8), rng.integers(0, 300, (8, 4))
    loss = lambda n: -np.mean(n.log_prob(ids, ctx))
    before = {k: getattr(net, k).copy() for k in net.NAMES}
    moved = net.with_vector(net.vector())
    moved.step(ids, ctx, 1.0)
    for name, scale in (("W", 1), ("A", 1), ("b", 1), ("c", 1), ("E", math.sqrt(8)), ("V", math.sqrt(8))):
        step = before[name] - getattr(moved, name)
        at = np.unravel_index(np.abs(step).argmax(), step.shape)
        eps, probe = 1e-2, net.with_vector(net.vector())
        getattr(probe, name)[at] += eps
        up = loss(probe)
        getattr(probe, name)[at] -= 2 * eps
        assert abs((up - loss(probe)) / (2 * eps) * scale - step[at]) < 0.03 * abs(step[at]) + 1e-3


def test_lm_tells_order_from_disorder(spark):
    rng = np.random.default_rng(8)
    cycle = prose(9, 12)
    text = lambda: " ".join(cycle[(s + k) % 12] for s in [int(rng.integers(12))] for k in range(60))
    rows = [(i, text(), *(None,) * 7) for i in range(800)]
    mixed = [(1000 + i, " ".join(rng.permutation(text().split())), *(None,) * 7) for i in range(50)]
    fresh = [(2000 + i, text(), *(None,) * 7) for i in range(50)]
    net = lm_score.train(frame(spark, rows).repartition(2), rounds=6)
    got = {r.doc_id: r for r in lm_score.score(frame(spark, mixed + fresh + [(1, None, *(None,) * 7), (2, " ", *(None,) * 7)] + fresh[:1]), net).collect()}
    assert np.mean([got[2000 + i].per_word for i in range(50)]) > np.mean([got[1000 + i].per_word for i in range(50)]) + 0.3
    assert got[1].n_words == 0 and got[1].log_likelihood == 0.0 and got[2].per_word is None
    assert abs(got[2000].per_word * got[2000].n_words - got[2000].log_likelihood) < 1e-9
    empty = lm_score.train(frame(spark, []))
    assert lm_score.score(frame(spark, []), empty).count() == 0


def brute_log_prob(net, ids, ctx):
    """The formula, a position at a time."""
    out = []
    for i, c in zip(ids, ctx, strict=True):
        h = np.tanh(sum(net.A[j].astype(float) * net.E[c[j]] for j in range(len(c))) + net.b)
        z = h @ net.W + net.c
        own = np.flatnonzero(net.class_of == net.class_of[i])
        y = net.V[own] @ h + net.log_within[own]
        out.append(z[net.class_of[i]] - np.log(np.exp(z).sum()) + net.V[i] @ h + net.log_within[i] - np.log(np.exp(y).sum()))
    return out


def test_lm_beats_the_unigram_on_held_out_text(spark):
    """Words that follow from their neighbours: both sides must reach the word itself, not only its class."""
    rng = np.random.default_rng(12)
    vocabulary = prose(33, 60)
    nxt = rng.permutation(60)

    def text():
        out = [int(rng.integers(60))]
        for _ in range(70):
            out.append(int(nxt[out[-1]]) if rng.random() < 0.9 else int(rng.integers(60)))
        return " ".join(vocabulary[k] for k in out)

    rows = [(i, text(), *(None,) * 7) for i in range(1500)]
    held = [(5000 + i, text(), *(None,) * 7) for i in range(60)]
    net = lm_score.train(frame(spark, rows).repartition(2), rounds=6)
    got = lm_score.score(frame(spark, held), net).toPandas()
    counts = Counter(w for r in rows for w in words(r[1]))
    total = sum(counts.values())
    unigram = np.mean([np.log(counts[w] / total) for r in held for w in words(r[1])])
    assert got.log_likelihood.sum() / got.n_words.sum() > unigram + 0.2


@pytest.mark.parametrize("most", [lm_score.FREQUENT, 20, 0])
def test_lm_scores_words_by_their_own_counts(spark, monkeypatch, most):
    monkeypatch.setattr(lm_score, "FREQUENT", most)
    hashed = lambda ws: words_of(pa.array([" ".join(ws)]))[0]
    id_of = lambda ws: (hashed(ws) % np.uint64(lm_score.IDS)).astype(int)
    tried = [f"w{k}" for k in range(100_000)]
    seldom, unseen = [w for w, i in zip(tried, id_of(tried), strict=True) if i == id_of(["often"])[0]][:2]  # all share an id
    texts = [" ".join(prose(i, 40) + ["often"] * (20 * i)) for i in range(6)] + [f"once {seldom}"]
    net = lm_score.train(frame(spark, [(i, t, *(None,) * 7) for i, t in enumerate(texts)]))
    counts = Counter(w for t in texts for w in words(t))
    vocabulary = list(counts)
    kind = dict(zip(vocabulary, id_of(vocabulary).tolist(), strict=True))
    total = Counter()
    for w, n in counts.items():
        total[kind[w]] += n + 0.5
    assert net.vocabulary.table.count() == len(counts)
    docs = [*texts, f"often {unseen} often", f"{unseen} " * 5, "often " * 5]
    got = {r.doc_id: r for r in lm_score.score(frame(spark, [(i, t, *(None,) * 7) for i, t in enumerate(docs)]), net).collect()}
    for i, t in enumerate(docs):
        ws = words(t)
        ids = id_of(ws)
        lp = brute_log_prob(net, ids, lm_score.windows(ids, np.array([0, len(ws)]), lm_score.IDS))
        want = sum(p + math.log(counts[w] + 0.5) - math.log(total[k] + 0.5) for w, k, p in zip(ws, ids, lp, strict=True))
        assert got[i].n_words == len(ws) and abs(got[i].log_likelihood - want) < 1e-3
    assert got[len(docs) - 1].per_word > got[len(docs) - 2].per_word + 5


def leak_oracle(docs, items):
    def norm(t):
        return ["".join(c) for c in __import__("regex").findall(r"[\p{L}\p{N}]+", (t or "").lower())]

    best = {}
    for d, t in docs:
        w = norm(t)
        for i, u in items:
            v = norm(u)
            if not v or not w:
                continue
            k = min(5, len(v))
            bag = Counter(tuple(v[j : j + k]) for j in range(len(v) - k + 1))
            size = min(len(v), len(w))
            for s in range(len(w) - size + 1):
                own = Counter(tuple(w[j : j + k]) for j in range(s, s + size - k + 1))
                both = sum((bag & own).values())
                sim = both / max(1, sum(bag.values()) + sum(own.values()) - both)
                if sim >= 0.8:
                    best[(d, i)] = max(best.get((d, i), 0), sim)
    return best


def test_leaks(spark):
    items = [(i, " ".join(prose(50 + i, 15 + 4 * i))) for i in range(6)] + [(6, "Two words"), (7, None), (8, " , "), (9, "x " * 30)]
    docs = []
    for i in range(6):
        w = items[i][1].split()
        pad = prose(90 + i, 40)
        docs.append((i, " ".join(pad[:20] + w + pad[20:])))
        docs.append((10 + i, " ".join(pad[:20] + w[: len(w) // 2]) + ", " + " ".join(w[len(w) // 2 :]).upper()))
        docs.append((20 + i, " ".join(w[1:])))
        docs.append((30 + i, " ".join(pad + w[:-1] + ["changed"] + pad)))
        docs.append((40 + i, " ".join(pad + w[: len(w) // 3] + pad)))
    docs += [(50, "here are two, words."), (51, ""), (52, None), (53, "y " + "x " * 40), (54, items[0][1]), (54, items[0][1]), (None, items[1][1])]
    df = frame(spark, [(*d, *(None,) * 7) for d in docs])
    bench = spark.createDataFrame([(*x, 1) for x in items + items[:1]], "item_id long, text string, size int")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.leaks(df, bench).collect()}
    want = leak_oracle(docs, items)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
    left = decontamination.without_leaks(df, decontamination.leaks(df, bench))
    assert Counter(r.doc_id for r in left.collect()) == Counter(d for d, _ in docs if d not in {k[0] for k in want})
    assert decontamination.leaks(df.limit(0), bench).count() == 0 == decontamination.leaks(df, bench.limit(0)).count()


def test_leaks_with_insertion_and_both_ends_trimmed(spark):
    item, other = prose(70, 200), prose(71, 300)
    docs = [(0, " ".join(other[:50] + item[6:100] + other[50:62] + item[100:194] + other[62:])), (1, " ".join(item[6:100] + other[:12] + item[100:194]))]
    items = [(0, " ".join(item))]
    got = {(r.doc_id, r.item_id): r for r in decontamination.leaks(frame(spark, [(*d, *(None,) * 7) for d in docs]), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = leak_oracle(docs, items)
    assert got.keys() == want.keys() == {(0, 0), (1, 0)}
    assert all(abs(got[k].similarity - want[k]) < 1e-12 for k in want)


def test_leaks_with_one_repeated_word(spark):
    items = [(i, " ".join(prose(80 + i, 200))) for i in range(5)]
    docs = [(i, " ".join(t.split()[:179] + ["filler"] * 21)) for i, t in items]
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.leaks(frame(spark, [(*d, *(None,) * 7) for d in docs]), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = leak_oracle(docs, items)
    assert got.keys() == want.keys() == {(i, i) for i in range(5)}
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_words_of_any_batch():
    texts = ["a  b", None, "", "\x0bé\x1f x", "ü" * (SLICE + 5) + " end", "z"]
    column = pa.array(["skip me", *texts])[1:]
    b, offs = text_buffers(column)
    s, e = spans(b, offs)
    assert [bytes(b[i:j]).decode() for i, j in zip(s, e, strict=True)] == [w for t in texts for w in words(t)]
    h, at = words_of(column)
    assert np.diff(at).tolist() == [len(words(t)) for t in texts]
    alone = [words_of(pa.array([w]))[0][0] for t in texts for w in words(t)]
    assert h.tolist() == alone


@pytest.mark.parametrize("stage", range(5))
def test_stages_keep_columns_and_rows(spark, sf_dir, stage):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(None, None, None, None, None), (900001, "", "en", None, 0)], docs.schema))
    out = corpus_pipeline.STAGES[stage][1](spark, docs, sf_dir)
    assert out.columns == docs.columns or stage == 4
    assert 0 < out.count() <= docs.count()
    empty = corpus_pipeline.STAGES[stage][1](spark, docs.limit(0), sf_dir)
    assert empty.count() == 0
