"""Results of operators and pipeline stages against plain Python over the same rows."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.cases import prose, words
from tests.llm.test_dedup import line_oracle, near
from tests.llm.test_models import leak_oracle
from tidewire.llm import mixing, toxicity
from tidewire.llm.text import hash_spans, mix


def test_mix_takes_the_documents_of_a_plain_mix(spark):
    rng = np.random.default_rng(21)
    rows = [(i, " ".join(["w"] * int(n)) if n else None, s) for i, (n, s) in enumerate(zip(rng.integers(0, 12, 400), rng.choice(["a", "b", "ü", None], 400, p=[0.7, 0.1, 0.1, 0.1]), strict=True))]
    rows += [rows[5], rows[7]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = df.sparkSession.createDataFrame(mixing.mix_sources(df).collect())
    told = {r.source: r for r in mixing.source_targets(df.groupBy("source").agg(F.sum(mixing.text_size(F.col("text"))).alias("source_size"))).collect()}
    h = {(r.doc_id, r.text): r.h for r in df.select("doc_id", "text", F.xxhash64(F.lit(mixing.SEED), "doc_id", "text").alias("h")).collect()}
    want = Counter()
    for s in {r[2] for r in rows}:
        own = [r for r in rows if r[2] == s]
        size = lambda r: len(words(r[1]))
        total, target = sum(map(size, own)), told[s].target
        copies = min(mixing.CAP, int(target // total)) if total else 0
        rest = target - copies * total if copies < mixing.CAP else 0.0
        lengths = np.array(sorted({size(r) for r in own}))
        counts = np.array([sum(size(r) == n for r in own) for n in lengths])
        picks = dict(zip(lengths.tolist(), mixing.fit_budget(lengths, counts, rest).tolist(), strict=True))
        for n in lengths.tolist():
            order = sorted((h[r[0], r[1]] % mixing.CELLS, h[r[0], r[1]], r[0]) for r in own if size(r) == n)
            for k, (_, _, i) in enumerate(order):
                want[(i, n, total, n * (copies + (k < picks[n])))] += 1
    assert Counter((r.doc_id, r["size"], r.source_size, r.taken) for r in got.collect()) == want


def plain_features(text):
    out = set()
    for w in "".join(c if c.isascii() and c.isalnum() or ord(c) >= 128 else " " for c in (text or "")).split(" "):
        raw = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w).encode()
        if raw:
            b = np.frombuffer(raw, np.uint8)
            at = lambda k: hash_spans(b, np.array([0]), np.array([k]))  # noqa: E731, B023
            out.add(int(at(len(raw))[0]))
            out |= {int(mix(at(k) + np.uint64(k))[0]) for k in toxicity.PREFIXES if len(raw) >= k}
    return out


def test_severity_is_the_formula(spark):
    texts = [" ".join(prose(i, 20 + i)) + (" Idiot, TRASH! scumbag" if i % 3 == 0 else "") for i in range(90)] + [None, "", "x" * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert len(model.keys) >= 3
    weight = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    h, rows, n = toxicity.features(pa.array(texts))
    got = {r.doc_id: r for r in toxicity.severity(docs, model).collect()}
    for i, t in enumerate(texts):
        have = plain_features(t)
        assert have == set(h[rows == i].tolist())
        score = sum(weight.get(k, 0.0) for k in have)
        upto = [1 / (1 + np.exp(-(a - score))) for a in model.thresholds]
        p = np.diff([0.0, *upto, 1.0])
        assert abs(got[i].severity - p @ np.arange(len(p))) < 1e-9 and abs(got[i].p_toxic - (1 - p[0])) < 1e-9
        assert got[i].grade == int(p.argmax()) and got[i].toxic == (1 - p[0] >= 0.5)


def test_stages_equal_plain_ones(spark, tmp_path):
    """Each stage on the rows that its predecessor kept."""
    shared = [" ".join(prose(700 + k, 9)) for k in range(4)]
    rows = []
    for i in range(60):
        lines = [" ".join(prose(100 * i + k, 12)) for k in range(4)]
        lines[i % 4] = shared[i % 4] if i % 5 == 0 else lines[i % 4]
        if i % 6 == 0:
            lines.append("idiot scum trash " * 3)
        if i % 10 == 3:
            lines.append(" ".join(prose(9000, 60)))
        rows.append((i, "\n".join(lines), "en", f"s{i % 3}", None))
    rows += [(100 + i, rows[i][1].replace(rows[i][1].split("\n")[1].split()[0], "other", 1), "en", "s1", 7) for i in range(5)]
    rows += [(200, None, None, None, None), (201, "", "en", "s0", 0), (202, shared[0], "en", "s0", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(int(i), int(i % 6 == 0)) for i in range(60)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, " ".join(prose(9000, 60)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, schema)
    stages = dict(corpus_pipeline.STAGES)

    def kept(name, df):
        out = stages[name](spark, df, str(tmp_path))
        assert out.columns == docs.columns
        return {r.doc_id: r.text for r in out.collect()}

    texts = {r[0]: r[1] for r in rows}
    graded = {r.doc_id for r in toxicity.severity(docs, toxicity.train(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))).filter("not toxic").collect()}
    assert set(kept("toxicity", docs)) == graded and not {i for i in range(0, 60, 6)} & graded and {i for i in range(1, 60) if i % 6} <= graded
    lost = line_oracle(list(texts.items()))
    want = {}
    for i, t in texts.items():
        left = [x for n, x in enumerate((t or "").split("\n")) if n not in lost[i]]
        if not lost[i] or any(x.strip(" \t\n\x0b\x0c\r") for x in left):
            want[i] = t if not lost[i] else "\n".join(left)
    assert kept("line_dedup", docs) == want
    group = near(list(texts.items()))
    first = defaultdict(list)
    for n, g in group.items():
        first[g].append(list(texts)[n])
    assert set(kept("minhash_near_dedup", docs)) == {min(x) for x in first.values()}
    leaks = {d for d, _ in leak_oracle(list(texts.items()), [(0, " ".join(prose(9000, 60)))])}
    assert leaks and set(kept("decontamination", docs)) == set(texts) - leaks
