"""Words made to collide, clashing column names, reordered benchmark passages, very long texts."""

import hashlib
import importlib.util
import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import ROOT
from tests.llm.cases import frame, prose
from tidewire.llm import decontamination, line_dedup, lm_score, minhash_dedup, mixing, substring_dedup, text, token_count, toxicity, url_filter
from tidewire.llm.tables import ARROW_BYTES, BATCH_BYTES


def thue_morse(n):
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_word_hashes_and_numbers():
    x, y = thue_morse(1024)
    blocks = ["".join(("aaaaaaaa", "bbbbbbbb")[b == "b"] for b in w) for w in (x, y)]
    words = [x, y, *blocks, x, "a", "a\0", "ab", "aaaaaaaab", "aaaaaaaabb", "", "é"]
    b, offs = text.text_buffers(pa.array(words))
    h = text.hash_spans(b, offs[:-1], offs[1:])
    assert len(set(h.tolist())) == len(set(words)) and h[0] == h[4]
    numbers = text.word_numbers(b, offs[:-1], offs[1:]).tolist()
    assert [numbers.index(n) for n in numbers] == [words.index(w) for w in words]
    assert (text.hash_spans(b, offs[:-1], offs[1:], 1) != h).all()


def test_words_are_told_apart_even_if_hashes_collide(monkeypatch):
    monkeypatch.setattr(text, "hash_spans", lambda b, s, e, seed=0: np.zeros(len(s), np.uint64))
    words = ["one", "two", "one", "threeeeeeeeeee", "threeeeeeeeeef", "two"]
    b, offs = text.text_buffers(pa.array(words))
    numbers = text.word_numbers(b, offs[:-1], offs[1:]).tolist()
    assert [numbers.index(n) for n in numbers] == [words.index(w) for w in words]


def test_colliding_words_in_documents(spark):
    x, y = thue_morse(1024)
    same = prose(1, 49)
    rows = [(1, " ".join([*same, x])), (2, " ".join([*same, y])), (3, x), (4, y), (5, " ".join([*same, x]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 0, 5: 50}
    groups = {r.doc_id: r.group_id for r in minhash_dedup.near_duplicates(docs.filter("doc_id in (3, 4)")).collect()}
    assert groups == {3: 3, 4: 4}
    z = "".join(("aaaaaaaa", "bbbbbbbb")[c == "b"] for c in x), "".join(("aaaaaaaa", "bbbbbbbb")[c == "b"] for c in y)
    lines = spark.createDataFrame([(1, "\n".join(prose(4, 3) + [z[0]])), (2, "\n".join(prose(5, 3) + [z[1]]))], "doc_id long, text string")
    occurrences = {r.line for r in line_dedup._sketches(lines.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.lit(0).cast("long").alias("_t"))).collect()}
    assert len(occurrences) == 8


CLASHES = ["_id", "_text", "_t", "_i", "_u", "_g", "_c", "_k", "_n", "_whole", "removed", "_class", "_out", "_again", "g", "component", "bucket", "class",
           "size", "taken", "target", "copies", "severity", "toxic", "host", "rule", "_0", "_1", "_2", "kept", "runs", "lo", "mask", "word", "n", "_row", "_lp", "_w", "_d",
           "_item", "_judged", "similarity", "start", "group_id", "n_words"]


def test_clashing_names(spark):
    rows = [(1, " ".join(prose(1, 60)), "a"), (2, " ".join(prose(1, 60)), "a"), (3, "x y\nx y\n" + " ".join(prose(2, 70)), None), (None, None, "b")]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = plain.select("*", *[F.lit(f"{c}!").alias(c) for c in CLASHES])
    want = sorted(docs.columns)

    def same(f, names=None):
        a, b = f(plain), f(docs)
        names = names or a.columns
        assert sorted(map(repr, a.select(*names).collect())) == sorted(map(repr, b.select(*names).collect()))
        return b

    assert sorted(same(minhash_dedup.one_of_each, ["doc_id", "text"]).columns) == want
    assert sorted(same(line_dedup.without_repeats, ["doc_id", "text"]).columns) == want
    kept = line_dedup.without_repeats(docs).filter("doc_id = 3").first()
    assert kept["removed"] == "removed!" and kept["text"].startswith("x y\n") and kept["text"].count("x y") == 1
    same(line_dedup.dedup_report)
    same(minhash_dedup.near_duplicates, ["doc_id", "group_id", "group_rows", "kept"])
    same(substring_dedup.remove_repeats)
    same(mixing.mix_sources)
    same(token_count.token_counts)
    bench = spark.createDataFrame([(7, " ".join(prose(1, 60)), "x")], "item_id long, text string, _w string")
    found = same(lambda d: decontamination.leaks(d, bench))
    assert sorted(r.doc_id for r in found.collect()) == [1, 2]
    clean = decontamination.without_leaks(docs, found)
    assert sorted(clean.columns) == want and clean.count() == 2
    labels = spark.createDataFrame([(1, 1, "z"), (3, 0, "z")], "doc_id long, toxic int, _y string")
    graded = toxicity.severity(docs, toxicity.train(docs, labels))
    assert graded.count() == 4 and graded.first()["_text"] == "_text!"
    pages = docs.withColumn("url", F.lit("http://a.com/en/1")).drop("text")
    judged = url_filter.filter_urls(pages, url_filter.rules_table(spark)).first()
    assert judged["rule"] == "com/en/" and judged["_judged"] == "_judged!"
    assert lm_score.score(docs, lm_score.train(docs)).count() == 4


def leak_oracle(doc, item, similarity=0.8, k=5):
    """Best window by brute force over every start."""
    from collections import Counter

    bag = lambda w: Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
    want, best = bag(item), None
    size = min(len(item), len(doc))
    for at in range(len(doc) - size + 1):
        have = bag(doc[at : at + size])
        both = sum((have & want).values())
        s = both / (sum(have.values()) + sum(want.values()) - both)
        if s >= similarity and (best is None or s > best[0] + 1e-12):
            best = (s, at)
    return best


def test_reordered_and_inserted_passages(spark):
    r = random.Random(4)
    items, docs = [], []
    for n in range(40):
        item = prose(100 + n, r.choice([60, 80, 120, 200]))
        half = len(item) // 2
        shape = n % 5
        if shape == 0:  # halves exchanged
            held = item[half:] + item[:half]
        elif shape == 1:  # both ends trimmed, foreign words in the middle
            cut = max(1, len(item) // 30)
            held = item[cut:half] + prose(500 + n, len(item) // 20) + item[half:-cut]
        elif shape == 2:  # two foreign words apart
            held = list(item)
            held[5], held[half] = "foreign", "words"
        elif shape == 3:  # a repeated word at the end
            held = item[: -len(item) // 10] + ["echo"] * (len(item) // 10)
        else:  # thirds in another order
            t = len(item) // 3
            held = item[2 * t :] + item[:t] + item[t : 2 * t]
        items.append((n, " ".join(item)))
        docs.append((n, " ".join(prose(900 + n, r.randint(0, 150)) + held + prose(1500 + n, r.randint(0, 150)))))
    found = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(x.doc_id, x.item_id): (round(x.similarity, 9), x.start) for x in found.collect()}
    want = {}
    split = lambda t: [w for w in __import__("re").split(r"[^\w]+|_", t.lower()) if w]
    for (d, t), (i, u) in zip(docs, items, strict=True):
        best = leak_oracle(split(t), split(u))
        if best:
            want[(d, i)] = (round(best[0], 9), best[1])
    assert len(want) >= 24 and got == want


def test_recall_of_fingerprints_at_the_threshold(spark):
    """Of pairs of weighted similarity 0.80 to 0.82 at least 0.99 lie within the radius."""
    rng = np.random.default_rng(3)
    near = 0
    for _ in range(2000):
        n = int(rng.integers(50, 200))
        s = rng.uniform(0.80, 0.82)
        both = int(np.ceil(2 * n * s / (1 + s)))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate((a[:both], rng.integers(0, 2**63, n - both).astype(np.uint64)))
        a, b = text.mix(a), text.mix(b)
        bits = [((x[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(0) * 2 > n for x in (a, b)]
        near += int((bits[0] != bits[1]).sum() <= decontamination.RADIUS)
    assert near >= 0.995 * 2000
    assert sum(decontamination.WIDTHS) == 64 and 2 * len(decontamination.WIDTHS) - 1 >= decontamination.RADIUS


@pytest.mark.parametrize("n_words", [80_000])
def test_very_long_texts(spark, n_words):
    """A text of a million bytes, longer than any slice, goes through every operator on texts."""
    base = prose(7, n_words)
    lines = "\n".join(" ".join(base[i : i + 12]) for i in range(0, n_words, 12))
    near = lines.replace(base[50], "changed", 1)
    rows = [(1, lines, "a"), (2, near, "a"), (3, "short text", "b"), (4, " ".join(base[1000:1060]), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2)
    n = len(lines.split())
    groups = {r.doc_id: r.group_id for r in minhash_dedup.near_duplicates(docs).collect()}
    assert groups == {1: 1, 2: 1, 3: 3, 4: 4}
    cut = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect()}
    assert cut[1] == (n, 0) and n - 100 <= cut[2][1] < n and cut[4] == (60, 60)
    kept = {r.doc_id: r.text for r in line_dedup.without_repeats(docs).collect()}
    assert kept[1] == lines and 2 not in kept or len(kept[2]) < 200
    sizes = {r.doc_id: r["size"] for r in mixing.mix_sources(docs).collect()}
    assert sizes[1] == n
    bench = spark.createDataFrame([(1, " ".join(base[5000:5080]))], "item_id long, text string")
    assert {r.doc_id for r in decontamination.leaks(docs, bench).collect()} == {1, 2}
    assert {r.doc_id: r.n_words for r in token_count.token_counts(docs).collect()}[1] == n
    scored = {r.doc_id: r for r in lm_score.score(docs, lm_score.train(docs)).collect()}
    assert scored[1].n_words == n and scored[1].log_likelihood < 0
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    assert toxicity.severity(docs, toxicity.train(docs, labels)).count() == 4
    assert int(spark.conf.get(ARROW_BYTES).rstrip("b")) <= BATCH_BYTES
    assert hashlib.sha256(b"").hexdigest() not in {r.kept_sha256 for r in substring_dedup.remove_repeats(docs.filter("doc_id < 4")).collect() if r.doc_id == 3}


def test_entry_without_the_subpackage():
    code = "import sys, importlib.util as u\nsys.modules['tidewire.llm'] = None\nimport __spark_entry__ as e\nq = e.queries()\nassert q and not [x for x in q if x[:2] == 'op' and x[2].isdigit() or x == 'pipeline'], list(q)\nassert 'op9_url_filter' not in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=100)
    assert importlib.util.find_spec("tidewire.llm") is not None
