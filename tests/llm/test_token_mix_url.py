import itertools
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.cases import corpus, frame, words
from tidewire.llm import mixing, token_count, url_filter


def greedy(word, pieces):
    n, at = 0, 0
    while at < len(word):
        for to in range(len(word), at, -1):
            if word[at:to] in pieces:
                n, at = n + 1, to
                break
        else:
            return -1
    return n


@settings(deadline=None, max_examples=200)
@given(st.sets(st.text("abc", min_size=1, max_size=5), max_size=15), st.text("abc", max_size=14))
def test_automaton_equals_greedy(pieces, word):
    assert token_count.Automaton(pieces).count(word) == greedy(word, pieces)


def test_token_counts_equal_greedy_on_the_public_vocabulary(spark):
    pieces = set(token_count.read_pieces())
    got = token_count.token_counts(frame(spark)).toPandas()
    want = Counter()
    for i, t, *_ in corpus():
        c = [greedy("▁" + w, pieces) for w in words(t)]
        want[(i, len(c), sum(x if x >= 0 else 1 for x in c), sum(x < 0 for x in c))] += 1
    have = Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.n_words, r.n_tokens, r.n_unknown) for r in got.itertuples())
    assert have == want
    assert token_count.token_counts(frame(spark, [])).count() == 0


@settings(deadline=None, max_examples=150)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), min_size=1, max_size=6), st.floats(0, 200))
def test_budget_is_fitted_best(counts, budget):
    lengths = np.array(sorted(counts))
    n = np.array([counts[k] for k in lengths])
    take = mixing.fit_budget(lengths, n, budget)
    assert ((0 <= take) & (take <= n)).all()
    goal = min(round(budget), int((lengths * n).sum()))
    sums = {sum(k * c for k, c in zip(lengths, x, strict=True)) for x in itertools.product(*[range(c + 1) for c in n])}
    assert abs(int((lengths * take).sum()) - goal) == min(abs(s - goal) for s in sums)


def test_budget_beyond_the_programme():
    lengths, counts = np.arange(1, 500), np.full(499, 200)
    for budget in (10, 1_000_003, 17_000_001):
        assert int((lengths * mixing.fit_budget(lengths, counts, budget)).sum()) == budget


def water(sizes, weights, cap=3):
    target, open_, left = {}, set(sizes), sum(sizes.values())
    while open_:
        w = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / w > cap * sizes[s]}
        if not full:
            return target | {s: left * weights[s] / w for s in open_}
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mix(spark):
    got = mixing.mix_sources(frame(spark)).toPandas()
    rows = corpus()
    sizes = Counter()
    for _, t, _, s, *_ in rows:
        sizes[s] += len(words(t))
    order = sorted(x for x in sizes if x is not None) + [None]
    want = water(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    assert len(got) == len(rows)
    assert sorted(got["size"]) == sorted(len(words(t)) for _, t, *_ in rows)
    for s, part in got.groupby("source_size"):
        assert any(abs(want[k] - part.target.iloc[0]) < 1e-6 for k in want if sizes[k] == s)
    assert (got.taken <= 3 * got["size"]).all()
    again = mixing.mix_sources(frame(spark).repartition(3)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    assert mixing.mix_sources(frame(spark, [])).count() == 0
    none = mixing.mix_sources(frame(spark, [(1, "", None, None) + (None,) * 5, (2, None, None, "a") + (None,) * 5])).collect()
    assert [(r.target, r.taken) for r in none] == [(0.0, 0), (0.0, 0)]


@pytest.mark.parametrize("cells", [1, 4096])
def test_quota_is_exact_with_many_equal_lengths(spark, monkeypatch, cells):
    monkeypatch.setattr(mixing, "CELLS", cells)
    rows = [(i, "a b", None, "x" if i < 100 else "y") + (None,) * 5 for i in range(150)]
    got = mixing.mix_sources(frame(spark, rows)).toPandas()
    # y gets weight 2 of 7 of 300 words: 85.7; x 214.3.
    assert got.groupby("source_size").taken.sum().to_dict() == {100: 86, 200: 214}


URLS = {
    "http://A.com/en/x": ("a.com", "/en/x", "com/en/", "block"),
    "https://www.example.com/en/742?q": ("www.example.com", "/en/742", "example.com/en/7", "allow"),
    "https://example.net/de/8": ("example.net", "/de/8", "example.net/de/8", "block"),
    "https://x.example.net/de/1": ("x.example.net", "/de/1", "net/de/", "allow"),
    "https://notexample.net/de/8": ("notexample.net", "/de/8", "net/de/", "allow"),
    "x://com/en/": ("com", "/en/", "com/en/", "block"),
    "x://org#/es/": ("org", "", None, "allow"),
    "x://a.org?/es/": ("a.org", "", None, "allow"),
    "no scheme com/en/": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "x://É.COM/en/": ("É.com", "/en/", "com/en/", "block"),
    "a://b.com/en/://c.org/es/": ("b.com", "/en/://c.org/es/", "com/en/", "block"),
    "x://" + "a." * 3000 + "org/es/" + "y" * 5000: ("a." * 3000 + "org", "/es/" + "y" * 5000, "org/es/", "block"),
    "x://h\n.org/es/\n": ("h\n.org", "/es/\n", "org/es/", "block"),
}


def test_urls(spark):
    rows = [(i, u, "h", "v") for i, u in enumerate(URLS)] + [(99, "http://A.com/en/x", None, None)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, url_filter.rules_table(spark)).collect()}
    assert got == {(i, *v) for i, v in enumerate(URLS.values())} | {(99, *URLS["http://A.com/en/x"])}
    assert url_filter.filter_urls(pages, url_filter.rules_table(spark)).count() == len(rows)
    assert url_filter.filter_urls(pages.limit(0), url_filter.rules_table(spark)).count() == 0
    none = url_filter.filter_urls(pages, url_filter.rules_table(spark).limit(0)).collect()
    assert len(none) == len(rows) and {r.verdict for r in none} == {"allow"}
