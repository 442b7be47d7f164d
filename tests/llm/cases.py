"""Small corpora with the cases that every operator must define."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, _id string, toxic string, kept string"


def words(text):
    return WORD.findall(text or "")


def prose(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    parts = ["th", "er", "on", "an", "ré", "in", "ed", "nd", "ß", "ing", "tion", "ou"]
    return ["".join(r.choice(parts) for _ in range(r.randint(1, 5))) for _ in range(n)]


def corpus() -> list[tuple]:
    """Rows of SCHEMA: nulls, blanks, long texts, exact and near copies, shared passages, repeated rows."""
    long_ = prose(1, 6000)
    a, b, shared = prose(2, 120), prose(3, 90), prose(4, 70)
    near = a[:60] + ["changed"] + a[61:]
    texts = {
        1: " ".join(a), 2: " ".join(near), 3: "\t".join(a), 4: " ".join(b), 5: " ".join(b[:40] + shared),
        6: " ".join(shared + prose(5, 30)), 7: "", 8: None, 9: " \n\t ", 10: "one", 11: "one", 12: " ".join(long_),
        13: " ".join(long_[:3000] + ["x"] + long_[3000:]), 14: "first line here now\nsecond line that is longer\n\nfirst line here now",
        15: "second line that is longer\nunlike", 16: "second line that is longes\nother thing", 17: "rep " * 200, 18: "rep " * 199,
    }
    rows = [(i, t, "en" if i % 2 else None, None if i % 7 == 0 else f"s{i % 3}", None, 5, "x", None, "k") for i, t in texts.items()]
    return rows + [rows[0], rows[4], (None, " ".join(a), None, "s0", 3, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


def frame(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA)


def union_find(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}
