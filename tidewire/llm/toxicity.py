"""Operator 2: toxicity severity by cumulative-link ordinal regression on sparse word features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.tables import in_arrow, numbered, picked
from tidewire.llm.text import hash_spans, mix, slices, spans, text_buffers
from tidewire.session import saved

#: Labelled rows that the model is fitted on at most: those first by hash of the id.
SAMPLE = 12_000
GRADES = 4
PREFIXES = (4, 5, 6)
#: A feature enters the model if it is in so many documents and its rates in toxic and other ones differ by so many standard errors.
LEAST_Z, LEAST_DOCS = 4.0, 4
_FOLD = np.full(256, 0x20, np.uint8)
for _c in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _FOLD[_c] = _c
for _c in range(0x41, 0x5B):
    _FOLD[_c] = _c + 32


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature hashes and their rows, then words per row: whole words (ASCII lower case, punctuation
    apart) and their first 4, 5 and 6 bytes."""
    b, offs = text_buffers(column)
    b = _FOLD[b]
    s, e = spans(b, offs)
    row = np.searchsorted(offs, s, "right") - 1
    hashes, rows = [hash_spans(b, s, e)], [row]
    for k in PREFIXES:
        at = e - s >= k
        hashes.append(mix(hash_spans(b, s[at], s[at] + k) + np.uint64(k)))
        rows.append(row[at])
    return np.concatenate(hashes), np.concatenate(rows), np.bincount(row, minlength=len(offs) - 1)


@dataclass
class Model:
    """Screened features (ascending hashes), one weight each for all thresholds, ordered thresholds."""

    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def grade_probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade = k) = P(grade <= k) - P(grade <= k - 1); P(grade <= k) = logistic(threshold k - score)."""
        upto = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))
        edges = np.concatenate((np.zeros((len(score), 1)), upto, np.ones((len(score), 1))), axis=1)
        return np.diff(edges, axis=1)


def _fit_ordinal(row: np.ndarray, col: np.ndarray, n_cols: int, y: np.ndarray, grades: int, ridge: float = 0.2):
    """Maximum likelihood with a ridge, by Adam over all rows; thresholds are a first one plus positive steps."""
    n = len(y)
    share = np.clip(np.cumsum(np.bincount(y, minlength=grades))[:-1] / n, 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    w, a, d = np.zeros(n_cols), first[0], np.log(np.maximum(np.diff(first), 0.05))
    p = np.concatenate((w, [a], d))
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, 401):
        w, th = p[:n_cols], np.cumsum(np.concatenate(([p[n_cols]], np.exp(p[n_cols + 1 :]))))
        s = np.bincount(row, w[col], n)
        ext = np.concatenate(([-np.inf], th, [np.inf]))
        hi, lo = (1 / (1 + np.exp(-np.clip(ext[y + j] - s, -40, 40))) for j in (1, 0))
        like = np.maximum(hi - lo, 1e-9)
        gh, gl = hi * (1 - hi) / like, lo * (1 - lo) / like
        gs = gh - gl  # derivative of -log likelihood by the score
        gth = np.zeros(grades + 1)
        np.add.at(gth, y + 1, -gh)
        np.add.at(gth, y, gl)
        gth = gth[1:grades]
        gd = np.cumsum(gth[::-1])[::-1]
        g = np.concatenate((np.bincount(col, gs[row], n_cols) + ridge * w, [gd[0]], gd[1:] * np.exp(p[n_cols + 1 :]))) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return p[:n_cols], np.cumsum(np.concatenate(([p[n_cols]], np.exp(p[n_cols + 1 :]))))


def fit(keys: np.ndarray, z: np.ndarray, rows: list[np.ndarray], words: np.ndarray, toxic: np.ndarray, grades: int = GRADES) -> Model:
    """Fit on each row's places in the screened ``keys``, whose class difference is ``z``. Grade 0 is not
    toxic; toxic rows fall into the others by the share of their words that carry toxic features (equal
    parts). With only one class present nothing can be told apart: all rows are graded 0."""
    n1 = int(toxic.sum())
    if not n1 or n1 == len(toxic):
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.full(grades - 1, 40.0))
    col = np.concatenate([np.zeros(0, np.int64), *rows])
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    share = np.bincount(row, (z > 0)[col].astype(float), len(rows)) / np.maximum(words, 1)
    y = np.zeros(len(rows), np.int64)
    order = np.argsort(share[toxic], kind="stable")
    y[np.flatnonzero(toxic)[order]] = 1 + np.arange(n1) * (grades - 1) // n1
    return Model(keys, *_fit_ordinal(row, col, len(keys), y, grades))


def _distinct(h: np.ndarray, row: np.ndarray, n: int) -> list[np.ndarray]:
    each = np.split(h[np.argsort(row, kind="stable")], np.cumsum(np.bincount(row, minlength=n))[:-1]) if n else []
    return [np.unique(x) for x in each]


def train(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least_z: float = LEAST_Z, least_docs: int = LEAST_DOCS,
    doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
) -> Model:
    """Fit on at most ``sample`` labelled documents, whole texts; labels repeated for an id count as toxic if any is.

    Executors count each feature's documents per class; features in ``least_docs`` documents or more
    whose classes differ by ``least_z`` standard errors reach the driver, then their places in each
    document. Both are bounded by the sample: of documents that share an id the least text counts, so
    an id is one row. Null ids and null labels are left out; no labelled document: all are graded 0."""
    marks = picked(labels, _id=doc_id, _label=label).filter("_id is not null and _label is not null")
    marks = marks.groupBy("_id").agg((F.max("_label") > 0).alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    marks = F.broadcast(saved(marks.withColumnRenamed("_id", "_k")))
    body = picked(docs, _id=doc_id, _text=text).join(marks, F.col("_id") == F.col("_k"))
    body = saved(body.groupBy("_id").agg(F.min("_text").alias("_text"), F.any_value("_y").alias("_y")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                h, row, _ = features(batch.column("_text"))
                each = _distinct(h, row, batch.num_rows)
                key, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *each]), return_inverse=True)
                toxic = np.repeat(np.asarray(batch.column("_y")).astype(bool), [len(x) for x in each])
                pos = np.bincount(at, toxic, len(key)).astype(np.int64)
                df = np.bincount(at, minlength=len(key))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(pos), pa.array(df)], names=["key", "pos", "df"])

    sizes = {r._y: r.n for r in body.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(True, 0), sizes.get(False, 0)
    if not n1 or not n0:
        return fit(np.zeros(0, np.uint64), np.zeros(0), [], np.zeros(0), np.zeros(0, bool))
    total = in_arrow(body, count, "key long, pos long, df long").groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("df").alias("df"))
    rate = F.col("df") / (n1 + n0)
    z = (F.col("pos") / n1 - (F.col("df") - F.col("pos")) / n0) / F.sqrt(rate * (1 - rate) * (1 / n1 + 1 / n0) + 1e-12)
    got = total.filter(F.col("df") >= least_docs).withColumn("z", z).filter(F.abs("z") >= least_z).select("key", "z").toPandas()
    keys = got["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys, z = keys[order], got["z"].to_numpy(float)[order]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                h, row, words = features(batch.column("_text"))
                at = np.append(np.searchsorted(keys, h), 0)[:-1]
                hit = np.append(keys, np.uint64(0))[at] == h
                hit &= at < len(keys)
                packed = pa.array([x.astype(np.int32).tobytes() for x in _distinct(at[hit], row[hit], batch.num_rows)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_y"), pa.array(words, pa.int64()), packed], names=["_id", "_y", "words", "packed"])

    kind = dict(body.dtypes)["_id"]
    rows = in_arrow(body, place, f"_id {kind}, _y boolean, words long, packed binary").toPandas().sort_values(["_id", "packed"], kind="stable")
    return fit(keys, z, [np.frombuffer(x, np.int32).astype(np.int64) for x in rows["packed"]], rows["words"].to_numpy(), rows["_y"].to_numpy(bool))


def severity(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``severity`` (expected grade), ``p_toxic`` (P(grade >= 1)), ``grade``
    (most probable) and ``toxic`` (p_toxic >= 0.5); input columns so named give way, others may have any name.

    A feature counts once per document. Null and empty texts have no features. Whole texts are read,
    however long. Repeated rows get repeated results.
    """
    names = ["severity", "p_toxic", "grade", "toxic"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    body, at = numbered(docs)
    words = body.columns.index(at[text])
    kept = [i for i, c in enumerate(docs.columns) if c.lower() not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        maybe = np.zeros(1 << 16, bool)
        maybe[m.keys & np.uint64(0xFFFF)] = True
        for whole in batches:
            for batch in slices(whole, f"_{words}"):
                h, row, _ = features(batch.column(words))
                at = np.flatnonzero(maybe[h & np.uint64(0xFFFF)])
                place = np.searchsorted(m.keys, h[at])
                hit = np.append(m.keys, np.uint64(0))[place] == h[at]
                at, place = at[hit & (place < len(m.keys))], place[hit & (place < len(m.keys))]
                pairs = np.unique(row[at] * max(len(m.keys), 1) + place)
                r, c = np.divmod(pairs, max(len(m.keys), 1))
                p = m.grade_probabilities(np.bincount(r, m.weights[c] if len(c) else None, batch.num_rows).astype(float))
                e = p @ np.arange(p.shape[1])
                cols = [pa.array(e), pa.array(1 - p[:, 0]), pa.array(p.argmax(1).astype(np.int32)), pa.array(1 - p[:, 0] >= 0.5)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *cols], names=[*(f"_{i}" for i in kept), *names])

    kinds = "".join(f"`_{i}` {body.dtypes[i][1]}, " for i in kept)
    graded = in_arrow(body, run, f"{kinds}severity double, p_toxic double, grade int, toxic boolean")
    return graded.toDF(*(docs.columns[i] for i in kept), *names)
