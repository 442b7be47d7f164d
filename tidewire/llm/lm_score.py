"""Operator 10: masked pseudo-likelihood by a bidirectional window network trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.tables import in_arrow, picked
from tidewire.llm.text import mix, slices, words_of
from tidewire.session import saved

#: The network predicts a word's id, one of so many, in two steps: its class, then the id among the class's.
#: Its size is fixed by these and does not grow with the data. Counts are kept per word and do.
IDS, WIDTH, CLASSES, SIDE = 1 << 14, 16, 128, 2
#: Share of positions masked and predicted in training, over all documents; scoring predicts every one.
MASKED, ROUNDS, RATE, BATCH = 0.15, 2, 0.15, 2048
#: Positions of one class scored at once: their arrays stay in the cache. Training moves the ids of one class in TURN per batch.
SCORED, TURN = 768, 4
PIECE = 1 << 14
FANIN = 32
#: Added to every word's count; each id has one more word of count 0, which stands for the unseen ones.
SMOOTH = 0.5
#: The most frequent words, so many at most, are looked up in each task; the others are joined.
FREQUENT = 1 << 16


@dataclass
class Vocabulary:
    """Counts of all words (``table``: word, n) and, of each id, log of the sum of n + SMOOTH over its
    words and the unseen one. ``frequent`` are the sorted words of bin ``least`` on and ``log_n`` their counts."""

    table: DataFrame
    log_total: np.ndarray
    frequent: np.ndarray
    log_n: np.ndarray
    least: int


@dataclass
class Network:
    """h = tanh(b + sum over window places j of A[j] * E[id at j]); P(class) = softmax(h W + c);
    P(id | class) = softmax over the class's ids of h V[id] + log_within[id]; P(word | id) follows the exact
    counts in ``vocabulary``. So both sides reach the id, and words of one id differ by their counts.
    Id IDS stands for places beyond the text."""

    E: np.ndarray
    A: np.ndarray
    b: np.ndarray
    W: np.ndarray
    c: np.ndarray
    V: np.ndarray
    class_of: np.ndarray
    log_within: np.ndarray
    vocabulary: Vocabulary | None = None

    NAMES = ("E", "A", "b", "W", "c", "V")

    def vector(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def with_vector(self, v: np.ndarray) -> Network:
        parts, at = {}, 0
        for n in self.NAMES:
            old = getattr(self, n)
            parts[n] = v[at : at + old.size].reshape(old.shape).astype(np.float32)
            at += old.size
        return Network(**parts, class_of=self.class_of, log_within=self.log_within, vocabulary=self.vocabulary)

    def hidden(self, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.E[ctx]
        return x, np.tanh(np.einsum("njd,jd->nd", x, self.A) + self.b)

    def log_classes(self, h: np.ndarray) -> np.ndarray:
        z = h @ self.W + self.c
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def members(self) -> list[np.ndarray]:
        """Ids of each class, ascending."""
        order = np.argsort(self.class_of, kind="stable")
        return np.split(order, np.cumsum(np.bincount(self.class_of, minlength=CLASSES))[:-1])

    def by_class(self, ids: np.ndarray, members: list[np.ndarray], turn: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each class that occurs (of those whose turn it is), the positions of ``ids`` in it, and their places among its ids."""
        cls = self.class_of[ids]
        order = np.argsort(cls, kind="stable")
        ends = np.cumsum(np.bincount(cls, minlength=CLASSES))
        for k in np.flatnonzero(np.diff(ends, prepend=0)):
            if turn is None or (k - turn) % TURN == 0:
                at = order[ends[k - 1] if k else 0 : ends[k]]
                yield k, at, np.searchsorted(members[k], ids[at])

    def scores(self, h: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Scores of the ids ``own`` of one class, up to a constant a row: log P(id | class, both sides)."""
        z = h @ self.V[own].T
        z += self.log_within[own].astype(np.float32)
        return z

    def log_prob(self, ids: np.ndarray, ctx: np.ndarray, members: list[np.ndarray] | None = None) -> np.ndarray:
        """log P(id | both sides)."""
        out, members = np.empty(len(ids)), members or self.members()
        for k, all_, places in self.by_class(ids, members):
            own = members[k]
            for lo in range(0, len(all_), SCORED):
                at, place = all_[lo : lo + SCORED], places[lo : lo + SCORED]
                h = self.hidden(ctx[at])[1]
                z = h @ self.W
                z += self.c
                y = self.scores(h, own)
                out[at] = z[:, k] + y[np.arange(len(at)), place] - _log_sum(z) - _log_sum(y)
        return out

    def step(self, ids: np.ndarray, ctx: np.ndarray, rate: float, members: list[np.ndarray] | None = None, turn: int | None = None) -> None:
        """One gradient step on the mean of -log P(id | both sides); ids of a class move when its turn comes."""
        n = np.float32(len(ids))
        x, h = self.hidden(ctx)
        g = np.exp(self.log_classes(h))
        g[np.arange(len(ids)), self.class_of[ids]] -= 1
        back = g @ self.W.T
        # An id, like a word in a window, is rare in a batch: its rows take the summed gradient over sqrt(n).
        members = members or self.members()
        for k, at, place in self.by_class(ids, members, turn):
            own = members[k]
            q = self.scores(h[at], own)
            q -= q.max(1, keepdims=True)
            np.exp(q, out=q)
            q /= q.sum(1, keepdims=True)
            q[np.arange(len(at)), place] -= 1
            back[at] += q @ self.V[own]
            self.V[own] -= np.float32(rate / np.sqrt(n)) * (q.T @ h[at])
        gh = back * (1 - h * h)
        self.W -= np.float32(rate) * (h.T @ g) / n
        self.c -= np.float32(rate) * g.sum(0) / n
        gx = gh[:, None, :] * self.A[None]
        self.A -= np.float32(rate) * np.einsum("njd,nd->jd", x, gh) / n
        self.b -= np.float32(rate) * gh.sum(0) / n
        flat = (ctx.reshape(-1, 1) * self.E.shape[1] + np.arange(self.E.shape[1])).ravel()
        np.add.at(self.E.reshape(-1), flat, (gx * np.float32(-rate / np.sqrt(n))).ravel())


def _log_sum(z: np.ndarray) -> np.ndarray:
    """log of the sum of exp along rows; ``z`` is used up."""
    top = z.max(1)
    z -= top[:, None]
    np.exp(z, out=z)
    return top + np.log(z.sum(1))


def initial(counts: np.ndarray, seed: int = 10) -> Network:
    """Classes of about equal mass over ids by falling count, and a seeded start."""
    rng = np.random.default_rng(seed)
    mass = counts + 0.5
    order = np.argsort(-mass, kind="stable")
    upto = np.cumsum(mass[order])
    class_of = np.empty(len(counts), np.int64)
    class_of[order] = np.minimum((upto - mass[order] / 2) * CLASSES / upto[-1], CLASSES - 1).astype(np.int64)
    total = np.bincount(class_of, mass, CLASSES)
    draw = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
    return Network(
        E=draw(len(counts) + 1, WIDTH), A=1 + draw(2 * SIDE, WIDTH), b=np.zeros(WIDTH, np.float32), W=draw(WIDTH, CLASSES),
        c=np.log((total + 1) / (total + 1).sum()).astype(np.float32), V=np.zeros((len(counts), WIDTH), np.float32), class_of=class_of,
        log_within=np.log(mass / total[class_of]),
    )


def windows(ids: np.ndarray, offs: np.ndarray, pad: int) -> np.ndarray:
    """Ids of the SIDE words before and after each word of the same row, ``pad`` beyond its ends."""
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    out = np.full((len(ids), 2 * SIDE), pad, np.int64)
    for j, k in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        to = np.arange(max(0, -k), len(ids) - max(0, k))
        same = to[row[to] == row[to + k]] if len(to) else to
        out[same, j] = ids[same + k]
    return out


def _ids(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(IDS)).astype(np.int64)


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """``word, n``: occurrences of each word (its 64-bit hash) over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                word, n = np.unique(words_of(batch.column("_text"))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])

    return in_arrow(picked(docs, _text=text), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _bin() -> Column:
    """Quarter octave of a word's count."""
    return F.floor(F.log2("n") * 4).cast("int")


def _start(docs: DataFrame, text: str) -> Network:
    """The untrained network of the corpus, with its vocabulary."""
    table = saved(word_counts(docs, text))
    got = table.groupBy(F.col("word").bitwiseAND(F.lit(IDS - 1)).alias("id")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).toPandas()
    counts, words, at = np.zeros(IDS), np.zeros(IDS), got["id"].to_numpy(np.int64)
    counts[at], words[at] = got["n"].to_numpy(), got["words"].to_numpy()
    net = initial(counts)
    total = counts + SMOOTH * words + SMOOTH
    least, held = 1 << 30, 0
    for r in sorted(table.groupBy(_bin().alias("bin")).count().collect(), reverse=True):
        held += r["count"]
        if held > FREQUENT:
            break
        least = r["bin"]
    top = table.filter(_bin() >= least).toPandas()
    word, n = top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(word)
    return replace(net, vocabulary=Vocabulary(table, np.log(total), word[order], np.log(n[order] + SMOOTH), least))


def _summed(rows: DataFrame, by: list[str]) -> DataFrame:
    """Sum of the weighted vectors with the same keys, added up as they stream in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for batch in batches:
            for k, s, n, v in zip(*(batch.column(c).to_pylist() for c in ("piece", "salt", "n", "v")), strict=True):
                have = total.setdefault((k, s if "salt" in by else 0), [0, 0.0])
                have[0] += n
                have[1] = have[1] + np.frombuffer(v, np.float64)
        out = [(k, s, n, v.tobytes()) for (k, s), (n, v) in sorted(total.items())]
        for k, s, n, v in out:
            yield pa.RecordBatch.from_pylist([{"piece": k, "salt": s, "n": n, "v": v}], pa.schema([("piece", pa.int32()), ("salt", pa.int32()), ("n", pa.int64()), ("v", pa.binary())]))

    return in_arrow(rows.repartition(*by), run, "piece int, salt int, n long, v binary")


def train(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> Network:
    """Train over all documents: in each round every task takes gradient steps on its own rows from
    the shared parameters, and their changes are averaged by words seen. What is gathered follows
    the input; what reaches the driver is one network of fixed size and the most frequent words."""
    spark: SparkSession = docs.sparkSession
    net = _start(docs, text)
    for k in range(rounds):
        shared, rate = spark.sparkContext.broadcast(replace(net, vocabulary=None)), RATE / (k + 1)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, rate=rate, k=k) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            start = shared.value
            own, seen, members = start.with_vector(start.vector()), 0, start.members()
            for whole in batches:
                for batch in slices(whole, "_text"):
                    h, offs = words_of(batch.column("_text"))
                    if not len(h):
                        continue
                    ids = _ids(h)
                    ctx = windows(ids, offs, IDS)
                    place = np.arange(len(ids), dtype=np.uint64) + (ids.astype(np.uint64) << np.uint64(32))
                    at = np.flatnonzero(mix(place + np.uint64(k << 60)) < np.uint64(int(MASKED * 2**64)))
                    for lo in range(0, len(at), BATCH):
                        p = at[lo : lo + BATCH]
                        own.step(ids[p], ctx[p], rate * len(p) / BATCH, members, lo // BATCH + seen)
                    seen += len(at)
            change = (own.vector().astype(np.float64) - start.vector()) * seen
            salt = TaskContext.get().partitionId() % FANIN
            for i, lo in enumerate(range(0, len(change), PIECE)):
                yield pa.RecordBatch.from_pylist([{"piece": i, "salt": salt, "n": seen, "v": change[lo : lo + PIECE].tobytes()}], pa.schema([("piece", pa.int32()), ("salt", pa.int32()), ("n", pa.int64()), ("v", pa.binary())]))

        parts = in_arrow(picked(docs, _text=text), run, "piece int, salt int, n long, v binary")
        got = _summed(_summed(parts, ["piece", "salt"]), ["piece"]).toPandas().sort_values("piece")
        if len(got) and got["n"].iloc[0]:
            v = np.concatenate([np.frombuffer(x, np.float64) for x in got["v"]]) / got["n"].iloc[0]
            net = net.with_vector(net.vector() + v)
        shared.unpersist()
    return net


def score(docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_words, log_likelihood`` (sum over words of log P(word | both sides)) and
    ``per_word`` (their mean; null without words). P(word | both sides) = P(id | both sides) times the
    word's own share of its id. Null and empty texts score 0 words and 0.0; repeated rows get repeated
    results; other columns are not read."""
    v = net.vocabulary
    shared = docs.sparkSession.sparkContext.broadcast((replace(net, vocabulary=None), v.log_total, v.frequent, v.log_n))
    key = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, log_total, frequent, log_n = shared.value
        members = own.members()
        for whole in batches:
            for batch in slices(whole, "_text"):
                h, offs = words_of(batch.column("_text"))
                ids, n = _ids(h), np.diff(offs)
                lp, rare = np.zeros(0), np.zeros(0, bool)
                if len(h):
                    lp = own.log_prob(ids, windows(ids, offs, IDS), members) - log_total[ids]
                    rare = np.ones(len(h), bool)
                    if len(frequent):
                        at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
                        rare = frequent[at] != h
                        lp += np.where(rare, 0.0, log_n[at])
                row = np.repeat(np.arange(len(n)), n)
                total = np.bincount(row, lp, len(n)).astype(float)
                upto = np.concatenate(([0], np.cumsum(rare)))[offs]
                lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(h[rare].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_id"), pa.array(n, pa.int64()), pa.array(total), lists], names=["_row", "_id", "_n", "_lp", "_rare"])

    body = picked(docs, _id=doc_id, _text=text).withColumn("_row", F.monotonically_increasing_id())
    # Written once, so that both reads see the same row numbers.
    part = saved(in_arrow(body, run, f"_row long, _id {key}, _n long, _lp double, _rare array<long>"))
    rare = part.select("_row", F.explode("_rare").alias("_word"))
    known = v.table.filter(_bin() < v.least)
    n = F.coalesce(F.col("n"), F.lit(0))
    rest = rare.join(known, F.col("_word") == F.col("word"), "left").groupBy(F.col("_row").alias("_r")).agg(F.sum(F.log(n + SMOOTH)).alias("_more"))
    all_ = part.drop("_rare").join(rest, F.col("_row") == F.col("_r"), "left").withColumn("_all", F.col("_lp") + F.coalesce(F.col("_more"), F.lit(0.0)))
    mean = F.when(F.col("_n") > 0, F.col("_all") / F.col("_n"))
    return all_.select(F.col("_id").alias(doc_id), F.col("_n").alias("n_words"), F.col("_all").alias("log_likelihood"), mean.alias("per_word"))
