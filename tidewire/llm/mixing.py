"""Operator 7: mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.llm.tables import picked
from tidewire.session import saved

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 7
#: The dynamic programme fits the last so many words of a budget; its state is one bit per word.
SPAN = 1 << 17
#: Seeded-hash cells by which documents of one source and size are chosen without sorting them all.
CELLS = 4096


def text_size(text: Column) -> Column:
    """Runs of characters other than space and 0x09-0x0D; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Add ``target`` to one row per source (``source, source_size``).

    Sources ordered by code point, null last, take the weights in turn. Targets share the sum of all
    sizes by weight, none above ``cap`` times its source: the excess is reshared by weight until none
    is above. That limit is min(cap * size, weight * level) with one level for all, found by prefix
    sums over sources in the order in which they fill up. All sizes zero: all targets zero.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("_i", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("_w", w).withColumn("_most", F.col("source_size") * float(cap))
    order = W.orderBy(F.col("_most") / F.col("_w"), "_i")
    before, every = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("_most").over(before), F.lit(0.0))) / (
        F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    )
    ranked = ranked.withColumn("_level", level)
    fills = F.col("_level") <= F.col("_most") / F.col("_w")
    ranked = ranked.withColumn("_level", F.min_by("_level", F.when(fills, F.col("_most") / F.col("_w"))).over(every))
    target = F.least("_most", F.col("_w") * F.coalesce("_level", F.lit(float("inf"))))
    return ranked.select("source", "source_size", target.alias("target"))


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: float, span: int = SPAN) -> np.ndarray:
    """How many documents of each length to take so that their words come nearest to ``budget``.

    Each length gives its even share first; then the largest that still fit, until at most ``span``
    words are open; then a bounded-knapsack subset sum (multiplicities split into powers of two, one
    bit per reachable sum) picks the rest exactly. A sum just above the budget is taken if nearer.
    """
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    goal = min(int(round(budget)), total)
    if goal <= 0 or not total:
        return take
    if goal > span:
        take = np.minimum(counts, np.floor(counts * (max(0, goal - span // 2) / total)).astype(np.int64))
    open_ = goal - int((lengths * take).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if open_ <= span // 2:
            break
        n = min(int(counts[i] - take[i]), max(0, open_ - span // 4) // int(lengths[i]) if lengths[i] else 0)
        take[i] += n
        open_ -= n * int(lengths[i])
    limit = 2 * open_  # what lies above is nearer than nothing only up to there
    mask, reach, steps = (1 << (limit + 1)) - 1, 1, []
    for i in np.argsort(-lengths, kind="stable"):
        size, left, part = int(lengths[i]), int(counts[i] - take[i]), 1
        if not 0 < size <= limit:
            continue
        left = min(left, limit // size)
        while left > 0:
            n = min(part, left)
            steps.append((i, n, reach))
            reach |= (reach << (n * size)) & mask
            left -= n
            part *= 2
        if reach >> open_ & 1:
            break
    under = (reach & ((1 << (open_ + 1)) - 1)).bit_length() - 1
    above = reach >> (open_ + 1)
    best = under
    if above and (above & -above).bit_length() < open_ - under:
        best = open_ + (above & -above).bit_length()
    for i, n, before in reversed(steps):
        if not before >> best & 1:
            take[i] += n
            best -= n * int(lengths[i])
    return take


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    cap: int = CAP,
    seed: int = SEED,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, size, source_size, target, taken``.

    A source takes all its documents floor(target / size of source) times, and once more a subset
    whose words fit the rest: documents counted by exact length, a subset sum over the counts, and
    within a length the documents first by seeded hash (ties by id). Taken words of a document are
    at most ``cap`` times its size; an empty or null text has size 0 and takes 0. A null source is a
    source. Repeated rows are separate documents. Reruns agree, whatever the partitioning.
    """
    rows = picked(docs, _id=doc_id, source=source, _text=text).select(
        "_id", "source", text_size(F.col("_text")).alias("size"), F.xxhash64(F.lit(seed), "_id", "_text").alias("_h")
    )
    rows = saved(rows.withColumn("_cell", F.pmod("_h", F.lit(CELLS)).cast("int")))
    lengths = saved(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    per_source = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = saved(source_targets(per_source, weights, cap))
    budgets = targets.withColumn(
        "copies", F.when(F.col("source_size") > 0, F.least(F.lit(cap), F.floor(F.col("target") / F.col("source_size")))).otherwise(0)
    ).withColumn("rest", F.when(F.col("copies") < cap, F.col("target") - F.col("copies") * F.col("source_size")).otherwise(0.0))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size")
        return part.assign(picks=fit_budget(part["size"].to_numpy(), part["n"].to_numpy(), float(part["rest"].iloc[0])))

    named = lengths.join(budgets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    plan = saved(
        named.select("source", "size", "n", "source_size", "target", "copies", "rest")
        .groupBy("source")
        .applyInPandas(
            fit, "source string, size long, n long, source_size long, target double, copies long, rest double, picks long"
        )
    )
    # Cells below the one where the picks end are taken whole; only that cell's rows are ranked.
    cells = rows.groupBy("source", "size", "_cell").agg(F.count("*").alias("m"))
    run = W.partitionBy("source", "size").orderBy("_cell")
    upto = cells.withColumn("before", F.sum("m").over(run) - F.col("m"))
    p = plan.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "source_size", "target", "copies", "picks")
    cut = upto.join(p, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))).select(
        F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("_cell").alias("_c"), "source_size", "target", "copies",
        F.least(F.greatest(F.col("picks") - F.col("before"), F.lit(0)), F.col("m")).alias("quota"), "m",
    )
    at = rows.join(cut, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("_cell") == F.col("_c")))
    split = (F.col("quota") > 0) & (F.col("quota") < F.col("m"))
    rank = F.row_number().over(W.partitionBy("source", "size", "_cell").orderBy("_h", "_id"))
    whole = at.filter(~split).withColumn("more", F.when(F.col("quota") > 0, 1).otherwise(0))
    ends = at.filter(split).withColumn("more", F.when(rank <= F.col("quota"), 1).otherwise(0))
    taken = (F.col("size") * (F.col("copies") + F.col("more"))).cast("long")
    return whole.unionByName(ends).select(
        F.col("_id").alias(doc_id), "size", "source_size", "target", taken.alias("taken")
    )
