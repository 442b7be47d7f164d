"""Range, as-of and comparison joins written as equi joins on time buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Keys = Sequence[str]


def band_join(left: DataFrame, right: DataFrame, lt: str, rt: str, window: float, keys: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Pairs with 0 <= right time - left time <= window: left rows go to their bucket of that width and
    the next, right rows to their own, so the join is an equi join with a filter, not a nested loop."""
    bucket = lambda c: F.floor(F.col(c) / window).cast("long")
    a = left.withColumn("_b", F.explode(F.array(bucket(lt), bucket(lt) + 1)))
    b = right.withColumn("_rb", bucket(rt))
    on = F.col("_b") == F.col("_rb")
    for x, y in keys:
        on = on & (F.col(x) == F.col(y))
    gap = F.col(rt) - F.col(lt)
    return a.join(b, on).filter((gap >= 0) & (gap <= window)).drop("_b", "_rb")


def asof_merge(left: DataFrame, right: DataFrame, keys: Keys, lt: str, rt: str, take: Sequence[str], forward: bool = False, tie: str | None = None) -> DataFrame:
    """Each left row with the nearest right row at or before it (after it: ``forward``).

    One sort of both sides together and a running last value: a single shuffle on the keys, whatever
    the distance. ``take`` columns of the right are added with the prefix ``asof_``.
    """
    pack = F.struct(F.col(rt).alias("t"), *[F.col(c) for c in take])
    a = left.withColumns({"_t": F.col(lt), "_side": F.lit(1), "_r": F.lit(None).cast(right.select(pack.alias("p")).schema["p"].dataType)})
    b = right.select(*[F.col(k) for k in keys], *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in keys], F.col(rt).alias("_t"), F.lit(2 if forward else 0).alias("_side"), pack.alias("_r"))
    both = a.unionByName(b)
    order = [F.col("_t"), F.col("_side"), *([F.col(tie)] if tie else [])]
    w = W.partitionBy(*keys).orderBy(*order)
    w = w.rowsBetween(0, W.unboundedFollowing) if forward else w.rowsBetween(W.unboundedPreceding, 0)
    hit = (F.first("_r", True) if forward else F.last("_r", True)).over(w)
    out = both.withColumn("_hit", hit).filter("_side = 1")
    return out.select(*left.columns, F.col("_hit.t").alias("asof_t"), *[F.col(f"_hit.{c}").alias(f"asof_{c}") for c in take])


def first_follower(df: DataFrame, keys: Keys, kind: str, at: str, order: Keys, leader: str, follower: str, window: float) -> DataFrame:
    """For each leader row the first later follower within ``window``: id, delay."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(1, W.unboundedFollowing)
    nxt = F.first(F.when(F.col(kind) == follower, F.col(at)), True).over(w)
    out = df.withColumn("delay", nxt - F.col(at)).filter(F.col(kind) == leader)
    return out.filter(F.col("delay") <= window)


def message_pairs(df: DataFrame, at: str, kind: str, window: float, least: int, keys: Keys = ()) -> DataFrame:
    """Ordered pairs of unlike kinds within ``window`` of each other: count, mean delay and confidence 1 / (1 + cv)."""
    right = df.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col(at).alias("r_at"), F.col(kind).alias("r_kind"))
    left = df.select(*keys, at, kind)
    met = band_join(left, right, at, "r_at", window, [(k, f"r_{k}") for k in keys]).filter((F.col(kind) != F.col("r_kind")) & (F.col("r_at") > F.col(at)))
    d = F.col("r_at") - F.col(at)
    g = met.groupBy(F.col(kind).alias("kind_a"), F.col("r_kind").alias("kind_b")).agg(F.count("*").alias("n"), F.avg(d).alias("mean_delay"), F.stddev_pop(d).alias("_s"))
    cv = F.when(F.col("mean_delay") > 0, F.col("_s") / F.col("mean_delay")).otherwise(0.0)
    return g.filter(F.col("n") >= least).select("kind_a", "kind_b", "n", "mean_delay", (1 / (1 + cv)).alias("confidence"))


def context_window(df: DataFrame, keys: Keys, order: Keys, trigger: Column, before: int, after: int) -> DataFrame:
    """Rows within ``before`` and ``after`` rows of a row where the trigger holds."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(-after, before)
    return df.withColumn("_hit", F.max(trigger.cast("int")).over(w)).filter("_hit = 1").drop("_hit")


def compare_recordings(base: DataFrame, other: DataFrame, key: str, at: str, tolerance: float = 0.2) -> DataFrame:
    """Full outer compare by id: new, disappeared, frequency changed (relative change above the tolerance) or same."""

    def inventory(df: DataFrame, tag: str) -> DataFrame:
        dur = F.max(at) - F.min(at)
        return df.groupBy(F.col(key).alias(f"{tag}_id")).agg(F.count("*").alias(f"{tag}_n"), F.when(dur > 0, (F.count("*") - 1) / dur).alias(f"{tag}_freq"))

    met = inventory(base, "a").join(inventory(other, "b"), F.col("a_id") == F.col("b_id"), "full")
    change = F.abs(F.col("b_freq") - F.col("a_freq")) / F.col("a_freq")
    verdict = F.when(F.col("a_id").isNull(), "new").when(F.col("b_id").isNull(), "disappeared").when(change > tolerance, "frequency_changed").otherwise("same")
    return met.select(F.coalesce("a_id", "b_id").alias("id"), "a_n", "b_n", verdict.alias("verdict"))


def zip_traces(left: DataFrame, right: DataFrame, keys: Keys, value: str, op: Column) -> DataFrame:
    """Positional join of two traces; ``op`` uses columns ``a`` and ``b``."""
    a = left.select(*keys, F.col(value).alias("a"))
    b = right.select(*keys, F.col(value).alias("b"))
    return a.join(b, list(keys)).withColumn("value", op)


def lookup(df: DataFrame, names: DataFrame, key: str, name_key: str) -> DataFrame:
    """Left lookup in a dimension table; the optimizer broadcasts it by its measured size."""
    return df.join(names, df[key] == names[name_key], "left")


def request_response(requests: DataFrame, responses: DataFrame, keys: Keys, at: str, req_id: str, resp_id: str, max_delay: float) -> DataFrame:
    """Greedy one-to-one matching per key group: responses in time order take the earliest open request
    within ``max_delay``. Candidates come from a band join; only a group's candidates meet in one task."""
    r = requests.select(*keys, F.col(at).alias("t0"), F.col(req_id).alias("request"))
    s = responses.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(at).alias("t1"), F.col(resp_id).alias("response"))
    met = band_join(r, s, "t0", "t1", max_delay, [(k, f"_{k}") for k in keys]).drop(*[f"_{k}" for k in keys])

    def match(pdf):
        used, taken, keep = set(), set(), []
        for row in pdf.sort_values(["t0", "request", "t1", "response"]).itertuples():
            if row.request not in used and row.response not in taken:
                used.add(row.request)
                taken.add(row.response)
                keep.append(row.Index)
        return pdf.loc[keep]

    return met.groupBy(*keys).applyInPandas(match, met.schema).withColumn("latency", F.col("t1") - F.col("t0"))


def content_pairs(left: DataFrame, right: DataFrame, lt: str, rt: str, window: float, keys: Sequence[tuple[str, str]], a: str, b: str, least: float) -> DataFrame:
    """Pairs of a band join whose sets of characters are more than ``least`` alike (Jaccard)."""
    x, y = (F.array_distinct(F.regexp_extract_all(F.col(c), F.lit("(?s)."), F.lit(0))) for c in (a, b))
    met = band_join(left.withColumn("_x", x), right.withColumn("_y", y), lt, rt, window, keys)
    s = F.size(F.array_intersect("_x", "_y")) / F.size(F.array_union("_x", "_y"))
    return met.withColumn("similarity", s).filter(F.col("similarity") > least).drop("_x", "_y")


def without_partner(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows of the left that no row of the right answers."""
    on = [F.col(f"_l.{a}") == F.col(f"_r.{b}") for a, b in keys]
    return left.alias("_l").join(right.alias("_r"), on, "left_anti")
