"""Log queries and statistics over real timestamps."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.session import saved


def query(df: DataFrame, at: str, start=None, stop=None, among: Mapping[str, Sequence] | None = None, like: Mapping[str, str] | None = None) -> DataFrame:
    """Inclusive time range, columns among values and columns like patterns, all pushed to the scan."""
    if start is not None:
        df = df.filter(F.col(at) >= F.lit(start))
    if stop is not None:
        df = df.filter(F.col(at) <= F.lit(stop))
    for c, values in (among or {}).items():
        df = df.filter(F.col(c).isin(list(values)))
    for c, pattern in (like or {}).items():
        df = df.filter(F.col(c).like(pattern.replace("*", "%")))
    return df


def json_field(df: DataFrame, column: str, path: str, test: Callable[[Column], Column]) -> DataFrame:
    return df.filter(test(F.get_json_object(column, path)))


def page(df: DataFrame, order: Sequence[str], number: int, size: int) -> DataFrame:
    """Page ``number`` from 1."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def statistics(df: DataFrame, groups: Mapping[str, str]) -> DataFrame:
    """Counts by each of several columns and in all, in one pass by grouping sets."""
    cols = list(groups.values())
    view = df.select(*cols)
    g = view.groupingSets([[F.col(c)] for c in cols] + [[]], *[F.col(c) for c in cols]).agg(F.count("*").alias("n"), *[F.grouping(c).alias(f"_g_{c}") for c in cols])
    name, key = F.lit("all"), F.lit("")
    for label, c in groups.items():
        name = F.when(F.col(f"_g_{c}") == 0, label).otherwise(name)
        key = F.when(F.col(f"_g_{c}") == 0, F.col(c).cast("string")).otherwise(key)
    return g.select(name.alias("grouping"), key.alias("key"), "n")


def error_trend(df: DataFrame, order: Sequence[str], is_error: Column, change: float = 0.2) -> DataFrame:
    """Error rates of the first and second half of the rows by ``order``; the halves come from a global
    row index that is counted per range partition, so no task holds all rows."""
    marked = df.select(*order, is_error.cast("int").alias("_e"))
    parts = marked.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    # Written once: ranges are drawn from a sample, and both reads must see the same ones.
    own = saved(parts.withColumn("_k", F.row_number().over(W.partitionBy("_p").orderBy(*order))))
    sizes = own.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row per partition
    total = F.broadcast(sizes.agg(F.sum("_n").alias("_N")))  # one row
    at = own.join(F.broadcast(before.drop("_n")), "_p").crossJoin(total).withColumn("_second", F.col("_b") + F.col("_k") > F.ceil(F.col("_N") / 2))
    r = at.agg(F.avg(F.when(~F.col("_second"), F.col("_e"))).alias("first_rate"), F.avg(F.when(F.col("_second"), F.col("_e"))).alias("second_rate"))
    a, b = F.col("first_rate"), F.col("second_rate")
    return r.withColumn("trend", F.when(b > a * (1 + change), "increasing").when(b < a * (1 - change), "decreasing").otherwise("stable"))


def summary(df: DataFrame, at: str, level: str, message: str, source: str, least: int = 1) -> DataFrame:
    """Normalised messages: count, first and last seen, level histogram and sources."""
    from tidewire.operators.payload import normalize_log

    one = df.select(normalize_log(F.col(message)).alias("pattern"), at, level, source)
    by_level = one.groupBy("pattern", level).agg(F.count("*").alias("n"), F.min(at).alias("a"), F.max(at).alias("z"), F.collect_set(source).alias("s"))
    return by_level.groupBy("pattern").agg(
        F.sum("n").alias("count"), F.min("a").alias("first_seen"), F.max("z").alias("last_seen"), F.map_from_entries(F.collect_list(F.struct(level, "n"))).alias("levels"), F.array_distinct(F.flatten(F.collect_list("s"))).alias("sources")
    ).filter(F.col("count") >= least)


def error_rate(df: DataFrame, at: str, is_error: Column, seconds: int) -> DataFrame:
    """Share of errors in the trailing window of each row's time, per event-time bucket of that width."""
    return df.groupBy(F.window(at, f"{seconds} seconds").alias("w")).agg(F.avg(is_error.cast("int")).alias("rate"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "rate", "n")


def batch_summary(df: DataFrame, batch: str, at: str, is_error: Column, duration: Column) -> DataFrame:
    """Per batch: rows, errors, error rate, span (seconds), throughput and mean duration."""
    span = F.max(at) - F.min(at)
    g = df.groupBy(batch).agg(F.count("*").alias("n"), F.count_if(is_error).alias("errors"), (span / 1e6).alias("seconds"), F.avg(duration).alias("mean_duration"))
    return g.withColumns({"error_rate": F.col("errors") / F.col("n"), "throughput": F.when(F.col("seconds") > 0, F.col("n") / F.col("seconds"))})


def find_by_name(df: DataFrame, name: str, pattern: str, score: str, least: float) -> DataFrame:
    """Rows whose name is like a pattern (``*`` for any run) and whose score reaches ``least``."""
    return df.filter(F.col(name).like(pattern.replace("*", "%")) & (F.col(score) >= least))


def flows(pairs: DataFrame, flow: str, start: str, stop: str) -> DataFrame:
    """Per flow of matched pairs: pairs, span from the first start to the last stop, and largest latency."""
    return pairs.groupBy(flow).agg(F.count("*").alias("pairs"), (F.max(stop) - F.min(start)).alias("span"), F.max(F.col(stop) - F.col(start)).alias("max_latency"))
