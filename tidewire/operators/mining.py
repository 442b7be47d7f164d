"""Clustering, similarity groups and features of messages at cluster scale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def kmeans(df: DataFrame, features: str, k: int, seed: int = 0) -> DataFrame:
    """``cluster`` by k-means (k-means|| start) on an array column."""
    v = df.withColumn("_v", array_to_vector(F.transform(features, lambda x: x.cast("double"))))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(v)
    return model.transform(v).drop("_v")


def nearest_centroid(df: DataFrame, features: str, label: str) -> DataFrame:
    """The label whose mean vector is nearest to each row; means are few and broadcast by their size."""
    x = df.select(label, F.posexplode(features).alias("d", "v"))
    means = x.groupBy(label, "d").agg(F.avg(F.col("v").cast("double")).alias("m")).groupBy(label).agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("c"))
    table = means.agg(F.collect_list(F.struct(label, F.transform("c", lambda s: s.m).alias("m"))).alias("_t"))  # a row of one mean per label
    dist = lambda m: F.aggregate(F.zip_with(features, m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, y: s + y)
    best = F.array_min(F.transform("_t", lambda t: F.struct(dist(t.m).alias("distance"), t[label].alias("label"))))
    return df.crossJoin(F.broadcast(table)).withColumn("_b", best).select(*df.columns, F.col("_b.label").alias("nearest"), F.col("_b.distance").alias("squared_distance"))


def frequent_items(df: DataFrame, keys: Sequence[str], item: str, least: float) -> DataFrame:
    """Item pairs that share a group in at least that part of groups: support, confidence and lift.

    Items below the support are dropped first, which bounds a group's pairs."""
    sets = df.select(*keys, item).distinct()
    total = F.broadcast(sets.select(*keys).distinct().agg(F.count("*").alias("_total")))  # one row
    single = sets.groupBy(item).agg(F.count("*").alias("_n")).crossJoin(total).filter(F.col("_n") >= F.col("_total") * least)
    kept = sets.join(single.select(item, "_n"), item)
    a = kept.select(*keys, F.col(item).alias("a"), F.col("_n").alias("_na"))
    b = kept.select(*keys, F.col(item).alias("b"), F.col("_n").alias("_nb"))
    pairs = a.join(b, list(keys)).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.first("_na").alias("_na"), F.first("_nb").alias("_nb"))
    out = pairs.crossJoin(total).filter(F.col("n") >= F.col("_total") * least)
    return out.select(
        "a", "b", "n", (F.col("n") / F.col("_total")).alias("support"), (F.col("n") / F.col("_na")).alias("confidence"), (F.col("n") * F.col("_total") / (F.col("_na") * F.col("_nb"))).alias("lift")
    )


def field_profile(df: DataFrame, group: Sequence[str], field: str) -> DataFrame:
    """Distinct values, entropy and mode of a categorical field per group."""
    c = df.groupBy(*group, field).agg(F.count("*").alias("_n"))
    n = F.col("_n").cast("double")
    g = c.groupBy(*group).agg(F.sum("_n").alias("n"), F.count("*").alias("unique"), F.sum(n * F.log2(n)).alias("_s"), F.max(F.struct("_n", field)).alias("_m"))
    return g.select(*group, "n", "unique", F.abs(F.log2("n") - F.col("_s") / F.col("n")).alias("entropy"), F.col(f"_m.{field}").alias("mode"))


def vote(df: DataFrame, keys: Sequence[str], label: str, weight: str) -> DataFrame:
    """Weighted vote: the label of most weight (ties: the smaller label) and its share."""
    w = df.groupBy(*keys, label).agg(F.sum(weight).alias("_w"))
    top = w.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_w"), label))).withColumn("_all", F.sum("_w").over(W.partitionBy(*keys)))
    return top.filter("_r = 1").select(*keys, F.col(label).alias("winner"), (F.col("_w") / F.col("_all")).alias("confidence"))
