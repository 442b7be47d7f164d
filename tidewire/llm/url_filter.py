"""Operator 9: URL rules by hash-prefix lookup of host-suffix / path-prefix expressions (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.tables import numbered, small

RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
#: Hex digits of the digest that the join compares first.
SHORT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules])
    return spark.range(1).select(F.inline(rows))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Judge the distinct values of ``url``: columns ``url, host, path, rule, verdict``.

    Each URL is expanded into its host suffixes, of the label counts that some rule has, times its
    path prefixes, of the lengths that some rule has: expressions of other sizes equal no rule.
    Expressions meet rules on the first ``SHORT`` hex digits of SHA-256, then on the full digest.
    The longest rule text wins, then the longer host, then ``allow``; without a rule ``default``
    holds. A null URL or one without ``://`` has an empty host and path and meets no rule.
    Repeated rules count once; an empty rule table judges all as ``default``.
    """
    rules = rules.select("host", "path", "verdict").distinct()
    sizes = rules.agg(
        F.sort_array(F.collect_set(F.size(F.split("host", r"\.")))).alias("labels"),
        F.sort_array(F.collect_set(F.length("path"))).alias("lengths"),
    )
    digests = small(
        rules.select(
            F.col("host").alias("_rule_host"),
            F.concat("host", "path").alias("_rule"),
            F.col("verdict").alias("_rule_verdict"),
            F.sha2(F.concat_ws("\n", "host", "path"), 256).alias("_rule_digest"),
        ).withColumn("_rule_short", F.substring("_rule_digest", 1, SHORT))
    )
    one = urls.select(F.col(url).alias("url")).distinct()
    one = one.select("url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    n = F.size(F.split("host", r"\."))
    pairs = F.flatten(
        F.transform(
            F.filter("labels", lambda k: k <= n),
            lambda k: F.transform(
                F.filter("lengths", lambda m: m <= F.length("path")),
                lambda m: F.sha2(
                    F.concat_ws("\n", F.call_function("substring_index", F.col("host"), F.lit("."), -k), F.substring("path", F.lit(1), m)), 256
                ),
            ),
        )
    )
    # The sizes are one row, so this join with it adds columns, not pairs.
    digest = F.explode(F.when(F.col("host") != "", pairs)).alias("_digest")
    found = (
        one.filter(F.col("host") != "")
        .join(F.broadcast(sizes))
        .select("url", digest)
        .withColumn("_short", F.substring("_digest", 1, SHORT))
        .join(digests, F.col("_short") == F.col("_rule_short"))
        .filter(F.col("_digest") == F.col("_rule_digest"))
        .groupBy("url")
        .agg(
            F.max(
                F.struct(
                    F.length("_rule").alias("n"),
                    F.length("_rule_host").alias("m"),
                    (F.col("_rule_verdict") == "allow").alias("allow"),
                    F.col("_rule").alias("rule"),
                    F.col("_rule_verdict").alias("verdict"),
                )
            ).alias("best")
        )
    )
    return one.join(found.withColumnRenamed("url", "_url"), F.col("url").eqNullSafe(F.col("_url")), "left").select(
        "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """All rows of ``pages`` with ``host, path, rule, verdict``; see :func:`judge_urls`.

    Repeated rows stay repeated; columns of the input named like a result give way to it, others may
    have any name.
    """
    result = ["host", "path", "rule", "verdict"]
    left, at = numbered(pages)
    judged = judge_urls(left, rules, at[url], default).withColumnRenamed("url", "_judged")
    hit = left.join(judged, F.col(at[url]).eqNullSafe(F.col("_judged")))
    kept = [(n, c) for n, c in zip(left.columns, pages.columns, strict=True) if c.lower() not in result]
    return hit.select(*[n for n, _ in kept], *result).toDF(*[c for _, c in kept], *result)
