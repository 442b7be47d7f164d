"""Operator 3: benchmark passages in documents by SimHash windows and multi-index Hamming blocks (native)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.llm.tables import numbered, picked, small
from tidewire.session import saved

SHINGLE, SIMILARITY = 5, 0.8
#: At weighted similarity 0.8 two 64-bit fingerprints differ in 10 bits on average (deviation 3).
RADIUS = 21
#: Eleven blocks: of two fingerprints within 21 bits some block differs in at most one bit.
WIDTHS = (6, 6, 6, 6, 6, 6, 6, 6, 6, 5, 5)
#: Shingle hashes (8 bytes each) of all items up to which they are broadcast.
LISTED = 2_000_000


def normal_words(text: Column) -> Column:
    """Lower-case runs of letters and digits; null: none."""
    parts = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: w != "")


def shingle_hashes(words: Column, k: int) -> Column:
    """Hash of the k words from each place of an array column that is not recomputed per use."""
    last = F.size(words) - k + 1
    return F.transform(
        F.slice(words, 1, F.greatest(last, F.lit(0))),
        lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, k)]),
    )


def occurrence_tags(hashes: Column) -> Column:
    """A value of its own for the k-th occurrence of each hash in a sorted array column."""
    return F.transform(hashes, lambda h, i: F.xxhash64(h, i - F.array_position(hashes, h)))


def simhash(hashes: Column) -> Column:
    """Each bit by majority over the hashes of a set; of ``occurrence_tags`` the angle follows weighted Jaccard."""
    ones = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda b: F.aggregate(
            hashes, F.lit(0), lambda a, h: a + F.call_function("getbit", h, b.cast("int")).cast("int")
        ),
    )
    bits = F.transform(ones, lambda n, b: F.when(n * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def blocks(fingerprint: Column) -> list[Column]:
    out, at = [], 0
    for width in WIDTHS:
        out.append(F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << width) - 1)).cast("int"))
        at += width
    return out


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of the lesser over sum of the greater multiplicities of all shingles."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    both = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    return both / (F.size(a) + F.size(b) - both)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = SIMILARITY,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per document and benchmark item that it holds: ``doc_id, item_id, similarity, start``.

    A window of an item's size (the whole document, if that is shorter) holds the item if their
    multisets of five-word shingles are at least ``similarity`` alike; items of fewer words are one
    shingle. Of the windows the best one, moved as far left as it stays best, ends with a shared shingle
    or begins the document. So every window that begins or ends with a shared shingle (moved inside the
    document) is tried, unless it holds too few shared shingles to be ``similarity`` alike. Their
    fingerprints meet those of items of that size in eleven blocks, which miss none within the radius;
    Hamming distance and exact similarity then decide. ``start`` is the first word of the best window
    (the earliest on ties). Null, empty or wordless texts hold nothing and are held by nothing;
    repeated rows of either table count once; other columns are not read.
    """
    words = picked(docs, _d=doc_id, _text=text).select("_d", F.xxhash64("_text").alias("_t"), normal_words(F.col("_text")).alias("_w"))
    items = picked(benchmark, _item=item_id, _text=item_text).select("_item", normal_words(F.col("_text")).alias("_w")).distinct()
    items = saved(items.withColumn("_size", F.size("_w")).filter("_size > 0"))
    sizes = [r[0] for r in items.select(F.least("_size", F.lit(SHINGLE))).distinct().collect()]  # at most five
    found = [_leaks_of(words, items.filter(F.least("_size", F.lit(SHINGLE)) == k), k, similarity) for k in sorted(sizes)]
    if not found:
        empty = F.lit(None)
        return words.join(items, F.lit(False)).select(
            F.col("_d").alias(doc_id), F.col("_item").alias(item_id), empty.cast("double").alias("similarity"), empty.cast("int").alias("start")
        )
    best = F.max(F.struct(F.col("_sim"), (-F.col("_start")).alias("_from")))
    return (
        reduce(DataFrame.unionByName, found)
        .groupBy(F.col("_d").alias(doc_id), F.col("_item").alias(item_id))
        .agg(best.alias("_best"))
        .select(doc_id, item_id, F.col("_best._sim").alias("similarity"), (-F.col("_best._from")).alias("start"))
    )


def _leaks_of(words: DataFrame, items: DataFrame, k: int, similarity: float) -> DataFrame:
    # Written tables stand where the optimizer would else copy a fingerprint into inferred filters;
    # the outer explode infers none.
    items = items.withColumn("_key", F.xxhash64("_item", "_w"))
    items = saved(items.withColumn("_sh", F.array_sort(shingle_hashes(F.col("_w"), k))).drop("_w"))
    items = saved(items.withColumn("_tags", occurrence_tags(F.col("_sh"))))
    items = saved(items.withColumn("_print", simhash(F.col("_tags"))).drop("_tags"))
    known = small(items.select(F.col("_size").alias("_L"), F.explode("_sh").alias("_hit")).distinct())
    n = F.size("_w")
    docs = words.withColumn("_sh", shingle_hashes(F.col("_w"), k)).select("_t", n.alias("_n"), F.posexplode_outer("_sh").alias("_p", "_h"))
    hits = docs.join(known, F.col("_h") == F.col("_hit")).select("_t", "_n", "_L", "_p").distinct()
    size = F.least("_L", "_n")
    m = size - (k - 1)  # shingles of a window
    # Places in units of a window, with half a place to spare for rounding, in fixed point.
    unit = 1 << 30
    near = W.partitionBy("_t", "_L").orderBy(F.floor(F.col("_p").cast("long") * (2 * unit) / (F.col("_m") * 2 - 1)))
    after, before = (F.count("*").over(near.rangeBetween(*r)) for r in ((0, unit), (-unit, 0)))
    counted = hits.withColumn("_m", m).withColumn("_len", size).withColumn("_after", after).withColumn("_before", before)
    # Shared shingles needed: both >= similarity * (a + b - both).
    need = F.lit(similarity) * (F.col("_m") + F.col("_L") - (k - 1)) / (1 + similarity) - 1e-6
    inside = lambda start: F.greatest(F.least(start, F.col("_n") - F.col("_len")), F.lit(0))
    starts = F.array(
        F.when(F.col("_after") >= need, inside(F.col("_p"))), F.when(F.col("_before") >= need, inside(F.col("_p") - F.col("_m") + 1))
    )
    tried = saved(counted.select("_t", "_L", "_m", F.explode(F.array_compact(starts)).alias("_start")).distinct())
    held = small(tried.select(F.col("_t").alias("_u")).distinct())
    texts = words.join(held, F.col("_t") == F.col("_u"), "left_semi").groupBy("_t").agg(F.any_value("_w").alias("_w"))
    texts = saved(texts.select(F.col("_t").alias("_u"), shingle_hashes(F.col("_w"), k).alias("_sh")))
    spans = tried.join(texts, F.col("_t") == F.col("_u")).select("_t", "_L", "_start", F.array_sort(F.slice("_sh", F.col("_start") + 1, F.col("_m"))).alias("_window"))
    spans = saved(saved(spans).withColumn("_tags", occurrence_tags(F.col("_window"))))
    prints = saved(spans.withColumn("_mine", simhash(F.col("_tags"))).drop("_tags"))
    mine = prints.select("*", F.posexplode(F.array(*blocks(F.col("_mine")))).alias("_block", "_value"))
    near = [
        F.concat(F.array(b), *[F.array(b.bitwiseXOR(F.lit(1 << j))) for j in range(w)])
        for b, w in zip(blocks(F.col("_print")), WIDTHS, strict=True)
    ]
    probes = items.select("*", F.posexplode(F.array(*near)).alias("_b", "_values")).select(
        "_item", "_key", "_size", "_print", "_b", F.explode("_values").alias("_v")
    )
    met = mine.join(small(probes), (F.col("_L") == F.col("_size")) & (F.col("_block") == F.col("_b")) & (F.col("_value") == F.col("_v")))
    met = met.filter(F.bit_count(F.col("_mine").bitwiseXOR(F.col("_print"))) <= RADIUS)
    own = small(items.select(F.col("_key").alias("_k"), "_sh"), LISTED, F.size("_sh"))
    met = met.join(own, F.col("_key") == F.col("_k"))
    met = met.withColumn("_sim", weighted_similarity(F.col("_sh"), F.col("_window")))
    met = saved(met.filter(F.col("_sim") >= similarity).select(F.col("_t").alias("_u"), "_item", "_sim", "_start").distinct())
    return words.select("_d", "_t").join(small(met), F.col("_t") == F.col("_u")).select("_d", "_item", "_sim", "_start")


def without_leaks(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that hold no item; rows with a null id stay unless a null id was found.

    Repeated rows go or stay together; columns of any name are kept as they are."""
    ids = found.select(F.col(doc_id).alias("_leak")).distinct()
    body, at = numbered(docs)
    return body.join(ids, F.col(at[doc_id]).eqNullSafe(F.col("_leak")), "left_anti").toDF(*docs.columns)
