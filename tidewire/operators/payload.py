"""Byte payloads: entropy, n-grams, patterns, delimiters, checksums of columns, classification."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Keys = Sequence[str]
#: Thresholds of the entropy ladder.
CONSTANT_BELOW, RANDOM_FROM, COMPRESSED_FROM, TEXT_FROM = 0.5, 7.5, 6.0, 0.9


def byte_rows(df: DataFrame, keys: Keys, data: str) -> DataFrame:
    """One row per byte: ``pos`` from 0 and ``byte`` 0-255. ``data`` is binary; its hex is cut once per value."""
    pairs = df.select(*keys, F.regexp_extract_all(F.hex(data), F.lit(".."), F.lit(0)).alias("_h"))
    rows = pairs.select(*keys, F.posexplode_outer("_h").alias("pos", "_b")).filter("_b is not null")
    return rows.select(*keys, "pos", F.conv("_b", 16, 10).cast("int").alias("byte"))


def byte_histogram(df: DataFrame, keys: Keys, data: str) -> DataFrame:
    return byte_rows(df, keys, data).groupBy(*keys, "byte").agg(F.count("*").alias("n"))


def _entropy(counts: DataFrame, keys: Keys) -> DataFrame:
    """-sum p log2 p by sums alone: log2 N - (sum n log2 n) / N."""
    n = F.col("n").cast("double")
    g = counts.groupBy(*keys).agg(F.sum(n).alias("_N"), F.sum(n * F.log2(n)).alias("_s"))
    return g.select(*keys, F.col("_N").cast("long").alias("n"), F.abs(F.log2("_N") - F.col("_s") / F.col("_N")).alias("entropy"))


def shannon_entropy(df: DataFrame, keys: Keys, data: str) -> DataFrame:
    """Bits per byte."""
    return _entropy(byte_histogram(df, keys, data), keys)


def bit_entropy(df: DataFrame, keys: Keys, data: str) -> DataFrame:
    """Entropy of the balance of ones."""
    g = byte_rows(df, keys, data).groupBy(*keys).agg(F.sum(F.bit_count("byte")).alias("_o"), (F.count("*") * 8).alias("bits"))
    p = F.col("_o") / F.col("bits")
    h = F.when((p > 0) & (p < 1), -(p * F.log2(p) + (1 - p) * F.log2(1 - p))).otherwise(0.0)
    return g.select(*keys, "bits", p.alias("ones"), h.alias("bit_entropy"))


def frequency_anomalies(df: DataFrame, keys: Keys, data: str, threshold: float = 3.0) -> DataFrame:
    """Byte values whose count lies beyond ``threshold`` binomial deviations of uniform, absent values included."""
    hist = byte_histogram(df, keys, data)
    total = hist.groupBy(*keys).agg(F.sum("n").alias("_N"))
    all_ = total.select(*keys, "_N", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("byte"))
    full = all_.join(hist, [*keys, "byte"], "left").fillna(0, ["n"])
    p = 1 / 256
    z = (F.col("n") - F.col("_N") * p) / F.sqrt(F.col("_N") * p * (1 - p))
    return full.withColumn("z", z).filter(F.abs("z") > threshold).select(*keys, "byte", "n", "z")


def compare_distributions(a: DataFrame, b: DataFrame) -> DataFrame:
    """Chi-square and symmetrised KL of two byte histograms (``byte, n``), smoothed by 1e-10."""
    total = lambda h, c: h.agg(F.sum("n").alias(c))
    met = a.withColumnRenamed("n", "_a").join(b.withColumnRenamed("n", "_b"), "byte", "full").fillna(0, ["_a", "_b"])
    met = met.crossJoin(F.broadcast(total(a, "_ta"))).crossJoin(F.broadcast(total(b, "_tb")))  # one row each
    p, q = F.col("_a") / F.col("_ta") + 1e-10, F.col("_b") / F.col("_tb") + 1e-10
    chi = F.when(p + q > 0, (p - q) ** 2 / (p + q)).otherwise(0.0)
    return met.agg(F.sum(chi).alias("chi_square"), ((F.sum(p * F.log(p / q)) + F.sum(q * F.log(q / p))) / 2).alias("symmetric_kl"))


def gram_rows(df: DataFrame, keys: Keys, text: str, n: int, stride: int = 1) -> DataFrame:
    """``pos`` and ``gram`` of every ``stride``-th character n-gram.

    Characters are split once per text and neighbours joined by place, so the work is linear in the
    text. The outer explode keeps the optimizer from copying the split into an inferred filter.
    """
    chars = df.select(*keys, F.regexp_extract_all(F.col(text), F.lit("(?s)."), F.lit(0)).alias("_c"))
    join = lambda c, i: F.concat(c, *[F.get("_c", i + k) for k in range(1, n)]) if n > 1 else c
    last = F.size("_c") - n + 1
    grams = chars.select(*keys, F.transform(F.slice("_c", 1, F.greatest(last, F.lit(0))), join).alias("_g"))
    rows = grams.select(*keys, F.posexplode_outer("_g").alias("pos", "gram")).filter("gram is not null")
    return rows if stride == 1 else rows.filter(F.col("pos") % stride == 0)


def ngram_counts(df: DataFrame, keys: Keys, text: str, n: int, stride: int = 1) -> DataFrame:
    return gram_rows(df, keys, text, n, stride).groupBy(*keys, "gram").agg(F.count("*").alias("n"))


def ngram_entropy(df: DataFrame, keys: Keys, text: str, n: int) -> DataFrame:
    return _entropy(ngram_counts(df, keys, text, n), keys)


def top_ngrams(df: DataFrame, text: str, n: int, k: int = 100) -> DataFrame:
    """The k most frequent n-grams, ties by gram."""
    return ngram_counts(df, [], text, n).orderBy(F.desc("n"), "gram").limit(k)


def unusual_ngrams(df: DataFrame, text: str, n: int, threshold: float) -> DataFrame:
    """n-grams whose count has a Poisson z of at least ``threshold`` against the mean count."""
    c = ngram_counts(df, [], text, n)
    mean = F.broadcast(c.agg(F.avg("n").alias("_m")))  # one row
    z = (F.col("n") - F.col("_m")) / F.sqrt("_m")
    return c.crossJoin(mean).withColumn("z", z).filter(F.abs("z") >= threshold).select("gram", "n", "z")


def compare_ngram_profiles(a: DataFrame, b: DataFrame) -> DataFrame:
    """Jaccard, cosine and chi-square of two n-gram tables (``gram, n``)."""
    met = a.withColumnRenamed("n", "_a").join(b.withColumnRenamed("n", "_b"), "gram", "full").fillna(0, ["_a", "_b"])
    x, y = F.col("_a").cast("double"), F.col("_b").cast("double")
    return met.agg(
        (F.count_if((x > 0) & (y > 0)) / F.count("*")).alias("jaccard"), (F.sum(x * y) / F.sqrt(F.sum(x * x) * F.sum(y * y))).alias("cosine"),
        F.sum((x - y) ** 2 / (x + y)).alias("chi_square"),
    )


def common_ngrams(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("gram").intersect(b.select("gram"))


def pattern_positions(df: DataFrame, keys: Keys, text: str, pattern: str) -> DataFrame:
    """Every (overlapping) offset of a literal pattern, from 0."""
    hit = df.filter(F.col(text).contains(pattern))
    return gram_rows(hit, keys, text, len(pattern)).filter(F.col("gram") == pattern).select(*keys, "pos")


def multi_pattern_search(df: DataFrame, patterns: DataFrame, keys: Keys, text: str, pattern_id: str, pattern: str) -> DataFrame:
    """Every (overlapping) occurrence of many literal patterns, from 0; empty and null patterns occur nowhere.

    An Aho-Corasick automaton of the distinct patterns, whose text in all is counted to be small, goes to
    every task, which reads each text once. A larger set is cut by hash into such parts; each part reads
    the texts anew, so memory stays bounded and no pattern is left out.
    """
    known = patterns.select(F.col(pattern_id).alias("_i"), F.col(pattern).alias("_p")).filter(F.length("_p") > 0)
    total = known.agg(F.coalesce(F.sum(F.octet_length("_p")), F.lit(0))).first()[0]
    parts = max(1, -(-total // PATTERN_BYTES))
    own = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(text).alias("_text"))
    out = None
    for n in range(parts):
        some = known.filter(F.pmod(F.xxhash64("_p"), F.lit(parts)) == n)
        found = _occurrences(own, some.select("_p").distinct())
        found = found.join(some, "_p").select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], F.col("_i").alias(pattern_id), "pos")
        out = found if out is None else out.unionByName(found)
    return out


#: UTF-8 bytes of patterns that one automaton holds.
PATTERN_BYTES = 8 << 20


def _occurrences(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Each occurrence (``_p, pos``) beside the other columns of ``texts`` (``_text``)."""
    words = [r[0] for r in patterns.collect()]  # at most PATTERN_BYTES in all
    shared = texts.sparkSession.sparkContext.broadcast(words)
    kept = [c for c in texts.columns if c != "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        own = ahocorasick.Automaton()
        for w in shared.value:
            own.add_word(w, w)
        if shared.value:
            own.make_automaton()
        for batch in batches:
            rows, hit, pos = [], [], []
            for i, t in enumerate(batch.column("_text").to_pylist() if shared.value else ()):
                for end, w in own.iter(t or ""):
                    rows.append(i)
                    hit.append(w)
                    pos.append(end - len(w) + 1)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in kept), pa.array(hit, pa.string()), pa.array(pos, pa.int32())], names=[*kept, "_p", "pos"])

    types = "".join(f"`{c}` {t}, " for c, t in texts.dtypes if c != "_text")
    return texts.mapInArrow(run, f"{types}_p string, pos int")


def classify(df: DataFrame, keys: Keys, data: str) -> DataFrame:
    """Entropy ladder: constant, random, compressed, text (printable share) or structured."""
    rows = byte_rows(df, keys, data)
    shown = F.avg(F.when(F.col("byte").between(32, 126) | F.col("byte").isin(9, 10, 13), 1.0).otherwise(0.0))
    h = shannon_entropy(df, keys, data).join(rows.groupBy(*keys).agg(shown.alias("printable")), list(keys))
    kind = (
        F.when(F.col("entropy") < CONSTANT_BELOW, "constant").when(F.col("entropy") >= RANDOM_FROM, "random").when(F.col("entropy") >= COMPRESSED_FROM, "compressed")
        .when(F.col("printable") >= TEXT_FROM, "text").otherwise("structured")
    )
    return h.withColumn("kind", kind)


def sliding_entropy(df: DataFrame, keys: Keys, data: str, window: int = 256, step: int = 64) -> DataFrame:
    """Entropy of each full window; a byte is dealt to the windows that hold it."""
    size = df.select(*keys, F.length(data).alias("_len"), data)
    rows = byte_rows(size, [*keys, "_len"], data)
    low = F.greatest(F.ceil((F.col("pos") - window + 1) / step), F.lit(0)).cast("int")
    high = F.least(F.floor(F.col("pos") / step), F.floor((F.col("_len") - window) / step)).cast("int")
    put = rows.filter(low <= high).select(*keys, F.explode(F.sequence(low, high)).alias("window"), "byte")
    return _entropy(put.groupBy(*keys, "window", "byte").agg(F.count("*").alias("n")), [*keys, "window"])


def column_stats(df: DataFrame, data: str) -> DataFrame:
    """Per byte position of messages, up to the longest: entropy, extremes, mean, deviation, distinct values and mode."""
    rows = byte_rows(df, [], data)
    counts = rows.groupBy("pos", "byte").agg(F.count("*").alias("n"))
    stats = rows.groupBy("pos").agg(
        F.min("byte").alias("min"), F.max("byte").alias("max"), F.avg("byte").alias("mean"), F.stddev_pop("byte").alias("std"), F.count_distinct("byte").alias("unique")
    )
    mode = counts.groupBy("pos").agg(F.max(F.struct("n", (-F.col("byte")).alias("b"))).alias("_m"))
    return _entropy(counts, ["pos"]).join(stats, "pos").join(mode, "pos").withColumn("mode", -F.col("_m.b")).drop("_m")


def delimiter_scores(df: DataFrame, text: str, candidates: Sequence[str]) -> DataFrame:
    """Score = count * (0.5 + 0.5 regularity) of candidate delimiters; regularity = 1 / (1 + cv of gaps)."""
    each = F.explode(F.array(*[F.lit(c) for c in candidates])).alias("delimiter")
    parts = df.select(each, F.col(text).alias("_x")).select("delimiter", F.split("_x", F.concat(F.lit(r"\Q"), F.col("delimiter"), F.lit(r"\E"))).alias("_s"))
    gaps = parts.select("delimiter", (F.size("_s") - 1).alias("_n"), F.transform(F.slice("_s", 2, 1 << 30), lambda x: F.length(x).cast("double")).alias("_g"))
    flat = gaps.select("delimiter", "_n", F.explode_outer("_g").alias("_g"))
    total = gaps.groupBy("delimiter").agg(F.sum("_n").alias("count"))
    reg = flat.groupBy("delimiter").agg(F.avg("_g").alias("_m"), F.stddev_pop("_g").alias("_s"))
    r = F.when(F.col("_m") > 0, 1 / (1 + F.col("_s") / F.col("_m"))).otherwise(0.0)
    return total.join(reg, "delimiter").filter("count >= 2").select("delimiter", "count", r.alias("regularity"), (F.col("count") * (0.5 + 0.5 * r)).alias("score"))


def segment(df: DataFrame, keys: Keys, text: str, delimiter: str) -> DataFrame:
    """Messages between delimiters, empty ones left out, with their number."""
    parts = F.filter(F.split(F.col(text), rf"\Q{delimiter}\E"), lambda x: x != "")
    return df.select(*keys, F.posexplode(parts).alias("part", "message"))


def hamming_distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def checksums(df: DataFrame, keys: Keys, data: str) -> DataFrame:
    """Native checksums of binary payloads: sum of bytes mod 256, sum of big-endian words mod 65536, XOR, CRC-32."""
    rows = byte_rows(df, keys, data)
    word = F.when(F.col("pos") % 2 == 0, F.col("byte") * 256).otherwise(F.col("byte"))
    sums = rows.groupBy(*keys).agg((F.sum("byte") % 256).alias("sum8"), (F.sum(word) % 65536).alias("sum16"), F.bit_xor("byte").alias("xor8"))
    return sums.join(df.select(*keys, F.crc32(data).alias("crc32")), list(keys))


def common_prefix(df: DataFrame, data: str, most: int = 64) -> DataFrame:
    """Leading positions at which every payload has the same byte."""
    rows = byte_rows(df.select(F.substring(data, 1, most).alias(data)), [], data)
    total = F.broadcast(df.agg(F.count("*").alias("_total")))  # one row
    at = rows.groupBy("pos").agg(F.count("*").alias("_n"), F.min("byte").alias("byte"), F.max("byte").alias("_z")).crossJoin(total)
    same = at.withColumn("_bad", F.when((F.col("_n") == F.col("_total")) & (F.col("byte") == F.col("_z")), 0).otherwise(1))
    ok = same.withColumn("_b", F.sum("_bad").over(W.orderBy("pos")))  # ``most`` rows at most
    return ok.filter("_b = 0").select("pos", "byte")


def normalize_log(message: Column) -> Column:
    """UUIDs, hex words, quoted strings and numbers, in this order, replaced by placeholders."""
    out = F.regexp_replace(message, r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}", "<UUID>")
    out = F.regexp_replace(out, r"0x[0-9a-fA-F]+", "<HEX>")
    out = F.regexp_replace(out, r"'[^']*'|\"[^\"]*\"", "<STR>")
    return F.regexp_replace(out, r"\d+", "<NUM>")


def similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer > 0, 1 - F.levenshtein(a, b) / longer).otherwise(1.0)


def entropy_transitions(df: DataFrame, keys: Keys, data: str, window: int, step: int, threshold: float) -> DataFrame:
    """Windows whose entropy differs from the one before by more than ``threshold`` (to nine digits)."""
    by = W.partitionBy(*keys).orderBy("window")
    h = sliding_entropy(df, keys, data, window, step).withColumn("change", F.col("entropy") - F.lag("entropy").over(by))
    return h.filter(F.round(F.abs("change"), 9) > threshold).select(*keys, "window", "change")


def sliding_byte_count(df: DataFrame, keys: Keys, data: str, byte: int, window: int = 256, step: int = 64) -> DataFrame:
    """Occurrences of one byte value in each full window."""
    rows = byte_rows(df.select(*keys, F.length(data).alias("_len"), data), [*keys, "_len"], data)
    low = F.greatest(F.ceil((F.col("pos") - window + 1) / step), F.lit(0)).cast("int")
    high = F.least(F.floor(F.col("pos") / step), F.floor((F.col("_len") - window) / step)).cast("int")
    put = rows.filter(low <= high).select(*keys, F.explode(F.sequence(low, high)).alias("window"), "byte")
    return put.groupBy(*keys, "window").agg(F.count_if(F.col("byte") == byte).alias("n"))


def byte_pairs(df: DataFrame, data: str) -> DataFrame:
    """Counts of neighbouring byte values: the cells of a bigram heat map that are not empty."""
    grams = gram_rows(df.select(F.hex(data).alias("_h")), [], "_h", 4, 2)
    byte = lambda a: F.conv(F.substring("gram", a, 2), 16, 10).cast("int")
    return grams.groupBy("gram").agg(F.count("*").alias("n")).select(byte(1).alias("first"), byte(3).alias("second"), "n")


def frequent_patterns(df: DataFrame, keys: Keys, text: str, lengths: Sequence[int], least: float) -> DataFrame:
    """n-grams of the given lengths that at least that share of messages hold."""
    total = F.broadcast(df.agg(F.count("*").alias("_t")))  # one row
    grams = None
    for n in lengths:
        g = gram_rows(df, keys, text, n).select(*keys, "gram").distinct()
        grams = g if grams is None else grams.unionByName(g)
    c = grams.groupBy("gram").agg(F.count("*").alias("n")).crossJoin(total).filter(F.col("n") >= F.col("_t") * least)
    return c.select("gram", "n", (F.col("n") / F.col("_t")).alias("support"))


def repeated_sequences(df: DataFrame, keys: Keys, text: str, lengths: Sequence[int], least: int) -> DataFrame:
    """n-grams of the given lengths that occur at least so often in one message."""
    out = None
    for n in lengths:
        g = ngram_counts(df, keys, text, n).filter(F.col("n") >= least)
        out = g if out is None else out.unionByName(g)
    return out.select(*keys, F.col("gram").alias("sequence"), "n")


def fuzzy_search(df: DataFrame, patterns: DataFrame, keys: Keys, text: str, pattern_id: str, pattern: str, errors: int) -> DataFrame:
    """Per text and pattern the nearest approximate occurrence, anywhere in the text, within ``errors`` edits:
    ``distance`` and ``stop`` (the first end of an occurrence at that distance).

    An occurrence within k edits holds one of k + 1 pieces of the pattern unchanged, so pieces are
    searched for literally and Sellers' recurrence decides around each hit. A pattern of at most
    ``errors`` characters has no such pieces and is not searched for: it would occur everywhere.
    """
    n, k = F.length("_p"), errors + 1
    known = patterns.select(F.col(pattern_id).alias("_i"), F.col(pattern).alias("_p")).filter(n > errors)
    cut = F.transform(F.sequence(F.lit(0), F.lit(errors)), lambda i: F.struct((i * n / k).cast("int").alias("at"), F.substring("_p", (i * n / k).cast("int") + 1, ((i + 1) * n / k).cast("int") - (i * n / k).cast("int")).alias("piece")))
    pieces = known.select("_i", "_p", F.explode(cut).alias("c")).select("_i", "_p", "c.at", "c.piece")
    own = df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_text"))
    hits = multi_pattern_search(own.select("*"), pieces.select("piece").distinct().withColumn("_id", F.col("piece")), [*[f"_k{i}" for i in range(len(keys))], "_text"], "_text", "_id", "piece")
    near = hits.join(pieces, F.col("_id") == F.col("piece")).select(*[f"_k{i}" for i in range(len(keys))], "_text", "_i", "_p", (F.col("pos") - F.col("at")).alias("_from"))
    kept = [f"_k{i}" for i in range(len(keys))] + ["_i"]
    start = F.greatest(F.col("_from") - errors, F.lit(0))
    spans = near.select(*kept, "_p", start.alias("_start"), F.substring("_text", start + 1, F.length("_p") + 2 * errors + F.least(F.col("_from") - start, F.lit(0))).alias("_part")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, (p, s, part) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_p", "_start", "_part")), strict=True)):
                best = nearest_occurrence(part, p)
                if best[0] <= errors:
                    rows.append(i)
                    found.append((best[0], s + best[1]))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in kept), pa.array([d for d, _ in found], pa.int32()), pa.array([e for _, e in found], pa.int32())], names=[*kept, "distance", "stop"])

    types = "".join(f"`{c}` {t}, " for c, t in spans.dtypes if c in kept)
    each = spans.mapInArrow(run, f"{types}distance int, stop int")
    best = each.groupBy(*kept).agg(F.min(F.struct("distance", "stop")).alias("_b"))
    return best.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keys)], F.col("_i").alias(pattern_id), F.col("_b.distance").alias("distance"), F.col("_b.stop").alias("stop"))


def nearest_occurrence(text: str, pattern: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any part of the text, and the first end of such a part
    (Sellers' recurrence, a row of the pattern at a time)."""
    t = np.array([ord(c) for c in text], np.int64)
    place = np.arange(len(t) + 1)
    row = np.zeros(len(t) + 1, np.int64)
    for j, c in enumerate(pattern, 1):
        new = np.empty_like(row)
        new[0] = j
        new[1:] = np.minimum(row[:-1] + (t != ord(c)), row[1:] + 1)
        row = np.minimum.accumulate(new - place) + place
    return int(row.min()), int(row.argmin())


def verify_checksums(df: DataFrame, keys: Keys, data: str, algorithm: str, size: int, big: bool = True) -> DataFrame:
    """Messages per group whose last ``size`` bytes are the checksum of what stands before, and their share."""
    from tidewire.functions.checksums import checksum

    own = F.expr(f"substring(`{data}`, 1, length(`{data}`) - {size})")
    tail = F.expr(f"substring(`{data}`, length(`{data}`) - {size - 1}, {size})")
    told = tail if big else F.reverse(tail)
    rows = df.filter(F.length(data) > size).select(*keys, (checksum(own, algorithm) == F.conv(F.hex(told), 16, 10).cast("long")).alias("_ok"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("_ok").alias("matches"), F.avg(F.col("_ok").cast("int")).alias("rate"))


def typed_regions(df: DataFrame, keys: Keys, data: str, window: int) -> DataFrame:
    """Kind of each whole window of ``window`` bytes (see :func:`classify`), equal neighbours joined: first and last window."""
    rows = byte_rows(df, keys, data).withColumn("window", F.floor(F.col("pos") / window).cast("int"))
    part = [*keys, "window"]
    counts = rows.groupBy(*part, "byte").agg(F.count("*").alias("n"))
    shown = F.avg(F.when(F.col("byte").between(32, 126) | F.col("byte").isin(9, 10, 13), 1.0).otherwise(0.0))
    h = _entropy(counts, part).filter(F.col("n") == window).join(rows.groupBy(*part).agg(shown.alias("printable")), part)
    kind = F.when(F.col("entropy") < CONSTANT_BELOW, "constant").when(F.col("printable") >= TEXT_FROM, "text").otherwise("binary")
    by = W.partitionBy(*keys).orderBy("window")
    k = h.withColumn("kind", kind)
    new = F.when(F.col("kind").eqNullSafe(F.lag("kind").over(by)) & (F.col("window") == F.lag("window").over(by) + 1), 0).otherwise(1)
    runs = k.withColumn("_new", new).withColumn("_run", F.sum("_new").over(by))
    return runs.groupBy(*keys, "_run", "kind").agg(F.min("window").alias("first"), F.max("window").alias("last")).drop("_run")


def signatures(df: DataFrame, keys: Keys, text: str, lengths: Sequence[int], least: int) -> DataFrame:
    """n-grams at one offset of at least so many messages: candidates for headers and sync words, by share of messages."""
    total = F.broadcast(df.agg(F.count("*").alias("_t")))  # one row
    out = None
    for n in lengths:
        g = gram_rows(df, keys, text, n).groupBy("pos", "gram").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
        out = g if out is None else out.unionByName(g)
    return out.crossJoin(total).select("pos", "gram", "n", (F.col("n") / F.col("_t")).alias("share"))


def regex_search(df: DataFrame, keys: Keys, text: str, pattern: str) -> DataFrame:
    """Matches of a regular expression in each text, numbered from 0."""
    return df.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("number", "match"))
