"""Corpus pipeline: toxicity, line dedup, near-dedup, decontamination, mixing; each stage over all rows its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import decontamination, line_dedup, minhash_dedup, mixing, toxicity
from tidewire.llm.tables import numbered, table
from tidewire.session import merged, saved

#: Bytes of a stage's input that go to one file of its output, if that makes more files than there are cores.
FILE = 32 << 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted chance of grade 1 or more is below 0.5, fitted on labels of ``docs``."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    # Graded beside the documents, so that columns named like a grade's stay as they are.
    body, at = numbered(docs)
    graded = toxicity.severity(body, model, doc_id=at["doc_id"], text=at["text"])
    return merged(graded.filter(~F.col("toxic")).select(*body.columns).toDF(*docs.columns), docs, FILE)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document or line has; documents left without a line go."""
    return merged(line_dedup.without_repeats(docs), docs, FILE)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return merged(minhash_dedup.one_of_each(docs), docs, FILE)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    found = saved(decontamination.leaks(docs, table(spark, sf_dir, "benchmark")))
    return merged(decontamination.without_leaks(docs, found), docs, FILE)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document."""
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", dedup_near),
    ("decontamination", drop_leaks),
    ("source_mixing", mix),
]

#: Fitted models and sketches decide here; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
