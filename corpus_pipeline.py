"""Corpus pipeline: quality rules, near-dedup, decontamination, secret masking and packing, one stage after another.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the columns of documents
(the last one: the packed pieces). Empty tables pass through; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontaminate, near_dup, packing, quality_rules, secrets
from tallyforge.llm.common import removed, scratch, table
from tallyforge.llm.queries import tokenizer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null and empty texts have no words and are rejected."""
    return quality_rules.keep_good(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies, on shingles of five words, stays; rows without a
    doc_id all stay."""
    found = near_dup.near_duplicates(docs)
    copies = found.where("doc_id is not null and not kept").select("doc_id").distinct()
    return docs.join(copies.hint("merge"), "doc_id", "left_anti").select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is masked; all documents stay."""
    return secrets.redact(docs, secrets.train(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset; workers that did other stages keep fewer words."""
    return packing.pack(docs, tokenizer(), max_words=350_000)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again by the next, and go
    when the next has written its own. What packing reads stays."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            removed(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)


#: Boosted trees, sketches, alignment and a tokenizer: not expressible in SQL.
ORACLE_SQL = None
