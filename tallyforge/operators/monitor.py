"""Reports on documents and on their processing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def document_kpis(documents: DataFrame) -> DataFrame:
    return documents.groupBy(F.coalesce("type", F.lit("uncategorised")).alias("type"), "review_status").agg(F.count("*").alias("n_documents"), F.countDistinct("partner_id").alias("n_partners"), F.max("document_date").alias("newest"))


def metrics_report(metrics: DataFrame) -> DataFrame:
    """Calls, successes, retries and milliseconds by phase and type of document."""
    return metrics.groupBy("phase", "document_type").agg(F.count("*").alias("n"), F.count_if("success").alias("n_success"), F.count_if(F.col("retry_count") > 0).alias("n_retried"), F.sum("duration").cast("double").alias("duration_ms"), F.max("duration").cast("double").alias("longest_ms"))


def hash_duplicates(texts: DataFrame) -> DataFrame:
    """Texts that occur more than once: digest, first document and number of copies. Only digests are shuffled."""
    return texts.where("text is not null").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n_copies")).where("n_copies > 1")
