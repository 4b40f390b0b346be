"""Bank statements: turnovers, sums, gaps and repeated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def day_turnover(rows: DataFrame) -> DataFrame:
    return rows.groupBy("statement_id", "day").agg(F.sum("debit").cast("double").alias("debit"), F.sum("credit").cast("double").alias("credit"), F.count("*").alias("n_rows"))


def statement_summary(rows: DataFrame) -> DataFrame:
    """Sums, period and signs for each statement; partial sums come before the shuffle."""
    return rows.groupBy("statement_id").agg(F.count("*").alias("n_rows"), F.sum("debit").cast("double").alias("debit"), F.sum("credit").cast("double").alias("credit"), F.sum(F.col("credit") - F.col("debit")).cast("double").alias("closing"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count_if(F.col("debit") > 0).alias("n_debits"))


def statement_gap(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """abs(opening + credits - debits - closing); null if a balance is missing."""
    sums = rows.groupBy("statement_id").agg(F.sum(F.col("credit") - F.col("debit")).alias("moved"))
    return headers.join(sums, "statement_id", "left").select("statement_id", F.abs(F.col("opening") + F.coalesce("moved", F.lit(0)) - F.col("closing")).cast("double").alias("gap"))


def first_of_repeated(rows: DataFrame) -> DataFrame:
    """The first row of each statement, day, event type and amounts."""
    return rows.groupBy("statement_id", "day", "event_type", "debit", "credit").agg(F.min("row_no").alias("row_no"), F.count("*").alias("n_same")).select("statement_id", "day", "event_type", F.col("debit").cast("double").alias("debit"), F.col("credit").cast("double").alias("credit"), "row_no", "n_same")
