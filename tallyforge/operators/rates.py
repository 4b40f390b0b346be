"""Exchange rates as of a date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A rate table of up to so many rows is sent to all executors; a longer one meets the documents in a shuffle.
BROADCAST_RATES = 200_000


def rates_as_of(documents: DataFrame, rates: DataFrame) -> DataFrame:
    """documents with the last rate published on or before their date; RON is 1, no rate gives null.

    A rate holds until the next one, and is listed under each month that it touches, so the join has the keys
    (currency, month) and no currency's documents lie in one task; the last rate of a currency holds for ever, and is
    found by the currency alone. Documents in RON don't take part in a shuffle.
    """
    after = F.lead("rate_date").over(Window.partitionBy("currency").orderBy("rate_date"))
    spans = rates.select(F.col("currency").alias("r_currency"), "rate_date", "rate", after.alias("until"))
    months = spans.where("until is not null").select("*", F.explode(F.sequence(F.trunc("rate_date", "month"), F.trunc("until", "month"), F.expr("interval 1 month"))).alias("r_month"))
    last = spans.where("until is null").select(F.col("r_currency").alias("l_currency"), F.col("rate_date").alias("l_date"), F.col("rate").alias("l_rate"))
    small = rates.limit(BROADCAST_RATES + 1).count() <= BROADCAST_RATES
    sized = F.broadcast if small else (lambda df: df.hint("merge"))
    d = documents.alias("d")
    on = (F.col("d.currency") == F.col("r_currency")) & (F.trunc("d.document_date", "month") == F.col("r_month")) & (F.col("d.document_date") >= F.col("rate_date")) & (F.col("d.document_date") < F.col("until"))
    ever = (F.col("d.currency") == F.col("l_currency")) & (F.col("d.document_date") >= F.col("l_date"))
    rate = F.when(F.col("d.currency") == "RON", F.lit(1.0)).otherwise(F.coalesce("rate", "l_rate")).alias("rate")
    found = lambda df: df.join(sized(months), on, "left").join(sized(last), ever, "left").select("d.*", rate, F.coalesce("rate_date", "l_date").alias("rate_date"))
    if small:
        return found(d)
    foreign = found(documents.where("currency <> 'RON'").alias("d"))
    return foreign.unionByName(documents.where("not coalesce(currency <> 'RON', false)").select("*", F.when(F.col("currency") == "RON", 1.0).alias("rate"), F.lit(None).cast("date").alias("rate_date")))
