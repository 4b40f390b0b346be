"""Individually tracked stock items: costs, landed cost, margin and transit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import MONEY
from .ledger import money, non_deductible


def vehicle_costs(documents: DataFrame, lines: DataFrame) -> DataFrame:
    """Economic cost in RON of each item and category from incoming invoices and receipts, each line at the rate of its
    document; sums under 0.004 are dropped. Lines of a document without a rate have no amount and aren't in the sums:
    n_unrated counts them."""
    docs = documents.where("direction = 'incoming' and type in ('Invoice', 'Receipt')").select("document_id", "rate")
    category = F.when(F.col("account") == "624", "TRANSPORT").when(F.col("account") == "6022", "FUEL").otherwise("OTHER")
    amount = F.col("net") + non_deductible(F.col("vat"), F.col("deductibility"))
    met = lines.where("account <> '371'").join(docs, "document_id").withColumn("ron", money(amount.cast("double"), F.col("rate")).cast(MONEY))
    got = met.groupBy("vehicle_id", category.alias("category")).agg(F.coalesce(F.sum("ron"), F.lit(0)).alias("amount"), F.count_if(F.col("ron").isNull()).alias("n_unrated"))
    return got.where("abs(amount) >= 0.004 or n_unrated > 0")


def landed_cost(vehicles: DataFrame, costs: DataFrame) -> DataFrame:
    """Purchase price and all costs in RON, the margin at the sold price, and its percent of the landed cost (none of 0)."""
    sums = costs.groupBy("vehicle_id").agg(F.sum("amount").alias("costs"))
    all_ = vehicles.join(sums, "vehicle_id", "left").withColumn("costs", F.coalesce("costs", F.lit(0)))
    landed = F.col("price") + F.col("costs")
    return all_.select("vehicle_id", F.col("costs").cast("double").alias("costs"), landed.cast("double").alias("landed_cost"), (F.col("sold_price") - landed).cast("double").alias("margin"), F.round(F.try_divide(100 * (F.col("sold_price") - landed).cast("double"), landed.cast("double")), 4).alias("margin_percent"))
