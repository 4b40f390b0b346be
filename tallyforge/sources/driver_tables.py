"""Accounting views over the plain star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import MONEY, round2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, more: dict[str, Column] | None = None) -> DataFrame:
    """One accounting document for each order, with more columns of the order."""
    kind, more = F.col("o_orderkey") % 10, more or {}
    out = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("document_id"),
        F.col("o_custkey").alias("partner_id"),
        F.when(kind < 6, "Invoice").when(kind < 8, "Receipt").when(kind == 8, "Payment Disposition").otherwise("Collection Disposition").alias("type"),
        F.when(F.col("o_custkey") % 2 == 0, "incoming").otherwise("outgoing").alias("direction"),
        F.when(F.col("o_orderkey") % 7 == 0, "EUR").when(F.col("o_orderkey") % 7 == 1, "HUF").otherwise("RON").alias("currency"),
        F.when(F.col("o_orderstatus") == "F", "APPROVED").when(F.col("o_orderstatus") == "O", "PENDING_APPROVAL").otherwise("REOPENED").alias("review_status"),
        F.to_date("o_orderdate").alias("document_date"),
        *(c.alias(f"more_{name}") for name, c in more.items()),
    )
    return out.select(*(F.col(f"more_{c}").alias(c) if c in more else c for c in out.columns if not c.startswith("more_")), *(F.col(f"more_{c}").alias(c) for c in more if c not in out.columns))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines; returned goods are negative lines."""
    sign = F.when(F.col("l_returnflag") == "R", -1.0).otherwise(1.0)
    net = sign * F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100 + F.lit(0.5)) / 100
    account = F.element_at(F.array(*map(F.lit, ("371", "624", "628", "6022"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    raw = table(spark, sf_dir, "lineitem").withColumn("net_raw", net)
    return raw.select(
        F.col("l_orderkey").alias("document_id"),
        F.col("l_partkey").alias("vehicle_id"),
        F.col("net_raw").cast(MONEY).alias("net"),
        round2(F.col("net_raw") * F.col("l_tax")).alias("vat"),
        F.round(F.col("l_tax") * 100).cast("int").alias("vat_rate"),
        F.when(F.col("l_returnflag") == "A", "FULL").when(F.col("l_returnflag") == "N", "PARTIAL_50").otherwise("NONE").alias("deductibility"),
        account.alias("account"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate").alias("pos"),
    )


def posting_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with all that posting looks at; some of the incoming invoices are contracts. The stated total is the
    order's, which counts for documents without lines."""
    k, partner = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.when(k % 10 == 9, "Collection Disposition").when(k % 10 == 8, "Payment Disposition").when(k % 10 > 5, "Receipt").when((k % 10 == 5) & (partner % 4 == 0), "Contract").otherwise("Invoice")
    total = round2(F.col("o_totalprice"))
    return documents(spark, sf_dir, {
        "type": kind,
        "number": F.when(k % 101 != 0, F.concat(F.lit("D-"), k)),
        "total": total,
        "vat": round2(total.cast("double") * 19 / 119),
        "is_advance": k % 11 == 0,
        "receipt_type": F.when(k % 4 == 2, "payment_receipt"),
        "payment_method": F.when(k % 3 == 0, "bank").otherwise("cash"),
        "account_code": F.when(k % 97 == 0, "cash").when(k % 5 == 3, "542"),
        "reverse_charge": k % 13 == 0,
        "vat_payer": partner % 5 != 0,
        "ref_direction": F.when((k % 10 >= 6) & (k % 9 < 2), F.when(k % 9 == 0, "incoming").otherwise("outgoing")),
    })


def posting_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of which some have no account, one of revenue, or one that can't be."""
    v = F.col("vehicle_id")
    account = F.when(v % 20 == 19, "704").when(v % 997 == 0, "37x").when(v % 5 != 0, F.col("account"))
    return lines(spark, sf_dir).withColumn("account", account)


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published rate for each foreign currency and first month of a quarter that has documents."""
    month = F.trunc("document_date", "month").alias("rate_date")
    published = documents(spark, sf_dir).where("currency <> 'RON' and month(document_date) % 3 = 1").select("currency", month).distinct()
    return published.withColumn("rate", F.when(F.col("currency") == "EUR", 4.5 + F.month("rate_date") / 16).otherwise((1.25 + F.month("rate_date") / 64) / 100))


def bank_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank transactions; purchases and errors are debits."""
    amount = round2(F.col("value"))
    out = F.col("event_type").isin("purchase", "error")
    zero = F.lit(0).cast(MONEY)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("statement_id"), F.col("event_id").alias("row_no"), "ts", F.to_date("ts").alias("day"), "event_type", F.when(out, amount).otherwise(zero).alias("debit"), F.when(out, zero).otherwise(amount).alias("credit"))
