"""What goes out to the accounting program: movements of money, and the order of invoices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import positions

LIQUID, VAT_OR_LIQUID = r"^(5311|5121|5124)", r"^(4426|4427|5311|5121|5124)"
#: Sources whose movements name no invoice, and the rank of kinds in the order of a car (fixed values).
UNLINKED = ("PAYMENT_DISPOSITION", "COLLECTION_DISPOSITION")
RANKS = {"car": 0, "services": 1, "transport": 2}
LATE = "9999-12-31"
#: Tags of a movement (fixed values).
TAGS = ("Data", "Numar", "Suma", "Cont", "{counter}", "Explicatie", "FacturaID", "FacturaNumar", "CodFiscal", "Moneda")


def movements(entries: DataFrame, edges: DataFrame, documents: DataFrame) -> DataFrame:
    """A row for each entry of cash or bank and each invoice that its document pays, or one if it pays none.

    entries: document_id, idx, account, debit, credit, document_date, source, original (amount in the document's currency,
    may be null); edges: document_id, invoice_id, amount (may be null); documents: document_id, number, currency. The
    counterpart is the document's first entry of 411 for a receipt or 401 for a payment, else its largest other entry that
    is neither VAT nor money, the first of equal ones. The amount is the edge's, else the original, else the entry's. Only
    edges to known documents count. The entries of one document are gathered once; equal edges give equal rows.
    """
    own = entries.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("idx", "account", "debit", "credit", "document_date", "source", "original"))).alias("es"))
    rows = own.select("document_id", "es", F.explode(F.filter("es", lambda e: e["account"].rlike(LIQUID) & ((e["debit"] > 0) | (e["credit"] > 0)))).alias("e"))
    receipt = F.col("e.debit") > 0
    first = F.get(F.filter("es", lambda x: x["account"].startswith(F.when(receipt, "411").otherwise("401"))), F.lit(0))["account"]
    others = F.filter("es", lambda x: (x["idx"] != F.col("e.idx")) & ~x["account"].rlike(VAT_OR_LIQUID))
    size = lambda x: F.struct((x["debit"] + x["credit"]).alias("size"), (-x["idx"]).alias("idx"), x["account"].alias("account"))
    largest = F.array_max(F.transform(others, size))["account"]
    made = rows.select("document_id", F.col("e.idx").alias("idx"), F.when(receipt, "receipt").otherwise("payment").alias("kind"), "e.document_date", "e.account", F.coalesce(first, largest, F.lit("")).alias("counter_account"), "e.source", F.coalesce("e.original", F.when(receipt, F.col("e.debit")).otherwise(F.col("e.credit"))).alias("own_amount"))
    names = documents.select("document_id", "number", "currency")
    paid = edges.join(names.select(F.col("document_id").alias("invoice_id"), F.col("number").alias("invoice_number")).hint("merge"), "invoice_id").select("document_id", "invoice_id", "amount", "invoice_number")
    met = made.join(names.hint("merge"), "document_id", "left").join(paid.hint("merge"), "document_id", "left")
    return met.select("document_id", "idx", "kind", "document_date", F.col("number").alias("reference"), F.coalesce("amount", "own_amount").alias("amount"), "account", "counter_account", "source", "currency", F.coalesce("invoice_id", "document_id").alias("linked_id"), F.coalesce("invoice_number", "number").alias("linked_number"))


def movement_records(moved: DataFrame, kind: str) -> DataFrame:
    """Receipts or payments with the tags of the exchanged format; movements of dispositions name no invoice."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    linked = lambda c: F.when(F.col("source").isin(*UNLINKED), "").otherwise(text(c))
    amount = F.regexp_replace(F.regexp_replace(F.abs(F.col("amount")).cast("decimal(18,2)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    saying = F.when(F.col("kind") == "receipt", "Încasare conform documentului").otherwise("Plată conform documentului")
    values = (F.coalesce(F.date_format("document_date", "dd-MM-yyyy"), F.lit("")), text("reference"), amount, text("account"), text("counter_account"), saying, linked("linked_id"), linked("linked_number"), F.lit(""), F.coalesce("currency", F.lit("RON")))
    counter = "ContClient" if kind == "receipt" else "ContFurnizor"
    return moved.where(F.col("kind") == kind).select(*(v.alias(tag.format(counter=counter)) for tag, v in zip(TAGS, values)))


def write_movements(moved: DataFrame, path: str, kind: str) -> None:
    root = "Incasari" if kind == "receipt" else "Plati"
    movement_records(moved, kind).write.mode("overwrite").option("rootTag", root).option("rowTag", "Linie").option("declaration", 'version="1.0" encoding="UTF-8"').xml(path)


def export_order(records: DataFrame) -> DataFrame:
    """records (document_id, at, date, kind, vehicle_id, vin) with their position: car by car, cars by the date of their
    purchase, else their earliest date; inside a car its purchase, services and transport, each by date and `at`; last what
    belongs to no car, by date. A purchase without a vehicle goes by its VIN; a missing date is the last."""
    day, rank = F.coalesce(F.col("date").cast("string"), F.lit(LATE)), F.create_map(*(F.lit(x) for pair in RANKS.items() for x in pair))[F.col("kind")]
    vin = F.nullif(F.regexp_replace(F.upper("vin"), "[^A-Z0-9]", ""), F.lit(""))
    group = F.when(F.col("vehicle_id").isNotNull(), F.concat(F.lit("v:"), F.col("vehicle_id"))).when(F.col("kind") == "car", F.concat(F.lit("vin:"), vin))
    keyed = records.withColumns({"_day": day, "_rank": rank, "_group": group})
    inside = F.struct("_rank", "_day", "at")
    groups = keyed.where("_group is not null").groupBy("_group").agg(F.coalesce(F.min(F.when(F.col("kind") == "car", F.col("_day"))), F.min("_day")).alias("_group_day"), F.min_by("at", inside).alias("_group_at"))
    met = keyed.join(groups.hint("merge"), "_group", "left")
    alone = F.col("_group").isNull()
    sorted_by = {"_k1": alone, "_k2": F.coalesce("_group_day", "_day"), "_k3": F.coalesce("_group_at", "at"), "_k4": F.when(alone, 0).otherwise(F.col("_rank")), "_k5": F.col("_day")}
    placed = positions(met.withColumns(sorted_by).drop("_day", "_rank", "_group_day", "_group_at"), [], [*sorted_by, "at"], "position")
    return placed.select(*records.columns, "position")
