"""Vehicles and their documents: which buy one, which are costs of one, how they are linked, and what they tell of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalise import ascii_fold, is_purchase_contract, text_of, vin_or_null

#: Words in descriptions of vehicles, freight and other costs of purchase (fixed values).
VEHICLE_WORDS = ("auto", "autoturism", "automobil", "vehicle", "vehicul", "fahrzeug", "pkw")
PURCHASE_WORDS = ("auto", "autoturism", "vehicle", "vehicul", "fahrzeug")
FREIGHT_WORDS = r"transport|freight|fracht|delivery|livrare|platform|tractare|remorcare|\btow\b"
COST_WORDS = ("document", "handling", "procesare", "pregatire", "taxa", "fee", "customs", "vama", "tva", "vat", "itp", "inspection", "inspectie", "registration", "inmatriculare", "rar", "service", "repair", "reparatie", "refurb", "recondition", "piese", "parts")
#: What candidates may tell of a vehicle.
ATTRIBUTES = ("make", "model", "year", "mileage_km", "origin_country")


def _words(words: tuple[str, ...]) -> str:
    return r"(?i)\b(" + "|".join(words) + r")\b"


def is_vehicle_line(name: Column) -> Column:
    return F.coalesce(name.rlike(_words(VEHICLE_WORDS)), F.lit(False))


def is_freight(name: Column) -> Column:
    return F.coalesce(ascii_fold(name).rlike(FREIGHT_WORDS), F.lit(False))


def is_ancillary_line(name: Column) -> Column:
    return is_freight(name) | F.coalesce(ascii_fold(name).rlike(_words(COST_WORDS)), F.lit(False))


def classify_documents(documents: DataFrame, lines: DataFrame) -> DataFrame:
    """Documents with is_purchase and is_cost. A purchase is a contract of purchase, or an invoice that isn't outgoing
    and says so or, without saying anything, names a vehicle and has a stock line. A cost is another incoming invoice
    that says so, has a cost category or a vehicle, or a receipt with a vehicle that doesn't just pay something.
    documents: document_id, type, direction, transaction, vin, contract_type, receipt_type, vehicle_id; lines:
    document_id, name, account, cost_category."""
    stock = F.coalesce(F.col("account").startswith("371"), F.lit(False)) | F.coalesce(F.col("name").rlike(_words(PURCHASE_WORDS)), F.lit(False))
    flags = lines.groupBy("document_id").agg(F.bool_or(stock).alias("has_stock"), F.bool_or(F.col("cost_category").isNotNull()).alias("has_category"))
    said, out = F.lower(F.trim("transaction")), F.coalesce(F.col("direction") == "outgoing", F.lit(False))
    contract = is_purchase_contract(F.col("transaction"), F.col("direction"), F.col("vin"), F.col("contract_type"))
    guessed = vin_or_null(F.col("vin")).isNotNull() & F.coalesce("has_stock", F.lit(False))
    invoice = (F.col("type") == "Invoice") & ~out & F.when(said == "purchase", True).when(said.isin("cost", "other"), False).otherwise(guessed)
    got = documents.join(flags, "document_id", "left").withColumn("is_purchase", F.coalesce((F.col("type") == "Contract") & contract | invoice, F.lit(False)))
    linked = F.col("vehicle_id").isNotNull()
    cost = F.when(F.col("type") == "Receipt", linked & F.coalesce(F.col("receipt_type") != "payment_receipt", F.lit(True))).when(F.col("type") == "Invoice", F.coalesce(said == "cost", F.lit(False)) | F.coalesce("has_category", F.lit(False)) | linked)
    return got.withColumn("is_cost", F.coalesce(cost & ~out & ~F.col("is_purchase"), F.lit(False))).drop("has_stock", "has_category")


def attach_documents(documents: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Documents without a vehicle take the one of their tenant and VIN; those whose vehicle has another VIN go to
    review and keep it. A VIN belongs to one vehicle of a tenant; of several the one of the smallest id counts."""
    by_vin = vehicles.groupBy("tenant", "vin").agg(F.min("vehicle_id").alias("found_id"))
    own = vehicles.select("tenant", "vehicle_id", F.col("vin").alias("own_vin"))
    got = documents.withColumn("vin_key", vin_or_null(F.col("vin"))).join(by_vin.withColumnRenamed("vin", "vin_key"), ["tenant", "vin_key"], "left").join(own, ["tenant", "vehicle_id"], "left")
    differs = F.coalesce(F.col("own_vin") != F.col("vin_key"), F.lit(False))
    return got.select("document_id", "tenant", F.coalesce("vehicle_id", "found_id").alias("vehicle_id"), differs.alias("needs_review"), (F.col("vehicle_id").isNull() & F.col("found_id").isNotNull()).alias("attached"))


def vehicle_state(vehicles: DataFrame, candidates: DataFrame) -> DataFrame:
    """Vehicles after their documents: of each attribute the newest that a document gives, else what is on file; the
    newest purchase sets price and currency, and a SOURCED vehicle becomes PURCHASED. candidates: vehicle_id,
    document_id, uploaded_at, is_purchase, purchase_price, purchase_currency and the attributes."""
    order = F.struct("uploaded_at", "document_id")
    newest = lambda c, also=F.lit(True): F.max_by(F.struct(c), F.when(F.col(c).isNotNull() & also, order))[c].alias(f"new_{c}")
    blank = [text_of(F.col(c)).alias(c) if c in ("make", "model", "origin_country") else F.col(c) for c in ATTRIBUTES]
    given = candidates.select("vehicle_id", "document_id", "uploaded_at", "is_purchase", F.when(F.col("purchase_price") > 0, F.col("purchase_price")).alias("purchase_price"), "purchase_currency", *blank)
    bought = F.col("is_purchase")
    told = given.groupBy("vehicle_id").agg(*map(newest, ATTRIBUTES), newest("purchase_price", bought), newest("purchase_currency", bought), F.bool_or(bought).alias("bought"))
    got = vehicles.join(told, "vehicle_id", "left")
    status = F.when(F.col("bought") & (F.col("status") == "SOURCED"), "PURCHASED").otherwise(F.col("status"))
    return got.select("vehicle_id", *(F.coalesce(f"new_{c}", c).alias(c) for c in (*ATTRIBUTES, "purchase_price", "purchase_currency")), status.alias("status"))


def purchase_rates(costs: DataFrame, postings: DataFrame) -> DataFrame:
    """Costs in another currency than their vehicle's purchase get the rate of its first purchase posting, else the
    published one that they carry; amounts are converted through RON. costs: vehicle_id, currency, amount, rate,
    purchase_currency, published_rate (of the purchase currency); postings: vehicle_id, posting_id, posted_at, rate."""
    first = postings.groupBy("vehicle_id").agg(F.min_by("rate", F.struct("posted_at", "posting_id")).alias("first_rate"))
    got = costs.join(first, "vehicle_id", "left")
    same = F.col("currency") == F.col("purchase_currency")
    rate = F.when(F.col("purchase_currency") == "RON", F.lit(1.0)).otherwise(F.coalesce("first_rate", "published_rate"))
    converted = F.floor(F.col("amount") * F.col("rate") / rate * 100 + F.lit(0.5)) / 100
    return got.withColumns({"purchase_rate": F.when(~same, rate), "purchase_amount": F.when(same, F.col("amount")).otherwise(converted)}).drop("first_rate")
