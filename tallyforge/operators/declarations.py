"""Transport declarations: goods values in RON, required fields, answers of the authority, prefilled drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalise import text_of

#: Codes of operations; those that need a border point, and those valid for 15 days instead of 5 (fixed values).
OPERATION_CODES = {"AIC": "10", "LHI": "12", "SCI": "14", "LIC": "20", "LHE": "22", "SCE": "24", "TTN": "30", "IMP": "40", "EXP": "50", "DIN": "60", "DIE": "70"}
BORDER_CODES = ("10", "12", "14", "20", "22", "24", "60", "70")
FIFTEEN_DAYS = ("AIC", "LHI", "LHE", "SCI", "SCE", "DIN", "DIE")
#: Member states (fixed values).
EU = ("AT", "BE", "BG", "HR", "CY", "CZ", "DE", "DK", "EE", "ES", "FI", "FR", "GR", "HU", "IE", "IT", "LT", "LU", "LV", "MT", "NL", "PL", "PT", "RO", "SE", "SI", "SK")


def _half_up(x: Column, places: int) -> Column:
    return F.floor(x * 10**places + F.lit(0.5)) / 10**places


def operation_code(operation: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in OPERATION_CODES.items() for x in kv)), operation)


def operation_of_origin(country: Column) -> Column:
    """TTN at home, AIC from the union, else IMP, also without a country."""
    c = F.upper(F.trim(country))
    return F.when(c == "RO", "TTN").when(c.isin(*EU), "AIC").otherwise("IMP")


def validity_end(operation: Column, start: Column) -> Column:
    return F.date_add(start, F.when(F.upper(operation).isin(*FIFTEEN_DAYS), 15).otherwise(5))


def goods_value_ron(goods: DataFrame) -> DataFrame:
    """Goods with value_ron, exchange_rate, rate_date and rate_source. In this order: RON as it is; a rate above 0 on the
    goods; the rate that a stated RON value implies, to four decimals; the document's rate if its currency is the goods'
    or unknown; the published one; else none. goods: value, currency, value_ron, exchange_rate, rate_date, and document_
    and published_ rate, date, and document_currency."""
    value, ron, own = F.col("value"), F.col("value_ron"), F.col("exchange_rate")
    currency = F.upper(text_of(F.col("currency")))
    by_document = (F.col("document_rate") > 0) & (F.col("document_currency").isNull() | (F.col("document_currency") == currency))
    source = (
        F.when(value.isNull() | currency.isNull(), "none")
        .when(currency == "RON", "ron")
        .when(own > 0, "stated")
        .when(ron > 0, "implied")
        .when(by_document, "document")
        .when(F.col("published_rate") > 0, "published")
        .otherwise("none")
    )
    got = goods.withColumn("currency", currency).withColumn("rate_source", source)
    by = lambda **k: _ladder(F.col("rate_source"), k)
    rate = by(stated=own, implied=_half_up(ron / value, 4), document=F.col("document_rate"), published=F.col("published_rate"))
    unconverted = F.when(value.isNull() | F.col("currency").isNull(), ron)
    value_ron = by(ron=F.coalesce(ron, value), stated=F.when(ron > 0, ron).otherwise(_half_up(value * own, 2)), implied=ron, document=_half_up(value * F.col("document_rate"), 2), published=_half_up(value * F.col("published_rate"), 2))
    known = F.coalesce("rate_date", "document_date")
    date = by(stated=known, implied=known, document=F.col("document_date"), published=F.col("published_date"))
    return got.select(*[c for c in got.columns if c not in ("value_ron", "exchange_rate", "rate_date")], F.coalesce(value_ron, unconverted).alias("value_ron"), rate.alias("exchange_rate"), date.alias("rate_date"))


def _ladder(source: Column, values: dict[str, Column]) -> Column:
    out = F
    for name, value in values.items():
        out = out.when(source == name, value)
    return out


def declaration_errors(declarations: DataFrame, goods: DataFrame, as_of: Column) -> DataFrame:
    """A row for each thing that keeps a declaration from being sent: declaration_id, position (null for the head),
    error. The transport lies within three days from as_of."""
    d, code = F.col, operation_code(F.col("operation"))
    blank = lambda c: text_of(F.col(c)).isNull()
    country = lambda c: ~F.coalesce(d(c).rlike("^[A-Z]{2}$"), F.lit(False))
    heads = (
        ("operation", code.isNull()),
        ("transport date", d("transport_date").isNull()),
        ("transport date out of window", (d("transport_date") < as_of) | (d("transport_date") > F.date_add(as_of, 3))),
        ("transporter name", blank("transporter_name")),
        ("transporter country", country("transporter_country")),
        ("transporter tax id", (F.upper("transporter_country") == "RO") & ~F.coalesce(code == "30", F.lit(False)) & blank("transporter_tax_id")),
        ("vehicle plate", blank("vehicle_plate")),
        ("loading country", country("loading_country")),
        ("unloading country", country("unloading_country")),
        ("loading county", (d("loading_country") == "RO") & blank("loading_county")),
        ("loading city", (d("loading_country") == "RO") & blank("loading_city")),
        ("unloading county", (d("unloading_country") == "RO") & blank("unloading_county")),
        ("unloading city", (d("unloading_country") == "RO") & blank("unloading_city")),
        ("border point", code.isin(*BORDER_CODES) & blank("border_point")),
    )
    above = lambda c: F.coalesce(d(c) > 0, F.lit(False))
    foreign = F.coalesce(d("currency") != "RON", F.lit(False))
    parts = (
        ("description", blank("description")),
        ("tariff code", ~F.coalesce(d("tariff_code").rlike(r"^\d{4,10}$"), F.lit(False))),
        ("gross weight", ~above("weight_kg")),
        ("value in RON", ~above("value_ron")),
        ("value in currency", foreign & ~above("value")),
        ("official rate", foreign & (~above("exchange_rate") | d("rate_date").isNull())),
    )
    named = lambda rules: F.explode(F.filter(F.array(*(F.when(broken, F.lit(n)) for n, broken in rules)), lambda x: x.isNotNull())).alias("error")
    none = declarations.join(goods.select("declaration_id"), "declaration_id", "left_anti").select("declaration_id", F.lit("goods").alias("error"))
    of_heads = declarations.select("declaration_id", named(heads)).unionByName(none).select("declaration_id", F.lit(None).cast("int").alias("position"), "error")
    return of_heads.unionByName(goods.select("declaration_id", "position", named(parts)))


def parse_answer(body: Column) -> Column:
    """state and code of an answer, JSON or text: a code or a state of acceptance confirms, one of refusal rejects."""
    json = F.get_json_object(body, "$").isNotNull()
    of_json = F.lower(F.trim(F.coalesce(F.get_json_object(body, "$.stare"), F.get_json_object(body, "$.status"), F.lit(""))))
    of_text = F.lower(F.regexp_extract(body, r"""(?i)stare["']?\s*[=:]\s*["']?([^"'\s,}]+)""", 1))
    code_json = F.upper(F.trim(F.coalesce(F.get_json_object(body, "$.UIT"), F.get_json_object(body, "$.uit"), F.lit(""))))
    code_text = F.regexp_extract(body, r"""(?i)UIT["']?\s*[=:]\s*["']?([0-9A-Z]{10,20})""", 1)
    state = F.when(json, of_json).otherwise(of_text)
    code = F.when(json, F.when(code_json.rlike("^[0-9A-Z]{10,20}$"), code_json)).otherwise(F.nullif(code_text, F.lit("")))
    verdict = F.when(state.rlike("^(nok|rejected|respins)"), "REJECTED").when(code.isNotNull() | state.rlike("^(ok|valid|validated|confirmed)"), "CONFIRMED").otherwise("PENDING")
    return F.struct(verdict.alias("verdict"), F.when(verdict == "CONFIRMED", code).alias("code"))


def declaration_status(declarations: DataFrame, answers: DataFrame) -> DataFrame:
    """Status after the newest answer. A sent declaration is confirmed with its code and end of validity, or rejected;
    a withdrawal that is confirmed withdraws it, one that is rejected leaves it confirmed. declarations: declaration_id,
    status (SUBMITTED or INFIRMING), operation, transport_date, uit; answers: declaration_id, answered_at, body."""
    last = answers.groupBy("declaration_id").agg(F.max_by("body", F.struct("answered_at", "body")).alias("body"))
    got = declarations.join(last, "declaration_id", "left").withColumn("a", parse_answer(F.coalesce("body", F.lit(""))))
    verdict, waiting = F.col("a.verdict"), F.col("status") == "INFIRMING"
    status = F.when(verdict == "PENDING", F.col("status")).when(waiting, F.when(verdict == "CONFIRMED", "INFIRMED").otherwise("CONFIRMED")).otherwise(verdict)
    uit = F.when(waiting, F.col("uit")).otherwise(F.coalesce("a.code", "uit"))
    end = F.when(~waiting & (verdict == "CONFIRMED"), validity_end(F.col("operation"), F.col("transport_date")))
    return got.select("declaration_id", status.alias("status"), uit.alias("uit"), end.alias("valid_to_date"))


def purchase_source(documents: DataFrame) -> DataFrame:
    """The purchase document of each vehicle: its newest purchase invoice, else its newest purchase contract.
    documents: vehicle_id, document_id, type, is_purchase, uploaded_at."""
    rank = F.struct((F.col("type") == "Invoice").alias("invoice"), "uploaded_at", "document_id")
    return documents.where("is_purchase and type in ('Invoice', 'Contract')").groupBy("vehicle_id").agg(F.max_by(F.struct("document_id", "type", "uploaded_at"), rank).alias("s")).select("vehicle_id", "s.*")


def lookup_logistics(vehicles: DataFrame, sheet: DataFrame) -> DataFrame:
    """The first row of a logistics sheet for each VIN, how many there are, and what is missing. sheet: vin, row_number,
    weight_kg, city."""
    first = sheet.groupBy("vin").agg(F.count("*").alias("n_rows"), F.min_by(F.struct("row_number", "weight_kg", "city"), "row_number").alias("r")).select("vin", "n_rows", "r.*")
    got = vehicles.join(first, "vin", "left")
    warnings = F.filter(F.array(F.when(F.col("n_rows").isNull(), "not in the sheet"), F.when(F.col("n_rows") > 1, "repeated in the sheet"), F.when(F.col("n_rows").isNotNull() & ~F.coalesce(F.col("weight_kg") > 0, F.lit(False)), "weight missing"), F.when(F.col("n_rows").isNotNull() & text_of(F.col("city")).isNull(), "place missing")), lambda x: x.isNotNull())
    return got.withColumn("warnings", F.array_join(warnings, "; "))


def prefill(vehicles: DataFrame, documents: DataFrame, sheet: DataFrame) -> DataFrame:
    """Drafts of declarations for vehicles: operation by origin, purchase document, weight and place.
    vehicles: vehicle_id, vin, origin_country."""
    got = lookup_logistics(vehicles, sheet).join(purchase_source(documents).select("vehicle_id", "document_id"), "vehicle_id", "left")
    missing = F.when(F.col("document_id").isNull(), "purchase document missing")
    return got.select("vehicle_id", "vin", operation_of_origin(F.col("origin_country")).alias("operation"), "document_id", "weight_kg", "city", F.concat_ws("; ", F.nullif(F.col("warnings"), F.lit("")), missing).alias("warnings"))
