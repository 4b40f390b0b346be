"""Queries of vehicles, their documents and transport declarations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import declarations as dc
from ..operators import vehicles as vh
from ..sources.driver_tables import table

AS_OF = "1996-06-30"


def _pick(index, *values):
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def _vin(k):
    return F.concat(F.lit("WVWZZZ1KZ"), F.lpad(k.cast("string"), 8, "0"))


def _vehicles(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("vehicle_id"), F.lit(1).alias("tenant"), _vin(k).alias("vin"), F.col("p_brand").alias("make"), F.col("p_name").alias("model"), F.lit(2015).alias("year"), F.lit(None).cast("int").alias("mileage_km"), _pick(k, "RO", "DE", "CH").alias("origin_country"), F.lit(0.0).alias("purchase_price"), F.lit("RON").alias("purchase_currency"), F.when(k % 2 == 0, "SOURCED").otherwise("IN_STOCK").alias("status"))


def _documents(spark, sf_dir):
    """Orders as documents around vehicles; some name a VIN, some are linked, some to the wrong vehicle."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("part", F.col("o_custkey"))
    return o.select(
        k.alias("document_id"),
        F.lit(1).alias("tenant"),
        _pick(k, "Invoice", "Contract", "Receipt").alias("type"),
        F.when(k % 7 == 0, "outgoing").when(k % 7 < 5, "incoming").alias("direction"),
        F.when(k % 11 == 0, "purchase").when(k % 11 == 1, "cost").when(k % 11 == 2, "other").alias("transaction"),
        F.when(k % 4 != 0, F.lower(_vin(F.col("part")))).alias("vin"),
        _pick(k, "Vânzare auto", "Leasing").alias("contract_type"),
        F.when(k % 5 == 0, "payment_receipt").alias("receipt_type"),
        F.when(k % 6 == 0, F.col("part")).when(k % 13 == 0, F.lit(1)).cast("bigint").alias("vehicle_id"),
        F.col("o_orderdate").alias("uploaded_at"),
        F.when(k % 3 == 0, F.concat(F.lit("Make "), (k % 8).cast("string"))).alias("make"),
        F.when(k % 5 == 1, F.lit(" ")).when(k % 5 == 2, F.concat(F.lit("Model "), (k % 9).cast("string"))).alias("model"),
        F.when(k % 4 == 1, (F.lit(2000) + k % 20).cast("int")).alias("year"),
        F.when(k % 4 == 2, (k % 100000).cast("int")).alias("mileage_km"),
        F.lit(None).cast("string").alias("origin_country"),
        (F.floor("o_totalprice") * 1.0).alias("purchase_price"),
        F.when(k % 2 == 0, "EUR").alias("purchase_currency"),
        "part",
    )


def _lines(spark, sf_dir):
    n, k = table(spark, sf_dir, "lineitem"), F.col("l_partkey")
    names = ("Autoturism Golf", "Livrare la domiciliu", "Taxă de înmatriculare", "Anvelope", "Vehicul rulat", "Tow service", "autoturisme second hand")
    return n.select(F.col("l_orderkey").alias("document_id"), _pick(k, *names).alias("name"), F.when(k % 9 == 0, "371.01").otherwise("628").alias("account"), F.when(k % 10 == 0, "REPAIR").alias("cost_category"))


def line_kinds(spark, sf_dir):
    name = F.col("name")
    return _lines(spark, sf_dir).groupBy("name").agg(F.count("*").alias("n_lines")).select("name", "n_lines", vh.is_vehicle_line(name).alias("vehicle"), vh.is_freight(name).alias("freight"), vh.is_ancillary_line(name).alias("ancillary"))


def vehicle_documents(spark, sf_dir):
    return vh.classify_documents(_documents(spark, sf_dir), _lines(spark, sf_dir)).select("document_id", "is_purchase", "is_cost")


def attached_documents(spark, sf_dir):
    return vh.attach_documents(_documents(spark, sf_dir), _vehicles(spark, sf_dir)).drop("tenant")


def _candidates(spark, sf_dir):
    return vh.classify_documents(_documents(spark, sf_dir), _lines(spark, sf_dir)).withColumn("vehicle_id", F.col("part").cast("bigint"))


def vehicle_state(spark, sf_dir):
    return vh.vehicle_state(_vehicles(spark, sf_dir), _candidates(spark, sf_dir))


def purchase_sources(spark, sf_dir):
    return dc.purchase_source(_candidates(spark, sf_dir)).select("vehicle_id", "document_id", "type")


def purchase_rates(spark, sf_dir):
    """Costs are lines of vehicles in three currencies, postings every fifth order of a vehicle."""
    k = F.col("l_partkey")
    costs = table(spark, sf_dir, "lineitem").select(k.alias("vehicle_id"), _pick(F.col("l_orderkey"), "RON", "EUR", "HUF").alias("currency"), F.col("l_extendedprice").alias("amount"), _pick(F.col("l_orderkey"), 1.0, 5.0, 0.0125).alias("rate"), _pick(k, "EUR", "RON").alias("purchase_currency"), _pick(k, 4.75, 1.0).alias("published_rate"))
    postings = _documents(spark, sf_dir).where("document_id % 5 = 0").select(F.col("part").alias("vehicle_id"), F.col("document_id").alias("posting_id"), F.col("uploaded_at").alias("posted_at"), (F.lit(4.5) + F.col("document_id") % 8 / 16).alias("rate"))
    return vh.purchase_rates(costs, postings).groupBy("vehicle_id", "currency").agg(F.max("purchase_rate").alias("purchase_rate"), F.sum(F.col("purchase_amount").cast("decimal(18,2)")).cast("double").alias("amount"), F.count("*").alias("n_lines"))


def _sheet(spark, sf_dir):
    """Rows of a logistics sheet: lines of parts, some without weight or place."""
    n = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return n.select(_vin(F.when(k % 9 == 0, k - 1).otherwise(k)).alias("vin"), k.alias("row_number"), F.when(k % 5 != 0, (k % 900 + 900) * 1.0).alias("weight_kg"), F.when(k % 4 != 0, F.concat(F.lit("City "), F.col("s_nationkey").cast("string"))).alias("city"))


def logistics_lookup(spark, sf_dir):
    return dc.lookup_logistics(_vehicles(spark, sf_dir).select("vehicle_id", "vin"), _sheet(spark, sf_dir))


def declaration_drafts(spark, sf_dir):
    return dc.prefill(_vehicles(spark, sf_dir).select("vehicle_id", "vin", "origin_country"), _candidates(spark, sf_dir), _sheet(spark, sf_dir))


def _goods(spark, sf_dir):
    n, k = table(spark, sf_dir, "lineitem"), F.col("l_partkey")
    return n.select(
        F.col("l_orderkey").alias("declaration_id"),
        F.col("l_linenumber").cast("int").alias("position"),
        F.when(k % 17 != 0, F.concat(F.lit("Goods "), k.cast("string"))).alias("description"),
        F.when(k % 19 != 0, F.lpad((k % 10000).cast("string"), 8, "8")).otherwise("87x").alias("tariff_code"),
        F.when(k % 23 != 0, F.col("l_quantity") * 10).otherwise(0).alias("weight_kg"),
        F.when(k % 29 != 0, F.col("l_extendedprice")).alias("value"),
        _pick(k, "RON", " eur", "USD").alias("currency"),
        F.when(k % 7 == 0, F.col("l_extendedprice") * 5).alias("value_ron"),
        F.when(k % 5 == 0, F.lit(4.875)).alias("exchange_rate"),
        F.when(k % 10 == 0, F.lit("1996-01-15").cast("date")).alias("rate_date"),
        F.when(k % 4 == 0, F.lit(4.9375)).alias("document_rate"),
        F.when(k % 8 == 0, F.lit("EUR")).alias("document_currency"),
        F.when(k % 4 == 0, F.lit("1996-02-20").cast("date")).alias("document_date"),
        F.when(k % 13 != 0, F.lit(4.8125)).alias("published_rate"),
        F.when(k % 13 != 0, F.to_date("l_shipdate")).alias("published_date"),
    )


def goods_values(spark, sf_dir):
    got = dc.goods_value_ron(_goods(spark, sf_dir))
    return got.groupBy("currency", "rate_source", "exchange_rate", "rate_date").agg(F.sum(F.col("value_ron").cast("decimal(18,2)")).cast("double").alias("value_ron"), F.count("*").alias("n_goods"))


def _declarations(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    day = F.lit(AS_OF).cast("date")
    return o.select(
        k.alias("declaration_id"),
        _pick(k, "AIC", "TTN", "IMP", "XXX").alias("operation"),
        F.when(k % 11 != 0, F.date_add(day, (k % 5 - F.when(k % 13 == 0, 3).otherwise(0)).cast("int"))).alias("transport_date"),
        F.when(k % 9 != 0, "Carrier").otherwise(" ").alias("transporter_name"),
        _pick(k, "RO", "DE", "Ro").alias("transporter_country"),
        F.when(k % 2 == 0, F.col("o_custkey").cast("string")).alias("transporter_tax_id"),
        F.when(k % 14 != 0, "B100ABC").alias("vehicle_plate"),
        _pick(k, "DE", "RO").alias("loading_country"),
        F.when(k % 3 == 0, "40").alias("loading_county"),
        F.when(k % 5 == 0, "Iași").alias("loading_city"),
        _pick(k, "RO", "FR", "ROU").alias("unloading_country"),
        F.when(k % 4 == 0, "22").alias("unloading_county"),
        F.when(k % 7 == 0, "Cluj").alias("unloading_city"),
        F.when(k % 6 == 0, "Nădlac").alias("border_point"),
    )


def declaration_errors(spark, sf_dir):
    got = dc.declaration_errors(_declarations(spark, sf_dir), dc.goods_value_ron(_goods(spark, sf_dir).where("declaration_id % 10 <> 3")), F.lit(AS_OF).cast("date"))
    return got.select("declaration_id", F.coalesce("position", F.lit(0)).alias("position"), "error")


def declaration_status(spark, sf_dir):
    """Answers are events, in JSON or in text; declarations are customers."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    code = F.concat(F.lit("UIT"), F.lpad(k.cast("string"), 9, "0"))
    bodies = (F.concat(F.lit('{"stare": "ok", "UIT": "'), code, F.lit('"}')), F.lit('{"stare": "nok"}'), F.lit("stare=in prelucrare"), F.concat(F.lit("<header stare=\"ok\" uit: '"), code, F.lit("'")), F.lit("stare: respins"), F.lit('{"status": "Valid", "uit": "short"}'), F.lit(""))
    body = F.element_at(F.array(*bodies), (k % len(bodies) + 1).cast("int"))
    c = F.col("c_custkey")
    d = table(spark, sf_dir, "customer").select(c.alias("declaration_id"), F.when(c % 3 == 0, "INFIRMING").otherwise("SUBMITTED").alias("status"), _pick(c, "AIC", "TTN", "DIE").alias("operation"), F.date_add(F.lit(AS_OF).cast("date"), (c % 9).cast("int")).alias("transport_date"), F.when(c % 3 == 0, F.concat(F.lit("OLD"), c.cast("string"))).alias("uit"))
    return dc.declaration_status(d, e.select(F.col("user_id").alias("declaration_id"), F.col("ts").alias("answered_at"), body.alias("body")))


NAMES = (line_kinds, vehicle_documents, attached_documents, vehicle_state, purchase_sources, purchase_rates, logistics_lookup, declaration_drafts, goods_values, declaration_errors, declaration_status)

_BASE = """
WITH d AS (
  SELECT o_orderkey AS id, o_custkey AS part, ['Invoice', 'Contract', 'Receipt'][o_orderkey % 3 + 1] AS type, CASE WHEN o_orderkey % 7 = 0 THEN 'outgoing' WHEN o_orderkey % 7 < 5 THEN 'incoming' END AS direction,
         CASE o_orderkey % 11 WHEN 0 THEN 'purchase' WHEN 1 THEN 'cost' WHEN 2 THEN 'other' END AS said, o_orderkey % 4 <> 0 AS has_vin, o_orderkey % 2 = 0 AS sale, o_orderkey % 5 = 0 AS pays,
         CASE WHEN o_orderkey % 6 = 0 THEN o_custkey WHEN o_orderkey % 13 = 0 THEN 1 END AS linked, o_orderdate AS ts, floor(o_totalprice) AS price FROM orders
), n AS (
  SELECT l_orderkey AS id, l_partkey % 9 = 0 OR l_partkey % 7 IN (0, 4) AS stock, l_partkey % 10 = 0 AS category FROM lineitem
), f AS (SELECT id, bool_or(stock) AS stock, bool_or(category) AS category FROM n GROUP BY id),
p AS (
  SELECT d.*, coalesce(stock, false) AS stock, coalesce(category, false) AS category, coalesce(direction = 'outgoing', false) AS outward FROM d LEFT JOIN f USING (id)
), q AS (
  SELECT *, CASE type WHEN 'Contract' THEN NOT outward AND (coalesce(said = 'purchase', false) OR (has_vin AND sale)) WHEN 'Invoice' THEN NOT outward AND CASE WHEN said = 'purchase' THEN true WHEN said IS NOT NULL THEN false ELSE has_vin AND stock END ELSE false END AS is_purchase FROM p
), docs AS (
  SELECT *, NOT outward AND NOT is_purchase AND CASE type WHEN 'Receipt' THEN linked IS NOT NULL AND NOT pays WHEN 'Invoice' THEN coalesce(said = 'cost', false) OR category OR linked IS NOT NULL ELSE false END AS is_cost FROM q
)"""
_VIN = "'WVWZZZ1KZ' || lpad(CAST({} AS VARCHAR), 8, '0')"
_SHEET = f""", sheet AS (
  SELECT {_VIN.format('CASE WHEN s_suppkey % 9 = 0 THEN s_suppkey - 1 ELSE s_suppkey END')} AS vin, s_suppkey AS row_number, CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_suppkey % 900 + 900 AS DOUBLE) END AS weight_kg, CASE WHEN s_suppkey % 4 <> 0 THEN 'City ' || s_nationkey END AS city FROM supplier
), firsts AS (SELECT vin, count(*) AS n_rows, min(row_number) AS row_number FROM sheet GROUP BY vin),
looked AS (
  SELECT p_partkey AS vehicle_id, {_VIN.format('p_partkey')} AS vin, n_rows, f.row_number, weight_kg, city,
         array_to_string(list_filter([CASE WHEN n_rows IS NULL THEN 'not in the sheet' END, CASE WHEN n_rows > 1 THEN 'repeated in the sheet' END, CASE WHEN n_rows > 0 AND weight_kg IS NULL THEN 'weight missing' END, CASE WHEN n_rows > 0 AND city IS NULL THEN 'place missing' END], lambda x: x IS NOT NULL), '; ') AS warnings
  FROM part LEFT JOIN firsts f ON f.vin = {_VIN.format('p_partkey')} LEFT JOIN sheet s ON s.vin = f.vin AND s.row_number = f.row_number
), sources AS (SELECT part AS vehicle_id, arg_max(id, [CASE type WHEN 'Invoice' THEN 1 ELSE 0 END, epoch_us(ts), id]) AS document_id FROM docs WHERE is_purchase AND type <> 'Receipt' GROUP BY part)"""
_GOODS = """goods AS (
  SELECT l_orderkey AS declaration_id, CAST(l_linenumber AS INTEGER) AS position, l_partkey AS k, CASE WHEN l_partkey % 29 <> 0 THEN l_extendedprice END AS value, ['RON', 'EUR', 'USD'][l_partkey % 3 + 1] AS currency,
         CASE WHEN l_partkey % 7 = 0 THEN l_extendedprice * 5 END AS ron, CAST(l_shipdate AS DATE) AS shipped, DATE '1996-02-20' AS document_date FROM lineitem
), sourced AS (
  SELECT *, CASE WHEN value IS NULL THEN 'none' WHEN currency = 'RON' THEN 'ron' WHEN k % 5 = 0 THEN 'stated' WHEN ron > 0 THEN 'implied' WHEN k % 4 = 0 AND (k % 8 <> 0 OR currency = 'EUR') THEN 'document' WHEN k % 13 <> 0 THEN 'published' ELSE 'none' END AS rate_source FROM goods
), valued AS (
  SELECT declaration_id, position, k, value, currency, rate_source,
         CASE rate_source WHEN 'stated' THEN 4.875::DOUBLE WHEN 'implied' THEN floor(ron / value * 10000 + 0.5::DOUBLE) / 10000 WHEN 'document' THEN 4.9375::DOUBLE WHEN 'published' THEN 4.8125::DOUBLE END AS exchange_rate,
         CASE WHEN rate_source IN ('stated', 'implied') THEN coalesce(CASE WHEN k % 10 = 0 THEN DATE '1996-01-15' END, CASE WHEN k % 4 = 0 THEN document_date END) WHEN rate_source = 'document' THEN document_date WHEN rate_source = 'published' THEN shipped END AS rate_date,
         CASE rate_source WHEN 'none' THEN CASE WHEN value IS NULL THEN ron END WHEN 'ron' THEN coalesce(ron, value) WHEN 'implied' THEN ron WHEN 'stated' THEN coalesce(ron, floor(value * 4.875::DOUBLE * 100 + 0.5::DOUBLE) / 100)
              WHEN 'document' THEN floor(value * 4.9375::DOUBLE * 100 + 0.5::DOUBLE) / 100 ELSE floor(value * 4.8125::DOUBLE * 100 + 0.5::DOUBLE) / 100 END AS value_ron FROM sourced
)"""


def oracle_sql():
    newest = lambda c: f"arg_max({c}, [epoch_us(ts), id]) FILTER ({c} IS NOT NULL)"
    foreign = "currency <> 'RON'"
    return {
        "line_kinds": """WITH n AS (SELECT ['Autoturism Golf', 'Livrare la domiciliu', 'Taxă de înmatriculare', 'Anvelope', 'Vehicul rulat', 'Tow service', 'autoturisme second hand'][l_partkey % 7 + 1] AS name FROM lineitem)
SELECT name, count(*) AS n_lines, name IN ('Autoturism Golf', 'Vehicul rulat') AS vehicle, name IN ('Livrare la domiciliu', 'Tow service') AS freight, name IN ('Livrare la domiciliu', 'Tow service', 'Taxă de înmatriculare') AS ancillary FROM n GROUP BY name""",
        "vehicle_documents": f"{_BASE} SELECT id AS document_id, is_purchase, is_cost FROM docs",
        "attached_documents": f"{_BASE} SELECT id AS document_id, coalesce(linked, CASE WHEN has_vin THEN part END) AS vehicle_id, linked IS NOT NULL AND has_vin AND linked <> part AS needs_review, linked IS NULL AND has_vin AS attached FROM docs",
        "vehicle_state": f"""{_BASE}, told AS (
  SELECT part, id, ts, is_purchase, CASE WHEN id % 3 = 0 THEN 'Make ' || (id % 8) END AS make, CASE WHEN id % 5 = 2 THEN 'Model ' || (id % 9) END AS model, CASE WHEN id % 4 = 1 THEN CAST(2000 + id % 20 AS INTEGER) END AS year, CASE WHEN id % 4 = 2 THEN CAST(id % 100000 AS INTEGER) END AS mileage,
         CASE WHEN is_purchase AND price > 0 THEN CAST(price AS DOUBLE) END AS cost, CASE WHEN is_purchase AND id % 2 = 0 THEN 'EUR' END AS currency FROM docs
), t AS (SELECT part, {newest('make')} AS make, {newest('model')} AS model, {newest('year')} AS year, {newest('mileage')} AS mileage, {newest('cost')} AS cost, {newest('currency')} AS currency, bool_or(is_purchase) AS bought FROM told GROUP BY part)
SELECT p_partkey AS vehicle_id, coalesce(make, p_brand) AS make, coalesce(model, p_name) AS model, coalesce(year, 2015) AS year, mileage AS mileage_km, ['RO', 'DE', 'CH'][p_partkey % 3 + 1] AS origin_country, coalesce(cost, 0.0::DOUBLE) AS purchase_price, coalesce(currency, 'RON') AS purchase_currency,
CASE WHEN p_partkey % 2 = 1 THEN 'IN_STOCK' WHEN bought THEN 'PURCHASED' ELSE 'SOURCED' END AS status FROM part LEFT JOIN t ON part = p_partkey""",
        "purchase_sources": f"{_BASE}{_SHEET} SELECT s.vehicle_id, s.document_id, type FROM sources s JOIN docs ON id = document_id",
        "purchase_rates": f"""{_BASE}, first AS (SELECT part, arg_min(4.5::DOUBLE + id % 8 / 16, [epoch_us(ts), id]) AS first_rate FROM d WHERE id % 5 = 0 GROUP BY part),
c AS (SELECT l_partkey AS vehicle_id, ['RON', 'EUR', 'HUF'][l_orderkey % 3 + 1] AS currency, l_extendedprice AS amount, [1.0::DOUBLE, 5.0::DOUBLE, 0.0125::DOUBLE][l_orderkey % 3 + 1] AS rate, ['EUR', 'RON'][l_partkey % 2 + 1] AS bought, CASE WHEN l_partkey % 2 = 1 THEN 1.0::DOUBLE ELSE coalesce(first_rate, 4.75::DOUBLE) END AS r FROM lineitem LEFT JOIN first ON part = l_partkey)
SELECT vehicle_id, currency, max(CASE WHEN currency <> bought THEN r END) AS purchase_rate, CAST(sum(CAST(CASE WHEN currency = bought THEN amount ELSE floor(amount * rate / r * 100 + 0.5::DOUBLE) / 100 END AS DECIMAL(18,2))) AS DOUBLE) AS amount, count(*) AS n_lines FROM c GROUP BY ALL""",
        "logistics_lookup": f"{_BASE}{_SHEET} SELECT * FROM looked",
        "declaration_drafts": f"""{_BASE}{_SHEET} SELECT vehicle_id, vin, ['TTN', 'AIC', 'IMP'][vehicle_id % 3 + 1] AS operation, document_id, weight_kg, city, array_to_string(list_filter([nullif(warnings, ''), CASE WHEN document_id IS NULL THEN 'purchase document missing' END], lambda x: x IS NOT NULL), '; ') AS warnings FROM looked LEFT JOIN sources USING (vehicle_id)""",
        "goods_values": f"WITH {_GOODS} SELECT currency, rate_source, exchange_rate, rate_date, CAST(sum(CAST(value_ron AS DECIMAL(18,2))) AS DOUBLE) AS value_ron, count(*) AS n_goods FROM valued GROUP BY ALL",
        "declaration_errors": f"""WITH {_GOODS}, g AS (SELECT v.*, CASE WHEN k % 23 <> 0 THEN 1 ELSE 0 END AS heavy FROM valued v WHERE declaration_id % 10 <> 3),
h AS (SELECT o_orderkey AS k, ['10', '30', '40', NULL][o_orderkey % 4 + 1] AS code, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 5 - CASE WHEN o_orderkey % 13 = 0 THEN 3 ELSE 0 END END AS ahead FROM orders),
e AS (
  SELECT k, unnest(list_filter([CASE WHEN code IS NULL THEN 'operation' END, CASE WHEN ahead IS NULL THEN 'transport date' END, CASE WHEN ahead < 0 OR ahead > 3 THEN 'transport date out of window' END, CASE WHEN k % 9 = 0 THEN 'transporter name' END,
    CASE WHEN k % 3 = 2 THEN 'transporter country' END, CASE WHEN k % 3 <> 1 AND coalesce(code, '') <> '30' AND k % 2 = 1 THEN 'transporter tax id' END, CASE WHEN k % 14 = 0 THEN 'vehicle plate' END, CASE WHEN k % 3 = 2 THEN 'unloading country' END,
    CASE WHEN k % 2 = 1 AND k % 3 <> 0 THEN 'loading county' END, CASE WHEN k % 2 = 1 AND k % 5 <> 0 THEN 'loading city' END, CASE WHEN k % 3 = 0 AND k % 4 <> 0 THEN 'unloading county' END, CASE WHEN k % 3 = 0 AND k % 7 <> 0 THEN 'unloading city' END,
    CASE WHEN code = '10' AND k % 6 <> 0 THEN 'border point' END], lambda x: x IS NOT NULL)) AS error FROM h
) SELECT k AS declaration_id, 0 AS position, error FROM e
UNION ALL SELECT o_orderkey, 0, 'goods' FROM orders WHERE o_orderkey NOT IN (SELECT declaration_id FROM g)
UNION ALL SELECT declaration_id, position, unnest(list_filter([CASE WHEN k % 17 = 0 THEN 'description' END, CASE WHEN k % 19 = 0 THEN 'tariff code' END, CASE WHEN heavy = 0 THEN 'gross weight' END, CASE WHEN NOT coalesce(value_ron > 0, false) THEN 'value in RON' END,
    CASE WHEN {foreign} AND value IS NULL THEN 'value in currency' END, CASE WHEN {foreign} AND (exchange_rate IS NULL OR rate_date IS NULL) THEN 'official rate' END], lambda x: x IS NOT NULL)) FROM g""",
        "declaration_status": f"""WITH last AS (SELECT user_id AS id, arg_max(event_id, [epoch_us(ts), event_id]) AS k FROM events GROUP BY user_id),
d AS (SELECT c_custkey AS id, c_custkey % 3 = 0 AS waiting, c_custkey % 3 <> 1 AS long, DATE '{AS_OF}' + CAST(c_custkey % 9 AS INTEGER) AS day, CASE WHEN c_custkey % 3 = 0 THEN 'OLD' || c_custkey END AS uit, CASE k % 7 WHEN 0 THEN 'C' WHEN 1 THEN 'R' WHEN 3 THEN 'C' WHEN 4 THEN 'R' WHEN 5 THEN 'C' ELSE 'P' END AS verdict, CASE WHEN k % 7 IN (0, 3) THEN 'UIT' || lpad(CAST(k AS VARCHAR), 9, '0') END AS code FROM customer LEFT JOIN last ON last.id = c_custkey)
SELECT id AS declaration_id, CASE verdict WHEN 'P' THEN CASE WHEN waiting THEN 'INFIRMING' ELSE 'SUBMITTED' END WHEN 'C' THEN CASE WHEN waiting THEN 'INFIRMED' ELSE 'CONFIRMED' END ELSE CASE WHEN waiting THEN 'CONFIRMED' ELSE 'REJECTED' END END AS status,
CASE WHEN waiting THEN uit ELSE code END AS uit, CASE WHEN NOT waiting AND verdict = 'C' THEN day + CASE WHEN long THEN 15 ELSE 5 END END AS valid_to_date FROM d""",
    }
