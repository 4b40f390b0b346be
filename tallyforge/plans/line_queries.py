"""Queries of checks and repairs over lines as extractors misread them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import line_checks as lc
from ..sources.driver_tables import table


def _lines(spark, sf_dir):
    """Lines of invoices; every third document is gross, some labels are wrong, some amounts missing, fuel is swapped."""
    n = table(spark, sf_dir, "lineitem")
    rate = F.element_at(F.array(*map(F.lit, (21.0, 19.0, 9.0, 5.0))), (F.col("l_partkey") % 4 + 1).cast("int"))
    label = F.element_at(F.array(*map(F.lit, ("TWENTYONE", "NINETEEN", "NINE", "FIVE"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    net = F.floor(F.col("l_extendedprice") * 100 + F.lit(0.5)) / 100
    vat = F.floor(net * rate + F.lit(0.5)) / 100
    n = n.withColumns({"k": k, "net": net, "vat0": vat, "label": label}).withColumn("total", F.when(F.col("l_orderkey") % 3 == 0, F.col("net") + F.col("vat0")).otherwise(F.col("net")))
    fuel = F.col("l_partkey") % 10 == 0
    return n.select(
        F.col("l_orderkey").alias("document_id"),
        F.col("l_linenumber").cast("int").alias("line_no"),
        F.when(fuel, "Motorină standard").otherwise("Piese").alias("name"),
        F.when(F.col("l_partkey") % 30 == 0, "combustibili").alias("kind"),
        F.when(fuel & (F.col("l_partkey") % 20 == 0), "l").otherwise("buc").alias("um"),
        F.when(F.col("k") % 5 == 0, "ELEVEN").when(F.col("k") % 53 == 0, "ZERO").otherwise(F.col("label")).alias("vat"),
        F.when(F.col("k") % 11 != 0, F.col("vat0")).alias("vat_amount"),
        F.col("l_quantity").cast("double").alias("quantity"),
        (F.col("total") / F.col("l_quantity") * F.when(F.col("k") % 41 == 0, 1.5).otherwise(1.0)).alias("unit_price"),
        "total",
        F.col("vat0"),
        F.lit("628").alias("account"),
        F.lit("FULL").alias("deductibility"),
    )


def _documents(spark, sf_dir):
    """Totals of the lines as printed; some are off, some parties equal."""
    n = _lines(spark, sf_dir)
    gross = F.col("document_id") % 3 == 0
    sums = n.groupBy("document_id").agg(F.sum(F.col("total").cast("decimal(18,2)")).alias("t"), F.sum(F.col("vat0").cast("decimal(18,2)")).alias("v"))
    total = F.when(gross, F.col("t")).otherwise(F.col("t") + F.col("v")).cast("double") * F.when(F.col("document_id") % 23 == 0, 1.25).otherwise(1.0)
    party = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").cast("string").alias("vendor_key"), F.when(F.col("o_orderkey") % 29 == 0, F.col("o_custkey").cast("string")).when(F.col("o_orderkey") % 31 != 0, F.lit("own")).alias("buyer_key"))
    return party.join(sums, "document_id").select("document_id", total.alias("total_amount"), F.col("v").cast("double").alias("doc_vat"), "vendor_key", "buyer_key")


SHOWN = ("document_id", "line_no", "vat", "vat_amount", "quantity", "unit_price", "total")


def repaired_rates(spark, sf_dir):
    return lc.repair_vat_rate(_lines(spark, sf_dir)).select(*SHOWN)


def net_lines(spark, sf_dir):
    return lc.lines_to_net(_documents(spark, sf_dir), lc.repair_vat_rate(_lines(spark, sf_dir))).select(*SHOWN)


def repaired_fuel(spark, sf_dir):
    return lc.repair_fuel_swap(_lines(spark, sf_dir)).select(*SHOWN)


def receipt_accounts(spark, sf_dir):
    return lc.receipt_accounts(_lines(spark, sf_dir)).groupBy("account", "deductibility").agg(F.count("*").alias("n_lines"))


def _checks(spark, sf_dir):
    n = _lines(spark, sf_dir)
    return lc.line_checks(n).unionByName(lc.document_checks(_documents(spark, sf_dir), n))


def failed_checks(spark, sf_dir):
    return _checks(spark, sf_dir).where("not passed").drop("passed")


def field_scores(spark, sf_dir):
    return lc.field_scores(_checks(spark, sf_dir))


def document_scores(spark, sf_dir):
    return lc.document_scores(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id")), _checks(spark, sf_dir))


def line_confidence(spark, sf_dir):
    n = _lines(spark, sf_dir)
    return lc.line_confidence(lc.line_checks(n), n)


NAMES = (repaired_rates, net_lines, repaired_fuel, receipt_accounts, failed_checks, field_scores, document_scores, line_confidence)

_RATE = "CASE {} " + " ".join(f"WHEN '{k}' THEN {float(v)}::DOUBLE" for k, v in lc.VAT_RATES.items()) + " END"


def _tol(x):
    return f"greatest(0.02::DOUBLE, abs({x}) * 0.01::DOUBLE)"


def _near(a, b):
    return f"(abs(({a}) - ({b})) <= greatest({_tol(a)}, {_tol(b)}))"


def _match(t, v, r):
    return f"({_near(f'{t} * {r} / 100', v)} OR {_near(f'{t} * {r} / ({r} + 100)', v)})"


_BASE = """
WITH a AS (
  SELECT *, l_orderkey * 7 + l_linenumber AS k, floor(l_extendedprice * 100 + 0.5::DOUBLE) / 100 AS net,
         CASE l_partkey % 4 WHEN 0 THEN 21.0::DOUBLE WHEN 1 THEN 19.0::DOUBLE WHEN 2 THEN 9.0::DOUBLE ELSE 5.0::DOUBLE END AS r,
         CASE l_partkey % 4 WHEN 0 THEN 'TWENTYONE' WHEN 1 THEN 'NINETEEN' WHEN 2 THEN 'NINE' ELSE 'FIVE' END AS label FROM lineitem
), b AS (SELECT *, floor(net * r + 0.5::DOUBLE) / 100 AS vat0 FROM a),
c AS (SELECT *, CASE WHEN l_orderkey % 3 = 0 THEN net + vat0 ELSE net END AS total FROM b),
n AS (
  SELECT l_orderkey AS document_id, CAST(l_linenumber AS INTEGER) AS line_no, l_partkey % 10 = 0 AS fuel, l_partkey % 20 = 0 AS litre,
         CASE WHEN k % 5 = 0 THEN 'ELEVEN' WHEN k % 53 = 0 THEN 'ZERO' ELSE label END AS vat, CASE WHEN k % 11 <> 0 THEN vat0 END AS vat_amount,
         CAST(l_quantity AS DOUBLE) AS quantity, total / l_quantity * CASE WHEN k % 41 = 0 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS unit_price, total, vat0 FROM c
), sums AS (
  SELECT document_id, CAST(sum(CAST(total AS DECIMAL(18,2))) AS DOUBLE) AS line_sum, CAST(sum(CAST(vat_amount AS DECIMAL(18,2))) AS DOUBLE) AS line_vat,
         sum(CAST(total AS DECIMAL(18,2))) AS t, sum(CAST(vat0 AS DECIMAL(18,2))) AS v FROM n GROUP BY document_id
), d AS (
  SELECT o_orderkey AS document_id, CAST(CASE WHEN o_orderkey % 3 = 0 THEN t ELSE t + v END AS DOUBLE) * CASE WHEN o_orderkey % 23 = 0 THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END AS total_amount, CAST(v AS DOUBLE) AS doc_vat,
         line_sum, line_vat, CAST(o_custkey AS VARCHAR) AS vendor_key, CASE WHEN o_orderkey % 29 = 0 THEN CAST(o_custkey AS VARCHAR) WHEN o_orderkey % 31 <> 0 THEN 'own' END AS buyer_key
  FROM orders JOIN sums ON o_orderkey = document_id
)"""
_HITS = " || ".join(f"CASE WHEN {_match('abs(total)', 'abs(vat_amount)', f'{float(v)}::DOUBLE')} THEN ['{k}'] ELSE [] END" for k, v in lc.VAT_RATES.items() if v)
_FIXED = f""", e AS (SELECT *, {_RATE.format('vat')} AS rate, {_HITS} AS hits FROM n WHERE true),
fixed AS (SELECT * EXCLUDE (vat, rate, hits), CASE WHEN abs(total) > 0 AND abs(vat_amount) > 0 AND NOT coalesce({_match('abs(total)', 'abs(vat_amount)', 'rate')}, false) AND len(hits) = 1 THEN hits[1] ELSE vat END AS vat FROM e)"""
_CHECKED = f""", j AS (SELECT *, {_RATE.format('vat')} AS rate FROM n),
checks AS (
  SELECT document_id, line_no, 'vat_amount' AS field, 'vat = total * rate' AS rule, CASE WHEN rate = 0 THEN {_near('0::DOUBLE', 'vat_amount')} ELSE {_match('total', 'vat_amount', 'rate')} END AS passed FROM j WHERE vat_amount IS NOT NULL
  UNION ALL SELECT document_id, line_no, 'total', 'quantity * unit_price = total', {_near('quantity * unit_price', 'total')} FROM j WHERE quantity <> 0 AND unit_price <> 0
  UNION ALL SELECT document_id, line_no, 'unit_price', 'fuel price plausible', unit_price <= 25 FROM j WHERE fuel AND litre AND unit_price > 0
  UNION ALL SELECT document_id, NULL, 'total_amount', 'total = lines or lines + vat', {_near('total_amount', 'line_sum')} OR {_near('total_amount', 'line_sum + coalesce(line_vat, 0)')} FROM d
  UNION ALL SELECT document_id, NULL, 'vat_amount', 'vat = vat of lines', {_near('doc_vat', 'line_vat')} FROM d WHERE line_vat <> 0
  UNION ALL SELECT document_id, NULL, 'buyer_tax_id', 'parties differ', vendor_key <> buyer_key FROM d WHERE buyer_key <> ''
)"""
_OUT = "document_id, line_no, vat, vat_amount, quantity, unit_price, total"


def oracle_sql():
    off = lambda r: f"abs(abs(vat_amount) - abs({r}))"
    net, gross, t = off("total * rate / 100"), off("total * rate / (rate + 100)"), _tol("vat_amount")
    room = _tol("total_amount")
    return {
        "repaired_rates": f"{_BASE}{_FIXED} SELECT {_OUT} FROM fixed",
        "net_lines": f"""{_BASE}{_FIXED}, m AS (SELECT document_id FROM d WHERE total_amount > 0 AND doc_vat > {room} AND abs(line_sum - total_amount) <= {room} AND abs(line_sum - (total_amount - doc_vat)) > {room}),
g AS (SELECT *, {_RATE.format('vat')} AS rate FROM fixed),
h AS (SELECT *, coalesce(rate > 0 AND total <> 0 AND CASE WHEN abs(vat_amount) > 0 THEN {gross} <= {t} AND {gross} <= {net} AND {net} > {t} ELSE document_id IN (SELECT document_id FROM m) END, false) AS is_gross, floor(total / (rate / 100 + 1) * 100 + 0.5::DOUBLE) / 100 AS base FROM g)
SELECT document_id, line_no, vat, CASE WHEN is_gross THEN floor((total - base) * 100 + 0.5::DOUBLE) / 100 ELSE vat_amount END AS vat_amount, quantity, CASE WHEN is_gross THEN floor(unit_price / (rate / 100 + 1) * 100 + 0.5::DOUBLE) / 100 ELSE unit_price END AS unit_price, CASE WHEN is_gross THEN base ELSE total END AS total FROM h""",
        "repaired_fuel": f"""{_BASE}, e AS (SELECT *, floor((total + abs(coalesce(vat_amount, 0))) / quantity * 100 + 0.5::DOUBLE) / 100 AS litres FROM n), f AS (SELECT *, floor(total / litres * 10000 + 0.5::DOUBLE) / 10000 AS price FROM e),
g AS (SELECT *, fuel AND litre AND total > 0 AND unit_price > 25 AND quantity > 0 AND quantity <= 25 AND litres > 0 AND price > 0 AND price <= 25 AS ok FROM f)
SELECT document_id, line_no, vat, vat_amount, CASE WHEN ok THEN litres ELSE quantity END AS quantity, CASE WHEN ok THEN price ELSE unit_price END AS unit_price, total FROM g""",
        "receipt_accounts": f"{_BASE} SELECT CASE WHEN fuel THEN '6022' ELSE '628' END AS account, CASE WHEN fuel THEN 'PARTIAL_50' ELSE 'FULL' END AS deductibility, count(*) AS n_lines FROM n GROUP BY ALL",
        "failed_checks": f"{_BASE}{_CHECKED} SELECT document_id, line_no, field, rule FROM checks WHERE NOT passed",
        "field_scores": f"{_BASE}{_CHECKED} SELECT document_id, line_no, field, CASE WHEN bool_and(passed) THEN 0.97::DOUBLE ELSE 0.2::DOUBLE END AS score, count(*) AS n_checks FROM checks GROUP BY ALL",
        "document_scores": f"""{_BASE}{_CHECKED}, s AS (SELECT document_id, count(*) AS n_checks, count(*) FILTER (passed) AS n_passed FROM checks GROUP BY ALL)
SELECT o_orderkey AS document_id, coalesce(n_checks, 0) AS n_checks, coalesce(n_passed, 0) AS n_passed, coalesce(floor(n_passed * 1000 / n_checks + 0.5::DOUBLE) / 1000, 0.2::DOUBLE) AS score FROM orders LEFT JOIN s ON o_orderkey = document_id""",
        "line_confidence": f"""{_BASE}{_CHECKED}, w AS (SELECT document_id, line_no, bool_and(passed) AS ok FROM checks WHERE line_no IS NOT NULL GROUP BY ALL)
SELECT document_id, line_no, CASE WHEN ok THEN 0.97::DOUBLE WHEN NOT ok THEN 0.2::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM n LEFT JOIN w USING (document_id, line_no)""",
    }
