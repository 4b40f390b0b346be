"""Queries from extracted JSON to canonical documents and open items; the JSON is made of the plain tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import reference_key
from ..operators import canonical as ca
from ..sources import driver_tables as src
from ..sources.driver_tables import table

OWN = "900"


def raw_documents(spark, sf_dir):
    """Documents as three extractors give them: in an envelope `result` with printed amounts, in `data` with numbers and
    prices, and bare with references. Lines are dealt by document as they are, and made up for the one form in which their
    document has them."""
    d = src.documents(spark, sf_dir).select("document_id", "document_date", "direction", "currency")
    rows = src.lines(spark, sf_dir).select("document_id", "pos", "net", "vat").repartition("document_id")
    comma = lambda x: F.replace(F.abs(x).cast("string"), F.lit("."), F.lit(","))
    name = F.when(F.col("pos.l_linenumber") % 3 != 0, F.concat(F.lit(" part "), F.col("pos.l_partkey"), F.lit(" ")))
    quantity, price = F.col("pos.l_quantity"), (F.floor(F.col("pos.l_extendedprice") + F.lit(0.5)) / 100).cast("decimal(12,2)")
    printed = F.struct(name.alias("description"), F.when(F.col("net") < 0, F.concat(F.lit("("), comma(F.col("net")), F.lit(")"))).otherwise(comma(F.col("net"))).alias("line_total"), F.col("vat").cast("string").alias("tva"))
    priced = F.struct(name.alias("name"), F.when(quantity % 5 == 0, 0).otherwise(quantity).alias("quantity"), price.alias("pret"))
    kind = F.col("document_id") % 3
    own = rows.groupBy("document_id").agg(F.sort_array(F.collect_list(F.when(kind < 2, F.struct("pos", F.when(kind == 0, printed).alias("a"), F.when(kind == 1, priced).alias("b"))))).alias("rows"), F.sum(F.col("net") + F.col("vat")).cast("decimal(14,2)").alias("total"), F.sum("vat").cast("decimal(14,2)").alias("vat"))
    met = d.join(own, "document_id")
    k, day = F.col("document_id"), F.col("document_date")
    currency = F.when(F.col("currency") == "RON", "lei").when(F.col("currency") == "EUR", "€").otherwise("huf ")
    signed = lambda x: F.concat(F.when(x < 0, "-").otherwise(""), comma(x), F.lit(" lei"))
    first = F.struct(F.struct(F.concat(F.lit("INV-"), k).alias("document_number"), F.date_format(day, "dd/MM/yyyy").alias("invoice_date"), currency.alias("currency"), signed(F.col("total")).alias("total_amount"), signed(F.col("vat")).alias("vat_amount"), F.when(F.col("direction") == "incoming", "Intrare").otherwise("vanzare").alias("direction"), F.transform("rows", lambda r: r["a"]).alias("line_items")).alias("result"))
    second = F.struct(F.struct(F.concat(F.lit(" 00"), k, F.lit(" ")).alias("invoice_number"), day.cast("string").alias("date"), F.col("total"), F.col("vat").alias("tva"), F.when(F.col("direction") == "outgoing", "RO 900").otherwise("1").alias("vendor_ein"), F.when(F.col("direction") == "incoming", "R0900").otherwise("2").alias("buyer_ein"), F.transform("rows", lambda r: r["b"]).alias("line_items")).alias("data"))
    refs = F.to_json(F.struct(F.concat(F.lit("R"), k).alias("receipt_number"), F.date_format(day, "d.M.yyyy").alias("document_date"), F.col("total").alias("amount"), F.when(k % 2 == 0, F.concat(F.lit("INV-"), k - 1, F.lit(", 00"), k - 2, F.lit(",INV-"), k - 1)).alias("reference_number")))
    bare = F.to_json(F.struct(F.concat(F.lit("R"), k).alias("receipt_number"), F.date_format(day, "d.M.yyyy").alias("document_date"), F.col("total").alias("amount")))
    structured = F.concat(F.regexp_replace(bare, r"\}$", ""), F.lit(',"referenced_invoices":["INV-'), (k - 1).cast("string"), F.lit('",{"invoice_number":"00'), (k - 2).cast("string"), F.lit('","amount":"12,50"},{"number":" "}],"reference_number":"no"}'))
    return met.select("document_id", F.when(kind == 0, F.to_json(first)).when(kind == 1, F.to_json(second)).when(k % 2 == 0, refs).otherwise(structured).alias("fields_json"))


def canonical_documents(spark, sf_dir):
    return ca.canonical_documents(ca.parsed(raw_documents(spark, sf_dir)), F.lit(OWN))


def canonical_lines(spark, sf_dir):
    return ca.canonical_lines(ca.parsed(raw_documents(spark, sf_dir)))


def canonical_references(spark, sf_dir):
    return ca.canonical_references(ca.parsed(raw_documents(spark, sf_dir)))


def _invoices(spark, sf_dir):
    d = src.documents(spark, sf_dir).where("type = 'Invoice'").select(F.col("document_id").alias("o_orderkey"), "document_date")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return d.join(o, "o_orderkey").select(F.col("o_orderkey").alias("invoice_id"), "document_date", "cents", reference_key(F.concat(F.lit("INV-"), F.col("o_orderkey"))).alias("key"))


def _edges(spark, sf_dir):
    """Dispositions pay three invoices before them; every fourth states a third of its total for the first."""
    p = table(spark, sf_dir, "orders").where("o_orderkey % 10 >= 8").select(F.col("o_orderkey").alias("document_id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    refs = p.select("document_id", "cents", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("ord")).select("document_id", "ord", F.when((F.col("document_id") % 4 == 0) & (F.col("ord") == 0), F.expr("cents div 3")).alias("amount"), reference_key(F.concat(F.lit("inv 00-"), F.col("document_id") - 3 - F.col("ord"))).alias("key"))
    refs = refs.withColumn("key", F.regexp_replace("key", "^INV0+", "INV"))
    found = ca.resolved_references(refs, _invoices(spark, sf_dir)).withColumnRenamed("amount", "cents")
    return ca.payment_edges(p, found)


def payment_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


def invoice_open_items(spark, sf_dir):
    return ca.open_items(_invoices(spark, sf_dir), _edges(spark, sf_dir))


NAMES = (canonical_documents, canonical_lines, canonical_references, payment_edges, invoice_open_items)


def oracle_sql():
    from .queries import _FX

    edges = """WITH p AS (SELECT o_orderkey AS document_id, CAST(round(o_totalprice * 100) AS BIGINT) AS total FROM orders WHERE o_orderkey % 10 >= 8),
inv AS (SELECT o_orderkey AS invoice_id, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders WHERE o_orderkey % 10 < 6),
r AS (SELECT document_id, total, unnest([0, 1, 2]) AS ord FROM p),
m AS (SELECT document_id, total, ord, invoice_id, CASE WHEN document_id % 4 = 0 AND ord = 0 THEN total // 3 END AS stated FROM r JOIN inv ON invoice_id = document_id - 3 - ord),
n AS (SELECT *, total - coalesce(sum(stated) OVER w, 0) AS left_, count(*) FILTER (stated IS NULL) OVER w AS k, count(*) FILTER (stated IS NULL) OVER (PARTITION BY document_id ORDER BY ord) AS i FROM m WINDOW w AS (PARTITION BY document_id)),
a AS (SELECT *, CASE WHEN k = 1 THEN left_ ELSE CAST(floor(left_::DOUBLE / k + 0.5::DOUBLE) AS BIGINT) END AS one FROM n),
b AS (SELECT *, CASE WHEN k = 2 THEN left_ - one ELSE CAST(floor((left_ - one)::DOUBLE / 2 + 0.5::DOUBLE) AS BIGINT) END AS two FROM a),
edges AS (SELECT document_id, invoice_id, CASE WHEN stated IS NOT NULL THEN stated WHEN i = 1 THEN one WHEN i = 2 THEN two ELSE left_ - one - two END AS cents FROM b)"""
    r2 = "floor(({} + 2.220446049250313e-16::DOUBLE) * 100 + 0.5::DOUBLE) / 100"
    return {
        "canonical_documents": f"""{_FX}, t AS (SELECT document_id, CAST(greatest(sum(net + vat), 0) AS DOUBLE) AS total, CAST(greatest(sum(vat), 0) AS DOUBLE) AS v FROM fx_lines GROUP BY document_id),
c AS (SELECT *, CASE WHEN document_id % 3 = 2 THEN 0 ELSE least(total, v) END AS vat FROM t)
SELECT document_id, CASE document_id % 3 WHEN 0 THEN 'INV-' || document_id WHEN 1 THEN '00' || document_id ELSE 'R' || document_id END AS number, document_date, CASE WHEN document_id % 3 = 0 THEN currency ELSE 'RON' END AS currency,
       CASE WHEN document_id % 3 < 2 THEN direction END AS direction, total, vat, greatest(0, {r2.format('total - vat')}) AS net FROM c JOIN fx_documents USING (document_id)""",
        "canonical_lines": f"""{_FX}, l AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS line_no, l_linenumber, l_partkey, CAST(net AS DOUBLE) AS n, CAST(vat AS DOUBLE) AS v,
  CASE WHEN l_quantity % 5 = 0 THEN 1.0::DOUBLE ELSE CAST(l_quantity AS DOUBLE) END AS q, floor(l_extendedprice + 0.5::DOUBLE) / 100 AS price FROM fx_lines)
SELECT document_id, line_no, CASE WHEN l_linenumber % 3 <> 0 THEN 'part ' || l_partkey ELSE 'Articol ' || line_no END AS name, CASE document_id % 3 WHEN 0 THEN 1 ELSE q END AS quantity, CASE document_id % 3 WHEN 0 THEN n ELSE price END AS unit_price,
       CASE document_id % 3 WHEN 0 THEN n ELSE {r2.format('q * price')} END AS net, CASE document_id % 3 WHEN 0 THEN v ELSE 0 END AS vat FROM l WHERE document_id % 3 < 2""",
        "canonical_references": f"""{_FX}, d AS (SELECT DISTINCT document_id FROM fx_lines JOIN fx_documents USING (document_id) WHERE document_id % 3 = 2)
SELECT document_id, 0 AS ord, 'INV-' || (document_id - 1) AS number, 'INV' || (document_id - 1) AS key, NULL::DOUBLE AS amount FROM d
UNION ALL SELECT document_id, 1, '00' || (document_id - 2), regexp_replace(CAST(document_id - 2 AS VARCHAR), '^0+', ''), CASE WHEN document_id % 2 = 1 THEN 12.5::DOUBLE END FROM d""",
        "payment_edges": f"{edges} SELECT * FROM edges",
        "invoice_open_items": f"{edges} SELECT invoice_id, inv.cents, CAST(coalesce(sum(e.cents), 0) AS BIGINT) AS paid, CAST(inv.cents - coalesce(sum(e.cents), 0) AS BIGINT) AS outstanding, count(e.cents) AS n_payments FROM inv LEFT JOIN edges e USING (invoice_id) GROUP BY invoice_id, inv.cents",
    }
