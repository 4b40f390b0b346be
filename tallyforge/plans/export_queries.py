"""Queries of what is exported: movements and the order of invoices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import MONEY
from ..operators import exports
from ..sources import driver_tables as src


def _edges(spark, sf_dir):
    """Payments of an invoice: those with a reference pay their partner's first and last one."""
    docs = src.posting_documents(spark, sf_dir)
    invoices = docs.where("type = 'Invoice'").groupBy("partner_id").agg(F.min("document_id").alias("a"), F.max("document_id").alias("b"))
    payers = docs.where("ref_direction is not null").select("document_id", "partner_id")
    stated = F.when(F.col("document_id") % 2 == 0, (F.col("document_id") % 700 / 4).cast(MONEY))
    met = payers.join(invoices.hint("merge"), "partner_id")
    return met.select("document_id", F.explode(F.array_distinct(F.array("a", "b"))).alias("invoice_id"), stated.alias("amount"))


def movements(spark, sf_dir):
    """Movements of the journal; some entries carry the amount in their document's currency."""
    from .queries import _journal

    journal = _journal(spark, sf_dir).withColumn("key", F.split("posting_key", ":"))
    side = F.col("debit") + F.col("credit")
    entries = journal.select("document_id", F.get("key", F.lit(4)).cast("int").alias("idx"), "account", "debit", "credit", "document_date", F.get("key", F.lit(2)).alias("source"), F.when(F.col("document_id") % 3 == 0, (side + 1).cast(MONEY)).alias("original"))
    got = exports.movements(entries, _edges(spark, sf_dir), src.posting_documents(spark, sf_dir))
    return got.withColumn("amount", F.col("amount").cast("double"))


def export_order(spark, sf_dir):
    """Positions of all invoices: documents with goods are cars, with freight transport; every third has no vehicle."""
    kinds = src.lines(spark, sf_dir).groupBy("document_id").agg(F.bool_or(F.col("account") == "371").alias("car"), F.bool_or(F.col("account") == "624").alias("freight"), (F.min("vehicle_id") % 500).alias("vehicle"))
    k = F.col("document_id")
    docs = src.documents(spark, sf_dir).where("type = 'Invoice'").join(kinds.hint("merge"), "document_id")
    records = docs.select("document_id", k.alias("at"), F.when(k % 29 != 0, F.col("document_date")).alias("date"), F.when(F.col("car"), "car").when(F.col("freight"), "transport").otherwise("services").alias("kind"), F.when(k % 3 != 0, F.col("vehicle")).alias("vehicle_id"), F.when(k % 2 == 0, F.concat(F.lit("wv-"), F.col("vehicle"))).alias("vin"))
    return exports.export_order(records).select("document_id", "position")


NAMES = (movements, export_order)


def oracle_sql():
    from .queries import _FX, _JOURNAL

    return {
        "movements": f"""{_JOURNAL}, named AS (SELECT d.*, 'D-' || document_id AS number FROM stated d WHERE NOT unnamed UNION ALL SELECT d.*, NULL FROM stated d WHERE unnamed),
firsts AS (SELECT partner_id, min(document_id) AS a, max(document_id) AS b FROM fx_documents JOIN (SELECT document_id, type AS t FROM stated) USING (document_id) WHERE t = 'Invoice' GROUP BY ALL),
edges AS (SELECT DISTINCT s.document_id, unnest([a, b]) AS invoice_id, CASE WHEN s.document_id % 2 = 0 THEN CAST(s.document_id % 700 / 4.0 AS DECIMAL(14,2)) END AS amount FROM stated s JOIN fx_documents d USING (document_id) JOIN firsts USING (partner_id) WHERE s.ref_direction IS NOT NULL),
es AS (SELECT document_id, document_date, CAST(split_part(posting_key, ':', 5) AS INTEGER) AS idx, split_part(posting_key, ':', 3) AS source, account, debit, credit, debit + credit AS side FROM journal),
money AS (SELECT *, CASE WHEN debit > 0 THEN 'receipt' ELSE 'payment' END AS kind FROM es WHERE regexp_matches(account, '^(5311|5121|5124)') AND side > 0),
first_ AS (SELECT m.document_id, m.idx, arg_min(e.account, e.idx) AS account FROM money m JOIN es e ON e.document_id = m.document_id AND e.account LIKE CASE m.kind WHEN 'receipt' THEN '411%' ELSE '401%' END GROUP BY ALL),
other AS (SELECT m.document_id, m.idx, arg_max(e.account, struct_pack(s := e.side, i := -e.idx)) AS account FROM money m JOIN es e ON e.document_id = m.document_id AND e.idx <> m.idx AND NOT regexp_matches(e.account, '^(4426|4427|5311|5121|5124)') GROUP BY ALL)
SELECT m.document_id, m.idx, m.kind, m.document_date, n.number AS reference, CAST(coalesce(e.amount, CASE WHEN m.document_id % 3 = 0 THEN m.side + 1 END, m.side) AS DOUBLE) AS amount, m.account, coalesce(f.account, o.account, '') AS counter_account, m.source, n.currency,
  coalesce(e.invoice_id, m.document_id) AS linked_id, coalesce(i.number, n.number) AS linked_number
FROM money m LEFT JOIN first_ f ON f.document_id = m.document_id AND f.idx = m.idx LEFT JOIN other o ON o.document_id = m.document_id AND o.idx = m.idx JOIN named n ON n.document_id = m.document_id LEFT JOIN edges e ON e.document_id = m.document_id LEFT JOIN named i ON i.document_id = e.invoice_id""",
        "export_order": f"""{_FX}, k AS (SELECT document_id, bool_or(account = '371') AS car, bool_or(account = '624') AS freight, min(vehicle_id) % 500 AS vehicle FROM fx_lines GROUP BY ALL),
r AS (SELECT document_id, document_id AS seq, coalesce(CAST(CASE WHEN document_id % 29 <> 0 THEN document_date END AS VARCHAR), '9999-12-31') AS day, CASE WHEN car THEN 0 WHEN freight THEN 2 ELSE 1 END AS rank, CASE WHEN document_id % 3 <> 0 THEN 'v:' || vehicle WHEN car AND document_id % 2 = 0 THEN 'vin:WV' || vehicle END AS grp FROM fx_documents JOIN k USING (document_id) WHERE type = 'Invoice'),
g AS (SELECT grp, coalesce(min(day) FILTER (rank = 0), min(day)) AS gday, arg_min(seq, struct_pack(rank := rank, day := day, seq := seq)) AS gat FROM r WHERE grp IS NOT NULL GROUP BY grp)
SELECT document_id, row_number() OVER (ORDER BY grp IS NULL, coalesce(gday, day), coalesce(gat, seq), CASE WHEN grp IS NULL THEN 0 ELSE rank END, day, seq) AS position FROM r LEFT JOIN g USING (grp)""",
    }
