"""Checks of texts over the given documents with lines of invoices put between theirs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corrections
from ..operators import text_checks as tc
from ..sources.driver_tables import table

#: Lines that stand before and after a document's text, by the number of the document.
BEFORE = ("Stock ID VAT Key Price EUR", "MwSt. Kennz.", "", "VAT  key", "Description", "Mwst Kennzeichnung")
AFTER = ("KL94218 I 159,00", "FS10577 M", "Reverse charge applies", " | e | ", "Total netto", "AB123 x", "Summe netto 3,00\nKL9421 I 5,00")


def reverse_charge(spark, sf_dir):
    """Whole texts of the documents between lines of a table of VAT keys."""
    k = F.col("doc_id")
    pick = lambda of: F.element_at(F.array(*map(F.lit, of)), (k % len(of) + 1).cast("int"))
    text = F.concat(pick(BEFORE), F.lit("\n"), pick(AFTER), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\nFS10577 M\n"), pick(AFTER))
    docs = table(spark, sf_dir, "documents").select(k.alias("document_id"), text.alias("text"), (k % 3 == 0).alias("model"))
    return tc.reverse_charge(docs)


#: A correction for each line number: its field and its value.
CORRECTIONS = (("total_amount", " 12,50 "), ("line_items[0].quantity", "3"), ("buyer.name", "X "), ("line_items[2].name", "new"), ("paid", "TRUE"), ("extra", "[1,2]"), ("document_number.part", "lost"))


def apply_corrections(spark, sf_dir):
    """Orders as JSON, corrected once for each line number that they have."""
    k = F.col("o_orderkey")
    line = lambda n: F.struct(F.lit(n).alias("quantity"))
    fields = F.to_json(F.struct(F.concat(F.lit("D-"), k).alias("document_number"), (k % 1000).alias("total_amount"), F.array(line(1), line(2)).alias("line_items"), F.lit(True).alias(corrections.REVIEWED)))
    docs = table(spark, sf_dir, "orders").select(k.alias("document_id"), fields.alias("fields_json"), F.when(F.col("o_orderstatus") == "F", "APPROVED").otherwise("PENDING").alias("review_status"))
    numbers = table(spark, sf_dir, "lineitem").where(f"l_linenumber <= {len(CORRECTIONS)}").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").cast("int").alias("n"))
    n = F.col("n")
    pick = lambda i: F.element_at(F.array(*(F.lit(c[i]) for c in CORRECTIONS)), n)
    made = numbers.repartition("document_id").distinct().select("document_id", n.alias("correction_id"), (-n).alias("at"), pick(0).alias("field"), pick(1).alias("value"))
    got = corrections.apply_corrections(docs, made)
    paths = {"total": "total_amount", "quantity": "line_items[0].quantity", "buyer": "buyer.name", "third": "line_items[2].name", "paid": "paid", "extra": "extra", "number": "document_number", "reviewed": corrections.REVIEWED}
    read = got.select("document_id", F.try_parse_json("fields_json").alias("v"), "log")
    return read.select("document_id", *(F.try_variant_get("v", f"$.{p}", "string").alias(c) for c, p in paths.items()), F.size(F.filter("log", lambda x: x["applied"])).alias("n_applied"), F.size("log").alias("n_corrections"))


NAMES = (reverse_charge, apply_corrections)


def oracle_sql():
    listed = lambda of: "[" + ", ".join("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in of) + "]"
    pick = lambda of: f"{listed(of)}[doc_id % {len(of)} + 1]"
    marks = " OR ".join(f"contains(t, '{m}')" for m in tc.MARKERS)
    has = lambda n, new, old: f"CASE WHEN open AND list_contains(ns, {n}) THEN {new} ELSE {old} END"
    return {
        "apply_corrections": f"""WITH c AS (SELECT l_orderkey AS document_id, list(DISTINCT CAST(l_linenumber AS INTEGER)) AS ns FROM lineitem WHERE l_linenumber <= {len(CORRECTIONS)} GROUP BY ALL),
d AS (SELECT o_orderkey AS document_id, o_orderkey AS k, o_orderstatus <> 'F' AS open, coalesce(ns, []) AS ns FROM orders LEFT JOIN c ON c.document_id = o_orderkey)
SELECT document_id, {has(1, "'12.5'", 'CAST(k % 1000 AS VARCHAR)')} AS total, {has(2, "'3'", "'1'")} AS quantity, {has(3, "'X '", 'NULL')} AS buyer, {has(4, "'new'", 'NULL')} AS third, {has(5, "'true'", 'NULL')} AS paid, {has(6, "'[1,2]'", 'NULL')} AS extra,
  'D-' || k AS number, CASE WHEN open AND (list_contains(ns, 2) OR list_contains(ns, 4)) THEN 'false' ELSE 'true' END AS reviewed, CAST(CASE WHEN open THEN len(list_filter(ns, lambda x: x < 7)) ELSE 0 END AS INTEGER) AS n_applied, CAST(len(ns) AS INTEGER) AS n_corrections FROM d""",
        "reverse_charge": rf"""WITH d AS (SELECT doc_id, {pick(BEFORE)} || chr(10) || {pick(AFTER)} || chr(10) || coalesce(text, '') || chr(10) || 'FS10577 M' || chr(10) || {pick(AFTER)} AS text, doc_id % 3 = 0 AS model FROM documents),
l AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\r|\n') AS ls FROM d)),
h AS (SELECT doc_id, min(i) AS head FROM l WHERE regexp_matches(x, '{tc.HEADING}') GROUP BY doc_id),
k AS (SELECT doc_id, i, x, upper(CASE WHEN regexp_matches(x, '{tc.ALONE}') THEN regexp_extract(x, '{tc.ALONE}', 1) WHEN regexp_matches(x, '{tc.BEFORE_PRICE}') THEN regexp_extract(x, '{tc.BEFORE_PRICE}', 2) WHEN regexp_matches(x, '{tc.LIKE_A_ROW}') THEN regexp_extract(x, '{tc.TOKEN}', 2) ELSE '' END) AS key
  FROM l JOIN h USING (doc_id) WHERE i > head AND i <= head + {tc.TABLE_LINES}),
f AS (SELECT doc_id, min(i) AS first FROM k WHERE key <> '' GROUP BY doc_id),
e AS (SELECT doc_id, min(i) AS last FROM k JOIN f USING (doc_id) WHERE i > first AND regexp_matches(x, '{tc.TABLE_END}') GROUP BY doc_id),
s AS (SELECT doc_id, string_agg(key, '') AS keys FROM k LEFT JOIN e USING (doc_id) WHERE i < coalesce(last, i + 1) GROUP BY doc_id),
j AS (SELECT d.doc_id, d.model, h.head IS NOT NULL AS known, coalesce(keys, '') AS keys, strip_accents(lower(text)) AS t FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id))
SELECT doc_id AS document_id, CASE WHEN regexp_matches(keys, '[IE]') THEN true WHEN contains(keys, 'M') THEN false WHEN NOT known AND ({marks}) THEN true ELSE model END AS reverse_charge,
  CASE WHEN regexp_matches(keys, '[IEM]') THEN 'key' WHEN NOT known AND ({marks}) THEN 'marker' ELSE 'model' END AS said_by FROM j"""
    }
