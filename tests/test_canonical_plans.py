"""Canonical documents, lines and references: odd values are read, and no schema of the whole JSON is made to tell objects."""

from pyspark.sql import functions as F

from tallyforge.operators import canonical as ca

ODD = [
    (1, '{"result": {"line_items": [{"name": "a", "quantity": 0, "line_total": "(1,50)"}, null, "text", {"total": {"x": 1}, "pret": "1.234,5,6", "valoare": 2.50}], "total": "1,2,3", "tva": "-"}}'),
    (2, '{"result": 5, "data": {"total": 1e3, "vat_amount": null, "tva": "2", "referenced_invoices": ["A", {"number": " B ", "amount": "1,5"}, null, 7]}}'),
    (3, '{"data": [1], "line_items": {"a": 1}, "reference_number": "X, Y,X,,"}'),
    (4, "no json"), (5, None), (6, "[1, 2]"), (7, '{"line_items": []}'),
]


def parsed(spark):
    return ca.parsed(spark.createDataFrame(ODD, "document_id long, fields_json string").repartition(2))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower().replace("_", "")


def test_lines(spark):
    got = ca.canonical_lines(parsed(spark))
    rows = {(r.document_id, r.line_no): (r.name, r.quantity, r.unit_price, r.net, r.vat) for r in got.collect()}
    assert rows == {(1, 1): ("a", 1.0, -1.5, -1.5, 0.0), (1, 2): ("Articol 2", 1.0, 0.0, 0.0, 0.0), (1, 3): ("Articol 3", 1.0, 0.0, 0.0, 0.0), (1, 4): ("Articol 4", 1.0, 1.0, 1.0, 0.0)}
    assert "schemaofvariant" not in plan(got) and "lambda" not in plan(got)


def test_documents(spark):
    got = ca.canonical_documents(parsed(spark), F.lit("900"))
    assert {r.document_id: (r.total, r.vat, r.net) for r in got.collect() if r.document_id < 4} == {1: (1.23, 0.0, 1.23), 2: (1000.0, 2.0, 998.0), 3: (0.0, 0.0, 0.0)}
    assert "schemaofvariant" not in plan(got) and "lambda" not in plan(got)


def test_references(spark):
    got = ca.canonical_references(parsed(spark))
    assert {(r.document_id, r.ord, r.number, r.amount) for r in got.collect()} == {(2, 0, "A", None), (2, 1, "B", 1.5), (2, 2, "7", None), (3, 0, "X", None), (3, 1, "Y", None)}
    assert "schemaofvariant" not in plan(got)
