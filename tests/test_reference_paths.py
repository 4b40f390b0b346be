"""Fields of documents are read as structs: Spark throws an exception for each path that a document doesn't have."""

from tallyforge.operators import canonical as ca

ODD = [
    (1, '{"result": {"referenced_invoices": [{"reference": "A"}, {"number": null, "invoice_number": {"x": 1}}, [1, "b"], true, {"number": "", "reference": "C"}, " D "]}, "reference_number": "no"}'),
    (2, '{"result": null, "data": {"referenced_invoices": {"number": "no"}, "referenced_numbers": [" E,F", null, 7, {"y": 2}], "invoice_reference": "F,G"}}'),
    (3, '{"referenced_invoices": [], "reference_number": "no"}'),
    (4, '{"referenced_invoices": null, "referenced_numbers": "no", "reference_number": 12}'),
    (5, '{"referenced_invoices": [{"number": "H", "amount": "-", "paid_amount": 3}, {"number": "H", "payment_amount": 4}, {"number": "I", "paid_amount": 2.5}]}'),
    (6, '"text"'), (7, "[]"), (8, "{}"), (9, '{"result": {}, "reference_number": "no"}'),
]


def references(spark):
    return ca.canonical_references(ca.parsed(spark.createDataFrame(ODD, "document_id long, fields_json string").repartition(2)))


def test_no_path_is_looked_up(spark):
    assert "$." not in references(spark)._jdf.queryExecution().optimizedPlan().toString()


def test_odd_references(spark):
    got = sorted((r.document_id, r.ord, r.number, r.amount) for r in references(spark).collect())
    one = [(1, 0, "A", None), (1, 1, '{"x":1}', None), (1, 2, '[1,"b"]', None), (1, 3, "true", None), (1, 4, "D", None)]
    two = [(2, 0, "E", None), (2, 1, "F", None), (2, 2, "7", None), (2, 3, '{"y":2}', None), (2, 5, "G", None)]
    assert got == one + two + [(4, 0, "12", None), (5, 0, "H", None), (5, 2, "I", 2.5)]
