"""Paths, coerced values and corrected documents."""

import json

import pytest

from tallyforge.operators import corrections as co


@pytest.mark.parametrize(
    "field, value, want",
    [("total_amount", " 12,50 ", 12.5), ("line_items[0].quantity", "3", 3), ("unit_price", "1e3", 1000), ("rate", "", ""), ("rate", "1.2.3", "1.2.3"), ("name", "12", "12"), ("flag", " TRUE", True), ("x", "[1,2]", [1, 2]), ("x", '{"a":1}', {"a": 1}), ("x", "[bad]", "[bad]"), ("x", "[", "["), ("x", None, None), ("total", "Infinity", "Infinity"), ("total", "1e999", "1e999")],
)
def test_values(field, value, want):
    got = co.coerced(field, value)
    assert got == want and type(got) is type(want)


def test_paths():
    root = {"a": {"b": [1, {"c": 2}]}, "t": "text", "n": None}
    assert co.read_path(root, "a.b[1].c") == 2 and co.read_path(root, "a.b[7].c") is None and co.read_path(root, "t.x") is None and co.read_path(root, "") == root
    assert co.write_path(root, "a.b[1].c", 5) and co.write_path(root, "a.b[3].d.e", 6) and co.write_path(root, "n[0]", 7) and co.write_path(root, "q.2", 8)
    assert root == {"a": {"b": [1, {"c": 5}, None, {"d": {"e": 6}}]}, "t": "text", "n": [7], "q": [None, None, 8]}
    before = json.dumps(root)
    assert not co.write_path(root, "t.x.y", 1) and not co.write_path(root, "a.b.name", 1) and not co.write_path(root, "", 1) and not co.write_path(root, "z[0].y[99999]", 1)
    assert json.dumps(root) == before


def test_documents(spark):
    docs = [(1, '{"total_amount": 5, "line_items": [{"quantity": 1}], "vehicle_cost_categories_reviewed": true}', "PENDING", "x"), (2, '{"a": 1}', "APPROVED", "x"), (3, None, "PENDING", "x"), (4, "not json", "PENDING", "x"), (5, '{"é": "ü"}', None, "x"), (None, '{"a": 1}', None, "x")]
    made = [(1, 2, 20, "total_amount", "7"), (1, 1, 10, "total_amount", "6,5"), (1, 3, 20, "line_items[0].quantity", "2"), (1, 4, 30, "total_amount.x", "1"), (2, 5, 1, "a", "2"), (3, 6, 1, "a", "2"), (4, 7, 1, "a", "2"), (9, 8, 1, "a", "2"), (None, 9, 1, "a", "2"), (5, 10, 1, None, "2"), (5, 11, 2, "b", None)]
    got = {r["document_id"]: r for r in co.apply_corrections(spark.createDataFrame(docs, "document_id long, fields_json string, review_status string, log string").repartition(3), spark.createDataFrame(made, "document_id long, correction_id long, at int, field string, value string").repartition(3)).collect()}
    assert len(got) == 6 and json.loads(got[1]["fields_json"]) == {"total_amount": 7, "line_items": [{"quantity": 2}], "vehicle_cost_categories_reviewed": False}
    assert [tuple(x) for x in got[1]["log"]] == [("total_amount", "5", "6.5", True), ("total_amount", "6.5", "7", True), ("line_items[0].quantity", "1", "2", True), ("total_amount.x", None, "1", False)]
    assert got[2]["fields_json"] == '{"a": 1}' and not got[2]["log"][0]["applied"] and got[3]["fields_json"] is None and not got[3]["log"][0]["applied"]
    assert got[4]["fields_json"] == "not json" and json.loads(got[5]["fields_json"]) == {"é": "ü", "b": None} and got[None]["log"] == []
