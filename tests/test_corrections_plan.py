"""Documents meet their corrections once, and those that stay as they are don't pass through Python."""

from tallyforge.operators import corrections as co


def test_one_join_for_all_documents(spark):
    docs = spark.createDataFrame([(1, '{"a": 1}', None), (2, '{"a": 1}', "APPROVED"), (3, "{", None), (4, None, None)], "document_id long, fields_json string, review_status string")
    made = spark.createDataFrame([(i, n, -n, "a", v) for i in (1, 2, 4) for n, v in ((1, "x"), (2, "[1, 2]"), (3, None))], "document_id long, correction_id long, at int, field string, value string")
    got = co.apply_corrections(docs, made)
    rows = {r.document_id: (r.fields_json, [tuple(x) for x in r.log]) for r in got.collect()}
    lost = [("a", None, None, False), ("a", None, "[1, 2]", False), ("a", None, "x", False)]
    assert rows == {1: ('{"a":"x"}', [("a", "1", None, True), ("a", None, "[1,2]", True), ("a", "[1,2]", "x", True)]), 2: ('{"a": 1}', lost), 3: ("{", []), 4: (None, lost)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Union" not in plan
