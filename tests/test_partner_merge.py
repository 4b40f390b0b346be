"""An import's rows are matched once, however many kinds of partners are made of them."""

from tallyforge.operators import partners

ROW = "row_no int, name string, tax_id string, code string, country string, kind string, city string"
HAVE = "partner_id int, name string, tax_id string, supplier_code string, country string, kind string, city string"


def merged(spark):
    rows = spark.createDataFrame([(1, "Ana SRL", "RO 10", None, "RO", None, "Iasi"), (2, None, "RO 10", None, "RO", None, "Cluj"), (3, "Dan", None, "77", "RO", None, None), (4, "Dan Nou", "", "077", None, None, "Arad"), (5, "Eva", "RO 12", None, "RO", None, None), (6, "Eva", "RO 12", None, "RO", "pf", "no")], ROW)
    have = spark.createDataFrame([(1, "Ana", "RO 10", "1", "RO", "COMPANY", None), (2, "Bob", None, None, "RO", "COMPANY", "Sibiu"), (3, "Eva", "12", None, "DE", "COMPANY", "Bonn")], HAVE)
    return partners.merge_partners(have.where("partner_id < 3"), partners.match_partners(rows, have, "supplier"), "supplier")


def test_rows_are_matched_once(spark):
    plan = merged(spark)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 4


def test_kept_updated_created_and_of_others(spark):
    got = sorted(map(tuple, merged(spark).collect()), key=str)
    assert got == [(1, None, "Ana SRL", "10", "1", "RO", "COMPANY", "Iasi", "updated"), (2, None, "Bob", None, None, "RO", "COMPANY", "Sibiu", "kept"), (None, 3, "Dan Nou", None, "077", "RO", "COMPANY", "Arad", "created")]
