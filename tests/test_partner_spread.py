"""Rows without a key aren't dealt to one task."""

from pyspark.sql import functions as F

from tallyforge.operators import partners


def test_rows_without_a_key_are_spread(spark):
    none = F.lit(None).cast("string")
    rows = spark.range(400).select(F.col("id").alias("row_no"), F.concat(F.lit("n"), F.col("id") % 3).alias("name"), none.alias("tax_id"), F.when(F.col("id") == 7, "k1").alias("code"), none.alias("country"), none.alias("kind"), none.alias("city"))
    have = spark.createDataFrame([(1, "Ana", None, "1", "RO", "COMPANY", None), (2, "Bob", None, "K1", "RO", "COMPANY", None)], "partner_id int, name string, tax_id string, supplier_code string, country string, kind string, city string")
    got = partners.match_partners(rows, have, "supplier")
    assert [(r.row_no, r.partner_id) for r in got.where("partner_id is not null").collect()] == [(7, 2)] and got.count() == 400
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") == 3
    for name in ("tax", "code"):
        keyed = partners._keyed(rows.withColumns({"tax_key": none, "code_key": F.col("code")}), name)
        assert keyed.select(f"{name}_at").distinct().count() == 400
