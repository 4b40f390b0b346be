"""Lines of documents that aren't approved go before lines are gathered, and lines are dealt by document once."""

from pyspark.sql import functions as F

from tallyforge.operators import ledger


def test_lines_of_other_documents_are_not_gathered(spark):
    docs = spark.createDataFrame([(1, "Invoice", "incoming", "APPROVED", 1.0), (2, "Invoice", "incoming", "PENDING", 1.0), (3, "Receipt", "outgoing", "APPROVED", 1.0), (1, "Contract", "incoming", "APPROVED", 1.0), (None, "Invoice", "incoming", "APPROVED", 1.0)], "document_id long, type string, direction string, review_status string, rate double").withColumn("document_date", F.lit("2024-01-31").cast("date"))
    lines = spark.createDataFrame([(1, 2, "2.00"), (1, 1, "1.00"), (2, 1, "5.00"), (9, 1, "7.00"), (None, 1, "7.00")], "document_id long, pos int, n string").select("document_id", "pos", F.col("n").cast(ledger.MONEY).alias("net"), F.col("n").cast(ledger.MONEY).alias("vat"), F.lit("FULL").alias("deductibility"), F.lit("371").alias("account"))
    got = ledger._gathered(docs, lines)
    rows = sorted((r.document_id or 0, r.type, [(x.pos, int(x.net)) for x in r.ls or []], r.n) for r in got.collect())
    assert rows == [(0, "Invoice", [], 0), (1, "Contract", [(1, 1), (2, 2)], 2), (1, "Invoice", [(1, 1), (2, 2)], 2), (3, "Receipt", [], 0)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") == 1 and "strategy=shuffle_hash" in plan and "array_sort" not in plan and "ArraySort" not in plan
