"""Streams give the rows of their batch twins; cases with known numbers."""

import datetime

from pyspark.sql import functions as F

from tallyforge import streaming
from tallyforge.functions import checks, normalise
from tallyforge.operators import canonical, ledger, worklists
from tallyforge.streaming.ledger_store import LedgerStore

DAY = datetime.date(2024, 5, 3)
DOCS = "document_id long, type string, direction string, review_status string, document_date date, rate double"
LINES = "document_id long, net decimal(14,2), vat decimal(14,2), deductibility string, account string, pos int"


def posted(spark, doc, lines):
    from decimal import Decimal

    docs = spark.createDataFrame([doc], DOCS)
    rows = [(doc[0], Decimal(n), Decimal(v), d, a, i) for i, (n, v, d, a) in enumerate(lines)]
    got = ledger.journal(docs, spark.createDataFrame(rows, LINES)).collect()
    return [(r["account"], float(r["debit"]), float(r["credit"])) for r in sorted(got, key=lambda r: r["posting_key"])]


def test_plain_invoices_balance(spark):
    assert posted(spark, (1, "Invoice", "incoming", "APPROVED", DAY, 1.0), [("100", "19", "FULL", "628")]) == [("401", 0, 119), ("628", 100, 0), ("4426", 19, 0)]
    assert posted(spark, (1, "Invoice", "outgoing", "APPROVED", DAY, 1.0), [("100", "21", "FULL", "371")]) == [("411", 121, 0), ("707", 0, 100), ("4427", 0, 21)]


def test_half_of_a_receipts_tax_is_a_cost(spark):
    assert posted(spark, (1, "Receipt", "incoming", "APPROVED", DAY, 1.0), [("100", "19", "PARTIAL_50", "6022")]) == [("5311", 0, 119), ("6022", 109.5, 0), ("4426", 9.5, 0)]


def test_a_discount_goes_to_the_other_side_and_cents_to_the_last_line(spark):
    assert posted(spark, (1, "Invoice", "outgoing", "APPROVED", DAY, 1.0), [("1922", "0", "FULL", "371"), ("-250", "0", "FULL", "371")]) == [("411", 1672, 0), ("707", 0, 1922), ("707", 250, 0)]
    rows = posted(spark, (1, "Invoice", "incoming", "APPROVED", DAY, 5.235), [("10.01", "1.9", "FULL", "371"), ("20.02", "3.8", "FULL", "624"), ("0.33", "0.06", "FULL", "628")])
    assert round(sum(r[1] for r in rows), 2) == round(sum(r[2] for r in rows), 2) and rows[0] == ("401", 0, 189.09)


def test_documents_without_a_rate_are_not_posted(spark):
    docs = spark.createDataFrame([(1, "Invoice", "incoming", "APPROVED", DAY, None)], DOCS)
    lines = spark.createDataFrame([(1, 100, 19)], "document_id long, n int, v int").select("document_id", F.col("n").cast("decimal(14,2)").alias("net"), F.col("v").cast("decimal(14,2)").alias("vat"), F.lit("FULL").alias("deductibility"), F.lit("628").alias("account"), F.lit(1).alias("pos"))
    drafts = ledger.balanced_entries(ledger.draft_entries(docs, lines))
    assert [(r["status"], r["error"]) for r in ledger.posting_status(drafts).collect()] == [("ERROR", "no rate")]
    assert ledger.journal(docs, lines).count() == 0


def test_payments_are_split_in_order_and_sum_up(spark):
    payments = spark.createDataFrame([(1, 5000), (2, 100), (3, 1000)], "document_id long, cents long")
    refs = spark.createDataFrame([(1, 0, 11, 3000), (1, 1, 12, None), (2, 0, 11, None), (2, 1, 12, None), (2, 2, 13, None), (3, 0, 9, None)], "document_id long, ord int, invoice_id long, cents long")
    got = {(r["document_id"], r["invoice_id"]): r["cents"] for r in canonical.payment_edges(payments, refs).collect()}
    assert got == {(1, 11): 3000, (1, 12): 2000, (2, 11): 33, (2, 12): 34, (2, 13): 33, (3, 9): 1000}


def test_checks_of_known_identifiers(spark):
    row = spark.range(1).select(checks.tax_id_valid(F.lit("RO 11201891")).alias("a"), checks.tax_id_valid(F.lit("DE123")).alias("b"), checks.iban_valid(F.lit("RO49 AAAA 1B31 0075 9384 0000")).alias("c"), checks.iban_valid(F.lit("GB82WEST12345698765433")).alias("d"), checks.cnp_valid(F.lit("1960229410013")).isNotNull().alias("e"), checks.vin_valid(F.lit("WVWZZZ1JZXW00000I")).alias("f"), normalise.analytic_account(F.lit("401"), F.lit("401.00063")).alias("g"), normalise.money_locale(F.lit("1.148,07")).alias("h")).first()
    assert (row["a"], row["b"], row["c"], row["d"], row["e"], row["f"], row["g"], row["h"]) == (True, None, True, False, True, False, "401.00063", 1148.07)


def test_streamed_metrics_equal_the_batch(spark, tmp_path):
    rows = [(datetime.datetime(2024, 1, 1, h, m), h % 2, "a", m % 2 == 0, m) for h in range(6) for m in range(0, 60, 7)]
    events = spark.createDataFrame(rows, "ts timestamp, phase int, document_type string, success boolean, duration int")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = streaming.stream_table(spark, f"{tmp_path}/in", events.schema)
    streaming.write_metrics(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    want = {tuple(r) for r in worklists.window_metrics(events).collect()}
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    watermark = max(r[0] for r in rows) - datetime.timedelta(minutes=10)
    assert got == {w for w in want if w[0] + datetime.timedelta(minutes=5) <= watermark} and got != want


def test_streamed_documents_replace_their_entries(spark, tmp_path):
    docs = spark.createDataFrame([(1, "01", 10), (2, "01", 20), (3, "02", 30)], "document_id long, month string, amount int")
    docs.write.parquet(f"{tmp_path}/in")
    store = LedgerStore(spark, f"{tmp_path}/out", {"entries": "document_id long, amount int, month string"})
    entries = lambda b: {"entries": b}
    run = lambda k: streaming.rewrite_documents(streaming.stream_table(spark, f"{tmp_path}/in", docs.schema), entries, store, f"{tmp_path}/check{k}", f"reader {k}").awaitTermination()
    run(1), run(2)  # a second reader of the same rows changes nothing
    assert sorted(map(tuple, store.read("entries").collect())) == [(1, 10, "01"), (2, 20, "01"), (3, 30, "02")]


def test_first_arrivals(spark, tmp_path):
    rows = [(1, "t", "h1", datetime.datetime(2024, 1, 1, 1)), (2, "t", "h1", datetime.datetime(2024, 1, 1, 2)), (3, "u", "h1", datetime.datetime(2024, 1, 1, 2))]
    docs = spark.createDataFrame(rows, "id long, tenant string, hash string, ts timestamp")
    docs.coalesce(1).write.parquet(f"{tmp_path}/in")
    kept = streaming.first_arrivals(streaming.stream_table(spark, f"{tmp_path}/in", docs.schema), ["tenant", "hash"], "ts", "1 day")
    kept.writeStream.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).format("parquet").start(f"{tmp_path}/out").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").groupBy("tenant").count().orderBy("tenant").collect() == [("t", 1), ("u", 1)]
