"""The store of posted documents: moves, removals, repeated and broken batches, and readers."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge import streaming
from tallyforge.streaming.ledger_store import LedgerStore

SCHEMAS = {"entries": "document_id long, month string, account string, amount int", "edges": "document_id long, month string, invoice_id long"}


def put(spark, store, docs, batch=None):
    """docs: {document_id: (month, [accounts], [invoices])}"""
    ids = spark.createDataFrame([(d,) for d in docs], "document_id long")
    entries = spark.createDataFrame([(d, m, a, i) for d, (m, accounts, _) in docs.items() for i, a in enumerate(accounts)], SCHEMAS["entries"])
    edges = spark.createDataFrame([(d, m, i) for d, (m, _, invoices) in docs.items() for i in invoices], SCHEMAS["edges"])
    return store.replace(ids, {"entries": entries, "edges": edges}, batch)


def held(store):
    out = {}
    for r in store.read("entries").collect():
        out.setdefault(r["document_id"], (r["month"], [], []))[1].append(r["account"])
    for r in store.read("edges").collect():
        out.setdefault(r["document_id"], (r["month"], [], []))[2].append(r["invoice_id"])
    return {d: (m, sorted(a), sorted(i)) for d, (m, a, i) in out.items()}


@pytest.fixture
def store(spark, tmp_path):
    return LedgerStore(spark, f"file://{tmp_path}/store", SCHEMAS)


def test_a_document_that_moves_leaves_its_old_month(spark, store):
    assert held(store) == {} and store.remove(spark.createDataFrame([(1,)], "document_id long"))
    put(spark, store, {1: ("2024-01", ["401", "628"], [7]), 2: ("2024-03", ["411"], [])})
    put(spark, store, {1: ("2024-02", ["401"], [8])})
    assert held(store) == {1: ("2024-02", ["401"], [8]), 2: ("2024-03", ["411"], [])}
    assert set(store._manifest()["tables"]["entries"]) == {"2024-02", "2024-03"}  # the emptied month has no folder
    assert [r["account"] for r in store.read("entries", ["2024-03"]).collect()] == ["411"]


def test_documents_without_rows_and_reopened_ones_go_from_all_tables(spark, store):
    put(spark, store, {1: ("2024-01", ["401"], [7]), 2: ("2024-01", ["411"], [7]), 3: ("2024-05", ["5311"], [])})
    put(spark, store, {1: ("2024-01", [], [])})
    assert held(store) == {2: ("2024-01", ["411"], [7]), 3: ("2024-05", ["5311"], [])}
    store.remove(spark.createDataFrame([(2,), (3,), (99,), (None,)], "document_id long"))
    assert held(store) == {} and store._manifest()["tables"] == {"entries": {}, "edges": {}}
    put(spark, store, {2: ("2024-01", ["411"], [7])})
    assert held(store) == {2: ("2024-01", ["411"], [7])}


def test_a_batch_counts_once_and_a_broken_one_leaves_nothing(spark, store, monkeypatch):
    assert put(spark, store, {1: ("2024-01", ["401"], [])}, ("stream", 0))
    assert not put(spark, store, {1: ("2024-02", ["999"], [])}, ("stream", 0))
    assert put(spark, store, {2: ("2024-01", ["401"], [])}, ("other", 0))

    def broken(manifest):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(store, "_commit", broken)
        with pytest.raises(OSError):
            put(spark, store, {1: ("2024-02", ["402"], [3])}, ("stream", 1))
    assert held(store) == {1: ("2024-01", ["401"], []), 2: ("2024-01", ["401"], [])}
    assert put(spark, store, {1: ("2024-02", ["402"], [3])}, ("stream", 1))
    assert held(store) == {1: ("2024-02", ["402"], [3]), 2: ("2024-01", ["401"], [])}
    assert len(store._manifests()) == 2 and len(store.folders.names(store.path + "/versions")) <= 3  # what broke off is gone


def test_a_reader_keeps_its_manifest_while_the_next_is_written(spark, store):
    put(spark, store, {1: ("2024-01", ["401"], [])})
    reading = store.read("entries")
    put(spark, store, {1: ("2024-02", ["402"], [])})
    assert [r["account"] for r in reading.collect()] == ["401"]


def test_two_writers_do_not_both_win(spark, store):
    put(spark, store, {1: ("2024-01", ["401"], [])})
    with pytest.raises(FileExistsError):
        store.folders.write_new(f"{store.path}/manifest-1.json", "{}")


def test_random_batches_equal_a_plain_table(spark, store):
    rng, want = random.Random(1), {}
    for batch in range(6):
        docs = {d: (f"2024-{rng.randint(1, 4):02}", [rng.choice(["401", "628", "4426"]) for _ in range(rng.randint(0, 3))], [rng.randint(1, 9)] * rng.randint(0, 1)) for d in rng.sample(range(20), 7)}
        put(spark, store, docs, ("s", batch))
        want = {d: v for d, v in (want | docs).items() if v[1] or v[2]}
        assert held(store) == {d: (m, sorted(a), i) for d, (m, a, i) in want.items()}


def test_streamed_versions_of_documents(spark, tmp_path, store):
    schema = "document_id long, month string, account string, version int, status string"
    rows = lambda b: {"entries": b.where("status = 'APPROVED'").select("document_id", "month", "account", F.col("version").alias("amount"))}
    files = [[(1, "2024-01", "a", 1, "APPROVED"), (1, "2024-02", "b", 2, "APPROVED"), (2, "2024-01", "c", 1, "APPROVED")], [(1, "2024-03", "d", 3, "APPROVED"), (2, "2024-01", "c", 2, "REOPENED")]]
    for file in files:
        spark.createDataFrame(file, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = streaming.stream_table(spark, f"{tmp_path}/in", spark.createDataFrame(file, schema).schema, 1)
        streaming.rewrite_documents(stream, rows, store, f"{tmp_path}/check", order="version").awaitTermination()
    assert sorted(map(tuple, store.read("entries").collect())) == [(1, "2024-03", "d", 3)]


def test_posting_a_stream_of_documents(spark, tmp_path):
    import datetime
    from decimal import Decimal

    day, schema = datetime.date, "document_id long, type string, direction string, review_status string, document_date date, currency string, version int"
    lines = spark.createDataFrame([(d, Decimal(100), Decimal(19), "FULL", "628", 1) for d in (1, 2)], "document_id long, net decimal(14,2), vat decimal(14,2), deductibility string, account string, pos int")
    published = spark.createDataFrame([("EUR", day(2024, 1, 1), 5.0)], "currency string, rate_date date, rate double")
    store = LedgerStore(spark, f"file://{tmp_path}/ledger", {"entries": streaming.ENTRIES})
    rows = streaming.posted_rows(lines, published)
    one = lambda d, at, status, v, c="RON": (d, "Invoice", "incoming", status, at, c, v)
    sums = []
    for file in ([one(1, day(2024, 1, 31), "APPROVED", 1), one(2, day(2024, 1, 5), "APPROVED", 1, "EUR"), one(3, day(2024, 1, 5), "APPROVED", 1)], [one(1, day(2024, 2, 1), "APPROVED", 2)], [one(2, day(2024, 1, 5), "REOPENED", 2, "EUR")]):
        spark.createDataFrame(file, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = streaming.stream_table(spark, f"{tmp_path}/in", spark.createDataFrame(file, schema).schema, 1)
        streaming.rewrite_documents(stream, rows, store, f"{tmp_path}/check", order="version").awaitTermination()
        sums.append({(r["document_id"], r["month"]): float(r["d"]) for r in store.read("entries").groupBy("document_id", "month").agg(F.sum("debit").alias("d")).collect()})
    assert sums == [{(1, "2024-01"): 119, (2, "2024-01"): 595}, {(1, "2024-02"): 119, (2, "2024-01"): 595}, {(1, "2024-02"): 119}]
