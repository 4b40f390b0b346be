"""Movements, their records, the order of invoices, and positions."""

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import exports, order

DAY = datetime.date(2026, 7, 16)
ENTRIES = "document_id long, idx int, account string, debit decimal(14,2), credit decimal(14,2), document_date date, source string, original decimal(14,2), number string"
D = Decimal


def moved(spark, entries, edges, docs):
    rows = [(d, i, a, D(b), D(c), DAY, s, None if o is None else D(o), "x") for d, i, a, b, c, s, o in entries]
    return exports.movements(spark.createDataFrame(rows, ENTRIES), spark.createDataFrame([(a, b, None if c is None else D(c)) for a, b, c in edges], "document_id long, invoice_id long, amount decimal(14,2)"), spark.createDataFrame(docs, "document_id long, number string, currency string"))


def test_counterparts_amounts_and_links(spark):
    entries = [
        (1, 0, "5311", "100", "0", "RECEIPT_OUT", None), (1, 1, "411", "0", "100", "RECEIPT_OUT", None),
        (2, 0, "5121", "0", "119", "RECEIPT_IN", "30"), (2, 1, "628", "40", "0", "RECEIPT_IN", None), (2, 2, "6022", "60", "0", "RECEIPT_IN", None), (2, 3, "371", "60", "0", "RECEIPT_IN", None), (2, 4, "4426", "99", "0", "RECEIPT_IN", None),
        (3, 0, "401", "10", "0", "INVOICE_IN", None), (3, 1, "628", "0", "10", "INVOICE_IN", None),
        (4, 0, "5124", "0", "5", "PAYMENT_DISPOSITION", None), (5, 0, "5311", "0", "0", "RECEIPT_IN", None),
    ]
    edges = [(1, 11, None), (1, 12, "25.5"), (1, 99, None)]
    got = sorted(map(tuple, moved(spark, entries, edges, [(1, "R1", "RON"), (2, "R2", "EUR"), (11, "F11", "RON"), (12, None, "RON")]).select("document_id", "kind", "amount", "account", "counter_account", "linked_id", "linked_number", "reference").collect()))
    assert got == [
        (1, "receipt", D("25.5"), "5311", "411", 12, "R1", "R1"), (1, "receipt", D("100"), "5311", "411", 11, "F11", "R1"),
        (2, "payment", D("30"), "5121", "6022", 2, "R2", "R2"), (4, "payment", D("5"), "5124", "", 4, None, None),
    ]
    assert moved(spark, entries, [], [(1, "a", "RON")]).where("document_id = 1").count() == 1


def test_written_records(spark, tmp_path):
    entries = [(7, 0, "5311", "125.50", "0", "COLLECTION_DISPOSITION", None), (7, 1, "411.00001", "0", "125.50", "COLLECTION_DISPOSITION", None), (8, 0, "5311", "0", "20", "RECEIPT_IN", None), (8, 1, "401", "20", "0", "RECEIPT_IN", None)]
    got = moved(spark, entries, [], [(7, "DI&1", "RON"), (8, None, None)])
    assert [tuple(r) for r in exports.movement_records(got, "receipt").collect()] == [("16-07-2026", "DI&1", "125.5", "5311", "411.00001", "Încasare conform documentului", "", "", "", "RON")]
    assert [tuple(r)[2:8] for r in exports.movement_records(got, "payment").collect()] == [("20", "5311", "401", "Plată conform documentului", "8", "")]
    exports.write_movements(got, f"{tmp_path}/out", "receipt")
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert "<Incasari>" in text and "<Numar>DI&amp;1</Numar>" in text and "<Suma>125.5</Suma>" in text and "<ContClient>411.00001</ContClient>" in text


def in_order(records):
    day = lambda r: str(r[2] or "9999-12-31")
    rank = lambda r: exports.RANKS[r[3]]
    groups, alone = {}, []
    for r in records:
        vin = "".join(c for c in (r[5] or "").upper() if c.isalnum())
        key = f"v{r[4]}" if r[4] is not None else f"vin{vin}" if r[3] == "car" and vin else None
        (alone if key is None else groups.setdefault(key, [])).append(r)
    done = []
    for rows in groups.values():
        rows.sort(key=lambda r: (rank(r), day(r), r[1]))
        cars = [r for r in rows if r[3] == "car"]
        done.append((day(cars[0]) if cars else min(map(day, rows)), rows[0][1], rows))
    return [r[0] for *_, rows in sorted(done, key=lambda g: g[:2]) for r in rows] + [r[0] for r in sorted(alone, key=lambda r: (day(r), r[1]))]


@pytest.mark.parametrize("seed", [1, 2])
def test_order_of_invoices(spark, seed):
    rng = random.Random(seed)
    records = [(1000 + i, i, rng.choice([None, DAY + datetime.timedelta(rng.randint(-20, 20))]), rng.choice(list(exports.RANKS)), rng.choice([None, *range(8)]), rng.choice([None, "", "w-1", "W 1", "zz"]), "x") for i in range(150)]
    got = exports.export_order(spark.createDataFrame(records, "document_id long, at long, date date, kind string, vehicle_id long, vin string, extra string").repartition(7)).orderBy("position").collect()
    assert [r["document_id"] for r in got] == in_order(records) and [r["position"] for r in got] == list(range(1, 151))


def test_positions_by_group(spark, monkeypatch):
    rows = [(g, i) for g, n in ((None, 5), (1, 400), (2, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, i int").repartition(5)
    for most in (100_000, 0):
        monkeypatch.setattr(order, "BROADCAST_PARTS", most)
        got = order.positions(df, ["g"], ["i"], "n")
        assert got.count() == len(rows) and got.where(F.col("n") != F.col("i") + 1).count() == 0
    assert order.positions(df.limit(0), ["g"], ["i"], "n").count() == 0
