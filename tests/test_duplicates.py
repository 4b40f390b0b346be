"""Duplicate candidates against all pairs."""

import datetime
import itertools
import random

import pytest

from tallyforge.operators import duplicates

SCHEMA = "document_id long, type string, number string, cents long, document_date date, partner_id long, name string, currency string, band string"
DAY = datetime.date(2024, 1, 1)


def similar(a, b):
    if not a or not b:
        return False
    x, y = sorted((a, b), key=len)
    common = set(a.split()) & set(b.split())
    return a == b or len(x) > 5 and x in y or len(common) >= 2 and len(common) * 10 >= 6 * min(len(set(a.split())), len(set(b.split())))


def score(a, b):
    _, kind, number, cents, day, partner, name, currency = a[:8]
    _, _, number2, cents2, day2, partner2, name2, currency2 = b[:8]
    invoice, fields, s = kind == "Invoice", 0, 0
    if number is not None and number == number2:
        s, fields = s + (500 if invoice else 400), fields + 1
    if cents and cents2 and abs(cents - cents2) < 100:
        s, fields = s + (300 if cents == cents2 else 150), fields + (cents == cents2)
    if day and day2:
        s += 150 if day == day2 else 50 if not invoice and abs((day - day2).days) <= 7 else 0
        fields += day == day2
    if kind in ("Invoice", "Receipt"):
        own = partner is not None and partner == partner2
        s += 150 if own else 105 if similar(name, name2) else 0
        fields += own or similar(name, name2)
    if currency is not None and currency == currency2:
        s, fields = s + 50, fields + 1
    return min(1000, s + 100 * (invoice and fields >= 3))


def classes(rows):
    out = {}
    for r in rows:
        out.setdefault(r[1:8], []).append(r[0])
    return [(min(ids), *key) for key, ids in out.items()]


def made(seed, n, tight):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    return [(i, pick("Invoice", "Receipt", "Payment Disposition", "Contract", None), pick(None, "1", "2", f"N{rng.randint(0, tight)}"), pick(None, 0, rng.randint(1000, 1400), rng.randint(1000, 1000 + tight)), pick(None, DAY + datetime.timedelta(rng.randint(0, tight))), pick(None, rng.randint(0, tight)), pick(None, "", "ALFA", "ALFA BETA GAMA", "BETA ALFA SUD", "OMEGAN", "XOMEGANY", "GAMA BETA"), pick("RON", "EUR", None), "x") for i in range(n)]


@pytest.mark.parametrize("seed, tight", [(1, 3), (2, 12)])
def test_pairs_equal_all_pairs(spark, monkeypatch, seed, tight):
    monkeypatch.setattr(duplicates, "SMALL", 10_000)
    rows = made(seed, 260, tight)
    want = {tuple(sorted((a[0], b[0]))): score(a, b) for a, b in itertools.combinations(classes(rows), 2) if a[1] is not None and a[1] == b[1] and score(a, b) >= 600}
    got = {(r["a"], r["b"]): round(r["score"] * 1000) for r in duplicates.duplicate_documents(spark.createDataFrame([*rows, (None, *rows[0][1:])], SCHEMA)).collect()}
    assert got == want and len(want) > 20


def test_many_of_one_key_are_a_star_and_pairs_of_what_stands_out(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "SMALL", 5)
    day = lambda i: DAY + datetime.timedelta(40 * i)
    fees = [(i, "Invoice", f"F{i}", 9900, day(i), 7, "ALFA", "RON", "x") for i in range(60)]
    odd = [(100, "Invoice", "F30", 9900, DAY, 7, "ALFA", "RON", "x"), (101, "Invoice", "Z", 9900, day(30), 7, "ALFA", "RON", "x")]
    got = {(r["a"], r["b"]): r["score"] for r in duplicates.duplicate_documents(spark.createDataFrame(fees + odd, SCHEMA)).collect()}
    assert {(0, i) for i in range(1, 60)} <= set(got) and got[30, 100] == 1.0 and got[30, 101] == 0.75
    assert len(got) <= 59 + 2 + 5  # no all against all


def test_a_cent_and_no_documents(spark):
    near = [(1, "Invoice", "A", 1000, DAY, 7, None, "RON", "x"), (2, "Invoice", "B", 1050, DAY, 7, None, "RON", "x"), (3, "Invoice", "C", 1199, DAY, 7, None, "RON", "x")]
    got = [tuple(r) for r in duplicates.duplicate_documents(spark.createDataFrame(near, SCHEMA)).collect()]
    assert got == [(1, 2, 0.6, "low", 1, 1)]
    assert duplicates.duplicate_documents(spark.createDataFrame([], SCHEMA)).count() == 0
