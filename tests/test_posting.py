"""Entries of every kind of document, what keeps documents out, and a plain version over random documents."""

import datetime
import math
import random
from decimal import Decimal

import pytest

from tallyforge.operators import ledger, rates

DAY = datetime.date(2024, 5, 3)
BASE = {"document_id": ("long", 1), "type": ("string", "Invoice"), "direction": ("string", "incoming"), "review_status": ("string", "APPROVED"), "document_date": ("date", DAY), "rate": ("double", 1.0), "tenant": ("string", "other")}
LINES = "document_id long, net decimal(14,2), vat decimal(14,2), deductibility string, account string, vat_rate int, pos int, rate string"
money = lambda x: None if x is None else Decimal(str(x))


def frames(spark, docs, lines):
    kinds = {k: t for k, (t, _) in BASE.items()} | {k: t for k, (t, _) in ledger.OPTIONAL.items()}
    start = {k: v for k, (_, v) in BASE.items()} | {k: v for k, (_, v) in ledger.OPTIONAL.items()}
    rows = [tuple(money(v) if kinds[k].startswith("dec") else v for k, v in (start | d).items()) for d in docs]
    return spark.createDataFrame(rows, ", ".join(f"{k} {t}" for k, t in kinds.items())), spark.createDataFrame([(d, money(n), money(v), ded, a, r, i, "x") for d, i, n, v, ded, a, r in lines], LINES)


def posted(spark, doc, *lines, need_lines=True):
    d, rows = frames(spark, [doc], [(1, i, *x) for i, x in enumerate(lines)])
    got = ledger.journal(d, rows, need_lines).collect()
    return [(r["posting_key"].split(":")[2], r["account"], float(r["debit"] - r["credit"])) for r in sorted(got, key=lambda r: int(r["posting_key"].split(":")[-1]))]


def status(spark, doc, *lines):
    d, rows = frames(spark, [doc], [(1, i, *x) for i, x in enumerate(lines)])
    balanced = ledger.balanced_entries(ledger.draft_entries(d, rows))
    r = ledger.posting_status(balanced).first()
    return r["status"], {(m["kind"], m["message"]) for m in ledger.posting_messages(balanced).collect()}


FULL = ("100", "19", "FULL", "628", 19)


@pytest.mark.parametrize(
    "doc, lines, want",
    [
        ({"is_advance": True}, [FULL], [("INVOICE_IN", "401", -119), ("INVOICE_IN", "409", 100), ("INVOICE_IN", "4426", 19)]),
        ({"is_advance": True, "direction": "outgoing"}, [FULL], [("INVOICE_OUT", "411", 119), ("INVOICE_OUT", "419", -100), ("INVOICE_OUT", "4427", -19)]),
        ({"direction": "outgoing"}, [("100", "19", "FULL", "704", 19), ("50", "0", "FULL", None, 0)], [("INVOICE_OUT", "411", 169), ("INVOICE_OUT", "704", -100), ("INVOICE_OUT", "707", -50), ("INVOICE_OUT", "4427", -19)]),
        ({"direction": "outgoing", "vat_payer": False}, [FULL], [("INVOICE_OUT", "411", 119), ("INVOICE_OUT", "707", -119)]),
        ({"vat_payer": False}, [("100", "19", "FULL", None, 19)], [("INVOICE_IN", "401", -119), ("INVOICE_IN", "628", 119)]),
        ({"reverse_charge": True}, [("100", "0", "FULL", "371", 0), ("10", "0", "FULL", "371", 9)], [("INVOICE_IN", "401", -110), ("INVOICE_IN", "371", 100), ("INVOICE_IN", "371", 10), ("INVOICE_IN", "4426", 9.9), ("INVOICE_IN", "4427", -9.9)]),
        ({"reverse_charge": True}, [("100", "0", "FULL", "371", None)], [("INVOICE_IN", "401", -100), ("INVOICE_IN", "371", 100), ("INVOICE_IN", "4426", 21), ("INVOICE_IN", "4427", -21)]),
        ({"type": "Receipt", "payment_method": "bank"}, [FULL], [("RECEIPT_IN", "5121", -119), ("RECEIPT_IN", "628", 100), ("RECEIPT_IN", "4426", 19)]),
        ({"type": "Receipt", "payment_method": "bank", "currency": "EUR", "rate": 5.0, "direction": "outgoing"}, [FULL], [("RECEIPT_OUT", "5124", 595), ("RECEIPT_OUT", "707", -500), ("RECEIPT_OUT", "4427", -95)]),
        ({"type": "Receipt", "receipt_type": "payment_receipt", "total": 80}, [], [("RECEIPT_IN", "401", 80), ("RECEIPT_IN", "5311", -80)]),
        ({"type": "Receipt", "ref_direction": "outgoing", "total": 80}, [], [("RECEIPT_OUT", "5311", 80), ("RECEIPT_OUT", "411", -80)]),
        ({"type": "Receipt", "receipt_type": "payment_receipt", "direction": None, "total": 80}, [], [("RECEIPT_OUT", "5311", 80), ("RECEIPT_OUT", "411", -80)]),
        ({"type": "Contract", "total": 4000}, [], [("CONTRACT_PURCHASE", "371", 4000), ("CONTRACT_PURCHASE", "462", -4000)]),
        ({"type": "Contract"}, [("3900", "0", "FULL", None, 0), ("100", "0", "FULL", "624", 0)], [("CONTRACT_PURCHASE", "371", 3900), ("CONTRACT_PURCHASE", "624", 100), ("CONTRACT_PURCHASE", "462", -4000)]),
        ({"type": "Payment Disposition", "total": 50}, [], [("PAYMENT_DISPOSITION", "401", 50), ("PAYMENT_DISPOSITION", "5311", -50)]),
        ({"type": "Payment Disposition", "total": 50, "is_advance": True}, [], [("PAYMENT_DISPOSITION", "409", 50), ("PAYMENT_DISPOSITION", "5311", -50)]),
        ({"type": "Payment Disposition", "total": 50, "is_advance": True, "account_code": "542"}, [], [("PAYMENT_DISPOSITION", "542", 50), ("PAYMENT_DISPOSITION", "5311", -50)]),
        ({"type": "Payment Disposition", "total": 50, "account_code": "542", "ref_direction": "incoming"}, [], [("PAYMENT_DISPOSITION", "401", 50), ("PAYMENT_DISPOSITION", "5311", -50)]),
        ({"type": "Collection Disposition", "total": 50, "is_advance": True}, [], [("COLLECTION_DISPOSITION", "5311", 50), ("COLLECTION_DISPOSITION", "419", -50)]),
    ],
)
def test_entries(spark, doc, lines, want):
    assert posted(spark, doc, *lines) == [(a, b, pytest.approx(c)) for a, b, c in want]


def test_documents_without_lines(spark):
    assert status(spark, {"total": 119, "vat": 19}) == ("ERROR", {("error", "no lines")})
    assert status(spark, {"type": "Receipt", "total": 119}) == ("ERROR", {("error", "no lines")})
    assert posted(spark, {"total": 119, "vat": 19}, need_lines=False) == [("INVOICE_IN", "401", -119), ("INVOICE_IN", "628", 100), ("INVOICE_IN", "4426", 19)]
    assert posted(spark, {"type": "Receipt", "total": 119, "vat": 19, "account_code": "604"}, need_lines=False) == [("RECEIPT_IN", "5311", -119), ("RECEIPT_IN", "604", 100), ("RECEIPT_IN", "4426", 19)]
    assert status(spark, {}) == ("ERROR", {("error", "no total"), ("error", "no lines")})


@pytest.mark.parametrize(
    "doc, lines, errors",
    [
        ({"document_date": None}, [FULL], {"no date"}),
        ({"direction": None}, [FULL], {"no direction"}),
        ({"number": None}, [FULL], {"no number"}),
        ({"rate": None}, [FULL], {"no rate"}),
        ({"net": 101, "vat": 19, "total": 120}, [FULL], {"lines off"}),
        ({"type": "Contract", "direction": "outgoing", "total": 5, "net": 5}, [], {"not a purchase"}),
        ({"type": "Contract", "net": 100, "total": 100}, [FULL], {"lines off"}),
        ({"stated_total": 200, "n_references": 2, "n_stated": 1}, [FULL], {"references over total"}),
        ({"stated_total": 20, "n_references": 1, "n_stated": 1}, [FULL], {"references off total"}),
        ({}, [("100", "19", "FULL", "x1", 19)], {"bad account"}),
        ({"type": "Payment Disposition", "total": 5, "account_code": "12"}, [], {"bad account"}),
    ],
)
def test_errors(spark, doc, lines, errors):
    got, messages = status(spark, doc, *lines)
    assert got == "ERROR" and {m for k, m in messages if k == "error"} == errors


def test_other_types_and_warnings(spark):
    assert status(spark, {"type": "Bank Statement"}) == ("NONE", {("warning", "no entries for this type")})
    got = status(spark, {"type": "Receipt", "receipt_type": "payment_receipt", "total": 9, "n_references": 2, "stated_total": 3, "n_stated": 1})
    assert got == ("POSTED", {("warning", "payment without its invoice"), ("warning", "rest is shared")})
    assert status(spark, {}, ("1", "0", "FULL", None, 0)) == ("POSTED", {("warning", "lines without account")})


def test_every_approved_document_has_a_status_and_books_balance(spark):
    rng = random.Random(4)
    docs, lines = [], []
    for i in range(300):
        docs.append({"document_id": i, "type": rng.choice([*ledger.KINDS, "Other"]), "direction": rng.choice(["incoming", "outgoing"]), "review_status": rng.choice(["APPROVED"] * 4 + ["REOPENED"]), "rate": rng.choice([1.0, 4.97, 0.0126]), "is_advance": rng.random() < 0.2, "payment_method": rng.choice(["bank", "cash"]), "currency": rng.choice(["RON", "EUR"]), "reverse_charge": rng.random() < 0.2, "vat_payer": rng.random() < 0.8, "total": rng.randint(1, 500), "vat": 0})
        for j in range(rng.choice([0, 1, 2, 5])):
            net = round(rng.uniform(-20, 300), 2)
            lines.append((i, j, net, round(net * 0.19, 2), rng.choice(["FULL", "PARTIAL_50", "NONE"]), rng.choice(["371", "628", None]), 19))
    d, rows = frames(spark, docs, lines)
    balanced = ledger.balanced_entries(ledger.draft_entries(d.repartition(3), rows.repartition(5)))
    approved = {x["document_id"] for x in docs if x["review_status"] == "APPROVED"}
    kinds = {r["document_id"]: r["status"] for r in ledger.posting_status(balanced).collect()}
    assert set(kinds) == approved and len({*kinds.values()}) == 3
    sums = {}
    for r in ledger.journal(d, rows).collect():
        sums.setdefault(r["document_id"], []).append(r["debit"] - r["credit"])
    assert set(sums) == {i for i, s in kinds.items() if s == "POSTED"} and all(abs(sum(s)) <= Decimal("0.01") for s in sums.values())
    assert ledger.journal(d.limit(0), rows).count() == 0 and ledger.posting_status(ledger.balanced_entries(ledger.draft_entries(d, rows.limit(0)))).count() == len(approved)


def test_rates_hold_until_the_next_and_the_last_for_ever(spark, monkeypatch):
    day = lambda m, d=1: datetime.date(2024, m, d)
    docs = [(i, c, x) for i, (c, x) in enumerate([("EUR", day(1)), ("EUR", day(2, 10)), ("EUR", day(2, 11)), ("EUR", day(12, 31)), ("USD", day(5)), ("RON", day(5)), ("EUR", None), (None, day(5)), ("USD", datetime.date(2031, 1, 1))])]
    table = [("EUR", day(1, 15), 4.9), ("EUR", day(2, 11), 5.0), ("EUR", day(6), 5.1), ("USD", day(5), 4.5)]
    want = [None, 4.9, 5.0, 5.1, 4.5, 1.0, None, None, 4.5]
    for most in (200_000, 0):
        monkeypatch.setattr(rates, "BROADCAST_RATES", most)
        got = rates.rates_as_of(spark.createDataFrame(docs, "id int, currency string, document_date date"), spark.createDataFrame(table, "currency string, rate_date date, rate double")).collect()
        assert [r["rate"] for r in sorted(got)] == want and not any(isinstance(r["rate"], float) and math.isnan(r["rate"]) for r in got)
