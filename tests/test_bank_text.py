"""Printed controls, days of both sides and their subsets."""

import datetime
import itertools
import random
from decimal import Decimal

import pytest

from tallyforge.operators import bank_text, statements

D = datetime.date


def test_the_subset_with_the_earliest_last_row_wins():
    rng = random.Random(2)
    for _ in range(300):
        cents = [rng.randint(0, 12) for _ in range(rng.randint(0, 8))]
        target, rows = rng.randint(0, 40), list(range(100, 100 + len(cents)))
        fits = [c for n in range(len(cents) + 1) for c in itertools.combinations([r for r, c in zip(rows, cents) if c], n) if sum(cents[r - 100] for r in c) == target]
        want = min(fits, key=lambda c: c[::-1], default=None)
        assert statements.credit_subset(rows, cents, target) == (None if want is None else list(want))
    assert statements.credit_subset([1, 2, 3], [300, 1000, 700], 1000) == [2]


def test_long_days_and_large_sums():
    cents = [100_000 + 7 * i for i in range(40)]
    assert statements.credit_subset(list(range(40)), cents, sum(cents[20:])) is not None


ROWS = "statement_id int, row_no long, day date, debit decimal(14,2), credit decimal(14,2), other string"


@pytest.mark.parametrize("flip", [False, True])
def test_days_are_repaired_by_their_kind(spark, flip):
    days = {1: ([10, 20], [], (30, 0)), 2: ([], [5, 6], (0, 11)), 3: ([7, 4], [9, 2], (11, 11)), 4: ([7, 4], [9], (11, 8)), 5: ([3], [3], (None, 3)), 6: ([1] * 30, [1] * 30, (30, 30)), 7: ([7], [9], (8, 8)), 8: ([], [], (4, 5))}
    rows, n = [], itertools.count()
    for day, (debits, credits, _) in days.items():
        sides = [(Decimal(d), Decimal(0)) for d in debits] + [(Decimal(0), Decimal(c)) for c in credits]
        rows += [(1, next(n), D(2024, 1, day), *((b, a) if flip and day != 6 else (a, b)), "x") for a, b in sides]
    rows.append((1, 900, None, Decimal(1), Decimal(0), "x"))
    controls = [(1, D(2024, 1, d), None if a is None else Decimal(a), None if b is None else Decimal(b)) for d, (_, _, (a, b)) in days.items()]
    got = statements.repair_day_directions(spark.createDataFrame(rows, ROWS).repartition(3), spark.createDataFrame(controls, "statement_id int, day date, debit decimal(14,2), credit decimal(14,2)")).collect()
    by_day = {}
    at = {r[1]: r[2] for r in rows}
    for r in got:
        by_day.setdefault(at[r["row_no"]] and at[r["row_no"]].day, []).append(r)
    sums = {d: (sum(r["debit"] for r in rs), sum(r["credit"] for r in rs), {r["flagged"] for r in rs}) for d, rs in by_day.items()}
    assert sums[1] == (30, 0, {False}) and sums[2] == (0, 11, {False}) and sums[3] == (11, 11, {False})
    assert sums[4] == ((9, 11) if flip else (11, 9)) + ({True},)  # not complete: as read
    assert sums[5][2] == {False} and sums[6] == (30, 30, {False}) and sums[7] == ((9, 7) if flip else (7, 9)) + ({True},)
    assert sums[None] == (1, 0, {False}) and len(got) == len(rows)
    assert sorted(r["credit"] for r in by_day[3] if r["credit"]) == [4, 7]  # rows 4, 5 are the earliest that give 11


def test_printed_controls_of_a_text(spark):
    text = """Extras de cont RULAJ
SOLD ANTERIOR    1,148.07
01/02/2024 plata 12.00
Rulaj zi 01-02-2024   100.00   1.250,50
sold final zi 2,298.57
RULAJ ZI 02.02.2024 7,5 8
RULAJ ZI 2024 1 2
SOLD FINAL ZI 2299,07
SOLD FINAL ZI
RULAJ ZI 01-02-2024 3 4
RULAJ TOTAL CONT 110.50 1,262.50
SOLD FINAL CONT -2.300,07"""
    rows = [(1, text), (2, "SOLD ANTERIOR 5.00\nno more"), (3, None), (4, ""), (5, "RULAJ ZI 31/02/2024 1 2\r\nSOLD FINAL ZI 4"), (6, "SOLD FINAL ZI 3\rRULAJ ZI 1/3/2024 1 2")]
    lines = bank_text.text_lines(spark.createDataFrame(rows, "statement_id int, text string")).repartition(3)
    days = {(r["statement_id"], r["day"]): tuple(None if v is None else float(v) for v in r[2:]) for r in bank_text.day_controls(lines).collect()}
    assert days == {(1, D(2024, 2, 1)): (3, 4, None), (1, D(2024, 2, 2)): (7.5, 8, 2299.07), (6, D(2024, 3, 1)): (1, 2, None)}
    whole = {r["statement_id"]: tuple(None if v is None else float(v) for v in r[1:]) for r in bank_text.statement_controls(lines).collect()}
    assert whole == {1: (1148.07, -2300.07, 110.5, 1262.5), 6: (None, None, None, None)}


def test_days_are_carried_over_segments(spark, monkeypatch):
    monkeypatch.setattr(bank_text, "SEGMENT", 3)
    rng = random.Random(1)
    rows, want, day = [], {}, None
    for i in range(200):
        kind = rng.random()
        if kind < 0.15:
            day = D(2024, 1, 1) + datetime.timedelta(rng.randint(0, 60))
            rows.append((1, i, f"RULAJ ZI {day:%d/%m/%Y} {i} 2"))
            want[day] = (i, 2, None)
        elif kind < 0.4:
            rows.append((1, i, f"SOLD FINAL ZI {i}"))
            if day:
                want[day] = (*want[day][:2], i)
        else:
            rows.append((1, i, "other"))
    got = {r["day"]: tuple(None if v is None else float(v) for v in r[2:]) for r in bank_text.day_controls(spark.createDataFrame(rows, "statement_id int, line_no int, text string").repartition(5)).collect()}
    assert got == want
