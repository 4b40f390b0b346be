"""Vector codes against brute force, on odd vectors and labels."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import common, vector_codes
from tallyforge.llm.vector_codes import Codebook

SCHEMA = "vec_id long, embedding array<float>, label int, part int, n long"


@pytest.mark.parametrize("k, d, high", [(16, 8, 40), (1, 3, 9), (100, 2, 12), (5, 1, 3), (16, 8, 1 << 40)])
def test_nearest_equals_brute_force_with_ties(k, d, high):
    rng = np.random.default_rng(k + d)
    kind = object if high > 1 << 30 else np.int64
    entries, x = rng.integers(-high, high, (k, d)).astype(kind), rng.integers(-2 * high, 2 * high, (500, d)).astype(kind)
    x[:k] = entries[: len(x)]
    index, far = Codebook(entries).nearest(x)
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(row, e)) for e in entries] for row in x]
    assert [int(v) for v in far] == [min(w) for w in want]
    assert index.tolist() == [w.index(min(w)) for w in want]


def test_masks_are_the_entries_in_the_box():
    rng = np.random.default_rng(1)
    entries, x, radius = rng.integers(0, 20, (70, 3)), rng.integers(0, 20, (200, 3)), rng.integers(0, 8, 200)
    mask = Codebook(entries).candidates(x, radius)
    got = [{64 * w + b for w in range(2) for b in range(64) if int(m[w]) >> b & 1} for m in mask]
    assert got == [{e for e in range(70) if (abs(entries[e] - row) <= r).all()} for row, r in zip(x, radius)]


def brute(rows, rounds=6):
    kept = [(i, [math.floor(4096 * float(np.float32(v))) for v in x], label) for i, x, label in rows if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    cut = lambda x, p: x[p * len(x) // 8 : (p + 1) * len(x) // 8]
    books = [[cut(x, p) for _, x, _ in sorted((r for r in kept if r[0] is not None), key=lambda r: r[:2])[:16]] for p in range(8)]
    gap = lambda a, b: sum((u - v) ** 2 for u, v in zip(a, b))
    find = lambda x, p: min((gap(cut(x, p), e), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        got = [[find(x, p)[1] for p in range(8)] for _, x, _ in kept]
        for p in range(8):
            for e in range(len(books[p])):
                own = [cut(x, p) for (_, x, _), g in zip(kept, got) if g[p] == e]
                books[p][e] = [sum(c) // len(own) for c in zip(*own)] if own else books[p][e]
    found = [[find(x, p) for p in range(8)] for _, x, _ in kept]
    errors, out = [sum(d for d, _ in f) for f in found], []
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    for (i, _, label), f, error in zip(kept, found, errors):
        out.append((i, "".join(f"{e:02x}" for _, e in f), error, sum(x for x, k in zip(errors, kept) if k[2] == label), sha))
    return out


def sorted_rows(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("n, length, high", [(300, 64, 0.3), (9, 16, 3.0), (40, 8, 1e6)])
def test_compress_equals_brute_force(spark, n, length, high):
    rng = np.random.default_rng(n)
    rows = [(i, [float(np.float32(v)) for v in rng.uniform(-high, high, length)], None if i % 5 == 0 else i % 3) for i in range(n)]
    nan, inf = float("nan"), float("inf")
    odd = [(n, None, 1), (n + 1, [None] * length, 1), (n + 2, [nan] * length, 2), (n + 3, [inf] + [0.0] * (length - 1), 2), (n + 4, rows[3][1], None), (None, rows[4][1], 1), (None, rows[5][1], None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows + odd], SCHEMA).repartition(3)
    got = vector_codes.compress(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted_rows(got.collect()) == sorted_rows(brute(rows + odd))


def test_vectors_of_other_lengths_and_empty_tables(spark):
    rows = [(1, [0.5] * 10, 1, 1, 1), (2, [0.25] * 10, 1, 1, 1), (3, [0.1] * 7, 1, 1, 1), (4, [], 2, 1, 1)]
    got = {r["vec_id"]: r for r in vector_codes.compress(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[1]["code"], got[1]["error"], got[2]["code"]) == ("0000000000" + "000000", 0, "0101010101" + "000000")
    assert got[3]["code"] is got[3]["error"] is None and got[4]["code"] is None
    empty = spark.createDataFrame([(4, [], 2, 1, 1)], SCHEMA)
    assert [r["code"] for r in vector_codes.compress(empty).collect()] == ["00" * 8]
    assert vector_codes.compress(empty.limit(0)).count() == 0
    huge = [(i, [float(v)] * 8, 1, 1, 1) for i, v in enumerate((3e38, -3e38, 1.0))]
    assert [r["error"] for r in vector_codes.compress(spark.createDataFrame(huge, SCHEMA)).collect()] == [0, 0, 0]


def test_groups_of_hot_and_other_keys_meet_their_rows(spark):
    keys = [None] * 700 + [1] * 900 + list(range(10, 3000))
    rows = common.stored(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i long"), "rows")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("i").alias("s"))
    want = {}
    for i, k in enumerate(keys):
        want[k] = want.get(k, 0) + i
    got = common.met_by_key(rows, common.stored(groups, "groups"), ["k"]).collect()
    assert sorted((r["i"], r["s"]) for r in got) == [(i, want[k]) for i, k in enumerate(keys)]
