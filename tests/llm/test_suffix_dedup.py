import hashlib
import random

import numpy as np
import pytest

from tallyforge.llm.suffix_dedup import N, repeated_spans, suffix_order

DOCS = "doc_id long, text string"


def brute(rows):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - N + 1):
            first[b[p : p + N]] = min(d, first.get(b[p : p + N], d))
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - N + 1):
            if first[b[p : p + N]] < d:
                gone[p : p + N] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[d] = (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def corpus(seed=3, n=80):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 4)))
    passage = " ".join(word() for _ in range(40))
    rows = [(1, None), (2, ""), (3, "a" * 400), (4, "a" * 120), (5, "x" * 49), (6, "x" * 50), (7, "x" * 50)]
    for d in range(8, n):
        text = " ".join(word() for _ in range(rng.randint(5, 120)))
        if d % 3 == 0:
            text = text[: rng.randint(0, 60)] + passage + text[60:]
        if d % 5 == 0:
            old = rng.choice(rows)[1] or ""
            text = old[rng.randint(0, 30) :] + text
        rows.append((d, text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("many", [2, 256])
def test_equals_brute_force(spark, many):
    rows = corpus()
    got = {r[0]: tuple(r)[1:5] for r in repeated_spans(spark.createDataFrame(rows, DOCS).repartition(3), many).collect()}
    assert got == brute(rows)


def test_odd_tables(spark):
    assert repeated_spans(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, "q" * 80, "m"), (1, "q" * 80, "m"), (1, "q" * 80, "m")]
    got = repeated_spans(spark.createDataFrame(rows, DOCS + ", marks string")).collect()
    assert len(got) == 3 and all(r["n_removed"] == 0 for r in got)


def test_two_texts_of_one_document_are_kept_apart(spark):
    """Rows of one doc_id lose what earlier documents have, each its own bytes, and don't remove one another."""
    a, b, c = (k * 3 for k in ("abcdefghijklmnopqrstuvwxyz", "0123456789-ABCDEFGHIJKLMN", "zyxwvutsrqponmlkji.,;:!?%"))
    rows = [(1, a + b), (2, "once upon a time " + a + "!"), (2, "another text " + b + " of the same document " + c), (2, c), (3, c)]
    got = {(r["doc_id"], r["n_bytes"]): (r["n_removed"], [tuple(s) for s in r["spans"]]) for r in repeated_spans(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {
        (1, len(a + b)): (0, []),
        (2, 17 + len(a) + 1): (len(a), [(17, 17 + len(a))]),
        (2, 13 + len(b) + 22 + len(c)): (len(b), [(13, 13 + len(b))]),
        (2, len(c)): (0, []),
        (3, len(c)): (len(c), [(0, len(c))]),
    }


def test_long_text_and_columns_with_names_of_our_own(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    rows = [(1, long, "x", 1), (2, long[1000:2000], "y", 2), (3, long, "z", 3)]
    got = {r["doc_id"]: r["n_removed"] for r in repeated_spans(spark.createDataFrame(rows, DOCS + ", version string, marks int")).collect()}
    assert got == {1: 0, 2: 1000, 3: 300_000}


def test_suffix_order_is_the_order_of_bytes():
    rng = np.random.default_rng(1)
    buf = rng.integers(97, 99, 3000).astype(np.uint8)
    buf[1000:2000] = buf[:1000]
    at = rng.permutation(len(buf) - N)
    place, equal = suffix_order(buf, at)
    strings = [buf[p : p + N].tobytes() for p in at[place]]
    assert strings == sorted(strings)
    assert equal.tolist() == [False, *(a == b for a, b in zip(strings, strings[1:]))]
