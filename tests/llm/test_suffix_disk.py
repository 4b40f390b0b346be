"""What op1 sends and keeps on disk: next to nothing for keys that are shared by chance, a few pieces for a run of a hot key."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tallyforge.llm import suffix_dedup
from tallyforge.llm.suffix_dedup import N, repeated_spans, runs

from test_suffix_dedup import DOCS, brute

LETTERS = "abcdefghijklmnopqrstuvwxyz ,."


def said(rng, n):
    return "".join(rng.choice(LETTERS) for _ in range(n))


def sent(monkeypatch, spark, rows):
    """Rows of marks, and rows of edges with bytes, on the way to the result."""
    seen, stored, spans = {}, suffix_dedup.stored, suffix_dedup._spans

    def keep(df, name):
        out = stored(df, name)
        seen[name] = out.count()
        return out

    def count(edges):
        seen["bytes"] = edges.where("part is not null").count()
        return spans(edges)

    monkeypatch.setattr(suffix_dedup, "stored", keep)
    monkeypatch.setattr(suffix_dedup, "_spans", count)
    got = {r[0]: tuple(r)[1:5] for r in repeated_spans(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute(rows)
    return seen


def test_keys_shared_by_chance_ask_for_next_to_nothing(monkeypatch, spark):
    """Texts that have phrases of 16 to 24 bytes in common, but no string of N bytes. Tags of 16 bits leave a few."""
    rng = random.Random(1)
    phrases = [said(rng, rng.randint(16, 24)) for _ in range(5)]
    rows = [(d, "".join(said(rng, 40) + rng.choice(phrases) for _ in range(20))) for d in range(60)]
    assert sent(monkeypatch, spark, rows)["marks"] < 20


def test_a_run_of_a_hot_key_goes_in_a_few_pieces(monkeypatch, spark):
    """A passage with another text on both sides in each document: its two edges have as many runs as documents."""
    rng = random.Random(2)
    passage = said(rng, 80)
    rows = [(d, said(rng, 60) + passage + said(rng, 60)) for d in range(400)]
    seen = sent(monkeypatch, spark, rows)
    assert seen["bytes"] < 8 * seen["marks"]


def test_runs_of_many_buckets_stay_small(monkeypatch, spark):
    """Bytes of a run, compressed as shuffles are, where a block's documents meet in few of a bucket's runs."""
    rng = random.Random(3)
    rows = [(d, said(rng, 2000)) for d in range(300)]
    seen, marked = [], suffix_dedup._marked

    def keep(hashed, *args):
        seen.extend(hashed.collect())
        return marked(hashed, *args)

    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 1000)
    monkeypatch.setattr(suffix_dedup, "_marked", keep)
    assert repeated_spans(spark.createDataFrame(rows, DOCS).coalesce(1)).count() == 300
    data = b"".join(bytes(r["ids"] + r["runs"]) for r in seen)
    assert len(pa.compress(data, "lz4_raw")) < 26 * len(runs([t.encode() for _, t in rows])[0])


@pytest.mark.parametrize(("many", "hot"), [(256, 65_536), (2, 65_536), (2, 4)])
def test_edges_at_any_offset_equal_brute_force(spark, many, hot):
    """Passages of N - 3 to N + 70 bytes cut from anywhere, texts that repeat themselves, and short periods."""
    rng = random.Random(many + hot)
    source = said(rng, 400)
    periods = [(said(rng, k) * 120)[:300] for k in (1, 2, 7, 16, 17, 23, 34, 40)]
    rows = []
    for d in range(150):
        text = said(rng, rng.randint(0, 40))
        for _ in range(rng.randint(0, 4)):
            old = rng.choice([source, source, source, rng.choice(periods), text, rng.choice(rows)[1] if rows else ""])
            n, a = rng.randint(N - 3, N + 70), rng.randint(0, max(0, len(old) - N))
            text += old[a : a + n] + said(rng, rng.choice([0, 1, 2, 30]))
        rows.append((d, text))
    rng.shuffle(rows)
    got = {r[0]: tuple(r)[1:5] for r in repeated_spans(spark.createDataFrame(rows, DOCS).repartition(3), many, hot).collect()}
    assert got == brute(rows)


def test_runs_are_unpacked_as_they_were():
    rng = np.random.default_rng(4)
    rec = np.empty(500, suffix_dedup.RUN)
    for name in suffix_dedup.RUN.names:
        rec[name] = rng.integers(0, 1 << 16, 500)
    rec["doc"] = np.sort(rng.integers(0, 90, 500))
    known = np.array([rng.integers(-(1 << 63), 1 << 63, 90), rng.integers(-(1 << 63), 1 << 63, 90)]).T
    ids, back = suffix_dedup._unpacked(*suffix_dedup._packed(known, rec.copy()))
    assert (ids == known[rec["doc"]]).all()
    assert all((back[name] == rec[name]).all() for name in suffix_dedup.RUN.names if name != "doc")
