"""Upload states: a plain fold, the batch and the stream agree, in any order of files and after a restart."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tallyforge import streaming
from tallyforge.streaming import uploads

EVENTS = "upload_id long, event_id long, event string, ts timestamp"
T0 = datetime.datetime(2024, 1, 1)


def made(seed, n=60):
    rng = random.Random(seed)
    path = ["upload", "claim", "phase0", "claim", "phase1", "complete"]
    rows = []
    for u in range(n):
        at = T0 + datetime.timedelta(minutes=rng.randint(0, 90))
        events = [x for e in path for x in ([e] if rng.random() < 0.85 else []) + (["fail", "requeue", "claim"] if rng.random() < 0.2 else []) + ([rng.choice(["cancel", "split", "retry", "odd", "fail"])] if rng.random() < 0.15 else [])]
        for e in events:
            at += datetime.timedelta(minutes=rng.choice([0, 1, 2, 14]))
            rows.append((u, len(rows), e, at))
    return rows


def fold(rows, as_of=None):
    out = {}
    for u in {r[0] for r in rows}:
        state = (None, 0, 0)
        for _, _, e, ts in sorted((r for r in rows if r[0] == u), key=lambda r: (r[3], r[1])):
            ms = int(ts.replace(tzinfo=datetime.UTC).timestamp() * 1000)
            state = uploads.advance(uploads.advance(state, uploads.TICK, ms), e, ms)
        if as_of is not None:
            state = uploads.advance(state, uploads.TICK, int(as_of.replace(tzinfo=datetime.UTC).timestamp() * 1000))
        if state[0]:
            out[u] = state
    return out


def as_ms(rows):
    return {r["upload_id"]: (r["status"], r["retries"], r["ms"]) for r in rows.withColumn("ms", F.unix_millis("since")).collect()}


def test_known_paths():
    state = (None, 0, 0)
    for e in ("claim", "upload", "complete", "claim", "phase0", "claim", "phase1", "cancel", "complete", "fail", "retry"):
        state = uploads.advance(state, e, 1)
    assert state[:2] == ("COMPLETED", 0)
    for e, want in (("upload", "QUEUED"), ("claim", "PROCESSING"), ("cancel", "CANCELLED"), ("retry", "CANCELLED"), ("fail", "CANCELLED")):
        state = uploads.advance(state if e != "upload" else (None, 0, 0), e, 1)
        assert state[0] == want
    state = ("ERROR", 3, 0)
    assert uploads.advance(state, "requeue", 1) == state and uploads.advance(state, "retry", 1) == ("QUEUED", 0, 1)
    assert uploads.advance(("PROCESSING", 2, 0), uploads.TICK, uploads.STUCK_MS + 1)[:2] == ("ERROR", 3)
    assert uploads.advance(("PROCESSING", 0, 0), uploads.TICK, uploads.STUCK_MS) == ("PROCESSING", 0, 0)


@pytest.mark.parametrize("late", [False, True])
def test_batch_equals_a_fold(spark, late):
    rows = made(1)
    as_of = T0 + datetime.timedelta(hours=9) if late else None
    df = spark.createDataFrame([*rows, *rows[:40], (None, 1, "upload", T0), (7000, 1, "upload", None), (7001, 1, None, T0)], EVENTS).repartition(4)
    got = as_ms(uploads.upload_states(df, None if as_of is None else F.lit(as_of)))
    assert got == fold(rows, as_of) and len(got) > 40
    assert uploads.upload_states(df.limit(0)).count() == 0


def test_stream_equals_the_batch_over_shuffled_files_and_a_restart(spark, tmp_path):
    rows = made(3)
    rng = random.Random(5)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, EVENTS)
    parts = [rows[i::4] for i in range(4)]
    for k, part in enumerate(parts):
        spark.createDataFrame(part + part[:5], EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k % 2:
            stream = streaming.stream_table(spark, f"{tmp_path}/in", df.schema, 1)
            uploads.write_states(stream, f"{tmp_path}/out", f"{tmp_path}/check", "12 hours").awaitTermination()
    got = as_ms(uploads.latest_states(spark.read.parquet(f"{tmp_path}/out")))
    assert got == fold(rows)


def test_time_alone_frees_what_is_stuck(spark, tmp_path):
    minute = lambda m: T0 + datetime.timedelta(minutes=m)
    rows = [(1, 1, "upload", minute(0)), (1, 2, "claim", minute(1)), (2, 3, "upload", minute(0)), (2, 4, "claim", minute(55)), (3, 5, "upload", minute(60))]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = streaming.stream_table(spark, f"{tmp_path}/in", spark.createDataFrame(rows, EVENTS).schema, 1)
    uploads.write_states(stream, f"{tmp_path}/out", f"{tmp_path}/check", "1 minute").awaitTermination()
    got = as_ms(uploads.latest_states(spark.read.parquet(f"{tmp_path}/out")))
    assert {u: s[:2] for u, s in got.items()} == {1: ("QUEUED", 1), 2: ("PROCESSING", 0), 3: ("QUEUED", 0)}
