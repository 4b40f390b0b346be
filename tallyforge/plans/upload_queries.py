"""The batch twin of the upload stream over the given events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.driver_tables import table
from ..streaming import uploads

#: What the events of an upload are taken for, by their number.
KINDS = ("upload", "claim", "phase0", "claim", "phase1", "complete", "fail", "requeue", "claim", "retry", "cancel", "split", "claim")
AS_OF = "2025-06-01 00:00:00"


def upload_states(spark, sf_dir):
    """An upload is what a user did in a week; the first event uploads it, the others follow from their number."""
    e = table(spark, sf_dir, "events")
    named = e.select((F.col("user_id") * 100 + F.floor(F.dayofyear("ts") / 7)).alias("upload_id"), "event_id", F.element_at(F.array(*map(F.lit, KINDS)), (F.col("event_id") % len(KINDS) + 1).cast("int")).alias("event"), F.col("ts").cast("timestamp").alias("ts"))
    first = named.groupBy("upload_id").agg(F.min("ts").alias("ts")).select("upload_id", F.lit(-1).cast("long").alias("event_id"), F.lit("upload").alias("event"), "ts")
    got = uploads.upload_states(named.unionByName(first), F.lit(AS_OF).cast("timestamp"))
    return got.select("upload_id", "status", "retries", F.unix_millis("since").alias("since_ms"))


NAMES = (upload_states,)


def _step(event, legal, then, count):
    known = "a.status IS NULL" if legal == (None,) else f"a.status IN ({', '.join(repr(s) for s in legal)})"
    return f"e.event = '{event}' AND {known}" + (f" AND a.retries < {uploads.MOST_RETRIES}" if count == "left" else "")


def oracle_sql():
    steps = [(_step(event, *rule), rule[1], {"zero": "0", "more": "a.retries + 1"}.get(rule[2], "a.retries")) for event, rule in uploads.TRANSITIONS.items()]
    late = f"e.event = 'tick' AND a.status = 'PROCESSING' AND e.ms - a.ms > {uploads.STUCK_MS}"
    status = " ".join(f"WHEN {c} THEN '{then}'" for c, then, _ in steps)
    retries = " ".join(f"WHEN {c} THEN {n}" for c, _, n in steps)
    moved = " OR ".join(f"({c})" for c, *_ in steps)
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return {
        "upload_states": f"""WITH named AS (SELECT user_id * 100 + dayofyear(ts) // 7 AS upload_id, event_id, [{kinds}][event_id % {len(KINDS)} + 1] AS event, epoch_us(ts) // 1000 AS ms FROM events),
every AS (SELECT * FROM named UNION ALL SELECT upload_id, -1, 'upload', min(ms) FROM named GROUP BY upload_id),
ticked AS (SELECT upload_id, ms, event_id, k, CASE k WHEN 0 THEN 'tick' ELSE event END AS event FROM every, (SELECT unnest([0, 1]) AS k)
  UNION ALL SELECT DISTINCT upload_id, epoch_ms(TIMESTAMP '{AS_OF}'), 9223372036854775807, 0, 'tick' FROM every),
listed AS (SELECT upload_id, list(struct_pack(status := NULL::VARCHAR, retries := 0::INTEGER, ms := ms, event := event) ORDER BY ms, event_id, k) AS es FROM ticked GROUP BY upload_id),
folded AS (SELECT upload_id, list_reduce(list_prepend(struct_pack(status := NULL::VARCHAR, retries := 0::INTEGER, ms := 0::BIGINT, event := ''), es), lambda a, e: struct_pack(
  status := CASE WHEN {late} THEN CASE WHEN a.retries + 1 >= {uploads.MOST_RETRIES} THEN 'ERROR' ELSE 'QUEUED' END {status} ELSE a.status END,
  retries := CAST(CASE WHEN {late} THEN a.retries + 1 {retries} ELSE a.retries END AS INTEGER),
  ms := CASE WHEN ({late}) OR {moved} THEN e.ms ELSE a.ms END, event := e.event)) AS s FROM listed)
SELECT upload_id, s.status AS status, s.retries AS retries, s.ms AS since_ms FROM folded WHERE s.status IS NOT NULL"""
    }
