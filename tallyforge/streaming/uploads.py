"""States of uploads: a stream of events through one state machine for each upload, and its batch twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: For each event the states in which it is legal (None: not uploaded yet), the state that follows and what becomes of the
#: count of retries (fixed values). tick stands for time passing: it only matters to what has been in process for too long.
TRANSITIONS = {
    "upload": ((None,), "QUEUED", "zero"),
    "claim": (("QUEUED", "PHASE0_COMPLETE"), "PROCESSING", "same"),
    "phase0": (("PROCESSING",), "PHASE0_COMPLETE", "same"),
    "phase1": (("PROCESSING",), "PHASE1_COMPLETE", "same"),
    "complete": (("PHASE1_COMPLETE",), "COMPLETED", "same"),
    "split": (("PROCESSING",), "SPLIT", "same"),
    "cancel": (("QUEUED", "PROCESSING", "PHASE0_COMPLETE"), "CANCELLED", "same"),
    "fail": (("QUEUED", "PROCESSING", "PHASE0_COMPLETE", "PHASE1_COMPLETE", "ERROR"), "ERROR", "more"),
    "requeue": (("ERROR",), "QUEUED", "left"),
    "retry": (("ERROR",), "QUEUED", "zero"),
}
MOST_RETRIES = 3
STUCK_MS = 10 * 60 * 1000
TICK = "tick"

State = tuple[str | None, int, int]


def advance(state: State, event: str, ms: int) -> State:
    """(status, retries, since in ms) after an event; illegal events change nothing. requeue needs a retry to be left."""
    status, retries, since = state
    if event == TICK:
        if status != "PROCESSING" or ms - since <= STUCK_MS:
            return state
        return ("ERROR" if retries + 1 >= MOST_RETRIES else "QUEUED", retries + 1, ms)
    legal, then, count = TRANSITIONS.get(event, ((), None, ""))
    if status not in legal or count == "left" and retries >= MOST_RETRIES:
        return state
    return (then, {"zero": 0, "more": retries + 1}.get(count, retries), ms)


def _advanced(state: Column, e: Column) -> Column:
    """advance() as an expression; state has status, retries and since_ms, e has event and ms."""
    status, retries, next_status, next_retries = state["status"], state["retries"], None, None
    stuck = (e["event"] == TICK) & (status == "PROCESSING") & (e["ms"] - state["since_ms"] > STUCK_MS)
    last = retries + 1 >= MOST_RETRIES
    next_status, next_retries, moved = F.when(stuck, F.when(last, "ERROR").otherwise("QUEUED")), F.when(stuck, retries + 1), stuck
    for event, (legal, then, count) in TRANSITIONS.items():
        ok = (e["event"] == event) & (status.isNull() if legal == (None,) else status.isin(*legal))
        ok = F.coalesce(ok & (retries < MOST_RETRIES) if count == "left" else ok, F.lit(False))
        next_status = next_status.when(ok, then)
        next_retries = next_retries.when(ok, {"zero": F.lit(0), "more": retries + 1}.get(count, retries))
        moved = moved | ok
    return F.struct(next_status.otherwise(status).alias("status"), next_retries.otherwise(retries).cast("int").alias("retries"), F.when(F.coalesce(moved, F.lit(False)), e["ms"]).otherwise(state["since_ms"]).alias("since_ms"))


def upload_states(events: DataFrame, as_of: Column | None = None) -> DataFrame:
    """upload_id, status, retries and since of each upload after its events (upload_id, event_id, event, ts) in the order of
    (ts, event_id), and, with as_of, after the time up to then. An event that comes twice counts once; what was never
    uploaded, and rows without an upload_id or a ts, have no state. An upload has few events, so its own are gathered."""
    at = F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "event_id", "event")
    own = events.where("upload_id is not null and ts is not null").groupBy("upload_id").agg(F.array_sort(F.collect_set(at)).alias("events"))
    tick = lambda ms: F.struct(ms.alias("ms"), F.lit(TICK).alias("event"))
    steps = F.flatten(F.transform("events", lambda e: F.array(tick(e["ms"]), F.struct(e["ms"].alias("ms"), e["event"].alias("event")))))
    if as_of is not None:
        steps = F.array_append(steps, tick(F.unix_millis(as_of)))
    none = F.struct(F.lit(None).cast("string").alias("status"), F.lit(0).alias("retries"), F.lit(0).cast("long").alias("since_ms"))
    folded = own.select("upload_id", F.aggregate(steps, none, _advanced).alias("s")).where("s.status is not null")
    return folded.select("upload_id", "s.status", "s.retries", F.timestamp_millis("s.since_ms").alias("since"))


class _Uploads(StatefulProcessor):
    """Keeps the state up to the watermark and the events after it, which may still be joined by earlier ones."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("upload", "version long, status string, retries int, since long, events array<struct<ms:bigint,event_id:bigint,event:string>>")

    def _changed(self, key, new: list[tuple[int, int, str]], now: int, shown: bool) -> Iterator[pd.DataFrame]:
        version, status, retries, since, events = self.value.get() if self.value.exists() else (0, None, 0, 0, [])
        state: State = (status, retries, since)
        pending = sorted({tuple(e) for e in events} | set(new))
        settled = [e for e in pending if e[0] <= now]
        for ms, _, event in settled:
            state = advance(advance(state, TICK, ms), event, ms)
        if state[0] == "PROCESSING" and now - state[2] > STUCK_MS:
            state = advance(state, TICK, now)
        latest, pending = state, pending[len(settled) :]
        for ms, _, event in pending:
            latest = advance(advance(latest, TICK, ms), event, ms)
        changed = latest != (status, retries, since) or shown
        self.value.update((version + changed, *state, pending))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        wait = [ms for ms, *_ in pending] + [state[2] + STUCK_MS + 1] * (state[0] == "PROCESSING")
        if wait:
            self.handle.registerTimer(min(wait))
        if latest[0] is not None and changed:
            yield pd.DataFrame({"upload_id": [key[0]], "version": [version + 1], "status": [latest[0]], "retries": [latest[1]], "since": [pd.Timestamp(latest[2], unit="ms")]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(t.timestamp() * 1000), int(i), e) for pdf in rows for t, i, e in zip(pdf["ts"], pdf["event_id"], pdf["event"])]
        yield from self._changed(key, new, timerValues.getCurrentWatermarkInMs(), True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._changed(key, [], timerValues.getCurrentWatermarkInMs(), False)

    def close(self) -> None:
        pass


STATES = "upload_id long, version long, status string, retries int, since timestamp"


def stream_states(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """STATES of uploads as events arrive, in any order within `late`; the row with the largest version of an upload is the
    state that upload_states() gives for what has arrived, and for the time up to the watermark. Needs the state store that
    keeps timers (RocksDB)."""
    known = events.where("upload_id is not null and ts is not null").select(F.col("upload_id").cast("long").alias("upload_id"), F.col("event_id").cast("long").alias("event_id"), "event", "ts")
    return known.withWatermark("ts", late).groupBy("upload_id").transformWithStateInPandas(_Uploads(), STATES, "Update", "EventTime")


def write_states(events: DataFrame, path: str, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """Runs stream_states() over what has arrived. Each batch has its own folder, so one that runs again replaces itself."""
    store = "spark.sql.streaming.stateStore.providerClass"
    events.sparkSession.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream_states(events, late).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_states(written: DataFrame) -> DataFrame:
    """The last row of each upload in what write_states() wrote."""
    last = written.groupBy("upload_id").agg(F.max_by(F.struct("status", "retries", "since"), "version").alias("s"))
    return last.select("upload_id", "s.*")
