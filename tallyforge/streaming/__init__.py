"""Streams of documents and metric events; each function has a batch twin with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ledger, rates
from ..operators.worklists import window_metrics
from .ledger_store import LedgerStore


def stream_table(spark: SparkSession, path: str, schema, files_each: int = 8) -> DataFrame:
    """New files of a folder of Parquet files, at most files_each in one batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def first_arrivals(stream: DataFrame, keys: list[str], time: str, horizon: str) -> DataFrame:
    """Rows whose keys (tenant, content hash) have not been seen within the horizon; state older than it goes."""
    return stream.withWatermark(time, horizon).dropDuplicatesWithinWatermark(keys)


def write_metrics(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Closed windows of metrics, appended once each; runs until what has arrived is done."""
    return window_metrics(events).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)


def posted_rows(lines: DataFrame, published: DataFrame, need_lines: bool = True) -> Callable[[DataFrame], dict[str, DataFrame]]:
    """For rewrite_documents(): the journal of a batch of documents, in RON at the rates that are published, as the table
    `entries` with the columns ENTRIES. Documents that aren't approved, or have an error, have no entries any more."""

    def rows(batch: DataFrame) -> dict[str, DataFrame]:
        own = lines.join(batch.select("document_id"), "document_id", "left_semi")
        entries = ledger.journal(rates.rates_as_of(batch, published), own, need_lines)
        return {"entries": entries.withColumn("month", F.date_format("document_date", "yyyy-MM"))}

    return rows


#: Columns of the table of entries in a LedgerStore.
ENTRIES = "document_id long, month string, document_date date, posting_key string, account string, debit decimal(14,2), credit decimal(14,2)"


def rewrite_documents(stream: DataFrame, rows_of: Callable[[DataFrame], dict[str, DataFrame]], store: LedgerStore, checkpoint: str, name: str = "documents", order: str | None = None) -> StreamingQuery:
    """Each batch of documents is posted exactly once: rows_of gives their rows for each table of the store, and these
    replace all that the store has for the batch's documents, in whatever month it was. Of several versions of a document
    in one batch the one with the largest `order` counts; a later batch wins over an earlier one."""

    def write(batch: DataFrame, batch_id: int) -> None:
        one = batch
        if order is not None:
            one = batch.groupBy("document_id").agg(F.max_by(F.struct(*batch.columns), order).alias("d")).select("d.*")
        store.replace(one, rows_of(one), (name, batch_id))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
