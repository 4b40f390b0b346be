"""Numbers, segments, queues, exports and reports over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import positions


def five_digits(n: Column) -> Column:
    """A number with zeros before it up to five digits; lpad would cut longer ones."""
    return F.when(n.isNotNull(), F.format_string("%05d", n))


def next_numbers(new: DataFrame, known: DataFrame, by: list[str], order: str, prefix: str) -> DataFrame:
    """Consecutive numbers of five digits, or more where they need them, for new rows, after the largest known one of each
    group: gap-free within it. A group's rows are dealt by the order, so no task holds a whole group."""
    last = known.groupBy(*by).agg(F.max(F.col("number").try_cast("long")).alias("last"))
    met = positions(new.select(*by, order), by, [order], "at").join(last.hint("merge"), by, "left")
    return met.select(*by, order, F.concat(F.lit(prefix), five_digits(F.coalesce("last", F.lit(0)) + F.col("at"))).alias("number"))


def segments_valid(segments: DataFrame) -> DataFrame:
    """Whether the segments of each file, in order, cover its pages from 1 to the last without gaps."""
    w = Window.partitionBy("file_id").orderBy("start_page")
    joined = segments.withColumn("ok", (F.col("start_page") == F.coalesce(F.lag("end_page").over(w), F.lit(0)) + 1) & (F.col("end_page") >= F.col("start_page")))
    return joined.groupBy("file_id").agg((F.bool_and("ok") & (F.max("end_page") == F.max("pages"))).alias("valid"), F.count("*").alias("n_segments"))


def merged_segments(segments: DataFrame, least: float = 0.7) -> DataFrame:
    """Segments under `least` join the one before; a low first one joins the next. An island starts at each sure one."""
    w = Window.partitionBy("file_id").orderBy("start_page")
    sure = F.col("confidence") >= least
    island = F.greatest(F.sum(F.when(sure, 1).otherwise(0)).over(w), F.when(F.max(F.when(sure, 1)).over(Window.partitionBy("file_id")).isNotNull(), 1).otherwise(0))
    kept = segments.withColumn("island", island).withColumn("sure", sure)
    first = F.coalesce(F.min(F.when(F.col("sure"), F.struct("start_page", "confidence"))), F.min(F.struct("start_page", "confidence")))["confidence"]
    return kept.groupBy("file_id", "island").agg(F.min("start_page").alias("start_page"), F.max("end_page").alias("end_page"), first.alias("confidence")).drop("island")


def stuck_uploads(uploads: DataFrame, as_of: Column, minutes: int = 10) -> DataFrame:
    """What becomes of uploads that have been in process for over `minutes`: queued again, or an error at the last try."""
    stuck = uploads.where((F.col("status") == "PROCESSING") & (F.col("started") < as_of - F.make_interval(mins=F.lit(minutes))))
    again = F.col("retries") + 1
    return stuck.select("upload_id", F.when(again >= F.col("most"), "ERROR").otherwise("QUEUED").alias("status"), again.cast("long").alias("retries"))


def retries_due(uploads: DataFrame, as_of: Column, seconds: int = 5) -> DataFrame:
    """Failed uploads with tries left whose pause, twice as long each time, is over."""
    pause = F.lit(seconds) * F.pow(F.lit(2), F.greatest(F.col("retries") - 1, F.lit(0)))
    return uploads.where((F.col("status") == "ERROR") & (F.col("retries") < F.col("most")) & (F.unix_timestamp(as_of) - F.unix_timestamp("started") >= pause)).select("upload_id", "retries")


def export_reason(status: Column, posting: Column, old: Column) -> Column:
    """Why a document isn't exported; the first reason that holds."""
    return F.when(old | (status == "LEGACY"), "history").when(posting == "ERROR", "posting error").when(status == "REOPENED", "reopened").when(status != "APPROVED", "waiting")


def export_split(documents: DataFrame, cutover: Column, begin: Column, end: Column) -> DataFrame:
    """Live documents of a period with the reason that keeps each out of the export (null: it is exported)."""
    inside = documents.where("deleted_at is null and archived_at is null").where(F.col("document_date").between(begin, end))
    return inside.select("document_id", "type", "document_date", export_reason(F.col("review_status"), F.col("posting_status"), F.col("uploaded_at") < cutover).alias("reason"))


def export_manifest(split: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Rows, exclusions and whether a file is written, for each type."""
    counts = split.where(F.col("type").isin(*types)).groupBy("type").agg(F.count_if(F.col("reason").isNull()).alias("n_exported"), F.count("reason").alias("n_excluded"))
    return counts.withColumn("included", F.col("n_exported") > 0)


def period_bounds(as_of: Column, preset: str) -> tuple[Column, Column]:
    """First and last day of the month, quarter or year of a date."""
    begin = F.trunc(as_of, preset)
    months = {"month": 1, "quarter": 3, "year": 12}[preset]
    return begin, F.date_sub(F.add_months(begin, months), 1)


def due_kpis(invoices: DataFrame, as_of: Column, soon: int = 7) -> DataFrame:
    """Overdue invoices, those due soon, and totals, by currency."""
    due = F.col("due_date")
    return invoices.groupBy("currency").agg(F.count_if(due < as_of).alias("overdue"), F.count_if(due.between(as_of, F.date_add(as_of, soon))).alias("due_soon"), F.sum("total").cast("double").alias("total"))


def stock_kpis(vehicles: DataFrame, documents: DataFrame) -> DataFrame:
    """Vehicles in stock, in transit and sold, and documents to review, by tenant."""
    count = lambda *s: F.count_if(F.col("status").isin(*s))
    v = vehicles.groupBy("tenant").agg(count("IN_STOCK", "RESERVED").alias("in_stock"), count("IN_TRANSIT", "CUSTOMS").alias("in_transit"), count("SOLD").alias("sold"))
    d = documents.groupBy("tenant").agg(F.count_if(F.col("review_status") != "APPROVED").alias("to_review"))
    return v.join(d, "tenant", "full_outer").select("tenant", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("in_stock", "in_transit", "sold", "to_review")))


def top_empty_fields(events: DataFrame, k: int = 5) -> DataFrame:
    """The k fields that are most often empty in each (phase, document_type); ties by name."""
    counts = events.select("phase", "document_type", F.explode("empty_fields").alias("field")).groupBy("phase", "document_type", "field").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("phase", "document_type").orderBy(F.desc("n"), "field"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def token_usage(calls: DataFrame, price: float) -> DataFrame:
    """Calls, tokens and cost by function, by phase and by document, in one pass over grouping sets."""
    sets = calls.groupingSets([["function"], ["phase"], ["document_id"]], "function", "phase", "document_id")
    tokens = F.sum("tokens")
    return sets.agg(F.count("*").alias("calls"), tokens.alias("tokens"), (tokens * price).alias("cost"))


def top_consumers(usage: DataFrame, by: str, k: int) -> DataFrame:
    """The k largest of one grouping: a top-k without a full sort."""
    return usage.where(F.col(by).isNotNull()).orderBy(F.desc("tokens"), by).limit(k).select(F.lit(by).alias("kind"), F.col(by).cast("string").alias("name"), "tokens", "calls")


def durations(uploads: DataFrame) -> DataFrame:
    """Milliseconds from one event of an upload to the next, by the step that ended."""
    w = Window.partitionBy("upload_id").orderBy("ts", "event_id")
    ms = F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(F.lag("ts").over(w).cast("timestamp"))
    return uploads.select("upload_id", "event_id", "step", ms.alias("ms"))


def ledger_page(entries: DataFrame, page: int, size: int) -> DataFrame:
    """A page of entries, newest first, then by key; pages have at most 200 rows."""
    size = max(1, min(size, 200))
    return entries.orderBy(F.desc("document_date"), F.desc("posting_key")).offset((page - 1) * size).limit(size)


def window_metrics(events: DataFrame, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events, successes and the longest duration by phase, type and tumbling window of event time; over a stream, events
    later than `late` are dropped."""
    got = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "phase", "document_type").agg(F.count("*").alias("n"), F.count_if("success").alias("n_success"), F.max("duration").alias("longest"))
    return got.select(F.col("w.start").alias("window_start"), "phase", "document_type", "n", "n_success", "longest")
