"""Queries of bank statements, worklists, exports, numbering, duplicates and reports over views of the plain tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import MONEY, round2
from ..operators import bank_text
from ..operators import duplicates as dup
from ..operators import statements as st
from ..operators import worklists as wl
from ..sources import driver_tables as src
from ..sources.driver_tables import table

AS_OF = "1996-06-30"
NOW = "2024-01-20 12:00:00"


def _controls(rows):
    """Printed turnover and closing of each day; rows of errors are not printed."""
    from pyspark.sql import Window

    days = rows.where("event_type <> 'error'").groupBy("statement_id", "day").agg(F.sum("debit").alias("debit"), F.sum("credit").alias("credit"))
    w = Window.partitionBy("statement_id").orderBy("day")
    return days.withColumn("closing", F.sum(F.col("credit") - F.col("debit")).over(w)).withColumn("opening", F.lit(0).cast(MONEY))


def _statement_lines(rows):
    """The lines a bank prints: turnover and closing of each day, among other lines, amounts in one of two ways."""
    days = _controls(rows)
    us = lambda c: F.format_number(F.col(c).cast("double"), 2)
    amount = lambda c: F.when(F.col("statement_id") % 2 == 0, us(c)).otherwise(F.translate(us(c), ",.", ".,"))
    day, base = F.date_format("day", "dd/MM/yyyy"), F.datediff("day", F.lit("2000-01-01")) * 8
    texts = [
        (1, F.concat(F.lit("Plata card "), day, F.lit(" 17.20"))),
        (2, F.concat_ws(" ", F.lit("RULAJ ZI"), day, amount("debit"), amount("credit"))),
        (3, F.lit("Sold final zi lipsa")),
        (4, F.concat_ws("  ", F.lit("Sold Final Zi"), amount("closing"))),
        (6, F.when(F.dayofmonth("day") == 3, F.concat_ws(" ", F.lit("SOLD FINAL CONT"), amount("closing")))),
        (7, F.when(F.dayofmonth("day") == 5, F.concat_ws(" ", F.lit("RULAJ TOTAL CONT"), amount("debit"), amount("credit")))),
    ]
    lines = F.inline(F.array(*(F.struct((base + k).alias("line_no"), text.alias("text")) for k, text in texts)))
    start = days.groupBy("statement_id").agg(F.lit(0).alias("line_no")).withColumn("text", F.lit("SOLD ANTERIOR 0.00"))
    return days.select("statement_id", lines).where("text is not null").unionByName(start)


def _read_controls(rows):
    lines = _statement_lines(rows)
    return bank_text.with_openings(bank_text.day_controls(lines), bank_text.statement_controls(lines))


def printed_days(spark, sf_dir):
    """Controls of days as the printed lines give them."""
    got = bank_text.day_controls(_statement_lines(src.bank_rows(spark, sf_dir)))
    return got.select("statement_id", "day", *(F.col(c).cast("double").alias(c) for c in ("debit", "credit", "closing")))


def printed_statements(spark, sf_dir):
    """Opening, closing and turnovers that the statements print."""
    got = bank_text.statement_controls(_statement_lines(src.bank_rows(spark, sf_dir)))
    return got.select("statement_id", *(F.col(c).cast("double").alias(c) for c in ("opening", "closing", "total_debit", "total_credit")))


def _printed(spark, sf_dir):
    """Rows with their printed balance, missing on some, and copies of some rows with the same balance."""
    from pyspark.sql import Window

    rows = src.bank_rows(spark, sf_dir)
    w = Window.partitionBy("statement_id").orderBy("ts", "row_no").rowsBetween(Window.unboundedPreceding, 0)
    real = rows.withColumn("balance", F.sum(F.col("credit") - F.col("debit")).over(w))
    copies = real.where("row_no % 50 = 0").withColumn("row_no", F.col("row_no") + 10**9)
    return real.withColumn("balance", F.when(F.col("row_no") % 40 != 1, F.col("balance"))).unionByName(copies)


def _statements(rows):
    closing = F.sum(F.col("credit") - F.col("debit")) + F.when(F.col("statement_id") % 3 == 0, 5).otherwise(0)
    return rows.groupBy("statement_id").agg(closing.cast("decimal(18,2)").alias("closing")).withColumn("opening", F.lit(0).cast(MONEY))


def running_balance(spark, sf_dir):
    rows = src.bank_rows(spark, sf_dir)
    return st.running_balance(rows, _read_controls(rows))


def turnover_gaps(spark, sf_dir):
    rows = src.bank_rows(spark, sf_dir)
    return st.turnover_gaps(rows, _read_controls(rows))


def day_directions(spark, sf_dir):
    """Each eleventh row is read on the wrong side, and a cent is missing from the printed debits of some days."""
    rows = src.bank_rows(spark, sf_dir)
    days = rows.groupBy("statement_id", "day").agg((F.sum("debit") + F.when(F.dayofmonth("day") == 7, 1).otherwise(0)).alias("debit"), F.sum("credit").alias("credit"))
    wrong = F.col("row_no") % 11 == 0
    read = rows.select("statement_id", "row_no", "day", F.when(wrong, F.col("credit")).otherwise(F.col("debit")).alias("debit"), F.when(wrong, F.col("debit")).otherwise(F.col("credit")).alias("credit"))
    return st.repair_day_directions(read, days)


def balance_chain(spark, sf_dir):
    return st.balance_chain(_statements(src.bank_rows(spark, sf_dir)), _printed(spark, sf_dir))


def chain_endpoints(spark, sf_dir):
    return st.chain_endpoints(_printed(spark, sf_dir))


def dedupe_kept(spark, sf_dir):
    rows = _printed(spark, sf_dir).withColumns({"reference": F.concat(F.lit("R"), (F.col("row_no") % 10**9).cast("string")), "description": F.concat_ws(" ", "event_type", F.lit("x" * 40), "row_no")})
    return st.first_of_equal(rows)


def statement_reconciled(spark, sf_dir):
    rows = src.bank_rows(spark, sf_dir)
    described = rows.withColumn("description", F.when(F.col("event_type") == "error", "Total rulaj zi").otherwise(F.col("event_type")))
    return st.reconciled(_statements(rows), st.without_summary_rows(described))


def _segments(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), "turn")
    pages = conv.groupBy("file_id").agg((F.max("turn") * 2 + 2 + F.when(F.col("file_id") % 5 == 0, 1).otherwise(0)).alias("pages"))
    return conv.join(pages, "file_id").select("file_id", (F.col("turn") * 2 + 1).alias("start_page"), (F.col("turn") * 2 + 2).alias("end_page"), "pages", ((F.col("file_id") * 7 + F.col("turn") * 3) % 10 / 10).alias("confidence"))


def segments_valid(spark, sf_dir):
    return wl.segments_valid(_segments(spark, sf_dir))


def merged_segments(spark, sf_dir):
    return wl.merged_segments(_segments(spark, sf_dir))


def partner_numbers(spark, sf_dir):
    """Suppliers without an account number get the next ones of their country."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("tenant"), F.col("s_suppkey").alias("partner_id"))
    known = s.where("partner_id % 3 <> 0").select("tenant", wl.five_digits(F.col("partner_id") * 2).alias("number"))
    return wl.next_numbers(s.where("partner_id % 3 = 0"), known, ["tenant"], "partner_id", "FURN")


def contract_numbers(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).alias("tenant"), F.when(F.col("o_custkey") % 2 == 0, "A").otherwise("B").alias("series"), F.col("o_orderkey").alias("request"))
    known = o.select("tenant", "series").distinct().where("series = 'A'").withColumn("number", F.lit("00041"))
    return wl.next_numbers(o, known, ["tenant", "series"], "request", "CV-")


def _uploads(spark, sf_dir):
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("upload_id"), F.when(kind == "error", "ERROR").when(kind.isin("click", "view"), "PROCESSING").otherwise("COMPLETED").alias("status"), F.col("ts").alias("started"), (F.get_json_object("props", "$.k").cast("int") % 4).alias("retries"), F.lit(3).alias("most"))


def stuck_uploads(spark, sf_dir):
    return wl.stuck_uploads(_uploads(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"))


def retries_due(spark, sf_dir):
    return wl.retries_due(_uploads(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"))


def processing_durations(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("upload_id"), "event_id", "ts", F.col("event_type").alias("step"))
    return wl.durations(e)


def _dated(spark, sf_dir):
    """Documents with an upload time, a posting status, a due date and some deleted or archived ones."""
    d, day = src.documents(spark, sf_dir), F.col("document_date")
    k = F.col("document_id")
    return d.select("*", F.date_add(day, (k % 5).cast("int")).alias("uploaded_at"), F.when(k % 13 == 0, "ERROR").otherwise("POSTED").alias("posting_status"), F.when(k % 17 == 0, day).alias("deleted_at"), F.when(k % 19 == 0, day).alias("archived_at"), F.when(k % 4 != 0, F.date_add(day, (k % 60).cast("int"))).alias("due_date"))


def _split(spark, sf_dir):
    begin, end = wl.period_bounds(F.lit(AS_OF).cast("date"), "year")
    return wl.export_split(_dated(spark, sf_dir), F.lit("1996-03-01").cast("date"), begin, end)


def export_split(spark, sf_dir):
    return _split(spark, sf_dir)


def export_manifest(spark, sf_dir):
    return wl.export_manifest(_split(spark, sf_dir), ("Invoice", "Receipt", "Payment Disposition"))


def export_periods(spark, sf_dir):
    """Documents by the month, quarter and year they fall into."""
    d = src.documents(spark, sf_dir)
    bounds = [F.struct(F.lit(p).alias("preset"), *(x.alias(n) for n, x in zip(("first_day", "last_day"), wl.period_bounds(F.col("document_date"), p)))) for p in ("month", "quarter", "year")]
    return d.select(F.explode(F.array(*bounds)).alias("p")).groupBy("p.preset", "p.first_day", "p.last_day").agg(F.count("*").alias("n_documents"))


def due_kpis(spark, sf_dir):
    d = _dated(spark, sf_dir).where("type = 'Invoice'").select(F.col("document_id").alias("o_orderkey"), "currency", "due_date")
    totals = table(spark, sf_dir, "orders").select("o_orderkey", round2(F.col("o_totalprice")).alias("total"))
    return wl.due_kpis(d.join(totals, "o_orderkey"), F.lit(AS_OF).cast("date"))


def stock_kpis(spark, sf_dir):
    states = F.element_at(F.array(*map(F.lit, ("SOURCED", "PURCHASED", "IN_TRANSIT", "CUSTOMS", "IN_STOCK", "RESERVED", "SOLD", "DELIVERED"))), (F.col("p_size") % 8 + 1).cast("int"))
    v = table(spark, sf_dir, "part").select((F.col("p_partkey") % 5).alias("tenant"), states.alias("status"))
    return wl.stock_kpis(v, src.documents(spark, sf_dir).select((F.col("partner_id") % 6).alias("tenant"), "review_status"))


def _metrics(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    empty = F.array_compact(F.array(F.when(k % 2 == 0, "vendor_ein"), F.when(k % 3 == 0, "total_amount"), F.when(k % 5 == 0, "document_date"), F.when(k % 7 == 0, "currency"), F.when(k % 4 == 0, "buyer"), F.when(k % 9 == 0, "net_amount")))
    return table(spark, sf_dir, "events").select("ts", (F.col("event_id") % 2).alias("phase"), F.col("event_type").alias("document_type"), (F.col("event_type") != "error").alias("success"), round2(F.col("value")).alias("duration"), empty.alias("empty_fields"), F.col("user_id").alias("document_id"), F.concat(F.lit("f"), (k % 12).cast("string")).alias("function"), (k * 37 + 5).cast("long").alias("tokens"))


def top_empty_fields(spark, sf_dir):
    return wl.top_empty_fields(_metrics(spark, sf_dir))


def _usage(spark, sf_dir):
    return wl.token_usage(_metrics(spark, sf_dir), 0.25)


def token_usage(spark, sf_dir):
    return _usage(spark, sf_dir)


def top_consumers(spark, sf_dir):
    """The 10 largest functions, 5 phases and 5 documents by tokens."""
    usage = _usage(spark, sf_dir)
    return wl.top_consumers(usage, "function", 10).union(wl.top_consumers(usage, "phase", 5)).union(wl.top_consumers(usage, "document_id", 5))


def window_metrics(spark, sf_dir):
    e = _metrics(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    got = wl.window_metrics(e, "1 hour", "2 hours")
    return got.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "phase", "document_type", "n", "n_success", F.col("longest").cast("double").alias("longest"))


def ledger_page(spark, sf_dir):
    """The third page of 200 entries of the journal, newest first."""
    from .queries import _journal

    return wl.ledger_page(_journal(spark, sf_dir), 3, 200).select("document_date", "posting_key", "account", F.col("debit").cast("double").alias("debit"), F.col("credit").cast("double").alias("credit"))


def duplicate_documents(spark, sf_dir):
    """Orders as documents, some entered again: the amount 0.50 off, three days later, without the number, without number
    and partner but with a similar name, or of another number 0.50 off."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    o = src.documents(spark, sf_dir).select("document_id", "type", "currency", "partner_id").join(table(spark, sf_dir, "orders").select(k.alias("document_id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), day.alias("document_date")), "document_id")
    word = lambda letter, n: F.concat(F.lit(letter), (F.col("partner_id") % n).cast("string"))
    o = o.withColumns({"number": F.concat_ws("-", "partner_id", "document_id"), "name": F.concat_ws(" ", word("NORD", 5), word("SUD", 7), word("EST", 11))})
    kind = F.expr("document_id div 37 % 5")
    changed = {
        "document_id": F.col("document_id") + 10**8,
        "cents": F.col("cents") + F.when(kind.isin(1, 4), 50).otherwise(0),
        "document_date": F.date_add("document_date", F.when(kind == 2, 3).otherwise(0)),
        "number": F.when(kind < 3, F.col("number")).when(kind == 4, F.concat("number", F.lit("B"))),
        "partner_id": F.when((kind != 3) | (F.col("document_id") % 2 == 0), F.col("partner_id")),
        "name": F.when(kind == 3, F.concat("name", F.lit(" GRUP"))).otherwise(F.col("name")),
    }
    again = o.where("document_id % 37 = 0").select(*(changed.get(c, F.col(c)).alias(c) for c in o.columns))
    return dup.duplicate_documents(o.unionByName(again))


NAMES = (printed_days, printed_statements, turnover_gaps, day_directions, balance_chain, chain_endpoints, dedupe_kept, statement_reconciled, segments_valid, merged_segments, partner_numbers, contract_numbers, stuck_uploads, retries_due, processing_durations, export_split, export_manifest, export_periods, due_kpis, stock_kpis, top_empty_fields, token_usage, top_consumers, window_metrics, ledger_page, duplicate_documents, running_balance)

_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


_DIRECTIONS = """, d AS (SELECT statement_id, day, sum(debit) + CASE WHEN day(day) = 7 THEN 1 ELSE 0 END AS dd, sum(credit) AS dc, count(*) AS n, sum(debit + credit) AS total FROM fx_bank GROUP BY statement_id, day),
r AS (SELECT statement_id, day, row_no, dd, dc, n, total, debit + credit AS amount, CASE WHEN row_no % 11 = 0 THEN credit ELSE debit END AS debit, CASE WHEN row_no % 11 = 0 THEN debit ELSE credit END AS credit FROM fx_bank JOIN d USING (statement_id, day)),
k AS (SELECT *, CASE WHEN dc <= 0.011 THEN 'debit' WHEN dd <= 0.011 THEN 'credit' WHEN abs(total - dd - dc) <= 0.011 AND n <= 40 AND dc <= 100000 THEN 'mixed' ELSE 'kept' END AS kind FROM r),
m AS MATERIALIZED (SELECT statement_id, day, row_no, amount, dc, row_number() OVER (PARTITION BY statement_id, day ORDER BY row_no) AS i FROM k WHERE kind = 'mixed' AND amount > 0),
subsets AS (SELECT statement_id, day, dc, 0::BIGINT AS i, 0::DECIMAL(14,2) AS s, []::BIGINT[] AS ids FROM m WHERE i = 1
  UNION ALL SELECT b.statement_id, b.day, b.dc, m.i, CAST(b.s + m.amount AS DECIMAL(14,2)), list_prepend(m.row_no, b.ids) FROM subsets b JOIN m ON b.statement_id = m.statement_id AND b.day = m.day AND m.i > b.i AND b.s + m.amount <= b.dc),
solved AS (SELECT statement_id, day, min(ids) AS credits FROM subsets WHERE s = dc GROUP BY ALL),
f AS (SELECT k.*, credits, CASE WHEN kind = 'mixed' AND credits IS NULL THEN 'kept' ELSE kind END AS done, sum(debit) OVER w AS sd, sum(credit) OVER w AS sc FROM k LEFT JOIN solved USING (statement_id, day) WINDOW w AS (PARTITION BY statement_id, day))
SELECT statement_id, row_no, CAST(CASE done WHEN 'debit' THEN amount WHEN 'credit' THEN 0 WHEN 'mixed' THEN CASE WHEN list_contains(credits, row_no) THEN 0 ELSE amount END ELSE debit END AS DOUBLE) AS debit,
  CAST(CASE done WHEN 'credit' THEN amount WHEN 'debit' THEN 0 WHEN 'mixed' THEN CASE WHEN list_contains(credits, row_no) THEN amount ELSE 0 END ELSE credit END AS DOUBLE) AS credit,
  CASE kind WHEN 'debit' THEN abs(total - dd) > 0.011 WHEN 'credit' THEN abs(total - dc) > 0.011 WHEN 'mixed' THEN credits IS NULL ELSE abs(sd - dd) > 0.011 OR abs(sc - dc) > 0.011 END AS flagged
FROM f"""


def oracle_sql():
    from .queries import _FX, _JOURNAL

    controls = ", days AS (SELECT statement_id, day, sum(debit) AS debit, sum(credit) AS credit FROM fx_bank WHERE event_type <> 'error' GROUP BY ALL), controls AS (SELECT *, sum(credit - debit) OVER (PARTITION BY statement_id ORDER BY day) AS closing FROM days)"
    printed = """, balanced AS (SELECT *, sum(credit - debit) OVER (PARTITION BY statement_id ORDER BY ts, row_no ROWS UNBOUNDED PRECEDING) AS b FROM fx_bank),
printed AS (SELECT statement_id, row_no, ts, day, event_type, debit, credit, CASE WHEN row_no % 40 <> 1 THEN b END AS balance FROM balanced
  UNION ALL SELECT statement_id, row_no + 1000000000, ts, day, event_type, debit, credit, b FROM balanced WHERE row_no % 50 = 0)"""
    closings = ", closings AS (SELECT statement_id, sum(credit - debit) + CASE WHEN statement_id % 3 = 0 THEN 5 ELSE 0 END AS closing FROM fx_bank GROUP BY statement_id)"
    segments = "WITH s AS (SELECT conv_id AS file_id, turn, turn * 2 + 1 AS start_page, turn * 2 + 2 AS end_page, max(turn) OVER (PARTITION BY conv_id) * 2 + 2 + CASE WHEN conv_id % 5 = 0 THEN 1 ELSE 0 END AS pages, (conv_id * 7 + turn * 3) % 10 AS tenths FROM conversations)"
    uploads = f"WITH u AS (SELECT event_id AS upload_id, CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type IN ('click', 'view') THEN 'PROCESSING' ELSE 'COMPLETED' END AS status, ts AS started, {_K} % 4 AS retries FROM events)"
    dated = _FX + """, dated AS (SELECT *, document_date + CAST(document_id % 5 AS INTEGER) AS uploaded_at, CASE WHEN document_id % 4 <> 0 THEN document_date + CAST(document_id % 60 AS INTEGER) END AS due_date FROM fx_documents),
split AS (SELECT document_id, type, document_date, CASE WHEN uploaded_at < DATE '1996-03-01' THEN 'history' WHEN document_id % 13 = 0 THEN 'posting error' WHEN review_status = 'REOPENED' THEN 'reopened' WHEN review_status <> 'APPROVED' THEN 'waiting' END AS reason
  FROM dated WHERE document_id % 17 <> 0 AND document_id % 19 <> 0 AND year(document_date) = 1996)"""
    metrics = f"WITH m AS (SELECT ts, event_id % 2 AS phase, event_type AS document_type, event_type <> 'error' AS success, CAST(floor(value * 100 + 0.5::DOUBLE) / 100 AS DECIMAL(14,2)) AS duration, {_K} AS k, user_id AS document_id, 'f' || ({_K} % 12) AS function, CAST({_K} * 37 + 5 AS BIGINT) AS tokens FROM events)"
    usage = metrics + ", usage AS (SELECT function, phase, document_id, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) AS DOUBLE) * 0.25 AS cost FROM m GROUP BY GROUPING SETS ((function), (phase), (document_id)))"
    top = lambda by, k: f"(SELECT '{by}' AS kind, CAST({by} AS VARCHAR) AS name, tokens, calls FROM usage WHERE {by} IS NOT NULL ORDER BY tokens DESC, {by} LIMIT {k})"
    fields = (("vendor_ein", 2), ("total_amount", 3), ("document_date", 5), ("currency", 7), ("buyer", 4), ("net_amount", 9))
    return {
        "running_balance": f"{_FX}{controls}, starts AS (SELECT statement_id, day, coalesce(lag(closing) OVER (PARTITION BY statement_id ORDER BY day), 0) AS start FROM controls) SELECT statement_id, row_no, CAST(coalesce(start, 0) + sum(credit - debit) OVER (PARTITION BY statement_id, day ORDER BY ts, row_no ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS balance FROM fx_bank LEFT JOIN starts USING (statement_id, day)",
        "turnover_gaps": f"{_FX}{controls}, s AS (SELECT statement_id, day, sum(debit) AS d, sum(credit) AS c, count(*) AS n_rows FROM fx_bank GROUP BY ALL) SELECT statement_id, day, coalesce(n_rows, 0) AS n_rows, CAST(abs(coalesce(d, 0) - coalesce(debit, 0)) AS DOUBLE) AS debit_gap, CAST(abs(coalesce(c, 0) - coalesce(credit, 0)) AS DOUBLE) AS credit_gap FROM s FULL JOIN controls USING (statement_id, day)",
        "printed_days": f"{_FX}{controls} SELECT statement_id, day, CAST(debit AS DOUBLE) AS debit, CAST(credit AS DOUBLE) AS credit, CAST(closing AS DOUBLE) AS closing FROM controls",
        "printed_statements": f"""{_FX}{controls} SELECT statement_id, 0.0::DOUBLE AS opening, CAST(arg_max(closing, day) FILTER (day(day) = 3) AS DOUBLE) AS closing, CAST(arg_max(debit, day) FILTER (day(day) = 5) AS DOUBLE) AS total_debit, CAST(arg_max(credit, day) FILTER (day(day) = 5) AS DOUBLE) AS total_credit FROM controls GROUP BY statement_id""",
        "day_directions": _FX.replace("WITH ", "WITH RECURSIVE ", 1) + _DIRECTIONS,
        "balance_chain": f"""{_FX}{printed}{closings}, runs AS (SELECT *, credit - debit AS amount, count(balance) OVER (PARTITION BY statement_id ORDER BY ts, row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM printed),
priors AS (SELECT *, coalesce(last_value(balance IGNORE NULLS) OVER (PARTITION BY statement_id ORDER BY ts, row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + coalesce(sum(amount) FILTER (balance IS NULL) OVER (PARTITION BY statement_id, run ORDER BY ts, row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM runs),
flags AS (SELECT *, coalesce(abs(balance - prior) <= 0.02 AND abs(amount) > 0.02, false) AS phantom FROM priors),
sums AS (SELECT statement_id, count(*) AS n_rows, count(balance) AS printed, count(DISTINCT balance) AS kinds, count(*) FILTER (phantom) AS phantoms, count(*) FILTER (NOT phantom AND abs(balance - prior - amount) > 0.02) AS jumps, sum(amount) AS al, coalesce(sum(amount) FILTER (NOT phantom), 0) AS kept FROM flags GROUP BY statement_id),
judged AS (SELECT *, printed * 10 >= n_rows * 8 AND kinds >= greatest(2, printed // 2) AS usable, abs(kept - closing) AS kept_gap, abs(al - closing) AS all_gap FROM sums JOIN closings USING (statement_id))
SELECT statement_id, n_rows, CASE WHEN usable THEN jumps END AS jumps, CASE WHEN usable AND phantoms > 0 AND kept_gap <= all_gap + 0.02 THEN phantoms ELSE 0 END AS dropped, usable, CASE WHEN usable AND phantoms > 0 AND kept_gap <= all_gap + 0.02 THEN kept_gap ELSE all_gap END <= 0.5 AS reconciled FROM judged""",
        "chain_endpoints": f"{_FX}{printed} SELECT statement_id, CAST((array_agg(balance - credit + debit ORDER BY ts, row_no) FILTER (true))[1] AS DOUBLE) AS opening, CAST((array_agg(balance ORDER BY ts DESC, row_no DESC))[1] AS DOUBLE) AS closing, min(day) AS first_day, max(day) AS last_day FROM printed GROUP BY statement_id",
        "dedupe_kept": f"{_FX}{printed} SELECT statement_id, min(row_no) AS row_no, event_type || ' ' || repeat('x', 40) || ' ' || min(row_no) AS description, 'R' || (row_no % 1000000000) AS reference FROM printed GROUP BY statement_id, day, event_type, row_no % 1000000000, debit, credit, balance",
        "statement_reconciled": f"{_FX}{closings}, s AS (SELECT statement_id, sum(credit - debit) FILTER (event_type <> 'error') AS moved FROM fx_bank GROUP BY ALL) SELECT statement_id, CAST(abs(coalesce(moved, 0) - closing) AS DOUBLE) AS gap, abs(coalesce(moved, 0) - closing) <= 0.5 AS reconciled FROM closings LEFT JOIN s USING (statement_id)",
        "segments_valid": f"{segments} SELECT file_id, count(*) = max(turn) + 1 AND count(DISTINCT turn) = count(*) AND max(end_page) = max(pages) AS valid, count(*) AS n_segments FROM s GROUP BY file_id",
        "merged_segments": f"""{segments}, i AS (SELECT *, greatest(count(*) FILTER (tenths >= 7) OVER (PARTITION BY file_id ORDER BY turn), CASE WHEN max(tenths) OVER (PARTITION BY file_id) >= 7 THEN 1 ELSE 0 END) AS island FROM s)
SELECT file_id, min(start_page) AS start_page, max(end_page) AS end_page, coalesce(arg_min(tenths, turn) FILTER (tenths >= 7), arg_min(tenths, turn)) / 10.0::DOUBLE AS confidence FROM i GROUP BY file_id, island""",
        "partner_numbers": "WITH l AS (SELECT s_nationkey AS tenant, max(s_suppkey * 2) AS last FROM supplier WHERE s_suppkey % 3 <> 0 GROUP BY ALL) SELECT s_nationkey AS tenant, s_suppkey AS partner_id, 'FURN' || printf('%05d', coalesce(last, 0) + row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)) AS number FROM supplier LEFT JOIN l ON tenant = s_nationkey WHERE s_suppkey % 3 = 0",
        "contract_numbers": "WITH o AS (SELECT o_custkey % 7 AS tenant, CASE WHEN o_custkey % 2 = 0 THEN 'A' ELSE 'B' END AS series, o_orderkey AS request FROM orders) SELECT tenant, series, request, 'CV-' || printf('%05d', CASE series WHEN 'A' THEN 41 ELSE 0 END + row_number() OVER (PARTITION BY tenant, series ORDER BY request)) AS number FROM o",
        "stuck_uploads": f"{uploads} SELECT upload_id, CASE WHEN retries + 1 >= 3 THEN 'ERROR' ELSE 'QUEUED' END AS status, CAST(retries + 1 AS BIGINT) AS retries FROM u WHERE status = 'PROCESSING' AND started < TIMESTAMP '{NOW}' - INTERVAL 10 MINUTE",
        "retries_due": f"{uploads} SELECT upload_id, retries FROM u WHERE status = 'ERROR' AND retries < 3 AND epoch(TIMESTAMP '{NOW}') - floor(epoch(started)) >= 5 * CASE retries WHEN 2 THEN 2 ELSE 1 END",
        "processing_durations": "SELECT user_id AS upload_id, event_id, event_type AS step, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ms FROM events",
        "export_split": f"{dated} SELECT * FROM split",
        "export_manifest": f"{dated} SELECT type, count(*) FILTER (reason IS NULL) AS n_exported, count(reason) AS n_excluded, count(*) FILTER (reason IS NULL) > 0 AS included FROM split WHERE type <> 'Collection Disposition' GROUP BY type",
        "export_periods": f"{_FX}, p AS (SELECT unnest(['month', 'quarter', 'year']) AS preset, document_date FROM fx_documents), b AS (SELECT preset, CAST(date_trunc(preset, document_date) AS DATE) AS first_day FROM p) SELECT preset, first_day, CAST(first_day + CASE preset WHEN 'month' THEN INTERVAL 1 MONTH WHEN 'quarter' THEN INTERVAL 3 MONTH ELSE INTERVAL 12 MONTH END - INTERVAL 1 DAY AS DATE) AS last_day, count(*) AS n_documents FROM b GROUP BY ALL",
        "due_kpis": f"{dated} SELECT currency, count(*) FILTER (due_date < DATE '{AS_OF}') AS overdue, count(*) FILTER (due_date BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 7) AS due_soon, CAST(sum(CAST(floor(o_totalprice * 100 + 0.5::DOUBLE) / 100 AS DECIMAL(14,2))) AS DOUBLE) AS total FROM dated JOIN orders ON o_orderkey = document_id WHERE type = 'Invoice' GROUP BY currency",
        "stock_kpis": f"{_FX}, v AS (SELECT p_partkey % 5 AS tenant, count(*) FILTER (p_size % 8 IN (4, 5)) AS in_stock, count(*) FILTER (p_size % 8 IN (2, 3)) AS in_transit, count(*) FILTER (p_size % 8 = 6) AS sold FROM part GROUP BY ALL), d AS (SELECT partner_id % 6 AS tenant, count(*) FILTER (review_status <> 'APPROVED') AS to_review FROM fx_documents GROUP BY ALL) SELECT tenant, coalesce(in_stock, 0) AS in_stock, coalesce(in_transit, 0) AS in_transit, coalesce(sold, 0) AS sold, coalesce(to_review, 0) AS to_review FROM v FULL JOIN d USING (tenant)",
        "top_empty_fields": f"{metrics}, f AS ({' UNION ALL '.join(f"SELECT phase, document_type, '{f}' AS field FROM m WHERE k % {n} = 0" for f, n in fields)}), c AS (SELECT *, count(*) AS n FROM f GROUP BY ALL) SELECT phase, document_type, field, n, CAST(row_number() OVER (PARTITION BY phase, document_type ORDER BY n DESC, field) AS INTEGER) AS rank FROM c QUALIFY rank <= 5",
        "token_usage": f"{usage} SELECT function, phase, document_id, calls, tokens, cost FROM usage",
        "top_consumers": f"{usage} {top('function', 10)} UNION ALL {top('phase', 5)} UNION ALL {top('document_id', 5)}",
        "window_metrics": f"{metrics} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, phase, document_type, count(*) AS n, count(*) FILTER (success) AS n_success, CAST(max(duration) AS DOUBLE) AS longest FROM m GROUP BY ALL",
        "ledger_page": f"{_JOURNAL} SELECT document_date, posting_key, account, CAST(debit AS DOUBLE) AS debit, CAST(credit AS DOUBLE) AS credit FROM journal ORDER BY document_date DESC, posting_key DESC LIMIT 200 OFFSET 400",
        "duplicate_documents": f"""{_FX}, o AS (SELECT document_id, type, currency, partner_id, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, document_date, partner_id || '-' || document_id AS number, 'NORD' || partner_id % 5 || ' SUD' || partner_id % 7 || ' EST' || partner_id % 11 AS name, document_id // 37 % 5 AS kind FROM fx_documents JOIN orders ON o_orderkey = document_id),
every AS (SELECT * FROM o UNION ALL SELECT document_id + 100000000, type, currency, CASE WHEN kind <> 3 OR document_id % 2 = 0 THEN partner_id END, cents + CASE WHEN kind IN (1, 4) THEN 50 ELSE 0 END, document_date + CASE kind WHEN 2 THEN 3 ELSE 0 END, CASE WHEN kind < 3 THEN number WHEN kind = 4 THEN number || 'B' END, name || CASE kind WHEN 3 THEN ' GRUP' ELSE '' END, kind FROM o WHERE document_id % 37 = 0),
c AS (SELECT type, number, cents, document_date, partner_id, currency, name, min(document_id) AS id, count(*) AS copies FROM every GROUP BY ALL),
met AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.type = b.type AND a.number = b.number AND a.id < b.id UNION SELECT a.id, b.id FROM c a JOIN c b ON a.type = b.type AND a.cents = b.cents AND a.id < b.id UNION SELECT a.id, b.id FROM c a JOIN c b ON a.type = b.type AND a.partner_id = b.partner_id AND a.document_date = b.document_date AND a.id < b.id),
p AS (SELECT a.id AS a, b.id AS b, a.type, a.copies AS a_copies, b.copies AS b_copies, coalesce(a.number = b.number, false) AS sn, a.cents = b.cents AS sc, abs(a.cents - b.cents) < 100 AS nc, a.document_date = b.document_date AS sd, abs(a.document_date - b.document_date) <= 7 AS nd, coalesce(a.partner_id = b.partner_id, false) AND a.type IN ('Invoice', 'Receipt') AS sp,
  a.type IN ('Invoice', 'Receipt') AND (contains(a.name, b.name) OR contains(b.name, a.name) OR len(list_intersect(string_split(a.name, ' '), string_split(b.name, ' '))) >= 2 AND len(list_intersect(string_split(a.name, ' '), string_split(b.name, ' '))) * 10 >= 6 * least(len(string_split(a.name, ' ')), len(string_split(b.name, ' ')))) AS sm, a.currency = b.currency AS su FROM met JOIN c a ON a.id = met.a JOIN c b ON b.id = met.b),
s AS (SELECT *, least(1000, CASE WHEN sn THEN CASE type WHEN 'Invoice' THEN 500 ELSE 400 END ELSE 0 END + CASE WHEN sc THEN 300 WHEN nc THEN 150 ELSE 0 END + CASE WHEN sd THEN 150 WHEN type <> 'Invoice' AND nd THEN 50 ELSE 0 END + CASE WHEN sp THEN 150 WHEN sm THEN 105 ELSE 0 END + CASE WHEN su THEN 50 ELSE 0 END
  + CASE WHEN type = 'Invoice' AND sn::INT + sc::INT + sd::INT + (sp OR sm)::INT + su::INT >= 3 THEN 100 ELSE 0 END) AS points FROM p)
SELECT a, b, points / 1000.0::DOUBLE AS score, CASE WHEN points >= 850 THEN 'high' WHEN points >= 700 THEN 'medium' ELSE 'low' END AS band, a_copies, b_copies FROM s WHERE points >= 600""",
    }
