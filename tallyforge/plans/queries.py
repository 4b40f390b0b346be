"""The registered accounting queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks, money, normalise
from ..operators import bank, ledger, monitor, rates, stock
from ..sources import driver_tables as src
from ..sources.driver_tables import table
from . import account_queries, document_queries, export_queries, field_queries, line_queries, partner_queries, scan_queries, text_queries, upload_queries, vehicle_queries, work_queries

MORE = (account_queries, document_queries, export_queries, field_queries, line_queries, partner_queries, scan_queries, text_queries, upload_queries, vehicle_queries, work_queries)


def _rated(spark, sf_dir):
    return rates.rates_as_of(src.posting_documents(spark, sf_dir), src.rates(spark, sf_dir))


def _balanced(spark, sf_dir):
    return ledger.balanced_entries(ledger.draft_entries(_rated(spark, sf_dir), src.posting_lines(spark, sf_dir)))


def _journal(spark, sf_dir):
    return ledger.journal(_rated(spark, sf_dir), src.posting_lines(spark, sf_dir))


def trial_balance(spark, sf_dir):
    return ledger.balances(_journal(spark, sf_dir), "account")


def journal_totals(spark, sf_dir):
    return ledger.balances(_journal(spark, sf_dir), "document_id")


def ledger_summary(spark, sf_dir):
    return ledger.balances(_journal(spark, sf_dir).withColumn("month", F.date_format("document_date", "yyyy-MM")), "account", "month")


def ledger_by_prefix(spark, sf_dir):
    docs = _rated(spark, sf_dir).where("document_date between date'1995-01-01' and date'1996-12-31'")
    return ledger.balances(ledger.journal(docs, src.posting_lines(spark, sf_dir)).where(F.col("account").startswith("44")), "account", "document_date")


def line_totals(spark, sf_dir):
    return ledger.line_totals(src.lines(spark, sf_dir))


def vat_breakdown(spark, sf_dir):
    return ledger.vat_breakdown(src.lines(spark, sf_dir), src.documents(spark, sf_dir))


def fx_as_of(spark, sf_dir):
    return rates.rates_as_of(src.documents(spark, sf_dir).select("document_id", "currency", "document_date"), src.rates(spark, sf_dir))


def posting_status(spark, sf_dir):
    return ledger.posting_status(_balanced(spark, sf_dir))


def posting_messages(spark, sf_dir):
    return ledger.posting_messages(_balanced(spark, sf_dir))


def posting_keys(spark, sf_dir):
    return _journal(spark, sf_dir).select("posting_key", "account", F.col("debit").cast("double").alias("debit"), F.col("credit").cast("double").alias("credit"))


def day_turnover(spark, sf_dir):
    return bank.day_turnover(src.bank_rows(spark, sf_dir))


def statement_summary(spark, sf_dir):
    return bank.statement_summary(src.bank_rows(spark, sf_dir))


def statement_gap(spark, sf_dir):
    rows = src.bank_rows(spark, sf_dir)
    printed = rows.where("event_type <> 'error'").groupBy("statement_id").agg(F.sum(F.col("credit") - F.col("debit")).alias("closing"))
    return bank.statement_gap(rows, printed.withColumn("opening", F.lit(0)))


def dedupe_transactions(spark, sf_dir):
    return bank.first_of_repeated(src.bank_rows(spark, sf_dir))


def _vehicle_costs(spark, sf_dir):
    return stock.vehicle_costs(rates.rates_as_of(src.documents(spark, sf_dir), src.rates(spark, sf_dir)), src.lines(spark, sf_dir))


def vehicle_costs(spark, sf_dir):
    return _vehicle_costs(spark, sf_dir).withColumn("amount", F.col("amount").cast("double"))


def landed_cost(spark, sf_dir):
    price = money.round2(F.col("p_retailprice"))
    vehicles = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vehicle_id"), price.alias("price"), (price * 2).alias("sold_price"))
    return stock.landed_cost(vehicles, _vehicle_costs(spark, sf_dir))


def in_transit_without_code(spark, sf_dir):
    confirmed = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F' and l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").where("p_size % 8 in (2, 3)").select("p_partkey", "p_size").join(confirmed, "p_partkey", "left_anti")


def document_kpis(spark, sf_dir):
    return monitor.document_kpis(src.documents(spark, sf_dir))


def metrics_report(spark, sf_dir):
    metrics = table(spark, sf_dir, "events").select((F.col("event_id") % 2).alias("phase"), F.col("event_type").alias("document_type"), (F.col("event_type") != "error").alias("success"), money.round2(F.col("value")).alias("duration"), (F.get_json_object("props", "$.k").cast("int") % 3).alias("retry_count"))
    return monitor.metrics_report(metrics)


def hash_duplicates(spark, sf_dir):
    return monitor.hash_duplicates(table(spark, sf_dir, "documents"))


def check_tax_id(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").select(F.lit("client").alias("role"), F.col("c_custkey").alias("id"), F.concat(F.lit("ro "), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("raw"))
    ids = ids.unionByName(table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("role"), F.col("s_suppkey").alias("id"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("raw")))
    key = money.tax_id_key(F.col("raw"))
    return ids.select("role", "id", key.alias("tax_id"), checks.tax_id_valid(F.col("raw")).alias("valid"))


def partner_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", normalise.company_name_key(F.col("c_name")).alias("name_key"), money.reference_key(F.substring_index("c_name", "#", -1)).alias("reference_key"))


def text_quality(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", money.glued_numbers(F.col("text")).alias("glued"))


def open_items(spark, sf_dir):
    """Outstanding amount by partner, direction and currency: invoices less dispositions of the same partner."""
    docs = src.documents(spark, sf_dir).where("type <> 'Receipt'").select("document_id", "partner_id", "direction", "currency", F.when(F.col("type") == "Invoice", 1).otherwise(-1).alias("sign"))
    met = src.lines(spark, sf_dir).join(docs, "document_id")
    return met.groupBy("partner_id", "direction", "currency").agg(F.sum((F.col("net") + F.col("vat")) * F.col("sign")).cast("double").alias("outstanding"), F.countDistinct("document_id").alias("n_documents"))


NAMES = (posting_status, posting_messages, posting_keys, trial_balance, journal_totals, ledger_summary, ledger_by_prefix, line_totals, vat_breakdown, fx_as_of, day_turnover, statement_summary, statement_gap, dedupe_transactions, vehicle_costs, landed_cost, in_transit_without_code, document_kpis, metrics_report, hash_duplicates, check_tax_id, partner_keys, text_quality, open_items)


def queries():
    return {f.__name__: f for part in (NAMES, *(m.NAMES for m in MORE)) for f in part}


_FX = """
WITH fx_documents AS (
  SELECT o_orderkey AS document_id, o_custkey AS partner_id,
         CASE WHEN o_orderkey % 10 < 6 THEN 'Invoice' WHEN o_orderkey % 10 < 8 THEN 'Receipt' WHEN o_orderkey % 10 = 8 THEN 'Payment Disposition' ELSE 'Collection Disposition' END AS type,
         CASE WHEN o_custkey % 2 = 0 THEN 'incoming' ELSE 'outgoing' END AS direction,
         CASE o_orderkey % 7 WHEN 0 THEN 'EUR' WHEN 1 THEN 'HUF' ELSE 'RON' END AS currency,
         CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'O' THEN 'PENDING_APPROVAL' ELSE 'REOPENED' END AS review_status,
         CAST(o_orderdate AS DATE) AS document_date
  FROM orders
), raw_lines AS (
  SELECT *, CASE WHEN l_returnflag = 'R' THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * floor(l_extendedprice * (1 - l_discount) * 100 + 0.5::DOUBLE) / 100 AS net_raw FROM lineitem
), fx_lines0 AS (
  SELECT l_orderkey AS document_id, l_partkey AS vehicle_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, CAST(net_raw AS DECIMAL(14,2)) AS net,
         CAST(floor(net_raw * l_tax * 100 + 0.5::DOUBLE) / 100 AS DECIMAL(14,2)) AS vat,
         CAST(round(l_tax * 100) AS INTEGER) AS vat_rate,
         CASE l_returnflag WHEN 'A' THEN 'FULL' WHEN 'N' THEN 'PARTIAL_50' ELSE 'NONE' END AS deductibility,
         CASE l_partkey % 4 WHEN 0 THEN '371' WHEN 1 THEN '624' WHEN 2 THEN '628' ELSE '6022' END AS account
  FROM raw_lines
), fx_lines AS (
  SELECT *, CAST(CASE deductibility WHEN 'FULL' THEN 0 WHEN 'PARTIAL_50' THEN vat - CAST(floor((CAST(vat * 100 AS BIGINT) + 1) / 2.0::DOUBLE) / 100 AS DECIMAL(14,2)) ELSE vat END AS DECIMAL(14,2)) AS cost FROM fx_lines0
), fx_bank AS (
  SELECT user_id AS statement_id, event_id AS row_no, ts, CAST(ts AS DATE) AS day, event_type,
         CASE WHEN event_type IN ('purchase', 'error') THEN CAST(floor(value * 100 + 0.5::DOUBLE) / 100 AS DECIMAL(14,2)) ELSE 0::DECIMAL(14,2) END AS debit,
         CASE WHEN event_type IN ('purchase', 'error') THEN 0::DECIMAL(14,2) ELSE CAST(floor(value * 100 + 0.5::DOUBLE) / 100 AS DECIMAL(14,2)) END AS credit
  FROM events
)"""
_M = "floor((({}) * rate + 2.220446049250313e-16::DOUBLE) * 100 + 0.5::DOUBLE) / 100"
_JOURNAL = _FX + f""", published AS (
  SELECT DISTINCT currency, CAST(date_trunc('month', document_date) AS DATE) AS rate_date,
         CASE currency WHEN 'EUR' THEN 4.5::DOUBLE + month(document_date)::DOUBLE / 16 ELSE (1.25::DOUBLE + month(document_date)::DOUBLE / 64) / 100 END AS rate
  FROM fx_documents WHERE currency <> 'RON' AND month(document_date) % 3 = 1
), stated AS (
  SELECT d.document_id, d.currency, d.document_date, d.direction, d.review_status, k, k % 10 AS r,
         CASE WHEN k % 10 = 9 THEN 'Collection Disposition' WHEN k % 10 = 8 THEN 'Payment Disposition' WHEN k % 10 > 5 THEN 'Receipt' WHEN k % 10 = 5 AND partner_id % 4 = 0 THEN 'Contract' ELSE 'Invoice' END AS type,
         k % 101 = 0 AS unnamed, CAST(floor(o_totalprice * 100 + 0.5::DOUBLE) / 100 AS DECIMAL(14,2)) AS total, k % 11 = 0 AS ahead, k % 4 = 2 AS receipt_of_payment, k % 3 = 0 AS at_bank,
         CASE WHEN k % 97 = 0 THEN 'cash' WHEN k % 5 = 3 THEN '542' END AS account_code, k % 13 = 0 AS reversed, partner_id % 5 <> 0 AS payer, CASE WHEN k % 10 >= 6 THEN CASE k % 9 WHEN 0 THEN 'incoming' WHEN 1 THEN 'outgoing' END END AS ref_direction
  FROM (SELECT *, document_id AS k FROM fx_documents) d JOIN orders ON o_orderkey = document_id
), rated AS (
  SELECT d.*, CAST(floor(CAST(d.total AS DOUBLE) * 19 / 119 * 100 + 0.5::DOUBLE) / 100 AS DECIMAL(14,2)) AS vat, CASE d.currency WHEN 'RON' THEN 1.0::DOUBLE ELSE p.rate END AS rate
  FROM stated d ASOF LEFT JOIN published p ON d.currency = p.currency AND d.document_date >= p.rate_date WHERE d.review_status = 'APPROVED'
), sums AS (SELECT document_id, count(*) AS n, sum(net) AS net, sum(vat) AS vat FROM fx_lines GROUP BY ALL), heads AS (
  SELECT d.document_id, d.type, d.document_date, d.rate, d.unnamed, d.ahead, d.account_code, d.reversed, d.payer, d.ref_direction, d.direction, coalesce(s.n, 0) AS n,
         CAST(coalesce(s.net, d.total - d.vat) AS DOUBLE) AS doc_net, CAST(coalesce(s.vat, d.vat) AS DOUBLE) AS doc_vat, CAST(coalesce(s.net + s.vat, d.total) AS DOUBLE) AS total,
         CASE WHEN at_bank THEN CASE WHEN currency <> 'RON' THEN '5124' ELSE '5121' END ELSE '5311' END AS liquid,
         type = 'Receipt' AND (receipt_of_payment OR ref_direction IS NOT NULL) AS paid, CASE WHEN type = 'Receipt' AND (receipt_of_payment OR ref_direction IS NOT NULL) THEN coalesce(ref_direction, direction) ELSE direction END AS way
  FROM rated d LEFT JOIN sums s USING (document_id)
), body AS (
  SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS i, CAST(net AS DOUBLE) AS net, CAST(vat AS DOUBLE) AS vat, deductibility, vat_rate,
         CASE WHEN l_partkey % 20 = 19 THEN '704' WHEN l_partkey % 997 = 0 THEN '37x' WHEN l_partkey % 5 <> 0 THEN account END AS account FROM fx_lines
  UNION ALL SELECT document_id, 1, doc_net, doc_vat, 'FULL', NULL, CASE type WHEN 'Receipt' THEN account_code END FROM heads WHERE n = 0
), taxed AS (
  SELECT h.*, b.i, b.net, b.vat AS own, b.account, b.vat_rate, b.deductibility, CASE WHEN b.vat <> 0 THEN b.vat WHEN doc_vat > 0 AND doc_net > 0 THEN doc_vat * b.net / doc_net ELSE 0.0::DOUBLE END AS line_vat FROM body b JOIN heads h USING (document_id)
), parted AS (
  SELECT *, CASE WHEN NOT payer THEN 0.0::DOUBLE WHEN deductibility = 'FULL' THEN line_vat WHEN deductibility = 'PARTIAL_50' THEN line_vat / 2 ELSE 0.0::DOUBLE END AS part FROM taxed
), totals AS (
  SELECT *, CASE WHEN reversed AND payer AND type = 'Invoice' THEN CASE WHEN doc_vat <> 0 THEN doc_vat ELSE doc_net * coalesce(first_rate, 21) / 100 END END AS reverse_vat
  FROM (SELECT document_id, CAST(sum(CAST(part AS DECIMAL(18,6))) AS DOUBLE) AS ded, arg_min(vat_rate, i) FILTER (vat_rate > 0) AS first_rate, bool_or(account IS NOT NULL AND NOT regexp_full_match(account, '[0-9]{{3,4}}([.][0-9]{{1,10}})?')) AS odd, bool_or(account IS NULL) AS bare FROM parted GROUP BY document_id) JOIN heads USING (document_id)
), sold AS (SELECT document_id, type IN ('Invoice', 'Receipt') AND NOT paid AS trade FROM heads), signed AS (
  SELECT document_id, 0 AS idx, CASE WHEN type = 'Receipt' THEN liquid WHEN way = 'incoming' THEN '401' ELSE '411' END AS account, CASE WHEN way = 'incoming' THEN -1 ELSE 1 END * ({_M.format('total')}) AS amount FROM heads JOIN sold USING (document_id) WHERE trade
  UNION ALL SELECT document_id, i, CASE WHEN way = 'incoming' THEN CASE WHEN ahead THEN '409' ELSE coalesce(account, '628') END WHEN ahead THEN '419' WHEN account[1] IN ('4', '7') THEN account ELSE '707' END,
    CASE WHEN way = 'incoming' THEN {_M.format('net + line_vat - part')} ELSE -({_M.format('CASE WHEN payer THEN net ELSE net + own END')}) END FROM parted JOIN sold USING (document_id) WHERE trade
  UNION ALL SELECT document_id, 1000000, '4426', {_M.format('ded')} FROM totals JOIN sold USING (document_id) WHERE trade AND way = 'incoming' AND ded > 0
  UNION ALL SELECT document_id, 1000001, '4426', {_M.format('reverse_vat')} FROM totals JOIN sold USING (document_id) WHERE trade AND way = 'incoming' AND reverse_vat IS NOT NULL
  UNION ALL SELECT document_id, 1000002, '4427', -({_M.format('reverse_vat')}) FROM totals JOIN sold USING (document_id) WHERE trade AND way = 'incoming' AND reverse_vat IS NOT NULL
  UNION ALL SELECT document_id, 1000003, '4427', -({_M.format('doc_vat')}) FROM heads JOIN sold USING (document_id) WHERE trade AND way = 'outgoing' AND payer AND doc_vat > 0
  UNION ALL SELECT document_id, k, CASE WHEN way = 'incoming' THEN CASE k WHEN 0 THEN '401' ELSE liquid END ELSE CASE k WHEN 0 THEN liquid ELSE '411' END END, (1 - 2 * k) * ({_M.format('total')}) FROM heads, (SELECT unnest([0, 1]) AS k) WHERE paid
  UNION ALL SELECT document_id, i, coalesce(account, '371'), {_M.format('net + own')} FROM parted WHERE type = 'Contract'
  UNION ALL SELECT document_id, 1000000, '462', -({_M.format('total')}) FROM heads WHERE type = 'Contract'
  UNION ALL SELECT document_id, k, CASE WHEN (type LIKE 'Pay%') = (k = 1) THEN '5311' ELSE CASE WHEN ref_direction IS NOT NULL THEN CASE WHEN type LIKE 'Pay%' THEN '401' ELSE '411' END ELSE coalesce(account_code, CASE WHEN type LIKE 'Pay%' THEN CASE WHEN ahead THEN '409' ELSE '401' END ELSE CASE WHEN ahead THEN '419' ELSE '411' END END) END END, (1 - 2 * k) * ({_M.format('total')}) FROM heads, (SELECT unnest([0, 1]) AS k) WHERE type LIKE '%Disposition'
), sided AS (SELECT document_id, idx, account, CAST(amount AS DECIMAL(14,2)) AS amount FROM signed), gaps AS (
  SELECT *, sum(amount) OVER (PARTITION BY document_id) AS gap, NOT regexp_matches(account, '^(401|404|408|411|4426|4427|462|5121|5124|5311)([.]|$)') AS free FROM sided WHERE amount IS NULL OR amount <> 0
), sought AS (
  SELECT *, CASE WHEN abs(gap) <= 0.05 THEN gap ELSE 0 END AS diff, amount * CASE WHEN gap > 0 THEN 1 ELSE -1 END AS s FROM gaps
), found AS (
  SELECT *, coalesce(max(idx) FILTER (free AND s >= abs(diff)) OVER (PARTITION BY document_id), max(idx) FILTER (free AND s < 0) OVER (PARTITION BY document_id)) AS borne FROM sought
), evened AS (SELECT document_id, idx, account, gap - CASE WHEN borne IS NULL THEN 0 ELSE diff END AS rest, amount - CASE WHEN idx = borne THEN diff ELSE 0 END AS amount FROM found),
rests AS (SELECT document_id, any_value(rest) AS rest FROM evened GROUP BY document_id), judged AS (
  SELECT t.*, CASE WHEN total <= 0 THEN 'no total' END AS e1, CASE WHEN type IN ('Invoice', 'Contract') AND unnamed THEN 'no number' END AS e2, CASE WHEN trade AND n = 0 THEN 'no lines' END AS e3, CASE WHEN type = 'Contract' AND direction <> 'incoming' THEN 'not a purchase' END AS e4,
         CASE WHEN odd OR type LIKE '%Disposition' AND account_code = 'cash' THEN 'bad account' END AS e5, CASE WHEN rate IS NULL THEN 'no rate' END AS l1, CASE WHEN abs(rest) > 0.01 THEN 'unbalanced' END AS l2
  FROM totals t JOIN sold USING (document_id) LEFT JOIN rests USING (document_id)
), judgement AS (
  SELECT *, CASE WHEN coalesce(e1, e2, e3, e4, e5) IS NULL THEN list_filter([l1, l2], lambda x: x IS NOT NULL) ELSE list_filter([e1, e2, e3, e4, e5], lambda x: x IS NOT NULL) END AS errors,
         list_filter([CASE WHEN paid AND ref_direction IS NULL THEN 'payment without its invoice' END, CASE WHEN n > 0 AND bare THEN 'lines without account' END], lambda x: x IS NOT NULL) AS warnings FROM judged
), journal AS (
  SELECT document_id, document_date, account, CAST(greatest(amount, 0) AS DECIMAL(14,2)) AS debit, CAST(greatest(-amount, 0) AS DECIMAL(14,2)) AS credit,
         'DOC:' || document_id || ':' || CASE WHEN type = 'Contract' THEN 'CONTRACT_PURCHASE' WHEN type IN ('Invoice', 'Receipt') THEN upper(type) || CASE way WHEN 'incoming' THEN '_IN' ELSE '_OUT' END ELSE upper(replace(type, ' ', '_')) END
         || ':' || document_date || ':' || (row_number() OVER (PARTITION BY document_id ORDER BY idx) - 1) AS posting_key FROM evened JOIN judgement USING (document_id) WHERE len(errors) = 0
)"""
_SUMS = "CAST(sum(debit) AS DOUBLE) AS debit, CAST(sum(credit) AS DOUBLE) AS credit, CAST(sum(debit) - sum(credit) AS DOUBLE) AS balance, count(*) AS n_entries FROM journal"
_COSTS = """, costs_published AS (
  SELECT DISTINCT currency, CAST(date_trunc('month', document_date) AS DATE) AS rate_date,
         CASE currency WHEN 'EUR' THEN 4.5::DOUBLE + month(document_date)::DOUBLE / 16 ELSE (1.25::DOUBLE + month(document_date)::DOUBLE / 64) / 100 END AS rate
  FROM fx_documents WHERE currency <> 'RON' AND month(document_date) % 3 = 1
), costs_rated AS (
  SELECT document_id, CASE d.currency WHEN 'RON' THEN 1.0::DOUBLE ELSE p.rate END AS rate FROM fx_documents d ASOF LEFT JOIN costs_published p ON d.currency = p.currency AND d.document_date >= p.rate_date
  WHERE d.direction = 'incoming' AND d.type IN ('Invoice', 'Receipt')
), costs AS (
  SELECT vehicle_id, category, coalesce(sum(ron), 0) AS amount, count(*) FILTER (ron IS NULL) AS n_unrated FROM (
    SELECT vehicle_id, CASE account WHEN '624' THEN 'TRANSPORT' WHEN '6022' THEN 'FUEL' ELSE 'OTHER' END AS category, CAST(floor((CAST(net + cost AS DOUBLE) * rate + 2.220446049250313e-16::DOUBLE) * 100 + 0.5::DOUBLE) / 100 AS DECIMAL(14,2)) AS ron
    FROM fx_lines JOIN costs_rated USING (document_id) WHERE account <> '371')
  GROUP BY ALL HAVING abs(coalesce(sum(ron), 0)) >= 0.004 OR count(*) FILTER (ron IS NULL) > 0
)"""
_TAX = "regexp_replace(regexp_replace(upper(trim(raw)), '^RO', ''), '[^A-Z0-9]', '', 'g')"


def oracle_sql():
    out = _own_sql()
    for m in MORE:
        out |= m.oracle_sql()
    return out


def _own_sql():
    weights = " + ".join(f"CAST(substr(lpad(left(tax_id, length(tax_id) - 1), 9, '0'), {i + 1}, 1) AS INTEGER) * {w}" for i, w in enumerate(money.TAX_ID_WEIGHTS))
    return {
        "posting_status": f"{_JOURNAL}, made AS (SELECT document_id, count(*) AS c FROM journal GROUP BY ALL) SELECT document_id, CASE WHEN len(errors) > 0 THEN 'ERROR' WHEN c > 0 THEN 'POSTED' ELSE 'NONE' END AS status, errors[1] AS error, coalesce(c, 0) AS n_entries FROM judgement LEFT JOIN made USING (document_id)",
        "posting_messages": f"{_JOURNAL} SELECT DISTINCT document_id, 'error' AS kind, unnest(errors) AS message FROM judgement UNION ALL SELECT document_id, 'warning', unnest(warnings) FROM judgement",
        "posting_keys": f"{_JOURNAL} SELECT posting_key, account, CAST(debit AS DOUBLE) AS debit, CAST(credit AS DOUBLE) AS credit FROM journal",
        "trial_balance": f"{_JOURNAL} SELECT account, {_SUMS} GROUP BY account",
        "journal_totals": f"{_JOURNAL} SELECT document_id, {_SUMS} GROUP BY document_id",
        "ledger_summary": f"{_JOURNAL} SELECT account, strftime(document_date, '%Y-%m') AS month, {_SUMS} GROUP BY ALL",
        "ledger_by_prefix": f"{_JOURNAL} SELECT account, document_date, {_SUMS} WHERE account LIKE '44%' AND document_date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' GROUP BY ALL",
        "line_totals": f"{_FX} SELECT document_id, CAST(sum(net) AS DOUBLE) AS net, CAST(sum(vat) AS DOUBLE) AS vat, CAST(sum(net + vat) AS DOUBLE) AS total, count(*) AS n_lines FROM fx_lines GROUP BY document_id",
        "vat_breakdown": f"{_FX} SELECT currency, vat_rate, deductibility, CAST(sum(net) AS DOUBLE) AS net, CAST(sum(vat) AS DOUBLE) AS vat, CAST(sum(cost) AS DOUBLE) AS non_deductible FROM fx_lines JOIN fx_documents USING (document_id) GROUP BY ALL",
        "fx_as_of": f"""{_FX}, rates AS (
  SELECT DISTINCT currency, CAST(date_trunc('month', document_date) AS DATE) AS rate_date,
         CASE currency WHEN 'EUR' THEN 4.5::DOUBLE + month(document_date)::DOUBLE / 16 ELSE (1.25::DOUBLE + month(document_date)::DOUBLE / 64) / 100 END AS rate
  FROM fx_documents WHERE currency <> 'RON' AND month(document_date) % 3 = 1
) SELECT d.document_id, d.currency, d.document_date, CASE d.currency WHEN 'RON' THEN 1.0::DOUBLE ELSE r.rate END AS rate, r.rate_date
FROM fx_documents d ASOF LEFT JOIN rates r ON d.currency = r.currency AND d.document_date >= r.rate_date""",
        "day_turnover": f"{_FX} SELECT statement_id, day, CAST(sum(debit) AS DOUBLE) AS debit, CAST(sum(credit) AS DOUBLE) AS credit, count(*) AS n_rows FROM fx_bank GROUP BY ALL",
        "statement_summary": f"{_FX} SELECT statement_id, count(*) AS n_rows, CAST(sum(debit) AS DOUBLE) AS debit, CAST(sum(credit) AS DOUBLE) AS credit, CAST(sum(credit - debit) AS DOUBLE) AS closing, min(day) AS first_day, max(day) AS last_day, count(*) FILTER (debit > 0) AS n_debits FROM fx_bank GROUP BY ALL",
        "statement_gap": f"{_FX} SELECT statement_id, CAST(abs(sum(credit - debit) - sum(credit - debit) FILTER (event_type <> 'error')) AS DOUBLE) AS gap FROM fx_bank GROUP BY ALL HAVING count(*) FILTER (event_type <> 'error') > 0",
        "dedupe_transactions": f"{_FX} SELECT statement_id, day, event_type, CAST(debit AS DOUBLE) AS debit, CAST(credit AS DOUBLE) AS credit, min(row_no) AS row_no, count(*) AS n_same FROM fx_bank GROUP BY statement_id, day, event_type, fx_bank.debit, fx_bank.credit",
        "vehicle_costs": f"{_FX}{_COSTS} SELECT vehicle_id, category, CAST(amount AS DOUBLE) AS amount, n_unrated FROM costs",
        "landed_cost": f"""{_FX}{_COSTS}, v AS (SELECT p_partkey AS vehicle_id, CAST(floor(p_retailprice * 100 + 0.5::DOUBLE) / 100 AS DECIMAL(14,2)) AS price FROM part),
s AS (SELECT vehicle_id, sum(amount) AS costs FROM costs GROUP BY ALL)
SELECT v.vehicle_id, CAST(coalesce(s.costs, 0) AS DOUBLE) AS costs, CAST(price + coalesce(s.costs, 0) AS DOUBLE) AS landed_cost, CAST(price - coalesce(s.costs, 0) AS DOUBLE) AS margin, round(100 * CAST(price - coalesce(s.costs, 0) AS DOUBLE) / nullif(CAST(price + coalesce(s.costs, 0) AS DOUBLE), 0), 4) AS margin_percent FROM v LEFT JOIN s USING (vehicle_id)""",
        "in_transit_without_code": "SELECT p_partkey, p_size FROM part WHERE p_size % 8 IN (2, 3) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linestatus = 'F' AND l_quantity >= 49 AND l_partkey IS NOT NULL)",
        "document_kpis": f"{_FX} SELECT type, review_status, count(*) AS n_documents, count(DISTINCT partner_id) AS n_partners, max(document_date) AS newest FROM fx_documents GROUP BY ALL",
        "metrics_report": """SELECT event_id % 2 AS phase, event_type AS document_type, count(*) AS n, count(*) FILTER (event_type <> 'error') AS n_success,
count(*) FILTER (CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 > 0) AS n_retried,
CAST(sum(CAST(floor(value * 100 + 0.5::DOUBLE) / 100 AS DECIMAL(14,2))) AS DOUBLE) AS duration_ms, CAST(max(CAST(floor(value * 100 + 0.5::DOUBLE) / 100 AS DECIMAL(14,2))) AS DOUBLE) AS longest_ms FROM events GROUP BY ALL""",
        "hash_duplicates": "SELECT sha256(text) AS digest, min(doc_id) AS first_doc, count(*) AS n_copies FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1",
        "check_tax_id": f"""WITH ids AS (SELECT 'client' AS role, c_custkey AS id, 'ro ' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS raw FROM customer
UNION ALL SELECT 'supplier', s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 8, '0') FROM supplier), k AS (SELECT role, id, {_TAX} AS tax_id FROM ids)
SELECT role, id, tax_id, CASE WHEN regexp_full_match(tax_id, '[0-9]{{2,10}}') THEN ({weights}) * 10 % 11 % 10 = CAST(right(tax_id, 1) AS INTEGER) END AS valid FROM k""",
        "partner_keys": "SELECT c_custkey, trim(regexp_replace(upper(c_name), '[^A-Z0-9]+', ' ', 'g')) AS name_key, regexp_replace(regexp_replace(upper(split_part(c_name, '#', -1)), '[^A-Z0-9]', '', 'g'), '^0+', '') AS reference_key FROM customer",
        "text_quality": "SELECT doc_id, CAST(len(regexp_extract_all(left(text, 20000), '[A-Za-z][0-9]|[0-9][A-Za-z]')) AS BIGINT) AS glued FROM documents",
        "open_items": f"{_FX} SELECT partner_id, direction, currency, CAST(sum((net + vat) * CASE type WHEN 'Invoice' THEN 1 ELSE -1 END) AS DOUBLE) AS outstanding, count(DISTINCT document_id) AS n_documents FROM fx_lines JOIN fx_documents USING (document_id) WHERE type <> 'Receipt' GROUP BY ALL",
    }
