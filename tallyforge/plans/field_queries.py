"""Queries of the normalisers and checks over fields as documents print them, derived from the plain tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks, normalise as n
from ..sources.driver_tables import table

AS_OF = "1996-06-30"


def money_fields(spark, sf_dir):
    """Amounts printed in eight ways, read by each of the money normalisers."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    whole, frac = F.expr("cents div 100").cast("string"), F.lpad((F.col("cents") % 100).cast("string"), 2, "0")
    grouped = F.concat(F.expr("cents div 100000").cast("string"), F.lit(","), F.lpad(F.expr("cents div 100 % 1000").cast("string"), 3, "0"), F.lit("."), frac)
    kind = F.col("l_partkey") % 8
    raw = F.when(kind == 0, F.concat(whole, F.lit("."), frac)).when(kind == 1, F.concat(whole, F.lit(","), frac)).when(kind == 2, F.concat(F.lit(" "), whole, F.lit(" ,"), frac, F.lit(" lei"))).when(kind == 3, F.concat(F.lit("("), whole, F.lit(","), frac, F.lit(")"))).when(kind == 4, F.concat(F.lit("−"), whole, F.lit("."), frac)).when(kind == 5, "n/a").when(kind == 6, "").otherwise(grouped)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", cents.alias("cents")).withColumn("raw", raw)
    c = F.col("raw")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "cents", n.money_positive(c).alias("positive"), n.money_signed(c).alias("signed"), n.money_locale(c).alias("locale"), n.rate_positive(c).alias("rate"), n.to_ron(n.money_positive(c), F.lit(4.5)).alias("ron"))


def date_fields(spark, sf_dir):
    kind, d = F.col("o_orderkey") % 6, F.to_date("o_orderdate")
    raw = F.when(kind == 0, F.date_format(d, "yyyy-MM-dd")).when(kind == 1, F.date_format(d, "d.M.yyyy")).when(kind == 2, F.date_format(d, "dd/MM/yyyy")).when(kind == 3, F.date_format(d, "yyyy-MM-dd'T10:00:00'")).when(kind == 4, F.date_format(d, "'31-02-'yyyy")).otherwise("soon")
    printed = F.when(kind == 4, raw).otherwise(F.date_format(d, "dd-MM-yyyy"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"), printed.alias("printed"))
    parsed = n.parse_date(F.col("raw"))
    return orders.select("o_orderkey", parsed.alias("parsed_date"), n.format_dmy(parsed).alias("dmy"), checks.date_valid(F.col("printed"), F.lit(AS_OF).cast("date")).alias("past"), checks.date_valid(F.col("printed")).alias("possible"))


def code_fields(spark, sf_dir):
    """Small enumerations and codes, by the part's number."""
    k = F.col("p_partkey")
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    p = table(spark, sf_dir, "part").select("p_partkey", pick("LEI", " euro ", "€", "", None, "usd", "Leu").alias("currency"), pick("romania", "România", "ROU", "", None, "de").alias("country"), pick("Intrare", "sale", "x", None, "purchase", "").alias("direction"), pick("PERSON", "persoană_fizică", "firm", None).alias("kind"), pick("cui", "", None, "foreign_id", "x").alias("identifier"), pick("Card", "cash", "", "OP 5121", None, "transfer bancar").alias("method"), pick("N50", "i", "full", None, "PARTIAL_50").alias("deductibility"), pick("Da", "1", "no", None, "TRUE").alias("flag"), pick("payment_receipt", "independent_receipt", "x", None).alias("receipt"), (k % 9 == 0).alias("refs"), pick("00012", "401.00012", "401", "", None).alias("analytic"), pick("000123.0", "ab-1", "0", " 00x ", "12").alias("code"), pick("A", "B", "C").alias("vendor"), pick("B", "A", "C", "A").alias("buyer"), pick("628", "624.01", "", "371").alias("account"), pick("Transport auto", "tow truck", "Tower", "ulei", "FRACHT").alias("line"), pick("VANZARE auto", "contract", "sale").alias("contract"), pick("purchase", "", None).alias("transaction"), pick("X", "").alias("vin"))
    c = F.col
    kind = n.party_kind(c("kind"))
    way = n.direction(c("direction"), c("vendor"), c("buyer"), F.lit("A"))
    return p.select("p_partkey", n.currency_code(c("currency")).alias("currency"), n.country_code(c("country")).alias("country"), way.alias("direction"), kind.alias("kind"), n.identifier_type(c("identifier"), kind, c("country")).alias("identifier"), n.payment_method(c("method")).alias("method"), n.deductibility(c("deductibility")).alias("deductibility"), n.bool_of(c("flag")).alias("flag"), n.receipt_type(c("receipt"), c("refs")).alias("receipt"), n.analytic_account(F.lit("401"), c("analytic")).alias("analytic"), n.valid_account(n.analytic_account(F.lit("401"), c("analytic"))).alias("valid_account"), n.partner_code_key(c("code")).alias("code"), n.is_freight_line(c("line"), c("account")).alias("freight"), n.is_purchase_contract(c("transaction"), way, c("vin"), c("contract")).alias("purchase"))


def identifier_checks(spark, sf_dir):
    """Tax ids, IBANs, personal numbers and VINs of customers, printed in several ways, and what the checks say."""
    k, s = F.col("c_custkey"), F.col("c_custkey").cast("string")
    kind = k % 6
    tax = F.when(kind == 0, F.concat(F.lit(" ro "), s)).when(kind == 1, F.concat(F.lit("R O"), F.lpad(s, 8, "0"))).when(kind == 2, F.concat(F.lit("DE"), F.lpad(s, 9, "0"))).when(kind == 3, F.concat(F.lit("R0"), F.lpad(s, 7, "7"))).when(kind == 4, F.concat(s, F.lit("12345678901"))).otherwise(F.concat(F.lit("7-"), F.lpad(s, 6, "1")))
    iban = F.when(kind == 5, "RO12").otherwise(F.concat(F.lit("ro"), F.lpad((k % 97 + 2).cast("string"), 2, "0"), F.lit(" btrl "), F.lpad(s, 16, "0")))
    body = F.concat((k % 9 + 1).cast("string"), F.lpad((k % 100).cast("string"), 2, "0"), F.lpad((k % 13 + 1).cast("string"), 2, "0"), F.lpad((k % 31 + 1).cast("string"), 2, "0"), F.lpad((k % 100000).cast("string"), 5, "0"))
    vin = F.concat(F.when(kind == 0, "wvi").otherwise("wvw-"), F.lpad(s, 14, "z"))
    raw = table(spark, sf_dir, "customer").select("c_custkey", tax.alias("tax"), iban.alias("iban"), F.concat(body, (k % 10).cast("string")).alias("cnp"), vin.alias("vin"))
    c = F.col
    found = n.vin_or_null(c("vin"))
    return raw.select("c_custkey", n.tax_id_compare(c("tax")).alias("tax_key"), n.tax_id_strict(c("tax")).alias("tax_strict"), checks.tax_id_valid(c("tax")).alias("tax_valid"), checks.iban_valid(c("iban")).alias("iban_valid"), checks.cnp_valid(c("cnp")).alias("cnp_valid"), checks.vin_valid(n.vin_key(c("vin"))).alias("vin_valid"), n.stock_article_code(found).alias("article"), n.stock_item_name(found, F.lit(" Golf ")).alias("item"))


def name_fields(spark, sf_dir):
    """Names of suppliers as companies write them, folded to keys."""
    k = F.col("s_suppkey")
    form = F.element_at(F.array(*map(F.lit, ("Ștefan & Fiii S.R.L.", "ÎNFRĂȚIREA SA", "Müller-Größe  srl", "Œuvre d'Art PFA", "SRL Trading"))), (k % 5 + 1).cast("int"))
    named = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(form, F.when(k % 7 == 0, " II").otherwise("")).alias("name"), F.when(k % 2 == 0, "romania").alias("country"))
    return named.select("s_suppkey", n.company_name_key(F.col("name")).alias("company_key"), n.name_country_key(F.col("name"), F.col("country")).alias("name_country"), n.ascii_fold(F.col("name")).alias("folded"), n.is_summary_row(F.concat(F.when(k % 3 == 0, "TOTAL ").when(k % 3 == 1, "Șold final ").otherwise("plată "), F.col("name"))).alias("summary"))


def clamped_texts(spark, sf_dir):
    """Documents over a token budget keep their head and tail."""
    return table(spark, sf_dir, "documents").select("doc_id", n.token_budget_clamp(F.col("text")).alias("t")).select("doc_id", F.length("t").alias("length"), F.sha2("t", 256).alias("digest"))


NAMES = (money_fields, date_fields, code_fields, identifier_checks, name_fields, clamped_texts)
_R2 = "floor(({} + 2.220446049250313e-16::DOUBLE) * 100 + 0.5::DOUBLE) / 100"
_PICK = lambda key, *values: f"([{', '.join('NULL' if v is None else repr(v) for v in values)}])[CAST({key} % {len(values)} AS INTEGER) + 1]"


def oracle_sql():
    pick = lambda *v: _PICK("p_partkey", *v)
    cnp = " + ".join(f"CAST(substr(cnp, {i + 1}, 1) AS INTEGER) * {w}" for i, w in enumerate(checks.CNP_WEIGHTS))
    tax = " + ".join(f"CAST(substr(lpad(left(digits, length(digits) - 1), 9, '0'), {i + 1}, 1) AS INTEGER) * {w}" for i, w in enumerate(checks.TAX_ID_WEIGHTS))
    fold = "replace(replace(replace(replace(strip_accents(lower(name)), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'ø', 'o')"
    key = "trim(regexp_replace(upper({}), '[^A-Z0-9]+', ' ', 'g'))"
    company = key.format("replace(" + fold + ", '.', '')")
    for suffix in n.COMPANY_SUFFIXES:
        company = f"regexp_replace({company}, ' {suffix}$', '')"
    return {
        "money_fields": f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_partkey % 8 AS kind FROM lineitem),
v AS (SELECT *, CAST(cents AS DOUBLE) / 100 AS x FROM t)
SELECT l_orderkey, l_linenumber, l_partkey, cents, CASE WHEN kind < 5 THEN x ELSE 0 END AS positive,
       CASE WHEN kind < 3 THEN x WHEN kind < 5 THEN -x WHEN kind = 5 THEN 0 END AS signed, CASE WHEN kind IN (0, 1, 7) THEN x END AS locale,
       CASE WHEN kind < 5 THEN x END AS rate, CASE WHEN kind < 5 THEN {_R2.format('x * 4.5::DOUBLE')} ELSE 0 END AS ron FROM v""",
        "date_fields": f"""WITH t AS (SELECT o_orderkey, o_orderkey % 6 AS kind, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, CASE WHEN kind < 4 THEN d END AS parsed_date, CASE WHEN kind < 4 THEN strftime(d, '%d-%m-%Y') END AS dmy, kind <> 4 AND d <= DATE '{AS_OF}' AS past, kind <> 4 AS possible FROM t""",
        "code_fields": f"""WITH t AS (SELECT p_partkey, {pick("RON", "EUR", "EUR", "RON", "RON", "USD", "RON")} AS currency, {pick("RO", "RO", "RO", "RO", "RO", "DE")} AS country,
  coalesce({pick("incoming", "outgoing", None, None, "incoming", None)}, CASE WHEN p_partkey % 3 = 0 THEN 'outgoing' WHEN p_partkey % 4 IN (1, 3) THEN 'incoming' END) AS direction,
  {pick("INDIVIDUAL", "INDIVIDUAL", "COMPANY", "COMPANY")} AS kind, {pick("CUI", None, None, "FOREIGN_ID", None)} AS ident, {pick("bank", "cash", None, "bank", None, "bank")} AS method,
  {pick("PARTIAL_50", "NONE", "FULL", "FULL", "PARTIAL_50")} AS deductibility, p_partkey % 5 NOT IN (2, 3) AS flag, {pick("payment_receipt", "independent_receipt", None, None)} AS rt,
  {pick("401.00012", "401.00012", "401", "401", "401")} AS analytic, {pick("123", "AB-1", "0", "00X", "12")} AS code FROM part)
SELECT p_partkey, currency, country, direction, kind, coalesce(ident, CASE WHEN kind = 'COMPANY' THEN 'CUI' WHEN country = 'RO' THEN 'CNP' ELSE 'FOREIGN_ID' END) AS identifier, method, deductibility, flag,
  CASE WHEN p_partkey % 9 = 0 THEN 'payment_receipt' ELSE rt END AS receipt, analytic, true AS valid_account, code, p_partkey % 4 = 1 OR p_partkey % 5 IN (0, 1, 4) AS freight,
  coalesce(direction, '') <> 'outgoing' AND (p_partkey % 3 = 0 OR (p_partkey % 2 = 0 AND p_partkey % 3 IN (0, 2))) AS purchase FROM t""",
        "identifier_checks": f"""WITH t AS (SELECT c_custkey, c_custkey % 6 AS kind, CAST(c_custkey AS VARCHAR) AS s, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS s8,
  CAST(c_custkey % 9 + 1 AS VARCHAR) || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 13 + 1 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 31 + 1 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') || CAST(c_custkey % 10 AS VARCHAR) AS cnp,
  CASE c_custkey % 9 + 1 WHEN 1 THEN '19' WHEN 2 THEN '19' WHEN 3 THEN '18' WHEN 4 THEN '18' WHEN 5 THEN '20' WHEN 6 THEN '20' END AS century FROM customer),
u AS (SELECT *, CASE kind WHEN 0 THEN s WHEN 1 THEN s8 WHEN 2 THEN lpad(s, 9, '0') WHEN 3 THEN '0' || lpad(s, 7, '7') WHEN 4 THEN s || '12345678901' ELSE '7' || lpad(s, 6, '1') END AS digits FROM t)
SELECT c_custkey, CASE kind WHEN 0 THEN s WHEN 1 THEN s8 WHEN 2 THEN 'DE' || lpad(s, 9, '0') WHEN 3 THEN lpad(s, 7, '7') WHEN 4 THEN s || '12345678901' ELSE digits END AS tax_key,
  CASE WHEN kind = 0 AND length(s) >= 2 THEN s WHEN kind = 1 THEN s8 END AS tax_strict,
  CASE WHEN kind NOT IN (2, 4) AND length(digits) BETWEEN 2 AND 10 THEN ({tax}) * 10 % 11 % 10 = CAST(right(digits, 1) AS INTEGER) END AS tax_valid,
  CASE WHEN kind <> 5 THEN CAST('11292721' || lpad(s, 16, '0') || '2724' || lpad(CAST(c_custkey % 97 + 2 AS VARCHAR), 2, '0') AS HUGEINT) % 97 = 1 END AS iban_valid,
  CASE WHEN century IS NULL THEN c_custkey % 13 + 1 <= 12 ELSE try_strptime(century || substr(cnp, 2, 6), '%Y%m%d') IS NOT NULL END AND CASE WHEN ({cnp}) % 11 = 10 THEN 1 ELSE ({cnp}) % 11 END = c_custkey % 10 AS cnp_valid,
  kind <> 0 AS vin_valid, CASE WHEN kind <> 0 THEN 'AUTO-WVW' || lpad(s, 14, 'Z') END AS article, CASE WHEN kind <> 0 THEN 'WVW' || lpad(s, 14, 'Z') || ' Golf' ELSE 'Golf' END AS item FROM u""",
        "name_fields": f"""WITH t AS (SELECT s_suppkey, {_PICK('s_suppkey', 'Ștefan & Fiii S.R.L.', 'ÎNFRĂȚIREA SA', 'Müller-Größe  srl', 'Œuvre d_Art PFA', 'SRL Trading')} AS form FROM supplier),
u AS (SELECT s_suppkey, replace(form, 'd_Art', 'd''Art') || CASE WHEN s_suppkey % 7 = 0 THEN ' II' ELSE '' END AS name FROM t)
SELECT s_suppkey, {company} AS company_key, {key.format(fold)} || '|RO' AS name_country, {fold} AS folded, s_suppkey % 3 <> 2 AS summary FROM u""",
        "clamped_texts": """WITH t AS (SELECT doc_id, CASE WHEN length(text) > 16000 THEN left(text, 8000) || right(text, 8000) ELSE text END AS t FROM documents)
SELECT doc_id, CAST(length(t) AS INTEGER) AS length, sha256(t) AS digest FROM t""",
    }
