"""Queries of partner and catalogue imports and of learned accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import partners as pt
from ..sources import driver_tables as src
from ..sources.driver_tables import table


def _partners(spark, sf_dir):
    """Customers on file; some have no tax id or no code, some share them."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("partner_id"),
        F.col("c_name").alias("name"),
        F.when(k % 6 != 0, F.concat(F.lit("RO "), (k - F.when(k % 50 == 2, 1).otherwise(0) + 1000).cast("string"))).alias("tax_id"),
        F.when(k % 4 != 0, (k - F.when(k % 70 == 3, 1).otherwise(0)).cast("string")).alias("supplier_code"),
        F.when(F.col("c_nationkey") < 20, "RO").otherwise("DE").alias("country"),
        F.when(k % 33 == 0, "INDIVIDUAL").otherwise("COMPANY").alias("kind"),
        F.concat(F.lit("City "), F.col("c_nationkey").cast("string")).alias("city"),
    )


def _rows(spark, sf_dir):
    """An import of partners derived from orders: of customers on file and new ones, with blanks and contradictions."""
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        k.alias("row_no"),
        F.when(k % 37 != 0, F.concat(F.when(k % 5 == 0, "New#").otherwise("Customer#"), F.lpad(c.cast("string"), 9, "0"))).alias("name"),
        F.when(k % 3 != 0, F.concat(F.lit("ro"), (c + 1000 + F.when(k % 5 == 0, 500000).when(k % 41 == 0, 1).otherwise(0)).cast("string"))).when(k % 43 == 0, "1960101410019").alias("tax_id"),
        F.when(k % 2 == 0, F.concat(F.lit("0"), (c + F.when(k % 5 == 0, 500000).otherwise(0)).cast("string"), F.lit(".0"))).alias("code"),
        F.when(k % 7 != 0, F.when(k % 11 == 0, "Germany").otherwise("Romania")).alias("country"),
        F.when(k % 47 == 0, "pf").when(k % 13 == 0, "companie").alias("kind"),
        F.when(k % 3 == 1, F.concat(F.lit("Town "), (k % 9).cast("string"))).alias("city"),
    )


def _matched(spark, sf_dir):
    return pt.match_partners(_rows(spark, sf_dir), _partners(spark, sf_dir), "supplier")


def partner_matches(spark, sf_dir):
    return _matched(spark, sf_dir).select("row_no", "partner_id", "match_source", "error", "new_kind", "entity")


def partner_import_summary(spark, sf_dir):
    return pt.import_summary(_matched(spark, sf_dir))


def merged_partners(spark, sf_dir):
    return pt.merge_partners(_partners(spark, sf_dir), _matched(spark, sf_dir), "supplier")


def _catalogue(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_partkey % 4 > 0")
    return p.select((F.col("p_partkey") % 5).alias("tenant"), F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("name"), F.lit("BUCATA").alias("unit"))


def _articles(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return n.select((F.col("l_partkey") % 5).alias("tenant"), k.alias("row_no"), F.when(k % 31 != 0, F.concat(F.lit(" "), F.col("l_partkey").cast("string"))).alias("code"), F.when(k % 29 != 0, F.concat(F.lit("Article "), (k % 17).cast("string"))).alias("name"), F.when(k % 3 == 0, F.concat(F.lit("U"), (k % 7).cast("string"))).alias("unit"))


def imported_articles(spark, sf_dir):
    return pt.upsert_catalogue(_catalogue(spark, sf_dir), _articles(spark, sf_dir), ("name", "unit"), keep_old=False)


def posted_articles(spark, sf_dir):
    return pt.upsert_catalogue(_catalogue(spark, sf_dir), _articles(spark, sf_dir), ("name", "unit"), keep_old=True)


def article_errors(spark, sf_dir):
    return pt.catalogue_errors(_articles(spark, sf_dir))


def _corrections(spark, sf_dir):
    """Accounts of lines as read and as a reviewer left them, one correction for each order."""
    n = src.lines(spark, sf_dir).withColumn("line", F.col("pos.l_linenumber"))
    text = F.concat(F.lit("  Part  "), (F.col("vehicle_id") % 60).cast("string"))
    fixed = F.when((F.col("document_id") + F.col("line")) % 3 == 0, "6028").when(F.col("document_id") % 5 == 0, "611").otherwise(F.col("account"))
    rows = F.array_sort(F.collect_list(F.struct("pos", text.alias("description"), F.col("account").alias("a"), fixed.alias("b"))))
    docs = n.groupBy("document_id").agg(rows.alias("r"))
    pick = lambda account: F.transform("r", lambda x: F.struct(x.description.alias("description"), x[account].alias("account")))
    return docs.select((F.col("document_id") % 4).alias("tenant"), F.col("document_id").alias("correction_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("document_id") % 50).cast("int")).alias("ts"), pick("a").alias("original"), pick("b").alias("corrected"))


def learned_accounts(spark, sf_dir):
    return pt.learned_accounts(_corrections(spark, sf_dir))


def attributed_lines(spark, sf_dir):
    """How the lines of all parts would be booked after the corrections."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 4).alias("tenant"), F.concat(F.lit("part "), (F.col("p_partkey") % 75).cast("string")).alias("description"))
    return pt.attribute_lines(p, pt.learned_accounts(_corrections(spark, sf_dir)))


NAMES = (partner_matches, partner_import_summary, merged_partners, imported_articles, posted_articles, article_errors, learned_accounts, attributed_lines)

_MATCHED = """
WITH partners AS (
  SELECT c_custkey AS partner_id, c_name AS name, CASE WHEN c_custkey % 6 <> 0 THEN CAST(c_custkey - CASE WHEN c_custkey % 50 = 2 THEN 1 ELSE 0 END + 1000 AS VARCHAR) END AS tax_key,
         CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey - CASE WHEN c_custkey % 70 = 3 THEN 1 ELSE 0 END AS VARCHAR) END AS supplier_code,
         CASE WHEN c_nationkey < 20 THEN 'RO' ELSE 'DE' END AS country, CASE WHEN c_custkey % 33 = 0 THEN 'INDIVIDUAL' ELSE 'COMPANY' END AS kind, 'City ' || c_nationkey AS city FROM customer
), r AS (
  SELECT o_orderkey AS row_no, CASE WHEN o_orderkey % 37 <> 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'New#' ELSE 'Customer#' END || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS name,
         CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey + 1000 + CASE WHEN o_orderkey % 5 = 0 THEN 500000 WHEN o_orderkey % 41 = 0 THEN 1 ELSE 0 END AS VARCHAR) WHEN o_orderkey % 43 = 0 THEN '1960101410019' END AS tax_key,
         CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 500000 ELSE 0 END AS VARCHAR) END AS code_key,
         CASE WHEN o_orderkey % 2 = 0 THEN '0' || CAST(o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 500000 ELSE 0 END AS VARCHAR) || '.0' END AS code,
         CASE WHEN o_orderkey % 7 <> 0 THEN CASE WHEN o_orderkey % 11 = 0 THEN 'GERMANY' ELSE 'RO' END END AS stated,
         CASE WHEN o_orderkey % 47 = 0 THEN 'INDIVIDUAL' WHEN o_orderkey % 13 = 0 THEN 'COMPANY' END AS kind, CASE WHEN o_orderkey % 3 = 1 THEN 'Town ' || (o_orderkey % 9) END AS city FROM orders
), keyed AS (SELECT *, upper(replace(name, '#', ' ')) || '|' || coalesce(stated, 'RO') AS name_key FROM r),
t AS (SELECT tax_key, count(*) AS tax_n, min(partner_id) AS t_id FROM partners WHERE tax_key IS NOT NULL GROUP BY ALL),
c AS (SELECT supplier_code AS code_key, count(*) AS code_n, min(partner_id) AS c_id FROM partners WHERE supplier_code IS NOT NULL GROUP BY ALL),
n AS (SELECT upper(replace(name, '#', ' ')) || '|' || country AS name_key, count(*) AS name_n, min(partner_id) AS n_id FROM partners GROUP BY ALL),
j AS (SELECT k.*, tax_n, t_id, code_n, c_id, name_n, n_id, np.tax_key AS n_tax FROM keyed k LEFT JOIN t USING (tax_key) LEFT JOIN c USING (code_key) LEFT JOIN n USING (name_key) LEFT JOIN partners np ON np.partner_id = n_id),
s AS (SELECT *, CASE WHEN t_id IS NOT NULL THEN 'identification' WHEN c_id IS NOT NULL THEN 'code' WHEN name_n = 1 AND (tax_key IS NULL OR n_tax IS NULL OR n_tax = tax_key) THEN 'name' END AS match_source FROM j),
m AS (
  SELECT s.*, p.partner_id, p.tax_key AS on_file, coalesce(stated, p.country, 'RO') AS country, coalesce(s.tax_key, p.tax_key) AS any_tax,
         coalesce(s.kind, CASE WHEN coalesce(stated, p.country, 'RO') = 'RO' AND regexp_full_match(coalesce(s.tax_key, p.tax_key), '[0-9]{13}') THEN 'INDIVIDUAL' END, p.kind, 'COMPANY') AS new_kind
  FROM s LEFT JOIN partners p ON p.partner_id = CASE match_source WHEN 'identification' THEN t_id WHEN 'code' THEN c_id WHEN 'name' THEN n_id END
), matched AS (
  SELECT *, CASE WHEN name IS NULL THEN 'name missing' WHEN tax_n > 1 THEN 'identifier of several partners' WHEN code_n > 1 THEN 'code of several partners' WHEN t_id <> c_id THEN 'identifier and code differ' WHEN on_file <> tax_key THEN 'other identifier on file'
         WHEN new_kind = 'INDIVIDUAL' THEN CASE WHEN length(country) <> 2 THEN 'country' WHEN any_tax IS NULL THEN 'identifier missing' WHEN country = 'RO' AND length(any_tax) <> 13 THEN 'not 13 digits' WHEN country = 'RO' AND any_tax = '1960101410019' AND NOT {cnp} THEN 'control digit' END END AS error,
         coalesce('t:' || tax_key, 'c:' || code_key, 'n:' || name_key) AS entity FROM m
)"""
_DIGITS = "1960101410019"


def _cnp_ok():
    from ..functions.checks import CNP_WEIGHTS

    rest = sum(int(d) * w for d, w in zip(_DIGITS, CNP_WEIGHTS)) % 11
    return str((1 if rest == 10 else rest) == int(_DIGITS[-1])).lower()


_ARTICLES = """
WITH cat AS (SELECT p_partkey % 5 AS tenant, CAST(p_partkey AS VARCHAR) AS code, p_name AS name, 'BUCATA' AS unit FROM part WHERE p_partkey % 4 > 0),
a AS (
  SELECT l_partkey % 5 AS tenant, k AS row_no, CASE WHEN k % 31 <> 0 THEN CAST(l_partkey AS VARCHAR) END AS code, CASE WHEN k % 29 <> 0 THEN 'Article ' || (k % 17) END AS name, CASE WHEN k % 3 = 0 THEN 'U' || (k % 7) END AS unit
  FROM (SELECT *, l_orderkey * 10 + l_linenumber AS k FROM lineitem)
), good AS (SELECT * FROM a WHERE code IS NOT NULL AND name IS NOT NULL)"""
_LEARNED = """
WITH lines AS (
  SELECT l_orderkey AS id, l_linenumber, l_partkey, CASE l_partkey % 4 WHEN 0 THEN '371' WHEN 1 THEN '624' WHEN 2 THEN '628' ELSE '6022' END AS account,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS pos FROM lineitem
), fixed AS (SELECT *, CASE WHEN (id + l_linenumber) % 3 = 0 THEN '6028' WHEN id % 5 = 0 THEN '611' ELSE account END AS new_account FROM lines),
learned AS (
  SELECT id % 4 AS tenant, 'part ' || (l_partkey % 60) AS description_key, arg_max(new_account, [id % 50, id, pos]) AS learned_account, count(*) AS n_changes FROM fixed WHERE account <> new_account GROUP BY ALL
)"""


def oracle_sql():
    matched = _MATCHED.replace("{cnp}", _cnp_ok())
    last = lambda c, k: f"arg_max({c}, row_no) FILTER ({c} IS NOT NULL) AS {k}"
    fields = (("name", "name"), ("tax_key", "tax_id"), ("code", "code"), ("country", "country"), ("new_kind", "kind"), ("city", "city"))
    return {
        "partner_matches": f"{matched} SELECT row_no, partner_id, match_source, error, new_kind, entity FROM matched",
        "partner_import_summary": f"{matched} SELECT CASE WHEN error IS NOT NULL THEN 'error' WHEN partner_id IS NOT NULL THEN 'updated' ELSE 'created' END AS outcome, coalesce(error, match_source) AS detail, count(*) AS n_rows FROM matched GROUP BY ALL",
        "merged_partners": f"""{matched}, g AS (SELECT partner_id, CASE WHEN partner_id IS NULL THEN entity END AS entity, min(row_no) AS first_row, {', '.join(last(c, 'new_' + k) for c, k in fields)} FROM matched WHERE error IS NULL GROUP BY ALL)
SELECT p.partner_id, NULL::BIGINT AS first_row, coalesce(new_name, p.name) AS name, coalesce(new_tax_id, CASE WHEN tax_key IS NOT NULL THEN 'RO ' || tax_key END) AS tax_id, coalesce(new_code, supplier_code) AS code, coalesce(new_country, p.country) AS country, coalesce(new_kind, p.kind) AS kind, coalesce(new_city, p.city) AS city, CASE WHEN first_row IS NULL THEN 'kept' ELSE 'updated' END AS outcome
FROM partners p LEFT JOIN g ON p.partner_id = g.partner_id
UNION ALL SELECT NULL, first_row, new_name, new_tax_id, new_code, new_country, new_kind, new_city, 'created' FROM g WHERE partner_id IS NULL""",
        "imported_articles": f"""{_ARTICLES}, u AS (SELECT tenant, code, arg_max({{'name': name, 'unit': unit}}, row_no) AS r FROM good GROUP BY ALL)
SELECT coalesce(u.tenant, cat.tenant) AS tenant, coalesce(u.code, cat.code) AS code, CASE WHEN r IS NULL THEN name ELSE r.name END AS name, CASE WHEN r IS NULL THEN unit ELSE r.unit END AS unit,
CASE WHEN r IS NULL THEN 'kept' WHEN name IS NOT NULL THEN 'updated' ELSE 'created' END AS outcome FROM cat FULL JOIN u ON cat.tenant = u.tenant AND cat.code = u.code""",
        "posted_articles": f"""{_ARTICLES}, u AS (SELECT tenant, code, {last('name', 'new_name')}, {last('unit', 'new_unit')} FROM good GROUP BY ALL)
SELECT coalesce(u.tenant, cat.tenant) AS tenant, coalesce(u.code, cat.code) AS code, coalesce(new_name, name) AS name, coalesce(new_unit, unit) AS unit,
CASE WHEN new_name IS NULL THEN 'kept' WHEN name IS NOT NULL THEN 'updated' ELSE 'created' END AS outcome FROM cat FULL JOIN u ON cat.tenant = u.tenant AND cat.code = u.code""",
        "article_errors": f"{_ARTICLES} SELECT row_no, 'code or name missing' AS error FROM a WHERE code IS NULL OR name IS NULL",
        "learned_accounts": f"{_LEARNED} SELECT * FROM learned",
        "attributed_lines": f"""{_LEARNED}, p AS (SELECT p_partkey, p_partkey % 4 AS tenant, 'part ' || (p_partkey % 75) AS description FROM part)
SELECT p_partkey, p.tenant, description, coalesce(learned_account, '628') AS suggested_account, CASE WHEN learned_account IS NULL THEN 0.3::DOUBLE ELSE 0.9::DOUBLE END AS account_confidence, learned_account IS NULL AS manual_review
FROM p LEFT JOIN learned ON p.tenant = learned.tenant AND description = description_key""",
    }
