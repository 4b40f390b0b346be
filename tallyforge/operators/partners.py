"""Imports of partners and catalogues: matching, rules, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks
from ..functions import normalise as nz
from ..functions.money import tax_id_key

#: Words that name a kind of partner (fixed values).
INDIVIDUAL_WORDS = ("INDIVIDUAL", "PERSOANA FIZICA", "PERSOANĂ FIZICĂ", "PF")
COMPANY_WORDS = ("COMPANY", "COMPANIE", "PERSOANA JURIDICA", "PERSOANĂ JURIDICĂ", "PJ")
MERGED = ("name", "tax_id", "code", "country", "kind", "city")


def _index(partners: DataFrame, key: Column, name: str) -> DataFrame:
    """One row a key: how many partners have it, and the first of them. Aggregated first, so no key is a hot one. Partners
    may be many, so rows meet the table in a shuffle, whatever size is guessed for it."""
    first = F.min_by(F.struct("partner_id", F.col("tax_key").alias("tax_key"), F.col("kind"), F.col("country")), "partner_id")
    return partners.where(key.isNotNull() & (key != "")).groupBy(F.concat(F.lit("k"), key).alias(f"{name}_at")).agg(F.count("*").alias(f"{name}_n"), first.alias(f"by_{name}")).hint("merge")


def _keyed(rows: DataFrame, name: str) -> DataFrame:
    """Rows with what they are dealt by: their key, else their own number, which no key is equal to. All rows without a key
    would lie in one task if they were dealt by the null."""
    return rows.withColumn(f"{name}_at", F.coalesce(F.concat(F.lit("k"), F.nullif(F.col(f"{name}_key"), F.lit(""))), F.concat(F.lit("n"), F.col("row_no").cast("string"))))


def imported_kind(stated: Column, tax_key: Column, country: Column, known: Column) -> Column:
    """The stated kind; else 13 digits of a Romanian partner are a person's; else the kind on file, else a company."""
    t = F.upper(F.trim(stated))
    return F.when(t.isin(*INDIVIDUAL_WORDS), "INDIVIDUAL").when(t.isin(*COMPANY_WORDS), "COMPANY").when((nz.country_code(country) == "RO") & tax_key.rlike("^[0-9]{13}$"), "INDIVIDUAL").otherwise(F.coalesce(known, F.lit("COMPANY")))


def private_seller_error(country: Column, tax_key: Column) -> Column:
    """What is wrong with a person's identity, null if nothing."""
    home, blank = nz.country_code(country) == "RO", F.coalesce(tax_key, F.lit("")) == ""
    return F.when(~nz.country_code(country).rlike("^[A-Z]{2}$"), "country").when(blank, "identifier missing").when(home & ~tax_key.rlike("^[0-9]{13}$"), "not 13 digits").when(home & ~checks.cnp_valid(tax_key), "control digit")


def match_partners(rows: DataFrame, partners: DataFrame, role: str) -> DataFrame:
    """Each row of an import with its partner, by tax id, else by the role's code, else by a name and country that one
    partner has; partner_id is null for a new one, and error names the first rule that a row breaks. Rows and partners
    have a null or blank where nothing is known. rows: row_no, name, tax_id, code, country, kind, city."""
    have = partners.select("partner_id", "name", "country", "kind", tax_id_key(F.col("tax_id")).alias("tax_key"), nz.partner_code_key(F.col(f"{role}_code")).alias("code_key"))
    keyed = rows.withColumns({"tax_key": F.nullif(tax_id_key(F.col("tax_id")), F.lit("")), "code_key": F.nullif(nz.partner_code_key(F.col("code")), F.lit("")), "name_key": nz.name_country_key(F.col("name"), F.col("country"))})
    got, name_key = keyed, nz.name_country_key(F.col("name"), F.col("country"))
    for name, key in (("tax", F.col("tax_key")), ("code", F.col("code_key")), ("name", name_key)):
        got = _keyed(got, name).join(_index(have, key, name), f"{name}_at", "left")
    known = F.coalesce(F.nullif(F.col("by_name.tax_key"), F.lit("")), F.col("tax_key"))
    named = (F.col("name_n") == 1) & (F.col("tax_key").isNull() | (known == F.col("tax_key")))
    source = F.when(F.col("by_tax").isNotNull(), "identification").when(F.col("by_code").isNotNull(), "code").when(named, "name")
    got = got.withColumn("match_source", source).withColumn("p", F.when(F.col("match_source") == "identification", F.col("by_tax")).when(F.col("match_source") == "code", F.col("by_code")).when(F.col("match_source") == "name", F.col("by_name")))
    got = got.withColumns({"on_file": F.nullif(F.col("p.tax_key"), F.lit("")), "now_in": nz.country_code(F.coalesce(nz.text_of(F.col("country")), F.col("p.country")))})
    on_file, country = F.col("on_file"), F.col("now_in")
    got = got.withColumn("any_tax", F.coalesce(F.col("tax_key"), on_file))
    got = got.withColumn("new_kind", imported_kind(F.col("kind"), F.col("any_tax"), country, F.col("p.kind")))
    kind = F.col("new_kind")
    error = (
        F.when(nz.text_of(F.col("name")).isNull(), "name missing")
        .when(F.col("tax_n") > 1, "identifier of several partners")
        .when(F.col("code_n") > 1, "code of several partners")
        .when(F.col("by_tax.partner_id") != F.col("by_code.partner_id"), "identifier and code differ")
        .when(on_file != F.col("tax_key"), "other identifier on file")
    )
    if role == "supplier":
        error = F.coalesce(error, F.when(kind == "INDIVIDUAL", private_seller_error(country, F.col("any_tax"))))
    entity = F.coalesce(F.concat(F.lit("t:"), "tax_key"), F.concat(F.lit("c:"), "code_key"), F.concat(F.lit("n:"), "name_key"))
    return got.select("row_no", "name", "tax_key", "code", F.col("country").alias("stated_country"), country.alias("country"), "new_kind", nz.text_of(F.col("city")).alias("city"), "match_source", F.col("p.partner_id").alias("partner_id"), error.alias("error"), entity.alias("entity"))


def import_summary(matched: DataFrame) -> DataFrame:
    """Rows by outcome and way of matching."""
    outcome = F.when(F.col("error").isNotNull(), "error").when(F.col("partner_id").isNotNull(), "updated").otherwise("created")
    return matched.groupBy(outcome.alias("outcome"), F.coalesce("error", "match_source").alias("detail")).agg(F.count("*").alias("n_rows"))


def merge_partners(partners: DataFrame, matched: DataFrame, role: str) -> DataFrame:
    """Partners after an import: the last row that states a value wins, blanks keep what is on file, and rows of one new
    partner (same tax id, else code, else name) make one. New partners have no partner_id yet but their first row. Both
    kinds are merged and meet what is on file in one go, so that rows are matched once."""
    # rows with an error have no slot: a filter on it would be pushed to where the whole rule is evaluated again for each use
    slotted = matched.withColumn("slot", F.when(F.col("error").isNull(), F.coalesce(_slot(), F.col("entity"))))
    last = lambda c: F.max_by(F.struct(c), F.when(F.col(c).isNotNull(), F.col("row_no")))[c]
    merged = slotted.withColumnsRenamed({"tax_key": "tax_id", "new_kind": "kind"}).withColumn("code", nz.text_of(F.col("code"))).groupBy("slot").agg(F.bool_and(F.col("error").isNull()).alias("good"), F.min("partner_id").alias("found_id"), F.min("row_no").cast("long").alias("new_row"), *(last(c).alias(f"new_{c}") for c in MERGED))
    old = partners.withColumns({"code": F.col(f"{role}_code"), "slot": _slot(), "on_file": F.lit(True)}).select("slot", "on_file", "partner_id", *MERGED)
    both = old.join(merged, "slot", "full").where("on_file or good and found_id is null")
    outcome = F.when(F.col("on_file").isNull(), "created").when(F.col("new_row").isNull(), "kept").otherwise("updated")
    return both.select("partner_id", F.when(F.col("on_file").isNull(), F.col("new_row")).alias("first_row"), *(F.coalesce(F.col(f"new_{c}"), F.col(c)).alias(c) for c in MERGED), outcome.alias("outcome"))


def _slot() -> Column:
    """What a partner on file is merged by; no entity of a new one is equal to it."""
    return F.concat(F.lit("p:"), F.col("partner_id").cast("string"))


def catalogue_errors(rows: DataFrame) -> DataFrame:
    """Rows without a code or a name."""
    return rows.where((F.coalesce(F.trim("code"), F.lit("")) == "") | (F.coalesce(F.trim("name"), F.lit("")) == "")).select("row_no", F.lit("code or name missing").alias("error"))


def upsert_catalogue(target: DataFrame, rows: DataFrame, values: tuple[str, ...], keep_old: bool) -> DataFrame:
    """A catalogue by (tenant, code) after rows: an import overwrites with its last row for a code, blanks included; with
    keep_old, as in posting, the last value that isn't null wins and nulls keep what is there."""
    good = rows.where((F.trim("code") != "") & (F.trim("name") != "")).withColumn("code", F.trim("code"))
    if keep_old:
        new = good.groupBy("tenant", "code").agg(F.count("*").alias("n"), *(F.max_by(F.struct(c), F.when(F.col(c).isNotNull(), F.col("row_no")))[c].alias(f"new_{c}") for c in values))
    else:
        new = good.groupBy("tenant", "code").agg(F.count("*").alias("n"), F.max_by(F.struct(*values), "row_no").alias("r")).select("tenant", "code", "n", *(F.col(f"r.{c}").alias(f"new_{c}") for c in values))
    both = target.withColumn("on_file", F.lit(True)).join(new, ["tenant", "code"], "full")
    value = lambda c: F.coalesce(F.col(f"new_{c}"), F.col(c)) if keep_old else F.when(F.col("n").isNull(), F.col(c)).otherwise(F.col(f"new_{c}"))
    outcome = F.when(F.col("n").isNull(), "kept").when(F.col("on_file"), "updated").otherwise("created")
    return both.select("tenant", "code", *(value(c).alias(c) for c in values), outcome.alias("outcome"))


def learned_accounts(corrections: DataFrame) -> DataFrame:
    """Account by description from corrected lines, paired by position: the last change of a description counts.
    corrections: tenant, correction_id, ts, original and corrected (arrays of structs description, account)."""
    pairs = corrections.select("tenant", "correction_id", "ts", F.posexplode(F.arrays_zip("original", "corrected")).alias("pos", "p"))
    key = description_key(F.col("p.original.description"))
    changed = pairs.where((key != "") & (F.col("p.original.account") != F.col("p.corrected.account")))
    return changed.groupBy("tenant", key.alias("description_key")).agg(F.max_by("p.corrected.account", F.struct("ts", "correction_id", "pos")).alias("learned_account"), F.count("*").alias("n_changes"))


def description_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")


def attribute_lines(lines: DataFrame, learned: DataFrame, default: str = "628") -> DataFrame:
    """The learned account of a line's description, else the default with low confidence and for review. lines: tenant,
    description."""
    got = lines.withColumn("description_key", description_key(F.col("description"))).join(learned.select("tenant", "description_key", "learned_account"), ["tenant", "description_key"], "left")
    known = F.col("learned_account").isNotNull()
    return got.withColumns({"suggested_account": F.coalesce("learned_account", F.lit(default)), "account_confidence": F.when(known, 0.9).otherwise(0.3), "manual_review": ~known}).drop("learned_account", "description_key")
