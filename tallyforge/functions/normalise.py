"""Scalar normalisers of extracted fields: money, dates, codes and keys. All are built-in expressions, no UDF."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that folding does not decompose, and those that it maps (fixed values).
FOLD_FROM = "ăâîșşțţáàäãåéèêëíìïóòôöõúùûüçñýÿžšćčđłńśźżőű"
FOLD_TO = "aaissttaaaaaeeeeiiiooooouuuucnyyzsccdlnszzou"
LIGATURES = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ø", "o"))
#: Suffixes of company names, removed in this order (fixed values).
COMPANY_SUFFIXES = ("SRL", "SA", "SRA", "PFA", "II", "IF", "LLC", "LTD", "INC")
#: Other names of two currencies, of Romania and of directions and kinds (fixed values).
RON_NAMES, EUR_NAMES = ("LEI", "LEU"), ("EURO", "€")
ROMANIA = ("ROMANIA", "ROMÂNIA", "ROU")
INCOMING, OUTGOING = ("incoming", "intrare", "achizitie", "purchase"), ("outgoing", "iesire", "vanzare", "sale")
INDIVIDUAL = ("INDIVIDUAL", "PERSOANA_FIZICA", "PERSOANĂ_FIZICĂ", "PERSON")
YES = ("true", "da", "yes", "1")
NUMBER = "double"


def text_of(c: Column) -> Column:
    """Trimmed, blank is null."""
    return F.nullif(F.trim(c), F.lit(""))


def _round2(x: Column) -> Column:
    """Two decimals of a double, half toward plus infinity."""
    return F.floor((x + F.lit(2.0**-52)) * 100 + F.lit(0.5)) / 100


def once(x: Column, of: Callable[[Column], Column]) -> Column:
    """of(x), with x evaluated once however often `of` names it."""
    return F.get(F.transform(F.array(x), of), F.lit(0))


def _bare(c: Column) -> Column:
    """Digits, points and minus signs; the first comma is a point, others go."""
    kept = F.regexp_replace(c, r"[^0-9.,\-]", "")
    return F.translate(F.regexp_replace(kept, "^([^,]*),", "$1."), ",", "")


def _number(bare: Column) -> Column:
    """A bare text as a number: an empty one is 0, an impossible one null."""
    return F.regexp_replace(bare, "^$", "0").try_cast(NUMBER)


def money_positive(c: Column) -> Column:
    """Two decimals; what is no number, or none above 0, is 0."""
    return _round2(F.greatest(_number(_bare(F.coalesce(c, F.lit("")))), F.lit(0.0)))


def money_signed(c: Column) -> Column:
    """Two decimals; parentheses and all kinds of minus signs count; null, empty and impossible texts are null."""
    t = F.trim(c)
    n = _number(_bare(F.translate(t, "−–—", "---")))
    return F.when(c == "", None).otherwise(_round2(F.when(t.startswith("(") & t.rlike(r"^\(.*\)$"), -F.abs(n)).otherwise(n)))


def money_locale(c: Column) -> Column:
    """Of two kinds of separators the rightmost is the decimal point; a lone comma is one if one or two digits follow
    it at the end. No rounding; texts that are no number are null."""
    return once(F.replace(F.trim(c), F.lit(" "), F.lit("")), _located)


def _located(s: Column) -> Column:
    no = lambda x, y: F.replace(x, F.lit(y), F.lit(""))
    point = lambda x: F.replace(x, F.lit(","), F.lit("."))
    comma, dot = s.contains(","), s.contains(".")
    comma_last = F.instr(F.reverse(s), F.lit(",")) < F.instr(F.reverse(s), F.lit("."))
    plain = F.when(comma & dot, F.when(comma_last, point(no(s, "."))).otherwise(no(s, ","))).when(comma, F.when(s.rlike(r",\d{1,2}$"), point(s)).otherwise(no(s, ","))).otherwise(s)
    return once(plain, lambda t: F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), t.try_cast(NUMBER)))


def rate_positive(c: Column) -> Column:
    """A number above 0, not rounded, else null."""
    return once(_number(_bare(c)), lambda n: F.when(n > 0, n))


def to_ron(amount: Column, rate: Column) -> Column:
    return _round2(amount * rate)


def parse_date(c: Column) -> Column:
    """ISO dates (what follows the day is ignored) and d.m.y with points, slashes or dashes; impossible dates are null."""
    t = F.trim(c)
    iso = F.try_to_date(F.regexp_extract(t, r"^(\d{4}-\d{1,2}-\d{1,2})", 1), "yyyy-M-d")
    dmy = F.try_to_date(F.regexp_replace(t, "[./]", "-"), "d-M-yyyy")
    return F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), iso).when(t.rlike(r"^\d{1,2}[./-]\d{1,2}[./-]\d{4}$"), dmy)


def format_dmy(d: Column) -> Column:
    return F.date_format(d, "dd-MM-yyyy")


def tax_id_compare(c: Column) -> Column:
    """Tax id for comparing: without RO, or R0 as it is often read, letters and digits only."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(c)), "[^A-Z0-9]", ""), "^R[O0]", "")


def tax_id_strict(c: Column) -> Column:
    """2 to 10 digits after RO, else null."""
    t = F.regexp_replace(F.regexp_replace(F.upper(c), r"\s", ""), "^RO", "")
    return F.when(t.rlike("^[0-9]{2,10}$"), t)


def country_code(c: Column) -> Column:
    t = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(t.isin(*ROMANIA) | (t == ""), "RO").otherwise(t)


def currency_code(c: Column) -> Column:
    t = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(t.isin(*RON_NAMES) | (t == ""), "RON").when(t.isin(*EUR_NAMES), "EUR").otherwise(t)


def vin_key(c: Column) -> Column:
    """Upper case, letters and digits only."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def vin_or_null(c: Column) -> Column:
    """17 letters and digits without I, O and Q, else null."""
    return F.when(vin_key(c).rlike("^[A-HJ-NPR-Z0-9]{17}$"), vin_key(c))


def stock_article_code(vin: Column) -> Column:
    return F.concat(F.lit("AUTO-"), vin)


def stock_item_name(vin: Column, model: Column) -> Column:
    return F.concat_ws(" ", text_of(F.upper(vin)), text_of(model))


def direction(c: Column, vendor: Column, buyer: Column, own: Column) -> Column:
    """incoming or outgoing by its names; else by the own tax id, as vendor first."""
    t = F.lower(F.trim(c))
    return F.when(t.isin(*INCOMING), "incoming").when(t.isin(*OUTGOING), "outgoing").when(vendor == own, "outgoing").when(buyer == own, "incoming")


def party_kind(c: Column) -> Column:
    return F.when(F.upper(F.trim(c)).isin(*INDIVIDUAL), "INDIVIDUAL").otherwise("COMPANY")


def identifier_type(c: Column, kind: Column, country: Column) -> Column:
    t = F.upper(F.trim(c))
    return F.when(t.isin("CUI", "CNP", "FOREIGN_ID"), t).when(kind == "COMPANY", "CUI").when(country_code(country) == "RO", "CNP").otherwise("FOREIGN_ID")


def receipt_type(c: Column, has_references: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when((t == "payment_receipt") | has_references, "payment_receipt").when(t == "independent_receipt", t)


def payment_method(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t.rlike("bank|transfer|card|5121|5124"), "bank").when(t != "", "cash")


def deductibility(c: Column) -> Column:
    t = F.upper(F.trim(c))
    return F.when(t.isin("PARTIAL_50", "N50"), "PARTIAL_50").when(t.isin("NONE", "I"), "NONE").otherwise("FULL")


def bool_of(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin(*YES), F.lit(False))


def partner_code_key(c: Column) -> Column:
    """Upper case without a trailing .0; numbers lose leading zeros."""
    t = F.regexp_replace(F.upper(F.trim(c)), r"\.0+$", "")
    return F.when(t.rlike("^[0-9]+$"), F.regexp_replace(t, "^0+(?=.)", "")).otherwise(t)


def analytic_account(root: Column, suffix: Column) -> Column:
    """root.suffix, unless the suffix has the root already or is blank."""
    t = F.coalesce(F.trim(suffix), F.lit(""))
    return F.when(t == "", root).when((t == root) | t.startswith(F.concat(root, F.lit("."))), t).otherwise(F.concat(root, F.lit("."), t))


def valid_account(c: Column) -> Column:
    return F.trim(c).rlike(r"^\d{3,4}(\.\d{1,10})?$")


def token_budget_clamp(c: Column, half: int = 8000) -> Column:
    """Texts of more than two halves keep their first and last half."""
    return F.when(F.length(c) > 2 * half, F.concat(F.substring(c, 1, half), F.right(c, F.lit(half)))).otherwise(c)


def ascii_fold(c: Column) -> Column:
    """Lower case without diacritics and ligatures."""
    t = F.translate(F.lower(c), FOLD_FROM, FOLD_TO)
    for old, new in LIGATURES:
        t = F.replace(t, F.lit(old), F.lit(new))
    return t


def name_country_key(name: Column, country: Column) -> Column:
    return F.concat(F.trim(F.regexp_replace(F.upper(ascii_fold(name)), "[^A-Z0-9]+", " ")), F.lit("|"), country_code(country))


def company_name_key(c: Column) -> Column:
    """Folded, upper case, letters and digits with single blanks, each suffix of companies removed once at its end."""
    t = F.trim(F.regexp_replace(F.upper(ascii_fold(F.replace(c, F.lit("."), F.lit("")))), "[^A-Z0-9]+", " "))
    for suffix in COMPANY_SUFFIXES:
        t = F.regexp_replace(t, f" {suffix}$", "")
    return t


def is_purchase_contract(transaction: Column, direction_: Column, vin: Column, contract_type: Column) -> Column:
    """A purchase that isn't outgoing; without a stated transaction, a vehicle in a contract of sale or purchase."""
    out = F.coalesce(direction_ == "outgoing", F.lit(False))
    by_type = F.coalesce(text_of(vin).isNotNull() & F.lower(contract_type).rlike("vanzare|vânzare|sale|achiz"), F.lit(False))
    return ~out & (F.coalesce(F.lower(F.trim(transaction)) == "purchase", F.lit(False)) | by_type)


def is_freight_line(name: Column, account: Column) -> Column:
    return F.coalesce(account.startswith("624"), F.lit(False)) | F.coalesce(name.rlike(r"(?i)transport|freight|fracht|platform|tractare|remorcare|\btow\b"), F.lit(False))


def is_summary_row(description: Column) -> Column:
    """Control rows of bank statements, whose folded description starts with a turnover, balance or total."""
    return F.coalesce(ascii_fold(F.trim(description)).rlike("^(rulaj|sold |total)"), F.lit(False))
