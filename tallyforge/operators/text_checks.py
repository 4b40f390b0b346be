"""What the text of a document says against what was read from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalise import ascii_fold, once

#: Marks of reverse charge in folded text, and patterns of a table of VAT keys: its heading, a key before a price, alone on
#: a line, or on a line that looks like a row of the table, and the line that ends it (fixed values).
MARKERS = ("taxare inversa", "taxarea inversa", "reverse charge", "reverse-charge")
HEADING = r"(?i)(\bvat\s*key\b|\bmwst\.?\s*kennz(eichnung)?\.?)"
BEFORE_PRICE = r"(?i)(^|[\s|;])([IME])\s*([|;]\s*)?(EUR|€)?\s*[-+]?\d"
ALONE = r"(?i)^\s*[|;]?\s*([IME])\s*[|;]?\s*$"
TOKEN = r"(?i)(^|[\s|;])([IME])([\s|;]|$)"
LIKE_A_ROW = r"(?i:\d[.,]\d|\b[A-Z]{2}\d{3,}\b)|\bEUR\b|€"
TABLE_END = r"(?i)^\s*(total(\s+netto)?|summe\s+netto|subtotal|gesamt)"
TABLE_LINES = 120


def _key(line: Column) -> Column:
    """The VAT key of a line of the table, in upper case, or an empty text."""
    found = F.when(line.rlike(ALONE), F.regexp_extract(line, ALONE, 1)).when(line.rlike(BEFORE_PRICE), F.regexp_extract(line, BEFORE_PRICE, 2)).when(line.rlike(LIKE_A_ROW), F.regexp_extract(line, TOKEN, 2))
    return F.upper(F.coalesce(found, F.lit("")))


def vat_keys(text: Column) -> Column:
    """The keys of the first table of VAT keys in a text, in order, as one text; null without such a table. The table
    has up to TABLE_LINES lines after its heading and ends at a line of totals below a key. A text is read where it lies:
    its lines are an array of its row, and nothing is shuffled."""
    lines = F.split(text, r"\r\n|\r|\n")

    def read(ls: Column) -> Column:
        at = F.array_position(F.transform(ls, lambda x: x.rlike(HEADING)), True)
        start = F.struct(F.lit("").alias("keys"), F.lit(False).alias("done"))

        def step(a: Column, x: Column) -> Column:
            over = a["done"] | (a["keys"] != "") & x.rlike(TABLE_END)
            return F.struct(F.when(over, a["keys"]).otherwise(F.concat(a["keys"], _key(x))).alias("keys"), over.alias("done"))

        return F.when(at > 0, F.aggregate(F.slice(ls, at.cast("int") + 1, TABLE_LINES), start, step, lambda a: a["keys"]))

    return once(lines, read)


def reverse_charge(documents: DataFrame) -> DataFrame:
    """document_id, reverse_charge and what says so, for document_id, text and model (what was read, may be null).

    A key I or E in the table of VAT keys means reverse charge, else a key M that there is none (`key`); without a table a
    mark in the text means it (`marker`); else what was read counts, null as false (`model`). A null text has no table and
    no mark. Rows are judged one by one; other columns are dropped.
    """
    keyed = documents.select("document_id", "model", F.coalesce("text", F.lit("")).alias("text")).withColumn("keys", vat_keys(F.col("text")))
    applied, not_applied = F.coalesce(F.col("keys").rlike("[IE]"), F.lit(False)), F.coalesce(F.col("keys").contains("M"), F.lit(False))
    marked = F.col("keys").isNull() & once(ascii_fold(F.lower("text")), _any)
    flag = F.when(applied, True).when(not_applied, False).when(marked, True).otherwise(F.coalesce("model", F.lit(False)))
    by = F.when(applied | not_applied, "key").when(marked, "marker").otherwise("model")
    return keyed.select("document_id", flag.alias("reverse_charge"), by.alias("said_by"))


def _any(text: Column) -> Column:
    found = text.contains(MARKERS[0])
    for mark in MARKERS[1:]:
        found = found | text.contains(mark)
    return found
