"""Money and key expressions; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(14,2)"
#: Weights of the tax identifier's check digit, aligned right (fixed values).
TAX_ID_WEIGHTS = (7, 5, 3, 2, 1, 7, 5, 3, 2)


def round2(x: Column) -> Column:
    """Two decimals, half toward plus infinity, as money."""
    return (F.floor(x * 100 + F.lit(0.5)) / 100).cast(MONEY)


def reference_key(c: Column) -> Column:
    """Upper case, letters and digits only, no leading zeros."""
    return F.regexp_replace(F.regexp_replace(F.upper(c), "[^A-Z0-9]", ""), "^0+", "")


def tax_id_key(c: Column) -> Column:
    """Upper case without the country prefix RO, letters and digits only."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(c)), "^RO", ""), "[^A-Z0-9]", "")


def glued_numbers(c: Column, head: int = 20000) -> Column:
    """Contacts of a letter with a digit, in either order, that don't overlap, at the beginning of a text; such contacts
    mark badly read text. The limit is part of the score, which compares readings of one page."""
    return F.regexp_count(F.substring(c, 1, head), F.lit("[A-Za-z][0-9]|[0-9][A-Za-z]")).cast("long")
