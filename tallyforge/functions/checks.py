"""Checks of identifiers and dates: true, false, or null where there is no opinion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import TAX_ID_WEIGHTS

#: Weights of the personal number's control digit (fixed values).
CNP_WEIGHTS = (2, 7, 9, 1, 4, 6, 3, 5, 8, 2, 7, 9)


def tax_id_valid(c: Column) -> Column:
    """The control digit of 2 to 10 digits; ids of other countries are not judged."""
    t = F.replace(F.upper(F.trim(c)), F.lit(" "), F.lit(""))
    foreign = t.rlike("^[A-Z]{2}") & ~t.startswith("RO")
    digits = F.regexp_replace(t, "[^0-9]", "")
    body = F.lpad(F.substring(digits, F.lit(1), F.greatest(F.length(digits) - 1, F.lit(0))), 9, "0")
    total = sum((F.substring(body, i + 1, 1).try_cast("int") * w for i, w in enumerate(TAX_ID_WEIGHTS)), F.lit(0))
    return F.when(~foreign & digits.rlike("^[0-9]{2,10}$"), total * 10 % 11 % 10 == F.right(digits, F.lit(1)).try_cast("int"))


def iban_valid(c: Column) -> Column:
    """15 to 34 characters whose number, first four moved to the end and letters as 10 to 35, is 1 modulo 97. The number
    is folded digit by digit, so no large integer is needed."""
    t = F.upper(F.replace(c, F.lit(" "), F.lit("")))
    moved = F.concat(F.substring(t, F.lit(5), F.length(t)), F.substring(t, 1, 4))
    value = lambda x: F.when(x.rlike("[0-9]"), x.try_cast("int")).otherwise(F.ascii(x) - 55)
    rest = F.aggregate(F.filter(F.split(moved, ""), lambda x: x != ""), F.lit(0), lambda acc, x: F.when(x.rlike("[0-9]"), acc * 10 + value(x)).otherwise(acc * 100 + value(x)) % 97)
    return F.when(t.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), rest == 1)


def cnp_valid(c: Column) -> Column:
    """13 digits with a possible date of the century that the first one names, and a control digit."""
    digit = lambda i: F.substring(c, i, 1).try_cast("int")
    century = F.when(digit(1) <= 2, "19").when(digit(1) <= 4, "18").when(digit(1) <= 6, "20")
    date = F.try_to_date(F.concat(century, F.substring(c, 2, 6)), "yyyyMMdd")
    loose = F.substring(c, 4, 2).try_cast("int").between(1, 12) & F.substring(c, 6, 2).try_cast("int").between(1, 31)
    total = sum((digit(i + 1) * w for i, w in enumerate(CNP_WEIGHTS)), F.lit(0)) % 11
    dated = F.when(century.isNull(), loose).otherwise(date.isNotNull())
    return F.when(c.isNull(), None).otherwise(F.coalesce(c.rlike("^[1-9][0-9]{12}$") & dated & (F.when(total == 10, 1).otherwise(total) == digit(13)), F.lit(False)))


def vin_valid(c: Column) -> Column:
    t = F.upper(F.trim(c))
    return F.when(t != "", t.rlike("^[A-HJ-NPR-Z0-9]{17}$"))


def date_valid(c: Column, as_of: Column | None = None) -> Column:
    """DD-MM-YYYY, and not after as_of if that is given; null for a blank."""
    d = F.when(c.rlike("^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$"), F.try_to_date(c, "d-M-yyyy"))
    return F.when(c != "", F.coalesce(d.isNotNull() if as_of is None else d <= as_of, F.lit(False)))
