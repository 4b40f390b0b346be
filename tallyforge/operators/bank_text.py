"""Printed controls of bank statements, read from their lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import MONEY, round2
from ..functions.normalise import money_locale

#: What marks a control line, in the order in which the marks are looked for, and how many amounts end it (fixed values).
MARKS = (("RULAJ TOTAL CONT", "total", 2), ("SOLD FINAL CONT", "closing", 1), ("SOLD ANTERIOR", "opening", 1), ("SOLD FINAL ZI", "day_closing", 1), ("RULAJ ZI", "day", 2))
AMOUNT = r"-?\d[\d.,]*"
DAY = r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})"
#: Lines of a statement that one task looks through for the last day named before a line.
SEGMENT = 4096


def text_lines(texts: DataFrame) -> DataFrame:
    """statement_id, line_no and text of the lines of whole texts (statement_id, text)."""
    return texts.select("statement_id", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("line_no", "text"))


def _money(text: Column) -> Column:
    return round2(money_locale(text))


def control_lines(lines: DataFrame) -> DataFrame:
    """The control lines among lines (statement_id, line_no, text): kind, day, and the one or two amounts that end them.
    A line whose amounts or day are missing says nothing and goes."""
    upper, kind, two = F.upper("text"), None, None
    for mark, name, n in MARKS:
        kind = (F.when if kind is None else kind.when)(upper.contains(mark), name)
    ends = F.regexp_extract("text", rf"({AMOUNT})\s+({AMOUNT})\s*$", 1), F.regexp_extract("text", rf"({AMOUNT})\s+({AMOUNT})\s*$", 2)
    one = F.regexp_extract("text", rf"({AMOUNT})\s*$", 1)
    day = F.try_to_date(F.concat_ws("-", *(F.regexp_extract("text", DAY, i) for i in (1, 2, 3))), "d-M-yyyy")
    found = lines.withColumn("kind", kind).where("kind is not null")
    two = F.col("kind").isin(*(name for _, name, n in MARKS if n == 2))
    found = found.select("statement_id", F.col("line_no").cast("long").alias("line_no"), "kind", F.when(F.col("kind") == "day", day).alias("day"), F.when(two, ends[0]).otherwise(one).alias("a"), F.when(two, ends[1]).alias("b"))
    return found.where("a <> '' and (kind <> 'day' or day is not null)").select("statement_id", "line_no", "kind", "day", _money(F.col("a")).alias("a"), _money(F.col("b")).alias("b"))


def carried_days(controls: DataFrame) -> DataFrame:
    """controls with the last day line before or at each line: its day and number. A statement's lines are looked through
    in segments; what is before a segment comes from one row for each of them."""
    own = F.when(F.col("kind") == "day", F.struct("line_no", "day"))
    cut = controls.withColumn("segment", F.floor(F.col("line_no") / SEGMENT))
    ends = cut.groupBy("statement_id", "segment").agg(F.max(own).alias("end"))
    before = ends.select("statement_id", "segment", F.last("end", True).over(Window.partitionBy("statement_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    inside = F.last(own, True).over(Window.partitionBy("statement_id", "segment").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    met = cut.withColumn("inside", inside).join(before, ["statement_id", "segment"])
    at = F.coalesce("inside", "before")
    return met.withColumns({"at_day": at["day"], "at_line": at["line_no"]}).drop("inside", "before", "segment")


def day_controls(lines: DataFrame) -> DataFrame:
    """statement_id, day, debit, credit and closing of each day that a line prints the turnover of. Of several lines of one
    day the last counts; its closing is the last one printed after it and before the next day line."""
    at = carried_days(control_lines(lines)).where("at_day is not null")
    parts = at.groupBy("statement_id", F.col("at_day").alias("day"), "at_line").agg(F.max_by("a", F.when(F.col("kind") == "day_closing", F.col("line_no"))).alias("closing"), F.max(F.when(F.col("kind") == "day", F.col("a"))).alias("debit"), F.max(F.when(F.col("kind") == "day", F.col("b"))).alias("credit"))
    last = parts.groupBy("statement_id", "day").agg(F.max_by(F.struct("debit", "credit", "closing"), "at_line").alias("c"))
    return last.select("statement_id", "day", "c.debit", "c.credit", "c.closing")


def statement_controls(lines: DataFrame) -> DataFrame:
    """Opening, closing and total turnovers that a statement prints; the last line of a kind counts. Statements without a
    turnover line, or with neither a day nor a balance, aren't of this layout and have no row."""
    layout = lines.groupBy("statement_id").agg(F.bool_or(F.upper("text").contains("RULAJ")).alias("known")).where("known").select("statement_id")
    last = lambda kind, c: F.max_by(c, F.when(F.col("kind") == kind, F.col("line_no")))
    got = control_lines(lines).groupBy("statement_id").agg(last("opening", "a").alias("opening"), last("closing", "a").alias("closing"), last("total", "a").alias("total_debit"), last("total", "b").alias("total_credit"), F.count_if(F.col("kind") == "day").alias("n_days"))
    return got.join(layout, "statement_id", "left_semi").where("n_days > 0 or opening is not null or closing is not null").drop("n_days")


def with_openings(days: DataFrame, controls: DataFrame) -> DataFrame:
    """Controls of days with the statement's opening, 0 where none is printed: what running_balance starts from."""
    known = controls.select("statement_id", "opening")
    return days.join(known, "statement_id", "left").withColumn("opening", F.coalesce("opening", F.lit(0).cast(MONEY)))
