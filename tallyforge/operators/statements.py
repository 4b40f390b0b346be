"""Bank statements: balances by day, the chain of printed balances, repairs and checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import MONEY
from ..functions.normalise import is_summary_row

TOLERANCE, GAP, MOST_DAYS = 0.02, 0.5, 1.0


def _moved() -> Column:
    return F.col("credit") - F.col("debit")


def running_balance(rows: DataFrame, controls: DataFrame) -> DataFrame:
    """Balance after each row: the closing printed for the day before (at first: opening), and the day's rows up to it.

    rows: statement_id, row_no, day, ts, debit, credit; controls: statement_id, day, closing, opening. A window holds one
    day of a statement, never a statement.
    """
    days = Window.partitionBy("statement_id").orderBy("day")
    starts = controls.select("statement_id", "day", F.coalesce(F.lag("closing").over(days), F.col("opening")).alias("start"))
    met = rows.join(starts, ["statement_id", "day"], "left")
    w = Window.partitionBy("statement_id", "day").orderBy("ts", "row_no").rowsBetween(Window.unboundedPreceding, 0)
    return met.select("statement_id", "row_no", (F.coalesce("start", F.lit(0).cast(MONEY)) + F.sum(_moved()).over(w)).cast("double").alias("balance"))


def turnover_gaps(rows: DataFrame, controls: DataFrame) -> DataFrame:
    """Debit and credit of each day against the printed turnover."""
    sums = rows.groupBy("statement_id", "day").agg(F.sum("debit").alias("d"), F.sum("credit").alias("c"), F.count("*").alias("n_rows"))
    met = sums.join(controls.select("statement_id", "day", "debit", "credit"), ["statement_id", "day"], "full_outer")
    gap = lambda a, b: F.abs(F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0))).cast("double")
    return met.select("statement_id", "day", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), gap("d", "debit").alias("debit_gap"), gap("c", "credit").alias("credit_gap"))


#: A mixed day is only solved up to so many rows and so large a credit turnover.
MOST_ROWS, MOST_CREDIT = 40, 100_000
CENT = 0.011


def credit_subset(rows: list[int], cents: list[int], target: int) -> list[int] | None:
    """Rows whose cents sum up to the target, if there are any: of several choices the one whose last row is the earliest,
    then whose last but one is, and so on. Bit s of a number says whether the rows so far can give the sum s."""
    sums, mask = [1], (1 << (target + 1)) - 1
    for c in cents:
        sums.append((sums[-1] | sums[-1] << c) & mask)
    if not sums[-1] >> target & 1:
        return None
    chosen = []
    while target:
        i = next(i for i, s in enumerate(sums) if s >> target & 1) - 1
        chosen.append(rows[i])
        target -= cents[i]
    return chosen[::-1]


def _credits():
    @F.pandas_udf("array<long>")
    def credits(rows: pd.Series, cents: pd.Series, target: pd.Series) -> pd.Series:
        return pd.Series([credit_subset(r.tolist(), c.tolist(), int(t)) for r, c, t in zip(rows, cents, target)], dtype=object)

    return credits


def day_decisions(rows: DataFrame, controls: DataFrame) -> DataFrame:
    """What becomes of each day with printed turnovers: all rows are debits where no credit is printed, credits where no
    debit is; the rows of a complete mixed day that sum up to the credits are `credits`. flagged days stay as they were
    read: those that aren't complete or have no such rows, and those over MOST_ROWS or MOST_CREDIT, unless the sides as
    read give the printed turnovers."""
    at = ["statement_id", "day"]
    amount = F.abs("debit") + F.abs("credit")
    sums = rows.groupBy(*at).agg(F.count("*").alias("n"), F.sum(amount).alias("total"), F.sum(F.abs("debit")).alias("d"), F.sum(F.abs("credit")).alias("c"))
    met = sums.join(controls.where("debit is not null and credit is not null").select(*at, F.col("debit").alias("day_debit"), F.col("credit").alias("day_credit")), at)
    no = lambda c: F.abs(c) <= CENT
    complete, small = no(F.col("total") - F.col("day_debit") - F.col("day_credit")), (F.col("n") <= MOST_ROWS) & (F.col("day_credit") <= MOST_CREDIT)
    kind = F.when(no(F.col("day_credit")), "debit").when(no(F.col("day_debit")), "credit").when(complete & small & (F.col("day_credit") > 0), "mixed").otherwise("kept")
    days = met.withColumn("kind", kind)
    mixed = days.where("kind = 'mixed'").select(*at, (F.col("day_credit") * 100).cast("long").alias("target"))
    own = rows.select(*at, "row_no", (amount * 100).cast("long").alias("cents")).join(mixed, at)
    listed = own.groupBy(*at, "target").agg(F.array_sort(F.collect_list(F.struct("row_no", "cents"))).alias("own"))
    solved = listed.select(*at, _credits()(F.col("own.row_no"), F.col("own.cents"), "target").alias("credits"))
    out = days.join(solved, at, "left")
    wrong = F.when(F.col("kind") == "debit", ~no(F.col("total") - F.col("day_debit"))).when(F.col("kind") == "credit", ~no(F.col("total") - F.col("day_credit"))).when(F.col("kind") == "mixed", F.col("credits").isNull()).otherwise(~(no(F.col("d") - F.col("day_debit")) & no(F.col("c") - F.col("day_credit"))))
    return out.select(*at, F.when((F.col("kind") == "mixed") & F.col("credits").isNull(), "kept").otherwise(F.col("kind")).alias("kind"), "credits", wrong.alias("flagged"))


def repair_day_directions(rows: DataFrame, controls: DataFrame) -> DataFrame:
    """Debit and credit of each row after day_decisions(); days without printed turnovers stay and aren't flagged."""
    met = rows.join(day_decisions(rows, controls), ["statement_id", "day"], "left")
    amount, zero = (F.abs("debit") + F.abs("credit")).cast(MONEY), F.lit(0).cast(MONEY)
    is_credit = F.when(F.col("kind") == "mixed", F.array_contains("credits", F.col("row_no"))).when(F.col("kind").isin("debit", "credit"), F.col("kind") == "credit")
    side = lambda own, c: F.when(is_credit == own, amount).when(is_credit == (not own), zero).otherwise(F.col(c)).cast("double").alias(c)
    return met.select("statement_id", "row_no", side(False, "debit"), side(True, "credit"), F.coalesce("flagged", F.lit(False)).alias("flagged"))


def balance_chain(statements: DataFrame, rows: DataFrame) -> DataFrame:
    """For each statement: phantom rows (an amount, but the balance of the row before), unexplained jumps, and whether
    the phantoms go: only if balances are printed on 80 % of the rows and vary, and the gap doesn't get worse.

    statements: statement_id, opening, closing; rows: statement_id, row_no, ts, debit, credit, balance. A phantom has its
    predecessor's balance, so the balance before a row is the last printed one, whether phantoms are kept or not; amounts
    of rows without one are added up since then.
    """
    order = Window.partitionBy("statement_id").orderBy("ts", "row_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    met = rows.join(statements, "statement_id").withColumn("amount", F.abs("credit") - F.abs("debit"))
    met = met.withColumn("run", F.coalesce(F.sum(F.when(F.col("balance").isNotNull(), 1)).over(before), F.lit(0)))
    part = Window.partitionBy("statement_id", "run").orderBy("ts", "row_no").rowsBetween(Window.unboundedPreceding, -1)
    since = F.sum(F.when(F.col("balance").isNull(), F.col("amount"))).over(part)
    met = met.withColumn("prior", F.coalesce(F.last("balance", True).over(before), F.col("opening")) + F.coalesce(since, F.lit(0)))
    phantom = F.coalesce((F.abs(F.col("balance") - F.col("prior")) <= TOLERANCE) & (F.abs("amount") > TOLERANCE), F.lit(False))
    jump = F.coalesce(~phantom & (F.abs(F.col("balance") - F.col("prior") - F.col("amount")) > TOLERANCE), F.lit(False))
    sums = met.groupBy("statement_id").agg(F.count("*").alias("n_rows"), F.count("balance").alias("printed"), F.count_distinct("balance").alias("kinds"), F.count_if(phantom).alias("phantoms"), F.count_if(jump).alias("jumps"), F.first("opening").alias("opening"), F.first("closing").alias("closing"), F.sum("amount").alias("all"), F.coalesce(F.sum(F.when(~phantom, F.col("amount"))), F.lit(0)).alias("kept"))
    usable = (F.col("printed") * 10 >= F.col("n_rows") * 8) & (F.col("kinds") >= F.greatest(F.lit(2), F.floor(F.col("printed") / 2)))
    gap = lambda moved: F.abs(F.col("opening") + F.col(moved) - F.col("closing"))
    drop = usable & (F.col("phantoms") > 0) & (gap("kept") <= gap("all") + TOLERANCE)
    return sums.select("statement_id", "n_rows", F.when(usable, F.col("jumps")).alias("jumps"), F.when(drop, F.col("phantoms")).otherwise(0).alias("dropped"), usable.alias("usable"), (F.when(drop, gap("kept")).otherwise(gap("all")) <= GAP).alias("reconciled"))


def chain_endpoints(rows: DataFrame) -> DataFrame:
    """Opening and closing as the first and the last row's printed balances give them."""
    at = F.struct("ts", "row_no")
    ends = rows.groupBy("statement_id").agg(F.min_by(F.col("balance") - _moved(), at).alias("opening"), F.max_by("balance", at).alias("closing"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return ends.select("statement_id", F.col("opening").cast("double").alias("opening"), F.col("closing").cast("double").alias("closing"), "first_day", "last_day")


def first_of_equal(rows: DataFrame) -> DataFrame:
    """The first row of each (statement, day, reference, amounts, balance, first 40 characters of the description)."""
    keys = ["statement_id", "day", "reference", "debit", "credit", "balance", F.substring("description", 1, 40).alias("head")]
    return rows.groupBy(*keys).agg(F.min_by(F.struct("row_no", "description"), F.struct("ts", "row_no")).alias("r")).select("statement_id", "r.row_no", "r.description", "reference")


def without_summary_rows(rows: DataFrame) -> DataFrame:
    """Rows that aren't printed turnovers, balances or totals, with absolute amounts."""
    return rows.where(~is_summary_row(F.col("description"))).withColumns({c: F.abs(c).cast(MONEY) for c in ("debit", "credit")})


def reconciled(statements: DataFrame, rows: DataFrame) -> DataFrame:
    """abs(opening + credits - debits - closing) and whether it is at most GAP; null where a balance is missing."""
    sums = rows.groupBy("statement_id").agg(F.sum(F.abs("credit") - F.abs("debit")).alias("moved"))
    gap = F.abs(F.col("opening") + F.coalesce("moved", F.lit(0)) - F.col("closing"))
    return statements.join(sums, "statement_id", "left").select("statement_id", gap.cast("double").alias("gap"), (gap <= GAP).alias("reconciled"))
