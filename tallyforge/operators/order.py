"""Positions in an order, without a task that holds a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import written

#: Rows of the table of parts up to which it is sent to all executors.
BROADCAST_PARTS = 100_000


def positions(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """df with the position of each row in its group, from 1, in ascending order, nulls first.

    Rows are dealt by range of (group, order) and sorted there, so a large group lies in many tasks. A number that grows
    along the sorted table gives the place inside a part of a group; what lies before a part comes from the sizes of the
    group's parts, one small row each. The order should tell all rows of a group apart, else ties are in any order.
    """
    dealt = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    table = written(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "sorted")
    parts = table.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = written(parts.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n"), "parts")
    sized = F.broadcast(starts.alias("p")) if starts.count() <= BROADCAST_PARTS else starts.alias("p").hint("merge")
    on = reduce(lambda a, b: a & b, (F.col(f"t.{c}").eqNullSafe(F.col(f"p.{c}")) for c in (*by, "_part")))
    met = table.alias("t").join(sized, on)
    return met.select(*(F.col(f"t.{c}") for c in df.columns), (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias(name))
