"""Small helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's spark.checkpoint.dir. Where that is unset, a folder of our own if all
    executors run in this process, else an error: a local folder of the driver is none that executors share."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = getattr(spark.sparkContext, "_tallyforge_dir", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="tallyforge-")
        spark.sparkContext._tallyforge_dir = own
    return own


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Shuffle files go as soon as the query that wrote them has ended, not when the driver's memory is next cleaned.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, among: list[DataFrame] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, its shuffle files go and Spark knows the true
    size. The table is added to `among`, so that the caller can drop it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if among is not None:
        among.append(out)
    return out


def dropped(df: DataFrame) -> None:
    """Delete a stored() table that nothing reads any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        removed(df.sparkSession, path)


def removed(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def met_by_key(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """rows (a stored table) with the columns of their group; groups has one row a key, nulls included, and the number n of
    its rows. Keys with over a thousandth of all rows, so fewer than a thousand keys, are sent to all executors, and no
    task gets the rows of such a key; the other rows meet their group in a shuffle, a key that isn't in groups has nulls.
    """
    total = groups.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot, rest = groups.where(F.col("n") * 1000 > total), groups.where(F.col("n") * 1000 <= total)
    out = [c for c in groups.columns if c not in (*keys, "n")]
    on = lambda g: [F.col(f"r.{k}").eqNullSafe(F.col(f"{g}.{k}")) for k in keys]
    found = rows.alias("r").join(F.broadcast(hot.alias("h")), on("h")).select("r.*", *(F.col(f"h.{c}") for c in out))
    cold = rows.alias("r").join(F.broadcast(hot.select(*keys).alias("h")), on("h"), "left_anti").select("r.*").alias("r")
    return found.unionByName(cold.join(rest.alias("g").hint("merge"), on("g"), "left").select("r.*", *(F.col(f"g.{c}") for c in out)))


def crc32_text(col: str):
    """crc32 of an id written as text."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def bounded_sample(labelled: DataFrame, key: str, rows: int) -> DataFrame:
    """At most `rows` rows, those with the smallest hash of `key`: the same ones in any order of the input."""
    return labelled.orderBy(F.xxhash64(F.col(key), F.lit(20240229)), F.col(key)).limit(rows)
