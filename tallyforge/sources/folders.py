"""Small things that a file system under Spark does: list, read, write, rename and delete; tables in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Folders:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self._conf), where

    def names(self, path: str) -> list[str]:
        """Names in a folder; a folder that isn't there has none."""
        fs, where = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def text(self, path: str) -> str:
        fs, where = self._at(path)
        stream = fs.open(where)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, path: str, text: str) -> None:
        """The whole text under a name that nothing has yet: written beside it, then renamed."""
        fs, where = self._at(path)
        if fs.exists(where):
            raise FileExistsError(path)
        beside = self._jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
        out = fs.create(beside, True)
        out.write(bytearray(text, "utf-8"))
        out.close()
        if not fs.rename(beside, where):
            raise FileExistsError(path)

    def delete(self, path: str) -> None:
        fs, where = self._at(path)
        fs.delete(where, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one where all executors run in this process."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not hasattr(spark.sparkContext, "_tallyforge_tables"):
        spark.sparkContext._tallyforge_tables = "file://" + tempfile.mkdtemp(prefix="tallyforge-")
    return spark.sparkContext._tallyforge_tables


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, for what is read several times or whose size Spark should know."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
