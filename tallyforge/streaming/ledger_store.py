"""Tables of what documents were posted to, rewritten document by document: entries, payment edges, costs.

A row belongs to a document and a month. The rows of one month lie in a folder of their own, and a manifest names the
folder of each month and table; an index from documents to months, in buckets, tells which months a document is in. What a
batch of documents had is replaced, wherever it was, by rewriting the months and buckets that it touches into new folders;
writing the next manifest then changes all tables at once. Whoever reads uses one manifest. A batch that is written again
is known by its number; one that broke off leaves folders that no manifest names, and the next one deletes them.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.folders import Folders

BUCKETS = 64


class LedgerStore:
    """One writer at a time; any number of readers. schemas: a DDL for each table, with document_id and a text month."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str]):
        self.spark, self.path, self.folders = spark, path.rstrip("/"), Folders(spark)
        self.schemas = {name: StructType.fromDDL(ddl) for name, ddl in schemas.items()}
        key = next(iter(self.schemas.values()))["document_id"].dataType.simpleString()
        self.index_schema = StructType.fromDDL(f"document_id {key}, month string, bucket int")

    def _manifests(self) -> list[int]:
        return sorted(int(n[9:-5]) for n in self.folders.names(self.path) if n.startswith("manifest-") and n.endswith(".json"))

    def _manifest(self, number: int | None = None) -> dict:
        numbers = self._manifests()
        if not numbers:
            return {"number": 0, "batches": {}, "tables": {name: {} for name in self.schemas}, "index": {}}
        return json.loads(self.folders.text(f"{self.path}/manifest-{number or numbers[-1]}.json"))

    def _read(self, schema: StructType, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def read(self, table: str, months: list[str] | None = None) -> DataFrame:
        """A table as the last manifest has it, or some months of it."""
        known = self._manifest()["tables"][table]
        return self._read(self.schemas[table], [f for m, f in known.items() if months is None or m in months])

    def replace(self, documents: DataFrame, rows: dict[str, DataFrame], batch: tuple[str, int] | None = None) -> bool:
        """The documents' rows are now these, in every table; tables that aren't named have none. A document without rows is
        only removed, and a month without any has no folder. batch: a name and a number that grows; one that was written
        before changes nothing (False). Null document_ids are ignored."""
        before = self._manifest()
        if batch is not None and before["batches"].get(batch[0], -1) >= batch[1]:
            return False
        stage = f"versions/{before['number'] + 1}-{uuid.uuid4().hex}"
        ids = self._staged(documents.select("document_id").where("document_id is not null").distinct(), f"{stage}/ids")
        new = {name: self._staged(rows[name].select(*schema.names).join(ids, "document_id", "left_semi"), f"{stage}/new-{name}") for name, schema in self.schemas.items() if name in rows}
        bucket = F.pmod(F.xxhash64("document_id"), F.lit(BUCKETS)).cast("int").alias("bucket")
        touched = [str(r[0]) for r in ids.select(bucket).distinct().collect()]
        index = self._read(self.index_schema, [f for b, f in before["index"].items() if b in touched])
        placed = reduce(DataFrame.union, (df.select("document_id", "month") for df in new.values()), ids.limit(0).withColumn("month", F.lit("")))
        months = {r[0] for r in index.join(ids, "document_id", "left_semi").select("month").union(placed.select("month")).distinct().collect()}
        tables = {}
        for name, schema in self.schemas.items():
            known = before["tables"][name]
            old = self._read(schema, [f for m, f in known.items() if m in months]).join(ids, "document_id", "left_anti")
            all_ = old.unionByName(new[name]) if name in new else old
            written = self._written(all_.withColumn("at", F.col("month")), f"{stage}/{name}")
            tables[name] = {m: f for m, f in known.items() if m not in months} | written
        kept = index.join(ids, "document_id", "left_anti").unionByName(placed.distinct().select("document_id", "month", bucket))
        after = self._written(kept.withColumn("at", F.col("bucket")), f"{stage}/index")
        batches = before["batches"] | ({batch[0]: batch[1]} if batch else {})
        self._commit({"number": before["number"] + 1, "batches": batches, "tables": tables, "index": {b: f for b, f in before["index"].items() if b not in touched} | after})
        return True

    def remove(self, documents: DataFrame) -> bool:
        """A reopened or deleted document loses its rows in all tables at once."""
        return self.replace(documents, {})

    def _staged(self, df: DataFrame, folder: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{folder}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{folder}")

    def _written(self, df: DataFrame, folder: str) -> dict[str, str]:
        """The folder of each value of `at` that has rows. Large months are dealt to several tasks."""
        df.hint("rebalance", "at").write.mode("overwrite").partitionBy("at").parquet(f"{self.path}/{folder}")
        return {n[3:]: f"{folder}/{n}" for n in self.folders.names(f"{self.path}/{folder}") if n.startswith("at=")}

    def _commit(self, manifest: dict) -> None:
        """The manifest, then a cleaning: what neither it nor the one before names goes."""
        number = manifest["number"]
        self.folders.write_new(f"{self.path}/manifest-{number}.json", json.dumps(manifest))
        for old in self._manifests():
            if old < number - 1:
                self.folders.delete(f"{self.path}/manifest-{old}.json")
        named = [self._manifest(n) for n in self._manifests()]
        used = {f.split("/")[1] + "/" + f.split("/")[2] for m in named for part in (*m["tables"].values(), m["index"]) for f in part.values()}
        for version in self.folders.names(f"{self.path}/versions"):
            inside = self.folders.names(f"{self.path}/versions/{version}")
            left = [x for x in inside if f"{version}/{x}" in used]
            for x in inside if left else []:
                if x not in left:
                    self.folders.delete(f"{self.path}/versions/{version}/{x}")
            if not left:
                self.folders.delete(f"{self.path}/versions/{version}")
