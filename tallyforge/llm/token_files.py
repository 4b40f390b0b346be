"""Token-ID / binary output: flat unsigned integer files with 64-bit document offsets.

Layout in the output folder, for partition p in ascending doc_id order (one line of the manifest each):
  part-p-<attempt>.bin   token ids, uint16 where the vocabulary allows, else uint32, little-endian
  part-p-<attempt>.off   int64 offsets of its documents, from 0, one more than documents
  part-p-<attempt>.doc   int64 document ids (null ids come first; the manifest counts them)
Partition bases are prefix sums of the manifest's token counts, one row for each partition.

A task writes files named by its attempt and reports them in its result, so a lost executor or a speculative copy
leaves only files that no manifest names.
"""

from __future__ import annotations

import json
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import encoder

MANIFEST = "part int, name string, n_null long, n_docs long, n_tokens long"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"
END_ID = 2


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int = END_ID) -> list[dict]:
    """Encode every text (null: empty) and write it in ascending doc_id order; returns the manifest with bases.

    A text of any length is encoded whole; repeated doc_ids are written one after the other; an empty table gives an empty manifest; columns other than
    doc_id and text are ignored. The manifest has one row for each partition, not for each document.
    """

    def write(batches):
        enc = encoder(tokenizer)
        kind = np.dtype("<u2") if max(enc.vocab - 1, end_id) < 1 << 16 else np.dtype("<u4")
        end = np.array([end_id], "<u4").tobytes()
        ctx = TaskContext.get()
        name = f"part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}"
        fs, root = _fs(out_dir)
        fs.create_dir(root, recursive=True)
        sizes, ids, n_null, n_tokens, out = [], [], 0, 0, None
        for batch in batches:
            if out is None:
                out = fs.open_output_stream(f"{root}/{name}.bin")
            col = batch.column(0)
            n_null += col.null_count
            ids.append(col.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
            texts = batch.column(1)
            for lo in range(0, len(texts), 512):
                got = enc.encode(texts.slice(lo, 512).to_pylist())
                out.write(np.frombuffer(end.join([*got, b""]), "<u4").astype(kind).tobytes())
                sizes += [len(b) // 4 + 1 for b in got]
        if out is None:
            return
        out.close()
        off = np.zeros(len(sizes) + 1, "<i8")
        np.cumsum(sizes, out=off[1:])
        for ext, data in (("off", off), ("doc", np.concatenate(ids))):
            with fs.open_output_stream(f"{root}/{name}.{ext}") as f:
                f.write(data.tobytes())
        yield pa.RecordBatch.from_pylist([{"part": ctx.partitionId(), "name": f"{name}|{kind.str}", "n_null": n_null, "n_docs": len(sizes), "n_tokens": int(off[-1])}], schema=pa.schema([("part", pa.int32()), ("name", pa.string()), ("n_null", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    spark = docs.sparkSession
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    parts = sorted((r.asDict() for r in ordered.mapInArrow(write, MANIFEST).collect()), key=lambda r: r["part"])
    for r, base in zip(parts, accumulate((r["n_tokens"] for r in parts), initial=0)):
        r["name"], r["dtype"] = r["name"].split("|")
        r["base"] = base
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{out_dir}/manifest.json")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(json.dumps(parts).encode()))
    out.close()
    return parts


def _slices(fs, path: str, kind: str):
    """A function that gives items lo to hi of a file: memory-mapped on a local or mounted file system, else read from
    the store, only these."""
    kind = np.dtype(kind)
    if fs.type_name == "local":
        whole = np.memmap(path, kind, "r") if fs.get_file_info(path).size else np.zeros(0, kind)
        return lambda lo, hi: whole[lo:hi]
    f = fs.open_input_file(path)
    return lambda lo, hi: np.frombuffer(f.read_at(int(hi - lo) * kind.itemsize, int(lo) * kind.itemsize), kind)


def read_token_files(spark: SparkSession, out_dir: str, parts: list[dict]) -> DataFrame:
    """One row for each document of the files: its global start, token count and the crc32 of its ids as uint32."""

    def read(batches):
        fs, root = _fs(out_dir)
        for batch in batches:
            for r in batch.to_pylist():
                tokens, offsets, docs = (_slices(fs, f"{root}/{r['name']}.{ext}", kind) for ext, kind in (("bin", r["dtype"]), ("off", "<i8"), ("doc", "<i8")))
                for lo in range(0, r["n_docs"], 1024):
                    hi = min(lo + 1024, r["n_docs"])
                    off = offsets(lo, hi + 1)
                    crcs = [zlib.crc32(tokens(a, b).astype("<u4").tobytes()) for a, b in zip(off, off[1:])]
                    nulls = max(0, min(hi, r["n_null"]) - lo)
                    ids = [None] * nulls + docs(lo + nulls, hi).tolist()
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(off[:-1] + r["base"], pa.int64()), pa.array(np.diff(off), pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = [(r["name"], r["dtype"], r["n_null"], r["n_docs"], r["base"]) for r in parts]
    files = spark.createDataFrame(spark.sparkContext.parallelize(rows, max(1, len(rows))), "name string, dtype string, n_null long, n_docs long, base long")
    return files.mapInArrow(read, RESULT)
