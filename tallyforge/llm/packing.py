"""Packing: first-fit decreasing with a tournament tree of bin capacities, run independently in randomised groups."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import MAX_WORDS, encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
RESULT = PIECES + ", sequence_id long, offset long"
SEQUENCE = 4096
GROUP_DOCS = 4096
END_ID = 2


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item. A complete binary tree holds at each node the largest room below it, so the
    first bin with enough room is found by one walk from the root."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    whole = int((lengths >= capacity).sum())
    bins[order[:whole]] = np.arange(whole)
    rest = order[whole:].tolist()
    if not rest:
        return bins, offsets
    width = 1 << (len(rest) - 1).bit_length()
    room = [capacity] * (2 * width)
    sizes = lengths.tolist()
    for item in rest:
        need, at = sizes[item], 1
        while at < width:
            at *= 2
            if room[at] < need:
                at += 1
        bins[item], offsets[item] = whole + at - width, capacity - room[at]
        room[at] -= need
        while at > 1:
            at //= 2
            top = max(room[2 * at], room[2 * at + 1])
            if room[at] == top:
                break
            room[at] = top
    return bins, offsets


def token_pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID, max_words: int = MAX_WORDS) -> DataFrame:
    """Documents as pieces of at most `sequence` tokens, with the end id as the last token of each document. A worker keeps
    the ids of max_words words."""

    def cut(batches):
        enc = encoder(tokenizer, max_words)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = [[], [], [], [], []]
                for doc, b in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist())):
                    b += end
                    for at in range(0, len(b), 4 * sequence):
                        piece = b[at : at + 4 * sequence]
                        for col, v in zip(rows, (doc, at // 4, len(piece) // 4, zlib.crc32(piece), len(b) // 4)):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, group_docs: int = GROUP_DOCS, max_words: int = MAX_WORDS) -> DataFrame:
    """Pieces of all documents with the sequence and the offset that they go to.

    Null texts are empty documents of one end id; null and repeated doc_ids are packed row by row; an empty table
    gives no rows; other columns are ignored. A group has about group_docs documents whatever the input's size, as
    the number of groups follows from the number of documents; pieces are dealt by a hash, so no source, key or
    long document fills a group.
    """
    groups = max(1, -(-docs.count() // group_docs))
    pieces = token_pieces(docs, tokenizer, sequence, max_words=max_words)
    apart = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())  # else equal texts without an id would be one group
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", apart, F.lit(7)), F.lit(groups)))

    def ffd(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start"], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), sequence)
        return pdf.drop(columns="grp").assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    return dealt.groupBy("grp").applyInPandas(ffd, RESULT)
