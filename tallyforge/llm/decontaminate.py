"""Benchmark decontamination by the q-gram lemma.

Benchmark texts are cut into overlapping windows of two lengths. Every PASSAGE bytes in a row of an item hold a whole
short window, so a verbatim quotation of that length (about 7 words) is found at any offset, and so is a changed one
that leaves a short window within its edits (2); long windows, and whole items that are shorter, allow up to EDITS.
Quotations under PASSAGE bytes are found only where they hold a whole window or item.

A region within e edits of a window of m bytes shares at least m - Q + 1 - Q * e of its q-grams, on diagonals that
differ by at most e. Hits are counted in overlapping diagonal bands, bands that reach the bound are kept, and a banded
alignment decides. Texts are compared as UTF-8 bytes after NFC and case folding of all letters, with each ASCII white
space as a blank; positions count the bytes of the text as it was.
"""

from __future__ import annotations

import unicodedata
import uuid
from bisect import bisect_left, bisect_right
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q, WINDOW, STEP, EDITS = 12, 100, 50, 6
#: The shortest passage that must be found at any offset, and the step of the short windows, which are as long as the
#: passage leaves them.
PASSAGE, SHORT_STEP = 50, 10
SHORT = PASSAGE - SHORT_STEP + 1
TABLE_BITS = 22
#: Benchmark bytes that go to the executors at once; more of them take further passes over the documents. Each Python
#: worker builds its index of them, of about 60 bytes for each.
BLOCK_BYTES = 2_000_000
#: Bytes of text that are searched at once (longer texts in pieces that overlap by more than a window and its edits), and
#: hits that are counted at once.
PIECE, HITS = 2_000_000, 2_000_000
OVERLAP = 2 * WINDOW
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c in (9, 10, 11, 12, 13) else c for c in range(256))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def fold(text: str) -> bytes:
    if not text.isascii():
        text = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())
    return text.encode("utf-8", "surrogatepass").translate(_FOLD)


@cache
def _seconds() -> frozenset[str]:
    """Characters that NFC may join with the one before them although they aren't combining marks, and some marks."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x20000))
    return frozenset(chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<") | frozenset(map(chr, (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))))


@cache
def _joins(char: str) -> bool:
    first = unicodedata.normalize("NFD", char)[0]
    return unicodedata.combining(first) > 0 or first in _seconds()


class Places:
    """Way back from positions in fold(text) to positions in the UTF-8 bytes of text."""

    def __init__(self, text: str):
        self.raw = self.folded = None
        if text.isascii():
            return
        begins = [i for i, c in enumerate(text) if not i or not _joins(c)]
        self.raw, self.folded = [0], [0]
        for a, b in zip(begins, [*begins[1:], len(text)]):
            self.raw.append(self.raw[-1] + len(text[a:b].encode("utf-8", "surrogatepass")))
            self.folded.append(self.folded[-1] + len(fold(text[a:b])))

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The least stretch of whole letters of text that covers the bytes start to end of fold(text)."""
        if self.raw is None:
            return start, end
        return self.raw[min(bisect_right(self.folded, start), len(self.raw) - 1) - 1], self.raw[min(bisect_left(self.folded, end), len(self.raw) - 1)]


def grams(buf: np.ndarray) -> np.ndarray:
    """64-bit hash of the Q bytes at each position, from two overlapping words of eight bytes."""
    n = len(buf)
    if n < Q:
        return np.zeros(0, np.uint64)
    word = np.empty(n - 7, np.uint64)
    for o in range(min(8, n - 7)):
        part = np.frombuffer(buf, "<u8", (n - o) // 8, o)
        word[o::8] = part[: len(word[o::8])]
    h = word[: n - Q + 1] * _A
    h ^= (word[Q - 8 :] * _B)[: n - Q + 1] >> np.uint64(7)
    return h * _A


def edits_allowed(m: int) -> int:
    """EDITS for a whole window, in proportion for a shorter one, and so few that the lemma asks for two q-grams."""
    return max(0, min(EDITS * m // WINDOW, (m - Q - 1) // Q))


class Windows:
    """The windows of a block of benchmark items, with an index of their q-grams."""

    def __init__(self, items: list[tuple[int, str]]):
        self.item, self.at, self.text = [], [], []
        folded = [(item, fold(text).strip(b" ")) for item, text in items]
        for most, step in ((WINDOW, STEP), (SHORT, SHORT_STEP)):
            for item, b in folded:
                if len(b) < Q or most == SHORT >= len(b):
                    continue
                last = max(0, len(b) - most)
                for s in dict.fromkeys((*range(0, last, step), last)):
                    self.item.append(item), self.at.append(s), self.text.append(b[s : s + most])
        self.length = np.array([len(t) for t in self.text], np.int64)
        self.edits = np.array([edits_allowed(len(t)) for t in self.text], np.int64)
        self.need = np.maximum(1, self.length - Q + 1 - Q * self.edits)
        self.padded = np.zeros((len(self.text), WINDOW), np.uint8)
        hashes, owner, offset = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int16)]
        for w, t in enumerate(self.text):
            self.padded[w, : len(t)] = np.frombuffer(t, np.uint8)
            g = grams(np.frombuffer(t, np.uint8))
            hashes.append(g), owner.append(np.full(len(g), w, np.int32)), offset.append(np.arange(len(g), dtype=np.int16))
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        self.owner, self.offset = np.concatenate(owner)[order], np.concatenate(offset)[order]
        self.keys, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.keys >> np.uint64(64 - TABLE_BITS)] = True

    def find(self, docs: list[bytes]) -> list[tuple[int, int, int, int, int, int]]:
        """(document, item, edits, start, end, window) of every verified region of folded documents; positions in bytes."""
        gap = WINDOW + 4 * EDITS + 8
        buf = np.frombuffer((b"\x00" * gap).join([b"", *docs, b""]), np.uint8)
        bounds = np.cumsum([gap, *(len(d) + gap for d in docs)])[:-1] if docs else np.zeros(0, int)
        g = grams(buf)
        at = np.flatnonzero(self.table[g >> np.uint64(64 - TABLE_BITS)])
        if not len(at) or not len(self.keys):
            return []
        k = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
        hit = self.keys[k] == g[at]
        at, k = at[hit], k[hit]
        if not len(at):
            return []
        half, wide = EDITS + 1, 2 * (len(buf) + 2 * WINDOW)
        key, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        times = np.cumsum(self.count[k])
        cuts = np.searchsorted(times, np.arange(HITS, times[-1], HITS)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(at)]):  # text of one character hits all grams of such items
            if a < b:
                part, n = self._bands(at[a:b], k[a:b], half, wide)
                key, which = np.unique(np.concatenate([key, part]), return_inverse=True)
                count = np.bincount(which, np.concatenate([count, n]), len(key)).astype(np.int64)
        window, band = key // wide, key % wide
        enough = count >= self.need[window]
        window, band = window[enough], band[enough]
        if not len(window):
            return []
        low = band // 2 * (2 * half) - half * (band % 2) - WINDOW
        found = []
        for lo in range(0, len(window), 4096):
            w, s = window[lo : lo + 4096], low[lo : lo + 4096]
            cost, end = self._align(buf, w, s - EDITS)
            for i in np.flatnonzero(cost <= self.edits[w]):
                d = int(np.searchsorted(bounds, s[i] + half + self.length[w[i]] // 2, side="right")) - 1
                found.append((d, self.item[w[i]], int(cost[i]), max(0, int(end[i] - self.length[w[i]] - bounds[d])), int(end[i] - bounds[d]), int(w[i])))
        return found

    def _bands(self, at: np.ndarray, k: np.ndarray, half: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows and diagonal bands (as window * wide + band) that the q-grams at some places hit, and how often."""
        times = self.count[k]
        pos = np.repeat(at, times)
        slot = np.repeat(self.first[k], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        window, diagonal = self.owner[slot].astype(np.int64) * wide, pos - self.offset[slot] + WINDOW
        return np.unique(np.concatenate([window + diagonal // (2 * half) * 2, window + (diagonal + half) // (2 * half) * 2 + 1]), return_counts=True)

    def _align(self, buf: np.ndarray, window: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least edits between each window and a stretch of buf whose diagonals lie in a band from start on, for
        all candidates at once; a step goes one byte down the windows. Also the end of the best stretch."""
        width = 2 * (EDITS + 1) + 2 * EDITS + 1
        far = np.arange(width)
        cost = np.zeros((len(window), width), np.int32)
        cost_end, end = np.full(len(window), 1 << 20, np.int32), np.zeros(len(window), np.int64)
        length = self.length[window]
        for i in range(int(length.max())):
            place = start[:, None] + i + far
            text = np.where((place >= 0) & (place < len(buf)), buf[np.clip(place, 0, len(buf) - 1)], 0)
            new = cost + (text != self.padded[window, i][:, None])
            new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
            cost = np.minimum.accumulate(new - far, axis=1) + far
            done = length == i + 1
            if done.any():
                best = cost[done].argmin(1)
                cost_end[done] = cost[done, best]
                end[done] = start[done] + i + 1 + best
        return cost_end, end


def _blocks(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    """The benchmark's items in blocks of bounded size, one after the other."""
    known = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    for k in range(n):
        part = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield sorted((r["item_id"], r["text"]) for r in part.collect())


_BUILT: dict[str, Windows] = {}


def _windows(name: str, items: list[tuple[int, str]]) -> Windows:
    """The windows of a block, built once in each worker, which keeps one block."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Windows(items)
    return _BUILT[name]


def _texts(column):
    """(rows, places of their first bytes in the row's text, folded texts or pieces of them), about PIECE bytes at once."""
    rows, places, block, size = [], [], [], 0
    for i, text in enumerate(column):
        b = fold(text.as_py() or "")
        for at in range(0, max(1, len(b) - OVERLAP), PIECE):
            part = b if len(b) <= PIECE else b[at : at + PIECE + OVERLAP]
            rows.append(i), places.append(at), block.append(part)
            size += len(part)
            if size > PIECE:
                yield rows, places, block
                rows, places, block, size = [], [], [], 0
    yield rows, places, block


LEAKS = "doc_id long, item_id long, n_windows long, edits long, start long, end long"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each row of docs and benchmark item that leaks into it: how many of the item's windows match, the
    least edits of one, and the UTF-8 bytes of the text from the first to the last match.

    Null or empty texts on either side match nothing, nor do items under Q bytes; very long texts are searched in
    overlapping pieces; of equal items each is reported; repeated documents give repeated rows; empty tables give no
    rows; other columns are not read.
    """
    out = None
    for items in _blocks(benchmark):

        def search(batches, items=items, name=uuid.uuid4().hex):
            windows = _windows(name, items)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = {}
                for doc, place, block in _texts(batch.column(1)):
                    for d, item, edits, start, end, window in windows.find(block):
                        start, end = start + place[d], end + place[d]
                        n, e, s, t = rows.get((doc[d], item), (set(), edits, start, end))
                        n.add(window)
                        rows[doc[d], item] = (n, min(e, edits), min(s, start), max(t, end))
                places = {d: Places(batch.column(1)[d].as_py()) for d in {d for d, _ in rows}}
                got = [(ids[d], item, len(n), e, *places[d].span(s, t)) for (d, item), (n, e, s, t) in sorted(rows.items())]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*got) if got else [[]] * 6)], names=["doc_id", "item_id", "n_windows", "edits", "start", "end"])

        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(search, LEAKS)
        out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], LEAKS) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that no benchmark item leaks into, with all their columns, whatever their names.

    Null and empty texts stay; very long texts are searched in overlapping pieces; repeated rows stay or go together;
    without a benchmark all rows stay; an empty table stays empty.
    """
    for items in _blocks(benchmark):

        def clean(batches, items=items, name=uuid.uuid4().hex):
            windows = _windows(name, items)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for doc, _, block in _texts(batch.column(batch.schema.get_field_index("text"))):
                    for found in windows.find(block):
                        keep[doc[found[0]]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
