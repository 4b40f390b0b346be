"""Quality rules: gradient-boosted trees over document statistics, scored from flat numpy node arrays.

The trees are monotone in chosen statistics: more symbols, repeated words or repeated lines never raise a score.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample

#: At most so many labelled rows fit the trees, whatever the size of the input.
TRAIN_ROWS = 6000
TREES, DEPTH, BINS, RATE, RIDGE = 60, 3, 32, 0.2, 2.0
KEEP = 0.5
MIN_WORDS = 50

_SYMBOL = re.compile(r"[#*$%&|<>]")
_SYMBOLS = b"#*$%&|<>"
_PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))

FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "punctuation", "shouts", "bars", "distinct", "line_words", "top_word", "long_words")
#: Sign of the only direction in which a statistic may move the score; 0: free.
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeats": -1, "shouts": -1, "bars": -1}

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(text: str | None) -> tuple[tuple, list[float]]:
    """The base counts of a whole text (null: no words) and the statistics that the trees read."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at ASCII white space alone
    n = len(words)
    if not n:
        return (0, 0, len(_SYMBOL.findall(text)), 0, 0), [0.0] * len(FEATURES)
    size = len(raw)
    spaces = size - len(raw.translate(None, b" \t\n\r\x0b\x0c"))
    word_chars = len(text) - spaces
    n_symbols = size - len(raw.translate(None, _SYMBOLS))
    seen: set[bytes] = set()
    dup = lines = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    repeats = 0
    if n >= 4:
        k = len(number)
        pair = np.unique(codes[:-1] * k + codes[1:], return_inverse=True)[1]
        _, back, times = np.unique(pair[:-1] * k + codes[2:], return_inverse=True, return_counts=True)
        hit = times[back] > 1
        covered = np.zeros(n, bool)
        covered[:-2] |= hit
        covered[1:-1] |= hit
        covered[2:] |= hit
        repeats = int(covered.sum())
    letters = max(1, word_chars)
    less = lambda chars: size - len(raw.translate(None, chars))
    stats = [np.log1p(n), word_chars / n, n_symbols / n, dup / lines, repeats / n, less(_UPPER) / letters, less(_DIGIT) / letters, less(_PUNCT) / letters, raw.count(b"!!") / n, raw.count(b"|") / n, len(number) / n, min(n / lines, 500.0), Counter(codes.tolist()).most_common(1)[0][1] / n, sum(len(w) > 14 for w in words) / n]
    return (n, word_chars, n_symbols, dup, repeats), stats


def base_failed(n_words, n_repeat_words):
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > 50 * n_words)


class Trees:
    """Boosted trees as arrays of nodes: feature (-1 at a leaf), threshold, left child (right is the next), value."""

    def __init__(self, feature, threshold, left, value, roots, start):
        self.feature, self.threshold, self.left, self.value, self.roots, self.start = feature, threshold, left, value, roots, start

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1, all rows and one tree at a time."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(DEPTH):
                f = self.feature[at]
                inner = f >= 0
                at = np.where(inner, self.left[at] + (x[rows, np.maximum(f, 0)] > self.threshold[at]), at)
            total += self.value[at]
        return 1 / (1 + np.exp(-total))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Trees:
        """Newton boosting of the log loss over quantile bins. A split on a monotone statistic must order its two
        leaf values, and bounds at the midpoint keep all that is below in that order."""
        n, d = x.shape if len(x) else (0, len(FEATURES))
        feature, threshold, left, value, roots = [], [], [], [], []
        rate = (y.sum() + 1) / (n + 2)
        start = float(np.log(rate / (1 - rate)))
        if n and 0 < y.sum() < n:
            cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(d)]
            binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
            signs = [MONOTONE.get(name, 0) for name in FEATURES]
            total = np.full(n, start)
            for _ in range(TREES):
                p = 1 / (1 + np.exp(-total))
                g, h = y - p, p * (1 - p)
                roots.append(len(feature))
                feature.append(-1), threshold.append(0.0), left.append(0), value.append(0.0)
                todo = [(roots[-1], np.arange(n), 0, -np.inf, np.inf)]
                while todo:
                    node, rows, depth, low, high = todo.pop()
                    gs, hs = g[rows].sum(), h[rows].sum()
                    value[node] = RATE * float(np.clip(gs / (hs + RIDGE), low, high))
                    best = (1e-6, None)
                    if depth < DEPTH and len(rows) >= 20:
                        for f in range(d):
                            bins = len(cuts[f]) + 1
                            gl = np.cumsum(np.bincount(binned[rows, f], g[rows], bins))[:-1]
                            hl = np.cumsum(np.bincount(binned[rows, f], h[rows], bins))[:-1]
                            vl, vr = np.clip(gl / (hl + RIDGE), low, high), np.clip((gs - gl) / (hs - hl + RIDGE), low, high)
                            gain = gl**2 / (hl + RIDGE) + (gs - gl) ** 2 / (hs - hl + RIDGE) - gs**2 / (hs + RIDGE)
                            gain[(signs[f] * (vr - vl) < 0) | (hl < 0.5) | (hs - hl < 0.5)] = -np.inf
                            if len(gain) and gain.max() > best[0]:
                                k = int(gain.argmax())
                                best = (gain[k], (f, k, vl[k], vr[k]))
                    if best[1]:
                        f, k, vl, vr = best[1]
                        feature[node], threshold[node], left[node] = f, float(cuts[f][k]), len(feature)
                        goes = binned[rows, f] > k
                        mid = (vl + vr) / 2
                        for side, part in ((0, rows[~goes]), (1, rows[goes])):
                            feature.append(-1), threshold.append(0.0), left.append(0), value.append(0.0)
                            lo, hi = (low, high) if not signs[f] else ((mid, high) if (side == 1) == (signs[f] > 0) else (low, mid))
                            todo.append((left[node] + side, part, depth + 1, lo, hi))
                total = np.log((q := cls(*map(np.array, (feature, threshold, left, value)), roots[-1:], 0.0).score(x)) / (1 - q)) + total
        return cls(np.array(feature, int), np.array(threshold), np.array(left, int), np.array(value), roots, start)


def _stats_batches(batches, score):
    names = ["doc_id", *BASE]
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            got = [statistics(t) for t in part.column(1).to_pylist()]
            cols = [part.column(0), *(pa.array(c, pa.int64()) for c in zip(*(b for b, _ in got)))]
            yield score(part, cols, names, got)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Fit on at most `rows` rows of labels with a quality of 0 or 1. Without labels, the trees keep everything."""
    known = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("double"))
    sample = bounded_sample(known, "doc_id", rows)

    def stats(part, cols, names, got):
        return pa.RecordBatch.from_arrays([part.column(2), pa.array([x for _, x in got], pa.list_(pa.float64()))], names=["y", "x"])

    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "quality")
    got = joined.mapInArrow(lambda batches: _stats_batches(batches, stats), "y double, x array<double>").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort(x.T) if len(x) else slice(0)  # the same trees for any order of the rows
    y = got["y"].to_numpy(float)
    order = np.lexsort([*x.T, y]) if len(x) else order
    return Trees.fit(x[order], y[order])


def judge(docs: DataFrame, trees: Trees, keep: float = KEEP) -> DataFrame:
    """One row for each row of docs: base counts, base_failed, score and kept.

    Null and empty texts have no words, fail and are not kept; repeated rows are judged one by one; an empty table
    gives no rows; columns other than doc_id and text are ignored.
    """

    def scored(part, cols, names, got):
        n, repeats = np.array([b[0] for b, _ in got]), np.array([b[4] for b, _ in got])
        failed = base_failed(n, repeats)
        score = trees.score(np.array([x for _, x in got], float))
        return pa.RecordBatch.from_arrays([*cols, pa.array(failed), pa.array(~failed & (score >= keep)), pa.array(score)], names=[*names, "base_failed", "kept", "score"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, score double"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda batches: _stats_batches(batches, scored), schema)


def keep_good(docs: DataFrame, trees: Trees, keep: float = KEEP) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns; judged where they lie, without a join."""

    def filtered(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            got = [statistics(t) for t in batch.column(at).to_pylist()]
            if not got:
                continue
            n, repeats = np.array([b[0] for b, _ in got]), np.array([b[4] for b, _ in got])
            yield batch.filter(pa.array(~base_failed(n, repeats) & (trees.score(np.array([x for _, x in got], float)) >= keep)))

    return docs.mapInArrow(filtered, docs.schema)
