"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

A line's features are its own statistics and those of its neighbours; forward-backward gives each line's probability
of being good, and a document's score is their mean weighted by line length.

Only documents are labelled. The field is fitted twice: first with each line labelled as its document, then with the
lines that this field holds to be of the other kind relabelled, as long as lines of at least OWN_SHARE of a document's
length keep its label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chains import Adam, forward_backward, layout
from .common import bounded_sample, crc32_text

#: At most so many labelled documents fit the field, and about so many lines of each, in windows of WINDOW lines spread
#: from its beginning to its end, whatever the size of the input.
TRAIN_DOCS, TRAIN_LINES, WINDOW = 3000, 400, 40
#: Part of a document's length that keeps the document's label when lines are relabelled, and how sure that must be.
OWN_SHARE, SURE = 0.75, 0.9
ROUNDS, RATE, RIDGE = 80, 0.08, 1e-4
THRESHOLD = 0.3

_SYMBOLS = b"#*$%&|<>"
_PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
OWN = 20


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x features, line lengths) of the lines with a word; a text without words is one line of no length."""
    rows, sizes, seen = [], [], set()
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        words = line.split()
        if not words:
            continue
        n, size = len(words), len(line)
        cut = lambda chars: size - len(line.translate(None, chars))
        symbols, upper, digits, punct = cut(_SYMBOLS) / n, cut(_UPPER) / size, cut(_DIGIT) / size, cut(_PUNCT) / n
        shouts, bars, known = line.count(b"!!") / n, line.count(b"|") / n, line in seen
        seen.add(line)
        distinct = len(set(words)) / n
        rows.append((1, np.log1p(n) / 4, size / n / 10, min(symbols, 5), symbols > 0.05, symbols > 0.5, upper, upper > 0.3, digits, digits > 0.2, min(punct, 5), punct > 0.8, shouts, shouts > 0.1, bars, bars > 0.1, known, distinct, distinct < 0.6, line[-1:] in b".!?"))
        sizes.append(size)
    if not rows:
        return np.eye(1, OWN, dtype=np.float32), np.ones(1, np.int64)
    return np.array(rows, np.float32), np.array(sizes, np.int64)


def with_neighbours(own: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Own, previous and next line's features; zeros where a document begins or ends."""
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    ends = np.cumsum(lengths)
    before[np.concatenate([[0], ends[:-1]])] = 0
    after[ends - 1] = 0
    return np.concatenate([own, before, after], 1)


def relabelled(own: np.ndarray, good: np.ndarray, weight: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Labels of lines: the document's (own), but the other one where the probability of being good says so for sure,
    the surest lines first, while lines of OWN_SHARE of the document's length keep the document's label."""
    against = np.where(own == 1, 1 - good, good)
    order = np.lexsort((-against, doc))
    w, d = weight[order].astype(float), doc[order]
    first = np.searchsorted(d, d)
    before = np.concatenate([[0.0], np.cumsum(w)])
    total = np.bincount(doc, weight)[d]
    moved = (against[order] >= SURE) & (before[1:] - before[first] <= (1 - OWN_SHARE) * total)
    out = own.copy()
    out[order[moved]] = 1 - out[order[moved]]
    return out


class LineField:
    def __init__(self, weights, move, first, prior):
        self.weights, self.move, self.first, self.prior = weights, move, first, prior

    @classmethod
    def fit(cls, features: list[np.ndarray], labels: np.ndarray, sizes: list[np.ndarray] | None = None) -> LineField:
        """A field from chains of lines of labelled documents; sizes are the lengths of the lines (1 if not given)."""
        width = 3 * OWN
        if len(features) == 0 or labels.min() == labels.max():
            only = 0.5 if len(features) == 0 else float(labels[0])
            return cls(np.zeros((width, 2)), np.zeros((2, 2)), np.zeros(2), only)
        lengths = np.array([len(f) for f in features])
        weight = np.concatenate(sizes) if sizes is not None else np.ones(lengths.sum())
        x = with_neighbours(np.concatenate(features), lengths).astype(np.float64)
        _, active, places = layout(lengths)
        own = np.repeat(labels, lengths).astype(int)
        field = cls._climb(x[places], own[places], own, lengths, active)
        good = np.empty(len(x))
        good[places] = forward_backward(x[places] @ field.weights, field.move, field.first, active)[:, 1]
        other = relabelled(own, good, weight, np.repeat(np.arange(len(lengths)), lengths))
        return cls._climb(x[places], other[places], other, lengths, active)

    @classmethod
    def _climb(cls, x: np.ndarray, y: np.ndarray, by_line: np.ndarray, lengths: np.ndarray, active: np.ndarray) -> LineField:
        """The gradient is observed minus expected counts over all lines. x and y lie as active says, by_line has the
        labels in order of the chains."""
        observed, starts, n = np.eye(2)[y], active[0], len(y)
        inside = np.ones(n, bool)
        inside[np.cumsum(lengths) - 1] = False
        at = np.flatnonzero(inside)
        moves = np.bincount(by_line[at] * 2 + by_line[np.minimum(at + 1, n - 1)], minlength=4).reshape(2, 2)
        w, move, first, opt = np.zeros((x.shape[1], 2)), np.zeros((2, 2)), np.zeros(2), Adam(RATE)
        for _ in range(ROUNDS):
            marginal, pairs, _ = forward_backward(x @ w, move, first, active, True)
            opt.step("w", w, x.T @ (observed - marginal) / n - RIDGE * w)
            opt.step("move", move, (moves - pairs) / n - 1e-2 * move)
            opt.step("first", first, (observed[:starts] - marginal[:starts]).sum(0) / n - RIDGE * first)
            opt.t += 1
        return cls(w, move, first, None)

    def score(self, features: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(features), self.prior)
        lengths = np.array([len(f) for f in features])
        _, active, places = layout(lengths)
        x = with_neighbours(np.concatenate(features), lengths)
        good = np.empty(len(x))
        good[places] = forward_backward(x[places] @ self.weights, self.move, self.first, active)[:, 1]
        weight = np.concatenate(sizes).astype(float)
        at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        return np.clip(np.add.reduceat(good * weight, at) / np.add.reduceat(weight, at), 0, 1)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_DOCS, lines_each: int = TRAIN_LINES) -> LineField:
    """Fit on at most `rows` labelled documents whose crc32(doc_id) mod 5 is not 0, and about `lines_each` lines of
    each: longer ones give windows from their beginning to their end."""
    known = labels.where("quality in (0, 1) and doc_id is not null").where(crc32_text("doc_id") % 5 != 0)
    sample = bounded_sample(known.select("doc_id", F.col("quality").cast("long")), "doc_id", rows)

    def lines(batches):
        for batch in batches:
            out = [[], [], [], []]
            for doc_id, text, y in zip(*(batch.column(c).to_pylist() for c in range(3))):
                x, n = line_features(text)
                starts = [0] if len(n) <= lines_each else np.linspace(0, len(n) - WINDOW, max(1, lines_each // WINDOW)).astype(int)
                for s in starts:
                    to = len(n) if len(n) <= lines_each else s + WINDOW
                    for col, v in zip(out, (doc_id, y, x[s:to].tobytes(), n[s:to].astype(np.int64).tobytes())):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["doc_id", "y", "x", "n"])

    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "quality")
    got = joined.mapInArrow(lines, "doc_id long, y long, x binary, n binary").toPandas().sort_values(["doc_id", "x"], kind="stable")
    return LineField.fit([np.frombuffer(b, np.float32).reshape(-1, OWN) for b in got["x"]], got["y"].to_numpy(), [np.frombuffer(b, np.int64) for b in got["n"]])


def score(docs: DataFrame, field: LineField, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Null and empty texts score as one line without words; a text of any length is one chain; repeated rows score alike;
    a null doc_id is not held out; an empty table gives no rows; other columns are ignored. Scores are rounded to 9
    places, and a score equal to the threshold is predicted 1.
    """

    def scored(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                got = [line_features(t) for t in part.column(1).to_pylist()]
                s = np.round(field.score([f for f, _ in got], [n for _, n in got]), 9)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scored, "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(crc32_text("doc_id") % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted")
