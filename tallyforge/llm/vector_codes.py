"""Vector code compression: each vector becomes one codebook entry a part, found by slicing and intersecting bitmasks.

Along each dimension of a part the codebook's coordinates are sorted, and every prefix of that order carries the mask of
its entries. A first guess gives a radius that holds the nearest entry for sure; two searches a dimension turn the range
around a coordinate into a mask, the uint64 words of all dimensions are ANDed, and only what is left is measured. All
numbers are integers, so ties are exact.
"""

from __future__ import annotations

import hashlib
import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import met_by_key, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096

#: Integers beyond this many bits count as the bound; below the second number of bits int64 arithmetic can't overflow.
MOST_BITS, FAST_BITS = 62, 26

_isqrt = np.frompyfunc(math.isqrt, 1, 1)


class Codebook:
    """Entries (k, d) of one part, with the sorted coordinates and the prefix masks of each dimension."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        k, d = entries.shape
        words = -(-k // 64)
        bits = np.zeros((k, words), np.uint64)
        bits[np.arange(k), np.arange(k) // 64] = np.left_shift(np.uint64(1), (np.arange(k) % 64).astype(np.uint64))
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, axis=0)
        self.order = order
        self.prefix = np.zeros((d, k + 1, words), np.uint64)
        for j in range(d):
            self.prefix[j, 1:] = np.bitwise_or.accumulate(bits[order[:, j]], axis=0)
        #: The guess goes along the dimension in which the entries lie farthest apart.
        self.widest = int(np.argmax(self.sorted[-1] - self.sorted[0])) if d else 0

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks (n, words) of the entries whose coordinates all differ from x by at most the radius."""
        out = np.full((len(x), self.prefix.shape[2]), ~np.uint64(0))
        for j in range(x.shape[1]):
            low = np.searchsorted(self.sorted[:, j], x[:, j] - radius, "left")
            high = np.searchsorted(self.sorted[:, j], x[:, j] + radius, "right")
            out &= self.prefix[j][high] ^ self.prefix[j][low]
        return out

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of and squared distance to the nearest entry of each row of x; ties go to the lower index."""
        if not x.shape[1] or not len(x):
            return np.zeros(len(x), np.int64), np.zeros(len(x), x.dtype)
        j = self.widest
        at = np.minimum(np.searchsorted(self.sorted[:, j], x[:, j]), len(self.entries) - 1)
        guess = self.order[at, j]
        far = ((x - self.entries[guess]) ** 2).sum(axis=1)
        radius = (_isqrt(far) if x.dtype == object else np.sqrt(far.astype(float)).astype(np.int64)) + 1
        mask = self.candidates(x, radius)
        best, index = far + 1, np.zeros(len(x), np.int64)
        for e in range(len(self.entries)):
            rows = np.nonzero(mask[:, e // 64] >> np.uint64(e % 64) & np.uint64(1))[0]
            d = ((x[rows] - self.entries[e]) ** 2).sum(axis=1)
            nearer = d < best[rows]
            best[rows[nearer]], index[rows[nearer]] = d[nearer], e
        return index, best


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): int64 where sums of squares fit, else Python's integers, bounded by MOST_BITS bits."""
    scaled = np.floor(values.astype(np.float64) * SCALE)
    if not scaled.size or np.abs(scaled).max() < 2.0**FAST_BITS:
        return scaled.astype(np.int64)
    most = 2.0**MOST_BITS
    return np.array([int(v) for v in np.clip(scaled, -most, most).ravel()], dtype=object).reshape(scaled.shape)


def _split(vectors: np.ndarray, parts: int) -> list[np.ndarray]:
    """Equal consecutive parts; where the length doesn't divide, zeros follow it."""
    width = -(-vectors.shape[1] // parts)
    padded = np.concatenate([vectors, np.zeros((len(vectors), width * parts - vectors.shape[1]), vectors.dtype)], axis=1)
    return [padded[:, width * p : width * (p + 1)] for p in range(parts)]


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows with a vector, all of whose components are finite numbers."""
    finite = lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False))
    return vectors.where(F.col(column).isNotNull() & F.forall(column, finite))


def _slices(batch: pa.RecordBatch, at: int, length: int, rows: int = 4096):
    """Row numbers and integers of the vectors of the given length, in slices."""
    for low in range(0, batch.num_rows, rows):
        col = batch.column(at).slice(low, rows)
        sizes = np.diff(np.asarray(col.offsets))
        flat, right = np.asarray(col.flatten()), np.nonzero(sizes == length)[0]
        if len(right) < len(sizes):
            flat = flat[np.repeat(sizes == length, sizes)]
        yield low, len(sizes), right, integers(flat.reshape(len(right), length))


def learn(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[list[np.ndarray], int]:
    """A codebook a part, and the length of the vectors: the smallest keys' vectors at first (of rows with one key the least vector), then `rounds` rounds
    of assigning all vectors and replacing each entry by the floored mean of what it got.

    vectors come from usable(). Each round is one pass over them; a task sends one row of sums for each entry, and only
    these sums, parts x entries rows, reach the driver. Vectors of another length than the smallest key's don't take
    part. Without a key the least vector starts alone; without a vector the codebooks have no entries.
    """
    keys = [r[0] for r in vectors.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).limit(entries).collect()]
    first = vectors.where(F.col(key).isin(keys)).groupBy(key).agg(F.min(column).alias(column)).orderBy(key).collect() if keys else vectors.orderBy(column).limit(1).select(column).collect()
    length = len(first[0][column]) if first else 0
    start = [r[column] for r in first if len(r[column]) == length]
    books = _split(integers(np.array(start, np.float64).reshape(len(start), length)), parts)
    width = books[0].shape[1]
    sums = ", ".join(f"s{i} decimal(38,0)" for i in range(width))
    for _ in range(rounds if start else 0):

        def assign(batches, books=books):
            indexes = [Codebook(b) for b in books]
            n = np.zeros((len(books), len(books[0])), np.int64)
            total = np.zeros((*n.shape, width), object)
            for batch in batches:
                for _, _, _, x in _slices(batch, 0, length):
                    for p, part in enumerate(_split(x, len(books))):
                        index, _ = indexes[p].nearest(part)
                        for e in np.unique(index):
                            own = part[index == e]
                            n[p, e] += len(own)
                            total[p, e] += own.sum(axis=0).astype(object)
            p, e = np.nonzero(n)
            columns = [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e])]
            columns += [pa.array([Decimal(int(v)) for v in total[p, e, i]], pa.decimal128(38, 0)) for i in range(width)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", *(f"s{i}" for i in range(width))])

        got = vectors.select(column).mapInArrow(assign, "part int, entry int, n long" + (", " + sums if sums else ""))
        books = [b.astype(object) for b in books]
        for r in got.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(width))).collect():
            books[r["part"]][r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
        if all(abs(v) < 1 << FAST_BITS for b in books for v in b.ravel()):
            books = [b.astype(np.int64) for b in books]
    return books, length


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all entries' integers by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for b in books for row in b.tolist() for v in row).encode()).hexdigest()


def encode(vectors: DataFrame, books: list[np.ndarray], length: int, *others: str, column: str = "embedding") -> DataFrame:
    """The other columns with the code of each vector (two hex digits a part) and its error, the squared distances summed
    over the parts; an error over 2**63 - 1 is that number. A vector of another length than `length` has null in both."""
    spark_types = {f.name: f.dataType for f in vectors.schema}
    schema = ", ".join(f"`{c}` {spark_types[c].simpleString()}" for c in others) + ", code string, error long"

    def apply(batches):
        indexes = [Codebook(b) for b in books]
        for batch in batches:
            codes, errors = np.full(batch.num_rows, None, object), np.full(batch.num_rows, None, object)
            for low, _, right, x in _slices(batch, len(others), length):
                digits, far = np.zeros((len(right), len(books)), np.uint8), np.zeros(len(right), object)
                for p, part in enumerate(_split(x, len(books))):
                    digits[:, p], d = indexes[p].nearest(part)
                    far += d.astype(object)
                codes[low + right] = [row.tobytes().hex() for row in digits]
                errors[low + right] = [min(int(v), (1 << 63) - 1) for v in far]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=[*others, "code", "error"])

    return vectors.select(*others, column).mapInArrow(apply, schema)


def compress(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """Code and error of every usable vector, the error summed over its label, and the digest of the codebooks.

    Rows without a usable vector go; a null key stays, and only doesn't start a codebook; repeated rows stay; rows with a
    null label count as one label; other columns are dropped; an empty table gives no rows.
    """
    rows = usable(vectors, column).select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(column).alias("vector"))
    books, length = learn(rows, "vector", "vec_id")
    coded = stored(encode(rows, books, length, "vec_id", "label", column="vector"), "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    return met_by_key(coded, stored(sums, "label-errors"), ["label"]).withColumn("codebooks_sha256", F.lit(digest(books))).drop("label")


def _oracle() -> str:
    """All rounds one after the other, over one row a component."""
    out = [
        f"""kept AS MATERIALIZED (SELECT * FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, (pos - 1) * {PARTS} // len AS part, pos, CAST(floor(CAST(v AS DOUBLE) * {SCALE}) AS BIGINT) AS v
  FROM (SELECT vec_id, len(embedding) AS len, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM kept)),
b0 AS MATERIALIZED (SELECT x.part, x.pos, x.v, f.entry FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {ENTRIES}) f USING (vec_id))"""
    ]
    for k in range(ROUNDS + 1):
        out.append(f"""d{k} AS MATERIALIZED (SELECT vec_id, part, min(struct_pack(d := d, entry := entry)) AS m FROM (
  SELECT x.vec_id, x.part, b.entry, CAST(sum((x.v - b.v) * (x.v - b.v)) AS BIGINT) AS d FROM x JOIN b{k} b ON x.part = b.part AND x.pos = b.pos GROUP BY ALL) GROUP BY ALL)""")
        if k < ROUNDS:
            out.append(f"""n{k} AS (SELECT x.part, x.pos, m.entry AS entry, sum(x.v) AS s, count(*) AS n FROM x JOIN d{k} d ON x.vec_id = d.vec_id AND x.part = d.part GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.pos, b.entry, CAST(coalesce((n.s - ((n.s % n.n) + n.n) % n.n) // n.n, b.v) AS BIGINT) AS v FROM b{k} b LEFT JOIN n{k} n ON b.part = n.part AND b.pos = n.pos AND b.entry = n.entry)""")
    joined = ",\n".join(out)
    return f"""WITH {joined},
coded AS (SELECT vec_id, string_agg(printf('%02x', m.entry), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM d{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""


ORACLE = _oracle()
