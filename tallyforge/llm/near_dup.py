"""MinHash near-dedup with SetSketch registers.

A set's registers are the truncated minima of exponential variables on an exponential scale: the register is
floor(1 - log_B(minimum)), so the registers of a union are the maxima of registers, and those of similar sets are
mostly equal. Bands of registers give candidates, a joint likelihood of two register vectors and the known set sizes
drops those that are far from similar, and the full sets of the rest are compared.

No pair of one set's copies is ever made: equal sets become one class first. Small buckets give all their pairs, large
ones pairs with two centres, their members with the smallest doc_id and with the smallest hash of it, so that similar
buckets have the same centres. In a large bucket that still spans several components, those outside its commonest one
meet all other members, block by block: no link between different sets is lost to a bucket's size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored
from .components import components

REGISTERS, ROWS = 200, 5
BANDS = REGISTERS // ROWS
SCALE, BASE, TOP = 20.0, 1.001, 65535
#: Pairs below this estimate, over six deviations under the threshold, are not compared in full.
LEAST_ESTIMATE = 0.6
#: A bucket of up to so many members gives all its pairs; larger ones go through centres and blocks, to the same links.
SMALL_BUCKET = 16
BLOCK, WIDE = 128, 8
#: A block holds about so many shingles at most, as long as one text has fewer.
BLOCK_SHINGLES = 1_000_000

_RNG = np.random.default_rng(92)
_XOR = _RNG.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)[:, None]
_MUL = (_RNG.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) | np.uint64(1))[:, None]
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
MAX_WORDS = 200_000
_WORDS: dict[bytes, int] = {}


def _word_hashes(words: list[bytes]) -> np.ndarray:
    get = _WORDS.get
    got = list(map(get, words))
    if None in got:
        if len(_WORDS) > MAX_WORDS:
            _WORDS.clear()
        for i, h in enumerate(got):
            if h is None:
                got[i] = _WORDS[words[i]] = xxhash.xxh3_64_intdigest(words[i])
    return np.array(got, np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; fewer words than width are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = _word_hashes(words)
    width_here = min(width, len(h))
    n = len(h) - width_here + 1
    out = np.full(n, width_here, np.uint64)
    for k in range(width_here):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers as uint16. A uniform hash and its exponential variable have their minimum at one element,
    so only the minima are put on the exponential scale."""
    low = np.full(REGISTERS, np.uint64(2**64 - 1))
    for at in range(0, len(hashes), 2048):
        low = np.minimum(low, ((hashes[at : at + 2048] ^ _XOR) * _MUL).min(1))
    least = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64 * (1 - 2.0**-53)) / SCALE
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)) + 20000, 0, TOP).astype(np.uint16)


def band_keys(sketch: np.ndarray) -> list[int]:
    """A 64-bit key of each band and its registers."""
    return [xxhash.xxh3_64_intdigest(sketch[b * ROWS : b * ROWS + ROWS].tobytes(), b) - (1 << 63) for b in range(BANDS)]


def _log_likelihood(u: np.ndarray, v: np.ndarray, nu: np.ndarray, nv: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of each pair of register vectors (rows) at each similarity j (columns), given both set sizes."""
    above, below = (u > v).sum(1), (u < v).sum(1)
    same = u.shape[1] - above - below
    a = nu / (nu + nv)
    b = 1 - a
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(a[:, None] - b[:, None] * j), p(b[:, None] - a[:, None] * j)
    return above[:, None] * np.log(up) + below[:, None] * np.log(down) + same[:, None] * np.log(np.clip(1 - up - down, 1e-12, None))


def joint_estimate(u: np.ndarray, v: np.ndarray, nu: np.ndarray, nv: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of each pair of register vectors, given both set sizes, on a grid of 0.01."""
    j = np.arange(0, 1.0001, 0.01)[None, :]
    feasible = j <= np.minimum(nu / nv, nv / nu)[:, None] + 1e-9
    return j[0][np.where(feasible, _log_likelihood(u, v, nu, nv, j), -np.inf).argmax(1)]


def likely_similar(u: np.ndarray, v: np.ndarray, nu: np.ndarray, nv: np.ndarray, least: float = LEAST_ESTIMATE) -> np.ndarray:
    """Whether the joint estimate reaches `least`. The likelihood has one maximum, so two neighbouring points of the
    grid tell on which side it lies; the sizes must allow `least`."""
    at = _log_likelihood(u, v, nu, nv, np.array([[least - 0.01, least]]))
    return at[:, 1] > at[:, 0]


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, fp (128-bit fingerprint of the set), sketch, bands; nulls where there is no word."""

    def sketch(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                n, fp, sk, bands = [], [], [], []
                for t in part.column(1).to_pylist():
                    s = shingle_set(t, width)
                    n.append(len(s))
                    if len(s):
                        regs = registers(s)
                        fp.append(xxhash.xxh3_128_digest(s.tobytes()))
                        sk.append(regs.tobytes())
                        bands.append(band_keys(regs))
                    else:
                        fp.append(None), sk.append(None), bands.append(None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sk, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "fp", "sketch", "bands"])
        _WORDS.clear()  # the worker lives on

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sketch, "doc_id long, n_shingles long, fp binary, sketch binary, bands array<long>")


def _likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) of representatives that the joint estimate cannot rule out."""
    side = lambda x: reps.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").where("100 * least(na, nb) >= 80 * greatest(na, nb)")

    def estimate(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                u, v = (np.frombuffer(b"".join(part.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (2, 4))
                nu, nv = (part.column(k).to_numpy().astype(float) for k in (3, 5))
                keep = likely_similar(u, v, nu, nv)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(keep)), part.column(1).filter(pa.array(keep))], names=["a", "b"])

    return both.select("a", "b", "sa", "na", "sb", "nb").mapInArrow(estimate, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    at_a = pairs.join(texts.withColumnsRenamed({"id": "a", "text": "ta"}).hint("merge"), "a")
    both = at_a.join(texts.withColumnsRenamed({"id": "b", "text": "tb"}).hint("merge"), "b").select("a", "b", "ta", "tb")

    def compare(batches):
        for batch in batches:
            known: dict[int, np.ndarray] = {}
            a, b, keep = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for k in range(batch.num_rows):
                sets = []
                for doc, col in ((a[k], 2), (b[k], 3)):
                    if doc not in known:
                        if len(known) > 256:
                            known.clear()
                        known[doc] = shingle_set(batch.column(col)[k].as_py(), width)
                    sets.append(known[doc])
                common = len(np.intersect1d(*sets, assume_unique=True))
                keep.append(100 * common >= percent * (len(sets[0]) + len(sets[1]) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    return both.mapInArrow(compare, "a long, b long")


def _meetings(keys: DataFrame, comp: DataFrame, used: list[DataFrame]) -> DataFrame:
    """merged, meet, doc_id, comp, main: who has to meet in large buckets that span components, each once a meeting.

    main is a bucket's commonest component. Buckets with one main that each hold a part of 1 / WIDE or more of all
    documents in such buckets are merged into one meeting, named by main: at most WIDE times the comparisons of the
    single buckets, and a document travels once instead of once a bucket. Other buckets meet by themselves.
    """
    placed = keys.join(comp.hint("merge"), keys["doc_id"] == comp["node"], "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("comp"))
    per = placed.groupBy("key", "comp").agg(F.count("*").alias("c"))
    main = per.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.sum("c").alias("m"), F.count("*").alias("comps")).where("comps > 1").drop("comps")
    opened = stored(placed.join(main.hint("merge"), "key"), "open", used)
    held = opened.select("main", "doc_id").distinct().groupBy("main").agg(F.count("*").alias("all"))
    kinds = opened.groupBy("key").agg(F.first("main").alias("main"), F.first("m").alias("m")).join(held.hint("merge"), "main").select("key", (F.col("m") * WIDE >= F.col("all")).alias("merged"))
    return opened.join(kinds.hint("merge"), "key").select("merged", F.when(F.col("merged"), F.col("main")).otherwise(F.col("key")).alias("meet"), "doc_id", "comp", "main").distinct()


def _candidates(merged: bool, meet: int, pdf: pd.DataFrame):
    """Of one meeting of blocks: each probe's row with the rows that the estimate cannot rule out. Only documents that
    share a band are compared. In a bucket that meets by itself, that is the first band that they share: an earlier
    bucket with both was either small, with all its pairs compared, or is open too."""
    regs = np.frombuffer(b"".join(pdf["sketch"]), np.uint16).reshape(-1, BANDS, ROWS)
    band = None if merged else band_keys(regs[0].reshape(-1)).index(meet)
    comps, n, is_probe = pdf["comp"].to_numpy(), pdf["n_shingles"].to_numpy(float), pdf["probe"].to_numpy()
    bases = np.flatnonzero(~is_probe)
    for i in np.flatnonzero(is_probe):
        j = bases[(comps[bases] != comps[i]) & (100 * np.minimum(n[bases], n[i]) >= 80 * np.maximum(n[bases], n[i]))]
        shared = (regs[j, :band] == regs[i, :band]).all(2).any(1)
        j = j[shared if merged else ~shared]
        if len(j):
            j = j[likely_similar(regs[i].reshape(1, -1), regs[j].reshape(-1, REGISTERS), np.full(len(j), n[i]), n[j])]
        if len(j):
            yield i, j


def _rest(keys: DataFrame, comp: DataFrame, reps: DataFrame, docs: DataFrame, width: int, percent: int, used: list[DataFrame]) -> DataFrame:
    """Links in large buckets that span components: each member outside the commonest component against every member
    of the other components. Blocks of the ones meet blocks of the others, never a bucket in one task. Sketches
    tell which members a meeting needs; their texts travel there once, and only links come out."""
    sized = reps.select("doc_id", "sketch", "n_shingles")
    meetings = stored(_meetings(keys, comp, used), "meetings", used)
    members = meetings.join(sized.hint("merge"), "doc_id")
    blocks = lambda few: F.greatest(F.ceil(F.count(F.when(few, 1)) / BLOCK), F.ceil(F.sum(F.when(few, F.col("n_shingles"))) / BLOCK_SHINGLES)).cast("int")
    shape = members.groupBy("merged", "meet").agg(blocks(F.col("comp") != F.col("main")).alias("xs"), blocks(F.lit(True)).alias("ys"))
    dealt = members.join(shape.hint("merge"), ["merged", "meet"]).withColumn("h", F.xxhash64("doc_id"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at, cols = ["merged", "meet", "x", "y"], ["doc_id", "comp", "sketch", "n_shingles"]
    base = dealt.select("merged", "meet", spread("xs").alias("x"), F.pmod("h", "ys").cast("int").alias("y"), F.lit(False).alias("probe"), *cols)
    probe = dealt.where("comp <> main").select("merged", "meet", F.pmod("h", "xs").cast("int").alias("x"), spread("ys").alias("y"), F.lit(True).alias("probe"), *cols)

    def needed(key, pdf):
        rows = set()
        for i, j in _candidates(key[0], key[1], pdf):
            rows.add(i)
            rows.update(j)
        return pdf.iloc[sorted(rows)][[*at, "probe", "doc_id", "comp"]]

    def linked(key, pdf):
        ids, texts, sets, out = pdf["doc_id"].tolist(), pdf["text"].tolist(), {}, []
        for i, js in _candidates(key[0], key[1], pdf):
            for j in js:
                for k in (i, j):
                    if ids[k] not in sets:
                        sets[ids[k]] = shingle_set(texts[k], width)
                one, two = sets[ids[i]], sets[ids[j]]
                common = len(np.intersect1d(one, two, assume_unique=True))
                if 100 * common >= percent * (len(one) + len(two) - common):
                    out.append((ids[i], ids[j]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    wanted = stored(base.unionByName(probe).groupBy(*at).applyInPandas(needed, "merged boolean, meet long, x int, y int, probe boolean, doc_id long, comp long"), "wanted", used)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    full = wanted.join(sized.hint("merge"), "doc_id").join(texts.hint("merge"), "doc_id")
    return full.groupBy(*at).applyInPandas(linked, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    Documents link if 100 * |A and B| >= percent * |A or B| for their sets of width-word shingles (a text of fewer
    words is one shingle; A-Z in lower case). component_id is the smallest doc_id reachable, kept marks it. Texts
    that are null or have no word have the empty set and link with nothing, as does a null doc_id, whose component
    is null and which is not kept. doc_ids are taken to be distinct; repeated rows come back each, in one component.
    An empty table gives no rows; other columns are not read. The result is a written table, all others are dropped.
    """
    used: list[DataFrame] = []
    met = stored(sketches(docs, width), "sketches", used)
    sets = met.where("fp is not null and doc_id is not null")
    reps = stored(sets.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")), "classes", used)
    keys = reps.select("doc_id", F.explode("bands").alias("key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.min(F.struct(F.xxhash64("doc_id").alias("h"), "doc_id"))["doc_id"].alias("pivot")).where("n > 1")
    inside = stored(keys.join(sizes.hint("merge"), "key"), "buckets", used)
    centres = inside.where(F.col("n") > SMALL_BUCKET).select("doc_id", F.explode(F.array("least", "pivot")).alias("c")).where("doc_id <> c")
    stars = centres.select(F.least("doc_id", "c").alias("a"), F.greatest("doc_id", "c").alias("b"))
    few = inside.where(F.col("n") <= SMALL_BUCKET).groupBy("key").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    one = few.select("ids", F.explode("ids").alias("a")).select("a", F.explode(F.filter("ids", lambda x: x > F.col("a"))).alias("b"))
    likely = stored(_likely(stars.union(one).distinct(), reps), "likely", used)
    links = stored(_verified(likely, docs, width, percent), "verified", used)
    comp = stored(components(links, used), "components", used)
    large = inside.where(F.col("n") > SMALL_BUCKET).select("key", "doc_id")
    more = stored(_rest(large, comp, reps, docs, width, percent, used), "rest", used)
    if not more.isEmpty():
        comp = stored(components(links.union(more), used), "components", used)
    named = reps.join(comp.hint("merge"), reps["doc_id"] == comp["node"], "left").select("fp", F.coalesce("component", "doc_id").alias("component_id"))
    out = met.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("fp")).alias("fp")).join(named.hint("merge"), "fp", "left")
    found = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    whole = stored(found, "near-duplicates")
    for df in used:
        dropped(df)
    return whole
