"""Suffix-array dedup across documents: strings of N bytes that also start in a document with a smaller id.

Every string of N bytes belongs to its least K-gram hash, so equal strings of two documents have equal keys. A run is
a stretch of neighbouring strings with one key. Runs travel as two hashes of different make, 96 bits in all: a polynomial
of their bytes and one of the mixed hashes of their K-grams. Runs that an earlier document has whole are settled by
them. The edges of repeats are fetched as bytes and suffix-sorted: prefix polynomial hashes and binary search find the
common extension of two suffixes, mergesort orders them by it, and bytes confirm each equality. An edge is a run whose
key other texts share next to the bytes on one of its sides: a string holds HALF bytes on the left of its key's K-gram or
on the right of it, so runs that share a string agree in one of the two tags that they carry for these bytes. The key
alone isn't enough: K bytes are shared by chance, by the more texts the more there are.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored

N, K = 50, 16
HALF = (N - K) // 2
#: Text bytes for each bucket of run hashes, and for one block of documents within a task.
BUCKET_BYTES, BLOCK_BYTES = 8_000_000, 2_000_000
#: A key with more different edges than this is a hot one: its runs are cut up by their least LONG_K-grams and dealt to
#: places by these instead of by the key, and string by string from HOT_RUNS on, so that no place holds them all. Each way
#: gives the same result, but a string alone takes 50 bytes where the next one in a run takes one.
MANY_RUNS, HOT_RUNS = 256, 65_536
LONG_K = 42
SORT_STRINGS = 200_000
KINDS = WHOLE, EDGE, MANY, SINGLE = 1, 2, 3, 4

_RNG = np.random.default_rng(50)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_B = 0x9E3779B97F4A7C15
_B_INV = pow(_B, -1, 1 << 64)
#: key: 32 bits of the key, enough within a bucket (keys that agree in them only cost sorting).
#: left, right: tags of the K-gram with HALF bytes on that side; NO_TAG if no string of the run holds them, ANY_TAG on both
#: sides if the K-gram is met more than once. doc: on its way, the step from the record before.
RUN = np.dtype([("key", "<u4"), ("check", "<u4"), ("hash", "<u8"), ("doc", "<u4"), ("run", "<u4"), ("left", "<u2"), ("right", "<u2")])
NO_TAG, ANY_TAG = 0, 0xFFFF
MARKS = "doc_id long, version long, mark long"
SPANS = "doc_id long, version long, start long, end long"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def prefix_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """H with H[j] - H[i] = sum of byte values times powers, and the inverse powers that move it to zero."""
    n = len(buf)
    powers = np.full(n + 1, np.uint64(_B))
    powers[0] = 1
    inverse = np.full(n + 1, np.uint64(_B_INV))
    inverse[0] = 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[buf] * np.cumprod(powers)[:n], out=total[1:])
    return total, np.cumprod(inverse)


def _tags(grams: np.ndarray, total: np.ndarray, inverse: np.ndarray, start: np.ndarray, count: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The left and right tags of runs, whose K-gram is sought in their first and last string."""
    low, least, last = grams.astype(np.uint32), key.astype(np.uint32)[:, None], start + count - 1
    windows = np.lib.stride_tricks.sliding_window_view(low, N - K + 1)
    head, tail = windows[start] == least, windows[last] == least
    at = start + head.argmax(1)
    once = (np.count_nonzero(head, 1) == 1) & (np.count_nonzero(tail, 1) == 1) & (last + tail.argmax(1) == at)

    def tag(a, b, inside):
        a, b = np.where(inside, a, 0), np.where(inside, b, 0)
        tags = (_mix((total[b] - total[a]) * inverse[a]) >> np.uint64(32)) % np.uint64(ANY_TAG - 1) + np.uint64(1)
        return np.where(once, np.where(inside, tags, NO_TAG), ANY_TAG)

    return tag(at - HALF, at + K, at - HALF >= start), tag(at, at + K + HALF, at + K + HALF <= last + N)


def runs(docs: list[bytes], hashed: bool = True, k: int = K) -> tuple[np.ndarray, ...]:
    """(document, first string, number of strings, key, hash, check, left, right) of all runs of a block of documents;
    positions are bytes from the document's start. A document's runs don't depend on its neighbours. hashed=False leaves
    the two hashes and the tags out, and may go by K-grams of another length k."""
    sizes = np.array([len(d) for d in docs], np.int64)
    ends = np.cumsum(sizes)
    buf = np.frombuffer(b"".join(docs), np.uint8)
    none, no_hash = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(buf) < N:
        return none, none, none, *[no_hash] * 5
    total, inverse = prefix_hashes(buf)
    grams = _mix((total[k:] - total[:-k]) * inverse[: len(buf) - k + 1])
    low, width = grams, 1
    span = N - k + 1
    if not hashed:
        del total, inverse
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    counts = np.maximum(sizes - N + 1, 0)  # strings of each document; the others cross its end
    head = np.zeros(len(low) + 1, bool)
    head[1:-1] = low[1:] != low[:-1]
    begins = ends - sizes
    head[begins[counts > 0]] = True
    head[(begins + counts)[counts > 0]] = True
    bounds = np.flatnonzero(head)
    if not len(bounds):
        return none, none, none, *[no_hash] * 5
    bounds = bounds if bounds[-1] == len(low) else np.append(bounds, len(low))
    start, count = bounds[:-1], np.diff(bounds)
    doc = np.searchsorted(ends, start, side="right")
    good = start + N <= ends[doc]
    start, count, doc = start[good], count[good], doc[good]
    key = low[start]
    if not len(start):
        return none, none, none, *[no_hash] * 5
    local = start - (ends - sizes)[doc]
    if not hashed:
        return doc, local, count, key, *[no_hash] * 4
    left, right = _tags(grams, total, inverse, start, count, key)
    digest = _mix((total[start + count + N - 1] - total[start]) * inverse[start] + count.astype(np.uint64))
    grams *= np.cumprod(np.full(len(grams), np.uint64(_B)))
    sums = np.concatenate([no_hash, [np.uint64(0)], np.cumsum(grams)])
    check = _mix((sums[start + count + N - K] - sums[start]) * inverse[start]) >> np.uint64(32)
    return doc, local, count, key, digest, check, left, right


def suffix_order(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the N-byte strings at `at`, and which of them equal the one before them in it."""
    total, inverse = prefix_hashes(buf)

    def common(x, y):
        n = np.zeros(len(x), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            to = n + step
            ok = to <= N
            to = np.minimum(to, N)
            same = (total[x + to] - total[x]) * inverse[x] == (total[y + to] - total[y]) * inverse[y]
            n = np.where(ok & same, to, n)
        return n

    def less(x, y, or_equal):
        n = common(x, y)
        end = n >= N
        last = np.minimum(n, N - 1)
        return np.where(end, or_equal, buf[x + last] < buf[y + last])

    words = np.lib.stride_tricks.sliding_window_view(buf, 8)[at].copy().view(">u8")[:, 0]
    place = np.argsort(words, kind="stable")
    order = at[place]
    n, width = len(at), 1
    first = np.flatnonzero(np.concatenate([[True], words[place[1:]] != words[place[:-1]]]))
    size = np.diff(np.concatenate([first, [n]]))
    head, tail = np.repeat(first, size), np.repeat(first + size, size)
    while width < n:
        heads = np.arange(width, n, 2 * width)
        heads = heads[head[heads] < heads]
        todo = heads[~less(order[heads - 1], order[heads], True)]
        if len(todo):  # only the strings with the first bytes of those at the seam move
            size_a = np.minimum(width, todo - head[todo])
            size_b = np.minimum(np.minimum(width, n - todo), tail[todo] - todo)
            a_pair, b_pair = np.repeat(np.arange(len(todo)), size_a), np.repeat(np.arange(len(todo)), size_b)
            begin = todo - size_a
            a = np.arange(size_a.sum()) - np.repeat(np.cumsum(size_a) - size_a, size_a) + begin[a_pair]
            b = np.arange(size_b.sum()) - np.repeat(np.cumsum(size_b) - size_b, size_b) + todo[b_pair]
            target = []
            for items, lo0, hi0, own, or_equal in ((a, todo[a_pair], (todo + size_b)[a_pair], a - begin[a_pair], False), (b, begin[b_pair], todo[b_pair], b - todo[b_pair], True)):
                lo, hi = lo0.copy(), hi0.copy()
                while (wide := lo < hi).any():
                    mid = np.where(wide, (lo + hi) // 2, lo0)
                    before = less(order[mid], order[items], or_equal)
                    lo, hi = np.where(wide & before, mid + 1, lo), np.where(wide & ~before, mid, hi)
                target.append(own + lo - lo0)
            new = np.concatenate([target[0] + begin[a_pair], target[1] + begin[b_pair]])
            moved = np.concatenate([order[a], order[b]])
            moved_place = np.concatenate([place[a], place[b]])
            order[new], place[new] = moved, moved_place
        width *= 2
    equal = np.concatenate([[False], common(order[1:], order[:-1]) >= N]) if n else np.zeros(0, bool)
    k = np.flatnonzero(equal)
    rows = np.lib.stride_tricks.sliding_window_view(buf, N)
    if (rows[order[k]] != rows[order[k - 1]]).any():  # a hash collision: this block is ordered by its bytes
        place = np.lexsort(rows[at].T[::-1])
        order = at[place]
        equal = np.concatenate([[False], (rows[order[1:]] == rows[order[:-1]]).all(1)])
    return place, equal


def _blocks(batches):
    """The columns of batches as lists, in blocks of about BLOCK_BYTES of text (the third column)."""
    held: list[list] = []
    size = 0
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        held, lo = held or [[] for _ in cols], 0
        for i, text in enumerate(cols[2]):
            size += len(text or b"")
            if size >= BLOCK_BYTES:
                yield [h + c[lo : i + 1] for h, c in zip(held, cols)]
                held, lo, size = [[] for _ in cols], i + 1, 0
        held = [h + c[lo:] for h, c in zip(held, cols)]
    if held and held[0]:
        yield held


def _planes(values: np.ndarray) -> bytes:
    """All first bytes, all second ones and so on: those that are zero in most values take no room when compressed."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def _from_planes(data: bytes, kind: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).view(kind)[:, 0]


def _packed(known: np.ndarray, part: np.ndarray) -> tuple[bytes, bytes]:
    """Runs in the order of their documents, and the (doc_id, version) of these, both as steps and planes."""
    used, doc = np.unique(part["doc"], return_inverse=True)
    part["doc"] = np.diff(doc, prepend=0)
    return _planes(np.diff(known[used, 0], prepend=0)) + _planes(known[used, 1]), _planes(part)


def _unpacked(ids: bytes, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(doc_id, version) of each run, and the runs."""
    half, rec = len(ids) // 2, _from_planes(packed, RUN)
    known = np.array([np.cumsum(_from_planes(ids[:half], np.dtype("<i8"))), _from_planes(ids[half:], np.dtype("<i8"))]).T
    return known[np.cumsum(rec["doc"], dtype=np.int64)], rec


def _hashed(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, the block's (doc_id, version) and its runs that fall into the bucket."""

    def hashed(batches):
        for ids, versions, texts in _blocks(batches):
            doc, _, _, key, digest, check, left, right = runs(texts)
            if not len(doc):
                continue
            rec = np.empty(len(doc), RUN)
            rec["key"], rec["check"], rec["hash"], rec["doc"] = key, check, digest, doc
            rec["left"], rec["right"] = left, right
            rec["run"] = np.arange(len(doc)) - np.searchsorted(doc, doc)
            bucket = ((key * np.uint64(_B)) >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            rec, bucket = rec[order], bucket[order]
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            known = np.array([ids, versions], "<i8").T
            out = [[], [], []]
            for a, b in zip(cuts, [*cuts[1:], len(rec)]):
                for col, v in zip(out, (int(bucket[a]), *_packed(known, rec[a:b]))):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["bucket", "ids", "runs"])

    return docs.mapInArrow(hashed, "bucket long, ids binary, runs binary")


def _batch(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in schema.split(", ")])


def _shared(key: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which runs may share a string with one of another document: they have a tag in common with it, or one of their key
    has any tag."""
    out = np.zeros(len(key), bool)
    if not len(key):
        return out
    for tag in (left, right, None):
        group = key.astype(np.uint64) << np.uint64(16) | (0 if tag is None else tag)
        order = np.argsort(group, kind="stable")
        new = np.concatenate([[True], group[order][1:] != group[order][:-1]])
        heads = np.flatnonzero(new)
        found = np.minimum.reduceat(doc[order], heads) < np.maximum.reduceat(doc[order], heads)
        found &= np.logical_or.reduceat(left[order] == ANY_TAG, heads) if tag is None else tag[order][heads] != NO_TAG
        out[order] |= found[np.cumsum(new) - 1]
    return out


def _settle(parts: list[tuple[bytes, bytes]], many: int, hot: int) -> pa.RecordBatch:
    """Marks run * 8 + kind of all runs in a bucket that an earlier document has, or that may be edges."""
    ids, rec = (np.concatenate(x) for x in zip(*(_unpacked(*p) for p in parts)))
    key = (rec["key"].astype(np.uint64) << np.uint64(32)) | rec["check"]
    order = np.lexsort((ids[:, 0], rec["hash"], key))
    (doc, version), key, digest, run = ids[order].T, key[order], rec["hash"][order], rec["run"][order].astype(np.int64)
    new_key = np.concatenate([[True], key[1:] >> np.uint64(32) != key[:-1] >> np.uint64(32)])
    new_run = np.concatenate([[True], (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])])
    least = doc[np.flatnonzero(new_run)][np.cumsum(new_run) - 1]
    of_key = lambda x: np.add.reduceat(x.astype(np.int64), np.flatnonzero(new_key))[np.cumsum(new_key) - 1]
    whole, edge = doc > least, np.zeros(len(doc), bool)
    ask = np.flatnonzero(~whole & (of_key(new_run) > 1))
    edge[ask] = _shared(key[ask] >> np.uint64(32), rec["left"][order[ask]], rec["right"][order[ask]], doc[ask])
    met = of_key(edge & new_run)
    kind = np.where(whole, WHOLE, np.where(edge, np.where(met > hot, SINGLE, np.where(met > many, MANY, EDGE)), 0))
    take = np.flatnonzero(kind)
    take = take[np.lexsort((run[take], doc[take]))]
    return _batch(MARKS, doc[take], version[take], run[take] * 8 + kind[take])


def _marked(hashed: DataFrame, many: int, hot: int) -> DataFrame:
    def settle(batches):
        at, parts = None, []
        for batch in batches:
            for b, i, r in zip(*(c.to_pylist() for c in batch.columns)):
                if b != at and parts:
                    yield _settle(parts, many, hot)
                    parts = []
                at = b
                parts.append((i, r))
        if parts:
            yield _settle(parts, many, hot)

    return hashed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(settle, MARKS)


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches that spans cover; touching ones are one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    head = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return start[head], end[np.concatenate([head[1:], [len(end)]]) - 1]


def _edges(joined: DataFrame) -> DataFrame:
    """What marks ask for: the bytes of edges (whole runs by their key, or pieces of them by the least long gram or the
    hash of a string where a key has many runs), and the settled stretches, which need no sort and have no bytes."""

    def edges(batches):
        for ids, versions, texts, marks in _blocks(batches):
            doc, start, count, key, *_ = runs(texts, hashed=False)
            first = np.searchsorted(doc, np.arange(len(texts)))
            out, cut = [], {MANY: [], SINGLE: []}

            def settled(d, starts, ends):
                for a, b in zip(*(x.tolist() for x in _merged(starts, ends))):
                    out.append((ids[d] ^ a << 20, ids[d], versions[d], a, b, None))

            for d, (text, lists) in enumerate(zip(texts, marks)):
                m = np.array(lists, np.int64)
                whole, edge, *more = (first[d] + m[m % 8 == k] // 8 for k in KINDS)
                settled(d, start[whole], start[whole] + count[whole] + N - 1)
                for place, s, c in zip(key[edge].view("<i8").tolist(), start[edge].tolist(), count[edge].tolist()):
                    out.append((place, ids[d], versions[d], s, s + c + N - 1, text[s : s + c + N - 1]))
                for k, i in zip(cut, more):
                    cut[k] += ((text[s : s + c + N - 1], d, s) for s, c in zip(start[i].tolist(), count[i].tolist()))
            parts, least = [], {}
            for k, own in cut.items():
                if own:
                    piece, at, c, place, *_ = runs([x[0] for x in own], hashed=False, k=LONG_K if k == MANY else N)
                    for j, a, b, to in zip(piece.tolist(), at.tolist(), (at + c + N - 1).tolist(), place.view("<i8").tolist()):
                        text, d, s = own[j]
                        parts.append((to, d, s + a, text[a:b]))
            for _, d, _, part in parts:
                least[part] = min(ids[d], least.get(part, ids[d]))
            known = defaultdict(list)
            for place, d, s, part in parts:  # only the first document of the block has to ask the others
                if least[part] < ids[d]:
                    known[d].append((s, s + len(part)))
                else:
                    out.append((place, ids[d], versions[d], s, s + len(part), part))
            for d, places in known.items():
                settled(d, *np.array(places).T)
            cols = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (*[pa.int64()] * 5, pa.binary()))], names=["place", "doc_id", "version", "start", "end", "part"])

    return joined.mapInArrow(edges, "place long, doc_id long, version long, start long, end long, part binary")


def _spans(edges: DataFrame) -> DataFrame:
    """Stretches to remove: the settled ones, and strings that an earlier document has, by suffix sorts of whole places."""

    def settle(docs, versions, starts, parts):
        buf = np.frombuffer(b"".join(parts), np.uint8)
        count = np.array([len(p) - N + 1 for p in parts])
        base = np.cumsum([0, *map(len, parts)])[:-1]
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at, begin = np.repeat(base, count) + inner, np.repeat(np.array(starts), count) + inner
        place, equal = suffix_order(buf, at)
        owner, begin = np.repeat(np.arange(len(docs)), count)[place], begin[place]
        doc, version = np.array(docs)[owner], np.array(versions)[owner]
        heads = np.flatnonzero(~equal)
        least = np.minimum.reduceat(doc, heads)[np.cumsum(~equal) - 1]
        gone = doc > least
        doc, version, begin = doc[gone], version[gone], begin[gone]
        order = np.lexsort((begin, version, doc))  # neighbouring strings are one stretch
        doc, version, begin = doc[order], version[order], begin[order]
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (version[1:] != version[:-1]) | (begin[1:] > begin[:-1] + 1)])) if len(doc) else np.zeros(0, int)
        return _batch(SPANS, doc[new], version[new], begin[new], begin[np.concatenate([new[1:], [len(doc)]]) - 1] + N if len(doc) else begin)

    def sort(batches):
        held, size, at = ([], [], [], []), 0, None
        for batch in batches:
            known = batch.filter(pc.is_null(batch.column(5)))
            if known.num_rows:
                yield pa.RecordBatch.from_arrays([known.column(c) for c in (1, 2, 3, 4)], names=["doc_id", "version", "start", "end"])
            batch = batch.filter(pc.is_valid(batch.column(5)))
            for place, doc, version, start, part in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 3, 5))):
                if place != at and size > SORT_STRINGS:
                    yield settle(*held)
                    held, size = ([], [], [], []), 0
                at = place
                for col, v in zip(held, (doc, version, start, part)):
                    col.append(v)
                size += len(part) - N + 1
        if size:
            yield settle(*held)

    return edges.repartition("place").sortWithinPartitions("place").mapInArrow(sort, SPANS)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def repeated_spans(docs: DataFrame, many_runs: int = MANY_RUNS, hot_runs: int = HOT_RUNS) -> DataFrame:
    """One row for each row of docs: removed byte spans of its UTF-8 text, their counts and the digest of the rest.

    A byte goes if a string of N bytes over it also starts in a document with a smaller doc_id. Null texts are empty;
    texts under N bytes lose nothing; a text of any length is hashed in one task that holds it; rows with a null doc_id
    neither lose nor cause anything; rows of one doc_id, of equal or different texts, don't remove one another; an
    empty table gives no rows; other columns are not read.

    Runs of texts travel once as records of 28 bytes, about 23 compressed, texts twice, next to what is asked of them; the
    shuffles and tables of a step are removed before the next but one. Texts are told apart by a hash if a doc_id has several.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), F.col("text").cast("binary").alias("text"))
    known = docs.where("doc_id is not null and text is not null")
    by_id = known.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("n"), (F.min("version") < F.max("version")).alias("several"))
    total, several = by_id.agg(F.sum("n"), F.max("several")).first()
    total = total or 0
    if not several:  # eight bytes less for each document and bucket, and for each mark
        docs = docs.withColumn("version", F.lit(0).cast("long"))
        known = docs.where("doc_id is not null and text is not null")
    keys = ["doc_id", "version"] if several else ["doc_id"]
    gathered = lambda df, *cols: df.groupBy(*keys).agg(*(F.collect_list(c).alias(c) for c in cols)).hint("merge")
    marks = stored(_marked(_hashed(known, max(1, total // BUCKET_BYTES)), many_runs, hot_runs), "marks")
    spans = stored(_spans(_edges(known.join(gathered(marks, "mark"), keys).select("doc_id", "version", "text", "mark"))), "spans")
    dropped(marks)
    joined = docs.join(gathered(spans, "start", "end"), keys, "left").select("doc_id", "version", "text", "start", "end")

    def cut(batches):
        for ids, _, texts, starts, ends in _blocks(batches):
            cols = defaultdict(list)
            for doc_id, text, s, e in zip(ids, texts, starts, ends):
                text = text or b""
                s, e = (x.tolist() for x in _merged(np.array(s or [], np.int64), np.array(e or [], np.int64)))
                keep = b"".join(text[a:b] for a, b in zip([0, *e], [*s, len(text)]))
                for name, v in (("doc_id", doc_id), ("n_bytes", len(text)), ("n_removed", len(text) - len(keep)), ("n_spans", len(s)), ("kept_sha256", hashlib.sha256(keep).hexdigest()), ("spans", [{"start": a, "end": b} for a, b in zip(s, e)])):
                    cols[name].append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols.values(), types)], names=list(cols))

    return joined.mapInArrow(cut, RESULT)
