"""License scans: an exact set-similarity join of text blocks with license notices by containment.

A notice and a block are sets of words, all in one global order, rarest first by the number of documents that have them.
A notice of m words of which need must be met has a prefix of m - need + 1 words: a block without any of these can't meet
it. The first common word bounds what can follow it in both (positional filter), and a block of fewer than need known
words is out (length filter). What is left is counted in full.

Blocks: a notice of w words is sought in windows of 2s words that begin every s words, where s is the least power of two,
8 or more, that isn't below w; so any s + 1 consecutive words lie whole in one block.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import NOTICES, PHRASES

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")  # of bytes: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of characters
GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
LEAST_PERCENT = 90

#: Bytes of a text whose words are held at once.
CHUNK = 1 << 20

RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<label:string,notice:int,first_word:bigint,words:int,containment:double>>"


def words_of(text: str) -> list[bytes]:
    return WORDS.findall(text.encode().lower())


def _chunks(text: bytes):
    """Words of a lower-cased text, about CHUNK bytes of it at a time; no word is cut."""
    low = 0
    while low < len(text):
        gap = GAP.search(text, low + CHUNK)
        high = gap.start() if gap else len(text)
        yield WORDS.findall(text, low, high)
        low = high


def _texts(batch: pa.RecordBatch, at: int):
    for value in batch.column(at).cast(pa.binary()):
        yield (value.as_py() or b"").lower()


def block_step(n_words: int) -> int:
    return 1 << max(3, (n_words - 1).bit_length())


def need_of(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def document_frequencies(docs: DataFrame, words: set[bytes]) -> dict[bytes, int]:
    """In how many documents each of the given words is; as many rows as words reach the driver."""

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in _texts(batch, 0):
                own: set = set()
                for some in _chunks(text):
                    own |= words.intersection(some)
                seen.update(own)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    got = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in got}


class Notices:
    """Notices as sets of ranks with an index of their prefixes, by block step."""

    def __init__(self, notices: list[tuple[str, str]], phrases: dict[str, str], frequency: dict[bytes, int], percent: int):
        texts = [(label, words_of(text)) for label, text in notices]
        known = {w for _, ws in texts for w in ws} | {w for p in phrases for w in words_of(p)}
        self.rank = {w: i for i, w in enumerate(sorted(known, key=lambda w: (frequency.get(w, 0), w)))}
        self.phrases = [(np.array([self.rank[w] for w in words_of(p)], np.int32), label) for p, label in phrases.items()]
        self.labels, self.sets, self.need = [label for label, _ in texts], [], []
        self.index: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for i, (_, ws) in enumerate(texts):
            ranks = sorted({self.rank[w] for w in ws})
            self.sets.append(frozenset(ranks))
            self.need.append(need_of(len(ranks), percent))
            own = self.index.setdefault(block_step(len(ws)), {})
            for at, r in enumerate(ranks[: len(ranks) - self.need[i] + 1]):
                own.setdefault(r, []).append((i, at))
        self.prefix = {s: np.array(sorted(own), np.int32) for s, own in self.index.items()}
        self.all_prefixes = frozenset(r for own in self.index.values() for r in own)

    def base(self, ids: np.ndarray, present: set[int]) -> list[tuple[int, str]]:
        """(first word, label) of each phrase."""
        out = []
        for phrase, label in self.phrases:
            k = len(phrase)
            if k <= len(ids) and present.issuperset(phrase.tolist()):
                hit = ids[: len(ids) - k + 1] == phrase[0]
                for j in range(1, k):
                    hit &= ids[j : len(ids) - k + 1 + j] == phrase[j]
                out += [(int(p), label) for p in np.nonzero(hit)[0]]
        return out

    def blocks(self, ids: np.ndarray, present: set[int]):
        """(notice, first word of the block, words of it, containment) of each block that meets a notice."""
        if present.isdisjoint(self.all_prefixes):
            return
        for step, index in self.index.items():
            if present.isdisjoint(index):
                continue
            at = np.nonzero(np.isin(ids, self.prefix[step]))[0] // step
            for k in np.unique(np.concatenate([at, at[at > 0] - 1])).tolist():
                span = ids[k * step : (k + 2) * step]
                block = np.unique(span[span >= 0]).tolist()
                seen: set = set()
                for j, r in enumerate(block):
                    for i, place in index.get(r, ()):
                        need = self.need[i]
                        if i in seen or len(block) < need:
                            continue
                        seen.add(i)
                        if min(len(self.sets[i]) - place, len(block) - j) >= need:
                            met = len(self.sets[i].intersection(block))
                            if met >= need:
                                yield i, k * step, len(span), met / len(self.sets[i])


def scan(docs: DataFrame, notices: list[tuple[str, str]] = NOTICES, phrases: dict[str, str] = PHRASES, percent: int = LEAST_PERCENT) -> DataFrame:
    """Words, phrase places, labels, score and matching blocks of each document.

    base_labels are those of the phrases, labels also have those of the notices that a block meets; both are distinct,
    sorted and joined by commas. score is 1 for a phrase, else the largest containment found, else 0. A null text is
    empty: no words, labels empty, score 0. Texts of any length are read whole, in pieces between words; each row is
    judged by itself, so repeated rows and null doc_ids stay; other columns are dropped; an empty table gives no rows.
    Notices and phrases are parameters that go along with the code; the corpus is counted in one pass and scanned in
    another, and no text is shuffled.
    """
    known = {w for _, text in notices for w in words_of(text)} | {w for p in phrases for w in words_of(p)}
    index = Notices(notices, phrases, document_frequencies(docs, known), percent)

    def apply(batches):
        rank = index.rank
        for batch in batches:
            rows: list[list] = [[] for _ in range(8)]
            for text in _texts(batch, 1):
                parts = [np.fromiter(map(rank.get, some, repeat(-1)), np.int32, len(some)) for some in _chunks(text)]
                ids = parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, np.int32), *parts])
                present = set(ids.tolist())
                base = index.base(ids, present)
                found = list(index.blocks(ids, present))
                places = [p for p, _ in base]
                base_labels = {label for _, label in base}
                labels = base_labels | {index.labels[i] for i, *_ in found}
                score = 1.0 if base else max((c for *_, c in found), default=0.0)
                blocks = [{"label": index.labels[i], "notice": i, "first_word": p, "words": n, "containment": c} for i, p, n, c in found]
                for col, v in zip(rows, (len(ids), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, blocks)):
                    col.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("notice", pa.int32()), ("first_word", pa.int64()), ("words", pa.int32()), ("containment", pa.float64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows, kinds)], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(apply, RESULT)


def _oracle() -> str:
    """Every block of every document counted against every notice."""
    quoted = lambda ws: "[" + ", ".join(f"'{w.decode()}'" for w in ws) + "]"
    phrases = "\n  UNION ALL ".join(f"SELECT doc_id, unnest(list_filter(range(len(w) - {len(words_of(p)) - 1}), lambda i: w[i + 1:i + {len(words_of(p))}] = {quoted(words_of(p))})) AS place, '{label}' AS label FROM d" for p, label in PHRASES.items())
    rows = []
    for i, (label, text) in enumerate(NOTICES):
        ws = sorted(set(words_of(text)))
        rows.append(f"({i}, '{label}', {block_step(len(words_of(text)))}, {need_of(len(ws), LEAST_PERCENT)}, {quoted(ws)})")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""WITH notices(notice, label, step, need, ws) AS (VALUES {", ".join(rows)}),
d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
base AS ({phrases}),
base_rows AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM d),
tokens AS (SELECT notice, label, step, need, len(ws) AS m, unnest(ws) AS word FROM notices),
met AS (SELECT doc_id, notice, label, need, m, unnest([pos // step, pos // step - 1]) AS block, words.word FROM words JOIN tokens USING (word)),
found AS (SELECT doc_id, label, count(DISTINCT word) / m AS containment FROM met WHERE block >= 0 GROUP BY doc_id, notice, label, need, m, block HAVING count(DISTINCT word) >= need),
labelled AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM found UNION ALL SELECT doc_id, label FROM base) GROUP BY doc_id),
best AS (SELECT doc_id, max(containment) AS score FROM found GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(score, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base_rows USING (doc_id) LEFT JOIN labelled USING (doc_id) LEFT JOIN best USING (doc_id)"""


ORACLE = _oracle()
