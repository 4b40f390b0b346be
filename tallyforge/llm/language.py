"""Language ID: a linear-chain conditional random field over words.

Emissions are sums of learned weights of a word's affixes, character n-grams and the word itself (lexicon); learned
transitions tie neighbouring words, so words of code-switched text get their own languages by forward-backward.
A document's language has the largest share of letters in expectation.
"""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chains import Adam, forward_backward, layout
from .common import bounded_sample, crc32_text

#: At most so many documents, and of each at most so many words in chunks spread over the whole text, fit the field.
TRAIN_DOCS, TRAIN_WORDS, CHUNK = 2000, 240, 12
BUCKETS, CHAIN, ROUNDS, RATE, RIDGE = 1 << 15, 60, 25, 0.1, 1e-7
MAX_WORDS, LONG = 400_000, 40
BLOCK_WORDS = 300_000

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters in lower case; what counts as a word character without being a letter (½, ①) parts them, and a run of
    more than LONG letters is cut into pieces of LONG, neighbours in the chain."""
    found = _WORD.findall(text.lower()) if text else []
    if not all(map(str.isalpha, found)):
        found = [part for w in found for part in "".join(c if c.isalpha() else " " for c in w).split()]
    if found and len(max(found, key=len)) > LONG:
        found = [w[at : at + LONG] for w in found for at in range(0, len(w), LONG)]
    return found


def buckets(word: str) -> list[int]:
    """Hashed features of a word: itself, prefixes and suffixes up to 3, n-grams of 2 and 3 with edges."""
    b = word.encode("utf-8", "surrogatepass")
    edged = f"^{word}$".encode("utf-8", "surrogatepass")
    crc = zlib.crc32
    out = [crc(b"w" + b)]
    out += [crc(b"p" + edged[1 : 1 + k]) for k in (2, 3, 4)]
    out += [crc(b"s" + edged[-1 - k : -1]) for k in (2, 3, 4)]
    out += [crc(edged[i : i + 3], 3) for i in range(len(edged) - 2)]
    out += [crc(edged[i : i + 2], 2) for i in range(0, len(edged) - 1)]
    return [x % BUCKETS for x in out]


class LanguageField:
    def __init__(self, langs: list[str], weights: np.ndarray, move: np.ndarray, first: np.ndarray):
        self.langs, self.weights, self.move, self.first, self.key = langs, weights, move, first, uuid.uuid4().hex

    @classmethod
    def fit(cls, texts: list[list[str]], langs: list[str]) -> LanguageField:
        """Chains of CHAIN words are spliced from chunks of the documents, so that languages change inside chains."""
        names = sorted(set(langs))
        if len(names) < 2:
            return cls(names, np.zeros((BUCKETS, len(names)), np.float32), np.zeros((len(names),) * 2), np.zeros(len(names)))
        code = {k: i for i, k in enumerate(names)}
        vocabulary: dict[str, int] = {}
        chunks = []
        for ws, lang in zip(texts, langs):
            for at in range(0, len(ws), CHUNK):
                part = ws[at : at + CHUNK]
                chunks.append((code[lang], [vocabulary.setdefault(w, len(vocabulary)) for w in part]))
        rng = np.random.default_rng(11)
        # runs of two to eight chunks of one language, runs shuffled
        by = [[c for c in chunks if c[0] == i] for i in range(len(names))]
        runs = []
        for own in by:
            at = 0
            mixed = [own[i] for i in rng.permutation(len(own))]
            while at < len(mixed):
                k = int(rng.integers(2, 9))
                runs.append(mixed[at : at + k])
                at += k
        ids, y = [], []
        for r in rng.permutation(len(runs)):
            for lang, ws in runs[r]:
                ids += ws
                y += [lang] * len(ws)
        ids, y = np.array(ids), np.array(y)
        lengths = np.full(-(-len(ids) // CHAIN), CHAIN)
        lengths[-1] = len(ids) - CHAIN * (len(lengths) - 1)
        _, active, places = layout(lengths)
        inside = np.ones(len(ids), bool)
        inside[np.cumsum(lengths) - 1] = False
        moves = np.zeros((len(names),) * 2)
        np.add.at(moves, (y[:-1][inside[:-1]], y[1:][inside[:-1]]), 1)
        ids, y = ids[places], y[places]
        feats = [buckets(w) for w in vocabulary]
        at = np.concatenate([[0], np.cumsum([len(f) for f in feats])[:-1]])
        word_of = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
        flat = np.concatenate([np.array(f) for f in feats])
        w, move, first = np.zeros((BUCKETS, len(names))), np.zeros((len(names),) * 2), np.zeros(len(names))
        opt, n, observed, starts = Adam(RATE), len(ids), np.eye(len(names))[y], active[0]
        for _ in range(ROUNDS):
            emit = np.add.reduceat(w[flat], at, axis=0)
            marginal, pairs, _ = forward_backward(emit[ids], move, first, active, True)
            wrong = observed - marginal
            grad = np.stack([np.bincount(flat, np.bincount(ids, wrong[:, k], len(feats))[word_of], BUCKETS) for k in range(len(names))], 1)
            opt.step("w", w, grad / n - RIDGE * w)
            opt.step("move", move, (moves - pairs) / n - 1e-4 * move)
            opt.step("first", first, wrong[:starts].sum(0) / n - 1e-4 * first)
            opt.t += 1
        return cls(names, w.astype(np.float32), move, first)


class _Words:
    """Emissions of the words that this worker has met under one field, at most MAX_WORDS, then it starts anew."""

    def __init__(self, field: LanguageField):
        self.field = field
        self.clear()

    def clear(self):
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1 << 12, len(self.field.langs)), np.float32)

    def ids(self, chains: list[list[str]]) -> list[np.ndarray]:
        if len(self.at) > MAX_WORDS:
            self.clear()
        new = list(set().union(*chains) - self.at.keys())
        if new:
            base = len(self.at)
            while base + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            feats = [buckets(w) for w in new]
            sizes = np.array([len(f) for f in feats])
            flat = np.fromiter((x for f in feats for x in f), np.int64, sizes.sum())
            self.rows[base : base + len(new)] = np.add.reduceat(self.field.weights[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
            self.at.update(zip(new, range(base, base + len(new))))
        get = self.at.__getitem__
        return [np.fromiter(map(get, c), np.int64, len(c)) for c in chains]


_MET: dict[str, _Words] = {}


def label_words(field: LanguageField, chains: list[list[str]]) -> np.ndarray:
    """Marginals of all words of all chains, one after the other."""
    if field.key not in _MET:
        _MET.clear()
        _MET[field.key] = _Words(field)
    met = _MET[field.key]
    ids = np.concatenate(met.ids(chains))
    _, active, places = layout(np.array([len(c) for c in chains]))
    out = np.empty((len(ids), len(field.langs)), np.float32)
    out[places] = forward_backward(met.rows[ids[places]].astype(np.float64), field.move, field.first, active)
    return out


def classify(field: LanguageField, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text, in blocks of words from texts of about one length."""
    split = [words(t) for t in texts]
    langs, scores = ["und"] * len(texts), np.zeros(len(texts))
    order = [i for i in sorted(range(len(split)), key=lambda i: len(split[i])) if split[i]]
    at = 0
    while at < len(order) and field.langs:
        to, total = at, 0
        while to < len(order) and (to == at or total + len(split[order[to]]) <= BLOCK_WORDS):
            total += len(split[order[to]])
            to += 1
        chains = [split[i] for i in order[at:to]]
        if len(field.langs) > 1:
            marginal = label_words(field, chains)
        else:
            marginal = np.ones((total, 1), np.float32)
        weight = np.fromiter((len(w) for c in chains for w in c), np.float64, total)
        bounds = np.concatenate([[0], np.cumsum([len(c) for c in chains])[:-1]])
        share = np.add.reduceat(marginal * weight[:, None], bounds, axis=0) / np.add.reduceat(weight, bounds)[:, None]
        best = share.argmax(1)
        for k, i in enumerate(order[at:to]):
            langs[i], scores[i] = field.langs[best[k]], min(1.0, round(float(share[k, best[k]]), 6))
        at = to
    return langs, scores


def held_out(col: str = "doc_id"):
    return F.coalesce(crc32_text(col) % 3 == 1, F.lit(False))


def train(docs: DataFrame, rows: int = TRAIN_DOCS, words_each: int = TRAIN_WORDS) -> LanguageField:
    """Fit on at most `rows` documents with a language whose crc32(doc_id) mod 3 is not 1, and on about `words_each`
    words of each, in chunks from its beginning to its end."""
    known = docs.where("lang is not null and doc_id is not null").where(~held_out()).select("doc_id", "lang")
    sample = bounded_sample(known, "doc_id", rows).select("doc_id")

    def spread(batches):
        for batch in batches:
            out = []
            for t in batch.column(2).to_pylist():
                ws = words(t)
                step = max(CHUNK, len(ws) * CHUNK // words_each)
                out.append([w for at in range(0, len(ws), step) for w in ws[at : at + CHUNK]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.string()))], names=["doc_id", "lang", "ws"])

    chosen = docs.where("lang is not null").join(F.broadcast(sample.distinct()), "doc_id").select("doc_id", "lang", "text")
    got = chosen.mapInArrow(spread, "doc_id long, lang string, ws array<string>").toPandas().sort_values(["doc_id", "lang"], kind="stable")
    return LanguageField.fit([list(ws) for ws in got["ws"]], got["lang"].tolist())


def identify(docs: DataFrame, field: LanguageField) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs.

    A null text or one without a letter is `und` with score 0; a text of any length is labelled whole, as one chain;
    of languages with equal shares the first by name is taken; a null doc_id is not held out; repeated rows
    get the same answer; an empty table gives no rows; other columns are not read.
    """

    def labelled(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                langs, scores = classify(field, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(labelled, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
