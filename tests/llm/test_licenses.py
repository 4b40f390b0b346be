"""License scans against every block and notice, planted notices and odd texts."""

import random
import re

import numpy as np
import pytest

from tallyforge.llm import licenses
from tallyforge.llm.license_texts import NOTICES, PHRASES

DOCS = "doc_id long, text string, blocks string, n_words int"


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, notices, phrases, percent=90):
    w = plain_words(text)
    places = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(plain_words(p))] == plain_words(p)]
    blocks = set()
    for n, (_, body) in enumerate(notices):
        step, words = licenses.block_step(len(plain_words(body))), set(plain_words(body))
        for at in range(0, len(w), step):
            met = len(words & set(w[at : at + 2 * step]))
            if 100 * met >= percent * len(words):
                blocks.add((n, at, met / len(words)))
    base = {label for _, label in places}
    at = [i for i, _ in places]
    score = 1.0 if places else max((c for *_, c in blocks), default=0.0)
    return (len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {notices[n][0] for n, *_ in blocks})), score, blocks)


def check(spark, texts, notices=NOTICES, phrases=PHRASES, percent=90):
    rows = licenses.scan(spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], DOCS).repartition(3), notices, phrases, percent).collect()
    got = {r["doc_id"]: (*r[1:8], {(b["notice"], b["first_word"], b["containment"]) for b in r["blocks"]}) for r in rows}
    assert got == {i: brute(t, notices, phrases, percent) for i, t in enumerate(texts)}
    return got


def test_planted_notices_and_odd_texts(spark):
    rng = random.Random(3)
    said = lambda n: " ".join(rng.choice("river stone the of and license version public is free".split()) for _ in range(n))
    changed = NOTICES[1][1].replace("granted", "given").replace("Software", "Programme", 1)
    texts = [None, "", " \t\n", "é", "Under the MIT\nLicense, under the mit license", "CC BY-NC 4.0", "cc by ncx", "Apache LICENSE (version 2)", "licence", said(500)]
    texts += [f"{said(40)} {body} {said(30)}" for _, body in NOTICES] + [changed.upper(), "x" * 3000, "This work is licensed under the GNU General Public License, version 3.", "licensed under the GNU General Public License, version 4", "ÀB under the mit license" * 2]
    got = check(spark, texts)
    assert [got[10 + i][5].split(",") for i in range(len(NOTICES))] == [[label] for label, _ in NOTICES]
    assert got[24][5] == "mit" and got[24][6] < 1 and got[26][5] == "gpl-3" and got[27][5] == ""
    assert licenses.scan(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("percent", [60, 90, 100])
def test_join_equals_all_pairs_on_random_words(spark, percent):
    rng = np.random.default_rng(percent)
    words = [f"w{i}" for i in range(40)]
    draw = lambda n: " ".join(words[i] for i in np.minimum(rng.geometric(0.08, n), 40) - 1)
    notices = [(f"l{i % 5}", draw(int(rng.integers(1, 30)))) for i in range(12)]
    check(spark, [draw(int(rng.integers(0, 200))) for _ in range(120)], notices, {"w1 w1": "a", "w3": "b"}, percent)


def test_pieces_cut_no_word(spark, monkeypatch):
    text = ("word " * 7 + "longerword-" * 3 + NOTICES[6][1] + " é" * 9).encode().lower() * 5
    for size in (1, 5, 64, 1 << 20):
        monkeypatch.setattr(licenses, "CHUNK", size)
        assert [w for some in licenses._chunks(text) for w in some] == licenses.WORDS.findall(text)


def test_frequencies_count_documents(spark):
    docs = spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(["The the cat", "the DOG", None, "thé"])], DOCS)
    assert licenses.document_frequencies(docs, {b"the", b"cat", b"emu"}) == {b"the": 2, b"cat": 1}
