"""Brute force, odd tables and odd texts for every operator and stage."""

import itertools
import random
import zlib

import numpy as np
import pytest

from tallyforge.llm import chains, decontaminate, language, line_quality, near_dup, packing, quality_rules, secrets, suffix_dedup, token_files, tokens, tool_calls
from tallyforge.llm.queries import tokenizer

DOCS = "doc_id long, text string"
LABELS = "doc_id long, quality int, toxic int"
EN = "the of and to in is that for it was with as his on be at by this had not are but from or have an they which one you".split()
DE = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass".split()


def said(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


# Tokens


def test_encoder_equals_the_library_on_odd_strings():
    rng = random.Random(4)
    pool = [chr(c) for c in (*range(32, 0x250), *range(0x370, 0x480))] + list("İıŞßẞŉΐﬁŀ½²①—…’̀́̇ͅ​‍­﻿　\x0b\x1c\x85\t\n你好ไทยกำ한국אב😀") + ["TARİHİ,", "İ.", "KALESİ:", "Hello,", "<|", "'s", "4.5"]
    texts = ["".join(rng.choice(pool) if rng.random() < 0.5 else rng.choice("abcde ,.") for _ in range(rng.randint(1, 14))) for _ in range(30000)]
    encoder = tokens.WordEncoder(tokenizer())
    assert encoder.encode(texts) == encoder._raw(texts)


def test_long_texts_are_encoded_in_parts(monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_CHARS", 50)
    encoder = tokens.WordEncoder(tokenizer(), max_words=20)
    texts = ["one two three. " * 40, "x" * 300, "", None, "ends here"]
    assert encoder.encode(texts) == encoder._raw([t or "" for t in texts])


# Packing


def test_packing_is_first_fit_decreasing():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 50, 300):
        lengths = rng.integers(1, 101, n)
        room, bins, offsets = [], np.zeros(n, int), np.zeros(n, int)
        for i in sorted(range(n), key=lambda i: -lengths[i]):
            b = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
            if b == len(room):
                room.append(100)
            bins[i], offsets[i] = b, 100 - room[b]
            room[b] -= lengths[i]
        got = packing.first_fit_decreasing(lengths, 100)
        assert got[0].tolist() == bins.tolist() and got[1].tolist() == offsets.tolist()


def test_packed_ids_and_null_ids(spark):
    texts = ["same"] * 40 + ["TARİHİ, " * 300]
    docs = spark.createDataFrame([(None, t) for t in texts] + [(7, "a b c")], DOCS)
    rows = packing.pack(docs, tokenizer(), sequence=128, group_docs=4).collect()
    raw = tokens.WordEncoder(tokenizer())._raw(["same"])[0] + np.array([2], "<u4").tobytes()
    same = [r for r in rows if r["doc_tokens"] == len(raw) // 4 and r["doc_id"] is None]
    assert {r["ids_crc32"] for r in same} == {zlib.crc32(raw)} and len(same) == 40
    assert len({r["sequence_id"] >> 32 for r in same}) > 2  # not one group


# Fields


@pytest.mark.parametrize("labels", [2, 3])
def test_forward_backward_equals_all_paths(labels):
    rng = np.random.default_rng(labels)
    lengths = np.array([3, 1, 4, 2])
    emit, move, first = rng.normal(size=(lengths.sum(), labels)), rng.normal(size=(labels, labels)), rng.normal(size=labels)
    _, active, places = chains.layout(lengths)
    got = np.empty_like(emit)
    marginal, pairs, log_z = chains.forward_backward(emit[places], move, first, active, True)
    got[places] = marginal
    want, want_pairs, want_z, at = np.zeros_like(emit), np.zeros((labels, labels)), 0.0, 0
    for n in lengths:
        paths = list(itertools.product(range(labels), repeat=int(n)))
        score = np.array([first[p[0]] + sum(emit[at + t, k] for t, k in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:])) for p in paths])
        weight = np.exp(score) / np.exp(score).sum()
        want_z += np.log(np.exp(score).sum())
        for p, w in zip(paths, weight):
            for t, k in enumerate(p):
                want[at + t, k] += w
            for a, b in zip(p, p[1:]):
                want_pairs[a, b] += w
        at += n
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs) and np.isclose(log_z, want_z)


def test_language_of_held_out_and_odd_texts(spark):
    rng = random.Random(1)
    rows = [(i, said(rng, (EN, DE)[i % 2], 30), ("en", "de")[i % 2]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    field = language.train(docs)
    got = language.identify(docs, field).collect()
    assert all(r["lang_pred"] == ("en", "de")[r["doc_id"] % 2] and 0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    odd = [(1, None), (2, ""), (3, "½ ① 12 ² !"), (4, "x" * 100_000), (None, "the of and"), (5, "der und das"), (5, "der und das"), (6, "the of and to in ½ is " + said(rng, DE, 4))]
    found = language.identify(spark.createDataFrame([(i, t, "de", 0.5) for i, t in odd], DOCS + ", lang_pred string, score double"), field).collect()
    assert [r["lang_pred"] for r in found][:3] == ["und"] * 3 and [r["score"] for r in found][:3] == [0.0] * 3
    assert [(r["held_out"], r["lang_pred"]) for r in found if r["doc_id"] is None] == [(False, "en")]
    assert [r["lang_pred"] for r in found if r["doc_id"] == 5] == ["de", "de"] and len(found) == len(odd)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.identify(empty, language.train(empty)).count() == 0
    assert [r["lang_pred"] for r in language.identify(docs.limit(2), language.train(empty)).collect()] == ["und"] * 2


def test_words_of_a_text_of_two_languages_have_their_own_labels(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, said(rng, (EN, DE)[i % 2], 40), ("en", "de")[i % 2]) for i in range(200)], "doc_id long, text string, lang string")
    field = language.train(docs)
    chain = said(rng, EN, 20).split() + said(rng, DE, 20).split()
    best = [field.langs[k] for k in language.label_words(field, [chain]).argmax(1)]
    assert best[:18] == ["en"] * 18 and best[22:] == ["de"] * 18


def test_words_are_letters_in_pieces():
    assert language.words("½ab①c d2e") == ["ab", "c", "d", "e"] and language.words(None) == []
    assert language.words("z" * 95) == ["z" * 40, "z" * 40, "z" * 15]


BAD = "buy now !!! click # here $$$ | free"


def test_line_quality_marks_lines_and_documents(spark):
    rng = random.Random(3)
    texts, y = [], []
    for i in range(200):
        good, n = i % 2, rng.randint(4, 12)
        lines = [said(rng, EN, 12) + "." if good else BAD.upper() + str(rng.randint(0, 99)) for _ in range(n)]
        texts.append("\n".join(lines)), y.append(good)
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    labels = spark.createDataFrame([(i, v, 0) for i, v in enumerate(y)], LABELS)
    field = line_quality.train(docs, labels)
    got = line_quality.score(docs, field).collect()
    assert all(r["predicted"] == y[r["doc_id"]] == (r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    odd = [(1, None), (2, ""), (3, "\n" * 50_000), (4, said(rng, EN, 200_000)), (None, "the"), (5, BAD), (5, BAD)]
    found = line_quality.score(spark.createDataFrame([(i, t, 0.1) for i, t in odd], DOCS + ", score double"), field).collect()
    assert len(found) == len(odd) and all(0 <= r["score"] <= 1 for r in found) and len({r["score"] for r in found if r["doc_id"] == 5}) == 1
    empty = spark.createDataFrame([], DOCS)
    assert line_quality.score(empty, line_quality.train(empty, labels.limit(0))).count() == 0


def test_lines_are_relabelled_only_for_sure_and_for_a_small_part():
    own, good = np.array([0, 0, 0, 0, 1, 1, 1, 1]), np.array([0.95, 0.99, 0.2, 0.1, 0.02, 0.8, 0.9, 0.5])
    weight, doc = np.array([1, 1, 1, 1, 1, 1, 1, 5]), np.repeat([0, 1], 4)
    assert line_quality.relabelled(own, good, weight, doc).tolist() == [0, 1, 0, 0, 0, 1, 1, 1]


def test_long_labelled_documents_are_kept(spark):
    lines = [f"{w} {i}" for i in range(500) for w in EN[:2]]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, BAD), (3, BAD), (4, BAD)], DOCS)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 0, 0), (4, 0, 0)], LABELS)
    assert line_quality.train(docs, labels).prior is None or zlib.crc32(b"1") % 5 == 0


# Quality rules


def test_boosted_trees_are_monotonic_and_survive_odd_tables(spark):
    rng = random.Random(5)
    texts = [said(rng, EN, 60) if i % 2 else " ".join(rng.choice("#*$%&|<>") * rng.randint(1, 4) for _ in range(80)) for i in range(120)]
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], DOCS + ", n_words long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)], LABELS)
    model = quality_rules.train(docs, labels)
    got = quality_rules.judge(docs, model).collect()
    assert all(r["kept"] == (r["doc_id"] % 2 == 1) for r in got if not r["base_failed"]) and not any(r["kept"] for r in got if r["base_failed"])
    assert sorted(r["doc_id"] for r in quality_rules.keep_good(docs, model).collect()) == sorted(r["doc_id"] for r in got if r["kept"])
    assert quality_rules.keep_good(docs, model).columns == docs.columns
    empty = docs.limit(0)
    assert quality_rules.judge(empty, quality_rules.train(empty, labels.limit(0))).count() == 0


# Secrets


def test_models_tell_random_strings_from_names_in_code(spark):
    rng = random.Random(6)
    words = [w for w in EN + DE if w.isascii()] + "river stone market window garden letter account balance customer service example report parser factory response system package library version".split()
    words += ["".join(rng.choice("ba co di fu ge lo mi na po ra se ti vu wen tor".split()) for _ in range(rng.randint(2, 5))) for _ in range(2000)] + [str(k * k) for k in range(300)]
    keys = ["".join(rng.choice(secrets.ALPHABET[:64]) for _ in range(rng.randint(20, 40))) for _ in range(200)]
    docs = spark.createDataFrame([(i, said(rng, words, 80) + (f' token = "{k}"' if i % 3 else "")) for i, k in enumerate(keys)], DOCS)
    ratios = secrets.train(docs)
    plain = ["src/main/java/com/example/service", "getUserAccountBalanceForCustomer", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "X" * 24, "-" * 40, "MAX_CONNECTION_POOL_SIZE", "2024-02-29-release-notes-final", "12345678901234567890", "response-parser-factory-report"]
    fresh = ["".join(rng.choice(secrets.ALPHABET[:64]) for _ in range(rng.randint(24, 40))) for _ in range(200)]
    test = spark.createDataFrame([(i, f"see {w} there\nnext {w}") for i, w in enumerate(plain + fresh)], DOCS)
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(test, ratios).collect()}
    assert [plain[i] for i in range(len(plain)) if got[i]] == []
    assert sum(got[i + len(plain)] == f"markov:4:{4 + len(w)},markov:{16 + len(w)}:{16 + 2 * len(w)}" for i, w in enumerate(fresh)) >= 195


def test_redact_keeps_all_columns_and_long_texts(spark):
    schema = DOCS + ", base_spans string, more_spans int, all_spans int, Lines string, n_chars long"
    rows = [(1, "a password: hunter2hunter2\n\nend", "b", 1, 2, "c", 30), (2, None, None, None, None, None, None), (2, "", "", 0, 0, "", 0), (3, "x y\n" * 40_000 + "secret=abcdefgh\n" * 600, "k", 1, 1, "l", 7), (None, "clean é", "k", 1, 1, "l", 7)]
    docs = spark.createDataFrame(rows, schema)
    ratios = secrets.train(docs)
    out = secrets.redact(docs, ratios)
    got = {(r["doc_id"], r["text"] is None): r for r in out.collect()}
    assert out.columns == docs.columns and len(got) == 5
    assert got[1, False]["text"] == "a [SECRET]\n\nend" and got[1, False]["n_chars"] == 15 and got[1, False]["base_spans"] == "b"
    assert got[2, True]["n_chars"] is None and got[2, False]["text"] == "" and got[None, False]["n_chars"] == 7
    assert got[3, False]["text"] == "x y\n" * 40_000 + "[SECRET]\n" * 600
    spans = {r["doc_id"]: r for r in secrets.scan(docs, ratios).collect() if r["doc_id"] == 3}[3]
    assert spans["n_assign"] == 600 and spans["spans"].startswith("assign:160000:160015,assign:160016:160031")


# Decontamination


def test_decontamination_of_one_character_and_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "HITS", 5000)
    monkeypatch.setattr(decontaminate, "PIECE", 1000)
    rng = random.Random(7)
    item = said(rng, [w + str(i) for i, w in enumerate(EN)], 30)
    items = spark.createDataFrame([(1, item), (2, "-" * 300), (3, item), (4, "tiny")], "item_id long, text string")
    long = said(rng, DE, 900)
    texts = ["-" * 3000, long[:950] + item + long[950:], long, long[:2990] + item, "-" * 30]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], DOCS + ", item_id long")
    got = decontaminate.leaks(docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(0, 2), (1, 1), (1, 3), (3, 1), (3, 3)]
    for r in got:
        if r["doc_id"]:
            assert texts[r["doc_id"]].encode()[r["start"] : r["end"]].decode() == item
    assert decontaminate.leaks(docs.limit(0), items).count() == 0 and decontaminate.without_leaks(docs.limit(0), items).count() == 0


def test_banded_alignment_finds_what_edit_distance_finds(spark):
    """Windows of an item with random edits at random places of a text, against Sellers' recurrence over all places."""
    rng = random.Random(8)
    item = "".join(rng.choice("abcdefghij ") for _ in range(decontaminate.WINDOW)).strip().ljust(decontaminate.WINDOW, "q")
    windows = decontaminate.Windows([(1, item)])
    for edits in range(9):
        part = list(item)
        for _ in range(edits):
            i = rng.randrange(len(part))
            part[i : i + 1] = rng.choice([[], ["#"], [part[i], "#"]])
        text = "".join(rng.choice("klmnop ") for _ in range(rng.randint(0, 90))) + "".join(part) + "".join(rng.choice("klmnop ") for _ in range(50))
        found = {x[5]: x[2] for x in windows.find([text.encode()])}
        for w, pattern in enumerate(windows.text):
            row = [0] * (len(text) + 1)
            for i, c in enumerate(pattern.decode()):
                new = [i + 1]
                for j, d in enumerate(text):
                    new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
                row = new
            assert (min(row) <= windows.edits[w]) == (w in found)
            assert w not in found or found[w] >= min(row)


# Sketches


def test_registers_of_a_union_are_the_maxima():
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 1 << 63, 400, dtype=np.uint64), rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    merged = np.maximum(near_dup.registers(a), near_dup.registers(b))
    assert (near_dup.registers(np.unique(np.concatenate([a, b]))) == merged).all()


def test_near_duplicates_of_odd_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert near_dup.near_duplicates(empty).count() == 0
    text = said(random.Random(1), EN, 50)
    rows = [(None, text, "f", 1), (3, text, "f", 1), (3, text, "f", 1), (9, text, "f", 1), (4, None, "f", 1), (5, " \n", "f", 1)]
    got = sorted(((r["doc_id"] or 0), r["component_id"], r["kept"]) for r in near_dup.near_duplicates(spark.createDataFrame(rows, DOCS + ", fp string, n_shingles int")).collect() if r["doc_id"])
    assert got == [(3, 3, True), (3, 3, True), (4, 4, True), (5, 5, True), (9, 3, False)]


# Tool calls and files


def test_tool_calls_of_odd_tables(spark):
    conv = spark.createDataFrame([(1, 0, "system", 'say "é"\n\u0001'), (1, 1, "user", None), (1, 2, "assistant", "t" * 70), (1, 3, "user", "ok"), (2, None, "assistant", "x"), (None, 5, None, "y")], "conv_id long, turn int, role string, text string")
    calls, results, messages = tool_calls.derived_calls(conv)
    got = tool_calls.link(calls, results, tool_calls.SCHEMAS, messages).collect()
    assert len(got) == 5 and sum(r["status"] == "message" for r in got) == 2
    assert {r["message"] for r in got if r["status"] == "message" and r["conv_id"]} == {'{"content":"say \\"é\\"\\n\\u0001","id":"1-0","role":"system"}'}
    assert [r["message"] for r in got if r["call_id"] == "1-2"] == ['{"arguments":{"size":70,"text":"' + "t" * 70 + '"},"depends_on":["1-0"],"id":"1-2","name":"measure","result":{"size":2,"text":"ok"}}']
    calls, results, messages = tool_calls.derived_calls(conv.limit(0))
    assert tool_calls.link(calls, results, tool_calls.SCHEMAS, messages).count() == 0


def test_token_files_of_an_empty_table_and_of_repeated_rows(spark, tmp_path):
    empty = token_files.write_token_files(spark.createDataFrame([], DOCS), f"file://{tmp_path}/e", tokenizer())
    assert empty == [] and token_files.read_token_files(spark, f"file://{tmp_path}/e", empty).count() == 0
    rows = [(None, "a", 1), (5, "b c", 1), (5, "b c", 1), (None, None, 2), (-3, "", 3)]
    parts = token_files.write_token_files(spark.createDataFrame(rows, DOCS + ", start long"), f"file://{tmp_path}/r", tokenizer())
    got = token_files.read_token_files(spark, f"file://{tmp_path}/r", parts).collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [None, None, -3, 5, 5]


def test_suffix_sort_of_a_hot_passage(spark):
    """A passage in half of all documents, with other letters around it each time."""
    rng = random.Random(10)
    hot = "".join(rng.choice("abc") for _ in range(120))
    rows = [(d, f"{d:04d}" + (hot if d % 2 else "") + "".join(rng.choice("xyz") for _ in range(60))) for d in range(200)]
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.repeated_spans(spark.createDataFrame(rows, DOCS), 8).collect()}
    assert all(got[d] == (120 if d % 2 and d > 1 else 0) or got[d] > 120 for d in got)
