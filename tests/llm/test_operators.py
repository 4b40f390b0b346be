"""Small tests of the other operators against brute force, round trips and planted cases."""

import re
import unicodedata
import zlib
from hashlib import sha256

import numpy as np
import pytest

from tallyforge.llm import decontaminate, near_dup, packing, quality_rules, secrets, token_files, tool_calls
from tallyforge.llm.queries import tokenizer

DOCS = "doc_id long, text string, grp string, n long"
WORDS = "river stone market window garden letter silver candle morning harbour button ladder orange winter copper".split()


def prose(seed, n=120):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(rng.integers(100)) for i in rng.integers(0, len(WORDS), n))


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "g", 1) for i, t in enumerate(texts)], DOCS)


ODD = [None, "", " \t\n", "one", "é" * 5000, prose(1, 5000)]


def test_token_files_read_back(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = [*ODD, "Same text.", "Same text."]
    tok, at = Tokenizer.from_file(tokenizer()), 0
    parts = token_files.write_token_files(frame(spark, texts).repartition(3), f"file://{tmp_path}/t", tokenizer())
    for r in sorted(token_files.read_token_files(spark, f"file://{tmp_path}/t", parts).collect()):
        ids = [*tok.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_packing_fills_sequences_without_gaps(spark):
    rows = packing.pack(frame(spark, [*ODD, *(prose(s, 40 * s) for s in range(1, 30))]), tokenizer(), sequence=256).collect()
    bins, docs = {}, {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        docs.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    for pieces in [*bins.values(), *([p[:2] for p in v] for v in docs.values())]:
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
    assert all(sum(x for _, x in p) <= 256 for p in bins.values())
    assert all(sum(p[1] for p in v) == v[0][2] for v in docs.values()) and len(docs) == 35


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    base = [prose(s) for s in range(6)]
    texts = [*ODD, *base, base[0], base[0].upper(), base[1] + " more words here", " ".join(base[2].split()[:-8]), base[3] + " " + base[4], *(base[5] + f" tail{i}" for i in range(40))]

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    got = near_dup.near_duplicates(frame(spark, texts), width).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(s), root[i], root[i] == i) for i, s in enumerate(sets)}


def test_two_points_of_the_likelihood_decide_as_its_maximum():
    rng = np.random.default_rng(3)
    u, v, nu, nv = [], [], [], []
    for similarity in rng.uniform(0.4, 0.9, 300):
        size = int(rng.integers(50, 500))
        ids = rng.integers(0, 1 << 63, 3 * size, dtype=np.uint64)
        common = int(size * 2 * similarity / (1 + similarity))
        a, b = ids[:size], ids[size - common : 2 * size - common - int(rng.integers(0, size // 10))]
        for out, x in ((u, near_dup.registers(a)), (v, near_dup.registers(b)), (nu, float(len(a))), (nv, float(len(b)))):
            out.append(x)
    u, v, nu, nv = map(np.array, (u, v, nu, nv))
    want = near_dup.joint_estimate(u, v, nu, nv) >= near_dup.LEAST_ESTIMATE - 1e-9
    assert 20 < want.sum() < 280 and (near_dup.likely_similar(u, v, nu, nv) == want).all()


def test_links_in_large_buckets_equal_brute_force(spark, monkeypatch):
    """Chains of near copies whose ends differ: centres do not link all, so blocks must."""
    monkeypatch.setattr(near_dup, "SMALL_BUCKET", 2)
    monkeypatch.setattr(near_dup, "BLOCK", 5)
    words = prose(70, 200).split()
    texts = [" ".join(words[4 * k : 4 * k + 80] + [f"end{k}"]) for k in range(30)] + [" ".join(words[:60] + prose(80 + k, 9).split() + words[60:120]) for k in range(12)]
    texts = [texts[i] for i in np.random.default_rng(5).permutation(len(texts))]
    sets = [{tuple(w[i : i + 2]) for i in range(len(w) - 1)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= 80 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    assert 1 < len(set(root)) < len(root)
    got = near_dup.near_duplicates(frame(spark, texts), 2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(root))


def test_decontamination_finds_planted_passages(spark):
    items = spark.createDataFrame([(1, prose(50, 40)), (2, None), (3, "")], "item_id long, text string")
    planted = prose(50, 40)
    texts = [*ODD, prose(60), prose(61) + " " + planted + " " + prose(62), planted.upper().replace(" ", "\n"), planted[:60] + "x" + planted[62:]]
    docs = frame(spark, texts)
    assert sorted({r["doc_id"] for r in decontaminate.leaks(docs, items).collect()}) == [7, 8, 9]
    assert sorted(r["doc_id"] for r in decontaminate.without_leaks(docs, items).collect()) == list(range(7))
    assert decontaminate.without_leaks(docs, items.limit(0)).count() == 10


def test_decontamination_folds_case_of_all_letters(spark):
    """An accented item in capitals, letter by letter in NFD and with ß as SS; positions are those of the text."""
    item = "l'été où la forêt brûlée reçut à noël une âme très âgée, señor, ñandú, größe, straße, αγάπη ἀρχή, дом"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    upper, before = item.upper(), "ÀİK ŉ " * 3
    texts = [before + t + "\nÉÉ" for t in (item, upper, unicodedata.normalize("NFD", upper))] + ["É" * 300, upper[: len(upper) // 4]]
    got = {r["doc_id"]: r for r in decontaminate.leaks(frame(spark, texts), items).collect()}
    assert sorted(got) == [0, 1, 2] and {r["edits"] for r in got.values()} == {0}
    for d, t in enumerate(texts[:3]):
        assert t.encode()[got[d]["start"] : got[d]["end"]].decode() == t[len(before) : -3]
    assert [r["doc_id"] for r in decontaminate.without_leaks(frame(spark, texts), items).collect()] == [3, 4]


def test_decontamination_finds_quoted_parts_at_every_offset(spark):
    """Parts of PASSAGE bytes of a long item, at each offset, as they are and with a letter changed in each window's
    reach; items just over a short window; words of six letters replaced so often that long windows exceed their edits."""
    item, short = prose(51, 40), prose(52, 7)[: decontaminate.PASSAGE + 3]
    n = decontaminate.PASSAGE
    parts = [x[o : o + n] for x in (item, short) for o in range(len(x) - n + 1)]
    swapped = item
    for o in range(20, len(item), n + 6):
        swapped = swapped[:o] + "qqqqqq" + swapped[o + 6 :]
    texts = [prose(100) + p + prose(101) for p in (*parts, *(p[:25] + "#" + p[26:] for p in parts), swapped)]
    items = spark.createDataFrame([(1, item), (2, short)], "item_id long, text string")
    docs = frame(spark, [*texts, prose(102), item[:30]])
    rows = decontaminate.leaks(docs, items).collect()
    assert sorted({r["doc_id"] for r in rows}) == list(range(len(texts)))
    assert all(r["item_id"] == (1 if i < len(item) - n + 1 else 2) for r in rows if (i := r["doc_id"]) < len(parts))
    assert sorted(r["doc_id"] for r in decontaminate.without_leaks(docs, items).collect()) == [len(texts), len(texts) + 1]


def test_positions_of_folded_texts_lead_back():
    rng, letters = np.random.default_rng(9), "aEéÉ\u0301\u0308\u0327ßİΣςΐ\u0345\u1100\u1161\u11a8가\u0f73\u09c7\u09be\u212a中 \n"
    for _ in range(300):
        text = "".join(letters[i] for i in rng.integers(0, len(letters), 12))
        places = decontaminate.Places(text)
        if places.raw:
            assert (places.raw[-1], places.folded[-1]) == (len(text.encode()), len(decontaminate.fold(text)))
            whole = [decontaminate.fold(text.encode()[a:b].decode()) for a, b in zip(places.raw, places.raw[1:])]
            assert b"".join(whole) == decontaminate.fold(text)


def test_secrets_equal_the_fixed_rules(spark):
    hexes = "0123456789abcdef" * 3
    texts = [*ODD, 'Password = "hunter2hunter2" tail', "AKIA" + "A1" * 8, "AKIA12", f"é {hexes}g", "token: short", f"API_KEY={hexes} api-key=x"]

    def base(t):
        kinds = (r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"AKIA[A-Z0-9]+()", r"[0-9a-f]+()")
        found = [(m.start(), k, m.end()) for k, p in enumerate(kinds) for m in re.finditer(p, t or "", re.A) if (len(m[1]) >= 8, len(m[0]) >= 16, len(m[0]) >= 32)[k]]
        return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))

    docs = frame(spark, texts)
    ratios = secrets.train(docs)
    for r in secrets.scan(docs, ratios).collect():
        want = base(texts[r["doc_id"]])
        assert r["base_sha256"] == sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs, ratios).collect()}
    assert clean[0] is None and clean[3] == "one" and "hunter2" not in clean[6] and hexes not in clean[9]
    assert secrets.scan(docs.limit(0), secrets.train(docs.limit(0))).count() == 0


def test_quality_base_counts(spark):
    texts = [*ODD, "a b c a b c\na b c a b c", "# x\n# x\n\n"]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(0, 0, 0), (5, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    for r in quality_rules.judge(docs, quality_rules.train(docs, labels)).collect():
        t = texts[r["doc_id"]] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(w) < 1000 else None
        lines = [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)))
        if covered is not None:
            assert r["n_repeat_words"] == len(covered)
            assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_tool_calls_link_and_order(spark):
    calls = spark.createDataFrame([(1, "a", "measure", '{"size": 70}', []), (1, "b", "measure", '{"size": 7}', ["a"]), (1, "c", "none", "{", ["b", "d"]), (1, "d", "quote", "{}", ["c"]), (1, None, None, None, None)], "conv_id long, call_id string, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([("a", '{"z":1,"b":2}'), ("q", None), (None, "1")], "call_id string, content string")
    got = {r["call_id"]: r for r in tool_calls.link(calls, results, tool_calls.SCHEMAS).collect() if r["call_id"]}
    assert [got[k]["level"] for k in "abcd"] == [0, 1, None, None]
    assert [got[k]["status"] for k in "abq"] == ["linked", "no_result", "orphan_result"]
    assert got["a"]["valid"] and got["b"]["errors"] == "$.size: below minimum"
    assert got["a"]["message"] == '{"arguments":{"size":70},"depends_on":[],"id":"a","name":"measure","result":{"b":2,"z":1}}'


def test_levels_of_long_chains_and_random_graphs(spark, monkeypatch):
    """A chain of thousands needs few rounds; chains, diamonds, cycles and random graphs equal brute force."""
    rng, rounds = np.random.default_rng(4), []
    monkeypatch.setattr(tool_calls, "stored", lambda df, name, f=tool_calls.stored: (rounds.append(name), f(df, name))[1])
    deps = {f"c{i}": {f"c{i - 1}"} for i in range(3000)} | {f"o{i}": {f"o{(i + 1) % 7}"} for i in range(7)} | {"p": {"o3", "c5"}, "q": {"p"}}
    for i in range(90):
        deps |= {f"a{i}": {f"d{i - 1}"}, f"b{i}": {f"a{i}"}, f"d{i}": {f"a{i}", f"b{i}", "c7"}}
    rows = [(1, k, "none", "{}", sorted(v)) for k, v in deps.items()]
    tangled = {f"r{i}": {f"r{j}" for j in rng.integers(0, i + (i % 20 == 0), 3)} for i in range(1, 60)}
    level = {}

    def find(k, graph, path=()):
        if k not in level:
            found = [-1] + [None if d in path + (k,) else find(d, graph, path + (k,)) for d in graph[k] if d in graph]
            level[k] = None if None in found else max(found) + 1
        return level[k]

    schema = "conv_id long, call_id string, name string, arguments string, depends_on array<string>"
    for i in range(3000):
        level[f"c{i}"] = i
    for k in deps:
        find(k, deps)
    got = tool_calls.levels(spark.createDataFrame(rows, schema)).collect()
    assert {r["call_id"]: r["level"] for r in got} == level and len(got) == len(deps)
    assert level["q"] is level["o1"] is None and level["d89"] > 180 and len(rounds) < 25
    level.clear()
    for k in tangled:
        find(k, tangled)
    got = tool_calls.levels(spark.createDataFrame([(1, k, "none", "{}", sorted(v)) for k, v in tangled.items()], schema)).collect()
    assert {r["call_id"]: r["level"] for r in got} == level
