"""The pipeline and its stages on small and odd tables."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

EN = "the of and to in is that for it was with as his on be at by this had not are but from or have an they which one you river stone".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, more_spans string, fp string, doc_words int"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(1)
    said = lambda n: " ".join(rng.choice(EN) + str(rng.randint(0, 50)) for _ in range(n))
    good = [said(120) for _ in range(60)]
    item = said(30)
    texts = good + [good[0], good[1].upper(), good[2] + " tail", None, "", "# $ " * 60, said(60) + " " + item + " " + said(60), said(80) + "\npassword: hunter2hunter2 " + said(40), said(30_000)]
    rows = [(i, t, "en", "s", len(t) if t else None, "x", "y", 1) for i, t in enumerate(texts)]
    out = tmp_path_factory.mktemp("tables")
    save = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{out}/{name}.parquet")
    save("documents", rows, SCHEMA), save("benchmark", [(1, item)], "item_id long, text string")
    save("labels", [(i, int(i < 60), 0) for i in (*range(60), 63, 64, 65)], "doc_id long, quality int, toxic int")
    return str(out), texts, good


def test_whole_pipeline(spark, tables):
    sf, texts, good = tables
    rows = corpus_pipeline.run(spark, sf).collect()
    kept = {r["doc_id"] for r in rows}
    gone = {60, 61, 62, 63, 64, 65, 66}
    assert kept == set(range(len(texts))) - gone
    from tallyforge.llm.queries import tokenizer
    from tallyforge.llm.tokens import WordEncoder

    masked = texts[67].replace("password: hunter2hunter2", "[SECRET]")
    n = len(WordEncoder(tokenizer())._raw([masked])[0]) // 4 + 1
    assert {r["doc_tokens"] for r in rows if r["doc_id"] == 67} == {n}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns_and_survive_empty_tables(spark, tables, name):
    sf, _, _ = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs.limit(0), sf)
    assert out.count() == 0
    if name != "packing":
        got = stage(spark, docs.union(docs.where("doc_id < 3")).union(docs.where("doc_id = 5").selectExpr("cast(null as long)", *docs.columns[1:])), sf)
        assert got.columns == docs.columns
        assert got.where("doc_id is null").count() == 1
