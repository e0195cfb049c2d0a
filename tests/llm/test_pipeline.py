"""The pipeline's stages, each on what the one before it kept."""

import corpus_pipeline
from tests.llm import helpers


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        if name != "pack":
            assert docs.columns == columns
        if name == "exact_dedup":
            texts = {}
            for r in before.collect():
                texts[r.text] = max(texts.get(r.text, -1), r.doc_id)
            assert sorted(r.doc_id for r in docs.collect()) == sorted(texts.values())
        if name == "ngram_join":
            found = helpers.linked([(r.doc_id, r.text) for r in before.collect()], 5, 80, 100)
            assert sorted(r.doc_id for r in docs.collect()) == sorted(i for i, (_, c) in found.items() if c == i or not found[i][0])
    mixed = {r.doc_id: r["count"] for r in kept["mix_sources"].groupBy("doc_id").count().collect()}
    whole = kept["pack"].where("piece = 0").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in whole} == mixed and max(mixed.values()) <= 3


def test_no_documents(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0


def test_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows and clashing columns pass every stage; clean documents stay."""
    clean = [f"the {w} of the house walked slowly over the {w} bridge at number {k} " + " ".join(f"word{k}x{j}" for j in range(30)) for k, w in enumerate(["cat", "dog", "cow", "owl", "fox", "hen"] * 5)]
    toxic = [f"you are a stupid idiot number {k} " * 4 for k in range(12)]
    texts = clean + toxic + [None, "", " \t", "long " + "words go on " * 4000, clean[0], clean[1] + " over number 9"]
    rows = [(k, t, None if k % 4 == 0 else "en", None if k % 3 == 0 else f"s{k % 2}", None, "x") for k, t in enumerate(texts)]
    rows += [(None, "a row without an id but with words of its own", None, None, None, None), rows[2], rows[2]]
    docs = spark.createDataFrame(rows, helpers.DOCS + ", score string")
    helpers.saved(spark.createDataFrame([(k, 1, int(len(clean) <= k < len(clean) + len(toxic))) for k in range(len(texts))] + [(None, None, None)], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = kept[name] = spark.read.parquet(str(tmp_path / name))
        assert name == "pack" or docs.columns == columns
    ids = {name: [r.doc_id for r in kept[name].collect()] for name in kept}
    assert set(range(len(clean))) <= set(ids["toxicity"]) and len(ids["toxicity"]) >= len(rows) - len(toxic)
    assert len(ids["exact_dedup"]) == len({t or "" for t in (r.text for r in kept["toxicity"].collect())})
    near = helpers.linked([(r.doc_id, r.text) for r in kept["exact_dedup"].collect() if r.doc_id is not None], 5, 80, 100)
    assert sorted(i for i in ids["ngram_join"] if i is not None) == sorted(i for i, (n, c) in near.items() if c == i or not n) and None in ids["ngram_join"]
    assert {r.doc_id for r in kept["pack"].collect()} == set(ids["mix_sources"]) and max(map(ids["mix_sources"].count, set(ids["mix_sources"]))) <= 3
