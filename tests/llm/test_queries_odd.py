"""Every query of this subpackage over whole tables with odd rows and clashing columns, and over empty ones."""

import pytest

from spanveil.llm import registry
from tests.llm import helpers

TEXTS = [
    "the quick brown fox and the lazy dog " * 4, "der schnelle braune Fuchs und der faule Hund " * 4, "le renard brun et rapide avec le chien " * 4, "you are a stupid idiot and i hate you " * 3, None, "", " \t\n", "x",
    "a b " * 3000, "Licensed under the Apache License, Version 2.0\nand more words", "¡Ñandú! “ſtrange” ​﻿ text 123",
]
QUERIES = registry.queries()
PER_DOCUMENT = {"op1_language_id", "op2_mix_sources", "op3_toxicity", "op5_ngram_join", "op7_license_scan", "op8_token_counts", "op9_exact_dedup", "op11_minhash_join", "op13_periodic_runs"}


def tables(spark, folder, empty):
    texts = TEXTS * 8
    docs = [(i, t, (None, "en", "de", "fr")[i % 4], None if i % 5 == 0 else f"s{i % 3}", None, 7, f"k{i}") for i, t in enumerate(texts)]
    docs += [(3, "another text of an id that is there already", "en", "s1", 1, 7, "k"), (3, TEXTS[3], "en", "s1", 1, 7, "k")]
    # columns named like those that operators make
    documents = spark.createDataFrame(docs, helpers.DOCS + ", score long, id string")
    labels = spark.createDataFrame([(i, i % 2, int(TEXTS[i % len(TEXTS)] == TEXTS[3])) for i in range(0, len(texts), 2)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    vectors = [(i, [float((i * k) % 7 - 3) for k in range(8)], "x") for i in range(120)] + [(121, None, "x"), (122, [None] * 8, "x"), (150, [float("nan")] * 8, "x"), (None, [1.0] * 8, "x")]
    embeddings = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, score string")
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.example.org/p{i}", ("<p>a</p>" * (i % 4)) or None, "x") for i in range(30)], "page_id long, url string, html string, record_type string")
    for name, table in {"documents": documents, "labels": labels, "embeddings": embeddings, "pages": pages}.items():
        helpers.saved((table.limit(0) if empty else table).coalesce(2), folder, name)
    return str(folder), len(docs)


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("odd"), False)


@pytest.fixture(scope="module")
def empty_tables(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("empty"), True)[0]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows(spark, odd_tables, name):
    folder, n = odd_tables
    rows = QUERIES[name](spark, folder).collect()
    assert len(rows) == n if name in PER_DOCUMENT else rows
    if name == "op4_pack_documents":
        assert all(r.length <= 2048 for r in rows) and len({(r.doc_id, r.piece) for r in rows}) >= n - 2
    if name == "op10_warc":
        assert len(rows) == 30 and {r.record_type for r in rows} == {"response", "revisit"}
    if name == "op6_top_k":
        assert {r.query_id for r in rows} == {0, 50, 100} and {r["rank"] for r in rows} == {1, 2, 3, 4, 5}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_tables, name):
    assert QUERIES[name](spark, empty_tables).count() == 0
