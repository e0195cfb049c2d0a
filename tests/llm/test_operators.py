"""Each operator against a plain version, and on the cases that it defines."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from spanveil.llm import queries_exact_dedup, queries_license_scan, queries_topk, registry
from spanveil.llm.exact_dedup import compact, exact_dedup, flush, keep_one
from spanveil.llm.language_id import learn_languages, predict_languages
from spanveil.llm.license_scan import scan_licences
from spanveil.llm.mixing import mix_sources, mixed_documents
from spanveil.llm.ngram_join import keep_representatives, ngram_components
from spanveil.llm.packing import TextEncoder, pack, pack_documents, place
from spanveil.llm.token_counts import CountingTransducer, count_tokens
from spanveil.llm.topk_search import top_k
from spanveil.llm.toxicity import Lexicon, fold, learn_lexicon, reject_toxic, score_toxicity
from spanveil.llm.warc import find_captures, new_archive, plan_records, read_records, write_archives, write_index
from tests.llm import helpers
from tests.llm.helpers import docs

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\t", "word", "a" * 5000, "x " * 3000, "x " * 3000, "é漢😀 <|endoftext|> ▁ 1 22", None]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and a column whose name clashes with those inside."""
    rows = docs(spark, ODD).unionByName(docs(spark, ["again", "again"]).withColumn("doc_id", F.lit(50).cast("long"))).unionByName(docs(spark, ["no id"]).withColumn("doc_id", F.lit(None).cast("long")))
    return rows.withColumns({"digest": F.lit(1), "_id": F.lit("x"), "size": F.lit(2), "key": F.lit(3), "score": F.lit(0.5), "length": F.lit(9), "id": F.lit(4), "n": F.lit(5)})


def duck_rows(sql, **tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con.execute(sql).df()


def same(ours, theirs):
    rows = lambda f: sorted(map(str, f[sorted(f.columns)].astype(object).where(f[sorted(f.columns)].notna(), None).values.tolist()))
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name,sql,table", [("op9_exact_dedup", queries_exact_dedup.SQL, "documents"), ("op6_top_k", queries_topk.SQL, "embeddings"), ("op7_license_scan", queries_license_scan.SQL, "documents")])
def test_same_rows_as_sql(spark, sf, name, sql, table):
    same(registry.queries()[name](spark, sf).toPandas(), duck_rows(sql, **{table: f"{sf}/{table}.parquet"}))


# exact dedup


def test_dedup_odd_rows(odd):
    out = [r.asDict() for r in exact_dedup(odd, keep="max").collect()]
    assert len(out) == odd.count()
    empty = [r for r in out if r["digest"] == hashlib.sha256(b"").hexdigest()]
    assert {r["keep_id"] for r in empty} == {9} and {r["group_size"] for r in empty} == {3}
    kept = keep_one(odd, keep="max")
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted((i is None, i or 0) for i in (9, 2, 3, 4, 5, 7, 8, 50, None))


def test_dedup_runs_merge(spark, tmp_path):
    keys = spark.range(1000, numPartitions=9).selectExpr("id AS _id", "cast(id % 70 AS string) AS digest")
    runs = flush(keys, str(tmp_path), 6, "min")
    assert runs.select("run").distinct().count() == 6
    merged = {r.digest: (r.keep_id, r.n) for r in compact(runs, str(tmp_path), 6, "min").collect()}
    assert merged == {str(k): (k, len(range(k, 1000, 70))) for k in range(70)}
    assert [p.name for p in tmp_path.iterdir()] == ["level-2"]


@pytest.mark.parametrize("digest", [lambda c: F.sha2(c, 256), lambda c: F.substring(c, 1, 1)])
def test_dedup_against_brute_force(spark, monkeypatch, digest):
    """Also with a digest that different texts share, and with hot groups."""
    monkeypatch.setattr("spanveil.llm.repeats.HOT_ROWS", 20)
    rng = random.Random(4)
    texts = [f"{rng.choice('abcde')}{rng.randint(0, 30)}" for _ in range(150)] + ["same"] * 60 + [None, "", "b"]
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t or "", []).append(i)
    out = exact_dedup(docs(spark, texts).repartition(5), keep="max", digest=digest).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in out} == {i: (g[-1], len(g), i == g[-1]) for g in groups.values() for i in g}


# mixing


def test_mixing_targets_and_budgets(spark):
    rng = random.Random(3)
    names = ["a", "b", "c", "d", None]
    table = docs(spark, ["w " * rng.randint(0, 60) for _ in range(400)], source=lambda i: names[i % 5 if i > 200 else 0])
    out = mix_sources(table).toPandas()
    sizes = out.groupby("source", dropna=False)["size"].sum()
    weights = dict(zip(["a", "b", "c", "d", None], [1, 2, 3, 1, 2]))
    live, target, rest = set(weights), {}, float(sizes.sum())
    key = lambda s: None if s is None or s != s else s
    size_of = {key(k): v for k, v in sizes.items()}
    while True:  # reshare what is above three times a source
        level = rest / sum(weights[s] for s in live)
        over = {s for s in live if level * weights[s] > 3 * size_of[s]}
        if not over:
            break
        for s in over:
            target[s] = 3 * size_of[s]
            rest -= target[s]
        live -= over
    target |= {s: level * weights[s] for s in live}
    for s, group in out.groupby("source", dropna=False):
        assert group.target.iloc[0] == pytest.approx(target[key(s)]) and abs(group.taken.sum() - target[key(s)]) <= 1
    assert (out.taken <= 3 * out["size"]).all()
    again = mix_sources(table.repartition(7)).toPandas()
    assert sorted(map(tuple, out[["doc_id", "taken"]].values)) == sorted(map(tuple, again[["doc_id", "taken"]].values))


def test_mixing_hot_rows(spark, monkeypatch):
    """Rows without an id have places of their own, equal rows follow one another, and no bucket is crowded."""
    from spanveil.llm import mixing

    monkeypatch.setattr(mixing, "PART_ROWS", 50)
    rows = [(None, "w " * (1 + k % 7) + str(k), "a") for k in range(600)] + [(7, "same words here", "a")] * 300 + [(k, "123 456 !!", "b") for k in range(400)] + [(None, None, None), (None, "", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out, again = (mixing.mix_sources(t).toPandas() for t in (table, table.repartition(3)))
    assert len(out) == len(rows)
    mark = lambda f: sorted(map(tuple, f[["doc_id", "source", "size", "tag", "taken"]].fillna(-1).astype(str).values))
    assert mark(out) == mark(again)
    for source, own in out.groupby("source"):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= 1 and (own.taken <= 3 * own["size"]).all(), source
        part = own[(own.taken > own.epochs * own["size"]) & (own.taken < (own.epochs + 1) * own["size"])]
        assert len(part) <= 1
    assert out[out.doc_id.isna()].key.nunique() == 602
    bucket = (1 - (-mixing.LEAST_WEIGHT * out[out.source == "b"].key).map(__import__("math").exp)) * 26 // 1
    assert bucket.value_counts().max() <= 4 * 400 / 26
    kept = mixing.mixed_documents(table).groupBy("source").count().collect()
    assert {r.source for r in kept} == {"a", "b"}


def test_mixing_odd_rows(odd):
    out = mix_sources(odd)
    assert out.count() == odd.count() and out.where("size = 0 and taken > 0").count() == 0
    assert mixed_documents(odd).columns == odd.columns
    assert mix_sources(odd.limit(0)).count() == 0


# toxicity


def test_fold():
    assert fold("1d10t! ІDІОТ sc​um$$ 1234 p@thetic") == " idiot idiot scum pathetic "
    assert fold("") == "  "


def test_toxicity_learns_and_spares(spark):
    rng = random.Random(1)
    clean = lambda: " ".join(rng.choice(["the", "house", "river", "stone", "tree"]) + rng.choice("abcdefgh") for _ in range(40))
    texts = [clean() + (" you vile grumbork " + clean() if i % 4 == 0 else "") for i in range(400)]
    table = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 400)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    lexicon = learn_lexicon(table, labels, F.col("doc_id") % 2 == 0)
    scored = {r.doc_id: r.score for r in score_toxicity(table, lexicon).collect()}
    assert all((scored[i] >= 0.3) == (i % 4 == 0) for i in scored)
    assert sorted(r.doc_id for r in reject_toxic(table, lexicon).collect()) == [i for i in range(400) if i % 4]
    assert lexicon.score(fold("vіle GRUMB0RK")) >= 0.3


def test_toxicity_exceptions_and_odd_rows(spark, odd):
    lexicon = Lexicon(((" scum ", 5.0),), (" pond scum ",), 3.0, -4.0)
    assert lexicon.hits(" pond scum ") == {} and lexicon.hits(" you scum ") != {}
    out = score_toxicity(odd.drop("score"), lexicon)
    assert out.count() == odd.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    assert reject_toxic(odd, lexicon).columns == odd.columns
    none = learn_lexicon(odd, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert none.score(fold("anything")) < 0.3


# packing


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    rng = random.Random(2)
    texts = ["".join(rng.choices("ab c  \n\t.'s1é\x1c漢", k=rng.randint(0, 40))) for _ in range(2000)] + [x or "" for x in ODD]
    tokenizer = Tokenizer.from_file(BPE)
    texts += ["".join(f"a{chr(c)}b {chr(c)}\n" for c in range(k, k + 997) if not 0xD800 <= c < 0xE000) for k in range(0, 0x10F000, 997)]
    texts += [" " * 300_000 + "x", "a" * 100_000, "<|endoftext|>  <|endoftext|> a"]
    encoder = TextEncoder(BPE)
    assert encoder.fast is not None and TextEncoder(public_tokenizers.path("word_bpe_49k.json")).fast is None
    assert list(map(encoder.encode, texts)) == [np.array(x.ids, "<u4").tobytes() for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_packing(spark, sf, odd, monkeypatch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    monkeypatch.setattr("spanveil.llm.packing.PART_PIECES", 60)
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    out = pack_documents(table.unionByName(odd.where("doc_id < 10").select((F.col("doc_id") + 10**6).alias("doc_id"), "text")), BPE).toPandas()
    texts = {r.doc_id: r.text for r in table.collect()} | {10**6 + i: t for i, t in enumerate(ODD)}
    for i, group in out.sort_values("piece").groupby("doc_id"):
        ids = np.array(tokenizer.encode(texts[i] or "", add_special_tokens=False).ids + [0], "<u4")
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(group.start, group.length)] == group.ids_crc32.tolist()
        assert group.length.sum() == len(ids) and (group.length.iloc[1:] == 2048).all()
    assert set(out.doc_id) == set(texts)
    for _, group in out.sort_values("offset").groupby("sequence_id"):
        assert group.offset.tolist() == [0, *np.cumsum(group.length)[:-1]] and group.length.sum() <= 2048
    assert out.sequence_id.nunique() <= 1.05 * out.length.sum() / 2048 + 2


def test_place_minimises_squares():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 9, 60)
    sequence, offset, gaps = place(lengths, 10)
    count, at = {}, {}
    for s, b, o in zip(lengths.tolist(), sequence.tolist(), offset.tolist()):
        options = [(0, 10)] + [(1, g) for g in count if count[g] > 0 and g >= s]

        def after(g, s=s):
            c = dict(count)
            if g < 10:
                c[g] -= 1
            if g > s:
                c[g - s] = c.get(g - s, 0) + 1
            return sum(v * v for v in c.values())

        chosen = at.get(b, 10)
        assert o == 10 - chosen and after(chosen) == min(after(g) for _, g in options)
        if chosen < 10:
            count[chosen] -= 1
        at[b] = chosen - s
        if at[b]:
            count[at[b]] = count.get(at[b], 0) + 1
    assert gaps.tolist() == [at[b] for b in range(len(gaps))]


def test_pack_no_part_is_large(spark, monkeypatch):
    """Pieces of which no two fit, most of them without an id."""
    from spanveil.llm import packing

    f = packing.place

    def counted(lengths, capacity):
        assert len(lengths) <= 250
        return f(lengths, capacity)

    monkeypatch.setattr(packing, "PART_PIECES", 100)
    monkeypatch.setattr(packing, "place", counted)
    rng = random.Random(2)
    for some in (0, 5):
        rows = [(None if k % 3 else k, 0, rng.randint(1100, 1900)) for k in range(2000)] + [(k, 1, 30) for k in range(some)]
        out = pack(spark.createDataFrame(rows, "doc_id long, piece int, length long")).collect()
        assert sorted((r.doc_id or -1, r.length) for r in out) == sorted((i or -1, n) for i, _, n in rows)
        sums = Counter()
        for r in out:
            sums[r.sequence_id] += r.length
        assert max(sums.values()) <= 2048 and len(sums) <= 2000 + some


def test_pack_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, piece int, length long")).count() == 0


# n-gram join


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80), (2, 50)])
def test_ngram_join_against_all_pairs(spark, n, num):
    rng = random.Random(n)
    base = [[f"w{rng.randint(0, 30)}" for _ in range(rng.choice([1, 2, 4, 12, 40, 120]))] for _ in range(12)]
    texts = []
    for words in base:
        for _ in range(8):
            mine = list(words)
            for _ in range(rng.randint(0, max(1, len(mine) // 30))):
                mine[rng.randrange(len(mine))] = f"v{rng.randint(0, 5)}"
            texts.append(" ".join(mine).upper() if rng.random() < 0.2 else "\n".join(mine))
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, " \t")]
    found = ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), n, num, 100)
    assert {r.doc_id: (r.n_ngrams, r.component_id) for r in found.collect()} == helpers.linked(rows, n, num, 100)


@pytest.mark.parametrize("rows", [3, 10])
def test_ngram_join_large_postings(spark, monkeypatch, rows):
    """A passage in all documents; with tiny blocks every pair still meets."""
    from spanveil.llm import ngram_join

    monkeypatch.setattr(ngram_join, "POSTING_ROWS", rows)
    met = []
    monkeypatch.setattr(ngram_join, "_block_meetings", lambda *a, f=ngram_join._block_meetings: met.append(1) or f(*a))
    rng = random.Random(5)
    passage = [f"p{k}" for k in range(60)]
    own = [[f"w{rng.randint(0, 999)}" for _ in range(rng.choice([8, 10, 14, 20]))] for _ in range(20)]
    texts = [" ".join(passage[: 60 - rng.randint(0, 3)] + own[k % 20] + [f"x{k}"] * (k % 3)) for k in range(80)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for num in (80, 90):
        out = {r.doc_id: (r.n_ngrams, r.component_id) for r in ngram_components(table, 3, num, 100).collect()}
        assert out == helpers.linked(list(enumerate(texts)), 3, num, 100)
    assert met


def test_ngram_join_repeated_ids(spark):
    """Repeated rows count once, and an id with several texts is one vertex: against all pairs, some just below the threshold."""
    rng = random.Random(11)
    rows = []
    for k in range(0, 40, 2):
        words = [f"w{k}.{i}" for i in range(204)]
        rows += [(k, " ".join(words)), (k + 1, " ".join(words[:182] + [f"v{k}.{i}" for i in range(22 + rng.randint(-2, 2))]))]
    rows += [*rows, *rows[::3], (0, rows[5][1]), (9, rows[20][1]), (100, rows[0][1]), (100, rows[30][1]), (12, ""), (12, rows[3][1])]
    sets = [(i, helpers.ngrams(t, 5)) for i, t in rows]
    root = {i: i for i, _ in sets}
    for a, x in sets:
        for b, y in sets:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    out = ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5, 80, 100).collect()
    assert len(out) == len(rows) and {(r.doc_id, r.component_id) for r in out} == set(root.items())


def test_common_ngrams_that_lead_after_reordering(spark):
    """Half of each document is one passage, which no set is led by."""
    from spanveil.llm import ngram_join

    passage = " ".join(f"p{k}" for k in range(300))
    texts = [passage + " " + " ".join(f"w{i}.{k}" for k in range(300)) for i in range(100)]
    body = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(7)
    common = ngram_join.common_ngrams(body, 5, 80, 100)
    prefixes = ngram_join.ngram_sets(body, 5, common, 80, 100).select(F.explode("prefix").alias("h"))
    assert prefixes.groupBy("h").count().where(F.col("count") > 1).count() == 0


def test_ngram_join_odd_rows(odd):
    out = ngram_components(odd).collect()
    assert len(out) == odd.count() and all(r.component_id is None for r in out if r.doc_id is None)
    kept = keep_representatives(odd)
    assert kept.columns == odd.columns and kept.where("doc_id is null").count() == 1
    assert kept.where("doc_id in (6, 7)").count() == 1


# top-k


def test_top_k_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [0.5, -0.5]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [0.25]), (8, []), (None, [1.0, 1.0]), (50, [1.0, 1.0]), (100, [0.0, 0.0]), (1, [1.0, 1.0]), (9, [3e38, -3e38])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in top_k(table, F.col("vec_id") % 50 == 0, k=3).collect()]
    assert [x[2] for x in sorted(got) if x[0] == 50] == [1, 1, 2]
    assert [x[2:] for x in sorted(got) if x[0] == 100] == [(0, 0), (1, 0), (1, 0)]
    assert top_k(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_multiplies_less_than_all_pairs():
    import numpy as np

    from spanveil.llm.topk_search import SLICES, local_lists, sufficient_entries

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 64))
    x = centres[rng.integers(0, 40, 3000)] + 0.3 * rng.normal(size=(3000, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None]).astype(np.int64)
    q = x[:200]
    every = q @ x.T
    i, j, score, made = local_lists(q, x, 6)
    assert (every[i, j] == score).all() and made < 0.2 * SLICES * every.size
    cutoff = np.array([np.sort(score[i == k])[-5] for k in range(len(q))])
    i, j, score, made = sufficient_entries(q, x, cutoff, np.arange(len(q)) != 3)
    assert made < 0.6 * SLICES * every.size
    expected = every >= cutoff[:, None]
    expected[3] = True
    assert (np.argwhere(expected) == np.stack([i, j], 1)).all() and (every[i, j] == score).all()
    low = sufficient_entries(q, x, np.full(len(q), -(10**9)), np.ones(len(q), bool))
    assert len(low[0]) == every.size


def test_top_k_fewer_candidates(spark, tmp_path):
    for size in (2, 4, 6, 8):
        rows = [(50 * k if k < 2 else k, [float(k), -1.5 * k, 2.0, 0.5 * k, 1.0]) for k in range(size)]
        table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        helpers.saved(table.coalesce(1), tmp_path / str(size), "embeddings")
        got = top_k(table, F.col("vec_id") % 50 == 0, k=5).toPandas()
        same(got, duck_rows(queries_topk.SQL, embeddings=f"{tmp_path}/{size}/embeddings.parquet/*.parquet"))
        assert len(got) == 2 * min(5, size - 1)


# licences


def test_licence_inheritance(spark):
    rows = [(1, "a/LICENSE", "Released under the MIT License"), (2, "a/b/c/x.py", "code"), (3, "a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0"), (4, "a/y.py", "code"), (5, "z/q.py", "Licensed under CC BY-NC 4.0.\nmore code"), (6, "z/r.py", None), (7, None, ""), (8, "ab/x.py", "code"), (9, "COPYING", "All rights reserved")]
    out = {r.doc_id: (r.licence, r.origin, r.licence_dir) for r in scan_licences(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert out[2] == ("Apache-2.0", "inherited", "a/b") and out[4] == ("MIT", "inherited", "a") and out[5] == ("CC-BY-NC-4.0", "own", None)
    assert out[8] == ("Proprietary", "inherited", "") and out[6][0] == "Proprietary" and out[7] == (None, "none", None)
    assert scan_licences(spark.createDataFrame([], "doc_id long, path string, text string")).count() == 0


def test_licences_of_repeated_headers(spark, tmp_path):
    texts = ["Copyright 2020 the authors, MIT License applies"] * 9 + ["some words\nReleased under a MIT style License, copyright of the authors", None, "", "no such line", "Licensed under the Apache License, Version 2.0", "x\nThe license of this work is unknown"] + ["plain text"] * 20
    docs = helpers.docs(spark, texts, source=lambda i: None if i % 3 else "licence").withColumnRenamed("n_chars", "row")
    folder = helpers.saved(docs.repartition(1), tmp_path)
    same(queries_license_scan.op7_license_scan(spark, folder).toPandas(), duck_rows(queries_license_scan.SQL, documents=f"{folder}/documents.parquet/*.parquet"))


# token counts


def test_transducer_equals_tokenizer():
    import sentencepiece

    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdehinorst   \n.,é▁ß漢😀AB12", k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(rng.choices("abcdefthein", k=3000)), " " * 40 + "x", "a" * 1000, "\x00a", "<s> </s>"] + [x or "" for x in ODD]
    tokenizer = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert CountingTransducer(PIECES).count(texts).tolist() == [len(x) for x in tokenizer.encode(texts, num_threads=1)]


def test_counts_odd_rows(odd):
    out = count_tokens(odd, PIECES, limit=3000)
    assert out.count() == odd.count() and out.where("n_bytes = 0 and n_tokens <> 0").count() == 0
    assert out.where("over_limit").count() == 2


# language


def test_language_held_out(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    net = learn_languages(table, learn)
    out = predict_languages(table, net).join(table.select("doc_id", "lang"), "doc_id").where(~(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    assert out.where("lang = lang_pred").count() >= 0.95 * out.count()
    windows = np.frombuffer(bytes(range(128)) * 2, np.uint8).reshape(2, 128)
    assert np.allclose(net.responses(windows)[0], net.fast_responses(windows), atol=1e-3)


def test_language_odd_rows(odd):
    assert learn_languages(odd, F.lit(True)) is None
    out = predict_languages(odd, None)
    assert out.where("lang_pred <> 'und' or score <> 0").count() == 0 and out.count() == odd.count()


# archives


def test_warc_round_trip(spark):
    rows = [(5, "http://b.example.com/x y\r\n", "same"), (3, "https://www.a.example.org/q?z=1", "same"), (7, None, None), (8, "", ""), (None, "u", "same"), (9, "http://b.example.com/x y\r\n", "é" * 70_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    folder = new_archive(spark)
    captures = write_archives(plan_records(pages), folder)
    upper = write_index(captures, folder, files=3)
    out = {r.page_id: r for r in read_records(captures, folder, with_payload=True).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in out.items()} == {5: ("revisit", 3), 3: ("response", None), 7: ("response", None), 8: ("revisit", 7), None: ("revisit", 3), 9: ("response", None)}
    assert out[9].payload_bytes == 140_000 and out[9].payload == ("é" * 70_000).encode()
    assert out[5].payload_digest == base64.b32encode(hashlib.sha1(b"same").digest()).decode()
    found = find_captures(spark.createDataFrame([("http://b.example.com/x y\r\n",), ("http://none.example.com/",), (None,)], "url string"), upper, folder)
    assert sorted(r.page_id for r in found.collect()) == [5, 7, 8, 9]


def test_warc_empty(spark):
    folder = new_archive(spark)
    captures = write_archives(plan_records(spark.createDataFrame([], "page_id long, url string, html string")), folder)
    assert read_records(captures, folder).count() == 0 and write_index(captures, folder).count() == 0
