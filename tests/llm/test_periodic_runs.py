"""Periodic runs against comparing every word with the one a period later."""

import hashlib
import random
import re
from fractions import Fraction

import numpy as np

from spanveil.llm.periodic_runs import Grammar, find_runs, periodic_runs
from spanveil.llm.queries_periodic_runs import op13_periodic_runs
from tests.llm import helpers


def brute(words):
    found = {}
    for q in range(1, len(words) // 3 + 1):
        same, k = [words[k] == words[k + q] for k in range(len(words) - q)], 0
        while k < len(same):
            s = k
            while k < len(same) and same[k]:
                k += 1
            if k > s and k - s + q >= max(24, 3 * q):
                found.setdefault((s, k - s + q), q)
            k += 1
    return sorted((s, q, n) for (s, n), q in found.items())


def expected(doc_id, text):
    w, h = re.findall(r"[^\x20\x09-\x0d]+", text or ""), helpers.crc(doc_id)
    if doc_id is not None and w and h % 10 == 0:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
    runs = brute(w)
    gone = {k for s, q, n in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[2], r[1]), r[0], r[1]), default=None)
    top = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *top, sha("".join(f"{s},{n},{q}\n" for s, q, n in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def made(rng):
    words = []
    for _ in range(rng.randint(0, 5)):
        period = [rng.choice("abcde"[: rng.randint(1, 5)]) for _ in range(rng.randint(1, 12))]
        words += period * rng.randint(1, 9) + [rng.choice("abcxyz") for _ in range(rng.randint(0, 8))]
    return words


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    texts = [None, "", " \t\n", "a", "a " * 23, "a " * 24, "a b " * 12, "Ä ä " * 2000, "x y " * 30, "z\x0bz\x0cz " * 9]
    texts += [rng.choice([" ", "\n", "  "]).join(made(rng)) for _ in range(200)]
    docs = helpers.docs(spark, texts).withColumnRenamed("n_chars", "runs")
    docs = docs.union(docs.where("doc_id = 20")).unionByName(spark.createDataFrame([(None, "a b " * 30, None, None, None)], docs.schema))
    found = op13_periodic_runs(spark, helpers.saved(docs, tmp_path)).collect()
    assert len(found) == len(texts) + 2
    by_id = dict(enumerate(texts)) | {None: "a b " * 30}
    for r in found:
        assert tuple(r)[1:] == expected(r.doc_id, by_id[r.doc_id]), r.doc_id
    assert sum(r.n_runs for r in found) > 100


def test_query_over_documents(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    short = {i for i, t in texts.items() if len(t or "") < 6000}
    for r in op13_periodic_runs(spark, sf).collect():
        if r.doc_id in short:
            assert tuple(r)[1:] == expected(r.doc_id, texts[r.doc_id])


def test_collapsed_texts_and_no_documents(spark):
    docs = helpers.docs(spark, ["go " + "on and " * 20 + "end", None]).withColumnRenamed("text", "body").withColumnRenamed("doc_id", "length")
    assert [(r.doc_id, r.collapsed) for r in periodic_runs(docs, "length", "body").orderBy("doc_id").collect()] == [(0, "go on and end"), (1, "")]
    assert periodic_runs(docs.limit(0), "length", "body").count() == 0


def test_extensions_and_long_texts():
    rng = np.random.default_rng(3)
    ids = np.concatenate([[-1], np.tile([0, 1, 0, 2], 40), rng.integers(0, 3, 200), [-1], np.zeros(90, np.int64), [-1]])
    grammar = Grammar(ids)
    assert max(np.diff(np.flatnonzero(grammar.symbols[-1] == -1))) <= 8
    pairs = [sorted(rng.choice(np.arange(1, 361), 2, replace=False).tolist()) for _ in range(3000)]
    i, j = np.array(pairs).T
    ahead, back = grammar.extension(i, j), grammar.extension(i, j, back=True)
    for a, b, x, y in zip(i.tolist(), j.tolist(), ahead.tolist(), back.tolist(), strict=True):
        assert (ids[a : a + x] == ids[b : b + x]).all() and ids[a + x] != ids[b + x]
        assert (ids[a - y : a] == ids[b - y : b]).all() and ids[a - y - 1] != ids[b - y - 1]
    long = np.concatenate([[-1], np.tile(np.arange(1000), 300), [-1]])
    assert [x.tolist() for x in find_runs(long, np.array([1]), np.array([300_000]))] == [[1], [300_000], [1000]]
