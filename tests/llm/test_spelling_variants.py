"""Spelling variants against comparing each word with every word it could be one letter away from."""

import random
import re
from collections import Counter

import pytest

from spanveil.llm import spelling_variants as sv
from spanveil.llm.queries_spelling_variants import op12_spelling_variants
from tests.llm import helpers

LOWER = {c: c + 32 for c in range(65, 91)}


def expected(rows):
    counts = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = helpers.crc(f"{i}:{w}")
            if i is not None and h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    holes, near = {}, {w: set() for w in words}
    for w in words:
        for k in range(len(w)):
            holes.setdefault((w[:k], w[k + 1 :]), set()).add(w)
    for w in words:
        for k in range(len(w)):
            near[w] |= holes[w[:k], w[k + 1 :]] - {w}
            if (x := w[:k] + w[k + 1 :]) in words:
                near[w].add(x)
                near[x].add(w)
    best = {w: min(x, key=lambda y: (-words[y], y), default=None) for w, x in near.items()}
    form = {w: b if b and words[b] >= 5 * words[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def texts(rng):
    stems = ["".join(rng.choice("abcdeéÿÀ") for _ in range(rng.randint(5, 9))) for _ in range(25)]
    many = []
    for k, w in enumerate(stems):
        many += [w] * 3 ** (k % 6)
        for _ in range(12):
            at, c = rng.randrange(len(w)), rng.choice("abcdeé")
            x = rng.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]])
            many += [rng.choice([x, x.upper()])] * rng.randint(1, 9)
    rng.shuffle(many)
    return [rng.choice([" ", "-", "1"]).join(many[k : k + 40]) for k in range(0, len(many), 40)]


@pytest.mark.parametrize("a_tree", [8000, 20])
def test_query_against_brute_force(spark, tmp_path, monkeypatch, a_tree):
    monkeypatch.setattr(sv, "WORDS_A_TREE", a_tree)
    long = "q" * 50_000
    chain = " ".join(["aaaaaaaa "] * 5 + ["aaaaaaab "] * 25 + ["aaaaaabb "] * 125 + ["aaaaabbb "] * 625)
    made = [None, "", "12 ,", f"{long} {long}z " * 5, "abcdefg abcdegf " * 5, "×÷" * 3 + " ", chain, *texts(random.Random(a_tree))]
    docs = helpers.docs(spark, made).withColumnRenamed("source", "form")
    docs = docs.unionByName(docs.where("doc_id = 8")).unionByName(spark.createDataFrame([(None, made[9] * 3, None, None, None)], docs.schema))
    rows = op12_spelling_variants(spark, helpers.saved(docs, tmp_path)).collect()
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(found) == len(rows)
    assert found == expected([*enumerate(made), (8, made[8]), (None, made[9] * 3)])
    assert sum(1 for x in found.values() if x[0]) > 20 and found["aaaaaaaa"][1] == "aaaaabbb"


def test_query_over_documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in op12_spelling_variants(spark, sf).collect()}
    assert found == expected(rows)


def test_no_documents(spark):
    assert sv.spelling_variants(helpers.docs(spark, ["a"]).limit(0)).count() == 0
