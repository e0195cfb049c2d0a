"""The Hamming join against comparing all pairs."""

import random

import numpy as np
import pytest

from spanveil.llm import minhash_join as mj
from spanveil.llm.queries_minhash_join import op11_minhash_join
from tests.llm import helpers


def changed(rng, words, times):
    words = list(words)
    for _ in range(times):
        at = rng.randrange(len(words))
        words[at : at + rng.choice([0, 1])] = [f"w{rng.randrange(10**6)}"] * rng.choice([0, 1, 1])
    return words


def texts(rng, groups=6, copies=12):
    """Copies with more and more changes, so that some are linked only by way of others, and many are nearly linked."""
    made = [None, "", " \t", "one two", "ONE two", "one two three four five", "Ä b " * 4000]
    for _ in range(groups):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randint(30, 200))]
        made += [" ".join(changed(rng, base, k % 7)) for k in range(copies)]
        chain = base
        for _ in range(copies // 2):
            chain = changed(rng, chain, 2)
            made.append(rng.choice([" ", "\n"]).join(chain).upper())
    made += made[20:24]
    passage = " ".join(f"p{k}" for k in range(60))
    made += [f"{passage} " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(rng.randint(10, 60))) for _ in range(30)]
    return made


@pytest.mark.parametrize("rows_a_posting", [2048, 3])
def test_query_against_all_pairs(spark, tmp_path, monkeypatch, rows_a_posting):
    monkeypatch.setattr(mj, "POSTING_ROWS", rows_a_posting)
    made = texts(random.Random(rows_a_posting))
    docs = helpers.docs(spark, made, first=3).withColumnRenamed("n_chars", "component_id")
    rows = op11_minhash_join(spark, helpers.saved(docs, tmp_path)).collect()
    expected = helpers.linked(list(enumerate(made, 3)), 5, 85, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == expected and len(rows) == len(expected)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    assert 20 < len({c for _, c in expected.values()}) < len(made) - 20


def test_null_and_repeated_ids(spark):
    words = [f"w{k}" for k in range(40)]
    rows = [(1, " ".join(words)), (7, " ".join(words)), (7, "other words of the seventh one"), (9, "other words of the seventh one"), (None, " ".join(words)), (4, None), (4, "four words alone here"), (9, "")]
    found = mj.minhash_components(spark.createDataFrame(rows, "n long, m string"), 5, 85, 100, "n", "m").collect()
    assert sorted((r.n, r.n_ngrams, r.component_id) for r in found if r.n is not None) == [(1, 36, 1), (4, 0, 4), (4, 1, 4), (7, 2, 1), (7, 36, 1), (9, 0, 1), (9, 2, 1)]
    assert [(r.n_ngrams, r.component_id) for r in found if r.n is None] == [(36, None)]
    assert mj.minhash_components(spark.createDataFrame([], "n long, m string"), 5, 85, 100, "n", "m").count() == 0


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_pairs_within_the_bound_meet_twice(percent):
    most = mj.threshold(percent, 100)
    chunks, rng = mj.chunks_for(most), np.random.default_rng(percent)
    a = rng.integers(0, 1 << mj.BITS, (400, mj.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(mj.SYMBOLS, rng.integers(0, most + 1), replace=False)] ^= 1
    (keys, of), (others, _) = mj.error_keys(a, chunks), mj.error_keys(b, chunks)
    for x, y in zip(keys, others, strict=True):
        assert len(set(of[x == y])) >= 2


def test_signatures_differ_as_sets_do():
    rng, apart = np.random.default_rng(2), []
    for _ in range(400):
        h = rng.integers(0, 1 << 62, 100).astype(np.uint64)
        both = mj._signatures(np.repeat([0, 1], 92), np.concatenate([h[:92], h[8:]]), 2)
        apart.append(np.count_nonzero(both[0] != both[1]))
    assert abs(np.mean(apart) - mj.SYMBOLS * 0.16) < 0.6 and max(apart) <= mj.threshold(84, 100)
