"""The pass over a text gives what the column expressions give, and takes time in proportion."""

import random
from time import time

import pytest
from pyspark.sql import functions as F

from spanveil.functions.masking import masked
from spanveil.functions.matching import findings
from spanveil.operators.detect import DEFAULT
from spanveil.operators.mask import mask
from spanveil.operators.resolve import resolve
from spanveil.operators.shield import shield
from spanveil.types import SPAN

KINDS = ["PERSON_NAME", "EMAIL_ADDRESS", "URL", "CONNECTION_STRING", "PASSWORD", "API_KEY", "CUSTOM_TERM", "ORGANIZATION", "DATE", "OTHER_KIND"]
WORDS = ["Ada Lovelace", "ada", "Ada's", "(bob)", "x@y.com", "key-1", "“Zoë”", "the", "[[DATE_007]]", "Orion Ltd.", "aaa", "aaaa", "\x01", "İx", "_ada", "\n"]


def made(rng):
    text = rng.choice([" ", ", ", ""]).join(rng.choice(WORDS) for _ in range(rng.randint(0, 25)))
    spans = []
    for seq in range(rng.randint(0, 14) if text else 0):
        a = rng.randrange(len(text))
        b = min(len(text), a + rng.randint(1, 16))
        spans.append((a, b, rng.choice(KINDS), rng.choice([0.5, 0.9, 0.9]), rng.choice([70, 80, 90, 1000]), "d", rng.choice(["e", "f"]), text[a:b], rng.choice([None, None, "Own", "staff_id"]), seq))
    return text, spans


@pytest.mark.parametrize("strategy,case_exact", [("REPLACE", False), ("REPLACE", True), ("HASH", False), ("PSEUDONYMIZE", False), ("REDACT", True)])
def test_same_as_the_column_expressions(spark, strategy, case_exact):
    rng = random.Random(len(strategy) + case_exact)
    cases = [made(rng) for _ in range(250)]
    docs = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(cases)], f"id long, text string, candidates array<{SPAN}>")
    rows = mask(resolve(docs), strategy=strategy, salt="s", case_exact=case_exact).collect()
    names = [part.partition(":")[0] for part in SPAN.removeprefix("struct<").removesuffix(">").split(",")]
    for r in rows:
        text, spans = cases[r.id]
        ours = masked(text, [dict(zip(names, s, strict=True)) for s in spans], strategy, "s", case_exact)
        assert ours["masked_text"] == r.masked_text, (text, spans)
        assert [tuple(p.values()) for p in ours["entities"]] == [tuple(e) for e in r.entities], (text, spans)
        assert dict(ours["mapping"]) == r.mapping


def log(lines):
    return "\n".join(f"2024-01-{k % 28 + 1:02d} user{k}@example{k % 50}.com from 10.{k % 250}.{k % 199}.7 token=abc{k}def{k}\nplain line {k} about nothing" for k in range(lines // 2))


def test_long_logs_take_time_in_proportion(spark):
    took = {}
    for lines in (400, 3200):
        text, began = log(lines), time()
        out = masked(text, findings(text, DEFAULT)[0])
        took[lines] = time() - began
        assert len(out["entities"]) >= lines // 2 * 3 and "@" not in out["masked_text"]
    assert took[3200] < 8 * 2.5 * max(took[400], 0.05)
    docs = spark.createDataFrame([(1, log(200))], "doc_id long, text string")
    shield(docs.limit(0)).collect()
    began = time()
    assert shield(docs).select("masked_text", "n_entities", "verdict").first().n_entities >= 300
    assert time() - began < 3 * 4  # a ceiling of three seconds on a machine of its own


def test_overrides_and_terms_take_the_same_way(spark):
    kind = "array<struct<start:int,end:int,action:string,entity_type:string>>"
    docs = spark.createDataFrame([(1, "mail a@b.com and c@d.com", [(5, 12, "UNMASK", None), (0, 4, "MASK", "VERB")]), (2, "mail a@b.com", None)], f"doc_id long, text string, o {kind}")
    rows = {r.doc_id: r for r in shield(docs, overrides="o").collect()}
    assert rows[1].masked_text == "[[VERB_001]] a@b.com and [[EMAIL_ADDRESS_001]]" and rows[1].processing.manual_overrides == 2
    assert rows[2].masked_text == "mail [[EMAIL_ADDRESS_001]]" and rows[2].processing.manual_overrides == 0
    with pytest.raises(ValueError):
        shield(docs, strategy="SHOUT")
    assert shield(docs.limit(0)).count() == 0 and "spans" not in shield(docs).columns
    assert shield(docs.withColumn("mapping", F.lit(1)).withColumn("entities", F.lit(2))).select("masked_text").count() == 2
