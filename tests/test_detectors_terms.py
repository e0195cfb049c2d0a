"""Detectors that fail, detectors for SQL, dictionaries within the shield, and rules kept as a table."""

import pytest
from pyspark.sql import functions as F

from spanveil.functions.matching import Reader, Rule, registered, rule_findings
from spanveil.functions.udtf import register_detector
from spanveil.operators import dictionary
from spanveil.operators.detect import DEFAULT
from spanveil.operators.dictionary import match_terms, pack_terms
from spanveil.operators.shield import shield
from spanveil.rules.table import COLUMNS, checked_rules, rule_row, rules_of, toggled, with_rule, without_rule


def _badges(text):
    at = text.find("badge ")
    if "boom" in text:
        raise RuntimeError("no badges today")
    if at >= 0:
        yield at + 6, at + 10, "EMPLOYEE_ID", 0.9, 92, "badge", None


BADGES = Reader("badges", _badges)
OUTSIDE = Reader("outside", lambda text: [(0, len(text) + 5, "URL", 1.0, 99, "x", None)] if "far" in text else [])
TEXTS = [(1, "mail a@b.com with badge 1234"), (2, "boom a@b.com badge 1234"), (3, "far badge 9999"), (4, None), (5, " ")]


def test_a_failing_detector_adds_nothing_and_is_named(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    rows = {r.doc_id: r for r in shield(docs, rules=registered(DEFAULT, BADGES, OUTSIDE)).collect()}
    assert rows[1].masked_text == "mail [[EMAIL_ADDRESS_001]] with badge [[EMPLOYEE_ID_001]]" and rows[1].processing.failed == []
    assert rows[2].masked_text == "boom [[EMAIL_ADDRESS_001]] badge 1234" and rows[2].processing.failed == ["badges: RuntimeError: no badges today"]
    assert rows[3].masked_text == "far badge [[EMPLOYEE_ID_001]]" and rows[3].processing.failed[0].startswith("outside: ValueError")
    assert rows[4].masked_text == "" and rows[4].processing.failed == []
    record = rows[1].processing
    assert (record.entities_detected, record.entities_masked, record.manual_overrides) == (2, 2, 0) and {"badges", "regex", "outside"} <= set(record.detectors)


def test_a_detector_replaces_the_one_with_its_name(spark):
    other = Reader("badges", lambda text: [])
    assert registered((BADGES,), other) == (other,) and registered((BADGES,), OUTSIDE) == (BADGES, OUTSIDE)
    found = spark.createDataFrame(TEXTS, "doc_id long, text string").select(rule_findings(F.col("text"), (BADGES,)).alias("f")).collect()
    assert [len(r.f.spans) for r in found] == [1, 0, 1, 0, 0] and [len(r.f.failed) for r in found] == [0, 1, 0, 0, 0]


def test_detectors_in_sql(spark):
    register_detector(spark, "find_badges", (BADGES, Rule("EMAIL_ADDRESS", r"[a-z]@[a-z]\.com", 0.9, 90, "mail")))
    spark.createDataFrame(TEXTS, "doc_id long, text string").createOrReplaceTempView("texts_with_badges")
    rows = spark.sql("SELECT doc_id, f.value, f.error FROM texts_with_badges, LATERAL find_badges(text) f").collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(1, "1234", None), (1, "a@b.com", None), (2, None, "badges: RuntimeError: no badges today"), (2, "a@b.com", None), (3, "9999", None)], key=str)


PACK_TEXTS = [
    (1, "The patient Electronic Health Record shows a diagnosis of diabetes."), (1, "no term; but an electronic, health record"), (None, "the MNPI\nDisclosure and Protected Health Information"),
    (None, "the electronic health recordings"), (7, None), (1, "The patient Electronic Health Record shows a diagnosis of diabetes."),
]


@pytest.mark.parametrize("small", [50_000, 2])
def test_dictionary_within_the_shield(spark, monkeypatch, small):
    monkeypatch.setattr(dictionary, "SMALL", small)
    docs = spark.createDataFrame(PACK_TEXTS, "doc_id long, text string")
    both = pack_terms(spark, ("HEALTHCARE_PHI", "FINANCE_MNPI"), (("RIA", "ORGANIZATION"),))
    masked = sorted(r.masked_text for r in shield(docs, terms=both).collect())
    assert masked == sorted([
        "The patient [[MEDICAL_RECORD_001]] shows a diagnosis of diabetes.", "no term; but an [[MEDICAL_RECORD_001]]", "the [[FINANCIAL_METRIC_001]] and [[MEDICAL_RECORD_001]]",
        "the electronic health recordings", "", "The patient [[MEDICAL_RECORD_001]] shows a diagnosis of diabetes.",
    ])
    off = [r.masked_text for r in shield(docs, terms=pack_terms(spark, ("FINANCE_MNPI",), (("RIA", "ORGANIZATION"), ("x y", "URL")))).collect()]
    assert "The patient Electronic Health Record shows a diagnosis of diabetes." in off
    found = match_terms(docs, both).collect()
    assert sorted((r.doc_id or 0, r.start, r.end, r.entity_type) for r in found) == [(0, 4, 19, "FINANCIAL_METRIC"), (0, 24, 52, "MEDICAL_RECORD"), (1, 12, 36, "MEDICAL_RECORD"), (1, 12, 36, "MEDICAL_RECORD"), (1, 16, 41, "MEDICAL_RECORD")]
    assert all(r.value == r.value.strip() and r.term for r in found)
    assert match_terms(docs.limit(0), both).count() == 0 and match_terms(docs, both.limit(0)).count() == 0


def test_rules_kept_as_a_table(spark):
    docs = spark.createDataFrame([(1, "ticket AB-123 of a@b.com, room 42")], "doc_id long, text string")
    table = spark.createDataFrame([("1", "tickets", "TICKET", "[A-Z]{2}-[0-9]+", None, None, True, False), ("2", "rooms", "ROOM", "room [0-9]+", 0.5, 80, False, None), ("3", None, "BAD", "([a-z", 1.0, 90, True, False), ("4", None, "EMPTY", "x*", 1.0, 90, None, False), ("5", None, "slow one", "a+", 1.0, 90, True, False), ("6", None, "SLOW", "(a+)+b", 1.0, 90, True, False)], COLUMNS)
    problems = {r.rule_id: r.problem for r in checked_rules(table).collect()}
    assert problems["1"] is None and problems["2"] is None and problems["3"].startswith("the pattern can't be read") and "empty" in problems["4"] and "capitals" in problems["5"] and "without end" in problems["6"]
    masked = lambda t: shield(docs, rules=(*DEFAULT, *rules_of(t))).first().masked_text
    assert masked(table) == "ticket [[TICKET_001]] of [[EMAIL_ADDRESS_001]], room 42"
    assert masked(toggled(toggled(table, "2"), "1")) == "ticket AB-123 of [[EMAIL_ADDRESS_001]], [[ROOM_001]]"
    assert masked(without_rule(table, "1")) == "ticket AB-123 of [[EMAIL_ADDRESS_001]], room 42"
    always = with_rule(table, rule_row(spark, "1", "WHOLE", "of a@b[.]com", always_mask=True))
    assert masked(always) == "ticket AB-123 [[WHOLE_001]], room 42" and always.count() == table.count()
    assert rules_of(table.limit(0)) == ()
