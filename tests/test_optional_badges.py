"""Detectors that are off by default, and labels of hidden boxes."""

import math
from time import time

from pyspark.sql import functions as F

from spanveil.functions.matching import find_all
from spanveil.operators.badges import SHORT_FORMS, box_label, labelled_boxes, short_form
from spanveil.operators.detect import DEFAULT
from spanveil.rules.optional import OPTIONAL, optional_rules


def found(text, *names):
    return {(s["text"], s["entity_type"]) for s in find_all(text, optional_rules(*names))}


def test_identifiers():
    text = "card 4539 1488 0343 6467 or 4539 1488 0343 6468, NINO QQ 12 34 56 C then AB 12 34 56 C, HARTL911227OJ9AB, passport A1234567, Account Number: 12345678, ABA 123456789, ZIP 90210-1234, M1 4WX, EMP-12345, CUST-AB12CD"
    got = found(text, "identifiers")
    assert {("4539 1488 0343 6467", "CREDIT_CARD"), ("AB 12 34 56 C", "SSN_NATIONAL_ID"), ("HARTL911227OJ9AB", "SSN_NATIONAL_ID"), ("A1234567", "PASSPORT_NUMBER"), ("12345678", "BANK_ACCOUNT")} <= got
    assert {("123456789", "BANK_ACCOUNT"), ("90210-1234", "ADDRESS"), ("M1 4WX", "ADDRESS"), ("EMP-12345", "EMPLOYEE_ID"), ("CUST-AB12CD", "CUSTOMER_ID")} <= got
    assert not any(v == "4539 1488 0343 6468" for v, _ in got) and ("0x" + "ab" * 20, "BANK_ACCOUNT") in found("to 0x" + "ab" * 20, "identifiers")
    assert found("000-12-3456 and 123-00-4567", "identifiers") == set()


def test_code():
    text = 'const dbPassword = "hunter22"; let passwordField = "#password"; use process.env.API_URL and ${HOME_DIR} or $PATH_X; USER_SECRET_PASS is read; the secret'
    assert found(text, "code") == {("hunter22", "SOURCE_CODE_SECRET"), ("process.env.API_URL", "SOURCE_CODE_SECRET"), ("${HOME_DIR}", "SOURCE_CODE_SECRET"), ("$PATH_X", "SOURCE_CODE_SECRET"), ("dbPassword", "SOURCE_CODE_SECRET"), ("passwordField", "SOURCE_CODE_SECRET"), ("USER_SECRET_PASS", "SOURCE_CODE_SECRET")}


def test_proper_nouns_and_business():
    assert found("we met Alexander Smith at Apex Bank", "proper_nouns") == {("Alexander Smith", "PERSON_NAME")}
    text = "operation aegis starts. Board approved Plan Nine today. EBITDA came to $4.5 million. Counsel Jane Smith. diagnosed with acute flu. NDA with-acme"
    assert {("operation aegis", "PROJECT_CODENAME"), ("EBITDA came to $4.5 million", "FINANCIAL_METRIC"), ("Jane Smith", "PERSON_NAME"), ("diagnosed with acute flu", "MEDICAL_RECORD"), ("NDA with-acme", "LEGAL_REFERENCE")} <= found(text, "business")
    assert ("Board approved Plan Nine today", "COMPANY_SECRET") in found(text, "business")


def test_precursors():
    text = "Bank Name: First Continental Bank\nUniversity: Oxford; see repo aquire1/core and the repo is down. WhatsApp: +44 20 7946 0958, Fax: 12"
    got = found(text, "precursors")
    assert got == {("First Continental Bank", "ORGANIZATION"), ("Oxford", "ORGANIZATION"), ("aquire1/core", "REPOSITORY"), ("+44 20 7946 0958", "PHONE_NUMBER")}


def test_off_by_default_and_linear():
    assert not {id(r) for rules in OPTIONAL.values() for r in rules} & {id(r) for r in DEFAULT} and len(optional_rules()) == sum(map(len, OPTIONAL.values()))
    for text in ("1 " * 20_000, "Aa " * 20_000, "$A" * 20_000, "const " * 10_000, "EBITDA " * 10_000, "case " * 10_000, "0x" + "a" * 40_000, "account " * 10_000):
        began = time()
        find_all(text, optional_rules())
        assert time() - began < 2.5, text[:10]


def expected(placeholder, width, height):
    full = "[[" + placeholder.strip("[]") + "]]"
    kind, _, number = full[2:-2].rpartition("_")
    short = f"[[{SHORT_FORMS.get(kind, kind)}_{number}]]" if kind and number.isdigit() and 3 <= len(number) <= 4 else full
    fits = lambda t: math.floor(width / max(1, len(t) * 0.62))
    size = lambda t: max(8, min(fits(t), math.floor(height * 0.65), 14))
    if (width < 130 or fits(full) < 11) and (size(short) >= size(full) or width < 110):
        return short, size(short)
    return full, size(full)


def test_labels(spark):
    rows = [(p, w, h) for p in ("[[PASSWORD_001]]", "API_KEY_012", "[[DRIVING_LICENCE_NUMBER_003]]", "[odd]", "[[NEW_KIND_1234]]") for w in (20.0, 90.0, 109.5, 120.0, 129.0, 200.0, 400.0) for h in (6.0, 14.0, 30.0)]
    out = spark.createDataFrame(rows, "p string, w double, h double").select("p", "w", "h", box_label(F.col("p"), F.col("w"), F.col("h")).alias("l")).collect()
    assert all(tuple(r.l) == expected(r.p, r.w, r.h) for r in out) and len(out) == len(rows)
    assert spark.range(1).select(short_form(F.lit("[[PERSON_NAME_007]]"))).first()[0] == "[[NAME_007]]"
    boxes = spark.createDataFrame([("[[API_KEY_001]]", 100.0, 20.0, False), ("[[API_KEY_001]]", 100.0, 20.0, True)], "placeholder string, width double, height double, continues boolean")
    assert [r.label and r.label.text for r in labelled_boxes(boxes).collect()] == ["[[KEY_001]]", None]
