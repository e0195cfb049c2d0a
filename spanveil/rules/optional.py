"""Detectors that are switched on by name: shapes of further identifiers, code, proper nouns, and phrases of business.

None of them runs by default. ``optional_rules("identifiers", "code")`` gives rules to
add to those of ``shield`` or ``detect``; where they meet the default ones, resolution
decides as always. All patterns take time in proportion to the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import replace

from spanveil.functions.matching import B0, B1, DIGIT, Reader, Rule
from spanveil.rules.context import NO_NAMES, ORG_SUFFIXES
from spanveil.types import CONTEXT_PRIORITY, REGEX_PRIORITY


def _shape(kind: str, pattern: str, confidence: float, evidence: str, marks: tuple = (DIGIT,), groups: tuple[int, ...] = (0,), guard=None) -> Rule:
    return Rule(kind, pattern, confidence, REGEX_PRIORITY, evidence, groups, detector="optional", marks=marks, guard=guard)


def _luhn(text: str, m: re.Match, group: int) -> bool:
    """From the end, every second digit counts twice, and its own digits are added; the sum ends in a zero."""
    digits = [int(c) for c in m.group(group) if c.isdigit()]
    return sum(digits[-1::-2]) % 10 == -sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2]) % 10


def _no_call(text: str, m: re.Match, group: int) -> bool:
    """Calls and parts of programs are no values."""
    return not re.match(r"(?:document|window|location|console|Math|JSON)\.|[A-Za-z0-9_$]+\(", m.group(group))


# Shapes of identifiers, accounts and addresses.
IDENTIFIERS = (
    _shape("CREDIT_CARD", rf"{B0}[0-9](?:[ -]?[0-9]){{12,18}}{B1}", 0.98, "card number with a check digit", guard=_luhn),
    _shape("BANK_ACCOUNT", rf"{B0}(?:0x[a-fA-F0-9]{{40}}|[13][a-km-zA-HJ-NP-Z1-9]{{25,34}}|bc1[a-z0-9]{{39,59}}|[1-9A-HJ-NP-Za-km-z]{{32,44}}){B1}", 0.97, "wallet"),
    _shape("SSN_NATIONAL_ID", rf"{B0}(?!000|666|9)[0-9]{{3}}[- ]?(?!00)[0-9]{{2}}[- ]?(?!0000)[0-9]{{4}}{B1}", 0.96, "social security number"),
    _shape("SSN_NATIONAL_ID", rf"(?i){B0}[A-CEGHJ-PR-TW-Z]{{2}}\s*[0-9]{{2}}\s*[0-9]{{2}}\s*[0-9]{{2}}\s*[A-D]{B1}", 0.98, "national insurance number"),
    _shape("SSN_NATIONAL_ID", rf"{B0}[A-Z]{{5}}[0-9]{{6}}[A-Z0-9]{{5}}{B1}", 0.98, "driving licence"),
    _shape("PASSPORT_NUMBER", rf"(?i){B0}[A-PR-WY][0-9]{{7,8}}{B1}", 0.9, "passport number"),
    _shape("BANK_ACCOUNT", rf"(?i){B0}(?:Account|Acct|Acc\s#)(?:\s+Number)?\s*[:=]?\s*#?([0-9]{{8,17}}){B1}", 0.96, "account number", ("acc",), (1,)),
    _shape("BANK_ACCOUNT", rf"(?i){B0}(?:Routing|ABA)(?:\s+Number)?\s*[:=]?\s*#?([0-9]{{9}}){B1}", 0.95, "routing number", ("routing", "aba"), (1,)),
    _shape("ADDRESS", rf"(?i){B0}(?:ZIP|Postal(?:\s+Code)?)\s*[:=]?\s*([A-Z0-9]{{3,5}}[-\s]?[A-Z0-9]{{3,4}}|[0-9]{{5}}(?:-[0-9]{{4}})?){B1}", 0.93, "postal code", ("zip", "postal"), (1,)),
    _shape("ADDRESS", rf"{B0}[A-Z]{{1,2}}[0-9][A-Z0-9]?\s+[0-9][A-Z]{{2}}{B1}", 0.94, "postcode"),
    _shape("EMPLOYEE_ID", rf"(?i){B0}(?:EMP|EID)[-_\s]?[0-9]{{4,8}}{B1}", 0.94, "employee number"),
    _shape("CUSTOMER_ID", rf"(?i){B0}(?:CUST|ACC)[-_\s]?[A-Z0-9]{{4,10}}{B1}", 0.93, "customer number", ("cust", "acc")),
)
# Names in program text that hold secrets, and those that hold something else.
_SECRET_NAMES, _FIELD_NAMES = "secret|apiKey|password|token|credential|dbPass", "Field|Element|Input|Selector|Label|Text|Count|Total|List|Length|Name|Type|Id|Icon|Button|Form"


def _declared_secret(text: str, m: re.Match, group: int) -> bool:
    return bool(re.search(f"(?i){_SECRET_NAMES}", m.group(1))) and not re.search(f"(?i)(?:{_FIELD_NAMES})", m.group(1)) and _no_call(text, m, group)


def _identifiers(text: str) -> Iterator[tuple]:
    """Words that are names of secrets in a program."""
    low = text.lower()
    if not any(p in low for p in _IDENTIFIER_PARTS):
        return
    for m in re.finditer(r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{2,}+", text):
        if any(p in (word := m.group().lower()) for p in _IDENTIFIER_PARTS) and (word not in ("secret", "password")):
            yield *m.span(), "SOURCE_CODE_SECRET", 0.9, CONTEXT_PRIORITY, "name of a secret in a program", None


_IDENTIFIER_PARTS = ("secret", "password", "api_key", "priv_key", "auth_token")
CODE = (
    _shape("SOURCE_CODE_SECRET", r"(?<![A-Za-z0-9_$])(?:process\.env\.[A-Z0-9_]{3,}+|\$[A-Z0-9_]{3,}+(?![A-Za-z0-9_])|\$\{[A-Z0-9_]{3,}+\})", 0.95, "variable of the environment", ("process.env", "$")),
    _shape("SOURCE_CODE_SECRET", rf"{B0}(?:const|let|var|String|final)\s+([A-Za-z0-9_]++)\s*[:=]\s*[\"']([^\"']{{4,}}+)[\"']", 0.96, "secret in a declaration", ("secret", "apikey", "password", "token", "credential", "dbpass"), (2,), _declared_secret),
    Reader("identifiers", _identifiers),
)

_COMPANY = frozenset(w.lower() for s in ORG_SUFFIXES for w in s.split())


def _proper_nouns(text: str) -> Iterator[tuple]:
    """One or two words that begin with a capital letter and go on in small ones, with no sign of a company among them."""
    for m in re.finditer(rf"{B0}[A-Z][a-z]{{2,20}}{B1}(?:\s+[A-Z][a-z]{{2,20}}{B1})?", text):
        if _COMPANY.isdisjoint(m.group().lower().split()):
            yield *m.span(), "PERSON_NAME", 0.88, CONTEXT_PRIORITY, "proper noun", None


# Code names that are known, and phrases of business that confidential values follow.
CODENAMES = ("Project Phoenix", "Project Titan", "Operation Aegis", "Falcon Horizon", "Project Q-Branch", "Project Quantum", "Apollo 2.0", "Project Falcon")
APPROVERS, APPROVED = "CEO|CTO|CFO|Board|VP|Director", "approved|authorized|signed|disclosed|reviewed"
MEASURES = r"Q[1-4]|fiscal\ year|ARR|MRR|EBITDA|valuation|settlement|acquisition"
PROFESSIONS = r"Dr\.|Prof\.|Counsel|Attorney|Patient|Employee|User|Manager|Mr\.|Mrs\.|Ms\.|Executive|Director"
DIAGNOSES = r"diagnosed\ with|prescribed|patient\ history\ of|symptoms\ include|medical\ record\ ?\#?"
MATTERS = r"NDA|non-disclosure|litigation|case\ ?\#?|settlement\ agreement|court\ order"


def _phrase(kind: str, pattern: str, confidence: float, evidence: str, marks: tuple, groups: tuple[int, ...] = (0,)) -> Rule:
    return Rule(kind, pattern.replace("\\ ", r"\s+"), confidence, CONTEXT_PRIORITY, evidence, groups, detector="optional", marks=marks)


BUSINESS = (
    *[_phrase("PROJECT_CODENAME", rf"(?i){B0}{re.escape(name)}{B1}", 0.98, "known code name", (name.split()[0].lower(),)) for name in CODENAMES],
    _phrase("COMPANY_SECRET", rf"{B0}(?:{APPROVERS})\s+(?:{APPROVED})\s+[A-Z][A-Za-z0-9]*(?:[ \t][A-Za-z0-9]+){{0,3}}", 0.92, "approved by an executive", tuple(APPROVED.split("|"))),
    _phrase("FINANCIAL_METRIC", rf"(?i){B0}(?:{MEASURES}){B1}[^$0-9\n]{{1,30}}\$?[0-9]+(?:\.[0-9]+)?(?:\s*(?:million|billion|[MBk]))?{B1}", 0.89, "figure of the business", (DIGIT,)),
    _phrase("PERSON_NAME", rf"{B0}(?:{PROFESSIONS})\s+([A-Z][a-z]{{1,20}}\s+[A-Z][a-z]{{1,20}}){B1}", 0.91, "name after a profession", (), (1,)),
    _phrase("MEDICAL_RECORD", rf"(?i){B0}(?:{DIAGNOSES})\s+[A-Za-z0-9]+(?:[ \t][A-Za-z0-9]+){{0,3}}", 0.93, "diagnosis", ("diagnosed", "prescribed", "patient", "symptoms", "medical")),
    _phrase("LEGAL_REFERENCE", rf"(?i){B0}(?:{MATTERS})\s+[A-Za-z0-9_-]+(?:[ \t][A-Za-z0-9_-]+){{0,3}}", 0.9, "legal matter", ("nda", "non-disclosure", "litigation", "case", "settlement", "court")),
)
# Kinds of organisations, repositories and telephones that stand before their names or numbers.
ORGANISATIONS = "Bank|Company|Organization|Org|Institution|Agency|Business|Employer|Firm|University|College|School|Hospital|Clinic|Ministry|Department|Authority|Foundation|Association"
REPOSITORIES = r"repository|git\ repo|repo|codebase"
TELEPHONES = r"Phone(?:\ Number)?|Telephone|Tel|Mobile(?:\ Number)?|Cell(?:\ Phone)?|Call(?:\ us\ at)?|Contact\ (?:Number|Phone)|Hotline|WhatsApp|SMS|Fax|Reach\ me\ (?:on|at)"
_WORDY = r"[A-Za-z0-9&.'À-ɏḀ-ỿ-]{2,35}"


def _a_name(text: str, m: re.Match, group: int) -> bool:
    return m.group(group).lower().rstrip(".") not in NO_NAMES


def _enough_digits(text: str, m: re.Match, group: int) -> bool:
    return 7 <= sum(c.isdigit() for c in m.group(group)) <= 15


PRECURSORS = (
    replace(_phrase("ORGANIZATION", rf"(?i){B0}(?:{ORGANISATIONS})(?:\s+(?:Name|of))?\s*[:=]\s*[\"']?({_WORDY}(?:[ \t]+{_WORDY}){{0,4}})", 0.99, "label of an organisation", (), (1,)), prefix="ORGANIZATION", guard=_a_name),
    replace(_phrase("REPOSITORY", rf"(?i){B0}(?:{REPOSITORIES})\s+([A-Z0-9_./-]{{2,40}}){B1}", 0.98, "word before a repository", ("repo", "codebase"), (1,)), guard=_a_name),
    replace(_phrase("PHONE_NUMBER", rf"(?i){B0}(?:{TELEPHONES})\s*[:=]\s*([+0-9 .()-]{{7,22}}){B1}", 0.99, "label of a telephone", (DIGIT,), (1,)), prefix="PHONE", guard=_enough_digits),
)
OPTIONAL: dict[str, tuple[Rule | Reader, ...]] = {"identifiers": IDENTIFIERS, "code": CODE, "proper_nouns": (Reader("proper nouns", _proper_nouns),), "business": BUSINESS, "precursors": PRECURSORS}


def optional_rules(*names: str) -> tuple[Rule | Reader, ...]:
    """The rules of the named groups, in the order of their names; all without names."""
    return tuple(rule for name in (names or OPTIONAL) for rule in OPTIONAL[name])
