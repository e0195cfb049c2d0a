"""Patterns of the domain packs; not among the default rules, so that a pack can be switched on by itself."""

from __future__ import annotations

from spanveil.functions.matching import B0, B1, DIGIT, Rule
from spanveil.types import DICTIONARY_PRIORITY


def _rule(kind: str, pattern: str, evidence: str, *marks) -> Rule:
    return Rule(kind, pattern, 0.95, DICTIONARY_PRIORITY, evidence, detector="pack", marks=marks)


# The shapes that belong to each pack.
PATTERNS: dict[str, tuple[Rule, ...]] = {
    "HEALTHCARE_PHI": (
        _rule("MEDICAL_RECORD", rf"(?ia){B0}MRN[-\s]?\d{{6,10}}{B1}", "medical record number", DIGIT),
        _rule("MEDICAL_RECORD", rf"(?ia){B0}ICD-10-[A-Z0-9]{{3,7}}{B1}", "diagnosis code", "icd-10-"),
        _rule("MEDICAL_RECORD", rf"(?ia){B0}Rx[-\s]?#?\d{{7,10}}{B1}", "prescription number", DIGIT),
    ),
    "FINANCE_MNPI": (
        _rule("BANK_ACCOUNT", rf"{B0}[A-Z]{{2}}\d{{2}}[A-Z0-9]{{11,30}}{B1}", "international account number", DIGIT),
        _rule("FINANCIAL_METRIC", rf"{B0}[A-Z]{{6}}[A-Z0-9]{{2}}(?:[A-Z0-9]{{3}})?{B1}", "bank identifier code"),
        _rule("FINANCIAL_METRIC", rf"(?ia){B0}CUSIP[-\s]?[A-Z0-9]{{9}}{B1}", "security identifier", "cusip"),
    ),
    "LEGAL_PRIVILEGE": (
        _rule("LEGAL_REFERENCE", r"(?ia)CONFIDENTIAL\s+ATTORNEY-CLIENT\s+PRIVILEGED", "privilege header", "attorney-client"),
        _rule("COMPANY_SECRET", r"(?ia)TRADE\s+SECRET\s+-\s+DO\s+NOT\s+DISCLOSE", "trade secret stamp", "disclose"),
    ),
    "CYBER_DEVOPS": (
        _rule("URL", rf"(?ia)(?<![A-Za-z0-9_-])[A-Z0-9-]++\.internal{B1}", "internal host", ".internal"),
        _rule("URL", rf"(?ia)(?<![A-Za-z0-9_-])[A-Z0-9-]++\.local{B1}", "local host", ".local"),
        _rule("CONNECTION_STRING", r"(?ia)mongodb(?:\+srv)?://[\w-]++:[^@\s]++@[\w.-]++", "database address", "mongodb"),
    ),
    "GOVT_DEFENSE": (
        _rule("COMPANY_SECRET", rf"(?ia){B0}TOP\s+SECRET{B1}", "classification"),
        _rule("COMPANY_SECRET", rf"(?ia){B0}CUI//[A-Z0-9/-]+{B1}", "controlled information mark", "cui//"),
    ),
}


def pack_rules(enabled: tuple[str, ...] = tuple(PATTERNS)) -> tuple[Rule, ...]:
    return tuple(rule for pack in enabled for rule in PATTERNS[pack])
