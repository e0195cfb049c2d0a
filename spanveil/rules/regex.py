"""Rules for values that are recognised by their shape alone."""

from __future__ import annotations

import re

from spanveil.functions.matching import B0, B1, DIGIT, Rule
from spanveil.types import REGEX_PRIORITY

# Shapes of values, and the words that stand before phone numbers or other numbers.
EMAIL = rf"(?i)(?<![A-Za-z0-9_%+-])[a-z0-9_%+-]++(?:\s*\.\s*[a-z0-9_%+-]++)*+\s*(?:@|\[at\]|\(at\))\s*[a-z0-9-]+(?:\.[a-z0-9-]+){{0,4}}(?:\s*\.\s*[a-z]{{2,4}}|\.[a-z]{{5,}}+)(?:\s*\.\s*[a-z]{{2}})?{B1}"
CARD = rf"{B0}(?:4[0-9]{{12}}(?:[0-9]{{3}})?|5[1-5][0-9]{{14}}|6(?:011|5[0-9][0-9])[0-9]{{12}}|3[47][0-9]{{13}}){B1}|{B0}\d{{4}}[-\s]?\d{{4}}[-\s]?\d{{4}}[-\s]?\d{{4}}{B1}"
IBAN = rf"{B0}[A-Z]{{2}}\d{{2}}[A-Z0-9]{{11,30}}{B1}"
SSN = rf"{B0}\d{{3}}-\d{{2}}-\d{{4}}{B1}"
UUID = rf"{B0}[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[1-5][0-9a-fA-F]{{3}}-[89abAB][0-9a-fA-F]{{3}}-[0-9a-fA-F]{{12}}{B1}"
URL = rf"(?i){B0}https?://[^\s<>'\"]+"
_BYTE = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
IP = rf"{B0}(?:{_BYTE}\.){{3}}{_BYTE}{B1}|{B0}(?:[0-9a-fA-F]{{1,4}}:){{7}}[0-9a-fA-F]{{1,4}}{B1}|{B0}(?:[0-9a-fA-F]{{1,4}}:){{1,6}}(?::[0-9a-fA-F]{{1,4}}){{1,6}}{B1}"
_MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
DATE = (
    rf"(?i){B0}(?:19|20)\d{{2}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}(?::\d{{2}}(?:\.\d+)?)?(?:Z|[+-]\d{{2}}:?\d{{2}})?{B1}"
    rf"|{B0}(?:19|20)\d{{2}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}{B1}|{B0}\d{{1,2}}[-/.]\d{{1,2}}[-/.]\d{{2,4}}{B1}"
    rf"|{B0}{_MONTH}\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,?\s+(?:19|20)?\d{{2}})?{B1}|{B0}\d{{1,2}}(?:st|nd|rd|th)?\s+{_MONTH}(?:,?\s+(?:19|20)?\d{{2}})?{B1}"
)
METRIC = (
    rf"(?i)[+-][$€£¥₦]\s*\d{{1,3}}(?:,\d{{3}})*(?:\.\d{{1,2}})?(?:\s*(?:[kmbt]|million|billion|thousand))?"
    rf"|{B0}[+-]\d+(?:\.\d+)?%|{B0}\d+(?:\.\d+)?%\s*(?:margin|velocity|growth|yield|discount|gain|loss|return|rate){B1}"
    rf"|{B0}\d+(?:\.\d+)?\s*(?:bps|Sharpe|ROI|PnL|EBITDA|ARR|MRR){B1}"
)
PHONE = (
    rf"(?:\+\d{{1,4}}[-.\s]+)?(?:\(\d{{1,4}}\)[-.\s]*)?(?:[0-9]{{2,5}}[-.\s]+[0-9]{{2,5}}(?:[-.\s]+[0-9]{{2,5}})?){B1}"
    rf"|\+\d{{1,4}}(?:\([0-9]\))?[0-9]{{7,12}}{B1}|{B0}0[789][01]\d{{8}}{B1}"
)
STREET = rf"(?i){B0}\d{{1,5}}\s+[a-z][a-z0-9\s,.]{{3,30}}\s+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Court|Ct|Way|Circle|Cir){B1}"
MAC = rf"{B0}(?:[0-9A-Fa-f]{{2}}[:-]){{5}}[0-9A-Fa-f]{{2}}{B1}"
IMEI = rf"(?i){B0}\d{{2}}-\d{{6}}-\d{{6}}-\d{B1}|{B0}(?:IMEI(?:\s*[:=]\s*|\s+))?\d{{15}}{B1}"
VIN = rf"(?i){B0}(?:VIN(?:\s*[:=]\s*|\s+))?[A-HJ-NPR-Z0-9]{{17}}{B1}"
GPS = rf"{B0}[-+]?(?:[1-8]?\d\.\d{{3,8}}|90(?:\.0{{3,8}})?)\s*,\s*[-+]?(?:180(?:\.0{{3,8}})?|(?:1[0-7]\d|[1-9]?\d)\.\d{{3,8}}){B1}"
BLOOD = r"(?i)(?<![A-Za-z0-9_])Blood\s+(?:Type|Group)\s*[:=]\s*(?:A|B|AB|O)[+-](?=[A-Za-z0-9_])"
NOT_PHONE = (
    r"(?i)(?:NIN|BVN|National\s+(?:Identification|Identity|ID)(?:\s+Number)?(?:\s*\([A-Za-z]+\))?|Bank\s+Verification(?:\s+Number)?(?:\s*\([A-Za-z]+\))?"
    r"|(?:Bank\s+)?Account(?:\s+Number)?|Acct\s+No|Card\s+Number|Card\s+No|Order\s+ID|Ticket\s+ID|Serial(?:\s+Number)?|Tax\s+ID|SSN"
    r"|Social\s+Security(?:\s+Number)?|Invoice(?:\s+Number)?|Tracking\s+ID|Employee\s+ID|Customer\s+ID|Policy\s+Number|License\s+Number"
    r"|Reference(?:\s+Number)?|Ref\s+No|Voter\s+ID|Student\s+ID)\s*[:=\-]?\s*\Z"
)
CALLS = r"(?i)(?:Phone|Telephone|Tel|Mobile|Cell|Call|Contact|Hotline|WhatsApp|SMS|Fax|Reach\s+me\s+(?:on|at))\s*[:=]?\s*\Z"


_NOT_PHONE, _CALLS = re.compile(NOT_PHONE), re.compile(CALLS)
_REFUSED = re.compile(
    r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}\Z|(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}\Z|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}\Z"
    r"|v?[0-9]+\.[0-9]+(?:\.[0-9]+)*\Z|.*[0-9]{1,2}:[0-9]{2}|[^+]*(?:\.[^+.]*){3}\Z"
)
_SHAPED = re.compile(r"\+|0[789][01][0-9]{8}\Z|[^0-9]*[0-9]+[\s\-.()]+[0-9]")


def phone_guard(text: str, match: re.Match, group: int) -> bool:
    """Is it a phone number, not an address, date, time, version, year, small number or account number?"""
    value, before = match.group(group).strip(), text[max(0, match.start(group) - 80) : match.start(group)]
    digits = sum(c in "0123456789" for c in value)
    if _REFUSED.match(value) or not 7 <= digits <= 15 or _NOT_PHONE.search(before):
        return False
    return bool(_SHAPED.match(value) or _CALLS.search(before))


def _rule(entity_type: str, pattern: str, confidence: float, evidence: str, marks: tuple = (DIGIT,), guard=None) -> Rule:
    return Rule(entity_type, pattern, confidence, REGEX_PRIORITY, evidence, marks=marks, guard=guard)


RULES = (
    _rule("EMAIL_ADDRESS", EMAIL, 0.98, "e-mail address", ("@", "[at]", "(at)")),
    _rule("CREDIT_CARD", CARD, 0.9, "card number"),
    _rule("IBAN", IBAN, 0.95, "bank account number"),
    _rule("SSN_NATIONAL_ID", SSN, 0.95, "social security number"),
    _rule("UUID", UUID, 0.99, "unique identifier"),
    _rule("URL", URL, 0.85, "web address", ("://",)),
    _rule("IP_ADDRESS", IP, 0.9, "IP address", (re.compile(r"[0-9]\.[0-9]|[0-9a-fA-F]:"),)),
    _rule("DATE", DATE, 0.92, "date or time"),
    _rule("FINANCIAL_METRIC", METRIC, 0.9, "financial figure"),
    _rule("PHONE_NUMBER", PHONE, 0.88, "phone number", guard=phone_guard),
    _rule("ADDRESS", STREET, 0.8, "street address"),
    _rule("IP_ADDRESS", MAC, 0.95, "hardware address", (":", "-")),
    _rule("SSN_NATIONAL_ID", IMEI, 0.95, "device identity"),
    _rule("SSN_NATIONAL_ID", VIN, 0.95, "vehicle identity", ()),
    _rule("LOCATION", GPS, 0.92, "coordinates", (",",)),
    _rule("MEDICAL_RECORD", BLOOD, 0.95, "blood type", ("blood",)),
)
