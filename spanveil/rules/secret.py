"""Rules for credentials.

A key keeps its name; only its value is found. Names of form fields, labels and
counters (passwordField, tokenCount) are no secrets, nor are the bare words in
prose: a value in a sentence must hold a digit or a sign.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from spanveil.functions.matching import B0, Reader, Rule
from spanveil.types import SECRET_PRIORITY

# Shapes of credentials. Runs are possessive: values of any length are taken whole, in linear time.
CONNECTION = r"(?i)(?:mongodb(?:\+srv)?|postgres(?:ql)?|mysql2?|rediss?)://[^\s\"'<>]+"
PEM = r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----(?:(?!-----END )[\s\S])*+-----END (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"
KEY = (
    rf"{B0}(?:sk-[A-Za-z0-9_-]{{8,}}+|AKIA[0-9A-Z]{{16}}(?![0-9A-Z])|gh[pousr]_[A-Za-z0-9]{{36,}}+"
    r"|(?:sk|rk|pk)_(?:live|test)_[0-9A-Za-z]{8,}+|(?:ck|cs|tok|whsec)_[0-9A-Za-z_]{8,}+)"
)
JWT = rf"{B0}eyJ[A-Za-z0-9_-]{{5,}}+\.[A-Za-z0-9_-]{{5,}}+\.[A-Za-z0-9_-]{{5,}}+"
BEARER = r"(?i)(?<![A-Za-z0-9_])Bearer\s{1,8}([A-Za-z0-9_.+/=-]{8,}+)"
_NAME = r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]++)[\"']?\s{0,8}[:=]\s{0,8}"
ASSIGNED_PASSWORD = _NAME + r"[\"']?([^\s\"';,}}\])\[]{3,}+)"
ASSIGNED_KEY = _NAME + r"[\"']([^\s\"']{6,}+)[\"']"
BARE_KEY = _NAME + r"(?![\"'\[])([^\s\"';,}}\])\[(]{6,}+)(?!\s*[(\[])"
SAID = (
    r"(?i)(?<![A-Za-z0-9_])(?:password|passwd|pwd|passcode|pin)\s++(?:is\s++now|is|was\s++changed\s++to|changed\s++to|set\s++to)\s++[\"']?"
    r"([^\s\"';,]{3,}+)"
)
SET_TO = r"(?i)(?<![A-Za-z0-9_])(?:set\s++it\s++to|changed\s++it\s++to|new\s++value\s++is)\s++[\"']?([^\s\"';,]{6,}+)"
COMMAND = re.compile(rf"{B0}(?:mysql|psql|mysqldump|mongo|redis-cli|sshpass)(?![A-Za-z0-9_])")
OPTION = re.compile(r"\s-p(\S{4,}+)")
USER_URL = r"(?i)(?<![A-Za-z0-9_])https?://[^\s/:@<>'\"]++:[^\s/@<>'\"]++@[^\s<>'\"]+"
ORDER = r"#ORD-[A-Za-z0-9-]{3,}+"
# Parts of names that hold passwords or keys, and of names that don't.
_PASSWORDS = re.compile(r"(?i)password|passwd|pwd|dbpass|credential")
_KEYS = re.compile(r"(?i)api[_-]?key|access[_-]?token|auth[_-]?token|private[_-]?key|secret[_-]?key|token|secret")
_FIELDS = re.compile(r"(?:Field|Element|Input|Selector|Label|Text|Count|Total|List|Length|Name|Type|Id|Icon|Button|Form)(?![a-z])")


def _named(parts: re.Pattern):
    return lambda text, m, group: bool(parts.search(m.group(1))) and not _FIELDS.search(m.group(1))


def _has(*classes: str):
    """The value has a character of each class; its closing sentence mark isn't looked at."""
    wanted = [re.compile(c) for c in classes]
    return lambda text, m, group: all(w.search(m.group(group).rstrip(".!?")) for w in wanted)


def _rule(entity_type: str, pattern: str, confidence: float, evidence: str, marks: tuple, groups: tuple[int, ...] = (0,), guard=None) -> Rule:
    return Rule(entity_type, pattern, confidence, SECRET_PRIORITY, evidence, groups, detector="secret", marks=marks, guard=guard)


def _bare_key(text: str, m: re.Match, group: int) -> bool:
    """A key without quotes has letters and digits, or is very long; calls, addresses and numbers are none."""
    value = m.group(group).rstrip(".!?")
    mixed = bool(re.search("[0-9]", value) and re.search("[A-Za-z]", value))
    return _named(_KEYS)(text, m, group) and "://" not in value and (mixed or len(value) >= 24)


def _options(text: str) -> Iterator[tuple]:
    """Passwords given to a command on its line, however far behind it."""
    if " -p" not in text and "\t-p" not in text:
        return
    at = 0
    for line in text.split("\n"):
        if "-p" in line and (command := COMMAND.search(line)):
            for m in OPTION.finditer(line, command.end()):
                if re.search("[0-9A-Z]", m.group(1)):
                    yield at + m.start(1), at + m.end(1), "PASSWORD", 0.95, SECRET_PRIORITY, "password option", None
        at += len(line) + 1


RULES = (
    _rule("CONNECTION_STRING", CONNECTION, 0.99, "database address", ("://",)),
    _rule("SOURCE_CODE_SECRET", PEM, 0.99, "private key block", ("-----begin ",)),
    _rule("API_KEY", KEY, 0.99, "key with a provider's prefix", ("sk-", "akia", "gh", "k_", "tok_", "whsec_", "cs_")),
    _rule("JWT_TOKEN", JWT, 0.99, "signed token", ("eyj",)),
    _rule("JWT_TOKEN", BEARER, 0.97, "bearer token", ("bearer",), (1,), _has("[0-9]")),
    _rule("PASSWORD", ASSIGNED_PASSWORD, 0.97, "assigned password", ("passw", "pwd", "dbpass", "credential"), (2,), _named(_PASSWORDS)),
    _rule("API_KEY", ASSIGNED_KEY, 0.96, "assigned key or token", ("key", "token", "secret"), (2,), _named(_KEYS)),
    _rule("API_KEY", BARE_KEY, 0.95, "assigned key or token without quotes", ("key", "token", "secret"), (2,), _bare_key),
    _rule("PASSWORD", SAID, 0.95, "password in a sentence", ("passw", "pwd", "passcode", "pin"), (1,), _has("[0-9!@#$%^&*]")),
    _rule("PASSWORD", SET_TO, 0.9, "value in a sentence", ("set", "changed", "value"), (1,), _has("[0-9]", "[A-Za-z]")),
    Reader("secret", _options),
    _rule("URL", USER_URL, 0.98, "address with a password", ("://",)),
    _rule("CUSTOMER_ID", ORDER, 0.9, "order number", ("#ord-",)),
)
