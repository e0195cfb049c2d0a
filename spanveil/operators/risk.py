"""Scores, risk levels, residual risk and verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD, _VALUE = "[a-zA-Z0-9_]", r"[\"']?([^\s\"';,})\[]{3,}+)"


def _assigned(parts: str) -> str:
    """A name with one of the parts, not that of a field, and its value; a name is read once, from its beginning."""
    fields = "Field|Element|Input|Selector|Label|Text|Count|Total|List|Length|Name|Type|Id|Icon|Button|Form"
    return rf"(?<!{_WORD})(?={_WORD}++\s*+[:=])(?={_WORD}*?(?i:{parts}))(?!{_WORD}*?(?:{fields})){_WORD}++\s*+[:=]\s*+{_VALUE}"


# What must not be left in a masked text, with the category that it belongs to.
RESIDUAL = (
    ("API Key", r"(sk-[a-zA-Z0-9_-]{10,}+|ghp_[a-zA-Z0-9]{36}|AKIA[0-9A-Z]{16}|sk_live_[0-9a-zA-Z]{24,}+|sk_test_[0-9a-zA-Z]{24,}+)", 1),
    ("Connection String", r"(?iu)(mongodb(?:\+srv)?://|postgres(?:ql)?://|mysql2?://|rediss?://)[^\s\"'>]+", 1),
    ("Private Key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", 0),
    ("JWT Token", r"(?<![a-zA-Z0-9_-])eyJ[a-zA-Z0-9_-]{10,}+\.eyJ[a-zA-Z0-9_-]{10,}+\.[a-zA-Z0-9_-]{10,}+", 0),
    ("Password", _assigned("password|passwd|pwd|pass|secret|credential|auth"), 1),
    ("Password", rf"(?iu)(?:password|passwd|pwd|secret)(?:\s++is(?=[\s:=])|[\s:=])++(?<=[\s:=]){_VALUE}", 1),
    ("Bearer Token", r"(?iu)Bearer\s++([a-zA-Z0-9_\-.]{8,}+)", 1),
    ("Secret Key", _assigned("api[_-]?key|access[_-]?token|auth[_-]?token|private[_-]?key|secret[_-]?key"), 1),
)


def residual_categories(masked: Column) -> Column:
    """array<string> of the categories still found, in the order of the rules."""
    found = []
    for category, pattern, group in RESIDUAL:
        left = F.filter(F.regexp_extract_all(masked, F.lit(pattern), F.lit(group)), lambda x: ~(x.startswith("[[") & x.endswith("]]")))
        found.append(F.when(F.size(left) > 0, F.lit(category)))
    return F.array_distinct(F.array_compact(F.array(*found)))


def residual_score(categories: Column) -> Column:
    return F.when(F.size(categories) > 0, F.greatest(F.lit(20), 50 - 15 * F.size(categories))).otherwise(99).cast("int")


def privacy_score(n: Column) -> Column:
    """99 without entities; else 20 less for each, between 14 and 99."""
    return F.when(n == 0, 99).otherwise(F.greatest(F.lit(14), F.least(F.lit(99), 100 - 20 * n))).cast("int")


def risk_level(score: Column, unresolved: Column) -> Column:
    return F.when(unresolved, "REVIEW_REQUIRED").when(score < 35, "CRITICAL").when(score < 60, "HIGH").when(score < 80, "MEDIUM").otherwise("LOW")


def verdict(unresolved: Column) -> Column:
    return F.when(unresolved, "REVIEW REQUIRED").otherwise("SAFE TO SHARE")


def shielded_score(categories: Column) -> Column:
    return F.when(F.size(categories) > 0, F.least(F.lit(45), residual_score(categories))).otherwise(99).cast("int")


def summary(entities: Column) -> Column:
    """Counts by type: ``✓ 2 EMAIL_ADDRESS, ✓ 1 IBAN``."""
    types = F.array_sort(F.array_distinct(F.transform(entities, lambda e: e["entity_type"])))
    return F.array_join(F.transform(types, lambda t: F.concat(F.lit("✓ "), F.size(F.filter(entities, lambda e: e["entity_type"] == t)).cast("string"), F.lit(" "), t)), ", ")
