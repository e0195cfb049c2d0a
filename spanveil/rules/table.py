"""Rules kept as a table: checked on the driver, compiled once in each worker.

A row is (rule_id, name, entity_type, pattern, confidence, priority, enabled,
always_mask). Rules are code that people write, so their number is bounded and they
go to every task with the plan; a table of more than MOST rows is refused.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.functions.matching import Rule
from spanveil.types import MANUAL_PRIORITY, REGEX_PRIORITY

COLUMNS = "rule_id string, name string, entity_type string, pattern string, confidence double, priority int, enabled boolean, always_mask boolean"
MOST = 10_000
#: A repetition of a group that repeats something itself, such as (a+)+, may take time without end.
_NESTED = re.compile(r"(?<!\\)[*+}][^()|]*\)(?:[*+]|\{\d+,)(?!\+)")


def problem_with(entity_type: str | None, pattern: str | None) -> str | None:
    """Why a rule can't be used, or null."""
    if not entity_type or not re.fullmatch(r"[A-Z][A-Z0-9_]*", entity_type):
        return "the entity type isn't written in capitals, digits and underscores"
    if not pattern:
        return "no pattern"
    try:
        compiled = re.compile(pattern)
    except re.error as e:
        return f"the pattern can't be read: {e}"
    if compiled.search(""):
        return "the pattern matches the empty text"
    if _NESTED.search(pattern):
        return "a repetition of a repetition may take time without end; make the inner one possessive"
    return None


def checked_rules(table: DataFrame) -> DataFrame:
    """``table`` with ``problem``: null for rules that can be used."""
    return table.withColumn("problem", F.udf(problem_with, "string")("entity_type", "pattern"))


def rules_of(table: DataFrame) -> tuple[Rule, ...]:
    """The rules that are switched on and have no problem, in the order of rule_id; of equal ids the last pattern's.

    A rule of ``always_mask`` wins over every other rule, as a choice by hand does.
    """
    usable = checked_rules(table).where("coalesce(enabled, true) and problem is null")
    rows = usable.orderBy("rule_id", "pattern").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} rules")
    own = {r.rule_id if r.rule_id is not None else (None, k): r for k, r in enumerate(rows)}
    return tuple(
        Rule(r.entity_type, r.pattern, 1.0 if r.confidence is None else r.confidence, MANUAL_PRIORITY if r.always_mask else REGEX_PRIORITY if r.priority is None else r.priority, r.name or r.rule_id or "own rule", detector="rules")
        for r in own.values()
    )


def rule_row(spark: SparkSession, rule_id: str, entity_type: str, pattern: str, name: str | None = None, confidence: float = 1.0, priority: int = REGEX_PRIORITY, always_mask: bool = False) -> DataFrame:
    """A table of one rule, switched on."""
    return spark.createDataFrame([(rule_id, name, entity_type, pattern, confidence, priority, True, always_mask)], COLUMNS)


def with_rule(table: DataFrame, rule: DataFrame) -> DataFrame:
    """``table`` with ``rule`` in the place of one with the same id."""
    return table.join(F.broadcast(rule.select("rule_id")), "rule_id", "left_anti").select(*table.columns).unionByName(rule)  # one row


def toggled(table: DataFrame, rule_id: str) -> DataFrame:
    """``table`` with a rule switched off if it was on, and on if it was off."""
    flipped = F.when(F.col("rule_id") == rule_id, ~F.coalesce("enabled", F.lit(True))).otherwise(F.col("enabled"))
    return table.withColumn("enabled", flipped)


def without_rule(table: DataFrame, rule_id: str) -> DataFrame:
    return table.where(F.col("rule_id").isNull() | (F.col("rule_id") != rule_id))
