"""Detection: all rules over a text column, in one pass and without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions.matching import Reader, Rule, rule_spans
from spanveil.rules import context, labels, lines, names, regex, secret

#: The detectors that run by default, in the order that decides ties.
DEFAULT: tuple[Rule | Reader, ...] = (*secret.RULES, *regex.RULES, *context.RULES, labels.READER, lines.READER, names.READER)


def candidates(text: Column, rules: tuple[Rule | Reader, ...] = DEFAULT) -> Column:
    """array<SPAN> of all rules' matches; blank texts have none."""
    return rule_spans(text, rules)


def detect(docs: DataFrame, rules: tuple[Rule | Reader, ...] = DEFAULT, text: str = "text") -> DataFrame:
    """``docs`` with a column ``candidates``."""
    return docs.withColumn("candidates", candidates(F.col(text), rules))


def detected_values(docs: DataFrame, rules: tuple[Rule | Reader, ...], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, start, end, entity_type, value), a row for each match of ``rules``."""
    found = detect(docs.select(id_col, text), rules, text).select(id_col, F.explode("candidates").alias("s"))
    return found.select(id_col, "s.start", "s.end", "s.entity_type", F.col("s.text").alias("value"))
