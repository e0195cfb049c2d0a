"""Detectors for SQL: a table function with a row for each value that it finds in a text."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spanveil.functions.matching import Reader, Rule, findings

_COLUMNS = "start int, end int, entity_type string, value string, confidence double, priority int, detector string, evidence string, error string"


def register_detector(spark: SparkSession, name: str, rules: tuple[Rule | Reader, ...]) -> None:
    """Make ``rules`` callable as ``SELECT ... FROM docs, LATERAL name(text)``.

    A detector that fails on a text adds a row with its error and no value; the
    others' rows are there all the same. A null or blank text gives no rows.
    """

    class Detector:
        def eval(self, text: str) -> Iterator[tuple]:
            spans, failed = findings(text, rules)
            for s in spans:
                yield (*(s[c] for c in ("start", "end", "entity_type", "text", "confidence", "priority", "detector", "evidence")), None)
            for error in failed:
                yield (*(None,) * 8, error)

    spark.udtf.register(name, F.udtf(Detector, returnType=_COLUMNS))
