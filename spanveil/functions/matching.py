"""Rules applied to texts in Arrow batches: one pass over a column, without a shuffle.

A rule is data: a pattern, what its matches are, and literals of which every match
holds one (``marks``); a text without any of them is passed over for the price of a
substring search. Offsets are code points.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from spanveil.types import SPAN

#: Word boundaries of ASCII words, whatever the neighbours' script.
B0, B1 = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: Marks that stand for a class of characters.
DIGIT = re.compile("[0-9]")

Found = tuple[int, int, str, float, int, str, str, str | None]


@dataclass(frozen=True)
class Rule:
    """What a match of ``pattern`` is; the value is the first of ``groups`` that took part.

    ``marks``: lower-case literals, or DIGIT, of which each match holds at least one;
    none if every text must be read. ``guard`` gets the text and the match and may refuse it.
    """

    entity_type: str
    pattern: str
    confidence: float
    priority: int
    evidence: str
    groups: tuple[int, ...] = (0,)
    prefix: str | None = None
    detector: str = "regex"
    marks: tuple = ()
    guard: Callable[[str, re.Match, int], bool] | None = None

    def find(self, text: str, lower: str) -> Iterator[Found]:
        if self.marks and not any(m.search(text) if isinstance(m, re.Pattern) else m in lower for m in self.marks):
            return
        for m in _compiled(self.pattern).finditer(text):
            group = next((g for g in self.groups if m.group(g)), None)
            if group is not None and (self.guard is None or self.guard(text, m, group)):
                yield (*m.span(group), self.entity_type, self.confidence, self.priority, self.detector, self.evidence, self.prefix)


@dataclass(frozen=True)
class Reader:
    """A detector that isn't a pattern: ``read`` gives the (start, end, type, confidence, priority, evidence, prefix) of a text."""

    detector: str
    read: Callable[[str], Iterable[tuple]]

    def find(self, text: str, lower: str) -> Iterator[Found]:
        for start, end, kind, confidence, priority, evidence, prefix in self.read(text):
            yield start, end, kind, confidence, priority, self.detector, evidence, prefix


@lru_cache(maxsize=1000)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace(r"\d", "[0-9]"))


def _name_of(rule: Rule | Reader) -> str:
    return f"{rule.detector}: {rule.evidence}" if isinstance(rule, Rule) else rule.detector


def _as_span(found: Found, text: str, seq: int) -> dict:
    names = ("start", "end", "entity_type", "confidence", "priority", "detector", "evidence", "prefix")
    span = dict(zip(names, found, strict=True))
    if not 0 <= span["start"] < span["end"] <= len(text):
        raise ValueError(f"a span from {span['start']} to {span['end']} in a text of {len(text)} characters")
    return span | {"text": text[span["start"] : span["end"]], "seq": seq}


def findings(text: str, rules: tuple[Rule | Reader, ...]) -> tuple[list[dict], list[str]]:
    """Every rule's matches in ``text`` as SPAN fields, and what failed.

    seq is the rule's place and orders ties. A detector that fails on a text adds
    nothing to it and is named, with its error; the others aren't touched.
    """
    if not text or text.isspace():
        return [], []
    lower, spans, failed = text.lower(), [], []
    for seq, rule in enumerate(rules):
        try:
            spans += [_as_span(found, text, seq) for found in rule.find(text, lower)]
        except Exception as e:  # noqa: BLE001  a detector may be anyone's code
            failed.append(f"{_name_of(rule)}: {type(e).__name__}: {e}")
    return spans, failed


def find_all(text: str, rules: tuple[Rule | Reader, ...]) -> list[dict]:
    """Every rule's matches in ``text``."""
    return findings(text, rules)[0]


def registered(rules: tuple[Rule | Reader, ...], *more: Rule | Reader) -> tuple[Rule | Reader, ...]:
    """``rules`` and ``more``; a Reader takes the place of the one with its name."""
    out = list(rules)
    for rule in more:
        at = next((k for k, old in enumerate(out) if isinstance(rule, Reader) and isinstance(old, Reader) and old.detector == rule.detector), None)
        if at is None:
            out.append(rule)
        else:
            out[at] = rule
    return tuple(out)


_FIELDS = [("start", pa.int32()), ("end", pa.int32()), ("entity_type", pa.string()), ("confidence", pa.float64()), ("priority", pa.int32())]
_FIELDS += [(n, pa.string()) for n in ("detector", "evidence", "text", "prefix")] + [("seq", pa.int32())]
_SPANS = pa.list_(pa.struct(_FIELDS))
#: Rows and characters of a batch whose results are Python objects at once.
SLICE_ROWS, SLICE_CHARS = 256, 1_000_000


def sliced(column: pa.Array, *more: pa.Array) -> Iterator[tuple[pa.Array, ...]]:
    """Columns of one batch in pieces of few rows and characters, so that a worker's memory doesn't follow the batch."""
    begin = size = 0
    for i, length in enumerate(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).tolist()):
        if i > begin and (size + length > SLICE_CHARS or i - begin == SLICE_ROWS):
            yield tuple(x.slice(begin, i - begin) for x in (column, *more))
            begin, size = i, 0
        size += length
    if begin < len(column) or not len(column):
        yield tuple(x.slice(begin) for x in (column, *more))


def in_pieces(run: Callable[..., pa.Array]) -> Callable[[pa.Array], pa.Array]:
    """``run`` over a column of texts piece by piece: only the Arrow results of a batch are held whole."""
    return lambda texts: pa.concat_arrays([run(part) for (part,) in sliced(texts)])


def rule_findings(text: Column, rules: tuple[Rule | Reader, ...]) -> Column:
    """struct<spans: array<SPAN>, failed: array<string>>: all rules' matches, and the detectors that failed on this text."""

    def read(texts: pa.Array) -> pa.Array:
        found = [findings(x.as_py(), rules) for x in texts]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in found], _SPANS), pa.array([x for _, x in found], pa.list_(pa.string()))], names=["spans", "failed"])

    return F.arrow_udf(in_pieces(read), f"struct<spans:array<{SPAN}>,failed:array<string>>").asNondeterministic()(F.coalesce(text, F.lit("")))


def rule_spans(text: Column, rules: tuple[Rule | Reader, ...]) -> Column:
    """array<SPAN> of all rules' matches; blank texts have none."""

    def read(texts: pa.Array) -> pa.Array:
        return pa.array([find_all(x.as_py(), rules) for x in texts], _SPANS)

    # called nondeterministic so that filters on the result don't repeat it
    return F.arrow_udf(in_pieces(read), f"array<{SPAN}>").asNondeterministic()(F.coalesce(text, F.lit("")))
