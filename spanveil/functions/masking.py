"""Resolving, spreading, numbering and replacing spans of one text, in time that grows with the text.

The same rules as the column expressions of ``operators.resolve`` and
``operators.mask``, for texts with many spans: overlaps are looked up by place and
keys in hash maps, where an expression over an array would scan all for each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from spanveil.functions.matching import Reader, Rule, findings, in_pieces, sliced
from spanveil.types import COMPATIBLE, CONTAINERS, PROPAGATED, SPECIFICITY, UNKNOWN_SPECIFICITY

# Characters that a value neither begins nor ends with.
_EDGE = " \t\n\x0b\f\r,.;:!?'\"()[]{}<>“”‘’`"
_OWNED = re.compile(r"['’][sS]\Z")
_USED = re.compile(r"\[\[([A-Z][A-Z0-9_]*)_([0-9]{3,9})\]\]")
_WORDY = re.compile(r"[A-Za-z0-9_]")
_PAIRS = frozenset(x for a, b in COMPATIBLE for x in ((a, b), (b, a)))
#: Places of a text that are looked up together.
_STRETCH = 64


class Places:
    """Intervals by place: the first added that overlaps another, without looking at all."""

    def __init__(self):
        self.spans: list[dict] = []
        self.at: dict[int, list[int]] = {}

    def _stretches(self, span: dict) -> range:
        return range(span["start"] // _STRETCH, (span["end"] - 1) // _STRETCH + 1)

    def overlapping(self, span: dict) -> int | None:
        found = {k for s in self._stretches(span) for k in self.at.get(s, ())}
        return min((k for k in found if self.spans[k]["start"] < span["end"] and span["start"] < self.spans[k]["end"]), default=None)

    def add(self, span: dict, k: int | None = None) -> None:
        """``span`` as another, or in the place of the k-th."""
        if k is None:
            k = len(self.spans)
            self.spans.append(span)
        else:
            self.spans[k] = span
        for s in self._stretches(span):
            if k not in (here := self.at.setdefault(s, [])):
                here.append(k)


def trimmed(text: str, span: dict) -> dict:
    value = text[span["start"] : span["end"]]
    left = value.lstrip(_EDGE)
    right = _OWNED.sub("", left.rstrip(_EDGE)).rstrip(_EDGE)
    start = span["start"] + len(value) - len(left)
    return span | {"start": start, "end": start + len(right), "text": right}


def _merged(text: str, old: dict, new: dict) -> dict:
    lead, other = (old, new) if old["priority"] >= new["priority"] else (new, old)
    prefix = next((x for x in (lead["prefix"], old["prefix"], other["prefix"]) if x is not None), None)
    both = old | {n: lead[n] for n in ("entity_type", "priority", "detector", "seq")} | {"start": min(old["start"], new["start"]), "end": max(old["end"], new["end"])}
    evidence = " | ".join(x for x in (old["evidence"], new["evidence"]) if x is not None)
    return trimmed(text, both | {"confidence": max(old["confidence"], new["confidence"]), "evidence": evidence, "prefix": prefix})


def _size(span: dict) -> int:
    return span["end"] - span["start"]


def _meet(text: str, old: dict, new: dict) -> dict:
    """What stays of a span taken before and one that overlaps it."""
    holds, holds_new = old["entity_type"] in CONTAINERS, new["entity_type"] in CONTAINERS
    inside = lambda a, b: a["start"] >= b["start"] and a["end"] <= b["end"]
    if holds and (not holds_new or _size(old) >= _size(new)) and inside(new, old):
        return old
    if holds_new and (not holds or _size(new) >= _size(old)) and inside(old, new):
        return new
    if old["entity_type"] == new["entity_type"] or (old["entity_type"], new["entity_type"]) in _PAIRS:
        return _merged(text, old, new)
    return new if new["priority"] > old["priority"] else old


def resolved(text: str, found: list[dict]) -> list[dict]:
    """Disjoint spans in the order of their place."""
    order = sorted(found, key=lambda s: (-s["priority"], -s["confidence"], s["start"], -_size(s), s["seq"]))
    taken = Places()
    for span in (trimmed(text, s) for s in order):
        if span["start"] < span["end"]:
            k = taken.overlapping(span)
            taken.add(span if k is None else _meet(text, taken.spans[k], span), k)
    apart = Places()
    for span in sorted(taken.spans, key=lambda s: (-_size(s), -s["priority"], s["start"])):
        if span["start"] < span["end"] and apart.overlapping(span) is None:
            apart.add(span)
    return sorted(apart.spans, key=lambda s: s["start"])


def spread(text: str, spans: list[dict]) -> list[dict]:
    """``spans`` and all other places where their values stand as whole words, found in one pass over the text."""
    worth: dict[str, dict] = {}
    for s in spans:
        if s["entity_type"] in PROPAGATED and len(s["text"]) >= 3 and (s["entity_type"] != "PERSON_NAME" or " " in s["text"]):
            worth.setdefault(s["text"], s)
    if not worth:
        return spans
    automaton = ahocorasick.Automaton()
    for value in worth:
        automaton.add_word(value, value)
    automaton.make_automaton()
    places: dict[str, list[int]] = {value: [] for value in worth}
    for last, value in automaton.iter(text):
        start, end = last + 1 - len(value), last + 1
        own = places[value]
        whole = not (start and _WORDY.match(text[start - 1])) and not (end < len(text) and _WORDY.match(text[end]))
        if whole and (not own or start >= own[-1] + len(value)):
            own.append(start)
    more = [s | {"start": a, "end": a + len(value), "text": value, "detector": "propagation", "evidence": "value found elsewhere"} for value, s in worth.items() for a in places[value]]
    every = Places()
    for s in spans:
        every.add(s)
    for s in sorted(more, key=lambda s: -_size(s)):
        if every.overlapping(s) is None:
            every.add(s)
    return sorted(every.spans, key=lambda s: s["start"])


def _key(value: str, case_exact: bool) -> str:
    bare = _OWNED.sub("", value.strip(_EDGE))
    return bare if case_exact else bare.lower()


def numbered(text: str, spans: list[dict], case_exact: bool = False) -> list[dict]:
    """Spans with key, type and placeholder; numbers go on after those that the text has already."""
    used: dict[str, int] = {}
    for m in _USED.finditer(text):
        used[m.group(1)] = max(used.get(m.group(1), 0), int(m.group(2)))
    same: dict[str, list[dict]] = {}
    keys = [_key(s["text"], case_exact) for s in spans]
    for key, s in zip(keys, spans, strict=True):
        same.setdefault(key, []).append(s)
    names: dict[str, tuple[str, str, int]] = {}
    for key, own in same.items():  # in the order of their first places
        kind = max(own, key=lambda s: SPECIFICITY.get(s["entity_type"], UNKNOWN_SPECIFICITY))["entity_type"]
        family = (own[0]["prefix"] if own[0]["prefix"] is not None else kind).upper()
        used[family] = number = used.get(family, 0) + 1
        names[key] = kind, f"[[{family}_{number:03d}]]", number
    return [{"start": s["start"], "end": s["end"], "text": s["text"], "entity_type": names[k][0], "key": k, "placeholder": names[k][1], "number": names[k][2]} for k, s in zip(keys, spans, strict=True)]


def _substitute(strategy: str, salt: str) -> Callable[[dict], str]:
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return {
        "REPLACE": lambda p: p["placeholder"],
        "REDACT": lambda p: "[REDACTED]",
        "HASH": lambda p: f"[HASH_{sha(p['text'])[:8]}]",
        "PSEUDONYMIZE": lambda p: f"[PSEUDO_{sha(salt + p['text'])[:12]}]",
    }[strategy]


def masked(text: str, found: list[dict], strategy: str = "REPLACE", salt: str = "", case_exact: bool = False) -> dict:
    """All of it: candidates to masked_text, entities, mapping, and how many spans were detected before they spread."""
    spans = resolved(text, found)
    parts = numbered(text, spread(text, spans), case_exact)
    put, out, at = _substitute(strategy, salt), [], 0
    for p in parts:
        out += [text[at : p["start"]], put(p)]
        at = p["end"]
    return {"detected": len(spans), "entities": parts, "masked_text": "".join(out) + text[at:], "mapping": list({p["placeholder"]: p["text"] for p in parts}.items())}


_PART = [("start", pa.int32()), ("end", pa.int32()), *[(n, pa.string()) for n in ("text", "entity_type", "key", "placeholder")], ("number", pa.int32())]
_MASKED = "detected:int,entities:array<struct<start:int,end:int,text:string,entity_type:string,key:string,placeholder:string,number:int>>,masked_text:string,mapping:map<string,string>"
_KINDS = [("detected", pa.int32()), ("entities", pa.list_(pa.struct(_PART))), ("masked_text", pa.string()), ("mapping", pa.map_(pa.string(), pa.string()))]


def _table(rows: list[dict], more: list[tuple] = ()) -> pa.Array:
    kinds = [*_KINDS, *more]
    return pa.StructArray.from_arrays([pa.array([r[n] for r in rows], kind) for n, kind in kinds], names=[n for n, _ in kinds])


def masked_column(text: Column, found: Column, **options) -> Column:
    """struct<detected, entities, masked_text, mapping> of candidates that are there already."""

    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        parts = sliced(texts, spans)
        return pa.concat_arrays([_table([masked(t, s or [], **options) for t, s in zip(a.to_pylist(), b.to_pylist(), strict=True)]) for a, b in parts])

    return F.arrow_udf(run, f"struct<{_MASKED}>").asNondeterministic()(F.coalesce(text, F.lit("")), found)


def detected_and_masked(text: Column, rules: tuple[Rule | Reader, ...], **options) -> Column:
    """The same with ``failed``, straight from the rules: candidates don't leave the task."""

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            found, failed = findings(text, rules)
            out.append(masked(text, found, **options) | {"failed": failed})
        return _table(out, [("failed", pa.list_(pa.string()))])

    return F.arrow_udf(in_pieces(run), f"struct<{_MASKED},failed:array<string>>").asNondeterministic()(F.coalesce(text, F.lit("")))
