"""Resolution of overlapping candidates, as folds over an array in the same row.

Candidates are taken by priority, confidence, place and length. One that overlaps
a span taken before merges with it, gives way or replaces it; at the end a span
that lies in a longer one, or overlaps it, is left out. So the result is disjoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions.spans import let, overlap, staged
from spanveil.types import COMPATIBLE, MANUAL_PRIORITY, SPAN, are_compatible, is_container

# Characters that a value neither begins nor ends with.
EDGE = r"[\s,.;:!?'\"()\[\]{}<>“”‘’`]"


def _with(span: Column, **changed: Column) -> Column:
    names = [part.partition(":")[0] for part in SPAN.removeprefix("struct<").removesuffix(">").split(",")]
    return F.struct(*[changed.get(n, span[n]).alias(n) for n in names]).cast(SPAN)


def trimmed(text: Column, span: Column) -> Column:
    """The span without punctuation and white space at its edges and without a possessive."""
    value = F.substring(text, span["start"] + 1, span["end"] - span["start"])

    def cut(value: Column) -> Column:
        left = F.regexp_replace(value, rf"^{EDGE}+", "")
        right = F.regexp_replace(F.regexp_replace(left, rf"{EDGE}+\z", ""), r"(?i)['’]s\z", "")
        right = F.regexp_replace(right, rf"{EDGE}+\z", "")
        return F.struct((span["start"] + F.length(value) - F.length(left)).alias("start"), right.alias("text"))

    return let(let(value, cut), lambda c: _with(span, start=c["start"].cast("int"), end=(c["start"] + F.length(c["text"])).cast("int"), text=c["text"]))


def _order(a: Column, b: Column) -> Column:
    """A comparison of two candidates for array_sort."""

    def first(*rules: tuple[Column, Column]) -> Column:
        out = F.lit(0)
        for before, after in reversed(rules):
            out = F.when(before, -1).when(after, 1).otherwise(out)
        return out

    size = lambda x: x["end"] - x["start"]
    return first(
        (a["priority"] > b["priority"], a["priority"] < b["priority"]),
        (a["confidence"] > b["confidence"], a["confidence"] < b["confidence"]),
        (a["start"] < b["start"], a["start"] > b["start"]),
        (size(a) > size(b), size(a) < size(b)),
        (a["seq"] < b["seq"], a["seq"] > b["seq"]),
    )


def resolve_spans(text: Column, found: Column, pairs: tuple[tuple[str, str], ...] = COMPATIBLE) -> Column:
    """array<SPAN>: disjoint, in the order of their place."""
    ready = F.filter(F.transform(F.array_sort(found, _order), lambda s: trimmed(text, s)), lambda s: s["start"] < s["end"])
    inside = lambda a, b: (a["start"] >= b["start"]) & (a["end"] <= b["end"])
    size = lambda x: x["end"] - x["start"]

    def merged(old: Column, new: Column) -> Column:
        lead = old["priority"] >= new["priority"]
        pick = lambda n: F.when(lead, old[n]).otherwise(new[n])
        both = _with(
            old,
            start=F.least(old["start"], new["start"]),
            end=F.greatest(old["end"], new["end"]),
            **{n: pick(n) for n in ("entity_type", "priority", "detector", "seq")},
            confidence=F.greatest(old["confidence"], new["confidence"]),
            evidence=F.concat_ws(" | ", old["evidence"], new["evidence"]),
            prefix=F.coalesce(pick("prefix"), old["prefix"], new["prefix"]),
        )
        return trimmed(text, both)

    def meet(old: Column, new: Column) -> Column:
        old_holds, new_holds = is_container(old["entity_type"]), is_container(new["entity_type"])
        keeps = old_holds & (~new_holds | (size(old) >= size(new))) & inside(new, old)
        takes = new_holds & (~old_holds | (size(new) >= size(old))) & inside(old, new)
        wins = takes | (~are_compatible(old["entity_type"], new["entity_type"], pairs) & (new["priority"] > old["priority"]))
        joins = are_compatible(old["entity_type"], new["entity_type"], pairs)
        return F.when(keeps, old).when(takes, new).when(joins, merged(old, new)).when(wins, new).otherwise(old)

    def take(done: Column, new: Column) -> Column:
        changed = lambda at: F.transform(done, lambda old, i: F.when(i == at - 1, meet(old, new)).otherwise(old))
        at = F.array_position(F.transform(done, lambda old: overlap(old, new)), True).cast("int")
        return let(at, lambda at: F.when(at == 0, F.concat(done, F.array(new))).otherwise(changed(at)))

    none = F.array().cast(f"array<{SPAN}>")
    resolved = F.aggregate(ready, none, take)

    def longest(a: Column, b: Column) -> Column:
        return (
            F.when(size(a) > size(b), -1).when(size(a) < size(b), 1).when(a["priority"] > b["priority"], -1).when(a["priority"] < b["priority"], 1)
            .when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)
        )

    apart = F.aggregate(F.array_sort(resolved, longest), none, lambda done, s: F.when(F.exists(done, lambda d: overlap(d, s)), done).otherwise(F.concat(done, F.array(s))))
    return F.array_sort(apart, lambda a, b: (a["start"] - b["start"]).cast("int"))


def apply_overrides(found: Column, overrides: Column, text: Column) -> Column:
    """Candidates after a user's own choices, in their order.

    ``overrides`` is array<struct<start, end, action, entity_type>>: UNMASK removes
    the candidates that overlap it, MASK adds one of the highest priority.
    """

    def choose(done: Column, o: Column) -> Column:
        added = F.struct(
            o["start"].cast("int").alias("start"), o["end"].cast("int").alias("end"), F.coalesce(o["entity_type"], F.lit("CUSTOM_TERM")).alias("entity_type"),
            F.lit(1.0).alias("confidence"), F.lit(MANUAL_PRIORITY).alias("priority"), F.lit("manual").alias("detector"), F.lit("chosen by hand").alias("evidence"),
            F.substring(text, o["start"] + 1, o["end"] - o["start"]).alias("text"), F.lit(None).cast("string").alias("prefix"), F.lit(-1).alias("seq"),
        ).cast(SPAN)
        return F.when(o["action"] == "UNMASK", F.filter(done, lambda s: ~overlap(s, o))).otherwise(F.concat(done, F.array(added)))

    return F.when(overrides.isNull(), found).otherwise(F.aggregate(overrides, found, choose))


def by_lines(overrides: Column, text: Column) -> Column:
    """``overrides`` of which each stands for the lines it runs over: one for each line that isn't blank, without white space at its ends.

    Of overrides that overlap the later holds.
    """

    def lines(o: Column) -> Column:
        pieces = F.split(F.substring(text, o["start"] + 1, o["end"] - o["start"]), "\n", -1)
        before = lambda ps, i: F.aggregate(F.slice(ps, F.lit(1), i), F.lit(0), lambda s, p: s + F.length(p) + 1)

        def part(ps: Column, p: Column, i: Column) -> Column:
            left = F.length(p) - F.length(F.regexp_replace(p, r"^\s+", ""))
            start = o["start"] + before(ps, i) + left
            kept = F.length(F.regexp_replace(p, r"^\s+|\s+\z", ""))
            return F.struct(start.cast("int").alias("start"), (start + kept).cast("int").alias("end"), o["action"].alias("action"), o["entity_type"].alias("entity_type"))

        return let(pieces, lambda ps: F.filter(F.transform(ps, lambda p, i: part(ps, p, i)), lambda x: x["start"] < x["end"]))

    def later(every: Column) -> Column:
        return F.filter(every, lambda o, i: ~F.exists(F.slice(every, i + 2, F.size(every)), lambda p: overlap(o, p)))

    return let(F.flatten(F.transform(overrides, lines)), later)


def resolve(docs: DataFrame, text: str = "text", found: str = "candidates", overrides: str | None = None) -> DataFrame:
    """``docs`` with ``spans`` in the place of its candidates."""
    if overrides:
        docs = staged(docs, **{found: apply_overrides(F.col(found), F.col(overrides), F.col(text))})
    return staged(docs, spans=resolve_spans(F.col(text), F.col(found))).drop(found)
