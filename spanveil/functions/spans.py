"""Finding spans with exact offsets by built-in functions.

``regexp_replace`` puts marks around every match, ``split`` cuts the text at the
marks, and lengths of the pieces add up to offsets. Offsets are code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPEN, _CLOSE, _GROUP = "\u0001", "\u0002", "\u0003"
_FOUND = "array<struct<start:int,end:int,text:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once for each row.

    They come from a generator of one row, which neither merges with projections
    above it nor lets filters on them repeat their expressions below.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def shadow_of(text: Column) -> Column:
    """The text as patterns see it: as long, without the characters that mark matches."""
    return F.translate(text, _OPEN + _CLOSE + _GROUP, "   ")


def matches(shadow: Column, pattern: str | Column, groups: tuple[int, ...] = (0,)) -> Column:
    """array<struct<start, end, text>> of all matches of ``pattern`` in a ``shadow_of`` text.

    ``groups`` are the groups of which the first that took part is the value; a
    group's place is that of its first occurrence in the match.
    """
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    named = "".join(f"${g}" for g in groups if g)
    pieces = F.split(F.regexp_replace(shadow, regex, F.lit(f"{_OPEN}$0{_GROUP}{named}{_CLOSE}")), f"[{_OPEN}{_CLOSE}]", -1)

    def step(state: Column, piece: Column) -> Column:
        inside = state["inside"]
        cut = F.split(piece, _GROUP, -1)
        whole = F.when(inside, F.element_at(cut, 1)).otherwise(piece)
        value = F.when(F.size(cut) > 1, F.element_at(cut, 2)).otherwise(F.lit(""))
        value = F.when(value == "", whole).otherwise(value)
        start = state["at"] + F.instr(whole, value) - 1
        found = F.struct(start.cast("int").alias("start"), (start + F.length(value)).cast("int").alias("end"), value.alias("text"))
        return F.struct(
            (state["at"] + F.length(whole)).cast("int").alias("at"),
            (~inside).alias("inside"),
            F.when(inside & (value != ""), F.concat(state["out"], F.array(found))).otherwise(state["out"]).alias("out"),
        )

    begin = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast(_FOUND).alias("out"))
    every = F.aggregate(pieces, begin, step)["out"]
    some = F.regexp_like(shadow, regex)
    return F.when(some, every).otherwise(F.array().cast(_FOUND))


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])
