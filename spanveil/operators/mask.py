"""Masking: numbered placeholders, spliced into the text in the same row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions.matching import B0, B1
from spanveil.functions.spans import let, matches, overlap, shadow_of, staged
from spanveil.operators.resolve import EDGE
from spanveil.types import PROPAGATED, SPAN, specificity_of

#: What stands for a value: its number, a mark, a digest, or a salted token.
STRATEGIES = ("REPLACE", "REDACT", "HASH", "PSEUDONYMIZE")


def clean_key(value: Column, case_exact: bool = False) -> Column:
    """Values with one key share a placeholder."""
    bare = F.regexp_replace(F.regexp_replace(value, rf"^{EDGE}+|{EDGE}+\z", ""), r"(?i)['’]s\z", "")
    return bare if case_exact else F.lower(bare)


def propagate(text: Column, spans: Column) -> Column:
    """``spans`` and all other places where their values occur as whole words.

    Only values of at least three characters and of the types that are worth it;
    names of persons need two words.
    """
    worth = F.filter(
        spans,
        lambda s: s["entity_type"].isin(*PROPAGATED) & (F.length(s["text"]) >= 3) & ((s["entity_type"] != "PERSON_NAME") | s["text"].contains(" ")),
    )

    def first_of(worth: Column) -> Column:
        return F.filter(worth, lambda s, i: F.array_position(F.transform(worth, lambda o: o["text"]), s["text"]) == i + 1)

    def again(like: Column) -> Column:
        pattern = F.concat(F.lit(B0 + r"\Q"), F.replace(like["text"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E" + B1))
        return F.transform(
            matches(shadow_of(text), pattern),
            lambda m: F.struct(
                m["start"].alias("start"), m["end"].alias("end"), like["entity_type"].alias("entity_type"), like["confidence"].alias("confidence"), like["priority"].alias("priority"),
                F.lit("propagation").alias("detector"), F.lit("value found elsewhere").alias("evidence"), m["text"].alias("text"), like["prefix"].alias("prefix"), like["seq"].alias("seq"),
            ).cast(SPAN),
        )

    def joined(more: Column) -> Column:
        more = F.array_sort(more, lambda a, b: ((b["end"] - b["start"]) - (a["end"] - a["start"])).cast("int"))
        every = F.aggregate(more, spans, lambda done, s: F.when(F.exists(done, lambda d: overlap(d, s)), done).otherwise(F.concat(done, F.array(s))))
        return F.array_sort(every, lambda a, b: (a["start"] - b["start"]).cast("int"))

    return F.when(F.size(worth) == 0, spans).otherwise(joined(F.flatten(F.transform(let(worth, first_of), again))))


def placeholders(spans: Column, case_exact: bool = False, first_free: Column | None = None) -> Column:
    """array<struct<start, end, text, entity_type, key, placeholder, number>>, in the order of place.

    A key has one type (the most specific of its spans, the first of equals) and
    one number: keys of one type are numbered in the order of their first place.
    """
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), s["entity_type"].alias("entity_type"), s["prefix"].alias("prefix"), clean_key(s["text"], case_exact).alias("key")))

    def typed(items: Column) -> Column:
        def canonical(s: Column) -> Column:
            same = F.filter(items, lambda o: o["key"] == s["key"])
            first = F.array_position(F.transform(items, lambda o: o["key"]), s["key"]).cast("int")

            def chosen(same: Column) -> Column:
                best = F.array_max(F.transform(same, lambda o: specificity_of(o["entity_type"])))
                return let(best, lambda best: F.element_at(F.filter(same, lambda o: specificity_of(o["entity_type"]) == best), 1)["entity_type"])

            def made(same: Column) -> Column:
                return let(
                    chosen(same),
                    lambda kind: F.struct(*[s[n].alias(n) for n in ("start", "end", "text", "key")], kind.alias("entity_type"), F.upper(F.coalesce(F.element_at(same, 1)["prefix"], kind)).alias("family"), first.alias("first")),
                )

            return let(same, made)

        return F.transform(items, canonical)

    def numbered(items: Column) -> Column:
        def number(s: Column, firsts: Column) -> Column:
            n = F.size(F.filter(firsts, lambda o: (o["family"] == s["family"]) & (o["first"] <= s["first"])))
            n = n if first_free is None else n + F.coalesce(first_free[s["family"]], F.lit(0))
            return let(n, lambda n: F.struct(*[s[c].alias(c) for c in ("start", "end", "text", "entity_type", "key")], F.format_string("[[%s_%03d]]", s["family"], n).alias("placeholder"), n.cast("int").alias("number")))

        return let(F.filter(items, lambda s, i: s["first"] == i + 1), lambda firsts: F.transform(items, lambda s: number(s, firsts)))

    return let(let(keyed, typed), numbered)


def splice(text: Column, parts: Column, put: str = "placeholder") -> Column:
    """``text`` with each part's span replaced; everything else is byte-identical."""
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda s, p: F.struct(F.concat(s["out"], F.substring(text, s["at"] + 1, p["start"] - s["at"]), p[put]).alias("out"), p["end"].cast("int").alias("at"))
    return let(F.aggregate(parts, begin, step), lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def mapping_of(parts: Column) -> Column:
    """map<placeholder, value>: of a placeholder's values the last."""
    names = F.array_distinct(F.transform(parts, lambda p: p["placeholder"]))
    last = lambda n: F.element_at(F.filter(parts, lambda p: p["placeholder"] == n), -1)["text"]
    return F.map_from_arrays(names, F.transform(names, last))


def substitute(strategy: str, salt: str = "") -> callable:
    """What stands for a part's value under a strategy."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    return {
        "REPLACE": lambda p: p["placeholder"],
        "REDACT": lambda p: F.lit("[REDACTED]"),
        "HASH": lambda p: F.concat(F.lit("[HASH_"), F.substring(F.sha2(p["text"], 256), 1, 8), F.lit("]")),
        "PSEUDONYMIZE": lambda p: F.concat(F.lit("[PSEUDO_"), F.substring(F.sha2(F.concat(F.lit(salt), p["text"]), 256), 1, 12), F.lit("]")),
    }[strategy]


def used_numbers(text: Column) -> Column:
    """map<family, highest number> of placeholders that a text already has, so that new ones differ."""
    found = F.regexp_extract_all(text, F.lit(r"\[\[[A-Z][A-Z0-9_]*_\d{3,9}\]\]"), F.lit(0))
    family = lambda x: F.regexp_extract(x, r"^\[\[(.+)_\d+\]\]\z", 1)
    names = F.array_distinct(F.transform(found, family))
    highest = lambda n: F.array_max(F.transform(F.filter(found, lambda x: family(x) == n), lambda x: F.regexp_extract(x, r"_(\d+)\]\]\z", 1).cast("int")))
    return F.map_from_arrays(names, F.transform(names, highest))


def mask(docs: DataFrame, text: str = "text", spans: str = "spans", strategy: str = "REPLACE", salt: str = "", case_exact: bool = False, spread: bool = True) -> DataFrame:
    """``docs`` with masked_text, entities and mapping in the place of its spans."""
    body = F.coalesce(F.col(text), F.lit(""))
    docs = staged(docs, **{spans: propagate(body, F.col(spans))}) if spread else docs
    docs = staged(docs, entities=placeholders(F.col(spans), case_exact, used_numbers(body))).drop(spans)
    parts = F.col("entities")
    if strategy != "REPLACE":
        put = substitute(strategy, salt)
        parts = F.transform("entities", lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), put(p).alias("placeholder")))
    return staged(docs, masked_text=splice(body, parts), mapping=mapping_of(F.col("entities")))
