"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Folding maps letters that look like Latin ones to these, and digits and signs
that stand for letters inside words to the letters, then lower-cases and turns
everything but letters into spaces. The lexicon has whole words and beginnings of
words with weights; an automaton finds all of them in one pass over a text. Each
word counts with its heaviest entry, unless an exception phrase covers it. The sum
of the weights, normalised by the number of words, gives the score.

Everything is learned from labelled rows: the entries and weights from their
counts in toxic and other documents, exception phrases from two-word contexts in
which entries occur in documents that are not toxic, and the two parameters of the
score by logistic regression, where each half of the rows is scored with the
lexicon of the other half.

Defined cases: a null or empty text has no words and the lowest score of all; a
text of any length is read whole; without labelled rows of both kinds every score
is the share of toxic rows (0 without rows); rows with a null label or id don't
count as labelled; of several labels for an id the highest counts; repeated rows
are scored alike; an empty table gives no rows; other columns are not read, but a
column with the score's name is replaced by it.

Only the number of labelled rows to learn from is bounded (SAMPLE); the lexicon
holds whatever has enough evidence in them.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents to learn from, at most (those with the smallest hash).
SAMPLE = 20_000
#: Clean texts that an exception phrase must occur in, and those of a half of the sample.
SPARED, SPARED_HALF = 5, 3
#: Lengths of the beginnings of words that can be entries.
BEGINNINGS = range(3, 9)
#: An entry needs this much evidence (log-likelihood ratio), and its documents are mostly toxic.
EVIDENCE, PRECISION = 12.0, 0.6

# Letters of other scripts that look like Latin letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ո": "n", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "А": "a", "В": "b", "Е": "e", "К": "k", "М": "m", "Н": "h", "О": "o", "Р": "p", "С": "c", "Т": "t", "У": "y", "Х": "x", "І": "i", "Ј": "j", "Ѕ": "s",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "τ": "t", "ι": "i", "κ": "k", "υ": "u", "ε": "e", "Α": "a", "Β": "b", "Ε": "e", "Η": "h", "Ι": "i", "Κ": "k", "Μ": "m", "Ν": "n", "Ο": "o", "Ρ": "p", "Τ": "t", "Υ": "y", "Χ": "x",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ⅼ": "l", "ʟ": "l", "ɪ": "i",
}
# Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}

_FULL_WIDTH = {chr(0xFF21 + i): chr(0x61 + i) for i in range(26)} | {chr(0xFF41 + i): chr(0x61 + i) for i in range(26)}
_INVISIBLE = dict.fromkeys("­​‌‍⁠﻿", "")
_SAME = str.maketrans(HOMOGLYPHS | _FULL_WIDTH | _INVISIBLE)
_STANDS = str.maketrans(SUBSTITUTES)
_MIXED = re.compile(r"[^\W_]*[0-9@$!|+][^\W_]+|[^\W\d_]+[0-9@$!|+][\w@$!|+]*")
_SIGN_END = re.compile(r"[@$!|+]+$")
_OTHER = re.compile(r"[\W\d_]+")
_NEEDED = re.compile(r"[0-9@$!|+]")


def _substitute(match: re.Match) -> str:
    word = _SIGN_END.sub("", match.group())  # signs that follow a word are no letters
    return word.translate(_STANDS) if any(map(str.isalpha, word)) else word


def fold(text: str) -> str:
    """Lower-case words of Latin-looking letters, each with a space before and after."""
    if not text.isascii():
        text = text.translate(_SAME)
    if _NEEDED.search(text):
        text = _MIXED.sub(_substitute, text)
    return f" {_OTHER.sub(' ', text.lower()).strip()} "


@dataclass(frozen=True)
class Lexicon:
    """Entries (" word " or " beginning") with weights, exception phrases (" two words "), and the score's parameters."""

    entries: tuple[tuple[str, float], ...] = ()
    exceptions: tuple[str, ...] = ()
    slope: float = 0.0
    base: float = -20.0
    _ready: dict = field(default_factory=dict, compare=False, repr=False)

    def __getstate__(self):
        return {"entries": self.entries, "exceptions": self.exceptions, "slope": self.slope, "base": self.base, "_ready": {}}

    def __setstate__(self, state):
        self.__dict__.update(state)

    def automaton(self):
        if "a" not in self._ready:
            import ahocorasick

            a = ahocorasick.Automaton()
            for entry, weight in self.entries:
                a.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                a.add_word(phrase, (len(phrase), None))
            if len(a):
                a.make_automaton()
            self._ready["a"] = a
        return self._ready["a"]

    def hits(self, folded: str) -> dict[int, float]:
        """The weight of each word (by the place of the space before it) that an entry matches."""
        a = self.automaton()
        found: dict[int, float] = {}
        if not len(a):
            return found
        spared: list[tuple[int, int]] = []
        for end, (length, weight) in a.iter(folded):
            start = end - length + 1
            if weight is None:
                spared.append((start, end))
            elif weight > found.get(start, 0.0):
                found[start] = weight
        for start, end in spared:
            for at in [x for x in found if start <= x < end]:
                del found[at]
        return found

    def density(self, folded: str) -> float:
        """Summed weights per word, where a short text counts as 20 words, on a log scale."""
        total = sum(self.hits(folded).values())
        return float(np.log1p(100.0 * total / max(20, folded.count(" ") - 1)))

    def score(self, folded: str) -> float:
        return float(1 / (1 + np.exp(-(self.base + self.slope * self.density(folded)))))


def _candidates(folded: str) -> set[str]:
    words = set(folded.split())
    found = {f" {w} " for w in words if len(w) > 2}
    for w in words:
        found.update(f" {w[:k]}" for k in BEGINNINGS if len(w) >= k)
    return found


def _sample(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text: str, label: str) -> DataFrame:
    """(text, toxic, fold): at most SAMPLE labelled texts, each text once."""
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("_toxic"))
    rows = docs.where(learn).select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col).alias("_order"))
    chosen = rows.join(marks, "doc_id").orderBy("_order").limit(SAMPLE).select(F.col("doc_id").alias("_id"), "_toxic")
    found = docs.where(learn).select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id")  # SAMPLE rows of two numbers
    found = found.groupBy("text").agg(F.max("_toxic").alias("toxic"))
    return found.select("text", (F.col("toxic") > 0).cast("int").alias("toxic"), F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("fold"))


def _counts(sample: DataFrame) -> DataFrame:
    """(entry, t0, c0, t1, c1): toxic and other texts of each half that have the entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(seen: dict) -> pa.RecordBatch:
            columns = [pa.array(list(seen)), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in range(4))]
            return pa.RecordBatch.from_arrays(columns, names=["entry", "t0", "c0", "t1", "c1"])

        seen: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
        for batch in batches:
            for text, toxic, half in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for entry in _candidates(fold(text)):
                    seen[entry][2 * half + (not toxic)] += 1
                if len(seen) > 300_000:
                    yield out(seen)
                    seen.clear()
        if seen:
            yield out(seen)

    partial = sample.mapInArrow(run, "entry string, t0 long, c0 long, t1 long, c1 long")
    return partial.groupBy("entry").agg(*[F.sum(c).alias(c) for c in ("t0", "c0", "t1", "c1")])


def _choose(counted: DataFrame, totals: dict[tuple[int, int], int], halves: tuple[int, ...]) -> tuple[tuple[str, float], ...]:
    """The entries with enough evidence in these halves; the weight is a shrunken log ratio of rates."""
    t, c = (sum((F.col(f"{k}{h}") for h in halves), F.lit(0)) for k in "tc")
    toxic, clean = (max(1, sum(totals.get((h, k), 0) for h in halves)) for k in (1, 0))
    share = toxic / (toxic + clean)
    term = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    evidence = 2 * (term(F.col("t"), (F.col("t") + F.col("c")) * share) + term(F.col("c"), (F.col("t") + F.col("c")) * (1 - share)))
    weight = F.log(((F.col("t") + 0.5 * share) / toxic) / ((F.col("c") + 0.5 * (1 - share)) / clean))
    rows = counted.select("entry", t.alias("t"), c.alias("c")).where(F.col("t") >= PRECISION * (F.col("t") + F.col("c")))
    rows = rows.withColumn("g", evidence).where(F.col("g") >= EVIDENCE).orderBy(F.desc("g"), "entry")
    shrunk = weight * F.col("g") / (F.col("g") + 40)  # an entry with little evidence weighs little
    return _specific([(r.entry, r.t, float(r.w)) for r in rows.select("entry", "t", shrunk.alias("w")).collect() if r.w > 0])


def _specific(found: list[tuple[str, int, float]]) -> tuple[tuple[str, float], ...]:
    """Without beginnings whose toxic texts nearly all have one and the same longer entry."""
    support = {entry: t for entry, t, _ in found}
    covered = set()
    for entry, t, _ in found:
        for k in range(3, len(entry)):
            if entry[:k] in support and t >= 0.9 * support[entry[:k]]:
                covered.add(entry[:k])
    return tuple((entry, weight) for entry, _, weight in found if entry not in covered)


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and base of a logistic regression with a small penalty, by Newton's method."""
    a, beta = np.column_stack([x, np.ones(len(x))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2), a.T @ (y - p) - 1e-2 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def learn_lexicon(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> Lexicon:
    """A lexicon from the labelled rows of ``docs`` for which ``learn`` holds.

    What reaches the driver is bounded: entries, exceptions, and a number for each
    row of the sample.
    """
    sample = _sample(docs, labels, learn, id_col, text, label).persist()
    try:
        totals = {(r.fold, r.toxic): r["count"] for r in sample.groupBy("fold", "toxic").count().collect()}
        rows, toxic = sum(totals.values()), sum(v for (_, k), v in totals.items() if k)
        if not toxic or toxic == rows:
            share = toxic / rows if rows else 0.0
            return Lexicon(base=float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
        counted = _counts(sample).where(F.col("t0") + F.col("t1") > 1).persist()
        whole, *halves = (_choose(counted, totals, h) for h in ((0, 1), (0,), (1,)))
        counted.unpersist()
        exceptions, *of_halves = _exceptions(sample, Lexicon(whole))
        other = [Lexicon(halves[1], of_halves[1]), Lexicon(halves[0], of_halves[0])]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = [other[h].density(fold(t)) for t, h in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column(1)], names=["x", "y"])

        seen = sample.mapInArrow(run, "x double, y int").toArrow()
        slope, base = _fit(seen.column("x").to_numpy(), seen.column("y").to_numpy())
        return Lexicon(whole, exceptions, max(slope, 0.0), base)
    finally:
        sample.unpersist()


def _exceptions(sample: DataFrame, lexicon: Lexicon) -> tuple[tuple[str, ...], ...]:
    """Two-word phrases with an entry that occur in several clean texts and in no toxic one: of all texts and of each half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
        for batch in batches:
            for text, toxic, half in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                folded, here = fold(text), set()
                for at in lexicon.hits(folded):
                    end = folded.index(" ", at + 1)
                    before, after = folded.rfind(" ", 0, at), folded.find(" ", end + 1)
                    here.update(folded[a : b + 1] for a, b in ((before, end), (at, after)) if a >= 0 and b > 0)
                for phrase in here:
                    seen[phrase][2 * half + (not toxic)] += 1
        columns = [pa.array(list(seen), pa.string()), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in range(4))]
        yield pa.RecordBatch.from_arrays(columns, names=["phrase", "t0", "c0", "t1", "c1"])

    counted = sample.mapInArrow(run, "phrase string, t0 long, c0 long, t1 long, c1 long")
    counted = counted.groupBy("phrase").agg(*[F.sum(c).alias(c) for c in ("t0", "c0", "t1", "c1")])
    some = counted.where(f"(t0 = 0 or t1 = 0) and c0 + c1 >= {SPARED_HALF}").orderBy("phrase").collect()  # phrases of the bounded sample
    return (
        tuple(r.phrase for r in some if not r.t0 + r.t1 and r.c0 + r.c1 >= SPARED),
        tuple(r.phrase for r in some if not r.t0 and r.c0 >= SPARED_HALF),
        tuple(r.phrase for r in some if not r.t1 and r.c1 >= SPARED_HALF),
    )


@lru_cache(maxsize=2)
def _kept(lexicon: Lexicon) -> Lexicon:
    """The same object for equal lexicons, so that a worker builds its automaton once."""
    return lexicon


def score_toxicity(docs: DataFrame, lexicon: Lexicon, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a column ``score`` (0 to 1), which replaces one of that name."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        ready = _kept(lexicon)
        return pa.array([ready.score(fold(x.as_py())) for x in texts], pa.float64())

    return docs.withColumn(score, scored(F.coalesce(F.col(text), F.lit(""))))


def reject_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score less than ``threshold``, with their columns."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text"))
    return score_toxicity(rows, lexicon, "_text", "_score").where(F.col("_score") < threshold).select("_row.*")
