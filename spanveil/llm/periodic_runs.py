"""Periodic runs of words in documents, found through a run-length grammar of their words.

A run is a stretch of words with smallest period ``q``, at least ``TIMES * q`` and
``LEAST`` words long, that no neighbouring word extends with that period.

Recompression makes the grammar: levels alternate between blocks (repetitions of
one symbol become one symbol) and pairs (symbols fall into two classes, and a symbol
of the first class before one of the second becomes one symbol with it). Where a
symbol begins depends only on the symbols beside it, so equal stretches of text are
compressed alike, and the longest common extension of two places takes a climb and
a descent through the levels, with at most one step aside on each.

For every period the text is probed at places of a grid, the wider the longer the
period, so that no run slips through; that is n * log n probes. Places that look
periodic are extended to both sides with the grammar. Documents are independent:
Spark deals them out, and a task compresses some hundred thousand words at a time,
a longer document by itself.

Defined cases: a null or empty text, or one of white space only, has no words and no
runs; a null id never has words repeated by ``repeated_words``; texts are read whole;
repeated rows give repeated rows; an empty table gives no rows; only the id and text
columns are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from fractions import Fraction
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has so many words and so many periods at least.
LEAST, TIMES = 24, 3
#: So many neighbouring words are compared before the grammar is asked.
_PROBE = 4
#: Words of so many are compressed together, and so many probes made at once.
_WORDS, _PROBES = 200_000, 1_000_000
#: A document's symbols are no further compressed when there are so few.
_TOP = 8
_END = -1
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


class Grammar:
    """Levels of a run-length grammar over ids of words; ``_END`` stands before, between and after the documents."""

    def __init__(self, ids: np.ndarray):
        #: The symbols of each level.
        self.symbols = [ids]
        #: For each step up: the places where the symbols above begin, and of each place the symbol above it.
        self.starts: list[np.ndarray] = []
        self.above: list[np.ndarray] = []
        #: For each step up: were blocks made, or pairs?
        self.blocks: list[bool] = []
        fresh, turn = int(ids.max(initial=0)) + 1, 0
        while np.diff(np.flatnonzero(self.symbols[-1] == _END)).max(initial=0) > _TOP:
            fresh = self._make_blocks(fresh)
            fresh = self._make_pairs(fresh, turn)
            turn += 1

    def _push(self, begins: np.ndarray, names: np.ndarray, blocks: bool) -> None:
        self.starts.append(np.append(np.flatnonzero(begins), len(begins)).astype(np.int32))
        self.above.append((np.cumsum(begins) - 1).astype(np.int32))
        self.symbols.append(names)
        self.blocks.append(blocks)

    def _make_blocks(self, fresh: int) -> int:
        s = self.symbols[-1]
        begins = np.ones(len(s), bool)
        begins[1:] = (s[1:] != s[:-1]) | (s[1:] == _END)
        if begins.all():
            return fresh
        at = np.flatnonzero(begins)
        names, times = s[at].copy(), np.diff(np.append(at, len(s)))
        long = np.flatnonzero(times > 1)
        kinds, of = np.unique((names[long] << 32) | times[long], return_inverse=True)
        names[long] = fresh + of
        self._push(begins, names, True)
        return fresh + len(kinds)

    def _make_pairs(self, fresh: int, turn: int) -> int:
        s = self.symbols[-1]
        mixed = (s + turn * 7919).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        first = (mixed >> np.uint64(61)) & np.uint64(1) == 1
        inside = (s[1:] != _END) & (s[:-1] != _END)
        ways = [inside & (first[:-1] == side) & (first[1:] != side) for side in (True, False)]
        joins = max(ways, key=np.count_nonzero)
        if not joins.any():
            return fresh
        begins = np.ones(len(s), bool)
        begins[1:] = ~joins
        at = np.flatnonzero(begins)
        names = s[at].copy()
        left = np.flatnonzero(joins)
        kinds, of = np.unique((s[left] << 32) | s[left + 1], return_inverse=True)
        names[np.cumsum(begins)[left] - 1] = fresh + of
        self._push(begins, names, False)
        return fresh + len(kinds)

    def extension(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words from i and from j on are equal (``back``: words before i and before j); i < j of one document."""
        a, b = i.astype(np.int64), j.astype(np.int64)
        side = 1 if back else 0  # the symbol at a place, or the one before it
        stopped = np.full(len(a), len(self.starts))
        climbing = np.arange(len(a))
        for level, (starts, above, blocks) in enumerate(zip(self.starts, self.above, self.blocks, strict=True)):
            s = self.symbols[level]
            p, q = a[climbing], b[climbing]
            loose = (starts[above[p]] != p) | (starts[above[q]] != q)
            odd = np.flatnonzero(loose)
            x, y = p[odd], q[odd]
            same = s[x - side] == s[y - side]
            go_x, go_y = self._room(level, x, back), self._room(level, y, back)
            go = np.where(same, np.minimum(go_x, go_y) if blocks else 1, 0)
            p[odd], q[odd] = (x - go, y - go) if back else (x + go, y + go)
            a[climbing], b[climbing] = p, q
            on = np.ones(len(climbing), bool)
            on[odd] = same & ((go_x == go_y) | (not blocks))
            stopped[climbing[~on]] = level
            climbing = climbing[on]
            a[climbing], b[climbing] = above[a[climbing]], above[b[climbing]]
        s = self.symbols[-1]
        while len(climbing):  # _TOP steps at most
            climbing = climbing[s[a[climbing] - side] == s[b[climbing] - side]]
            a[climbing] += 1 - 2 * side
            b[climbing] += 1 - 2 * side
        for level in range(len(self.starts) - 1, -1, -1):
            here = np.flatnonzero(stopped > level)
            x, y = (self.starts[level][z[here]].astype(np.int64) for z in (a, b))
            s = self.symbols[level]
            same = s[x - side] == s[y - side]
            go = np.minimum(self._room(level, x, back), self._room(level, y, back)) if self.blocks[level] else 1
            go = np.where(same, go, 0)
            a[here], b[here] = (x - go, y - go) if back else (x + go, y + go)
        return i - a if back else a - i

    def _room(self, level: int, at: np.ndarray, back: bool) -> np.ndarray:
        """Places from each of ``at`` to the end of its symbol on the level above."""
        starts, above = self.starts[level], self.above[level]
        return at - starts[above[at - 1]] if back else starts[above[at] + 1] - at


def _probes(ids: np.ndarray, first: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) where the next words recur a period later, from a grid that meets every run."""
    periods = np.maximum(n // TIMES, 0) * (n >= LEAST)
    ends = np.cumsum(periods)
    total, done = int(ends[-1]) if len(ends) else 0, 0
    while done < total:
        upto = min(total, done + _PROBES // 4)
        pair = np.arange(done, upto)
        of = np.searchsorted(ends, pair, "right")
        q = pair - (ends[of] - periods[of]) + 1
        gap = np.maximum((TIMES - 1) * q, LEAST - q) - (_PROBE - 1)
        points = np.maximum((n[of] - q - _PROBE) // gap + 1, 0)
        made = np.cumsum(points)
        begin = 0
        while begin < len(pair):
            end = max(begin + 1, int(np.searchsorted(made, (made[begin - 1] if begin else 0) + _PROBES, "right")))
            k = points[begin:end]
            row = np.repeat(np.arange(begin, end), k)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
            at, period = first[of[row]] + nth * gap[row], q[row]
            for more in range(_PROBE):
                same = ids[at + more] == ids[at + more + period]
                at, period = at[same], period[same]
            if len(at):
                yield at, period
            begin = end
        done = upto


def find_runs(ids: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and period, of documents with n words each from ``first`` on in ``ids``."""
    grammar, found = None, [np.zeros((3, 0), np.int64)]
    for at, period in _probes(ids, first, n):
        grammar = grammar or Grammar(ids)
        start = at - grammar.extension(at, at + period, back=True)
        length = at + grammar.extension(at, at + period) + period - start
        long = length >= np.maximum(LEAST, TIMES * period)
        found.append(np.unique(np.array([start[long], length[long], period[long]]), axis=1))
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, start))  # a multiple of a period finds the same stretch
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def repeated_words(doc_id: int | None, words: list) -> list:
    """Words of one document, of which one in ten (by its id) repeats a stretch up to its end."""
    h, n = crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


_OUT = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, collapsed string"


def _described(doc_id: int | None, words: list[bytes], start: list[int], length: list[int], period: list[int]) -> tuple:
    """The columns of one document; the last is its text without repetitions, in UTF-8."""
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in zip(start, length, period, strict=True))
    kept = words
    if start:
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, np.add(start, period), 1)
        np.add.at(change, np.add(start, length), -1)
        kept = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    best = max(range(len(start)), key=lambda k: (Fraction(length[k], period[k]), -start[k], -period[k]), default=None)
    top = (None,) * 4 if best is None else (start[best], length[best], period[best], 1000 * length[best] // period[best])
    text = b" ".join(kept)
    return (doc_id, len(words), len(start), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest(), text)


def _rows_of(docs: list[tuple[int | None, list[bytes]]], known: _Ids) -> Iterator[tuple]:
    n = np.array([len(words) for _, words in docs], np.int64)
    first = np.cumsum(n + 1) - n
    ids = np.full(int(n.sum()) + len(n) + 1, _END, np.int64)
    for (_, words), at in zip(docs, first.tolist(), strict=True):
        ids[at : at + len(words)] = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    start, length, period = find_runs(ids, first, n)
    cut_at = np.searchsorted(start, np.append(first, len(ids)))
    for k, (doc_id, words) in enumerate(docs):
        own = slice(cut_at[k], cut_at[k + 1])
        yield _described(doc_id, words, (start[own] - first[k]).tolist(), length[own].tolist(), period[own].tolist())


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", change: Callable[[int | None, list], list] | None = None, texts: bool = True) -> DataFrame:
    """For each row of ``docs``: its number of runs, the strongest one, digests, and the text without repetitions.

    The strongest run has the greatest length/period (ties: smallest start). A word is
    left out of ``collapsed`` when any run contains it after that run's first period.
    ``change(id, words)`` may replace a document's words first. ``texts=False`` leaves
    out ``collapsed``.
    """
    schema = _OUT if texts else _OUT.rpartition(",")[0]
    kinds = {"long": pa.int64(), "string": pa.string()}
    columns = [(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")]
    names = [c for c, _ in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = _Ids(), [], 0

        def done() -> pa.RecordBatch:
            rows = list(zip(*_rows_of(held, known), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(rows, columns, strict=False)], names=names)

        for batch in batches:
            for k in range(batch.num_rows):
                doc_id, body = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                words = _WORD.findall(body)
                words = change(doc_id, words) if change else words
                held.append((doc_id, words))
                size += len(words) + 1
                if size >= _WORDS:
                    yield done()
                    known, held, size = _Ids(), [], 0
        if held:
            yield done()

    body = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return body.mapInArrow(run, schema)
