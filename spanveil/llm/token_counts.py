"""Token counts by a finite-state compilation of a merge tokenizer.

The tokenizer joins the best-scored adjacent pair again and again. Its result for
a prefix is fixed by the last token of that prefix: the token t that ends there,
whose left neighbour (the last token of what precedes t) would not have merged
differently with it. So text can be read from left to right by a deterministic
transducer: a state holds, for each boundary from which a vocabulary piece may
still grow, the last token there and the number of tokens up to it, relative to
the current end; a transition is annotated with the change in the number of
tokens. States and transitions are compiled when first met, into dense tables.

A batch of texts is cut into chunks of equal length that are read side by side.
The white-space mark and characters outside the vocabulary lead to the same state
from anywhere, so a chunk's state map is constant from its first such character
on. Only the head of a chunk depends on what precedes it: chunk maps are composed
by a prefix scan, and heads are read side by side from the states that it gives.

The scores of white-space runs tie; runs of two marks and more are therefore
counted by the tokenizer's own rule (leftmost first), given whether the last mark
stays a token of its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CHUNK = 256
#: Characters that a guessed state is read from.
WARM = 48
#: A part of a batch holds about so many characters.
PART_CHARS = 1_000_000
#: Columns of the dense tables; characters beyond take a slower way.
COLUMNS = 96
#: Rows of the dense tables; when they are full they are emptied. Pages that are not used take no memory.
STATES = 250_000

_UNKNOWN, _MARK = 0, 1
_NONE, _DEAD, _OPEN = 0, 1, 2


class MergeVocabulary:
    """Pieces and scores of a merge tokenizer with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, norm = model.trainer_spec, model.normalizer_spec
        plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
        if spec.model_type != spec.BPE or not spec.byte_fallback or not plain or norm.precompiled_charsmap or spec.treat_whitespace_as_suffix:
            raise ValueError("only merge models with byte fallback, a dummy prefix and no other normalisation are supported")
        if any(p.type in (p.USER_DEFINED, p.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.score = {p.piece: p.score for p in model.pieces if p.type == p.NORMAL}
        if any(MARK in p[1:] and p.strip(MARK) for p in self.score):
            raise ValueError("pieces that span words are not supported")
        self.longest = max(map(len, self.score))
        self.chars = {p for p in self.score if len(p) == 1}
        self.grows = {p[:i] for p in self.score for i in range(1, len(p)) if not p.startswith(MARK * 2)}

    def split(self, word: str) -> list[str]:
        """The pieces of ``word``: best score first, leftmost among equals."""
        parts: list[str | None] = list(word)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-s, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (s := self.score.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, piece = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or parts[i] + parts[j] != piece:
                continue
            parts[i], parts[j] = piece, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (s := self.score.get(parts[left] + parts[right])) is not None:
                    heapq.heappush(heap, (-s, left, parts[left] + parts[right]))
        return [p for p in parts if p is not None]


class CountingTransducer:
    """Compiled on demand; ``count`` gives the tokens of each text."""

    def __init__(self, path: str):
        self.vocabulary = MergeVocabulary(path)
        self.stays: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.runs: dict[int, int] = {0: 0}
        self._empty()

    def _empty(self) -> None:
        # A state: the longest growing suffix and, for each boundary in it, (characters since, last token there,
        # tokens there less tokens here, whether the first token there is the mark alone).
        self.states: list[tuple] = [(), (), ("", ((0, None, 0, False),))]
        self.ids = {self.states[_OPEN]: _OPEN}
        self.next = np.zeros((STATES + PART_CHARS, COLUMNS), np.int32)
        self.emit = np.zeros((STATES + PART_CHARS, COLUMNS), np.int8)
        self.alone = np.zeros(STATES + PART_CHARS, bool)
        self.rare: dict[tuple[int, str], tuple[int, int]] = {}
        self.column = np.zeros(0x110000, np.int16)
        self.column[ord(MARK)] = _MARK
        self.column_chars = ["", MARK]
        self.known = np.zeros(0x110000, bool)
        self.next[_DEAD] = _DEAD
        self.next[_DEAD : _OPEN + 1, _UNKNOWN] = _OPEN
        self.first = self._step(_OPEN, MARK)
        for state in (_DEAD, _OPEN, self.first[0]):
            self._resets(state)

    def _resets(self, state: int) -> None:
        self.next[state, _UNKNOWN] = _OPEN
        self.next[state, _MARK], self.emit[state, _MARK] = self.first

    def _stays(self, left: str | None, right: str) -> bool:
        if (ok := self.whole.get(right)) is None:
            ok = self.whole[right] = self.vocabulary.split(right) == [right]
        if not ok or left is None:
            return ok
        if (ok := self.stays.get((left, right))) is None:
            if len(self.stays) > 500_000:
                self.stays.clear()
            ok = self.stays[left, right] = self.vocabulary.split(left + right) == [left, right]
        return ok

    def _step(self, state: int, char: str) -> tuple[int, int]:
        suffix, ends = self.states[state]
        grown, score = suffix + char, self.vocabulary.score
        for length, last, tokens, alone in ends:
            piece = grown[len(grown) - length - 1 :]
            if piece in score and self._stays(last, piece):
                break
        else:
            raise AssertionError("every known character is a piece")
        now = tokens + 1
        alone = piece == MARK if last is None else alone
        kept = [(n + 1, t, k - now, a) for n, t, k, a in ends if grown[len(grown) - n - 1 :] in self.vocabulary.grows]
        longest = kept[0][0] if kept else 0
        made = (grown[len(grown) - longest :] if longest else "", (*kept, (0, piece, 0, alone)))
        if (to := self.ids.get(made)) is None:
            to = self.ids[made] = len(self.states)
            if to == len(self.alone):
                more = np.zeros_like(self.next[:PART_CHARS])
                self.next, self.emit = np.concatenate([self.next, more]), np.concatenate([self.emit, more.astype(np.int8)])
                self.alone = np.concatenate([self.alone, np.zeros(PART_CHARS, bool)])
            self.states.append(made)
            self.alone[to] = alone
            if to > _OPEN + 1:
                self._resets(to)
        return to, now

    def _columns(self, codes: np.ndarray) -> np.ndarray:
        """The table column of each character; new characters get one while there are any left."""
        fresh = np.unique(codes[~self.known[codes]])
        for code in fresh.tolist():
            self.known[code] = True
            char = chr(code)
            if char in self.vocabulary.chars and char != MARK:
                self.column[code] = len(self.column_chars) if len(self.column_chars) < COLUMNS else -1
                if self.column[code] > 0:
                    self.column_chars.append(char)
                    self.next[_DEAD, self.column[code]] = _DEAD
        return self.column[codes]

    def _read(self, columns: np.ndarray, codes: np.ndarray, state: np.ndarray, emitted: np.ndarray, states: np.ndarray) -> np.ndarray:
        """Read rows of chars (one column for each chunk) from ``state`` on."""
        for t in range(len(columns)):
            column = columns[t]
            to = self.next[state, column]
            change = self.emit[state, column]
            if (slow := (to == _NONE) | (column < 0)).any():
                to, change = to.copy(), change.copy()
                for i in np.flatnonzero(slow).tolist():
                    s, c = int(state[i]), int(column[i])
                    if c < 0:
                        to[i], change[i] = self._rare(s, chr(int(codes[t, i])))
                        continue
                    if self.next[s, c] == _NONE:
                        self.next[s, c], self.emit[s, c] = self._step(s, self.column_chars[c])
                    to[i], change[i] = self.next[s, c], self.emit[s, c]
            state = to
            emitted[t], states[t] = change, to
        return state

    def _rare(self, state: int, char: str) -> tuple[int, int]:
        if state == _DEAD:
            return _DEAD, 0
        if (found := self.rare.get((state, char))) is None:
            found = self.rare[state, char] = self._step(state, char)
        return found

    def _run(self, n: int) -> int:
        """Tokens of n white-space marks in a row."""
        if n not in self.runs:
            if len(self.runs) > 10_000:
                self.runs = {0: 0}
            self.runs[n] = len(self.vocabulary.split(MARK * n))
        return self.runs[n]

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        if len(self.states) > STATES:
            self._empty()
        some = [i for i, x in enumerate(texts) if x]
        out = np.zeros(len(texts), np.int64)
        if not some:
            return out
        joined = "".join(f"{MARK}{texts[i]}" for i in some).replace(" ", MARK)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(texts[i]) + 1 for i in some])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        doc = np.repeat(np.arange(len(some)), lengths)
        mark = codes == ord(MARK)
        begins = np.zeros(len(codes), bool)
        begins[starts] = True
        first = mark & ~(np.concatenate([[False], mark[:-1]]) & ~begins)
        keep = first | ~mark
        run = np.diff(np.append(np.flatnonzero(first), len(codes)))  # characters of each unit
        marks = np.add.reduceat(mark.astype(np.int64), np.flatnonzero(first)) if len(run) else run
        codes, doc, first = codes[keep], doc[keep], first[keep]
        columns = self._columns(codes)
        emitted, states = self._scan(columns, codes)
        emitted = emitted.astype(np.int64)
        unknown = columns == _UNKNOWN
        emitted[unknown] = np.where(codes[unknown] < 0x80, 1, np.where(codes[unknown] < 0x800, 2, np.where(codes[unknown] < 0x10000, 3, 4)))
        at = np.flatnonzero(first)
        for unit in np.flatnonzero(marks > 1).tolist():
            n = int(marks[unit])
            # the state before a reset still tells whether the mark stayed alone
            end = at[unit] + 1
            stop = at[unit + 1] if unit + 1 < len(at) else len(codes)
            while end < stop and not unknown[end]:
                end += 1
            emitted[at[unit]] += self._run(n) - 1 if self.alone[states[end - 1]] else self._run(n - 1)
        out[some] = np.bincount(doc, weights=emitted, minlength=len(some)).astype(np.int64)
        return out

    def _quiet(self, cols: np.ndarray, chars: np.ndarray, state: np.ndarray) -> np.ndarray:
        """The states after reading; what is emitted is not needed."""
        return self._read(cols, chars, state, np.zeros(cols.shape, np.int16), np.zeros(cols.shape, np.int32))

    def _entries(self, cols: np.ndarray, chars: np.ndarray, leaves: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """The state in which each chunk is entered.

        A chunk with a reset has a constant map. The map of another chunk is read for
        the states in which its neighbour can be left: first for a guess, the state
        that the neighbour's last characters lead to from the start, then for the
        neighbour's own results, all chunks side by side, until no state is new.
        The maps compose associatively, so a prefix scan gives every chunk's entry in
        as many steps as the number of chunks has binary digits.
        """
        n = len(whole)
        maps: list[dict[int, int]] = [{} for _ in range(n)]
        lanes = np.flatnonzero(whole)
        before = np.maximum(lanes - 1, 0)
        guess = self._quiet(cols[-WARM:, before], chars[-WARM:, before], np.full(len(lanes), _OPEN, np.int32))
        guess = np.where(lanes == 0, _OPEN, np.where(whole[before], guess, leaves[before]))
        todo = sorted(set(zip(lanes.tolist(), guess.tolist(), strict=True)))
        while todo:
            at, state = (np.array(x) for x in zip(*todo, strict=True))
            ends = self._quiet(cols[:, at], chars[:, at], state.astype(np.int32))
            fresh = set()
            for (i, s), end in zip(todo, ends.tolist(), strict=True):
                maps[i][s] = end
                if i + 1 < n and whole[i + 1] and end not in maps[i + 1]:
                    fresh.add((i + 1, end))
            todo = sorted((i, s) for i, s in fresh if s not in maps[i])
        entry = [list(m) for m in maps]
        place = [{s: k for k, s in enumerate(e)} for e in entry]
        scan = np.zeros((n, max(1, *map(len, maps))), np.int64)  # entry of this chunk to entry of the next, by number
        for i in range(n - 1):
            if whole[i + 1]:
                ends = [maps[i][s] for s in entry[i]] if whole[i] else [int(leaves[i])] * scan.shape[1]
                scan[i, : len(ends)] = [place[i + 1][x] for x in ends]
        step = 1
        while step < n:
            scan[step:] = np.take_along_axis(scan[step:], scan[:-step].copy(), 1)
            step *= 2
        out = np.full(n, _OPEN, np.int32)
        for i in range(1, n):
            if whole[i - 1]:
                left = entry[i - 1][scan[i - 2, 0] if i > 1 else 0]
                out[i] = maps[i - 1][left]
            else:
                out[i] = leaves[i - 1]
        return out

    def _scan(self, columns: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Emitted tokens and state at each character."""
        n = -(-len(columns) // CHUNK)
        pad = n * CHUNK - len(columns)
        grid = lambda x, fill: np.ascontiguousarray(np.append(x, np.full(pad, fill, x.dtype)).reshape(n, CHUNK).T)
        cols, chars = grid(columns, _UNKNOWN), grid(codes, 0)
        emitted, states = np.zeros(cols.shape, np.int16), np.zeros(cols.shape, np.int32)
        leaves = self._read(cols, chars, np.full(n, _DEAD, np.int32), emitted, states)
        resets = (cols == _UNKNOWN) | (cols == _MARK)
        head = np.where(resets.any(0), resets.argmax(0), CHUNK)
        state = self._entries(cols, chars, leaves, head == CHUNK)
        lanes = np.argsort(-head, kind="stable")  # heads, the longest first
        state = state[lanes]
        for t in range(int(head.max(initial=0))):
            live = int(np.searchsorted(-head[lanes], -t, "left"))
            part = lanes[:live]
            e, s = np.zeros((1, live), np.int16), np.zeros((1, live), np.int32)
            state[:live] = self._read(cols[t : t + 1, part], chars[t : t + 1, part], state[:live], e, s)
            emitted[t, part], states[t, part] = e[0], s[0]
        flat = lambda x: x.T.reshape(-1)[: len(columns)]
        return flat(emitted), flat(states)


@lru_cache(maxsize=2)
def _transducer(path: str) -> CountingTransducer:
    return CountingTransducer(path)


def _parts(texts: list[str]) -> Iterator[list[str]]:
    part, chars = [], 0
    for x in texts:
        part.append(x)
        chars += len(x) + 1
        if chars >= PART_CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row of ``docs``.

    Defined cases: a null text counts as empty; an empty text has no tokens; a null
    id stays null; repeated rows are counted each; a text of any length is read
    whole, in chunks; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = _transducer(model_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = np.concatenate([transducer.count(x) for x in _parts(texts)]) if texts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), body.alias("text"), F.octet_length(body).cast("long").alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
