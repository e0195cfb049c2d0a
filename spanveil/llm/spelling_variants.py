"""Words that differ from a more frequent word by one letter, found in a trie of letter counts.

Letters fall into ``GROUPS`` groups. A word's vector has the number of its letters in
each group, and the words are arranged in a trie by these numbers, one group a level.
One inserted letter raises one number by one, one deleted letter lowers one, and one
replaced letter does both or neither; so a search goes down the trie with a surplus
of one and a deficit of one to spend, and words at the leaves it comes to are
compared letter by letter.

The upper part of the trie is spread over the cluster: a node of more than
``WORDS_A_TREE`` words is opened, level by level, by joins with the nodes (which are
few), and each word is sent to all the subtrees that its budget reaches. A task
holds one subtree at a time and reads the words that search it as a stream. When
more words have equal vectors, they are dealt to several subtrees.

Counting goes over all documents, a task passes on what it counted when that gets
long, and Spark adds the counts up.

Defined cases: a null or empty text has no words; in a document with a null id no
word loses a letter; rows that repeat an id count each; runs of letters of any
length are words; an empty table gives no rows; only the id and text columns are
read, so other columns may have any names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.components import cut_to_size
from spanveil.storage import cut

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: A run loses a letter when this divides its checksum.
LOSE = 199
#: Words have so many letters and occurrences at least; a form occurs so many times as often as its word.
LETTERS, OCCURRENCES, TIMES = 6, 5, 5
GROUPS = 12
#: Words in a task's subtree, words that a task counts before it passes them on, words in a partition.
WORDS_A_TREE, _HELD, WORDS_A_TASK = 40_000, 200_000, 50_000
#: Nodes of a level that may be sent to every task.
NODES = 20_000
#: Searches that go down a subtree together, and pairs of words compared at once.
_SEARCHES, _PAIRS = 20_000, 100_000


def _count_words(doc_id: int | None, text: str, counts: Counter) -> None:
    begun = None if doc_id is None else crc32(f"{doc_id}:".encode())
    lowered: dict[str, int] = {}
    for run, n in Counter(_RUN.findall(text)).items():
        low = run.lower() if run.isascii() else run.translate(_LOWER)
        lowered[low] = lowered.get(low, 0) + n
    for word, n in lowered.items():
        if begun is not None and (h := crc32(word.encode(), begun)) % LOSE == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        if len(word) >= LETTERS:
            counts[word] += n


def word_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all words of at least LETTERS letters and OCCURRENCES occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, body in zip(batch.column(0), batch.column(1), strict=True):
                _count_words(doc_id.as_py(), body.as_py(), counts)
                if len(counts) >= _HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
                    counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    body = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = body.mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


def _vectors(words: list[bytes]) -> np.ndarray:
    """How many letters of each group each word has; a letter's group follows from its code."""
    row = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    letters = np.frombuffer(b"".join(words), np.uint8)
    return np.bincount(row * GROUPS + letters % GROUPS, minlength=len(words) * GROUPS).reshape(-1, GROUPS)


def _letters_of(group: int) -> Column:
    """The same for one group, of a column ``word``."""
    letters = "".join(chr(c) for c in (*range(0x61, 0x7B), *range(0xC0, 0x100)) if c % GROUPS == group)
    return F.length("word") - F.length(F.translate("word", letters, ""))


def subtrees(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The words (tree, word, n), each in its subtree, and the searches (tree, word) of each subtree that a word's budget reaches.

    A node of few words, and one at the lowest level, is a subtree; of the others, each
    word goes one level down: to its own child as a word, and to up to three as a search.
    """
    total = words.count()
    if total <= WORDS_A_TREE:
        return words.select(F.lit("").alias("tree"), "word", "n"), words.select(F.lit("").alias("tree"), "word")

    def step(looks: DataFrame, level: int) -> DataFrame:
        found = looks.withColumn("_c", _letters_of(level)).select("*", F.explode(F.array(*map(F.lit, (-1, 0, 1)))).alias("d"))
        found = found.where("d <= surplus and -d <= deficit and _c + d >= 0")
        child = F.concat("node", (F.col("_c") + F.col("d")).cast("string"), F.lit(","))
        return found.select("word", child.alias("node"), (F.col("surplus") - F.greatest("d", F.lit(0))).alias("surplus"), (F.col("deficit") + F.least("d", F.lit(0))).alias("deficit"))

    stays, reach = [], []
    now = words.select("word", "n", F.concat(_letters_of(0).cast("string"), F.lit(",")).alias("node"))
    looks = step(words.select("word", F.lit("").alias("node"), F.lit(1).alias("surplus"), F.lit(1).alias("deficit")), 0)
    for level in range(1, GROUPS + 1):
        nodes = cut(now.groupBy("node").agg(F.count(F.lit(1)).alias("m")))
        few = nodes.count() <= NODES
        side = lambda df: F.broadcast(df) if few else df  # noqa: E731, B023
        small = nodes if level == GROUPS else nodes.where(F.col("m") <= WORDS_A_TREE)
        slots = small.select("node", F.ceil(F.col("m") / WORDS_A_TREE).alias("slots"))
        name = lambda slot: F.concat("node", F.lit(":"), slot.cast("string"))
        stays.append(now.join(side(slots), "node").select(name(F.pmod(F.xxhash64("word"), F.col("slots"))).alias("tree"), "word", "n"))
        met = looks.join(side(slots), "node")
        reach.append(met.select("node", "word", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot")).select(name(F.col("slot")).alias("tree"), "word"))
        large = nodes.where(F.col("m") > WORDS_A_TREE).select("node")
        if level == GROUPS or not large.head(1):
            break
        now = now.join(side(large), "node", "left_semi").withColumn("node", F.concat("node", _letters_of(level).cast("string"), F.lit(",")))
        looks = step(looks.join(side(large), "node", "left_semi"), level)
    return reduce(DataFrame.unionByName, stays), reduce(DataFrame.unionByName, reach)


def _padded(words: list[bytes], back: bool = False) -> np.ndarray:
    """The letters of each word in a row (``back``: from its end), no letter after them."""
    width = max(map(len, words), default=0)
    rows = [(x[::-1] if back else x).ljust(width, b"\0") for x in words]
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(words), width)


def one_apart(a: list[bytes], b: list[bytes], i: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For each pair a[i], b[k]: does exactly one inserted, deleted or replaced letter lead from one to the other?

    Then what they share from their beginnings on and what they share from their ends
    on leave one letter of the longer word at most.
    """
    kinds = [np.unique(x, return_inverse=True) for x in (i, k)]
    a, b = ([x[j] for j in of.tolist()] for x, (of, _) in zip((a, b), kinds, strict=True))
    i, k = (at for _, at in kinds)
    sizes = [np.fromiter(map(len, x), np.int64, len(x))[at] for x, at in ((a, i), (b, k))]
    shared = []
    for back in (False, True):
        x, y = _padded(a, back), _padded(b, back)
        width = min(x.shape[1], y.shape[1])
        unlike = np.ones((len(i), width + 1), bool)
        unlike[:, :width] = x[i, :width] != y[k, :width]
        shared.append(np.minimum(unlike.argmax(1), np.minimum(*sizes)))
    longer = np.maximum(*sizes)
    same = (sizes[0] == sizes[1]) & (shared[0] == longer)
    return ~same & (np.abs(sizes[0] - sizes[1]) <= 1) & (shared[0] + shared[1] >= longer - 1)


class Trie:
    """Words in the order of their vectors; a node is a stretch of them."""

    def __init__(self, words: list[bytes], n: np.ndarray):
        vectors = _vectors(words)
        order = np.lexsort(vectors.T[::-1])
        self.words, self.n, self.v = [words[k] for k in order], n[order], vectors[order]
        #: Each word's place by code points.
        self.rank = np.argsort(sorted(range(len(words)), key=self.words.__getitem__))

    def search(self, words: list[bytes], vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(searches, words) that are one letter apart.

        Depth first over the nodes; at a node are all the searches that have come to it
        with what is left of their surplus and deficit.
        """
        # words of like lengths are compared together, so that a long one doesn't widen all rows
        size = np.fromiter(map(len, words), np.int64, len(words)).astype(float)
        once, met, count = np.ones(len(words), np.int64), [], 0
        stack = [(0, 0, len(self.words), np.arange(len(words)), once, once)]
        while stack:
            level, begin, end, who, surplus, deficit = stack.pop()
            # a leaf; or so little below that comparing letters is less work than going on
            if level == GROUPS or (end - begin) * len(who) <= 32:
                step = max(1, _PAIRS // (end - begin))
                for k in range(0, len(who), step):
                    some = who[k : k + step]
                    met.append((np.repeat(some, end - begin), np.tile(np.arange(begin, end), len(some))))
                    count += len(met[-1][0])
                    if count >= _PAIRS:
                        yield from self._verified(words, size, met)
                        met, count = [], 0
                continue
            values = self.v[begin:end, level]
            at = np.concatenate([[0], np.flatnonzero(np.diff(values)) + 1, [len(values)]])
            for k in range(len(at) - 1):
                d = values[at[k]] - vectors[who, level]
                left, owed = surplus - np.maximum(d, 0), deficit + np.minimum(d, 0)
                on = (left >= 0) & (owed >= 0)
                if on.any():
                    stack.append((level + 1, begin + at[k], begin + at[k + 1], who[on], left[on], owed[on]))
        yield from self._verified(words, size, met)

    def _verified(self, words: list[bytes], size: np.ndarray, met: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not met:
            return
        i, k = (np.concatenate(x) for x in zip(*met, strict=True))
        scale = np.log2(size[i]).astype(np.int64)
        for width in np.unique(scale).tolist():
            own = np.flatnonzero(scale == width)
            step = max(1, (_PAIRS * 16) >> width)
            for at in range(0, len(own), step):
                x, y = i[own[at : at + step]], k[own[at : at + step]]
                right = one_apart(words, self.words, x, y)
                yield x[right], y[right]


def near_words(words: DataFrame, searches: DataFrame) -> DataFrame:
    """(word, n_near, best) for each search in each subtree that has near words; best: (-n, form) of the most frequent one."""

    def answers(trie: Trie, letters: list[bytes]) -> pa.RecordBatch:
        found = list(trie.search(letters, _vectors(letters)))
        i, k = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*found, strict=True) if found else ((), ())))
        order = np.lexsort((trie.rank[k], -trie.n[k], i))
        i, k = i[order], k[order]
        who, at, count = np.unique(i, return_index=True, return_counts=True)
        best = k[at].tolist()
        text = lambda rows: pa.array([x.decode("latin-1") for x in rows], pa.string())
        columns = [text([letters[j] for j in who.tolist()]), pa.array(count, pa.int64()), pa.array(-trie.n[k[at]], pa.int64()), text([trie.words[j] for j in best])]
        return pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "less", "form"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, held, trie, looks = None, [], None, []
        for batch in batches:  # a subtree's words, then its searches
            for name, n, word in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if name != tree:
                    if looks:
                        yield answers(trie, looks)
                    tree, held, trie, looks = name, [], None, []
                letters = word.encode("latin-1")
                if n is not None:
                    held.append((letters, n))
                    continue
                trie = trie or Trie([x for x, _ in held], np.array([x for _, x in held], np.int64))
                looks.append(letters)
                if len(looks) >= _SEARCHES:
                    yield answers(trie, looks)
                    looks = []
        if looks:
            yield answers(trie, looks)

    rows = words.select("tree", "n", "word").unionByName(searches.select("tree", F.lit(None).cast("long").alias("n"), "word"))
    found = rows.repartition("tree").sortWithinPartitions("tree", F.col("n").desc_nulls_last()).mapInArrow(run, "word string, n_near long, less long, form string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "form")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): from each ``word`` along its ``form`` to a word without one. Each step doubles the way gone."""
    now = cut_to_size(forms.select("word", F.col("form").alias("root")), WORDS_A_TASK)
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        now = cut_to_size(now.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), WORDS_A_TASK)
        if not now.where("moved").head(1):
            return now.drop("moved")
        now = now.drop("moved")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each word of ``docs``.

    Near words differ by one letter; a word's form is its near word of largest n (ties:
    smallest by code points) if that occurs TIMES as often; root is where forms lead.
    """
    words = cut_to_size(word_counts(docs, id_col, text), WORDS_A_TASK)
    near = near_words(*subtrees(words))
    found = cut_to_size(words.select("word", "n").join(near, "word", "left"), WORDS_A_TASK)
    much = -F.col("best.less") >= TIMES * F.col("n")
    formed = found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(much, F.col("best.form")).alias("form"), F.when(much, -F.col("best.less")).alias("form_n"))
    ends = roots(formed.where("form is not null"))
    return formed.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
