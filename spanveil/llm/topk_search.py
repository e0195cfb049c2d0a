"""Exact top-k inner-product search with a three-phase uniform threshold.

A vector's dimensions are cut into slices; a score is the sum of one partial score
from each slice. Candidates are dealt to slots, each the rows of one task, and every
query goes to every slot as a row of its own, so that neither side is broadcast or
collected; they meet in tiles (a block of queries with a block of a slot's candidates).
1. In each slice of each tile the longest rows, HEAD of them, give every query its k
   best partial scores; only the candidates on these local lists are scored in full,
   and the k-th best score that a query has anywhere is a safe cutoff: the final
   list cannot fall below.
2. The cutoffs travel to the slots with the queries. A score that reaches the
   cutoff c has a partial score of c / slices at least in one of the slices; pairs
   whose lengths rule that out in all slices aren't multiplied. The others are
   multiplied slice by slice, each only as long as what it has and what lengths let
   the other slices add can reach the cutoff.
3. Only the scores of these entries are resolved, exactly, and each slot passes on
   its k best.

Defined cases: vectors that are null, empty or hold null or non-finite components
take no part, nor do rows with a null id; a shorter vector counts as filled up
with zeros; ties go to the smaller id; a candidate with the query's id is its own;
of rows that repeat a query's id one is the query (the smallest vector); repeated
candidates are ranked each; scores beyond 64 bits are set to the largest or
smallest number; with fewer than k candidates all are returned; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.storage import cut

#: Queries and rows are multiplied in blocks of so many.
QUERY_BLOCK, ROW_BLOCK = 256, 4096
#: A slot's rows have about so many components (what a task holds), and so many rows at least while there are few slots:
#: rows go to one slot each, and queries to every slot.
SLOT_CELLS, SLOT_ROWS = 1 << 22, 1024
SLICES, HEAD = 4, 256
_LOWEST = -(1 << 63)


def integer_vectors(table: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * component) of the vectors that take part."""
    v = F.col(vector)
    fit = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale))
    return table.where(F.col(id_col).isNotNull() & F.coalesce(fit, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def _matrix(vs: pa.Array) -> np.ndarray:
    lengths = vs.value_lengths().to_numpy()
    out = np.zeros((len(vs), int(lengths.max())), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = vs.flatten().to_numpy()
    return out


def _filled(parts: list[tuple[np.ndarray, pa.Array]]) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """``parts`` (ids, vectors) of a slot as blocks of ROW_BLOCK rows."""
    ids, vs = np.concatenate([i for i, _ in parts]), pa.concat_arrays([v for _, v in parts])
    for at in range(0, len(ids), ROW_BLOCK):
        yield ids[at : at + ROW_BLOCK], vs[at : at + ROW_BLOCK]


def _most(a: np.ndarray, b: np.ndarray) -> float:
    """No inner product of a row of each is larger."""
    return float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows, exact: in floating point while it holds the integers, else in Python's."""
    if _most(a, b) < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, _LOWEST, -_LOWEST - 1).astype(np.int64)


def _scores(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whole scores of the pairs (i, j), exact."""
    if _most(q, x) >= 2**62:
        return np.array([max(_LOWEST, min(-_LOWEST - 1, sum(int(a) * int(b) for a, b in zip(q[m], x[n], strict=True)))) for m, n in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    step = max(1, 4_000_000 // max(1, q.shape[1]))
    return np.concatenate([np.zeros(0, np.int64), *[(q[i[k : k + step]] * x[j[k : k + step]]).sum(1) for k in range(0, len(i), step)]])


def _lengths(m: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Of each row its length in each slice."""
    return np.stack([np.sqrt((m[:, c].astype(np.float64) ** 2).sum(1)) for c in cuts], 1)


def local_lists(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, row, score, multiplied): rows that are among a query's k best partial scores over the HEAD longest rows of a slice."""
    cuts = np.array_split(np.arange(q.shape[1]), max(1, min(SLICES, q.shape[1])))
    chosen, multiplied = np.zeros((len(q), len(x)), bool), 0
    for c, length in zip(cuts, _lengths(x, cuts).T, strict=True):
        head = np.argsort(-length, kind="stable")[:HEAD]
        part, n = _exact(q[:, c], x[head][:, c]), min(k, len(head))
        multiplied += part.size
        best = np.argpartition(-part.astype(np.float64), n - 1, axis=1)[:, :n]
        chosen[np.arange(len(q))[:, None], head[best]] = True
    i, j = np.nonzero(chosen)
    return i, j, _scores(q, x, i, j), multiplied


def sufficient_entries(q: np.ndarray, x: np.ndarray, cutoff: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, row, score, multiplied) of the pairs that reach the query's cutoff; all pairs of a query whose cutoff isn't ``known``.

    multiplied: how many pairs were multiplied, slice by slice. A pair isn't multiplied
    at all if lengths rule its share of the cutoff out in every slice, and no further
    once what it has and the lengths of the slices to come can't add up to the cutoff.
    """
    cuts = np.array_split(np.arange(q.shape[1]), max(1, min(SLICES, q.shape[1])))
    length, own = _lengths(x, cuts), _lengths(q, cuts)
    least = cutoff.astype(np.float64) * (1 - 1e-9 * np.sign(cutoff)) - 1  # lengths are rounded
    share = (least / len(cuts))[:, None]
    open_ = np.zeros((len(q), len(x)), bool)
    for c in range(len(cuts)):
        open_ |= own[:, c, None] * length[None, :, c] >= share
    open_ |= ~known[:, None]
    most = own @ length.T  # what all slices can add
    open_ &= (most >= least[:, None]) | ~known[:, None]
    rest, so_far, s, multiplied = most, np.zeros(open_.shape), 0, 0
    while s < len(cuts) and 4 * np.count_nonzero(open_) >= open_.size:  # most pairs are open: products of matrices
        so_far += _exact(q[:, cuts[s]], x[:, cuts[s]])
        rest -= own[:, s, None] * length[None, :, s]
        open_ &= (so_far + rest >= least[:, None] - 1e-9 * np.abs(so_far)) | ~known[:, None]
        multiplied, s = multiplied + open_.size, s + 1
    i, j = np.nonzero(open_)
    so_far, rest = so_far[i, j], rest[i, j]
    for s, c in list(enumerate(cuts))[s:]:
        multiplied += len(i)
        so_far, rest = so_far + _scores(q[:, c], x[:, c], i, j), rest - own[i, s] * length[j, s]
        stays = ~known[i] | (so_far + rest >= least[i] - 1e-9 * np.abs(so_far))
        i, j, so_far, rest = i[stays], j[stays], so_far[stays], rest[stays]
    # sums that floating point holds are exact
    score = so_far.astype(np.int64) if _most(q, x) < 2**53 else _scores(q, x, i, j)
    ok = ~known[i] | (score >= cutoff[i])
    return i[ok], j[ok], score[ok], multiplied


def _best(i: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the entries (query i, id, score) the k best of each query."""
    order = np.lexsort((ids, np.negative(score.astype(object)) if (score == _LOWEST).any() else -score, i))
    i, ids, score = i[order], ids[order], score[order]
    kept = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
    return i[kept], ids[kept], score[kept]


def _tiles(vectors: DataFrame, asked: DataFrame, slots: int, k: int, phase: int) -> DataFrame:
    """(query_id, vec_id, score): from each slot each query's k best entries of the local lists (phase 1) or of the sufficient entries.

    A row is a vector, and a task holds the rows of one slot while the queries (id, v,
    cutoff) pass by, so that no record and no batch grows with the tables.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, held, blocks = None, [], []
        for batch in batches:  # in the order of slots, their rows before the queries
            slot_of, asks, ids = (batch.column(n).to_numpy() for n in range(3))
            vs, cutoffs = batch.column(3), batch.column(4)
            edges = np.flatnonzero((np.diff(slot_of) != 0) | (np.diff(asks) != 0)) + 1
            for begin, end in zip([0, *edges], [*edges, len(ids)], strict=True):
                if begin == end:
                    continue
                if slot_of[begin] != slot:
                    slot, held, blocks = slot_of[begin], [], []
                if not asks[begin]:
                    held.append((ids[begin:end], vs[begin:end]))
                    continue
                if held:
                    blocks, held = [(i, _matrix(v)) for i, v in _filled(held)], []
                for at in range(begin, end, QUERY_BLOCK):
                    part = slice(at, min(at + QUERY_BLOCK, end))
                    query, q, cutoff = ids[part], _matrix(vs[part]), cutoffs[part]
                    known, cutoff = cutoff.is_valid().to_numpy(zero_copy_only=False), cutoff.fill_null(0).to_numpy()
                    found = []
                    for of, x in blocks:
                        dims = min(q.shape[1], x.shape[1])  # what one lacks is zero
                        if phase == 1:
                            i, j, score, _ = local_lists(q[:, :dims], x[:, :dims], k + 1)  # one may be the query itself
                        else:
                            i, j, score, _ = sufficient_entries(q[:, :dims], x[:, :dims], cutoff, known)
                        other = of[j] != query[i]
                        found.append(_best(i[other], of[j[other]], score[other], k))
                    if found:
                        i, of, score = _best(*(np.concatenate(c) for c in zip(*found, strict=True)), k)
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (query[i], of, score)], names=["query_id", "vec_id", "score"])

    # rows are dealt in turn, whatever they hold
    rows = vectors.select(F.pmod(F.monotonically_increasing_id(), F.lit(slots)).cast("int").alias("slot"), F.lit(0).alias("asks"), "id", "v", F.lit(None).cast("long").alias("cutoff"))
    every = asked.select(F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), F.lit(1).alias("asks"), "id", "v", "cutoff")
    met = rows.unionByName(every).repartitionById(slots, F.col("slot")).sortWithinPartitions("slot", "asks")
    return met.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(table: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which ``queries`` holds its k best other rows."""
    vectors = integer_vectors(table, id_col, vector, scale)
    asked = cut(integer_vectors(table.where(queries), id_col, vector, scale).groupBy("id").agg(F.min("v").alias("v")))
    n, cells = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    cores = table.sparkSession.sparkContext.defaultParallelism
    slots = max(1, -(-cells // SLOT_CELLS), min(2 * cores, -(-n // SLOT_ROWS)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    lists = _tiles(vectors, asked.withColumn("cutoff", F.lit(None).cast("long")), slots, k, 1)
    kth = lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    kth = kth.groupBy("query_id").agg(F.when(F.count("score") == k, F.min("score")).alias("cutoff"))
    bounded = cut(asked.join(kth.withColumnRenamed("query_id", "id"), "id", "left"))
    entries = _tiles(vectors, bounded, slots, k, 2).withColumn("rank", F.row_number().over(order))
    return entries.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
