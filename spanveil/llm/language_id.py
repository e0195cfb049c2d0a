"""Language identification by a convolutional network over bytes.

Bytes are embedded; filters of several widths slide over windows of fixed length;
each filter's largest response in a window goes to a softmax layer over the
languages. The network is trained in numpy on windows of labelled texts. A text is
read whole, window after window, in batches; its prediction is the mean of its
windows' probabilities, weighted by their bytes.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a
text of any length is read whole, a short one is padded with zero bytes; without
labelled rows every text is ``und``; rows with a null label or id aren't learned from;
equal probabilities go to the label that sorts first; repeated rows are predicted
alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labelled texts of each language to learn from, at most: those with the smallest hash. They are read whole.
SAMPLE = 400
#: Bytes of a window.
LENGTH = 128
UNKNOWN = "und"
_WIDTHS, _FILTERS, _EMBEDDING = (2, 3, 4, 5), 12, 8
_EPOCHS, _BATCH, _RATE = 2, 64, 0.01
_BLOCK_BYTES = 1_000_000
_BLOCK_WINDOWS = 512


@dataclass(frozen=True)
class ByteNetwork:
    """Weights: a byte's embedding, for each width a filter matrix and bias, and the last layer."""

    labels: tuple[str, ...]
    embedding: np.ndarray
    filters: tuple[np.ndarray, ...]
    biases: tuple[np.ndarray, ...]
    last: np.ndarray
    offset: np.ndarray

    def responses(self, windows: np.ndarray) -> tuple[np.ndarray, list]:
        """Each filter's largest response in each window, not below zero; and what a gradient needs."""
        x = self.embedding[windows]
        pooled, kept = [], []
        for weights, bias in zip(self.filters, self.biases, strict=True):
            width = len(weights) // self.embedding.shape[1]
            slid = np.lib.stride_tricks.sliding_window_view(x, width, axis=1).transpose(0, 1, 3, 2)
            spread = np.ascontiguousarray(slid).reshape(-1, len(weights))
            out = (spread @ weights).reshape(len(windows), -1, weights.shape[1])
            at = out.argmax(1)
            pooled.append(np.maximum(np.take_along_axis(out, at[:, None], 1)[:, 0] + bias, 0))
            kept.append((spread, at, out.shape[1]))
        return np.concatenate(pooled, 1), kept

    def fast_responses(self, windows: np.ndarray) -> np.ndarray:
        """The same responses by adding up, for each place in a filter, the product of the byte there."""
        pooled = []
        for weights, bias in zip(self.filters, self.biases, strict=True):
            size = self.embedding.shape[1]
            products = [self.embedding @ weights[k : k + size] for k in range(0, len(weights), size)]
            n = windows.shape[1] - len(products) + 1
            out = products[0][windows[:, :n]]
            for k, product in enumerate(products[1:], 1):
                out += product[windows[:, k : k + n]]
            pooled.append(np.maximum(out.max(1) + bias, 0))
        return np.concatenate(pooled, 1)

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.last + self.offset
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def train(windows: np.ndarray, targets: np.ndarray, labels: tuple[str, ...], seed: int = 7) -> ByteNetwork:
    """Adam on the cross entropy, classes weighted by the inverse root of their counts."""
    rng = np.random.default_rng(seed)
    init = lambda *shape: rng.normal(0, (2 / shape[0]) ** 0.5, shape).astype(np.float32)
    net = ByteNetwork(
        labels,
        rng.normal(0, 0.5, (256, _EMBEDDING)).astype(np.float32),
        tuple(init(w * _EMBEDDING, _FILTERS) for w in _WIDTHS),
        tuple(np.zeros(_FILTERS, np.float32) for _ in _WIDTHS),
        init(len(_WIDTHS) * _FILTERS, len(labels)),
        np.zeros(len(labels), np.float32),
    )
    weight = 1 / np.sqrt(np.maximum(np.bincount(targets, minlength=len(labels)), 1))
    weight = (weight / weight[targets].mean()).astype(np.float32)
    params = [net.embedding, *net.filters, *net.biases, net.last, net.offset]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(max(_EPOCHS, -(-400 * _BATCH // max(1, len(windows))))):
        order = rng.permutation(len(windows))
        for k in range(0, len(order), _BATCH):
            some = order[k : k + _BATCH]
            x, y = windows[some], targets[some]
            pooled, kept = net.responses(x)
            error = net.probabilities(pooled)
            error[np.arange(len(y)), y] -= 1
            error *= weight[y][:, None] / len(y)
            back = (error @ net.last.T) * (pooled > 0)
            embedding = np.zeros_like(net.embedding)
            filters, biases = [], []
            for i, (spread, at, places) in enumerate(kept):
                part = back[:, i * _FILTERS : (i + 1) * _FILTERS]
                rows = (np.arange(len(x))[:, None] * places + at).reshape(-1)
                seen = spread[rows].reshape(len(x), _FILTERS, -1)
                filters.append(np.einsum("bf,bfd->df", part, seen))
                biases.append(part.sum(0))
                grad = np.einsum("bf,df->bfd", part, net.filters[i]).reshape(-1, _EMBEDDING)
                place = at[..., None] + np.arange(_WIDTHS[i])
                np.add.at(embedding, np.take_along_axis(x[:, None, :], place, 2).reshape(-1), grad)
            grads = [embedding, *filters, *biases, pooled.T @ error, error.sum(0)]
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= _RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def _windows(data: bytes) -> np.ndarray:
    n = max(1, -(-len(data) // LENGTH))
    return np.frombuffer(data.ljust(n * LENGTH, b"\0"), np.uint8).reshape(n, LENGTH)


def learn_languages(docs: DataFrame, learn: Column, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> ByteNetwork | None:
    """A network from at most SAMPLE labelled rows of each language for which ``learn`` holds; None without any."""
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    named = rows.select(F.col(id_col).alias("_id"), F.xxhash64(id_col).alias("_order"), F.col(lang).alias("_lang"))
    # each task passes on SAMPLE rows of a language at most
    first = named.withColumn("_n", F.row_number().over(Window.partitionBy("_lang").orderBy("_order", "_id"))).where(F.col("_n") <= SAMPLE)
    chosen = rows.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    chosen = chosen.join(F.broadcast(first.select("_id", "_lang").distinct()), ["_id", "_lang"], "left_semi")  # SAMPLE rows of a language
    found = chosen.select("_lang", "_text").distinct().orderBy(F.xxhash64("_text"), "_text").toArrow().to_pydict()
    if not found["_lang"]:
        return None
    labels = tuple(sorted(set(found["_lang"])))
    stacks = [_windows(x.encode()) for x in found["_text"]]
    targets = np.repeat([labels.index(x) for x in found["_lang"]], [len(x) for x in stacks])
    return train(np.concatenate(stacks), targets, labels)


def predict_languages(docs: DataFrame, net: ByteNetwork | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score) of each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, has = batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist()
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            at = 0
            while at < len(texts) and net is not None:
                rows, size = [], 0
                while at < len(texts) and size < _BLOCK_BYTES:
                    if has[at]:
                        rows.append(at)
                        size += len(texts[at])
                    at += 1
                if not rows:
                    continue
                stacks = [_windows(texts[i]) for i in rows]
                windows = np.concatenate(stacks)
                pieces = [net.probabilities(net.fast_responses(windows[k : k + _BLOCK_WINDOWS])) for k in range(0, len(windows), _BLOCK_WINDOWS)]
                filled = np.full(len(windows), LENGTH)
                ends = np.cumsum([len(x) for x in stacks])
                filled[ends - 1] = [(len(texts[i]) - 1) % LENGTH + 1 for i in rows]
                mean = np.add.reduceat(np.concatenate(pieces) * filled[:, None], np.concatenate([[0], ends[:-1]]))
                mean /= np.array([len(texts[i]) for i in rows])[:, None]
                for i, best, p in zip(rows, mean.argmax(1), mean.max(1), strict=True):
                    lang[i], score[i] = net.labels[best], min(1.0, float(p))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score)], names=["id", "lang_pred", "score"])

    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), body.alias("text"), body.rlike(r"\p{L}").alias("has_letter"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
