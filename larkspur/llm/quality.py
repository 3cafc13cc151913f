"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features are hashed 1- and 2-grams of words and 1- to 3-grams of word shapes (runs of letters, capitals and digits folded
to one sign, punctuation as it is), and of 2-grams by whether both words are the same, each with its relative frequency in the text. A score is the sigmoid of a sparse dot
product. Training takes at most about `limit` labelled documents of each class.

Edge cases: null and empty texts score the bias; without labels of both classes every score is the share of label 1 (0.5
where there is none); repeated ids count once in training, with their larger label; repeated rows score alike; a null id
is in the fold of the empty text. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import kernel as K
from larkspur.llm.labelled import fit_in_task, fold, labelled_sample

BITS = 20
LIMIT = 6000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 0.02, 2e-4, 1e-3
THRESHOLD = 0.3

_b = np.arange(256)
#: Shape of a byte: letters a, capitals A, digits 0, other ASCII itself; of UTF-8, lead bytes count for nothing and the
#: first half of continuation bytes as capitals (so it is for Latin letters).
_SHAPE = _b.copy()
_SHAPE[(_b >= 97) & (_b <= 122) | (_b >= 0xA0) & (_b < 0xC0)] = 97
_SHAPE[(_b >= 65) & (_b <= 90) | (_b >= 0x80) & (_b < 0xA0)] = 65
_SHAPE[(_b >= 48) & (_b <= 57)] = 48
_SHAPE[_b >= 0xC0] = 0


def shape_hashes(w: K.Words) -> np.ndarray:
    """Hash of each word's shape."""
    sign = _SHAPE[w.buf]
    real = sign > 0
    at = np.flatnonzero(real)
    keep = np.zeros(len(sign), bool)
    if len(at):
        new = np.ones(len(at), bool)
        new[1:] = sign[at[1:]] != sign[at[:-1]]
        keep[at[new]] = True
        first = np.searchsorted(at, w.starts)  # a word's first sign always counts
        ok = first < len(at)
        keep[at[first[ok]]] = True
    rank = np.concatenate([[0], np.cumsum(keep)])
    return K.hashes(sign[keep].astype(np.uint8), rank[w.starts], rank[w.ends], 21)


def features(buf: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram: buckets, and their bounds per document."""
    w = K.split_words(buf, offsets)
    shape = shape_hashes(w) if len(w.hashes) else w.hashes
    out = []
    sizes = np.diff(w.first)
    for kind, (h, n) in enumerate(((w.hashes, 1), (w.hashes, 2), (shape, 1), (shape, 2), (shape, 3))):
        at = np.flatnonzero(K.window_starts(w.first, n)) if len(h) else np.zeros(0, np.int64)
        grams = K.ngram_hashes(h, n, salt=kind + 1)[at] if len(at) else np.zeros(0, np.uint64)
        out.append(((grams >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate([[0], np.cumsum(np.maximum(sizes - n + 1, 0))])))
        if kind == 1:  # 2-grams once more, as repeated words or not
            out.append(((w.hashes[at + 1] == w.hashes[at]).astype(np.int64) if len(at) else out[-1][0], out[-1][1]))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train(texts: pa.Array, y: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of 2**BITS buckets, then the bias."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for _, _, buf, offsets in K.chunks(texts):
        kinds = features(buf, offsets)
        for d in range(len(offsets) - 1):
            index, value = [np.array([1 << BITS])], [np.ones(1)]
            for grams, first in kinds:
                u, c = np.unique(grams[first[d] : first[d + 1]], return_counts=True)
                index.append(u)
                value.append(c / max(c.sum(), 1))
            rows.append((np.concatenate(index).astype(np.int32), np.concatenate(value).astype(np.float32)))

    def weights(i: np.ndarray | slice) -> np.ndarray:
        return -np.sign(z[i]) * np.maximum(np.abs(z[i]) - L1, 0) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)

    if len(rows) and 0 < y.sum() < len(y):
        rng = np.random.default_rng(1)
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                i, x = rows[k]
                w = weights(i)
                g = (_sigmoid(w @ x) - y[k]) * x
                after = n[i] + g * g
                z[i] += g - (np.sqrt(after) - np.sqrt(n[i])) / ALPHA * w
                n[i] = after
        return weights(slice(None)).astype(np.float32)
    out = np.zeros(len(z), np.float32)
    out[-1] = 0 if not len(y) else 30 if y.mean() > 0.5 else -30
    return out


def _fit(sample: pa.Table) -> np.ndarray:
    return train(sample["text"].combine_chunks(), sample["y"].to_numpy().astype(np.float64))


def scores(weights: np.ndarray, texts: pa.Array) -> np.ndarray:
    out = [np.zeros(0)]
    for _, _, buf, offsets in K.chunks(texts):
        total = np.full(len(offsets) - 1, float(weights[-1]))
        for grams, first in features(buf, offsets):
            total += K.segment_sum(weights[grams].astype(np.float64), first) / np.maximum(np.diff(first), 1)
        out.append(_sigmoid(total))
    return np.concatenate(out)


def _score(weights: np.ndarray):
    index = np.flatnonzero(weights)
    packed = index.astype(np.int32), weights[index]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((1 << BITS) + 1, np.float32)
        own[packed[0]] = packed[1]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["id"], batch["held_out"], pa.array(scores(own, batch["text"]))], names=["id", "held_out", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held_out: int = 0, limit: int = LIMIT, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, score (0 to 1; higher: label 1 likelier) and predicted of every row."""
    weights = fit_in_task(labelled_sample(docs, labels, label, folds, held_out, limit, id_col, text_col), _fit)
    rows = docs.select(F.col(id_col).alias("id"), (fold(id_col, folds) == held_out).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_score(weights), f"id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumnRenamed("id", id_col)


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The op5 digest."""
    return score_quality(documents, labels)
