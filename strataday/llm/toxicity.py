"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Features are binary: the words of the lower-cased text, pairs of neighbours, and pairs with
one word between them, hashed into a fixed number of buckets. Each coordinate has its own
learning rate and an L1 threshold, so most weights are exactly zero; only the others are
kept and sent to the executors (at most ``BUCKETS`` of them, whatever the corpus).

Training takes about ``rows`` labelled texts, a documented bound, in one task. Scoring is
a column expression over whole texts, so it needs no shuffle and leaves other columns alone.

Defined results: NULL and empty texts have no features and get the score of the bias; without
any training row all scores are 0.5. Very long texts are scored whole. Repeated rows get
equal scores. An id labelled both 0 and 1 counts as 1; other labels are left out. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import labelled, split_no, trained
from .texts import (
    LOWER, SPACE_OR_PUNCTUATION, distinct_in_rows, mix, prefix_sums, row_of, slices, span_hash, words,
)

BITS = 20
BUCKETS = 1 << BITS
#: Labelled texts to learn from, about.
TRAIN_ROWS = 20_000
#: Bytes of texts worked on at a time; workers keep tables of powers for the largest slice.
SLICE = 1 << 19


@dataclass(frozen=True)
class Ftrl:
    """Settings of the training: learning rate, its smoothing, penalties, passes."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.1
    passes: int = 3


@dataclass(frozen=True)
class Weights:
    """Weights other than zero, by bucket, and the bias."""

    index: np.ndarray
    value: np.ndarray
    bias: float


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every word, pair and pair with a gap; repeats included."""
    data = LOWER[data]
    start, end, first = words(data, off, SPACE_OR_PUNCTUATION)
    word = span_hash(prefix_sums(data), start, end)
    row = row_of(first)
    rows, hashes = [row], [word]
    for step, odd in ((1, 0xD6E8FEB86659FD93), (2, 0xA0761D6478BD642F)):
        same = row[step:] == row[:-step]
        pair = word[:-step] * np.uint64(odd) + word[step:]
        rows.append(row[step:][same])
        hashes.append(mix(pair[same]))
    return np.concatenate(rows), (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)


def fit(sets: list[np.ndarray], y: np.ndarray, how: Ftrl = Ftrl()) -> Weights:
    """FTRL-proximal, one text at a time in a fixed mixed order."""
    seen = np.zeros(BUCKETS, np.int32)
    for at in sets:
        seen[at] += 1
    # One text moves z by 1 at most, so the others stay below the threshold: they are zero anyway.
    can = seen * how.passes > how.l1
    # One array for all texts: thousands of small ones would leave the worker's memory in pieces.
    many = np.fromiter((np.count_nonzero(can[at]) for at in sets), np.int64, len(sets))
    flat, ends = np.empty(many.sum(), np.int32), np.cumsum(many)
    for at, n, end in zip(sets, many, ends):
        flat[end - n : end] = at[can[at]]
    sets = np.split(flat, ends[:-1])
    z, n, w = (np.zeros(BUCKETS) for _ in range(3))
    bias, bias_n = 0.0, 1.0
    order = np.random.default_rng(11)
    for _ in range(how.passes):
        for i in order.permutation(len(sets)):
            at = sets[i]
            p = 1 / (1 + np.exp(-np.clip(w[at].sum() + bias, -35, 35)))
            g = p - y[i]
            bias -= how.alpha / np.sqrt(bias_n) * g
            bias_n += g * g
            before = n[at]
            after = before + g * g
            zi = z[at] + g - (np.sqrt(after) - np.sqrt(before)) / how.alpha * w[at]
            z[at], n[at] = zi, after
            w[at] = np.where(
                np.abs(zi) > how.l1,
                -(zi - np.sign(zi) * how.l1) / ((how.beta + np.sqrt(after)) / how.alpha + how.l2), 0.0,
            )
    index = np.flatnonzero(w)
    return Weights(index, w[index], float(bias))


def _train(how: Ftrl):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, y = [], []
        for batch in batches:
            for i, j, data, off in slices(batch.column("text"), SLICE):
                row, bucket = distinct_in_rows(*features(data, off))
                sets += np.split(bucket.astype(np.int32), np.searchsorted(row, np.arange(1, j - i)))
            y.append(batch.column("y").to_numpy())
        if not sets:
            return
        model = fit(sets, np.concatenate(y), how)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *model.index.tolist()], pa.int32()), pa.array([model.bias, *model.value.tolist()])],
            ["bucket", "weight"],
        )

    return run


def train(docs: DataFrame, labels: DataFrame, keep: Column | None = None, rows: int = TRAIN_ROWS,
          how: Ftrl = Ftrl(), label: str = "toxic") -> Weights:
    """Learn from about ``rows`` labelled texts for whose doc_id ``keep`` holds."""
    sample = labelled(docs, labels, label, F.lit(True) if keep is None else keep, rows)
    got = trained(sample, _train(how), "bucket int, weight double")
    bias = next((r.weight for r in got if r.bucket < 0), 0.0)
    kept = sorted((r.bucket, r.weight) for r in got if r.bucket >= 0)
    return Weights(np.array([k for k, _ in kept], np.int64), np.array([v for _, v in kept], float), bias)


def score_texts(column: pa.Array, dense: np.ndarray, bias: float) -> np.ndarray:
    out = []
    for i, j, data, off in slices(column, SLICE):
        row, bucket = features(data, off)
        hit = dense[bucket] != 0
        row, bucket = distinct_in_rows(row[hit], bucket[hit])
        out.append(np.bincount(row, weights=dense[bucket], minlength=j - i))
    total = np.concatenate(out) if out else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(total + bias, -35, 35)))


def toxicity_score(spark: SparkSession, text: Column | str, model: Weights) -> Column:
    """Probability of label 1, a column over whole texts."""
    shared = spark.sparkContext.broadcast((model.index, model.value, model.bias))

    @arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index, value, bias = shared.value
        dense = np.zeros(BUCKETS)
        dense[index] = value
        for column in batches:
            yield pa.array(score_texts(column, dense, bias))

    return score(text)


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; rows whose CRC-32 of the id
    leaves 0 modulo 5 are held out of the training."""
    part = split_no("doc_id", 5)
    model = train(docs, labels, part != 0, rows)
    scored = docs.select("doc_id", (part == 0).alias("held_out"), toxicity_score(docs.sparkSession, "text", model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, limit: float = 0.5) -> DataFrame:
    """The documents that score below the limit, with all their columns."""
    model = train(docs, labels, split_no("doc_id", 5) != 0, rows)
    return docs.where(toxicity_score(docs.sparkSession, docs["text"], model) < limit)
