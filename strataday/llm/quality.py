"""Quality: supervised subword embeddings.

Each word, each run of 3 to 5 bytes inside a word (the white space beside the word
counts as its edge) and the event that a word repeats the one before it, whichever it is,
has a learned vector, found by a hash. A document is the mean of its vectors; a softmax
over two outputs follows. All is trained by stochastic gradient descent in numpy on about
``rows`` labelled texts, a documented bound, in one task. The number of steps is the same
however few texts there are, and the bias starts from the shares of the labels.

The mean and the output are both linear, so for scoring each bucket is reduced to one
number, the difference it makes between the two outputs: scoring adds up numbers
instead of vectors, in a column expression over whole texts, without a shuffle.

Defined results: NULL and empty texts have no features and get the score of the output's bias;
without any training row all scores are 0.5. Very long texts are scored whole. Repeated
rows get equal scores. An id labelled both 0 and 1 counts as 1; other labels are left out.
An empty table gives an empty result.
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
from .texts import SPACE, powers, prefix_sums, row_of, slices, span_hash, words

BITS = 17
BUCKETS = 1 << BITS
GRAMS = (3, 4, 5)
#: Bucket of a repeated word.
AGAIN = 0
#: Labelled texts to learn from, about.
TRAIN_ROWS = 4_000
_SHIFT = np.uint64(64 - BITS)


@dataclass(frozen=True)
class Sgd:
    """Settings of the training: length of the vectors, first step size, steps, how much
    larger the steps of the vectors are, as each has but a small share in a mean, and how
    many texts count for each label before any is seen."""

    size: int = 8
    step: float = 0.5
    steps: int = 12_000
    lift: float = 8.0
    prior: float = 1.0


@dataclass(frozen=True)
class Model:
    """Per bucket the difference between the outputs for 1 and for 0; the bias."""

    value: np.ndarray
    bias: float


def grams(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: the bucket at every byte, and whether a feature starts there."""
    sums = prefix_sums(data)
    _, down = powers(len(data))
    gap = SPACE[data]
    gaps = np.zeros(len(data) + 1, np.int32)
    np.cumsum(gap, out=gaps[1:])
    for n in GRAMS:
        total = max(0, len(data) - n + 1)
        bucket = ((sums[n:] - sums[: total]) * down[:total] if total else np.zeros(0, np.uint64)) >> _SHIFT
        good = gaps[n - 1 : n - 1 + total] == gaps[1 : 1 + total]
        for k in range(1, n):
            ends = off[1:-1] - k
            good[ends[(ends >= 0) & (ends < total)]] = False
        yield bucket.astype(np.int32), good


def word_buckets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every word, and one more, the same for all words, wherever a word
    repeats the one before it."""
    start, end, first = words(data, off)
    row, word = row_of(first), span_hash(prefix_sums(data), start, end)
    again = np.flatnonzero((word[1:] == word[:-1]) & (row[1:] == row[:-1])) + 1
    bucket = (word >> _SHIFT).astype(np.int32)
    return np.append(row, row[again]), np.append(bucket, np.full(len(again), AGAIN, np.int32))


def bag(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of one text and the share of its features that each has."""
    off = np.array([0, len(data)])
    found = [word_buckets(data, off)[1]] + [b[g] for b, g in grams(data, off)]
    index, count = np.unique(np.concatenate(found), return_counts=True)
    return index.astype(np.int32), (count / max(1, count.sum())).astype(np.float32)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, how: Sgd = Sgd()) -> Model:
    """One text at a time in a fixed mixed order, with a step that falls to zero."""
    rng = np.random.default_rng(7)
    vector = rng.uniform(-1 / how.size, 1 / how.size, (BUCKETS, how.size)).astype(np.float32)
    out = np.zeros((2, how.size), np.float32)
    target = np.eye(2, dtype=np.float32)[y.astype(int)]
    bias = np.log((target.sum(axis=0) + np.float32(how.prior)) / np.float32(len(bags) + 2 * how.prior))
    done = 0
    while done < how.steps:
        for i in rng.permutation(len(bags))[: how.steps - done]:
            step = np.float32(how.step * (1 - done / how.steps))
            done += 1
            index, share = bags[i]
            mean = share @ vector[index]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            error = p / p.sum() - target[i]
            back = error @ out
            out -= step * np.outer(error, mean)
            bias -= step * error * np.float32(0.1)
            vector[index] -= np.outer(share * (step * how.lift), back)
    difference = out[1] - out[0]
    return Model((vector @ difference).astype(np.float32), float(bias[1] - bias[0]))


def _train(how: Sgd):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags, y = [], []
        for batch in batches:
            for _, _, data, off in slices(batch.column("text")):
                bags += [bag(data[a:b]) for a, b in zip(off[:-1], off[1:])]
            y.append(batch.column("y").to_numpy())
        if not bags:
            return
        model = fit(bags, np.concatenate(y), how)
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.value.tobytes()], pa.binary()), pa.array([model.bias])], ["value", "bias"]
        )

    return run


def train(docs: DataFrame, labels: DataFrame, keep: Column | None = None, rows: int = TRAIN_ROWS,
          how: Sgd = Sgd(), label: str = "quality") -> Model:
    """Learn from about ``rows`` labelled texts for whose doc_id ``keep`` holds."""
    sample = labelled(docs, labels, label, F.lit(True) if keep is None else keep, rows)
    got = trained(sample, _train(how), "value binary, bias double")
    if not got:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    return Model(np.frombuffer(got[0].value, np.float32), got[0].bias)


def score_texts(column: pa.Array, model: Model) -> np.ndarray:
    out = []
    for i, j, data, off in slices(column):
        row, bucket = word_buckets(data, off)
        total = np.bincount(row, weights=model.value[bucket], minlength=j - i)
        count = np.bincount(row, minlength=j - i).astype(float)
        total = total.astype(float)
        for bucket, good in grams(data, off):
            sums = np.zeros((2, len(data) + 1))
            np.cumsum(np.where(good, model.value[bucket], 0), out=sums[0, 1 : 1 + len(good)], dtype=float)
            np.cumsum(good, out=sums[1, 1 : 1 + len(good)], dtype=float)
            sums[:, 1 + len(good) :] = sums[:, len(good), None]
            total += np.diff(sums[0][off])
            count += np.diff(sums[1][off])
        out.append(total / np.maximum(count, 1))
    mean = np.concatenate(out) if out else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(mean + model.bias, -35, 35)))


def quality_score(spark: SparkSession, text: Column | str, model: Model) -> Column:
    """Probability of label 1, a column over whole texts."""
    shared = spark.sparkContext.broadcast((model.value, model.bias))

    @arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Model(*shared.value)
        for column in batches:
            yield pa.array(score_texts(column, own))

    return score(text)


def quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; rows whose CRC-32 of the id
    leaves 1 modulo 3 are held out of the training."""
    part = split_no("doc_id", 3)
    model = train(docs, labels, part != 1, rows)
    scored = docs.select("doc_id", (part == 1).alias("held_out"), quality_score(docs.sparkSession, "text", model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
