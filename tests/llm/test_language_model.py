from __future__ import annotations

import math
import random
from collections import Counter

import pyspark.sql.functions as F
import pytest

from strataday.llm import language_model

from .conftest import passage

BYTES = 6


def steps(text):
    """(context, byte) of every byte of a text, by the rules; contexts nearest byte first."""
    stream = b"".join(w + b" " for w in (text or "").encode().lower().split()) + b" "
    held = b"\n" * BYTES + stream
    return [(held[i : i + BYTES][::-1], held[i + BYTES]) for i in range(len(stream))]


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


def added(x, y):
    return max(x, y) + math.log1p(math.exp(-abs(x - y)))


def plain_scores(train, texts):
    """log10 of the probability of each text by context-tree weighting, node by node."""
    seen = Counter()
    for text in train:
        for context, byte in steps(text):
            for k in range(8):
                for d in range(BYTES + 1):
                    seen[k, byte >> (8 - k), context[:d], (byte >> (7 - k)) & 1] += 1
    below = {}
    for k, prefix, context, _ in seen:
        if context:
            below.setdefault((k, prefix, context[:-1]), set()).add(context)
    known = {}

    def own(k, prefix, context):
        return [seen[k, prefix, context, v] for v in (0, 1)]

    def whole(k, prefix, context):
        if (k, prefix, context) not in known:
            here = kt(*own(k, prefix, context))
            if len(context) < BYTES:
                here = math.log(0.5) + added(here, sum(whole(k, prefix, c) for c in below.get((k, prefix, context), ())))
            known[k, prefix, context] = here
        return known[k, prefix, context]

    def chance(byte, context):
        out = 1.0
        for k in range(8):
            prefix, bit, p = byte >> (8 - k), (byte >> (7 - k)) & 1, 0.5
            for d in range(BYTES, -1, -1):
                n = own(k, prefix, context[:d])
                w = 1.0 if d == BYTES else math.exp(math.log(0.5) + kt(*n) - whole(k, prefix, context[:d]))
                p = w * (n[bit] + 0.5) / (sum(n) + 1) + (1 - w) * p
            out *= p
        return out

    return [sum(math.log10(chance(byte, context)) for context, byte in steps(text)) for text in texts]


@pytest.fixture(scope="module")
def some():
    r = random.Random(4)
    lines = ["the cat sat on the mat", "The dog sat on a log", "a cat and a dog", "on the mat the cat sat", "été où  l'été", None, ""]
    lines += [" ".join(r.choice(["the", "cat", "dog", "sat", "on", "mat"]) for _ in range(20)) for _ in range(5)]
    return [(i, t, i % 3 > 0) for i, t in enumerate(lines)]


@pytest.mark.parametrize("chunk, built", [(12 << 20, 1 << 17), (40, 3)])
def test_scores_are_those_of_plain_context_trees(spark, some, monkeypatch, chunk, built):
    monkeypatch.setattr(language_model, "CHUNK", chunk)
    monkeypatch.setattr(language_model, "BUILT", built)
    docs = spark.createDataFrame(some, "doc_id long, text string, learn boolean").coalesce(2)
    got = {r.doc_id: r.score for r in language_model.language_scores(docs, F.col("learn")).collect()}
    plain = plain_scores([t for _, t, learn in some if learn], [t for _, t, _ in some])
    assert len(got) == len(some)
    for (i, _, _), p in zip(some, plain):
        assert math.isclose(got[i], p, rel_tol=1e-5), (i, got[i], p)


def test_word_order_counts(spark):
    """The same words in another order than that of the training texts are less likely."""
    texts = [" ".join(passage(k % 4, 40)) for k in range(40)]
    words = texts[1].split()
    random.Random(1).shuffle(words)
    rows = [(k, t, True) for k, t in enumerate(texts)] + [(100, texts[1], False), (101, " ".join(words), False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learn boolean")
    got = {r.doc_id: r for r in language_model.language_scores(docs, F.col("learn")).collect()}
    assert got[100].score == got[1].score and got[100].score > got[101].score + 10
    assert math.isclose(got[100].base_score, got[101].base_score)
