"""Ranked search against a plain account of the scores, with every list short, long or mixed."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from strataday.llm import lexical_search

SCHEMA = "doc_id long, text string, rank string, number long"


def terms(text):
    lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t, *_ in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    total, df = sum(n for _, _, n in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, count, n in held:
            m = 25 + 75 * n * len(held) // total
            s = sum(
                math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * (10**9 * count[t] // (1000 * count[t] + 8 * m))
                for t in terms(text) if count[t]
            )
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    common, rare = [f"w{i}" for i in range(12)], [f"Rare{i}é" for i in range(400)]
    docs = []
    for i in range(700):
        words = [r.choice(common) if r.random() < 0.8 else r.choice(rare) for _ in range(r.choice([1, 3, 20, 60]))]
        docs.append((i, " ".join(words), "x", 1))
    docs += [(800, None, "x", 1), (801, "", "x", 1), (802, " .,;\n\0", "x", 1), (803, "漢字 w1 W1,w1", "x", 1), docs[3], docs[3],
             (None, docs[7][1], None, None), (804, "w2 " * 30000 + "rare3é", "x", 1), (805, "q" * 5000, "x", 1)]
    items = [(i, " ".join(r.choice(common + rare) for _ in range(r.choice([1, 4, 25])))) for i in range(30)]
    items += [(50, "w1"), (51, None), (52, "?!"), (53, "unseen"), (54, "w1 w1 W1 rare7é"), (55, "漢字"), (56, "q" * 5000), (57, "")]
    return docs, items


@pytest.mark.parametrize("short, step, slice_bytes, window", [(32, 1024, 1 << 23, 1 << 21), (1, 7, 4000, 50), (10**9, 64, 9000, 333)])
def test_search_matches_brute_force(spark, corpus, monkeypatch, short, step, slice_bytes, window):
    docs, items = corpus
    statistics, vocabulary = _statistics(docs, items)
    block = lexical_search.Queries()
    for item in items:
        block.add(*item)
    best = [lexical_search.Best(10) for _ in items]
    monkeypatch.setattr(lexical_search, "SHORT", short)
    monkeypatch.setattr(lexical_search, "STEP", step)
    monkeypatch.setattr(lexical_search, "SLICE", slice_bytes)
    monkeypatch.setattr(lexical_search, "WINDOW", window)
    for row in _rows(docs, vocabulary):
        shard = lexical_search.Shard(row, statistics)
        for own, term, repeat in zip(best, block.terms, block.repeats):
            lexical_search.search_shard(shard, term, repeat, statistics, own)
    got = [
        (item, rank, None if null else int(doc), int(score))
        for (item, _), b in zip(items, best) for rank, (doc, null, score) in enumerate(zip(b.doc, b.null, b.score), 1)
    ]
    assert sorted(got, key=str) == brute(docs, items)


def _batch(docs):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays(
        [pa.array([d[0] for d in docs], pa.int64()), pa.array([d[1] for d in docs], pa.string())], ["doc_id", "text"]
    )


class _Shared:
    def __init__(self, value):
        self.value = value


def _rows(docs, vocabulary):
    for batch in lexical_search._index(_Shared(vocabulary))(iter([_batch(docs[:300]), _batch(docs[300:])])):
        yield {n: batch.column(n)[0].as_py() for n in batch.schema.names}


def _statistics(docs, items):
    block = lexical_search.Queries()
    for item in items:
        block.add(*item)
    vocabulary = list(block.words)
    rows = list(_rows(docs, vocabulary))
    df = np.zeros(len(vocabulary), np.int64)
    for r in rows:
        df[np.frombuffer(r["term"], "<i4")] += np.diff(np.frombuffer(r["first"], "<i4"))
    return lexical_search.Statistics.of(sum(r["held"] for r in rows), sum(r["total"] for r in rows), df), vocabulary


def test_query_over_tables_in_several_blocks(spark, corpus):
    docs, items = corpus
    d = spark.createDataFrame(docs, SCHEMA).repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert sorted(map(tuple, lexical_search.search(d, q).collect()), key=str) == want
    assert sorted(map(tuple, lexical_search.search(d, q, block_bytes=300).collect()), key=str) == want
    three = brute(docs, items, 3)
    assert sorted(map(tuple, lexical_search.search(d, q, 3).collect()), key=str) == three


def test_repeated_queries_and_empty_tables(spark, corpus, docs, empty):
    some = spark.createDataFrame([(1, "w1 rare3é"), (1, "w1 rare3é"), (None, "w2")], "item_id long, text string")
    got = [tuple(r) for r in lexical_search.search(spark.createDataFrame(corpus[0], SCHEMA), some).collect()]
    want = brute(corpus[0], [(1, "w1 rare3é"), (1, "w1 rare3é"), (None, "w2")])
    assert sorted(got, key=str) == want
    assert lexical_search.search(empty, some).count() == 0
    assert lexical_search.search(docs, some.where("false")).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert lexical_search.search(blank, some).count() == 0


def test_terms_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(lexical_search, "span_hash", lambda sums, start, end: (end - start).astype(np.uint64))
    vocabulary = lexical_search.Vocabulary([b"ab", b"cd", b"xyz", b"ef"])
    data = np.frombuffer(b"cd ef zz ab xyz xyy", np.uint8)
    start, end, _ = lexical_search.words(data, np.array([0, len(data)]), lexical_search.GAPS)
    assert vocabulary.find(data, start, end).tolist() == [1, 3, -1, 0, 2, -1]
