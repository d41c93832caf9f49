"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

The seeds are all word n-grams of the test items: which of them an edited copy still has is
not known beforehand. A scan joins the passages with the items by these seeds, and aligns the words
around each hit with the item's words: a match scores 2, a mismatch or a gap -1, and the
score is given as a share of the item's own. Copies with edits, insertions and omissions
keep most of it; one without any three words of the item in a row is not found. Passages that
hold too few of the item's words to reach the limit are not aligned.

The scan reads the texts in place: only the items are sent out, in blocks of at most
``ITEMS`` whatever the size of the benchmark, and nothing is shuffled.
Words are compared in lower case without white space and ASCII punctuation.

Defined results: NULL and empty texts match nothing, nor do items without words; items
shorter than a seed are sought as a whole; very long texts are searched whole; repeated rows
get equal results; an empty table or benchmark gives no matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .texts import LOWER, SPACE_OR_PUNCTUATION, prefix_sums, row_of, shingle_hash, slices, span_hash, words

GRAM = 3
#: Share of an item's own score from which a passage counts as a copy of it.
SCORE = 0.5
#: Items that are sent out at once.
ITEMS = 20_000
#: Bytes of texts worked on at a time; workers keep tables of powers for the largest slice.
SLICE = 1 << 19
MATCH, OTHER = 2, 1
_HITS = "array<struct<item:int,score:double,start:int,words:int>>"


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes, and per row the index of its first word."""
    data = LOWER[data]
    start, end, first = words(data, off, SPACE_OR_PUNCTUATION)
    return span_hash(prefix_sums(data), start, end), first


class Seeds:
    """N-grams of the items, sorted, each with the items and offsets that it stands at."""

    def __init__(self, items: list[np.ndarray]):
        self.items = items
        gram, item, at, size = [], [], [], []
        for i, word in enumerate(items):
            n = min(GRAM, len(word))
            if n:
                own, _ = shingle_hash(word, np.array([0, len(word)]), n)
                gram.append(own)
                item.append(np.full(len(own), i))
                at.append(np.arange(len(own)))
                size.append(np.full(len(own), n))
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        self.gram, self.item, self.at, self.size = (
            join(gram, np.uint64), join(item, np.int64), join(at, np.int64), join(size, np.int64)
        )
        self._sort()

    def _sort(self) -> None:
        order = np.lexsort((self.at, self.item, self.gram))
        self.gram, self.item, self.at, self.size = (x[order] for x in (self.gram, self.item, self.at, self.size))
        self.keys, self.first = np.unique(self.gram, return_index=True)
        self.last = np.append(self.first[1:], len(self.gram))
        self.near = np.zeros(1 << 16, bool)
        self.near[self.keys >> np.uint64(48)] = True

    def hits(self, word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, key and word (within the slice) of every n-gram that is a seed."""
        rows, keys, places = [], [], []
        for n in np.unique(self.size):
            gram, at = shingle_hash(word, first, int(n))
            can = np.flatnonzero(self.near[gram >> np.uint64(48)])
            key = np.searchsorted(self.keys, gram[can])
            key[key == len(self.keys)] = 0
            good = self.keys[key] == gram[can]
            can, key = can[good], key[good]
            row = np.searchsorted(at, can, "right") - 1
            rows.append(row)
            keys.append(key)
            places.append(first[row] + can - at[row])
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, keys, places))


def align(item: np.ndarray, passages: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of the item with each passage, both as word hashes."""
    width = max(map(len, passages))
    held = np.zeros((len(passages), width), np.uint64)
    real = np.zeros((len(passages), width), bool)
    for k, p in enumerate(passages):
        held[k, : len(p)], real[k, : len(p)] = p, True
    column = np.arange(1, width + 1)
    above = np.zeros((len(passages), width + 1), np.int64)
    best = np.zeros(len(passages), np.int64)
    for word in item:
        fit = np.where((held == word) & real, MATCH, -OTHER)
        now = np.maximum(0, np.maximum(above[:, :-1] + fit, above[:, 1:] - OTHER))
        # A gap along the passage: the best score to the left less one a word.
        now = np.maximum.accumulate(now + column, axis=1) - column
        above[:, 1:] = now
        best = np.maximum(best, now.max(axis=1))
    return best


def matches(seeds: Seeds, word: np.ndarray, first: np.ndarray, limit: float) -> list[list[tuple]]:
    """For each row (item, score, first word, words) of the passages that reach the limit, the best of each item."""
    found: list[list[tuple]] = [[] for _ in range(len(first) - 1)]
    row, key, place = seeds.hits(word, first)
    count = seeds.last[key] - seeds.first[key]
    pick = np.repeat(seeds.first[key] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    row, item = np.repeat(row, count), seeds.item[pick]
    begin = np.repeat(place, count) - seeds.at[pick]
    order = np.lexsort((begin, item, row))
    row, item, begin = row[order], item[order], begin[order]
    length = np.fromiter(map(len, seeds.items), np.int64, len(seeds.items))
    cut = np.ones(len(row), bool)
    cut[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > length[item[1:]])
    at = np.flatnonzero(cut)
    ends = np.append(at[1:], len(row)) - 1 if len(at) else at
    by_item: dict[int, list[tuple[int, int, int]]] = {}
    for a, b in zip(at, ends):
        i, r = int(item[a]), int(row[a])
        # A gap costs half of what a match brings, so an alignment that reaches the limit has no more gap words.
        pad = int(MATCH / OTHER * max(0.0, 1 - limit) * length[i]) + 1
        lo = max(int(first[r]), int(begin[a]) - pad)
        hi = min(int(first[r + 1]), int(begin[b]) + int(length[i]) + pad)
        # Each match takes another word of the item, so this bounds the score from above.
        if np.isin(seeds.items[i], word[lo:hi]).sum() / length[i] >= limit:
            by_item.setdefault(i, []).append((r, lo, hi))
    for i, spans in by_item.items():
        spans.sort(key=lambda s: s[2] - s[1])
        top: dict[int, tuple] = {}
        for k in range(0, len(spans), 64):
            part = spans[k : k + 64]
            scores = align(seeds.items[i], [word[lo:hi] for _, lo, hi in part]) / (MATCH * len(seeds.items[i]))
            for (r, lo, hi), s in zip(part, scores):
                if s >= limit and (r not in top or s > top[r][1]):
                    top[r] = (i, float(s), lo - int(first[r]), hi - lo)
        for r, hit in top.items():
            found[r].append(hit)
    return found


def passages(spark: SparkSession, text: Column | str, seeds: Seeds, limit: float = SCORE) -> Column:
    """The items that a text holds: number in the block, score, first word, words."""
    shared = spark.sparkContext.broadcast(seeds)

    @arrow_udf(_HITS)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        kind = pa.list_(pa.struct([("item", pa.int32()), ("score", pa.float64()), ("start", pa.int32()), ("words", pa.int32())]))
        for column in batches:
            out: list[list[dict]] = []
            for _, _, data, off in slices(column, SLICE):
                for hits in matches(own, *_words(data, off), limit):
                    out.append([dict(zip(("item", "score", "start", "words"), h)) for h in hits])
            yield pa.array(out, kind)

    return search(text)


def item_blocks(benchmark: DataFrame, size: int = ITEMS) -> Iterator[list[tuple]]:
    """The test items (id, word hashes) in blocks, fetched one after the other."""
    block: list[tuple] = []
    for row in benchmark.select("item_id", "text").toLocalIterator():
        data = np.frombuffer((row.text or "").encode(), np.uint8)
        block.append((row.item_id, _words(data, np.array([0, len(data)]))[0]))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, limit: float = SCORE) -> DataFrame:
    """(doc_id, item_id, score, start_word, n_words) of every document and the test items it holds."""
    spark, out = docs.sparkSession, None
    for block in item_blocks(benchmark):
        seeds = Seeds([w for _, w in block])
        found = docs.select("doc_id", F.explode(passages(spark, docs["text"], seeds, limit)).alias("h"))
        names = F.array(*[F.lit(i).cast("long") for i, _ in block]) if len(block) < 1000 else None
        if names is None:
            ids = spark.createDataFrame(list(enumerate(i for i, _ in block)), "item int, item_id long")
            named = found.join(ids, found["h.item"] == ids["item"])
        else:
            named = found.withColumn("item_id", F.get(names, F.col("h.item")))
        hits = named.select(
            "doc_id", "item_id", F.col("h.score").alias("score"),
            F.col("h.start").alias("start_word"), F.col("h.words").alias("n_words"),
        )
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        none = F.lit(None)
        out = docs.select(
            "doc_id", none.cast("long").alias("item_id"), none.cast("double").alias("score"),
            none.cast("int").alias("start_word"), none.cast("int").alias("n_words"),
        ).where(F.lit(False))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, limit: float = SCORE) -> DataFrame:
    """The documents that hold no test item, with all their columns."""
    spark, out = docs.sparkSession, docs
    for block in item_blocks(benchmark):
        seeds = Seeds([w for _, w in block])
        out = out.where(F.size(passages(spark, out["text"], seeds, limit)) == 0)
    return out
