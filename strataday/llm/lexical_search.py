"""Ranked lexical search: accumulators of short lists, then document-at-a-time over long ones.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII; A-Z count as
a-z. A document with n terms scores, for each term of a query, w * (10^9 tf div (1000 tf + 8 m)), with
w = floor(1000 ln((2N + 2) / (2df + 1))) and m = 25 + (75 n N div L); N documents hold L terms.

The queries of a block (``BLOCK_BYTES`` of text; a longer query is a block of its own) are sent out.
One scan of the documents writes an index of their terms, a row for some thousand
documents: the postings of each term in order of documents, its highest tf and its lowest
n. Sums over these rows give N, L and df. The second job reads the index. For a query and a row of the index

1. the bounds of its lists are added up; a row that can't reach the query's tenth best score so far is skipped;
2. postings of short lists (df at most 1 / ``SHORT`` of N) are added up term by term: the
   accumulators then stand as one list whose bound is the highest sum in it;
3. that list and the long lists are gone through document by document, ``STEP`` documents at once: those
   whose bounds together can't reach the tenth score bring up no documents of their own and are only probed
   for documents that can still reach it, the strongest first.

Each task keeps the best of each query; the last shuffle moves those only. Nothing is dropped that could be
among the best, so results are exact, ties included.

Defined results: NULL and empty texts have no terms, aren't counted and are not found; queries without terms
and documents with score 0 give no rows. Documents are rows: repeated rows and ids all count
and may fill several ranks, in no fixed order among equal ids; NULL ids come last among equal scores. Each
row of the queries is ranked by itself. Very long texts are read whole, in windows cut between terms.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written
from .lookup import Lookup
from .texts import LOWER, prefix_sums, slices, span_hash, words

#: Bytes that end a term.
GAPS = np.ones(256, bool)
GAPS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
BLOCK_BYTES = 1 << 23
SHORT = 32
STEP = 1024
SLICE = 1 << 23
WINDOW = 1 << 21
_INDEX = "docs array<long>, n binary, term binary, first binary, most binary, least binary, doc binary, tf binary, held long, total long"


@dataclass
class Queries:
    """A block of queries: their ids, and of each the numbers of its terms with their repeats."""

    ids: list[int | None] = field(default_factory=list)
    terms: list[np.ndarray] = field(default_factory=list)
    repeats: list[np.ndarray] = field(default_factory=list)
    words: dict[bytes, int] = field(default_factory=dict)
    size: int = 0

    def add(self, query_id: int | None, text: str | None) -> None:
        raw = (text or "").encode()
        data = LOWER[np.frombuffer(raw, np.uint8)]
        start, end, _ = words(data, np.array([0, len(data)]), GAPS)
        flat = data.tobytes()
        numbers = [self.words.setdefault(flat[a:b], len(self.words)) for a, b in zip(start, end, strict=True)]
        term, n = np.unique(np.array(numbers, np.int64), return_counts=True)
        self.ids.append(query_id)
        self.terms.append(term)
        self.repeats.append(n)
        self.size += len(raw)


class Vocabulary:
    """Numbers of the terms that any query of a block holds; compared byte by byte."""

    def __init__(self, terms: list[bytes]):
        self.data = np.frombuffer(b"".join(terms), np.uint8)
        self.off = np.zeros(len(terms) + 1, np.int64)
        np.cumsum([len(t) for t in terms], out=self.off[1:])
        hashes = span_hash(prefix_sums(self.data), self.off[:-1], self.off[1:])
        # Terms of one hash stand behind each other, and are tried one after the other.
        order = np.argsort(hashes, kind="stable")
        self.order, keys = order, hashes[order]
        self.keys, self.first, self.many = np.unique(keys, return_index=True, return_counts=True)
        self.lookup = Lookup(self.keys)

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of the term in each span, -1 if there is none."""
        out = np.full(len(start), -1, np.int64)
        if not len(start) or not len(self.keys):
            return out
        key = self.lookup.find(span_hash(prefix_sums(data), start, end))
        left = np.flatnonzero(key >= 0)
        for k in range(int(self.many.max())):
            left = left[(self.many[key[left]] > k) & (out[left] < 0)]
            term = self.order[self.first[key[left]] + k]
            size = self.off[term + 1] - self.off[term]
            same = size == end[left] - start[left]
            term, at, size = term[same], left[same], size[same]
            begin = np.cumsum(size) - size
            step = np.arange(int(size.sum())) - np.repeat(begin, size)
            equal = data[np.repeat(start[at], size) + step] == self.data[np.repeat(self.off[term], size) + step]
            good = np.ones(len(at), bool)
            if len(at):
                good = np.logical_and.reduceat(equal, begin)
            out[at[good]] = term[good]
        return out


def _windows(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about WINDOW bytes that cut no term, and rows only if they are longer than that."""
    a = 0
    while a < len(data):
        b = min(a + WINDOW, len(data))
        if b < len(data):
            row = int(off[np.searchsorted(off, b, "right") - 1])
            if row > a:
                b = row
            else:
                gap = np.flatnonzero(GAPS[data[a:b]])
                while not len(gap) and b < len(data):  # one term longer than the window
                    gap, b = np.flatnonzero(GAPS[data[b : b + WINDOW]]) + b - a, min(b + WINDOW, len(data))
                b = a + int(gap[-1]) + 1 if len(gap) else b
        yield a, b
        a = b


def postings(vocabulary: Vocabulary, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n of each row; term, row and tf of each posting in order of term and row)."""
    n = np.zeros(len(off) - 1, np.int64)
    pairs, counts = [], []
    width = max(1, len(off) - 1)
    for a, b in _windows(data, off):
        part = LOWER[data[a:b]]
        edges = np.unique(np.clip(off, a, b)) - a
        start, end, _ = words(part, edges, GAPS)
        row = np.searchsorted(off, start + a, "right") - 1
        n += np.bincount(row, minlength=len(n))
        term = vocabulary.find(part, start, end)
        hit = term >= 0
        pair, count = np.unique(term[hit] * width + row[hit], return_counts=True)
        pairs.append(pair)
        counts.append(count)
    if not pairs:
        none = np.zeros(0, np.int64)
        return n, none, none, none
    pair, at = np.unique(np.concatenate(pairs), return_inverse=True)
    tf = np.zeros(len(pair), np.int64)
    np.add.at(tf, at, np.concatenate(counts))
    return n, pair // width, pair % width, tf


def _index(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value)
        names = [x.split(" ")[0] for x in _INDEX.split(", ")]
        for batch in batches:
            ids = batch.column("doc_id")
            for i, j, data, off in slices(batch.column("text"), SLICE):
                n, term, row, tf = postings(vocabulary, data, off)
                # Documents without any of the terms only count.
                rows, doc = np.unique(row, return_inverse=True)
                terms, first = np.unique(term, return_index=True)
                most = np.maximum.reduceat(tf, first) if len(terms) else tf
                least = np.minimum.reduceat(n[row], first) if len(terms) else tf
                binary = [
                    n[rows].astype("<i8"), terms.astype("<i4"), np.append(first, len(term)).astype("<i4"), most.astype("<i8"),
                    least.astype("<i8"), doc.astype("<i4"), tf.astype("<i8"),
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids.slice(i, j - i).take(pa.array(rows)).to_pylist()], pa.list_(pa.int64())),
                     *(pa.array([x.tobytes()], pa.binary()) for x in binary),
                     pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64())],
                    names,
                )

    return run


def _frequencies(terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(terms, np.int64)
        for batch in batches:
            for term, first in zip(batch.column("term"), batch.column("first"), strict=True):
                df[np.frombuffer(term.as_py(), "<i4")] += np.diff(np.frombuffer(first.as_py(), "<i4"))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], ["term", "df"])

    return run


@dataclass(frozen=True)
class Statistics:
    """Documents with terms, all their terms, and for each term of a block its df and its weight."""

    held: int
    total: int
    df: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, held: int, total: int, df: np.ndarray) -> Statistics:
        return cls(held, total, df, np.array([math.floor(1000 * math.log((2 * held + 2) / (2 * int(x) + 1))) for x in df], np.int64))

    def length(self, n: np.ndarray) -> np.ndarray:
        """m of documents with n terms; Python's integers, as n * N may pass 64 bits."""
        return np.array([25 + 75 * x * self.held // self.total for x in n.tolist()], np.int64)


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Best:
    """The k best (score, place, id) of a query; equal scores by id, NULL last."""

    def __init__(self, k: int):
        self.k, self.floor = k, 0
        self.score, self.doc, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def put(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        self.score, self.doc, self.null = (np.concatenate(x) for x in ((self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort((self.doc, self.null, -self.score))[: self.k]
        self.score, self.doc, self.null = self.score[order], self.doc[order], self.null[order]
        if len(order) == self.k:
            self.floor = int(self.score[-1])


class Shard:
    """A row of the index."""

    def __init__(self, row: dict, statistics: Statistics):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.id = np.array([0 if x is None else x for x in row["docs"]], np.int64)
        self.null = np.array([x is None for x in row["docs"]], bool)
        self.m = statistics.length(read("n", "<i8"))
        self.first, self.doc, self.tf = read("first", "<i4"), read("doc", "<i4"), read("tf", "<i8")
        self.bound = gain(read("most", "<i8"), statistics.length(read("least", "<i8")))
        self.list = np.full(len(statistics.df), -1, np.int64)
        term = read("term", "<i4")
        self.list[term] = np.arange(len(term))

    def postings(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.first[at], self.first[at + 1])
        return self.doc[part], self.tf[part]


class Postings:
    """A long list, whose gains are worked out for the documents that are asked for."""

    def __init__(self, shard: Shard, at: int, weight: int):
        self.doc, self.tf = shard.postings(at)
        self.m, self.weight, self.bound = shard.m, weight, weight * int(shard.bound[at])

    def gains(self, at) -> np.ndarray:
        return self.weight * gain(self.tf[at], self.m[self.doc[at]])


class Accumulators:
    """The sums of all short lists, as one list."""

    def __init__(self, shard: Shard, lists: list[tuple[int, int]]):
        held = [(*shard.postings(at), weight) for at, weight in lists]
        doc = np.concatenate([d for d, _, _ in held])
        value = np.concatenate([w * gain(tf, shard.m[d]) for d, tf, w in held])
        order = np.argsort(doc, kind="stable")
        doc, value = doc[order], value[order]
        starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        self.doc, self.value = doc[starts], np.add.reduceat(value, starts)
        self.bound = int(self.value.max())

    def gains(self, at) -> np.ndarray:
        return self.value[at]


def search_shard(shard: Shard, terms: np.ndarray, repeats: np.ndarray, statistics: Statistics, best: Best) -> None:
    """Put the shard's documents that are among the query's best into ``best``."""
    at = shard.list[terms]
    weight = statistics.weight[terms] * repeats
    some = (at >= 0) & (weight > 0)
    terms, at, weight = terms[some], at[some], weight[some]
    if not len(at) or int((weight * shard.bound[at]).sum()) < best.floor:
        return
    short = statistics.df[terms] * SHORT <= statistics.held
    lists: list = [Postings(shard, int(a), int(w)) for a, w in zip(at[~short], weight[~short])]
    if short.any():
        lists.append(Accumulators(shard, list(zip(at[short].tolist(), weight[short].tolist()))))
    lists.sort(key=lambda x: x.bound)
    reach = np.cumsum([x.bound for x in lists])  # what the lists up to each can give together
    leading = 0
    for begin in range(0, len(shard.m), STEP):
        while leading < len(lists) and reach[leading] < best.floor:
            leading += 1
        if leading == len(lists):
            return
        docs, values = [], []
        for x in lists[leading:]:
            part = slice(*np.searchsorted(x.doc, (begin, begin + STEP)))
            docs.append(x.doc[part])
            values.append(x.gains(part))
        sums = np.zeros(STEP, np.int64)
        seen = np.zeros(STEP, bool)
        for d, v in zip(docs, values):
            sums[d - begin] += v  # a list holds a document once
            seen[d - begin] = True
        doc = np.flatnonzero(seen)
        score = sums[doc]
        doc = doc + begin
        for k in range(leading - 1, -1, -1):
            can = score + reach[k] >= best.floor
            doc, score = doc[can], score[can]
            if not len(doc):
                break
            own = lists[k].doc
            place = np.searchsorted(own, doc)
            place[place == len(own)] = 0
            hit = np.flatnonzero(own[place] == doc)
            score[hit] += lists[k].gains(place[hit])
        can = (score >= best.floor) & (score > 0)
        if can.any():
            doc = doc[can]
            best.put(score[can], shard.id[doc], shard.null[doc])


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms, repeats, statistics = shared.value
        best = [Best(k) for _ in ids]
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
                shard = Shard(row, statistics)
                for own, term, repeat in zip(best, terms, repeats, strict=True):
                    search_shard(shard, term, repeat, statistics, own)
        number = np.repeat(np.arange(len(ids)), [len(b.score) for b in best])
        doc = [None if null else int(d) for b in best for d, null in zip(b.doc, b.null)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(number, pa.int64()), pa.array([ids[i] for i in number], pa.int64()), pa.array(doc, pa.int64()),
             pa.array(np.concatenate([b.score for b in best]) if best else [], pa.int64())],
            ["number", "item_id", "doc_id", "score"],
        )

    return run


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[Queries]:
    """The queries in blocks of bounded text, read from the cluster part by part."""
    block = Queries()
    for row in items.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        size = len((row.text or "").encode())
        if block.ids and block.size + size > block_bytes:
            yield block
            block = Queries()
        block.add(row.item_id, row.text)
    if block.ids:
        yield block


def _search_block(docs: DataFrame, block: Queries, k: int) -> DataFrame | None:
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(list(block.words))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text") != "")
    index = written(rows.mapInArrow(_index(vocabulary), _INDEX), "lexical-index")
    sums = index.agg(F.sum("held").alias("held"), F.sum("total").alias("total")).first()
    if not sums.total:
        return None
    df = np.zeros(len(block.words), np.int64)
    counted = index.select("term", "first").mapInArrow(_frequencies(len(df)), "term int, df long")
    for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r.term] = r.df
    statistics = Statistics.of(sums.held, sums.total, df)
    shared = spark.sparkContext.broadcast((block.ids, block.terms, block.repeats, statistics))
    found = index.drop("held", "total").mapInArrow(_search(shared, k), "number long, item_id long, doc_id long, score long")
    order = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents that score highest for each row of ``items`` (item_id, text)."""
    found = [x for x in (_search_block(docs, block, k) for block in _blocks(items, block_bytes)) if x is not None]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out
