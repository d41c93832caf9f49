"""Language-model scores by context-tree weighting over bytes.

A text is its lower-cased words, each followed by a space, and an end, which is a
space where a word would begin. Before its first byte stand bytes that no text has (``START``).

Every byte is decomposed into eight binary choices. Each choice has a tree of contexts: the
0 to ``BYTES`` bytes before it, nearest first, which run over spaces into the words before. A
node holds the Krichevsky-Trofimov estimate of what followed it in the training texts, and weighs it
against its children by how well both would have coded them. The mixture over all depths
gives the probability of the choice; -log2 of it is the code length.

Texts are dealt to chunks of about ``CHUNK`` bytes. A chunk asks once for each of its distinct (context, byte)
codes and words, with how often its training texts have them. Codes with equal two bytes of context meet in one
part, as do equal words; a part adds up the counts of all chunks and builds the nodes with two bytes of context
or more. Only the depths above, at most 256 x 255 nodes whatever the corpus, and the totals of words are added up
across parts and sent out. Then the parts answer each chunk, which adds up its texts byte by byte.

Defined results: NULL and empty texts consist of the end only; very long texts and words are
scored whole; repeated rows get equal scores; without training rows every choice costs one
bit; an empty table gives an empty result.

``word_scores`` gives what words cost on their own, at the beginning of a text of a class, the one of the
``CLASSES`` most frequent words that the text has most often: contexts end where the word begins, then comes the class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .alignment import _pack, _pack_small, _unpack, _unpack_small
from .common import shuffle_parts, split_no, written
from .texts import LOWER, SPACE as GAPS, distinct_in_rows, mix, prefix_sums, row_of, slices, span_hash, words

#: Bytes of the longest context of a text.
BYTES = 6
#: Depths of the trees of single words: six bytes and the class.
DEPTH = 7
#: Bytes of text that ask together.
CHUNK = 32 << 20
#: Bytes of text whose codes are held at once; one text alone may have more.
SLICE = 1 << 20
#: Codes whose trees are built at once, unless one pair of bytes has more.
BUILT = 1 << 16
#: Stands before a text; words and spaces between them never are this byte.
START = 0x0A
CLASSES = 64
#: Words that a task counts before it passes them on.
COUNTED = 400_000
SPACE = 0x20
_HALF = np.log(0.5)
#: Stands for the end among the words; no word is empty.
END = 0
_LOG10 = np.log(10)
#: Words with equal first bytes meet in one part, where they share most of their contexts, up to a part's share.
PREFIX = 4
#: Parts of the vocabulary for each shuffle partition.
PARTS = 4
_CLASS_ODD = np.uint64(0xD1B54A32D192ED03)


def classes_of(hashes: np.ndarray, row: np.ndarray, rows: int, class_words: np.ndarray) -> np.ndarray:
    """Class of each row: the class word that it has most often, the more frequent one if
    several are; ``CLASSES`` where it has none. ``class_words``: hashes, most frequent first."""
    if not len(class_words):
        return np.full(rows, CLASSES)
    order = np.argsort(class_words)
    place = np.searchsorted(class_words[order], hashes)
    place[place == len(order)] = 0
    hit = class_words[order][place] == hashes
    counts = np.bincount(row[hit] * len(order) + order[place[hit]], minlength=rows * len(order)).reshape(rows, -1)
    return np.where(counts.any(axis=1), counts.argmax(axis=1), CLASSES)


def pair_hash(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Key of a word within a class."""
    return mix(hashes + (classes.astype(np.uint64) + np.uint64(1)) * _CLASS_ODD)


# --- words ------------------------------------------------------------------

def _word_strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    length = end - start
    off = np.zeros(len(start) + 1, np.int32)
    np.cumsum(length, out=off[1:])
    held = data[np.repeat(start - off[:-1], length) + np.arange(off[-1])]
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(held.tobytes())])


class _Counter:
    """Counts by key, with what else belongs to a key, merged slice by slice."""

    def __init__(self):
        self.key, self.count = np.zeros(0, np.uint64), np.zeros(0)
        self.at, self.parts, self.held = np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray, count: np.ndarray, describe) -> None:
        """Distinct keys, sorted; ``describe`` gives the arrays that belong to some of them."""
        place = np.searchsorted(self.key, keys)
        known = place < len(self.key)
        known[known] = self.key[place[known]] == keys[known]
        self.count[place[known]] += count[known]
        new = np.flatnonzero(~known)
        if len(new):
            self.parts.append(describe(new))
            order = np.argsort(np.concatenate([self.key, keys[new]]), kind="stable")
            self.key = np.concatenate([self.key, keys[new]])[order]
            self.count = np.concatenate([self.count, count[new]])[order]
            self.at = np.concatenate([self.at, self.held + np.arange(len(new))])[order]
            self.held += len(new)

    def columns(self) -> list[pa.Array]:
        """What belongs to the keys, in their order."""
        return [pa.concat_arrays(list(x)).take(pa.array(self.at)) for x in zip(*self.parts)]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush() -> pa.RecordBatch:
        some = counter.count > 0
        return pa.RecordBatch.from_arrays(
            [pa.array(counter.key[some].view(np.int64)), pa.array(counter.count[some].astype(np.int64))], ["hash", "n"]
        )

    counter = _Counter()
    for batch in batches:
        learn = np.asarray(batch.column("learn")).astype(float)
        for i, j, data, off in slices(batch.column("text")):
            data = LOWER[data]
            start, end, first = words(data, off)
            hashes, of = np.unique(span_hash(prefix_sums(data), start, end), return_inverse=True)
            counter.add(hashes, np.bincount(of, weights=learn[i:j][row_of(first)], minlength=len(hashes)), lambda new: ())
            if len(counter.key) >= COUNTED:
                yield flush()
                counter = _Counter()
    yield flush()


def _count_pairs(class_words: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            own = [pa.array(counter.key.view(np.int64)), *counter.columns(), pa.array(counter.count.astype(np.int64))]
            return pa.RecordBatch.from_arrays(own, ["pair", "hash", "word", "class", "n"])

        counter, ends = _Counter(), np.zeros(CLASSES + 1, np.int64)
        for batch in batches:
            learn = np.asarray(batch.column("learn")).astype(float)
            for i, j, data, off in slices(batch.column("text")):
                data = LOWER[data]
                start, end, first = words(data, off)
                hashes, row = span_hash(prefix_sums(data), start, end), row_of(first)
                kind = classes_of(hashes, row, j - i, class_words)
                ends += np.bincount(kind, weights=learn[i:j], minlength=CLASSES + 1).astype(np.int64)
                pairs, at, of = np.unique(pair_hash(hashes, kind[row]), return_index=True, return_inverse=True)
                count = np.bincount(of, weights=learn[i:j][row], minlength=len(pairs))
                counter.add(pairs, count, lambda new: (
                    pa.array(hashes[at[new]].view(np.int64)), _word_strings(data, start[at[new]], end[at[new]]),
                    pa.array(kind[row[at[new]]].astype(np.int32)),
                ))
                if len(counter.key) >= COUNTED:
                    yield flush()
                    counter = _Counter()
        if len(counter.key):
            yield flush()
        kind = np.arange(CLASSES + 1)
        end = np.full(CLASSES + 1, END, np.uint64)
        yield pa.RecordBatch.from_arrays([
            pa.array(pair_hash(end, kind).view(np.int64)), pa.array(end.view(np.int64)),
            pa.array([b""] * len(kind)), pa.array(kind.astype(np.int32)), pa.array(ends),
        ], ["pair", "hash", "word", "class", "n"])

    return run


def class_words(rows: DataFrame) -> np.ndarray:
    """Hashes of the most frequent words of the training texts, by exact counts."""
    counted = rows.where("learn").mapInArrow(_count_words, "hash long, n long")
    top = counted.groupBy("hash").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "hash").limit(CLASSES).collect()
    return np.array([r.hash for r in top], np.int64).view(np.uint64)


def word_counts(rows: DataFrame, class_words: np.ndarray) -> DataFrame:
    """(pair, hash, word, class, n, total) of every distinct word of each class of texts,
    and of the end; n and total (over all classes) count training texts only."""
    counted = rows.mapInArrow(_count_pairs(class_words), "pair long, hash long, word binary, class int, n long")
    # One shuffle for the counts and the totals.
    counts = counted.repartition(shuffle_parts(rows.sparkSession), "hash").groupBy("pair", "hash", "word", "class").agg(
        F.sum("n").alias("n")
    )
    # A word has at most one row a class.
    return counts.withColumn("total", F.sum("n").over(W.partitionBy("hash")))


def _in_parts(vocabulary: DataFrame) -> DataFrame:
    """The vocabulary with the part of each row. Words with equal first bytes share one, unless they
    are more than a part's share of all rows: then they go to as many parts as they have shares."""
    n = PARTS * shuffle_parts(vocabulary.sparkSession)
    named = vocabulary.withColumn("prefix", F.substring("word", 1, PREFIX))
    share = max(1, named.count() // n)
    large = named.groupBy("prefix").agg(F.count("*").alias("rows")).where(F.col("rows") > 2 * share).select(
        "prefix", F.ceil(F.col("rows") / share).alias("pieces")
    )
    # At most one large prefix a part.
    piece = F.pmod("pair", F.coalesce("pieces", F.lit(1)))
    return named.join(F.broadcast(written(large, "prefixes")), "prefix", "left").withColumn(
        "part", F.pmod(F.xxhash64("prefix", piece), F.lit(n)).cast("int")
    ).drop("prefix", "pieces")


# --- context trees ----------------------------------------------------------

def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function, for x of 0.5 and more."""
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1) - np.log(np.pi)


def codes(data: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per byte of each word and the space behind it: its context, nearest byte first, the
    class and itself, in 64 bits; its place in the word."""
    n = np.diff(off) + 1
    first = np.cumsum(n) - n
    total = int(n.sum())
    stream = np.full(total, SPACE, np.uint64)
    place = np.arange(total) - np.repeat(first, n)
    inside = np.ones(total, bool)
    inside[first + n - 1] = False
    stream[inside] = data
    code = stream | (np.repeat(kind.astype(np.uint64), n) << np.uint64(8))
    for back in range(1, BYTES + 1):
        has = np.flatnonzero(place >= back)
        code[has] |= stream[has - back] << np.uint64(8 * (DEPTH + 1 - back))
    return code, place


class Trees:
    """All context trees below a set of two-byte contexts: nodes of depth 2 and more."""

    def __init__(self, code: np.ndarray, n: np.ndarray, depth: int = DEPTH):
        """``code``: distinct and sorted; ``n``: how often each was seen in training; ``depth``: of the longest contexts."""
        self.code, self.depth = code, depth
        self.keys, self.up = {depth: code}, {}
        count = {depth: n}
        for d in range(depth - 1, 1, -1):
            key = self.keys[d + 1]
            short = ((key >> np.uint64(16)) << np.uint64(8)) | (key & np.uint64(255))
            self.keys[d], self.up[d] = np.unique(short, return_inverse=True)
            count[d] = np.bincount(self.up[d], weights=count[d + 1], minlength=len(self.keys[d]))
        self.tops = []
        self.chance = np.empty((8, len(code)))
        for k in range(8):
            self._choice(k, count)

    def _choice(self, k: int, count: dict) -> None:
        """Nodes of one binary choice, from the deepest up; then its chances, from depth 2 on."""
        node, seen, weight = {}, {}, {}
        below = None
        for d in range(self.depth, 1, -1):
            key = self.keys[d]
            prefix = key >> np.uint64(8 - k)
            change = np.ones(len(key), bool)
            change[1:] = prefix[1:] != prefix[:-1]
            node[d] = np.cumsum(change) - 1
            bit = (key >> np.uint64(7 - k)) & np.uint64(1)
            size = int(change.sum())
            a, b = (np.bincount(node[d], weights=count[d] * (bit == v), minlength=size) for v in (0, 1))
            own = log_kt(a, b)
            if below is None:
                whole, weight[d] = own, np.ones(size)
            else:
                parent = node[d][self.up[d][below[1]]]
                split = np.bincount(parent, weights=below[0], minlength=size)
                whole = _HALF + np.logaddexp(own, split)
                weight[d] = np.exp(_HALF + own - whole)
            below = whole, np.flatnonzero(change)
            seen[d] = a, b
        first = self.keys[2][below[1]]
        self.tops.append((
            (first >> np.uint64(16)).astype(np.int64),
            (np.int64(1) << k) | (((first & np.uint64(255)) >> np.uint64(8 - k)).astype(np.int64)),
            seen[2][0], seen[2][1], below[0],
        ))
        bit = ((self.code >> np.uint64(7 - k)) & np.uint64(1)).astype(bool)
        at = {self.depth: np.arange(len(self.code))}
        for d in range(self.depth - 1, 1, -1):
            at[d] = self.up[d][at[d + 1]]
        chance = np.full(len(self.code), 0.5)
        for d in range(self.depth, 1, -1):
            n = node[d][at[d]]
            a, b = seen[d][0][n], seen[d][1][n]
            own = (np.where(bit, b, a) + 0.5) / (a + b + 1)
            w = weight[d][n]
            chance = w * own + (1 - w) * chance
        self.chance[k] = chance

    def top_nodes(self) -> pa.RecordBatch:
        """What depth 2 adds to the nodes of depth 1: (byte, node, zeros, ones, logarithm of the weighted probability)."""
        byte, node, a, b, log_p = (np.concatenate(x) for x in zip(*self.tops))
        where, of = np.unique(byte * 256 + node, return_inverse=True)
        sums = [np.bincount(of, weights=v, minlength=len(where)) for v in (a, b, log_p)]
        return pa.RecordBatch.from_arrays(
            [pa.array(where // 256), pa.array(where % 256), *map(pa.array, sums)], ["byte", "node", "a", "b", "log_p"]
        )

    def log_probability(self, top: "Top") -> np.ndarray:
        """Natural logarithm of the probability of each code's byte in its context."""
        byte = (self.code >> np.uint64(8 * self.depth)).astype(np.int64)
        symbol = (self.code & np.uint64(255)).astype(np.int64)
        total = np.zeros(len(self.code))
        for k in range(8):
            node = (1 << k) | (symbol >> (8 - k))
            bit = (symbol >> (7 - k)) & 1
            total += np.log(top.mix(byte, node, bit, self.chance[k]))
        return total


class Top:
    """The nodes of depth 0 and 1: their weights and estimates."""

    def __init__(self, byte, node, a, b, log_p):
        def table(values) -> np.ndarray:
            t = np.zeros((256, 256))
            t[byte, node] = values
            return t

        a1, b1, split = table(a), table(b), table(log_p)
        own = log_kt(a1, b1)
        whole = _HALF + np.logaddexp(own, split)
        self.weight1, self.one1 = np.exp(_HALF + own - whole), (b1 + 0.5) / (a1 + b1 + 1)
        a0, b0 = a1.sum(0), b1.sum(0)
        own = log_kt(a0, b0)
        whole = _HALF + np.logaddexp(own, whole.sum(0))
        self.weight0, self.one0 = np.exp(_HALF + own - whole), (b0 + 0.5) / (a0 + b0 + 1)

    def mix(self, byte, node, bit, deeper):
        one = self.one1[byte, node]
        w = self.weight1[byte, node]
        chance = w * np.where(bit, one, 1 - one) + (1 - w) * deeper
        one, w = self.one0[node], self.weight0[node]
        return w * np.where(bit, one, 1 - one) + (1 - w) * chance


def _word_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = np.asarray(batch.column("n")).astype(float)
        for i, j, data, off in slices(batch.column("word")):
            code, _ = codes(data, off, np.asarray(batch.column("class"))[i:j])
            code, of = np.unique(code, return_inverse=True)
            seen = np.bincount(of, weights=np.repeat(n[i:j], np.diff(off) + 1), minlength=len(code))
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(seen.astype(np.int64))], ["code", "n"])


def _trees(batches: Iterator[pa.RecordBatch]) -> Trees | None:
    got = [(np.asarray(b.column("code")).view(np.uint64), np.asarray(b.column("n"))) for b in batches]
    if not sum(len(c) for c, _ in got):
        return None
    code, n = (np.concatenate(x) for x in zip(*got))
    order = np.argsort(code)
    return Trees(code[order], n[order].astype(float))


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trees = _trees(batches)
    if trees:
        yield trees.top_nodes()


def _log_probabilities(top):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _trees(batches)
        if trees:
            yield pa.RecordBatch.from_arrays(
                [pa.array(trees.code.view(np.int64)), pa.array(trees.log_probability(top.value))], ["code", "log_p"]
            )

    return run


def byte_probabilities(vocabulary: DataFrame) -> DataFrame:
    """(code, log_p) of every byte and context among the words."""
    spark = vocabulary.sparkSession
    seen = vocabulary.mapInArrow(_word_codes, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    seen = written(seen, "codes").repartition(shuffle_parts(spark), F.shiftrightunsigned("code", 48))
    nodes = seen.mapInArrow(_tops, "byte long, node long, a double, b double, log_p double").groupBy("byte", "node").agg(
        *[F.sum(c).alias(c) for c in ("a", "b", "log_p")]
    ).toArrow()  # at most 256 x 255 rows
    top = Top(*[np.asarray(nodes[c].combine_chunks()) for c in ("byte", "node", "a", "b", "log_p")])
    return seen.mapInArrow(_log_probabilities(spark.sparkContext.broadcast(top)), "code long, log_p double")


def _codes_of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct codes of the words of each part."""
    for batch in batches:
        part, kind = np.asarray(batch.column("part")), np.asarray(batch.column("class"))
        for i, j, data, off in slices(batch.column("word")):
            code, _ = codes(data, off, kind[i:j])
            own, code = distinct_in_rows(np.repeat(part[i:j], np.diff(off) + 1), code)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(code.view(np.int64))], ["part", "code"])


def _add_up(key, vocabulary: pa.Table, found: pa.Table) -> pa.Table:
    """Probabilities of a part's words, from those of its codes."""
    known = np.asarray(found["code"].combine_chunks()).view(np.uint64)
    order = np.argsort(known)
    known, log_p = known[order], np.asarray(found["log_p"].combine_chunks())[order]
    total = np.zeros(len(vocabulary))
    kind = np.asarray(vocabulary["class"].combine_chunks())
    for i, j, data, off in slices(vocabulary["word"].combine_chunks()):
        code, _ = codes(data, off, kind[i:j])
        word = np.repeat(np.arange(j - i), np.diff(off) + 1)
        total[i:j] = np.bincount(word, weights=log_p[np.searchsorted(known, code)], minlength=j - i)
    return vocabulary.select(["pair", "hash", "class", "n", "total"]).append_column("log10_p", pa.array(total / _LOG10))


def word_scores(vocabulary: DataFrame) -> DataFrame:
    """(pair, hash, class, n, total, log10_p) of every word of a class: the probability of its
    bytes and the space behind it."""
    probabilities = written(byte_probabilities(vocabulary), "byte-probabilities")
    vocabulary = _in_parts(vocabulary)
    words_of_parts = vocabulary.select("part", "word", "class").repartition(shuffle_parts(vocabulary.sparkSession), "part")
    asked = words_of_parts.mapInArrow(_codes_of_parts, "part int, code long")
    found = asked.join(probabilities, "code").select("part", "code", "log_p")
    return vocabulary.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(
        _add_up, "pair long, hash long, class int, n long, total long, log10_p double"
    )


# --- texts ------------------------------------------------------------------

_ASKED = "chunk long, texts binary, part int, codes binary, seen binary, words binary, times binary"
_ANSWERED = "chunk long, part int, log_p binary, totals binary"


def text_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all bytes of lower-cased texts, whose words are given, and per text the index of its first one.

    A code holds the bytes before, nearest first, and itself, in ``BYTES`` + 1 bytes.
    """
    row, length = row_of(first), end - start
    pad = 7
    size = np.bincount(row, weights=length + 1, minlength=len(first) - 1).astype(np.int64) + 1
    off = np.concatenate([[0], np.cumsum(size)])
    total = int(off[-1]) + pad * len(size)
    stream = np.full(total, SPACE, np.uint8)
    inside = np.ones(total, bool)
    before = (off[:-1] + pad * np.arange(len(size)))[:, None] + np.arange(pad)
    stream[before], inside[before] = START, False
    at = np.cumsum(length + 1) - (length + 1) + row + pad * (row + 1)
    at = np.repeat(at - (np.cumsum(length) - length), length) + np.arange(length.sum())
    stream[at] = data[~GAPS[data]]
    # Eight bytes up to each byte, the byte itself on top.
    eight = np.ndarray((max(0, total - pad),), "<u8", stream.tobytes(), strides=(1,))[inside[pad:]]
    return (eight & np.uint64(((1 << 8 * BYTES) - 1) << 8)) | (eight >> np.uint64(56)), off


def _firsts(key: np.ndarray) -> np.ndarray:
    """Where each of the sorted keys stands first."""
    change = np.ones(len(key), bool)
    change[1:] = key[1:] != key[:-1]
    return np.flatnonzero(change)


def _merged(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    if not len(key):
        return key, count
    order = np.argsort(key)
    key = key[order]
    first = _firsts(key)
    return key[first], np.add.reduceat(count[order], first)


class _Distinct:
    """Distinct keys and their counts, put together when those to come are a quarter as many as those there."""

    def __init__(self):
        self.key, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.more, self.waiting = [], 0

    def add(self, key: np.ndarray, count: np.ndarray) -> None:
        self.more.append((key, count))
        self.waiting += len(key)
        if self.waiting > max(1 << 18, len(self.key) // 4):
            self.merge()

    def merge(self) -> None:
        if not self.more:
            return
        key, count = _merged(*map(np.concatenate, zip(*self.more)))
        self.more, self.waiting = [], 0
        place = np.searchsorted(self.key, key)
        known = place < len(self.key)
        known[known] = self.key[place[known]] == key[known]
        self.count[place[known]] += count[known]
        new = ~known
        at = place[new] + np.arange(np.count_nonzero(new))
        there = np.ones(len(self.key) + len(at), bool)
        there[at] = False
        for name, more in (("key", key[new]), ("count", count[new])):
            out = np.empty(len(there), more.dtype)
            out[there], out[at] = getattr(self, name), more
            setattr(self, name, out)


class _Chunk:
    """Distinct codes and words of a chunk, with how often its training texts have them, and their order by part."""

    def __init__(self, parts: int):
        self.parts, self.codes, self.tokens, self.held = parts, _Distinct(), _Distinct(), 0

    def add(self, data: np.ndarray, off: np.ndarray, learn: np.ndarray) -> None:
        code, code_off, token, row = _codes_and_tokens(data, off)
        code <<= np.uint64(8)
        code |= np.repeat(learn.astype(np.uint64), np.diff(code_off))
        code.sort()
        seen = (code & np.uint64(255)).astype(np.int64)
        code >>= np.uint64(8)
        first = _firsts(code)
        self.codes.add(code[first], np.add.reduceat(seen, first) if len(first) else seen)
        self.tokens.add(*_merged(token, learn[row]))
        self.held += max(1, len(data))

    def close(self) -> None:
        """Merges what is left and deals keys to their parts: in order of parts, then of keys."""
        for keys in (self.codes, self.tokens):
            keys.merge()
            part = _code_parts(keys.key, self.parts) if keys is self.codes else _token_parts(keys.key, self.parts)
            keys.order = np.argsort(part, kind="stable").astype(np.int32)
            keys.cut = np.searchsorted(part[keys.order], np.arange(self.parts + 1))


def _codes_and_tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of texts and per text the index of its first one; their words and ends as hashes, and the text of each."""
    data = LOWER[data]
    start, end, first = words(data, off)
    code, code_off = text_codes(data, start, end, first)
    token = np.concatenate([span_hash(prefix_sums(data), start, end), np.full(len(off) - 1, END, np.uint64)])
    return code, code_off, token, np.concatenate([row_of(first), np.arange(len(off) - 1)])


def _places(known: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where each key stands among the known ones, which are sorted and hold all."""
    order = np.argsort(key)
    key = key[order]
    first = _firsts(key)
    place = np.empty(len(key), np.int64)
    place[order] = np.repeat(np.searchsorted(known, key[first]), np.diff(np.append(first, len(key))))
    return place


def _code_parts(code: np.ndarray, parts: int) -> np.ndarray:
    """Parts of sorted codes, by their first two bytes of context."""
    root = (code >> np.uint64(8 * (BYTES - 1))).astype(np.uint16)
    first = _firsts(root)
    part = (mix(root[first]) % np.uint64(parts)).astype(np.int32)
    return np.repeat(part, np.diff(np.append(first, len(root))))


def _token_parts(token: np.ndarray, parts: int) -> np.ndarray:
    return (mix(token) % np.uint64(parts)).astype(np.int32)


def _packed_texts(ids: pa.Array, texts: pa.Array) -> bytes:
    batch, sink = pa.RecordBatch.from_arrays([ids, texts], ["doc_id", "text"]), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _ask(parts: int):
    """Rows with the texts of each chunk, slice by slice, and a row for each part that the chunk has codes or words of."""
    names = [x.split(" ")[0] for x in _ASKED.split(", ")]
    types = [pa.int64(), pa.binary(), pa.int32(), *[pa.binary()] * 4]

    def rows(number: int, **columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        columns["chunk"] = [number] * n
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, types)], names
        )

    def asked(number: int, chunk: _Chunk) -> pa.RecordBatch:
        chunk.close()
        columns = {c: [] for c in names[2:]}
        for part in range(parts):
            code, token = (k.order[k.cut[part] : k.cut[part + 1]] for k in (chunk.codes, chunk.tokens))
            if len(code) or len(token):
                columns["part"].append(part)
                columns["codes"].append(_pack(chunk.codes.key[code].view(np.int64)))
                columns["seen"].append(_pack_small(chunk.codes.count[code]))
                columns["words"].append(_pack(chunk.tokens.key[token].view(np.int64)))
                columns["times"].append(_pack_small(chunk.tokens.count[token]))
        return rows(number, **columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, chunk = TaskContext.get().partitionId() << 32, _Chunk(parts)
        for batch in batches:
            learn = np.asarray(batch.column("learn")).astype(np.int64)
            for i, j, data, off in slices(batch.column("text"), SLICE):
                if chunk.held and chunk.held + len(data) > CHUNK:
                    yield asked(number, chunk)
                    number, chunk = number + 1, _Chunk(parts)
                chunk.add(data, off, learn[i:j])
                yield rows(number, texts=[_packed_texts(*(batch.column(c).slice(i, j - i) for c in ("doc_id", "text")))])
        if chunk.held:
            yield asked(number, chunk)

    return run


def _whole_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Rows sorted by part, the rows of one part at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        part = np.asarray(batch.column("part"))
        cuts = [*np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(part)] if len(part) else []
        for i, j in zip(cuts[:-1], cuts[1:]):
            if held and held[-1].column("part")[0].as_py() != part[i]:
                yield held
                held = []
            held.append(batch.slice(i, j - i))
    if held:
        yield held


def _in_all(held: list[pa.RecordBatch], key: str, count: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a part and their counts over all chunks."""
    out = _Distinct()
    for batch in held:
        for keys, counts in zip(batch.column(key), batch.column(count)):
            own = _unpack(keys.as_buffer()).view(np.uint64)
            out.add(own, _unpack_small(counts.as_buffer(), len(own)))
    out.merge()
    return out.key, out.count


def _part_trees(code: np.ndarray, n: np.ndarray) -> Iterator[Trees]:
    """The trees of a part, some pairs of bytes at a time."""
    root = code >> np.uint64(8 * (BYTES - 1))
    i = 0
    while i < len(code):
        # Up to the last pair of bytes that is whole, one at least.
        j = min(len(code), i + BUILT)
        if j < len(code):
            j = int(np.searchsorted(root, root[j]))
            j = j if j > i else int(np.searchsorted(root, root[i], "right"))
        yield Trees(code[i:j], n[i:j].astype(float), BYTES)
        i = j


def _part_tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each part adds to the nodes of depth 1, and, as byte -1, to the number of all and of distinct words."""
    for held in _whole_parts(batches):
        for trees in _part_trees(*_in_all(held, "codes", "seen")):
            yield trees.top_nodes()
        _, total = _in_all(held, "words", "times")
        sums = [-1, 0, float(total.sum()), float(np.count_nonzero(total)), 0.0]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in sums], ["byte", "node", "a", "b", "log_p"])


def _answer(top):
    """For each chunk what a part knows of its codes and words, in the order in which they were asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _whole_parts(batches):
            code, n = _in_all(held, "codes", "seen")
            log_p = [t.log_probability(top.value).astype(np.float32) for t in _part_trees(code, n)]
            log_p = np.concatenate(log_p) if log_p else np.zeros(0, np.float32)
            token, total = _in_all(held, "words", "times")
            for batch in held:
                answers = [log_p[np.searchsorted(code, _unpack(x.as_buffer()).view(np.uint64))].tobytes() for x in batch.column("codes")]
                totals = [
                    _pack_small(total[np.searchsorted(token, _unpack(x.as_buffer()).view(np.uint64))]) for x in batch.column("words")
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("chunk"), batch.column("part"), pa.array(answers, pa.binary()), pa.array(totals, pa.binary())],
                    ["chunk", "part", "log_p", "totals"],
                )

    return run


def _add_up_texts(parts: int, all_words: int, distinct: int):
    """Scores of a chunk's texts from the answers of the parts."""

    def texts_of(column: pa.ChunkedArray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        for packed in column:
            for batch in pa.ipc.open_stream(packed.as_buffer()):
                for i, j, data, off in slices(batch.column("text"), SLICE):
                    yield batch.column("doc_id").slice(i, j - i), data, off

    def run(key, texts: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = _Chunk(parts)
        for ids, data, off in texts_of(texts["texts"]):
            chunk.add(data, off, np.zeros(len(ids), np.int64))
        chunk.close()
        codes, tokens = chunk.codes, chunk.tokens
        codes.count = tokens.count = None
        log_p, total = np.empty(len(codes.key), np.float32), np.empty(len(tokens.key), np.int64)
        for part, p, n in zip(answers["part"].to_pylist(), answers["log_p"], answers["totals"]):
            log_p[codes.order[codes.cut[part] : codes.cut[part + 1]]] = np.frombuffer(p.as_buffer(), np.float32)
            own = tokens.order[tokens.cut[part] : tokens.cut[part + 1]]
            total[own] = _unpack_small(n.as_buffer(), len(own))
        known, base = total > 0, np.log10((total + 1) / (all_words + distinct + 1))
        out = []
        for ids, data, off in texts_of(texts["texts"]):
            code, code_off, token, row = _codes_and_tokens(data, off)
            of_code, of_token, n = _places(codes.key, code), _places(tokens.key, token), len(ids)
            score = np.bincount(row_of(code_off), weights=log_p[of_code], minlength=n) / _LOG10
            out.append(pa.table([
                ids, pa.array(np.bincount(row, minlength=n)),
                pa.array(np.bincount(row, weights=known[of_token], minlength=n).astype(np.int64)),
                pa.array(np.bincount(row, weights=base[of_token], minlength=n)), pa.array(score),
            ], ["doc_id", "n_tokens", "n_known", "base_score", "score"]))
        return pa.concat_tables(out)

    return run


def language_scores(docs: DataFrame, learn: Column) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every document.

    ``learn`` says which rows train; ``base_score`` is that of single words with add-one smoothing.
    """
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(learn, F.lit(False)).alias("learn"))
    chunks = written(rows.mapInArrow(_ask(parts), _ASKED), "chunks")
    asked = chunks.where(F.col("part").isNotNull()).drop("texts").repartition(parts, "part").sortWithinPartitions("part", "chunk")
    nodes = asked.mapInArrow(_part_tops, "byte long, node long, a double, b double, log_p double").groupBy("byte", "node").agg(
        *[F.sum(c).alias(c) for c in ("a", "b", "log_p")]
    ).toArrow()  # at most 256 x 255 rows, and the words
    byte, *others = (np.asarray(nodes[c].combine_chunks()) for c in ("byte", "node", "a", "b", "log_p"))
    total, distinct = (int(others[k][byte < 0].sum()) for k in (1, 2))
    top = spark.sparkContext.broadcast(Top(byte[byte >= 0], *[x[byte >= 0] for x in others]))
    answers = asked.mapInArrow(_answer(top), _ANSWERED)
    texts = chunks.where(F.col("part").isNull()).select("chunk", "texts")
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _add_up_texts(parts, total, distinct), "doc_id long, n_tokens long, n_known long, base_score double, score double"
    ).withColumn("train_tokens", F.lit(total).cast("long"))


def language_model(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); rows whose
    CRC-32 of the id leaves 2 modulo 7 are held out of the training."""
    scored = language_scores(docs, split_no("doc_id", 7) != 2)
    return scored.select(
        "doc_id", (split_no("doc_id", 7) == 2).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score",
    )
