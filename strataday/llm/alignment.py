"""Token alignment between two tokenizers by diagonal run skipping.

Both tokenizers split the same bytes. Walking along the two arrays of token ends, as long as the
ends at the current index shift agree, tokens stand one to one: exponential probing compares
ever longer stretches of both arrays at that shift and halving finds the end of the run, which
is jumped at once. Where the ends differ, the smaller one is moved on until two agree; the tokens passed
make an irregular group, and the shift is updated. Many chunks of texts are walked as one, as both
arrays have an end where a chunk ends.

The bytes of a text count as one space and the text. Tokenizer A (tokenizers, byte-level) encodes
them, tokenizer B (sentencepiece, whose own prefix is the space) the text; no special tokens, special
strings are plain text. Texts are cut for both where a space stands between two characters that
are not white space, as neither joins anything across it (A by its pattern; B if no piece has a space
behind another character, else texts stay whole). Where a chunk ends both have an end, so groups lie within chunks: the
ids and groups of chunks are remembered in the worker, up to a bound, and only chunks that are new to it are walked.

A link is a pair of an A and a B token of one group; the count of a pair of ids is the number of documents that
have it linked. The first job tokenizes once and writes per document its numbers and
its distinct pairs with repeats; the counts are one aggregate over these, summed in the tasks first. Counts of the most
frequent pairs, at most ``SENT``, are sent out, so that links of common pairs are added up where they are; links
of rarer pairs are joined with the counts and summed by document. No step drops a pair.

Defined results: texts that are NULL or empty, or whose tokens of either side do not spell the
space and the text, have no tokens: zeros, empty hash. Rows are documents of their own, so repeated
rows and ids count each time and get equal results. The pairs of one document are made in one task: a group without a
common end costs its distinct A ids times its distinct B ids. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .lookup import Lookup

#: Most pairs whose counts are sent out.
SENT = 1 << 20
#: Chunks that a worker remembers.
KEPT = 1 << 19
#: A space between two characters that are not white space.
_CUT = re.compile(r" (?=\S)(?<=\S )").split
#: Characters of a slice of texts; one text alone may be longer.
SLICE = 1 << 20
#: Pairs that a task sums up before it hands them on.
HELD = 1 << 23
_DOCS = "key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def one_to_one(a: list[int], b: list[int], i: int, j: int) -> int:
    """Length of the run of equal ends from i in ``a`` and j in ``b``, which agree there."""
    most = min(len(a) - i, len(b) - j)
    n = 1
    while n < most and n < 4:  # most runs are short
        if a[i + n] != b[j + n]:
            return n
        n += 1
    width = 4
    while n < most:
        width = min(width, most - n)
        if a[i + n : i + n + width] == b[j + n : j + n + width]:
            n += width
            width *= 2
            continue
        while width > 1:  # the first difference is among the next ``width``
            half = width // 2
            if a[i + n : i + n + half] == b[j + n : j + n + half]:
                n += half
                width -= half
            else:
                width = half
        break
    return n


def _walk(a: list[int], b: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Runs of groups: A's and B's tokens before the first end, and how many ends follow one to one."""
    at, bt, run = [], [], []
    i = j = 0
    try:
        while True:
            x, y = a[i], b[j]
            if x == y:
                n = one_to_one(a, b, i, j)
                at.append(i)
                bt.append(j)
                run.append(n)
                i += n
                j += n
                continue
            while x != y:
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
            at.append(i)
            bt.append(j)
            run.append(1)
            i += 1
            j += 1
    except IndexError:  # the end of either array, maybe within a group
        return at, bt, run


def groups(a: np.ndarray, b: np.ndarray, window: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Number of A and of B tokens up to each common end, in order. The last ends agree.

    The arrays are walked in windows; one in which no group ends is doubled.
    """
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    i = j = 0
    width = window
    while i < len(a):
        at, bt, run = _walk(a[i : i + width].tolist(), b[j : j + width].tolist())
        if not run:
            width *= 2
            continue
        count = np.array(run, np.int64)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + 1
        out_a.append(np.repeat(np.array(at, np.int64) + i, count) + step)
        out_b.append(np.repeat(np.array(bt, np.int64) + j, count) + step)
        i, j, width = int(out_a[-1][-1]), int(out_b[-1][-1]), window
    return np.concatenate(out_a), np.concatenate(out_b)


def _byte_of_character() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in set(plain)]
    return {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(rest)}


class Side:
    """A tokenizer: ids of texts and the bytes of each id."""

    def __init__(self, spelled: list[bytes]):
        self.spelled = spelled
        self.length = np.array([len(x) for x in spelled], np.int64)
        digits = [str(k).encode() for k in range(len(spelled))]
        width = max(map(len, digits))
        #: Decimal digits of each id, filled up with zero bytes from the left.
        self.digits = np.frombuffer(b"".join(x.rjust(width, b"\0") for x in digits), np.uint8).reshape(-1, width)


class ByteLevel(Side):
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        byte = _byte_of_character()
        size = self.model.get_vocab_size()
        super().__init__([
            bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
            for piece in map(self.model.id_to_token, range(size))
        ])

    def ids(self, chunks: list[str]) -> list[list[int]]:
        """Ids of a space and each chunk."""
        return [x.ids for x in self.model.encode_batch_fast([" " + c for c in chunks], add_special_tokens=False)]


class Pieces(Side):
    MARK = "▁"

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.cuts = not any(self.MARK in x.lstrip(self.MARK) for x in pieces)
        super().__init__([
            bytes([int(x[3:5], 16)]) if self.model.is_byte(k) else x.replace(self.MARK, " ").encode()
            for k, x in enumerate(pieces)
        ])

    def ids(self, chunks: list[str]) -> list[list[int]]:
        return self.model.encode(chunks, num_threads=1)


class Table:
    """Numbers of many arrays, one behind the other."""

    def __init__(self):
        self.ids, self.first = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def add(self, more: np.ndarray, size: np.ndarray) -> None:
        self.ids = np.concatenate([self.ids, more.astype(np.int32)])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(size)])

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the arrays ``at``, in that order, and the size of each."""
        size = self.first[at + 1] - self.first[at]
        pick = np.arange(size.sum()) + np.repeat(self.first[at] - (np.cumsum(size) - size), size)
        return self.ids[pick].astype(np.int64), size


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers, and how many each list has."""
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(size.sum())), size


class Encoder:
    """Ids of texts under both tokenizers and their groups; chunks that were seen are remembered, up to KEPT of them."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.cut = _CUT if self.b.cuts else (lambda text: [text])
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.held_a, self.held_b = Table(), Table()
        #: A's and B's tokens of each group.
        self.groups_a, self.groups_b = Table(), Table()
        self.spells = np.zeros(0, bool)

    def learn(self, chunks: list[str]) -> None:
        for chunk in chunks:
            self.number[chunk] = len(self.number)
        ids_a, ids_b = self.a.ids(chunks), self.b.ids(chunks)
        own = [
            b"".join([self.a.spelled[k] for k in x]) == b"".join([self.b.spelled[k] for k in y]) == b" " + chunk.encode()
            for chunk, x, y in zip(chunks, ids_a, ids_b, strict=True)
        ]
        own = np.array(own, bool)
        (flat_a, n_a), (flat_b, n_b) = _flat(ids_a), _flat(ids_b)
        self.held_a.add(flat_a, n_a)
        self.held_b.add(flat_b, n_b)
        self.spells = np.concatenate([self.spells, own])
        to_a, to_b = groups(*(
            np.cumsum(side.length[flat[np.repeat(own, n)]]) for side, flat, n in ((self.a, flat_a, n_a), (self.b, flat_b, n_b))
        ))
        to_group = np.searchsorted(to_a, np.cumsum(np.where(own, n_a, 0)), "right")
        size = np.diff(to_group, prepend=0)
        self.groups_a.add(np.diff(to_a, prepend=0), size)
        self.groups_b.add(np.diff(to_b, prepend=0), size)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of all chunks, how many each text has, and whether its tokens spell it."""
        if len(self.number) > KEPT:
            self.clear()
        parts = [self.cut(t) for t in texts]
        new = dict.fromkeys(filterfalse(self.number.__contains__, chain.from_iterable(parts)))
        if new:
            self.learn(list(new))
        size = np.array([len(own) for own in parts], np.int64)
        chunk = np.fromiter(map(self.number.__getitem__, chain.from_iterable(parts)), np.int64, int(size.sum()))
        wrong = np.append(0, np.cumsum(~self.spells[chunk]))
        ends = np.cumsum(size)
        return chunk, size, wrong[ends] == wrong[ends - size]


@lru_cache(maxsize=2)
def _encoder(path_a: str, path_b: str) -> Encoder:
    return Encoder(path_a, path_b)


class Aligned:
    """Groups of a slice of texts. ``row`` holds the numbers of the texts that have tokens."""

    def __init__(self, encoder: Encoder, texts: list[str | None]):
        self.a, self.b = encoder.a, encoder.b
        some = np.array([k for k, t in enumerate(texts) if t], np.int64)
        chunk, size, good = encoder.encode([texts[k] for k in some])
        self.row = some[good]
        chunk, size = chunk[np.repeat(good, size)], size[good]
        chunks_to = np.cumsum(size)
        self.ids_a, own_a = encoder.held_a.take(chunk)
        self.ids_b, own_b = encoder.held_b.take(chunk)
        self.n_a, self.n_b = (np.diff(np.append(0, np.cumsum(own))[chunks_to], prepend=0) for own in (own_a, own_b))
        self.size_a, own = encoder.groups_a.take(chunk)
        self.size_b, _ = encoder.groups_b.take(chunk)
        self.to_a, self.to_b = np.cumsum(self.size_a), np.cumsum(self.size_b)
        #: Number of the groups up to the end of each text.
        self.to_group = np.cumsum(own)[chunks_to - 1]

    @property
    def n_groups(self) -> np.ndarray:
        return np.diff(self.to_group, prepend=0)

    def sums(self, value: np.ndarray) -> np.ndarray:
        """Sum of a value of each group by text."""
        total = np.append(0, np.cumsum(value))
        return np.diff(total[self.to_group], prepend=0)

    def hashes(self) -> list[str]:
        """SHA-256 of each text's groups, written as decimal ids."""
        n = len(self.ids_a) + len(self.ids_b)
        width = max(self.a.digits.shape[1], self.b.digits.shape[1])
        out = np.zeros((n, width + 1), np.uint8)
        group_a = np.repeat(np.arange(len(self.size_a)), self.size_a)
        group_b = np.repeat(np.arange(len(self.size_b)), self.size_b)
        at_a = np.arange(len(self.ids_a)) + (self.to_b - self.size_b)[group_a]
        at_b = np.arange(len(self.ids_b)) + self.to_a[group_b]
        for at, ids, side in ((at_a, self.ids_a, self.a), (at_b, self.ids_b, self.b)):
            digits = side.digits[ids]
            out[at, width - digits.shape[1] : width] = digits
            out[at, width] = ord(",")
        last_a, last_b = self.to_a + self.to_b - self.size_b - 1, self.to_a + self.to_b - 1
        out[last_a, width] = ord("|")
        out[last_b, width] = ord(";")
        ends = last_b[self.to_group - 1]
        out[ends, width] = 0
        lengths = np.append(0, np.cumsum((out != 0).sum(axis=1)))
        raw = out[out != 0].tobytes()
        stops = lengths[ends + 1].tolist()
        return [hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip([0, *stops], stops)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, links) of every distinct pair of a text, in that order; a pair is A's id times the size of B plus B's."""
        group_a = np.repeat(np.arange(len(self.size_a)), self.size_a)
        group_b = np.repeat(np.arange(len(self.size_b)), self.size_b)
        # In groups of several tokens equal ids are put together first.
        id_a, group_a, many_a = _distinct(group_a, self.ids_a, self.size_a)
        id_b, group_b, many_b = _distinct(group_b, self.ids_b, self.size_b)
        size_b = np.bincount(group_b, minlength=len(self.size_b))
        first_b = np.cumsum(size_b) - size_b
        wide = size_b[group_a]
        left = np.repeat(np.arange(len(id_a)), wide)
        right = np.arange(len(left)) + np.repeat(first_b[group_a] - (np.cumsum(wide) - wide), wide)
        text = np.searchsorted(self.to_group, group_a, "right")[left]
        code = (text * len(self.a.spelled) + id_a[left]) * len(self.b.spelled) + id_b[right]
        links = many_a[left] * many_b[right]
        order = np.argsort(code, kind="stable")
        code, links = code[order], links[order]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
        links = np.add.reduceat(links, first) if len(code) else links
        size = len(self.a.spelled) * len(self.b.spelled)
        return code[first] // size, code[first] % size, links


def _distinct(group: np.ndarray, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, group, repeats) with each id once a group, in order of groups."""
    many = (size > 1)[group]
    if not many.any():
        return ids, group, np.ones(len(ids), np.int64)
    top = int(ids.max()) + 1
    code, n = np.unique(group[many] * top + ids[many], return_counts=True)
    code = np.concatenate([code, group[~many] * top + ids[~many]])
    n = np.concatenate([n, np.ones(int((~many).sum()), np.int64)])
    order = np.argsort(code, kind="stable")
    return code[order] % top, code[order] // top, n[order]


def _pack(values: np.ndarray) -> bytes:
    """Differences as planes of bytes, which compress well."""
    return np.diff(values, prepend=0).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64))


def _pack_small(values: np.ndarray) -> bytes:
    """One byte a value, and behind them those above 254 in full."""
    large = values > 254
    return np.where(large, 255, values).astype(np.uint8).tobytes() + values[large].astype("<i8").tobytes()


def _unpack_small(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<i8", offset=n)
    return out


def _text_slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    i, size = 0, 0
    for j, text in enumerate(texts):
        if size and size + len(text or "") > SLICE:
            yield i, j
            i, size = j, 0
        size += len(text or "")
    if i < len(texts):
        yield i, len(texts)


def _align(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path_a, path_b)
        key = TaskContext.get().partitionId() << 40
        names = [x.split(" ")[0] for x in _DOCS.split(", ")]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in _text_slices(texts):
                held = Aligned(encoder, texts[i:j])
                text, pair, links = held.pairs()
                cut = np.searchsorted(text, np.arange(len(held.row) + 1))
                numbers = np.zeros((j - i, 4), np.int64)
                numbers[held.row] = np.stack([held.n_a, held.n_b, held.n_groups, held.sums(held.size_a * held.size_b)], axis=1)
                sha, pairs, times = ([x] * (j - i) for x in ("", b"", b""))
                for k, own, x, y in zip(held.row, held.hashes(), cut[:-1], cut[1:], strict=True):
                    sha[k], pairs[k], times[k] = own, _pack(pair[x:y]), _pack_small(links[x:y])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key + np.arange(i, j)), batch.column("doc_id").slice(i, j - i),
                     *(pa.array(numbers[:, c]) for c in range(4)),
                     pa.array(sha, pa.string()), pa.array(pairs, pa.binary()), pa.array(times, pa.binary())],
                    names,
                )
            key += len(texts)

    return run


def _sum_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n): documents that hold each pair, summed over HELD pairs at a time."""

    def out(parts: list[np.ndarray]) -> pa.RecordBatch:
        pair, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n.astype(np.int64))], ["pair", "n"])

    parts, held = [], 0
    for batch in batches:
        for raw in batch.column("pairs"):
            own = _unpack(raw.as_buffer())
            parts.append(own)
            held += len(own)
            if held > HELD:
                yield out(parts)
                parts, held = [], 0
    yield out(parts)


class Counts:
    """Counts of frequent pairs, and whether each is the highest of its A id."""

    def __init__(self, pair: np.ndarray, n: np.ndarray, best: np.ndarray):
        self.lookup, self.n, self.best = Lookup(pair.astype(np.uint64)), n, best


def _known(shared):
    """Per document the sums over links of frequent pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(*shared.value)
        for batch in batches:
            _, row, times, at = _links(batch, counts)
            good = at >= 0
            row, times, at = row[good], times[good], at[good]
            rows = batch.num_rows
            count_sum, n_best = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            np.add.at(count_sum, row, times * counts.n[at])
            np.add.at(n_best, row, times * counts.best[at])
            kept = [n for n in batch.schema.names if n not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array(n_best), pa.array(count_sum)], [*kept, "known_best", "known_sum"]
            )

    return run


def _rare(shared):
    """(key, pair, times) of the links of all other pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(*shared.value)
        for batch in batches:
            pair, row, times, at = _links(batch, counts)
            rest = at < 0
            key = batch.column("key").to_numpy()[row[rest]]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(pair[rest]), pa.array(times[rest])], ["key", "pair", "times"])

    return run


def _links(batch: pa.RecordBatch, counts: Counts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    pairs = [_unpack(x.as_buffer()) for x in batch.column("pairs")]
    times = [_unpack_small(x.as_buffer(), len(p)) for x, p in zip(batch.column("times"), pairs, strict=True)]
    row = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
    pair = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
    return pair, row, np.concatenate(times) if times else pair, counts.lookup.find(pair.astype(np.uint64))


def _least_sent(counts: DataFrame, sent: int) -> int:
    """The count from which at most ``sent`` pairs are left, from the number of pairs a class of counts."""
    classes = counts.groupBy(F.floor(F.log2("n") * 8).alias("c")).agg(F.count("*").alias("pairs"), F.min("n").alias("n")).collect()
    total, least = 0, None
    for r in sorted(classes, key=lambda r: -r.c):
        total += r.pairs
        if total > sent:
            break
        least = r.n
    return least if least is not None else (1 << 62)


def align_tokens(docs: DataFrame, path_a: str, path_b: str, sent: int = SENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = written(rows.mapInArrow(_align(path_a, path_b), _DOCS), "aligned")
    size_b = len(_encoder(path_a, path_b).b.spelled)
    summed = held.select("pairs").mapInArrow(_sum_pairs, "pair long, n long")
    counts = summed.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.expr(f"pair div {size_b}"))
    counts = written(counts, "pair-counts")
    # One row for each id of A.
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    counts = counts.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    least = _least_sent(counts, sent)
    sent_out = counts.where(F.col("n") >= least).toArrow()
    shared = spark.sparkContext.broadcast(tuple(sent_out.column(c).to_numpy() for c in ("pair", "n", "best")))
    known = held.mapInArrow(_known(shared), _DOCS.rsplit(", ", 2)[0] + ", known_best long, known_sum long")
    rare = (
        held.select("key", "pairs", "times").mapInArrow(_rare(shared), "key long, pair long, times long")
        .join(counts.where(F.col("n") < least), "pair")
        .groupBy("key").agg(
            F.sum(F.col("times") * F.col("best").cast("long")).alias("rare_best"), F.sum(F.col("times") * F.col("n")).alias("rare_sum"),
        )
    )
    add = lambda x, y: (F.col(x) + F.coalesce(F.col(y), F.lit(0))).cast("long")
    return known.join(rare, "key", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", add("known_best", "rare_best").alias("n_best"),
        add("known_sum", "rare_sum").alias("count_sum"), "groups_sha256",
    )
