"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts of up to ``DEPTH`` bytes with the counts of the
byte that followed. In a context seen T times with D different bytes, a byte seen c times
has probability c / (T + D), and the escape D / (T + D); an escape goes to the context without its
first byte, whose probabilities are scaled up over the bytes that the longer context
excludes. Below the empty context all bytes unseen there are alike. So the probabilities of all 256
bytes sum to one in every context, and the bits of a text under frozen counts are exact. The
language with the fewest bits is predicted; ``score`` is its share under equal priors.

Training reads a bounded sample: pieces of ``PIECE`` bytes, picked by a hash of id and piece number, about
``TRAIN_BYTES`` in all, an equal share for each language (all of a language that has less). One
task counts them. The trees of all languages are laid over each other, one row of bits a
context and byte with a column a language. Rows seen less than some number of times are left
out so that at most ``CELLS`` numbers are sent out, whatever the corpus; their weight goes to the escape.

Scoring is a column over whole lower-cased texts, read in windows of ``WINDOW`` bytes; no shuffle.

Defined results: texts that are NULL or have no letter are ``und`` with score 0 and 0 bits, so
are all texts if there is nothing to learn from. NULL languages are not learnt. Texts of any length are
scored to their end. Repeated rows get equal results; an id that is NULL counts as the empty
text in the split. Of languages with equal bits the first by code point wins. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import split_no, trained, written
from .lookup import Lookup
from .texts import as_bytes

#: Bytes of the longest context.
DEPTH = 4
PIECE = 1024
#: Bytes to learn from, about, shared equally among the languages.
TRAIN_BYTES = 1 << 22
#: Most numbers in the model: rows times languages.
CELLS = 1 << 23
WINDOW = 1 << 20
UNKNOWN = "und"
_U = np.uint64
_RESULT = "struct<lang_pred:string,score:double,bits:double>"


@dataclass(frozen=True)
class Trees:
    """Bits of (context, byte) rows and of escapes from contexts, a column a language.

    A key holds the bytes of the context and the byte, and above them the context's length.
    """

    languages: list[str]
    edges: np.ndarray
    cost: np.ndarray
    nodes: np.ndarray
    escape: np.ndarray


def _gram(data: np.ndarray, n: int) -> np.ndarray:
    """The n bytes that end at each place, as a number; places before the first n hold fewer."""
    out = np.zeros(len(data), np.uint64)
    for k in range(min(n, len(data))):
        out[k:] |= data[: len(data) - k].astype(np.uint64) << _U(8 * k)
    return out


def _tag(k: int) -> np.uint64:
    return _U(k + 1) << _U(56)


def _in_row(off: np.ndarray) -> np.ndarray:
    """Number of bytes of the same row before each byte."""
    return np.arange(off[-1]) - np.repeat(off[:-1], np.diff(off))


def count(pieces: list[tuple[np.ndarray, np.ndarray]], depth: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each context length the (context, byte) keys of all languages and a column of counts a language.

    ``pieces``: per language the bytes of its pieces and their offsets.
    """
    keys, counts = [], []
    for k in range(depth + 1):
        own = []
        for data, off in pieces:
            gram = _gram(data, k + 1)[_in_row(off) >= k]
            own.append(np.unique(gram, return_counts=True))
        if k == 0:
            own.append((np.arange(256, dtype=np.uint64), np.zeros(256, np.int64)))
        every = np.unique(np.concatenate([x for x, _ in own]))
        table = np.zeros((len(every), len(pieces)))
        for i, (key, n) in enumerate(own[: len(pieces)]):
            table[np.searchsorted(every, key), i] = n
        keys.append(every)
        counts.append(table)
    return keys, counts


def least_count(counts: list[np.ndarray], cells: int) -> int:
    """The number of times that a row must have been seen for at most ``cells`` numbers to be kept."""
    sums = np.concatenate([c.sum(axis=1) for c in counts[1:]]) if len(counts) > 1 else np.zeros(0)
    room = max(0, cells // (2 * counts[0].shape[1]) - 256)
    if len(sums) <= room:
        return 1
    return int(np.sort(sums)[::-1][room]) + 1


def build(languages: list[str], pieces: list[tuple[np.ndarray, np.ndarray]], depth: int = DEPTH, cells: int = CELLS) -> Trees:
    """Bits of every kept row, from the empty context to the longest."""
    keys, counts = count(pieces, depth)
    least = least_count(counts, cells)
    n = len(languages)
    edges, costs, nodes, escapes = [], [], [], []
    below: tuple[np.ndarray, np.ndarray] | None = None
    for k in range(depth + 1):
        # Counts of all bytes seen make up T and D; rows that are left out add to the escape.
        context = keys[k] >> _U(8)  # the byte itself is the lowest
        held, at = np.unique(context, return_inverse=True)
        total, kinds = np.zeros((len(held), n)), np.zeros((len(held), n))
        np.add.at(total, at, counts[k])
        np.add.at(kinds, at, (counts[k] > 0).astype(float))
        kept = (counts[k].sum(axis=1) >= least) | (k == 0)
        key, own, at = keys[k][kept], counts[k][kept], at[kept]
        if k == 0:
            weight = np.where(kinds < 256, total + kinds, total)
            chance = np.where(own > 0, own, kinds[at] / np.maximum(256 - kinds[at], 1)) / np.maximum(weight[at], 1)
            chance = np.where(weight[at] > 0, chance, 1 / 256)
        else:
            lower_keys, lower = below
            shorter = key & _U((1 << (8 * k)) - 1)  # without the first byte
            base = lower[np.searchsorted(lower_keys, shorter)]
            direct = own / np.maximum((total + kinds)[at], 1)
            seen = own > 0
            left, free = np.ones((len(held), n)), np.ones((len(held), n))
            np.subtract.at(left, at, np.where(seen, direct, 0))
            np.subtract.at(free, at, np.where(seen, base, 0))
            factor = np.where(total > 0, np.maximum(left, 1e-12) / np.maximum(free, 1e-12), 1.0)
            chance = np.where(seen, direct, base * factor[at])
            used = np.unique(at)
            nodes.append(held[used] | _tag(k))
            escapes.append(-np.log2(factor[used]))
        edges.append(key | _tag(k))
        costs.append(-np.log2(chance))
        below = key, chance
    join = lambda x, width: np.concatenate(x) if x else np.zeros((0, *width))
    return Trees(
        languages, join(edges, ()), join(costs, (n,)).astype(np.float32),
        join(nodes, ()).astype(np.uint64), join(escapes, (n,)).astype(np.float32),
    )


class Scorer:
    """Bits of texts under each language."""

    def __init__(self, trees: Trees, depth: int = DEPTH):
        self.trees, self.depth = trees, depth
        self.edges, self.nodes = Lookup(trees.edges), Lookup(trees.nodes)

    def window(self, data: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Bits of each byte (rows) under each language; ``before``: bytes of its text before it."""
        gram = _gram(data, self.depth + 1)
        out = np.zeros((len(data), len(self.trees.languages)), np.float32)
        left = np.arange(len(data))
        for k in range(self.depth, -1, -1):
            far = before[left] >= k
            at, waiting = left[far], left[~far]
            own = gram[at] & _U((1 << (8 * (k + 1))) - 1)
            edge = self.edges.find(own | _tag(k))
            hit = edge >= 0
            out[at[hit]] += self.trees.cost[edge[hit]]
            missed = at[~hit]
            if k and len(missed):
                node = self.nodes.find((own[~hit] >> _U(8)) | _tag(k))
                known = node >= 0
                out[missed[known]] += self.trees.escape[node[known]]
            left = np.concatenate([missed, waiting])
        return out

    def bits(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Bits of each row under each language, in windows of bytes that may cut rows."""
        rows, n = len(off) - 1, len(self.trees.languages)
        out = np.zeros((rows, n))
        for a in range(0, len(data), WINDOW):
            b, back = min(a + WINDOW, len(data)), max(0, a - self.depth)
            first, last = int(np.searchsorted(off, a, "right")) - 1, int(np.searchsorted(off, b, "left"))
            inside = np.diff(np.clip(off[first : last + 1], a, b))
            row = np.repeat(np.arange(len(inside)), inside)
            start = np.repeat(off[first:last], inside)
            before = np.zeros(b - back, np.int64)
            before[a - back :] = np.arange(a, b) - start
            cost = self.window(data[back:b], before)[a - back :]
            for i in range(n):
                out[first:last, i] += np.bincount(row, weights=cost[:, i], minlength=last - first)
        return out


def _train(depth: int, cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, list] = {}
        for batch in batches:
            for lang, piece in zip(batch.column("text").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                by.setdefault(lang, []).append(piece)
        languages = sorted(by)
        if not languages:
            return
        pieces = [as_bytes(pa.array(by[x], pa.large_binary())) for x in languages]
        trees = build(languages, pieces, depth, cells)
        for kind, keys, bits in (("edge", trees.edges, trees.cost), ("node", trees.nodes, trees.escape)):
            for i in range(0, len(keys), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind], pa.string()), pa.array([languages], pa.list_(pa.string())),
                     pa.array([keys[part].tobytes()], pa.binary()), pa.array([bits[part].tobytes()], pa.binary())],
                    ["kind", "languages", "keys", "bits"],
                )

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, text = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        out = [
            (x, raw[k * PIECE : (k + 1) * PIECE])
            for x, raw, picks in zip(lang, map(str.encode, text), batch.column("picks").to_pylist(), strict=True)
            for k in picks
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.binary())], ["text", "piece"]
        )


def sample(docs: DataFrame, keep: Column, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """(text: the language, piece): about ``train_bytes`` of the texts for whose doc_id ``keep`` holds."""
    rows = docs.select("doc_id", "lang", F.lower("text").alias("text")).where(keep & F.col("lang").isNotNull() & (F.col("text") != ""))
    per = written(rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes")), "languages")
    each = train_bytes / max(1, per.count())
    share = per.select(F.col("lang").alias("of"), (F.lit(each) / F.col("bytes")).alias("share"))
    wide = 1 << 30
    # A short text is one piece of its own length, so pieces are picked at one rate whatever their length.
    last = F.floor((F.octet_length("text") - 1) / PIECE).cast("int")
    picked = F.filter(
        F.sequence(F.lit(0), last),
        lambda k: F.pmod(F.xxhash64(F.lit("piece"), F.col("doc_id").cast("long"), k), F.lit(wide)) < F.col("share") * wide,
    )
    taken = rows.join(share, F.col("lang") == F.col("of")).select("lang", "text", picked.alias("picks")).where(F.size("picks") > 0)
    return taken.mapInArrow(_pieces, "text string, piece binary")


def train(docs: DataFrame, keep: Column | None = None, depth: int = DEPTH, train_bytes: int = TRAIN_BYTES, cells: int = CELLS) -> Trees | None:
    """The trees of all languages; None if there is no text with a language."""
    got = trained(
        sample(docs, F.lit(True) if keep is None else keep, train_bytes).withColumn("y", F.xxhash64("piece")),
        _train(depth, cells), "kind string, languages array<string>, keys binary, bits binary",
    )
    if not got:
        return None
    languages = list(got[0].languages)
    parts = {
        kind: (
            np.frombuffer(b"".join(bytes(r.keys) for r in got if r.kind == kind), np.uint64),
            np.frombuffer(b"".join(bytes(r.bits) for r in got if r.kind == kind), np.float32).reshape(-1, len(languages)),
        )
        for kind in ("edge", "node")
    }
    return Trees(languages, *parts["edge"], *parts["node"])


def predict(spark: SparkSession, text: Column | str, trees: Trees | None, depth: int = DEPTH) -> Column:
    """Struct of lang_pred, score and bits (under the predicted language) of each text."""
    text = F.col(text) if isinstance(text, str) else text
    nothing = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits"))
    if trees is None:
        return nothing
    shared = spark.sparkContext.broadcast(trees)

    @arrow_udf(_RESULT)
    def best(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value, depth)
        names = np.array(shared.value.languages, object)
        for column in batches:
            bits = scorer.bits(*as_bytes(column))
            pick = bits.argmin(axis=1) if len(bits) else np.zeros(0, np.int64)
            least = bits[np.arange(len(bits)), pick]
            score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
            yield pa.StructArray.from_arrays(
                [pa.array(names[pick], pa.string()), pa.array(score), pa.array(least)], ["lang_pred", "score", "bits"]
            )

    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    return F.when(letters, best(F.when(letters, F.lower(text)))).otherwise(nothing)


def language(docs: DataFrame, depth: int = DEPTH, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits) of every document; rows whose CRC-32 of the id
    leaves 2 modulo 4 are held out of the training."""
    part = split_no("doc_id", 4)
    trees = train(docs, part != 2, depth, train_bytes)
    scored = docs.select("doc_id", (part == 2).alias("held_out"), predict(docs.sparkSession, docs["text"], trees, depth).alias("_p"))
    return scored.select("doc_id", "held_out", "_p.lang_pred", "_p.score", "_p.bits")
