"""Token ids in binary blocks with Elias-Fano document boundaries.

The file format is a Parquet table of blocks, so any storage that Spark writes to holds it.
A block has consecutive documents of one shard: their ids, the concatenated token ids as
little-endian integers (16 bits where the vocabulary allows, else 32), and the offsets
between documents as an Elias-Fano sequence. Shards are ranges of doc_id in ascending
order; within a shard blocks are numbered, and know the ids in those before. A block is
closed once it has ``BLOCK_IDS`` ids.

Texts are dealt out by ranges of doc_id once; each task encodes and writes its range. Where
a document starts in the whole follows from the totals of the shards before it (one row a
shard, sent to the tasks that read) and the block's own numbers: no ids are moved again.

Defined results: NULL and empty texts have the end id only; a NULL doc_id comes first; rows
that repeat an id stay separate, in order of their texts; very long texts are encoded whole
and may fill a block alone; an empty table gives no blocks.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import shuffle_parts

BLOCK_IDS = 1 << 20
BLOCKS = "shard int, block int, before long, n_docs long, n_ids long, width int, doc_ids array<long>, bounds binary, ids binary"
#: Pieces whose ids a worker remembers.
REMEMBERED = 500_000
#: Letters of plain texts, and all their characters; controls are left out.
_LETTERS = r"A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\xFF"
_PLAIN = r"\x09-\x0D\x20-\x7E\xC0-\xD6\xD8-\xF6\xF8-\xFF"
#: Fixed value: the vocabulary's pattern, for plain texts.
_PATTERN = rf"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9\x20\x09-\x0D]+"
PLAIN = re.compile(f"[{_PLAIN}]*").fullmatch
PLAIN_PIECES = re.compile(_PATTERN).findall
#: As above for any text; a run between white space with another character is a piece.
PIECES = re.compile(rf"[\x21-\x7E\xC0-\xD6\xD8-\xF6\xF8-\xFF]*[^{_PLAIN}][^\x20\x09-\x0D]*|{_PATTERN}").findall
EVERY = 64
#: Texts that are encoded together.
TEXTS = 256


def _byte_letters(word: str) -> str:
    """The word's bytes as the vocabulary writes them: the letter of the same number, or for those
    that Latin-1 doesn't print the letters from 256 on."""
    return word.encode().decode("latin-1").translate(_UNPRINTED)


_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_UNPRINTED = {b: 256 + n for n, b in enumerate(sorted({*range(256)} - _PRINTED))}


class EliasFano:
    """A sorted sequence of integers in near-minimal space, with select.

    Stored as: count, low bits, number of high bytes, number of samples, then the low parts, the
    high parts in unary, and the place of every 64th set bit.
    """

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        values = np.asarray(values, np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low = max(0, int(np.log2(top / n))) if n and top > n else 0
        lows = ((values[:, None] >> np.arange(low)) & 1).astype(np.uint8).ravel()
        places = (values >> low) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        high[places] = 1
        packed = np.packbits(high, bitorder="little")
        samples = places[::EVERY].astype("<u4")
        head = np.array([n, low, len(packed), len(samples)], "<u4")
        return head.tobytes() + np.packbits(lows, bitorder="little").tobytes() + packed.tobytes() + samples.tobytes()

    def __init__(self, stored: bytes):
        self.n, self.low, size, count = map(int, np.frombuffer(stored, "<u4", 4))
        at = 16 + (self.n * self.low + 7) // 8
        self.lows = np.frombuffer(stored, np.uint8, at - 16, 16)
        self.high = np.frombuffer(stored, np.uint8, size, at)
        self.samples = np.frombuffer(stored, "<u4", count, at + size)

    def all(self) -> np.ndarray:
        """The whole sequence."""
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        bits = np.unpackbits(self.lows, bitorder="little")[: self.n * self.low].reshape(self.n, self.low)
        lows = bits.astype(np.int64) @ (1 << np.arange(self.low, dtype=np.int64)) if self.low else 0
        return ((places - np.arange(self.n)) << self.low) + lows

    def select(self, i: int) -> int:
        """The i-th value, from the nearest sample before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // EVERY]), i % EVERY
        byte = place // 8
        left += int(np.unpackbits(self.high[byte : byte + 1], bitorder="little")[: place % 8].sum())
        while True:
            ones = np.flatnonzero(np.unpackbits(self.high[byte : byte + 32], bitorder="little"))
            if left < len(ones):
                place = byte * 8 + int(ones[left])
                break
            left -= len(ones)
            byte += 32
        span = np.arange(i * self.low, (i + 1) * self.low)
        bits = (self.lows[span // 8] >> (span % 8)) & 1
        return ((place - i) << self.low) + int((bits.astype(np.int64) << np.arange(self.low)).sum())


class WordEncoder:
    """Ids of whole texts, piece by piece, with those of pieces met before remembered.

    A piece is what the vocabulary's own pattern cuts a plain text into, which is one of ASCII and
    the letters of Latin-1: these stay as they are under normalisation but for their case, and no
    token crosses two pieces. A run between white space that holds any other character is
    one piece as it is. Texts that may hold a special token's string go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        # A piece that is new takes the next number as it is asked for.
        self.place = defaultdict(count().__next__)
        self.start, self.length, self.flat = (np.zeros(0, np.int32) for _ in range(3))

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def places(self, asked: list[str]) -> np.ndarray:
        """Numbers of the pieces, whose ids are then held; with too many held, only those asked for now stay."""
        known = len(self.place)
        at = np.fromiter(map(self.place.__getitem__, asked), np.int64, len(asked))
        if known and len(self.place) > max(known, REMEMBERED):
            self.forget()
            return self.places(asked)
        try:
            self.learn([*islice(reversed(self.place), len(self.place) - known)][::-1])
        except BaseException:
            self.forget()
            raise
        return at

    def learn(self, unknown: list[str]) -> None:
        """Look up the ids of pieces that have just been numbered, in that order."""
        if not unknown:
            return
        other = [w for w in unknown if not PLAIN(w)]
        whole, look = dict(zip(other, self._ids(other))) if other else {}, self.model.tokenize
        lists = [
            whole[w] if w in whole else [t.id for t in look(w if w.isascii() else _byte_letters(w))]
            for w in (w if w in whole else w.lower() for w in unknown)
        ]
        length = np.fromiter(map(len, lists), np.int32, len(lists))
        start = np.cumsum(length, dtype=np.int32) - length + np.int32(len(self.flat))
        new = np.fromiter((i for ids in lists for i in ids), np.int32, int(length.sum()))
        self.start, self.length, self.flat = (
            np.concatenate(both) for both in ((self.start, start), (self.length, length), (self.flat, new))
        )

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        split = [
            [] if not t or any(s in t for s in self.special)
            else PLAIN_PIECES(t.lower()) if PLAIN(t) else PIECES(t)
            for t in texts
        ]
        flat = [w for pieces in split for w in pieces]
        at = self.places(flat)
        length, start = self.length[at], self.start[at]
        ends = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
        ids = self.flat[np.repeat(start - ends[:-1], length) + np.arange(ends[-1])]
        cuts = ends[np.cumsum([0, *map(len, split)])]
        out = [ids[i:j] for i, j in zip(cuts[:-1], cuts[1:])]
        for i, t in enumerate(texts):
            if t and not split[i]:
                out[i] = np.array(self._ids([t])[0], np.int64)
        return out


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _blocks(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        kind = "<u2" if max(encoder.vocabulary, end_id + 1) <= 1 << 16 else "<u4"
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        doc_ids, ids, size = [], [], 0

        def close() -> pa.RecordBatch:
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            bounds = EliasFano.encode(np.concatenate([[0], np.cumsum(lengths)]))
            values = [shard, block, before, len(ids), int(lengths.sum()), int(kind[-1]), doc_ids, bounds, np.concatenate(ids).astype(kind).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

        names = [c.split()[0] for c in BLOCKS.split(", ")]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS):
                part = batch.slice(i, TEXTS)
                for doc_id, own in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text").to_pylist())):
                    doc_ids.append(doc_id)
                    ids.append(np.append(own, end_id))
                    size += len(own) + 1
                    if size >= BLOCK_IDS:
                        yield close()
                        doc_ids, ids, size, block, before = [], [], 0, block + 1, before + size
        if ids:
            yield close()

    return run


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, shards: int | None = None) -> None:
    """Encode all documents and write the blocks; ``tokenizer`` is a file on every executor."""
    shards = shards or shuffle_parts(docs.sparkSession)
    ordered = (
        docs.select(F.col("doc_id").cast("long"), F.col("text"))
        .repartitionByRange(shards, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    )
    ordered.mapInArrow(_blocks(tokenizer, end_id), BLOCKS).write.option("compression", "zstd").parquet(path)


def read_token_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with ``base``, the ids in all blocks before."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # One row a shard, whose number is the number of write tasks.
    bases = shards.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("shard_base"))
    based = blocks.join(F.broadcast(bases), "shard")
    return based.withColumn("base", F.col("shard_base") + F.col("before")).drop("shard_base", "before")


def _documents(digest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                bounds = EliasFano(b["bounds"]).all()
                ids = np.frombuffer(b["ids"], f"<u{b['width']}").astype("<u4")
                yield pa.RecordBatch.from_arrays([
                    pa.array(b["doc_ids"], pa.int64()), pa.array(b["base"] + bounds[:-1], pa.int64()),
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.array([digest(ids[i:j]) for i, j in zip(bounds[:-1], bounds[1:])]),
                ], ["doc_id", "start", "n_tokens", "value"])

    return run


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files."""
    return read_token_blocks(spark, path).mapInArrow(
        _documents(lambda ids: ids.tolist()), "doc_id long, start long, n_tokens long, value array<long>"
    ).withColumnRenamed("value", "ids")


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""
    return read_token_blocks(spark, path).mapInArrow(
        _documents(lambda ids: zlib.crc32(ids.tobytes())), "doc_id long, start long, n_tokens long, value long"
    ).withColumnRenamed("value", "ids_crc32")
