"""Token counts by dynamic programming over prefixes.

For a byte-pair vocabulary the encoding of every prefix of a text follows from those of
the shorter prefixes: it ends in the one piece that fits behind the encoding before it. Two pieces fit
if no join across their border would have come before the joins that made them, which is seen by
taking these back, the latest first. A
table with the count at every prefix therefore answers how many tokens a text or any
prefix of it has and where a budget of tokens ends, without encoding anything again.

No piece of the vocabulary has a space mark behind another character, and line ends are not
in it, so a text falls into chunks whose tables do not depend on each other; the counts of
chunks seen lately and of their prefixes are kept in the worker, up to a bound. Counting is a column expression over
whole texts and needs no shuffle.

Defined results: NULL and empty texts have 0 tokens; very long texts are counted whole;
repeated rows get equal counts; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

SPACE_MARK = "▁"
#: Chunks, prefixes and pairs of pieces that a worker remembers of each kind, twice at most.
REMEMBERED = 300_000
#: Longer chunks are worked out each time.
LONG_CHUNK = 64


class _Lately(dict):
    """Values worked out when first asked for; of those not asked for lately the older ones go."""

    def __init__(self, work, remembered: int = 0):
        self.work, self.remembered, self.older = work, remembered or REMEMBERED, {}

    def __missing__(self, key):
        if key in self.older:
            value = self.older[key]
        else:
            value = self.work(key)
        if len(self) >= self.remembered:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class PrefixTable:
    """Token counts of all prefixes under one sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [
            i for i in range(model.vocab_size())
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in ids}
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.rank):
            raise ValueError("a piece has a space mark behind another character")
        self.longest = max(map(len, self.rank))
        stop = "" if any("\n" in p for p in self.rank) else "\n"
        self.chunks = re.compile(f"{SPACE_MARK}+[^{SPACE_MARK}{stop}]*|[^{SPACE_MARK}{stop}]+|\n").findall
        #: The last join of each piece that alone is encoded as itself; none for single characters.
        self.joins: dict[str, tuple[str, str] | None] = {}
        for piece in self.rank:
            parts, last = self.merged(piece)
            if len(parts) == 1:
                self.joins[piece] = last
        #: Lengths of the pieces that end in the same three characters, the longest first; then 2 and 1.
        ends: dict[str, set[int]] = {}
        for piece in self.joins:
            ends.setdefault(piece[-3:], set()).add(len(piece))
        self.lengths = {end: (*sorted((n for n in own if n > 2), reverse=True), 2, 1) for end, own in ends.items() if len(end) == 3}
        self.pairs = _Lately(lambda pair: self.apart(*pair))
        self.prefixes = _Lately(None)
        self.totals = _Lately(self.of_whole)

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Pieces of a short text and the join made last: the best-ranked neighbours are joined first, from the left."""
        parts, last = list(text), None
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get(parts[i] + parts[i + 1], float("inf")))
            if parts[best] + parts[best + 1] not in self.rank:
                break
            last = parts[best], parts[best + 1]
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts, last

    def _made(self, piece: str) -> float:
        """When a piece is made: its rank; single characters are there from the start."""
        return self.rank[piece] if len(piece) > 1 else -1.0

    def apart(self, left: str, right: str) -> bool:
        """Whether two pieces that stand stay apart when they meet.

        The last piece of the left side and the first of the right are taken back join by join, the latest first; of
        equal joins the right one is the later. No pair of pieces that are there at one
        time may have a join that comes before the next one of either; of equal joins the left one comes first.
        """
        end_left = end_right = float("inf")
        while True:
            joined = self.rank.get(left + right)
            if joined is not None and joined < end_left and joined <= end_right:
                return False
            made_left, made_right = self._made(left), self._made(right)
            if made_left < 0 and made_right < 0:
                return True
            if made_left > made_right:
                end_left = made_left
                left = self.joins[left][1]
                made = self._made(left)
            else:
                end_right = made_right
                right = self.joins[right][0]
                made = self._made(right)
            if made >= max(made_left, made_right):  # a part that ranks behind the whole: try it out
                return None

    def fits(self, left: str, right: str) -> bool:
        """Whether the two pieces stay apart when they meet."""
        known = self.pairs[left, right]
        return self.merged(left + right)[0] == [left, right] if known is None else known

    def of_chunk(self, chunk: str) -> list[int]:
        """Count at each prefix of the chunk, the empty one first."""
        counts, last = [0], [""]
        for end in range(1, len(chunk) + 1):
            count, piece = self._next(chunk, end, lambda start: (counts[start], last[start]))
            counts.append(count)
            last.append(piece)
        return counts

    def of_whole(self, chunk: str) -> int:
        """Count of the chunk, worked out from its longest prefix that is remembered."""
        return self._state(chunk)[0] if len(chunk) <= LONG_CHUNK else self.of_chunk(chunk)[-1]

    def _state(self, chunk: str) -> tuple[int, str]:
        """Count of a short chunk and its last piece; it and its prefixes are remembered."""
        seen, older = self.prefixes, self.prefixes.older
        end = len(chunk)
        held = seen.get(chunk) or older.get(chunk)
        own: dict[int, tuple[int, str]] = {}
        while held is None and end > 1:
            end -= 1
            held = seen.get(chunk[:end]) or older.get(chunk[:end])

        def at(start: int) -> tuple[int, str]:
            if start in own:
                return own[start]
            if not start:
                return 0, ""
            return seen.get(chunk[:start]) or older.get(chunk[:start]) or self._state(chunk[:start])

        if held is None:
            end = 0
        else:
            own[end] = held
        while end < len(chunk):
            end += 1
            held = own[end] = self._next(chunk, end, at)
            if len(seen) >= seen.remembered:
                seen.older = older = dict(seen)
                seen.clear()
            seen[chunk[:end]] = held
        return held

    def _next(self, chunk: str, end: int, at) -> tuple[int, str]:
        """Count and last piece of the prefix up to ``end``; ``at`` gives those of the shorter ones.

        A character outside the vocabulary is one token a byte, with which nothing is joined.
        """
        stands = self.joins
        for n in self.lengths.get(chunk[end - 3 : end], (2, 1)) if end > 2 else (2, 1):
            if n > end:
                continue
            piece = chunk[end - n : end]
            if piece in stands:
                count, before = at(end - n)
                if not before or self.fits(before, piece):
                    return count + 1, piece
        return at(end - 1)[0] + len(chunk[end - 1].encode("utf-8", "surrogatepass")), ""

    def parts(self, text: str | None) -> list[str]:
        return self.chunks(SPACE_MARK + text.replace(" ", SPACE_MARK)) if text else []

    def total(self, text: str | None) -> int:
        return sum(map(self.totals.__getitem__, self.parts(text)))

    def table(self, text: str | None) -> list[int]:
        """Token count of the first 0, 1, 2 ... characters of the text."""
        counts, base = [], 0
        for chunk in self.parts(text):
            own = self.of_chunk(chunk)
            counts += [base + c for c in own[1:]]
            base += own[-1]
        return [0, *counts[1:]]

    def cut(self, text: str | None, budget: int) -> tuple[int, int]:
        """Tokens of the text, and the most characters from its start within the budget."""
        parts = self.parts(text)
        ends = list(accumulate(map(self.totals.__getitem__, parts)))
        if not ends or ends[-1] <= budget:
            return (ends[-1] if ends else 0), len(text or "")
        k = bisect_left(ends, budget)
        if ends[k] == budget and k + 1 < len(ends):
            k += 1
        base = ends[k - 1] if k else 0
        if base > budget or (base == budget and k):
            inside = 0
        else:
            own = self.of_chunk(parts[k])
            inside = max((i for i in range(len(own)) if base + own[i] <= budget), default=0)
        return ends[-1], max(0, sum(map(len, parts[:k])) + inside - 1)


@lru_cache(maxsize=4)
def prefix_table(path: str) -> PrefixTable:
    return PrefixTable(path)


def token_cut(text: Column | str, path: str, budget: int) -> Column:
    """(n_tokens, cut) of each text: its token count, and how many of its first characters
    stay within the budget. ``path`` is the model file on every executor."""

    @arrow_udf("struct<n_tokens:bigint,cut:bigint>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = prefix_table(path)
        for column in batches:
            got = [table.cut(t, budget) for t in column.to_pylist()]
            yield pa.StructArray.from_arrays(
                [pa.array([g[k] for g in got], pa.int64()) for k in (0, 1)], ["n_tokens", "cut"]
            )

    return count(text)


def prefix_counts(text: Column | str, path: str) -> Column:
    """Token count at every prefix of each text, from the empty one to the whole."""

    @arrow_udf("array<int>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = prefix_table(path)
        for column in batches:
            yield pa.array([table.table(t) for t in column.to_pylist()], pa.list_(pa.int32()))

    return count(text)


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, cut) of every document."""
    text = F.coalesce("text", F.lit(""))
    counted = docs.select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), token_cut("text", path, limit).alias("c")
    )
    return counted.select(
        "doc_id", "n_bytes", F.col("c.n_tokens").alias("n_tokens"),
        (F.col("c.n_tokens") > limit).alias("over_limit"), F.col("c.cut").alias("cut"),
    )
