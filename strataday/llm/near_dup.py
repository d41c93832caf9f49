"""Near duplicates by a chosen-path set similarity join over word shingles.

Every document's set of shingles is sketched by minwise hashes. A forest of independent trees then
branches the documents: a node picks one or two sketch places at random (4/3 on average, the
reciprocal of the similarity 0.75) and deals its documents to children by what they have there, so
a similar pair stays together in some child of each tree with good odds. These odds fall with the
depth, so a forest is followed by others, with sketches of their own, for the documents whose nodes
went so deep that a pair at the similarity 0.75 would be found with odds below ``RECALL``: the
number of trees follows from the depth that is reached. Nodes with few documents are compared exhaustively; in a
larger one a single document, its pivot, is compared with all others and leaves, and the
rest branch on. Only documents that are not yet known to be connected are compared, so a
node of thousands of near copies costs one comparison each and is then dropped.

Candidates go if the sizes of their sets rule out a link, or their marks: a byte for each of 256 ranges
of hashes, taken from the set's lowest hash in it. Given how many ranges two sets use, the equal ones are a draw
without replacement from their union, so sets of some hundred shingles are told apart almost exactly;
pairs more than 4.5 standard deviations below the threshold go, every other link is confirmed on the full sets. A
small node is compared in two passes: first each document with the first and with the most
alike of those that it may be linked to, then, in nodes where this left likely pairs out, all
pairs that are still unconnected; the second pass goes along with the first one of the next
level, and each of its pairs is raised in one node only. A node with more than ``CROWD`` such pairs a document makes
no rows of pairs: its full sets meet in the node, which gives a link for every two classes that it joins. Only a node whose
sets have more than ``HELD`` hashes gives all its likely pairs as rows. What a level deals out is kept as a row a document
with its nodes, so that classes, marks and sketches are joined once a document. Tasks hold one batch and one node
at a time, and of a node's comparisons some rows.
Documents with equal sets are one vertex throughout.

Defined results: NULL, empty and blank texts have empty sets and are linked with nothing; texts
shorter than a shingle are one shingle as a whole; very long texts are used whole; rows
that repeat id and text are one vertex and several rows; ids are taken to be unique
otherwise; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, passing_scratch, scratch_path, shuffle_parts, sized, written
from .components import stars
from .texts import LOWER, as_bytes, mix, prefix_sums, shingle_hash, slices, span_hash, words

SHINGLE = 5
#: Similarity of a link, as a fraction.
SIMILAR = (75, 100)
PLACES = 64
#: Bytes of a place: wide enough that documents without a common shingle hardly ever meet in a node.
WIDTH = 4
#: Trees of a forest.
TREES = 16
#: Odds with which the forests together bring a pair at the similarity 0.75 into one node.
RECALL = 0.999
#: Nodes of at most so many documents are compared exhaustively.
SMALL = 4096
#: Rows of a node that are compared with the others at a time.
BLOCK = 64
#: Nodes of at most so many documents are compared many at a time, all pairs at once.
FEW = 8
#: Pairs a document of a node that are confirmed one by one; nodes with more are compared on full sets in place.
CROWD = 16
#: Hashes of a node's sets, repeats included, that a task holds to compare them in place.
HELD = 1 << 21
#: Bytes of texts worked on at a time; longer texts are a slice of their own. Tables of powers and sums take some 30 times this.
SLICE = 1 << 19
#: Ranges of hashes that have a mark, a byte each.
MARKS = 256
#: Standard deviations below the similarity of a link at which marks rule a pair out: by the normal
#: law a link has odds of 3.4e-6 to be that low.
DEVIATIONS = 4.5


def _odd(forest: int) -> np.ndarray:
    """Multipliers of a forest's sketch places."""
    place = np.arange(1 + forest * PLACES, 1 + (forest + 1) * PLACES, dtype=np.uint64)
    return mix(place * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def missed(depth: int, trees: int) -> float:
    """Odds that a pair at the similarity of a link shares no node at this depth of so many trees over one sketch."""
    over, under = SIMILAR
    share, out = over / under, 0.0
    for k in range(PLACES + 1):
        one, both, stays = k / PLACES, k * (k - 1) / (PLACES * (PLACES - 1)), 1.0
        for _ in range(depth):
            # One place with odds 2/3, two different ones with odds 1/3.
            stays = 4 / 3 * one * stays - both * stays**2 / 3
        out += comb(PLACES, k) * share**k * (1 - share) ** (PLACES - k) * (1 - stays) ** trees
    return out


def _runs(data: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data = LOWER[data]
    start, end, first = words(data, off)
    word = span_hash(prefix_sums(data), start, end)
    shingle, at = shingle_hash(word, first, SHINGLE)
    for i in range(len(off) - 1):
        n = first[i + 1] - first[i]
        if n >= SHINGLE:
            own = np.sort(shingle[at[i] : at[i + 1]])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif n:
            whole = shingle_hash(word[first[i] : first[i + 1]], np.array([0, n]), int(n))[0]
            yield whole
        else:
            yield word[:0]


def _marks(flat: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """For each row and range of hashes a byte of the lowest hash, 0 if there is none; sorted within rows."""
    out = np.zeros(rows * MARKS, np.uint8)
    place = row * MARKS + (flat >> np.uint64(56)).astype(np.int64)
    lowest = np.ones(len(place), bool)
    lowest[1:] = place[1:] != place[:-1]
    out[place[lowest]] = 1 + (flat[lowest] & np.uint64(0xFFFFFF)) % np.uint64(255)
    return out.reshape(rows, MARKS)


def _likely(equal: np.ndarray, used: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes may be linked, by the ranges whose marks are equal and those that either uses."""
    over, under = SIMILAR
    share = over / under
    union = (one + two) / (1 + share)  # of a pair that is just similar enough
    spread = share * (1 - share) * used * np.maximum(union - used, 0) / np.maximum(union - 1, 1)
    enough = equal >= share * used - DEVIATIONS * np.sqrt(spread) - 1e-6
    # No draw hides more of the difference than the set sizes allow: exact for sets of few shingles.
    enough &= equal >= used - (1 - share) * union - 1e-6
    return enough & (under * np.minimum(one, two) >= over * np.maximum(one, two))


def _pairs_likely(a: np.ndarray, b: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The same for pairs of rows of marks."""
    used = np.count_nonzero(a | b, axis=1)
    return _likely(np.count_nonzero(a == b, axis=1) - MARKS + used, used, one, two)


def _node_likely(marks: np.ndarray, size: np.ndarray, at: int = 0, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Equal marks of a node's rows from ``at`` to ``end`` with all rows from ``at`` on, and whether each pair may be linked."""
    rows, own, size = marks[at:], marks[at:end], size[at:]
    n = len(rows)
    some = (rows > 0).astype(np.float32)
    full = some.sum(axis=1).astype(np.int64)
    used = full[: len(own), None] + full - (some[: len(own)] @ some.T).astype(np.int64)
    # Sums of eight bytes at a time; a byte counts at most MARKS / 8.
    equal = np.empty((len(own), n), np.int64)
    for k, row in enumerate(own):
        equal[k] = (rows == row).view(np.uint64).sum(axis=1).view(np.uint8).reshape(n, 8).sum(axis=1)
    equal += used - MARKS
    return equal, _likely(equal, used, size[: len(own), None], size)


def _node_pairs(
    marks: np.ndarray, size: np.ndarray, kind: np.ndarray, full: bool, first: Callable | None = None, limit: float = np.inf
) -> tuple[np.ndarray, np.ndarray, bool]:
    """Likely pairs of different classes of a node: all of them if ``full``, else those of a star cover and of each
    row with the one most like it; and whether that leaves some out.

    ``first``: which pairs a full node is to look at; above ``limit`` of them it gives none.
    """
    n = len(marks)
    covered, best, most = np.zeros(n, bool), np.full(n, -1), np.full(n, -1)
    x, y, all_ = [], [], 0
    for at in range(0, n, BLOCK):
        equal, good = _node_likely(marks, size, at, at + BLOCK)
        good &= kind[at : at + BLOCK, None] != kind[at:]
        good = np.triu(good, 1)
        if full:
            i, j = np.nonzero(good)
            i, j = at + i, at + j
            keep = first(i, j) if first else slice(None)
            x.append(i[keep])
            y.append(j[keep])
            all_ += len(x[-1])
            if all_ > limit:
                return best[:0], best[:0], True
            continue
        for i in np.flatnonzero(good.any(axis=1)):
            j = at + np.flatnonzero(good[i])
            all_ += len(j)
            alike = equal[i, j - at]
            better = alike > most[j]
            best[j[better]], most[j[better]] = at + i, alike[better]
            top = alike.argmax()
            if alike[top] > most[at + i]:
                best[at + i], most[at + i] = j[top], alike[top]
            if not covered[at + i]:
                j = j[~covered[j]]
                covered[j] = True
                x.append(np.full(len(j), at + i))
                y.append(j)
    some = np.flatnonzero(best >= 0)
    x, y = np.concatenate([*x, np.minimum(some, best[some])]), np.concatenate([*y, np.maximum(some, best[some])])
    pair = np.unique(x * n + y)
    return pair // n, pair % n, not full and len(pair) < all_


def _first_shared(node: int, x: np.ndarray, y: np.ndarray, also: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which pairs (x, y) of a node's rows share no lower node, by the nodes that each row has."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    lower = also < node
    which, code, count = np.unique(also[lower], return_inverse=True, return_counts=True)
    shared = count > 1
    has = np.zeros((len(off) - 1, max(1, np.count_nonzero(shared))), bool)
    has[row[lower][shared[code]], (np.cumsum(shared) - 1)[code[shared[code]]]] = True
    keep = np.ones(len(x), bool)
    for k in range(0, len(x), 1 << 14):
        own = slice(k, k + (1 << 14))
        keep[own] = ~(has[x[own]] & has[y[own]]).any(axis=1)
    return keep


def _node_links(
    marks: np.ndarray, size: np.ndarray, kind: np.ndarray, first: Callable, flat: np.ndarray, off: np.ndarray
) -> tuple[list[int], list[int]]:
    """Links of a node's rows by their full sets (``flat`` from ``off`` on): one for every two classes that they join.

    ``first``: which pairs of rows the node is to look at.
    """
    over, under = SIMILAR
    code, kind, count = np.unique(flat, return_inverse=True)[1].astype(np.int32), kind.copy(), np.diff(off)
    inside = np.zeros(len(flat), bool)
    x, y = [], []
    for at in range(0, len(marks), BLOCK):
        good = np.triu(_node_likely(marks, size, at, at + BLOCK)[1], 1)
        a, b = np.nonzero(good & (kind[at : at + BLOCK, None] != kind[at:]))
        keep = first(at + a, at + b)
        a, b = at + a[keep], at + b[keep]
        for i in np.unique(a):
            j = b[a == i]
            j = j[kind[j] != kind[i]]
            if not len(j):
                continue
            own, many = code[off[i] : off[i + 1]], count[j]
            start = np.cumsum(many) - many
            theirs = np.repeat(off[j] - start, many) + np.arange(many.sum())
            inside[own] = True
            common = np.add.reduceat(inside[code[theirs]], start, dtype=np.int64)
            inside[own] = False
            j = j[under * common >= over * (count[i] + count[j] - common)]
            joined, one = np.unique(kind[j], return_index=True)
            kind[np.isin(kind, joined)] = kind[i]
            x += [i] * len(one)
            y += j[one].tolist()
    return x, y


def _sketch(forest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _odd(forest)
        for batch in batches:
            for i, j, data, off in slices(batch.column("text"), SLICE):
                sets = list(_runs(data, off))
                size = np.fromiter(map(len, sets), np.int64, len(sets))
                full = np.flatnonzero(size)
                first = np.cumsum(size[full]) - size[full]
                flat = np.concatenate(sets) if len(full) else np.zeros(0, np.uint64)
                keys = np.zeros((2, len(sets)), np.uint64)
                sketch = np.zeros((len(sets), PLACES), np.uint32)
                marks = _marks(flat, np.repeat(np.arange(len(sets)), size), len(sets))
                if len(full):
                    for k in range(2):
                        keys[k, full] = np.add.reduceat(mix(flat + np.uint64(k)), first)
                    for k, odd in enumerate(factors):
                        lowest = np.minimum.reduceat(flat * odd, first)
                        sketch[full, k] = (mix(lowest) >> np.uint64(64 - 8 * WIDTH)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(i, j - i), pa.array(size),
                    pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)),
                    pa.array([row.tobytes() for row in sketch], pa.binary()),
                    pa.array([row.tobytes() for row in marks], pa.binary()),
                ], ["doc_id", "n_shingles", "key", "key2", "sketch", "marks"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, off in slices(batch.column("text"), SLICE):
            sets = [s.view(np.int64) for s in _runs(data, off)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, j - i), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "shingles"]
            )


def sketches(docs: DataFrame, forest: int = 0) -> DataFrame:
    """(doc_id, n_shingles, key, key2, sketch, marks): size of the set, a 128-bit key of it, its minwise
    hashes for a forest, its marks."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(
        _sketch(forest), "doc_id long, n_shingles long, key long, key2 long, sketch binary, marks binary"
    )


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, shingles): hashes of each document's distinct shingles."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(_sets, "doc_id long, shingles array<long>")


def _children(node: Column, sketch: str = "sketch") -> Column:
    """Children that a document goes to from a node: one place, and with odds 1/3 another."""
    def child(place: Column) -> Column:
        return F.xxhash64(node, place, F.substring(sketch, (place * WIDTH + 1).cast("int"), F.lit(WIDTH)))

    one = F.pmod(F.xxhash64(node, F.lit(1)), F.lit(PLACES))
    two = F.pmod(one + 1 + F.pmod(F.xxhash64(node, F.lit(2)), F.lit(PLACES - 1)), F.lit(PLACES))
    more = F.pmod(F.xxhash64(node, F.lit(3)), F.lit(3)) == 0
    return F.when(more, F.array(child(one), child(two))).otherwise(F.array(child(one)))


def _mixed_nodes(dealt: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (node, full, doc, class, n) of the nodes whose documents aren't all connected."""
    def marked(nodes: str, full: bool) -> Column:
        return F.transform(nodes, lambda node: F.struct(node.alias("node"), F.lit(full).alias("full")))

    named = dealt.join(classes, dealt["doc"] == classes["vertex"], "left").select(
        "doc", F.coalesce("component", "doc").alias("class"),
        F.explode(F.concat(marked("nodes", False), marked("fulls", True))).alias("at"),
    ).select("at.node", "at.full", "doc", "class")
    nodes = named.groupBy("node").agg(
        F.count("*").alias("n"), F.min("class").alias("lo"), F.max("class").alias("hi")
    ).where("lo < hi").select(F.col("node").alias("of"), "n")
    return named.join(nodes, F.col("node") == F.col("of")).drop("of")


def _whole_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by node, dealt out so that no node is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        node = np.asarray(batch.column("node"))
        if not len(node):
            continue
        last = int(np.searchsorted(node, node[-1]))
        if last or (held and held[-1].column("node")[-1].as_py() != node[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _pairs_of_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Likely pairs (a, b) of different classes within whole nodes: if the node is to be compared in full, all
    that no lower such node raises, else those of a star cover; and the nodes (node, full) where that leaves some out,
    which full ones do that have too many pairs and can be compared in place."""
    for got in _whole_nodes(batches):
        node, doc, kind, size = (
            np.asarray(got[c].combine_chunks()) for c in ("node", "doc", "class", "n_shingles")
        )
        full = got["full"].to_numpy()
        marks = as_bytes(got["marks"])[0].reshape(-1, MARKS)
        fulls = got["fulls"].combine_chunks()
        also, at_full = np.asarray(fulls.flatten()), np.zeros(len(node) + 1, np.int64)
        np.cumsum(np.asarray(fulls.value_lengths().fill_null(0)), out=at_full[1:])
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        count = np.diff(np.append(first, len(node)))
        a, b, more = [], [], []
        for n in range(2, FEW + 1):
            x, y = np.triu_indices(n, 1)
            x, y = ((first[count == n][:, None] + z).ravel() for z in (x, y))
            apart = kind[x] != kind[y]
            x, y = x[apart], y[apart]
            for k in range(0, len(x), 1 << 14):
                i, j = x[k : k + (1 << 14)], y[k : k + (1 << 14)]
                good = _pairs_likely(marks[i], marks[j], size[i], size[j])
                a.append(i[good])
                b.append(j[good])
        for at, n in zip(first[count > FEW], count[count > FEW]):
            own, off = slice(at, at + n), at_full[at : at + n + 1]
            look = partial(_first_shared, node[at], also=also[off[0] : off[-1]], off=off - off[0])
            limit = CROWD * n if size[own].sum() <= HELD else np.inf
            x, y, open_ = _node_pairs(marks[own], size[own], kind[own], full[at], look, limit)
            if open_:
                more.append((node[at], full[at]))
            a.append(at + x)
            b.append(at + y)
        a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (a, b))
        none = lambda n, kind=pa.int64(): pa.nulls(n, kind)
        columns = [(pa.array(doc[a]), none(len(more))), (pa.array(doc[b]), none(len(more))),
                   (none(len(a)), pa.array([x for x, _ in more], pa.int64())),
                   (none(len(a), pa.bool_()), pa.array([bool(x) for _, x in more], pa.bool_()))]
        yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], ["a", "b", "node", "full"])


def _links_of_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that join classes within whole nodes, of the pairs that no lower node in ``fulls`` looks at."""
    for got in _whole_nodes(batches):
        node, doc, kind, size = (
            np.asarray(got[c].combine_chunks()) for c in ("node", "doc", "class", "n_shingles")
        )
        marks = as_bytes(got["marks"])[0].reshape(-1, MARKS)
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        a, b = [], []
        for at, end in zip(first, np.append(first[1:], len(node))):
            own, part = slice(at, end), got.slice(at, end - at)
            (also, at_also), (flat, off) = ((np.asarray(z.flatten()), np.append(0, np.cumsum(z.value_lengths())))
                                            for z in (part[c].combine_chunks() for c in ("fulls", "shingles")))
            look = partial(_first_shared, node[at], also=also, off=at_also)
            x, y = _node_links(marks[own], size[own], kind[own], look, flat, off)
            a += doc[own][x].tolist()
            b += doc[own][y].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _full_links(nodes: DataFrame, docs: DataFrame, vertices: DataFrame) -> DataFrame:
    """Links (a, b) that join the classes of these nodes, by the full sets of their documents."""
    of_doc = written(nodes.groupBy("doc").agg(F.min("class").alias("class"), F.collect_list("node").alias("fulls")), "crowds")
    sets = _sets_of(of_doc.select(F.col("doc").alias("id")), docs).withColumnRenamed("doc_id", "doc")
    full = of_doc.join(vertices.select("doc", "marks", "n_shingles"), "doc").join(sets, "doc").select(
        F.explode("fulls").alias("node"), "doc", "class", "marks", "n_shingles", "fulls", "shingles"
    )
    parts = shuffle_parts(nodes.sparkSession)
    links = full.repartition(parts, "node").sortWithinPartitions("node", "doc").mapInArrow(_links_of_nodes, "a long, b long")
    return written(links, "full-links")


def _small_pairs(nodes: DataFrame, vertices: DataFrame) -> DataFrame:
    """Pairs (a, b) of unconnected documents of small nodes that the marks don't rule out, and nodes (node, full) left open."""
    of_doc = nodes.where(F.col("n") <= SMALL).groupBy("doc").agg(
        F.min("class").alias("class"), F.collect_list(F.struct("node", "full")).alias("all")
    )
    fulls = F.transform(F.filter("all", lambda at: at["full"]), lambda at: at["node"])
    small = of_doc.join(vertices.select("doc", "marks", "n_shingles"), "doc").select(
        "doc", "class", "marks", "n_shingles", fulls.alias("fulls"), F.explode("all").alias("at")
    ).select("at.node", "at.full", "doc", "class", "marks", "n_shingles", F.when(F.col("at.full"), F.col("fulls")).alias("fulls"))
    parts = shuffle_parts(nodes.sparkSession)
    return small.repartition(parts, "node").sortWithinPartitions("node", "doc").mapInArrow(
        _pairs_of_nodes, "a long, b long, node long, full boolean"
    )


def _keep_likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, len(batch), 1 << 14):
            part = batch.slice(i, 1 << 14)
            one, two = (as_bytes(part.column(c))[0].reshape(-1, MARKS) for c in ("ma", "mb"))
            good = _pairs_likely(one, two, np.asarray(part.column("na")), np.asarray(part.column("nb")))
            yield part.select(["a", "b"]).filter(pa.array(good))


def _with_pivots(large: DataFrame) -> DataFrame:
    """Rows of large nodes with (pivot): class and document of one of the node's documents."""
    pivots = large.groupBy("node").agg(F.max(F.struct("class", "doc")).alias("pivot"))
    return large.join(pivots, "node")


def _pivot_pairs(large: DataFrame, vertices: DataFrame) -> DataFrame:
    """Pairs of each large node's pivot and the others, as far as the marks don't rule them out."""
    pairs = _with_pivots(large).where(F.col("class") != F.col("pivot.class")).select(
        F.least("doc", "pivot.doc").alias("a"), F.greatest("doc", "pivot.doc").alias("b")
    ).distinct()
    one = vertices.select(F.col("doc").alias("a"), F.col("marks").alias("ma"), F.col("n_shingles").alias("na"))
    two = vertices.select(F.col("doc").alias("b"), F.col("marks").alias("mb"), F.col("n_shingles").alias("nb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ma", "mb", "na", "nb").mapInArrow(
        _keep_likely, "a long, b long"
    )


def _sets_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, shingles) of the documents with these ids (id)."""
    needed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, F.col("doc_id") == F.col("id"), "left_semi")
    return shingle_sets(needed).dropDuplicates(["doc_id"])


def _links(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs that are similar by their full sets."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    sets = written(_sets_of(ids, docs), "sets")
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    over, under = SIMILAR
    return written(
        both.where(under * common >= over * (F.size("sa") + F.size("sb") - common)).select("a", "b"), "links"
    )


def _with_links(links: DataFrame, classes: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links so far and the classes that they make, without the classes' own documents; the same as before
    if none was found."""
    if found.isEmpty():
        return links, classes
    links = links.unionByName(found)
    return links, stars(links).select(F.col("u").alias("vertex"), F.col("v").alias("component"))


def _forest(
    docs: DataFrame, vertices: DataFrame, forest: int, links: DataFrame, classes: DataFrame, count: int
) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Links and classes with what a forest adds to them, and the documents that each of its levels dealt out.

    ``count``: rows of the documents, which with those of a level bound all tables of a round.
    """
    trees = range(forest * TREES, (forest + 1) * TREES)
    roots = F.flatten(F.array(*[_children(F.lit(-tree - 1).cast("long")) for tree in trees]))
    dealt = vertices.select("doc", roots.alias("nodes"), F.array().cast("array<long>").alias("fulls"))
    levels, rows, known = [dealt], vertices.count() * TREES * 4 // 3, None
    while True:
        with sized(docs.sparkSession, max(rows, count)):
            links, classes, known, large, open_ = _level(dealt, known, docs, vertices, links, classes)
            if large is None and open_ is None:
                return links, classes, levels
            dealt = written(_dealt(large, open_, vertices), "dealt")
        if large is not None:
            levels.append(dealt.where(F.size("nodes") > 0))
        rows = dealt.agg(F.sum(F.size("nodes") + F.size("fulls"))).first()[0] or 0


def _dealt(large: DataFrame | None, open_: DataFrame | None, vertices: DataFrame) -> DataFrame:
    """(doc, nodes, fulls) for the next level: the children that a document goes to from its large nodes, and its open nodes."""
    rows = reduce(DataFrame.unionByName, (r for r in (large, open_) if r is not None))
    of_doc = rows.groupBy("doc").agg(
        F.collect_list(F.when(~F.col("full"), F.col("node"))).alias("nodes"),
        F.collect_list(F.when(F.col("full"), F.col("node"))).alias("fulls"),
    )
    if large is None:
        return of_doc
    return of_doc.join(vertices.select("doc", "sketch"), "doc").select(
        "doc", F.flatten(F.transform("nodes", lambda node: _children(node))).alias("nodes"), "fulls"
    )


def _level(
    dealt: DataFrame, known: DataFrame | None, docs: DataFrame, vertices: DataFrame, links: DataFrame, classes: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None, DataFrame | None]:
    """Links and classes with what the nodes of a level add to them, the pairs (a, b) that were looked at, (doc, node, full)
    of the nodes that branch on, and (doc, node, full) of those to be compared in full with the next level; None if there are none.

    ``known``: pairs that the level before looked at; they aren't looked at again.
    """
    nodes = written(_mixed_nodes(dealt, classes), "nodes")
    large = nodes.where(F.col("n") > SMALL)
    seen = written(_small_pairs(nodes, vertices), "seen")
    left, crowds = (seen.where(F.col("full") == full).select(F.col("node").alias("of")) for full in (False, True))
    deeper, again = not large.isEmpty(), not left.isEmpty()
    pairs = seen.where(F.col("node").isNull()).select("a", "b")
    if deeper:
        pairs = pairs.unionByName(_pivot_pairs(large, vertices))
    pairs = pairs.distinct()
    if known is not None:
        pairs = pairs.join(known, ["a", "b"], "left_anti")
    pairs = written(pairs, "pairs")
    found = [] if pairs.isEmpty() else [_links(pairs, docs)]
    if not crowds.isEmpty():
        found.append(_full_links(nodes.join(crowds, F.col("node") == F.col("of"), "left_semi"), docs, vertices))
    if found:
        links, classes = _with_links(links, classes, reduce(DataFrame.unionByName, found))
    branch = _with_pivots(large).where(F.col("doc") != F.col("pivot.doc")).select("doc", "node", F.lit(False).alias("full"))
    open_ = nodes.join(left, F.col("node") == F.col("of"), "left_semi").select("doc", "node", F.lit(True).alias("full"))
    return links, classes, pairs, branch if deeper else None, open_ if again else None


def _unsure(odds: DataFrame, levels: list[DataFrame]) -> DataFrame | None:
    """(doc, odds) of the documents whose pairs the forests so far miss with odds above the target's."""
    lost = [missed(depth, TREES) for depth in range(1, len(levels) + 1)]
    deep = [rows.select("doc", F.lit(p).alias("lost")) for rows, p in zip(levels, lost) if p > 1 - RECALL]
    if not deep:
        return None
    deepest = reduce(DataFrame.unionByName, deep).groupBy("doc").agg(F.max("lost").alias("lost"))
    left = odds.join(deepest, "doc").select("doc", (F.col("odds") * F.col("lost")).alias("odds"))
    left = written(left.where(F.col("odds") > 1 - RECALL), "unsure")
    return None if left.isEmpty() else left


def similar_components(docs: DataFrame, vertices: DataFrame) -> DataFrame:
    """(vertex, component) of every vertex that has a link; vertices: (doc, sketch, marks, n_shingles)."""
    spark = docs.sparkSession
    links = spark.createDataFrame([], "a long, b long")
    classes = spark.createDataFrame([], "vertex long, component long")
    odds, forest, count = vertices.select("doc", F.lit(1.0).alias("odds")), 0, docs.count()
    while True:
        links, classes, levels = _forest(docs, vertices, forest, links, classes, count)
        odds = _unsure(odds, levels)
        if odds is None:
            return classes
        forest += 1
        again = docs.join(odds, F.col("doc_id").cast("long") == F.col("doc"), "left_semi")
        vertices = written(
            sketches(again, forest).where("n_shingles > 0")
            .select(F.col("doc_id").alias("doc"), "sketch", "marks", "n_shingles").dropDuplicates(["doc"]), "vertices",
        )


def near_dup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    seen = written(sketches(docs), "sketches")
    key = ["key", "key2"]
    lowest = F.min_by(F.struct(F.col("doc_id").alias("doc"), "sketch", "marks", "n_shingles"), "doc_id").alias("lowest")
    sets = written(seen.where("n_shingles > 0").groupBy(*key).agg(lowest).select(*key, "lowest.*"), "set-keys")
    vertices = sets.where(F.col("doc").isNotNull()).drop(*key)
    if not vertices.groupBy("doc").count().where("count > 1").isEmpty():  # an id with several texts
        vertices = written(vertices.dropDuplicates(["doc"]), "vertices")
    classes = similar_components(docs, vertices)
    named = sets.select(*key, "doc").join(classes, F.col("doc") == F.col("vertex"), "left").select(
        *key, F.coalesce("component", "doc").alias("component_id")
    )
    empty = seen.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    full = seen.where("n_shingles > 0").join(named, key).select("doc_id", "n_shingles", "component_id")
    return full.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each group, with all their columns.

    Rows that repeat an id of a group's document all stay, as does a NULL id. The ids that go are
    written; the tables that led to them are removed.
    """
    spark = docs.sparkSession
    name = free_name(docs, "_gone")  # columns of the documents may have any names
    path = scratch_path(spark, "gone")
    with passing_scratch(spark):
        gone = near_dup(docs).where(~F.col("kept")).select(F.col("doc_id").alias(name))
        gone.write.parquet(path)
    gone = spark.read.schema(gone.schema).parquet(path)
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
