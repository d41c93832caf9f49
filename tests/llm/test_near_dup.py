"""Marks, nodes and links of the near-duplicate operator."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")

from strataday.llm import near_dup  # noqa: E402
from strataday.llm.texts import mix  # noqa: E402

from .conftest import passage  # noqa: E402


def _marked(sets):
    flat = np.concatenate([np.sort(s) for s in sets])
    size = np.array([len(s) for s in sets])
    return near_dup._marks(flat, np.repeat(np.arange(len(sets)), size), len(sets)), size


def _pair(rng, n, common):
    """Two sets of n hashes with so many in common."""
    both = mix(rng.integers(1, 1 << 62, 2 * n - common).astype(np.uint64))
    return both[:n], both[n - common :]


@pytest.mark.parametrize("n", [1, 4, 7, 20, 70, 300, 1500])
def test_marks_keep_links_and_drop_pairs_at_half(n):
    rng = np.random.default_rng(n)
    common = -(-6 * n // 7)  # similarity 0.75 at least
    linked = [_pair(rng, n, common) for _ in range(1500)]
    one, size = _marked([a for a, _ in linked])
    two, _ = _marked([b for _, b in linked])
    assert near_dup._pairs_likely(one, two, size, size).all()
    if n >= 70:
        apart = [_pair(rng, n, 2 * n // 3) for _ in range(500)]
        one, size = _marked([a for a, _ in apart])
        two, _ = _marked([b for _, b in apart])
        assert near_dup._pairs_likely(one, two, size, size).mean() < 0.02


def test_node_at_once_agrees_with_pairs():
    rng = np.random.default_rng(3)
    base = mix(rng.integers(1, 1 << 62, 400).astype(np.uint64))
    sets = [np.concatenate([base[: rng.integers(1, 400)], mix(rng.integers(1, 1 << 62, rng.integers(1, 99)).astype(np.uint64))])
            for _ in range(60)]
    sets += [base, base]
    marks, size = _marked(sets)
    equal, good = near_dup._node_likely(marks, size)
    x, y = np.triu_indices(len(sets), 1)
    assert (good[x, y] == near_dup._pairs_likely(marks[x], marks[y], size[x], size[y])).all()
    assert (equal[x, y] == ((marks[x] == marks[y]) & (marks[x] > 0)).sum(axis=1)).all()
    assert equal[-1, -2] == np.count_nonzero(marks[-1]) and good[-1, -2]


@pytest.mark.parametrize("cut", [1, 2, 3, 7, 100])
def test_nodes_are_whole_whatever_the_batches(cut):
    node = np.repeat([1, 2, 5, 9, 10], [3, 1, 8, 1, 2])
    batches = [pa.RecordBatch.from_arrays([pa.array(node[i : i + cut])], ["node"]) for i in range(0, len(node), cut)]
    got = [np.asarray(t["node"].combine_chunks()) for t in near_dup._whole_nodes(iter([batches[0].slice(0, 0), *batches]))]
    assert np.concatenate(got).tolist() == node.tolist()
    assert sum(len(set(t.tolist())) for t in got) == 5


def test_a_crowd_at_half_and_large_groups_of_copies(spark, monkeypatch):
    """Documents that share half their text make no links; nodes above SMALL and in it give the same groups."""
    half = passage(1, 80)
    texts = [" ".join(half + passage(10 + i, 80)) for i in range(60)]
    base = passage(2, 120)
    texts += [" ".join([*base[:60], f"w{i}", *base[61:]]) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: min(i, 60) for i in range(120)}
    for small in (near_dup.SMALL, 16):
        monkeypatch.setattr(near_dup, "SMALL", small)
        assert {r.doc_id: r.component_id for r in near_dup.near_dup(docs).collect()} == want


def _group(rng, n, changed):
    """Sets of 140 hashes that share a base, of which each has up to so many of its own."""
    base = mix(rng.integers(1, 1 << 62, 140).astype(np.uint64))
    own = (mix(rng.integers(1, 1 << 62, rng.integers(0, changed)).astype(np.uint64)) for _ in range(n))
    return [np.concatenate([o, base[rng.permutation(140)[len(o) :]]]) for o in own]


def test_rows_of_a_node_at_a_time_give_all_its_pairs():
    rng = np.random.default_rng(5)
    marks, size = _marked(_group(rng, 150, 50))
    kind = rng.integers(0, 60, 150)
    good = near_dup._node_likely(marks, size)[1] & (kind[:, None] != kind)
    x, y, more = near_dup._node_pairs(marks, size, kind, True)
    assert not more and list(zip(x, y)) == list(zip(*np.nonzero(np.triu(good, 1))))
    x, y, more = near_dup._node_pairs(marks, size, kind, False)
    assert more and good[x, y].all() and len(x) < 300
    assert set(x) | set(y) == set(np.flatnonzero(good.any(axis=1)))


def test_documents_just_below_the_threshold_are_raised_in_one_node_only():
    """Two open nodes with the same documents raise each pair once; a pair of the second one alone is raised there."""
    rng = np.random.default_rng(6)
    marks, size = _marked(_group(rng, 40, 30))
    rows = [(node, doc) for node, docs in ((3, range(39)), (7, range(40))) for doc in docs]
    at = [doc for _, doc in rows]
    batch = pa.RecordBatch.from_arrays([
        pa.array([node for node, _ in rows]), pa.array([True] * len(rows)), pa.array(at), pa.array(at),
        pa.array([marks[i].tobytes() for i in at], pa.binary()), pa.array(size[at]),
        pa.array([[3, 7] if i < 39 else [7] for i in at], pa.list_(pa.int64())),
    ], ["node", "full", "doc", "class", "marks", "n_shingles", "fulls"])
    got = pa.Table.from_batches(near_dup._pairs_of_nodes(iter([batch])))
    pairs = list(zip(got["a"].to_pylist(), got["b"].to_pylist()))
    x, y = np.nonzero(np.triu(near_dup._node_likely(marks, size)[1], 1))
    assert sorted(pairs) == list(zip(x, y)) and got["node"].null_count == len(got)


def test_a_crowd_just_below_the_threshold_ends_in_two_levels(spark, monkeypatch):
    """Nodes of more than 512 documents that share a base are compared without branching, with classes named once a document."""
    base, made = passage(3, 60), []
    texts = [" ".join([*base[:k], f"a{i}", *base[k + 1 : 40], f"b{i}", *base[41:]]) for i, k in enumerate(range(5, 30)) for _ in "x"]
    texts = [f"{t} c{j}" for j in range(24) for t in texts]
    mixed = near_dup._mixed_nodes
    monkeypatch.setattr(near_dup, "_mixed_nodes", lambda dealt, classes: made.append(dealt) or mixed(dealt, classes))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = near_dup.near_dup(docs).select("component_id").distinct().count()
    assert len(texts) == 600 and len(made) <= 2 and got < 600
    assert all(dealt.count() == dealt.select("doc").distinct().count() for dealt in made)


def _connected(n, x, y, kind):
    """Lowest row that each row is connected with by the pairs and by equal kinds."""
    lowest = list(range(n))
    def top(i):
        while lowest[i] != i:
            i = lowest[i]
        return i
    same = [(i, kind.tolist().index(k)) for i, k in enumerate(kind.tolist())]
    for i, j in [*zip(x, y), *same]:
        lowest[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(n)]


def test_a_node_compared_on_full_sets_gives_links_of_its_classes_only():
    """Exactly the classes that all its links make, by no more links than classes; a pair of a lower node is left to that."""
    rng = np.random.default_rng(8)
    sets = [np.unique(s) for s in _group(rng, 90, 60)]
    marks, size = _marked(sets)
    kind = rng.integers(0, 70, 90)
    common = np.array([[len(np.intersect1d(s, t)) for t in sets] for s in sets])
    linked = np.triu(100 * common >= 75 * (size[:, None] + size - common), 1)
    x, y = np.nonzero(linked)
    batch = pa.RecordBatch.from_arrays([
        pa.array([5] * 90), pa.array(range(90)), pa.array(kind), pa.array(size),
        pa.array([m.tobytes() for m in marks], pa.binary()), pa.array([[5]] * 90, pa.list_(pa.int64())),
        pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
    ], ["node", "doc", "class", "n_shingles", "marks", "fulls", "shingles"])
    got = pa.Table.from_batches(near_dup._links_of_nodes(iter([batch])))
    a, b = got["a"].to_pylist(), got["b"].to_pylist()
    assert all(linked[i, j] for i, j in zip(a, b)) and 0 < len(a) < len(set(kind.tolist()))
    assert _connected(90, a, b, kind) == _connected(90, x, y, kind)
    lower = batch.set_column(0, "node", pa.array([5] * 90)).set_column(5, "fulls", pa.array([[3, 5]] * 90, pa.list_(pa.int64())))
    assert sum(map(len, near_dup._links_of_nodes(iter([lower])))) == 0


def test_documents_just_below_the_threshold_make_no_rows_of_pairs(spark, monkeypatch):
    """The rows of pairs grow with the documents of a crowd, not with its square; nodes too large to hold give the same groups."""
    base, count, links = passage(4, 140), [], near_dup._links
    # Pairs of a group of three have one shingle more in common: 137 of 181, the others 136 of 182.
    texts = [" ".join([*base, f"g{i // 3}", *(f"w{i}x{k}" for k in range(22))]) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(near_dup, "_links", lambda pairs, docs: count.append(pairs.count()) or links(pairs, docs))
    for held in (near_dup.HELD, 0):
        monkeypatch.setattr(near_dup, "HELD", held)
        count.clear()
        assert {r.doc_id: r.component_id for r in near_dup.near_dup(docs).collect()} == {i: i - i % 3 for i in range(300)}
        assert sum(count) < 32 * 300
