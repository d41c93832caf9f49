"""Token groups and link counts against brute force over token ends."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from strataday.llm import alignment  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoder():
    return alignment.Encoder(A, B)


def brute(encoder, rows):
    """Results by row number."""
    a, b, out, held = encoder.a, encoder.b, [], []
    for _, text, *_ in rows:
        x = a.model.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.model.encode(text) if text else []
        if text and not b"".join(a.spelled[k] for k in x) == b"".join(b.spelled[k] for k in y) == (" " + text).encode():
            x, y = [], []
        ends_a, ends_b = (np.cumsum([side.length[k] for k in ids]).astype(int) for side, ids in ((a, x), (b, y)))
        found, i, j, links = [], 0, 0, Counter()
        for end in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
            p, q = int(np.searchsorted(ends_a, end)) + 1, int(np.searchsorted(ends_b, end)) + 1
            found.append((x[i:p], y[j:q]))
            links.update((u, v) for u in x[i:p] for v in y[j:q])
            i, j = p, q
        spelled = ";".join(f"{','.join(map(str, u))}|{','.join(map(str, v))}" for u, v in found)
        out.append([len(x), len(y), len(found), links.total(), 0, 0, hashlib.sha256(spelled.encode()).hexdigest() if x else ""])
        held.append(links)
    count, top = Counter(p for links in held for p in links), Counter()
    for (u, _), n in count.items():
        top[u] = max(top[u], n)
    for row, links in zip(out, held):
        row[4] = sum(m for p, m in links.items() if count[p] == top[p[0]])
        row[5] = sum(m * count[p] for p, m in links.items())
    return sorted(((r[0], *o) for r, o in zip(rows, out)), key=str)


@pytest.mark.parametrize("sent", [alignment.SENT, 40, 0])
def test_alignment_matches_brute_force(spark, docs, rows, encoder, sent):
    more = [(100, "▁ mark"), (101, "a  b   c\t\n d \n\n"), (102, "漢字かな交じり文 😀😀 ﬁ"), (103, "y" * 3000 + "漢" * 500), (104, "é" * 40 + " x" * 300)]
    every = [*rows, *((i, t, *[None] * 7) for i, t in more)]
    frame = docs.unionAll(spark.createDataFrame(every[len(rows):], docs.schema))
    got = sorted(map(tuple, alignment.align_tokens(frame, A, B, sent).collect()), key=str)
    assert got == brute(encoder, every)
    by = {r[0]: r for r in got}
    assert by[100][1:] == by[3][1:] == by[4][1:] == (0, 0, 0, 0, 0, 0, "") and by[103][1] > 100


def test_empty_table(empty):
    assert alignment.align_tokens(empty, A, B).count() == 0


def test_groups_are_the_common_ends():
    r = random.Random(2)
    for size, share, window in ((1, 0.5, 4), (40, 0.3, 4), (500, 0.9, 64), (500, 0.02, 2), (3000, 0.99, 1 << 16), (3000, 1.0, 128)):
        for _ in range(20):
            common = sorted({r.randrange(1, 10 * size) for _ in range(size)})
            a = np.array(sorted({x for x in common if r.random() < share} | {10 * size}))
            b = np.array(sorted({x for x in common if r.random() < share} | {10 * size}))
            to_a, to_b = alignment.groups(a, b, window)
            ends = np.intersect1d(a, b)
            assert (a[to_a - 1] == ends).all() and (b[to_b - 1] == ends).all()


def test_runs_are_measured_to_their_end():
    for n in range(1, 70):
        for rest in (0, 1, 9):
            a = [*range(n), *range(1000, 1000 + rest)]
            b = [*range(n), *range(2000, 2000 + rest)]
            assert alignment.one_to_one(a, b, 0, 0) == n
            assert alignment.one_to_one([7, *a], b, 1, 0) == n


def test_cut_texts_have_the_ids_of_whole_texts(encoder):
    r = random.Random(9)
    parts = ["foo", "Bar's", " ", "  ", "\n", "\t", "é", "漢字", "12", "<s>", "<|endoftext|>", "'ll", "…", " ", " ", "x" * 30, "!?", "\x1c", "\x85"]
    for _ in range(400):
        text = "".join(r.choice(parts) + r.choice(["", " ", " "]) for _ in range(r.randint(1, 40)))
        chunk, _, good = encoder.encode([text])
        assert encoder.held_a.take(chunk)[0].tolist() == encoder.a.model.encode(" " + text, add_special_tokens=False).ids
        assert encoder.held_b.take(chunk)[0].tolist() == encoder.b.model.encode(text)
        assert good.all()


def test_numbers_come_back_from_their_packed_form():
    values = np.array([3, 5, 5, 900, 1 << 40])
    assert alignment._unpack(alignment._pack(values)).tolist() == values.tolist()
    small = np.array([1, 254, 255, 256, 1 << 33, 2])
    assert alignment._unpack_small(alignment._pack_small(small), 6).tolist() == small.tolist()
    assert alignment._unpack(alignment._pack(values[:0])).tolist() == alignment._unpack_small(b"", 0).tolist() == []


def test_only_new_chunks_are_walked(monkeypatch):
    own, walked, walk = alignment.Encoder(A, B), [], alignment._walk
    monkeypatch.setattr(alignment, "_walk", lambda a, b: walked.append(len(a)) or walk(a, b))
    text = "the same words, unusually tokenised ▁ here"
    first = alignment.Aligned(own, ["words", text, "the same words", None])
    seen = sum(walked)
    again = alignment.Aligned(own, ["the same words", "words", "here the words"] * 50)
    assert 0 < seen == sum(walked)
    assert first.row.tolist() == [0, 2] and len(again.row) == 150
    once = alignment.Aligned(alignment.Encoder(A, B), ["the same words", "words", "here the words"])
    assert again.hashes() == once.hashes() * 50 and again.n_groups.tolist() == once.n_groups.tolist() * 50
