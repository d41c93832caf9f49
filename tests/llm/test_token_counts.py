"""Prefix counts against the library and against joining pieces one by one."""

from __future__ import annotations

import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from strataday.llm import token_counts  # noqa: E402

PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def table():
    return token_counts.PrefixTable(PIECES)


def test_pieces_that_stay_apart(table):
    r = random.Random(1)
    pieces = sorted(table.joins)
    pairs = [(r.choice(pieces), r.choice(pieces)) for _ in range(4000)]
    for _ in range(4000):  # borders within likely pieces
        text = r.choice(pieces) + r.choice(pieces)[:3]
        k = r.randrange(1, len(text))
        if text[:k] in table.joins and text[k:] in table.joins:
            pairs.append((text[:k], text[k:]))
    seen = {True: 0, False: 0}
    for left, right in pairs:
        want = table.merged(left + right)[0] == [left, right]
        assert table.fits(left, right) == want
        seen[want] += 1
    assert min(seen.values()) > 100


@pytest.mark.parametrize("remembered", [token_counts.REMEMBERED, 7])
def test_random_texts_count_like_the_library(monkeypatch, remembered):
    import sentencepiece

    monkeypatch.setattr(token_counts, "REMEMBERED", remembered)
    table = token_counts.PrefixTable(PIECES)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    r = random.Random(2)
    letters = "abcdehinorst ▁  éäßñ漢\n\t0012.,;<s>\x00😀"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += ["onthertion" * 40, "x" * 3000, " " * 500, "re\n\nthe" * 100]
    assert [table.total(t) for t in texts] == [len(ids) for ids in model.encode(texts)]
    for t in texts[:200]:
        counts = table.table(t)
        assert counts == [len(model.encode(t[:k])) for k in range(len(t) + 1)]
        for budget in (0, 3, 11):
            assert table.cut(t, budget) == (counts[-1], max(k for k, c in enumerate(counts) if c <= budget))
