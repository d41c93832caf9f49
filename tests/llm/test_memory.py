"""What tasks leave behind in a worker."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")

from strataday.llm import texts, toxicity  # noqa: E402

from .conftest import passage  # noqa: E402


def test_scoring_and_training_keep_small_tables_of_powers(monkeypatch):
    """A batch of 3 MB is worked on in slices, so that tables of 16 MB stay; scores are those of single texts."""
    held: list[np.ndarray] = []
    monkeypatch.setattr(texts, "_HELD", held)
    some = [" ".join(passage(k, 2000)) for k in range(20)]
    column = pa.array(some * (1 + 3_000_000 // sum(map(len, some))))
    dense = np.random.default_rng(1).normal(0, 0.01, toxicity.BUCKETS)
    got = toxicity.score_texts(column, dense, 0.1)
    assert np.array_equal(got[:20], np.concatenate([toxicity.score_texts(pa.array([t]), dense, 0.1) for t in some]))
    batch = pa.RecordBatch.from_arrays([column, pa.array(np.arange(len(column)) % 2, pa.float64())], ["text", "y"])
    assert len(list(toxicity._train(toxicity.Ftrl(passes=1))(iter([batch])))) == 1
    assert sum(p.nbytes for p in held) < 17 << 20
