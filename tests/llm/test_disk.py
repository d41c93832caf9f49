"""What operators move and leave on disk: texts and ids are not shuffled again, passing tables go."""

from __future__ import annotations

import os
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from strataday.llm import mixing, near_dup, token_ids  # noqa: E402
from strataday.scratch import passing_scratch, scratch_path, written  # noqa: E402

from .conftest import passage  # noqa: E402

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture
def plan(spark, capsys):
    """Formatted plan without broadcasts that only the size of small tables allows."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)

    def text(df) -> str:
        spark.conf.set(name, "-1")
        try:
            capsys.readouterr()
            df.explain("formatted")
            return capsys.readouterr().out
        finally:
            spark.conf.set(name, before)

    return text


def moved(text: str) -> list[str]:
    """The columns that each exchange of a plan takes in."""
    return re.findall(r"\(\d+\) (?:Broadcast)?Exchange\nInput \[\d+\]: (.*)", text)


def test_mix_moves_no_text(spark, docs, plan):
    out = mixing.mix_documents(docs)
    found = moved(plan(out))
    assert found and not any(re.search(r"\btext#", columns) for columns in found)


def test_mix_takes_the_copies_of_each_row_in_runs_of_any_size(spark, monkeypatch):
    """Rows that repeat an id and a text, in more runs than buckets, get the copies that their numbers were given."""
    monkeypatch.setattr(mixing, "RUN", 3)
    r = random.Random(5)
    rows = [(None if i % 7 == 0 else i // 3, "w " * (i // 3 % 40), r.choice(["a", "a", "b", None]), i) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, at long").repartition(3)
    seen = []
    real = mixing.mixed
    monkeypatch.setattr(mixing, "mixed", lambda numbered, **how: seen.append((numbered, real(numbered, **how))) or seen[-1][1])
    got = Counter(x.at for x in mixing.mix_documents(docs).collect())
    numbered, taken = seen[0]
    copies = {x.row: x.copies for x in taken.collect()}
    assert len(copies) == len(rows) and len(set(copies.values())) > 1
    assert got == Counter({x["at"]: copies[x["_row"]] for x in numbered.collect() if copies[x["_row"]]})
    assert {x["_run"] for x in numbered.collect()} == {x["_row"] >> 3 for x in numbered.collect()}


def test_reading_token_ids_moves_no_ids(spark, docs, tmp_path, plan):
    token_ids.write_token_ids(docs, str(tmp_path / "a"), WORDS, 2, 3)
    found = moved(plan(token_ids.document_digests(spark, str(tmp_path / "a"))))
    assert found and not any(re.search(r"\bids#", columns) for columns in found)


def test_documents_start_behind_the_blocks_before(spark, tmp_path, monkeypatch):
    """Several blocks a shard, some shards empty."""
    monkeypatch.setattr(token_ids, "BLOCK_IDS", 50)
    texts = [" ".join(passage(k, k % 30)) for k in range(60)]
    for shard, some in enumerate([range(0, 25), range(0), range(25, 60)]):
        monkeypatch.setattr(token_ids, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: shard)))
        batch = pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([texts[k] for k in some], pa.string())], ["doc_id", "text"])
        blocks = list(token_ids._blocks(WORDS, 2)(iter([batch])))
        assert len(blocks) > 2 or not some
        if blocks:
            pq.write_table(pa.Table.from_batches(blocks), tmp_path / f"part-{shard}.parquet")
    place = 0
    for k, r in enumerate(token_ids.document_digests(spark, str(tmp_path)).orderBy("start").collect()):
        ids = [*token_ids.word_encoder(WORDS).encode([texts[k]])[0].tolist(), 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (k, place, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        place += len(ids)


def test_near_duplicates_leave_one_table(spark, docs):
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(os.listdir(shared))
    out = near_dup.keep_one_of_each(docs)
    assert [x.rsplit("-", 1)[0] for x in set(os.listdir(shared)) - before] == ["gone"]
    ids = {x.doc_id for x in out.collect()}
    assert {0, 3, 9} <= ids and not {1, 2, 7} & ids


def test_passing_tables_go_also_when_it_fails(spark):
    kept = scratch_path(spark, "kept")
    with pytest.raises(ZeroDivisionError), passing_scratch(spark):
        spark.range(3).write.parquet(kept)
        inner = scratch_path(spark, "inner")
        written(spark.range(3), "passing")
        spark.range(3).write.parquet(inner)
        1 / 0
    exists = lambda path: os.path.exists(path.removeprefix("file:"))
    assert exists(kept) and not exists(inner) and spark.read.parquet(kept).count() == 3


def test_pieces_are_numbered_as_they_come_and_forgotten_when_too_many(monkeypatch):
    monkeypatch.setattr(token_ids, "REMEMBERED", 40)
    encoder = token_ids.WordEncoder(WORDS)
    some = [" ".join(passage(k, 12)) + " Don't 12 漢é" for k in range(30)]
    for k in range(0, 30, 3):
        got = [ids.tolist() for ids in encoder.encode(some[k : k + 3])]
        assert got == [encoder.library.encode(t, add_special_tokens=False).ids for t in some[k : k + 3]]
        assert list(encoder.place.values()) == list(range(len(encoder.start))) and len(encoder.place) < 80
    with monkeypatch.context() as broken, pytest.raises(ZeroDivisionError):
        broken.setattr(encoder, "_ids", lambda texts: 1 / 0)
        encoder.encode(["new 漢漢"])
    assert encoder.encode(["new 漢漢"])[0].tolist() == encoder.library.encode("new 漢漢", add_special_tokens=False).ids
