"""The pipeline's stages on odd rows with clashing column names, and on empty tables."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from strataday.llm import decontaminate, near_dup  # noqa: E402

from .conftest import passage  # noqa: E402

CLASHING = "_id long, _gone string, _copies int, _copy int, _row int, _taken int, key long, n long"


@pytest.fixture(scope="module")
def tables(spark, rows, tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    item = " ".join(passage(77, 25))
    docs = [(r[0], r[1], r[2], r[3], len(r[1] or "")) for r in rows]
    docs += [(200 + i, f"vile filth {' '.join(passage(300 + i, 30))} vile filth", "en", "s0", 1) for i in range(40)]
    docs += [(400 + i, " ".join(passage(600 + i, 40)), "en", "s1", 1) for i in range(40)]
    docs += [(500, f"{' '.join(passage(900, 10))} {item}", "en", "s2", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING
    frame = spark.createDataFrame([(*d, 1, "g", 2, 3, 4, 5, 6, 7) for d in docs], schema)
    frame.write.parquet(f"{base}/documents.parquet")
    labels = [(200 + i, 1, 1) for i in range(40)] + [(400 + i, 1, 0) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    empty = tmp_path_factory.mktemp("empty")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{base}/{name}.parquet").where("false").write.parquet(f"{empty}/{name}.parquet")
    return str(base), str(empty)


def test_stages_one_after_the_other(spark, tables, tmp_path):
    from tokenizers import Tokenizer

    base, _ = tables
    docs, kept = spark.read.parquet(f"{base}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, base)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = (before, docs)
        if name != "token_ids":
            assert docs.columns == before.columns
    ids = lambda df: {r.doc_id for r in df.collect()}
    before, after = kept["toxicity"]
    gone = ids(before) - ids(after)
    assert len(gone & set(range(200, 240))) >= 35 and not gone - set(range(200, 240))
    before, after = kept["near_duplicates"]
    wanted = {r.doc_id for r in near_dup.near_dup(before).where("kept").collect()}
    assert ids(after) - {None} == wanted - {None} and 1 not in ids(after) and 2 not in ids(after)
    before, after = kept["decontamination"]
    hit = {r.doc_id for r in decontaminate.contaminated(before, spark.read.parquet(f"{base}/benchmark.parquet")).collect()}
    assert hit == {500} and ids(before) - ids(after) == hit
    before, mixed = kept["mixing"]
    sizes = {r.doc_id: len((r.text or "").split()) for r in before.collect()}
    times = {}
    for r in mixed.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
        assert r._gone == "g" and r._row == 4
    assert set(times) <= set(sizes) and all(n <= 2 * 3 for n in times.values())
    words = sum(sizes.values())
    assert sum(n * sizes[i] for i, n in times.items()) == pytest.approx(1.5 * words, rel=0.35)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = sorted(kept["token_ids"][1].collect(), key=lambda r: r.start)
    assert len(rows) == mixed.count()
    text = {r.doc_id: r.text for r in mixed.collect()}
    place = 0
    for r in rows:
        assert r.start == place
        place += r.n_tokens
        if r.doc_id != 9 and r.doc_id is not None:
            held = [*library.encode(text[r.doc_id] or "", add_special_tokens=False).ids, 2]
            assert (r.n_tokens, r.ids_crc32) == (len(held), zlib.crc32(np.array(held, "<u4").tobytes()))


def test_empty_tables(spark, tables):
    assert corpus_pipeline.run(spark, tables[1]).count() == 0
