"""From raw documents to token-id blocks: toxicity, near duplicates, benchmark passages, mixing, token ids.

Each stage takes what the one before it kept and returns the columns of documents; the last
returns a row a document of the files it wrote. Defined results for odd rows are those of the
operators: rows with NULL ids or texts pass the filters.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strataday.llm import decontaminate, mixing, near_dup, token_ids, toxicity
from strataday.llm.common import scratch_path, table, written


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dup.keep_one_of_each(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed_in(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixing.mix_documents(docs)


def tokens_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id blocks in a fresh folder, read back: (doc_id, start, n_tokens, ids_crc32)."""
    path = scratch_path(spark, "token-ids")
    token_ids.write_token_ids(docs, path, public_tokenizers.path("word_bpe_49k.json"), 2)
    return token_ids.document_digests(spark, path)


STAGES = [
    ("toxicity", toxic_out),
    ("near_duplicates", near_duplicates_out),
    ("decontamination", benchmark_out),
    ("mixing", mixed_in),
    ("token_ids", tokens_out),
]

#: SQL can express neither the trained model nor the alignment, the sampling and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
