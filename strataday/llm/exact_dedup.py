"""Exact duplicates against a persistent index of digests.

The index is a table of (digest, keep_id, group_size) bucketed and sorted by digest. New
documents are reduced to one row a digest before anything is shuffled by it, matched with
the index by a sort-merge anti-join that moves the new digests only, and those not found
are appended. The index outlives the session: any later session opens it by its path.

Texts are equal when identical after each run of white space is replaced by one space.
Defined results: a NULL text counts as empty; rows that repeat both id and text count as one
document with several rows; a NULL id stays only if no other row has its text; very long
texts are hashed whole; an empty table gives an empty result and leaves the index as it is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, scratch_path, written

BUCKETS = 32


def text_digest(text: Column | str) -> Column:
    """SHA-256 of the text with its white space folded, in lower-case hexadecimal."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "), 256)


class DigestIndex:
    """Bucketed, sorted Parquet table of known digests at a path.

    The number of buckets is fixed when the index is made; choose it for the size the
    index is to reach (about 100 MB a bucket).
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest STRING, keep_id BIGINT, group_size BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        """All digests, read with their bucketing."""
        return self.spark.table(self.name)

    def files(self) -> DataFrame:
        """The same rows, read as plain files: joins on them are dealt out anew, so that
        adaptive execution can split a digest that many rows share."""
        return self.spark.read.schema(self.rows().schema).parquet(self.path)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The rows of (digest, ...) whose digest is not in the index."""
        return groups.hint("merge").join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame) -> DataFrame:
        """Add the digests that are new; the rows that were added."""
        fresh = written(self.unseen(groups).select("digest", "keep_id", "group_size"), "fresh-digests")
        (
            fresh.repartition(self.buckets, "digest").sortWithinPartitions("digest")
            .write.mode("append").insertInto(self.name)
        )
        self.spark.catalog.refreshTable(self.name)
        return fresh


def digest_groups(digests: DataFrame) -> DataFrame:
    """One row a digest: the smallest id and the number of rows."""
    return digests.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))


def dedup_against(index: DigestIndex, docs: DataFrame) -> DataFrame:
    """New documents after a look into the index, which learns their digests: doc_id,
    digest, keep_id, group_size (of the batch that brought the digest first), kept."""
    digests = written(docs.select(F.col("doc_id").cast("long"), text_digest(docs["text"]).alias("digest")), "digests")
    index.append(digest_groups(digests))
    known = digests.join(index.files(), "digest")
    return known.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def exact_dedup(docs: DataFrame, path: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every document, by an index at
    ``path`` (a new one in the scratch folder if none is given)."""
    spark = docs.sparkSession
    index = DigestIndex(spark, path or scratch_path(spark, "digest-index"), buckets)
    return dedup_against(index, docs).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )
