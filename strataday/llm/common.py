"""Small helpers of the operators: tables, splits by document, written intermediates."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import passing_scratch, scratch_path

#: The words of a text are the runs between these.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_no(doc_id: Column | str, n: int) -> Column:
    """Remainder of the CRC-32 of the id as text; NULL counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def ascii_lower(col: Column | str) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame written below the shared scratch folder and read again, so that what
    follows neither works it out twice nor depends on executors that may go."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until the frame has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Rows for which a shuffle of a round gets one more partition.
ROUND_ROWS = 20_000


@contextmanager
def sized(spark: SparkSession, rows: int) -> Iterator[None]:
    """Shuffles that run within have a partition for every ``ROUND_ROWS`` rows, at most as many as the session says.

    For rounds over tables whose rows were counted: late rounds are small, and tasks
    without rows would take longer than the work. ``rows`` has to cover the largest table that takes part.
    """
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(1, min(int(before), -(-rows // ROUND_ROWS)))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def labelled(docs: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int) -> DataFrame:
    """A sample of about ``rows`` labelled texts: (text, y), or all of them if there are fewer.

    ``keep`` says which rows of a table with doc_id may be learnt from. Rows are taken
    by a hash of their id: reruns take the same ones, and no text is moved to pick them.
    Labels other than 0 and 1 are left out; an id that has both counts as 1.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & keep)
        .groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    )
    share = rows / max(1, known.count())
    wide = 1 << 30
    taken = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id").cast("long")), F.lit(wide)) < int(min(1.0, share) * wide)
    return docs.select("doc_id", "text").where(keep & taken).join(known.where(taken), "doc_id").select("text", "y")


def trained(sample: DataFrame, train, schema: str) -> list:
    """Run ``train`` over the sample, whose size is bounded, in one task of an executor.

    The rows that it gives are the model; they come to the driver, as their number is
    bounded by the model's own size and not by the data.
    """
    return sample.repartition(1).sortWithinPartitions(F.xxhash64("text"), "text", "y").mapInArrow(train, schema).collect()
