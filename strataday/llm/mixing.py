"""Mixing sources to target weights by balanced sampling with the cube method.

Each source has a share of the mix by its weight, at most ``most`` times what it holds. A
document is taken whole as often as its source's ratio says; the fraction that is left is
the probability of one more copy. The cube method settles these: three documents at a time
move their probabilities along the one direction that leaves both the sum of
probabilities (documents) and the sum of probabilities times sizes (words) unchanged, until
one of them reaches 0 or 1. Each block of a source's documents ends with at most two
open ones; these go through further rounds together, and the last two of a source are the
landing problem, settled by the outcome that is nearest in words, then in documents.

Only ids, sources, sizes and a hash of id and text are moved. Blocks hold about ``BLOCK``
documents, so a hot source is many blocks; they are dealt by that hash, so rows that
repeat an id are spread unless they repeat the text too. Draws depend on source, round and
block only: reruns agree.

Defined results: a NULL text has size 0, documents of size 0 take 0 words; NULL is a source
of its own, last in order; a source without words has target 0; rows that repeat an id are
separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import free_name, scratch_path, shuffle_parts, written

WEIGHTS = (5, 2, 1)
#: Documents in a block, about.
BLOCK = 8192
#: Rows with the same number but for so many last bits make a run.
RUN = 14
EDGE = 1e-9
_STATE = "row long, doc_id long, source string, size long, source_size long, target double, whole long, p double, rank long, blocks long, block long"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, documents, target): shares by weight, held to ``most`` times
    the source's size, the excess shared again by weight. One row a source."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    ranked = total.withColumn("n", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("n") - 1) % len(weights) + 1)
    ranked = ranked.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    # Filled in the order of cap / weight: the level is the highest that any step reaches.
    filling = W.orderBy(F.col("cap") / F.col("weight"), "n")
    everything = W.partitionBy()
    before = F.coalesce(F.sum("cap").over(filling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    behind = F.sum("weight").over(filling.rowsBetween(0, W.unboundedFollowing))
    level = (share * F.sum("source_size").over(everything) - before) / behind
    filled = ranked.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return filled.select(
        "source", "source_size", "documents",
        F.least("cap", F.col("weight") * F.col("level")).cast("double").alias("target"),
    )


def fly(p: np.ndarray, x: np.ndarray, draw: np.random.Generator, land: bool) -> np.ndarray:
    """Settle probabilities in order; at most two stay open unless ``land``."""
    p, x = p.tolist(), x.tolist()
    luck = draw.random(2 * len(p) + 2).tolist()
    turn, open_ = 0, []
    for k in range(len(p)):
        if not EDGE < p[k] < 1 - EDGE:
            p[k] = float(round(p[k]))
            continue
        open_.append(k)
        while len(open_) == 3:
            a, b, c = open_
            u = (x[c] - x[b], x[a] - x[c], x[b] - x[a])
            if not any(u):
                u = (1, -1, 0)
            up = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(open_, u) if v)
            down = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(open_, u) if v)
            step = up if luck[turn % len(luck)] * (up + down) < down else -down
            turn += 1
            for i, v in zip(open_, u):
                p[i] += step * v
                if not EDGE < p[i] < 1 - EDGE:
                    p[i] = float(round(p[i]))
            open_ = [i for i in open_ if EDGE < p[i] < 1 - EDGE]
    if land and open_:
        def miss(outcome):
            return (
                abs(sum(x[i] * (o - p[i]) for i, o in zip(open_, outcome))),
                abs(sum(o - p[i] for i, o in zip(open_, outcome))),
            )

        choices = [[(n >> k) & 1 for k in range(len(open_))] for n in range(1 << len(open_))]
        for i, o in zip(open_, min(choices, key=miss)):
            p[i] = float(o)
    return np.array(p)


def _flight(level: int):
    def run(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
        block = block.sort_by([(c, "ascending") for c in ("rank", "doc_id", "size", "row")])
        seed = zlib.crc32(repr((tuple(k.as_py() for k in key), level)).encode())
        land = bool((block["blocks"].to_numpy() == 1).all())
        p = fly(block["p"].to_numpy(), block["size"].to_numpy(), np.random.default_rng(seed), land)
        return block.set_column(block.column_names.index("p"), "p", pa.array(p))

    return run


def _round(state: DataFrame, level: int) -> DataFrame:
    """One flight over every block of every source, blocks by the counts at hand."""
    counts = state.groupBy("source").agg(F.ceil(F.count("*") / BLOCK).alias("now"))
    dealt = (
        state.join(counts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        .withColumn("blocks", F.col("now")).drop("now")
        .withColumn("block", F.pmod(F.xxhash64(F.lit(level), "doc_id", "rank"), F.col("blocks")))
    )
    flown = dealt.groupBy("source", "block").applyInArrow(_flight(level), _STATE)
    return written(flown, f"cube-{level}")


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, row: str | None = None) -> DataFrame:
    """(row, doc_id, source, size, source_size, target, copies) of every document; ``row`` names a
    column with a number of its own for each row, else the first is 0."""
    sizes = written(
        docs.select(
            (F.lit(0) if row is None else F.col(row)).cast("long").alias("row"),
            F.xxhash64(F.lit("order"), "doc_id", "text").alias("rank"),
            F.col("doc_id").cast("long"), F.col("source").cast("string"),
            F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        ), "sizes",
    )
    targets = source_targets(sizes, weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    state = (
        sizes.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("whole", F.floor(ratio + EDGE)).withColumn("p", F.greatest(ratio - F.col("whole"), F.lit(0.0)))
        .withColumn("blocks", F.lit(0).cast("long")).withColumn("block", F.lit(0).cast("long"))
        .select(*[c.split()[0] for c in _STATE.split(", ")])
    )
    settled, level = [], 0
    while True:
        state = _round(state, level)
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        settled.append(state.where(~open_))
        state, level = state.where(open_), level + 1
        if state.isEmpty():
            break
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    copies = (F.col("whole") + F.col("p")).cast("long")
    return out.select("row", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def mixing(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    return mixed(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with all its columns.

    The documents are written once with a number for each row, so that rows that share an
    id, or have none, are told apart without being brought together. They lie in buckets by
    runs of these numbers, of which a task has few; the copies of a run come to its
    bucket as one row, and no text is moved.
    """
    spark = docs.sparkSession
    # Columns of the documents may have any names.
    row, run, copies, copy, id_ = (free_name(docs, c) for c in ("_row", "_run", "_copies", "_copy", "_id"))
    name = f"numbered_{uuid.uuid4().hex}"
    (
        docs.withColumn(row, F.monotonically_increasing_id()).withColumn(run, F.shiftright(row, RUN))
        .write.format("parquet").bucketBy(shuffle_parts(spark), run)
        .option("compression", "zstd").option("path", scratch_path(spark, "numbered")).saveAsTable(name)
    )
    numbered = spark.table(name)
    taken = mixed(numbered, row=row).groupBy(F.shiftright("row", RUN).alias(id_)).agg(
        F.sort_array(F.collect_list(F.struct("row", F.col("copies").cast("int").alias("copies"))))["copies"].alias(copies)
    )
    place = F.col(row).bitwiseAND(F.lit((1 << RUN) - 1)).cast("int")
    return (
        numbered.join(taken.hint("shuffle_hash"), F.col(run) == F.col(id_))
        .withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.get(copies, place))))
        .select(*[numbered[c] for c in docs.columns])
    )
