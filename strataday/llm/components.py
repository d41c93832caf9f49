"""Connected components of an edge table by alternating small-star and large-star steps.

Every step is an aggregate and a join on the edge's end; nothing is gathered per vertex, so
a vertex with very many edges is combined before the shuffle and split after it. Before the first round each batch of
edges is replaced by a star for each of the trees that it makes. Each
round is written, so that lost executors cost at most one round, and has partitions for the edges that
are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import sized, written


def _lowest(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the smallest vertex among u and its neighbours."""
    lowest = edges.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("w"), F.least("u", "m").alias("m")
    )
    return edges.join(lowest, F.col("u") == F.col("w")).drop("w")


def _star_round(edges: DataFrame) -> DataFrame:
    # Small star: every edge points from the larger vertex u to the smaller v already.
    found = _lowest(edges)
    small = found.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        found.select("u", F.col("m").alias("v"))
    ).where("u <> v")
    # Large star; after the small one it also moves what hangs on a vertex that has just been given a lower one.
    both = small.unionByName(small.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _lowest(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return large.where("u <> v").distinct()


def _counted(edges: DataFrame, label: str) -> tuple[DataFrame, tuple]:
    """The edges, written, and their number and sum of hashes, observed while they are written."""
    seen = Observation()
    out = written(edges.observe(
        seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")
    ), label)
    return out, (seen.get["n"], seen.get["sum"])


def _batch_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each batch of edges the stars (u, v) of its components: v is the smallest vertex."""
    for batch in batches:
        vertex, at = np.unique(np.concatenate([np.asarray(batch.column(c)) for c in ("u", "v")]), return_inverse=True)
        u, v = at[: len(batch)], at[len(batch) :]
        lowest = np.arange(len(vertex))
        while True:
            both = np.minimum(lowest[u], lowest[v])
            now = lowest.copy()
            # The roots of both ends and the ends themselves take the lower root, then all roots are followed.
            for end in (lowest[u], lowest[v], u, v):
                np.minimum.at(now, end, both)
            now = now[now]
            if (now == lowest).all():
                break
            lowest = now
        other = np.flatnonzero(lowest != np.arange(len(vertex)))
        yield pa.RecordBatch.from_arrays([pa.array(vertex[other]), pa.array(vertex[lowest[other]])], ["u", "v"])


def stars(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(u, v) of every vertex u that isn't the smallest of its component; v is the smallest."""
    ends = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v")
    now, before = _counted(ends.mapInArrow(_batch_stars, "u long, v long"), "edges")
    while True:
        with sized(edges.sparkSession, 2 * before[0]):
            now, after = _counted(_star_round(now), "stars")
        if after == before:
            return now
        before = after


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component) of every vertex with an edge; the component is its smallest vertex."""
    found = stars(edges, a, b).select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("vertex"), "component").distinct())
