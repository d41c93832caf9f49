"""Group statistics, group filters, first rows and distinct values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import has_both_flags, named
from .numbering import dense_rank


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One whole row per key, the first in ``order`` (NULLs last).

    An aggregate instead of a ranked window: each task keeps one row per key
    before the shuffle, so a key with very many copies costs nothing extra.
    """
    rank = [x for c in order for x in (F.col(c).isNull(), F.col(c))]
    best = F.min_by(F.struct(*[named(c) for c in df.columns]), F.struct(*rank))
    return df.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(best.alias("__row")).select(
        "__row.*"
    )


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-NULL values in order."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def rank_dates(df: DataFrame, date: str = "Date", rank: str = "rank") -> DataFrame:
    """Ordinal position of each distinct date, or of each distinct value of any other ordered type."""
    return dense_rank(df, date, rank)


def keep_groups(df: DataFrame, keys: Sequence[str], condition: Column) -> DataFrame:
    """Rows of the groups whose aggregate ``condition`` holds.

    Grouped aggregate plus semi join: the aggregate shrinks each group before
    its shuffle, and a hot group is split by the adaptive skew join, which a
    window over the group would not allow.
    """
    groups = df.groupBy(*[F.col(k).alias(f"__g_{k}") for k in keys]).agg(condition.alias("__keep"))
    match = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__g_{k}"))
        match = same if match is None else match & same
    return df.join(groups.where("__keep"), match, "left_semi")


def informative_strata(
    df: DataFrame, flags: Mapping[str, str], id_col: str = "Patient_ID"
) -> DataFrame:
    """Long table of the informative strata of every flag in one pass.

    A stratum (one id) is informative for a flag when the flag takes two values
    in it. ``flags`` maps flag column to output label. All columns stay, and
    ``outcome`` / ``out_name`` are added; a row appears once per flag its id is
    informative for.

    ``df`` is read twice, for the aggregate with the flags only. That is cheaper than one
    window over the whole rows, which has to sort and buffer them all, and an id with
    very many rows costs nothing extra.
    """
    chosen = F.filter(
        F.array(*[F.when(F.col(f"__both_{c}"), F.lit(c)) for c in flags]), lambda x: x.isNotNull()
    )
    strata = (
        df.groupBy(F.col(id_col).alias("__id"))
        .agg(*[has_both_flags(c).alias(f"__both_{c}") for c in flags])
        .select("__id", chosen.alias("__flags"))
        .where(F.size("__flags") > 0)
    )
    long = (
        df.join(strata, F.col(id_col).eqNullSafe(F.col("__id")), "inner")
        .withColumn("__flag", F.explode("__flags"))
    )
    outcome = F.coalesce(*[F.when(F.col("__flag") == c, F.col(c)) for c in flags])
    label = F.coalesce(*[F.when(F.col("__flag") == c, F.lit(n)) for c, n in flags.items()])
    return long.select(*[named(c) for c in df.columns], outcome.alias("outcome"), label.alias("out_name"))


def outcome_table(strata: DataFrame, flag: str, label: str) -> DataFrame:
    """One diagnosis from the long strata table, its own flag renamed ``outcome`` in place.

    A table without the flag's column keeps its ``outcome`` column where it is.
    """
    own = strata.where(F.col("out_name") == label)
    left_out = ("outcome", "out_name") if flag in strata.columns else ("out_name",)
    names = [c for c in strata.columns if c not in left_out]
    return own.select(
        *[F.col("outcome") if c == flag else named(c) for c in names], "out_name"
    )
