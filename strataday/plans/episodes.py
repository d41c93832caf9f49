"""From county-day counts to identified episodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import month_text, named, paste, slice_text, year_text
from ..operators import block_by_rank, checked_count, flags_wide, running_base, uncount
from ..operators.reshape import PIECE
from ..schemas import OUTCOMES


def case_cells(
    admissions: DataFrame, outcomes: Sequence[str] = OUTCOMES, date: str = "Date",
    county: str = "County", file_order: str | None = None,
) -> DataFrame:
    """County-day counts, their total and the number of episodes that come before.

    Episodes are numbered by date, county, outcome and replicate over the
    whole table, before any filter. Rows of one county-day are interchangeable in that order,
    so adding them up first keeps the numbers and leaves little to shuffle.

    With ``file_order``, a column holding the row's position in its file, they are numbered by
    that position, outcome and replicate instead, and source rows stay apart. Positions are
    whole numbers of any spacing and must be unique; they are cut into blocks of about equally many rows.
    """
    extra = [file_order] if file_order else []
    counted = admissions.select(
        date, county, *extra, *[checked_count(c).alias(c) for c in outcomes]
    )
    total: Column = F.lit(0).cast("long")
    for c in outcomes:
        total = total + F.col(c)
    if file_order:
        rows = counted.withColumns({"total": total, "__part": block_by_rank(admissions, file_order)})
        return running_base(rows, "total", "__part", [file_order], check=True).drop("__part")
    cells = counted.groupBy(date, county).agg(*[F.sum(c).alias(c) for c in outcomes])
    return running_base(
        cells.withColumn("total", total), "total", date, [county],
        source=counted.select(date, total.alias("total")),
    )


def outcome_entries(
    outcomes: Sequence[str] = OUTCOMES, only: Sequence[str] | None = None, base: str = "id_base"
) -> Column:
    """Array with an entry per outcome: position in ``outcomes``, count, IDs before the first."""
    entries: list[Column] = []
    running = F.col(base)
    for i, c in enumerate(outcomes, start=1):
        if only is None or c in only:
            entries.append(
                F.struct(F.lit(i).alias("ord"), F.col(c).alias("n"), running.alias("first"))
            )
        running = running + F.col(c)
    return F.array(*entries)


def explode_outcomes(
    cells: DataFrame, outcomes: Sequence[str] = OUTCOMES, entries: str | None = None
) -> DataFrame:
    """One row per outcome that occurs in a cell.

    Gives ``Primary_dx``, its position ``dx_ord``, its count ``n`` and ``first_id``,
    the number of IDs before its first. ``entries`` names a column already
    holding :func:`outcome_entries`.
    """
    # the outer form only spares a ready-made array an inferred size filter, which would
    # build it twice; an empty one still gives no row
    exploded = F.explode_outer(entries) if entries else F.explode(outcome_entries(outcomes))
    dropped = (*outcomes, "id_base", "total", entries)
    others = [named(c) for c in cells.columns if c not in dropped]
    names = F.array(*[F.lit(c) for c in outcomes])
    return cells.select(*others, exploded.alias("__o")).where(F.col("__o.n") > 0).select(
        *others,
        F.element_at(names, F.col("__o.ord")).alias("Primary_dx"),
        F.col("__o.ord").alias("dx_ord"),
        F.col("__o.n").alias("n"),
        F.col("__o.first").alias("first_id"),
    )


def patient_id(outcome: str = "Primary_dx", number: Column | str = "ID") -> Column:
    """``resp 17``: four letters of the outcome and the episode number."""
    return paste(slice_text(outcome, 1, 4), number)


def with_ids(copies: DataFrame) -> DataFrame:
    """Replicates of outcome rows with their ``Patient_ID``."""
    kept = [named(c) for c in copies.columns if c not in ("first_id", "replicate")]
    return copies.select(*kept, patient_id(number=F.col("first_id") + F.col("replicate") + 1).alias("Patient_ID"))


def number_episodes(rows: DataFrame, size: int = PIECE) -> DataFrame:
    """Replicate each outcome row by its count ``n`` and give every copy its ``Patient_ID``."""
    return with_ids(uncount(rows, "n", "replicate", size))


def build_episodes(
    admissions: DataFrame, outcomes: Sequence[str] = OUTCOMES, size: int = PIECE,
    file_order: str | None = None,
) -> DataFrame:
    """One row per admission episode: Date, County, Primary_dx, Episode, Patient_ID."""
    rows = explode_outcomes(case_cells(admissions, outcomes, file_order=file_order), outcomes)
    return number_episodes(rows, size).select(
        "Date", "County", "Primary_dx", F.lit(1).alias("Episode"), "Patient_ID"
    )


def widen_episodes(
    episodes: DataFrame, outcomes: Sequence[str] = OUTCOMES, keep_prefix: bool = False
) -> DataFrame:
    """Episode rows with one 0/1 column per outcome, and the year and month as text."""
    base = episodes
    extra: list[str] = []
    if keep_prefix:
        base = base.withColumn("Prim_dx", slice_text("Primary_dx", 1, 4))
        extra = ["Prim_dx"]
    wide = flags_wide(base, "Primary_dx", outcomes, F.col("Episode"))
    return wide.select(
        "Date", year_text("Date").alias("Year"), month_text("Date").alias("Month"), "County",
        "Patient_ID", *extra, *outcomes,
    )
