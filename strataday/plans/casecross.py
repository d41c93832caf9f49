"""The case-crossover analysis tables.

Three routes give the same rows:

* step by step on episode rows (:func:`attach_exposure`, :func:`strata_tables`),
  for tables that already hold cases and referents;
* from counts (:func:`full_dataset`, :func:`case_crossover_tables`). All episodes of
  a county-day share their referent dates and exposures, so referents and the
  exposure join are worked out once per county-day and the episodes are
  multiplied out last. The join moves at most 2 * weeks + 1 rows per
  county-day however many episodes there are, no shuffle of episodes follows
  it, and no key of it can be hot;
* from episode rows (:func:`case_crossover_from_cases`), where each case is joined to
  the finished dates and exposures of its place and day, so that cases are
  shuffled once each and not once per referent.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import in_study, month_text, named, year_text, zero_if_null
from ..operators import (
    informative_strata, left_join, outcome_table, pieces_of, replicate, require_unique, spread,
)
from ..operators.reshape import PIECE
from ..schemas import (
    FIRE_APR_SEP, OUTCOMES, OUTPUT_ORDER, REFERENT_WEEKS, STUDY_START, output_name,
)
from .episodes import case_cells, explode_outcomes, outcome_entries, with_ids
from .referents import add_referents, has_referent


def attach_exposure(
    rows: DataFrame, panel: DataFrame, keys: Sequence[str] = ("Date", "County"),
    on_dup: str = "keep",
) -> DataFrame:
    """Exposures of the row's own date and place, NULL where the panel has none."""
    return left_join(rows, panel, keys, on_dup)


def strata_tables(
    full: DataFrame, flags: Sequence[str] | Mapping[str, str] = OUTCOMES, id_col: str = "Patient_ID"
) -> DataFrame:
    """Informative strata of every outcome, as one long table."""
    labels = flags if isinstance(flags, Mapping) else {c: output_name(c) for c in flags}
    return informative_strata(full, labels, id_col)


def crossed_episodes(
    admissions: DataFrame, panel: DataFrame | None, outcomes: Sequence[str] = OUTCOMES,
    weeks: int = REFERENT_WEEKS, months: Iterable[int] = FIRE_APR_SEP,
    start: dt.date | None = STUDY_START, only: Sequence[str] | None = None,
    only_informative: bool = False, size: int = PIECE, file_order: str | None = None,
) -> DataFrame:
    """Every in-study episode on its case date and all its referent dates.

    ``index`` is the offset in weeks, 0 on the case date; ``dx_ord`` is the outcome's position
    in ``outcomes``. ``only`` keeps some outcomes, with the IDs they have among all. Without a
    ``panel`` there are no exposures, and nothing is joined.
    County-days are cut into pieces of at most ``size`` episodes, most into one, and the pieces are
    spread before they meet their dates, so that a county-day holding a
    large part of all episodes is not written out by one task per date. In file order source
    rows stay apart, so they are joined to the finished dates of their county-day.
    """
    months = tuple(months)
    counted = F.col("total") if only is None else reduce(add, [F.col(c) for c in only])
    wanted = in_study("Date", months, start) & (counted > 0)
    if only_informative:
        wanted = wanted & has_referent("Date", weeks, months, start)
    cells = case_cells(admissions, outcomes, file_order=file_order).where(wanted).select(
        "Date", year_text("Date").alias("Year"), month_text("Date").alias("Month"), "County",
        "total",
        # only the outcomes that occur travel along
        F.filter(outcome_entries(outcomes, only), lambda o: o["n"] > 0).alias("occurring"),
    )
    cells = _cut_cells(cells, size)
    # the first ID tells pieces apart, also those of source rows of one county-day
    cells = spread(cells, "Date", "County", F.col("occurring")[0]["first"])
    if file_order:
        days = place_days(cells, panel, ("Date", "County"), {}, weeks, months, start)
        placed = left_join(
            cells.withColumnRenamed("Date", "__case_date"), days, ("__case_date", "County")
        )
        exposed = placed.withColumn("__day", F.explode("__days")).select(
            "Year", "Month", "County", "occurring", "__day.*"
        )
    else:
        crossed = add_referents(cells, weeks, months, start, include_case=True)
        exposed = crossed if panel is None else left_join(crossed, panel, ("Date", "County"))
    return with_ids(replicate(explode_outcomes(exposed, outcomes, "occurring"), "n", "replicate"))


def _cut_cells(cells: DataFrame, size: int) -> DataFrame:
    """Cells of at most ``size`` episodes, each with those outcomes, counts and first IDs that fall to it."""
    begin = F.col("occurring")[0]["first"]

    def part(o: Column) -> Column:
        first = F.greatest(o["first"], F.col("__begin"))
        end = F.least(o["first"] + o["n"], F.col("__begin") + size)
        return F.struct(o["ord"].alias("ord"), (end - first).alias("n"), first.alias("first"))

    last = F.element_at("occurring", -1)
    # IDs of outcomes that were not asked for may lie between, and a piece may have no others
    span = last["first"] + last["n"] - begin
    pieces = cells.withColumn("__piece", F.explode(pieces_of(span, size))).withColumn("__begin", begin + F.col("__piece") * size)
    return pieces.withColumn(
        "occurring", F.filter(F.transform("occurring", part), lambda o: o["n"] > 0)
    ).where(F.size("occurring") > 0).drop("__piece", "__begin", "total")


def _exposures(panel: DataFrame | None) -> list[Column]:
    return [] if panel is None else [named(c) for c in panel.columns if c not in ("Date", "County")]


def full_dataset(
    admissions: DataFrame, panel: DataFrame | None, outcomes: Sequence[str] = OUTCOMES, **options
) -> DataFrame:
    """Cases and referents with 0/1 outcome flags and exposures, one row per episode and date.

    Without a ``panel``, the union of cases and referents alone, from one pass at the grain of county-days.
    """
    rows = crossed_episodes(admissions, panel, outcomes, **options)
    is_case = F.col("index") == 0
    flags = [
        (is_case & (F.col("dx_ord") == i)).cast("int").alias(c)
        for i, c in enumerate(outcomes, start=1)
    ]
    return rows.select("Date", "Year", "Month", "County", "Patient_ID", *flags, *_exposures(panel))


def case_crossover_tables(
    admissions: DataFrame, panel: DataFrame, outcomes: Sequence[str] = OUTCOMES, **options
) -> DataFrame:
    """The analysis tables of all outcomes as one long table.

    An episode built from counts has exactly one outcome, so its stratum is
    informative exactly when it has a referent. That is known per county-day,
    before anything is multiplied out.
    """
    rows = crossed_episodes(admissions, panel, outcomes, only_informative=True, **options)
    labels = F.array(*[F.lit(output_name(c)) for c in outcomes])
    return rows.select(
        "Date", "Year", "Month", "County", "Patient_ID",
        (F.col("index") == 0).cast("int").alias("outcome"), *_exposures(panel),
        F.element_at(labels, F.col("dx_ord")).alias("out_name"),
    )


def outcome_tables(
    admissions: DataFrame, panel: DataFrame, outcomes: Sequence[str] = OUTCOMES, **options
) -> DataFrame:
    """The analysis tables of all outcomes with all flags, as one long table from one expansion.

    Beside the 0/1 flags each row has the ``outcome`` of its own diagnosis, named in ``out_name``;
    :func:`tables_by_outcome` gives each table its layout, with the own flag as ``outcome`` in place.
    """
    rows = crossed_episodes(admissions, panel, outcomes, only_informative=True, **options)
    is_case = F.col("index") == 0
    labels = F.array(*[F.lit(output_name(c)) for c in outcomes])
    return rows.select(
        "Date", "Year", "Month", "County", "Patient_ID",
        *[(is_case & (F.col("dx_ord") == i)).cast("int").alias(c) for i, c in enumerate(outcomes, start=1)],
        *_exposures(panel), is_case.cast("int").alias("outcome"),
        F.element_at(labels, F.col("dx_ord")).alias("out_name"),
    )


def outcome_dataset(
    admissions: DataFrame, panel: DataFrame, outcome: str, outcomes: Sequence[str] = OUTCOMES,
    **options,
) -> DataFrame:
    """The analysis table of one outcome, its own flag renamed ``outcome`` in place."""
    rows = full_dataset(
        admissions, panel, outcomes, only=[outcome], only_informative=True, **options
    )
    return rows.withColumnRenamed(outcome, "outcome").withColumn(
        "out_name", F.lit(output_name(outcome))
    )


def place_days(
    cases: DataFrame, panel: DataFrame | None, keys: Sequence[str], derived: Mapping[str, Column],
    weeks: int, months: Iterable[int], start: dt.date | None, date: str = "Date",
) -> DataFrame:
    """Per place and case date an array of its dates and their exposures.

    ``keys`` are the panel's join keys; those in ``derived`` are computed from the shifted
    date, the others (besides the date) say where the case is. An array has at
    most ``2 * weeks + 1`` entries as long as the panel has one row per key.
    """
    place = [k for k in keys if k != date and k not in derived]
    starts = cases.select(*place, date).distinct().withColumn("__case_date", F.col(date))
    crossed = add_referents(starts, weeks, months, start, date, include_case=True)
    exposed = crossed.withColumns(dict(derived))
    if panel is not None:
        exposed = left_join(exposed, require_unique(panel, keys), keys)
    entry = [c for c in exposed.columns if c not in (*place, "__case_date")]
    return exposed.groupBy(*place, "__case_date").agg(
        F.collect_list(F.struct(*[named(c) for c in entry])).alias("__days")
    )


def case_crossover_from_cases(
    cases: DataFrame, panel: DataFrame, flags: Sequence[str], labels: Mapping[str, str],
    id_col: str = "Patient_ID", keys: Sequence[str] = ("Date", "County"),
    derived: Mapping[str, Column] | None = None, weeks: int = REFERENT_WEEKS,
    months: Iterable[int] = FIRE_APR_SEP, start: dt.date | None = STUDY_START, date: str = "Date",
    unique_ids: bool = False,
) -> DataFrame:
    """Informative strata of episode rows that may carry several flags.

    A referent's flags are all 0, so a stratum takes both values of a flag exactly when
    a case of its ID has it, and some case lacks it or has a referent. That is
    an aggregate over the cases alone; referents are only multiplied out for
    the strata that stay. ``unique_ids`` states that every ID has one case, which then
    decides on its own, without the aggregate and its join.

    ``keys`` are the panel's join keys, of which ``derived`` ones are computed from
    the shifted date.
    """
    months, derived = tuple(months), derived or {}
    in_scope = cases.where(in_study(date, months, start))
    paired = has_referent(date, weeks, months, start)
    if unique_ids:
        # stated on the stored flags: the same test on the filled ones would give the
        # optimizer one constraint with an alias per flag, and 2^flags ways to write it
        any_flag = reduce(or_, [F.col(c) == 1 for c in labels])
        found = [F.when(F.col(c) == 1, F.lit(c)) for c in labels]
        kept = in_scope.where(any_flag & paired).select(
            "*", F.array_compact(F.array(*found)).alias("__flags")
        )
    else:
        filled = {c: zero_if_null(c) for c in labels}
        found = [
            F.when((F.max(v) == 1) & ((F.min(v) == 0) | F.max("__paired")), F.lit(c))
            for c, v in filled.items()
        ]
        strata = (
            in_scope.withColumn("__paired", paired)
            .groupBy(F.col(id_col).alias("__id"))
            .agg(F.array_compact(F.array(*found)).alias("__flags"))
            .where(F.size("__flags") > 0)
        )
        kept = in_scope.join(strata, F.col(id_col).eqNullSafe(F.col("__id")), "inner").drop("__id")
    days = place_days(in_scope, panel, keys, derived, weeks, months, start, date)
    place = [k for k in keys if k != date and k not in derived]
    rows = (
        left_join(
            kept.withColumnRenamed(date, "__case_date"), days, ("__case_date", *place)
        )
        .withColumn("__day", F.explode("__days"))
        .withColumn("__flag", F.explode_outer("__flags"))
    )
    is_case = F.col("__day.index") == 0
    own = {c: F.when(is_case, zero_if_null(c)).otherwise(0) for c in flags}
    carried = [
        F.col("__day")[date].alias(date) if c == date else own[c].alias(c) if c in own else named(c)
        for c in cases.columns
    ]
    added = [c for c in panel.columns if c not in cases.columns]
    outcome = F.coalesce(*[F.when(F.col("__flag") == c, own[c]) for c in labels])
    label = F.coalesce(*[F.when(F.col("__flag") == c, F.lit(n)) for c, n in labels.items()])
    return rows.select(
        *carried, *[F.col("__day")[c].alias(c) for c in added],
        outcome.alias("outcome"), label.alias("out_name"),
    )


def tables_by_outcome(
    strata: DataFrame, labels: Mapping[str, str] | None = None
) -> dict[str, DataFrame]:
    """The long table of :func:`strata_tables` as one lazy DataFrame per diagnosis."""
    if labels is None:
        labels = {f"{name}_dx": name for name in OUTPUT_ORDER}
    return {label: outcome_table(strata, flag, label) for flag, label in labels.items()}
