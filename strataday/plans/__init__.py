"""Pipelines put together from the operators."""

from .admissions import annual_summary, clean_admissions, facet_series, yearly_scatter
from .casecross import (
    attach_exposure, case_crossover_from_cases, case_crossover_tables, crossed_episodes,
    full_dataset, outcome_dataset, outcome_tables, strata_tables, tables_by_outcome,
)
from .episodes import (
    build_episodes, case_cells, explode_outcomes, number_episodes, patient_id, widen_episodes,
)
from .exposure import clean_heat, clean_smoke, exposure_panel
from .frames import (
    attach_layer, daily_counts, date_spine, frame_layers, frame_manifest, standardise_monitors,
)
from .referents import add_referents, case_crossover, cross_cases, has_referent, study_cases
from .study import run_case_crossover, run_flagged_study, run_frames

__all__ = [
    "add_referents", "annual_summary", "attach_exposure", "attach_layer", "build_episodes",
    "case_cells", "case_crossover", "case_crossover_from_cases", "case_crossover_tables",
    "clean_admissions", "clean_heat", "clean_smoke", "cross_cases", "crossed_episodes",
    "daily_counts", "date_spine", "explode_outcomes", "exposure_panel", "facet_series",
    "frame_layers", "frame_manifest", "full_dataset", "has_referent", "number_episodes",
    "outcome_dataset", "outcome_tables", "patient_id", "run_case_crossover", "run_flagged_study", "run_frames", "standardise_monitors",
    "strata_tables", "study_cases", "tables_by_outcome", "widen_episodes",
    "yearly_scatter",
]
