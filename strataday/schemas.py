"""Table layouts and the fixed vocabulary the pipelines share."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. They must match the published study files, so they are kept
# here as plain text in their natural order.
# ---------------------------------------------------------------------------

# source column -> diagnosis column, in source order (drives episode numbering)
OUTCOME_SOURCES = {
    "resp_prim": "respiratory_dx",
    "asthma_prim": "asthma_dx",
    "copd_prim": "copd_dx",
    "pneu_prim": "pneumonia_dx",
    "bron_prim": "bronchitis_dx",
    "cardio_prim": "cardiovascular_dx",
    "cardiac_prim": "cardiacarrest_dx",
    "arrythmia_prim": "arrythmia_dx",
    "heartfail_prim": "heartfailure_dx",
    "ischemic_prim": "ischemic_dx",
    "mi_prim": "myocardial_dx",
    "cerebro_prim": "cerebrovascular_dx",
}

# display order of the diagnoses in tables and facets
FACET_ORDER = [
    "respiratory_dx", "asthma_dx", "bronchitis_dx", "copd_dx", "pneumonia_dx",
    "cardiovascular_dx", "arrythmia_dx", "cardiacarrest_dx",
    "cerebrovascular_dx", "heartfailure_dx", "ischemic_dx", "myocardial_dx",
]

# order of the per-diagnosis output tables
OUTPUT_ORDER = [
    "asthma", "bronchitis", "copd", "pneumonia", "respiratory", "arrythmia",
    "cardiacarrest", "cerebrovascular", "heartfailure", "ischemic",
    "myocardial", "cardiovascular",
]

# flags of the multi-flag study variant, and flag -> output label
MULTI_FLAGS = [
    "asthma", "copd", "pneumonia", "bronchitis", "respiratory", "arrythmia",
    "cerebrovascular", "heartfailure", "ischemic", "myocardial",
    "cardiovascular", "heatillness", "forearmfracture", "cardiorespiratory",
]
MULTI_FLAG_LABELS = {
    "asthma": "asthma",
    "copd": "copd",
    "pneumonia": "pneumonia",
    "bronchitis": "bronchitis",
    "respiratory": "respiratory",
    "arrythmia": "arrhythmia",
    "cerebrovascular": "cerebrovascular",
    "ischemic": "ischemic",
    "myocardial": "myocardial",
    "heartfailure": "heartfailure",
    "cardiovascular": "cardiovascular",
    "cardiorespiratory": "cardiorespiratory",
}

# county code within the state -> county name
COUNTY_FIPS = {
    1: "Bernalillo",
    3: "Catron",
    5: "Chaves",
    6: "Cibola",
    7: "Colfax",
    9: "Curry",
    11: "De Baca",
    13: "Doña Ana",
    15: "Eddy",
    17: "Grant",
    19: "Guadalupe",
    21: "Harding",
    23: "Hidalgo",
    25: "Lea",
    27: "Lincoln",
    28: "Los Alamos",
    29: "Luna",
    31: "McKinley",
    33: "Mora",
    35: "Otero",
    37: "Quay",
    39: "Rio Arriba",
    41: "Roosevelt",
    43: "Sandoval",
    45: "San Juan",
    47: "San Miguel",
    49: "Santa Fe",
    51: "Sierra",
    53: "Socorro",
    55: "Taos",
    57: "Torrance",
    59: "Union",
    61: "Valencia",
}
STATE_FIPS = 35

# spellings seen in the inputs -> canonical county name
COUNTY_ALIASES = {"Dona Ana": "Doña Ana", "Bernilillo": "Bernalillo"}
# the older variant folds the other way
COUNTY_ASCII = {"Doña Ana": "Dona Ana"}

# column names, in order, a daily polygon file must have
POLYGON_COLUMNS = ["Satellite", "Start", "End", "Density", "geometry"]

PM25_PARAMETER = "88101"
PM25_STANDARD = "PM25 Annual 2012"
PALETTE_DOMAIN = (-3.0, 67.0)
FRAME_FIRST_DAY = dt.date(2022, 4, 6)
FRAME_LAST_DAY = dt.date(2022, 8, 21)
FRAME_FIRST_NUMBER = 96

FIRE_APR_SEP = (4, 5, 6, 7, 8, 9)
FIRE_APR_AUG = (4, 5, 6, 7, 8)
OFF_SEASON = (1, 2, 3, 10, 11, 12)
STUDY_START = dt.date(2016, 1, 1)  # exclusive
REFERENT_WEEKS = 26
LAG_DAYS = 5

# ---------------------------------------------------------------------------
# Derived vocabulary
# ---------------------------------------------------------------------------

OUTCOMES = list(OUTCOME_SOURCES.values())
COUNTY_STATE_FIPS = {STATE_FIPS * 1000 + code: name for code, name in COUNTY_FIPS.items()}
EXPOSURES = ["smokepm25", "totalpm25", "HeatIndex"]


def output_name(outcome_column: str) -> str:
    """``asthma_dx`` -> ``asthma``."""
    return outcome_column.removesuffix("_dx")


ADMISSION_TYPES: dict[str, T.DataType] = {
    "Admission_Date": T.StringType(),
    "Patient_Resi_County_FIPS_Cd": T.IntegerType(),
    **{name: T.IntegerType() for name in OUTCOME_SOURCES},
}

SMOKE_PM_TYPES: dict[str, T.DataType] = {
    "Date": T.StringType(),
    "County": T.StringType(),
    "smokepm25": T.DoubleType(),
    "totalpm25": T.DoubleType(),
}

MONITOR_SCHEMA = T.StructType([
    T.StructField("parameter_code", T.StringType()),
    T.StructField("state_code", T.IntegerType()),
    T.StructField("county_code", T.StringType()),
    T.StructField("site_number", T.StringType()),
    T.StructField("pollutant_standard", T.StringType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("date_local", T.StringType()),
    T.StructField("arithmetic_mean", T.DoubleType()),
])

POLYGON_GEOMETRY = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("coordinates", T.StringType()),
])
POLYGON_RINGS = T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))

POLYGON_SCHEMA = T.StructType([
    T.StructField("Satellite", T.StringType()),
    T.StructField("Start", T.StringType()),
    T.StructField("End", T.StringType()),
    T.StructField("Density", T.StringType()),
    T.StructField("geometry", POLYGON_GEOMETRY),
])
