"""Column names, types and fixed values shared by all grains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# A simulation number can repeat across scenarios, so it is never a key alone.
FLOCK = ["scenario", "simu_id"]

LAST_DAY = 42
GROWTH_FACTORS = ["low", "middle", "high"]

_INT, _LONG, _DOUBLE, _STRING = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType()

# One row per simulation and day, as written by the simulation runs.
COUNTS_SCHEMA = T.StructType(
    [T.StructField("simu_id", _LONG), T.StructField("step", _INT)]
    + [T.StructField("level", _STRING), T.StructField("agent_id", _INT)]
    + [
        T.StructField(n, _LONG)
        for n in ("NG", "NGi", "NGr", "RGi", "RGb", "B", "RL", "I0", "I", "RS", "P", "De")
    ]
    + [
        T.StructField(n, _INT)
        for n in (
            "introduction_time", "early_slaughter", "time_before_reduced_growth",
            "duration_reduced_growth", "t_until_bact_inf", "length_B",
        )
    ]
    + [
        T.StructField(n, _DOUBLE)
        for n in (
            "vaccination_scenario", "beta", "recovery", "prop_clinical",
            "treatment_trigger", "prop_bact_factor", "mortality_I", "mortality_B",
        )
    ]
    + [
        T.StructField(n, _INT)
        for n in (
            "treatment_allowed", "treatment_triggered", "not_yet_treated",
            "thinning_time", "slaughter_time",
        )
    ]
    + [
        T.StructField(n, _LONG)
        for n in ("previous_flock_size", "cum_I", "cum_B", "cum_thinning", "cum_mort")
    ]
    + [
        T.StructField(n, _DOUBLE)
        for n in (
            "percentage_mortality", "percentage_prevalence",
            "percentage_prevalence_secondary", "percentage_prevalence_recovered_lesions",
            "percentage_total_resp_signs", "percentage_daily_mortality",
        )
    ]
)

# Columns that hold one value for a whole scenario.
SCENARIO_INPUTS = [
    "vaccination_scenario", "introduction_time", "early_slaughter", "beta", "recovery",
    "t_until_bact_inf", "prop_bact_factor", "duration_reduced_growth", "length_B",
    "mortality_I", "mortality_B", "treatment_trigger",
]

# Columns of the counts table that the daily step cannot do without.
REQUIRED_COUNTS = [
    "simu_id", "step", "level", "agent_id", "De", "NG", "NGi", "NGr", "RGi", "RGb", "B",
    "RL", "P", "cum_thinning", "percentage_mortality", "percentage_total_resp_signs",
    "not_yet_treated", "thinning_time",
]


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    """Names that ``required`` lists and the frame lacks."""
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def drop_existing(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns; a name that is not there is an error, as Spark alone would ignore it."""
    return require_columns(df, list(names)).drop(*names)
