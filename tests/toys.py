"""Few-row frames with every column that the daily step needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from broodspark.operators import production
from broodspark.schema import COUNTS_SCHEMA

DEFAULTS = {
    "simu_id": 1, "step": 0, "level": "population", "agent_id": 0, "NG": 100, "NGi": 0,
    "NGr": 0, "RGi": 0, "RGb": 0, "B": 0, "RL": 0, "I0": 0, "I": 0, "RS": 0, "P": 100, "De": 0,
    "introduction_time": 14, "early_slaughter": 0, "time_before_reduced_growth": 2,
    "duration_reduced_growth": 8, "t_until_bact_inf": 5, "length_B": 14,
    "vaccination_scenario": 0.0, "beta": 0.78, "recovery": 1 / 12, "prop_clinical": 0.9,
    "treatment_trigger": 0.002, "prop_bact_factor": 1.0, "mortality_I": 0.001,
    "mortality_B": 0.03, "treatment_allowed": 1, "treatment_triggered": 0, "not_yet_treated": 1,
    "thinning_time": 34, "slaughter_time": 42, "previous_flock_size": 100, "cum_I": 0,
    "cum_B": 0, "cum_thinning": 0, "cum_mort": 0, "percentage_mortality": 0.0,
    "percentage_prevalence": 0.0, "percentage_prevalence_secondary": 0.0,
    "percentage_prevalence_recovered_lesions": 0.0, "percentage_total_resp_signs": 0.0,
    "percentage_daily_mortality": 0.0,
}


def counts(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Counts rows; each dict overrides the defaults, ``scenario`` is '1' unless given."""
    unknown = {key for row in rows for key in row} - set(DEFAULTS) - {"scenario"}
    assert not unknown, unknown
    names = [field.name for field in COUNTS_SCHEMA.fields]
    values = [
        [row.get("scenario", "1"), *[(DEFAULTS | row)[name] for name in names]] for row in rows
    ]
    schema = "scenario string, " + ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in COUNTS_SCHEMA.fields
    )
    return spark.createDataFrame(values, schema)


def flock(days: int, scenario: str = "1", simu_id: int = 1, **columns) -> list[dict]:
    """Rows of one flock for days 0 to ``days - 1``; a callable column gets the day."""
    return [
        {"scenario": scenario, "simu_id": simu_id, "step": day}
        | {name: value(day) if callable(value) else value for name, value in columns.items()}
        for day in range(days)
    ]


def production_table(spark: SparkSession, days: int = 43, gain: float = 50, feed: float = 80):
    healthy = spark.range(days).selectExpr(
        "CAST(id AS INT) AS day", f"{gain}D AS healthy_DG", f"{feed}D AS healthy_intake"
    )
    return production.production_table(healthy)
