"""Scenario grids, one-at-a-time grids and the parameters derived from them."""

from __future__ import annotations

from math import prod

from pyspark.sql import DataFrame, SparkSession

from broodspark.functions.frames import derive, rederive
from broodspark.functions.small import literal_table

# The factorial scenario grid, in nesting order.
SCENARIO_LISTS = {
    "vaccination_scenario": [0.0, 0.5, 1.0],
    "introduction_time": [7, 14, 21, 28],
    "prop_bact_factor": [0.5, 1.0, 2.0],
    "early_slaughter": [0, 1],
}

# The default scenario and the one-at-a-time variations around it.
DEFAULT_SCENARIO = {
    "vaccination_scenario": 0.0,
    "introduction_time": 14,
    "prop_bact_factor": 1.0,
    "early_slaughter": 0,
}
VARIATIONS = {
    "beta_factor": [0.5, 2.0],
    "recovery_factor": [0.5, 2.0],
    "prop_clinical_base": [0.8, 0.95],
    "mortality_I": [0.000725, 0.001885],
    "mortality_B": [0.0142, 0.0571],
    "time_before_reduced_growth": [1.0, 4.0],
    "duration_reduced_growth": [4.0, 16.0],
    "t_until_bact_inf": [3.0, 10.0],
    "length_B": [7.0, 28.0],
}

# Disease parameters by vaccination scenario.
BETA = {0.0: 0.78, 0.5: 0.48, 1.0: 0.17}
INFECTIOUS_DAYS = {0.0: 12.0, 0.5: 12.0, 1.0: 3.5}
PROP_CLINICAL_BASE = 0.9
PROP_CLINICAL_DROP = {0.5: 0.1}
PROP_BACT_I0 = 0.02
PROP_BACT_I = 0.15
NORMAL_MORTALITY = 0.000725
MORTALITY_I_RATIO = 1.3
MORTALITY_B = (0.40, 14)

# Days spent in a state.
DURATIONS = {
    "time_before_reduced_growth": 2,
    "duration_reduced_growth": 8,
    "t_until_bact_inf": 5,
    "length_B": 14,
}
TIME_BEFORE_RESP_SIGNS = 1
DURATION_RESP_SIGNS = 7


def scenario_grid(spark: SparkSession, lists: dict[str, list] | None = None) -> DataFrame:
    """Every combination of the listed values; ``folder`` counts from 1 in nesting order.

    Row ``i`` reads its values off the mixed-radix digits of ``i``: the grid is generated
    in parallel, without joins and without numbering through a single task.
    """
    lists = lists or SCENARIO_LISTS
    columns, block = [], prod(len(v) for v in lists.values())
    size = block
    for name, values in lists.items():
        block //= len(values)
        options = ", ".join(f"{v}D" if isinstance(v, float) else str(v) for v in values)
        columns.append(f"array({options})[CAST(id DIV {block} % {len(values)} AS INT)] AS {name}")
    return spark.range(size).selectExpr("CAST(id + 1 AS INT) AS folder", *columns)


def oat_grid(
    spark: SparkSession,
    variations: dict[str, list[float]] | None = None,
    defaults: dict[str, float] | None = None,
) -> DataFrame:
    """One row per changed value around the defaults, with the name and value that vary.

    A varied column is NULL in the rows that vary another one; ``derive_parameters`` fills
    in the default there, so a grid row can be handed to it as is.
    """
    variations = VARIATIONS if variations is None else variations
    defaults = defaults or DEFAULT_SCENARIO
    rows = [
        {"folder": n, "varied_param": name, "varied_value": value}
        for n, (name, value) in enumerate(
            ((name, value) for name, values in variations.items() for value in values), start=1
        )
    ]
    table = literal_table(spark, rows, "folder int, varied_param string, varied_value double")
    fixed = {n: f"{v}D" if isinstance(v, float) else str(v) for n, v in defaults.items()}
    varied = {
        name: f"IF(varied_param = '{name}', varied_value, CAST(NULL AS DOUBLE))"
        for name in variations
    }
    return derive(table, **fixed, **varied)


def _by_vaccination(values: dict[float, float], otherwise: float) -> str:
    cases = " ".join(f"WHEN {scenario}D THEN {value}D" for scenario, value in values.items())
    return f"CASE vaccination_scenario {cases} ELSE {otherwise}D END"


def derive_parameters(grid: DataFrame, given: list[str] | None = None) -> DataFrame:
    """Disease parameters of each row from its vaccination scenario and factors.

    The columns that ``VARIATIONS`` names are optional; where one is there and not NULL, it
    overrides the default. ``given`` lists those that the grid has, if known beforehand.
    """
    given = [c for c in grid.columns if c in VARIATIONS] if given is None else given

    def default(name: str, value: str) -> str:
        return f"coalesce({name}, {value})" if name in given else value

    known = " OR ".join(f"vaccination_scenario = {v}D" for v in INFECTIOUS_DAYS)
    recovery = f"IF({known}, 1D / {_by_vaccination(INFECTIOUS_DAYS, 1.0)}, 0D)"
    clinical = default("prop_clinical_base", f"{PROP_CLINICAL_BASE}D")
    parameters = {
        "beta": f"{default('beta_factor', '1D')} * {_by_vaccination(BETA, 0.0)}",
        "recovery": f"{default('recovery_factor', '1D')} * {recovery}",
        "prop_clinical": f"{clinical} - {_by_vaccination(PROP_CLINICAL_DROP, 0.0)}",
        "prop_bact_inf_I0": f"prop_bact_factor * {PROP_BACT_I0}D",
        "prop_bact_inf_I": f"prop_bact_factor * {PROP_BACT_I}D",
        "mortality_I": default("mortality_I", f"{MORTALITY_I_RATIO}D * {NORMAL_MORTALITY}D"),
        "mortality_B": default("mortality_B", f"{MORTALITY_B[0]}D / {MORTALITY_B[1]}"),
    }
    for name, days in DURATIONS.items():
        parameters[name] = f"CAST({default(name, str(days))} AS INT)"
    return rederive(grid, **parameters) if given else derive(grid, **parameters)
