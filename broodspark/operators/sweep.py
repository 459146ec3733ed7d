"""One-at-a-time economic sensitivity as a join with a parameter table."""

from __future__ import annotations

from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broodspark.functions.frames import derive
from broodspark.functions.small import SMALL_ROWS, literal_table
from broodspark.operators import daily as daily_ops
from broodspark.operators import grids
from broodspark.operators import outcomes as outcome_ops
from broodspark.operators import summary as summary_ops
from broodspark.operators.outcomes import Economics
from broodspark.session import shared_dir

# The variations of the economic parameters, in the order they are run.
ECONOMIC_VARIATIONS = {
    "condemnation_B": [0.50],
    "growth_factor": ["low", "high"],
    "slaughter_price": [0.56, 2.24],
    "feed_price": [0.187, 0.748],
    "ab_price_per_chick": [0.01, 0.04],
}
SWEEP_KEYS = ["param_id", "varied_param", "varied_value"]


def economic_rows(
    base: Economics = Economics(),
    growth: str = "middle",
    variations: dict[str, list] | None = None,
) -> list[dict]:
    """The base row (``param_id`` 0) and one row per changed value."""
    default = asdict(base) | {"growth_factor": growth}
    rows = [default | {"param_id": 0, "varied_param": "none", "varied_value": "base"}]
    changes = (ECONOMIC_VARIATIONS if variations is None else variations).items()
    for name, value in ((name, value) for name, values in changes for value in values):
        changed = {"param_id": len(rows), "varied_param": name, "varied_value": str(value)}
        rows.append(default | {name: value} | changed)
    return rows


def economic_table(spark: SparkSession, rows: list[dict] | None = None) -> DataFrame:
    rows = rows or economic_rows()
    kinds = {"n_birds": "int"}
    prices = ", ".join(f"{c} {kinds.get(c, 'double')}" for c in outcome_ops.ECONOMIC_COLUMNS)
    return literal_table(
        spark,
        rows,
        f"param_id int, varied_param string, varied_value string, growth_factor string, {prices}",
    )


def _in_blocks(params: DataFrame, block_rows: int) -> list[DataFrame]:
    """Parameter rows in blocks that may be broadcast; almost always it is one."""
    total = params.count()
    n = max(1, -(-total // block_rows))
    if n == 1:
        return [params]
    block = F.pmod(F.xxhash64("param_id", "varied_param", "varied_value"), F.lit(2 * n))
    return [params.filter(block == i) for i in range(2 * n)]


def economic_outcomes(
    counts: DataFrame,
    production: DataFrame,
    rows: list[dict] | DataFrame | None = None,
    as_written: bool = False,
    block_rows: int = SMALL_ROWS,
) -> DataFrame:
    """One row per flock and parameter row; the rows are a list or a table of any size.

    Prices act on the collapsed grain only. The daily grain is passed once, whatever the
    number of growth factors: each has columns of its own until the flock is one row.
    Parameter rows join on their growth factor, in blocks of a counted size.
    """
    spark = counts.sparkSession
    if isinstance(rows, DataFrame):
        params = rows
        growth = sorted(r["growth_factor"] for r in params.select("growth_factor").distinct().collect())
    else:
        rows = rows or economic_rows()
        params, growth = economic_table(spark, rows), sorted({r["growth_factor"] for r in rows})
    if len(growth) == 1 or as_written:
        daily = daily_ops.interpret(counts, production, growth[0], as_written)
        collapsed = outcome_ops.collapse(daily).drop("growth_factor")
        labels = ", ".join(f"'{g}'" for g in growth)
        collapsed = derive(collapsed, growth_factor=f"explode(array({labels}))")
    else:
        daily = daily_ops.interpret_wide(counts, production, growth)
        suffixes = tuple(f"_{g}" for g in growth)
        collapsed = outcome_ops.per_factor(outcome_ops.collapse(daily, suffixes=suffixes), growth)
    blocks = _in_blocks(params, block_rows) if isinstance(rows, DataFrame) or len(rows) > block_rows else [params]
    if len(blocks) > 1:  # the daily grain is passed once, not once per block
        path = shared_dir(spark, "collapsed")
        collapsed.write.parquet(path)
        collapsed = spark.read.parquet(path)
    joined = [collapsed.join(F.broadcast(block), "growth_factor") for block in blocks]
    return outcome_ops.economics(reduce(DataFrame.unionByName, joined))


def economic_sweep(
    counts: DataFrame,
    production: DataFrame,
    rows: list[dict] | DataFrame | None = None,
    as_written: bool = False,
    na_rm: bool = False,
) -> DataFrame:
    """One summary row per scenario and parameter row."""
    outcomes = economic_outcomes(counts, production, rows, as_written)
    return summary_ops.per_scenario(outcomes, na_rm, by=SWEEP_KEYS)


def one_parameter(name: str) -> list[dict]:
    """The rows that vary one parameter."""
    return [row for row in economic_rows() if row["varied_param"] == name]


def simulator_sweep(
    counts: DataFrame, production: DataFrame, growth: str = "middle", na_rm: bool = False,
    prices: Economics = Economics(),
) -> DataFrame:
    """Summary of the runs of a simulator sensitivity analysis, one row per run folder."""
    daily = daily_ops.interpret(counts, production, growth)
    return summary_ops.per_scenario(outcome_ops.per_simulation(daily, prices), na_rm)


# Inputs of a run that tell what it varies, and the columns that its default follows from.
RUN_INPUTS = [
    "beta", "recovery", "prop_clinical", "mortality_I", "mortality_B", "time_before_reduced_growth",
    "duration_reduced_growth", "t_until_bact_inf", "length_B",
]
RUN_BASE = ["vaccination_scenario", "prop_bact_factor"]
# How a varied parameter of the grid shows in the inputs of a run (``d_`` is the default); others are inputs themselves.
SHOWS_AS = {
    "beta_factor": "beta / nullif(d_beta, 0)",
    "recovery_factor": "recovery / nullif(d_recovery, 0)",
    "prop_clinical_base": f"prop_clinical - d_prop_clinical + {grids.PROP_CLINICAL_BASE}D",
}
UNVARIED = {"beta_factor": "1D", "recovery_factor": "1D", "prop_clinical_base": f"{grids.PROP_CLINICAL_BASE}D"}
# Values are the same if they agree to nine digits; they went through text and through products.
SAME = "%.8e"


def run_inputs(runs: DataFrame) -> DataFrame:
    """One row per run: its inputs, and ``problem`` where they vary or are missing in it."""
    names = [*RUN_INPUTS, *RUN_BASE]
    absent = [c for c in names if c not in runs.columns]
    runs = derive(runs, **{c: "CAST(NULL AS DOUBLE)" for c in absent})
    varies = " OR ".join(f"min({c}) <> max({c}) OR count({c}) NOT IN (0, count(1))" for c in names)
    missing = " OR ".join(f"min({c}) IS NULL" for c in names)
    problem = f"CASE WHEN {varies} THEN 'inputs vary within the run' WHEN {missing} THEN 'an input is missing' END"
    return runs.groupBy("scenario").agg(*[F.expr(f"CAST(min({c}) AS DOUBLE) AS {c}") for c in names], F.expr(problem).alias("problem"))


def run_labels(runs: DataFrame, grid: DataFrame) -> DataFrame:
    """(scenario, varied_param, varied_value, problem): what each run varies, from its inputs and not from its name.

    The inputs of a run are compared with the defaults of its own vaccination scenario. If just one of them differs and its value is
    in the one-at-a-time grid, that row names it; otherwise both names are NULL and ``problem`` says why. ``runs`` needs
    any rows of each run, one file each will do. One row per run is joined with the grid by value.
    """
    found = run_inputs(runs)
    default = grids.derive_parameters(found.select("scenario", *RUN_BASE), given=[]).select(
        "scenario", *[F.col(c).cast("double").alias(f"d_{c}") for c in RUN_INPUTS]
    )
    shown = {c: SHOWS_AS.get(c, c) for c in grids.VARIATIONS}
    usual = {c: UNVARIED.get(c, f"d_{c}") for c in grids.VARIATIONS}
    text = {c: f"format_string('{SAME}', CAST({v} AS DOUBLE))" for c, v in shown.items()}
    changes = ", ".join(
        f"IF({text[c]} <> format_string('{SAME}', CAST({usual[c]} AS DOUBLE)), struct('{c}' AS varied_param, {text[c]} AS _value), NULL)"
        for c in shown
    )
    compared = derive(found.join(default, "scenario"), _changes=f"array_compact(array({changes}))")
    one = derive(compared, _one="IF(problem IS NULL AND size(_changes) = 1, _changes[0], NULL)")
    known = grid.select(
        F.col("varied_param").alias("_grid_param"), F.format_string(SAME, F.col("varied_value").cast("double")).alias("_grid_value"),
        F.col("varied_value").cast("string").alias("varied_value"),
    )
    joined = one.join(known, (F.col("_one.varied_param") == F.col("_grid_param")) & (F.col("_one._value") == F.col("_grid_value")), "left")
    return joined.selectExpr(
        "scenario", "_grid_param AS varied_param", "varied_value",
        """CASE WHEN problem IS NOT NULL THEN problem WHEN size(_changes) = 0 THEN 'nothing varies'
           WHEN size(_changes) > 1 THEN 'several inputs vary' WHEN _grid_param IS NULL THEN 'not in the grid' END AS problem""",
    )


def name_runs(simulator: DataFrame, ordinals: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``run``, and what the run varies: ``varied_param`` and ``varied_value``.

    ``run`` is the position of the folder in name order (``counts.scenario_ordinals``), whatever its
    name is; ``labels`` comes from ``run_labels``. All tables have one row per run.
    """
    numbered = ordinals.select("scenario", F.col("ordinal").alias("run"))
    return simulator.join(numbered, "scenario", "left").join(labels.drop("problem"), "scenario", "left")


def continue_numbering(economic: DataFrame, simulator_runs: int) -> DataFrame:
    """Number the economic rows on from the last simulator run; the base row gets no number."""
    return derive(economic, run=f"IF(param_id > 0, param_id + {simulator_runs}, NULL)")


def combined_sensitivity(
    simulator: DataFrame, economic: DataFrame, simulator_runs: int
) -> DataFrame:
    """Both sensitivity summaries in one table; the base row is not part of it.

    ``simulator`` comes from ``name_runs``, ``simulator_runs`` is its highest number.
    """
    numbered = continue_numbering(economic, simulator_runs).filter("param_id > 0")
    return summary_ops.combine(
        derive(simulator, kind="'simulator'"), derive(numbered, kind="'economic'")
    )

