"""Quality rules for parameter tables and for the daily panel, as rows of violations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from broodspark.functions.frames import by_day, derive
from broodspark.schema import FLOCK, SCENARIO_INPUTS

# Tolerance when a number is read as an integer: the square root of the double epsilon.
INTEGER_TOLERANCE = 2.0**-26


@dataclass(frozen=True)
class Rule:
    """What a parameter column must satisfy."""

    kind: str  # numeric, integer, logical or text
    low: float | None = None
    high: float | None = None


# The rules of the economic parameters.
ECONOMIC_RULES = {
    "DOA": Rule("numeric", high=1),
    "condemnation_base": Rule("numeric", high=1),
    "condemnation_B": Rule("numeric", high=1),
    "slaughter_price": Rule("numeric"),
    "feed_price": Rule("numeric"),
    "ab_price_per_chick": Rule("numeric"),
    "ab_price_constant": Rule("numeric"),
    "growth_factor": Rule("text"),
    "DG_change_IB": Rule("numeric", high=0),
    "DG_change_B": Rule("numeric", high=0),
    "FCR_change_IB": Rule("numeric", low=0),
    "FCR_change_B": Rule("numeric", low=0),
}


def _problem(name: str, rule: Rule, kind: str) -> Column:
    """The first rule that a value breaks, or NULL. A column's type counts: text is never a number."""
    value = F.col(name)
    text = value.cast("string")
    if rule.kind == "text":
        if kind != "string":
            return F.when(text.isNull(), "missing").otherwise("not text")
        return F.when(text.isNull(), "missing").when(text == "", "empty")
    if rule.kind == "logical":
        return F.when(text.isNull(), "missing").when(F.lit(kind != "boolean"), "not logical")
    if kind in ("string", "boolean"):
        return F.when(text.isNull(), "missing").otherwise("not numeric")
    number = value.cast("double")
    problem = F.when(text.isNull(), "missing").when(F.isnan(number), "not numeric")
    if rule.kind == "integer":
        problem = problem.when(F.abs(number - F.rint(number)) > INTEGER_TOLERANCE, "not an integer")
    if rule.low is not None:
        problem = problem.when(number < rule.low, f"below {rule.low}")
    if rule.high is not None:
        problem = problem.when(number > rule.high, f"above {rule.high}")
    return problem


def parameter_violations(
    table: DataFrame, rules: dict[str, Rule], keys: list[str]
) -> DataFrame:
    """One row per key, parameter and broken rule. A required column that is absent fails."""
    absent = F.lit("column is absent")
    kinds = dict(table.dtypes)
    checks = [
        F.struct(
            F.lit(name).alias("parameter"),
            (F.col(name).cast("string") if name in table.columns else F.lit(None).cast("string"))
            .alias("value"),
            (_problem(name, rule, kinds[name]) if name in table.columns else absent).alias("problem"),
        )
        for name, rule in rules.items()
    ]
    return table.select(*keys, F.inline(F.array(*checks))).filter(F.col("problem").isNotNull())


def list_violations(
    table: DataFrame, rules: dict[str, Rule], keys: list[str], min_length: int = 1
) -> DataFrame:
    """The same for array columns: too short, missing elements, or an element's own problem."""
    checks = []
    for name, rule in rules.items():
        size = F.coalesce(F.size(name), F.lit(0))
        short = F.when(size < min_length, f"fewer than {min_length} elements")
        checks.append(F.struct(F.lit(name).alias("parameter"), short.alias("problem")))
    lengths = table.select(*keys, F.inline(F.array(*checks))).filter(F.col("problem").isNotNull())
    found = lengths.withColumn("value", F.lit(None).cast("string"))
    for name, rule in rules.items():
        elements = table.select(*keys, F.explode(name).alias(name))
        found = found.unionByName(parameter_violations(elements, {name: rule}, keys))
    return found.select(*keys, "parameter", "value", "problem")


COUNTERS = ["cum_I", "cum_B", "cum_mort", "cum_thinning"]
SHARES = ["NG", "NGi", "NGr", "RGi", "RGb"]


def panel_violations(panel: DataFrame) -> DataFrame:
    """One row per flock, day and broken rule of the daily panel.

    All rules share one pass in the order of days: a day that occurs again (``duplicate_day``), days
    that are left out before a row (``missing_day``), a running total below that of the row before
    (``<counter>_falls``), growth classes that do not add up to the birds present (``shares``), and
    values that are missing (``<column>_missing``), for which no other rule is tried.
    """
    before = derive(panel, _day=f"lag(day) {by_day()}", **{f"_{c}": f"lag({c}) {by_day()}" for c in COUNTERS})
    rules = ["IF(day IS NULL, 'day_missing', NULL)", "IF(day = _day, 'duplicate_day', NULL)", "IF(day > _day + 1, 'missing_day', NULL)"]
    rules += [f"IF({c} < _{c}, '{c}_falls', NULL)" for c in COUNTERS]
    rules += [f"IF({' + '.join(SHARES)} <> P, 'shares', NULL)"]
    rules += [f"IF({c} IS NULL, '{c}_missing', NULL)" for c in [*COUNTERS, *SHARES, "P"]]
    return before.selectExpr(*FLOCK, "day", f"explode(array_compact(array({', '.join(rules)}))) AS rule")


def varying_inputs(panel: DataFrame, inputs: list[str] = SCENARIO_INPUTS) -> DataFrame:
    """Inputs that should hold one value per scenario but do not: scenario, input, range, missing rows.

    A value on some rows and none on others varies too.
    """
    ranges = panel.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(c).alias(f"_count_{c}") for c in inputs],
        *[F.min(c).cast("double").alias(f"_min_{c}") for c in inputs],
        *[F.max(c).cast("double").alias(f"_max_{c}") for c in inputs],
    )
    rows = [
        F.struct(
            F.lit(c).alias("input"),
            F.col(f"_min_{c}").alias("lowest"),
            F.col(f"_max_{c}").alias("highest"),
            (F.col("_rows") - F.col(f"_count_{c}")).alias("n_missing"),
        )
        for c in inputs
    ]
    spread = ranges.select("scenario", "_rows", F.inline(F.array(*rows)))
    partly = (F.col("n_missing") > 0) & (F.col("n_missing") < F.col("_rows"))
    return spread.filter((F.col("lowest") != F.col("highest")) | partly).drop("_rows")


def partly_left_out(kept: DataFrame, left_out: Observation) -> DataFrame:
    """(scenario): those that a filter by scenario split, from the rows it kept and what it observed.

    The frame that was observed must have been written before; ``kept`` is what was written.
    """
    names = [(name,) for name in left_out.get["scenarios"]]
    lost = kept.sparkSession.createDataFrame(names, "scenario string")
    return kept.select("scenario").distinct().join(lost, "scenario", "left_semi")


def column_presence(df: DataFrame, required: list[str]) -> DataFrame:
    """Per required column: whether it is there and how many rows have a value."""
    counts = df.agg(
        *[
            (F.count(c) if c in df.columns else F.lit(0).cast("long")).alias(f"n_{c}")
            for c in required
        ]
    )
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(int(c in df.columns)).alias("present"),
            F.col(f"n_{c}").alias("n_values"),
        )
        for c in required
    ]
    return counts.select(F.inline(F.array(*rows)))


def single_match(df: DataFrame, scenarios: str = "scenario") -> DataFrame:
    """Scenarios that a selection matched, with their rows; more than one is ambiguous."""
    return df.groupBy(scenarios).agg(F.count(F.lit(1)).alias("n_rows"))
