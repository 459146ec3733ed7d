"""Per-scenario grain: one summary row per scenario (and parameter set)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broodspark.functions.frames import named
from broodspark.functions.missing import ratio
from broodspark.operators.outcomes import PLANNED_SLAUGHTER, PLANNED_THINNING
from broodspark.schema import SCENARIO_INPUTS

# Economic columns that the summary repeats, by their name in the outcome table.
ECHOED = {
    "condemnation_B": "condemnation_B",
    "growth_factor": "growth_factor",
    "slaughter_price": "slaughter_price",
    "feed_price": "feed_price",
    "ab_price_per_chick": "ab_price_per_chick",
    "ab_price_constant": "ab_price_constant",
    "vaccine_price_per_chick": "vaccine_price",
}

# Fixed names and order of the output. Measures with mean, min and max: name in the summary -> column of the outcome table.
SPREAD = {
    "p_prevalence": "percentage_prevalence",
    "p_resp_signs": "resp_signs",
    "p_secondary": "percentage_prevalence_secondary",
    "peak_resp_signs": "peak_resp_signs",
    "cum_clin_IB": "cum_I",
    "cum_secondary": "cum_B",
    "end_weight": "total_weight",
    "avg_BW": "avg_BW",
    "weight_revenue": "weight_revenue",
    "cum_FI": "cum_FI",
    "FCR": "FCR_daily",
    "delta": "delta",
    "cond": "condemned_total",
    "feed_cost": "feed_cost",
    "mort": "mortality",
    "treatment_cost": "treatment_cost",
    "kg_treated": "treated_kg",
    "DDD_year": "DDD_year",
}
PERCENT = ("p_prevalence", "p_secondary")


# Means only: name in the summary -> expression over the outcome table.
MEANS = {
    "mean_thinned_weight": "thinned_weight",
    "early_thinning_triggered": f"CAST(thinning_day < {PLANNED_THINNING} AS INT)",
    "early_slaughter_triggered": f"CAST(day < {PLANNED_SLAUGHTER} AS INT)",
    "vaccination_cost": "vaccination_cost",
    "fraction_treatment_triggered": "treatment_triggered",
    "fraction_treated": "treated",
}


def summary_columns() -> list[str]:
    """The 84 columns of the summary, in order."""

    def spread(*names: str) -> list[str]:
        return [f"{stat}_{name}" for name in names for stat in ("mean", "min", "max")]

    names = list(SPREAD)
    infection, rest = names[:6], names[6:]
    production, treatment = rest[:9], rest[9:]
    return [
        "scenario", "n", *SCENARIO_INPUTS, *ECHOED.values(),
        *spread(*infection),
        "mean_thinned_weight", *spread(*production),
        "early_thinning_triggered", "early_slaughter_triggered", "vaccination_cost",
        *spread(treatment[0]),
        "fraction_treatment_triggered", "fraction_treated",
        "median_treatment_day", "min_treatment_day", "max_treatment_day",
        *spread(*treatment[1:]),
    ]


def per_scenario(
    outcomes: DataFrame, na_rm: bool = False, by: list[str] | None = None
) -> DataFrame:
    """One row per scenario, and per value of the extra key columns in ``by``.

    Statistics are NULL when a value is missing unless ``na_rm``: then missing values are
    left out, e.g. untreated flocks from the treatment day.

    Two steps. The first groups by scenario, echoed parameters and treatment day (a few
    dozen days at most) with plain sums, minima and maxima, so the heavy step is combined
    on the map side and a scenario with a third of all flocks shuffles a few rows per
    task. The second merges those rows and takes the exact median of the treatment day
    from their counts.
    """
    keys = ["scenario", *(by or []), *ECHOED]
    parts = ["count(1) AS n", "min(simu_id) AS _first"]
    parts += [f"min_by({c}, simu_id) AS _id_{c}" for c in SCENARIO_INPUTS]
    for name, value in (SPREAD | MEANS).items():
        parts += [f"sum({value}) AS _sum_{name}", f"count({value}) AS _count_{name}"]
    for name, column in SPREAD.items():
        parts += [f"min({column}) AS _min_{name}", f"max({column}) AS _max_{name}"]

    def guarded(value: str, counted: str) -> str:
        return value if na_rm else f"IF({counted} = sum(n), {value}, NULL)"

    def mean(name: str) -> str:
        counted = f"sum(_count_{name})"
        return guarded(ratio(f"sum(_sum_{name})", counted), counted)

    merged = {"n": "sum(n)"} | {c: f"min_by(_id_{c}, _first)" for c in SCENARIO_INPUTS}
    for name in SPREAD:
        scale = " / 100" if name in PERCENT else ""
        counted = f"sum(_count_{name})"
        merged |= {
            f"mean_{name}": mean(name) + scale,
            f"min_{name}": guarded(f"min(_min_{name})", counted) + scale,
            f"max_{name}": guarded(f"max(_max_{name})", counted) + scale,
        }
    merged |= {name: mean(name) for name in MEANS}
    with_day = "sum(IF(treatment_day IS NULL, 0, n))"
    merged |= {
        "median_treatment_day": guarded("percentile(treatment_day, 0.5, n)", with_day),
        "min_treatment_day": guarded("min(treatment_day)", with_day),
        "max_treatment_day": guarded("max(treatment_day)", with_day),
    }
    grouped = ", ".join(keys)
    columns = {name: c for c, name in ECHOED.items()} | {"scenario": "scenario"} | merged
    wanted = [*(by or []), *named({c: columns[c] for c in summary_columns()})]
    return outcomes.sparkSession.sql(
        f"""
        SELECT {', '.join(wanted)}
        FROM (
          SELECT {grouped}, treatment_day, {', '.join(parts)}
          FROM {{outcomes}} GROUP BY {grouped}, treatment_day
        )
        GROUP BY {grouped}
        """,
        outcomes=outcomes,
    )


def check(summary: DataFrame) -> DataFrame:
    """One row about a summary table: scenarios, rounds, whether these agree, values used.

    The input has one row per scenario, so the sets are as small as the grid's lists. A missing
    value is one of the values, the last one.
    """

    def values(column: str) -> Column:
        found = F.array_sort(F.collect_set(column))
        none = F.array(F.lit(None).cast(dict(summary.dtypes)[column]))
        return F.when(F.count(column) < F.count(F.lit(1)), F.concat(found, none)).otherwise(found)

    return summary.agg(
        F.count(F.lit(1)).alias("n_simulations"),
        F.min_by("n", "scenario").alias("n_rounds"),
        F.when(F.count_distinct("n") > 1, 0).otherwise(1).alias("n_rounds_constant"),
        values("vaccination_scenario").alias("vaccination_scenario"),
        values("introduction_time").alias("introduction_times"),
        values("early_slaughter").alias("early_slaughter"),
        values("prop_bact_factor").alias("prop_bact_factor"),
    )


PUBLICATION_KEYS = [
    "vaccination_scenario", "introduction_time", "early_slaughter", "prop_bact_factor",
]
PUBLICATION_MEASURES = [
    "mean_delta", "mean_avg_BW", "mean_mort", "mean_cond", "mean_DDD_year",
]


def publication(summary: DataFrame, digits: int = 3) -> DataFrame:
    """The columns to publish, rounded and sorted by scenario."""
    return summary.select(
        *PUBLICATION_KEYS, *[F.round(c, digits).alias(c) for c in PUBLICATION_MEASURES]
    ).orderBy(*PUBLICATION_KEYS)


def combine(*summaries: DataFrame) -> DataFrame:
    """Union by column name; a column that one table lacks is NULL there."""
    first, *others = summaries
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
