"""Production table: daily gain and feed intake of healthy and diseased birds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broodspark.functions.frames import derive, named
from broodspark.functions.small import is_small, literal_table

# Response of gain and feed conversion, and its strength per growth factor.
DISEASE_RESPONSE = {
    "DG_change_IB": -0.05,
    "DG_change_B": -0.2,
    "FCR_change_IB": 0.03,
    "FCR_change_B": 0.07,
}
GROWTH_STRENGTH = {"low": 0.5, "middle": 1.0, "high": 2.0}
HATCH_WEIGHT = 44.0
LAST_DAY_WITHOUT_FEED = 1
RESPONSES = ["DG_IB", "DG_B", "FI_IB", "FI_B"]


def with_multipliers(rows: DataFrame, response: dict[str, float] | None = None) -> DataFrame:
    """Multipliers of gain, feed conversion and feed intake from the column ``strength``."""
    response = response or DISEASE_RESPONSE
    single = {
        f"{kind}_mult_{group}": f"1 + strength * {response[f'{change}_change_{group}']}D"
        for group in ("IB", "B")
        for kind, change in (("dg", "DG"), ("fcr", "FCR"))
    }
    feed = {f"fi_mult_{g}": f"dg_mult_{g} * fcr_mult_{g}" for g in ("IB", "B")}
    return derive(derive(rows, **single), **feed)


def multipliers(spark: SparkSession, response: dict[str, float] | None = None) -> DataFrame:
    """One row of multipliers per growth factor."""
    rows = [{"growth_factor": name, "strength": s} for name, s in GROWTH_STRENGTH.items()]
    table = literal_table(spark, rows, "growth_factor string, strength double")
    return with_multipliers(table, response)


def healthy_table(healthy: DataFrame) -> DataFrame:
    """Rename the input columns; day 0 gains the hatch weight, the first days eat nothing."""
    return healthy.selectExpr(
        "day",
        f"IF(day = 0, {HATCH_WEIGHT}D, healthy_DG) AS DG_healthy",
        f"IF(day BETWEEN 0 AND {LAST_DAY_WITHOUT_FEED}, 0D, healthy_intake) AS FI_healthy",
    )


def production_table(healthy: DataFrame, response: dict[str, float] | None = None) -> DataFrame:
    """Long form: one row per day and growth factor.

    Each day is spread over the growth factors; no join. The input is counted here, once;
    if it is small, the result is marked for broadcast in the joins to come.
    """
    factors = ", ".join(
        f"struct('{g}' AS growth_factor, {s}D AS strength)" for g, s in GROWTH_STRENGTH.items()
    )
    days = healthy_table(healthy)
    spread = days.selectExpr("*", f"inline(array({factors}))")
    diseased = {}
    for group in ("IB", "B"):
        gain = f"IF(day = 0, {HATCH_WEIGHT}D, dg_mult_{group} * DG_healthy)"
        diseased |= {f"DG_{group}": gain, f"FI_{group}": f"fi_mult_{group} * FI_healthy"}
    ordered = {c: diseased[c] for c in RESPONSES}
    table = with_multipliers(spread, response).selectExpr(
        "day", "growth_factor", "DG_healthy", "FI_healthy", *named(ordered)
    )
    return F.broadcast(table) if is_small(healthy) else table


def wide(production: DataFrame) -> DataFrame:
    """One row per day; low and high responses as suffixed columns, middle without suffix."""

    def pick(column: str, factor: str, name: str) -> str:
        return f"max(IF(growth_factor = '{factor}', {column}, NULL)) AS {name}"

    columns = [pick(c, "middle", c) for c in ("DG_healthy", "FI_healthy", *RESPONSES)]
    columns += [pick(c, f, f"{c}_{f}") for f in ("low", "high") for c in RESPONSES]
    return production.sparkSession.sql(
        f"SELECT day, {', '.join(columns)} FROM {{production}} GROUP BY day", production=production
    )


def long(wide_table: DataFrame) -> DataFrame:
    """The long form back from the wide one, e.g. after reading a wide CSV."""
    options = ", ".join(
        f"struct('{factor}' AS growth_factor, "
        + ", ".join(f"{c}{suffix} AS {c}" for c in RESPONSES)
        + ")"
        for factor, suffix in (("low", "_low"), ("middle", ""), ("high", "_high"))
    )
    spread = wide_table.selectExpr("day", "DG_healthy", "FI_healthy", f"inline(array({options}))")
    return spread.select("day", "growth_factor", "DG_healthy", "FI_healthy", *RESPONSES)


def attach_wide(daily: DataFrame, production: DataFrame, factors: list[str]) -> DataFrame:
    """Left join on ``day`` with one set of response columns per growth factor."""
    unknown = set(factors) - set(GROWTH_STRENGTH)
    if unknown:
        raise ValueError(f"unknown growth factor: {', '.join(sorted(unknown))}")
    picks = [
        f"max(IF(growth_factor = '{f}', {c}, NULL)) AS {c}_{f}" for f in factors for c in RESPONSES
    ]
    per_day = production.sparkSession.sql(
        f"""SELECT day, max(DG_healthy) AS DG_healthy, max(FI_healthy) AS FI_healthy,
        {', '.join(picks)} FROM {{production}} GROUP BY day""",
        production=production,
    )
    # At most as many rows as the table it groups, so that one is counted, not the groups.
    return daily.join(F.broadcast(per_day) if is_small(production) else per_day, "day", "left")


def attach(
    daily: DataFrame, production: DataFrame, growth: str | list[str], as_written: bool = False
) -> DataFrame:
    """Left join on ``day``; a list of growth factors repeats each row once per factor.

    The production table comes marked for broadcast if it was found small where it was made
    or read; otherwise Spark chooses the join from its statistics.

    ``as_written=True`` keeps the middle responses whatever the growth factor, which is what
    the published results used; the factor is then only a label.
    """
    factors = [growth] if isinstance(growth, str) else list(growth)
    unknown = set(factors) - set(GROWTH_STRENGTH)
    if unknown:
        raise ValueError(f"unknown growth factor: {', '.join(sorted(unknown))}")
    shared = (set(daily.columns) & set(production.columns)) - {"day"}
    if shared:
        raise ValueError(f"columns in both tables: {', '.join(sorted(shared))}")
    quoted = ", ".join(f"'{f}'" for f in factors)
    responses = ["day", "DG_healthy", "FI_healthy", *RESPONSES]
    chosen = "'middle'" if as_written else quoted
    table = production.filter(f"growth_factor IN ({chosen})")
    if len(factors) == 1:
        joined = daily.join(table.select(responses), "day", "left")
        # A label that is always there, also on days that the production table lacks.
        return derive(joined, growth_factor=quoted)
    if as_written:
        table = derive(table.select(responses), growth_factor=f"explode(array({quoted}))")
    per_factor = derive(daily, growth_factor=f"explode(array({quoted}))")
    return per_factor.join(table, ["day", "growth_factor"], "left")
