"""Per-simulation grain: one row of production and economics per flock.

``per_simulation`` collapses the daily grain in one pass: windows over the days of a flock
put the thinning and treatment values on every row, and the last day is kept. The joined
form (thinning rows, treatment rows and last rows, joined on the key) gives the same result
from three reads of the daily frame; it is kept for single use and as a cross-check.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from broodspark.functions.frames import derive, named, whole_flock
from broodspark.functions.missing import ratio
from broodspark.operators.daily import GROWN
from broodspark.operators.grids import DEFAULT_SCENARIO
from broodspark.schema import FLOCK, LAST_DAY, drop_existing

# Fixed values.
TREATED_DAYS = 3
PLANNED_THINNING = 34
PLANNED_SLAUGHTER = LAST_DAY


@dataclass(frozen=True)
class Economics:
    """Prices and rates of the base case (fixed values)."""

    DOA: float = 0.0014
    condemnation_base: float = 0.005
    condemnation_B: float = 1.0
    slaughter_price: float = 1.12
    feed_price: float = 0.374
    ab_price_per_chick: float = 0.02
    ab_price_constant: float = 178.0
    vaccine_price_per_chick: float = 0.01
    n_birds: int = 30000

    def columns(self) -> dict[str, str]:
        values = asdict(self).items()
        return {name: f"{v!r}D" if isinstance(v, float) else str(v) for name, v in values}


ECONOMIC_COLUMNS = list(asdict(Economics()))

# Columns of the thinning day that the outcome needs, by their name there.
THINNING_VALUES = {
    "day": "thinning_day",
    "thinned_weight": "thinned_weight",
    "FCR_daily": "FCR_thinning",
    "cum_thinning": "n_thinned",
    "weight_per_bird": "weight_per_bird_thinning",
    "p_lesions": "p_lesions_thinning",
    "p_no_lesions": "p_no_lesions_thinning",
}
# Treatment columns of a flock that got none.
UNTREATED = {
    "treatment_day": "CAST(NULL AS INT)",
    "treated": "0",
    "treated_flock_size": "0",
    "treated_kg": "0D",
    "treated_days": "0",
}


# --- single pass -------------------------------------------------------------------


def collapse(
    daily: DataFrame, keys: list[str] = FLOCK, suffixes: tuple[str, ...] = ("",)
) -> DataFrame:
    """The last day of each flock with its thinning and treatment values; no prices yet.

    ``suffixes`` as in ``growth_measures``: growth-dependent values are picked once each.
    """
    everywhere = whole_flock(keys)
    # Fixed at slaughter: the thinning time that the last day holds.
    marked = derive(
        daily,
        _last_day=f"max(day) {everywhere}",
        _thinned_on=f"max_by(thinning_time, day) {everywhere}",
    )
    picked = {
        f"{name}{s}": f"max(IF(day = _thinned_on, {column}{s}, NULL)) {everywhere}"
        for column, name in THINNING_VALUES.items()
        for s in (suffixes if column in GROWN else ("",))
    }
    start = "IF(treatment_start = 1, day, NULL)"
    picked |= {
        "treatment_day": f"min({start}) {everywhere}",
        "_treated_birds": f"min_by(total_birds, {start}) {everywhere}",
    }
    picked |= {f"_kg{s}": f"min_by(total_weight{s}, {start}) {everywhere}" for s in suffixes}
    replaced = ", ".join(f"thinned_weight{s}" for s in suffixes)
    last = marked.selectExpr(f"* EXCEPT ({replaced})", *named(picked)).filter("day = _last_day")
    # A treated flock keeps its own values, also missing ones.
    treated = {
        "treated": "1",
        "treated_flock_size": "_treated_birds",
        "treated_days": str(TREATED_DAYS),
    }
    values = {c: f"IF(treatment_day IS NOT NULL, {v}, {UNTREATED[c]})" for c, v in treated.items()}
    for s in suffixes:
        kg = f"IF(treatment_day IS NOT NULL, _kg{s}, {UNTREATED['treated_kg']})"
        values[f"treated_kg{s}"] = kg
    helpers = ["_last_day", "_thinned_on", "_treated_birds", *[f"_kg{s}" for s in suffixes]]
    return derive(last, **values).drop(*helpers)


def per_factor(collapsed: DataFrame, factors: list[str]) -> DataFrame:
    """One row per flock and growth factor from the columns that ``collapse`` gave each."""
    names = [*GROWN, "FCR_thinning", "weight_per_bird_thinning", "treated_kg"]
    rows = ", ".join(
        f"struct('{f}' AS growth_factor, {', '.join(f'{n}_{f} AS {n}' for n in names)})"
        for f in factors
    )
    suffixed = ", ".join(f"{n}_{f}" for f in factors for n in names)
    return collapsed.selectExpr(f"* EXCEPT ({suffixed})", f"inline(array({rows}))")


def economics(collapsed: DataFrame) -> DataFrame:
    """Condemnation, delivered and slaughter weights, revenue, costs and margin.

    The frame carries one row per flock (and parameter set) and the columns of
    ``Economics``, as literals or from a joined parameter table.
    """

    def condemned(suffix: str = "") -> str:
        return f"condemnation_B * p_lesions{suffix} + condemnation_base * p_no_lesions{suffix}"

    shares = derive(
        collapsed,
        condemned_thinning=condemned("_thinning"),
        condemned_end=condemned(),
        delivered_weight_thinning="thinned_weight - DOA * thinned_weight",
        delivered_weight_end="total_weight - DOA * total_weight",
        treatment_cost="""IF(treated = 1,
            ab_price_per_chick * treated_flock_size + ab_price_constant, 0D)""",
        vaccination_cost="""CASE WHEN vaccination_scenario = 0 THEN 0D
            WHEN vaccination_scenario IS NOT NULL THEN vaccine_price_per_chick * n_birds END""",
        feed_cost="cum_FI * feed_price",
        avg_BW=ratio("thinned_weight + total_weight", "n_thinned + total_birds"),
        DDD_year=f"{ratio('treated_days', 'day')} * 365",
        early_thinning_triggered=f"CAST(thinning_day < {PLANNED_THINNING} AS INT)",
        early_slaughter_triggered=f"CAST(day < {PLANNED_SLAUGHTER} AS INT)",
    )
    weights = derive(
        shares,
        n_condemned_thinning="condemned_thinning * n_thinned",
        n_condemned_end="condemned_end * total_birds",
        slaughter_weight_thinning="(1 - condemned_thinning) * delivered_weight_thinning",
        slaughter_weight_end="(1 - condemned_end) * delivered_weight_end",
    )
    totals = derive(
        weights,
        condemned_total=ratio("n_condemned_thinning + n_condemned_end", "n_thinned + total_birds"),
        slaughter_weight_total="slaughter_weight_thinning + slaughter_weight_end",
        weight_revenue="(slaughter_weight_thinning + slaughter_weight_end) * slaughter_price",
    )
    return derive(totals, delta="weight_revenue - feed_cost - treatment_cost - vaccination_cost")


def per_simulation(
    daily: DataFrame, prices: Economics = Economics(), keys: list[str] = FLOCK
) -> DataFrame:
    """One row per flock: its last day, thinning, treatment and economics."""
    return economics(derive(collapse(daily, keys), **prices.columns()))


# --- joined form -------------------------------------------------------------------


def thinning_rows(daily: DataFrame, keys: list[str] = FLOCK) -> DataFrame:
    """Values on the thinning day, for the flocks that reach it."""
    marked = derive(daily, _thinned_on=f"max_by(thinning_time, day) {whole_flock(keys)}")
    values = [f"{c} AS {name}" for c, name in THINNING_VALUES.items()]
    return marked.filter("day = _thinned_on").selectExpr(*keys, *values)


def treatment_rows(daily: DataFrame, keys: list[str] = FLOCK) -> DataFrame:
    """First day, flock size and weight at treatment, for the treated flocks only."""
    return (
        daily.filter(F.col("treatment_start") == 1)
        .groupBy(*keys)
        .agg(
            F.min("day").alias("treatment_day"),
            F.lit(1).alias("treated"),
            F.min_by("total_birds", "day").alias("treated_flock_size"),
            F.min_by("total_weight", "day").alias("treated_kg"),
            F.lit(TREATED_DAYS).alias("treated_days"),
        )
    )


def keyed_update(target: DataFrame, source: DataFrame, by: list[str]) -> DataFrame:
    """Overwrite the shared columns of matched rows, also with NULL; keep the others.

    A key of ``source`` that occurs twice, or that ``target`` does not have, stops the job: it is seen where the two meet,
    without another pass (``key_problems`` lists such keys).
    """
    columns = [c for c in source.columns if c not in by]
    counted = source.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    renamed = counted.withColumnsRenamed({c: f"_new_{c}" for c in columns})
    joined = target.withColumn("_there", F.lit(True)).join(renamed, by, "full")
    key = F.concat_ws(", ", *[F.concat(F.lit(f"{c} = "), F.coalesce(F.col(c).cast("string"), F.lit("NULL"))) for c in by])

    def stop(problem: str) -> Column:
        return F.raise_error(F.concat(F.lit(f"the update has a key {problem}: "), key))

    checked = joined.filter(
        F.when(F.col("_there").isNull(), stop("without a row")).when(F.col("_n") > 1, stop("twice")).otherwise(F.lit(True))
    )
    return checked.select(
        *[F.when(F.col("_n") == 1, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns]
    )


def key_problems(target: DataFrame, source: DataFrame, by: list[str]) -> DataFrame:
    """The keys that stop ``keyed_update``: once per key, ``twice`` or ``without a row``. A missing key matches nothing."""
    keys = source.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    there = target.select(*by).distinct().withColumn("_there", F.lit(True))
    problem = F.when(F.col("_there").isNull(), "without a row").when(F.col("n") > 1, "twice")
    return keys.join(there, by, "left").select(*by, "n", problem.alias("problem")).filter("problem IS NOT NULL")


def last_rows(daily: DataFrame, keys: list[str] = FLOCK) -> DataFrame:
    """The latest day of each flock."""
    latest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("day")))
    return daily.withColumn("_rank", latest).filter(F.col("_rank") == 1).drop("_rank")


def per_simulation_joined(
    daily: DataFrame, prices: Economics = Economics(), keys: list[str] = FLOCK
) -> DataFrame:
    """Same rows as ``per_simulation``, from joins of three views of the daily frame."""
    defaults = derive(daily.select(*keys).distinct(), **UNTREATED)
    treatment = keyed_update(defaults, treatment_rows(daily, keys), keys)
    end = drop_existing(last_rows(daily, keys), "thinned_weight")
    joined = end.join(thinning_rows(daily, keys), keys, "left").join(treatment, keys, "left")
    return economics(derive(joined, **prices.columns()))


def default_scenario(df: DataFrame, parameters: dict[str, float] | None = None) -> DataFrame:
    """Rows of the default scenario, by its parameters."""
    for name, value in (parameters or DEFAULT_SCENARIO).items():
        df = df.filter(f"{name} = {value!r}")
    return df


def without_introduction_time(df: DataFrame, day: int = 7, left_out: Observation | None = None) -> DataFrame:
    """Leave out the scenarios whose virus introduction is on ``day``; a missing day is an error.

    The rows go one by one. ``left_out`` observes, in the pass that reads them, which scenarios lost rows
    (``quality.partly_left_out`` says whether one of them kept some); there are as many names as folders.
    """
    time = F.col("introduction_time")
    missing = F.raise_error(F.lit("introduction_time is missing"))
    if left_out is not None:
        df = df.observe(left_out, F.collect_set(F.when(time == day, F.col("scenario"))).alias("scenarios"))
    return df.filter(F.when(time.isNull(), missing).otherwise(time != day))
