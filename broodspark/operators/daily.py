"""Daily grain: shares, weight, feed intake and feed conversion per flock and day."""

from __future__ import annotations

from pyspark.sql import DataFrame

from broodspark.functions.frames import by_day, derive, so_far, whole_flock
from broodspark.functions.missing import half_even, ratio, running_sum, strict
from broodspark.operators import production as production_ops
from broodspark.schema import FLOCK, REQUIRED_COUNTS, drop_existing, require_columns

RAW_COLUMNS_DROPPED = ["level", "agent_id", "De"]
RENAMED = {"step": "day", "RGi": "red_grow_IB", "RGb": "red_grow_B", "P": "total_birds"}


def tidy(counts: DataFrame) -> DataFrame:
    """Raw counts with the bookkeeping columns dropped and the working names set."""
    checked = require_columns(counts, ["scenario", *REQUIRED_COUNTS])
    return drop_existing(checked, *RAW_COLUMNS_DROPPED).withColumnsRenamed(RENAMED)


def flock_measures(daily: DataFrame) -> DataFrame:
    """Measures that do not depend on growth: shares, lesions, signs, start of treatment."""
    shares = derive(
        daily,
        normal_growing_birds="NG + NGi + NGr",
        p_normal=ratio("NG + NGi + NGr", "total_birds"),
        p_IB=ratio("red_grow_IB", "total_birds"),
        p_B=ratio("red_grow_B", "total_birds"),
        p_lesions=ratio("B + RL", "total_birds"),
        p_no_lesions=ratio("total_birds - (B + RL)", "total_birds"),
        mortality="percentage_mortality / 100",
        resp_signs="percentage_total_resp_signs / 100",
    )
    started = f"not_yet_treated = 0 AND lag(not_yet_treated, 1, 1) {by_day()} = 1"
    return derive(
        shares,
        p_tot=half_even("p_normal + p_IB + p_B"),
        peak_resp_signs=strict("max(resp_signs)", "resp_signs", whole_flock()),
        treatment_start=f"CAST({started} AS INT)",
    ).drop("not_yet_treated")


# Columns that depend on the growth factor.
GROWN = [
    "DG_per_bird", "total_daily_FI", "weight_per_bird", "cum_FI", "total_weight",
    "thinned_weight", "FCR_daily",
]


def growth_measures(
    daily: DataFrame, keys: list[str] = FLOCK, suffixes: tuple[str, ...] = ("",)
) -> DataFrame:
    """Weight, feed and feed conversion; ``daily`` carries the production columns.

    With several suffixes, the responses and the results have one column each per suffix:
    one window pass accumulates all of them.
    """

    def columns(of_suffix) -> dict[str, str]:
        return {f"{name}{s}": e for s in suffixes for name, e in of_suffix(s).items()}

    gains = columns(
        lambda s: {
            "DG_per_bird": f"p_normal * DG_healthy + p_IB * DG_IB{s} + p_B * DG_B{s}",
            "total_daily_FI": f"""(normal_growing_birds * FI_healthy + red_grow_IB * FI_IB{s}
                + red_grow_B * FI_B{s}) / 1000""",
        }
    )
    sums = columns(
        lambda s: {
            "weight_per_bird": f"{running_sum(f'DG_per_bird{s}', so_far(keys))} / 1000",
            "cum_FI": running_sum(f"total_daily_FI{s}", so_far(keys)),
        }
    )
    weights = columns(
        lambda s: {
            "total_weight": f"weight_per_bird{s} * total_birds",
            # Thinned birds are valued at the weight of the current day.
            "thinned_weight": f"weight_per_bird{s} * cum_thinning",
        }
    )
    conversion = columns(
        lambda s: {"FCR_daily": ratio(f"cum_FI{s}", f"total_weight{s} + thinned_weight{s}")}
    )
    for step in (gains, sums, weights, conversion):
        daily = derive(daily, **step)
    return daily


def grain_keys(growth: str | list[str]) -> list[str]:
    """Key of the daily grain: the growth factor belongs to it when there are several."""
    return FLOCK if isinstance(growth, str) else [*FLOCK, "growth_factor"]


def interpret(
    counts: DataFrame,
    production: DataFrame,
    growth: str | list[str] = "middle",
    as_written: bool = False,
) -> DataFrame:
    """Counts in, daily grain out.

    Flock windows come before the production join: the exchange on (scenario, simu_id)
    moves each counts row once, also when several growth factors repeat the rows after it.
    """
    flock = flock_measures(tidy(counts))
    grown = production_ops.attach(flock, production, growth, as_written)
    return growth_measures(grown, grain_keys(growth))


def interpret_wide(counts: DataFrame, production: DataFrame, factors: list[str]) -> DataFrame:
    """The daily grain with the ``GROWN`` columns once per growth factor (``_<factor>``).

    Rows are not repeated per factor, so neither the sort nor the windows grow with them.
    """
    flock = flock_measures(tidy(counts))
    grown = production_ops.attach_wide(flock, production, factors)
    return growth_measures(grown, suffixes=tuple(f"_{f}" for f in factors))
