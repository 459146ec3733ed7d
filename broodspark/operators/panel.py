"""Operators on the daily panel or an entry log: counters, rates, alarms, decisions.

Input grain is (scenario, simu_id, day). All windows share one partitioning and order,
so a chain of these operators costs one exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broodspark.functions.frames import (
    by_day,
    derive,
    last_days,
    rederive,
    so_far,
    whole_flock,
)
from broodspark.functions.missing import half_even, ratio
from broodspark.schema import FLOCK

# Days before thinning or slaughter in which no treatment may start.
WITHDRAWAL_DAYS = 5


# --- counts from a log -------------------------------------------------------------


def state_occupancy(log: DataFrame, states: list[str], keys: list[str] = FLOCK) -> DataFrame:
    """Rows per state, flock and day, one column per state (``n_<state>``)."""
    return log.groupBy(*keys, "day").agg(
        *[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in states]
    )


def co_occurrence(log: DataFrame, first: str, second: str, keys: list[str] = FLOCK) -> DataFrame:
    """Rows per pair of values of two state columns, per flock and day."""
    return log.groupBy(*keys, "day", first, second).agg(F.count(F.lit(1)).alias("n"))


def cumulative_entries(daily: DataFrame, counters: dict[str, str]) -> DataFrame:
    """Running totals: ``counters`` maps a column of daily entries to its counter's name."""
    return derive(
        daily, **{total: f"sum({entry}) {so_far()}" for entry, total in counters.items()}
    )


def dwell_occupancy(daily: DataFrame, durations: dict[str, tuple]) -> DataFrame:
    """Birds present per day when each stays a fixed number of days after entering.

    ``durations`` maps the new column to (entry column, days) or, for a state that follows
    another one, (entry column, days, days before it). Needs a row for every day.
    """
    return derive(
        daily,
        **{
            name: f"coalesce(sum({entry}) {last_days(days, *before)}, 0)"
            for name, (entry, days, *before) in durations.items()
        },
    )


def occupancy_from_log(
    log: DataFrame, days: int | str, last_day: int, exit_day: str | None = None, share: float = 1, after: int = 0
) -> DataFrame:
    """Birds present per flock and day from a log of entries (key, day, ``n`` birds).

    Each entry comes ``after`` days after its row and stays ``days`` days. On the day in column
    ``exit_day`` a ``share`` of the birds that are present leaves; that happens once. It acts on the birds
    at the start of the day: those that enter on that day or later stay their full time.
    A flock without an exit day loses none. With a share below 1 the birds are fractions.

    Entries are first added up per flock, day and stay, then turned into one arrival
    and one departure; days in between follow from a running sum, so rows never multiply by
    the stay length.
    """
    entered = log.selectExpr(*FLOCK, f"day + {after} AS day", f"day + {after} + {days} AS _end", f"{exit_day or 'NULL'} AS _exit", "n")
    early = "IF(_exit > day, least(_end, _exit), _end)"
    if exit_day is None or share == 1:
        stays = entered.selectExpr(*FLOCK, "day", f"{early if exit_day else '_end'} AS _leave", "n")
    else:
        parts = f"struct({early} AS _leave, n * {share}D AS n), struct(_end AS _leave, n - n * {share}D AS n)"
        stays = entered.selectExpr(*FLOCK, "day", f"inline(array({parts}))")
    least_birds = "0" if exit_day is None or share == 1 else "1e-6"
    moves = (
        stays.groupBy(*FLOCK, "day", "_leave")
        .agg(F.sum("n").alias("n"))
        .selectExpr(
            *FLOCK,
            "inline(array(struct(day AS day, n AS change), struct(_leave AS day, -n AS change)))",
        )
        .groupBy(*FLOCK, "day")
        .agg(F.sum("change").alias("change"))
    )
    present = derive(
        moves,
        present=f"sum(change) {so_far()}",
        _until=f"least(lead(day, 1, {last_day + 1}) {by_day()} - 1, {last_day})",
    ).filter(f"present > {least_birds} AND day <= _until")
    return present.selectExpr(*FLOCK, "explode(sequence(day, _until)) AS day", "present")


def birds_by_day(
    stays: DataFrame, first_day: int, last_day: int, signs: str = "signs", bacterial: str = "bacterial",
    bird: str = "bird", keys: list[str] = FLOCK,
) -> DataFrame:
    """Birds per flock and day in either of two kinds of state, from stays of single birds.

    ``stays`` has (keys, bird, dimension, from_day, until_day): a bird is in a state of the dimension on these days, both
    included; no ``until_day`` means to the end. Stays of one bird may overlap. A bird counts once per day as RS (``signs``), B
    (``bacterial``), ``B_and_RS`` and ``total_resp_signs``, on all days of every flock that has a stay.

    A sweep over the changes: per bird and dimension the open stays are added up, and where a bird enters or leaves, the
    flock's counts change by one. Changes are added up per flock and day before they are shuffled; no bird is repeated per day.
    """
    inside = stays.selectExpr(
        *keys, bird, "dimension", f"greatest(from_day, {first_day}) AS _from", f"least(coalesce(until_day, {last_day}), {last_day}) AS _until"
    ).filter(f"_from <= _until AND dimension IN ('{signs}', '{bacterial}')")
    edges = inside.selectExpr(*keys, bird, "dimension", "inline(array(struct(_from AS day, 1 AS step), struct(_until + 1 AS day, -1 AS step)))")
    changes = edges.groupBy(*keys, bird, "day").agg(
        *[F.sum(F.when(F.col("dimension") == d, F.col("step")).otherwise(0)).alias(f"_{d}") for d in (signs, bacterial)]
    )
    of_bird = so_far([*keys, bird])
    present = derive(changes, _s=f"CAST(sum(_{signs}) {of_bird} > 0 AS INT)", _b=f"CAST(sum(_{bacterial}) {of_bird} > 0 AS INT)")
    counted = {"RS": "_s", "B": "_b", "B_and_RS": "_s * _b", "total_resp_signs": "greatest(_s, _b)"}
    now = derive(present, **counted)
    entered = now.selectExpr(*keys, "day", *[f"{c} - lag({c}, 1, 0) {by_day([*keys, bird])} AS {c}" for c in counted])
    per_day = entered.groupBy(*keys, "day").agg(*[F.sum(c).alias(c) for c in counted])
    running = per_day.selectExpr(
        *keys, "day", f"lead(day, 1, {last_day + 1}) {by_day(keys)} AS _next", f"row_number() {by_day(keys)} AS _n",
        *[f"sum({c}) {so_far(keys)} AS {c}" for c in counted],
    )
    before = f"struct({first_day} AS _from, day AS _next, {', '.join(f'0L AS {c}' for c in counted)})"
    after = f"struct(day AS _from, _next, {', '.join(counted)})"
    spans = running.selectExpr(*keys, f"inline(IF(_n = 1, array({before}, {after}), array({after})))").filter(f"_from < _next AND _from <= {last_day}")
    return spans.selectExpr(*keys, "explode(sequence(_from, _next - 1)) AS day", *counted)


# --- rates -------------------------------------------------------------------------


def flock_size(panel: DataFrame, initial_birds: int) -> DataFrame:
    return derive(panel, flock_size=f"{initial_birds} - cum_mort - cum_thinning")


def daily_mortality(panel: DataFrame, initial_birds: int, lag_days: int = 0) -> DataFrame:
    """Deaths of the day as a share of the flock of the day before.

    The first day has no day before, nor has a day after a missing one: NULL. ``lag_days=1``
    gives the value one day late, as the simulation runs export it.
    """
    previous = rederive(
        flock_size(panel, initial_birds),
        _deaths=f"cum_mort - IF(lag(day) {by_day()} = day - 1, lag(cum_mort) {by_day()}, NULL)",
        previous_flock_size=f"IF(lag(day) {by_day()} = day - 1, lag(flock_size) {by_day()}, NULL)",
    )
    rate = rederive(previous, daily_mortality=ratio("_deaths", "previous_flock_size"))
    if lag_days:
        rate = rederive(rate, daily_mortality=f"lag(daily_mortality, {lag_days}) {by_day()}")
    return rederive(rate, percentage_daily_mortality="100 * daily_mortality").drop("_deaths")


def birds_with_signs(panel: DataFrame) -> DataFrame:
    """Birds with respiratory signs of either kind, those with both counted once."""
    return derive(panel, total_resp_signs="RS + B - B_and_RS")


def percent_measures(panel: DataFrame, initial_birds: int) -> DataFrame:
    """The percent measures of the panel; mortality is relative to the initial flock.

    Needs ``daily_mortality``, as ``daily_mortality()`` adds it.
    """
    return derive(
        birds_with_signs(panel),
        percentage_prevalence=ratio("100 * (I0 + I)", "P"),
        percentage_prevalence_secondary=ratio("100 * B", "P"),
        percentage_prevalence_recovered_lesions=ratio("100 * RL", "P"),
        percentage_mortality=ratio("100 * cum_mort", str(initial_birds)),
        percentage_total_resp_signs=ratio("100 * (RS + B - B_and_RS)", "P"),
        percentage_daily_mortality="100 * daily_mortality",
    )


def force_of_infection(panel: DataFrame) -> DataFrame:
    """Infectious birds, and the transmission rate times their share of the flock."""
    return derive(
        panel, infectious="I0 + I", force_of_infection=ratio("beta * (I0 + I)", "P")
    )


# --- alarm, treatment, decisions ---------------------------------------------------


def mortality_alarm(panel: DataFrame) -> DataFrame:
    """Latched alarm: on from the first day that ``daily_mortality`` exceeds the trigger."""
    over = "daily_mortality > treatment_trigger"
    return derive(
        panel,
        alarm=f"coalesce(max(IF({over}, 1, 0)) {so_far()}, 0)",
        alarm_day=f"min(IF({over}, day, NULL)) {whole_flock()}",
    )


def permitted_when(thinning: int | str = "thinning_time", slaughter: int | str = "slaughter_time") -> str:
    """Condition for a treatment to start: not in the days up to and on thinning, nor in the
    last days before slaughter or later."""
    return f"""NOT ((day > {thinning} - {WITHDRAWAL_DAYS} AND day <= {thinning})
        OR day > {slaughter} - {WITHDRAWAL_DAYS})"""


def treatment_day(panel: DataFrame) -> DataFrame:
    """First permitted day with the alarm on, and the flag that drops to 0 from then on."""
    start = f"min(IF(alarm = 1 AND {permitted_when()}, day, NULL)) {whole_flock()}"
    return derive(
        derive(panel, treatment_day=start), not_yet_treated="IF(day >= treatment_day, 0, 1)"
    )


def early_removal(panel: DataFrame, thinning: int, slaughter: int) -> DataFrame:
    """Early thinning or slaughter: planned dates in, decided dates out.

    A flock that may leave early, with the alarm on and no treatment so far, is thinned
    (or else slaughtered) the day after the first such day inside the few days before
    the planned date. At most one of the two happens.
    """
    treated = f"max(IF(alarm = 1 AND {permitted_when(thinning, slaughter)}, 1, 0)) {so_far()}"
    waiting = derive(panel, _waiting=f"early_slaughter = 1 AND alarm = 1 AND {treated} = 0")

    def first_day_before(date: int) -> str:
        near = f"day > {date - WITHDRAWAL_DAYS} AND day < {date}"
        return f"min(IF(_waiting AND {near}, day, NULL)) {whole_flock()}"

    decided = derive(
        waiting, _thin=first_day_before(thinning), _slaughter=first_day_before(slaughter)
    )
    return derive(
        decided,
        thinning_time=f"coalesce(_thin + 1, {thinning})",
        slaughter_time=f"IF(_thin IS NULL, coalesce(_slaughter + 1, {slaughter}), {slaughter})",
    ).drop("_waiting", "_thin", "_slaughter")


def truncate_at_slaughter(panel: DataFrame) -> DataFrame:
    return panel.filter("day <= slaughter_time")


def removal_by_stratum(panel: DataFrame, strata: list[str], number: int) -> DataFrame:
    """Birds to take from each stratum on the thinning day, in proportion to its size.

    One row per flock, thinning day and stratum. Ties in rounding go to the even number.
    """
    classes = ", ".join(f"struct('{s}' AS stratum, {s} AS birds)" for s in strata)
    rows = panel.filter("day = thinning_time").selectExpr(
        *FLOCK, "day", f"{' + '.join(strata)} AS total", f"inline(array({classes}))"
    )
    quota = half_even(ratio(f"birds * {number}D", "total"))
    return derive(rows, removed=f"CAST({quota} AS INT)")


def allocation(strata: DataFrame, number: int, keys: list[str] = FLOCK) -> DataFrame:
    """Birds to take from each stratum so that they add up to ``number``: one row per flock and stratum, with ``removed``.

    ``strata`` has (keys, stratum, birds). Each stratum gives its share rounded down; what is left goes to the largest
    remainders, ties in the order of the names. A flock of fewer birds gives them all.
    """
    total = f"sum(birds) OVER (PARTITION BY {', '.join(keys)})"
    shares = derive(strata, _total=total)
    taken = f"least({number}, _total)"
    parts = derive(shares, _down=f"birds * {taken} DIV _total", _rest=f"birds * {taken} % _total")
    left = derive(
        parts, _left=f"{taken} - sum(_down) OVER (PARTITION BY {', '.join(keys)})",
        _place=f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY _rest DESC, stratum)",
    )
    return left.selectExpr(*keys, "stratum", "birds", "CAST(_down + IF(_place <= _left, 1, 0) AS INT) AS removed")


def removed_birds(birds: DataFrame, number: int, bird: str = "bird", keys: list[str] = FLOCK) -> DataFrame:
    """The birds that thinning takes: (keys, stratum, bird), ``number`` of each flock, in proportion to its strata.

    ``birds`` has a row per bird with its stratum. Which birds go is fixed by the MD5 of the bird's name, so a rerun
    takes the same ones. Strata are counted before the shuffle; the choice is made per flock and stratum.
    """
    strata = birds.groupBy(*keys, "stratum").agg(F.count(F.lit(1)).alias("birds"))
    quota = allocation(strata, number, keys).select(*keys, "stratum", "removed")
    order = f"row_number() OVER (PARTITION BY {', '.join(keys)}, stratum ORDER BY md5(CAST({bird} AS STRING)), {bird})"
    placed = derive(birds.select(*keys, "stratum", bird), _place=order)
    return placed.join(quota, [*keys, "stratum"]).filter("_place <= removed").select(*keys, "stratum", bird)
