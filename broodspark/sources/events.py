"""Daily panel and entry log from an event feed (one row per event of one flock).

The feed stands in for simulation output: event types are read as entries into states,
with fixed numbers of birds per event. Every count is an integer.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession

from broodspark.functions.frames import by_day, derive, last_days, named, so_far, whole_flock
from broodspark.functions.missing import ratio
from broodspark.operators.grids import DURATION_RESP_SIGNS, DURATIONS, derive_parameters
from broodspark.operators.panel import percent_measures, permitted_when
from broodspark.schema import COUNTS_SCHEMA, FLOCK, LAST_DAY

# Fixed values of the derived panel.
FEED_START = datetime.date(2024, 1, 1)
FIRST_EVENT_DAY = 12
SCENARIOS = 6
BIRDS_PER_EVENT = {"click": 100, "purchase": 40, "error": 25, "view": 20}
ENTRY_NAMES = {"click": "new_i", "purchase": "new_b", "error": "new_d", "view": "new_s"}
INITIAL_BIRDS = 30000
THINNING_NUMBER = 7500
THINNING_TIME = 34
SLAUGHTER_TIME = 42
TREATMENT_TRIGGER = 0.002
INTRODUCTION_TIME = 14
ENTRIES = ["new_i", "new_b", "new_d", "new_s"]

FLOCK_OF_USER = {
    "scenario": f"CAST(user_id % {SCENARIOS} AS STRING)",
    "simu_id": f"user_id DIV {SCENARIOS}",
}

EVENTS_SCHEMA = (
    "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
)


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed; with the schema given, no file is opened to plan a query."""
    return spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet")


def entry_log(
    events: DataFrame, start: datetime.date = FEED_START, first_day: int = FIRST_EVENT_DAY
) -> DataFrame:
    """(scenario, simu_id, day, state): one row per entry of a bird group into a state.

    The date ``start`` is day ``first_day`` of every flock.
    """
    day = f"date_diff(CAST(ts AS DATE), DATE '{start}') + {first_day}"
    return events.selectExpr(*named(FLOCK_OF_USER), f"{day} AS day", "event_type AS state")


def daily_entries(log: DataFrame) -> DataFrame:
    """Birds entering each state per flock and day, only days with events.

    The count is combined on the map side, so a flock with a third of all events still
    sends at most one row per day and task through the exchange.
    """
    entered = [
        f"{birds} * count_if(state = '{event}') AS {ENTRY_NAMES[event]}"
        for event, birds in BIRDS_PER_EVENT.items()
    ]
    return log.sparkSession.sql(
        f"SELECT {', '.join(FLOCK)}, day, {', '.join(entered)} FROM {{log}} "
        f"GROUP BY {', '.join(FLOCK)}, day",
        log=log,
    )


def on_every_day(
    daily: DataFrame, columns: list[str], first: int = 0, last: int = LAST_DAY
) -> DataFrame:
    """Fill the days without rows with zeros, for every flock, from ``first`` to ``last``.

    Each row spreads over the days up to the next row of its flock; no spine join. Rows outside
    the days keep their flock in the result, as a row before the first day, but do not count;
    ``outside_days`` gives them out.
    """
    placed = derive(daily.withColumnRenamed("day", "_event_day"), day=f"IF(_event_day BETWEEN {first} AND {last}, _event_day, {first - 1})")
    rows = placed.selectExpr(
        *FLOCK, "day AS _event_day", *columns,
        f"IF(row_number() {by_day()} = 1, {first}, greatest(day, {first})) AS _from",
        f"lead(day, 1, {last + 1}) {by_day()} - 1 AS _until",
    ).filter("_until >= _from")
    return derive(rows, day="explode(sequence(_from, _until))").selectExpr(
        *FLOCK, "day", *[f"IF(day = _event_day, {c}, 0) AS {c}" for c in columns]
    )


def outside_days(daily: DataFrame, first: int = 0, last: int = LAST_DAY) -> DataFrame:
    """The rows that ``on_every_day`` does not count, with the rule they break."""
    outside = daily.filter(f"day IS NULL OR day NOT BETWEEN {first} AND {last}")
    return derive(outside, rule=f"IF(day IS NULL, 'no_day', IF(day < {first}, 'before_first_day', 'after_last_day'))")


def derived_panel(
    events: DataFrame, truncate: bool = True,
    start: datetime.date = FEED_START, first_day: int = FIRST_EVENT_DAY,
) -> DataFrame:
    """The counts table of the raw schema, plus ``scenario``, built from the feed.

    Days 0 to 42 count, from a feed whose date ``start`` is day ``first_day``. Every flock of
    the feed is in the panel, also one whose events all lie outside.
    """
    entries = on_every_day(daily_entries(entry_log(events, start, first_day)), ENTRIES)
    dwell, reduced = DURATIONS["time_before_reduced_growth"], DURATIONS["duration_reduced_growth"]
    counted = derive(
        entries,
        cum_I=f"sum(new_i) {so_far()}",
        cum_B=f"sum(new_b) {so_far()}",
        cum_mort=f"sum(new_d) {so_far()}",
        NGi=f"sum(new_i) {last_days(dwell)}",
        RGi=f"coalesce(sum(new_i) {last_days(reduced, skip=dwell)}, 0)",
        B=f"sum(new_b) {last_days(DURATIONS['length_B'])}",
        RS=f"sum(new_s) {last_days(DURATION_RESP_SIGNS)}",
    )
    # Deaths of the day against the flock of the day before, planned thinning included.
    birds_before = f"""({INITIAL_BIRDS} - (cum_mort - new_d)
        - IF(day - 1 >= {THINNING_TIME}, {THINNING_NUMBER}, 0))"""
    over_trigger = f"day > 0 AND new_d > {TREATMENT_TRIGGER}D * {birds_before}"
    alarmed = derive(
        counted,
        alarm=f"min(IF({over_trigger}, day, NULL)) {whole_flock()}",
        early_slaughter="IF(CAST(scenario AS INT) >= 3, 1, 0)",
        vaccination_scenario="(CAST(scenario AS INT) % 3) / 2D",
    )

    def early(date: int) -> str:
        return f"IF(early_slaughter = 1 AND alarm BETWEEN {date - 4} AND {date - 1}, alarm + 1, {date})"

    dated = derive(
        alarmed, thinning_time=early(THINNING_TIME), slaughter_time=early(SLAUGHTER_TIME)
    )
    flagged = derive(
        dated,
        treatment_allowed=f"IF({permitted_when()}, 1, 0)",
        treatment_triggered="IF(day >= alarm, 1, 0)",
        cum_thinning=f"IF(day >= thinning_time, {THINNING_NUMBER}, 0)",
        previous_flock_size=f"""IF(day > 0, {INITIAL_BIRDS} - (cum_mort - new_d)
            - IF(day > thinning_time, {THINNING_NUMBER}, 0), 0)""",
    )
    sized = derive(
        flagged,
        not_yet_treated=f"1 - max(treatment_allowed * treatment_triggered) {so_far()}",
        P=f"{INITIAL_BIRDS} - cum_mort - cum_thinning",
        I0="0",
        I="NGi + RGi",
        RL="cum_B - B",
        B_and_RS="0",
        daily_mortality="IF(day > 0, " + ratio("new_d", "previous_flock_size") + ", NULL)",
        prop_bact_factor="1D",
        introduction_time=str(INTRODUCTION_TIME),
        treatment_trigger=f"{TREATMENT_TRIGGER}D",
    )
    kept = sized.filter("day <= slaughter_time") if truncate else sized
    measured = percent_measures(derive_parameters(kept, given=[]), initial_birds=INITIAL_BIRDS)
    constant = {
        "step": "day",
        "level": "'population'",
        "agent_id": "0",
        "De": "0",
        "NGr": "0",
        "RGb": "B",
        "NG": "P - NGi - RGi - B",
    }
    return measured.selectExpr(
        "scenario",
        *[
            f"CAST({constant.get(field.name, field.name)} AS {field.dataType.simpleString()}) "
            f"AS {field.name}"
            for field in COUNTS_SCHEMA.fields
        ],
    )


def healthy_production(spark: SparkSession) -> DataFrame:
    """Synthetic growth and feed of healthy birds, one row per day (grams per bird)."""
    return spark.range(LAST_DAY + 1, numPartitions=1).selectExpr(
        "CAST(id AS INT) AS day", "13 + id * 2.6D AS healthy_DG", "10 + id * 4D AS healthy_intake"
    )
