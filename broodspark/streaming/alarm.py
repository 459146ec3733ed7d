"""Mortality alarm on an unbounded feed of deaths, one latched alarm per flock or per round of a flock."""

from __future__ import annotations

import datetime
import sys
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from broodspark.schema import FLOCK

# Send the processor with the query: the workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ALARM_SCHEMA = "scenario string, simu_id long, day int, deaths long, daily_mortality double"
ROUND = [*FLOCK, "start"]
ROUND_ALARM_SCHEMA = "scenario string, simu_id long, start date, day int, deaths long, daily_mortality double"
STATE_SCHEMA = "cum_mort long, alarmed boolean"


@dataclass(frozen=True)
class AlarmRule:
    """When to raise the alarm. One thinning date holds for all flocks, so it fits flocks that are not
    thinned early before their first alarm. After day ``last_day`` a flock is gone and forgotten."""

    initial_birds: int
    trigger: float
    thinning_time: int
    thinning_number: int
    last_day: int = 42


def deaths_per_day(feed: DataFrame, lateness: str) -> DataFrame:
    """Deaths per flock and calendar day of a feed (ts, scenario, simu_id, deaths).

    Rows later than the watermark are dropped. Deaths are added up before the exchange, so
    a flock with much of the feed sends one row per day and task.
    """
    return (
        feed.withWatermark("ts", lateness)
        .groupBy(*FLOCK, F.window("ts", "1 day"))
        .agg(F.sum("deaths").alias("deaths"))
    )


class LatchedAlarm(StatefulProcessor):
    """Remembers the deaths of a flock so far; emits the first day over the trigger.

    A day has at most one row per flock, so the processor sees few rows; the adding up is
    done before it. A timer clears the flock when the watermark passes the end of its round.
    """

    def __init__(self, rule: AlarmRule, first_day: int, start: datetime.date | None = None) -> None:
        """``start`` is the date of ``first_day`` of all flocks; without it the third part of the key is."""
        self.rule, self.first_day, self.start = rule, first_day, start

    def end_ms(self, key: tuple) -> int:
        """When the flock is gone: the watermark has passed its last day."""
        start = self.start or key[2]
        day = datetime.datetime(start.year, start.month, start.day, tzinfo=datetime.UTC)
        return int((day + datetime.timedelta(days=self.rule.last_day + 2 - self.first_day)).timestamp() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flock = handle.getValueState("flock", STATE_SCHEMA)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timer_values: TimerValues) -> Iterator[Row]:
        # Plain rows and numbers: a round has few days, and a data frame for each round costs more than the rest of the stream.
        rule, known, over = self.rule, self.flock.exists(), None
        cum_mort, alarmed = self.flock.get() if known else (0, False)
        for day, deaths in sorted((row["day"], row["deaths"]) for row in rows if row["deaths"] is not None):
            birds = rule.initial_birds - (rule.thinning_number if day - 1 >= rule.thinning_time else 0) - cum_mort
            if not alarmed and day > 0 and birds != 0 and deaths / birds > rule.trigger:
                alarmed = True
                over = Row(**dict(zip(ROUND, key, strict=False)), day=day, deaths=deaths, daily_mortality=deaths / birds)
            cum_mort += deaths
        if not self.has_ended(key, timer_values):
            self.keep(key, cum_mort, alarmed)
        elif known:  # a feed that holds several rounds at once: nothing of this one is needed any more
            self.flock.clear()
        if over:
            yield over

    def has_ended(self, key: tuple, timer_values: TimerValues) -> bool:
        return timer_values.getCurrentWatermarkInMs() >= self.end_ms(key)

    def keep(self, key: tuple, cum_mort: int, alarmed: bool) -> None:
        self.flock.update((cum_mort, alarmed))
        self.handle.registerTimer(self.end_ms(key))

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: TimerValues) -> None:
        """What a batch job found of a round that began before the stream: deaths so far, and whether the alarm was raised."""
        if not self.has_ended(key, timerValues) and not self.flock.exists():  # of several rows of a round, the first
            self.keep(key, int(initialState["cum_mort"]), bool(initialState["alarmed"]))

    def handleExpiredTimer(
        self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo
    ) -> Iterator[Row]:
        self.flock.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_alarms(
    feed: DataFrame, rule: AlarmRule, first_day: str, offset: int = 0, lateness: str = "1 day"
) -> DataFrame:
    """First day per flock on which deaths exceed the trigger share of the flock before.

    ``first_day`` is the calendar date of day ``offset``. A day is judged once the watermark
    has passed it, and the days of one flock are judged in order. Days after the last day belong to no flock and
    raise nothing. The chained state needs the RocksDB state store (``with_rocksdb``). State is cleared when the
    watermark is a day past the last day.
    """
    day = F.date_diff(F.to_date(F.col("window.start")), F.to_date(F.lit(first_day))) + offset
    closed = deaths_per_day(feed, lateness).select(
        *FLOCK, F.window_time("window").alias("closed"), day.alias("day"), "deaths"
    ).filter(F.col("day") <= rule.last_day)
    return closed.groupBy(*FLOCK).transformWithState(
        LatchedAlarm(rule, offset, datetime.date.fromisoformat(first_day)), ALARM_SCHEMA, "append", "eventTime"
    )


def stream_rounds(
    feed: DataFrame, rounds: DataFrame, rule: AlarmRule, first_day: int = 0, lateness: str = "1 day",
    begun: DataFrame | None = None,
) -> DataFrame:
    """The same for flocks with rounds of their own: the first day per round over the trigger.

    ``rounds`` has (scenario, simu_id, start): ``start`` is the date of ``first_day`` of that round. Each round has a state of its own and
    a timer that clears it once the watermark has passed its last day. Deaths on days of no round raise nothing, so a late
    feed cannot raise an alarm again. Rounds of one flock must not overlap (``overlapping_rounds``).

    ``begun`` hands over rounds that a batch job has followed so far: (scenario, simu_id, start, cum_mort, alarmed), deaths up
    to the day before the feed begins.
    """
    deaths = deaths_per_day(feed, lateness).select(
        *FLOCK, F.window_time("window").alias("closed"), F.to_date("window.start").alias("date"), "deaths"
    )
    day = F.date_diff("date", "start") + first_day
    placed = deaths.join(rounds.select(*ROUND), FLOCK).withColumn("day", day).filter(F.col("day").between(first_day, rule.last_day))
    state = begun.select(*ROUND, "cum_mort", "alarmed").groupBy(*ROUND) if begun is not None else None
    return placed.select(*ROUND, "closed", "day", "deaths").groupBy(*ROUND).transformWithState(
        LatchedAlarm(rule, first_day), ROUND_ALARM_SCHEMA, "append", "eventTime", initialState=state
    )


def overlapping_rounds(rounds: DataFrame, rule: AlarmRule, first_day: int = 0) -> DataFrame:
    """Rounds that begin before the one before them has ended: (scenario, simu_id, start, previous)."""
    length = rule.last_day - first_day
    before = rounds.selectExpr(*ROUND, "lag(start) OVER (PARTITION BY scenario, simu_id ORDER BY start) AS previous")
    return before.filter(f"date_diff(start, previous) <= {length}")


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """Session setting for the state store that chained state needs."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    return spark


def run_until_drained(stream: DataFrame, output: str, checkpoint: str) -> None:
    """Work off what the source holds now, write Parquet, and stop."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
