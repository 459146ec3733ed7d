"""The streamed alarm against the batch alarm."""

import datetime
import tempfile

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import TimerValues

from broodspark.operators import panel
from broodspark.schema import FLOCK
from broodspark.session import shared_dir
from broodspark.sources import events as feed
from broodspark.streaming import alarm as stream

RULE = stream.AlarmRule(
    feed.INITIAL_BIRDS, feed.TREATMENT_TRIGGER, feed.THINNING_TIME, feed.THINNING_NUMBER
)
SCHEMA = "ts timestamp, scenario string, simu_id long, deaths int"


def run(spark, folder, tmp_path, per_trigger=None, state="state"):
    stream.with_rocksdb(spark)
    reader = spark.readStream.schema(SCHEMA)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    alarms = stream.stream_alarms(
        reader.parquet(folder), RULE, str(feed.FEED_START), feed.FIRST_EVENT_DAY
    )
    output = str(tmp_path / "alarms")
    stream.run_until_drained(alarms, output, str(tmp_path / state))
    return spark.read.schema(alarms.schema).parquet(output)


def batch_alarms(spark, sf_dir):
    raw = feed.derived_panel(feed.read_events(spark, sf_dir)).withColumnRenamed("step", "day")
    alarmed = panel.mortality_alarm(panel.daily_mortality(raw, feed.INITIAL_BIRDS))
    return alarmed.filter("day = alarm_day").select(*FLOCK, "day").collect()


def deaths(spark, sf_dir):
    return feed.read_events(spark, sf_dir).filter("event_type = 'error'").selectExpr(
        "CAST(ts AS TIMESTAMP) AS ts",
        *[f"{e} AS {n}" for n, e in feed.FLOCK_OF_USER.items()],
        "CAST(25 AS INT) AS deaths",
    )


def test_stream_equals_batch_over_several_batches(spark, sf_dir, tmp_path):
    # One file per ten days in order, then a much later row that closes all days.
    rows = deaths(spark, sf_dir)
    folder = str(tmp_path / "feed")
    for first in (1, 11, 21):
        part = rows.filter(F.dayofmonth("ts").between(first, first + 9))
        part.coalesce(1).write.mode("append").parquet(folder)
    late = spark.sql("SELECT TIMESTAMP '2024-03-01' AS ts, 'z' AS scenario, 1 AS simu_id, 1 AS deaths")
    late.coalesce(1).write.mode("append").parquet(folder)
    found = run(spark, folder, tmp_path, per_trigger=1).filter("scenario <> 'z'")
    expected = {tuple(r) for r in batch_alarms(spark, sf_dir)}
    assert {tuple(r) for r in found.select(*FLOCK, "day").collect()} == expected and expected


def feed_rows(spark, rows):
    text = ", ".join(f"(TIMESTAMP '{ts}', 'a', {simu}L, {n})" for ts, simu, n in rows)
    return spark.sql(f"SELECT * FROM VALUES {text} AS t(ts, scenario, simu_id, deaths)")


def test_alarm_latches_and_late_rows_are_dropped(spark, tmp_path):
    folder = str(tmp_path / "feed")
    first = [("2024-01-02 08:00:00", 1, 70), ("2024-01-02 20:00:00", 1, 10)]
    first += [("2024-01-04 08:00:00", 1, 500), ("2024-01-03 01:00:00", 2, 50)]
    feed_rows(spark, first + [("2024-01-10 00:00:00", 3, 1)]).coalesce(1).write.parquet(folder)
    one = run(spark, folder, tmp_path).collect()
    assert [(r["simu_id"], r["day"], r["deaths"]) for r in one] == [(1, 13, 80)]
    # Far behind the watermark: dropped, although it would raise an alarm on time.
    more = [("2024-01-03 02:00:00", 2, 900), ("2024-01-20 00:00:00", 3, 1)]
    feed_rows(spark, more).coalesce(1).write.mode("append").parquet(folder)
    two = run(spark, folder, tmp_path).collect()
    assert sorted(r["simu_id"] for r in two) == [1]


def test_state_is_cleared_after_the_round(spark, tmp_path):
    folder = str(tmp_path / "feed")
    feed_rows(spark, [("2024-01-02 08:00:00", i, 70) for i in range(5)]).coalesce(1).write.parquet(folder)
    feed_rows(spark, [("2024-01-05 08:00:00", 9, 1)]).coalesce(1).write.mode("append").parquet(folder)
    run(spark, folder, tmp_path, per_trigger=1).collect()

    def flocks():
        return spark.read.format("statestore").option("path", str(tmp_path / "state")).option("operatorId", 0).option("stateVarName", "flock").load().count()

    assert flocks() == 5
    # Day 12 is 1 January, so day 42 is 31 January.
    feed_rows(spark, [("2024-02-09 08:00:00", 9, 1)]).coalesce(1).write.mode("append").parquet(folder)
    run(spark, folder, tmp_path, per_trigger=1).collect()
    feed_rows(spark, [("2024-02-19 08:00:00", 9, 1)]).coalesce(1).write.mode("append").parquet(folder)
    run(spark, folder, tmp_path, per_trigger=1).collect()
    assert flocks() == 0


def round_alarms(spark, folder, tmp_path, rounds, rule, name="rounds", **options):
    stream.with_rocksdb(spark)
    alarms = stream.stream_rounds(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder), rounds, rule, **options)
    stream.run_until_drained(alarms, str(tmp_path / f"{name}-out"), str(tmp_path / name))
    return spark.read.schema(alarms.schema).parquet(str(tmp_path / f"{name}-out"))


SMALL = stream.AlarmRule(1000, 0.01, 6, 250, last_day=9)


def batch_rounds(spark, rows, rounds, rule=SMALL):
    """Batch alarm over every day of every round of a feed (ts, scenario, simu_id, deaths)."""
    days = rounds.selectExpr(*FLOCK, "start", f"explode(sequence(0, {rule.last_day})) AS day").selectExpr("*", "date_add(start, day) AS date")
    per_day = rows.groupBy(*FLOCK, F.to_date("ts").alias("date")).agg(F.sum("deaths").alias("n"))
    named = days.join(per_day, [*FLOCK, "date"], "left").fillna(0, "n").withColumn("scenario", F.concat_ws("|", "scenario", "start"))
    so_far = "OVER (PARTITION BY scenario, simu_id ORDER BY day)"
    counted = named.selectExpr(
        *FLOCK, "day", f"CAST(sum(n) {so_far} AS BIGINT) AS cum_mort",
        f"IF(day >= {rule.thinning_time}, {rule.thinning_number}, 0) AS cum_thinning", f"{rule.trigger}D AS treatment_trigger",
    )
    alarmed = panel.mortality_alarm(panel.daily_mortality(counted, rule.initial_birds))
    return {tuple(r) for r in alarmed.filter("day = alarm_day").select(*FLOCK, "day").collect()}


def two_rounds(spark, tmp_path):
    """Forty days of deaths of five flocks; each has two rounds of ten days, at its own dates."""
    rows = spark.range(200).selectExpr(
        "timestampadd(HOUR, CAST(id % 24 AS INT), timestampadd(DAY, CAST(id DIV 5 AS INT), TIMESTAMP '2024-01-01')) AS ts",
        "'a' AS scenario", "id % 5 AS simu_id", "CAST(IF(hash(id) % 5 = 0, 25, abs(hash(id)) % 7) AS INT) AS deaths",
    )
    rounds = spark.range(10).selectExpr("'a' AS scenario", "id % 5 AS simu_id", "date_add(DATE '2024-01-02', CAST(id % 5 + 15 * (id DIV 5) AS INT)) AS start")
    folder = str(tmp_path / "feed")
    for first in (1, 15, 26):
        last = {1: 14, 15: 25, 26: 40}[first]
        rows.filter(F.date_diff("ts", F.lit("2023-12-31")).between(first, last)).coalesce(1).write.mode("append").parquet(folder)
    late = spark.sql("SELECT TIMESTAMP '2024-05-01' AS ts, 'z' AS scenario, 1L AS simu_id, 1 AS deaths")
    late.coalesce(1).write.mode("append").parquet(folder)
    return rows, rounds, folder


def test_rounds_of_a_flock_equal_batch(spark, tmp_path):
    rows, rounds, folder = two_rounds(spark, tmp_path)
    assert stream.overlapping_rounds(rounds, SMALL).count() == 0
    found = round_alarms(spark, folder, tmp_path, rounds, SMALL)
    expected = batch_rounds(spark, rows, rounds)
    assert {(f"{r.scenario}|{r.start}", r.simu_id, r.day) for r in found.collect()} == expected
    assert len({(s.split("|")[1], i) for s, i, _ in expected}) > 5, "alarms in both rounds"
    closer = rounds.union(spark.sql("SELECT 'a', 0L, DATE '2024-01-11'"))
    assert sorted(str(r.start) for r in stream.overlapping_rounds(closer, SMALL).collect()) == ["2024-01-11", "2024-01-17"]


def test_rounds_go_on_from_a_batch_state(spark, tmp_path):
    rows, rounds, folder = two_rounds(spark, tmp_path)
    expected = batch_rounds(spark, rows, rounds)
    # The batch job knows the days up to 7 January; the feed begins on the 8th.
    cut = "2024-01-08"
    early = batch_rounds(spark, rows.filter(F.col("ts") < cut), rounds)
    begun = rounds.filter(F.col("start") < cut).join(rows.filter(F.col("ts") < cut), FLOCK, "left").groupBy(*FLOCK, "start").agg(
        F.coalesce(F.sum(F.when(F.to_date("ts") >= F.col("start"), F.col("deaths"))), F.lit(0)).alias("cum_mort")
    )
    names = [(s, i) for s, i, _ in early]
    known = spark.createDataFrame([(s.split("|")[0], i, s.split("|")[1]) for s, i in names] or [("", 0, "2024-01-01")], "scenario string, simu_id long, start string")
    begun = begun.join(known.selectExpr("scenario", "simu_id", "CAST(start AS DATE) AS start", "true AS alarmed"), [*FLOCK, "start"], "left").fillna(False, "alarmed")
    rest = str(tmp_path / "rest")
    spark.read.schema(SCHEMA).parquet(folder).filter(F.col("ts") >= cut).coalesce(1).write.parquet(rest)
    later = round_alarms(spark, rest, tmp_path, rounds, SMALL, name="later", begun=begun)
    found = {(f"{r.scenario}|{r.start}", r.simu_id, r.day) for r in later.collect()}
    assert early and found | early == expected and not found & early


class Handle:
    """State and timers of one round, and how often they were asked."""

    def __init__(self) -> None:
        self.value, self.timers, self.calls = None, set(), []

    def getValueState(self, name, schema):
        return self

    def exists(self):
        self.calls.append("exists")
        return self.value is not None

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None

    def registerTimer(self, at):
        self.calls.append("timer")
        self.timers.add(at)


KEY = ("a", 1, datetime.date(2024, 1, 2))
DAYS = [(0, 300), (3, 5), (1, 6), (2, None), (4, 7), (7, 4), (8, 5)]


def follow(handle, days, watermark=0):
    """Alarms of the round KEY from days that arrive in one batch."""
    processor = stream.LatchedAlarm(SMALL, 0)
    processor.init(handle)
    rows = iter([Row(scenario="a", simu_id=1, start=KEY[2], day=day, deaths=n) for day, n in days])
    return [tuple(r) for r in processor.handleInputRows(KEY, rows, TimerValues(0, watermark))]


def test_a_round_costs_a_few_state_calls_and_no_data_frame():
    """A feed has a million rounds: each is followed with plain rows, and one that has ended is not written."""
    handle = Handle()
    # 300 of 1,000 are dead before day 1; 6 and 5 are below a hundredth of 700 and 694, 7 of 689 are not.
    assert follow(handle, DAYS) == [(*KEY, 4, 7, 7 / 689)]
    assert handle.value == (327, True) and len(handle.timers) == 1
    assert handle.calls == ["exists", "update", "timer"]
    assert follow(handle, [(9, 600)]) == [], "latched"
    assert handle.value == (927, True) and handle.calls[3:] == ["exists", "get", "update", "timer"]
    end = handle.timers.pop()
    late = Handle()
    assert follow(late, DAYS, watermark=end) == [(*KEY, 4, 7, 7 / 689)]
    assert late.calls == ["exists"] and late.value is None
    begun = Handle()
    assert follow(begun, DAYS[:1]) == [] and follow(begun, DAYS[1:], watermark=end) == [(*KEY, 4, 7, 7 / 689)]
    assert begun.calls[3:] == ["exists", "get", "clear"] and begun.value is None


def test_no_birds_left_and_days_across_batches():
    assert follow(Handle(), [(0, 1000), (1, 5)]) == [], "no birds, no share"
    # Thinned on day 6, so from day 7 on 250 birds fewer: 8 of 750 are over, of 1,000 they are not.
    assert follow(Handle(), [(6, 8)]) == [] and follow(Handle(), [(7, 8)]) == [(*KEY, 7, 8, 8 / 750)]
    for cut in range(len(DAYS) + 1):
        handle, days = Handle(), sorted(DAYS)
        assert follow(handle, days[:cut]) + follow(handle, days[cut:]) == [(*KEY, 4, 7, 7 / 689)]
        assert handle.value == (327, True)


def test_of_several_rows_of_a_begun_round_the_first_counts():
    handle, processor = Handle(), stream.LatchedAlarm(SMALL, 0)
    processor.init(handle)
    for n in (50, 90):
        processor.handleInitialState(KEY, Row(scenario="a", simu_id=1, start=KEY[2], cum_mort=n, alarmed=False), TimerValues(0, 0))
    assert handle.value == (50, False) and len(handle.timers) == 1


def test_a_flock_without_number_leaves_the_others_alone(spark, tmp_path):
    folder = str(tmp_path / "feed")
    rows = spark.sql("SELECT TIMESTAMP '2024-01-02 08:00:00' AS ts, 'a' AS scenario, IF(id = 0, NULL, id) AS simu_id, 70 AS deaths FROM range(41)")
    rows.coalesce(1).write.parquet(folder)
    feed_rows(spark, [("2024-01-10 00:00:00", 99, 1)]).coalesce(1).write.mode("append").parquet(folder)
    found = run(spark, folder, tmp_path).collect()
    assert sorted((r["simu_id"] or 0, r["day"]) for r in found) == [(i, 13) for i in range(41)]


def test_nothing_after_the_last_day(spark, tmp_path):
    folder = str(tmp_path / "feed")
    # Day 12 is 1 January, so day 42 is 31 January; an alarm before, and many deaths long after.
    feed_rows(spark, [("2024-01-02 08:00:00", 1, 70), ("2024-02-20 08:00:00", 1, 900)]).coalesce(1).write.parquet(folder)
    feed_rows(spark, [("2024-03-20 08:00:00", 2, 900), ("2024-05-20 08:00:00", 9, 1)]).coalesce(1).write.mode("append").parquet(folder)
    assert [(r["simu_id"], r["day"]) for r in run(spark, folder, tmp_path, per_trigger=1).collect()] == [(1, 13)]


class Session:
    """The two things that ``shared_dir`` asks a session for."""

    def __init__(self, master: str, **conf: str) -> None:
        self.conf = conf
        self.sparkContext = type("Context", (), {"master": master})


def test_shared_dir_follows_the_session(spark):
    cluster = Session("yarn", **{"spark.checkpoint.dir": "hdfs:///shared/"})
    first, second = shared_dir(cluster, "x"), shared_dir(cluster, "x")
    assert first.startswith("hdfs:///shared/x-") and first != second
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session("yarn"), "x")
    assert shared_dir(Session("local[2]"), "x").startswith(tempfile.gettempdir())
