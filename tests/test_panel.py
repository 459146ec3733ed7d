"""Panel and log operators against plain loops, and invariants of the derived panel."""

import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F
from toys import counts, flock

from broodspark.functions.frames import derive
from broodspark.operators import daily, outcomes, panel, production, quality
from broodspark.schema import FLOCK
from broodspark.sources import events as feed


@pytest.fixture(scope="module")
def days(spark, sf_dir):
    table = production.production_table(feed.healthy_production(spark))
    raw = feed.derived_panel(feed.read_events(spark, sf_dir))
    return daily.interpret(raw, table).cache()


def test_shares_add_up_and_weight_never_falls(days):
    assert days.filter("p_tot <> 1 OR abs(p_lesions + p_no_lesions - 1) > 1e-12").count() == 0
    lighter = derive(
        days, _before="lag(weight_per_bird) OVER (PARTITION BY scenario, simu_id ORDER BY day)"
    )
    assert lighter.filter("weight_per_bird < _before").count() == 0


def test_one_start_of_treatment_and_one_outcome_per_flock(days):
    starts = days.groupBy(*FLOCK).agg(F.sum("treatment_start").alias("n"))
    assert starts.filter("n > 1").count() == 0
    found = outcomes.per_simulation(days)
    assert found.count() == days.select(*FLOCK).distinct().count()
    off = "abs(delta - (weight_revenue - feed_cost - treatment_cost - vaccination_cost)) > 1e-6"
    assert found.filter(off).count() == 0


def test_single_pass_equals_joined_form(days):
    single = outcomes.per_simulation(days)
    joined = outcomes.per_simulation_joined(days).select(single.columns)
    assert single.exceptAll(joined).count() == 0 and joined.exceptAll(single).count() == 0


def test_every_day_filled_per_flock(spark):
    rows = [("a", 1, 3, 5), ("a", 1, 4, 6), ("a", 2, 0, 7), ("b", 1, 6, 8)]
    sparse = spark.createDataFrame(rows, "scenario string, simu_id int, day int, n int")
    dense = feed.on_every_day(sparse, ["n"], 0, 6)
    found = {tuple(r)[:3]: r["n"] for r in dense.collect()}
    assert len(found) == 21 and dense.count() == 21
    given = {r[:3]: r[3] for r in rows}
    assert all(found[k] == given.get(k, 0) for k in found)


def stays(spark, seed=3):
    chance = random.Random(seed)
    rows = [
        (str(chance.randrange(2)), chance.randrange(3), chance.randrange(20), chance.randrange(1, 9))
        for _ in range(60)
    ]
    rows += [("0", 0, 5, 1)] * 200  # one flock and day with most of the entries
    return rows, spark.createDataFrame(rows, "scenario string, simu_id int, day int, n int")


@pytest.mark.parametrize("share", [1, 0.75])
@pytest.mark.parametrize("escape", [None, 0, 5, 9, 30])
@pytest.mark.parametrize("after", [0, 3])
def test_occupancy_from_log_day_by_day(spark, escape, share, after):
    """Each day: birds whose time is up leave, those that are there are treated, then birds enter."""
    rows, log = stays(spark)
    expected, there = {}, {}
    for today in range(21):
        for key, groups in list(there.items()):
            groups = [(end, n) for end, n in groups if end > today]
            if today == escape:
                groups = [(end, n * (1 - share)) for end, n in groups]
            there[key] = groups
        for scenario, simu, day, n in rows:
            if day + after == today:
                there.setdefault((scenario, simu), []).append((today + 4, n))
        for key, groups in there.items():
            if sum(n for _, n in groups) > 0:
                expected[*key, today] = sum(n for _, n in groups)
    with_exit = derive(log, out="NULL" if escape is None else str(escape))
    found = panel.occupancy_from_log(with_exit, 4, 20, exit_day="out", share=share, after=after)
    assert {tuple(r)[:3]: pytest.approx(r["present"]) for r in found.collect()} == expected
    if escape is None:
        plain = panel.occupancy_from_log(log, 4, 20, after=after)
        assert {tuple(r)[:3]: r["present"] for r in plain.collect()} == expected


def test_every_flock_stays_whatever_its_days(spark, sf_dir):
    events = feed.read_events(spark, sf_dir).selectExpr(
        "event_id", "ts + IF(user_id = 3, INTERVAL 90 DAYS, INTERVAL 0 DAYS) AS ts", "user_id", "event_type", "value", "props"
    )
    logged = feed.daily_entries(feed.entry_log(events))
    dense = feed.on_every_day(logged, feed.ENTRIES)
    flocks = logged.select(*FLOCK).distinct().count()
    assert dense.count() == 43 * flocks == dense.select(*FLOCK, "day").distinct().count()
    late = feed.outside_days(logged)
    assert {(r["scenario"], r["simu_id"], r["rule"]) for r in late.collect()} == {("3", 0, "after_last_day")}
    panel_rows = feed.derived_panel(events)
    assert panel_rows.select(*FLOCK).distinct().count() == flocks
    moved = feed.derived_panel(events, start=feed.FEED_START + datetime.timedelta(days=90))
    assert moved.filter("scenario = '3' AND simu_id = 0 AND cum_I > 0").count() > 0

    import duckdb

    from checks.sqltext import over

    con = duckdb.connect()
    con.register("events_frame", events.toPandas())
    con.execute("CREATE VIEW events AS SELECT * FROM events_frame")
    theirs = set(con.execute(over("SELECT scenario, simu_id, step, cum_I, B, P FROM panel")).fetchall())
    ours = {tuple(r) for r in panel_rows.select(*FLOCK, "step", "cum_I", "B", "P").collect()}
    assert ours == theirs


def test_a_very_large_count_does_not_overflow(spark):
    log = spark.range(3).selectExpr("'a' AS scenario", "1L AS simu_id", "3 AS day", "'click' AS state")
    one = feed.daily_entries(log).selectExpr("scenario", "simu_id", "day", "new_i * 1000000000 AS new_i", "new_b", "new_d", "new_s")
    total = panel.cumulative_entries(feed.on_every_day(one, ["new_i"]), {"new_i": "cum_I"})
    assert total.agg({"cum_I": "max"}).first()[0] == 300_000_000_000


def test_mortality_after_a_missing_day_is_missing(spark):
    rows = [r for r in flock(5, cum_mort=lambda d: 10 * d) if r["step"] != 2]
    rated = panel.daily_mortality(counts(spark, rows).withColumnRenamed("step", "day"), 1000)
    known = {r["day"]: r["daily_mortality"] is not None for r in rated.collect()}
    assert known == {0: False, 1: True, 3: False, 4: True}


def test_dwell_equals_occupancy_from_log(spark, sf_dir):
    entries = feed.daily_entries(feed.entry_log(feed.read_events(spark, sf_dir)))
    full = feed.on_every_day(entries, feed.ENTRIES)
    window = panel.dwell_occupancy(full, {"present": ("new_b", 14)}).filter("present > 0")
    log = entries.filter("new_b > 0").selectExpr(*FLOCK, "day", "new_b AS n")
    other = panel.occupancy_from_log(log, 14, last_day=42)
    keys = [*FLOCK, "day", "present"]
    assert window.select(keys).exceptAll(other.select(keys)).count() == 0
    assert window.count() == other.count() > 0


def test_removal_follows_the_strata(spark):
    rows = flock(35, P=100, NG=50, NGi=25, RGi=15, RGb=10)
    raw = counts(spark, rows).withColumnRenamed("step", "day")
    removed = panel.removal_by_stratum(raw, ["NG", "NGi", "RGi", "RGb"], 30).collect()
    # 4.5 and 7.5 are ties and go to the even neighbour.
    assert {r["stratum"]: r["removed"] for r in removed} == {
        "NG": 15, "NGi": 8, "RGi": 4, "RGb": 3,
    }


def test_quality_rules_find_bad_rows(spark):
    good = flock(4, cum_mort=lambda d: d)
    bad = flock(4, simu_id=2, cum_mort=lambda d: 3 - d, NG=lambda d: 100 if d else 99)
    raw = counts(spark, good + bad + good[:1]).withColumnRenamed("step", "day")
    found = sorted(tuple(r) for r in quality.panel_violations(raw).collect())
    assert ("1", 1, 0, "duplicate_day") in found and ("1", 2, 0, "shares") in found
    assert [r[3] for r in found].count("cum_mort_falls") == 3 and len(found) == 5
    holes = flock(6, NG=lambda d: None if d == 1 else 100, cum_B=lambda d: None if d == 3 else 0)
    holes = [r for r in holes if r["step"] != 4]
    raw = counts(spark, holes).withColumnRenamed("step", "day")
    found = sorted(tuple(r)[2:] for r in quality.panel_violations(raw).collect())
    assert found == [(1, "NG_missing"), (3, "cum_B_missing"), (5, "missing_day")]
    partly = quality.varying_inputs(counts(spark, flock(3, recovery=lambda d: 0.1 if d else None))).collect()
    assert [(r["input"], r["n_missing"]) for r in partly] == [("recovery", 1)]
    varying = quality.varying_inputs(
        counts(spark, flock(2, beta=lambda d: 0.1 * d) + flock(2, scenario="2"))
    )
    assert [(r["scenario"], r["input"]) for r in varying.collect()] == [("1", "beta")]


def test_parameter_rules(spark):
    table = spark.sql(
        """SELECT * FROM VALUES (1, 0.0014D, 'middle', '0.374', -0.05D, 30000D),
           (2, 1.5D, '', 'dear', 0.1D, 30000.5D), (3, NULL, NULL, NULL, -0.2D, 30000.0000000001D)
           AS t(id, DOA, growth_factor, feed_price, DG_change_IB, n_birds)"""
    )
    rules = {c: quality.ECONOMIC_RULES[c] for c in ("DOA", "growth_factor", "feed_price", "DG_change_IB")}
    rules |= {"n_birds": quality.Rule("integer"), "slaughter_price": quality.Rule("numeric")}
    found = quality.parameter_violations(table, rules, ["id"]).collect()
    problems = {(r["id"], r["parameter"]): r["problem"] for r in found}
    assert problems == {
        (2, "DOA"): "above 1", (2, "growth_factor"): "empty", (2, "feed_price"): "not numeric",
        (1, "feed_price"): "not numeric", (2, "DG_change_IB"): "above 0", (2, "n_birds"): "not an integer",
        (3, "DOA"): "missing", (3, "growth_factor"): "missing", (3, "feed_price"): "missing",
        (1, "slaughter_price"): "column is absent", (2, "slaughter_price"): "column is absent",
        (3, "slaughter_price"): "column is absent",
    }


def test_list_rules(spark):
    table = spark.sql(
        """SELECT 1 AS id, array(0.5D) AS sens_condemnation, array('low', 'high') AS sens_growth
           UNION ALL SELECT 2, array(), array('low', NULL)"""
    )
    rules = {"sens_condemnation": quality.Rule("numeric"), "sens_growth": quality.Rule("text")}
    found = quality.list_violations(table, rules, ["id"]).collect()
    assert {(r["id"], r["parameter"], r["problem"]) for r in found} == {
        (2, "sens_condemnation", "fewer than 1 elements"), (2, "sens_growth", "missing"),
    }


def test_birds_by_day_equals_the_wide_form(spark):
    rnd = random.Random(4)
    stays = [
        ("s", f, bird, rnd.choice(["signs", "bacterial", "other"]), day, rnd.choice([day - 1, day, day + rnd.randrange(9), None]))
        for f in range(3) for bird in range(12) for _ in range(rnd.randrange(4)) for day in [rnd.randrange(-4, 24)]
    ]
    frame = spark.createDataFrame(stays, "scenario string, simu_id long, bird int, dimension string, from_day int, until_day int")
    found = {(r.simu_id, r.day): (r.RS, r.B, r.B_and_RS, r.total_resp_signs) for r in panel.birds_by_day(frame, 0, 20).collect()}

    def inside(flock, bird, kind, day):
        return any(s[1:4] == (flock, bird, kind) and s[4] <= day <= (99 if s[5] is None else s[5]) for s in stays)

    flocks = {s[1] for s in stays if s[3] != "other" and s[4] <= 20 and (s[5] is None or s[5] >= max(0, s[4]))}
    expected = {}
    for flock in flocks:
        for day in range(21):
            seen = [(inside(flock, b, "signs", day), inside(flock, b, "bacterial", day)) for b in range(12)]
            expected[flock, day] = (sum(a for a, _ in seen), sum(b for _, b in seen), sum(a and b for a, b in seen), sum(a or b for a, b in seen))
    assert found == expected
    wide = panel.birds_with_signs(panel.birds_by_day(frame, 0, 20).withColumnRenamed("total_resp_signs", "by_bird"))
    assert wide.filter("total_resp_signs <> by_bird").count() == 0


def test_allocation_adds_up_and_birds_are_fixed(spark):
    sizes = {0: {"a": 10, "b": 10, "c": 10}, 1: {"a": 1, "b": 999}, 2: {"a": 3}, 3: {"a": 7, "b": 5, "c": 3, "d": 1}}
    rows = [("s", f, k, f"{f}-{k}-{i}") for f, kinds in sizes.items() for k, n in kinds.items() for i in range(n)]
    birds = spark.createDataFrame(rows, "scenario string, simu_id long, stratum string, bird string")
    strata = birds.groupBy(*FLOCK, "stratum").agg(F.count("*").alias("birds"))
    taken = {(r.simu_id, r.stratum): r.removed for r in panel.allocation(strata, 10).collect()}
    assert taken == {
        (0, "a"): 4, (0, "b"): 3, (0, "c"): 3, (1, "a"): 0, (1, "b"): 10, (2, "a"): 3, (3, "a"): 4, (3, "b"): 3, (3, "c"): 2, (3, "d"): 1,
    }
    chosen = panel.removed_birds(birds, 10)
    first, again = ({tuple(r) for r in f.collect()} for f in (chosen, panel.removed_birds(birds.repartition(3), 10)))
    assert first == again and len(first) == 33
    for (flock, stratum), n in taken.items():
        names = sorted((f"{flock}-{stratum}-{i}" for i in range(sizes[flock][stratum])), key=lambda b: hashlib.md5(b.encode()).hexdigest())
        assert {b for _, f, k, b in first if (f, k) == (flock, stratum)} == set(names[:n])
