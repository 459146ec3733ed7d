"""One test per semantic trap: missing values, ties, orders, boundaries."""

import pytest
from pyspark.sql import functions as F
from toys import counts, flock, production_table

from broodspark.functions.missing import half_even, running_sum
from broodspark.functions.frames import derive, so_far
from broodspark.operators import daily, outcomes, panel, production, summary, sweep


def interpreted(spark, rows, **options):
    return daily.interpret(counts(spark, rows), production_table(spark), **options)


def one(df, **where):
    for column, value in where.items():
        df = df.filter(F.col(column) == value)
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]


def test_growth_factor_changes_weight_unless_as_written(spark):
    rows = flock(5, RGi=50, NG=50)
    weights = {
        (growth, as_written): one(
            interpreted(spark, rows, growth=growth, as_written=as_written), day=4
        )["weight_per_bird"]
        for growth in ("low", "middle", "high")
        for as_written in (False, True)
    }
    assert weights["low", False] > weights["middle", False] > weights["high", False]
    assert weights["low", True] == weights["high", True] == weights["middle", False]


def test_several_growth_factors_equal_single_runs(spark):
    rows = flock(6, RGi=20, NG=80) + flock(6, scenario="2", RGi=10, NG=90)
    together = interpreted(spark, rows, growth=["low", "middle", "high"])
    for growth in ("low", "middle", "high"):
        alone = interpreted(spark, rows, growth=growth)
        columns = sorted(alone.columns)
        left = together.filter(F.col("growth_factor") == growth).select(columns)
        assert left.exceptAll(alone.select(columns)).count() == 0
        assert left.count() == 12


def test_growth_strength_of_low_and_high(spark):
    rows = {r["growth_factor"]: r["strength"] for r in production.multipliers(spark).collect()}
    assert rows == {"low": 0.5, "middle": 1.0, "high": 2.0}


def test_running_sum_stays_missing(spark):
    df = spark.createDataFrame(
        [("1", 1, d, v) for d, v in enumerate([1.0, None, 3.0])],
        "scenario string, simu_id int, day int, v double",
    )
    sums = derive(df, total=running_sum("v", so_far())).orderBy("day").collect()
    assert [r["total"] for r in sums] == [1.0, None, None]


def test_missing_count_makes_later_weights_missing(spark):
    rows = flock(4, NG=lambda d: None if d == 2 else 100)
    weights = [r["weight_per_bird"] for r in interpreted(spark, rows).orderBy("day").collect()]
    assert weights[:2] == pytest.approx([0.044, 0.094]) and weights[2:] == [None, None]


def test_missing_signs_make_the_peak_missing(spark):
    rows = flock(3, percentage_total_resp_signs=lambda d: None if d == 1 else 10.0)
    assert {r["peak_resp_signs"] for r in interpreted(spark, rows).collect()} == {None}


def treated_and_not(spark):
    treated = flock(
        43, simu_id=1, not_yet_treated=lambda d: int(d < 20),
        cum_thinning=lambda d: 25 * (d >= 34), P=lambda d: 100 - 25 * (d >= 34),
        NG=lambda d: 100 - 25 * (d >= 34),
    )
    untreated = [row | {"simu_id": 2, "not_yet_treated": 1} for row in treated]
    later = [row | {"simu_id": 3, "not_yet_treated": int(row["step"] < 23)} for row in treated]
    return treated, untreated, later


def test_treatment_day_statistics_strict_and_known(spark):
    treated, untreated, later = treated_and_not(spark)
    mixed = outcomes.per_simulation(interpreted(spark, treated + untreated + later))
    strict, known = (summary.per_scenario(mixed, na_rm=n).first() for n in (False, True))
    assert strict["median_treatment_day"] is None and strict["min_treatment_day"] is None
    assert (known["median_treatment_day"], known["min_treatment_day"]) == (21.5, 20)
    assert known["max_treatment_day"] == 23
    assert strict["fraction_treated"] == pytest.approx(2 / 3)
    everyone = outcomes.per_simulation(interpreted(spark, treated + later))
    assert summary.per_scenario(everyone).first()["median_treatment_day"] == 21.5


def test_weighted_median_over_many_flocks(spark):
    days = [20] * 5 + [22] * 2 + [30] * 3
    rows = [
        row
        for n, start in enumerate(days)
        for row in flock(43, simu_id=n, not_yet_treated=lambda d, s=start: int(d < s))
    ]
    found = summary.per_scenario(outcomes.per_simulation(interpreted(spark, rows)), na_rm=True)
    assert found.first()["median_treatment_day"] == 21.0


def test_half_even(spark):
    row = spark.sql("SELECT 0.5D AS a, 1.5D AS b").selectExpr(half_even("a"), half_even("b")).first()
    assert list(row) == [0.0, 2.0]


def test_no_birds_gives_missing_not_an_error(spark):
    row = one(interpreted(spark, flock(1, P=0, NG=0)), day=0)
    assert row["p_normal"] is None and row["p_lesions"] is None and row["FCR_daily"] is None


def test_shared_column_names_are_rejected(spark):
    raw = counts(spark, flock(2)).withColumnRenamed("step", "day")
    with pytest.raises(ValueError, match="DG_B"):
        production.attach(raw.withColumn("DG_B", F.lit(1.0)), production_table(spark), "middle")


def test_day_without_production_row_stays(spark):
    rows = daily.interpret(counts(spark, flock(5)), production_table(spark, days=3))
    found = rows.orderBy("day").collect()
    assert len(found) == 5 and found[4]["weight_per_bird"] is None
    assert found[4]["growth_factor"] == "middle"


def test_thinned_birds_weigh_as_on_the_current_day(spark):
    rows = flock(
        43, cum_thinning=lambda d: 25 * (d >= 34), P=lambda d: 100 - 25 * (d >= 34),
        NG=lambda d: 100 - 25 * (d >= 34),
    )
    days = interpreted(spark, rows)
    end, thinned = one(days, day=42), one(days, day=34)
    assert end["thinned_weight"] == pytest.approx(25 * end["weight_per_bird"])
    flock_row = outcomes.per_simulation(days).first()
    assert flock_row["thinned_weight"] == pytest.approx(25 * thinned["weight_per_bird"])
    expected = (thinned["thinned_weight"] + end["total_weight"]) / 100
    assert flock_row["avg_BW"] == pytest.approx(expected)
    assert flock_row["FCR_daily"] == pytest.approx(
        end["cum_FI"] / (end["total_weight"] + end["thinned_weight"])
    )


@pytest.mark.parametrize("form", [outcomes.per_simulation, outcomes.per_simulation_joined])
def test_flock_that_never_reaches_thinning(spark, form):
    row = form(interpreted(spark, flock(20))).first()
    for column in ("thinning_day", "slaughter_weight_total", "weight_revenue", "delta"):
        assert row[column] is None
    assert row["condemned_end"] is not None and row["early_thinning_triggered"] is None


def test_thinning_time_of_the_last_day_counts(spark):
    rows = flock(43, thinning_time=lambda d: 34 if d < 30 else 31)
    assert outcomes.per_simulation(interpreted(spark, rows)).first()["thinning_day"] == 31


def test_same_simulation_number_in_two_scenarios(spark):
    rows = flock(3, scenario="1", P=100) + flock(3, scenario="2", P=50, NG=50)
    found = outcomes.per_simulation(interpreted(spark, rows)).orderBy("scenario").collect()
    assert [r["total_birds"] for r in found] == [100, 50]


def test_parameters_differ_per_row_of_the_sweep(spark):
    raw = counts(spark, flock(43, cum_thinning=lambda d: 25 * (d >= 34)))
    rows = sweep.economic_sweep(raw, production_table(spark)).collect()
    by_id = {r["param_id"]: r for r in rows}
    assert len(by_id) == 10 and by_id[0]["condemnation_B"] == 1.0
    assert by_id[1]["condemnation_B"] == 0.5
    assert by_id[4]["mean_weight_revenue"] == pytest.approx(by_id[0]["mean_weight_revenue"] / 2)
    assert by_id[7]["mean_feed_cost"] == pytest.approx(2 * by_id[0]["mean_feed_cost"])
    assert [by_id[n]["growth_factor"] for n in (2, 3)] == ["low", "high"]
    base = summary.per_scenario(
        outcomes.per_simulation(daily.interpret(raw, production_table(spark)))
    ).first()
    for column in summary.summary_columns():
        assert by_id[0][column] == pytest.approx(base[column]), column


def test_publication_rounds_and_sorts(spark):
    rows = flock(43, scenario="b", vaccination_scenario=1.0) + flock(43, scenario="a")
    table = summary.per_scenario(outcomes.per_simulation(interpreted(spark, rows)))
    found = summary.publication(table, digits=1).collect()
    assert [r["vaccination_scenario"] for r in found] == [0.0, 1.0]
    assert found[0]["mean_avg_BW"] == round(found[0]["mean_avg_BW"], 1)


def test_input_order_does_not_matter(spark):
    rows = flock(43, cum_thinning=lambda d: 25 * (d >= 34), not_yet_treated=lambda d: int(d < 20))
    first = outcomes.per_simulation(interpreted(spark, rows)).collect()
    again = outcomes.per_simulation(interpreted(spark, rows[::-1])).collect()
    assert first == again


@pytest.mark.parametrize("thinning, slaughter, flags", [(33, 41, (1, 1)), (34, 42, (0, 0))])
def test_early_flags_are_strict(spark, thinning, slaughter, flags):
    rows = flock(slaughter + 1, thinning_time=thinning)
    row = outcomes.per_simulation(interpreted(spark, rows)).first()
    assert (row["early_thinning_triggered"], row["early_slaughter_triggered"]) == flags


def deaths(on: dict[int, int], days: int = 43, **columns) -> list[dict]:
    total, rows = 0, []
    for row in flock(days, **columns):
        total += on.get(row["step"], 0)
        rows.append(row | {"cum_mort": total})
    return rows


def by_day(spark, rows):
    return counts(spark, rows).withColumnRenamed("step", "day")


def test_daily_mortality_same_day_and_late(spark):
    raw = by_day(spark, deaths({3: 10}, days=6))
    for lag, day in ((0, 3), (1, 4)):
        rates = panel.daily_mortality(raw, 1000, lag).filter("daily_mortality > 0").collect()
        assert [(r["day"], r["daily_mortality"]) for r in rates] == [(day, 0.01)]
    assert one(panel.daily_mortality(raw, 1000), day=0)["daily_mortality"] is None


def test_trigger_is_a_fraction(spark):
    raw = by_day(spark, deaths({3: 2, 5: 3}, days=8))
    alarmed = panel.mortality_alarm(panel.daily_mortality(raw, 1000))
    assert alarmed.first()["alarm_day"] == 5  # 2 of 1000 is the trigger, not above it
    assert [r["alarm"] for r in alarmed.orderBy("day").collect()] == [0] * 5 + [1] * 3


def test_keyed_update_overwrites_with_missing_values(spark):
    target = spark.createDataFrame([(1, 0, 5), (2, 0, 6)], "k int, a int, b int")
    source = spark.createDataFrame([(1, None)], "k int, a int")
    rows = {r["k"]: (r["a"], r["b"]) for r in outcomes.keyed_update(target, source, ["k"]).collect()}
    assert rows == {1: (None, 5), 2: (0, 6)}


def test_treated_flock_keeps_a_missing_weight(spark):
    rows = flock(43, NG=lambda d: None if d == 5 else 100, not_yet_treated=lambda d: int(d < 20))
    for form in (outcomes.per_simulation, outcomes.per_simulation_joined):
        row = form(interpreted(spark, rows)).first()
        assert row["treated"] == 1 and row["treated_kg"] is None


def test_vaccination_cost_uses_the_birds_of_the_parameters(spark):
    prices = outcomes.Economics(n_birds=1000)
    rows = flock(43, scenario="0") + flock(43, scenario="1", vaccination_scenario=0.5)
    found = outcomes.per_simulation(interpreted(spark, rows), prices).orderBy("scenario").collect()
    assert [r["vaccination_cost"] for r in found] == [0.0, 10.0]


# Alarm day -> (thinning, slaughter, treatment) with early removal allowed and not allowed.
DECISIONS = {
    29: ((34, 42, 29), (34, 42, 29)),
    30: ((31, 42, 32), (34, 42, 35)),
    31: ((32, 42, 33), (34, 42, 35)),
    32: ((33, 42, 34), (34, 42, 35)),
    33: ((34, 42, 35), (34, 42, 35)),
    34: ((34, 42, 35), (34, 42, 35)),
    35: ((34, 42, 35), (34, 42, 35)),
    37: ((34, 42, 37), (34, 42, 37)),
    38: ((34, 39, None), (34, 42, None)),
    39: ((34, 40, None), (34, 42, None)),
    40: ((34, 41, None), (34, 42, None)),
    41: ((34, 42, None), (34, 42, None)),
    42: ((34, 42, None), (34, 42, None)),
}


def test_decisions_day_by_day(spark):
    rows = [
        row
        for alarm_day in DECISIONS
        for early in (1, 0)
        for row in deaths(
            {alarm_day: 10}, scenario=str(early), simu_id=alarm_day, early_slaughter=early
        )
    ]
    bare = by_day(spark, rows).drop("thinning_time", "slaughter_time", "not_yet_treated")
    alarmed = panel.mortality_alarm(panel.daily_mortality(bare, 1000))
    decided = panel.treatment_day(panel.early_removal(alarmed, 34, 42)).filter("day = 0").collect()
    found = {
        (r["simu_id"], r["early_slaughter"]): (
            r["thinning_time"], r["slaughter_time"], r["treatment_day"]
        )
        for r in decided
    }
    expected = {
        (day, early): pair[1 - early] for day, pair in DECISIONS.items() for early in (0, 1)
    }
    assert found == expected


def test_missing_column_is_an_error(spark):
    with pytest.raises(ValueError, match="RL"):
        daily.tidy(counts(spark, flock(2)).drop("RL"))


def test_sweep_as_written_ignores_the_growth_factor(spark):
    raw = counts(spark, flock(43, RGi=50, NG=50, cum_thinning=lambda d: 25 * (d >= 34)))
    weights = {}
    for as_written in (True, False):
        rows = sweep.economic_sweep(raw, production_table(spark), as_written=as_written).collect()
        weights[as_written] = {
            r["growth_factor"]: r["mean_end_weight"] for r in rows if r["param_id"] in (0, 2, 3)
        }
    assert len(set(weights[True].values())) == 1
    low, middle, high = (weights[False][f] for f in ("low", "middle", "high"))
    assert low > middle > high and weights[True]["low"] == middle


def test_an_update_with_bad_keys_stops(spark):
    target = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", None), (None, "d", 4.0)], "k int, name string, v double")

    def update(rows):
        return outcomes.keyed_update(target, spark.createDataFrame(rows, "k int, v double"), ["k"])

    assert sorted((r.name, r.v) for r in update([(1, None), (3, 5.0)]).collect()) == [("a", None), ("b", 2.0), ("c", 5.0), ("d", 4.0)]
    assert update([]).count() == 4
    with pytest.raises(Exception, match="a key twice: k = 1"):
        update([(1, 1.0), (1, 2.0)]).collect()
    for key, text in ((9, "9"), (None, "NULL")):
        with pytest.raises(Exception, match=f"a key without a row: k = {text}"):
            update([(key, 1.0)]).collect()
    # Also where no updated column is asked for.
    with pytest.raises(Exception, match="a key twice"):
        update([(2, 1.0), (2, 1.0)]).select("name").collect()
    problems = outcomes.key_problems(target, spark.createDataFrame([(1, 1.0), (1, 2.0), (9, 1.0), (2, 0.0)], "k int, v double"), ["k"])
    assert {tuple(r) for r in problems.collect()} == {(1, 2, "twice"), (9, 1, "without a row")}
