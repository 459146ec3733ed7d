"""Plans at scale: few exchanges, broadcast of small sides only, pruned scans."""

import pytest
from plans import count, exchanges, operators, plan_of

from broodspark.operators import daily, outcomes, production, summary, sweep
from broodspark.sources import counts as counts_source
from broodspark.sources import events as feed
from broodspark.sources import sinks
from checks.pairs import QUERIES


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "panel")
    sinks.write_panel(feed.derived_panel(feed.read_events(spark, sf_dir)), path)
    return counts_source.read_panel(spark, path)


@pytest.fixture(scope="module")
def table(spark):
    return production.production_table(feed.healthy_production(spark))


def test_one_exchange_and_sort_carry_the_whole_flock_pipeline(stored, table):
    flocks = outcomes.per_simulation(daily.interpret(stored, table))
    assert len(exchanges(flocks)) == 1
    assert "scenario" in exchanges(flocks)[0] and "simu_id" in exchanges(flocks)[0]
    assert count(flocks, "Sort") == 1
    assert count(flocks, "BroadcastHashJoin") == 1
    assert "CartesianProduct" not in operators(flocks)
    assert "BroadcastNestedLoopJoin" not in operators(flocks)


def test_joined_form_needs_more(stored, table):
    joined = outcomes.per_simulation_joined(daily.interpret(stored, table))
    assert len(exchanges(joined)) > 1


def test_sweep_passes_the_days_once(stored, table):
    swept = sweep.economic_outcomes(stored, table)
    assert len(exchanges(swept)) <= 2 and count(swept, "Sort") == 1
    assert "CartesianProduct" not in operators(swept)
    assert "BroadcastNestedLoopJoin" not in operators(swept)


def test_summary_is_combined_before_its_exchange(stored, table):
    scenarios = summary.per_scenario(outcomes.per_simulation(daily.interpret(stored, table)))
    assert len(exchanges(scenarios)) == 3
    assert "treatment_day" in "".join(exchanges(scenarios))


def test_summary_reads_only_the_columns_it_needs(stored, table):
    flocks = outcomes.per_simulation(daily.interpret(stored, table)).select("scenario", "delta")
    schema = [line for line in plan_of(flocks).splitlines() if line.startswith("ReadSchema")]
    text = next(line for line in schema if "cum_thinning" in line)
    for unused in ("agent_id", "previous_flock_size", "percentage_prevalence", "RS", "beta"):
        assert f"{unused}:" not in text


def test_scenario_filter_prunes_folders(stored, table):
    one = daily.interpret(stored.filter("scenario = '3'"), table)
    assert "PartitionFilters: [isnotnull(scenario" in plan_of(one)


def test_parameter_filter_reaches_the_scan(stored):
    from broodspark.operators.outcomes import default_scenario

    plan = plan_of(default_scenario(stored))
    pushed = next(line for line in plan.splitlines() if line.startswith("PushedFilters"))
    assert "EqualTo(introduction_time,14)" in pushed and "vaccination_scenario" in pushed


def test_events_are_combined_before_the_first_exchange(spark, sf_dir):
    entries = feed.daily_entries(feed.entry_log(feed.read_events(spark, sf_dir)))
    names = operators(entries)
    assert names.index("HashAggregate") < names.index("Exchange")
    assert count(entries, "HashAggregate") == 2
    schema = next(line for line in plan_of(entries).splitlines() if line.startswith("ReadSchema"))
    assert "props" not in schema and "value" not in schema


@pytest.mark.parametrize("name", ["k03_per_scenario", "r15_early_removal", "x01_economic_sweep"])
def test_no_python_on_the_batch_path(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "Python" not in plan and "Pandas" not in plan


def test_large_production_side_is_not_broadcast(spark, monkeypatch):
    from broodspark.functions import small

    monkeypatch.setattr(small.is_small, "__defaults__", (10,))
    big = production.production_table(feed.healthy_production(spark))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(5).selectExpr("CAST(id AS INT) AS day")
        joined = production.attach(left, big, "middle")
        assert "BroadcastHashJoin" not in operators(joined)
        assert joined.filter("DG_healthy IS NOT NULL").count() == 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
