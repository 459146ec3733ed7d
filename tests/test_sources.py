"""Sources and sinks: round trips, folder identity, headers, run dates, whole studies."""

import pytest
from plans import exchanges, plan_of
from pyspark.sql import functions as F
from toys import counts, flock, production_table

from broodspark.operators import daily, grids, outcomes, production, sweep
from broodspark.plans import studies
from broodspark.schema import COUNTS_SCHEMA, FLOCK
from broodspark.sources import counts as counts_source
from broodspark.sources import events as feed
from broodspark.sources import production as production_source
from broodspark.sources import sinks


def same_rows(left, right):
    columns = sorted(left.columns)
    assert sorted(right.columns) == columns
    left, right = left.select(columns), right.select(columns)
    return left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


@pytest.fixture(scope="module")
def panel(spark, sf_dir):
    return feed.derived_panel(feed.read_events(spark, sf_dir)).cache()


@pytest.mark.parametrize("files", [1, 3])
def test_csv_tree_round_trip(spark, panel, tmp_path, files):
    path = sinks.write_counts_tree(panel, str(tmp_path / "tree"), files)
    read = counts_source.read_counts(spark, path)
    assert same_rows(read, panel)
    folders = read.select("scenario", F.col("_metadata.file_path").alias("f")).distinct()
    assert folders.groupBy("scenario").count().filter(f"count > {files}").count() == 0


def test_plain_folders_and_reordered_header(spark, tmp_path):
    rows = counts(spark, flock(3, P=lambda d: None if d == 1 else 100))
    for folder, columns in (("7", rows.columns), ("10", rows.columns)):
        sinks.write_csv(
            rows.select([c for c in columns[::-1] if c != "scenario"]), str(tmp_path / "runs" / folder)
        )
    read = counts_source.read_counts(spark, str(tmp_path / "runs"))
    assert {r["scenario"] for r in read.collect()} == {"7", "10"}
    assert read.filter("P IS NULL").count() == 2
    assert dict(read.dtypes)["beta"] == "double" and dict(read.dtypes)["step"] == "int"
    assert counts_source.file_count(spark, str(tmp_path / "runs")).first()["n_files"] >= 2


def test_ordinal_follows_name_order(spark, tmp_path):
    for folder in ("2", "10", "1"):
        sinks.write_csv(counts(spark, flock(1)).drop("scenario"), str(tmp_path / "o" / folder))
    files = counts_source.list_files(spark, str(tmp_path / "o"))
    read = counts_source.read_counts(spark, str(tmp_path / "o"))
    numbered = counts_source.with_ordinal(read, counts_source.scenario_ordinals(files))
    found = {r["scenario"]: r["ordinal"] for r in numbered.collect()}
    assert found == {"1": 1, "10": 2, "2": 3}


def test_a_missing_column_fails(spark, tmp_path):
    rows = counts(spark, flock(2)).drop("scenario")
    sinks.write_csv(rows, str(tmp_path / "bad" / "1"))
    sinks.write_csv(rows.drop("RL"), str(tmp_path / "bad" / "2"))
    with pytest.raises(ValueError, match=r"bad/2.* lacks the columns: RL"):
        counts_source.read_counts(spark, str(tmp_path / "bad"))
    (tmp_path / "empty" / "1").mkdir(parents=True)
    (tmp_path / "empty" / "1" / "a.csv").write_text("")
    with pytest.raises(ValueError, match="no file"):
        counts_source.read_counts(spark, str(tmp_path / "empty"))
    (tmp_path / "empty" / "1" / "b.csv").write_text(",".join([*rows.columns, "rl"]) + "\n")
    with pytest.raises(ValueError, match="twice"):
        counts_source.read_counts(spark, str(tmp_path / "empty"))


def test_columns_go_by_name_in_every_file(spark, panel, tmp_path):
    """Three headers in one tree, two of them in one folder, in folders whose names are patterns."""
    optional = ["mortality_B", "beta", "percentage_prevalence"]
    whole = panel.drop("scenario")
    parts = {s: whole.filter(panel.scenario == s) for s in ("0", "1", "2")}
    sinks.write_csv(parts["0"], str(tmp_path / "tree" / "a[1]"))
    sinks.write_csv(parts["1"].select(whole.columns[::-1]), str(tmp_path / "tree" / "b{x}*"))
    sinks.write_csv(parts["2"].coalesce(1).drop(*optional).withColumn("more", F.lit("x")), str(tmp_path / "more"))
    file = next((tmp_path / "more").glob("*.csv"))
    file.rename(tmp_path / "tree" / "a[1]" / "z.csv")
    (tmp_path / "tree" / "a[1]" / "nothing.csv").write_text("")
    read = counts_source.read_counts(spark, str(tmp_path / "tree"))
    assert read.columns == [*whole.columns, "scenario", "more"]
    lacking = parts["2"].withColumns({c: F.lit(None).cast(whole.schema[c].dataType) for c in optional})
    first = read.filter("scenario = 'a[1]'")
    assert same_rows(first.filter("more IS NULL").select(whole.columns), parts["0"])
    assert same_rows(first.filter("more = 'x'").select(whole.columns), lacking)
    assert same_rows(read.filter("scenario = 'b{x}*'").select(whole.columns), parts["1"])


def test_one_header_is_one_scan(spark, panel, tmp_path):
    sinks.write_counts_tree(panel, str(tmp_path / "tree"))
    assert plan_of(counts_source.read_counts(spark, str(tmp_path / "tree"))).count("(1) Scan csv") == 1


def test_bad_number_fails(spark, tmp_path):
    rows = counts(spark, flock(2)).drop("scenario").withColumn("P", F.lit("many"))
    sinks.write_csv(rows, str(tmp_path / "bad" / "1"))
    with pytest.raises(Exception, match="many|MALFORMED|FAILFAST|parse"):
        counts_source.read_counts(spark, str(tmp_path / "bad")).collect()


def test_parquet_panel_prunes_folders(spark, panel, tmp_path):
    path = sinks.write_panel(panel, str(tmp_path / "panel"), files_per_scenario=2)
    read = counts_source.read_panel(spark, path)
    assert same_rows(read, panel)
    assert "PartitionFilters: [isnotnull(scenario" in plan_of(read.filter("scenario = '3'"))


def test_production_round_trip(spark, tmp_path):
    table = production_table(spark)
    path = sinks.write_csv(production.wide(table), str(tmp_path / "production"))
    assert same_rows(production_source.read_production(spark, path), table)
    sinks.write_csv(feed.healthy_production(spark), str(tmp_path / "healthy"))
    feed.healthy_production(spark).write.parquet(str(tmp_path / "healthy.parquet"))
    from_csv, from_parquet = (
        production_source.read_healthy_production(spark, str(tmp_path / n))
        for n in ("healthy", "healthy.parquet")
    )
    assert same_rows(from_csv, from_parquet) and from_csv.count() == 43


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_run_dates_live_side_by_side(spark, tmp_path, fmt):
    path = str(tmp_path / fmt)
    first, second = (spark.range(n).withColumn("v", F.lit(None).cast("double")) for n in (3, 5))
    sinks.write_result(first, path, "2024-02-01", fmt)
    sinks.write_result(second, path, "2024-02-02", fmt)
    sinks.write_result(second, path, "2024-02-02", fmt)
    for date, rows in (("2024-02-01", 3), ("2024-02-02", 5)):
        read = sinks.read_result(spark, path, date, fmt, first.schema)
        assert read.count() == rows and read.filter("v IS NOT NULL").count() == 0


@pytest.fixture(scope="module")
def runs(spark, panel, tmp_path_factory):
    base = tmp_path_factory.mktemp("runs")
    sinks.write_counts_tree(panel, str(base / "scenarios"))
    one = panel.filter("scenario = '0'").drop("scenario")
    sinks.write_csv(one, str(base / "healthy"))
    sinks.write_csv(feed.healthy_production(spark), str(base / "inputs"))
    studies.build_production(spark, str(base / "inputs"), str(base / "production"))
    return base


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_scenario_study(spark, panel, runs, tmp_path, fmt):
    tables = studies.compare_scenarios(
        spark, str(runs / "scenarios"), str(runs / "production"), str(tmp_path), "2024-02-01", fmt=fmt
    )
    assert tables["days"].count() == panel.count()
    assert tables["simulations"].count() == panel.select(*FLOCK).distinct().count()
    assert tables["summary"].count() == 6 and len(tables["summary"].columns) == 84
    check = tables["check"].first()
    assert check["n_simulations"] == 6 and check["introduction_times"] == [14]


def test_sensitivity_study(spark, runs, tmp_path):
    both = studies.sensitivity(
        spark, str(runs / "scenarios"), str(runs / "scenarios"), str(runs / "production"),
        str(tmp_path), "2024-02-01",
    )
    rows = both.collect()
    assert len(rows) == 6 + 9
    assert sorted(r["run"] for r in rows) == list(range(1, 16))
    # Folders 0 to 5 are no runs of the one-at-a-time grid, whatever their numbers: their inputs are those of the default.
    varied = {r["scenario"]: (r["varied_param"], r["varied_value"]) for r in rows if r["kind"] == "simulator"}
    assert set(varied.values()) == {(None, None)} and len(varied) == 6
    problems = sinks.read_result(spark, str(tmp_path / "sens_label_problems"), "2024-02-01").collect()
    assert sorted((r["scenario"], r["problem"]) for r in problems) == [(str(i), "nothing varies") for i in range(6)]
    assert studies.sensitivity_check(both).first()["n_simulations"] == 6


def test_sensitivity_study_with_its_own_configuration(spark, runs, tmp_path):
    both = studies.sensitivity(
        spark, str(runs / "scenarios"), str(runs / "scenarios"), str(runs / "production"), str(tmp_path), "2024-02-01",
        prices=outcomes.Economics(feed_price=0.5), growth="low", variations={"slaughter_price": [1.0, 2.0, 3.0]},
    )
    rows = [r for r in both.collect() if r["kind"] == "economic"]
    assert [(r["varied_param"], r["growth_factor"], r["feed_price"]) for r in rows] == [("slaughter_price", "low", 0.5)] * 3


def oat_runs(spark, names):
    """Runs whose folder stands for a change: {folder: {column: value}}; other inputs are those of the default scenario."""
    inputs = {r: v for r, v in grids.derive_parameters(grids.oat_grid(spark), given=[]).first().asDict().items() if r in sweep.RUN_INPUTS}
    rows = [r for name, change in names.items() for r in flock(2, scenario=name, **(inputs | change))]
    return counts(spark, rows)


def test_runs_are_named_by_their_inputs(spark):
    names = {
        "beta_low": {"beta": 0.5 * 0.78}, "9": {"mortality_B": 0.0571}, "7": {}, "x y": {"recovery": 2 / 12},
        "clinical": {"prop_clinical": 0.8}, "both": {"beta": 0.39, "length_B": 7}, "odd": {"length_B": 8}, "gone": {"length_B": None},
        "vaccinated": {"vaccination_scenario": 1.0, "beta": 0.34, "recovery": 1 / 3.5},
    }
    runs = oat_runs(spark, names).union(oat_runs(spark, {"two": {}})).union(oat_runs(spark, {"two": {"t_until_bact_inf": 3}}))
    labels = {r["scenario"]: (r["varied_param"], r["varied_value"], r["problem"]) for r in sweep.run_labels(runs, grids.oat_grid(spark)).collect()}
    assert labels == {
        "beta_low": ("beta_factor", "0.5", None), "9": ("mortality_B", "0.0571", None), "7": (None, None, "nothing varies"),
        "x y": ("recovery_factor", "2.0", None), "clinical": ("prop_clinical_base", "0.8", None), "both": (None, None, "several inputs vary"),
        "odd": (None, None, "not in the grid"), "gone": (None, None, "an input is missing"), "two": (None, None, "inputs vary within the run"),
        "vaccinated": ("beta_factor", "2.0", None),
    }


def test_runs_are_numbered_by_position(spark):
    names = {"beta_low": {"beta": 0.39}, "9": {}, "7": {"length_B": 28}, "x y": {}}
    runs = oat_runs(spark, names)
    ordinals = runs.groupBy("scenario").count().selectExpr("scenario", "dense_rank() OVER (ORDER BY scenario) AS ordinal")
    simulator = spark.createDataFrame([(s,) for s in names], "scenario string")
    named = sweep.name_runs(simulator, ordinals, sweep.run_labels(runs, grids.oat_grid(spark)))
    found = {r["scenario"]: (r["run"], r["varied_param"]) for r in named.collect()}
    assert found == {"7": (1, "length_B"), "9": (2, None), "beta_low": (3, "beta_factor"), "x y": (4, None)}


@pytest.mark.parametrize("change", [{"DOA": 5.0}, {"slaughter_price": None}, {"feed_price": "0.3"}])
def test_bad_prices_stop_a_study(spark, runs, tmp_path, change):
    prices = outcomes.Economics(**change)
    with pytest.raises(ValueError, match=next(iter(change))):
        studies.compare_scenarios(spark, str(runs / "scenarios"), str(runs / "production"), str(tmp_path), "2024-02-01", prices)
    with pytest.raises(ValueError, match="DG_change_B"):
        studies.build_production(spark, str(runs / "inputs"), str(tmp_path / "p"), {"DG_change_B": 0.2})


def test_stored_days_need_no_exchange(spark, panel, runs, tmp_path):
    tables = studies.compare_scenarios(
        spark, str(runs / "scenarios"), str(runs / "production"), str(tmp_path), "2024-02-01"
    )
    assert exchanges(outcomes.per_simulation(tables["days"])) == []
    stored = spark.read.parquet(str(tmp_path / "output_all_days"))
    assert stored.count() == panel.count() and "run_date" in stored.columns


def totals(tables):
    return [tables[g].agg(F.count(F.lit(1)), F.round(F.sum(c), 6)).first() for g, c in (("days", "cum_FI"), ("simulations", "delta"), ("summary", "mean_delta"))]


def stored_totals(spark, folder):
    paths = {g: f"{folder}/{n}/run_date=2024-02-01" for g, n in studies.GRAINS.items()}
    return totals({g: spark.read.parquet(p) for g, p in paths.items()})


class Killed(Exception):
    pass


def killed(*args, **options):
    raise Killed


def test_a_study_that_ends_early_leaves_the_old_result(spark, runs, tmp_path, monkeypatch):
    def study(**options):
        return studies.compare_scenarios(spark, str(runs / "scenarios"), str(runs / "production"), str(tmp_path), "2024-02-01", **options)

    tables = [t.name for t in spark.catalog.listTables()]
    old = totals(study())
    assert stored_totals(spark, tmp_path) == old
    assert totals(study()) == old, "a rerun of one date is equal"
    dearer = outcomes.Economics(feed_price=0.9)
    with monkeypatch.context() as patched:
        patched.setattr(studies.summary_ops, "per_scenario", killed)
        with pytest.raises(Killed):
            study(prices=dearer)
    assert stored_totals(spark, tmp_path) == old
    # Killed between two moves: the next reader or study completes what the manifest says.
    rename, moved = sinks._Files.rename, []

    def second_fails(self, source, target):
        if "_publishing" not in target:
            moved.append(target)
            if len(moved) == 2:
                raise Killed
        rename(self, source, target)

    with monkeypatch.context() as patched:
        patched.setattr(sinks._Files, "rename", second_fails)
        with pytest.raises(Killed):
            study(prices=dearer)
    assert sinks.recover(spark, str(tmp_path)) == ["2024-02-01"] and sinks.recover(spark, str(tmp_path)) == []
    new = stored_totals(spark, tmp_path)
    assert new != old and new == totals(study(prices=dearer))
    assert [t.name for t in spark.catalog.listTables()] == tables
    assert not list((tmp_path / "_staging").glob("*")) and not list((tmp_path / "_publishing").glob("*.json"))
    with pytest.raises(ValueError, match="not written: x"):
        sinks.Publication(spark, str(tmp_path), "2024-02-02").publish(["x"])


def test_default_scenario_must_be_one_folder(spark, runs, tmp_path):
    two = counts(spark, flock(1, scenario="1") + flock(1, scenario="2"))
    with pytest.raises(ValueError, match="one is needed"):
        studies.only_default(two)
    assert studies.only_default(two.filter("scenario = '1'")) == "1"
    found = studies.default_runs(spark, str(runs / "scenarios"))
    assert {r["scenario"] for r in found.select("scenario").distinct().collect()} == {"0"}
    # Only the folder of the default scenario is in the plan that the study runs.
    assert all("scenario=0/" in f or f.endswith("scenario=0") for f in found.inputFiles())


def test_folder_names_are_read_as_they_are(spark, panel, tmp_path):
    names = ["run a", "100%", "a%20b", "x+y", "é"]
    for name in names:
        one = panel.filter("scenario = '1'").drop("scenario").limit(3)
        sinks.write_csv(one, str(tmp_path / "tree" / name))
    sinks.write_csv(panel.filter("scenario = '1'").drop("scenario").limit(3), str(tmp_path / "tree" / "key=b c"))
    ordinals = counts_source.scenario_ordinals(counts_source.list_files(spark, str(tmp_path / "tree")))
    found = counts_source.with_ordinal(counts_source.read_counts(spark, str(tmp_path / "tree")), ordinals)
    numbers = {r["scenario"]: r["ordinal"] for r in found.select("scenario", "ordinal").distinct().collect()}
    assert numbers == {name: i for i, name in enumerate(sorted([*names, "b c"]), start=1)}


def test_an_introduction_day_that_varies_stops_the_study(spark, panel, runs, tmp_path):
    mixed = panel.withColumn("introduction_time", F.expr("IF(scenario = '3' AND simu_id % 2 = 0, 7, IF(scenario = '4', 7, 14))"))
    sinks.write_counts_tree(mixed, str(tmp_path / "mixed"))
    with pytest.raises(ValueError, match="introduction_time varies within scenario 3$"):
        studies.compare_scenarios(spark, str(tmp_path / "mixed"), str(runs / "production"), str(tmp_path / "out"), "2024-02-01")
    whole = panel.withColumn("introduction_time", F.expr("IF(scenario = '4', 7, 14)"))
    sinks.write_counts_tree(whole, str(tmp_path / "whole"))
    tables = studies.compare_scenarios(spark, str(tmp_path / "whole"), str(runs / "production"), str(tmp_path / "out"), "2024-02-01")
    assert tables["summary"].count() == 5


def test_missing_introduction_time_is_an_error(spark):
    with pytest.raises(Exception, match="introduction_time is missing"):
        outcomes.without_introduction_time(counts(spark, flock(2, introduction_time=None))).collect()


def test_parameter_tables_of_any_size(spark):
    rows = sweep.economic_rows(variations={"slaughter_price": [i / 1000 for i in range(50_001)]})
    assert sweep.economic_table(spark, rows).count() == 50_002
    assert grids.oat_grid(spark, {"beta_factor": [float(i) for i in range(50_001)]}).count() == 50_001
    few = sweep.economic_rows(variations={"slaughter_price": [1.0 + i for i in range(40)]})
    raw, table = counts(spark, flock(5)), production_table(spark)
    whole = sweep.economic_outcomes(raw, table, few).select("param_id", "delta")
    blocks = sweep.economic_outcomes(raw, table, sweep.economic_table(spark, few), block_rows=7).select("param_id", "delta")
    assert blocks.count() == 41 and whole.exceptAll(blocks).count() == 0


def test_healthy_study(spark, runs, tmp_path):
    tables = studies.healthy_baseline(
        spark, str(runs / "healthy"), str(runs / "production"), str(tmp_path), "2024-02-01"
    )
    assert [r["scenario"] for r in tables["summary"].collect()] == ["healthy"]


def test_bucketed_table_needs_no_exchange(spark, panel, tmp_path):
    table = sinks.save_bucketed(panel, "bucketed_panel", str(tmp_path / "b"), 4, day="step")
    raw = spark.table(table)
    flocks = outcomes.per_simulation(daily.interpret(raw, production_table(spark)))
    assert exchanges(flocks) == []
    assert flocks.count() == panel.select(*FLOCK).distinct().count()
    spark.sql("DROP TABLE bucketed_panel")


def test_schema_names_are_unique():
    names = [f.name.lower() for f in COUNTS_SCHEMA.fields]
    assert len(names) == len(set(names))
