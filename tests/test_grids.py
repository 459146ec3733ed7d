"""Fixed values worked out by hand: grids, derived parameters, multipliers, permitted days."""

import pytest
from pyspark.sql import functions as F

from broodspark.operators import grids, outcomes, panel, production, sweep


def test_scenario_grid_in_nesting_order(spark):
    rows = grids.scenario_grid(spark).orderBy("folder").collect()
    assert len(rows) == 72 and [r["folder"] for r in rows] == list(range(1, 73))
    assert tuple(rows[0])[1:] == (0.0, 7, 0.5, 0)
    assert tuple(rows[1])[1:] == (0.0, 7, 0.5, 1)
    assert tuple(rows[2])[1:] == (0.0, 7, 1.0, 0)
    assert tuple(rows[6])[1:] == (0.0, 14, 0.5, 0)
    assert tuple(rows[71])[1:] == (1.0, 28, 2.0, 1)
    assert len({tuple(r)[1:] for r in rows}) == 72


def test_grid_after_exclusion_and_default_folder(spark):
    grid = grids.scenario_grid(spark)
    assert outcomes.without_introduction_time(grid).count() == 54
    assert [r["folder"] for r in outcomes.default_scenario(grid).collect()] == [9]


def test_one_at_a_time_grid(spark):
    rows = grids.oat_grid(spark).orderBy("folder").collect()
    assert len(rows) == 18
    assert {r["vaccination_scenario"] for r in rows} == {0.0}
    for row in rows:
        varied = [n for n in grids.VARIATIONS if row[n] is not None]
        assert varied == [row["varied_param"]]
        assert row[varied[0]] == row["varied_value"]


def test_derived_parameters_by_vaccination(spark):
    grid = spark.sql(
        "SELECT * FROM VALUES (0D, 0.5D), (0.5D, 1D), (1D, 2D) AS t(vaccination_scenario, prop_bact_factor)"
    )
    rows = grids.derive_parameters(grid).orderBy("vaccination_scenario").collect()
    assert [r["beta"] for r in rows] == [0.78, 0.48, 0.17]
    assert [r["recovery"] for r in rows] == pytest.approx([1 / 12, 1 / 12, 1 / 3.5])
    assert [r["prop_clinical"] for r in rows] == pytest.approx([0.9, 0.8, 0.9])
    assert [r["prop_bact_inf_I0"] for r in rows] == pytest.approx([0.01, 0.02, 0.04])
    assert [r["prop_bact_inf_I"] for r in rows] == pytest.approx([0.075, 0.15, 0.3])
    assert rows[0]["mortality_I"] == pytest.approx(0.0009425)
    assert rows[0]["mortality_B"] == pytest.approx(0.4 / 14)
    assert rows[0]["length_B"] == 14


def test_variations_override_the_defaults(spark):
    rows = {
        (r["varied_param"], r["varied_value"]): r
        for r in grids.derive_parameters(grids.oat_grid(spark)).collect()
    }
    assert rows["beta_factor", 2.0]["beta"] == pytest.approx(1.56)
    assert rows["recovery_factor", 0.5]["recovery"] == pytest.approx(1 / 24)
    assert rows["prop_clinical_base", 0.95]["prop_clinical"] == pytest.approx(0.95)
    assert rows["mortality_B", 0.0571]["mortality_B"] == pytest.approx(0.0571)
    assert rows["length_B", 28.0]["length_B"] == 28
    assert rows["length_B", 28.0]["beta"] == 0.78


def test_feed_multipliers(spark):
    rows = {r["growth_factor"]: r for r in production.multipliers(spark).collect()}
    expected = {"middle": (0.9785, 0.856), "low": (0.989625, 0.9315), "high": (0.954, 0.684)}
    for factor, (ib, b) in expected.items():
        assert rows[factor]["fi_mult_IB"] == pytest.approx(ib)
        assert rows[factor]["fi_mult_B"] == pytest.approx(b)


def test_production_overrides_and_round_trip(spark):
    healthy = spark.range(4).selectExpr(
        "CAST(id AS INT) AS day", "10D * (id + 1) AS healthy_DG", "20D AS healthy_intake"
    )
    table = production.production_table(healthy)
    rows = {(r["day"], r["growth_factor"]): r for r in table.collect()}
    assert len(rows) == 12
    assert rows[0, "high"]["DG_healthy"] == rows[0, "high"]["DG_B"] == 44.0
    assert [rows[d, "middle"]["FI_healthy"] for d in range(4)] == [0.0, 0.0, 20.0, 20.0]
    assert rows[2, "middle"]["DG_B"] == pytest.approx(24.0)
    assert rows[3, "low"]["FI_IB"] == pytest.approx(20 * 0.989625)
    again = production.long(production.wide(table)).select(table.columns)
    assert again.exceptAll(table).count() == 0 and again.count() == 12


def test_permitted_days(spark):
    days = spark.range(43).selectExpr("CAST(id AS INT) AS day")
    forbidden = days.filter(f"NOT ({panel.permitted_when(34, 42)})").orderBy("day").collect()
    assert [r["day"] for r in forbidden] == [*range(30, 35), *range(38, 43)]


def test_economic_rows():
    rows = sweep.economic_rows()
    assert [r["param_id"] for r in rows] == list(range(10))
    names = [r["varied_param"] for r in rows[1:]]
    assert [names.count(n) for n in sweep.ECONOMIC_VARIATIONS] == [1, 2, 2, 2, 2]
    for row in rows[1:]:
        changed = {k for k in rows[0] if row[k] != rows[0][k]}
        assert changed - {"param_id", "varied_param", "varied_value"} == {row["varied_param"]}


def test_grid_scales_without_a_single_task(spark):
    big = {"a": list(range(40)), "b": list(range(50)), "c": [0.5, 1.5]}
    grid = grids.scenario_grid(spark, big)
    assert grid.count() == 4000
    assert grid.agg(F.count_distinct("a", "b", "c").alias("n")).first()["n"] == 4000
