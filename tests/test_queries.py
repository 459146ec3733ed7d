"""Registered queries against their SQL at the smallest size, one per section.

All of them, at any size: ``python -m checks.run /root/testdata/sf0.01``.
"""

import re

import pytest

import __spark_entry__ as contract
from checks.pairs import QUERIES, SQL
from checks.run import compare, database

SAMPLE = [
    "s01_csv_tree_scan", "s06_scenario_from_folder", "p06_publication_table", "f04_rows_on_thinning_day",
    "f06_required_columns", "j04_keyed_update", "r01_scenario_grid", "a10_treatment_day_of_treated",
    "w06_first_values_at_treatment", "u02_union_of_sensitivities", "g08_low_high_responses",
    "k01_interpret", "k02_per_simulation", "k03_per_scenario", "x01_economic_sweep",
    "r02_one_at_a_time_grid", "r09_birds_with_signs", "r12_mortality_alarm", "r14_treatment_day",
    "r15_early_removal", "r17_removal_by_stratum", "r18_dwell_occupancy_from_log",
    "r19_early_exit_dwell", "r20_parameter_quality", "r21_streaming_alarm",
]


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_its_sql(spark, con, sf_dir, name):
    assert compare(spark, con, name, sf_dir) == ""


def test_contract(spark):
    more = contract.queries().keys() - QUERIES.keys()
    assert contract.queries().keys() >= QUERIES.keys() and all(re.match(r"op\d+_|pipeline$", n) for n in more)
    assert contract.oracle_sql().items() >= SQL.items() and set(SQL) == set(QUERIES)
    result = contract.entry(spark)
    assert result.count() == 6 and "mean_delta" in result.columns


def test_every_inventory_item_has_a_query():
    sizes = {
        "s": 10, "p": 6, "f": 6, "j": 6, "a": 14, "w": 7, "o": 3, "u": 3, "g": 9, "d": 11,
        "e": 16, "x": 8, "r": 21, "k": 5,
    }
    found = {m.group(0) for name in QUERIES if (m := re.match(r"[a-z]\d\d(?=_)", name))}
    wanted = {f"{letter}{n:02d}" for letter, size in sizes.items() for n in range(1, size + 1)}
    assert wanted <= found, sorted(wanted - found)


def test_no_query_cuts_its_input():
    for name, sql in SQL.items():
        assert " LIMIT " not in sql.upper() and "SAMPLE" not in sql.upper(), name
