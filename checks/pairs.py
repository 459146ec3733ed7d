"""Queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from broodspark.functions.frames import by_day, derive, named, so_far, whole_flock
from broodspark.operators import daily as daily_ops
from broodspark.operators import grids, outcomes, panel, production, quality, summary, sweep
from broodspark.plans import studies
from broodspark.schema import FLOCK, LAST_DAY, REQUIRED_COUNTS, drop_existing
from broodspark.session import shared_dir
from broodspark.sources import counts as counts_source
from broodspark.sources import events as feed
from broodspark.sources import production as production_source
from broodspark.sources import sinks
from broodspark.streaming import alarm as alarm_stream
from checks.sqltext import FLOCK_DAY, RUNNING, over

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}

KEY = "scenario simu_id"
DAY = "scenario simu_id day"


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = run
        if sql:
            SQL[name] = over(sql)
        return run

    return register


# Digits of the comparison: six, fewer where exact ties are frequent at the sixth. Which way
# a tie goes depends on the order of summation, and the two engines add in different orders.
DIGITS = {"total_weight": 3, "mean_cum_FI": 3}


def rounded(measure: str, digits: int | None = None) -> str:
    places = digits or DIGITS.get(measure, 6)
    return f"round(CAST({measure} AS DOUBLE), {places}) AS {measure}"


def pick(df: DataFrame, keys: str, measures: str = "", digits: int | None = None) -> DataFrame:
    """Key columns as they are, measures as rounded doubles."""
    return df.selectExpr(*keys.split(), *[rounded(m, digits) for m in measures.split()])


def cols(keys: str, measures: str = "", digits: int | None = None) -> str:
    return ", ".join(keys.split() + [rounded(m, digits) for m in measures.split()])


def same(
    name: str, build: Run, table: str, keys: str, measures: str = "", digits: int | None = None
) -> None:
    """A query that picks the same columns from a frame and from a table of the SQL."""
    query(name, f"SELECT {cols(keys, measures, digits)} FROM {table}")(
        lambda spark, sf: pick(build(spark, sf), keys, measures, digits)
    )


# --- frames ------------------------------------------------------------------------


def counts(spark: SparkSession, sf: str, truncate: bool = True) -> DataFrame:
    return feed.derived_panel(feed.read_events(spark, sf), truncate)


def log(spark: SparkSession, sf: str) -> DataFrame:
    return feed.entry_log(feed.read_events(spark, sf))


def entries(spark: SparkSession, sf: str) -> DataFrame:
    return feed.on_every_day(feed.daily_entries(log(spark, sf)), feed.ENTRIES)


def by_days(spark: SparkSession, sf: str) -> DataFrame:
    return counts(spark, sf).withColumnRenamed("step", "day")


def table(spark: SparkSession) -> DataFrame:
    return production.production_table(feed.healthy_production(spark))


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return daily_ops.interpret(counts(spark, sf), table(spark))


def collapsed(spark: SparkSession, sf: str) -> DataFrame:
    return outcomes.collapse(daily(spark, sf))


def per_flock(spark: SparkSession, sf: str) -> DataFrame:
    return outcomes.per_simulation(daily(spark, sf))


def summarised(spark: SparkSession, sf: str) -> DataFrame:
    return summary.per_scenario(per_flock(spark, sf))


def swept(spark: SparkSession, sf: str) -> DataFrame:
    return sweep.economic_sweep(counts(spark, sf), table(spark))


# --- sources and sinks -------------------------------------------------------------

RAW_INTS = "step NG NGi NGr RGi RGb B RL RS P thinning_time slaughter_time cum_I cum_mort not_yet_treated"
RAW_DOUBLES = "beta recovery vaccination_scenario percentage_mortality percentage_total_resp_signs"


def counts_tree(spark: SparkSession, sf: str) -> str:
    return sinks.write_counts_tree(counts(spark, sf), shared_dir(spark, "counts"))


def tree(spark: SparkSession, sf: str) -> DataFrame:
    return counts_source.read_counts(spark, counts_tree(spark, sf))


same("s01_csv_tree_scan", tree, "panel", f"{KEY} {RAW_INTS}", RAW_DOUBLES)


@query(
    "s01_three_headers",
    f"SELECT {cols(f'{KEY} {RAW_INTS}')}, " + ", ".join(
        f"round(CASE WHEN CAST(scenario AS INTEGER) % 3 = 2 THEN NULL ELSE {c} END, 6) AS {c}" if c in ("beta", "recovery")
        else rounded(c) for c in RAW_DOUBLES.split()
    ) + " FROM panel",
)
def s01_three_headers(spark, sf):
    # One tree: columns as they are, columns in reverse order, and two columns absent.
    path, whole = shared_dir(spark, "counts"), counts(spark, sf)
    third = F.col("scenario").cast("int") % 3
    kinds = [whole, whole.select(whole.columns[::-1]), whole.drop("beta", "recovery")]
    for number, rows in enumerate(kinds):
        sinks.by_scenario(rows.filter(third == number)).write.mode("append").options(header=True, nullValue="NA").partitionBy("scenario").csv(path)
    return pick(counts_source.read_counts(spark, path), f"{KEY} {RAW_INTS}", RAW_DOUBLES)


@query(
    "s02_sensitivity_tree_scan",
    f"SELECT {cols(f'{KEY} {RAW_INTS}', RAW_DOUBLES)}, 'sens' AS run_kind FROM panel",
)
def s02(spark, sf):
    path = counts_tree(spark, sf)
    runs = counts_source.read_counts(spark, path, run_kind="sens")
    return pick(runs, f"run_kind {KEY} {RAW_INTS}", RAW_DOUBLES)


RESPONSE = "DG_healthy FI_healthy DG_IB DG_B FI_IB FI_B"


@query(
    "s03_production_table_scan",
    f"SELECT {cols('scenario simu_id f.day growth_factor', RESPONSE)} "
    "FROM flock_days f LEFT JOIN production p ON p.day = f.day AND p.growth_factor = 'high'",
)
def s03(spark, sf):
    path = sinks.write_csv(production.wide(table(spark)), shared_dir(spark, "production"))
    read = production_source.read_production(spark, path)
    joined = production.attach(by_days(spark, sf), read, "high")
    return pick(joined, f"{DAY} growth_factor", RESPONSE)


@query(
    "s04_healthy_baseline_scan",
    "SELECT 'healthy' AS scenario, simu_id * 6 + CAST(scenario AS INTEGER) AS simu_id, "
    "step, NG, P, cum_mort FROM panel",
)
def s04(spark, sf):
    whole = counts(spark, sf).withColumn(
        "simu_id", F.col("simu_id") * 6 + F.col("scenario").cast("int")
    )
    path = sinks.write_csv(whole.drop("scenario"), shared_dir(spark, "healthy"))
    baseline = counts_source.read_counts(spark, path, scenario="healthy")
    return baseline.select("scenario", "simu_id", "step", "NG", "P", "cum_mort")


@query(
    "s05_healthy_production_input",
    "SELECT scenario, simu_id, f.day, round(13 + 2.6::DOUBLE * f.day, 6) AS healthy_DG, "
    "10 + 4.0::DOUBLE * f.day AS healthy_intake FROM flock_days f",
)
def s05(spark, sf):
    path = sinks.write_csv(feed.healthy_production(spark), shared_dir(spark, "healthy-production"))
    healthy = production_source.read_healthy_production(spark, path)
    joined = by_days(spark, sf).join(healthy, "day", "left")
    return pick(joined, DAY, "healthy_DG healthy_intake")


@query(
    "s06_scenario_from_folder",
    "SELECT scenario, CAST(dense_rank() OVER (ORDER BY scenario) AS INTEGER) AS ordinal, "
    "count(*) AS n_rows FROM panel GROUP BY scenario",
)
def s06(spark, sf):
    path = counts_tree(spark, sf)
    ordinals = counts_source.scenario_ordinals(counts_source.list_files(spark, path))
    numbered = counts_source.with_ordinal(counts_source.read_counts(spark, path), ordinals)
    return numbered.groupBy("scenario", "ordinal").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "s07_file_count",
    "SELECT count(DISTINCT scenario) AS n_folders, count(DISTINCT (scenario, simu_id % 2)) AS n_files FROM panel",
)
def s07(spark, sf):
    # One file per folder and half of its flocks.
    path = shared_dir(spark, "counts")
    halves = counts(spark, sf).withColumn("half", F.col("simu_id") % 2)
    for half in (0, 1):
        sinks.by_scenario(halves.filter(F.col("half") == half).drop("half"), 1).write.mode("append").options(
            header=True, nullValue="NA"
        ).partitionBy("scenario").csv(path)
    return counts_source.file_count(spark, path)


def _totals(df: DataFrame, grain: str, measure: str) -> DataFrame:
    return df.agg(
        F.lit(grain).alias("grain"),
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.sum(measure), 3).alias("total"),
    )


@query(
    "s08_csv_sink_three_grains",
    "SELECT 'days' AS grain, count(*) AS n_rows, round(sum(total_weight), 3) AS total FROM daily "
    "UNION ALL SELECT 'simulations', count(*), round(sum(delta), 3) FROM outcomes "
    "UNION ALL SELECT 'summary', count(*), round(sum(mean_delta), 3) FROM summary",
)
def s08(spark, sf):
    def stored(df):
        path = sinks.write_csv(df, shared_dir(spark, "grain"))
        return sinks.read_csv_back(spark, path, df.schema)

    read = [stored(daily(spark, sf))]
    read.append(stored(outcomes.per_simulation(read[0])))
    read.append(stored(summary.per_scenario(read[1])))
    return (
        _totals(read[0], "days", "total_weight")
        .unionByName(_totals(read[1], "simulations", "delta"))
        .unionByName(_totals(read[2], "summary", "mean_delta"))
    )


@query(
    "s08_published_study",
    "SELECT 'days' AS grain, count(*) AS n_rows, round(sum(total_weight), 3) AS total FROM daily "
    "UNION ALL SELECT 'simulations', count(*), round(sum(delta), 3) FROM outcomes "
    "UNION ALL SELECT 'summary', count(*), round(sum(mean_delta), 3) FROM summary",
)
def s08_published(spark, sf):
    # The whole study from files, twice on one date; the second run replaces the tables of the first.
    output = shared_dir(spark, "study")
    prices = sinks.write_csv(production.wide(table(spark)).orderBy("day").coalesce(1), shared_dir(spark, "production"))
    tree = counts_tree(spark, sf)
    for growth in ("low", "middle"):
        tables = studies.compare_scenarios(spark, tree, prices, output, "2024-02-01", growth=growth)
    parts = [_totals(tables[g], g, c) for g, c in (("days", "total_weight"), ("simulations", "delta"), ("summary", "mean_delta"))]
    return summary.combine(*parts)


@query(
    "s09_csv_sink_sensitivity",
    f"SELECT {cols('scenario param_id varied_param varied_value n', 'mean_delta max_delta mean_FCR')} "
    "FROM sweep_summary",
)
def s09(spark, sf):
    result = swept(spark, sf)
    path = sinks.write_csv(result, shared_dir(spark, "sensitivity"))
    read = sinks.read_csv_back(spark, path, result.schema)
    return pick(
        read, "scenario param_id varied_param varied_value n", "mean_delta max_delta mean_FCR"
    )


@query(
    "s10_dated_output",
    f"SELECT '2024-02-01' AS run_date, {cols(KEY, 'delta avg_BW')} FROM outcomes",
)
def s10(spark, sf):
    path = shared_dir(spark, "dated")
    result = per_flock(spark, sf)
    sinks.write_result(result, path, "2024-02-01")
    read = sinks.read_result(spark, path, "2024-02-01")
    return pick(
        read.withColumn("run_date", F.col("run_date").cast("string")),
        f"run_date {KEY}",
        "delta avg_BW",
    )


# --- projections -------------------------------------------------------------------

same(
    "p01_drop_columns",
    lambda spark, sf: drop_existing(counts(spark, sf), "level", "agent_id", "De"),
    "panel",
    f"{KEY} step NG NGi NGr RGi RGb B RL I0 I RS P introduction_time early_slaughter",
    "vaccination_scenario beta",
)
same(
    "p02_rename_columns",
    lambda spark, sf: daily_ops.tidy(counts(spark, sf)),
    "flock_days",
    f"{DAY} red_grow_IB red_grow_B total_birds NG cum_thinning",
)
THINNING = (
    "thinned_weight FCR_thinning weight_per_bird_thinning p_lesions_thinning p_no_lesions_thinning"
)
same(
    "p03_thinning_columns",
    lambda spark, sf: outcomes.thinning_rows(daily(spark, sf)),
    "thinning3 WHERE growth_factor = 'middle'",
    f"{KEY} thinning_day n_thinned",
    THINNING,
)
same(
    "p04_computed_columns",
    daily,
    "daily",
    f"{DAY} normal_growing_birds treatment_start",
    "p_normal p_IB p_B p_tot weight_per_bird total_weight total_daily_FI FCR_daily",
)


@query(
    "p05_constant_columns",
    "SELECT DISTINCT scenario, simu_id, CAST(NULL AS INTEGER) AS treatment_day, 0 AS treated, "
    "0 AS treated_flock_size, 0.0::DOUBLE AS treated_kg, 0 AS treated_days FROM panel",
)
def p05(spark, sf):
    flocks = counts(spark, sf).select(*FLOCK).distinct()
    return derive(flocks, **outcomes.UNTREATED)


PUBLISHED = ["mean_delta", "mean_avg_BW", "mean_mort", "mean_cond", "mean_DDD_year"]


@query(
    "p06_publication_table",
    "SELECT vaccination_scenario, introduction_time, early_slaughter, prop_bact_factor, "
    + ", ".join(f"round({c}, 3) AS {c}" for c in PUBLISHED)
    + " FROM summary ORDER BY 1, 2, 3, 4",
)
def p06(spark, sf):
    return summary.publication(summarised(spark, sf), 3)


# --- filters -----------------------------------------------------------------------

def several_introductions(spark, sf):
    """The panel with the introduction on day 7, 14, 21 or 28, by scenario."""
    return counts(spark, sf).withColumn("introduction_time", F.expr("7 * (1 + CAST(scenario AS INT) % 4)"))


DEFAULT = (
    "vaccination_scenario = 0 AND introduction_time = 14 "
    "AND early_slaughter = 0 AND prop_bact_factor = 1"
)
same(
    "f01_exclude_introduction_time",
    lambda spark, sf: outcomes.without_introduction_time(several_introductions(spark, sf), 7),
    "(SELECT * EXCLUDE (introduction_time), CAST(7 * (1 + CAST(scenario AS INTEGER) % 4) AS INTEGER) AS introduction_time "
    "FROM panel) WHERE introduction_time <> 7",
    f"{KEY} step introduction_time P",
)


@query(
    "f01_scenarios_partly_left_out",
    "SELECT scenario FROM (SELECT scenario, 7 * (1 + (CAST(scenario AS INTEGER) % 3 + CASE WHEN simu_id % 5 < CAST(scenario AS INTEGER) % 2 "
    "THEN 1 ELSE 0 END) % 4) AS introduction_time FROM panel) GROUP BY scenario "
    "HAVING count(*) FILTER (introduction_time = 7) > 0 AND count(*) FILTER (introduction_time <> 7) > 0",
)
def f01_partly(spark, sf):
    # In odd scenarios a fifth of the flocks has the next day: scenario 3 is split, 0 goes as a whole.
    later = "7 * (1 + (CAST(scenario AS INT) % 3 + IF(simu_id % 5 < CAST(scenario AS INT) % 2, 1, 0)) % 4)"
    left_out, path = Observation("left_out"), shared_dir(spark, "kept")
    mixed = counts(spark, sf).withColumn("introduction_time", F.expr(later))
    outcomes.without_introduction_time(mixed, 7, left_out).write.parquet(path)
    return quality.partly_left_out(spark.read.parquet(path), left_out)


same(
    "f02_default_scenario_daily",
    lambda spark, sf: outcomes.default_scenario(daily(spark, sf)),
    f"daily WHERE {DEFAULT}",
    DAY,
    "total_weight cum_FI FCR_daily",
)


@query(
    "f03_default_scenario_raw",
    f"SELECT scenario, count(*) AS n_rows FROM panel WHERE {DEFAULT} GROUP BY scenario",
)
def f03(spark, sf):
    return quality.single_match(outcomes.default_scenario(counts(spark, sf)))


@query(
    "f04_rows_on_thinning_day",
    f"SELECT {cols(f'{DAY} thinning_time', 'total_weight thinned_weight')} FROM daily d "
    "WHERE day = (SELECT arg_max(thinning_time, day) FROM panel p "
    "WHERE p.scenario = d.scenario AND p.simu_id = d.simu_id)",
)
def f04(spark, sf):
    final = f"max_by(thinning_time, day) {whole_flock()}"
    rows = derive(daily(spark, sf), _final=final).filter("day = _final")
    return pick(rows, f"{DAY} thinning_time", "total_weight thinned_weight")


same(
    "f05_treatment_start_rows",
    lambda spark, sf: daily(spark, sf).filter(F.col("treatment_start") == 1),
    "daily WHERE treatment_start = 1",
    f"{DAY} total_birds",
    "total_weight",
)


@query(
    "f06_required_columns",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, 1 AS present, count({c}) AS n_values FROM panel"
        for c in REQUIRED_COUNTS
    )
    + " UNION ALL SELECT 'not_there', 0, CAST(0 AS BIGINT)",
)
def f06(spark, sf):
    return quality.column_presence(counts(spark, sf), [*REQUIRED_COUNTS, "not_there"])


# --- joins -------------------------------------------------------------------------

same(
    "j01_panel_with_production",
    lambda spark, sf: production.attach(by_days(spark, sf), table(spark), "middle"),
    "fed WHERE growth_factor = 'middle'",
    DAY,
    RESPONSE,
)


@query(
    "j02_last_day_with_thinning",
    f"SELECT {cols('l.scenario l.simu_id l.day thinning_day n_thinned', 'total_weight')}, "
    "round(t.thinned_weight, 6) AS thinned_weight FROM last_days l "
    "LEFT JOIN thinning3 t USING (scenario, simu_id, growth_factor) "
    "WHERE l.growth_factor = 'middle'",
)
def j02(spark, sf):
    days = daily(spark, sf)
    end = drop_existing(outcomes.last_rows(days), "thinned_weight")
    joined = end.join(outcomes.thinning_rows(days), FLOCK, "left")
    return pick(joined, f"{DAY} thinning_day n_thinned", "total_weight thinned_weight")


@query(
    "j03_last_day_with_treatment",
    f"SELECT {cols('l.scenario l.simu_id l.day treatment_day treated', 'treated_kg')} "
    "FROM last_days l LEFT JOIN treatment3 t USING (scenario, simu_id, growth_factor) "
    "WHERE l.growth_factor = 'middle'",
)
def j03(spark, sf):
    days = daily(spark, sf)
    joined = outcomes.last_rows(days).join(outcomes.treatment_rows(days), FLOCK, "left")
    return pick(joined, f"{DAY} treatment_day treated", "treated_kg")


TREATMENT = "treatment_day treated treated_flock_size treated_days"


@query(
    "j04_keyed_update",
    f"SELECT {cols(f'{KEY} {TREATMENT}', 'treated_kg')} FROM collapsed "
    "WHERE growth_factor = 'middle'",
)
def j04(spark, sf):
    days = daily(spark, sf)
    defaults = derive(days.select(*FLOCK).distinct(), **outcomes.UNTREATED)
    updated = outcomes.keyed_update(defaults, outcomes.treatment_rows(days), FLOCK)
    return pick(updated, f"{KEY} {TREATMENT}", "treated_kg")


@query(
    "j04_key_problems",
    "SELECT scenario, simu_id, count(*) AS n, CASE WHEN max(day) > 30 THEN 'without a row' ELSE 'twice' END AS problem FROM log "
    "WHERE state = 'error' GROUP BY scenario, simu_id HAVING count(*) > 1 OR max(day) > 30",
)
def j04_problems(spark, sf):
    # The rows of an update: one per event of a kind; the flocks whose last such event is late are no targets.
    errors = log(spark, sf).filter("state = 'error'")
    targets = errors.groupBy(*FLOCK).agg(F.max("day").alias("last")).filter("last <= 30")
    return outcomes.key_problems(targets, errors, FLOCK)


# The published lists of the scenario grid.
GRID_SQL = """
SELECT CAST(g.folder AS INTEGER) AS folder, g.vaccination_scenario, g.introduction_time,
       g.prop_bact_factor, g.early_slaughter, coalesce(p.n_flocks, 0) AS n_flocks,
       coalesce(p.n_rows, 0) AS n_rows
FROM (
  SELECT row_number() OVER (ORDER BY vaccination_scenario, introduction_time, prop_bact_factor,
                            early_slaughter) AS folder, *
  FROM (SELECT unnest([0.0::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE]) AS vaccination_scenario),
       (SELECT unnest([7, 14, 21, 28]) AS introduction_time),
       (SELECT unnest([0.5::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE]) AS prop_bact_factor),
       (SELECT unnest([0, 1]) AS early_slaughter)
) g LEFT JOIN (
  SELECT vaccination_scenario, introduction_time, prop_bact_factor, early_slaughter,
         count(*) FILTER (step = 0) AS n_flocks, count(*) AS n_rows
  FROM panel GROUP BY ALL
) p USING (vaccination_scenario, introduction_time, prop_bact_factor, early_slaughter)"""


def _grid_use(spark, sf):
    """Every cell of the grid with the flocks and rows that the panel has for it."""
    cell = list(grids.SCENARIO_LISTS)
    used = counts(spark, sf).groupBy(*cell).agg(
        F.count_if(F.col("step") == 0).alias("n_flocks"), F.count(F.lit(1)).alias("n_rows")
    )
    joined = grids.scenario_grid(spark).join(used, cell, "left")
    return joined.fillna(0, ["n_flocks", "n_rows"]).select("folder", *cell, "n_flocks", "n_rows")


query("j05_parameter_product", GRID_SQL)(_grid_use)

SWEEP_KEY = "scenario simu_id param_id varied_param varied_value growth_factor"
PRICED = "weight_revenue feed_cost treatment_cost vaccination_cost condemned_total delta"
same(
    "j06_outcomes_by_parameter_row",
    lambda spark, sf: sweep.economic_outcomes(counts(spark, sf), table(spark)),
    "sweep_outcomes",
    SWEEP_KEY,
    PRICED,
    digits=3,
)

# --- aggregations ------------------------------------------------------------------


def spread(names: str) -> str:
    return " ".join(f"{stat}_{name}" for name in names.split() for stat in ("mean", "min", "max"))


TEXT = {"scenario", "growth_factor"}
SUMMARY_MEASURES = " ".join(c for c in summary.summary_columns() if c not in TEXT | {"n"})
same("a01_scenario_summary", summarised, "summary", "scenario n growth_factor", SUMMARY_MEASURES)
same("a02_rounds_per_scenario", summarised, "summary", "scenario n")
IDENTIFIERS = (
    "vaccination_scenario beta recovery prop_bact_factor mortality_I mortality_B treatment_trigger"
)
same(
    "a03_scenario_identifiers",
    summarised,
    "summary",
    "scenario introduction_time early_slaughter t_until_bact_inf duration_reduced_growth length_B",
    IDENTIFIERS,
)
same(
    "a04_echoed_parameters",
    swept,
    "sweep_summary",
    "scenario param_id growth_factor",
    "condemnation_B slaughter_price feed_price ab_price_per_chick ab_price_constant vaccine_price",
)
same(
    "a05_infection_measures",
    summarised,
    "summary",
    "scenario",
    spread("p_prevalence p_resp_signs p_secondary peak_resp_signs cum_clin_IB cum_secondary"),
)
same(
    "a06_production_measures",
    summarised,
    "summary",
    "scenario",
    "mean_thinned_weight "
    + spread("end_weight avg_BW weight_revenue cum_FI FCR delta cond feed_cost mort"),
)
same(
    "a07_condition_shares",
    summarised,
    "summary",
    "scenario",
    "early_thinning_triggered early_slaughter_triggered",
)
same("a08_mean_vaccination_cost", summarised, "summary", "scenario", "vaccination_cost")
same(
    "a09_treatment_measures",
    summarised,
    "summary",
    "scenario",
    spread("treatment_cost kg_treated DDD_year") + " fraction_treatment_triggered fraction_treated",
)


@query(
    "a10_treatment_day_of_treated",
    "SELECT scenario, n, round(median_treatment_day_known, 6) AS median_treatment_day, "
    "min_treatment_day_known AS min_treatment_day, max_treatment_day_known AS max_treatment_day, "
    "median_treatment_day AS strict_median FROM summary",
)
def a10(spark, sf):
    # The flocks are built once and stored; both summaries read them.
    path, built = shared_dir(spark, "flocks"), per_flock(spark, sf)
    built.write.parquet(path)
    flocks = spark.read.schema(built.schema).parquet(path)
    known = summary.per_scenario(flocks, na_rm=True).select(
        "scenario", "n", F.round("median_treatment_day", 6).alias("median_treatment_day"),
        "min_treatment_day", "max_treatment_day",
    )
    strict = summary.per_scenario(flocks).select(
        "scenario", F.col("median_treatment_day").alias("strict_median")
    )
    return known.join(strict, "scenario")


same(
    "a11_treated_flocks",
    lambda spark, sf: outcomes.treatment_rows(daily(spark, sf)),
    "treatment3 WHERE growth_factor = 'middle'",
    f"{KEY} {TREATMENT}",
    "treated_kg",
)


def _checked(spark, sf):
    return summary.check(summarised(spark, sf))


same(
    "a12_scenario_check_counts",
    _checked,
    "(SELECT count(*) AS n_simulations, arg_min(n, scenario) AS n_rounds FROM summary)",
    "n_simulations n_rounds",
)
same(
    "a13_rounds_constant",
    _checked,
    "(SELECT CASE WHEN count(DISTINCT n) > 1 THEN 0 ELSE 1 END AS n_rounds_constant FROM summary)",
    "n_rounds_constant",
)


def joined_values(name: str) -> Column:
    return F.array_join(F.transform(name, lambda v: v.cast("string")), ",").alias(name)


@query(
    "a14_parameter_values_used",
    "SELECT array_to_string(list_sort(list(DISTINCT vaccination_scenario)), ',') AS vaccination_scenario, "
    "array_to_string(list_sort(list(DISTINCT introduction_time)), ',') AS introduction_times, "
    "array_to_string(list_sort(list(DISTINCT early_slaughter)), ',') AS early_slaughter, "
    "array_to_string(list_sort(list(DISTINCT prop_bact_factor)), ',') AS prop_bact_factor FROM summary",
)
def a14(spark, sf):
    names = ["vaccination_scenario", "introduction_times", "early_slaughter", "prop_bact_factor"]
    return _checked(spark, sf).select(*[joined_values(n) for n in names])


# --- windows -----------------------------------------------------------------------

same("w01_weight_per_bird", daily, "daily", DAY, "DG_per_bird weight_per_bird")
same("w02_cumulative_feed", daily, "daily", DAY, "total_daily_FI cum_FI")
same("w03_peak_resp_signs", daily, "daily", DAY, "resp_signs peak_resp_signs")
same("w04_treatment_start_edge", daily, "daily", f"{DAY} treatment_start")


@query(
    "w05_last_thinning_time",
    "SELECT scenario, simu_id, step, arg_max(thinning_time, step) "
    "OVER (PARTITION BY scenario, simu_id) AS last_thinning_time FROM panel",
)
def w05(spark, sf):
    final = f"max_by(thinning_time, step) {whole_flock(day='step')} AS last_thinning_time"
    return counts(spark, sf).selectExpr(*FLOCK, "step", final)


@query(
    "w06_first_values_at_treatment",
    "SELECT scenario, simu_id, min(day) AS first_day, arg_min(total_birds, day) AS first_birds, "
    "round(arg_min(total_weight, day), 3) AS first_weight FROM daily "
    "WHERE not_yet_treated = 0 GROUP BY scenario, simu_id",
)
def w06(spark, sf):
    # The flag column is gone from the daily grain: a started treatment stays started.
    started = f"max(treatment_start) {so_far()}"
    after = derive(daily(spark, sf), _started=started).filter("_started = 1")
    return after.groupBy(*FLOCK).agg(
        F.min("day").alias("first_day"),
        F.min_by("total_birds", "day").alias("first_birds"),
        F.round(F.min_by("total_weight", "day"), 3).alias("first_weight"),
    )


same(
    "w07_last_row_per_flock",
    lambda spark, sf: outcomes.last_rows(daily(spark, sf)),
    "last_days WHERE growth_factor = 'middle'",
    f"{DAY} total_birds",
    "total_weight cum_FI FCR_daily",
)

# --- sorts and top rows ------------------------------------------------------------


@query(
    "o01_sorted_days",
    f"SELECT {cols(DAY, 'weight_per_bird')} FROM daily ORDER BY scenario, simu_id, day",
)
def o01(spark, sf):
    # In order within a flock, which is all that the running sums need; no global sort.
    rows = pick(daily(spark, sf), DAY, "weight_per_bird")
    return rows.repartition(*FLOCK).sortWithinPartitions(*FLOCK, "day")


@query(
    "o02_sorted_summary",
    f"SELECT {cols('scenario introduction_time early_slaughter', 'vaccination_scenario prop_bact_factor mean_delta')} "
    "FROM summary ORDER BY vaccination_scenario, introduction_time, early_slaughter, prop_bact_factor",
)
def o02(spark, sf):
    rows = summarised(spark, sf).orderBy(*summary.PUBLICATION_KEYS)
    return pick(
        rows,
        "scenario introduction_time early_slaughter",
        "vaccination_scenario prop_bact_factor mean_delta",
    )


@query(
    "o03_latest_day_per_flock",
    "SELECT scenario, simu_id, max(step) AS step, arg_max(P, step) AS P, "
    "arg_max(cum_mort, step) AS cum_mort FROM panel GROUP BY scenario, simu_id",
)
def o03(spark, sf):
    latest = F.max_by(F.struct("step", "P", "cum_mort"), "step").alias("_latest")
    return counts(spark, sf).groupBy(*FLOCK).agg(latest).select(*FLOCK, "_latest.*")


# --- unions ------------------------------------------------------------------------


@query(
    "u01_union_of_scenarios",
    "SELECT scenario, 'days' AS grain, count(*) AS n_rows FROM daily GROUP BY scenario "
    "UNION ALL SELECT scenario, 'simulations', count(*) FROM outcomes GROUP BY scenario "
    "UNION ALL SELECT scenario, 'summary', count(*) FROM summary GROUP BY scenario "
    "UNION ALL SELECT 'healthy', 'summary', 1",
)
def u01(spark, sf):
    def stored(df, grain):
        path = shared_dir(spark, grain)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    days = stored(daily(spark, sf), "days")
    flocks = stored(outcomes.per_simulation(days), "flocks")
    # A flock number is unique within a scenario only: number again when scenarios merge.
    whole = flocks.withColumns(
        {
            "simu_id": F.col("simu_id") * 6 + F.col("scenario").cast("int"),
            "scenario": F.lit("healthy"),
        }
    )
    scenarios = summary.combine(summary.per_scenario(flocks), summary.per_scenario(whole))
    grains = {"days": days, "simulations": flocks, "summary": scenarios}
    parts = [
        df.groupBy("scenario").agg(F.lit(g).alias("grain"), F.count(F.lit(1)).alias("n_rows"))
        for g, df in grains.items()
    ]
    return summary.combine(*parts)


U02_COLUMNS = cols("scenario n", "mean_delta mean_FCR mean_feed_cost")


def sensitivity_tree(spark, sf):
    """A tree of 18 run folders, named 1 to 18: each scenario's flocks dealt over three runs."""
    runs = counts(spark, sf).withColumns({
        "scenario": F.expr("CAST(1 + (simu_id % 3) * 6 + CAST(scenario AS INT) AS STRING)"), "simu_id": F.expr("simu_id DIV 3")
    })
    return sinks.write_counts_tree(varied(runs, grids.oat_grid(spark)), shared_dir(spark, "sensitivity"))


def varied(runs: DataFrame, grid: DataFrame) -> DataFrame:
    """Runs in folders named by the rows of the grid, with the input that each row varies; others stay as they are."""
    row = F.broadcast(grid.selectExpr("CAST(folder AS STRING) AS scenario", "varied_param AS _p", "varied_value AS _v"))
    changed = {"beta": ("beta_factor", "beta * _v"), "recovery": ("recovery_factor", "recovery * _v"), "prop_clinical": ("prop_clinical_base", "prop_clinical - 0.9D + _v")}
    changed |= {c: (c, "_v") for c in sweep.RUN_INPUTS if c not in changed}
    kinds = dict(runs.dtypes)
    inputs = {c: F.expr(f"CAST(IF(_p = '{p}', {v}, {c}) AS {kinds[c]})") for c, (p, v) in changed.items()}
    return runs.join(row, "scenario", "left").withColumns(inputs).drop("_p", "_v")


# What each run varies, in the order of the folders' numbers; fixed values of the one-at-a-time grid.
VARIED_SQL = "(VALUES " + ", ".join(
    f"({i}, '{n}', '{v}')"
    for i, (n, v) in enumerate(
        [
            ("beta_factor", "0.5"), ("beta_factor", "2.0"), ("recovery_factor", "0.5"), ("recovery_factor", "2.0"),
            ("prop_clinical_base", "0.8"), ("prop_clinical_base", "0.95"), ("mortality_I", "7.25E-4"),
            ("mortality_I", "0.001885"), ("mortality_B", "0.0142"), ("mortality_B", "0.0571"),
            ("time_before_reduced_growth", "1.0"), ("time_before_reduced_growth", "4.0"),
            ("duration_reduced_growth", "4.0"), ("duration_reduced_growth", "16.0"), ("t_until_bact_inf", "3.0"),
            ("t_until_bact_inf", "10.0"), ("length_B", "7.0"), ("length_B", "28.0"),
        ],
        start=1,
    )
) + ") AS v(folder, varied_param, varied_value)"
SIMULATOR_MEASURES = {"mean_delta": "delta", "mean_FCR": "FCR_daily", "mean_feed_cost": "feed_cost", "mean_cum_FI": "cum_FI", "mean_mort": "mortality"}


def simulator_sql(measures: str) -> str:
    means = ", ".join(f"round(avg({SIMULATOR_MEASURES[m]}), {DIGITS.get(m, 6)}) AS {m}" for m in measures.split())
    return (
        f"SELECT kind, run, varied_param, varied_value, scenario, n, {', '.join(measures.split())} FROM (SELECT 'simulator' AS kind, "
        f"folder, CAST(folder AS VARCHAR) AS scenario, count(*) AS n, {means}, "
        "CAST(dense_rank() OVER (ORDER BY CAST(folder AS VARCHAR)) AS INTEGER) AS run FROM "
        "(SELECT *, 1 + (simu_id % 3) * 6 + CAST(scenario AS INTEGER) AS folder FROM outcomes) GROUP BY folder) "
        f"JOIN {VARIED_SQL} USING (folder)"
    )


def simulated(spark, sf):
    path = sensitivity_tree(spark, sf)
    ordinals = counts_source.scenario_ordinals(counts_source.list_files(spark, path))
    read = counts_source.read_counts(spark, path)
    return sweep.name_runs(sweep.simulator_sweep(read, table(spark)), ordinals, sweep.run_labels(read, grids.oat_grid(spark)))


U02_MEASURES = "mean_delta mean_FCR mean_feed_cost"


@query(
    "u02_union_of_sensitivities",
    f"{simulator_sql(U02_MEASURES)} UNION ALL "
    f"SELECT 'economic', param_id + 18, varied_param, varied_value, {U02_COLUMNS} FROM sweep_summary "
    "WHERE param_id > 0 AND scenario = '0'",
)
def u02(spark, sf):
    default = sweep.economic_sweep(outcomes.default_scenario(counts(spark, sf)), table(spark))
    both = sweep.combined_sensitivity(simulated(spark, sf), default, simulator_runs=18)
    return pick(both, "kind run varied_param varied_value scenario n", U02_MEASURES)


same(
    "u03_distinct_flocks",
    lambda spark, sf: counts(spark, sf).select(*FLOCK).distinct(),
    "(SELECT DISTINCT scenario, simu_id FROM panel)",
    KEY,
)

# --- production table --------------------------------------------------------------


def with_multipliers(spark, sf):
    """The panel with the growth classes' birds and the multipliers of every growth factor."""
    factors = F.array(*[F.lit(g) for g in production.GROWTH_STRENGTH])
    spread_rows = by_days(spark, sf).withColumn("growth_factor", F.explode(factors))
    return spread_rows.join(F.broadcast(production.multipliers(spark)), "growth_factor").withColumns(
        {
            f"{kind}_{group}": F.col(count) * F.col(f"{kind}_mult_{group}")
            for kind in ("dg", "fcr", "fi")
            for group, count in (("IB", "RGi"), ("B", "RGb"))
        }
    )


def multiplied(kinds: str, factors: str) -> str:
    wanted = ", ".join(f"'{f}'" for f in factors.split())
    names = " ".join(f"{k}_{g}" for k in kinds.split() for g in ("IB", "B"))
    inner = ", ".join(
        f"{count} * {k}_mult_{g} AS {k}_{g}"
        for k in kinds.split()
        for g, count in (("IB", "RGi"), ("B", "RGb"))
    )
    return (
        f"SELECT {cols(f'{DAY} growth_factor', names)} FROM (SELECT scenario, simu_id, day, "
        f"growth_factor, {inner} FROM panel CROSS JOIN multipliers "
        f"WHERE growth_factor IN ({wanted}))"
    )


def _multiplier_query(name: str, kinds: str, factors: str) -> None:
    names = " ".join(f"{k}_{g}" for k in kinds.split() for g in ("IB", "B"))

    @query(name, multiplied(kinds, factors))
    def run(spark, sf):
        rows = with_multipliers(spark, sf).filter(F.col("growth_factor").isin(*factors.split()))
        return pick(rows, f"{DAY} growth_factor", names)


_multiplier_query("g01_response_multipliers", "dg fcr", "middle")
_multiplier_query("g02_low_high_multipliers", "dg fcr", "low high")
_multiplier_query("g03_feed_multipliers", "fi", "low middle high")


def produced(growth: str | list[str]) -> Run:
    return lambda spark, sf: production.attach(by_days(spark, sf), table(spark), growth)


same("g04_hatch_weight_gain", produced("middle"), "fed WHERE growth_factor = 'middle'", DAY, "DG_healthy")
same("g05_feed_of_first_days", produced("middle"), "fed WHERE growth_factor = 'middle'", DAY, "FI_healthy")
same("g06_diseased_gain", produced("middle"), "fed WHERE growth_factor = 'middle'", DAY, "DG_IB DG_B")
same("g07_diseased_feed", produced("middle"), "fed WHERE growth_factor = 'middle'", DAY, "FI_IB FI_B")
G08 = [f"{c}_{f}" for f in ("low", "high") for c in production.RESPONSES]


@query(
    "g08_low_high_responses",
    "SELECT f.scenario, f.simu_id, f.day, "
    + ", ".join(
        f"round(max(CASE WHEN p.growth_factor = '{f}' THEN p.{c} END), 6) AS {c}_{f}"
        for f in ("low", "high")
        for c in production.RESPONSES
    )
    + " FROM flock_days f LEFT JOIN production p ON p.day = f.day GROUP BY ALL",
)
def g08(spark, sf):
    wide = F.broadcast(production.wide(table(spark)))
    return pick(by_days(spark, sf).join(wide, "day", "left"), DAY, " ".join(G08))


same(
    "g09_growth_factor_choice",
    produced(["low", "high"]),
    "fed WHERE growth_factor <> 'middle'",
    f"{DAY} growth_factor",
    RESPONSE,
)

# --- daily expressions -------------------------------------------------------------

for _name, _keys, _measures in (
    ("d01_normal_growing_birds", f"{DAY} normal_growing_birds", ""),
    ("d02_growth_shares", DAY, "p_normal p_IB p_B"),
    ("d03_share_total", DAY, "p_tot"),
    ("d04_lesion_shares", DAY, "p_lesions p_no_lesions"),
    ("d05_mortality_and_signs", DAY, "mortality resp_signs"),
    ("d06_gain_per_bird", DAY, "DG_per_bird"),
    ("d07_total_weight", DAY, "total_weight"),
    ("d08_thinned_weight", DAY, "thinned_weight"),
    ("d09_daily_feed_intake", DAY, "total_daily_FI"),
    ("d10_daily_fcr", DAY, "FCR_daily"),
    ("d11_treatment_start", f"{DAY} treatment_start", ""),
):
    same(_name, daily, "daily", _keys, _measures)

# --- per-simulation expressions ----------------------------------------------------

for _name, _keys, _measures in (
    ("e01_thinning_day_and_fcr", f"{KEY} thinning_day", "FCR_thinning"),
    ("e02_delivered_weight", KEY, "delivered_weight_thinning delivered_weight_end"),
    ("e03_condemned_share", KEY, "condemned_thinning condemned_end"),
    ("e04_condemned_birds", KEY, "n_condemned_thinning n_condemned_end"),
    ("e05_slaughter_weight", KEY, "slaughter_weight_thinning slaughter_weight_end"),
    ("e06_treatment_cost", KEY, "treatment_cost"),
    ("e07_treated_flag_and_days", f"{KEY} treated treated_days", ""),
    ("e08_condemned_total", KEY, "condemned_total"),
    ("e09_slaughter_weight_total", KEY, "slaughter_weight_total"),
    ("e10_weight_revenue", KEY, "weight_revenue"),
    ("e11_feed_cost", KEY, "feed_cost"),
    ("e12_vaccination_cost", KEY, "vaccination_cost"),
    ("e13_average_body_weight", KEY, "avg_BW"),
    ("e14_margin", KEY, "delta"),
    ("e15_treated_days_per_year", KEY, "DDD_year"),
    ("e16_early_flags", f"{KEY} early_thinning_triggered early_slaughter_triggered", ""),
):
    same(_name, per_flock, "outcomes", _keys, _measures)

# --- sweeps ------------------------------------------------------------------------

SWEPT_KEYS = "scenario param_id varied_param varied_value growth_factor n"
SWEPT = "mean_delta min_delta max_delta mean_cond mean_FCR mean_feed_cost mean_weight_revenue mean_treatment_cost"
same("x01_economic_sweep", swept, "sweep_summary", SWEPT_KEYS, SWEPT)


def _one_parameter(name: str, parameter: str) -> None:
    same(
        name,
        lambda spark, sf: sweep.economic_sweep(
            counts(spark, sf), table(spark), sweep.one_parameter(parameter)
        ),
        f"sweep_summary WHERE varied_param = '{parameter}'",
        SWEPT_KEYS,
        SWEPT,
    )


_one_parameter("x02_condemnation_sweep", "condemnation_B")
_one_parameter("x03_growth_sweep", "growth_factor")
_one_parameter("x04_slaughter_price_sweep", "slaughter_price")
_one_parameter("x05_feed_price_sweep", "feed_price")
_one_parameter("x06_antibiotic_price_sweep", "ab_price_per_chick")
X07_MEASURES = "mean_delta mean_FCR mean_cum_FI mean_mort"


@query("x07_simulator_sweep", f"SELECT * EXCLUDE (kind) FROM ({simulator_sql(X07_MEASURES)})")
def x07(spark, sf):
    return pick(simulated(spark, sf), "run varied_param varied_value scenario n", X07_MEASURES)


@query(
    "x07_labels_by_value",
    "SELECT 'run ' || chr(CAST(90 - folder AS INTEGER)) AS scenario, CASE WHEN folder <= 18 THEN varied_param END AS varied_param, "
    "CASE WHEN folder <= 18 THEN varied_value END AS varied_value, CASE folder WHEN 19 THEN 'nothing varies' "
    "WHEN 20 THEN 'several inputs vary' WHEN 21 THEN 'not in the grid' END AS problem "
    "FROM (SELECT DISTINCT 1 + simu_id % 21 AS folder FROM panel) "
    f"LEFT JOIN {VARIED_SQL} USING (folder)",
)
def x07_labels(spark, sf):
    # Eighteen runs of the grid, one without a change, one with two, one with a value that is not in the grid; the names tell nothing.
    dealt = counts(spark, sf).drop(*sweep.RUN_INPUTS).withColumns({"vaccination_scenario": F.lit(0.0), "scenario": F.expr("CAST(1 + simu_id % 21 AS STRING)")})
    runs = varied(grids.derive_parameters(dealt, given=[]), grids.oat_grid(spark)).withColumns({
        "beta": F.expr("IF(scenario = '20', beta / 2, beta)"), "length_B": F.expr("CASE scenario WHEN '20' THEN 7 WHEN '21' THEN 9 ELSE length_B END"),
        "scenario": F.expr("'run ' || chr(90 - CAST(scenario AS INT))"),
    })
    return sweep.run_labels(runs, grids.oat_grid(spark))


@query(
    "x08_continued_numbering",
    "SELECT scenario, param_id, varied_param, varied_value, "
    "CASE WHEN param_id > 0 THEN param_id + 18 END AS run, round(mean_delta, 6) AS mean_delta "
    "FROM sweep_summary",
)
def x08(spark, sf):
    numbered = sweep.continue_numbering(swept(spark, sf), simulator_runs=18)
    return pick(numbered, "scenario param_id varied_param varied_value run", "mean_delta")


# --- grids and parameters ----------------------------------------------------------

query("r01_scenario_grid", GRID_SQL)(_grid_use)

# The published one-at-a-time variations.
OAT = [
    (name, float(value))
    for name, values in (
        ("beta_factor", (0.5, 2)), ("recovery_factor", (0.5, 2)),
        ("prop_clinical_base", (0.8, 0.95)), ("mortality_I", (0.000725, 0.001885)),
        ("mortality_B", (0.0142, 0.0571)), ("time_before_reduced_growth", (1, 4)),
        ("duration_reduced_growth", (4, 16)), ("t_until_bact_inf", (3, 10)),
        ("length_B", (7, 28)),
    )
    for value in values
]
OAT_SQL = ", ".join(f"({n}, '{name}', {v}::DOUBLE)" for n, (name, v) in enumerate(OAT, 1))


@query(
    "r02_one_at_a_time_grid",
    f"""
SELECT g.folder, g.varied_param, round(g.varied_value, 6) AS varied_value,
  round(0.78::DOUBLE * CASE WHEN varied_param = 'beta_factor' THEN varied_value ELSE 1 END
        * p.share, 6) AS infection_pressure,
  CASE WHEN varied_param = 'length_B' THEN CAST(varied_value AS INTEGER) ELSE 14 END AS length_B,
  round(CASE WHEN varied_param = 'prop_clinical_base' THEN varied_value ELSE 0.9::DOUBLE END, 6)
    AS prop_clinical
FROM (VALUES {OAT_SQL}) AS g(folder, varied_param, varied_value),
     (SELECT sum((I0 + I)::DOUBLE / P) AS share FROM panel WHERE {DEFAULT}) p""",
)
def r02(spark, sf):
    cell = list(grids.DEFAULT_SCENARIO)
    pressure = counts(spark, sf).groupBy(*cell).agg(
        F.sum(F.try_divide(F.col("I0") + F.col("I"), F.col("P"))).alias("share")
    )
    rows = grids.derive_parameters(grids.oat_grid(spark)).join(pressure, cell)
    rows = rows.withColumn("infection_pressure", F.col("beta") * F.col("share"))
    return pick(
        rows, "folder varied_param length_B", "varied_value infection_pressure prop_clinical"
    )


@query(
    "r03_derived_parameters",
    "SELECT scenario, simu_id, step, round(beta, 6) AS beta, round(recovery, 6) AS recovery, "
    "round(prop_clinical, 6) AS prop_clinical, round(0.02::DOUBLE * prop_bact_factor, 6) AS prop_bact_inf_I0, "
    "round(0.15::DOUBLE * prop_bact_factor, 6) AS prop_bact_inf_I, round(mortality_I, 8) AS mortality_I, "
    "round(mortality_B, 6) AS mortality_B FROM panel",
)
def r03(spark, sf):
    scenario = counts(spark, sf).select(*FLOCK, "step", "vaccination_scenario", "prop_bact_factor")
    derived = grids.derive_parameters(scenario)
    return derived.select(
        *FLOCK, "step",
        *[
            F.round(c, 6).alias(c)
            for c in ("beta", "recovery", "prop_clinical", "prop_bact_inf_I0", "prop_bact_inf_I", "mortality_B")
        ],
        F.round("mortality_I", 8).alias("mortality_I"),
    )


# --- panel and log operators -------------------------------------------------------

STATES = ["view", "click", "purchase", "error", "signup"]


@query(
    "r04_state_occupancy",
    "SELECT scenario, simu_id, day, "
    + ", ".join(f"count(*) FILTER (state = '{s}') AS n_{s}" for s in STATES)
    + " FROM log GROUP BY ALL",
)
def r04(spark, sf):
    return panel.state_occupancy(log(spark, sf), STATES)


COUNTERS = {"new_i": "cum_I", "new_b": "cum_B", "new_d": "cum_mort"}


@query(
    "r05_cumulative_entries",
    "SELECT scenario, simu_id, day, "
    + ", ".join(
        f"CAST(sum({e}) OVER ({FLOCK_DAY} {RUNNING}) AS BIGINT) AS {c}" for e, c in COUNTERS.items()
    )
    + " FROM entries",
)
def r05(spark, sf):
    running = panel.cumulative_entries(entries(spark, sf), COUNTERS)
    return running.select(*FLOCK, "day", *COUNTERS.values())


@query(
    "r05_cumulative_thinning",
    "SELECT scenario, simu_id, day, cum_thinning FROM flagged",
)
def r05_thinning(spark, sf):
    days = counts(spark, sf, truncate=False).withColumnRenamed("step", "day").drop("cum_thinning")
    thinned = derive(days, new_thinned=f"IF(day = thinning_time, {feed.THINNING_NUMBER}L, 0L)")
    return panel.cumulative_entries(thinned, {"new_thinned": "cum_thinning"}).select(*FLOCK, "day", "cum_thinning")


@query(
    "r05_entries_outside_days",
    "SELECT scenario, simu_id, day, new_b, 'counted' AS rule FROM entries WHERE day BETWEEN 20 AND 30 UNION ALL "
    "SELECT scenario, simu_id, day, new_b, CASE WHEN day < 20 THEN 'before_first_day' ELSE 'after_last_day' END "
    "FROM logged WHERE day NOT BETWEEN 20 AND 30",
)
def r05_outside(spark, sf):
    logged = feed.daily_entries(log(spark, sf))
    counted = derive(feed.on_every_day(logged, ["new_b"], 20, 30), rule="'counted'")
    wanted = [*FLOCK, "day", "new_b", "rule"]
    return counted.select(wanted).unionByName(feed.outside_days(logged, 20, 30).select(wanted))


same(
    "r06_flock_size",
    lambda spark, sf: panel.flock_size(by_days(spark, sf), feed.INITIAL_BIRDS),
    "(SELECT scenario, simu_id, day, 30000 - cum_mort - cum_thinning AS flock_size FROM panel)",
    f"{DAY} flock_size",
)


@query(
    "r07_daily_mortality",
    "SELECT scenario, simu_id, day, round(percentage_daily_mortality / 100, 8) AS daily_mortality, "
    "round(percentage_daily_mortality, 6) AS percentage_daily_mortality, "
    f"round(lag(percentage_daily_mortality / 100) OVER ({FLOCK_DAY}), 8) AS late_mortality FROM panel",
)
def r07(spark, sf):
    prompt = panel.daily_mortality(by_days(spark, sf), feed.INITIAL_BIRDS)
    return prompt.selectExpr(
        *FLOCK, "day",
        "round(daily_mortality, 8) AS daily_mortality",
        "round(percentage_daily_mortality, 6) AS percentage_daily_mortality",
        f"round(lag(daily_mortality) {by_day()}, 8) AS late_mortality",
    )


PERCENTAGES = (
    "percentage_prevalence percentage_prevalence_secondary "
    "percentage_prevalence_recovered_lesions percentage_mortality percentage_total_resp_signs"
)
same(
    "r08_percent_measures",
    lambda spark, sf: panel.percent_measures(
        derive(by_days(spark, sf), B_and_RS="0", daily_mortality="percentage_daily_mortality / 100")
        .drop(*PERCENTAGES.split(), "percentage_daily_mortality"),
        feed.INITIAL_BIRDS,
    ),
    "panel",
    DAY,
    PERCENTAGES,
)


def agents(spark, sf):
    """A flock-day as one agent: whether it had bacterial entries and respiratory signs."""
    seen = panel.state_occupancy(log(spark, sf), ["purchase", "view"])
    return seen.select(
        "scenario", "simu_id", "day",
        (F.col("n_purchase") > 0).alias("bacterial"), (F.col("n_view") > 0).alias("signs"),
    )


@query(
    "r09_birds_with_signs",
    "SELECT scenario, day, count(*) FILTER (signs) AS RS, count(*) FILTER (bacterial) AS B, "
    "count(*) FILTER (signs AND bacterial) AS B_and_RS, "
    "count(*) FILTER (signs OR bacterial) AS total_resp_signs, "
    "count(*) FILTER (signs OR bacterial) AS agent_level FROM "
    "(SELECT scenario, simu_id, day, bool_or(state = 'purchase') AS bacterial, "
    "bool_or(state = 'view') AS signs FROM log GROUP BY ALL) GROUP BY ALL",
)
def r09(spark, sf):
    signs, bacterial = F.col("signs"), F.col("bacterial")
    wide = agents(spark, sf).groupBy("scenario", "day").agg(
        F.count_if(signs).alias("RS"),
        F.count_if(bacterial).alias("B"),
        F.count_if(signs & bacterial).alias("B_and_RS"),
        F.count_if(signs | bacterial).alias("agent_level"),
    )
    return panel.birds_with_signs(wide)


@query(
    "r09_birds_by_day",
    "SELECT scenario, day, count(*) FILTER (signs) AS RS, count(*) FILTER (bacterial) AS B, "
    "count(*) FILTER (signs AND bacterial) AS B_and_RS, count(*) FILTER (signs OR bacterial) AS total_resp_signs FROM "
    "(SELECT l.scenario, l.simu_id, d.day, bool_or(l.state = 'view' AND d.day BETWEEN l.day AND l.day + 6) AS signs, "
    "bool_or(l.state = 'purchase' AND d.day BETWEEN l.day AND l.day + 13) AS bacterial "
    "FROM log l, (SELECT CAST(unnest(range(0, 43)) AS INTEGER) AS day) d GROUP BY ALL) GROUP BY ALL",
)
def r09_birds(spark, sf):
    # Each flock of the feed as one bird of its scenario, with a stay per entry.
    days = F.when(F.col("state") == "view", grids.DURATION_RESP_SIGNS).otherwise(grids.DURATIONS["length_B"])
    kind = F.when(F.col("state") == "view", "signs").when(F.col("state") == "purchase", "bacterial")
    stays = log(spark, sf).select(
        "scenario", F.col("simu_id").alias("bird"), kind.alias("dimension"), F.col("day").alias("from_day"), (F.col("day") + days - 1).alias("until_day")
    )
    return panel.birds_by_day(stays, 0, LAST_DAY, keys=["scenario"])


@query(
    "r10_state_co_occurrence",
    "SELECT scenario, day, bacterial, signs, count(*) AS n FROM "
    "(SELECT scenario, simu_id, day, CAST(bool_or(state = 'purchase') AS INTEGER) AS bacterial, "
    "CAST(bool_or(state = 'view') AS INTEGER) AS signs FROM log GROUP BY ALL) GROUP BY ALL",
)
def r10(spark, sf):
    coded = agents(spark, sf).withColumns(
        {c: F.col(c).cast("int") for c in ("bacterial", "signs")}
    )
    return panel.co_occurrence(coded, "bacterial", "signs", keys=["scenario"])


same(
    "r11_force_of_infection",
    lambda spark, sf: panel.force_of_infection(by_days(spark, sf)),
    "(SELECT scenario, simu_id, day, I0 + I AS infectious, beta * (I0 + I) / P AS force_of_infection FROM panel)",
    f"{DAY} infectious",
    "force_of_infection",
)

PLAN = ["treatment_allowed", "treatment_triggered", "thinning_time", "slaughter_time", "not_yet_treated"]


def alarmed(spark, sf):
    """The panel with the alarm worked out again from its counters."""
    bare = by_days(spark, sf).drop(*PLAN)
    return panel.mortality_alarm(panel.daily_mortality(bare, feed.INITIAL_BIRDS))


def decided(spark, sf):
    dated = panel.early_removal(alarmed(spark, sf), feed.THINNING_TIME, feed.SLAUGHTER_TIME)
    return panel.treatment_day(dated)


same(
    "r12_mortality_alarm",
    alarmed,
    "(SELECT *, treatment_triggered AS alarm_on FROM (SELECT * EXCLUDE (alarm), alarm AS alarm_day, "
    "treatment_triggered AS alarm FROM panel))",
    f"{DAY} alarm alarm_day",
)


@query("r13_treatment_permitted", "SELECT scenario, simu_id, day, treatment_allowed FROM panel")
def r13(spark, sf):
    permitted = f"IF({panel.permitted_when()}, 1, 0) AS treatment_allowed"
    return by_days(spark, sf).selectExpr(*FLOCK, "day", permitted)


@query(
    "r14_treatment_day",
    "SELECT scenario, simu_id, day, not_yet_treated, min(CASE WHEN not_yet_treated = 0 THEN day END) "
    "OVER (PARTITION BY scenario, simu_id) AS treatment_day FROM panel",
)
def r14(spark, sf):
    return decided(spark, sf).select(*FLOCK, "day", "not_yet_treated", "treatment_day")


same("r15_early_removal", decided, "panel", f"{DAY} thinning_time slaughter_time")
same(
    "r16_truncate_at_slaughter",
    lambda spark, sf: panel.truncate_at_slaughter(
        counts(spark, sf, truncate=False).withColumnRenamed("step", "day")
    ),
    "panel",
    f"{DAY} slaughter_time P cum_mort",
)


@query(
    "r17_removal_by_stratum",
    "SELECT scenario, simu_id, day, stratum, birds, CAST(round_even(birds * 7500::DOUBLE / total, 0) AS INTEGER) AS removed "
    "FROM (SELECT scenario, simu_id, day, NG + NGi + RGi + RGb AS total, "
    "unnest(['NG', 'NGi', 'RGi', 'RGb']) AS stratum, unnest([NG, NGi, RGi, RGb]) AS birds "
    "FROM panel WHERE day = thinning_time)",
)
def r17(spark, sf):
    strata = ["NG", "NGi", "RGi", "RGb"]
    removed = panel.removal_by_stratum(by_days(spark, sf), strata, feed.THINNING_NUMBER)
    return removed.select(*FLOCK, "day", "stratum", "birds", "removed")


NUMBER = 20
SHARES_SQL = (
    "SELECT scenario, simu_id, stratum, birds, rest, down, least(20, total) - sum(down) OVER (PARTITION BY scenario, simu_id) AS spare FROM "
    "(SELECT *, birds * least(20, total) // total AS down, birds * least(20, total) % total AS rest FROM "
    "(SELECT *, CAST(sum(birds) OVER (PARTITION BY scenario, simu_id) AS BIGINT) AS total FROM "
    "(SELECT scenario, simu_id, state AS stratum, count(*) AS birds FROM log GROUP BY ALL)))"
)
QUOTA_SQL = (
    "SELECT scenario, simu_id, stratum, birds, CAST(down + CASE WHEN row_number() OVER (PARTITION BY scenario, simu_id ORDER BY rest DESC, stratum) "
    f"<= spare THEN 1 ELSE 0 END AS INTEGER) AS removed FROM ({SHARES_SQL})"
)


def single_birds(spark, sf):
    """Every event of the feed as a bird of its flock; its kind is the stratum."""
    return feed.read_events(spark, sf).selectExpr(*named(feed.FLOCK_OF_USER), "event_type AS stratum", "event_id AS bird")


@query("r17_allocation", QUOTA_SQL)
def r17_allocation(spark, sf):
    strata = single_birds(spark, sf).groupBy(*FLOCK, "stratum").agg(F.count(F.lit(1)).alias("birds"))
    return panel.allocation(strata, NUMBER)


@query(
    "r17_removed_birds",
    "SELECT b.scenario, b.simu_id, b.stratum, b.bird FROM (SELECT *, row_number() OVER (PARTITION BY scenario, simu_id, stratum "
    "ORDER BY md5(CAST(bird AS VARCHAR)), bird) AS place FROM (SELECT CAST(user_id % 6 AS VARCHAR) AS scenario, user_id // 6 AS simu_id, "
    "event_type AS stratum, event_id AS bird FROM events)) b "
    f"JOIN ({QUOTA_SQL}) q ON b.scenario = q.scenario AND b.simu_id = q.simu_id AND b.stratum = q.stratum AND b.place <= q.removed",
)
def r17_birds(spark, sf):
    return panel.removed_birds(single_birds(spark, sf), NUMBER)


@query(
    "r18_dwell_occupancy",
    "SELECT scenario, simu_id, day, B, RS, NGi, RGi, "
    f"CAST(sum(new_i) OVER ({FLOCK_DAY} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS BIGINT) AS PB, "
    "new_s AS Hi FROM counted",
)
def r18(spark, sf):
    days = grids.DURATIONS
    stays = {
        "B": ("new_b", days["length_B"]),
        "RS": ("new_s", grids.DURATION_RESP_SIGNS),
        "NGi": ("new_i", days["time_before_reduced_growth"]),
        # Follows NGi: comes when that stay ends.
        "RGi": ("new_i", days["duration_reduced_growth"], days["time_before_reduced_growth"]),
        "PB": ("new_i", days["t_until_bact_inf"]),
        "Hi": ("new_s", grids.TIME_BEFORE_RESP_SIGNS),
    }
    return panel.dwell_occupancy(entries(spark, sf), stays).select(*FLOCK, "day", *stays)


def bacterial_entries(spark, sf):
    daily_log = feed.daily_entries(log(spark, sf)).filter(F.col("new_b") > 0)
    return daily_log.select(*FLOCK, "day", F.col("new_b").alias("n"))


@query(
    "r18_dwell_occupancy_from_log",
    "SELECT scenario, simu_id, day, CAST(B AS BIGINT) AS present FROM counted WHERE B > 0",
)
def r18_log(spark, sf):
    stay = grids.DURATIONS["length_B"]
    return panel.occupancy_from_log(bacterial_entries(spark, sf), stay, last_day=42)


# Treatment moves, once, the birds that are in the state when its day begins: an entry is cut short
# if it came before that day, and counts in full if it comes on that day or later.
EXIT_SQL = (
    "FROM entries e LEFT JOIN (SELECT scenario, simu_id, min(day) AS treated FROM panel WHERE not_yet_treated = 0 "
    "GROUP BY ALL) t ON t.scenario = e.scenario AND t.simu_id = e.simu_id "
    "JOIN days d ON d.day >= e.day AND d.day < e.day + 14 WHERE e.new_b > 0"
)
LEFT_SQL = "t.treated IS NOT NULL AND e.day < t.treated AND d.day >= t.treated"


@query(
    "r19_early_exit_dwell",
    f"SELECT e.scenario, e.simu_id, d.day, CAST(sum(e.new_b) AS BIGINT) AS present {EXIT_SQL} AND NOT ({LEFT_SQL}) GROUP BY ALL",
)
def r19(spark, sf):
    return early_exits(spark, sf)


@query(
    "r19_early_exit_share",
    "SELECT e.scenario, e.simu_id, d.day, round(sum(e.new_b - e.new_b * CASE WHEN "
    f"{LEFT_SQL} THEN 0.9::DOUBLE ELSE 0 END), 6) AS present {EXIT_SQL} GROUP BY ALL",
)
def r19_share(spark, sf):
    # The published effect of the treatment: nine birds in ten recover.
    return early_exits(spark, sf, share=0.9).withColumn("present", F.round("present", 6))


def early_exits(spark, sf, share=1):
    treated = (
        counts(spark, sf)
        .filter(F.col("not_yet_treated") == 0)
        .groupBy(*FLOCK)
        .agg(F.min("step").alias("treated_on"))
    )
    # Entries are one row per flock and day before this join, so no flock is large in it.
    entered = bacterial_entries(spark, sf).join(treated, FLOCK, "left")
    return panel.occupancy_from_log(
        entered, grids.DURATIONS["length_B"], last_day=42, exit_day="treated_on", share=share
    )


# --- quality and stream ------------------------------------------------------------


BROKEN = {
    "NG": "IF(day = 20 AND simu_id % 3 = 0, NG + 1, IF(day = 21 AND simu_id % 5 = 0, NULL, NG))",
    "cum_mort": "IF(day = 25 AND simu_id % 4 = 0, cum_mort + 100000, cum_mort)",
    "beta": "IF(scenario = '2' AND simu_id % 2 = 0, NULL, IF(scenario = '4', beta + day, beta))",
    "copies": "IF(day = 10 AND simu_id % 7 = 1, 2, IF(day = 15 AND simu_id % 6 = 2, 0, 1))",
}
BROKEN_SQL = (
    "(SELECT scenario, simu_id, day, P, NGi, NGr, RGi, RGb, vaccination_scenario, cum_I, cum_B, cum_thinning, "
    "CASE WHEN day = 20 AND simu_id % 3 = 0 THEN NG + 1 WHEN day = 21 AND simu_id % 5 = 0 THEN NULL ELSE NG END AS NG, "
    "CASE WHEN day = 25 AND simu_id % 4 = 0 THEN cum_mort + 100000 ELSE cum_mort END AS cum_mort, "
    "CASE WHEN scenario = '2' AND simu_id % 2 = 0 THEN NULL WHEN scenario = '4' THEN beta + day ELSE beta END AS beta "
    "FROM panel JOIN (SELECT range AS copy FROM range(2)) c ON c.copy < CASE WHEN day = 10 AND simu_id % 7 = 1 THEN 2 "
    "WHEN day = 15 AND simu_id % 6 = 2 THEN 0 ELSE 1 END)"
)


@query(
    "r20_panel_quality",
    f"SELECT 'cells' AS item, count(*) AS n FROM (SELECT DISTINCT scenario, simu_id, day FROM {BROKEN_SQL}) "
    f"UNION ALL SELECT 'shares', count(*) FROM {BROKEN_SQL} WHERE NG + NGi + NGr + RGi + RGb <> P "
    f"UNION ALL SELECT 'NG_missing', count(*) FROM {BROKEN_SQL} WHERE NG IS NULL "
    f"UNION ALL SELECT 'duplicate_day', coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM {BROKEN_SQL} GROUP BY scenario, simu_id, day) "
    f"UNION ALL SELECT 'missing_day', count(*) FROM (SELECT day - lag(day) OVER (PARTITION BY scenario, simu_id ORDER BY day) AS step "
    f"FROM (SELECT DISTINCT scenario, simu_id, day FROM {BROKEN_SQL})) WHERE step > 1 "
    f"UNION ALL SELECT 'cum_mort_falls', count(*) FROM (SELECT cum_mort - lag(cum_mort) OVER (PARTITION BY scenario, simu_id ORDER BY day) AS step "
    f"FROM {BROKEN_SQL}) WHERE step < 0 "
    "UNION ALL SELECT 'varying_inputs', count(*) FROM (SELECT scenario FROM "
    f"{BROKEN_SQL} GROUP BY scenario HAVING min(beta) <> max(beta) OR (count(beta) > 0 AND count(beta) < count(*)))",
)
def r20(spark, sf):
    path = shared_dir(spark, "broken-panel")
    rows = by_days(spark, sf)
    changed = rows.withColumns({c: F.expr(e) for c, e in BROKEN.items()})
    changed.withColumn("copies", F.expr("explode(array_repeat(0, copies))")).drop("copies").write.parquet(path)
    # From here on the stored panel is read; the feed is scanned once.
    rows = spark.read.schema(rows.schema).parquet(path)

    def counted(df, item):
        return df.agg(F.lit(item).alias("item"), F.count(F.lit(1)).alias("n"))

    return summary.combine(
        counted(rows.select(*FLOCK, "day").distinct(), "cells"),
        quality.panel_violations(rows).groupBy(F.col("rule").alias("item")).agg(F.count(F.lit(1)).alias("n")),
        counted(quality.varying_inputs(rows, ["vaccination_scenario", "beta"]), "varying_inputs"),
    )


@query(
    "r20_parameter_quality",
    "SELECT scenario, simu_id, step, 'beta' AS parameter, CAST(beta AS VARCHAR) AS value, "
    "'above 0.5' AS problem FROM panel WHERE beta > 0.5 "
    "UNION ALL SELECT scenario, simu_id, step, 'cum_mort', CAST(cum_mort AS VARCHAR), 'below 25' "
    "FROM panel WHERE cum_mort < 25",
)
def r20_parameters(spark, sf):
    rules = {
        "beta": quality.Rule("numeric", high=0.5),
        "cum_mort": quality.Rule("integer", low=25),
        "scenario": quality.Rule("text"),
    }
    return quality.parameter_violations(counts(spark, sf), rules, [*FLOCK, "step"])


LISTS_SQL = (
    "(SELECT scenario, simu_id, list(CASE WHEN day % 10 = 0 THEN NULL ELSE cum_mort END ORDER BY day) "
    "FILTER (day > 38) AS deaths FROM panel GROUP BY ALL)"
)


@query(
    "r20_list_quality",
    "SELECT scenario, simu_id, 'deaths' AS parameter, CAST(NULL AS VARCHAR) AS value, 'fewer than 4 elements' AS problem "
    f"FROM {LISTS_SQL} WHERE coalesce(len(deaths), 0) < 4 UNION ALL "
    "SELECT scenario, simu_id, 'deaths', CAST(d AS VARCHAR), CASE WHEN d IS NULL THEN 'missing' ELSE 'above 3000' END "
    f"FROM (SELECT scenario, simu_id, unnest(deaths) AS d FROM {LISTS_SQL}) WHERE d IS NULL OR d > 3000",
)
def r20_lists(spark, sf):
    late = by_days(spark, sf).groupBy(*FLOCK).agg(
        F.expr("transform(array_sort(collect_list(IF(day > 38, struct(day, IF(day % 10 = 0, NULL, cum_mort) AS n), NULL))), x -> x.n)").alias("deaths")
    )
    return quality.list_violations(late, {"deaths": quality.Rule("integer", high=3000)}, FLOCK, min_length=4)


@query(
    "r21_streaming_alarm",
    "SELECT scenario, simu_id, alarm AS day, CAST(max(CASE WHEN day = alarm THEN new_d END) AS BIGINT) AS deaths "
    "FROM alarmed WHERE alarm < (SELECT CAST(date_diff('day', DATE '2024-01-01', "
    "CAST(max(ts) - INTERVAL 1 DAY AS DATE)) AS INTEGER) + 12 FROM events WHERE event_type = 'error') "
    "GROUP BY ALL",
)
def r21(spark, sf):
    files = spark.readStream.schema(feed.EVENTS_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf)
    deaths = files.filter("event_type = 'error'").selectExpr(
        "CAST(ts AS TIMESTAMP) AS ts",
        *named(feed.FLOCK_OF_USER),
        f"{feed.BIRDS_PER_EVENT['error']} AS deaths",
    )
    rule = alarm_stream.AlarmRule(
        feed.INITIAL_BIRDS, feed.TREATMENT_TRIGGER, feed.THINNING_TIME, feed.THINNING_NUMBER
    )
    alarm_stream.with_rocksdb(spark)
    alarms = alarm_stream.stream_alarms(
        deaths, rule, str(feed.FEED_START), feed.FIRST_EVENT_DAY, lateness="1 day"
    )
    output = shared_dir(spark, "alarms")
    alarm_stream.run_until_drained(alarms, output, shared_dir(spark, "alarm-state"))
    return spark.read.schema(alarms.schema).parquet(output).select(*FLOCK, "day", "deaths")


ROUND_RULE = alarm_stream.AlarmRule(feed.INITIAL_BIRDS, 0.0008, 8, feed.THINNING_NUMBER, last_day=11)


@query(
    "r21_rounds_in_stream",
    "SELECT * FROM (WITH d AS (SELECT CAST(user_id % 6 AS VARCHAR) AS scenario, user_id // 6 AS simu_id, CAST(ts AS DATE) AS date, "
    "CAST(25 * count(*) AS BIGINT) AS deaths FROM events WHERE event_type = 'error' GROUP BY ALL), "
    "r AS (SELECT DISTINCT scenario, simu_id, CAST(DATE '2024-01-02' + CAST(simu_id % 3 + k AS INTEGER) AS DATE) AS start "
    "FROM d, (SELECT unnest([0, 14]) AS k)), "
    "c AS (SELECT scenario, simu_id, start, CAST(date_diff('day', start, date) AS INTEGER) AS day, deaths FROM d JOIN r USING (scenario, simu_id) "
    "WHERE date_diff('day', start, date) BETWEEN 0 AND 11 AND date < (SELECT CAST(max(ts) - INTERVAL 1 DAY AS DATE) FROM events WHERE event_type = 'error')), "
    "s AS (SELECT *, 30000 - CASE WHEN day - 1 >= 8 THEN 7500 ELSE 0 END - coalesce(sum(deaths) OVER "
    "(PARTITION BY scenario, simu_id, start ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS birds FROM c) "
    "SELECT scenario, simu_id, CAST(start AS VARCHAR) AS start, min(day) AS day, arg_min(deaths, day) AS deaths FROM s "
    "WHERE day > 0 AND deaths / birds > 0.0008 GROUP BY ALL)",
)
def r21_rounds(spark, sf):
    # Every flock has two rounds of twelve days, at dates of its own.
    files = spark.readStream.schema(feed.EVENTS_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf)
    deaths = files.filter("event_type = 'error'").selectExpr(
        "CAST(ts AS TIMESTAMP) AS ts", *named(feed.FLOCK_OF_USER), f"{feed.BIRDS_PER_EVENT['error']} AS deaths"
    )
    flocks = feed.read_events(spark, sf).selectExpr(*named(feed.FLOCK_OF_USER)).distinct()
    rounds = flocks.selectExpr(*FLOCK, "explode(array(0, 14)) AS _k").selectExpr(*FLOCK, "date_add(DATE '2024-01-02', CAST(simu_id % 3 + _k AS INT)) AS start")
    alarm_stream.with_rocksdb(spark)
    alarms = alarm_stream.stream_rounds(deaths, rounds, ROUND_RULE)
    output = shared_dir(spark, "alarms")
    alarm_stream.run_until_drained(alarms, output, shared_dir(spark, "alarm-state"))
    return spark.read.schema(alarms.schema).parquet(output).select(*FLOCK, F.col("start").cast("string").alias("start"), "day", "deaths")


# --- public functions --------------------------------------------------------------

same(
    "k01_interpret",
    daily,
    "daily",
    f"{DAY} red_grow_IB red_grow_B total_birds normal_growing_birds treatment_start",
    "p_normal p_IB p_B p_lesions p_no_lesions mortality resp_signs peak_resp_signs DG_per_bird "
    "weight_per_bird total_weight thinned_weight total_daily_FI cum_FI FCR_daily",
)
PER_FLOCK_KEYS = (
    f"{DAY} thinning_day treatment_day treated treated_days total_birds n_thinned "
    "early_thinning_triggered early_slaughter_triggered"
)
PER_FLOCK = (
    "thinned_weight FCR_thinning condemned_thinning n_condemned_thinning slaughter_weight_thinning "
    "weight_per_bird_thinning treated_kg treatment_cost condemned_end n_condemned_end "
    "condemned_total delivered_weight_end slaughter_weight_end slaughter_weight_total "
    "weight_revenue feed_cost vaccination_cost avg_BW delta DDD_year"
)
same("k02_per_simulation", per_flock, "outcomes", PER_FLOCK_KEYS, PER_FLOCK)
same(
    "k02_per_simulation_joined",
    lambda spark, sf: outcomes.per_simulation_joined(daily(spark, sf)),
    "outcomes",
    PER_FLOCK_KEYS,
    PER_FLOCK,
)
same("k03_per_scenario", summarised, "summary", "scenario n growth_factor", SUMMARY_MEASURES)


@query(
    "k04_check_scenarios",
    "SELECT count(*) AS n_simulations, arg_min(n, scenario) AS n_rounds, "
    "CASE WHEN count(DISTINCT n) > 1 THEN 0 ELSE 1 END AS n_rounds_constant, "
    "array_to_string(list_sort(list(DISTINCT vaccination_scenario)), ',') AS vaccination_scenario "
    "FROM summary",
)
def k04(spark, sf):
    return _checked(spark, sf).select(
        "n_simulations", "n_rounds", "n_rounds_constant", joined_values("vaccination_scenario")
    )


@query(
    "k05_publication",
    "SELECT vaccination_scenario, introduction_time, early_slaughter, prop_bact_factor, "
    + ", ".join(f"round({c}, 1) AS {c}" for c in PUBLISHED)
    + " FROM summary",
)
def k05(spark, sf):
    return summary.publication(summarised(spark, sf), digits=1)


# --- whole studies -----------------------------------------------------------------

same("panel_from_events", counts, "panel", f"{KEY} {RAW_INTS} introduction_time", RAW_DOUBLES)
FLAGSHIP = "mean_end_weight mean_cum_FI mean_FCR mean_delta"
same("flagship_scenario_means", summarised, "summary", "scenario n", FLAGSHIP)
