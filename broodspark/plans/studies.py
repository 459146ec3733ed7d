"""The whole studies: files in, result tables out.

Each scenario study writes its daily grain first, bucketed by flock, and works on from the written
table, so the counts are read and accumulated once and the next step needs no exchange of the days. The
sensitivity study accumulates the days of each tree once and writes its summary. Every study checks its
parameters first, and publishes its tables together at its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broodspark.functions.small import literal_table
from broodspark.operators import daily as daily_ops
from broodspark.operators import grids
from broodspark.operators import outcomes as outcome_ops
from broodspark.operators import production as production_ops
from broodspark.operators import quality, sweep
from broodspark.operators import summary as summary_ops
from broodspark.operators.outcomes import Economics
from broodspark.sources import counts as counts_source
from broodspark.sources import production as production_source
from broodspark.sources import sinks

GRAINS = {
    "days": "output_all_days",
    "simulations": "output",
    "summary": "output_summarised",
}


def build_production(
    spark: SparkSession,
    healthy_path: str,
    output_path: str,
    response: dict[str, float] | None = None,
) -> str:
    """Production table from the healthy production input, one CSV row per day."""
    check_prices(spark, sweep.economic_rows(variations={}), response)
    healthy = production_source.read_healthy_production(spark, healthy_path)
    table = production_ops.wide(production_ops.production_table(healthy, response))
    # One row per day of a round, so one file.
    return sinks.write_csv(table.orderBy("day").coalesce(1), output_path)


def check_prices(spark: SparkSession, rows: list[dict], response: dict[str, float] | None = None) -> None:
    """Stop with the broken rules if a parameter is out of its range, missing, or of the wrong kind."""
    names = ["param_id", *(n for n in quality.ECONOMIC_RULES if n in rows[0])]
    kinds = {n: "string" if isinstance(rows[0][n], str) else "double" for n in names[1:]}
    wrong = [(r["param_id"], n) for r in rows for n in names[1:] if isinstance(r[n], str) != (kinds[n] == "string") and r[n] is not None]
    found = [f"row {i}: {n} has another kind than in the first row" for i, n in wrong]
    if not found:
        schema = ", ".join(["param_id int", *(f"{n} {k}" for n, k in kinds.items())])
        table = literal_table(spark, rows, schema)
        rules = {n: quality.ECONOMIC_RULES[n] for n in names[1:]}
        broken = quality.parameter_violations(table, rules, ["param_id"]).orderBy("param_id", "parameter").take(20)
        found = [f"row {r['param_id']}: {r['parameter']} = {r['value']} is {r['problem']}" for r in broken]
    for name, value in (response or {}).items():
        rule = quality.ECONOMIC_RULES.get(name)
        if rule and (value is None or (rule.low is not None and value < rule.low) or (rule.high is not None and value > rule.high)):
            found.append(f"{name} = {value} is out of range")
    if found:
        raise ValueError("; ".join(found))


def _write_grains(
    counts: DataFrame,
    production: DataFrame,
    output_dir: str,
    run_date: str,
    prices: Economics,
    growth: str,
    fmt: str,
    left_out: Observation | None = None,
) -> dict[str, DataFrame]:
    spark = counts.sparkSession
    check_prices(spark, sweep.economic_rows(prices, growth, {}))
    publication = sinks.Publication(spark, output_dir, run_date)

    def stored(df: DataFrame, grain: str) -> DataFrame:
        path = publication.staged(GRAINS[grain])
        sinks.write_result(df, path, run_date, fmt)
        return sinks.read_result(spark, path, run_date, fmt, df.schema).drop("run_date")

    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{publication.staged(GRAINS['days'])}/run_date={run_date}"
    days = sinks.bucketed(daily_ops.interpret(counts, production, growth), path, buckets)
    varying = [(r["input"], r["scenario"]) for r in quality.varying_inputs(days).take(20)]
    if left_out is not None:
        varying += [("introduction_time", r["scenario"]) for r in quality.partly_left_out(days, left_out).take(20)]
    if varying:
        raise ValueError("; ".join(f"{name} varies within scenario {scenario}" for name, scenario in sorted(set(varying))))
    names = list(GRAINS.values())
    if fmt != "parquet":
        names.append(f"{GRAINS['days']}_{fmt}")
        sinks.write_result(days, publication.staged(names[-1]), run_date, fmt)
    simulations = stored(outcome_ops.per_simulation(days, prices), "simulations")
    scenarios = stored(summary_ops.per_scenario(simulations), "summary")
    publication.publish(names)

    def published(grain: str, schema: T.StructType) -> DataFrame:
        return sinks.read_result(spark, f"{output_dir}/{GRAINS[grain]}", run_date, fmt, schema).drop("run_date")

    return {
        "days": sinks.read_bucketed(spark, days.schema, f"{output_dir}/{GRAINS['days']}/run_date={run_date}", buckets),
        "simulations": published("simulations", simulations.schema),
        "summary": published("summary", scenarios.schema),
    }


def compare_scenarios(
    spark: SparkSession,
    input_dir: str,
    production_path: str,
    output_dir: str,
    run_date: str,
    prices: Economics = Economics(),
    growth: str = "middle",
    fmt: str = "parquet",
    skip_introduction: int = 7,
) -> dict[str, DataFrame]:
    """Daily, per-simulation and per-scenario tables of a tree of scenario folders.

    Also returns ``check``: how many scenarios, whether their rounds agree, values used.
    """
    left_out = Observation("left_out")
    counts = outcome_ops.without_introduction_time(
        counts_source.read_counts(spark, input_dir), skip_introduction, left_out
    )
    production = production_source.read_production(spark, production_path)
    tables = _write_grains(counts, production, output_dir, run_date, prices, growth, fmt, left_out)
    return tables | {"check": summary_ops.check(tables["summary"])}


def healthy_baseline(
    spark: SparkSession,
    input_file: str,
    production_path: str,
    output_dir: str,
    run_date: str,
    prices: Economics = Economics(),
    growth: str = "middle",
    fmt: str = "parquet",
) -> dict[str, DataFrame]:
    """The three tables of the run without infection, as scenario ``healthy``."""
    counts = counts_source.read_counts(spark, input_file, scenario="healthy")
    production = production_source.read_production(spark, production_path)
    return _write_grains(counts, production, output_dir, run_date, prices, growth, fmt)


def smallest_files(spark: SparkSession, path: str) -> dict[str, str]:
    """One file of each scenario folder, the smallest; one path per folder, as many as the grid has rows."""
    files = counts_source.list_files(spark, path)
    one = files.groupBy("scenario").agg(F.min_by("path", F.struct("length", "path")).alias("path"))
    return {r["scenario"]: r["path"] for r in one.collect()}


def only_default(counts: DataFrame) -> str:
    """The name of the default scenario; none or several matching scenarios is an error."""
    chosen = outcome_ops.default_scenario(counts)
    found = [row["scenario"] for row in quality.single_match(chosen).limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"the default scenario matches {found or 'no folder'}, one is needed")
    return found[0]


def default_runs(spark: SparkSession, scenario_dir: str) -> DataFrame:
    """Counts of the default scenario of a tree.

    Its inputs are the same in all files of a folder, so one file per folder, the smallest,
    is read to find it; the other folders are not parsed. That the inputs do not vary is then checked on
    the folder itself.
    """
    folders = smallest_files(spark, scenario_dir)
    name = only_default(counts_source.read_counts(spark, list(folders.values())))
    chosen = counts_source.read_counts(spark, counts_source.parent_of(folders[name]))
    varying = quality.varying_inputs(chosen, list(outcome_ops.DEFAULT_SCENARIO)).collect()
    if varying:
        raise ValueError(f"inputs vary within scenario {name}: {', '.join(r['input'] for r in varying)}")
    return chosen


def sensitivity(
    spark: SparkSession,
    scenario_dir: str,
    sensitivity_dir: str,
    production_path: str,
    output_dir: str,
    run_date: str,
    fmt: str = "parquet",
    as_written: bool = False,
    prices: Economics = Economics(),
    growth: str = "middle",
    variations: dict[str, list] | None = None,
    grid: DataFrame | None = None,
) -> DataFrame:
    """Summary rows of the simulator sensitivity runs and of the economic variations.

    The economic part varies prices and growth (``variations``) around ``prices`` and ``growth`` in the default scenario of
    ``scenario_dir``. Runs are numbered on from one part to the other. What a simulator run varies is read off its inputs, in one
    file of each folder, by the values of ``grid`` (the one-at-a-time grid if none is given); runs without a name are
    listed in ``sens_label_problems``. How the simulator runs agree in their rounds and inputs is in ``sensitivity_check``.
    """
    rows = sweep.economic_rows(prices, growth, variations)
    check_prices(spark, rows)
    production = production_source.read_production(spark, production_path)
    runs = counts_source.read_counts(spark, sensitivity_dir)
    ordinals = counts_source.scenario_ordinals(counts_source.list_files(spark, sensitivity_dir))
    labels = sweep.run_labels(
        counts_source.read_counts(spark, list(smallest_files(spark, sensitivity_dir).values())),
        grids.oat_grid(spark) if grid is None else grid,
    )
    publication = sinks.Publication(spark, output_dir, run_date)
    problems, summarised = "sens_label_problems", "sens_output_summarised"
    # A partition of its own even if no run has a problem.
    labels.filter("problem IS NOT NULL").write.format(fmt).options(header=True).save(f"{publication.staged(problems)}/run_date={run_date}")
    named_runs = sweep.name_runs(sweep.simulator_sweep(runs, production, growth, prices=prices), ordinals, labels)
    both = sweep.combined_sensitivity(
        named_runs,
        sweep.economic_sweep(default_runs(spark, scenario_dir), production, rows, as_written=as_written),
        simulator_runs=ordinals.agg(F.max("ordinal")).first()[0],
    )
    sinks.write_result(both, publication.staged(summarised), run_date, fmt)
    publication.publish([problems, summarised])
    return sinks.read_result(spark, f"{output_dir}/{summarised}", run_date, fmt, both.schema).drop("run_date")


def sensitivity_check(both: DataFrame) -> DataFrame:
    """The scenario check over the simulator rows of a sensitivity table."""
    return summary_ops.check(both.filter("kind = 'simulator'"))
