"""The checking SQL: the same tables as the library, as common table expressions.

Written for DuckDB, over the ``events`` view. Each query in ``pairs`` adds a final SELECT.
"""

from __future__ import annotations

# Fixed values, written out here on their own: inputs of a scenario, echoed parameters, and the
# measures of the summary with the column and the divisor that each is taken from.
INPUTS = (
    "vaccination_scenario introduction_time early_slaughter beta recovery t_until_bact_inf prop_bact_factor "
    "duration_reduced_growth length_B mortality_I mortality_B treatment_trigger"
).split()
ECHOES = (
    "condemnation_B AS condemnation_B, growth_factor AS growth_factor, slaughter_price AS slaughter_price, "
    "feed_price AS feed_price, ab_price_per_chick AS ab_price_per_chick, ab_price_constant AS ab_price_constant, "
    "vaccine_price_per_chick AS vaccine_price"
).split(", ")
MEASURES = (
    "p_prevalence=percentage_prevalence/100 p_resp_signs=resp_signs/1 p_secondary=percentage_prevalence_secondary/100 "
    "peak_resp_signs=peak_resp_signs/1 cum_clin_IB=cum_I/1 cum_secondary=cum_B/1 end_weight=total_weight/1 avg_BW=avg_BW/1 "
    "weight_revenue=weight_revenue/1 cum_FI=cum_FI/1 FCR=FCR_daily/1 delta=delta/1 cond=condemned_total/1 feed_cost=feed_cost/1 "
    "mort=mortality/1 treatment_cost=treatment_cost/1 kg_treated=treated_kg/1 DDD_year=DDD_year/1"
).split()

FLOCK_DAY = "PARTITION BY scenario, simu_id ORDER BY day"
GROWN_DAY = "PARTITION BY scenario, simu_id, growth_factor ORDER BY day"
RUNNING = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"

LOG = """
log AS (
  SELECT CAST(user_id % 6 AS VARCHAR) AS scenario,
         CAST((user_id - user_id % 6) // 6 AS BIGINT) AS simu_id,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) + 12 AS day,
         event_type AS state
  FROM events
),
days AS (SELECT CAST(range AS INTEGER) AS day FROM range(43)),
flocks AS (SELECT DISTINCT scenario, simu_id FROM log),
logged AS (
  SELECT scenario, simu_id, day,
         CAST(100 * count(*) FILTER (state = 'click') AS BIGINT) AS new_i,
         CAST(40 * count(*) FILTER (state = 'purchase') AS BIGINT) AS new_b,
         CAST(25 * count(*) FILTER (state = 'error') AS BIGINT) AS new_d,
         CAST(20 * count(*) FILTER (state = 'view') AS BIGINT) AS new_s
  FROM log GROUP BY ALL
),
entries AS (
  SELECT f.scenario, f.simu_id, d.day,
         coalesce(l.new_i, 0) AS new_i, coalesce(l.new_b, 0) AS new_b,
         coalesce(l.new_d, 0) AS new_d, coalesce(l.new_s, 0) AS new_s
  FROM flocks f CROSS JOIN days d
  LEFT JOIN logged l ON l.scenario = f.scenario AND l.simu_id = f.simu_id AND l.day = d.day
)"""

PANEL = f"""
counted AS (
  SELECT *,
    CAST(sum(new_i) OVER ({FLOCK_DAY} {RUNNING}) AS BIGINT) AS cum_I,
    CAST(sum(new_b) OVER ({FLOCK_DAY} {RUNNING}) AS BIGINT) AS cum_B,
    CAST(sum(new_d) OVER ({FLOCK_DAY} {RUNNING}) AS BIGINT) AS cum_mort,
    CAST(sum(new_i) OVER ({FLOCK_DAY} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS NGi,
    CAST(coalesce(sum(new_i) OVER ({FLOCK_DAY} ROWS BETWEEN 9 PRECEDING AND 2 PRECEDING), 0) AS BIGINT) AS RGi,
    CAST(sum(new_b) OVER ({FLOCK_DAY} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS BIGINT) AS B,
    CAST(sum(new_s) OVER ({FLOCK_DAY} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS RS
  FROM entries
),
alarmed AS (
  SELECT *,
    CASE WHEN CAST(scenario AS INTEGER) >= 3 THEN 1 ELSE 0 END AS early_slaughter,
    (CAST(scenario AS INTEGER) % 3) / 2.0::DOUBLE AS vaccination_scenario,
    min(CASE WHEN day > 0 AND new_d > 0.002::DOUBLE * (30000 - (cum_mort - new_d)
        - CASE WHEN day - 1 >= 34 THEN 7500 ELSE 0 END) THEN day END)
      OVER (PARTITION BY scenario, simu_id) AS alarm
  FROM counted
),
dated AS (
  SELECT *,
    CASE WHEN early_slaughter = 1 AND alarm BETWEEN 30 AND 33 THEN alarm + 1 ELSE 34 END AS thinning_time,
    CASE WHEN early_slaughter = 1 AND alarm BETWEEN 38 AND 41 THEN alarm + 1 ELSE 42 END AS slaughter_time
  FROM alarmed
),
flagged AS (
  SELECT *,
    CASE WHEN (day > thinning_time - 5 AND day <= thinning_time) OR day > slaughter_time - 5
         THEN 0 ELSE 1 END AS treatment_allowed,
    CASE WHEN day >= alarm THEN 1 ELSE 0 END AS treatment_triggered,
    CAST(CASE WHEN day >= thinning_time THEN 7500 ELSE 0 END AS BIGINT) AS cum_thinning,
    CASE WHEN day > 0 THEN 30000 - (cum_mort - new_d)
         - CASE WHEN day > thinning_time THEN 7500 ELSE 0 END ELSE 0 END AS previous_flock_size
  FROM dated
),
full_panel AS (
  SELECT *,
    1 - max(treatment_allowed * treatment_triggered) OVER ({FLOCK_DAY} {RUNNING}) AS not_yet_treated,
    30000 - cum_mort - cum_thinning AS P,
    30000 - cum_mort - cum_thinning - NGi - RGi - B AS NG,
    0::BIGINT AS NGr, B AS RGb, cum_B - B AS RL, 0::BIGINT AS I0, NGi + RGi AS I, 0::BIGINT AS De,
    'population' AS level, 0 AS agent_id,
    14 AS introduction_time, 1.0::DOUBLE AS prop_bact_factor,
    CASE vaccination_scenario WHEN 0 THEN 0.78::DOUBLE WHEN 0.5 THEN 0.48::DOUBLE ELSE 0.17::DOUBLE END AS beta,
    CASE WHEN vaccination_scenario = 1 THEN 1 / 3.5::DOUBLE ELSE 1 / 12::DOUBLE END AS recovery,
    CASE WHEN vaccination_scenario = 0.5 THEN 0.9::DOUBLE - 0.1::DOUBLE ELSE 0.9::DOUBLE END AS prop_clinical,
    0.002::DOUBLE AS treatment_trigger,
    1.3::DOUBLE * 0.000725::DOUBLE AS mortality_I, 0.4::DOUBLE / 14 AS mortality_B,
    2 AS time_before_reduced_growth, 8 AS duration_reduced_growth,
    5 AS t_until_bact_inf, 14 AS length_B
  FROM flagged
),
panel AS (
  SELECT * EXCLUDE (day), day AS step, day,
    100.0::DOUBLE * cum_mort / 30000 AS percentage_mortality,
    100.0::DOUBLE * (I0 + I) / P AS percentage_prevalence,
    100.0::DOUBLE * B / P AS percentage_prevalence_secondary,
    100.0::DOUBLE * RL / P AS percentage_prevalence_recovered_lesions,
    100.0::DOUBLE * (RS + B) / P AS percentage_total_resp_signs,
    CASE WHEN day > 0 THEN 100.0::DOUBLE * new_d / previous_flock_size END AS percentage_daily_mortality
  FROM full_panel WHERE day <= slaughter_time
)"""

PRODUCTION = """
strengths(growth_factor, strength) AS (
  VALUES ('low', 0.5::DOUBLE), ('middle', 1.0::DOUBLE), ('high', 2.0::DOUBLE)
),
multipliers AS (
  SELECT growth_factor, strength,
    1 - 0.05::DOUBLE * strength AS dg_mult_IB, 1 - 0.2::DOUBLE * strength AS dg_mult_B,
    1 + 0.03::DOUBLE * strength AS fcr_mult_IB, 1 + 0.07::DOUBLE * strength AS fcr_mult_B,
    (1 - 0.05::DOUBLE * strength) * (1 + 0.03::DOUBLE * strength) AS fi_mult_IB,
    (1 - 0.2::DOUBLE * strength) * (1 + 0.07::DOUBLE * strength) AS fi_mult_B
  FROM strengths
),
healthy AS (
  SELECT day,
    CASE WHEN day = 0 THEN 44.0::DOUBLE ELSE 13 + 2.6::DOUBLE * day END AS DG_healthy,
    CASE WHEN day IN (0, 1) THEN 0.0::DOUBLE ELSE 10 + 4.0::DOUBLE * day END AS FI_healthy
  FROM days
),
production AS (
  SELECT day, growth_factor, DG_healthy, FI_healthy,
    CASE WHEN day = 0 THEN 44.0::DOUBLE ELSE dg_mult_IB * DG_healthy END AS DG_IB,
    CASE WHEN day = 0 THEN 44.0::DOUBLE ELSE dg_mult_B * DG_healthy END AS DG_B,
    fi_mult_IB * FI_healthy AS FI_IB, fi_mult_B * FI_healthy AS FI_B
  FROM healthy CROSS JOIN multipliers
)"""

DAILY = f"""
flock_days AS (
  SELECT * EXCLUDE (step, RGi, RGb, P, level, agent_id, De),
    RGi AS red_grow_IB, RGb AS red_grow_B, P AS total_birds,
    NG + NGi + NGr AS normal_growing_birds,
    (NG + NGi + NGr)::DOUBLE / P AS p_normal, RGi::DOUBLE / P AS p_IB, RGb::DOUBLE / P AS p_B,
    round_even((NG + NGi + NGr)::DOUBLE / P + RGi::DOUBLE / P + RGb::DOUBLE / P, 0) AS p_tot,
    (B + RL)::DOUBLE / P AS p_lesions, (P - (B + RL))::DOUBLE / P AS p_no_lesions,
    percentage_mortality / 100 AS mortality,
    percentage_total_resp_signs / 100 AS resp_signs,
    max(percentage_total_resp_signs / 100) OVER (PARTITION BY scenario, simu_id) AS peak_resp_signs,
    CASE WHEN not_yet_treated = 0 AND lag(not_yet_treated, 1, 1) OVER ({FLOCK_DAY}) = 1
         THEN 1 ELSE 0 END AS treatment_start
  FROM panel
),
fed AS (
  SELECT f.*, p.* EXCLUDE (day),
    p_normal * DG_healthy + p_IB * DG_IB + p_B * DG_B AS DG_per_bird,
    (normal_growing_birds * FI_healthy + red_grow_IB * FI_IB + red_grow_B * FI_B) / 1000 AS total_daily_FI
  FROM flock_days f LEFT JOIN production p ON p.day = f.day
),
summed AS (
  SELECT *,
    sum(DG_per_bird) OVER ({GROWN_DAY} {RUNNING}) / 1000 AS weight_per_bird,
    sum(total_daily_FI) OVER ({GROWN_DAY} {RUNNING}) AS cum_FI
  FROM fed
),
daily3 AS (
  SELECT *, weight_per_bird * total_birds AS total_weight,
    weight_per_bird * cum_thinning AS thinned_weight,
    cum_FI / (weight_per_bird * total_birds + weight_per_bird * cum_thinning) AS FCR_daily
  FROM summed
),
daily AS (SELECT * FROM daily3 WHERE growth_factor = 'middle')"""

# Base prices, and one change per row of the sweep.
_BASE = {
    "growth_factor": "middle", "DOA": 0.0014, "condemnation_base": 0.005, "condemnation_B": 1.0,
    "slaughter_price": 1.12, "feed_price": 0.374, "ab_price_per_chick": 0.02,
    "ab_price_constant": 178.0, "vaccine_price_per_chick": 0.01, "n_birds": 30000,
}
_CHANGES = [
    ("none", "base"), ("condemnation_B", 0.5), ("growth_factor", "low"),
    ("growth_factor", "high"), ("slaughter_price", 0.56), ("slaughter_price", 2.24),
    ("feed_price", 0.187), ("feed_price", 0.748), ("ab_price_per_chick", 0.01),
    ("ab_price_per_chick", 0.04),
]


def _literal(value) -> str:
    if isinstance(value, str):
        return f"'{value}'"
    return f"{value}::DOUBLE" if isinstance(value, float) else str(value)


def _param_row(number: int, name: str, value) -> str:
    changed = _BASE | ({name: value} if name in _BASE else {})
    cells = [number, name, str(value), *changed.values()]
    return "(" + ", ".join(_literal(cell) for cell in cells) + ")"


PARAMS = (
    f"params(param_id, varied_param, varied_value, {', '.join(_BASE)}) AS (VALUES\n  "
    + ",\n  ".join(_param_row(n, *change) for n, change in enumerate(_CHANGES))
    + ")"
)

OUTCOMES = f"""
last_days AS (
  SELECT * FROM daily3
  QUALIFY row_number() OVER (PARTITION BY scenario, simu_id, growth_factor ORDER BY day DESC) = 1
),
thinning3 AS (
  SELECT d.scenario, d.simu_id, d.growth_factor, d.day AS thinning_day, d.thinned_weight,
    d.FCR_daily AS FCR_thinning, d.cum_thinning AS n_thinned,
    d.weight_per_bird AS weight_per_bird_thinning,
    d.p_lesions AS p_lesions_thinning, d.p_no_lesions AS p_no_lesions_thinning
  FROM daily3 d JOIN last_days l USING (scenario, simu_id, growth_factor)
  WHERE d.day = l.thinning_time
),
treatment3 AS (
  SELECT scenario, simu_id, growth_factor, min(day) AS treatment_day, 1 AS treated,
    arg_min(total_birds, day) AS treated_flock_size, arg_min(total_weight, day) AS treated_kg,
    3 AS treated_days
  FROM daily3 WHERE treatment_start = 1 GROUP BY ALL
),
collapsed AS (
  SELECT l.* EXCLUDE (thinned_weight), t.* EXCLUDE (scenario, simu_id, growth_factor),
    r.treatment_day, coalesce(r.treated, 0) AS treated,
    coalesce(r.treated_flock_size, 0) AS treated_flock_size,
    coalesce(r.treated_kg, 0.0::DOUBLE) AS treated_kg, coalesce(r.treated_days, 0) AS treated_days
  FROM last_days l
  LEFT JOIN thinning3 t USING (scenario, simu_id, growth_factor)
  LEFT JOIN treatment3 r USING (scenario, simu_id, growth_factor)
),
priced AS (
  SELECT c.*, p.* EXCLUDE (growth_factor),
    condemnation_B * p_lesions_thinning + condemnation_base * p_no_lesions_thinning AS condemned_thinning,
    condemnation_B * p_lesions + condemnation_base * p_no_lesions AS condemned_end,
    thinned_weight - DOA * thinned_weight AS delivered_weight_thinning,
    total_weight - DOA * total_weight AS delivered_weight_end,
    CASE WHEN treated = 1 THEN ab_price_per_chick * treated_flock_size + ab_price_constant
         ELSE 0 END AS treatment_cost,
    CASE WHEN vaccination_scenario = 0 THEN 0 WHEN vaccination_scenario IS NOT NULL THEN vaccine_price_per_chick * n_birds END AS vaccination_cost,
    cum_FI * feed_price AS feed_cost,
    (thinned_weight + total_weight) / (n_thinned + total_birds) AS avg_BW,
    treated_days::DOUBLE / day * 365 AS DDD_year,
    CASE WHEN thinning_day < 34 THEN 1 WHEN thinning_day >= 34 THEN 0 END AS early_thinning_triggered,
    CASE WHEN day < 42 THEN 1 ELSE 0 END AS early_slaughter_triggered
  FROM collapsed c JOIN params p USING (growth_factor)
),
weighed AS (
  SELECT *,
    condemned_thinning * n_thinned AS n_condemned_thinning,
    condemned_end * total_birds AS n_condemned_end,
    (condemned_thinning * n_thinned + condemned_end * total_birds) / (n_thinned + total_birds) AS condemned_total,
    (1 - condemned_thinning) * delivered_weight_thinning AS slaughter_weight_thinning,
    (1 - condemned_end) * delivered_weight_end AS slaughter_weight_end
  FROM priced
),
revenue AS (
  SELECT *, slaughter_weight_thinning + slaughter_weight_end AS slaughter_weight_total,
    (slaughter_weight_thinning + slaughter_weight_end) * slaughter_price AS weight_revenue
  FROM weighed
),
sweep_outcomes AS (
  SELECT *, weight_revenue - feed_cost - treatment_cost - vaccination_cost AS delta FROM revenue
),
outcomes AS (SELECT * FROM sweep_outcomes WHERE param_id = 0)"""


def _summary_expressions() -> str:
    parts = ["scenario", "param_id", "any_value(varied_param) AS varied_param",
             "any_value(varied_value) AS varied_value", "count(*) AS n"]
    parts += [f"arg_min({c}, simu_id) AS {c}" for c in INPUTS]
    parts += [f"any_value({c}) AS {name}" for c, name in (e.split(" AS ") for e in ECHOES)]
    for measure in MEASURES:
        name, _, source = measure.partition("=")
        column, _, divisor = source.partition("/")
        scale = f" / {divisor}" if divisor != "1" else ""
        for stat, function in (("mean", "avg"), ("min", "min"), ("max", "max")):
            parts.append(f"{function}({column}){scale} AS {stat}_{name}")
    parts += [
        "avg(thinned_weight) AS mean_thinned_weight",
        "avg(early_thinning_triggered) AS early_thinning_triggered",
        "avg(early_slaughter_triggered) AS early_slaughter_triggered",
        "avg(vaccination_cost) AS vaccination_cost",
        "avg(treatment_triggered) AS fraction_treatment_triggered",
        "avg(treated) AS fraction_treated",
    ]
    for stat in ("median", "min", "max"):
        value = f"{stat}(treatment_day)"
        parts.append(
            f"CASE WHEN count(treatment_day) = count(*) THEN {value} END AS {stat}_treatment_day"
        )
        parts.append(f"{value} AS {stat}_treatment_day_known")
    return ",\n    ".join(parts)


SUMMARY = f"""
sweep_summary AS (
  SELECT {_summary_expressions()}
  FROM sweep_outcomes GROUP BY scenario, param_id
),
summary AS (SELECT * FROM sweep_summary WHERE param_id = 0)"""

WITH = "WITH " + ",".join([LOG, PANEL, PRODUCTION, DAILY, "\n" + PARAMS, OUTCOMES, SUMMARY])


def over(select: str) -> str:
    return f"{WITH}\n{select}"
