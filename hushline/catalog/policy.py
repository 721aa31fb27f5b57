"""Queries over calibration case tables: bounds, splits, candidate grids, calibration and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushline.catalog.registry import query
from hushline.catalog.scores import round_all, rounded, spearman_sql
from hushline.catalog.views import Views
from hushline.functions.numeric import d, wilson_upper
from hushline.operators import joins, policy
from hushline.schemas import GROUP


def wilson_sql(s: str, n: str) -> str:
    z = "1.959963984540054e0"
    p = f"({s} / CAST({n} AS DOUBLE))"
    return f"""CASE WHEN {n} > 0 THEN greatest(0e0, least(1e0, ({p} + {z}*{z} / (2e0*{n}) + {z} * sqrt({p} * (1e0 - {p}) / {n} + {z}*{z} / (4e0*{n}*{n})))
      / (1e0 + {z}*{z} / {n}))) ELSE 1e0 END"""


@query(
    "a23_wilson_upper",
    sql=f"""WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS successes, count(*) FILTER (event_type IN ('error','view')) AS trials FROM events GROUP BY user_id)
    SELECT user_id, successes, trials, round({wilson_sql('successes', 'trials')}, 6) + 0e0 AS upper FROM c""",
)
def a23(v: Views) -> DataFrame:
    counts = v.table("events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "error").alias("successes"),
        F.count_if(F.col("event_type").isin("error", "view")).alias("trials"),
    )
    return rounded(counts.withColumn("upper", wilson_upper(F.col("successes"), F.col("trials"))))


SPLIT_SQL = """sp AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY case_id) <= greatest(1, least(round_even(count(*) OVER () * 0.5e0, 0), count(*) OVER () - 1))
    THEN 'calibration' ELSE 'holdout' END AS split FROM cases)"""


@query("a22_leading_split", "cases", f"WITH {SPLIT_SQL} SELECT case_id, split FROM sp")
def a22(v: Views) -> DataFrame:
    return policy.leading_split(v.cases, "case_id").select("case_id", "split")


PERCENTS = ", ".join(f"{p / 100}" for p in range(5, 100, 5))


def grid_sql(source: str) -> str:
    """CTEs ``grid`` (every candidate pair against every case) and ``pol`` (the chosen pair)."""
    return f"""rc AS (SELECT DISTINCT unnest(quantile_cont(risk_score, [{PERCENTS}])) AS risk_max FROM {source}),
    bc AS (SELECT DISTINCT unnest(quantile_cont(estimated_noise_reduction_db, [{PERCENTS}])) AS benefit_min_db FROM {source}),
    pairs AS (SELECT risk_max, benefit_min_db, count(*) FILTER (risk_score <= risk_max AND estimated_noise_reduction_db >= benefit_min_db) AS accepted,
      count(*) FILTER (risk_score <= risk_max AND estimated_noise_reduction_db >= benefit_min_db AND NOT is_safe) AS false_safe, count(*) AS total
      FROM rc, bc, {source} GROUP BY risk_max, benefit_min_db),
    grid AS (SELECT *, accepted / CAST(total AS DOUBLE) AS coverage, false_safe / CAST(greatest(accepted, 1) AS DOUBLE) AS rate, {wilson_sql('false_safe', 'accepted')} AS upper FROM pairs),
    f AS (SELECT *, accepted > 0 AND rate <= 0.05e0 AND upper <= 0.10e0 AS feasible FROM grid),
    pol AS (SELECT risk_max, benefit_min_db, total AS calibration_cases, rate AS calibration_false_safe_rate, coverage AS calibration_coverage, feasible FROM f
      ORDER BY feasible DESC, CASE WHEN feasible THEN coverage ELSE -upper END DESC, CASE WHEN feasible THEN -upper ELSE coverage END DESC,
        rate ASC, risk_max ASC, benefit_min_db DESC LIMIT 1)"""


@query(
    "j10_threshold_grid",
    "cases",
    f"WITH {grid_sql('cases')} SELECT round(risk_max, 6) + 0e0 AS risk_max, round(benefit_min_db, 6) + 0e0 AS benefit_min_db, total, accepted, false_safe, "
    + round_all("coverage rate upper")
    + " FROM grid",
)
def j10(v: Views) -> DataFrame:
    return rounded(policy.candidate_grid(v.cases))


POLICY_NAMES = "risk_max benefit_min_db calibration_false_safe_rate calibration_coverage"


@query(
    "a21_policy_calibration",
    "cases",
    f"WITH {SPLIT_SQL}, cal AS (SELECT * FROM sp WHERE split = 'calibration'), {grid_sql('cal')} SELECT {round_all(POLICY_NAMES, 'calibration_cases, feasible')} FROM pol",
)
def a21(v: Views) -> DataFrame:
    split = policy.leading_split(v.cases, "case_id")
    return rounded(policy.calibrate(split.where(F.col("split") == "calibration")))


@query(
    "s03_policy_argmax",
    "cases",
    f"WITH cal AS (SELECT * REPLACE (CASE WHEN case_id % 9 = 0 THEN is_safe ELSE false END AS is_safe) FROM cases), {grid_sql('cal')} "
    f"SELECT {round_all(POLICY_NAMES, 'calibration_cases, feasible')} FROM pol",
)
def s03(v: Views) -> DataFrame:
    mostly_unsafe = F.when(F.col("case_id") % 9 == 0, F.col("is_safe")).otherwise(F.lit(False))
    return rounded(policy.calibrate(v.cases.withColumn("is_safe", mostly_unsafe)))


EVAL_NAMES = """safe_prevalence coverage false_safe_rate false_safe_upper_ci risk_spearman tail_loss_reduction unconditional_loss_q95 policy_loss_q95"""


def evaluate_sql(source: str, keys: str) -> str:
    """CTE ``ev``: fixed-policy metrics of ``source`` (with columns risk_max and benefit_min_db) per key."""
    return f"""jd AS (SELECT *, risk_score <= risk_max AND estimated_noise_reduction_db >= benefit_min_db AS ok FROM {source}),
    {spearman_sql('jd', keys, 'risk_score', 'anomaly_loss')},
    ct AS (SELECT {keys}, count(*) AS cases, count(*) FILTER (is_safe) AS safe_cases, count(*) FILTER (ok) AS accepted, count(*) FILTER (ok AND NOT is_safe) AS false_safe_count,
      quantile_cont(anomaly_loss, 0.95) AS unconditional_loss_q95, quantile_cont(CASE WHEN ok THEN anomaly_loss ELSE 0e0 END, 0.95) AS policy_loss_q95 FROM jd GROUP BY {keys}),
    ev AS (SELECT {keys}, cases, safe_cases, safe_cases / CAST(cases AS DOUBLE) AS safe_prevalence, accepted, accepted / CAST(cases AS DOUBLE) AS coverage, false_safe_count,
      false_safe_count / CAST(greatest(accepted, 1) AS DOUBLE) AS false_safe_rate, {wilson_sql('false_safe_count', 'accepted')} AS false_safe_upper_ci,
      coalesce(spearman_rho, 0e0) AS risk_spearman, greatest(-1e0, least(1e0, 1e0 - policy_loss_q95 / greatest(unconditional_loss_q95, 1e-12))) AS tail_loss_reduction,
      unconditional_loss_q95, policy_loss_q95 FROM ct JOIN rho USING ({keys}))"""


@query(
    "a20_policy_evaluation",
    "cases",
    f"WITH base AS (SELECT *, 'all' AS k, 0.4e0 AS risk_max, 3e0 AS benefit_min_db FROM cases), {evaluate_sql('base', 'k')} "
    f"SELECT {round_all(EVAL_NAMES, 'cases, safe_cases, accepted, false_safe_count')} FROM ev",
)
def a20(v: Views) -> DataFrame:
    fixed = v.spark.range(1).select(d(0.4).alias("risk_max"), d(3.0).alias("benefit_min_db"))
    return rounded(policy.evaluate(v.cases, fixed))


GATE_SQL = """false_safe_rate <= 0.05e0 AS false_safe_ok, false_safe_upper_ci <= 0.10e0 AS upper_ok, coverage >= 0.2e0 AS coverage_ok,
    risk_spearman >= 0.6e0 AS spearman_ok, tail_loss_reduction >= 0.5e0 AS tail_ok,
    false_safe_rate <= 0.05e0 AND false_safe_upper_ci <= 0.10e0 AND coverage >= 0.2e0 AND risk_spearman >= 0.6e0 AND tail_loss_reduction >= 0.5e0 AS passed"""


@query(
    "m10_policy_job",
    "cases",
    f"""WITH {SPLIT_SQL}, cal AS (SELECT * FROM sp WHERE split = 'calibration'), {grid_sql('cal')},
    base AS (SELECT sp.*, pol.risk_max, pol.benefit_min_db FROM sp, pol), {evaluate_sql('base', 'split')}
    SELECT {round_all(EVAL_NAMES, 'split, cases, safe_cases, accepted, false_safe_count')}, {GATE_SQL} FROM ev""",
)
def m10(v: Views) -> DataFrame:
    from hushline.plans.policy_job import policy_job

    return rounded(policy_job(v.cases, "case_id").metrics)


@query(
    "j05_policy_decisions",
    "cases",
    """WITH g AS (SELECT concat('G', CAST(case_id % 20 AS VARCHAR)) AS machine_type, 'section_00' AS section, avg(risk_score) AS risk_score, avg(estimated_noise_reduction_db) AS benefit FROM cases GROUP BY ALL)
    SELECT c.case_id, CASE WHEN g.risk_score <= 0.1e0 AND benefit >= 4.9e0 THEN 'refsub' ELSE 'near' END AS decision FROM cases c
    JOIN g ON g.machine_type = concat('G', CAST(case_id % 20 AS VARCHAR))""",
)
def j05(v: Views) -> DataFrame:
    grouped = v.cases.withColumn("machine_type", F.concat(F.lit("G"), (F.col("case_id") % 20).cast("string")))
    grouped = grouped.withColumn("section", F.lit("section_00"))
    profiles = grouped.groupBy(*GROUP).agg(
        F.avg("risk_score").alias("risk_score"),
        F.avg("estimated_noise_reduction_db").alias("noise_reduction_l05_db"),
    )
    fixed = v.spark.range(1).select(d(0.1).alias("risk_max"), d(4.9).alias("benefit_min_db"))
    decided = policy.decisions(profiles, fixed)
    scored = grouped.withColumn("near_score", d(0.0)).withColumn("refsub_score", F.col("risk_score"))
    fan = joins.system_scores(scored, decided)
    return fan.where(F.col("system") == "safe_ref").select("case_id", "decision")
