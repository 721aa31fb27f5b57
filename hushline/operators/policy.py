"""Reference-safety policy: candidate thresholds, calibration, evaluation and gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hushline.functions.numeric import clip, d, wilson_upper
from hushline.operators.correlation import spearman
from hushline.operators.ordered import quantiles, running_sums

FALSE_SAFE_MAX = 0.05
FALSE_SAFE_UPPER_MAX = 0.10


def view_decision(risk: Column, benefit: Column, risk_max: Column, benefit_min: Column) -> Column:
    return F.when((risk <= risk_max) & (benefit >= benefit_min), "refsub").otherwise("near")


def decisions(profiles: DataFrame, policy: DataFrame) -> DataFrame:
    """Profiles with the view each group decided on and the policy that decided it."""
    rule = policy.select(F.struct("risk_max", "benefit_min_db").alias("p")).scalar()
    out = profiles.withColumn("_p", rule)
    return out.select(
        *profiles.columns,
        view_decision(
            F.col("risk_score"), F.col("noise_reduction_l05_db"), F.col("_p.risk_max"), F.col("_p.benefit_min_db")
        ).alias("decision"),
        F.col("_p.risk_max").alias("policy_risk_max"),
        F.col("_p.benefit_min_db").alias("policy_benefit_min_db"),
    )


def leading_split(cases: DataFrame, order: str, fraction: float = 0.5) -> DataFrame:
    """Label the leading fraction of rows (by ``order``) 'calibration' and the rest 'holdout'."""
    run = running_sums(cases, [], order, {"n": F.lit(1).cast("bigint")})
    cut = F.greatest(F.lit(1), F.least(F.bround(F.col("n_total") * d(fraction)), F.col("n_total") - 1))
    label = F.when(F.col("n_before") < cut, "calibration").otherwise("holdout")
    return run.withColumn("split", label).drop("n_before", "n_total")


def quantile_candidates(df: DataFrame, value: str, probabilities: Sequence[float]) -> DataFrame:
    """One row: the sorted distinct linear-interpolated quantiles of a whole column.

    All ranks are read in one pass over prefix counts of the distinct values.
    """
    cells = df.groupBy(F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("_n"))
    run = running_sums(cells, [], "_x", {"n": F.col("_n")})
    ranks = F.transform(
        F.array(*[d(p) for p in probabilities]), lambda p: p * (F.col("n_total") - 1)
    )
    holds = lambda k: (F.col("n_before") <= k) & (k < F.col("n_before") + F.col("_n"))
    hits = F.filter(ranks, lambda r: holds(F.floor(r)) | holds(F.ceil(r)))
    ends = run.select(F.explode(hits).alias("r"), "_x", "n_before", "_n").groupBy("r").agg(
        F.max(F.when(holds(F.floor("r")), F.col("_x"))).alias("lo"),
        F.max(F.when(holds(F.ceil("r")), F.col("_x"))).alias("hi"),
    )
    value_at = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("r") - F.floor("r"))
    return ends.agg(F.sort_array(F.collect_set(value_at)).alias("candidates"))


def candidate_grid(cases: DataFrame, step: int = 5) -> DataFrame:
    """Accepted and false-safe counts for every (risk_max, benefit_min) candidate pair.

    Each case falls in one cell of the candidate grid; the counts of a pair are a two-way prefix sum over
    that grid (at most (100/step - 1)^2 cells), so cases are never multiplied by the candidates.
    """
    probabilities = [p / 100.0 for p in range(step, 100, step)]
    risk = quantile_candidates(cases, "risk_score", probabilities).scalar()
    benefit = quantile_candidates(cases, "estimated_noise_reduction_db", probabilities).scalar()
    tagged = cases.select(
        "risk_score", "estimated_noise_reduction_db", "is_safe", risk.alias("_r"), benefit.alias("_b")
    )
    cells = tagged.select(
        F.size(F.filter("_r", lambda c: c < F.col("risk_score"))).alias("i"),
        (F.size(F.filter("_b", lambda c: c <= F.col("estimated_noise_reduction_db"))) - 1).alias("j"),
        F.lit(1).alias("accepted"),
        (~F.col("is_safe")).cast("int").alias("false_safe"),
    ).groupBy("i", "j").agg(F.sum("accepted").alias("accepted"), F.sum("false_safe").alias("false_safe"))
    axes = cases.sparkSession.range(1).select(
        risk.alias("_r"), benefit.alias("_b"), cases.agg(F.count("*").alias("n")).scalar().alias("total")
    )
    pairs = axes.select("_b", "total", F.posexplode("_r").alias("i", "risk_max")).select(
        "i", "risk_max", "total", F.posexplode("_b").alias("j", "benefit_min_db")
    )
    zero = pairs.select("i", "j", "risk_max", "benefit_min_db", "total", F.lit(0).cast("bigint").alias("accepted"),
                        F.lit(0).cast("bigint").alias("false_safe"))
    filled = zero.unionByName(cells, allowMissingColumns=True).groupBy("i", "j").agg(
        F.max("risk_max").alias("risk_max"), F.max("benefit_min_db").alias("benefit_min_db"),
        F.max("total").alias("total"), F.sum("accepted").alias("accepted"), F.sum("false_safe").alias("false_safe"),
    )
    up = Window.partitionBy("j").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("i").orderBy(F.desc("j")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = filled
    for window in (up, down):
        for c in ("accepted", "false_safe"):
            summed = summed.withColumn(c, F.sum(c).over(window))
    counted = summed.where(F.col("risk_max").isNotNull())
    return counted.select(
        "risk_max", "benefit_min_db", "total", "accepted", "false_safe",
        (F.col("accepted") / F.col("total")).alias("coverage"),
        (F.col("false_safe") / F.greatest(F.col("accepted"), F.lit(1))).alias("rate"),
        wilson_upper(F.col("false_safe"), F.col("accepted")).alias("upper"),
    )


def calibrate(
    cases: DataFrame,
    step: int = 5,
    rate_max: float = FALSE_SAFE_MAX,
    upper_max: float = FALSE_SAFE_UPPER_MAX,
) -> DataFrame:
    """The chosen policy, one row.  Feasible pairs rank by coverage first; without any, by upper bound."""
    grid = candidate_grid(cases, step)
    feasible = (F.col("accepted") > 0) & (F.col("rate") <= d(rate_max)) & (F.col("upper") <= d(upper_max))
    tail = [-F.col("rate"), -F.col("risk_max"), F.col("benefit_min_db")]
    first = F.when(feasible, F.col("coverage")).otherwise(-F.col("upper"))
    second = F.when(feasible, -F.col("upper")).otherwise(F.col("coverage"))
    order = F.struct(feasible.cast("int"), first, second, *tail)
    best = grid.withColumn("feasible", feasible).agg(F.max_by(F.struct("*"), order).alias("b")).select("b.*")
    return best.select(
        "risk_max", "benefit_min_db", F.col("total").alias("calibration_cases"),
        F.col("rate").alias("calibration_false_safe_rate"), F.col("coverage").alias("calibration_coverage"),
        "feasible",
    )


def evaluate(cases: DataFrame, policy: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Fixed-policy metrics per key: coverage, false-safe rate and bound, rank correlation, tail losses."""
    keys = list(keys)
    join_keys = keys or ["_all"]
    rule = policy.select(F.struct("risk_max", "benefit_min_db").alias("p")).scalar()
    base = cases if keys else cases.withColumn("_all", F.lit(0))
    judged = base.withColumn("_p", rule)
    accepted = (F.col("risk_score") <= F.col("_p.risk_max")) & (
        F.col("estimated_noise_reduction_db") >= F.col("_p.benefit_min_db")
    )
    judged = judged.withColumn("_ok", accepted).withColumn(
        "_loss", F.when(F.col("_ok"), F.col("anomaly_loss")).otherwise(d(0.0))
    )
    counts = judged.groupBy(*join_keys).agg(
        F.count("*").alias("cases"),
        F.count_if("is_safe").alias("safe_cases"),
        F.count_if("_ok").alias("accepted"),
        F.count_if(F.col("_ok") & ~F.col("is_safe")).alias("false_safe_count"),
    )
    rho = spearman(base, join_keys, "risk_score", "anomaly_loss").drop("clips")
    losses = quantiles(base, join_keys, "anomaly_loss", {"unconditional_loss_q95": 0.95})
    kept = quantiles(judged, join_keys, "_loss", {"policy_loss_q95": 0.95})
    row = counts.join(rho, join_keys).join(losses, join_keys).join(kept, join_keys)
    reduction = d(1.0) - F.col("policy_loss_q95") / F.greatest(F.col("unconditional_loss_q95"), d(1.0e-12))
    return row.select(
        *keys, "cases", "safe_cases",
        (F.col("safe_cases") / F.col("cases")).alias("safe_prevalence"),
        "accepted",
        (F.col("accepted") / F.col("cases")).alias("coverage"),
        "false_safe_count",
        (F.col("false_safe_count") / F.greatest(F.col("accepted"), F.lit(1))).alias("false_safe_rate"),
        wilson_upper(F.col("false_safe_count"), F.col("accepted")).alias("false_safe_upper_ci"),
        F.coalesce("spearman_rho", d(0.0)).alias("risk_spearman"),
        clip(reduction, -1.0, 1.0).alias("tail_loss_reduction"),
        "unconditional_loss_q95",
        "policy_loss_q95",
    )


def gate(
    holdout: DataFrame,
    rate_max: float = FALSE_SAFE_MAX,
    upper_max: float = FALSE_SAFE_UPPER_MAX,
    minimum_coverage: float = 0.20,
    minimum_spearman: float = 0.60,
    minimum_tail_reduction: float = 0.50,
) -> DataFrame:
    """The five holdout criteria and their conjunction."""
    checks = {
        "false_safe_ok": F.col("false_safe_rate") <= d(rate_max),
        "upper_ok": F.col("false_safe_upper_ci") <= d(upper_max),
        "coverage_ok": F.col("coverage") >= d(minimum_coverage),
        "spearman_ok": F.col("risk_spearman") >= d(minimum_spearman),
        "tail_ok": F.col("tail_loss_reduction") >= d(minimum_tail_reduction),
    }
    out = holdout
    for name, check in checks.items():
        out = out.withColumn(name, check)
    passed = F.lit(True)
    for name in checks:
        passed = passed & F.col(name)
    return out.withColumn("passed", passed)
