"""Macro summaries, ensembles, official scores, gates and detection thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushline.functions.numeric import FLOAT_EPS, d
from hushline.operators.ordered import quantiles
from hushline.operators.selection import with_categories
from hushline.schemas import GROUP, IDENTITY, SCORE_COLUMNS

# Metric name in the metric table -> name in the macro summary.
MACRO = {
    "auc_all": "mean_auc_all",
    "pauc_all": "mean_pauc_all_max_fpr_0_1",
    "auc_source": "mean_auc_source",
    "auc_target": "mean_auc_target",
}
OFFICIAL_COMPONENTS = ("auc_source", "auc_target", "pauc_all")


def macro_summary(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return metrics.groupBy(*keys).agg(*[F.avg(m).alias(name) for m, name in MACRO.items()])


def category_summary(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Macro means per front-end for all, real and emulated machines."""
    return macro_summary(with_categories(metrics), [*keys, "category"])


def seed_ensemble(scores: DataFrame, seeds: int, model_id: str, experiment_id: str, seed: str = "model_id") -> DataFrame:
    """Mean score per file over matched seed tables stacked in ``scores``; column ``seed`` tells the tables apart.

    A file that not every seed covers exactly once fails the job that reads the result.
    """
    if seeds < 2:
        raise ValueError("An ensemble requires at least two score tables")
    mean = scores.groupBy(*IDENTITY).agg(
        F.avg("anomaly_score").alias("_mean"), F.count("*").alias("_n"), F.count_distinct(seed).alias("_seeds")
    )
    covered = F.when((F.col("_n") == seeds) & (F.col("_seeds") == seeds), F.col("_mean")).otherwise(
        F.raise_error(F.concat(F.lit("Seed score tables do not cover "), "file_id")).cast("double")
    )
    return mean.select(
        *IDENTITY,
        covered.alias("anomaly_score"),
        F.lit(model_id).alias("model_id"),
        F.lit(experiment_id).alias("experiment_id"),
    ).select(*SCORE_COLUMNS)


def detection_thresholds(
    train_scores: DataFrame, keys: Sequence[str], q: float = 0.99, score: str = "anomaly_score"
) -> DataFrame:
    return quantiles(train_scores, keys, score, {"threshold": q})


def harmonic(values: Column) -> Column:
    """Aggregate: harmonic mean with every value floored at the float epsilon."""
    return F.count(values) / F.sum(d(1.0) / F.greatest(values, d(FLOAT_EPS)))


def stacked_components(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    return metrics.select(*keys, F.explode(F.array(*OFFICIAL_COMPONENTS)).alias("value"))


def group_official_scores(metrics: DataFrame, keys: Sequence[str] = ("system",)) -> DataFrame:
    """Harmonic mean of the three official components per group."""
    keys = [*keys, *GROUP]
    return stacked_components(metrics, keys).groupBy(*keys).agg(harmonic(F.col("value")).alias("group_score"))


def inverse_components() -> tuple[Column, Column]:
    """Sum of the inverse floored components of a metric row, and how many of them are defined."""
    value = lambda c: F.when(F.col(c).isNotNull(), d(1.0) / F.greatest(F.col(c), d(FLOAT_EPS))).otherwise(d(0.0))
    inverse = sum((value(c) for c in OFFICIAL_COMPONENTS), d(0.0))
    counted = sum((F.col(c).isNotNull().cast("int") for c in OFFICIAL_COMPONENTS), F.lit(0))
    return inverse, counted


def development_summary(metrics: DataFrame, keys: Sequence[str] = ("system",)) -> DataFrame:
    """Official score over all groups plus macro AUC and pAUC per system.

    The components are floored and inverted per group first, so one pass over the metric table serves
    both the harmonic and the arithmetic means.
    """
    inverse, counted = inverse_components()
    return metrics.groupBy(*keys).agg(
        (F.sum(counted) / F.sum(inverse)).alias("official_score"),
        F.avg("auc_all").alias("mean_auc_all"),
        F.avg("pauc_all").alias("mean_pauc_all_max_fpr_0_1"),
    )


def development_gate(
    metrics: DataFrame,
    decisions: DataFrame,
    noninferiority_margin: float = 0.005,
    harm_margin: float = 0.005,
    maximum_drop: float = 0.01,
    minimum_harm_reduction: float = 0.5,
) -> DataFrame:
    """One row: harm counts against near, harm reduction, worst group, accepted groups, verdict."""
    # One row per group with each system's component count and inverse sum; the group scores, the harm counts and
    # the official scores all come from this one table.
    inverse, counted = inverse_components()
    pick = lambda s, value: F.max(F.when(F.col("system") == s, value))
    short = {"near": "near", "unconditional": "unconditional_refsub", "safe": "safe_ref"}
    per_group = metrics.groupBy(*GROUP).agg(
        *[pick(system, inverse).alias(f"{n}_inverse") for n, system in short.items()],
        *[pick(system, counted).alias(f"{n}_count") for n, system in short.items()],
    )
    group = {n: F.col(f"{n}_count") / F.col(f"{n}_inverse") for n in short}
    harmed = lambda n: F.count_if(group[n] - group["near"] < d(-harm_margin))
    overall = lambda n: F.sum(f"{n}_count") / F.sum(f"{n}_inverse")
    measured = per_group.agg(
        overall("near").alias("near_official_score"),
        overall("unconditional").alias("unconditional_official_score"),
        overall("safe").alias("safe_ref_official_score"),
        harmed("unconditional").alias("unconditional_harm_events"),
        harmed("safe").alias("safe_ref_harm_events"),
        F.min(group["safe"] - group["near"]).alias("minimum_machine_delta"),
        F.lit(1).alias("_one"),
    )
    verdicts = decisions.agg(
        F.count_if(F.col("decision") == "refsub").alias("accepted_groups"),
        F.count_if(F.col("decision") == "near").alias("rejected_groups"),
        F.lit(1).alias("_one"),
    )
    row = measured.join(verdicts, "_one").drop("_one")
    before, after = F.col("unconditional_harm_events"), F.col("safe_ref_harm_events")
    row = row.withColumn("safe_ref_delta", F.col("safe_ref_official_score") - F.col("near_official_score"))
    row = row.withColumn("harm_reduction", F.when(before > 0, (before - after) / before).otherwise(d(0.0)))
    passed = (
        (F.col("safe_ref_official_score") >= F.col("near_official_score") - d(noninferiority_margin))
        & (F.col("harm_reduction") >= d(minimum_harm_reduction))
        & (F.col("minimum_machine_delta") >= d(-maximum_drop))
        & (F.col("accepted_groups") >= 1)
        & (F.col("rejected_groups") >= 1)
    )
    return row.withColumn("passed", passed)


def latency_summary(samples: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and the ceil(q * (n - 1)) order statistics, with the ordering check.

    Runs on prefix counts over distinct values, so a hot key is split by value range.
    """
    from hushline.operators.ordered import running_sums

    keys = list(keys)
    cells = samples.groupBy(*keys, F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("_n"))
    ranked = running_sums(cells, keys, "_x", {"n": F.col("_n")})

    def statistic(q: float) -> Column:
        at = F.ceil(d(q) * (F.col("n_total") - 1))
        here = (F.col("n_before") <= at) & (at < F.col("n_before") + F.col("_n"))
        return F.max(F.when(here, F.col("_x")))

    out = ranked.groupBy(*keys).agg(
        (F.sum(F.col("_x") * F.col("_n")) / F.sum("_n")).alias("mean"),
        statistic(0.5).alias("p50"),
        statistic(0.95).alias("p95"),
        statistic(0.99).alias("p99"),
    )
    return out.withColumn("ordered", (F.col("p50") <= F.col("p95")) & (F.col("p95") <= F.col("p99")))
