"""Three-system runs: a near model and a second-view model per group and seed, fused by the group's decision."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushline.operators import bootstrap, guards, joins, roc, summaries
from hushline.operators import linear_model as lm
from hushline.schemas import GROUP, IDENTITY, SCORE_COLUMNS
from hushline.session import stored

FIT = ["seed", "view", *GROUP]
VIEWS = ("near", "refsub")


class SystemRun(NamedTuple):
    scores: DataFrame
    thresholds: DataFrame


@dataclass(frozen=True)
class DevelopmentRun:
    ensemble: DataFrame
    thresholds: DataFrame
    metrics: DataFrame
    summary: DataFrame
    gate: DataFrame
    compared: Callable[[], DataFrame]

    @cached_property
    def bootstrap(self) -> DataFrame:
        """Intervals of both comparisons; resampled only when asked for."""
        return self.compared()


def view_scores(
    vectors: DataFrame, seeds: Sequence[int], train_splits: Sequence[str], test_splits: Sequence[str], rank: int = lm.RANK
) -> DataFrame:
    """Scores of train and test clips under their group's models: one row per (seed, view, clip).

    ``vectors``: identity columns, dataset_split, vec_idx, and one array column per view.
    Seeds and views are key columns, so all models are fitted by one set of shuffles.
    """
    long = vectors.select(
        *IDENTITY, "dataset_split", "vec_idx",
        F.inline(F.array(*[F.struct(F.lit(v).alias("view"), F.col(v).alias("x")) for v in VIEWS])),
    )
    train = guards.normal_train(long, train_splits)
    token = train.withColumn("token", F.concat_ws("#", "file_id", F.col("vec_idx").cast("string")))
    seeded = [
        lm.held_out_split(token, ["view", *GROUP], "token", s).where("kept").withColumn("seed", F.lit(s)) for s in seeds
    ]
    fit = lm.fit_subspace(reduce(DataFrame.unionByName, seeded), FIT, "x", rank)
    wanted = F.col("dataset_split").isin(*test_splits) | (
        F.col("dataset_split").isin(*train_splits) & (F.col("condition") == "normal")
    )
    keys = ["view", *IDENTITY, "dataset_split"]
    packed = lm.pack_vectors(long.where(wanted), keys, "vec_idx", "x")
    every_seed = packed.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    return lm.reconstruction_scores(every_seed, fit, FIT, ["seed", *keys])


def run_systems(
    vectors: DataFrame, decisions: DataFrame, seeds: Sequence[int], train_splits: Sequence[str], test_splits: Sequence[str],
    materialise: bool = False,
) -> SystemRun:
    """Test scores per seed and system, and the 0.99 training quantile per seed, group and system."""
    by_view = view_scores(vectors, seeds, train_splits, test_splits)
    if materialise:
        by_view = stored(by_view)
    pick = lambda v: F.max(F.when(F.col("view") == v, F.col("anomaly_score"))).alias(f"{v}_score")
    wide = by_view.groupBy("seed", *IDENTITY, "dataset_split").agg(*[pick(v) for v in VIEWS])
    fan = joins.system_scores(wide, decisions)
    train = fan.where(F.col("dataset_split").isin(*train_splits))
    thresholds = summaries.detection_thresholds(train, ["seed", *GROUP, "system"])
    chosen = F.when(F.col("system") == "safe_ref", F.col("decision")).otherwise(F.col("system"))
    thresholds = thresholds.join(decisions.select(*GROUP, "decision"), GROUP).select(
        "seed", *GROUP, "system", "threshold", chosen.alias("selected_view")
    )
    test = fan.where(F.col("dataset_split").isin(*test_splits))
    return SystemRun(test.select("seed", "system", *IDENTITY, "anomaly_score"), thresholds)


def ensemble(scores: DataFrame, seeds: int, experiment_id: str) -> DataFrame:
    """Mean over seeds per system and clip; a clip some seed misses fails the job."""
    mean = scores.groupBy("system", *IDENTITY).agg(F.avg("anomaly_score").alias("_m"), F.count("*").alias("_n"), F.count_distinct("seed").alias("_s"))
    covered = F.when((F.col("_n") == seeds) & (F.col("_s") == seeds), F.col("_m")).otherwise(
        F.raise_error(F.lit("Seed scores do not cover the same clips")).cast("double")
    )
    model = F.concat(F.lit("linear_"), "system", F.lit(f"_{seeds}seed_ensemble"))
    return mean.select(
        "system", *IDENTITY, covered.alias("anomaly_score"), model.alias("model_id"), F.lit(experiment_id).alias("experiment_id")
    )


def development_run(
    vectors: DataFrame, decisions: DataFrame, seeds: Sequence[int], iterations: int = 5000, bootstrap_seed: int = 2026,
    experiment_id: str = "safe_reference", materialise: bool = True,
) -> DevelopmentRun:
    """The whole development run.  The ensemble scores (one row per system and clip) are materialised once."""
    run = run_systems(vectors, decisions, seeds, ["dev_train"], ["dev_test"], materialise)
    scores = ensemble(run.scores, len(seeds), experiment_id)
    if materialise:
        scores = stored(scores)
    metrics = roc.metric_table(scores, ["system"])
    if materialise:
        metrics = stored(metrics)
    side = lambda s: scores.where(F.col("system") == s).select(*SCORE_COLUMNS)
    compare = lambda s: bootstrap.paired_bootstrap(
        joins.paired_scores(side("near"), side(s)), iterations, bootstrap_seed
    ).withColumn("comparison", F.lit(f"{s}_vs_near"))
    return DevelopmentRun(
        scores, run.thresholds, metrics, summaries.development_summary(metrics),
        summaries.development_gate(metrics, decisions), lambda: compare("unconditional_refsub").unionByName(compare("safe_ref")),
    )


def evaluation_run(
    vectors: DataFrame, decisions: DataFrame, seeds: Sequence[int], experiment_id: str = "safe_reference"
) -> SystemRun:
    """Label-blind scoring of the evaluation split: refuses labelled test rows, computes no metrics."""
    guards.require_label_blind(vectors.where(F.col("dataset_split") == "eval_test"))
    run = run_systems(vectors, decisions, seeds, ["add_train"], ["eval_test"])
    return SystemRun(ensemble(run.scores, len(seeds), experiment_id), run.thresholds)
