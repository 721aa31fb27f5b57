"""ROC curves, AUC and partial AUC as grouped aggregates over distinct-score cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushline.functions.numeric import d
from hushline.operators.ordered import prefix_sums, with_range_bucket
from hushline.schemas import GROUP

MAX_FPR = 0.1
SCOPES = ("all", "source", "target")


def score_cells(
    scores: DataFrame, keys: Sequence[str], score: str = "anomaly_score", weight: Column | None = None
) -> DataFrame:
    """Collapse tied scores: one row per (keys, score) with its anomaly and normal counts."""
    w = F.lit(1).cast("bigint") if weight is None else weight
    anomaly = F.col("condition") == "anomaly"
    return scores.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(F.when(anomaly, w).otherwise(0)).alias("pos"),
        F.sum(F.when(anomaly, 0).otherwise(w)).alias("neg"),
    )


def bucketed_points(cells: DataFrame, keys: Sequence[str], bucket: str = "bucket") -> DataFrame:
    """Rates at each distinct score and at the step before, highest score first, from bucketed cells."""
    run = prefix_sums(
        cells, keys, bucket, [F.col("score").desc()], {"pos": F.col("pos"), "neg": F.col("neg")}, descending=True
    )
    rate = lambda count, total: F.when(F.col(total) > 0, count / F.col(total))
    return run.select(
        *keys,
        "score",
        "pos",
        "neg",
        rate(F.col("neg_before"), "neg_total").alias("fpr_before"),
        rate(F.col("pos_before"), "pos_total").alias("tpr_before"),
        rate(F.col("neg_before") + F.col("neg"), "neg_total").alias("fpr"),
        rate(F.col("pos_before") + F.col("pos"), "pos_total").alias("tpr"),
    )


def roc_points(cells: DataFrame, keys: Sequence[str], balance_on: DataFrame | None = None) -> DataFrame:
    """The curve's points of plain (keys, score) cells; ``balance_on`` may be a cheaper table for the cut points."""
    return bucketed_points(with_range_bucket(cells, "score", balance_on), keys)


def roc_curve(scores: DataFrame, keys: Sequence[str], score: str = "anomaly_score") -> DataFrame:
    """Points of the curve with (0, 0) first; ``score`` is NULL on that first point."""
    points = roc_points(score_cells(scores, keys, score), keys).select(*keys, "score", "fpr", "tpr")
    origin = scores.select(*keys).distinct().select(
        *keys, F.lit(None).cast("double").alias("score"), d(0.0).alias("fpr"), d(0.0).alias("tpr")
    )
    return origin.unionByName(points)


def segment_area() -> Column:
    return (F.col("fpr") - F.col("fpr_before")) * (F.col("tpr_before") + F.col("tpr")) / d(2.0)


def clipped_segment_area(max_fpr: float) -> Column:
    """Area of one segment left of ``max_fpr``, the crossing segment cut by linear interpolation."""
    limit = d(max_fpr)
    x0 = F.least(F.col("fpr_before"), limit)
    x1 = F.least(F.col("fpr"), limit)
    slope = (F.col("tpr") - F.col("tpr_before")) / (F.col("fpr") - F.col("fpr_before"))
    crossing = (F.col("fpr") > limit) & (F.col("fpr_before") <= limit)
    y1 = F.when(crossing, F.col("tpr_before") + slope * (limit - F.col("fpr_before")))
    y1 = y1.otherwise(F.col("tpr"))
    return F.when(x1 > x0, (x1 - x0) * (F.col("tpr_before") + y1) / d(2.0)).otherwise(d(0.0))


def standardised(partial: Column, max_fpr: float) -> Column:
    smallest = 0.5 * max_fpr**2
    return d(0.5) * (d(1.0) + (partial - d(smallest)) / d(max_fpr - smallest))


def area_table(points: DataFrame, keys: Sequence[str], max_fpr: float = MAX_FPR) -> DataFrame:
    """AUC and standardised partial AUC per group; NULL where one class is empty."""
    defined = (F.sum("pos") > 0) & (F.sum("neg") > 0)
    return points.groupBy(*keys).agg(
        F.when(defined, F.sum(segment_area())).alias("auc"),
        F.when(defined, standardised(F.sum(clipped_segment_area(max_fpr)), max_fpr)).alias("pauc"),
    )


def roc_areas(
    scores: DataFrame,
    keys: Sequence[str],
    score: str = "anomaly_score",
    weight: Column | None = None,
    balance_on: DataFrame | None = None,
    max_fpr: float = MAX_FPR,
) -> DataFrame:
    cells = score_cells(scores, keys, score, weight)
    return area_table(roc_points(cells, keys, balance_on), keys, max_fpr)


def metric_table(
    scores: DataFrame,
    extra_keys: Sequence[str] = (),
    score: str = "anomaly_score",
    weight: Column | None = None,
) -> DataFrame:
    """One row per (extra keys, machine_type, section) with AUC and pAUC for all, source and target."""
    keys = [*extra_keys, *GROUP]
    scoped = scores.withColumn("scope", F.explode(F.array(F.lit("all"), F.col("domain"))))
    scoped = scoped.where(F.col("scope").isin(*SCOPES))
    # Cut points only balance the work, so they come from the score column alone, before any grouping.
    areas = roc_areas(scoped, [*keys, "scope"], score, weight, scores.select(F.col(score).alias("score")))
    pick = lambda value, scope: F.max(F.when(F.col("scope") == scope, F.col(value)))
    return areas.groupBy(*keys).agg(
        *[pick("auc", s).alias(f"auc_{s}") for s in SCOPES],
        *[pick("pauc", s).alias(f"pauc_{s}") for s in SCOPES],
    )
