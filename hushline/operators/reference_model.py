"""Normal-only reference scorer and channel normaliser: moments per group, then standardised distances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushline.functions.numeric import d
from hushline.operators.guards import required
from hushline.operators.joins import with_group_rows

SCALE_FLOOR = 1.0e-4
VARIANCE_FLOOR = 1.0e-6


def fit_reference(train: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean and floored population deviation of each value per key (normal training rows only)."""
    aggs = []
    for v in values:
        aggs.append(F.avg(v).alias(f"{v}_centre"))
        aggs.append(F.greatest(F.stddev_pop(v), d(SCALE_FLOOR)).alias(f"{v}_scale"))
    return train.groupBy(*keys).agg(*aggs)


def reference_scores(
    rows: DataFrame, model: DataFrame, keys: Sequence[str], values: Sequence[str], clip_keys: Sequence[str]
) -> DataFrame:
    """Mean squared standardised distance per (clip keys, view), then the mean over views.

    Rows whose key has no model fail the job.
    """
    joined = rows.join(model, list(keys), "left")
    scale = lambda v: required(F.col(f"{v}_scale"), "double", "No reference model for", *keys)
    squares = sum((F.pow((F.col(v) - F.col(f"{v}_centre")) / scale(v), 2) for v in values), d(0.0))
    per_view = joined.groupBy(*clip_keys, "view").agg(
        (F.sum(squares) / (F.count("*") * len(values))).alias("view_score")
    )
    return per_view.groupBy(*clip_keys).agg(F.avg("view_score").alias("anomaly_score"))


def fit_normaliser(rows: DataFrame, keys: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """Per key and channel: mean and deviation from sum and sum of squares, variance floored."""
    long = rows.unpivot(list(keys), list(channels), "channel", "value") if keys else rows.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("channel"), F.col(n).cast("double").alias("value")) for n in channels]))
    )
    moments = long.groupBy(*keys, "channel").agg(
        F.sum("value").alias("_s"), F.sum(F.col("value") * F.col("value")).alias("_q"), F.count("*").alias("_n")
    )
    mean = F.col("_s") / F.col("_n")
    variance = F.greatest(F.col("_q") / F.col("_n") - mean * mean, d(VARIANCE_FLOOR))
    return moments.select(*keys, "channel", mean.alias("mean"), F.sqrt(variance).alias("std"))


def normalise(rows: DataFrame, normaliser: DataFrame, keys: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """(x - mean) / std per channel, the normaliser pivoted to one row per key."""
    pick = lambda name, channel: F.max(F.when(F.col("channel") == channel, F.col(name)))
    wide = normaliser.groupBy(*keys).agg(
        *[pick("mean", n).alias(f"{n}_mean") for n in channels], *[pick("std", n).alias(f"{n}_std") for n in channels]
    )
    joined = with_group_rows(rows, wide, keys) if keys else rows.crossJoin(wide)  # without keys: one row
    std = lambda n: required(F.col(f"{n}_std"), "double", "No normaliser for", *keys)
    scaled = {n: (F.col(n) - F.col(f"{n}_mean")) / std(n) for n in channels}
    return joined.select(*[scaled[n].alias(n) if n in scaled else F.col(n) for n in rows.columns])
