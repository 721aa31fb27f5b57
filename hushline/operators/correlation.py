"""Rank correlation and the per-clip failure analysis built on it."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from hushline.functions.numeric import d, student_t_two_sided
from hushline.operators.ordered import quantiles, running_sums
from hushline.schemas import GROUP, IDENTITY

OUTCOMES = ("score_delta", "absolute_score_delta")


def average_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per distinct (keys, value) with the mean 1-based rank its ties share."""
    cells = df.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    run = running_sums(cells, keys, value, {"c": F.col("_c")})
    rank = F.col("c_before") + (F.col("_c") + 1) / d(2.0)
    return run.select(*keys, value, rank.alias("rank"), F.col("c_total").alias("rows"))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Spearman rho per group with average ranks; NULL when one side is constant.

    Tied pairs are collapsed first; ranks come back through equi-joins on (keys, value), which AQE can
    split when one value is hot.
    """
    keys = list(keys)
    join_keys = keys
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")
    )
    if not keys:
        rows, join_keys = rows.withColumn("_all", F.lit(0)), ["_all"]
    pairs = rows.groupBy(*join_keys, "_x", "_y").agg(F.count("*").alias("_w"))
    rank_x = average_ranks(rows, join_keys, "_x").withColumnRenamed("rank", "_rx")
    rank_y = average_ranks(rows, join_keys, "_y").withColumnRenamed("rank", "_ry").drop("rows")
    ranked = pairs.join(rank_x, [*join_keys, "_x"]).join(rank_y, [*join_keys, "_y"])
    middle = (F.col("rows") + 1) / d(2.0)
    dx, dy, w = F.col("_rx") - middle, F.col("_ry") - middle, F.col("_w")
    sums = ranked.groupBy(*join_keys).agg(
        F.sum("_w").alias("clips"),
        F.sum(w * dx * dy).alias("_xy"),
        F.sum(w * dx * dx).alias("_xx"),
        F.sum(w * dy * dy).alias("_yy"),
    )
    rho = F.when(
        (F.col("_xx") > 0) & (F.col("_yy") > 0), F.col("_xy") / F.sqrt(F.col("_xx") * F.col("_yy"))
    )
    return sums.select(*keys, "clips", rho.alias("spearman_rho"))


@F.pandas_udf(DoubleType())
def two_sided_p(rho: pd.Series, n: pd.Series) -> pd.Series:
    """p-value of one correlation per row (one row per group, never per clip)."""
    return pd.Series([student_t_two_sided(r, int(k)) for r, k in zip(rho.fillna(float("nan")), n)])


def displacement(vectors: DataFrame, keys: Sequence[str], near: str = "near", residual: str = "residual"):
    """Per clip: mean near, mean residual, mean difference and mean absolute difference over all cells.

    Vector rows are reduced to sums inside their own row, so only five numbers per vector are shuffled.
    """
    total = lambda c: F.aggregate(c, d(0.0), lambda a, x: a + x)
    n, r = F.col(near).cast("array<double>"), F.col(residual).cast("array<double>")
    gap = F.zip_with(r, n, lambda a, b: a - b)
    per_row = vectors.select(
        *keys,
        total(n).alias("_n"),
        total(r).alias("_r"),
        total(gap).alias("_d"),
        total(F.transform(gap, F.abs)).alias("_a"),
        F.size(near).alias("_c"),
    )
    mean = lambda c: F.sum(c) / F.sum("_c")
    return per_row.groupBy(*keys).agg(
        mean("_n").alias("near_mean"),
        mean("_r").alias("residual_mean"),
        mean("_d").alias("residual_minus_near"),
        mean("_a").alias("shift_l1"),
    )


def aligned_vectors(near: DataFrame, residual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Near and residual vectors of the same clip and position side by side."""
    return near.withColumnRenamed("values", "near").join(
        residual.withColumnRenamed("values", "residual"), list(keys)
    )


def with_score_delta(df: DataFrame, reference: Column, candidate: Column) -> DataFrame:
    delta = candidate - reference
    return df.withColumn("score_delta", delta).withColumn("absolute_score_delta", F.abs("score_delta"))


def strata_summary(per_clip: DataFrame) -> DataFrame:
    """Count, mean and median delta, mean displacement per machine, section, domain and condition."""
    keys = [*IDENTITY[1:]]
    means = per_clip.groupBy(*keys).agg(
        F.count("*").alias("clips"),
        F.avg("score_delta").alias("score_delta_mean"),
        F.avg("residual_minus_near").alias("residual_minus_near_mean"),
        F.avg("shift_l1").alias("shift_l1_mean"),
    )
    return means.join(quantiles(per_clip, keys, "score_delta", {"score_delta_median": 0.5}), keys)


def worst_strata(strata: DataFrame, count: int = 5) -> DataFrame:
    return strata.orderBy("score_delta_mean", *IDENTITY[1:]).limit(count)


def correlation_table(per_clip: DataFrame, x: str = "residual_minus_near") -> DataFrame:
    """rho and p for both outcomes, for all clips and per machine and section."""
    label = F.explode(F.array(F.lit("all"), F.concat_ws("/", *GROUP)))
    stacked = per_clip.select(x, *OUTCOMES, label.alias("group")).unpivot(
        ["group", x], list(OUTCOMES), "outcome", "value"
    )
    table = spearman(stacked, ["group", "outcome"], x, "value")
    return table.withColumn("two_sided_p_value", two_sided_p("spearman_rho", "clips"))
