"""Residual failure analysis: joined scores and displacement per clip, strata and correlations."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushline.operators import correlation
from hushline.operators.joins import paired_scores


class FailureAnalysis(NamedTuple):
    per_clip: DataFrame
    strata: DataFrame
    correlations: DataFrame
    worst: DataFrame


def analyse(vectors: DataFrame, reference: DataFrame, candidate: DataFrame) -> FailureAnalysis:
    """``vectors``: file_id with aligned near and residual arrays; scores: the two score tables.

    A file that one of the three lacks fails the job, as does one that a score table repeats.
    """
    moved = correlation.displacement(vectors, ["file_id"])
    joined = paired_scores(reference, candidate, vectors=moved)
    per_clip = correlation.with_score_delta(
        joined, F.col("anomaly_score_reference"), F.col("anomaly_score_candidate")
    )
    strata = correlation.strata_summary(per_clip)
    return FailureAnalysis(per_clip, strata, correlation.correlation_table(per_clip), correlation.worst_strata(strata))
