"""Policy calibration as one job over a case table."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushline.operators import policy
from hushline.session import stored


class PolicyJob(NamedTuple):
    policy: DataFrame
    metrics: DataFrame


CASE_COLUMNS = ("risk_score", "estimated_noise_reduction_db", "is_safe", "anomaly_loss")


def policy_job(
    cases: DataFrame, order: str = "case_id", fraction: float = 0.5, step: int = 5, materialise: bool = True
) -> PolicyJob:
    """Calibrate on the leading fraction, evaluate both parts, and apply the gate to each part.

    The holdout row's ``passed`` is the verdict; a policy is returned either way.  The labelled split (four columns
    per case) and the one-row policy are stored, because calibration and evaluation read them many times.
    """
    split = policy.leading_split(cases.select(order, *CASE_COLUMNS), order, fraction)
    if materialise:
        split = stored(split)
    chosen = policy.calibrate(split.where(F.col("split") == "calibration"), step)
    if materialise:
        chosen = stored(chosen)
    return PolicyJob(chosen, policy.gate(policy.evaluate(split, chosen, ["split"])))
