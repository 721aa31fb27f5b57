"""Front-end benchmark: summaries, reference fit, scores and metrics for every front-end in one plan."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushline.operators import acoustic_path, frontends, guards, roc, summaries
from hushline.operators.reference_model import fit_reference, reference_scores
from hushline.schemas import IDENTITY
from hushline.session import stored

MODEL_KEYS = ["machine_type", "frontend", "view", "bin"]
VALUES = ["mean", "std"]


class Benchmark(NamedTuple):
    scores: DataFrame
    metrics: DataFrame
    summary: DataFrame


def scored_summaries(clip_summaries: DataFrame, manifest: DataFrame) -> DataFrame:
    """Score rows per front-end from (clip_no, frontend, view, bin, mean, std)."""
    rows = clip_summaries.join(manifest.select("clip_no", *IDENTITY, "dataset_split"), "clip_no")
    model = fit_reference(guards.normal_train(rows, ["dev_train"]), MODEL_KEYS, VALUES)
    test = rows.where(F.col("dataset_split") == "dev_test")
    return reference_scores(test, model, MODEL_KEYS, VALUES, ["frontend", *IDENTITY])


def benchmark(
    packed: DataFrame,
    manifest: DataFrame,
    names: Sequence[str] = tuple(frontends.REGISTRY),
    settings: frontends.Settings = frontends.Settings(),
    materialise: bool = False,
) -> Benchmark:
    """Scores, metric table and category summary.

    The clip summaries are the only thing kept of the spectra.  With ``materialise`` they are stored, so
    that the fit, the scores and the metrics read them instead of repeating the transforms.
    """
    for name in names:
        frontends.frontend(name)
    clip_summaries = frontends.spectral_summaries(packed, names, settings)
    if materialise:
        clip_summaries = stored(clip_summaries)
    scores = scored_summaries(clip_summaries, manifest)
    if materialise:
        scores = stored(scores)
    metrics = roc.metric_table(scores, ["frontend"])
    return Benchmark(scores, metrics, summaries.category_summary(metrics, ["frontend"]))


def path_summaries(packed: DataFrame, settings: acoustic_path.PathSettings = acoustic_path.PathSettings()) -> DataFrame:
    """Clip summaries of the acoustic-path front-end's three views, under the front-end name 'acoustic_path'."""
    from hushline.functions import complexes as c

    rows = acoustic_path.acoustic_path(packed, settings)
    views = ("near", "far", "residual")
    aggs = []
    for view in views:
        value = F.log1p(c.magnitude(c.cx(view)))
        aggs += [F.avg(value).alias(f"{view}_m"), F.stddev_pop(value).alias(f"{view}_s")]
    wide = rows.groupBy("clip_no", "bin").agg(*aggs)
    fan = [
        F.struct(F.lit("acoustic_path").alias("frontend"), F.lit(v).alias("view"), F.col(f"{v}_m").alias("mean"), F.col(f"{v}_s").alias("std"))
        for v in views
    ]
    return wide.select("clip_no", "bin", F.inline(F.array(*fan)))
