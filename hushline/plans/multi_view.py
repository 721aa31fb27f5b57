"""Near-target reconstruction on normalised mel maps for every ablation and seed in one plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushline.operators import guards
from hushline.operators import linear_model as lm
from hushline.operators.reference_model import fit_normaliser, normalise
from hushline.operators.selection import ABLATIONS
from hushline.schemas import IDENTITY

FIT = ["ablation", "seed", "machine_type"]


def frame_vectors(maps: DataFrame, channels: Sequence[str]) -> DataFrame:
    """One vector per frame: the channels' mel bands side by side."""
    rows = F.array_sort(F.collect_list(F.struct("mel", *channels)))
    packed = maps.groupBy(*IDENTITY, "dataset_split", F.col("frame").alias("vec_idx")).agg(rows.alias("_m"))
    return packed.select(*IDENTITY, "dataset_split", "vec_idx", F.concat(*[F.col(f"_m.{c}") for c in channels]).alias("x"))


def multi_view_scores(
    maps: DataFrame, mels: int, seeds: Sequence[int], ablations: Mapping[str, Sequence[str]] = ABLATIONS, rank: int = lm.RANK
) -> DataFrame:
    """Scores per (ablation, seed, clip).  ``maps``: identity columns, dataset_split, frame, mel and the channels.

    The near maps come first in every channel set, so the error is taken over the first ``mels`` dimensions.
    """
    channels = list(dict.fromkeys(c for set_ in ablations.values() for c in set_))
    fit = fit_normaliser(guards.normal_train(maps, ["dev_train"]), ["machine_type"], channels)
    scaled = normalise(maps, fit, ["machine_type"], channels)
    vectors = reduce(
        DataFrame.unionByName,
        [frame_vectors(scaled, set_).withColumn("ablation", F.lit(name)) for name, set_ in ablations.items()],
    )
    train = guards.normal_train(vectors, ["dev_train"]).withColumn(
        "token", F.concat_ws("#", "file_id", F.col("vec_idx").cast("string"))
    )
    kept = [
        lm.held_out_split(train, ["ablation", "machine_type"], "token", s).where("kept").withColumn("seed", F.lit(s))
        for s in seeds
    ]
    model = lm.fit_subspace(reduce(DataFrame.unionByName, kept), FIT, "x", rank)
    keys = ["ablation", *IDENTITY]
    packed = lm.pack_vectors(vectors.where(F.col("dataset_split") == "dev_test"), keys, "vec_idx", "x")
    every_seed = packed.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    return lm.reconstruction_scores(every_seed, model, FIT, ["seed", *keys], mels)
