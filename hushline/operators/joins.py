"""Equi-joins between manifests, feature indexes, score tables, policies and thresholds.

No broadcast is forced: Catalyst broadcasts a side only when its measured size is under
``spark.sql.autoBroadcastJoinThreshold``; otherwise it sorts and merges, and AQE splits hot keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushline.functions import paths
from hushline.operators.guards import required
from hushline.operators.one_to_one import checked, gathered, one_to_one, same
from hushline.schemas import GROUP, IDENTITY, SCORE_COLUMNS

# The three system labels.
VIEW_SYSTEMS = ("near", "unconditional_refsub", "safe_ref")


SLICES = 32


def with_group_rows(rows: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of many rows with one row per group, a group's rows dealt over ``SLICES`` slices.

    A few groups (machines, say) would otherwise send all rows to as many tasks; each group's row is repeated once per slice.
    """
    rest = [c for c in rows.columns if c not in keys]
    dealt = rows.withColumn("_slice", F.pmod(F.xxhash64(*rest), F.lit(SLICES)).cast("int"))
    repeated = groups.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    return dealt.join(repeated, [*keys, "_slice"], "left").drop("_slice")


def label_official_scores(
    official: DataFrame, manifest: DataFrame, model_id: str, experiment_id: str
) -> DataFrame:
    """Score-table rows for (machine_type, section, basename, anomaly_score).

    A basename unknown to the manifest, a test clip without a score, and one that either side repeats fail the job.
    """
    named = official_sides(official, manifest)
    joined = gathered(named, [*GROUP, "basename"])
    unknown = F.concat(F.lit("The manifest has no clip named "), "basename")
    known = F.when(F.col("_rows").getField("manifest clip") == 0, F.raise_error(unknown).cast("boolean")).otherwise(F.lit(True))
    return score_rows(checked(joined.where(known), named, [*GROUP, "basename"]), F.col("anomaly_score"), model_id, experiment_id)


def official_sides(official: DataFrame, manifest: DataFrame) -> dict[str, DataFrame]:
    expected = manifest.where(F.col("dataset_split") == "dev_test").select(
        *IDENTITY, paths.basename(F.col("relative_path")).alias("basename")
    )
    named = official.withColumn("machine_type", paths.strip_dataset_prefix(F.col("machine_type")))
    return {"manifest clip": expected, "official score": named.select(*GROUP, "basename", "anomaly_score")}


def score_rows(df: DataFrame, score: Column, model_id: str, experiment_id: str) -> DataFrame:
    return df.select(
        *IDENTITY,
        score.cast("double").alias("anomaly_score"),
        F.lit(model_id).alias("model_id"),
        F.lit(experiment_id).alias("experiment_id"),
    ).select(*SCORE_COLUMNS)


def paired_indexes(
    near: DataFrame, residual: DataFrame, reference: DataFrame, candidate: DataFrame
) -> DataFrame:
    """Two feature indexes and two score tables joined one to one on the test clips, in one grouping.

    A clip that one of them lacks or repeats, or whose indexes hold unequal numbers of vectors, fails the job.
    """
    joined = one_to_one(index_sides(near, residual, reference, candidate), ["file_id"])
    same_clip = same(F.struct(*IDENTITY[1:]), F.col("_residual_identity"), "Near and residual features name different clips as", "file_id")
    equal = same(F.col("near_vector_count"), F.col("residual_vector_count"), "Unequal vector counts for", "file_id")
    scored = {f"{n}_anomaly_score": required(F.col(f"{n}_anomaly_score"), "double", f"No {n} score for", "file_id") for n in ("reference", "candidate")}
    return joined.where(same_clip).where(equal).drop("_residual_identity").withColumns(scored)


def index_sides(near: DataFrame, residual: DataFrame, reference: DataFrame, candidate: DataFrame) -> dict[str, DataFrame]:
    test = F.col("dataset_split") == "dev_test"
    side = lambda df, name: df.select("file_id", F.col("anomaly_score").alias(name))
    return {
        "near features": near.where(test).withColumnRenamed("vector_count", "near_vector_count"),
        "residual features": _residual(residual.where(test), IDENTITY[1:]),
        "reference score": side(reference, "reference_anomaly_score"),
        "candidate score": side(candidate, "candidate_anomaly_score"),
    }


def _residual(residual: DataFrame, identity: Sequence[str]) -> DataFrame:
    return residual.select(
        "file_id", F.struct(*identity).alias("_residual_identity"), F.col("vector_count").alias("residual_vector_count")
    )


def join_cardinalities(joined: DataFrame, *inputs: DataFrame) -> DataFrame:
    """Row counts of the joined table and each input, and whether they are all equal."""
    out = joined.agg(F.count("*").alias("joined"))
    for i, df in enumerate(inputs):
        out = out.withColumn(f"input_{i}", df.agg(F.count("*").alias("n")).scalar())
    same = F.lit(True)
    for i in range(len(inputs)):
        same = same & (F.col(f"input_{i}") == F.col("joined"))
    return out.withColumn("one_to_one", same)


def gated_inputs(near: DataFrame, residual: DataFrame, reliability: DataFrame) -> DataFrame:
    """Near and residual indexes and the reliability, joined one to one per clip.

    A clip that one of the three lacks or repeats, that the indexes describe differently (six identity columns) or hold with
    unequal numbers of vectors, or with a reliability outside [0, 1], fails the job.
    """
    joined = one_to_one(gated_sides(near, residual, reliability), ["file_id"])
    same_clip = same(F.struct(*GATED), F.col("_residual_identity"), "Near and residual features name different clips as", "file_id")
    value = required(F.col("reliability"), "double", "No reliability for", "file_id")
    outside = F.raise_error(F.concat_ws(" ", F.lit("Reliability outside [0, 1] for"), "file_id")).cast("double")
    inside = F.when(value.between(0.0, 1.0), value).otherwise(outside)
    equal = same(F.col("near_vector_count"), F.col("residual_vector_count"), "Unequal vector counts for", "file_id")
    return joined.where(same_clip).where(equal).drop("_residual_identity").withColumn("reliability", inside)


#: What near and residual features must agree on, besides the file_id.
GATED = ["dataset_split", *IDENTITY[1:]]


def gated_sides(near: DataFrame, residual: DataFrame, reliability: DataFrame) -> dict[str, DataFrame]:
    return {
        "near features": near.withColumnRenamed("vector_count", "near_vector_count"),
        "residual features": _residual(residual, GATED),
        "reliability": reliability.select("file_id", "reliability"),
    }


def paired_scores(reference: DataFrame, candidate: DataFrame, **more: DataFrame) -> DataFrame:
    """The two score tables side by side, and the columns of ``more`` tables keyed by file_id.

    A file that one of the tables lacks or repeats, or that the score tables describe differently, fails the job.
    """
    joined = one_to_one({**score_sides(reference, candidate), **more}, ["file_id"])
    same_clip = same(F.struct(*IDENTITY[1:]), F.col("_candidate_identity"), "The score tables describe differently", "file_id")
    score = lambda s: required(F.col(f"anomaly_score_{s}"), "double", f"No {s} score for", "file_id")
    values = {f"anomaly_score_{s}": score(s) for s in ("reference", "candidate")}
    return joined.where(same_clip).drop("_candidate_identity").withColumns(values)


def score_sides(reference: DataFrame, candidate: DataFrame) -> dict[str, DataFrame]:
    return {
        "reference score": reference.select(*IDENTITY, F.col("anomaly_score").alias("anomaly_score_reference")),
        "candidate score": candidate.select(
            "file_id", F.struct(*IDENTITY[1:]).alias("_candidate_identity"), F.col("anomaly_score").alias("anomaly_score_candidate")
        ),
    }


def system_scores(
    views: DataFrame, decisions: DataFrame, near: str = "near_score", refsub: str = "refsub_score"
) -> DataFrame:
    """Fan each clip out to the three systems; safe_ref takes the view its group decided on (no decision: an error)."""
    chosen = views.join(decisions.select(*GROUP, "decision"), GROUP, "left")
    chosen = chosen.withColumn("decision", required(F.col("decision"), "string", "No decision for", *GROUP))
    picked = F.when(F.col("decision") == "refsub", F.col(refsub)).otherwise(F.col(near))
    fan = F.array(
        *[
            F.struct(F.lit(system).alias("system"), score.alias("anomaly_score"))
            for system, score in zip(VIEW_SYSTEMS, (F.col(near), F.col(refsub), picked))
        ]
    )
    rest = [c for c in views.columns if c not in (near, refsub)]
    return chosen.select(*rest, "decision", F.inline(fan))


def apply_thresholds(
    scores: DataFrame, thresholds: DataFrame, keys: Sequence[str] = GROUP
) -> DataFrame:
    """Mean threshold over seeds per group (none: an error); the alarm is strict: score > threshold."""
    mean = thresholds.groupBy(*keys).agg(F.avg("threshold").alias("threshold"))
    joined = scores.join(mean, list(keys), "left")
    return joined.withColumn("threshold", required(F.col("threshold"), "double", "No threshold for", *keys)).withColumn(
        "decision", (F.col("anomaly_score") > F.col("threshold")).cast("int")
    )
