"""Filters, leakage guards and data-quality aggregates over manifests and score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushline.functions import paths
from hushline.schemas import GROUP, ContractError, require_columns

TRAIN_SPLITS = ("dev_train", "add_train")
TEST_SPLITS = ("dev_test", "eval_test")


def normal_train(df: DataFrame, splits: Sequence[str] = TRAIN_SPLITS) -> DataFrame:
    """The only rows any fit may read: normal clips of the training splits."""
    return df.where(F.col("dataset_split").isin(*splits) & (F.col("condition") == "normal"))


def test_rows(df: DataFrame, splits: Sequence[str] = TEST_SPLITS) -> DataFrame:
    return df.where(F.col("dataset_split").isin(*splits))


def leakage_report(df: DataFrame) -> DataFrame:
    """Per split: rows, rows with a known label, rows with an unknown label, and the guard verdict."""
    known = F.col("condition").isin("normal", "anomaly")
    report = df.groupBy("dataset_split").agg(
        F.count("*").alias("clips"),
        F.count_if(known).alias("known_labels"),
        F.count_if(F.col("condition") == "unknown").alias("unknown_labels"),
        F.count_if(F.col("condition") == "anomaly").alias("anomaly_labels"),
    )
    split = F.col("dataset_split")
    return report.withColumn(
        "passed",
        F.when(split == "eval_test", F.col("known_labels") == 0)
        .when(split == "dev_test", F.col("unknown_labels") == 0)
        .otherwise(F.lit(True)),
    )


def require_label_blind(test: DataFrame) -> DataFrame:
    """Raise when evaluation rows carry labels (one counting job)."""
    if test.where(F.col("condition") != "unknown").limit(1).count():
        raise ContractError("Evaluation rows have labels, but must be unlabelled")
    return test


def require_labelled(test: DataFrame) -> DataFrame:
    if test.where(~F.col("condition").isin("normal", "anomaly")).limit(1).count():
        raise ContractError("Metrics of development rows need a normal or anomaly label on each")
    return test


def all_finite(values: Column) -> Column:
    """True for a non-empty array without NaN or infinities."""
    bad = F.exists(values, lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return (F.size(values) > 0) & ~bad


def required(value: Column, kind: str, message: str, *named: str | Column) -> Column:
    """``value`` where it is there; a missing one fails the job that reads it, naming what it belongs to.

    Put on a column of the right side of an outer join, it turns rows that an inner join would lose into an error.  Use it
    where the value is read first: a division skips its left side when the divisor is NULL.
    """
    about = [F.coalesce(F.col(n).cast("string") if isinstance(n, str) else n.cast("string"), F.lit("null")) for n in named]
    error = F.raise_error(F.concat_ws(" ", F.lit(message), *about)).cast(kind)
    return F.when(value.isNull(), error).otherwise(value)


def within_unit(value: Column) -> Column:
    return value.between(0.0, 1.0)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def require_unique(df: DataFrame, keys: Sequence[str], label: str = "table") -> DataFrame:
    if duplicate_keys(df, keys).limit(1).count():
        raise ContractError(f"{label} has duplicate {', '.join(keys)} values")
    return df


def manifest_summary(manifest: DataFrame) -> DataFrame:
    """One audit row.  Labels and rates are small vocabularies, so the sets stay small."""
    path = F.col("relative_path")
    stereo = F.col("channels") == 2
    values = lambda name: F.sort_array(F.collect_set(name))
    return manifest.agg(
        F.count("*").alias("clips"),
        F.count_if(stereo).alias("stereo_clips"),
        F.count_if(~stereo).alias("invalid_channel_clips"),
        F.count_if(paths.unsafe(path)).alias("unsafe_paths"),
        values("sample_rate").alias("sample_rates"),
        values("condition").alias("conditions"),
        values("domain").alias("domains"),
    )


def audit_manifest(manifest: DataFrame) -> DataFrame:
    """The audit row, after raising on an empty, non-stereo, duplicated or unsafe manifest."""
    require_columns(
        manifest,
        ("file_id", "relative_path", "channels", "sample_rate", "condition", "domain", "dataset_split"),
        "manifest",
    )
    summary = manifest_summary(manifest)
    row = summary.first()
    if not row["clips"]:
        raise ContractError("The manifest is empty")
    if row["invalid_channel_clips"]:
        raise ContractError(f"Stereo audio is required; invalid clips={row['invalid_channel_clips']}")
    require_unique(manifest, ["file_id"], "Manifest")
    if row["unsafe_paths"]:
        raise ContractError("A relative_path of the manifest leaves its folder")
    return summary


def coverage(scores: DataFrame, expected: DataFrame, key: str = "file_id") -> DataFrame:
    """Counts of ids missing from the scores and ids the manifest does not know."""
    have = scores.select(key).distinct().withColumn("in_scores", F.lit(True))
    want = expected.select(key).distinct().withColumn("in_manifest", F.lit(True))
    return have.join(want, key, "full_outer").agg(
        F.count_if(F.col("in_scores").isNull()).alias("missing"),
        F.count_if(F.col("in_manifest").isNull()).alias("unexpected"),
        F.count("*").alias("ids"),
    )


def require_coverage(scores: DataFrame, expected: DataFrame) -> DataFrame:
    row = coverage(scores, expected).first()
    if row["missing"] or row["unexpected"]:
        raise ContractError(
            f"Score coverage mismatch: missing={row['missing']}, unexpected={row['unexpected']}"
        )
    return scores


def id_differences(left: DataFrame, right: DataFrame, key: str = "file_id") -> DataFrame:
    """Ids on one side only, with the side they are on."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    only_left = a.join(b, key, "left_anti").withColumn("side", F.lit("left"))
    only_right = b.join(a, key, "left_anti").withColumn("side", F.lit("right"))
    return only_left.unionByName(only_right)


def values_outside(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Distinct values of ``column`` that are not in the allowed vocabulary."""
    return df.where(~F.col(column).isin(*allowed)).groupBy(column).agg(F.count("*").alias("copies"))


def untrained_groups(test: DataFrame, train: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    return test.select(*keys).distinct().join(train.select(*keys).distinct(), list(keys), "left_anti")


def trained_only(rows: DataFrame, train: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    """The rows whose group has training rows, for jobs that refuse others; :func:`untrained_groups` reports those."""
    return rows.join(train.select(*keys).distinct(), list(keys), "left_semi").select(*rows.columns)


def label_balance(df: DataFrame) -> DataFrame:
    """Counts per split, domain and condition with roll-up totals (NULL marks a total)."""
    return df.rollup("dataset_split", "domain", "condition").agg(F.count("*").alias("clips"))
