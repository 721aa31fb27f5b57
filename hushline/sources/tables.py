"""Parquet and CSV scans with their contracts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushline.operators import guards
from hushline.schemas import SCORE_COLUMNS, SCORES, ContractError, require_columns


def read_table(
    spark: SparkSession, path: str, required: Iterable[str], schema: T.StructType | None = None
) -> DataFrame:
    """Parquet scan; the schema comes from the file footers unless given, never from the data."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return require_columns(reader.parquet(path), required, path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Score CSV with header: columns present, ids unique, labels known."""
    df = spark.read.schema(SCORES).option("mode", "FAILFAST").option("enforceSchema", False).csv(path, header=True)
    require_columns(df, SCORE_COLUMNS, path)
    row = score_contract(df).first()
    if row["duplicate_ids"] or row["unknown_labels"]:
        raise ContractError(f"{path} must have unique ids and known labels")
    return df


def score_contract(scores: DataFrame) -> DataFrame:
    """Counts behind the score-table contract, in one row."""
    known = F.col("condition").isin("normal", "anomaly")
    per_id = scores.groupBy("file_id").agg(F.count("*").alias("n"), F.count_if(~known).alias("u"))
    return per_id.agg(
        F.sum("n").alias("scores"),
        F.count("*").alias("distinct_ids"),
        (F.sum("n") - F.count("*")).alias("duplicate_ids"),
        F.sum("u").alias("unknown_labels"),
    )


def feature_index(stored: DataFrame, side: str, width: int) -> DataFrame:
    """Index of a feature table: one row per clip with its vector width and count, renamed per side."""
    keys = [c for c in stored.columns if c != "values"]
    index = stored.groupBy(*keys).agg(
        F.max(F.size("values")).alias("width"),
        F.min(F.size("values") == width).alias("width_ok"),
        F.count("*").alias("vector_count"),
    )
    return index.withColumnsRenamed({"vector_count": f"{side}_vector_count"})


def feature_faults(stored: DataFrame, width: int, views: Sequence[str], key: str = "file_id") -> DataFrame:
    """Clips whose feature vectors break the contract, with a count of each fault; one grouping.

    Expected are rows of (key, view, values, what describes the clip): ``width`` finite numbers in every vector, the same
    number of vectors in each of ``views`` and no other view, and one description per clip.  A null key is a clip of its own.
    """
    described = [c for c in stored.columns if c not in (key, "view", "values")]
    size = F.coalesce(F.size("values"), F.lit(-1))
    of_view = [F.count_if(F.col("view") == v) for v in views]
    known = F.coalesce(F.col("view").isin(*views), F.lit(False))
    told = F.struct(*described) if described else F.lit(0)
    counted = stored.groupBy(key).agg(
        F.count_if(size != width).alias("wrong_width"),
        F.count_if(~F.coalesce(guards.all_finite(F.col("values")), F.lit(False))).alias("not_finite"),
        F.count_if(~known).alias("unknown_view"),
        sum((n == 0).cast("bigint") for n in of_view).alias("missing_views"),
        (F.greatest(*of_view) - F.least(*of_view) if len(views) > 1 else F.lit(0).cast("bigint")).alias("uneven_views"),
        (~F.min(told).eqNullSafe(F.max(told))).cast("bigint").alias("described_twice"),
    )
    faults = ["wrong_width", "not_finite", "unknown_view", "missing_views", "uneven_views", "described_twice"]
    broken = F.lit(False)
    for fault in faults:
        broken = broken | (F.col(fault) > 0)
    return counted.where(broken)


def require_feature_contract(stored: DataFrame, width: int, views: Sequence[str], label: str = "Feature table") -> DataFrame:
    worst = feature_faults(stored, width, views).orderBy("file_id").first()
    if worst is not None:
        found = ", ".join(f"{name} {n}" for name, n in worst.asDict().items() if name != "file_id" and n)
        raise ContractError(f"{label} breaks its contract at {worst['file_id']}: {found}")
    return stored


def read_feature_index(spark: SparkSession, path: str, side: str, width: int, views: Sequence[str]) -> DataFrame:
    """Index of a stored feature table that meets its contract, one row per clip and view, counts renamed per side."""
    stored = read_table(spark, path, ("file_id", "view", "values"))
    return feature_index(require_feature_contract(stored, width, views, path), side, width)


def load_channels(
    maps: DataFrame, keys: Sequence[str], channels: Sequence[str], available: Sequence[str]
) -> DataFrame:
    """Requested channels in the caller's order; Parquet reads only those columns."""
    unknown = sorted(set(channels) - set(available))
    if unknown:
        raise ValueError(f"Unknown feature channel(s): {', '.join(unknown)}")
    return maps.select(*keys, *channels)
