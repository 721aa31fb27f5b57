"""Write-once sinks: Parquet, CSV, nested JSON, per-group score exports and feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushline.functions import paths
from hushline.schemas import GROUP, SCORE_COLUMNS

ONCE = "errorifexists"


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode(ONCE).partitionBy(*partition_by).parquet(path)


def write_scores(df: DataFrame, path: str) -> None:
    """Score CSV with header, sorted by file_id: a range sort, so part files are in global order."""
    df.select(*SCORE_COLUMNS).orderBy("file_id").write.mode(ONCE).csv(path, header=True)


def nested_metrics(metrics: DataFrame, names: Sequence[str], label: str) -> Column:
    entry = F.struct(F.concat_ws("/", *GROUP).alias("key"), F.struct(*names).alias("value"))
    groups = F.map_from_entries(F.array_sort(F.collect_list(entry)))
    return F.to_json(F.struct(groups.alias("groups"), F.lit(label).alias("score_file"))).alias("value")


def metrics_json(metrics: DataFrame, label: str) -> DataFrame:
    """One JSON document {"groups": {"machine/section": {...}}, "score_file": ...} with sorted keys.

    The metric table has one row per machine and section; that is all the document gathers.
    """
    names = sorted(c for c in metrics.columns if c not in GROUP)
    return metrics.agg(nested_metrics(metrics, names, label))


def write_metrics_json(metrics: DataFrame, path: str, label: str) -> None:
    metrics_json(metrics, label).coalesce(1).write.mode(ONCE).text(path)


def official_rows(decided: DataFrame, manifest: DataFrame) -> DataFrame:
    """(machine_type, section, basename, anomaly_score, decision) of thresholded scores."""
    named = manifest.select("file_id", paths.basename(F.col("relative_path")).alias("basename"))
    return decided.join(named, "file_id").select(*GROUP, "basename", "anomaly_score", "decision")


def write_official_scores(rows: DataFrame, folder: str) -> None:
    """Headerless ``basename,score`` and ``basename,decision`` files, one directory per machine and section."""
    for name, column in (("anomaly_score", "anomaly_score"), ("decision_result", "decision")):
        part = rows.select(*GROUP, "basename", column)
        part.write.mode(ONCE).partitionBy(*GROUP).csv(f"{folder}/{name}", header=False)


def read_official_scores(spark, folder: str, name: str = "anomaly_score") -> DataFrame:
    kind = "double" if name == "anomaly_score" else "int"
    schema = f"basename string, value {kind}, machine_type string, section string"
    return spark.read.schema(schema).csv(f"{folder}/{name}")


def vector_index(vectors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Index row per clip: its storage key and number of vectors."""
    return vectors.groupBy(*keys).agg(F.count("*").alias("vector_count")).withColumn(
        "storage_key", paths.storage_key(F.col("file_id"))
    )


def write_features(vectors: DataFrame, keys: Sequence[str], path: str) -> None:
    """Feature table partitioned by machine type, and its index."""
    write_table(vectors, f"{path}/vectors", ["machine_type"])
    stored = vectors.sparkSession.read.schema(vectors.schema).parquet(f"{path}/vectors")
    write_table(vector_index(stored, keys), f"{path}/index")
