"""Directories of headerless two-column score files, and checksum audits of written files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: name pattern of an official score file.
SCORE_FILE = r"^anomaly_score_(?:DCASE2026T2)?(.+?)_(section_\d+)_test.*\.csv$"


def read_score_files(spark: SparkSession, folder: str) -> DataFrame:
    """(machine_type, section, basename, anomaly_score) from files named after their machine and section."""
    lines = spark.read.option("pathGlobFilter", "anomaly_score_*.csv").text(folder)
    return _parsed(lines.select(F.col("_metadata.file_name").alias("name"), "value"))


def read_score_directories(spark: SparkSession, folder: str) -> DataFrame:
    """The same for score sets Spark wrote, where each named set is a folder of part files.

    The folder is named like the file, also as the partition folder ``column=name`` of one partitioned write.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(folder)
    parent = F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -2), r"^\w+=", "")
    return _parsed(lines.select(parent.alias("name"), "value"))


def _parsed(lines: DataFrame) -> DataFrame:
    """Names that do not match are skipped, blank lines too; any other number of columns fails the read."""
    lines = lines.select("name", F.trim("value").alias("line"))
    named = lines.where(F.col("name").rlike(SCORE_FILE) & (F.col("line") != ""))
    parsed = named.withColumn("_c", F.from_csv("line", "a string, b string, c string"))
    wrong = F.col("_c.b").isNull() | F.col("_c.c").isNotNull()
    score = F.when(wrong, F.raise_error(F.concat(F.lit("A line without exactly a name and a score is in "), "name")).cast("double")).otherwise(
        F.col("_c.b").cast("double")
    )
    return parsed.select(
        F.regexp_extract("name", SCORE_FILE, 1).alias("machine_type"),
        F.regexp_extract("name", SCORE_FILE, 2).alias("section"),
        F.col("_c.a").alias("basename"),
        score.alias("anomaly_score"),
    )


def file_digests(
    spark: SparkSession, folder: str, pattern: str = "*", algorithm: str = "sha256", with_path: bool = False
) -> DataFrame:
    """(file_name, digest) of every file below a folder; ``with_path`` keeps the whole path as the name."""
    content = F.col("content")
    digests = {"sha256": F.sha2(content, 256), "md5": F.md5(content), "sha1": F.sha1(content)}
    if algorithm not in digests:
        raise ValueError(f"No digest named {algorithm}; there are {sorted(digests)}")
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    )
    name = F.col("path") if with_path else F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("file_name"), digests[algorithm].alias("digest"))


def checksum_audit(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(file_name, status): ok, mismatch, missing (expected only) or unexpected (found only)."""
    joined = actual.join(expected.withColumnRenamed("digest", "_want"), "file_name", "full_outer")
    status = (
        F.when(F.col("digest").isNull(), "missing")
        .when(F.col("_want").isNull(), "unexpected")
        .when(F.col("digest") == F.col("_want"), "ok")
        .otherwise("mismatch")
    )
    return joined.select("file_name", status.alias("status"))
