"""From raw documents to encoded training text: five stages of the training-data operators, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again for the next one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushline.llm import decontamination, line_dedup, near_copies, quality_rules, sentencepiece_codec
from hushline.llm.common import keyed, table
from hushline.session import ship_package, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the risk-controlled cutoffs, each row judged on its own."""
    ship_package(spark)
    rows = keyed(docs.select(*COLUMNS))
    judged = quality_rules.judge(rows.select("_row.*", "_key"), table(spark, sf_dir, "labels"), carry=("_key",))
    rejected = judged.where(~F.col("kept")).select("_key")
    return rows.join(rejected, "_key", "left_anti").select("_row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of repeated three-line windows, however short (not blank); n_chars follows the text."""
    cleaned = line_dedup.deduplicate(docs.select(*COLUMNS))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity of 0.8 or more)."""
    ship_package(spark)
    return near_copies.drop_near_copies(docs.select(*COLUMNS)).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up less than a twentieth."""
    ship_package(spark)
    return decontamination.remove_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """The documents with their SentencePiece ids, and whether these give the text back."""
    ship_package(spark)
    coded = sentencepiece_codec.encode(docs.select(*COLUMNS), model_path or public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(*COLUMNS, "n_ids", "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("encoded", encoded),
]

#: The fingerprints, the interval of the cutoffs and the piece encoding have no SQL form; the tests compare with plain code.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
