"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushline.llm import alignment, chat_tools, decontamination, hard_negatives, line_dedup, ngram_join, oracles, quality_rules, sentencepiece_codec, sharding, simhash, suffix_dedup, token_codec, toxicity
from hushline.llm.common import table
from hushline.session import new_folder

Query = Callable[[SparkSession, str], DataFrame]


#: The chain's categories, in order, as conditions on the label table.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), CATEGORIES)


def op2_token_codec(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    with open(tokenizer_path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        tokenizer = file.read()
    path = new_folder(spark, "huffman")
    token_codec.write(table(spark, sf_dir, "documents"), path, tokenizer, end_id=2)
    return token_codec.read(spark, path, with_ids=False)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op5_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepiece_codec.encode(docs, model_path or public_tokenizers.path("piece_bpe_32k.model"))
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "n_ids", "ids", same.alias("round_trip"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.interleave(table(spark, sf_dir, "documents"), shards=16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_removed", "text")


def tool_messages(conversations: DataFrame) -> DataFrame:
    """A tool log derived from the conversations.

    A user's turn is a call that comes after the call two turns before; the assistant's turn after it is the result.
    Every fifth result is logged two turns early, every seventh limit is a text, every eleventh turn names no known tool.
    """
    size = F.coalesce(F.length("text"), F.lit(0))
    call = F.to_json(F.struct(F.struct(
        F.concat(F.lit("c"), F.col("turn")).alias("id"),
        F.when(F.col("turn") % 11 == 10, "other").otherwise("search").alias("name"),
        F.struct(F.col("text").alias("query"), F.when(size % 7 != 0, size).alias("limit"), F.when(size % 7 == 0, size.cast("string")).alias("depth")).alias("arguments"),
        F.concat(F.lit("c"), F.col("turn") - 2).alias("after"),
    ).alias("tool_call")))
    result = F.to_json(F.struct(F.struct(F.concat(F.lit("c"), F.col("turn") - 1).alias("id"), F.col("text").alias("content")).alias("tool_result")))
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    early = assistant & ((F.col("conv_id") + F.col("turn")) % 5 == 0)
    return conversations.select(
        "conv_id", F.when(early, F.col("turn") - 2).otherwise(F.col("turn")).alias("turn"),
        F.when(user, "assistant").when(assistant, "tool").otherwise(F.col("role")).alias("role"),
        F.when(user, call).when(assistant, result).otherwise(F.col("text")).alias("text"),
    )


SCHEMAS = [("search", "limit", "integer", True), ("search", "query", "string", True)]


def op10_chat_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    schemas = spark.createDataFrame(SCHEMAS, "name string, arg string, type string, required boolean")
    linked = chat_tools.link(tool_messages(table(spark, sf_dir, "conversations")), schemas)
    return linked.withColumn("errors", F.array_join("errors", ";"))


def op11_alignment(spark: SparkSession, sf_dir: str, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    both = alignment.Tokenizers.load(a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.align(table(spark, sf_dir, "documents"), both)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"), ngram_join.Rule(size=3, num=9, den=10))


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_token_codec": op2_token_codec,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_simhash": op6_simhash,
    "op7_quality_rules": op7_quality_rules,
    "op8_sharding": op8_sharding,
    "op9_line_dedup": op9_line_dedup,
    "op10_chat_tools": op10_chat_tools,
    "op11_alignment": op11_alignment,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_ngram_join": op13_ngram_join,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op3_suffix_dedup": oracles.SUFFIX_DEDUP,
    "op4_decontamination": oracles.CONTAMINATION,
    "op7_quality_rules": oracles.quality_sql(),
    "op8_sharding": oracles.SHARDING,
    "op9_line_dedup": oracles.LINE_DEDUP,
    "op10_chat_tools": oracles.CHAT_TOOLS,
    "op12_hard_negatives": oracles.HARD_NEGATIVES,
    "op13_ngram_join": oracles.NGRAM_JOIN,
}
