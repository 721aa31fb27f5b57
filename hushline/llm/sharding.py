"""Sharding by proportional stratified interleaving.

Within each source the rows get a seeded random order; a row's fractional rank is ``(2 * rank - 1) / (2 * rows of the
source)``.  Sorted by fractional rank, every stretch of the order holds each source in its share, so cutting the order into
equal stretches gives shards that match the mixture; their counts differ by one at most (law ``rows``).

No source and no stretch is handled by one task: both orders are range-partitioned on their full key, which ends in a number
of the row itself, so sources of one row each, rows without a doc_id and rows that repeat split like any others.  A row's
place in its partition is written down with it, and a small table of counts supplies what comes before the partition.

Defined cases: null sources are a source of their own; null texts have size 1 and the checksum of no bytes; rows that
repeat are ordered by their size and checksum and are otherwise interchangeable; fewer rows than shards leave shards
empty; further columns stay where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hushline.llm.common import keyed
from hushline.session import stored

#: Rows that one range of an order should hold.
RANGE_ROWS = 200_000


def laid_out(rows: DataFrame, ranges: int, order: list[str], purpose: str) -> DataFrame:
    """``rows`` in the order, stored, with ``_range`` and ``_at``, the 0-based place in the range.

    The order must tell all rows apart; storing fixes the ranges, whose bounds Spark samples.
    """
    cut = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    return stored(
        cut.withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))),
        purpose,
    )


def numbered(placed: DataFrame, keys: list[str], name: str) -> DataFrame:
    """1-based rank ``name`` and group size ``<name>_of`` of rows laid out in an order that starts with ``keys``."""
    counts = placed.groupBy(*keys, "_range").agg(F.count("*").alias("_in"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        *keys, "_range", "_first", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_before"),
        F.sum("_in").over(Window.partitionBy(*keys)).alias(f"{name}_of"),
    )
    rank = F.col("_before") + F.col("_at") - F.col("_first") + 1
    return placed.join(counts, [*keys, "_range"]).withColumn(name, rank).drop("_range", "_at", "_first", "_before", "_in")


def interleave(docs: DataFrame, shards: int = 16, seed: int = 42, source: str = "source") -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot of every row; no text is shuffled."""
    return _interleaved(docs.withColumn("_key", F.monotonically_increasing_id()), shards, seed, source).drop("_key")


def _interleaved(docs: DataFrame, shards: int, seed: int, source: str) -> DataFrame:
    rows = docs.select(
        "doc_id",
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_digest"),
        "_key",
    )
    rows = stored(rows, "shard-rows")
    ranges = max(16, -(-rows.count() // RANGE_ROWS))
    ties = ["_digest", "doc_id", "size", "text_crc32", "_key"]
    ranked = numbered(laid_out(rows, ranges, ["source", *ties], "shard-ranks"), ["source"], "rank")
    ranked = ranked.withColumn("_part", (2 * F.col("rank") - 1) / (2.0 * F.col("rank_of")))
    ordered = laid_out(ranked.withColumn("_all", F.lit(0)), ranges, ["_part", "source", *ties], "shard-places")
    placed = numbered(ordered, ["_all"], "place")
    shard = F.expr(f"cast((place - 1) * {shards} div place_of as int)")
    placed = placed.withColumn("shard", shard)
    first = F.expr(f"(shard * place_of + {shards - 1}) div {shards}")  # places before the shard's first row
    return placed.select(
        "doc_id", "source", "size", "text_crc32", "shard", (F.col("place") - 1 - first).cast("long").alias("slot"), "_key"
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 42, source: str = "source") -> None:
    """Write whole rows of ``docs`` as Parquet, one folder per shard, rows in slot order.

    Rows without a doc_id and rows that share one are written like any others.
    """
    rows = keyed(docs)
    parts = rows.select("_row.doc_id", F.col(f"_row.{source}").alias("source"), "_row.text", "_key")
    where = _interleaved(parts, shards, seed, "source").select("_key", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    placed = rows.join(where, "_key").repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot")
    # The folder's and the order's columns replace columns of these names that the rows may have.
    mine = [F.col(f"_row.`{c}`") for c in docs.columns if c not in ("shard", "slot")]
    placed.select(*mine, F.col("_shard").alias("shard"), F.col("_slot").alias("slot")).write.partitionBy("shard").parquet(path)
