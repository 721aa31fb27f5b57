"""Line deduplication over overlapping three-line windows, in DataFrame functions only.

A text is split at ``\\n``.  Three consecutive lines form a window, known by 128 hash bits of its lines.  The first
occurrence of a window (smallest doc_id, then smallest line) stays; every line covered by a later occurrence is removed,
overlapping occurrences being merged.  Every window is compared that has a character other than white space; wholly
blank ones are left alone.  What repeats is judged on the input, not on what is left.

Counting is a plain aggregation (partial per task, so a window that a third of all documents share is a few rows), only
windows that repeat go on, and the join back is on the window key, which adaptive execution splits where it is hot.

Defined cases: a null text stays null and has no lines; texts of fewer than three lines have no windows and stay; rows are
told apart by a row key, so rows that repeat a doc_id, null ids and wholly equal rows count as documents of their own,
in the order of doc_id (null last), then of their texts' hashes; other columns pass through, but n_lines and n_removed
are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushline.llm.common import keyed
from hushline.session import stored

LINES = 3


def windows(rows: DataFrame) -> DataFrame:
    """``_key``, ``line`` and the window key ``_w1, _w2`` of each window of ``rows`` (``_key``, ``_row.text``) that is not blank."""
    parts = rows.where(F.col("_row.text").contains("\n")).select("_key", F.split("_row.text", "\n").alias("_lines"))
    hashed = parts.where(F.size("_lines") >= LINES).select(
        "_key",
        F.transform("_lines", lambda x: F.struct(
            F.xxhash64(F.lit(1), x).alias("a"),
            F.xxhash64(F.lit(2), x).alias("b"),
            x.rlike(r"\S").alias("inked"),
        )).alias("_l"),
    )
    at = F.sequence(F.lit(0), F.size("_l") - LINES)
    line = lambda i, k, name: F.get("_l", i + k)[name]
    found = hashed.select("_key", F.explode(F.transform(at, lambda i: F.struct(
        i.alias("line"),
        F.xxhash64(*[line(i, k, "a") for k in range(LINES)]).alias("w1"),
        F.xxhash64(*[line(i, k, "b") for k in range(LINES)]).alias("w2"),
        (line(i, 0, "inked") | line(i, 1, "inked") | line(i, 2, "inked")).alias("inked"),
    ))).alias("_w"))
    return found.where("_w.inked").select("_key", F.col("_w.line").alias("line"), F.col("_w.w1").alias("_w1"), F.col("_w.w2").alias("_w2"))


def later_windows(rows: DataFrame) -> DataFrame:
    """The occurrences of windows after the first one: ``_key``, ``line``."""
    every = windows(rows)
    repeated = every.groupBy("_w1", "_w2").agg(F.min(F.struct("_key", "line")).alias("_first"), F.count("*").alias("_times"))
    # Stored, so that both sides of the join are plain shuffles: adaptive execution then broadcasts or splits by measured size.
    repeated = stored(repeated.where("_times > 1").drop("_times"), "windows")
    return every.join(repeated, ["_w1", "_w2"]).where(F.struct("_key", "line") != F.col("_first")).select("_key", "line")


def covered_lines(rows: DataFrame) -> DataFrame:
    """Per row: the sorted first lines of its later windows."""
    return later_windows(rows).groupBy("_key").agg(F.sort_array(F.collect_set("line")).alias("_starts"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with covered lines taken out of ``text``, plus n_lines and n_removed."""
    # The rows travel as one struct, so that no column of theirs meets a column of the work.
    rows = keyed(docs)
    joined = rows.join(covered_lines(rows).withColumnRenamed("_key", "_k"), F.col("_key") == F.col("_k"), "left")
    gone = F.array_distinct(F.flatten(F.transform("_starts", lambda s: F.sequence(s, s + LINES - 1))))
    kept = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone"), lambda i: F.get("_lines", i)
    )
    joined = joined.withColumn("_lines", F.split("_row.text", "\n")).withColumn("_gone", F.when(F.col("_starts").isNotNull(), gone))
    text = F.when(F.col("_gone").isNull(), F.col("_row.text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *[text.alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")],
        F.coalesce(F.when(F.col("_row.text").isNull(), 0).otherwise(F.size("_lines")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
