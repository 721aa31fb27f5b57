"""Quality rules with risk-controlled thresholds.

Every document gets integer rule scores (per mille).  A rule rejects a document whose score is above the rule's cutoff in
the document's stratum.  The cutoffs come from labelled holdout documents: for each stratum and rule the cutoffs are
tested from the most lenient to the strictest, and a cutoff passes while the exact binomial test rejects "more than
``risk / rules`` of the good documents are lost" (the same as a Clopper-Pearson upper bound below that share).  Testing in
this fixed order and stopping at the first failure needs no correction inside a sequence; between the sequences
(strata x rules) the level is divided by their number (Bonferroni).  So with probability ``1 - level`` no stratum loses
more than ``risk`` of its good documents to the rules.  A stratum with too few labels gets no cutoff and loses nothing.

Defined cases: a null or empty text has no words and fails the base rules; null strata are a stratum of their own (empty
text); rows that repeat a doc_id are judged on their own; a document labelled several times counts as good only if all
its labels say so; an empty label table gives no cutoffs; further input columns are left alone.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushline.llm.common import data, offsets, slices, tidy, totals, utf8
from hushline.session import stored

SYMBOLS = b"#*$%&|<>"

#: Cutoffs of each rule in per mille, from the most lenient to the strictest.
CUTOFFS: dict[str, tuple[int, ...]] = {
    "symbol_rate": (900, 700, 500, 400, 300),
    "upper_rate": (900, 800, 700, 600, 500),
    "shout_rate": (900, 700, 500, 400, 300),
    "dup_line_rate": (900, 800, 700, 600, 500),
    "repeat_rate": (450, 400, 350, 300, 250),
}


@dataclass(frozen=True)
class Risk:
    """``risk``: most good documents a stratum may lose, all rules together; ``level``: chance that a bound fails."""

    risk: float = 0.02
    level: float = 0.05
    min_words: int = 50
    max_repeat_percent: int = 50


FEATURES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField(n, T.LongType()) for n in ("_upper", "_shout", "_lines")]
)


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice in the text."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered, end = 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            covered += at + 3 - max(at, end)
            end = at + 3
    return covered


def repeated_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and all lines with a word."""
    seen: set[bytes] = set()
    repeated = 0
    for line in text.split(b"\n"):
        if line.strip():
            if line in seen:
                repeated += 1
            seen.add(line)
    return repeated, len(seen) + repeated


def measure(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The counts of each text of a slice."""
    texts = batch.column("_text")
    at, bytes_ = offsets(texts), data(texts)
    classes = np.zeros(256, np.uint8)
    classes[0x80:0xC0] = 1
    classes[list(b" \t\n\x0b\x0c\r")] = 2
    classes[list(SYMBOLS)] = 3
    classes[ord("A") : ord("Z") + 1] = 4
    classes[ord("!")] = 5
    kinds = classes[bytes_]
    count = lambda k: totals(kinds == k, at)
    n_words, lines, dup_lines, repeats = [], [], [], []
    for text in texts.to_pylist():
        words = text.split()
        n_words.append(len(words))
        repeats.append(repeated_words(words))
        repeated, all_lines = repeated_lines(text)
        dup_lines.append(repeated)
        lines.append(all_lines)
    return {
        "n_words": np.array(n_words, np.int64),
        "word_chars": np.diff(at) - count(1) - count(2),
        "n_symbols": count(3),
        "n_dup_lines": np.array(dup_lines, np.int64),
        "n_repeat_words": np.array(repeats, np.int64),
        "_upper": count(4),
        "_shout": count(5),
        "_lines": np.array(lines, np.int64),
    }


def with_features(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) and the counts of the text."""
    names = list(keep if keep is not None else docs.columns)
    source = docs.select(*names, utf8(text).alias("_text"))
    schema = T.StructType([*docs.select(*names).schema.fields, *FEATURES.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            found = measure(part)
            columns = [part.column(n) for n in names] + [pa.array(found[f.name], pa.int64()) for f in FEATURES.fields]
            yield pa.RecordBatch.from_arrays(columns, [*names, *FEATURES.names])

    return source.mapInArrow(tidy(run), schema)


def base_failed(risk: Risk) -> Column:
    few = F.col("n_words") < risk.min_words
    return few | (100 * F.col("n_repeat_words") > risk.max_repeat_percent * F.col("n_words"))


def scores() -> dict[str, Column]:
    """Rule scores in whole per mille, so that comparisons are exact."""
    rate = lambda top, bottom: F.expr(f"1000 * {top} div greatest({bottom}, 1)")
    return {
        "symbol_rate": rate("n_symbols", "n_words"),
        "upper_rate": rate("_upper", "word_chars"),
        "shout_rate": rate("_shout", "n_words"),
        "dup_line_rate": rate("n_dup_lines", "_lines"),
        "repeat_rate": rate("n_repeat_words", "n_words"),
    }


def binomial_tail(lost: int, n: int, share: float) -> float:
    """P(X <= lost) for X ~ Bin(n, share), exactly, summed from its largest term down."""
    if n <= 0 or lost >= n:
        return 1.0
    log_term = (
        math.lgamma(n + 1) - math.lgamma(lost + 1) - math.lgamma(n - lost + 1)
        + lost * math.log(share) + (n - lost) * math.log1p(-share)
    )
    if lost > n * share:
        return 1.0  # at least a half: never small enough to pass
    total, term, k = 1.0, 1.0, lost
    while k > 0 and term > 1e-18 * total:
        term *= k * (1.0 - share) / ((n - k + 1) * share)
        total += term
        k -= 1
    return math.exp(log_term) * total


def cutoffs(measured: DataFrame, labels: DataFrame, stratum: Column, risk: Risk) -> DataFrame:
    """One row per stratum that has a passing cutoff: ``_stratum`` and ``_cut_<rule>`` (null: the rule stays off)."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("_quality")).where("_quality = 1")
    holdout = measured.where(~F.col("base_failed")).join(good, "doc_id").withColumn("_stratum", stratum)
    lost = [
        F.sum((F.col(f"_s_{rule}") > cut).cast("long")).alias(f"_l_{rule}_{cut}")
        for rule, cuts in CUTOFFS.items()
        for cut in cuts
    ]
    counts = holdout.groupBy("_stratum").agg(F.count("*").alias("_n"), *lost)
    counts = counts.withColumn("_strata", counts.agg(F.count("*").alias("_strata")).scalar())
    schema = T.StructType(
        [T.StructField("_stratum", T.StringType()), *[T.StructField(f"_cut_{r}", T.LongType()) for r in CUTOFFS]]
    )
    share = risk.risk / len(CUTOFFS)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for _, row in rows.iterrows():
                level = risk.level / (int(row["_strata"]) * len(CUTOFFS))
                found: dict[str, object] = {"_stratum": row["_stratum"]}
                for rule, cuts in CUTOFFS.items():
                    best = None
                    for cut in cuts:
                        if binomial_tail(int(row[f"_l_{rule}_{cut}"]), int(row["_n"]), share) > level:
                            break
                        best = cut
                    found[f"_cut_{rule}"] = best
                out.append(found)
            frame = pd.DataFrame(out, columns=schema.names)
            for rule in CUTOFFS:
                frame[f"_cut_{rule}"] = frame[f"_cut_{rule}"].astype("Int64")
            yield frame[frame[[f"_cut_{r}" for r in CUTOFFS]].notna().any(axis=1)]

    return counts.mapInPandas(choose, schema)


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: Risk = Risk(), carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the five counts, ``base_failed``, the rule scores, ``kept`` and the columns ``carry``, one row per row of ``docs``."""
    slim = docs.select("doc_id", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("_stratum"), "text", *carry)
    measured = with_features(slim, "text", ("doc_id", "_stratum", *carry)).withColumn("base_failed", base_failed(risk))
    measured = stored(measured.select("*", *[s.alias(f"_s_{r}") for r, s in scores().items()]), "quality")
    chosen = cutoffs(measured, labels, F.col("_stratum"), risk)
    joined = measured.join(chosen, "_stratum", "left")
    rejected = F.lit(False)
    for rule in CUTOFFS:
        rejected = rejected | F.coalesce(F.col(f"_s_{rule}") > F.col(f"_cut_{rule}"), F.lit(False))
    return joined.select(
        "doc_id", *FEATURES.names[:5], "base_failed", *[F.col(f"_s_{r}").alias(r) for r in CUTOFFS],
        (~F.col("base_failed") & ~rejected).alias("kept"), *carry,
    )
