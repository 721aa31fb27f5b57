"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models: the model of a category sees the words of a text and the
probabilities of all earlier categories.  In training these probabilities are out-of-fold: the labelled sample is
split into folds by hash, and a row's probability for a category comes from the model fitted without the row's fold, so
later models learn from probabilities as uncertain as those they meet in use.  The models that are used are then fitted
on all rows.

Words.  ASCII letters are lower-cased, words are runs of letters (ASCII or beyond).  A text is the set of its words and of
their beginnings of ``STEMS`` bytes.  Each fit keeps the features whose share differs most between the two sides of its
category, by a chi-square statistic of ``least_chi`` at least on the rows that it is fitted on, ``max_words`` at most, ties in
byte order.

Sample.  The models are fitted on ``max_rows`` labelled rows at most, those of the smallest hash of doc_id; this bound is a
parameter.  Their word sets and the fitting are small and done on the driver, scoring runs over all documents in Arrow batches.

Defined cases: null and empty texts have no words and get the chain's base rate; labels of an unknown document are left out; a
document labelled several times counts as a category if any label says so; null labels are 0; a category that the sample
lacks (or has only) gets its share as a constant; with no labels at all every probability is 0; rows that repeat are scored
on their own; other columns are left alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushline.llm.common import slices, utf8

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


@dataclass(frozen=True)
class Training:
    max_rows: int = 8_000
    max_words: int = 2_000
    min_rows: int = 4
    least_chi: float = 15.0
    folds: int = 4
    penalty: float = 0.05
    rounds: int = 200
    threshold: float = 0.5


STEMS = (4, 5, 7)


def word_set(text: bytes) -> set[bytes]:
    """Words, and with a star the beginnings of longer words."""
    words = set(text.translate(_FOLD).split())
    return words | {w[:n] + b"*" for n in STEMS for w in words if len(w) > n}


@dataclass
class Rows:
    """Sparse 0/1 features: the words of row i are ``words[at[i]:at[i + 1]]``."""

    words: np.ndarray
    at: np.ndarray

    def __post_init__(self) -> None:
        self.row = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=weights[self.words], minlength=len(self.at) - 1)

    def back(self, values: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.words, weights=values[self.row], minlength=size)

    def only(self, number: np.ndarray) -> Rows:
        """The features that have a new number (0 or more)."""
        kept = number[self.words] >= 0
        size = np.bincount(self.row[kept], minlength=len(self.at) - 1)
        return Rows(number[self.words[kept]], np.concatenate([[0], np.cumsum(size)]))

    def take(self, rows: np.ndarray) -> Rows:
        size = np.diff(self.at)[rows]
        first = np.cumsum(size) - size
        place = np.repeat(self.at[:-1][rows] - first, size) + np.arange(size.sum())
        return Rows(self.words[place], np.concatenate([[0], np.cumsum(size)]))


@dataclass
class Linear:
    """Logistic model of words, earlier probabilities and an intercept."""

    words: np.ndarray
    earlier: np.ndarray
    base: float

    def probability(self, rows: Rows, earlier: np.ndarray) -> np.ndarray:
        return _logistic(rows.times(self.words) + earlier @ self.earlier + self.base)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit(rows: Rows, earlier: np.ndarray, target: np.ndarray, size: int, training: Training) -> Linear:
    """Ridge-penalised logistic regression by accelerated gradient steps in the scale of each feature."""
    n, share = len(target), float(target.mean()) if len(target) else 0.0
    k = earlier.shape[1]
    if share in (0.0, 1.0):
        edge = 0.5 / (n + 1)
        share = min(max(share, edge), 1 - edge) if n else 1e-9
        return Linear(np.zeros(size), np.zeros(k), float(np.log(share / (1 - share))))
    keep = telling(rows, target, size, training)
    number = np.full(size, -1)
    number[keep] = np.arange(len(keep))
    rows = rows.only(number)
    # A diagonal bound of the curvature: features meet at most so many others in a row.
    meets = np.diff(rows.at) + k + 1.0
    curve_words = rows.back(meets, len(keep)) * 0.25 + training.penalty
    curve_rest = np.concatenate([(np.abs(earlier) * meets[:, None]).sum(axis=0), [meets.sum()]]) * 0.25 + 1e-9
    words, rest = np.zeros(len(keep)), np.concatenate([np.zeros(k), [np.log(share / (1 - share))]])
    ahead_words, ahead_rest, t = words.copy(), rest.copy(), 1.0
    for _ in range(training.rounds):
        off = _logistic(rows.times(ahead_words) + earlier @ ahead_rest[:k] + ahead_rest[k]) - target
        new_words = ahead_words - (rows.back(off, len(keep)) + training.penalty * ahead_words) / curve_words
        slope = np.concatenate([earlier.T @ off + training.penalty * ahead_rest[:k], [off.sum()]])
        new_rest = ahead_rest - slope / (curve_rest + training.penalty)
        next_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead_words = new_words + (t - 1) / next_t * (new_words - words)
        ahead_rest = new_rest + (t - 1) / next_t * (new_rest - rest)
        words, rest, t = new_words, new_rest, next_t
    weights = np.zeros(size)
    weights[keep] = words
    return Linear(weights, rest[:k], float(rest[k]))


def telling(rows: Rows, target: np.ndarray, size: int, training: Training) -> np.ndarray:
    """Features whose share differs most between the two sides of the target."""
    n, positive = len(target), target.sum()
    total = rows.back(np.ones(n), size)
    spread = total * (1 - total / n) * (positive / n) * (1 - positive / n)
    chi = (rows.back(target, size) - total * positive / n) ** 2 / np.maximum(spread, 1e-9)
    chi[total < training.min_rows] = 0
    best = np.lexsort((np.arange(size), -chi))[: training.max_words]
    return np.sort(best[chi[best] >= training.least_chi])


@dataclass
class Chain:
    categories: list[str]
    vocabulary: dict[bytes, int]
    models: list[Linear]

    def rows(self, texts: Sequence[bytes]) -> Rows:
        known = self.vocabulary
        found = [sorted(known[w] for w in word_set(t) if w in known) for t in texts]
        return Rows(np.array([w for ws in found for w in ws], np.int64), np.concatenate([[0], np.cumsum([len(ws) for ws in found])]).astype(np.int64))

    def probabilities(self, rows: Rows) -> np.ndarray:
        done = np.zeros((len(rows.at) - 1, 0))
        for model in self.models:
            done = np.column_stack([done, model.probability(rows, done)])
        return done


def train_chain(texts: list[bytes], targets: np.ndarray, folds: np.ndarray, categories: list[str], training: Training = Training()) -> Chain:
    """Fit the chain on the sample; ``targets`` has a 0/1 column per category, ``folds`` a fold number per row."""
    counts = Counter(w for t in texts for w in word_set(t))
    words = sorted(w for w, c in counts.items() if c >= training.min_rows)
    chain = Chain(categories, {w: i for i, w in enumerate(words)}, [])
    size = len(words)
    rows = chain.rows(texts)
    earlier = np.zeros((len(texts), 0))
    for k in range(len(categories)):
        target = targets[:, k].astype(float)
        out_of_fold = np.zeros(len(texts))
        for fold in range(training.folds):
            rest, own = np.flatnonzero(folds != fold), np.flatnonzero(folds == fold)
            if len(own):
                model = fit(rows.take(rest), earlier[rest], target[rest], size, training)
                out_of_fold[own] = model.probability(rows.take(own), earlier[own])
        chain.models.append(fit(rows, earlier, target, size, training))
        earlier = np.column_stack([earlier, out_of_fold])
    # Only words that some model uses are looked up later.
    used = np.flatnonzero(np.any([m.words != 0 for m in chain.models], axis=0))
    return Chain(categories, {words[i]: j for j, i in enumerate(used.tolist())}, [Linear(m.words[used], m.earlier, m.base) for m in chain.models])


def sample(docs: DataFrame, labels: DataFrame, categories: dict[str, str], training: Training) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Word sets (as joined bytes), targets and folds of the bounded labelled sample.  ``categories``: name to SQL condition."""
    flags = [F.max(F.coalesce(F.expr(c).cast("int"), F.lit(0))).alias(f"_y{i}") for i, c in enumerate(categories.values())]
    chosen = labels.groupBy("doc_id").agg(*flags).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(training.max_rows)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("words", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            words = [b" ".join(sorted(set(t.translate(_FOLD).split()))) for t in part.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words, pa.binary())], schema.names)

    texts = docs.select(F.col("doc_id").cast("long"), utf8("text").alias("_text")).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    # One row per chosen doc_id, any but always the same, however often rows repeat it.
    words = texts.mapInArrow(run, schema).groupBy("doc_id").agg(F.min_by("words", F.xxhash64("words")).alias("words"))
    found = words.join(chosen, "doc_id").orderBy("doc_id", "words").toArrow()  # max_rows documents at most
    targets = np.column_stack([found.column(f"_y{i}").to_numpy() for i in range(len(categories))]) if found.num_rows else np.zeros((0, len(categories)))
    ids = found.column("doc_id").to_numpy().astype(np.uint64)
    folds = ((ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(training.folds)
    return found.column("words").to_pylist(), targets, folds.astype(np.int64)


def score(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """doc_id, a probability per category, and ``toxic``: the last category's probability reaches the threshold."""
    names = [f"p_{c}" for c in chain.categories]
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names], T.StructField("toxic", T.BooleanType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            p = chain.probabilities(chain.rows(part.column("_text").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *[pa.array(p[:, k]) for k in range(len(names))], pa.array(p[:, -1] >= threshold)], schema.names
            )

    return docs.select(F.col("doc_id").cast("long"), utf8("text").alias("_text")).mapInArrow(run, schema)


def detect(docs: DataFrame, labels: DataFrame, categories: dict[str, str], training: Training = Training()) -> DataFrame:
    """Train the chain on the labelled sample and score all documents."""
    texts, targets, folds = sample(docs, labels, categories, training)
    return score(docs, train_chain(texts, targets, folds, list(categories), training), training.threshold)
