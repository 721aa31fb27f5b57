"""Normal-only reconstruction scorers: per-group principal subspaces from distributed Gram sums.

The fit reduces each partition to Gram rows, sums the rows with Spark's vector summarizer, and decomposes one
small matrix per group.  Scores are reconstruction errors of packed vector blocks joined with their group's model.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushline.functions.numeric import d
from hushline.operators.guards import required
from hushline.operators.joins import with_group_rows
from hushline.operators.ordered import hashed_positions

RANK = 8
PACK = 256
# Groups a partition accumulates before it hands its partial sums on.
OPEN_GROUPS = 32


def held_out_split(rows: DataFrame, keys: Sequence[str], token: str, seed: int, fraction: float = 0.1) -> DataFrame:
    """Seeded subsample: mark the first ceil(fraction * n) rows of each group's hashed order as held out."""
    text = F.concat_ws("|", F.lit(str(seed)), F.col(token).cast("string"))
    placed = hashed_positions(rows, keys, text)
    kept = F.col("pos") >= F.ceil(d(fraction) * F.col("pos_count"))
    return placed.withColumn("kept", kept).drop("pos", "pos_count")


def gram_rows(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per group: the rows of sum(x x') plus one row (index -1) holding [sum(x), n]."""
    keys = list(keys)
    table = rows.select(*keys, F.col(value).cast("array<double>").alias("_x"))
    schema = T.StructType(
        [*[table.schema[k] for k in keys], T.StructField("row", T.IntegerType()), T.StructField("values", T.ArrayType(T.DoubleType()))]
    )

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: dict[tuple, np.ndarray] = {}

        def emit() -> Iterator[pd.DataFrame]:
            for key, gram in open_.items():
                # The augmented Gram matrix [x, 1]'[x, 1]: its last row is [sum(x), n].
                index = np.r_[np.arange(len(gram) - 1), -1]
                frame = pd.DataFrame({"row": index.astype(np.int32), "values": list(gram)})
                for name, part in zip(keys, key):
                    frame[name] = part
                yield frame[[*keys, "row", "values"]]
            open_.clear()

        for batch in batches:
            for key, part in batch.groupby(keys, sort=False):
                x = np.stack(part["_x"].to_numpy())
                x = np.hstack([x, np.ones((len(x), 1))])
                gram = x.T @ x
                open_[key] = open_[key] + gram if key in open_ else gram
            if len(open_) > OPEN_GROUPS:
                yield from emit()
        yield from emit()

    summed = table.mapInPandas(partials, schema).groupBy(*keys, "row").agg(
        Summarizer.sum(array_to_vector(F.col("values"))).alias("values")
    )
    return summed.select(*keys, "row", vector_to_array("values").alias("values"))


def _moments(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """(mean, covariance, n) from the summed Gram rows of one group."""
    ordered = rows.sort_values("row")
    table = np.stack(ordered["values"].to_numpy())
    last, gram = table[0], table[1:]
    n = last[-1]
    mean = last[:-1] / n
    return mean, gram[:, :-1] / n - np.outer(mean, mean), n


def fit_subspace(rows: DataFrame, keys: Sequence[str], value: str, rank: int = RANK) -> DataFrame:
    """One model row per group: mean, flattened leading components and the number of training vectors.

    Each group's task sees one d x d matrix, whatever the number of training rows.
    """
    keys = list(keys)
    grams = gram_rows(rows, keys, value)
    schema = T.StructType(
        [
            *[grams.schema[k] for k in keys],
            T.StructField("mean", T.ArrayType(T.DoubleType())),
            T.StructField("components", T.ArrayType(T.DoubleType())),
            T.StructField("vectors", T.LongType()),
        ]
    )

    def decompose(part: pd.DataFrame) -> pd.DataFrame:
        mean, covariance, n = _moments(part)
        _, basis = np.linalg.eigh(covariance)
        leading = basis[:, ::-1][:, :rank].T
        out = part[keys].head(1).copy()
        out["mean"] = [mean]
        out["components"] = [leading.ravel()]
        out["vectors"] = int(n)
        return out

    return grams.groupBy(*keys).applyInPandas(decompose, schema)


def pack_vectors(vectors: DataFrame, keys: Sequence[str], order: str, value: str, size: int = PACK) -> DataFrame:
    """Up to ``size`` consecutive vectors per row, flattened, so a model travels once per block of vectors."""
    block = F.floor(F.col(order) / d(size)).alias("_pack")
    rows = F.array_sort(F.collect_list(F.struct(order, value)))
    packed = vectors.select(*keys, order, value, block).groupBy(*keys, "_pack").agg(rows.alias("_r"))
    return packed.select(*keys, F.flatten(F.transform("_r", lambda x: x[value])).cast("array<double>").alias("flat"))


ERROR = T.StructType([T.StructField("error", T.DoubleType()), T.StructField("cells", T.LongType())])


def _views(array: pa.Array) -> list[np.ndarray]:
    values, offsets = array.flatten().to_numpy(), array.offsets.to_numpy()
    base = offsets[0]
    return [values[a - base : b - base] for a, b in zip(offsets[:-1], offsets[1:])]


def _error(flat: pa.Array, mean: pa.Array, components: pa.Array, target: pa.Array) -> pa.Array:
    errors, cells = [], []
    for x, m, basis, width in zip(_views(flat), _views(mean), _views(components), target.to_numpy()):
        centred = x.reshape(-1, len(m)) - m
        basis = basis.reshape(-1, len(m))
        missed = (centred - (centred @ basis.T) @ basis)[:, :width]
        errors.append(float(np.sum(missed * missed)))
        cells.append(missed.size)
    return pa.StructArray.from_arrays([pa.array(errors, pa.float64()), pa.array(cells, pa.int64())], names=["error", "cells"])


def reconstruction_scores(
    packed: DataFrame, model: DataFrame, keys: Sequence[str], clip_keys: Sequence[str], target: int | None = None
) -> DataFrame:
    """Squared reconstruction error per cell, micro-averaged per clip, over the first ``target`` dimensions.

    The model side is one row per group, repeated so that a group's vectors go to many tasks.
    """

    def error(flat: pa.Array, mean: pa.Array, components: pa.Array, width: pa.Array) -> pa.Array:
        return _error(flat, mean, components, width)

    width = F.size("mean") if target is None else F.lit(target)
    joined = with_group_rows(packed, model.select(*keys, "mean", "components"), keys)
    joined = joined.withColumn("mean", required(F.col("mean"), "array<double>", "No linear model for", *keys))
    scored = joined.withColumn("_e", F.arrow_udf(error, ERROR)("flat", "mean", "components", width.cast("int")))
    return scored.groupBy(*clip_keys).agg((F.sum("_e.error") / F.sum("_e.cells")).alias("anomaly_score"))


def micro_mean(errors: DataFrame, clip_keys: Sequence[str], error: str, cells: str) -> DataFrame:
    """Sum of squared errors over number of cells per clip."""
    return errors.groupBy(*clip_keys).agg((F.sum(error) / F.sum(cells)).alias("anomaly_score"))


# ---- Mahalanobis -------------------------------------------------------------------------------


def fit_mahalanobis(rows: DataFrame, keys: Sequence[str], value: str, shrinkage: float = 0.1) -> DataFrame:
    """Mean and precision per group; the covariance is shrunk to its mean variance, so it stays invertible."""
    if not 0.0 <= shrinkage <= 1.0:
        raise ValueError("shrinkage must lie in [0, 1]")
    keys = list(keys)
    grams = gram_rows(rows, keys, value)
    schema = T.StructType(
        [
            *[grams.schema[k] for k in keys],
            T.StructField("mean", T.ArrayType(T.DoubleType())),
            T.StructField("precision", T.ArrayType(T.DoubleType())),
        ]
    )

    def invert(part: pd.DataFrame) -> pd.DataFrame:
        mean, covariance, _ = _moments(part)
        size = len(mean)
        level = max(np.trace(covariance) / size, 1.0e-12)
        shrunk = (1.0 - shrinkage) * covariance + shrinkage * level * np.eye(size)
        out = part[keys].head(1).copy()
        out["mean"] = [mean]
        out["precision"] = [np.linalg.pinv(shrunk, hermitian=True).ravel()]
        return out

    return grams.groupBy(*keys).applyInPandas(invert, schema)


def mahalanobis_scores(
    packed: DataFrame, model: DataFrame, keys: Sequence[str], clip_keys: Sequence[str]
) -> DataFrame:
    """Mean squared Mahalanobis distance per clip; the precision must be square with the mean's width."""

    def distance(flat: pa.Array, mean: pa.Array, precision: pa.Array) -> pa.Array:
        errors, counts = [], []
        for x, m, p in zip(_views(flat), _views(mean), _views(precision)):
            if len(p) != len(m) ** 2:
                raise ValueError("precision must be square with dimension len(mean)")
            centred = x.reshape(-1, len(m)) - m
            errors.append(float(np.sum((centred @ p.reshape(len(m), -1)) * centred)))
            counts.append(len(centred))
        return pa.StructArray.from_arrays([pa.array(errors, pa.float64()), pa.array(counts, pa.int64())], names=["error", "cells"])

    joined = packed.join(model, list(keys), "left")
    joined = joined.withColumn("mean", required(F.col("mean"), "array<double>", "No covariance model for", *keys))
    scored = joined.withColumn("_e", F.arrow_udf(distance, ERROR)("flat", "mean", "precision"))
    return scored.groupBy(*clip_keys).agg((F.sum("_e.error") / F.sum("_e.cells")).alias("anomaly_score"))
