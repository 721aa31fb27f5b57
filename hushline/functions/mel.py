"""Mel filter weights as small parameter tables (mel, bin, weight)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

WEIGHTS = T.StructType(
    [
        T.StructField("mel", T.IntegerType()),
        T.StructField("bin", T.IntegerType()),
        T.StructField("weight", T.DoubleType()),
    ]
)


def floor_binned_filters(
    n_fft: int, sample_rate: int, n_mels: int, fmin: float = 0.0, fmax: float | None = None
) -> np.ndarray:
    """Triangles between floored bin edges, un-normalised; every slope spans at least one bin."""
    top = sample_rate / 2.0 if fmax is None else min(fmax, sample_rate / 2.0)
    if top <= fmin:
        raise ValueError("The upper mel frequency has to lie above the lower one")
    to_mel = lambda hz: 2595.0 * np.log10(1.0 + hz / 700.0)
    hz = 700.0 * (10.0 ** (np.linspace(to_mel(fmin), to_mel(top), n_mels + 2) / 2595.0) - 1.0)
    edges = np.floor((n_fft + 1) * hz / sample_rate).astype(int)
    left = edges[:-2, None]
    centre = np.maximum(edges[1:-1, None], left + 1)
    right = np.maximum(edges[2:, None], centre + 1)
    bins = np.arange(n_fft // 2 + 1)[None, :]
    rising = np.where((bins >= left) & (bins < centre), (bins - left) / (centre - left), 0.0)
    falling = np.where((bins >= centre) & (bins < right), (right - bins) / (right - centre), 0.0)
    return rising + falling


def area_normalised_filters(n_fft: int, sample_rate: int, n_mels: int) -> np.ndarray:
    """Auditory-toolbox mel scale (linear below 1 kHz), triangles of unit area in Hz."""
    # 200/3 Hz per mel up to 1000 Hz, then 27 steps per factor 6.4.
    step, knee, log_step = 200.0 / 3.0, 1000.0, np.log(6.4) / 27.0
    knee_mel = knee / step
    top = sample_rate / 2.0
    top_mel = top / step if top < knee else knee_mel + np.log(top / knee) / log_step
    mels = np.linspace(0.0, top_mel, n_mels + 2)
    hz = np.where(mels < knee_mel, mels * step, knee * np.exp(log_step * (mels - knee_mel)))
    bins = np.fft.rfftfreq(n_fft, 1.0 / sample_rate)[None, :]
    low, mid, high = hz[:-2, None], hz[1:-1, None], hz[2:, None]
    triangle = np.clip(np.minimum((bins - low) / (mid - low), (high - bins) / (high - mid)), 0.0, None)
    return triangle * (2.0 / (high - low))


def weight_table(spark: SparkSession, filters: np.ndarray) -> DataFrame:
    """Non-zero weights as rows; its size is set by the filter parameters, never by the data."""
    mel, bin_ = np.nonzero(filters)
    rows = [(int(m), int(b), float(filters[m, b])) for m, b in zip(mel, bin_)]
    return spark.createDataFrame(rows, WEIGHTS)
