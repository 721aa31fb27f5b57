"""Acoustic-path residual: transfer estimate, reliability gate, bounded removal, multi-view maps."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hushline.functions import complexes as c
from hushline.functions.complexes import Cx, cx
from hushline.functions.numeric import EPS, clip, d
from hushline.operators.frontends import bounded_coherence, ema, far_bin, near_bin, powers
from hushline.operators.recurrence import Matrices, map_frames, scan
from hushline.operators.selection import frequency_band
from hushline.operators.spectra import BLOCK, PACKED, attach_bins, explode_bins


@dataclass(frozen=True)
class PathSettings:
    """Fixed values of the acoustic-path front-end."""

    mode: str = "causal_ema"
    alpha: float = 0.95
    reg_floor: float = 1.0e-5
    smoothing_bins: int = 1
    gate_min: float = 0.0
    gate_max: float = 0.9
    coherence_weight: float = 4.0
    snr_weight: float = -0.5
    bias: float = 0.0
    bypass: bool = False
    max_removed_ratio: float = 0.8
    eps: float = EPS
    block: int = BLOCK

    def __post_init__(self) -> None:
        if self.mode not in ("causal_ema", "static_per_clip"):
            raise ValueError(f"Unknown transfer mode: {self.mode}")
        if self.gate_min > self.gate_max:
            raise ValueError("gate_min must not exceed gate_max")


def snr_proxy(near: Cx, far: Cx, eps: float) -> Column:
    return clip(F.log((c.power(near) + d(eps)) / (c.power(far) + d(eps))), -12.0, 12.0)


def log_ratio(near: Cx, far: Cx, eps: float) -> Column:
    return F.log((c.magnitude(near) + d(eps)) / (c.magnitude(far) + d(eps)))


def gate_value(coherence: np.ndarray, snr: np.ndarray, s: PathSettings) -> np.ndarray:
    logit = s.coherence_weight * (2.0 * coherence - 1.0) + s.snr_weight * snr + s.bias
    return np.clip(s.gate_min + (s.gate_max - s.gate_min) / (1.0 + np.exp(-np.clip(logit, -40.0, 40.0))), s.gate_min, s.gate_max)


def moving_mean(values: np.ndarray, width: int) -> np.ndarray:
    """Centred moving mean over the bins of each row with zero-padded edges."""
    bins = values.shape[1]
    padded = np.pad(values, ((0, 0), (width // 2, width - width // 2 - 1)))
    return sum(padded[:, k : k + bins] for k in range(width)) / width


def smooth_bins(packed: DataFrame, values: Sequence[str], width: int) -> DataFrame:
    """Packed spectra with the named arrays smoothed over bins, frame by frame."""
    smoothed = [f"_smooth_{v}" for v in values]
    wide = map_frames(packed, values, smoothed, lambda m: {f"_smooth_{v}": moving_mean(m[v], width) for v in values})
    return wide.select(*[F.col(f"_smooth_{n}").alias(n) if n in values else F.col(n) for n in packed.columns])


TRANSFER = ("transfer_re", "transfer_im", "coherence")


def transfer_of(averages: Matrices, s: PathSettings) -> Matrices:
    """Transfer and coherence from (clips or frames) x bins of averaged cross and auto powers."""
    smooth = {n: moving_mean(v, s.smoothing_bins) for n, v in averages.items()}
    inverse = 1.0 / (smooth["far"] + s.reg_floor)
    return {"transfer_re": smooth["re"] * inverse, "transfer_im": smooth["im"] * inverse, "coherence": bounded_coherence(smooth, s.eps)}


def static_arrays(packed: DataFrame, s: PathSettings) -> DataFrame:
    """One row per clip: transfer and coherence arrays from the clip's mean cross and auto power, and its last block."""
    cross = c.cross(near_bin(), far_bin())
    means = explode_bins(packed.select("clip_no", "block", *PACKED)).groupBy("clip_no", "bin").agg(
        F.max("block").alias("_last"),
        F.avg(cross.re).alias("re"), F.avg(cross.im).alias("im"),
        F.avg(c.power(near_bin())).alias("near"), F.avg(c.power(far_bin())).alias("far"),
    )
    stats = ("re", "im", "near", "far")
    rows = means.groupBy("clip_no").agg(F.max("_last").alias("last_block"), F.array_sort(F.collect_list(F.struct("bin", *stats))).alias("_a"))
    arrays = rows.select("clip_no", "last_block", *[F.col(f"_a.{n}").alias(n) for n in stats])
    return map_frames(arrays, stats, TRANSFER, lambda m: transfer_of(m, s)).select("clip_no", "last_block", *TRANSFER)


def static_transfer(packed: DataFrame, s: PathSettings) -> DataFrame:
    """One transfer row per (clip_no, bin)."""
    return explode_bins(static_arrays(packed, s), TRANSFER)


def with_transfer(packed: DataFrame, s: PathSettings) -> DataFrame:
    """Packed spectra with transfer and coherence arrays, causal or static per clip."""
    if s.mode == "static_per_clip":
        return attach_bins(packed, static_transfer(packed, s), list(TRANSFER))
    return scan(packed, [ema(s.alpha, TRANSFER, lambda m, averages: transfer_of(averages, s))], PACKED, s.block)


PATH = ("residual_re", "residual_im", "gate", "snr_proxy", "path_confidence", "removed_energy_ratio")


def cancelled(m: Matrices, s: PathSettings) -> Matrices:
    """Residual, gate and confidence of frames x bins; the removed energy is bounded frame by frame."""
    p = powers(m)
    snr = np.clip(np.log((p["near"] + s.eps) / (p["far"] + s.eps)), -12.0, 12.0)
    gate = np.zeros_like(snr) if s.bypass else gate_value(m["coherence"], snr, s)
    re = gate * (m["transfer_re"] * m["far_re"] - m["transfer_im"] * m["far_im"])
    im = gate * (m["transfer_re"] * m["far_im"] + m["transfer_im"] * m["far_re"])
    ratio = (re**2 + im**2).sum(axis=1, keepdims=True) / np.maximum(p["near"].sum(axis=1, keepdims=True), s.eps)
    scale = np.minimum(1.0, np.sqrt(s.max_removed_ratio / np.maximum(ratio, s.eps)))
    removed = ratio * scale * scale
    trust = m["coherence"] * (1.0 - np.clip(removed / s.max_removed_ratio, 0.0, 1.0))
    return {
        "residual_re": m["near_re"] - scale * re, "residual_im": m["near_im"] - scale * im, "gate": gate, "snr_proxy": snr,
        "path_confidence": np.clip(trust, 0.0, 1.0), "removed_energy_ratio": np.broadcast_to(removed, snr.shape),
    }


def path_arrays(packed: DataFrame, s: PathSettings = PathSettings()) -> DataFrame:
    """Packed spectra with the arrays of the acoustic path; the causal one leaves the task that carries its averages once."""
    if s.mode == "causal_ema":

        def finish(m: Matrices, averages: Matrices) -> Matrices:
            transfer = transfer_of(averages, s)
            return transfer | cancelled(m | transfer, s)

        return scan(packed, [ema(s.alpha, (*TRANSFER, *PATH), finish)], PACKED, s.block)
    return map_frames(with_transfer(packed, s), [*PACKED, *TRANSFER], PATH, lambda m: cancelled(m, s))


def acoustic_path(packed: DataFrame, s: PathSettings = PathSettings()) -> DataFrame:
    """Long spectra with residual, transfer, gate, snr_proxy, coherence, path_confidence and removed ratio."""
    return explode_bins(path_arrays(packed, s), [*PACKED, *TRANSFER, *PATH])


def multi_view(packed: DataFrame, s: PathSettings = PathSettings()) -> DataFrame:
    """Three views and the ten diagnostics per (clip_no, block, frame, bin)."""
    rows = acoustic_path(packed, s)
    near, far, residual = near_bin(), far_bin(), cx("residual")
    phase = c.angle(c.cross(near, far))
    return rows.select(
        *rows.columns,
        log_ratio(near, far, s.eps).alias("log_ratio"),
        F.sin(phase).alias("phase_sin"),
        F.cos(phase).alias("phase_cos"),
        c.magnitude(cx("transfer")).alias("transfer_magnitude"),
        (c.power(residual) / F.greatest(c.power(near), d(s.eps))).alias("view_to_near_energy_ratio"),
    )


def mel_maps(views: DataFrame, weights: DataFrame) -> DataFrame:
    """The eight base maps per (clip_no, frame, mel): log power for the views, weighted means for the rest.

    ``weights`` is a parameter table (mels x a few bins each), so broadcasting it is always safe; the sums per
    frame stay inside the (clip_no, block) placement.
    """
    w = F.col("weight")
    joined = views.join(F.broadcast(weights), "bin")
    logs = {"near": near_bin(), "far": far_bin(), "residual": cx("residual")}
    means = ("coherence", "log_ratio", "phase_sin", "phase_cos", "path_confidence")
    total = F.greatest(F.sum(w), d(1.0e-12))
    return joined.groupBy("clip_no", "block", "frame", "mel").agg(
        *[F.log1p(F.sum(w * c.power(z))).alias(n) for n, z in logs.items()],
        *[(F.sum(w * F.col(n)) / total).alias(n) for n in means],
    )


def band_statistics(views: DataFrame, sample_rate: int, n_fft: int) -> DataFrame:
    """Mean coherence, gate and path confidence per clip and frequency band."""
    hz = F.col("bin") * d(sample_rate / n_fft)
    banded = views.withColumn("band", frequency_band(hz)).where(F.col("band").isNotNull())
    return banded.groupBy("clip_no", "band").agg(
        *[F.avg(n).alias(f"mean_{n}") for n in ("coherence", "gate", "path_confidence")]
    )


def band_summary(statistics: DataFrame) -> DataFrame:
    return statistics.groupBy("band").agg(
        *[F.avg(n).alias(n) for n in ("mean_coherence", "mean_gate", "mean_path_confidence")]
    )


def reliability_index(maps: DataFrame) -> DataFrame:
    """Mean path confidence per clip, clipped to [0, 1]."""
    return maps.groupBy("clip_no").agg(clip(F.avg("path_confidence"), 0.0, 1.0).alias("reliability"))
