"""Reference subtraction: noise floors, transfer profiles, floored subtraction and clip diagnostics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushline.functions import complexes as c
from hushline.functions.complexes import cx
from hushline.functions.numeric import EPS, clip, d, decibels, risk_score
from hushline.operators import chunks, spectra
from hushline.operators.frontends import far_bin, near_bin
from hushline.operators.guards import required
from hushline.operators.ordered import ACCURACY, quantiles, sized_quantiles
from hushline.operators.spectra import BLOCK, PACKED, Stft
from hushline.schemas import GROUP

ENHANCED = ("enh_re", "enh_im")
DIAGNOSTICS = ("leakage_index", "transfer_instability", "spectral_drift", "noise_reduction_db")


@dataclass(frozen=True)
class SubtractionSettings:
    """Fixed values of the reference-subtraction path."""

    noise_quantile: float = 0.10
    alpha: float = 1.5
    beta: float = 0.10
    transfer_min: float = 0.10
    transfer_max: float = 10.0
    upper_quantile: float = 0.95
    lower_quantile: float = 0.05
    eps: float = EPS
    block: int = BLOCK


def power_floors(packed: DataFrame, channels: Sequence[str], s: SubtractionSettings) -> DataFrame:
    """Noise-quantile of the power over frames per (clip_no, bin), one ``<channel>_floor`` per channel."""
    arrays = [f"{ch}_{part}" for ch in channels for part in ("re", "im")]
    long = spectra.explode_bins(packed.select("clip_no", "frames", *arrays), arrays)
    fan = F.array(*[F.struct(F.lit(ch).alias("channel"), c.power(cx(ch)).alias("power")) for ch in channels])
    rows = long.select("clip_no", "bin", "frames", F.inline(fan))
    keys = ["clip_no", "bin", "channel"]
    floors = sized_quantiles(rows, keys, "power", {"floor": s.noise_quantile}, F.col("frames"))
    pick = lambda ch: F.max(F.when(F.col("channel") == ch, F.col("floor")))
    return floors.groupBy("clip_no", "bin").agg(*[pick(ch).alias(f"{ch}_floor") for ch in channels])


def noise_transfer(floors: DataFrame, groups: DataFrame, s: SubtractionSettings) -> DataFrame:
    """Median near/far floor ratio over the normal training clips of each group, clipped.

    ``groups`` holds clip_no, machine_type and section of the training clips only.
    """
    rows = floors.join(groups.select("clip_no", *GROUP), "clip_no")
    rows = rows.withColumn("ratio", F.col("near_floor") / F.greatest(F.col("far_floor"), d(s.eps)))
    median = quantiles(rows, [*GROUP, "bin"], "ratio", {"ratio": 0.5})
    return median.select(*GROUP, "bin", clip(F.col("ratio"), s.transfer_min, s.transfer_max).alias("transfer_power"))


def with_group_transfer(packed: DataFrame, transfer: DataFrame, manifest: DataFrame) -> DataFrame:
    """The group's transfer as an array per frame (bin-aligned), joined without moving the spectra."""
    return spectra.attach_bins(packed, transfer, ["transfer_power"], GROUP, manifest)


def subtract(packed: DataFrame, s: SubtractionSettings) -> DataFrame:
    """Long spectra with the enhanced spectrum: floored power, near phase."""
    long = spectra.explode_bins(packed, [*PACKED, "transfer_power"])
    near = c.power(near_bin())
    left = near - d(s.alpha) * F.col("transfer_power") * c.power(far_bin())
    gain = F.when(near > d(0.0), F.sqrt(F.greatest(left, d(s.beta) * near) / near)).otherwise(d(0.0))
    enhanced = c.scaled(near_bin(), gain)
    return long.select("*", enhanced.re.alias("enh_re"), enhanced.im.alias("enh_im"))


def enhanced_waveform(packed: DataFrame, convention: Stft, s: SubtractionSettings) -> DataFrame:
    """Chunk rows (clip_no, block, samples, start, value) of the subtracted near channel; zero where no window reaches."""
    rows = spectra.pack_bins(subtract(packed, s), ENHANCED, ["samples"])
    wave = chunks.inverse(rows, convention, s.block, *ENHANCED)
    known = F.transform("value", lambda x: F.coalesce(x, d(0.0)))
    return wave.select("clip_no", "block", "samples", "start", known.alias("value"))


def compared_spectra(clips: DataFrame, waveform: DataFrame, convention: Stft, block: int) -> DataFrame:
    """Packed spectra of both channels and of the inverted waveform (the diagnostics read these, not the subtracted ones).

    Samples meet in their blocks and are transformed there side by side; spectra, several times as large, do not move.
    """
    enhanced = spectra.blocks(waveform, convention, block, ["value"]).withColumnRenamed("at", "value_at").drop("samples")
    joined = spectra.blocks(clips, convention, block).join(enhanced, ["clip_no", "block"])
    return spectra.stft(joined, convention, block, ["near", "far", "value"], ["near", "far", "enh"], placed=False).drop("samples")


def clip_diagnostics(both: DataFrame, transfer: DataFrame, manifest: DataFrame, s: SubtractionSettings) -> DataFrame:
    """Leakage, instability, drift, noise reduction and risk per clip, from packed spectra of near, far and enhanced channel."""
    long = spectra.explode_bins(both, [*PACKED, *ENHANCED])
    cross = c.cross(near_bin(), far_bin())
    powers = {"near": c.power(near_bin()), "far": c.power(far_bin()), "enh": c.power(cx("enh"))}
    near_size, enhanced_size = F.sqrt(powers["near"]), F.sqrt(powers["enh"])
    means = [
        F.avg(cross.re).alias("x_re"), F.avg(cross.im).alias("x_im"),
        F.avg(powers["near"]).alias("nn"), F.avg(powers["far"]).alias("ff"),
        F.sum(F.abs(enhanced_size - near_size)).alias("moved"), F.sum(near_size).alias("size"),
    ]
    # Usual clips: floors and means in one aggregation (its buffers hold at most ACCURACY frames per bin).
    q = F.lit(s.noise_quantile)
    short = long.where(F.col("frames") <= ACCURACY).groupBy("clip_no", "bin").agg(
        *means, *[F.percentile(p, q).alias(f"{ch}_floor") for ch, p in powers.items()]
    )
    # Very long clips: the same numbers with bracketed floors.
    lengthy = both.where(F.col("frames") > ACCURACY)
    floors = power_floors(lengthy, ("near", "far", "enh"), s)
    long_means = spectra.explode_bins(lengthy, [*PACKED, *ENHANCED]).groupBy("clip_no", "bin").agg(*means)
    per_bin = short.unionByName(long_means.join(floors, ["clip_no", "bin"]))
    rows = per_bin.join(manifest.select("clip_no", *GROUP), "clip_no")
    rows = rows.join(transfer, [*GROUP, "bin"], "left")
    rows = rows.withColumn("transfer_power", required(F.col("transfer_power"), "double", "No noise profile for", *GROUP))
    floor = lambda value: F.greatest(value, d(s.eps))
    coherence = clip(c.power(cx("x")) / floor(F.col("nn") * F.col("ff")), 0.0, 1.0)
    weight = F.greatest(F.col("nn") - F.col("near_floor"), d(0.0))
    own = clip(F.col("near_floor") / floor(F.col("far_floor")), s.transfer_min, s.transfer_max)
    log_error = F.abs(F.log(floor(own)) - F.log(floor(F.col("transfer_power"))))
    # The median runs over the bins of one clip: at most n_fft / 2 + 1 values.
    out = rows.groupBy("clip_no").agg(
        (F.sum(coherence * weight) / floor(F.sum(weight))).alias("leakage_index"),
        F.percentile(log_error, F.lit(0.5)).alias("transfer_instability"),
        (F.sum("moved") / floor(F.sum("size"))).alias("spectral_drift"),
        (decibels(F.sum("near_floor"), s.eps) - decibels(F.sum("enh_floor"), s.eps)).alias("noise_reduction_db"),
    )
    risk = risk_score(F.col("leakage_index"), F.col("transfer_instability"), F.col("spectral_drift"))
    return out.withColumn("risk_score", risk)


def group_profiles(diagnostics: DataFrame, s: SubtractionSettings, keys: Sequence[str] = GROUP) -> DataFrame:
    """Conservative quantiles of the training diagnostics per group, with the combined risk."""
    keys = list(keys)
    long = diagnostics.unpivot(keys, list(DIAGNOSTICS), "metric", "value")
    ends = quantiles(long, [*keys, "metric"], "value", {"upper": s.upper_quantile, "lower": s.lower_quantile})
    pick = lambda metric, end: F.max(F.when(F.col("metric") == metric, F.col(end)))
    wide = ends.groupBy(*keys).agg(
        pick("leakage_index", "upper").alias("leakage_u95"),
        pick("transfer_instability", "upper").alias("transfer_instability_u95"),
        pick("spectral_drift", "upper").alias("spectral_drift_u95"),
        pick("noise_reduction_db", "lower").alias("noise_reduction_l05_db"),
    )
    counts = diagnostics.groupBy(*keys).agg(F.count("*").alias("training_clips"))
    risk = risk_score(F.col("leakage_u95"), F.col("transfer_instability_u95"), F.col("spectral_drift_u95"))
    return wide.withColumn("risk_score", risk).join(counts, keys)
