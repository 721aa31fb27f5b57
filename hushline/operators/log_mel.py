"""Stacked log-mel vectors of one channel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hushline.functions import complexes as c
from hushline.functions.complexes import cx
from hushline.functions.mel import area_normalised_filters, weight_table
from hushline.functions.numeric import FLOAT_EPS, decibels
from hushline.operators import spectra
from hushline.operators.spectra import BLOCK, Stft

STACK = 5
MELS = 128


def log_mel_frames(samples: DataFrame, channel: str, sample_rate: int, convention: Stft, n_mels: int, block: int = BLOCK):
    """One row per frame with its mel powers in dB as an array: (clip_no, block, frame, frames, values)."""
    packed = spectra.stft(samples, convention, block, [channel], ["x"])
    long = spectra.explode_bins(packed, ["x_re", "x_im"])
    filters = weight_table(samples.sparkSession, area_normalised_filters(convention.n_fft, sample_rate, n_mels))
    # Mel bands too narrow to hold a bin have no weight row; their power is zero.
    power = long.join(F.broadcast(filters), "bin").groupBy(*spectra.FRAME_KEYS, "mel").agg(
        F.sum(F.col("weight") * c.power(cx("x"))).alias("power"), F.first("frames").alias("frames")
    )
    pairs = F.map_from_entries(F.collect_list(F.struct("mel", "power")))
    maps = power.groupBy(*spectra.FRAME_KEYS).agg(pairs.alias("_m"), F.first("frames").alias("frames"))
    band = lambda i: decibels(F.coalesce(F.try_element_at("_m", i), F.lit(0.0)), FLOAT_EPS)
    values = F.transform(F.sequence(F.lit(0), F.lit(n_mels - 1)), band)
    return maps.select(*spectra.FRAME_KEYS, "frames", values.alias("values"))


def stack_frames(frames: DataFrame, values: str = "values", stack: int = STACK, block: int = BLOCK) -> DataFrame:
    """``stack`` consecutive frames flattened per row; clips shorter than that give no rows.

    The first frames of a block are also copied to the block before it, so the window over (clip_no, block)
    sees every frame it needs and a long clip is not gathered in one task.
    """
    own = F.col("block")
    halo = (F.col("frame") % block < stack - 1) & (own > 0)
    targets = F.when(halo, F.array(own, own - 1)).otherwise(F.array(own))
    spread = frames.select("clip_no", "frame", F.col(values).alias("_v"), own.alias("_own"), F.explode(targets).alias("block"))
    ahead = Window.partitionBy("clip_no", "block").orderBy("frame").rowsBetween(Window.currentRow, stack - 1)
    stacked = spread.withColumn("_s", F.collect_list("_v").over(ahead))
    whole = stacked.where((F.col("_own") == F.col("block")) & (F.size("_s") == stack))
    return whole.select("clip_no", F.col("frame").alias("vec_idx"), F.flatten("_s").cast("array<float>").alias("values"))


def log_mel_vectors(samples: DataFrame, channel: str, sample_rate: int, n_mels: int = MELS, convention: Stft | None = None):
    """(clip_no, vec_idx, values) with stack * n_mels wide vectors."""
    shape = convention or Stft.log_mel()
    return stack_frames(log_mel_frames(samples, channel, sample_rate, shape, n_mels))
