"""Framing, short-time Fourier transforms and their inverses.

Layout.  A *frame* row holds one window of both channels and is keyed by (clip_no, block, frame), where
a block is a run of ``block`` consecutive frames.  After the transform the packed spectra are placed by
hash(clip_no, block): everything that runs along frames or along bins inside a block (windows, sums per
frame) then needs no further shuffle, and a very long clip is spread over its blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushline.operators import chunks
from hushline.operators.guards import required

BLOCK = 512
FRAME_KEYS = ["clip_no", "block", "frame"]
PACKED = ("near_re", "near_im", "far_re", "far_im")


@dataclass(frozen=True)
class Stft:
    """One transform convention.

    Plain: frames start at sample zero, an extra frame ends at the last sample, symmetric window, no scaling.
    ``centred``: the signal is extended by half a window of zeros on both sides and the window is periodic;
    ``padded`` also pads the end to whole hops, and ``scaled`` divides by the window sum.
    """

    n_fft: int = 1024
    win: int = 1024
    hop: int = 512
    centred: bool = False
    padded: bool = False
    scaled: bool = False

    def __post_init__(self) -> None:
        if self.win > self.n_fft:
            raise ValueError("win must not exceed n_fft")
        if self.hop > self.win:
            raise ValueError("hop must not exceed win")

    @property
    def bins(self) -> int:
        return self.n_fft // 2 + 1

    def window(self) -> np.ndarray:
        if self.centred:
            return 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(self.win) / self.win)
        return np.hanning(self.win)

    def scale(self) -> float:
        return 1.0 / float(self.window().sum()) if self.scaled else 1.0

    @classmethod
    def reference(cls, n_fft: int = 1024, hop: int = 512) -> Stft:
        """Convention of the reference-subtraction path."""
        return cls(n_fft, n_fft, hop, centred=True, padded=True, scaled=True)

    @classmethod
    def log_mel(cls, n_fft: int = 1024, hop: int = 512) -> Stft:
        """Convention of the log-mel vectors."""
        return cls(n_fft, n_fft, hop, centred=True)


def with_samples(clips: DataFrame) -> DataFrame:
    """Add the clip length where the table does not carry it."""
    if "samples" in clips.columns:
        return clips
    return clips.join(clips.groupBy("clip_no").agg(F.count("*").alias("samples")), "clip_no")


def blocks(clips: DataFrame, convention: Stft, block: int = BLOCK, channels: Sequence[str] = ("near", "far")) -> DataFrame:
    """Block rows: as they are, or gathered from long samples or chunk rows.  Steps that transform clips several times store them."""
    return clips if "at" in clips.columns else chunks.gather(with_samples(clips), convention, block, channels)


def frames(clips: DataFrame, convention: Stft, block: int = BLOCK, channels: Sequence[str] = ("near", "far")):
    """Windows as arrays (one row per frame), from long samples (clip_no, t, samples, channels), chunk rows or block rows.

    Samples move at most once, into blocks of frames with a halo; short clips are padded with zeros on the right.
    ``width`` counts the samples of the clip in a window.
    """
    return chunks.frames(blocks(clips, convention, block, channels), convention, block, channels)


def stft(
    clips: DataFrame, convention: Stft, block: int = BLOCK, channels: Sequence[str] = ("near", "far"),
    names: Sequence[str] | None = None, placed: bool = True,
) -> DataFrame:
    """Spectra as arrays per frame row, from long samples, chunk rows or block rows.

    Framing and transform are one step on a block's arrays.  ``placed`` puts the spectra by (clip_no, block), for steps that
    run along frames; without it nothing moves after the samples met in their blocks.
    """
    out = chunks.transform(blocks(clips, convention, block, channels), convention, block, channels, names or channels)
    return out.repartition("clip_no", "block") if placed else out


def explode_bins(packed: DataFrame, arrays: Sequence[str] = PACKED) -> DataFrame:
    """Long spectra: one row per (clip_no, block, frame, bin) with the named arrays as scalars."""
    rest = [c for c in packed.columns if c not in arrays]
    zipped = packed.select(*rest, F.posexplode(F.arrays_zip(*arrays)).alias("bin", "_z"))
    return zipped.select(*rest, "bin", *[F.col(f"_z.{a}").alias(a) for a in arrays])


def attach_bins(
    packed: DataFrame,
    per_bin: DataFrame,
    values: Sequence[str],
    keys: Sequence[str] = ("clip_no",),
    clip_keys: DataFrame | None = None,
) -> DataFrame:
    """Join values known per (keys, bin) onto the packed spectra as arrays, without moving the spectra.

    The values are packed per key (at most one array of bins) and repeated per block of the clip, so the
    join runs on (clip_no, block), the placement the spectra already have.  ``clip_keys`` maps clip_no to keys
    that are not clip_no itself (such as the machine and section); ``last_block`` in ``per_bin`` saves looking the
    blocks up.
    """
    keys = list(keys)
    packing = [F.array_sort(F.collect_list(F.struct("bin", *values))).alias("_a")]
    if "last_block" in per_bin.columns:
        # The values came from these clips, so their own aggregation already knows how many blocks each has.
        arrays = per_bin.groupBy(*keys).agg(*packing, F.max("last_block").alias("_last"))
        side = arrays.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last"))))
    else:
        blocks = packed.select("clip_no", "block").distinct()
        if clip_keys is not None:
            blocks = blocks.join(clip_keys.select("clip_no", *keys), "clip_no")
        side = blocks.join(per_bin.groupBy(*keys).agg(*packing), keys)
    side = side.select("clip_no", "block", *[F.col(f"_a.{c}").alias(c) for c in values])
    joined = packed.join(side, ["clip_no", "block"], "left")
    kinds = {f.name: f.dataType.simpleString() for f in side.schema}
    checked = [required(F.col(c), kinds[c], "No values per bin for clip", "clip_no").alias(c) for c in values]
    return joined.select(*packed.columns, *checked)


def pack_bins(long: DataFrame, values: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Long spectra back to one row per frame (at most one array of bins)."""
    rows = F.array_sort(F.collect_list(F.struct("bin", *values)))
    firsts = [F.first(c).alias(c) for c in extra]
    packed = long.groupBy(*FRAME_KEYS).agg(rows.alias("_a"), *firsts)
    return packed.select(*FRAME_KEYS, *extra, *[F.col(f"_a.{c}").alias(c) for c in values])


def overlap_add(packed: DataFrame, convention: Stft, re: str, im: str, samples: str = "samples", block: int = BLOCK) -> DataFrame:
    """Samples (clip_no, t, samples, value, support) of the inverse transform, divided by the summed squared window.

    ``block`` is the block length the spectra were made with.
    """
    return chunks.samples_of(chunks.inverse(packed, convention, block, re, im, samples), ["value", "support"])


def reconstruct(
    packed: DataFrame, convention: Stft, re: str, im: str, fallback: DataFrame, channel: str = "near", block: int = BLOCK
) -> DataFrame:
    """Overlap-add inverse; samples no window supports fall back to the given channel."""
    whole = chunks.inverse(packed, convention, block, re, im, fallback=with_samples(fallback), channel=channel)
    return chunks.samples_of(whole, ["value"]).select("clip_no", "t", "value")
