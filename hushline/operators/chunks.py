"""Clips as rows of sample arrays: cut into blocks with a halo, framed and transformed in place, and put together again.

A *block* row (clip_no, block, samples, at, channels) holds every sample that the frames ``block * n .. block * n + n - 1``
of its clip read, n being the frames of a block; neighbouring blocks therefore share some samples.  ``at`` lists
positions and each channel the values there; both may be nested one level, as the starts and arrays of pieces.  A channel
whose positions differ has them in ``<channel>_at``.
A *chunk* row (clip_no, block, samples, start, channels) holds ``n * hop`` consecutive samples of which no other row has one.

Framing and transforms work on one block at a time, so no sample is moved for them.  Samples move once at most:
when long tables, or chunks, are gathered into blocks.  Blocks read from files (``audio.stereo_blocks``) need not even that.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushline.functions.numeric import FLOAT_EPS, d
from hushline.schemas import ContractError

# Cells of the windows that a task transforms at a time, unless one block has more.
CELLS = 1 << 17

if TYPE_CHECKING:
    from hushline.operators.spectra import Stft


def regular_frames(n: np.ndarray, c: Stft) -> np.ndarray:
    """Frames that start at a multiple of the hop, for clips of ``n`` samples."""
    if not c.centred:
        return np.maximum(n - c.win, 0) // c.hop + 1
    length = (np.maximum(n, c.win) if c.padded else n) + 2 * (c.win // 2) - c.win
    return (-(-length // c.hop) if c.padded else length // c.hop) + 1


def frame_count(samples: Column, c: Stft) -> Column:
    """Number of frames of a clip, the one that ends at its last sample included."""
    n = samples.cast("bigint")
    if c.centred:
        length = (F.greatest(n, F.lit(c.win)) if c.padded else n) + F.lit(2 * (c.win // 2) - c.win)
        return (F.ceil(length / d(c.hop)) if c.padded else F.floor(length / d(c.hop))) + 1
    beyond = F.greatest(n - c.win, F.lit(0).cast("bigint"))
    return F.ceil(beyond / d(c.hop)) + 1


def frame_starts(frame: Column, samples: Column, c: Stft) -> Column:
    """First sample of a frame; negative where the frame begins in the zero extension."""
    if c.centred:
        return frame * c.hop - c.win // 2
    return F.least(frame * c.hop, F.greatest(samples.cast("bigint") - c.win, F.lit(0).cast("bigint")))


def extent(c: Stft, block: int) -> tuple[int, int]:
    """(samples before, samples from) the position ``block number * block * hop`` on that a block's frames can read.

    A frame moved back to end at the last sample starts less than one hop before its regular place.
    """
    lead = c.win // 2 if c.centred else c.hop
    reach = (block - 1) * c.hop + c.win - (c.win // 2 if c.centred else 0)
    return lead, reach


def _frame_ends(numbers: np.ndarray, n: np.ndarray, c: Stft, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frames in the block, frames of the clip, whether its last one is moved back) of block rows."""
    regular = regular_frames(n, c)
    extra = (not c.centred) & (n > c.win) & ((regular - 1) * c.hop != n - c.win)
    total = regular + extra
    return np.clip(total - numbers * block, 0, block), total, extra


def _frames_of(numbers: np.ndarray, n: np.ndarray, c: Stft, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frame numbers, first samples) of the frames of block rows, one row after the other, and the frames of each row's clip."""
    numbers, n = np.atleast_1d(numbers), np.atleast_1d(n)
    count, total, extra = _frame_ends(numbers, n, c, block)
    spread = lambda x: np.repeat(x, count)
    frames = np.arange(count.sum()) + spread(numbers * block - np.cumsum(count) + count)
    starts = frames * c.hop - (c.win // 2 if c.centred else 0)
    return frames, np.where(spread(extra), np.minimum(starts, spread(n) - c.win), starts), total


def _dealt(clips: DataFrame, step: int, lead: int, reach: int, channels: Sequence[str], final: Column | None = None) -> DataFrame:
    """Long samples or chunk rows grouped by (clip_no, block): ``at`` and channels, pieces nested one level.

    Block b takes the positions from ``b * step - lead`` to before ``b * step + reach``; pieces that cross a border are cut.  With
    ``final``, the last sample also opens the blocks up to that one.
    """
    whole = "start" in clips.columns
    first = F.col("start" if whole else "t").cast("bigint")
    last = first + F.size(channels[0]) - 1 if whole else first
    low = F.greatest(F.lit(0).cast("bigint"), F.floor((first - reach) / d(step)) + 1)
    high = F.floor((last + lead) / d(step))
    if final is not None:
        high = F.when(last == F.col("samples") - 1, final).otherwise(F.least(final, high))
        low = F.least(low, final)  # samples after the last frame's end
    blocks = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    rows = clips.select("clip_no", F.col("samples").cast("bigint").alias("samples"), first.alias("_at"), *channels, F.explode(blocks).alias("block"))
    if whole:
        start = F.greatest(F.col("_at"), F.col("block") * step - lead)
        end = F.least(F.col("_at") + F.size(channels[0]), F.col("block") * step + reach)
        size = F.greatest(end - start, F.lit(0).cast("bigint")).cast("int")
        cut = [F.slice(ch, F.when(size > 0, (start - F.col("_at")).cast("int") + 1).otherwise(1), size).alias(ch) for ch in channels]
        rows = rows.select("clip_no", "block", "samples", start.alias("_at"), *cut)
    packed = rows.groupBy("clip_no", "block").agg(
        F.max("samples").alias("samples"), F.collect_list(F.struct("_at", *channels)).alias("_s")
    )
    return packed.select(
        "clip_no", "block", "samples", F.col("_s._at").alias("at"), *[F.col(f"_s.{ch}").alias(ch) for ch in channels]
    )


def gather(clips: DataFrame, c: Stft, block: int, channels: Sequence[str]) -> DataFrame:
    """Block rows from long samples (clip_no, t, samples, channels) or from chunk rows; one shuffle.

    A sample goes to its own block and, near the border, to the neighbours that read it too.  The last sample also
    opens the blocks after it that hold only frames of zeros.
    """
    final = F.floor((frame_count(F.col("samples"), c) - 1) / d(block))
    return _dealt(clips, block * c.hop, *extent(c, block), channels, final)


def lists(matrix: np.ndarray) -> pa.ListArray:
    rows, width = matrix.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel()))


def _flat(positions: np.ndarray, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(position, value) of every sample; pieces are laid out from their starts."""
    if not isinstance(values, pa.ListArray):
        return positions, values.to_numpy(zero_copy_only=False)
    sizes = values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.cumsum(sizes) - sizes
    at = np.repeat(positions - before, sizes) + np.arange(sizes.sum())
    return at, values.flatten().to_numpy(zero_copy_only=False)


def _samples(at: pa.ListArray, values: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block row, position, value) of every sample of block rows."""
    owner = np.repeat(np.arange(len(at)), at.value_lengths().to_numpy())
    positions, held = at.flatten().to_numpy(), values.flatten()
    if isinstance(held, pa.ListArray):
        owner = np.repeat(owner, held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    return owner, *_flat(positions, held)


def _per_frame(blocks: DataFrame, c: Stft, block: int, channels: Sequence[str], outputs: Sequence[str], work) -> DataFrame:
    """One row per frame; ``work`` turns a channel's (frames, window) matrix into its output matrices.

    What lies outside the clip is zero.  A sample that is null or not finite fails the job, naming the clip.
    """
    key = blocks.schema["clip_no"].dataType
    fields = [T.StructField("clip_no", key), *[T.StructField(x, T.LongType()) for x in ("block", "frame", "samples", "frames", "width")]]
    schema = T.StructType(fields + [T.StructField(name, T.ArrayType(T.DoubleType())) for name in outputs])

    names = [f.name for f in schema]
    lead, _ = extent(c, block)
    at_of = {ch: f"{ch}_at" if f"{ch}_at" in blocks.columns else "at" for ch in channels}
    held = ["clip_no", "block", "samples", *dict.fromkeys(at_of.values()), *channels]

    def framed(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The frames of a few block rows, whose samples lie one block after the other on one line."""
        number, n = batch["block"].to_numpy(), batch["samples"].to_numpy()
        count = _frame_ends(number, n, c, block)[0]
        owner = np.repeat(np.arange(len(count)), count)
        frame, start, total = _frames_of(number, n, c, block)
        low = number * block * c.hop - lead
        size = lead + (count - 1) * c.hop + c.win
        begin = np.cumsum(size) - size
        matrices = []
        for ch in channels:
            row, place, amount = _samples(batch[at_of[ch]], batch[ch])
            bad = np.flatnonzero(~np.isfinite(amount))
            if len(bad):
                raise ContractError(f"Samples that are missing or not finite in {ch} of clip {batch['clip_no'][int(row[bad[0]])].as_py()}")
            place = place - low[row]
            real = (place >= 0) & (place < size[row])
            line = np.zeros(size.sum())
            line[begin[row[real]] + place[real]] = amount[real]
            matrices += work(np.lib.stride_tricks.sliding_window_view(line, c.win)[begin[owner] + start - low[owner]])
        width = np.clip(np.minimum(start + c.win, n[owner]) - np.maximum(start, 0), 0, None)
        numbers = (number[owner], frame, n[owner], total[owner], width)
        columns = [batch["clip_no"].take(pa.array(owner)), *[pa.array(x, pa.int64()) for x in numbers], *map(lists, matrices)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Short blocks share an output batch; none holds more than ``CELLS`` cells of windows, unless one block does.
        for batch in batches:
            if any(batch[name].null_count for name in held):
                raise ContractError("Blocks of samples need their clip, number, length, positions and channels")
            count = _frame_ends(batch["block"].to_numpy(), batch["samples"].to_numpy(), c, block)[0]
            batch = batch.take(pa.array(np.flatnonzero(count))) if not count.all() else batch
            ends = np.cumsum(count[count > 0]) * c.win
            at = 0
            while at < len(ends):
                until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, side="right")))
                yield framed(batch.slice(at, until - at))
                at = until

    return blocks.select(*held).mapInArrow(run, schema)


def frames(blocks: DataFrame, c: Stft, block: int, channels: Sequence[str]) -> DataFrame:
    """Windows of block rows, not yet weighted; ``width`` counts the samples of the clip in them."""
    return _per_frame(blocks, c, block, channels, list(channels), lambda m: [m])


def transform(blocks: DataFrame, c: Stft, block: int, channels: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Framing and transform of block rows in one step: ``<name>_re`` and ``<name>_im`` per frame and channel."""
    window, scale, n_fft = c.window(), c.scale(), c.n_fft

    def work(matrix: np.ndarray) -> list[np.ndarray]:
        spectrum = np.fft.rfft(matrix * window, n=n_fft, axis=1) * scale
        return [spectrum.real, spectrum.imag]

    outputs = [f"{name}_{part}" for name in names for part in ("re", "im")]
    return _per_frame(blocks, c, block, channels, outputs, work).drop("width")


def _pieces(packed: DataFrame, c: Stft, block: int, re: str, im: str, samples: str) -> DataFrame:
    """Overlap-add inside each block, cut where chunks begin: (clip_no, block of the chunk, samples, start, x, w).

    A block's own chunk gets one long piece; only what hangs over its borders goes to the chunks beside it.
    """
    window, scale, n_fft, step = c.window(), c.scale(), c.n_fft, block * c.hop
    kind = packed.schema["clip_no"].dataType.simpleString()
    schema = f"clip_no {kind}, block bigint, samples bigint, start bigint, x array<double>, w array<double>"
    rows = packed.select(
        "clip_no", "block", F.col(samples).cast("bigint").alias("samples"),
        frame_starts(F.col("frame"), F.col(samples), c).cast("bigint").alias("start"), F.col(re).alias("re"), F.col(im).alias("im"),
    )
    names = ["clip_no", "block", "samples", "start", "x", "w"]

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        count = table.num_rows
        part = lambda name: pc.list_flatten(table[name]).to_numpy().reshape(count, -1)
        waves = np.fft.irfft((part("re") + 1j * part("im")) / scale, n=n_fft, axis=1)[:, : c.win] * window
        starts, n = table["start"].to_numpy(), table["samples"][0].as_py()
        low, high = int(starts.min()), int(starts.max()) + c.win
        x, w = np.zeros(high - low), np.zeros(high - low)
        for wave, start in zip(waves, starts - low):  # at most one block of frames
            x[start : start + c.win] += wave
            w[start : start + c.win] += window * window
        first, last = max(low, 0), min(high, n)
        chunks = range(first // step, (last - 1) // step + 1) if last > first else range(0)
        cuts = [(k, max(first, k * step), min(last, (k + 1) * step)) for k in chunks]
        lines = lambda line: pa.array([line[a - low : b - low] for _, a, b in cuts], pa.list_(pa.float64()))
        columns = [
            pa.array([table["clip_no"][0].as_py()] * len(cuts), table["clip_no"].type), pa.array([k for k, _, _ in cuts], pa.int64()),
            pa.array([n] * len(cuts), pa.int64()), pa.array([a for _, a, _ in cuts], pa.int64()), lines(x), lines(w),
        ]
        return pa.Table.from_arrays(columns, names=names)

    return rows.groupBy("clip_no", "block").applyInArrow(run, schema)


def _merged(step: int):
    """Arrow UDF: a chunk's pieces, and the values to take where no window reaches, -> (value, support)."""
    schema = "struct<value: array<double>, support: array<double>>"

    def run(block: pa.Array, samples: pa.Array, start: pa.Array, x: pa.Array, w: pa.Array, at: pa.Array, other: pa.Array) -> pa.Array:
        values, supports = [], []
        for i, (number, n) in enumerate(zip(block.to_pylist(), samples.to_pylist())):
            low = number * step
            size = min(step, n - low)
            total, support, value = np.zeros(size), np.zeros(size), np.zeros(size)
            known = np.zeros(size, bool)
            starts = start[i].values
            if starts is not None:
                for j, begin in enumerate(starts.to_pylist()):
                    one, two = (part[i].values[j].values.to_numpy(zero_copy_only=False) for part in (x, w))
                    total[begin - low : begin - low + len(one)] += one
                    support[begin - low : begin - low + len(two)] += two
            if at[i].values is not None:
                places, amounts = _flat(at[i].values.to_numpy(zero_copy_only=False), other[i].values)
                value[places - low], known[places - low] = amounts, True
            reached = support > FLOAT_EPS
            value[reached] = total[reached] / support[reached]
            # Samples without window and without another value are null.
            values.append(pa.array(value, mask=~(known | reached)))
            supports.append(pa.array(support))
        lengths = np.cumsum([0, *map(len, values)]).astype(np.int32)
        joined = [pa.ListArray.from_arrays(pa.array(lengths), pa.concat_arrays(parts)) for parts in (values, supports)] if values else [
            pa.array([], pa.list_(pa.float64()))] * 2
        return pa.StructArray.from_arrays(joined, names=["value", "support"])

    return F.arrow_udf(run, schema)


def inverse(
    packed: DataFrame, c: Stft, block: int, re: str, im: str, samples: str = "samples", fallback: DataFrame | None = None, channel: str = "near"
) -> DataFrame:
    """Chunk rows (clip_no, block, samples, start, value, support) of the inverse transform.

    Overlapping windows are summed inside each block; the sums meet as arrays, one row per block and border, and are
    divided by the summed squared window.  Where no window reaches, the value is that of ``fallback`` (long samples or chunks)
    or null.  With a fallback, its clips decide which chunks there are.
    """
    step = block * c.hop
    pieces = _pieces(packed, c, block, re, im, samples).groupBy("clip_no", "block").agg(
        F.max("samples").alias("samples"), F.collect_list(F.struct("start", "x", "w")).alias("_p")
    )
    nothing = F.lit(None).cast("array<double>")
    if fallback is None:
        both = pieces.withColumn("_at", F.lit(None).cast("array<bigint>")).withColumn("_other", nothing)
    else:
        held = _dealt(fallback, step, 0, step, [channel])
        both = held.select("clip_no", "block", "samples", F.col("at").alias("_at"), F.col(channel).alias("_other")).join(
            pieces.drop("samples"), ["clip_no", "block"], "left"
        )
    merged = _merged(step)(F.col("block"), F.col("samples"), F.col("_p.start"), F.col("_p.x"), F.col("_p.w"), F.col("_at"), F.col("_other"))
    out = both.select("clip_no", "block", "samples", merged.alias("_m"))
    return out.select("clip_no", "block", "samples", (F.col("block") * step).alias("start"), "_m.value", "_m.support")


def samples_of(chunks: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Long samples (clip_no, t, samples, channels) of chunk rows."""
    rows = chunks.select("clip_no", "samples", "start", F.posexplode(F.arrays_zip(*channels)).alias("_k", "_z"))
    return rows.select("clip_no", (F.col("start") + F.col("_k")).alias("t"), "samples", *[F.col(f"_z.{ch}").alias(ch) for ch in channels])
