"""First-order recurrences s_n = a_n * s_(n-1) + b_n along frames, over matrices of frames x bins.

A step is an affine map of the state, and maps compose: (a2, b2) after (a1, b1) is (a2 * a1, a2 * b1 + b2).  A task
holds a few blocks as matrices and composes their maps for all bins at once, each block for itself.  Nothing is divided, so
every factor (zero, small, negative, above one) works at every length.  The composed map of a whole block is the only
thing the next blocks need: one row per block, with one array per state, is carried along each clip, and the blocks
of a long clip are computed in parallel.  Clips of a single block carry nothing and are transformed once.

Any number of recurrences run in the same scan, and only what they put out leaves the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

Matrices = dict[str, np.ndarray]
KEYS = ["clip_no", "block"]
# Cells of a matrix that a task holds at a time, unless one block has more.
CELLS = 1 << 16


@dataclass(frozen=True)
class Recurrence:
    """``step`` gives the factor and the input of each state from a block's matrices and its frame numbers;
    ``finish`` gives the output matrices from the block's matrices, the states after and the states before each frame."""

    states: tuple[str, ...]
    step: Callable[[Matrices, np.ndarray], tuple[np.ndarray, Matrices]]
    outputs: tuple[str, ...]
    finish: Callable[[Matrices, Matrices, Matrices], Matrices]


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def lists(values: np.ndarray) -> pa.ListArray:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).ravel()))


def composed(factor: np.ndarray, inputs: Matrices, place: np.ndarray | None = None) -> tuple[np.ndarray, Matrices]:
    """The map of each frame after all frames of its block before it, by doubling the reach of every frame's map.

    ``place`` counts the frames before each row in its block, where the rows hold several blocks.
    """
    product, local = np.array(factor, float), {n: np.array(v, float) for n, v in inputs.items()}
    place = np.arange(len(product)) if place is None else place
    step, longest = 1, int(place.max(initial=-1)) + 1
    while step < longest:
        late = np.flatnonzero(place >= step)
        for values in local.values():
            values[late] += product[late] * values[late - step]
        product[late] *= product[late - step]
        step *= 2
    return product, local


def in_blocks(packed: DataFrame) -> DataFrame:
    """The rows of each block together in the order of their frames; ``_place`` counts the frames before each."""
    order = Window.partitionBy(*KEYS).orderBy("frame")
    return packed.withColumn("_place", F.row_number().over(order).cast("bigint") - 1)


def whole_blocks(batches: Iterator[pa.RecordBatch], arrays: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, Matrices]]:
    """(rows, first row of each block, place of each row, matrices) of as many whole blocks as ``CELLS`` allows, one at least.

    The last block of a batch waits for the batch that may continue it.
    """

    def pieces(table: pa.Table, firsts: np.ndarray) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, Matrices]]:
        width = max(1, len(table.column(arrays[0])[0]))
        ends = np.append(firsts[1:], table.num_rows)
        at = 0
        while at < len(firsts):
            until = max(at + 1, int(np.searchsorted(ends, firsts[at] + CELLS // width, side="right")))
            part = table.slice(firsts[at], ends[until - 1] - firsts[at])
            yield part, firsts[at:until] - firsts[at], part.column("_place").to_numpy(), {c: matrix(part.column(c)) for c in arrays}
            at = until

    held: list[pa.RecordBatch] = []
    for batch in batches:
        firsts = np.flatnonzero(batch.column("_place").to_numpy() == 0)
        if not len(firsts):
            held.append(batch)
            continue
        table = pa.Table.from_batches([*held, batch.slice(0, firsts[-1])], batch.schema).combine_chunks()
        held = [batch.slice(firsts[-1])]
        if table.num_rows:
            yield from pieces(table, np.flatnonzero(table.column("_place").to_numpy() == 0))
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        if table.num_rows:
            yield from pieces(table, np.array([0]))


def block_maps(packed: DataFrame, parts: Sequence[Recurrence], arrays: Sequence[str], block: int) -> DataFrame:
    """The composed maps of every block that is followed by another one: clip_no, block, and one array per factor and state."""
    schema = T.StructType([packed.schema["clip_no"], T.StructField("block", T.LongType()), T.StructField("_maps", T.ArrayType(T.ArrayType(T.DoubleType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, firsts, place, values in whole_blocks(batches, arrays):
            lasts = np.append(firsts[1:], len(place)) - 1
            rows: list[np.ndarray] = []
            for part in parts:
                product, local = composed(*part.step(values, table.column("frame").to_numpy()), place)
                rows += [product[lasts], *[local[n][lasts] for n in part.states]]
            stacked = np.stack(rows, axis=1)
            outer = pa.array(np.arange(len(lasts) + 1, dtype=np.int32) * len(rows))
            maps = pa.ListArray.from_arrays(outer, lists(stacked.reshape(len(lasts) * len(rows), -1)))
            keys = table.select(KEYS).take(pa.array(lasts)).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([keys.column(0), keys.column(1).cast(pa.int64()), maps], names=schema.names)

    followed = packed.where((F.col("block") + 1) * block < F.col("frames"))
    return in_blocks(followed.select(*KEYS, "frame", *arrays)).mapInArrow(run, schema)


def carried(maps: DataFrame, parts: Sequence[Recurrence]) -> DataFrame:
    """The states that each block starts from: ``_start``, one array per state; a clip's blocks pass one after the other."""
    schema = T.StructType([*maps.select(*KEYS).schema.fields, T.StructField("_start", maps.schema["_maps"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clip, states = None, []
        for batch in batches:
            out = []
            for at, own in enumerate(batch.column("clip_no").to_pylist()):
                row = batch.column("_maps")[at].values
                values = row.flatten().to_numpy().reshape(len(row), -1)
                if own != clip:
                    clip, states = own, [np.zeros(values.shape[1])] * (len(values) - len(parts))
                fresh, k = [], 0
                for part in parts:
                    factor = values[k + len(fresh)]
                    k += 1
                    fresh += [factor * states[len(fresh) + i] + values[k + len(fresh) + i] for i in range(len(part.states))]
                states = fresh
                out.append([s.tolist() for s in states])
            following = pa.array(batch.column("block").to_numpy() + 1)
            yield pa.RecordBatch.from_arrays([batch.column("clip_no"), following, pa.array(out, pa.list_(pa.list_(pa.float64())))], schema.names)

    return maps.repartition("clip_no").sortWithinPartitions(*KEYS).mapInArrow(run, schema)


def scan(packed: DataFrame, parts: Sequence[Recurrence], arrays: Sequence[str], block: int) -> DataFrame:
    """Packed spectra (clip_no, block, frame, frames and ``arrays`` of bins) with an array column per output."""
    names = [n for part in parts for n in part.outputs]
    schema = T.StructType([*packed.schema.fields, *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in names]])
    starts = carried(block_maps(packed, parts, arrays, block), parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, firsts, place, values in whole_blocks(batches, arrays):
            # A block's first row carries the states it starts from; clips start from zero.
            owner = np.cumsum(place == 0) - 1
            given = table.column("_start").take(pa.array(firsts)).combine_chunks()
            known = np.flatnonzero(given.is_valid().to_numpy(zero_copy_only=False))
            width = values[arrays[0]].shape[1]
            first = np.zeros((len(firsts), sum(len(part.states) for part in parts), width))
            if len(known):
                first[known] = given.flatten().flatten().to_numpy().reshape(len(known), -1, width)
            at = 0
            made: Matrices = {}
            for part in parts:
                product, local = composed(*part.step(values, table.column("frame").to_numpy()), place)
                after, before = {}, {}
                for n in part.states:
                    after[n] = local[n] + product * first[owner, at]
                    before[n] = np.empty_like(after[n])
                    before[n][1:] = after[n][:-1]
                    before[n][firsts] = first[:, at]
                    at += 1
                made |= part.finish(values, after, before)
            for n in names:
                table = table.append_column(n, lists(made[n]))
            yield from table.select(schema.names).combine_chunks().to_batches()

    joined = in_blocks(packed.join(starts, KEYS, "left"))
    own = joined.withColumn("_start", F.when(F.col("_place") == 0, F.col("_start")))
    return own.select(*packed.columns, "_place", "_start").mapInArrow(run, schema)


def map_frames(packed: DataFrame, arrays: Sequence[str], outputs: Sequence[str], made: Callable[[Matrices], Matrices]) -> DataFrame:
    """Packed spectra with further arrays that depend on a frame's own arrays only; the rows stay where they are."""
    schema = T.StructType([T.StructField(n, T.ArrayType(T.DoubleType())) for n in outputs])

    def run(rows: pa.Array) -> pa.Array:
        out = made({c: matrix(rows.field(c)) for c in arrays})
        return pa.StructArray.from_arrays([lists(out[n]) for n in outputs], names=list(outputs))

    added = packed.withColumn("_made", F.arrow_udf(run, schema)(F.struct(*arrays)))
    return added.select(*packed.columns, *[F.col(f"_made.{n}").alias(n) for n in outputs])
