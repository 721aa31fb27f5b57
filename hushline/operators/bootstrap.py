"""Paired stratified bootstrap of AUC and pAUC deltas, reproducible in any engine.

A row carries an array: how often each resample draws it.  Every position of a stratum makes one draw per resample (the
first 32 bits of the md5 of a counter text).  The draws need no row, only the stratum's name and size.

Groups of up to ``GROUP_ROWS`` rows.  A task takes some resamples of one group, and the group's scores as arrays: it draws
one resample after the other and counts the draws by steps of the curve.  Only the scores travel, ``COPIES`` times at
most; nothing as long as rows x resamples is shuffled or stored.

Larger groups.  Tasks take some
resamples of some positions, count how often each position is drawn, and hand on these counts, deflated, by blocks of
``TARGETS`` drawn positions.  There they meet the rows and become one deflated array per row.
Rows are dealt by side, group and value range and pass in the order of their scores; counts, running sums and
the segments of all curves are operations on arrays with one place per resample.  Between the ranges only their totals
travel.  Nothing grows with rows x resamples but the counts, at about two bits each.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushline.operators.ordered import hashed_positions, with_range_bucket
from hushline.operators.roc import MAX_FPR, standardised
from hushline.schemas import GROUP
from hushline.session import stored

STRATUM = [*GROUP, "condition"]
TARGETS = 1024
ROWS = 256  # rows whose arrays are worked on together
DRAWS = 16_000_000  # of one unit of work
POSITIONS = 4 << 20  # that one unit draws for, and whose counts it holds at a time
FEW = 512  # positions that are hashed one by one
SEGMENT = ["side", *GROUP, "bucket"]
SIDES = ["reference", "candidate"]
GROUP_ROWS = 6 << 20  # of a group that is resampled inside tasks, at some 50 bytes a row
COPIES = 8  # of a group's scores, for as many tasks
UNIT = DRAWS // 4  # draws of one task's turn, unless that takes more copies
HEADS = 1 << 20  # draws that are counted together


def _fields(names: list[str]) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


def deflated(data: bytes) -> bytes:
    """Entropy-coded alone: counts of draws have few values and no repeats."""
    coder = zlib.compressobj(1, zlib.DEFLATED, -15, 8, zlib.Z_HUFFMAN_ONLY)
    return coder.compress(data) + coder.flush()


def inflated(data: bytes) -> bytes:
    return zlib.decompress(data, -15)


_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4


def _md5_heads(prefix: bytes, first: int, stop: int, digits: int) -> np.ndarray:
    """The first 32 bits of md5(prefix + number) for numbers of as many digits; the text fits md5's one block."""
    size = len(prefix) + digits
    block = bytearray(64)
    block[: len(prefix)], block[size], block[56:] = prefix, 0x80, (8 * size).to_bytes(8, "little")
    words = list(np.frombuffer(bytes(block), "<u4"))
    rest = np.arange(first, stop, dtype=np.uint64)
    for at in range(size - 1, len(prefix) - 1, -1):
        rest, digit = np.divmod(rest, np.uint64(10))
        words[at // 4] = words[at // 4] + ((digit.astype(np.uint32) + np.uint32(48)) << np.uint32(8 * (at % 4)))
    a, b, c, d = (np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    with np.errstate(over="ignore"):
        for i in range(61):  # the last three rounds do not reach these bits
            if i < 16:
                f, g = d ^ (b & (c ^ d)), i
            elif i < 32:
                f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
            elif i < 48:
                f, g = b ^ c ^ d, (3 * i + 5) % 16
            else:
                f, g = c ^ (b | ~d), (7 * i) % 16
            f = f + a + (words[g] + np.uint32(_SINES[i]))
            a, d, c, b = d, c, b, b + ((f << np.uint32(_TURNS[i])) | (f >> np.uint32(32 - _TURNS[i])))
        return (b + np.uint32(0x67452301)).byteswap()


def md5_heads(prefix: bytes, first: int, stop: int) -> np.ndarray:
    """The first 32 bits of md5(prefix + number) for each number from ``first`` to before ``stop``."""
    if stop - first < FEW or len(prefix) + len(str(stop)) > 55:
        digests = b"".join([hashlib.md5(prefix + str(n).encode()).digest() for n in range(first, stop)])
        return np.frombuffer(digests, ">u4")[::4].astype(np.uint32)
    parts = []
    while first < stop:
        digits = len(str(first))
        end = min(stop, 10**digits, first + 16_384)
        parts.append(_md5_heads(prefix, first, end, digits))
        first = end
    return np.concatenate(parts)


DRAWN = T.StructType(
    [*_fields(STRATUM), T.StructField("target", T.LongType()), T.StructField("resample", T.IntegerType()), T.StructField("resamples", T.IntegerType()), T.StructField("counts", T.BinaryType())]
)


def _checked(counts: np.ndarray) -> np.ndarray:
    if counts.max(initial=0) > 255:
        raise ValueError("A row was drawn more than 255 times in one resample")
    return counts.astype(np.uint8)


def _draws(seed: int, targets: int, wide: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in batch.to_pylist():
                stratum, n = [unit[c] for c in STRATUM], unit["pos_count"]
                name = "|".join(v for v in stratum if v is not None)
                drawn = []
                for at in range(unit["resample"] + 1, unit["resample"] + unit["resamples"] + 1):
                    heads = md5_heads(f"{seed}|{at}|{name}|".encode(), unit["first"], unit["stop"])
                    drawn.append(heads % n if n < 1 << 32 else heads)
                for low in range(0, n, wide):
                    size = min(wide, n - low)
                    mine = drawn if size == n else [d[(d >= low) & (d < low + size)] - low for d in drawn]
                    counts = np.stack([_checked(np.bincount(d, minlength=size)) for d in mine])
                    blocks = range(0, size, targets)
                    found = [deflated(np.ascontiguousarray(counts[:, at : at + targets]).tobytes()) for at in blocks]
                    alike = lambda v, kind: pa.array([v] * len(found), kind)
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[alike(v, pa.string()) for v in stratum], pa.array([(low + at) // targets for at in blocks], pa.int64()),
                            alike(unit["resample"], pa.int32()), alike(unit["resamples"], pa.int32()), pa.array(found, pa.binary()),
                        ],
                        DRAWN.names,
                    )

    return run


def _weighted(iterations: int, targets: int, schema: T.StructType, packed: bool):
    def run(drawn: pa.Table, rows: pa.Table) -> pa.Table:
        """The rows of one block with how often each resample draws them; rows that none draws are left out."""
        counts = None
        for at, size, data in zip(*(drawn.column(c).to_pylist() for c in ("resample", "resamples", "counts"))):
            part = np.frombuffer(inflated(data), np.uint8).reshape(size, -1)
            counts = np.zeros((iterations, part.shape[1]), np.int32) if counts is None else counts
            counts[at : at + size] += part
        if counts is None:
            counts = np.zeros((iterations, targets), np.int32)
        mine = _checked(counts).T[rows.column("pos").to_numpy() % targets]
        some = mine.any(axis=1)
        arrays = [v.tobytes() for v in mine[some]]
        column = pa.array([deflated(v) for v in arrays] if packed else arrays, pa.binary())
        return rows.filter(pa.array(some)).select(schema.names[:-1]).append_column("weights", column)

    return run


def weighted(rows: DataFrame, iterations: int, seed: int, targets: int = TARGETS, packed: bool = True, positions: int = POSITIONS) -> DataFrame:
    """``rows`` with ``weights``: one byte per resample, deflated if ``packed``.  They have the stratum, pos and pos_count."""
    if not 1 <= iterations <= 1 << 16 or targets > 1 << 16:
        raise ValueError("Between 1 and 65536 resamples are possible")
    rows = rows.withColumns({c: F.col(c).cast("string") for c in STRATUM})
    # A unit of work is some resamples of some positions of one stratum: a hot stratum becomes more of them.
    sizes = rows.groupBy(*STRATUM).agg(F.max("pos_count").alias("pos_count"))
    parts = sizes.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pos_count") - 1, F.lit(positions).cast("long"))))
    parts = parts.withColumn("stop", F.least(F.col("first") + positions, "pos_count"))
    step = F.greatest(F.lit(1), F.least(F.lit(iterations), F.floor(F.lit(DRAWS) / (F.col("stop") - F.col("first"))))).cast("int")
    units = parts.withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1), step)))
    units = stored(units.withColumn("resamples", F.least(step, F.lit(iterations) - F.col("resample"))), "units")
    tasks = units.agg(F.coalesce(F.sum(F.col("resamples") * (F.col("stop") - F.col("first"))), F.lit(0)).alias("n")).first()["n"] // DRAWS
    dealt = units.repartition(max(1, 2 * tasks), *STRATUM, "first", "resample")
    drawn = dealt.mapInArrow(_draws(seed, targets, max(1, positions // targets) * targets), DRAWN)
    schema = T.StructType([*rows.drop("pos_count").schema.fields, T.StructField("weights", T.BinaryType())])
    blocks = rows.withColumn("target", F.floor(F.col("pos") / targets).cast("long"))
    both = drawn.groupBy(*STRATUM, "target").cogroup(blocks.groupBy(*STRATUM, "target"))
    return both.applyInArrow(_weighted(iterations, targets, schema, packed), schema)


def weights(rows: DataFrame, iterations: int, seed: int, targets: int = TARGETS) -> DataFrame:
    """``weights`` of each drawn position: one byte per resample.  ``rows`` has the stratum, pos and pos_count."""
    return weighted(rows.select(*STRATUM, "pos", "pos_count"), iterations, seed, targets, packed=False)


def _segments(batches: Iterator[pa.RecordBatch], names: list[str], size: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of at most ``size`` rows of one segment each, in the order of arrival."""
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in SEGMENT)))
        at = 0
        while at < len(keys):
            stop = at + 1
            while stop < len(keys) and stop - at < size and keys[stop] == keys[at]:
                stop += 1
            yield keys[at], batch.select(names).slice(at, stop - at)
            at = stop


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join([inflated(v) for v in column.to_pylist()]), np.uint8).reshape(len(column), -1).astype(np.int64)


TOTALS = T.StructType([*_fields(["side", *GROUP]), T.StructField("bucket", T.IntegerType()), T.StructField("sums", T.BinaryType())])


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {T.StringType(): pa.string(), T.IntegerType(): pa.int32(), T.BinaryType(): pa.binary()}
    columns = list(zip(*rows)) if rows else [[] for _ in schema.names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[f.dataType]) for c, f in zip(columns, schema.fields)], schema.names)


def _totals(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anomalies and normals of each segment per resample."""
        at, sums = None, None
        for key, part in _segments(batches, ["anomaly", "weights"], size):
            if key != at:
                if at is not None:
                    yield _batch([(*at, sums.tobytes())], TOTALS)
                at, sums = key, None
            values, anomaly = _matrix(part.column("weights")), part.column("anomaly").to_numpy(zero_copy_only=False)
            fresh = np.stack([values[anomaly].sum(axis=0), values[~anomaly].sum(axis=0)])
            sums = fresh if sums is None else sums + fresh
        if at is not None:
            yield _batch([(*at, sums.tobytes())], TOTALS)

    return run


def _offsets(iterations: int):
    def run(table: pa.Table) -> pa.Table:
        """What lies above each value range of one side and group, and the whole; at most one row per range."""
        table = table.sort_by([("bucket", "descending")])
        sums = np.frombuffer(b"".join(table.column("sums").to_pylist()), np.int64).reshape(-1, 2, iterations)
        above = np.cumsum(sums, axis=0) - sums
        whole = sums.sum(axis=0)
        heads = pa.array([np.concatenate([a, whole]).tobytes() for a in above], pa.binary())
        return table.set_column(table.schema.get_field_index("sums"), "sums", heads)

    return run


AREAS = T.StructType([*_fields(["side", *GROUP]), T.StructField("parts", T.BinaryType())])


class Curve:
    """The curves of all resamples within one segment: areas of whole steps, from the counts above the segment on."""

    def __init__(self, head: bytes, iterations: int, max_fpr: float):
        self.pos, self.neg, self.all_pos, self.all_neg = np.frombuffer(head, np.int64).reshape(4, iterations).astype(float)
        self.areas = np.zeros((2, iterations))
        self.max_fpr = max_fpr
        self.score, self.step = None, None  # the step that may go on

    def add(self, score: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> None:
        """Rows in descending order of score."""
        first = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]]))
        steps = np.stack([np.add.reduceat(pos, first, axis=0), np.add.reduceat(neg, first, axis=0)], axis=1).astype(float)
        if self.score is not None and self.score == score[0]:
            steps[0] += self.step
        elif self.score is not None:
            steps = np.concatenate([self.step[None], steps])
        self._close(steps[:-1])
        self.score, self.step = score[-1], steps[-1]

    def done(self) -> np.ndarray:
        if self.step is not None:
            self._close(self.step[None])
        return self.areas

    def _close(self, steps: np.ndarray) -> None:
        if not len(steps):
            return
        with np.errstate(divide="ignore", invalid="ignore"):
            pos, neg = self.pos + np.cumsum(steps[:, 0], axis=0), self.neg + np.cumsum(steps[:, 1], axis=0)
            y, x = pos / self.all_pos, neg / self.all_neg
            y0, x0 = (pos - steps[:, 0]) / self.all_pos, (neg - steps[:, 1]) / self.all_neg
            self.areas[0] += ((x - x0) * (y0 + y) / 2.0).sum(axis=0)
            limit = self.max_fpr
            low, high = np.minimum(x0, limit), np.minimum(x, limit)
            crossing = (x > limit) & (x0 <= limit)
            top = np.where(crossing, y0 + (y - y0) / (x - x0) * (limit - x0), y)
            self.areas[1] += np.where(high > low, (high - low) * (y0 + top) / 2.0, np.where(np.isnan(x + y), np.nan, 0.0)).sum(axis=0)
        self.pos, self.neg = pos[-1], neg[-1]


def _areas(iterations: int, max_fpr: float, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A segment's first row holds what lies above it; its rows follow in descending order of score."""
        at, curve = None, None
        for key, part in _segments(batches, ["head", "score", "anomaly", "weights"], size):
            if key != at:
                if curve is not None:
                    yield _batch([(*at[:-1], curve.done().tobytes())], AREAS)
                at, curve = key, Curve(part.column("weights")[0].as_py(), iterations, max_fpr)
                part = part.slice(1)
            if part.num_rows:
                values, anomaly = _matrix(part.column("weights")), part.column("anomaly").to_numpy(zero_copy_only=False)[:, None]
                curve.add(part.column("score").to_numpy(zero_copy_only=False), values * anomaly, values * ~anomaly)
        if curve is not None:
            yield _batch([(*at[:-1], curve.done().tobytes())], AREAS)

    return run


RESULT = T.StructType(
    [T.StructField("iteration", T.IntegerType()), *_fields(["side", *GROUP]), T.StructField("auc", T.DoubleType()), T.StructField("pauc", T.DoubleType())]
)


def _added(iterations: int):
    def run(table: pa.Table) -> pa.Table:
        """The areas of one side and group, from at most one row per value range."""
        parts = np.frombuffer(b"".join(table.column("parts").to_pylist()), float).reshape(-1, 2, iterations).sum(axis=0)
        names = [pa.array([table.column(c)[0].as_py()] * iterations, pa.string()) for c in ("side", *GROUP)]
        areas = [pa.array(p, pa.float64(), mask=np.isnan(p)) for p in parts]
        return pa.table([pa.array(np.arange(1, iterations + 1, dtype=np.int32)), *names, *areas], names=RESULT.names)

    return run


PIECE = T.StructType([*_fields(STRATUM), T.StructField("n", T.LongType()), T.StructField("pos", T.BinaryType()), *[T.StructField(s, T.BinaryType()) for s in SIDES]])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per stratum of a batch: places (as differences, which mostly are 1) and scores as arrays."""
    for batch in batches:
        batch = batch.sort_by([(c, "ascending") for c in STRATUM]) if batch.num_rows else batch
        keys = list(zip(*(batch.column(c).to_pylist() for c in STRATUM)))
        starts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
        pos, *scores = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("pos", *SIDES)]
        rows = [
            (*keys[a], b - a, np.diff(pos[a:b], prepend=0).astype(np.int32).tobytes(), *[v[a:b].astype(float).tobytes() for v in scores])
            for a, b in zip(starts, [*starts[1:], len(keys)])
        ]
        yield pa.RecordBatch.from_pylist([dict(zip(PIECE.names, r)) for r in rows], _PIECES)


_PIECES = pa.schema([*[(c, pa.string()) for c in STRATUM], ("n", pa.int64()), *[(c, pa.binary()) for c in ("pos", *SIDES)]])


def step_areas(pos: np.ndarray, neg: np.ndarray, max_fpr: float) -> tuple[float, float]:
    """AUC and the area up to ``max_fpr`` from the counts of each step, in descending order of score."""
    all_pos, all_neg = int(pos.sum()), int(neg.sum())
    if not all_pos or not all_neg:
        return math.nan, math.nan
    above = np.cumsum(pos, dtype=np.int64) - pos
    strips = neg * (2 * above + pos)  # twice the area, in draws
    x = np.cumsum(neg, dtype=np.int64)
    at = int(np.searchsorted(x / all_neg > max_fpr, True))  # the step that crosses the limit
    part = int(strips[:at].sum()) / (2 * all_pos * all_neg)
    if at < len(x):
        x0, x1, y0, y1 = (x[at] - neg[at]) / all_neg, x[at] / all_neg, above[at] / all_pos, (above[at] + pos[at]) / all_pos
        if max_fpr > x0:
            top = y0 + (y1 - y0) / (x1 - x0) * (max_fpr - x0)
            part += (max_fpr - x0) * (y0 + top) / 2.0
    return int(strips.sum()) / (2 * all_pos * all_neg), part


def _descending_ranks(score: np.ndarray) -> tuple[np.ndarray, int]:
    """The step of each score, equal scores sharing one, and the number of steps.  NaN is the greatest score, as in Spark."""
    order = np.argsort(score)[::-1]
    score = score[order]
    new = (score[1:] != score[:-1]) & ~(np.isnan(score[1:]) & np.isnan(score[:-1]))
    rank = np.empty(len(score), np.int32)
    rank[order] = np.concatenate([[0], np.cumsum(new)])
    return rank, int(rank[order[-1]]) + 1


def _unit_areas(strata: dict[tuple, list[dict]], first: int, stop: int, seed: int, max_fpr: float, heads: int) -> dict[str, np.ndarray]:
    """Areas of the resamples ``first`` + 1 to ``stop`` of one group, per side."""
    names = sorted(strata)
    sizes = [sum(p["n"] for p in strata[name]) for name in names]
    starts = np.cumsum([0, *sizes])
    scores = {side: np.empty(starts[-1]) for side in SIDES}
    for name, start in zip(names, starts):
        for piece in strata.pop(name):
            place = start + np.cumsum(np.frombuffer(piece["pos"], np.int32))
            for side in SIDES:
                scores[side][place] = np.frombuffer(piece[side], float)
    steps, number = {}, {}
    for side in SIDES:
        rank, number[side] = _descending_ranks(scores.pop(side))
        steps[side] = np.split(rank, starts[1:-1])
    areas = {side: np.empty((2, stop - first)) for side in SIDES}
    for at in range(first, stop):
        counts = {side: np.zeros((2, number[side]), np.int32) for side in SIDES}
        for k, (name, n) in enumerate(zip(names, sizes)):
            prefix = f"{seed}|{at + 1}|{'|'.join(name)}|".encode()
            for low in range(0, n, heads):
                place = md5_heads(prefix, low, min(low + heads, n)) % n
                for side in SIDES:
                    counts[side][int(name[-1] != "anomaly")] += np.bincount(steps[side][k][place], minlength=number[side]).astype(np.int32)
        for side in SIDES:
            areas[side][:, at - first] = step_areas(*counts[side], max_fpr)
    return areas


def _resampled(seed: int, max_fpr: float, heads: int = HEADS):
    """Task body: pieces sorted by group and first resample; areas of these resamples."""

    def areas_of(key: tuple, strata: dict, stop: int) -> Iterator[pa.RecordBatch]:
        *group, first = key
        for side, parts in _unit_areas(strata, first, stop, seed, max_fpr, heads).items():
            names = [pa.array([c] * (stop - first), pa.string()) for c in (side, *group)]
            values = [pa.array(p, pa.float64(), mask=np.isnan(p)) for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(first + 1, stop + 1, dtype=np.int32)), *names, *values], names=RESULT.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, strata, stop = None, {}, 0
        for batch in batches:
            for piece in batch.to_pylist():
                key = (*[piece[c] for c in GROUP], piece["resample"])
                if key != at:
                    if at is not None:
                        yield from areas_of(at, strata, stop)
                    at, strata = key, {}
                stop = piece["stop"]
                strata.setdefault(tuple(piece[c] for c in STRATUM), []).append({c: piece[c] for c in ("n", "pos", *SIDES)})
        if at is not None:
            yield from areas_of(at, strata, stop)

    return run


def _areas_in_tasks(rows: DataFrame, sizes: DataFrame, iterations: int, seed: int, max_fpr: float) -> DataFrame:
    """Areas of groups that fit a task; ``sizes`` has their rows."""
    least = -(-iterations // COPIES)
    step = F.least(F.lit(iterations), F.greatest(F.lit(least), F.floor(F.lit(UNIT) / F.col("rows")))).cast("int")
    units = sizes.withColumn("step", step).withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1), F.col("step"))))
    units = units.withColumn("stop", F.least(F.col("resample") + F.col("step"), F.lit(iterations))).drop("step")
    work = units.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("rows") * (F.col("stop") - F.col("resample"))), F.lit(0)).alias("draws")).first()
    tasks = max(1, min(2 * work["n"], 2 * (work["draws"] // DRAWS)))
    pieces = rows.mapInArrow(_pieces, PIECE).join(units.drop("rows"), GROUP)
    dealt = pieces.repartition(tasks, *GROUP, "resample").sortWithinPartitions(*GROUP, "resample")
    return dealt.mapInArrow(_resampled(seed, max_fpr), RESULT)


def resampled_areas(
    paired: DataFrame, iterations: int, seed: int, max_fpr: float = MAX_FPR, targets: int = TARGETS, size: int = ROWS, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """AUC and pAUC per iteration, side and group of the resampled rows."""
    if not 1 <= iterations <= 1 << 16:
        raise ValueError("Between 1 and 65536 resamples are possible")
    paired = paired.withColumns({c: F.col(c).cast("string") for c in STRATUM})
    scores = [F.col(f"anomaly_score_{s}").cast("double").alias(s) for s in SIDES]
    placed = hashed_positions(paired.select("file_id", *STRATUM, *scores), STRATUM, F.col("file_id"))
    rows = stored(placed.select(*STRATUM, "pos", "pos_count", *SIDES), "bootstrap")
    sizes = stored(rows.groupBy(*GROUP).agg(F.count("*").alias("rows")), "sizes")
    large = sizes.where(F.col("rows") > group_rows).select(*GROUP)
    areas = _areas_in_tasks(rows, sizes.where(F.col("rows") <= group_rows), iterations, seed, max_fpr)
    if large.limit(1).count():
        more = _areas_in_ranges(rows.join(large, GROUP, "left_semi"), iterations, seed, max_fpr, targets, size)
        areas = areas.unionByName(more)
    return areas.withColumn("pauc", standardised(F.col("pauc"), max_fpr))


def _areas_in_ranges(placed: DataFrame, iterations: int, seed: int, max_fpr: float, targets: int, size: int) -> DataFrame:
    """Areas of groups of every size, cut into value ranges."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("score")) for s in SIDES])
    # The order of the scores is the same in every iteration: the value ranges are found once.
    rows = with_range_bucket(placed.select(*STRATUM, "pos", "pos_count", F.inline(sides)), "score")
    rows = rows.groupBy(*STRATUM, "pos", "pos_count").agg(F.collect_list(F.struct("side", "score", "bucket")).alias("sides"))
    # One row per input row, also with its weights: both sides read the same array.
    rows = stored(rows, "bootstrap")
    drawn = weighted(rows, iterations, seed, targets)
    drawn = stored(drawn.select(*GROUP, (F.col("condition") == "anomaly").alias("anomaly"), "weights", "sides"), "weights")
    curves = drawn.select(*GROUP, "anomaly", "weights", F.inline("sides"))
    curves = curves.select(*SEGMENT, F.lit(1).alias("head"), F.col("score").cast("double").alias("score"), "anomaly", "weights")
    totals = curves.repartition(*SEGMENT).sortWithinPartitions(*SEGMENT).select(*SEGMENT, "anomaly", "weights").mapInArrow(_totals(size), TOTALS)
    heads = totals.groupBy("side", *GROUP).applyInArrow(_offsets(iterations), TOTALS)
    heads = heads.select(*SEGMENT, F.lit(0).alias("head"), F.lit(None).cast("double").alias("score"), F.lit(False).alias("anomaly"), F.col("sums").alias("weights"))
    both = heads.unionByName(curves).repartition(*SEGMENT).sortWithinPartitions(*SEGMENT, "head", F.col("score").desc())
    parts = both.mapInArrow(_areas(iterations, max_fpr, size), AREAS)
    return parts.groupBy("side", *GROUP).applyInArrow(_added(iterations), RESULT)


def iteration_deltas(areas: DataFrame) -> DataFrame:
    """Macro mean over groups per iteration, candidate minus reference."""
    macro = areas.groupBy("iteration", "side").agg(F.avg("auc").alias("auc"), F.avg("pauc").alias("pauc"))
    side = lambda m, s: F.max(F.when(F.col("side") == s, F.col(m)))
    return macro.groupBy("iteration").agg(
        (side("auc", "candidate") - side("auc", "reference")).alias("auc_delta"),
        (side("pauc", "candidate") - side("pauc", "reference")).alias("pauc_delta"),
    )


def interval(deltas: DataFrame) -> DataFrame:
    """Mean and 95 % interval per metric; the percentile buffers hold one value per iteration."""
    long = deltas.unpivot(["iteration"], ["auc_delta", "pauc_delta"], "metric", "delta")
    return long.groupBy("metric").agg(
        F.count("*").alias("iterations"),
        F.avg("delta").alias("mean"),
        F.percentile("delta", F.lit(0.025)).alias("ci95_low"),
        F.percentile("delta", F.lit(0.975)).alias("ci95_high"),
    )


def paired_bootstrap(paired: DataFrame, iterations: int = 2000, seed: int = 2026) -> DataFrame:
    if iterations < 100:
        raise ValueError(f"{iterations} resamples are too few for an interval; take 100 or more")
    return interval(iteration_deltas(resampled_areas(paired, iterations, seed)))
