"""Hard negatives by threshold joins over an inverted index with suffix-norm bounds.

Vectors are whole numbers (``floor(scale * x)``), a score is an inner product.  Each anchor gets its positives (the best
rows of its own label), and for each positive the best rows of other labels whose score lies in a window between two
shares of the positive's score.

Threshold join.  A round asks for all rows that reach a threshold, which every anchor has for itself.  Anchors and rows
meet in pairs of blocks.  A task orders the dimensions by their weight in its rows and builds an inverted index: a row's
components enter the posting lists only as far as the norm of its remaining components could still reach the lowest
threshold of the task; what is left out could not reach it alone, so no row is missed.  Partial scores are accumulated
list by list; a pair is dropped as soon as its partial score and the remaining norms (Cauchy-Schwarz) fall short, and what
survives is completed by the components that were left out.  A task hands on no more than the wanted rows per window.

Rounds.  An anchor whose windows are full is done: every row above its threshold was seen.  The others go on with a lower
threshold, the last one lying below every score (positives) or at the floor of the windows (negatives).

Sizes.  Blocks have a bounded number of rows, whatever the labels' sizes; anchors are a stated set that meets all rows.
Copies of a vector are rows like any others and never multiply what a task hands on.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; a shorter vector
is filled up with zeros; rows that repeat an id are rows of their own (an anchor is never its own partner, its copies
may be), and ties go by id, then label, then vector; anchors without positives or negatives give no rows; a negative
positive score has an empty window; scores beyond 2**53 raise an error; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from hushline.session import stored

LEVELS = (0.9, 0.7, 0.5, 0.25)  # thresholds for positives, as shares of the highest score that norms allow
STEPS = (0.95, 0.8)  # thresholds for negatives, as shares of the lowest window's upper end


@dataclass(frozen=True)
class Rule:
    """How many positives and negatives are wanted, and the negatives' window in percent of the positive's score."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    scale: int = 256


@dataclass(frozen=True)
class Blocks:
    """Bounds on the rows and the anchors that meet in one task."""

    rows: int = 16_384
    anchors: int = 4_096


def vectors(rows: DataFrame, anchors: Column, scale: int) -> DataFrame:
    """The rows that take part: ``row`` (their order), vec_id, label, ``anchor`` and the whole-number vector ``v``."""
    bad = F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = rows.select(
        F.col("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("_v"), anchors.alias("anchor")
    ).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("_v").isNotNull()).where(~bad)
    whole = usable.select("vec_id", "label", F.coalesce("anchor", F.lit(False)).alias("anchor"), F.transform("_v", lambda x: F.floor(x * scale).cast("double")).alias("v"))
    order = ("vec_id", "label", "v")
    ranged = whole.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(ranged.withColumn("row", F.monotonically_increasing_id()), "vectors")


def measured(points: DataFrame) -> tuple[int, float]:
    """The longest vector's dimensions and the greatest norm."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    dims, most, norm = points.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs))), F.max(norm)).first()
    if dims and most * most * dims >= 2.0**53:
        raise ValueError("Scores of these vectors exceed 2**53")
    return int(dims or 0), float(norm or 0.0)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as a matrix, short rows filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), dims))
    out[np.arange(dims)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


class Index:
    """Rows in posting lists, each row only as far as its remaining norm can reach ``reach`` (a score for a unit anchor)."""

    STEP = 8  # dimensions of which the lists are read together

    def __init__(self, values: np.ndarray, reach: float):
        self.dims = np.argsort(-(values * values).sum(axis=0), kind="stable")
        ordered = values[:, self.dims]
        self.starts = range(0, ordered.shape[1], self.STEP)
        # Norm of what is left from each start on; rounded up, so that no bound is too small.
        left = np.cumsum((ordered * ordered)[:, ::-1], axis=1)[:, ::-1]
        self.norms = np.stack([np.sqrt(left[:, s]) for s in self.starts], axis=1) * (1 + 1e-12) if ordered.shape[1] else np.zeros((len(values), 0))
        depth = (self.norms >= reach).sum(axis=1) if reach > 0 else np.full(len(values), len(self.starts))
        self.order = np.argsort(-depth, kind="stable")  # rows with the longest lists first: a list is a leading part
        self.depth, self.values, self.norms = depth[self.order], ordered[self.order], self.norms[self.order]
        self.lists = [int(np.searchsorted(-self.depth, -k, side="right")) for k in range(1, len(self.starts) + 1)]
        indexed = np.arange(ordered.shape[1])[None, :] < (self.depth * self.STEP)[:, None]
        self.omitted = np.where(indexed, 0.0, self.values)

    def join(self, anchors: np.ndarray, thresholds: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (anchor, row, score) that reach the anchor's threshold; ``skip`` (anchors x rows) are no candidates."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        x = anchors[:, self.dims]
        left = np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1]
        norms = np.sqrt(left) * (1 + 1e-12)
        for a in range(0, len(x), 64):
            found.append(self._some(x[a : a + 64], norms[a : a + 64], thresholds[a : a + 64], skip[a : a + 64, self.order], a))
        return tuple(np.concatenate(v) for v in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))

    def _some(self, x, norms, thresholds, skip, base):
        n = self.lists[0] if self.lists else 0  # rows without a posting reach no threshold
        one = np.repeat(np.arange(len(x)), n)
        two = np.tile(np.arange(n), len(x))
        keep = ~skip[:, :n].ravel()
        one, two = one[keep], two[keep]
        score = np.zeros(len(one))
        for k, s in enumerate(self.starts):
            dims = slice(s, s + self.STEP)
            if k == 0:
                score = (x[:, dims] @ self.values[:n, dims].T).ravel()[keep]
            else:
                listed = two < self.lists[k]
                i, j = one[listed], two[listed]
                score[listed] += np.einsum("ij,ij->i", x[i, dims], self.values[j, dims])
            # A listed row's rest is all that follows; another's is what was left out of the lists, from its depth on.
            behind = np.minimum(k + 1, self.depth[two])
            end = behind == len(self.starts)
            at = np.where(end, 0, behind)
            rest = np.where(end, 0.0, norms[one, at * self.STEP] * self.norms[two, at])
            alive = score + rest * (1 + 1e-9) + 1e-6 >= thresholds[one]
            one, two, score = one[alive], two[alive], score[alive]
        short = self.depth[two] < len(self.starts)
        if short.any():
            score[short] += np.einsum("ij,ij->i", x[one[short]], self.omitted[two[short]])
        hit = score >= thresholds[one]
        return one[hit] + base, self.order[two[hit]], score[hit]


FOUND = T.StructType([T.StructField(n, T.LongType()) for n in ("anchor", "window", "row", "vec_id", "score")])


def _batch(parts: list[tuple]) -> pa.RecordBatch:
    columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(len(FOUND.names))]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], FOUND.names)


def _join(dims: int, same_label: bool, wanted: int, rule: Rule):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Anchors (row, label, v, threshold, windows) and rows (row, vec_id, label, v) of one pair of blocks."""
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([_batch([])])
        number = lambda table, c: table.column(c).to_numpy()
        x, y = matrix(left.column("v"), dims), matrix(right.column("v"), dims)
        thresholds = number(left, "threshold")
        norms = np.sqrt((x * x).sum(axis=1))
        reach = np.divide(thresholds, norms, out=np.full(len(x), -np.inf), where=norms > 0).min()
        anchor, row, vec_id = number(left, "row"), number(right, "row"), number(right, "vec_id")
        index = Index(y, float(reach) * (1 - 1e-9))
        windows = left.column("windows").to_pylist()
        labels_left, labels_right = (t.column("label").to_pylist() for t in (left, right))
        codes = {v: i for i, v in enumerate({*labels_left, *labels_right})}
        code = lambda values: np.array([codes[v] for v in values])
        a_code, r_code = code(labels_left), code(labels_right)
        out: list[tuple] = []
        for at in range(0, len(x), 256):
            part = slice(at, at + 256)
            same = a_code[part, None] == r_code[None, :]
            skip = (anchor[part, None] == row[None, :]) | (~same if same_label else same)
            one, two, score = index.join(x[part], thresholds[part], skip)
            order = np.lexsort((row[two], -score, one))
            one, two, score = one[order], two[order], score[order]
            edges = np.searchsorted(one, np.arange(len(skip) + 1))
            for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                for window, high, low in _limits(windows[at + i], rule):
                    first = a + int(np.searchsorted(-score[a:b], -high)) if high is not None else a
                    last = min(b, first + wanted)
                    while last > first and low is not None and score[last - 1] < low:
                        last -= 1
                    if last > first:
                        n = last - first
                        out.append((np.full(n, anchor[at + i]), np.full(n, window), row[two[first:last]], vec_id[two[first:last]], score[first:last]))
        return pa.Table.from_batches([_batch(out)])

    return run


def _limits(windows: list[dict] | None, rule: Rule) -> Iterator[tuple[int, float | None, float | None]]:
    """Each open window with the highest and the lowest score that it admits; without windows, everything."""
    if windows is None:
        yield 0, None, None
        return
    for w in windows:
        yield w["row"], w["score"] * rule.high // 100, -(-w["score"] * rule.low // 100)


def threshold_join(anchors: DataFrame, points: DataFrame, dims: int, same_label: bool, wanted: int, rule: Rule, blocks: Blocks) -> DataFrame:
    """The best ``wanted`` rows of each window among those that reach the anchors' thresholds."""
    if same_label:
        sizes = points.groupBy(F.col("label").alias("_g")).agg(F.ceil(F.count("*") / blocks.rows).cast("int").alias("_d"))
        asked = anchors.groupBy(F.col("label").alias("_g")).agg(F.ceil(F.count("*") / blocks.anchors).cast("int").alias("_q"))
        sizes = stored(sizes.join(asked, "_g"), "blocks")  # one row per label that has anchors
        anchors, points = (df.withColumn("_g", F.col("label")).join(sizes, "_g") for df in (anchors, points))
    else:
        counts = [F.lit(max(1, -(-df.count() // most))) for df, most in ((points, blocks.rows), (anchors, blocks.anchors))]
        anchors, points = (df.select("*", F.lit(0).alias("_g"), counts[0].alias("_d"), counts[1].alias("_q")) for df in (anchors, points))
    mine = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = anchors.withColumn("_a", mine("row", "_q")).withColumn("_b", every("_d"))
    right = points.withColumn("_b", mine("row", "_d")).withColumn("_a", every("_q"))
    left = left.select("_g", "_a", "_b", "row", "label", "v", "threshold", "windows")
    right = right.select("_g", "_a", "_b", "row", "vec_id", "label", "v")
    found = left.groupBy("_g", "_a", "_b").cogroup(right.groupBy("_g", "_a", "_b")).applyInArrow(_join(dims, same_label, wanted, rule), FOUND)
    place = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "row"))
    return stored(found.withColumn("rank", place).where(F.col("rank") <= wanted), "found")


def positives(points: DataFrame, dims: int, most: float, rule: Rule, blocks: Blocks) -> DataFrame:
    """``anchor``, ``row``, vec_id and score of the best rows of each anchor's label."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    open_ = stored(points.where("anchor").select("row", "label", "v", norm.alias("norm"), F.lit(None).cast("array<struct<row:long,score:long>>").alias("windows")), "anchors")
    done: DataFrame | None = None
    for level in (*LEVELS, None):
        threshold = F.col("norm") * (level * most) if level is not None else F.lit(float("-inf"))
        found = threshold_join(open_.withColumn("threshold", threshold), points, dims, True, rule.positives, rule, blocks)
        if level is not None:
            full = found.where(F.col("rank") == rule.positives).select(F.col("anchor").alias("row"))
            open_ = stored(open_.join(full, "row", "left_anti"), "anchors")
            found = found.join(full.withColumnRenamed("row", "anchor"), "anchor", "left_semi").select(*found.columns)
        done = found if done is None else done.unionByName(found)
        if level is not None and open_.isEmpty():
            break
    return stored(done.select("anchor", "row", "vec_id", "score"), "positives")


def negatives(points: DataFrame, pairs: DataFrame, dims: int, rule: Rule, blocks: Blocks) -> DataFrame:
    """``anchor``, ``window`` (the positive's row), rank, vec_id and score of the negatives of each pair."""
    windows = F.sort_array(F.collect_list(F.struct("row", "score"))).alias("windows")  # at most ``positives`` of them
    open_ = pairs.where("score >= 0").groupBy("anchor").agg(windows)
    open_ = stored(open_.join(points.select(F.col("row").alias("anchor"), "label", "v"), "anchor").withColumnRenamed("anchor", "row"), "anchors")
    least = F.array_min(F.transform("windows", lambda w: w["score"]))
    done: DataFrame | None = None
    for step in (*STEPS, None):
        floor = F.ceil(least * rule.low / 100) - 1
        threshold = floor if step is None else F.greatest(floor, least * (rule.high * step / 100))
        found = threshold_join(open_.withColumn("threshold", threshold.cast("double")), points, dims, False, rule.negatives, rule, blocks)
        if step is not None:
            full = stored(found.where(F.col("rank") == rule.negatives).select("anchor", "window"), "full")
            found = found.join(full, ["anchor", "window"], "left_semi").select(*found.columns)
            filled = full.groupBy(F.col("anchor").alias("_a")).agg(F.collect_list("window").alias("_full"))
            rest = F.filter("windows", lambda w: ~F.array_contains(F.coalesce("_full", F.array().cast("array<long>")), w["row"]))
            open_ = open_.join(filled, F.col("row") == F.col("_a"), "left").withColumn("windows", rest).drop("_a", "_full")
            open_ = stored(open_.where(F.size("windows") > 0), "anchors")
        done = found if done is None else done.unionByName(found)
        if step is not None and open_.isEmpty():
            break
    return done


def mine(rows: DataFrame, anchors: Column, rule: Rule = Rule(), blocks: Blocks = Blocks()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of the hard negatives of ``rows``
    (vec_id, label, embedding); ``anchors`` is the condition that tells the anchors."""
    points = vectors(rows, anchors, rule.scale)
    dims, most = measured(points)
    pairs = positives(points, dims, most, rule, blocks)
    found = negatives(points, pairs, dims, rule, blocks)
    named = points.where("anchor").select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    told = pairs.select("anchor", F.col("row").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(told, ["anchor", "window"]).join(named, "anchor").select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
