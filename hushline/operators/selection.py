"""Projections, samples, crops and unions over feature and score tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hushline.functions import paths
from hushline.functions.numeric import d

# The eight base maps, the three registered channel sets, the three report bands (Hz).
BASE_CHANNELS = (
    "near", "far", "residual", "coherence", "log_ratio", "phase_sin", "phase_cos", "path_confidence"
)
ABLATIONS = {
    "a00_near": ("near",),
    "a01_near_far": ("near", "far"),
    "a02_multiview": BASE_CHANNELS,
}
BANDS = (("0-1000Hz", 0.0, 1000.0), ("1000-4000Hz", 1000.0, 4000.0), ("4000-8000Hz", 4000.0, 8000.0))


def ablation_channels(maps: DataFrame, ablation: str, keys: Sequence[str]) -> DataFrame:
    """Only the keys and the channels of one registered set reach the scan."""
    if ablation not in ABLATIONS:
        raise ValueError(f"Unknown ablation: {ablation}")
    return maps.select(*keys, *ABLATIONS[ablation])


def with_categories(df: DataFrame) -> DataFrame:
    """Each row twice: under its machine category and under 'all'."""
    kind = paths.machine_category(F.col("machine_type"))
    return df.withColumn("category", F.explode(F.array(F.lit("all"), kind)))


def frequency_band(hz: Column) -> Column:
    """Label of the half-open band that holds ``hz``; NULL above the last band."""
    out = None
    for label, low, high in BANDS:
        inside = (hz >= d(low)) & (hz < d(high))
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def crop_time(
    maps: DataFrame, keys: Sequence[str], length: str, values: Sequence[str], frames: int = 64
) -> DataFrame:
    """Centred crop of long maps to ``frames``; shorter maps get zero frames on the right."""
    total = F.col(length)
    start = F.when(total >= frames, F.floor((total - frames) / 2)).otherwise(0)
    cropped = maps.withColumn("frame", F.col("frame") - start)
    inside = cropped.where((F.col("frame") >= 0) & (F.col("frame") < frames))
    # The last real frame of a short map also emits the missing ones.
    missing = F.when(
        (total < frames) & (F.col("frame") == total - 1),
        F.sequence(total.cast("bigint"), F.lit(frames - 1).cast("bigint")),
    ).otherwise(F.array().cast("array<bigint>"))
    own = F.array(F.struct(F.col("frame").cast("bigint").alias("frame"), F.lit(1.0).alias("keep")))
    pads = F.transform(missing, lambda i: F.struct(i.alias("frame"), F.lit(0.0).alias("keep")))
    grown = inside.select(*keys, *values, F.inline(F.concat(own, pads)))
    return grown.select(*keys, "frame", *[(F.col(c) * F.col("keep")).alias(c) for c in values])


def concatenate(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """One ordered array per key; callers pass keys whose groups are bounded (a block of frames)."""
    packed = F.array_sort(F.collect_list(F.struct(order, value)))
    return df.groupBy(*keys).agg(packed.alias("_p")).select(
        *keys, F.transform("_p", lambda x: x[value]).alias(value)
    )


def balanced_sample(df: DataFrame, limit: int) -> DataFrame:
    """First ceil(limit / machines) clips per machine in path order, then the first ``limit`` overall.

    The rank filter directly on row_number lets Spark keep only the needed rows per group before the
    shuffle (WindowGroupLimit), so a hot machine does not reach one task whole.
    """
    machines = df.agg(F.countDistinct("machine_type").alias("n")).scalar()
    numbered = df.withColumn(
        "_rn", F.row_number().over(Window.partitionBy("machine_type").orderBy("relative_path"))
    ).where(F.col("_rn") <= limit)
    kept = numbered.where(F.col("_rn") <= F.greatest(F.ceil(F.lit(limit) / machines), F.lit(1)))
    return kept.drop("_rn").orderBy("machine_type", "relative_path").limit(limit)


def head(df: DataFrame, limit: int, order: str = "file_id") -> DataFrame:
    if limit < 1:
        raise ValueError(f"A limit of {limit} selects nothing")
    return df.orderBy(order).limit(limit)


def tag_union(frames: Mapping[str, DataFrame], tag: str) -> DataFrame:
    return reduce(
        DataFrame.unionByName, [df.withColumn(tag, F.lit(name)) for name, df in frames.items()]
    )
