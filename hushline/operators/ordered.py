"""Order statistics that never put one whole group into one task.

A plain ``Window.partitionBy(group).orderBy(value)`` sends a group to a single task, and
``percentile`` keeps every distinct value of a group in one buffer.  Both break when one group holds
a third of the data.  The operators here split each group into value ranges (or any coarser key that
is monotone in the order), work inside the ranges, and add the totals of the ranges before.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = 256
ACCURACY = 10_000


def range_bounds(df: DataFrame, value: str, buckets: int = BUCKETS) -> Column:
    """Scalar subquery: one array of ``buckets - 1`` approximate cut points of ``value``.

    The cut points only balance the work; results never depend on how exact they are.
    """
    grid = [i / buckets for i in range(1, buckets)]
    cuts = F.percentile_approx(F.col(value).cast("double"), grid, ACCURACY)
    return df.agg(cuts.alias("cuts")).scalar()


def range_bucket(value: str, bounds: str, buckets: int = BUCKETS) -> Column:
    """Number of cut points not above ``value``, by binary search in the cut-point array."""
    steps = []
    step = buckets // 2
    while step:
        steps.append(step)
        step //= 2
    probe = F.col(value).cast("double")
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, by: F.when(probe >= F.element_at(F.col(bounds), at + by), at + by).otherwise(at),
    )


def with_range_bucket(df: DataFrame, value: str, balance_on: DataFrame | None = None, name: str = "bucket") -> DataFrame:
    """Add the value-range index of ``value``, with cut points from ``balance_on`` (default: the rows themselves)."""
    cut = df.withColumn("_cuts", range_bounds(df if balance_on is None else balance_on, value))
    return cut.withColumn(name, range_bucket(value, "_cuts")).drop("_cuts")


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: Sequence[Column],
    sums: Mapping[str, Column],
    descending: bool = False,
) -> DataFrame:
    """Add ``<name>_before`` (exclusive prefix sum) and ``<name>_total`` per group.

    ``bucket`` must be monotone in ``order``.  Rows are windowed per (keys, bucket); the small table of
    bucket totals carries the offsets and is joined on the same (keys, bucket).
    """
    keys = list(keys)
    within = (
        Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    direction = F.col(bucket).desc() if descending else F.col(bucket).asc()
    across = Window.partitionBy(*keys).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)

    # The join below drops NULL keys anyway; filtering them here, before the two uses of the rows part, keeps both
    # uses identical so that Spark runs the shuffle underneath once and reuses it.
    rows = df
    for key in [*keys, bucket]:
        rows = rows.where(F.col(key).isNotNull())
    for name, value in sums.items():
        rows = rows.withColumn(f"_v_{name}", value)
    totals = rows.groupBy(*keys, bucket).agg(
        *[F.sum(f"_v_{name}").alias(f"_b_{name}") for name in sums]
    )
    totals = totals.select(
        *keys,
        bucket,
        *[F.coalesce(F.sum(f"_b_{n}").over(across), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_b_{n}").over(whole).alias(f"{n}_total") for n in sums],
    )
    windowed = rows.select(
        *df.columns,
        *[F.coalesce(F.sum(f"_v_{n}").over(within), F.lit(0)).alias(f"_w_{n}") for n in sums],
    )
    joined = windowed.join(totals, [*keys, bucket])
    return joined.select(
        *df.columns,
        *[(F.col(f"_o_{n}") + F.col(f"_w_{n}")).alias(f"{n}_before") for n in sums],
        *[F.col(f"{n}_total") for n in sums],
    )


def running_sums(
    cells: DataFrame,
    keys: Sequence[str],
    value: str,
    sums: Mapping[str, Column],
    descending: bool = False,
    balance_on: DataFrame | None = None,
    tie_breakers: Sequence[str] = (),
) -> DataFrame:
    """Prefix sums in the order of a numeric column; one row per (keys, value) unless ties are broken.

    ``balance_on`` may name a cheaper table with the same value column for the cut points.
    """
    cut = with_range_bucket(cells, value, balance_on, "_bucket")
    first = F.col(value).desc() if descending else F.col(value).asc()
    order = [first, *[F.col(c).asc() for c in tie_breakers]]
    return prefix_sums(cut, keys, "_bucket", order, sums, descending).drop("_bucket")


def ordered_positions(
    df: DataFrame, keys: Sequence[str], coarse: str, order: Sequence[str], name: str = "pos"
) -> DataFrame:
    """Dense 0-based position of each row in its group, plus the group size as ``<name>_count``.

    ``coarse`` is a column monotone in the order (such as a date before a full sort key).
    """
    counted = prefix_sums(df, keys, coarse, [F.col(c) for c in order], {"_n": F.lit(1).cast("bigint")})
    return counted.select(
        *df.columns, F.col("_n_before").alias(name), F.col("_n_total").alias(f"{name}_count")
    )


def hashed_positions(
    df: DataFrame, keys: Sequence[str], token: Column, name: str = "pos"
) -> DataFrame:
    """Dense positions in the order of md5(token): a reproducible shuffle of each group.

    The first two hex digits of the digest are the coarse key, so every group splits evenly in 256.
    """
    hashed = df.withColumn("_digest", F.md5(token.cast("string")))
    hashed = hashed.withColumn("_coarse", F.substring("_digest", 1, 2))
    placed = ordered_positions(hashed, keys, "_coarse", ["_digest"], name)
    return placed.drop("_digest", "_coarse")


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Exact linear-interpolated quantiles per group, in bounded memory per task.

    A mergeable sketch brackets each wanted rank.  Values outside the bracket are only counted (they
    collapse to one cell per group before the shuffle, with their greatest value below and least value above); the
    few inside keep their value and are ranked.  Interpolation needs two neighbouring ranks, one of which may lie just
    outside; the outer values supply it, so groups of every size go one way.  A rank that still lies elsewhere, beyond
    the sketch's error, fails the job.
    """
    names = list(probabilities)
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    join_keys = keys
    if not keys:
        rows = rows.withColumn("_all", F.lit(0))
        join_keys = ["_all"]
    slack = 4.0 / accuracy
    grid = [max(0.0, probabilities[n] - slack) for n in names]
    grid += [min(1.0, probabilities[n] + slack) for n in names]
    sketch = rows.groupBy(*join_keys).agg(
        F.count("*").alias("_n"), F.percentile_approx("_v", grid, accuracy).alias("_b")
    )
    wanted = F.array(
        *[
            F.struct(
                F.lit(i).alias("which"),
                F.element_at("_b", i + 1).alias("lo"),
                F.element_at("_b", len(names) + i + 1).alias("hi"),
                (F.lit(float(probabilities[n])) * (F.col("_n") - 1)).alias("rank"),
            )
            for i, n in enumerate(names)
        ]
    )
    brackets = sketch.select(*join_keys, F.explode(wanted).alias("_w"))
    # AQE broadcasts the brackets when they turn out small and splits hot groups when they do not.
    side = F.when(F.col("_v") < F.col("_w.lo"), -1).when(F.col("_v") > F.col("_w.hi"), 1).otherwise(0)
    cells = (
        rows.join(brackets, join_keys)
        .select(*join_keys, F.col("_w.which").alias("_q"), F.col("_w.rank").alias("_r"),
                side.alias("_s"), F.when(side == 0, F.col("_v")).alias("_v"), F.col("_v").alias("_x"))
        .groupBy(*join_keys, "_q", "_r", "_s", "_v")
        .agg(F.count("*").alias("_c"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))
    )
    ranked = cells.withColumn(
        "_end",
        F.sum("_c").over(
            Window.partitionBy(*join_keys, "_q")
            .orderBy("_s", "_v")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ),
    )
    low = F.floor("_r")
    high = F.ceil("_r")

    def value_at(rank: Column) -> Column:
        start = F.col("_end") - F.col("_c")
        inside = (F.col("_s") == 0) & (start <= rank) & (rank < F.col("_end"))
        return (
            F.when(inside, F.col("_v"))
            .when((F.col("_s") == -1) & (rank == F.col("_end") - 1), F.col("_most"))
            .when((F.col("_s") == 1) & (rank == start), F.col("_least"))
        )

    picked = ranked.groupBy(*join_keys, "_q").agg(
        F.max(value_at(low)).alias("_lo"), F.max(value_at(high)).alias("_hi"), F.max(F.col("_r") - low).alias("_f")
    )
    missed = F.raise_error(F.lit("A quantile's rank lies outside its sketch's bracket")).cast("double")
    picked = picked.withColumns({c: F.coalesce(F.col(c), missed) for c in ("_lo", "_hi")})
    result = picked.groupBy(*join_keys).agg(
        *[
            F.max(
                F.when(
                    F.col("_q") == i,
                    F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f"),
                )
            ).alias(n)
            for i, n in enumerate(names)
        ]
    )
    return result.select(*keys, *names)


def sized_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    size: Column,
    limit: int = ACCURACY,
) -> DataFrame:
    """Exact quantiles where each row knows (a bound of) its group's size.

    Groups up to ``limit`` rows use the built-in aggregate, whose buffer is then bounded by ``limit``; larger
    groups take the bracketed path of :func:`quantiles`.
    """
    rows = df.select(*keys, value, size.alias("_size"))
    small = rows.where(F.col("_size") <= limit).groupBy(*keys).agg(
        *[F.percentile(value, F.lit(float(p))).alias(n) for n, p in probabilities.items()]
    )
    large = quantiles(rows.where(F.col("_size") > limit), keys, value, probabilities)
    return small.unionByName(large)
