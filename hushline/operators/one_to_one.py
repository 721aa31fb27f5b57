"""Joins that must be one to one: tables tagged by side, one grouping by the key, every departure named.

A chain of outer joins shuffles the growing result again and again, multiplies repeated keys and loses what only a later
side holds.  Here all sides travel once, as a union with a side tag; one grouping counts the rows of every side and brings
their values together.  A key that repeats collapses in the map-side part of the grouping, so a hot key is no hot task, and
a null key is a key like any other: it is matched, counted and reported.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _picked(name: str, kind: T.DataType) -> Column:
    """The one value of a column.  ``max`` keeps numbers in the hash aggregate's own buffer."""
    number = isinstance(kind, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType))
    return (F.max(name) if number else F.any_value(name, ignoreNulls=True)).alias(name)


def gathered(sides: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """One row per key: the values of all sides and ``_rows``, a struct with each side's number of rows.

    ``sides`` maps what a side holds ("near features") to its table; besides the keys their columns must differ.
    """
    keys = list(keys)
    values = [(field.name, field.dataType) for df in sides.values() for field in df.schema if field.name not in keys]
    names = [name for name, _ in values]
    if len(set(names)) != len(names):
        raise ValueError(f"Sides share value columns: {sorted({n for n in names if names.count(n) > 1})}")
    tagged = [df.withColumn("_side", F.lit(i)) for i, df in enumerate(sides.values())]
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    counts = [F.count_if(F.col("_side") == i).alias(f"_n{i}") for i in range(len(tagged))]
    grouped = together.groupBy(*keys).agg(*[_picked(n, kind) for n, kind in values], *counts)
    rows = F.struct(*[F.col(f"_n{i}").alias(side) for i, side in enumerate(sides)])
    return grouped.select(*keys, *names, rows.alias("_rows"))


def _named(keys: Sequence[str]) -> Column:
    return F.concat_ws(" ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])


def one_to_one(sides: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """The sides joined on ``keys``; a key that a side lacks or repeats fails the job that reads the result.

    The test is a filter over the counts, so it runs whatever columns the reader takes.
    """
    return checked(gathered(sides, keys), sides, keys)


def matched(sides: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """The keys that every side holds exactly once, for reports beside :func:`faults`; jobs take :func:`one_to_one`."""
    once = reduce(lambda a, b: a & b, [F.col("_rows").getField(side) == 1 for side in sides])
    return gathered(sides, keys).where(once).drop("_rows")


def checked(joined: DataFrame, sides: Iterable[str], keys: Sequence[str]) -> DataFrame:
    """The rows of :func:`gathered`, failing the job at the first key that a side lacks or repeats."""
    fault = F.lit(None).cast("string")
    for side in reversed(list(sides)):
        n = F.col("_rows").getField(side)
        fault = (
            F.when(n == 0, F.concat_ws(" ", F.lit(f"No {side} for"), _named(keys)))
            .when(n > 1, F.concat_ws(" ", F.lit(f"Repeated {side} for"), _named(keys)))
            .otherwise(fault)
        )
    sound = F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")).otherwise(F.lit(True))
    return joined.where(sound).drop("_rows")


def faults(sides: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """keys, side, fault ("missing" or "repeated") and rows of every departure from one row per key and side."""
    rows = gathered({side: df.select(*keys) for side, df in sides.items()}, keys)
    each = F.array(*[F.struct(F.lit(side).alias("side"), F.col("_rows").getField(side).alias("rows")) for side in sides])
    found = rows.select(*keys, F.inline(each)).where(F.col("rows") != 1)
    return found.select(*keys, "side", F.when(F.col("rows") == 0, "missing").otherwise("repeated").alias("fault"), "rows")


def same(left: Column, right: Column, message: str, *named: str) -> Column:
    """A filter that fails the job where the two sides disagree; NULL equals NULL."""
    about = F.concat_ws(" ", F.lit(message), *[F.coalesce(F.col(n).cast("string"), F.lit("null")) for n in named])
    return F.when(left.eqNullSafe(right), F.lit(True)).otherwise(F.raise_error(about).cast("boolean"))
