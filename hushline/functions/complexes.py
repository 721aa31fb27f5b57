"""Complex arithmetic on (re, im) pairs of double columns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Cx(NamedTuple):
    re: Column
    im: Column


def cx(prefix: str) -> Cx:
    return Cx(F.col(f"{prefix}_re"), F.col(f"{prefix}_im"))


def power(a: Cx) -> Column:
    return a.re * a.re + a.im * a.im


def magnitude(a: Cx) -> Column:
    return F.sqrt(power(a))


def angle(a: Cx) -> Column:
    return F.atan2(a.im, a.re)


def cross(a: Cx, b: Cx) -> Cx:
    """a * conj(b)."""
    return Cx(a.re * b.re + a.im * b.im, a.im * b.re - a.re * b.im)


def product(a: Cx, b: Cx) -> Cx:
    return Cx(a.re * b.re - a.im * b.im, a.re * b.im + a.im * b.re)


def scaled(a: Cx, k: Column) -> Cx:
    return Cx(a.re * k, a.im * k)


def plus(a: Cx, b: Cx) -> Cx:
    return Cx(a.re + b.re, a.im + b.im)


def minus(a: Cx, b: Cx) -> Cx:
    return Cx(a.re - b.re, a.im - b.im)
