"""Semirings as builders of columns.  The identity of the addition is an absent row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Semiring:
    """multiply(weight, x) of an edge and a vector's value; add(products), an aggregate.

    fold(array) adds the products of a packed row, merge(folds) is the aggregate of what several rows' folds gave.
    """

    name: str
    multiply: Callable[[Column, Column], Column]
    add: Callable[[Column], Column]
    fold: Callable[[Column], Column]
    merge: Callable[[Column], Column]


def _plus(products: Column) -> Column:
    return F.reduce(products, F.lit(0.0), lambda a, x: a + x)


COUNTING = Semiring("counting", lambda w, x: F.lit(1), lambda p: F.count(p), lambda a: F.size(a).cast("long"), lambda f: F.sum(f))
BOOLEAN = Semiring("boolean", lambda w, x: F.lit(True), lambda p: F.bool_or(p), lambda a: F.size(a) > 0, lambda f: F.bool_or(f))
MIN_PLUS = Semiring("min_plus", lambda w, x: w + x, lambda p: F.min(p), lambda a: F.array_min(a), lambda f: F.min(f))
PLUS_TIMES = Semiring("plus_times", lambda w, x: w * x, lambda p: F.sum(p), _plus, lambda f: F.sum(f))
MIN_SECOND = Semiring("min_second", lambda w, x: x, lambda p: F.min(p), lambda a: F.array_min(a), lambda f: F.min(f))

ALL = {s.name: s for s in (COUNTING, BOOLEAN, MIN_PLUS, PLUS_TIMES, MIN_SECOND)}
