"""Helpers for array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once a row, also where the body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def mean_of(values: Column) -> Column:
    return total(values) / F.size(values)


def softmax(logits: Column) -> Column:
    def shifted(x: Column) -> Column:
        return let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))

    return let(logits, lambda x: let(shifted(x), lambda p: let(total(p), lambda z: F.transform(p, lambda v: v / z))))


def unit(values: Column) -> Column:
    """At unit length, in double precision; zero stays zero."""
    doubles = F.transform(values, lambda x: x.cast("double"))
    size = lambda x: F.greatest(F.sqrt(total(F.transform(x, lambda v: v * v))), F.lit(1e-12))
    return let(doubles, lambda x: let(size(x), lambda n: F.transform(x, lambda v: v / n)))
