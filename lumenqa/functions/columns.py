"""Building blocks for Column expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it.

    It is the end of a fold over no elements: a transform would copy the value's strings, a fold copies nothing.
    """
    return F.aggregate(F.array(), value, lambda v, _: v, body)


def exploded(df: DataFrame, rows: Column, *columns: str | Column, names: tuple[str, ...] = ("at", "x")) -> DataFrame:
    """``columns`` of ``df`` with each element of an array and its place.

    For an array that costs something to make: the outer form keeps the optimizer from making it
    once more to leave out rows whose array is empty.
    """
    return df.select(*columns, F.posexplode_outer(rows).alias(*names)).filter(F.col(names[0]).isNotNull())


def places(rows: Column, test: Callable[[Column], Column]) -> Column:
    """The numbers, from 0, of the elements that pass a test."""
    return F.filter(F.transform(rows, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())


def cut_at(rows: Column, starts: Column, part: Callable[[Column, Column], Column]) -> Column:
    """``part`` (first place, elements) of each stretch of ``rows`` from one start to the next."""
    return F.transform(starts, lambda a, j: part(a, F.slice(rows, a + 1, F.coalesce(F.get(starts, j + 1), F.size(rows)) - a)))
