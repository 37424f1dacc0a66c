"""Reducers: names of aggregates that combine before the shuffle, or functions of two Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Reducer = str | Callable[[Column, Column], Column]
NAMED = {"min": F.min, "max": F.max, "sum": F.sum, "product": F.product, "and": F.bool_and, "or": F.bool_or, "count": F.count, "avg": F.avg}


def reduce_column(reducer: Reducer, value: Column) -> Column:
    """The aggregate of a group's values. A function reduces them in sorted order, so it need not be commutative."""
    if isinstance(reducer, str):
        return NAMED[reducer](value)
    values = F.array_sort(F.collect_list(value))
    return F.reduce(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)), reducer)


def fold_column(order: list[Column], fields: dict[str, Column], init: Column, f: Callable[[Column, Column], Column]) -> Column:
    """A left fold of f(accumulator, row) over a group's rows in the given order."""
    keys = {f"_{i}": c for i, c in enumerate(order)}
    rows = F.array_sort(F.collect_list(F.struct(*(c.alias(n) for n, c in (keys | fields).items()))))
    return F.reduce(rows, init, f)
