"""Named global reducers of vertex programs: a zero, a merge, and the same as an aggregate of a Column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Identities of the reducers.
LONG_MAX, LONG_MIN, DOUBLE_MAX = (1 << 63) - 1, -(1 << 63), 1.7976931348623157e308


@dataclass(frozen=True)
class Aggregator:
    zero: Any
    merge: Callable[[Any, Any], Any]
    column: Callable[[Column], Column] | None = None


def _add_lists(a: list[float], b: list[float]) -> list[float]:
    if a and len(b) > len(a):
        raise ValueError("a longer list than the first")
    return [x + y for x, y in zip(a, [*b, *[0.0] * (len(a) - len(b))], strict=True)] if a else list(b)


def list_of_lists(k: int) -> Aggregator:
    """Keeps k lists: of all that come, the k that sort first, whatever the order of arrival."""
    return Aggregator([], lambda a, b: sorted([*a, *b])[:k])


LONG_SUM = Aggregator(0, lambda a, b: a + b, lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)))
DOUBLE_SUM = Aggregator(0.0, lambda a, b: a + b, lambda c: F.coalesce(F.sum(c.cast("double")), F.lit(0.0)))
LONG_PRODUCT = Aggregator(1, lambda a, b: a * b, lambda c: F.reduce(F.collect_list(c.cast("long")), F.lit(1).cast("long"), lambda a, b: a * b))
DOUBLE_PRODUCT = Aggregator(1.0, lambda a, b: a * b, lambda c: F.coalesce(F.product(c.cast("double")), F.lit(1.0)))
LONG_MIN_OF = Aggregator(LONG_MAX, min, lambda c: F.coalesce(F.min(c.cast("long")), F.lit(LONG_MAX)))
LONG_MAX_OF = Aggregator(LONG_MIN, max, lambda c: F.coalesce(F.max(c.cast("long")), F.lit(LONG_MIN)))
DOUBLE_MIN_OF = Aggregator(DOUBLE_MAX, min, lambda c: F.coalesce(F.min(c.cast("double")), F.lit(DOUBLE_MAX)))
DOUBLE_MAX_OF = Aggregator(float("-inf"), max, lambda c: F.coalesce(F.max(c.cast("double")), F.lit(float("-inf"))))
BOOLEAN_AND = Aggregator(True, lambda a, b: a and b, lambda c: F.coalesce(F.bool_and(c), F.lit(True)))
BOOLEAN_OR = Aggregator(False, lambda a, b: a or b, lambda c: F.coalesce(F.bool_or(c), F.lit(False)))
DOUBLE_LIST = Aggregator([], _add_lists)
