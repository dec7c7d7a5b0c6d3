"""Reducers for ``reduce`` and ``combine``: an aggregate expression over the column ``val``.

Any Spark aggregate serves, also a pandas one; these have a partial step before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

REDUCERS: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "xor": F.bit_xor,
    "any": F.bool_or,
    "all": F.bool_and,
}


def reducer(op: str | Callable[[Column], Column]) -> Callable[[Column], Column]:
    return REDUCERS[op] if isinstance(op, str) else op


def ordered_fold(value: Column, order: Column, start: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """A fold that need not commute: values in their order. The values of a group are gathered, so it is for groups of one row a process."""
    return F.aggregate(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), start, lambda a, x: merge(a, x["v"]))


def normal_density(x: float) -> float:
    return math.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def normal_cumulative(x: float) -> float:
    return (1 + math.erf(x / math.sqrt(2))) / 2


def normal_interval(confidence: float) -> float:
    """Half width, in standard deviations, of the centred interval with this probability."""
    if not 0 < confidence < 1:
        raise ValueError("a probability between 0 and 1")
    x = 0.0
    for _ in range(200):
        step = (2 * normal_cumulative(x) - 1 - confidence) / (2 * normal_density(x))
        x -= max(-1.0, min(1.0, step))
        if abs(step) < 1e-14:
            break
    return x


def normal_error_bound(third_moment: Column, variance: Column, n: Column) -> Column:
    """Bound on the distance of a mean of ``n`` samples from the normal law, from their third absolute moment."""
    return F.lit(0.3328) * (third_moment / F.pow(variance, 1.5) + 0.429) / F.sqrt(n)
