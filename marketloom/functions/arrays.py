"""Running values over arrays, in time proportional to their length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketloom.functions.text import bind

CHUNK = 256  # an array grows by copying, so it is built in chunks of this length


def chunks(values: Column, size: int = CHUNK) -> Column:
    """The array in slices of ``size`` elements; an empty array gives one empty slice."""
    places = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int"))
    cut = F.transform(places, lambda c: F.slice(values, c * size + 1, F.lit(size)))
    return F.when(F.size(values) == 0, F.array(values)).otherwise(cut)


def running(values: Column, merge: Callable[[Column, Column], Column], zero: Column) -> Column:
    """``merge`` over every prefix of ``values``, the element included; starts from ``zero``."""

    def run(part: Column, start: Column) -> Column:
        return F.aggregate(
            part, F.array(start), lambda a, v: F.concat(a, F.array(merge(F.element_at(a, -1), v)))
        )

    def of(parts: Column) -> Column:
        ends = F.transform(parts, lambda p: F.aggregate(p, zero, merge))
        return bind(
            run(ends, zero),
            lambda starts: F.flatten(
                F.transform(parts, lambda p, i: F.slice(run(p, starts[i]), F.lit(2), F.size(p)))
            ),
        )

    return bind(values, lambda v: bind(chunks(v), of))


def running_sums(values: Column) -> Column:
    """Sums of all prefixes of an array of whole numbers, as longs."""
    return running(values, lambda a, v: (a + v).cast("long"), F.lit(0).cast("long"))
