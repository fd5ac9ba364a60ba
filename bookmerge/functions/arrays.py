"""Set and ordered-union expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlaps(a: Column, b: Column) -> Column:  # X03
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def same_set(a: Column, b: Column) -> Column:  # X04
    return F.array_sort(F.array_distinct(a)).eqNullSafe(F.array_sort(F.array_distinct(b)))


def ordered_union(primary: Column, secondary: Column, key: Callable[[Column], Column], element: str, dedup_secondary: bool = False) -> Column:  # X05
    """Primary's elements, then secondary's whose keys primary lacks; repeats inside secondary stay unless told."""
    none = F.array().cast(f"array<{element}>")
    p, s = F.coalesce(primary, none), F.coalesce(secondary, none)
    known = F.transform(p, key)
    extra = F.filter(s, lambda x: ~F.coalesce(F.array_contains(known, key(x)), F.lit(False)))
    if dedup_secondary:
        extra = F.filter(extra, lambda x, i: ~F.exists(F.slice(extra, F.lit(1), i), lambda y: key(y).eqNullSafe(key(x))))
    return F.concat(p, extra)


def set_union(a: Column, b: Column) -> Column:  # X06
    return F.array_sort(F.array_union(F.coalesce(a, b), F.coalesce(b, a)))


def same_tokens(a: Column, b: Column) -> Column:  # X07
    x, y = (F.array_sort(F.array_distinct(F.filter(F.split(s, " "), lambda w: w != ""))) for s in (a, b))
    return (a != b) & (x == y) & (F.size(x) >= 2)


def any_pair(a: Column, b: Column, test: Callable[[Column, Column], Column]) -> Column:  # J10
    return F.coalesce(F.exists(a, lambda x: F.exists(b, lambda y: test(x, y))), F.lit(False))
