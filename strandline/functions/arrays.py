"""Set operations on sorted arrays (O1 - O7), as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merged(*arrays: Column) -> Column:
    """All elements of all arrays in order, repeats kept."""
    return F.array_sort(F.concat(*arrays))


def union(*arrays: Column) -> Column:
    """O1, O2: the different elements of all arrays in order."""
    return F.array_sort(F.array_distinct(F.concat(*arrays)))


def intersection(*arrays: Column) -> Column:
    """O1, O3: the elements that every array holds, in order."""
    out = F.array_distinct(arrays[0])
    for a in arrays[1:]:
        out = F.array_intersect(out, a)
    return F.array_sort(out)


def difference(a: Column, b: Column) -> Column:
    """O1: elements of the first array only."""
    return F.array_sort(F.array_except(a, b))


def symmetric_difference(a: Column, b: Column) -> Column:
    """O1: elements of exactly one of the arrays."""
    return F.array_sort(F.array_union(F.array_except(a, b), F.array_except(b, a)))


def _times(all_: Column, x: Column) -> Column:
    return F.size(F.filter(all_, lambda y: y == x))


def frequent(arrays: list[Column], least: int, most: int | None = None) -> Column:
    """The different elements that occur at least ``least`` times in all; nothing at all if more than ``most`` do."""
    together = F.concat(*arrays)
    kept = F.array_sort(F.filter(F.array_distinct(together), lambda x: _times(together, x) >= least))
    return kept if most is None else or_empty(kept, most)


def repeated(a: Column, least: int) -> Column:
    """The elements that occur at least ``least`` times, all copies kept."""
    often = F.filter(F.array_distinct(a), lambda x: _times(a, x) >= least)  # counted once for each different element
    return F.array_sort(F.flatten(F.transform(often, lambda x: F.filter(a, lambda y: y == x))))


def first_n(a: Column, n: int) -> Column:
    """The first n elements."""
    return F.slice(a, F.lit(1), F.lit(n))


def or_empty(a: Column, most: int) -> Column:
    """The array, or nothing if it is longer than ``most``."""
    return F.when(F.size(a) > most, F.slice(a, F.lit(1), F.lit(0))).otherwise(a)
