"""Array expressions that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(c: Column, pattern: str = "[^a-z0-9]+") -> Column:
    """Non-empty parts between separators."""
    return F.filter(F.split(c, pattern), lambda t: t != "")


def space_split(c: Column) -> Column:
    return words(c, " ")


def lookup(mapping: Mapping[str, str]) -> Callable[[Column], Column]:
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return lambda t: F.coalesce(F.try_element_at(table, t), t)


def without(c: Column, banned: Sequence[str]) -> Column:
    return F.filter(c, lambda t: ~t.isin(*banned))


def first_non_empty(*options: Column) -> Column:
    """The first option with elements, or the last one."""
    out = options[-1]
    for o in reversed(options[:-1]):
        out = F.when(F.size(o) > 0, o).otherwise(out)
    return out


def digits_only(c: Column) -> Column:
    return F.filter(c, lambda t: t.rlike("^[0-9]+$"))


def no_digits(c: Column) -> Column:
    return F.filter(c, lambda t: ~t.rlike("^[0-9]+$"))


def adjacent(c: Column, join: Callable[[Column, Column], Column]) -> Column:
    """``join`` of each element and the next."""
    return F.when(F.size(c) < 2, F.array().cast("array<string>")).otherwise(F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), join))


def joined(c: Column, sep: str = " ") -> Column:
    return F.array_join(c, sep)


def intersection_size(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """-1 if both are empty, 0 if one is, else shared over all."""
    none, one = (F.size(a) == 0) & (F.size(b) == 0), (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(none, -1.0).when(one, 0.0).otherwise(intersection_size(a, b) / F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    """-1 if either is empty, else shared over the smaller set."""
    smaller = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), -1.0).otherwise(intersection_size(a, b) / smaller)
