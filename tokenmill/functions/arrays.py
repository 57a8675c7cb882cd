"""Parallel token arrays: specials, masks, padding."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row.

    A column that a lambda refers to is inlined into it when projections are
    merged, and is then computed for every element. A lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def constant(value, size: Column, sql_type: str) -> Column:
    return F.array_repeat(F.lit(value).cast(sql_type), size)


def framed(body: Column, first: int, last: int) -> Column:
    """``[CLS] body [SEP]``."""
    return F.concat(F.array(F.lit(first)), body, F.array(F.lit(last)))


def frame_mask(size: Column) -> Column:
    """True at the first and the last of ``size`` positions."""
    edge = F.array(F.lit(True))
    return F.concat(edge, F.array_repeat(F.lit(False), size - 2), edge)


def tail(array: Column) -> Column:
    return F.slice(array, 2, F.size(array))


def padded(array: Column, width: Column, value, element_type: str) -> Column:
    return F.concat(array, constant(value, width - F.size(array), element_type))


def as_text(array: Column) -> Column:
    """Comma-joined elements, for exports that cannot carry arrays."""
    return F.array_join(array.cast("array<string>"), ",")


def bits(array: Column) -> Column:
    """Boolean array as 0/1 integers."""
    return array.cast("array<int>")
