"""Arrays to rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numbered(rows: DataFrame, keep: list, array: Column, number: str, item: str) -> DataFrame:
    """One row per element with its 0-based number.

    For the inner form Spark adds a filter on the size of the array, which
    builds the array a second time. The outer form keeps empty arrays as a NULL
    row, dropped here afterwards.
    """
    exploded = rows.select(*keep, F.posexplode_outer(array).alias(number, item))
    return exploded.where(F.col(number).isNotNull())


def inlined(rows: DataFrame, keep: list, structs: str, never_null: str) -> DataFrame:
    """One row per struct of an array, its fields as columns; see :func:`numbered`."""
    return rows.select(*keep, F.inline_outer(structs)).where(F.col(never_null).isNotNull())
