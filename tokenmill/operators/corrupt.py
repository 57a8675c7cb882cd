"""Replaced-token detection: inputs corrupted by sampled tokens, and their labels."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.functions.arrays import bound
from tokenmill.operators.rows import numbered
from tokenmill.schema import IGNORE

KEYS = ("file_key", "example_id")


def positions(masked: DataFrame) -> DataFrame:
    """(…keys, pos, label) of the positions that carry a label, with ``batch_id`` and ``row_key`` if there."""
    carried = [c for c in ("batch_id", "row_key") if c in masked.columns]
    return (numbered(masked, [*carried, *KEYS], F.col("labels"), "pos", "label")
            .where(F.col("label") != IGNORE))


def attach(masked: DataFrame, samples: DataFrame) -> DataFrame:
    """Add ``sampled MAP<pos, token>`` to the examples; without samples it is NULL.

    A group is the sampled positions of one example, so it is never large.
    """
    per_example = samples.groupBy(*KEYS).agg(
        F.map_from_entries(F.collect_list(F.struct("pos", "token_id"))).alias("sampled"))
    return masked.join(per_example, list(KEYS), "left")


def sampled(positions: str, tokens: str) -> Column:
    """``sampled`` as :func:`attach` adds it, for samples that are in the row of their example."""
    return F.map_from_arrays(positions, tokens)


def corrupt(attached: DataFrame) -> DataFrame:
    """Add ``d_inputs`` (the sampled token where a label is set) and ``d_labels``
    (1 where that token differs from the original)."""
    def token(row, position):
        return F.try_element_at(row.sampled, position).cast("long")

    labelled = F.arrays_zip("inputs", "labels")
    samples = F.struct("sampled")
    d_inputs = bound(samples, lambda row: F.transform(labelled, lambda p, i: F.when(
        p.labels != IGNORE, F.coalesce(token(row, i), p.inputs)).otherwise(p.inputs)))
    d_labels = bound(samples, lambda row: F.transform(labelled, lambda p, i: F.coalesce(
        (p.labels != IGNORE) & (token(row, i) != p.labels), F.lit(False)).cast("long")))
    return attached.withColumns({"d_inputs": d_inputs, "d_labels": d_labels}).drop("sampled")
