"""Masked-LM and causal-LM inputs and labels, drawn from (seed, epoch, example, position).

All narrow array work. The mask is never part of the cache: another epoch is
another draw over the same examples.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.functions import draws
from tokenmill.functions.arrays import bound
from tokenmill.schema import IGNORE

# Of the selected positions this share becomes the mask token,
# and half of what is left becomes a random token.
MASKED_SHARE = 0.8
RANDOM_SHARE = 0.1

#: which draw of a position a decision uses
_SELECT, _REPLACE, _WORD = 0, 1, 2


def example_key(seed: int, purpose: int, epoch: int = 0, row_key: str | None = None) -> Column:
    """Draw key of an example; ``row_key`` names a column that has ``draws.row_key`` of its file."""
    key = F.col(row_key) if row_key else draws.row_key(seed, "file_key")
    return draws.fold(key, purpose, epoch, F.col("example_id"))


def _draw(key, position, decision: int) -> Column:
    return draws.draw(key, position * 4 + decision)


def select(examples: DataFrame, mlm_prob: float, pad_id: int, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Add ``selected ARRAY<BOOLEAN>``: an independent draw per position that is
    neither special nor padding."""
    keyed = examples.withColumn("mask_key", example_key(seed, draws.MASK, epoch))
    limit = draws.threshold(mlm_prob)

    def chosen(row):
        return F.transform("ids", lambda token, position: (
            ~F.get(row.special_tokens_mask, position) & (token != pad_id)
            & (_draw(row.mask_key, position, _SELECT) < limit)))

    return keyed.withColumn("selected", bound(F.struct("special_tokens_mask", "mask_key"), chosen))


def with_labels(selected: DataFrame) -> DataFrame:
    """Add ``labels``: the original id where selected, the ignore value elsewhere."""
    return selected.withColumn("labels", F.zip_with(
        "ids", "selected", lambda token, hit: F.when(hit, token.cast("long")).otherwise(F.lit(IGNORE).cast("long"))))


def replaced(selected: DataFrame, mask_id: int, vocab_size: int, rand_replace: bool = True) -> DataFrame:
    """Add ``inputs``: the ids with the selected positions replaced.

    With ``rand_replace`` a selected position becomes the mask token, a uniform
    id of the whole vocabulary, or stays; otherwise always the mask token.
    """
    to_mask = draws.threshold(MASKED_SHARE)
    to_word = draws.threshold(MASKED_SHARE + RANDOM_SHARE)

    if not rand_replace:
        return selected.withColumn("inputs", F.zip_with(
            "ids", "selected", lambda token, hit: F.when(hit, F.lit(mask_id)).otherwise(token).cast("long")))

    def put(row, token, position):
        word = _draw(row.mask_key, position, _WORD) % vocab_size
        fate = _draw(row.mask_key, position, _REPLACE)
        return (F.when(~F.get(row.selected, position), token.cast("long"))
                .when(fate < to_mask, F.lit(mask_id).cast("long"))
                .when(fate < to_word, word).otherwise(token.cast("long")))

    return selected.withColumn("inputs", bound(
        F.struct("selected", "mask_key"),
        lambda row: F.transform("ids", lambda token, position: put(row, token, position))))


def mlm(examples: DataFrame, mlm_prob: float, pad_id: int, mask_id: int, vocab_size: int,
        rand_replace: bool = True, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Add ``inputs`` and ``labels`` for masked language modelling."""
    chosen = with_labels(select(examples, mlm_prob, pad_id, seed, epoch))
    return replaced(chosen, mask_id, vocab_size, rand_replace).drop("mask_key", "selected")


def clm(examples: DataFrame) -> DataFrame:
    """Add ``inputs`` and ``labels`` for causal modelling: both are the ids,
    unshifted, padding included."""
    ids = F.col("ids").cast("array<bigint>")
    return examples.withColumns({"inputs": ids, "labels": ids})
