"""Batches for a trainer."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.functions.text import physical_lines
from tokenmill.operators import batch, encode, lines, masking, segments
from tokenmill.operators.encode import Tokenizer


def loader(examples: DataFrame, tokenizer: Tokenizer, batch_size=128, shuffle=True, mlm=True,
           mlm_prob=0.15, rand_replace=True, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Padded batches of one epoch with inputs, labels and masks."""
    if shuffle:
        padded = batch.shuffled_padded(examples, batch_size, tokenizer.pad_id, seed, epoch)
    else:
        padded = batch.ordered_padded(examples, batch_size, tokenizer.pad_id, seed)
    return _collated(padded, tokenizer, mlm, mlm_prob, rand_replace, seed, epoch)


def _collated(padded: DataFrame, tokenizer: Tokenizer, mlm: bool, mlm_prob: float, rand_replace: bool,
              seed: int, epoch: int) -> DataFrame:
    if not mlm:
        return batch.collate(padded, masking.clm)
    return batch.collate(padded, lambda rows: masking.mlm(
        rows, mlm_prob, tokenizer.pad_id, tokenizer.mask_id, tokenizer.vocab_size, rand_replace,
        seed, epoch))


def line_examples(files: DataFrame, tokenizer: Tokenizer, max_length=512) -> DataFrame:
    """One example per physical line, blank ones too, without type ids."""
    rows = encode.segments(files, tokenizer, max_length, texts=physical_lines(lines.whole_text()))
    return segments.single(rows).withColumn(
        "token_type_ids", F.lit(None).cast("array<tinyint>"))


def line_loader(files: DataFrame, tokenizer: Tokenizer, max_length: int | None = 512, batch_size=128, shuffle=True, mlm=True,
                mlm_prob=0.15, rand_replace=True, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Batches encoded straight from raw lines.

    A line is one example whatever it encodes to, cut at ``max_length`` tokens unless that is
    None, so the lines are numbered and dealt to
    batches as text, and each is encoded once, in its batch.
    """
    rows = lines.raw_lines(files).select("file_key", F.col("row_no").cast("long").alias("example_id"), "line")
    batched = batch.shuffled(rows, batch_size, seed, epoch) if shuffle else batch.ordered(rows, batch_size, seed)
    pieces = batched.withColumn("texts", F.array("line")).select(
        "batch_id", "row_in_batch", "file_key", F.col("example_id").alias("seg_id"),
        encode.encoded("texts", tokenizer).alias("pieces"))
    ids = encode.windows(F.element_at("pieces", 1), max_length, False, tokenizer)
    framed = pieces.withColumn("ids", F.element_at(ids, 1))
    made = segments.single(framed, "batch_id", "row_in_batch").withColumn(
        "token_type_ids", F.lit(None).cast("array<tinyint>"))
    padded = batch.pad_batch(made, tokenizer.pad_id)
    return _collated(padded, tokenizer, mlm, mlm_prob, rand_replace, seed, epoch)
