"""Fixed-size batches and padding to a rectangle."""

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.functions import arrays as ar
from tokenmill.operators import index

# What fills the columns of a padded row besides the pad id.
ATTENTION_FILL, SPECIAL_FILL, TYPE_FILL = False, True, 1


def _numbered(indexed: DataFrame, batch_size: int) -> DataFrame:
    return indexed.withColumns({
        "batch_id": F.floor(F.col("global_idx") / batch_size),
        "row_in_batch": (F.col("global_idx") % batch_size).cast("int")})


def shuffled(examples: DataFrame, batch_size: int = 128, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Batches of a fresh random order; the last one may be short."""
    return _numbered(index.random_order(examples, seed, epoch), batch_size)


def shuffled_padded(examples: DataFrame, batch_size: int = 128, pad_id: int = 0, seed: int = 0,
                    epoch: int = 0) -> DataFrame:
    """:func:`shuffled` then :func:`pad_batch`, moving the rows through one shuffle
    instead of two. ``n_tokens`` must be the length of ``ids``, as it is in the cache.

    Ranking leaves the rows grouped by bucket, and a batch inside one bucket is
    padded there. Only batches that cross a bucket border, no more than there are
    buckets, need rows of several; their widths come from a pass over the keys.
    """
    # the stored lengths spare this pass the token arrays
    sizes = examples.select("file_key", "example_id", "n_tokens")
    keys = index.in_buckets(sizes, seed, epoch)
    edges = (index.bucket_starts(keys)
             .select(F.explode(F.array("start", F.col("start") + F.col("size") - 1)).alias("global_idx"))
             .select(F.floor(F.col("global_idx") / batch_size).alias("batch_id")).distinct())
    crossing = (_numbered(index.ranked(keys), batch_size)
                .join(F.broadcast(edges), "batch_id", "left_semi")
                .groupBy("batch_id").agg(F.max("n_tokens").alias("edge_width")))
    rows = _numbered(index.ranked(index.in_buckets(examples, seed, epoch)), batch_size)
    inside = rows.withColumn("inside_width", F.max("n_tokens").over(Window.partitionBy("bucket", "batch_id")))
    wide = (inside.join(F.broadcast(crossing), "batch_id", "left")
            .withColumn("width", F.coalesce("edge_width", "inside_width"))
            .drop("edge_width", "inside_width", "bucket", "place"))
    return _fill(wide, pad_id)


def ordered(examples: DataFrame, batch_size: int = 128, seed: int = 0) -> DataFrame:
    """Batches in file order."""
    return _numbered(index.file_order(examples, seed), batch_size)


def ordered_padded(examples: DataFrame, batch_size: int = 128, pad_id: int = 0, seed: int = 0) -> DataFrame:
    """:func:`ordered` then :func:`pad_batch`, moving the rows through one shuffle instead of
    two. ``n_tokens`` must be the length of ``ids``, as it is in the cache.

    The rows are grouped by run, and a batch inside one run is padded there. Only the first
    and last batch of a run may have rows of other runs; their widths come from a pass over
    the keys and are joined back by run, by which the rows are grouped already.
    """
    sizes = examples.select("file_key", "example_id", "n_tokens")
    keys = sizes.withColumn("block", F.shiftright("example_id", index.BLOCK_BITS))
    widths = _numbered(index.in_runs(sizes, seed), batch_size).groupBy("batch_id").agg(
        F.max("n_tokens").alias("edge_width"))
    ends = F.array_distinct(F.array(*(F.floor(at / batch_size) for at in (F.col("start"), F.col("start") + F.col("n") - 1))))
    edges = (index.runs(keys, seed).select("file_key", "block", F.explode(ends).alias("batch_id")).join(widths, "batch_id")
             .groupBy("file_key", "block").agg(F.map_from_entries(F.collect_list(F.struct("batch_id", "edge_width")))
                                               .alias("edges")))
    rows = _numbered(index.in_runs(examples, seed), batch_size)
    inside = rows.withColumn("inside_width", F.max("n_tokens").over(Window.partitionBy("file_key", "block", "batch_id")))
    wide = (inside.join(edges, ["file_key", "block"])
            .withColumn("width", F.coalesce(F.try_element_at("edges", F.col("batch_id")), "inside_width"))
            .drop("edges", "inside_width", "block"))
    return _fill(wide, pad_id)


def _fill(rows: DataFrame, pad_id: int) -> DataFrame:
    width = F.col("width")
    return rows.withColumns({
        "ids": ar.padded(F.col("ids"), width, pad_id, "int"),
        "attention_mask": ar.padded(F.col("attention_mask"), width, ATTENTION_FILL, "boolean"),
        "special_tokens_mask": ar.padded(F.col("special_tokens_mask"), width, SPECIAL_FILL, "boolean"),
        # NULL type ids stay NULL
        "token_type_ids": ar.padded(F.col("token_type_ids"), width, TYPE_FILL, "tinyint")}).drop("width")


def pad_batch(batched: DataFrame, pad_id: int = 0) -> DataFrame:
    """Pad every row to the longest of its batch. A batch is never large."""
    batch = Window.partitionBy("batch_id")
    return _fill(batched.withColumn("width", F.max(F.size("ids")).over(batch)), pad_id)


def pad_file(examples: DataFrame, pad_id: int = 0) -> DataFrame:
    """Pad every row to the longest of its file.

    Widths are aggregated per run of 2**20 rows and then per file, and joined
    back by run, so one large file is spread over many tasks.
    """
    rows = examples.withColumn("block", F.shiftright("example_id", index.BLOCK_BITS))
    blocks = rows.groupBy("file_key", "block").agg(F.max(F.size("ids")).alias("longest"))
    of_file = blocks.groupBy("file_key").agg(F.max("longest").alias("width"))
    widths = blocks.join(of_file, "file_key").select("file_key", "block", "width")
    return _fill(rows.join(widths, ["file_key", "block"]).drop("block"), pad_id)


def to_export(rows: DataFrame) -> DataFrame:
    """Types a trainer reads: 64-bit ids and masks, boolean special mask."""
    return rows.withColumns({
        "ids": F.col("ids").cast("array<bigint>"),
        "attention_mask": F.col("attention_mask").cast("array<bigint>"),
        "token_type_ids": F.col("token_type_ids").cast("array<bigint>")})


def collate(padded: DataFrame, masking: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Padded batches with ``inputs`` and ``labels``; ``masking`` is any
    DataFrame -> DataFrame step that adds the two."""
    return to_export(padded.transform(masking)).select(
        "batch_id", "row_in_batch", "file_key", "example_id", "inputs", "labels", "attention_mask",
        "token_type_ids")
