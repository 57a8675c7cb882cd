"""Dense row numbers over a whole table without ordering it in one task.

Rows are ranked inside groups of bounded size, and a table of group sizes, far
smaller than the rows, supplies where each group starts.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.functions import draws

#: by default a group is this many consecutive example numbers of a file
BLOCK_BITS = 20

#: blocks of a file are added up in groups of this many block numbers first
GROUP_BITS = 16


def bucket_starts(rows: DataFrame) -> DataFrame:
    """(bucket, start, size) of rows carrying an order-draw ``bucket``.

    At most 2**BUCKET_BITS rows whatever the input, so one window and a
    broadcast are safe.
    """
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"), "size")


def _running(column: str, partition: list[str], *order: str) -> Column:
    before = (Window.partitionBy(*partition).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(F.sum(column).over(before), F.lit(0))


def runs(rows: DataFrame, seed: int) -> DataFrame:
    """(file_key, block, start, n) of rows carrying the ``block`` of their file: where each run
    of a file starts in the seeded order of the files, and its rows."""
    blocks = rows.groupBy("file_key", "block").agg(F.count("*").alias("n"))
    order = draws.order_draw(draws.row_key(seed, "file_key"), F.lit(draws.FILE_ORDER))
    placed = blocks.withColumn("place", order).withColumn("bucket", draws.bucket_of(F.col("place")))
    buckets = placed.groupBy("bucket").agg(F.sum("n").alias("n"))
    # one row per order-draw range: bounded, see bucket_starts
    bucket_start = buckets.select("bucket", F.coalesce(F.sum("n").over(
        Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    # blocks are added up in groups first, so that no window holds all blocks of a file
    placed = placed.withColumn("group", F.shiftright("block", GROUP_BITS))
    groups = placed.groupBy("bucket", "place", "file_key", "group").agg(F.sum("n").alias("n"))
    group_starts = (groups.join(F.broadcast(bucket_start), "bucket")
                    .withColumn("first", F.col("base") + _running("n", ["bucket"], "place", "file_key", "group"))
                    .select("file_key", "group", "first"))
    return (placed.join(group_starts, ["file_key", "group"])
            .withColumn("start", F.col("first") + _running("n", ["file_key", "group"], "block"))
            .select("file_key", "block", "start", "n"))


def in_runs(examples: DataFrame, seed: int = 0, block: Column | None = None) -> DataFrame:
    """:func:`file_order` that keeps ``block``; the rows stay grouped by file and block."""
    block = F.shiftright("example_id", BLOCK_BITS) if block is None else block
    rows = examples.withColumn("block", block)
    inside = Window.partitionBy("file_key", "block").orderBy("example_id")
    return (rows.withColumn("rank", F.row_number().over(inside) - 1)
            .join(runs(rows, seed).drop("n"), ["file_key", "block"])
            .withColumn("global_idx", F.col("start") + F.col("rank")).drop("rank", "start"))


def file_order(examples: DataFrame, seed: int = 0, block: Column | None = None) -> DataFrame:
    """Add ``global_idx``: files in a seeded order, the rows of a file by example_id.

    ``block`` cuts a file into runs of consecutive rows (by default of 2**20
    example numbers), so a file of any length is ranked in pieces.
    """
    return in_runs(examples, seed, block).drop("block")


def in_buckets(examples: DataFrame, seed: int, epoch: int) -> DataFrame:
    """Add ``place``, an order drawn anew for each epoch, and its ``bucket``."""
    place = draws.order_draw(draws.row_key(seed, "file_key"), F.lit(draws.SHUFFLE), F.lit(epoch),
                             F.col("example_id"))
    return examples.withColumn("place", place).withColumn("bucket", draws.bucket_of(F.col("place")))


def ranked(rows: DataFrame) -> DataFrame:
    """Add ``global_idx`` to rows in buckets; they stay grouped by bucket."""
    inside = Window.partitionBy("bucket").orderBy("place", "file_key", "example_id")
    return (rows.withColumn("rank", F.row_number().over(inside) - 1)
            .join(F.broadcast(bucket_starts(rows).drop("size")), "bucket")
            .withColumn("global_idx", F.col("start") + F.col("rank")).drop("rank", "start"))


def random_order(examples: DataFrame, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Add ``global_idx`` in an order drawn anew for each epoch."""
    return ranked(in_buckets(examples, seed, epoch)).drop("place", "bucket")


def rows_at(examples: DataFrame, positions: DataFrame, seed: int = 0) -> DataFrame:
    """The examples at the given ``global_idx`` values of the file order. Only keys are
    ordered; the found ones fetch their rows."""
    keys = lookup(file_order(examples.select("file_key", "example_id"), seed), positions)
    return examples.join(keys, ["file_key", "example_id"])


def lookup(indexed: DataFrame, positions: DataFrame) -> DataFrame:
    """The rows at the given ``global_idx`` values."""
    return indexed.join(positions.select("global_idx").distinct(), "global_idx", "left_semi")
