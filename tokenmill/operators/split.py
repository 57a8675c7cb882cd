"""Exact-count train/val/test split by file.

Files are ordered by a keyed draw and cut at exact ranks. The cuts are found
first, as values of the ordering; after that the split of any row is a
comparison with three constants, without a join or a shuffle.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.functions import draws
from tokenmill.operators.index import bucket_starts

NAMES = ("train", "val", "test")


def _place(seed: int) -> Column:
    return draws.order_draw(draws.row_key(seed, "file_key"), F.lit(draws.SPLIT))


def cuts(files: DataFrame, train: float, val: float, test: float | None, seed: int) -> DataFrame:
    """One row (cuts): per split the ordering value (place, file_key) it ends before.

    NULL where a split reaches the end of the files. Only the at most three
    buckets of the ordering that hold a cut are ranked.
    """
    placed = (files.select("file_key").distinct().withColumn("place", _place(seed))
              .withColumn("bucket", draws.bucket_of(F.col("place"))))
    starts = bucket_starts(placed)
    everything = F.sum("size").over(Window.orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)).cast("double")

    def share(fraction):
        return F.floor(F.col("n") * F.lit(float(fraction)))

    ends = [share(train), share(train) + share(val)]
    if test:
        ends.append(share(train) + share(val) + share(test))
    marks = F.array(*[F.struct(F.lit(name).alias("split"), (end - F.col("start")).alias("rank"))
                      for name, end in zip(NAMES, ends)])
    # the cuts that fall into a bucket, by their rank inside it; at most three in all
    held = (starts.withColumn("n", everything)
            .select("bucket", "size", F.explode(marks).alias("mark")).select("bucket", "size", "mark.*")
            .where((F.col("rank") >= 0) & (F.col("rank") < F.col("size"))).drop("size"))
    inside = Window.partitionBy("bucket", "split").orderBy("place", "file_key")
    found = (placed.join(F.broadcast(held), "bucket")
             .withColumn("at", F.row_number().over(inside) - 1).where("at = rank"))
    return found.agg(F.struct(*[
        F.max(F.when(F.col("split") == name, F.struct("place", "file_key"))).alias(name)
        for name in NAMES]).alias("cuts"))


def assign(rows: DataFrame, files: DataFrame, train: float = 0.8, val: float = 0.1,
           test: float | None = None, seed: int = 0) -> DataFrame:
    """Add ``split`` to rows carrying ``file_key``; files are never divided.

    The first ``int(n * train)`` files, the next ``int(n * val)``, and the rest
    (or the next ``int(n * test)``, and NULL for what is left then).
    """
    keyed = (rows.withColumn("cuts", cuts(files, train, val, test, seed).scalar())
             .withColumn("place", _place(seed)))
    here = F.struct("place", "file_key")
    split = F.lit(None).cast("string") if test else F.lit("test")
    for name in reversed(NAMES if test else NAMES[:2]):
        split = F.when(F.coalesce(here < F.col(f"cuts.{name}"), F.lit(True)), F.lit(name)).otherwise(split)
    return keyed.withColumn("split", split).drop("cuts", "place")
