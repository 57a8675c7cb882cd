"""Losses and accuracies over scored positions.

Per-batch sums are pre-aggregated before the shuffle; an epoch is the plain mean
of its batches. A batch without active positions is NULL and is left out of it.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: weight of the discriminator's loss in the combined loss
D_LOSS_WEIGHT = 50.0


def accuracy(rows: DataFrame, predicted: str = "token_id", label: str = "label", by: str = "batch_id",
             active: Column | None = None) -> DataFrame:
    """(by, n_active, accuracy) over the active rows."""
    hit = (F.col(predicted) == F.col(label)).cast("double")
    return _means(rows, hit, "accuracy", by, active)


def mean_loss(rows: DataFrame, by: str = "batch_id", active: Column | None = None) -> DataFrame:
    """(by, n_active, loss)."""
    return _means(rows, F.col("loss"), "loss", by, active)


def _means(rows, value, name, by, active) -> DataFrame:
    value = value if active is None else F.when(active, value)
    return rows.groupBy(by).agg(F.count(value).alias("n_active"), F.avg(value).alias(name))


def of_statistics(rows: DataFrame, statistics: str, by: str = "batch_id") -> DataFrame:
    """(by, n_losses, loss, n_labels, accuracy) from examples with the sums of
    :func:`scores.of_examples`: the means of :func:`mean_loss` and :func:`accuracy`."""
    sums = [F.sum(f"{statistics}.{name}").alias(name) for name in ("loss", "n_loss", "hits", "n_labels")]
    mean = [F.try_divide(F.col(total).cast("double"), F.col(count)) for total, count in (("loss", "n_loss"), ("hits", "n_labels"))]
    return rows.groupBy(by).agg(*sums).select(
        by, F.col("n_loss").alias("n_losses"), mean[0].alias("loss"), "n_labels", mean[1].alias("accuracy"))


def perplexity(losses: DataFrame, loss: str = "loss") -> DataFrame:
    return losses.withColumn("perplexity", F.exp(loss))


def combined(g_losses: DataFrame, d_losses: DataFrame, weight: float = D_LOSS_WEIGHT,
             by: str = "batch_id") -> DataFrame:
    """(by, g_loss, d_loss, loss) with loss = g_loss + weight * d_loss."""
    g = g_losses.select(by, F.col("loss").alias("g_loss"))
    d = d_losses.select(by, F.col("loss").alias("d_loss"))
    return g.join(d, by, "full").withColumn("loss", F.col("g_loss") + weight * F.col("d_loss"))


def epoch(batches: DataFrame, *names: str, perplexity_of: str | None = None) -> DataFrame:
    """One row: the mean of each named batch metric, and exp of one mean."""
    means = batches.agg(F.count("*").alias("n_batches"), *[F.avg(n).alias(n) for n in names])
    return means.withColumn("perplexity", F.exp(perplexity_of)) if perplexity_of else means
