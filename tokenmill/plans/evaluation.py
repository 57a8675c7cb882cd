"""Replaced-token detection over score tables, and the metrics of an epoch."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.functions import draws
from tokenmill.functions.arrays import bound
from tokenmill.operators import corrupt, masking, metrics, scores


def corrupted(masked: DataFrame, g_scores: DataFrame, candidates: str | None = None, seed: int = 0,
              epoch: int = 0) -> DataFrame:
    """Masked examples with ``d_inputs`` and ``d_labels`` from sampled generator scores."""
    samples = scores.sample(g_scores, candidates, seed, epoch)
    return corrupt.corrupt(corrupt.attach(masked, samples))


def corrupted_rows(scored: DataFrame, candidates: str | None = None, seed: int = 0, epoch: int = 0) -> DataFrame:
    """As :func:`corrupted` for masked examples that carry their scores (pos, label, logits and the
    candidates), without explode, group or join; ``g`` has the statistics of the generator."""
    key = masking.example_key(seed, draws.SAMPLE, epoch)
    drawn = scored.withColumn("draw", bound(key, lambda k: F.transform("pos", lambda p: draws.draw(k, p))))
    judged = drawn.withColumn("g", scores.of_examples("logits", "label", candidates, "draw"))
    named = judged.withColumn("sampled", corrupt.sampled("pos", "g.drawn"))
    return corrupt.corrupt(named).drop("pos", "label", "logits", "draw", *([candidates] if candidates else []))


def epoch_of_statistics(examples: DataFrame, weight: float = metrics.D_LOSS_WEIGHT) -> DataFrame:
    """As :func:`epoch_metrics`, from examples with the statistics ``g`` and ``d`` of
    :func:`scores.of_examples`: sums of six numbers a batch, added up before the one shuffle."""
    sums = [F.sum(f"{side}.{name}").alias(f"{side}_{name}")
            for side in "gd" for name in ("loss", "n_loss", "hits", "n_labels")]
    means = [F.try_divide(F.col(f"{side}_{total}").cast("double"), F.col(f"{side}_{count}")).alias(name)
             for side in "gd" for total, count, name in (("loss", "n_loss", f"{side}_loss"), ("hits", "n_labels", f"{side}_acc"))]
    batches = examples.groupBy("batch_id").agg(*sums).select("batch_id", *means)
    both = batches.withColumn("loss", F.col("g_loss") + weight * F.col("d_loss"))
    return metrics.epoch(both, "loss", "g_loss", "d_loss", "g_acc", "d_acc", perplexity_of="g_loss")


def generator_metrics(g_scores: DataFrame, candidates: str | None = None) -> DataFrame:
    """(batch_id, loss, accuracy) over labelled positions."""
    scored = scores.log_loss(scores.argmax(g_scores, candidates), candidates)
    return _per_batch(scored)


def discriminator_metrics(d_scores: DataFrame) -> DataFrame:
    """(batch_id, loss, accuracy) over attended positions."""
    scored = scores.log_loss(scores.argmax(d_scores))
    return _per_batch(scored.where("attention_mask"))


def _per_batch(scored: DataFrame) -> DataFrame:
    hit = (F.col("token_id") == F.col("label")).cast("double")
    return scored.groupBy("batch_id").agg(F.avg("loss").alias("loss"), F.avg(hit).alias("accuracy"))


def epoch_metrics(g_batches: DataFrame, d_batches: DataFrame,
                  weight: float = metrics.D_LOSS_WEIGHT) -> DataFrame:
    """One row of epoch means, and the perplexity of the mean generator loss."""
    g = g_batches.select("batch_id", F.col("loss").alias("g_loss"), F.col("accuracy").alias("g_acc"))
    d = d_batches.select("batch_id", F.col("loss").alias("d_loss"), F.col("accuracy").alias("d_acc"))
    both = g.join(d, "batch_id", "full").withColumn("loss", F.col("g_loss") + weight * F.col("d_loss"))
    return metrics.epoch(both, "loss", "g_loss", "d_loss", "g_acc", "d_acc", perplexity_of="g_loss")
