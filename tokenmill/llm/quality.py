"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on pieces of texts labelled good and one
on pieces of bad ones. A text is cut into pieces of a fixed size, each piece is
compressed with both dictionaries, and the difference of the summed sizes, taken per
compressed byte and per text byte, is turned into a probability by a logistic curve
fitted on labelled texts that gave nothing to the dictionaries. The share of bytes
that remains after compression is the curve's third input: where a text repeats
itself both sizes are next to nothing and their difference says little.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.words import slices
from tokenmill.sources import scratch

#: labelled rows that are learned from at most: those whose key hashes lowest
SAMPLE_ROWS = 16_000

#: pieces of a class that its dictionary is trained on at most, and a piece's bytes
SAMPLE_PIECES, PIECE = 6_000, 1_000

#: bytes of a dictionary, and the compression level
DICTIONARY, LEVEL = 1 << 16, 3

#: a document is good from this score on
THRESHOLD = 0.7

#: bytes of a frame around nothing
_FRAME = 6


@dataclass(frozen=True)
class Model:
    """What the tasks need: the dictionaries and the fitted curve."""

    good: bytes
    bad: bytes
    centre: tuple = (0.0, 0.0, 0.0)
    scale: tuple = (1.0, 1.0, 1.0)
    weights: tuple = (0.0, 0.0, 0.0, 0.0)

    def probability(self, features: np.ndarray) -> np.ndarray:
        scaled = (features - np.array(self.centre)) / np.array(self.scale)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + scaled @ np.array(self.weights[1:]), -500, 500)))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _dictionary(pieces: list[bytes]) -> bytes:
    """A trained dictionary, or the pieces themselves where they are too few to train."""
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(pieces)[-DICTIONARY:]


def _compressor(dictionary: bytes):
    if len(dictionary) < 8:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False)


def _features(texts: pa.Array, good, bad) -> np.ndarray:
    rows = np.zeros((len(texts), 3))
    for row, text in zip(rows, texts.cast(pa.binary()), strict=True):
        content = text.as_py() or b""
        size_good = size_bad = 0
        for start in range(0, len(content), PIECE):
            piece = content[start:start + PIECE]
            size_good += len(good.compress(piece)) - _FRAME
            size_bad += len(bad.compress(piece)) - _FRAME
        if content:
            row[:] = ((size_bad - size_good) / max(size_bad + size_good, 1),
                      (size_bad - size_good) / len(content), (size_bad + size_good) / len(content))
    return rows


def _pieces(batches):
    for batch in slices(batches):
        for text in batch.column("text").cast(pa.binary()):
            content = text.as_py()
            yield pa.RecordBatch.from_arrays(
                [pa.array([content[i:i + PIECE] for i in range(0, len(content), PIECE)], pa.binary())], ["piece"])


def _measured(model: Model, scored: bool):
    def run(batches):
        good, bad = _compressor(model.good), _compressor(model.bad)
        for batch in slices(batches):
            features = _features(batch.column("text"), good, bad)
            kept = [c for c in batch.schema.names if c != "text"]
            found = [model.probability(features)] if scored else list(features.T)
            names = ["score"] if scored else ["a", "b", "c"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), *(pa.array(x, pa.float64()) for x in found)], [*kept, *names])
    return run


def _fitted(features: np.ndarray, labels: np.ndarray) -> dict:
    """A logistic curve by Newton's method with a light ridge."""
    centre, scale = features.mean(axis=0), features.std(axis=0) + 1e-9
    rows = np.column_stack([np.ones(len(features)), (features - centre) / scale])
    weights, ridge = np.zeros(rows.shape[1]), 1e-2 * np.eye(rows.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -500, 500)))
        bend = (rows * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ rows + ridge
        weights = weights + np.linalg.solve(bend, rows.T @ (labels - p) - ridge @ weights)
    return {"centre": tuple(centre), "scale": tuple(scale), "weights": tuple(weights)}


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the labelled rows that are not held out, ``sample_rows`` at most.

    ``labels`` has doc_id and quality; rows whose quality is neither 0 nor 1 and
    documents without a text teach nothing. A missing class or a sample too small to
    fit a curve gives a constant score, the share of good rows.
    """
    place = F.xxhash64(F.col("doc_id").cast("string"), F.lit("order"))
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
    sample = (known.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
              .orderBy(place, "doc_id", "quality").limit(sample_rows))
    texts = scratch.table(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text <> ''")
                          .join(F.broadcast(sample), "doc_id"), "labelled")  # sample_rows at most
    texts = (texts.withColumn("for_curve", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("fold")), 2) == 1))

    def pieces(quality: int) -> list[bytes]:
        cut = (texts.where((F.col("quality") == quality) & ~F.col("for_curve")).select("text")
               .mapInArrow(_pieces, "piece binary"))
        rows = cut.orderBy(F.xxhash64("piece"), "piece").limit(SAMPLE_PIECES)
        return [bytes(row.piece) for row in rows.collect()]

    model = Model(*(_dictionary(pieces(quality)) for quality in (1, 0)))
    curve = texts.where("for_curve").select("quality", "text").mapInArrow(
        _measured(model, scored=False), "quality int, a double, b double, c double")
    rows = np.array([tuple(r) for r in curve.orderBy("a", "b", "c", "quality").limit(sample_rows).collect()], float)
    rows = rows.reshape(-1, 4)
    if len(rows) and model.good and model.bad and 0 < rows[:, 0].mean() < 1:
        return Model(model.good, model.bad, **_fitted(rows[:, 1:], rows[:, 0]))
    good, seen = sample.agg(F.coalesce(F.sum("quality"), F.lit(0)), F.count("quality")).first()
    share = (good + 0.5) / (seen + 1)
    return Model(model.good, model.bad, weights=(float(np.log(share / (1 - share))), 0.0, 0.0, 0.0))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    A NULL or empty text has no compressed size: its differences and sizes are 0 and it
    gets the curve's value there. A NULL doc_id stays NULL and is not held out.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = rows.mapInArrow(_measured(model, scored=True), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` predicted good, with all their columns. Only texts go to Python,
    and only verdicts come back."""

    @F.arrow_udf("boolean")
    def is_good(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        good, bad = _compressor(model.good), _compressor(model.bad)
        for texts in batches:
            yield pa.array(model.probability(_features(texts, good, bad)) >= THRESHOLD)

    return docs.where(is_good(F.col("text").cast("string")))
