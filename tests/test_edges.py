"""Nothing is lost or done twice at the edges: NULL sizes and texts, bad bytes, odd file
names, new checkpoints, unfinished batches, large vocabularies, hot files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenmill.operators import encode, index, lines, scores, segments, stats
from tokenmill.plans import corpus, training
from tokenmill.sources import cache, files as fs
from tokenmill.streaming import tokenize as stream

SHAPE = "file_key string, text string, n_chars long"


def test_null_sizes_and_texts_are_files(spark, tokenizer):
    rows = spark.createDataFrame([("a", "the cat\nsat", 11), ("b", "the cat\nsat", None), ("c", None, None),
                                  ("d", None, 40), ("e", "", 0)], SHAPE)
    for limit in (5, 1 << 24):
        made = segments.examples(rows, tokenizer, two_segments=False, big_file_chars=limit)
        found = {}
        for r in made.collect():
            found.setdefault(r.file_key, []).append(tuple(r.ids))
        assert sorted(found["a"]) == sorted(found["b"]) and set(found) == {"a", "b"}
        counts = {r.file_key: r.num_examples for r in stats.corpus(rows, tokenizer, big_file_chars=limit).collect()}
        assert counts == {"a": 2, "b": 2, "c": 0, "d": 0, "e": 0}
    assert {r.file_key for r in lines.raw_lines(rows).collect()} == {"a", "b"}
    assert {r.file_key: r.text for r in lines.texts(rows, 1).collect() if r.file_key in "cde"} == dict.fromkeys("cde", ".")


@pytest.fixture
def folder(tmp_path):
    where = tmp_path / "in"
    where.mkdir()
    (where / "a%b é.txt").write_text("the cat\nsat\n")
    (where / "plain.txt").write_bytes("﻿the cat\nsat\n".encode())
    (where / "bad.txt").write_bytes(b"the cat\nsa\xc3\x28t\n")
    return where


def test_every_reader_gives_a_file_the_same_key_and_text(spark, folder):
    good, bad = fs.decode(fs.read_binary(spark, str(folder)))
    assert [r.file_key.rsplit("/", 1)[1] for r in bad.collect()] == ["bad.txt"]
    whole = {(r.file_key, r.line) for r in lines.clean_lines(good).collect()}
    assert whole == {(r.file_key, r.line) for r in fs.read_lines(spark, str(folder)).collect()}
    assert len({k for k, _ in whole}) == 2


def test_stream_equals_batch_and_outlives_its_checkpoint(spark, folder, tokenizer, tmp_path):
    out = str(tmp_path / "out")

    def run(checkpoint):
        stream.tokenize(stream.read_texts(spark, str(folder)), tokenizer, out, str(tmp_path / checkpoint),
                        two_segments=False).awaitTermination()
        return sorted((r.file_key, tuple(r.ids)) for r in cache.read(spark, out).collect())
    good, _ = fs.decode(fs.read_binary(spark, str(folder)))
    batch = sorted((r.file_key, tuple(r.ids)) for r in segments.examples(good, tokenizer, two_segments=False).collect())
    assert run("first") == batch and len(batch) == 4
    (folder / "later.txt").write_text("mat\n")
    assert len(run("second")) == 5 and len(run("first")) == 5


class Counting:
    """An encoder that counts the texts it sees, over all tasks."""

    def __init__(self, spark):
        self.seen = seen = spark.sparkContext.accumulator(0)
        from tokenmill.operators.encode import Tokenizer, list_encoder

        def factory():
            def encode_texts(texts):
                seen.add(len(texts))
                return [[5 + len(t) % 90] for t in texts]
            return list_encoder(encode_texts)
        self.tokenizer = Tokenizer(factory, vocab_size=100)

    def taken(self):
        before, self.last = getattr(self, "last", 0), self.seen.value
        return self.last - before


@pytest.mark.parametrize("shuffle", [True, False])
def test_raw_lines_are_encoded_once(spark, files, shuffle):
    counting = Counting(spark)
    texts = files({f"f{i}": "a\nbb\n\nccc" for i in range(10)})
    assert training.line_loader(texts, counting.tokenizer, batch_size=4, shuffle=shuffle).count() == 40
    training.line_loader(texts, counting.tokenizer, batch_size=4, shuffle=shuffle).collect()
    assert counting.taken() <= 2 * 40


@pytest.mark.parametrize("limit", [5, 1 << 24])
@pytest.mark.parametrize("use_overflow", [False, True])
def test_pairing_encodes_once(spark, files, limit, use_overflow):
    counting = Counting(spark)
    texts = files({f"f{i}": "a\nbb\nccc\ndddd" for i in range(10)})
    segments.examples(texts, counting.tokenizer, use_overflow=use_overflow, big_file_chars=limit).collect()
    assert counting.taken() == 40


def test_a_second_run_encodes_nothing_and_unfinished_batches_go(spark, files, tmp_path):
    counting, path = Counting(spark), str(tmp_path / "cache")
    texts = files({"none": "", "one": "a", "two": "a\nbb"})
    first = corpus.tokenize_and_cache(texts, counting.tokenizer, path).count()
    assert first == 1 and counting.taken() == 3
    found = {r.file_key: r.num_examples for r in cache.manifest(spark, path).collect()}
    assert found == {"none": 0, "one": 0, "two": 1}
    cache.read(spark, path).write.parquet(f"{path}/batch=unfinished")
    assert cache.read(spark, path).count() == 1  # what is not committed is not seen
    assert corpus.tokenize_and_cache(texts, counting.tokenizer, path).count() == 1
    assert counting.taken() == 0


def test_sampling_from_a_large_vocabulary(spark):
    size, draws = 250_000, [0.0, 0.25, 0.5, 0.75, 0.99]
    rows = spark.createDataFrame([(d,) for d in draws], "share double").select(
        "share", F.array_repeat(F.lit(0.0).cast("float"), size).alias("logits"))
    pick = F.floor(F.col("share") * (1 << 32)).cast("long")
    found = rows.select("share", scores._over_logits(scores._pick, pick).alias("at")).collect()
    assert {r.share: r.at for r in found} == {d: int(d * (1 << 32)) * size >> 32 for d in draws}
    last = rows.limit(1).select(scores._over_logits(scores._pick, F.lit((1 << 32) - 1)).alias("at")).first().at
    assert last == size - 1


def test_unlikely_tokens_can_be_drawn(spark):
    rows = spark.createDataFrame([([0.0, -30.0],), ([-30.0, 0.0, 1.0],)], "logits array<float>")
    found = rows.select(scores._over_logits(scores._pick, F.lit((1 << 32) - 1)).alias("at")).collect()
    assert [r.at for r in found] == [0, 2]
    assert np.floor(np.exp(-30.0) * 2.0 ** (scores.WEIGHT_BITS - 2)) > 0


def test_a_hot_file_of_overflow_examples_is_ordered_in_groups(spark):
    rows = spark.range(3000).select(F.lit("hot").alias("file_key"), F.shiftleft(
        F.col("id"), encode.CHUNK_BITS).alias("example_id")).repartition(4)
    found = index.file_order(rows).sort("global_idx").collect()
    assert [r.global_idx for r in found] == list(range(3000))
    assert [r.example_id >> encode.CHUNK_BITS for r in found] == list(range(3000))
    wanted = spark.createDataFrame([(5,), (2999,), (3000,)], "global_idx long")
    assert sorted(r.global_idx for r in index.rows_at(rows.withColumn("x", F.lit(1)), wanted).collect()) == [5, 2999]
