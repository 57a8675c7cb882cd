"""The stream gives what the batch job gives, once."""

from pyspark.sql import Observation

from tokenmill.operators import segments, stats
from tokenmill.plans.queries import registered
from tokenmill.sources import cache
from tokenmill.streaming import tokenize as stream


def test_stream_equals_batch_and_resumes(spark, files, tokenizer, tmp_path):
    texts, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    texts.mkdir()

    def run():
        stream.tokenize(stream.read_texts(spark, str(texts)), tokenizer, out, checkpoint, seed=4,
                        max_length=16).awaitTermination()
        return sorted((r.file_key.rsplit("/", 1)[1], r.seg_a_id, r.seg_b_id, tuple(r.ids))
                      for r in cache.read(spark, out).collect())

    (texts / "a.txt").write_text("the cat\nsat\non\nthe mat")
    first = run()
    assert len(first) == 2 and run() == first
    (texts / "b.txt").write_text("a\nb\n")
    second = run()
    assert len(second) == 3 and set(first) < set(second)
    keys = {r.file_key for r in cache.read(spark, out).select("file_key").collect()}
    whole = files({k: (texts / k.rsplit("/", 1)[1]).read_text() for k in keys})
    batch = segments.examples(whole, tokenizer, 4, max_length=16)
    assert sorted((r.file_key.rsplit("/", 1)[1], r.seg_a_id, r.seg_b_id, tuple(r.ids)) for r in batch.collect()) == second


def test_progress_counts(files, tokenizer):
    made = segments.examples(files({"f": "the cat\nsat"}), tokenizer)
    progress = Observation()
    stats.observed(made, progress).collect()
    assert progress.get == {"num_examples": 1, "num_tokens": 6}
    assert {r.file_key: (r.num_examples, r.num_tokens) for r in stats.cached(made).collect()} == {"f": (1, 6)}


def test_streamed_table_may_be_a_folder(spark, tmp_path):
    """Large tables are folders of files; these were not found by the table's name."""
    rows = spark.createDataFrame([(i, "The cat.\nA mat.\nIt sat.\nOn.", 28) for i in range(6)], "doc_id long, text string, n_chars long")
    rows.repartition(3).write.parquet(str(tmp_path / "folder" / "documents.parquet"))
    (tmp_path / "file").mkdir()
    part, = tmp_path.glob("folder/documents.parquet/part-00000*.parquet")
    (tmp_path / "file" / "documents.parquet").write_bytes(part.read_bytes())
    for name, n in (("folder", 6), ("file", spark.read.parquet(str(part)).count())):
        found = registered()["stream_tokenize"](spark, str(tmp_path / name))
        assert found.select("file_key").distinct().count() == n
