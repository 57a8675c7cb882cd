"""The cache's versions and leases, and runs that read only what is new."""

import os

import pytest

from tokenmill.operators import segments, stats
from tokenmill.plans import corpus
from tokenmill.sources import cache, files as sources, log
from tokenmill.streaming import tokenize as stream


def counts(rows):
    return sorted((r.file_key, r.num_examples) for r in stats.cached(rows).collect())


@pytest.fixture
def add(spark, files, tokenizer):
    def run(path, texts, batch):
        rows = files(texts)
        cache.add(rows, segments.examples(rows, tokenizer, two_segments=False), path, batch)
    return run


def test_readers_see_finished_batches_of_a_version(spark, add, tmp_path):
    path = str(tmp_path / "cache")
    add(path, {"a": "the cat\nsat"}, "one")
    add(path, {"b": "on"}, "two")
    assert log.batches(spark, path) == ["one", "two"] and log.version(spark, path) == 2
    assert counts(cache.read(spark, path, version=1)) == [("a", 2)]
    assert counts(cache.read(spark, path)) == [("a", 2), ("b", 1)]
    assert [r.file_key for r in cache.manifest(spark, path, 1).collect()] == ["a"]
    add(path, {"b": "on\non\non"}, "two")  # replayed: it is part of the cache already
    assert counts(cache.read(spark, path)) == [("a", 2), ("b", 1)]


def test_dead_batch_is_not_read_and_is_removed(spark, add, files, tokenizer, tmp_path):
    """A job that died between its examples and its commit doubles nothing."""
    path, texts = str(tmp_path / "cache"), {"a": "the cat\nsat\non"}
    add(path, {"z": "mat"}, "first")
    log.begin(spark, path, "dead", seconds=-1)
    segments.examples(files(texts), tokenizer, two_segments=False).write.parquet(f"{path}/batch=dead")
    assert counts(cache.read(spark, path)) == [("z", 1)]
    add(path, texts, "again")
    assert counts(cache.read(spark, path)) == [("a", 3), ("z", 1)]
    cache.tidy(spark, path)
    assert not os.path.exists(f"{path}/batch=dead") and counts(cache.read(spark, path)) == [("a", 3), ("z", 1)]
    with pytest.raises(log.LeaseLost):  # should its writer live after all
        log.commit(spark, path, "dead")


def test_live_batch_is_spared(spark, add, files, tokenizer, tmp_path):
    """A batch that is written but not committed survives another job's cleaning."""
    path = str(tmp_path / "cache")
    add(path, {"z": "mat"}, "first")
    log.begin(spark, path, "live")
    rows = segments.examples(files({"a": "the cat\nsat"}), tokenizer, two_segments=False)
    rows.write.parquet(f"{path}/batch=live")
    corpus.tokenize_and_cache(files({"b": "on"}), tokenizer, path, two_segments=False)
    assert counts(cache.read(spark, path)) == [("b", 1), ("z", 1)]
    assert log.commit(spark, path, "live") == 3
    assert counts(cache.read(spark, path)) == [("a", 2), ("b", 1), ("z", 1)]
    cache.tidy(spark, path)
    assert counts(cache.read(spark, path)) == [("a", 2), ("b", 1), ("z", 1)]


def test_versions_are_summed_up(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(log, "SUMMARY", 3)
    path = str(tmp_path)
    for n in range(8):
        log.begin(spark, path, f"b{n}")
        assert log.commit(spark, path, f"b{n}") == n + 1
    assert log.batches(spark, path) == [f"b{n}" for n in range(8)]
    assert [log.batches(spark, path, n) for n in (0, 2, 3, 7)] == [[f"b{k}" for k in range(n)] for n in (0, 2, 3, 7)]
    assert "000000000006.all" in os.listdir(f"{path}/_log")
    assert not log._create(spark, f"{path}/_log/000000000002", "late") and log.batches(spark, path, 2) == ["b0", "b1"]


@pytest.fixture
def tree(tmp_path):
    folder = tmp_path / "texts"
    (folder / "deep er").mkdir(parents=True)
    (folder / "a.txt").write_text("the cat\nsat")
    (folder / "deep er" / "b%20[1]ü.txt").write_text("on\nthe\nmat")
    (folder / "bad.txt").write_bytes(b"ok \xc3\x28")
    (folder / "empty.txt").write_bytes(b"")
    return folder


def test_second_run_opens_no_finished_file(spark, tokenizer, tree, tmp_path):
    path, seen = str(tmp_path / "cache"), {}
    options = dict(two_segments=False, max_length=16)
    made = corpus.tokenize_tree(spark, str(tree), tokenizer, path, progress=seen.__setitem__, **options)
    assert sorted(r.num_examples for r in stats.cached(made).collect()) == [2, 3]
    manifest = {r.file_key.rsplit("/", 1)[1]: (r.num_examples, r.rejected) for r in cache.manifest(spark, path).collect()}
    assert manifest == {"a.txt": (2, False), "b%2520%5B1%5Dü.txt": (3, False), "bad.txt": (0, True)}  # Spark skips empty files
    [totals] = seen.values()
    assert totals == {"num_examples": 5, "num_tokens": sum(r.num_tokens for r in cache.manifest(spark, path).collect())}
    for name in ("a.txt", "deep er/b%20[1]ü.txt", "bad.txt"):
        os.truncate(tree / name, 3 << 30)  # no row can hold 3 GB, so opening one of them fails
    (tree / "new.txt").write_text("sat")
    seen.clear()
    again = corpus.tokenize_tree(spark, str(tree), tokenizer, path, progress=seen.__setitem__, **options)
    assert sorted(r.num_examples for r in stats.cached(again).collect()) == [1, 2, 3]
    assert [t["num_examples"] for t in seen.values()] == [1]
    seen.clear()
    assert corpus.tokenize_tree(spark, str(tree), tokenizer, path, progress=seen.__setitem__, **options).count() == 6
    assert seen == {}
    with pytest.raises(Exception, match="(?i)length|exceed"):
        sources.read_binary(spark, str(tree)).collect()


def test_batches_of_a_tree(spark, tokenizer, tree, tmp_path):
    options = dict(two_segments=False, max_length=16)
    whole = corpus.tokenize_tree(spark, str(tree), tokenizer, str(tmp_path / "whole"), **options)
    for name, limits in (("files", dict(batch_files=1)), ("bytes", dict(batch_bytes=16))):
        path = str(tmp_path / name)
        parted = corpus.tokenize_tree(spark, str(tree), tokenizer, path, **limits, **options)
        assert sorted(map(str, parted.collect())) == sorted(map(str, whole.collect()))
        assert len(log.batches(spark, path)) == (3 if name == "files" else 2)


def test_listing_reads_no_content(spark, tree):
    listed = sources.listing(spark, str(tree))
    assert {r.n_bytes for r in listed.collect()} == {11, 10, 5}
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<modificationTime:timestamp,length:bigint>" in plan


def test_stream_in_several_micro_batches_beside_a_batch_job(spark, tokenizer, tree, tmp_path):
    path, options = str(tmp_path / "cache"), dict(two_segments=False, max_length=16)

    def run():
        stream.tokenize(stream.read_texts(spark, str(tree), files_per_batch=1), tokenizer, path,
                        str(tmp_path / "checkpoint"), **options).awaitTermination()
        return sorted(r.num_examples for r in stats.cached(cache.read(spark, path)).collect())

    corpus.tokenize_tree(spark, str(tree / "deep er"), tokenizer, path, **options)
    assert run() == [2, 3]
    (tree / "c.txt").write_text("mat")
    (tree / "d.txt").write_text("mat\nmat\nmat\nmat")
    assert run() == [1, 2, 3, 4] == run()
    assert len(log.batches(spark, path)) >= 4


@pytest.mark.parametrize("big_file_chars", [1 << 24, 1])
def test_files_with_equal_keys_are_refused(spark, files, tokenizer, tmp_path, big_file_chars):
    twice = files({"a": "one\ntwo"}).union(files({"a": "three\nfour"}))
    made = segments.examples(twice, tokenizer, big_file_chars=big_file_chars)
    with pytest.raises(ValueError, match="key a"):
        cache.add(twice, made, str(tmp_path / "cache"), "b")
    assert not log.batches(spark, str(tmp_path / "cache"))
    with pytest.raises(ValueError, match="key a"):
        corpus.tokenize_and_cache(twice, tokenizer, str(tmp_path / "cache"))
