"""Documents to token ids: quality filter, near-duplicate removal, benchmark
decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns the documents it lets pass, with the
columns of ``documents``; the last one returns their ids. ``run`` writes every stage's
result as Parquet in the shared folder and reads it again for the next, so a lost
executor repeats no more than one stage's tasks.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tokenmill.llm import byte_bpe, leaks, near_dups, quality
from tokenmill.sources import scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted good by the compression classifier, learned from the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, quality.train(docs, labels))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id."""
    return near_dups.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return leaks.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every document left."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(docs, path, public_tokenizers.PATTERN, "ids")


STAGES = [("quality classifier", quality_classifier),
          ("MinHash near-dedup", minhash_near_dedup),
          ("benchmark decontamination", benchmark_decontamination),
          ("byte-level BPE encoding and decoding", byte_level_bpe)]

#: no stage can be written in SQL; the tests compare run() with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        docs, path = scratch.placed(stage(spark, docs, sf_dir), "stage")
        if before:
            scratch.remove(spark, before)
        before = path
    return docs
