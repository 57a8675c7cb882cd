"""Queries of this package, one for each operator, over whole tables."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tokenmill.llm import (brown, byte_bpe, hamming, leaks, near_dups, oracle, piecewise, quality, ring, spelling, urls,
                           warc, wavelet, whitening)

#: shards that the documents are put into
SHARDS = 40


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _read(spark, sf_dir, "labels")))


def op2_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.verdicts(_read(spark, sf_dir, "pages"))


def op3_itq_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op4_brown_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(_read(spark, sf_dir, "documents"))


def op5_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.sharded(_read(spark, sf_dir, "documents"), SHARDS)


def op6_chained_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op7_overlapping_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(_read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op8_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(_read(spark, sf_dir, "documents"))


def op11_sturm_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


def op12_spelling_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_read(spark, sf_dir, "documents"))


def op13_piecewise_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise.followed(_read(spark, sf_dir, "documents"))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    queries = [op1_compression_quality, op2_redirect_equivalence, op3_itq_near_dups, op4_brown_bigrams,
               op5_bounded_ring, op6_chained_warc, op7_overlapping_bpe, op8_qgram_decontamination, op9_wavelet_shards,
               op10_hyperminhash, op11_sturm_whitening, op12_spelling_trie, op13_piecewise_hashes]
    return {query.__name__: query for query in queries}


def statements() -> dict[str, str]:
    return oracle.statements()
