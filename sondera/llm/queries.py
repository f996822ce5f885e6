"""Queries over the driver's tables, one per operator, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, licenses, linededup, merkle, mixing, neardup, ngram_lm, pii, quality, sharding, tokens, trie, wrappers
from .common import read_documents, scratch_folder


#: The key of the registered query, whose pseudonyms protect nobody.
TEST_KEY = "public-test-key"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read_documents(spark, sf_dir), TEST_KEY)


def op2_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.plan(read_documents(spark, sf_dir)))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_documents(spark, sf_dir))


def op4_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_documents(spark, sf_dir))


def op5_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read_documents(spark, sf_dir))
    return found.withColumn("n_spans", F.size("spans").cast("long")).drop("spans")


def op7_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_documents(spark, sf_dir), 40, path=scratch_folder(spark, "slot-map"))


def op8_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(read_documents(spark, sf_dir))


def op9_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(read_documents(spark, sf_dir))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_tokens(*tokens.write_tokens(read_documents(spark, sf_dir), tokenizer_path()))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    return merkle.digest(merkle.manifest(docs, merkle.lowered(docs)))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_pii, op2_curriculum, op3_minhash, op4_divergence, op5_lemma, op6_automaton, op7_slots, op8_backoff, op9_winnow, op10_flat, op11_manifest, op12_trie, op13_wrapper)
    return {f.__name__: f for f in (*ops, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op2_curriculum": mixing.oracle(), "op3_minhash": neardup.oracle(), "op8_backoff": ngram_lm.oracle(), "op9_winnow": linededup.oracle(), "op11_manifest": merkle.oracle(), "op12_trie": trie.oracle()}
