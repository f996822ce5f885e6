"""A corpus pipeline: each stage works on what the one before kept, written as Parquet in the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sondera.llm import decontam, mixing, neardup, quality, tokens
from sondera.llm.common import discard, materialise
from sondera.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the divergence verdict. Null, empty and blank texts fail the base rules and go; very
    long texts are judged whole; repeated rows and rows without a doc_id are judged each for itself. Columns stay as they are, other
    ones too; no rows give none."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near duplicates; of rows of one doc_id one. Texts without words and
    rows without a doc_id are linked with nothing and stay. Very long texts are compared whole. Columns stay as they are, other
    ones too; no rows give none."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts hold none and stay, as do repeated rows and rows without a
    doc_id if their texts are clean; very long texts are searched whole. Columns stay as they are, other ones too; no rows give
    none."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in the order of its training positions. Texts without words are not taken; a null
    source is a source of its own; rows of one doc_id and source occur together; ties go by doc_id. Columns stay as they are, other
    ones too; no rows give none."""
    return mixing.mix_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' documents: doc_id, start, n_tokens, ids_crc32. Documents stand in the files as the rows of docs stand in
    theirs, which is the curriculum of the stage before; rows that come from no file stand by doc_id. Null and empty texts have
    the end id alone; repeated rows are documents of their own; very long texts are encoded whole. Other columns are not read;
    no rows give none."""
    return tokens.read_tokens(*tokens.write_tokens(docs, tokenizer_path(), order=tokens.stored_order(docs)))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_output", token_output),
]

#: SQL cannot express the divergence, shingle, alignment and encoding stages; tests/llm holds the run against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn. A stage's rows are written before the next one begins, and go when that has written its own."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
