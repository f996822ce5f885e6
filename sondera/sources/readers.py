"""Readers for the metadata and vector sources."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..session import arrow_map
from . import stores

FRAME = "STRUCT<status STRING, frame_index INT, file STRING, score DOUBLE, bbox ARRAY<DOUBLE>, crop_box ARRAY<INT>>"
MANIFEST = f"source STRING, label INT, label_csv STRING, split STRING, fps DOUBLE, frame_count INT, settings MAP<STRING, STRING>, frames ARRAY<{FRAME}>"


def _levels() -> Column:
    """Names along a file's path, with what the URI of the path escapes put back."""
    return F.transform(F.split(F.col("_metadata.file_path"), "/"), lambda x: F.url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))))


def label_csv(spark: SparkSession, path: str) -> DataFrame:
    """(filename, label) of CSV with a header, with or without a byte-order mark; another label than 0 or 1 is an error."""
    rows = spark.read.schema("filename STRING, label INT").csv(path, header=True, mode="FAILFAST")
    ok = F.col("label").isin(0, 1)
    return rows.withColumn("label", F.when(ok, F.col("label")).otherwise(F.raise_error(F.concat(F.lit("label of "), F.col("filename"))).cast("int")))


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """(part, video, source, label, ..., frames) of <root>/<part>/<video>/metadata.json; ids come from the path."""
    rows = spark.read.schema(MANIFEST).json(f"{root}/*/*/metadata.json", multiLine=True)
    level = _levels()
    return rows.select(F.element_at(level, -3).alias("part"), F.element_at(level, -2).alias("video"), *rows.columns)


def part_metadata(spark: SparkSession, root: str) -> DataFrame:
    """(part, filename, label, original) of <root>/<part>/metadata.json, each a map by filename."""
    text = spark.read.text(f"{root}/*/metadata.json", wholetext=True)
    part = F.element_at(_levels(), -2)
    entries = F.from_json("value", "MAP<STRING, STRUCT<label STRING, original STRING>>", {"mode": "FAILFAST"})
    return text.select(part.alias("part"), F.explode(entries).alias("filename", "m")).select("part", "filename", "m.label", "m.original")


def name_list(spark: SparkSession, path: str) -> DataFrame:
    """(name): the second white-space field of each line that is not blank (it may hold blanks itself)."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return lines.select(F.split(F.ltrim("value"), r"\s+", 2)[1].alias("name"))


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, size, modified) of the files under a folder; no content is read. Spark does not list files of no bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def stem_index(files: DataFrame) -> DataFrame:
    """(stem, paths): the files of each stem."""
    return files.groupBy(paths.stem(F.col("path")).alias("stem")).agg(F.array_sort(F.collect_list("path")).alias("paths"))


def file_digests(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, sha256) of the files under a folder, each read in a task in chunks, so that files may be of any size."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([stores.digest(path)])], ["path", "sha256"])

    paths_ = listing(spark, root, pattern).select("path")
    return arrow_map(paths_.repartition("path"), run, "path string, sha256 string")


def parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Features, bank, evidence and region tables."""
    rows = spark.read.parquet(path)
    return rows.select(*columns) if columns else rows
