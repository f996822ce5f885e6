"""A bank as arrays aligned by row number: vectors in half or single precision, and whole numbers beside them, in a tensor container.
A completion record, written last, holds what the bank was built from and the size and hash of each file; a bank is only loaded if all
of that still holds."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import ordered_rank
from ..plans import checks
from ..session import arrow_map, file_exists, read_text, write_text
from . import stores, tensors

COMPLETE = "complete.json"


def digests(spark: SparkSession, files: list[str]) -> DataFrame:
    """(path, size, sha256) of files, one file a task, in memory of one chunk; those that are missing have nulls."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    size, sha = stores.size_of(path), stores.digest(path)
                except FileNotFoundError:
                    size = sha = None
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([sha], pa.string())], ["path", "size", "sha256"])

    rows = spark.createDataFrame([(p,) for p in files], "path string").repartition(max(1, len(files)))
    return arrow_map(rows, run, "path string, size long, sha256 string")


def write_bank(patches: DataFrame, path: str, order: list[str], vector: str, numbers: list[str], record: dict, half: bool = False) -> None:
    """Writes the vector and the whole-number columns of patches as arrays aligned by the row number in an order without ties, then the
    completion record."""
    spark = patches.sparkSession
    rows = ordered_rank(patches, [], order, "__row").select(F.col("__row").alias("row"), F.explode(F.create_map(F.lit(vector), F.col(vector).cast("array<double>"), *[x for c in numbers for x in (F.lit(c), F.array(F.col(c).cast("double")))])).alias("name", "values"))
    tensors.write(rows, f"{path}/arrays", {vector: "F16" if half else "F32"} | dict.fromkeys(numbers, "I64"))
    found = tensors.tensors(f"{path}/arrays")
    shapes = {name: [kind, *shape] for name, (kind, shape) in tensors.whole_shapes(found).items()}
    files = sorted({t.file for t in found} | {f"{path}/arrays/{tensors.INDEX}"})
    hashes = {r.path.rpartition("/")[2]: [r.size, r.sha256] for r in digests(spark, files).collect()}
    write_text(spark, f"{path}/{COMPLETE}", json.dumps({"record": record, "shapes": shapes, "files": hashes}, sort_keys=True))


def load_bank(spark: SparkSession, path: str, record: dict) -> DataFrame:
    """(name, row, values) of a complete bank that was built from the record and has not changed since."""
    if not file_exists(spark, f"{path}/{COMPLETE}"):
        raise ValueError("the bank is incomplete")
    done = json.loads(read_text(spark, f"{path}/{COMPLETE}"))
    if done["record"] != json.loads(json.dumps(record)):
        raise ValueError("the bank was built from something else")
    recorded = spark.createDataFrame([(f"{path}/arrays/{name}", sha) for name, (_, sha) in done["files"].items()], "path string, sha256 string")
    checks.require_none(checks.changed_files(recorded, digests(spark, [f"{path}/arrays/{name}" for name in done["files"]]).where("sha256 IS NOT NULL")), "the bank's files have changed")
    lengths = {shape[1] for shape in done["shapes"].values()}
    if len(lengths) > 1:
        raise ValueError(f"the bank's arrays are not aligned: {done['shapes']}")
    return tensors.read(spark, f"{path}/arrays", {name: shape[1:] for name, shape in done["shapes"].items()})


def aligned(rows: DataFrame, vector: str, numbers: list[str]) -> DataFrame:
    """(row, vector, numbers...) of a loaded bank."""
    pick = lambda name: F.max(F.when(F.col("name") == name, F.col("values")))
    wide = rows.groupBy("row").agg(pick(vector).alias(vector), *[pick(c).alias(c) for c in numbers])
    return wide.select("row", vector, *[F.col(c)[0].cast("long").alias(c) for c in numbers])
