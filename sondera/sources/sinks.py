"""Writers. Spark's committer makes each write all or nothing; a bank's completion row is written last."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import arrow_map
from . import stores


def json_report(df: DataFrame, path: str) -> None:
    """JSON lines; NaN and infinities are an error, as they have no JSON form."""
    checked = df
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            odd = F.isnan(name) | F.col(name).isin(float("inf"), float("-inf"))
            checked = checked.withColumn(name, F.when(odd, F.raise_error(F.lit(f"{name} is not finite")).cast(kind)).otherwise(F.col(name)))
    checked.write.mode("overwrite").json(path)


def csv_report(df: DataFrame, path: str, fields: list[str]) -> None:
    df.select(*fields).write.mode("overwrite").csv(path, header=True)


def evidence(df: DataFrame, path: str) -> None:
    """Evidence by role; only the roles written are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("role").parquet(path)


def bank(patches: DataFrame, sources: DataFrame, path: str, plan_sha256: str, foreground_minimum: float, top_fraction: float) -> None:
    """Writes bank patches (bank_patch_id, source_idx, patch_id, embedding), sources, and then the completion row, without which
    the bank does not count as built."""
    patches.write.mode("overwrite").parquet(f"{path}/patches")
    sources.write.mode("overwrite").parquet(f"{path}/sources")
    counts = patches.sparkSession.read.parquet(f"{path}/patches").agg(F.countDistinct("source_idx").alias("image_count"), F.count(F.lit(1)).alias("patch_count"))
    done = counts.select(F.lit("cosine").alias("method"), "image_count", "patch_count", F.lit(float(foreground_minimum)).alias("foreground_minimum"), F.lit(float(top_fraction)).alias("top_fraction"), F.lit(plan_sha256).alias("plan_sha256"))
    done.write.mode("overwrite").parquet(f"{path}/complete")


def load_bank(spark, path: str, plan_sha256: str) -> tuple[DataFrame, DataFrame]:
    """(patches, sources) of a complete bank built from the plan of that hash."""
    row = spark.read.parquet(f"{path}/complete").first()
    if row is None or row.plan_sha256 != plan_sha256:
        raise ValueError("the bank is incomplete or was built from another plan")
    patches = spark.read.parquet(f"{path}/patches")
    if patches.count() != row.patch_count:
        raise ValueError("the bank's patches changed after it was built")
    return patches, spark.read.parquet(f"{path}/sources")


def pending(rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows not yet in a committed table: what a resumed run still has to do."""
    return rows.join(done.select(*key).distinct(), key, "left_anti")


def quarantine(rows: DataFrame, bad, reason: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with a reason)."""
    flag = F.coalesce(bad, F.lit(False))
    return rows.where(~flag), rows.where(flag).withColumn("reason", F.lit(reason))


def text_files(rows: DataFrame, root: str) -> int:
    """Writes each row (path, content) as a file under a folder, from the tasks that have the rows; each is moved into place when it is
    whole, so that a task that runs again leaves the same files. Returns how many."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                stores.write_file(f"{root}/{path}", iter([content.encode()]))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return arrow_map(rows.select(F.col("path").cast("string"), F.col("content").cast("string")), run, "n long").agg(F.sum("n")).first()[0] or 0
