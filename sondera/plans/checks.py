"""Integrity checks as DataFrames of violations, and a way to demand that there are none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..session import materialise


def require_none(violations: DataFrame, what: str) -> None:
    """Raises with a few examples if there is any violation."""
    found = violations.limit(3).collect()
    if found:
        raise ValueError(f"{what}: {[r.asDict() for r in found]}")


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def bad_vectors(rows: DataFrame, column: str, dim: int) -> DataFrame:
    """Rows whose vector has another dimension, a component that is null or not finite, or no length."""
    v = F.col(column)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(v.isNull() | (F.size(v) != dim) | F.coalesce(odd, F.lit(True)) | (vectors.norm(v.cast("array<double>")) == 0))


def held_out_overlap(rows: DataFrame) -> DataFrame:
    """Families of the bank that are in a held-out role too."""
    return rows.where("role IN ('calibration', 'evaluation')").join(rows.where("role = 'bank'").select("family").distinct(), "family", "left_semi").select("family").distinct()


def evidence_mismatch(queries: DataFrame, saved: DataFrame) -> DataFrame:
    """(role, sample_id, patch_id) in one of queries and saved evidence but not in the other."""
    key = ["role", "sample_id", "patch_id"]
    a, b = queries.select(*key), saved.select(*key)
    return differing_rows(a, b)


def differing_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one has and the other lacks, each as often as that is so."""
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return differing_rows(a, b).isEmpty()


#: Digests that are hashed together in one row, about.
LOT = 65_536


def row_signature(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row: sha256 over a tree of the sorted digests of the rows as compact JSON. Digests that share a prefix are hashed
    together, the hashes of 256 prefixes again, and so on to the root; the first prefix has two hexadecimal digits and two more
    each time that as many as LOT digests would share one, so no row holds much more than that."""
    digest = materialise(rows.select(F.sha2(F.to_json(F.struct(*order)), 256).alias("d")), "digests")
    n, digits = digest.count(), 2
    while n > LOT * 16**digits:
        digits += 2
    parts = digest.groupBy(F.substring("d", 1, digits).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("s"), F.count(F.lit(1)).alias("n"))
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "s"))), lambda x: x["s"]), ""), 256)
    for left in range(digits - 2, 0, -2):
        parts = parts.groupBy(F.substring("p", 1, left).alias("p")).agg(joined.alias("s"), F.sum("n").alias("n"))
    return parts.agg(joined.alias("signature"), F.sum("n").alias("rows"))


def changed_files(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, sha256, reason) of recorded files (path, sha256) that are missing now, or have another digest."""
    now = actual.select(F.col("path").alias("__path"), F.col("sha256").alias("__now"))
    joined = recorded.join(now, F.col("path") == F.col("__path"), "left")
    reason = F.when(F.col("__path").isNull(), "missing").when(~F.col("sha256").eqNullSafe(F.col("__now")), "changed")
    return joined.withColumn("reason", reason).where("reason IS NOT NULL").select("path", "sha256", "reason")
