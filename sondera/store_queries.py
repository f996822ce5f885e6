"""Queries over containers of tensors, banks as arrays, and files of any size, each next to its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.ordering import ordered_rank
from .plan_queries import query
from .plans.views import table
from .session import scratch_folder
from .sources import arrays, readers, tensors
from .streaming import files


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    return ordered_rank(table(spark, d, "embeddings"), [], ["vec_id"], "row")


@query("""WITH e AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, embedding, label FROM embeddings)
SELECT 'vectors' AS name, row, (k - 1)::INT AS at, round(embedding[k]::DOUBLE, 7) AS x FROM e, (SELECT unnest(range(1, 65)) AS k)
UNION ALL SELECT 'labels', row, 0::INT, label::DOUBLE FROM e""")
def tensor_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Vectors and labels written as a container of tensors, and read again by byte ranges."""
    e = _numbered(spark, d)
    rows = e.select(F.lit("vectors").alias("name"), "row", F.col("embedding").cast("array<double>").alias("values"))
    rows = rows.unionByName(e.select(F.lit("labels").alias("name"), "row", F.array(F.col("label").cast("double")).alias("values")))
    path = scratch_folder(spark, "tensors")
    tensors.write(rows, path, {"vectors": "F32", "labels": "I64"}, {"vectors": [8, 8]})
    n = e.count()
    back = tensors.read(spark, path, {"vectors": [n, 8, 8], "labels": [n, 1]})
    return back.select("name", "row", F.posexplode("values").alias("at", "x")).withColumn("x", F.round("x", 7))


@query("""WITH e AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, embedding, label, vec_id FROM embeddings), x AS (SELECT row, (k - 1)::INT AS dim, embedding[k]::DOUBLE AS x FROM e, (SELECT unnest(range(1, 65)) AS k)),
h AS (SELECT row, dim, CASE WHEN x = 0 THEN 0 ELSE pow(2::DOUBLE, greatest(floor(log2(abs(x))), -14) - 10) END AS unit, x FROM x)
SELECT row, dim, CASE WHEN unit = 0 THEN 0 ELSE round_even(x / unit, 0) * unit END AS x, label::BIGINT AS label, vec_id FROM h JOIN e USING (row)""")
def half_bank_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A bank written as aligned arrays in half precision, checked and loaded."""
    path, record = scratch_folder(spark, "array-bank"), {"plan_sha256": "of the plan", "foreground_minimum": 0.5}
    arrays.write_bank(table(spark, d, "embeddings"), path, ["vec_id"], "embedding", ["label", "vec_id"], record, half=True)
    rows = arrays.aligned(arrays.load_bank(spark, path, record), "embedding", ["label", "vec_id"])
    return rows.select("row", F.posexplode("embedding").alias("dim", "x"), "label", "vec_id")


@query("SELECT source, sha256(string_agg(replace(text, chr(10), ' ') || chr(10), '' ORDER BY doc_id)) AS sha256, sum(strlen(text) + 1)::BIGINT AS size FROM documents GROUP BY source")
def large_file_digests(spark: SparkSession, d: str) -> DataFrame:
    """The texts of each source as one file, and the files' digests, read in chunks."""
    path = scratch_folder(spark, "texts")
    docs = table(spark, d, "documents").select("source", "doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("value"))
    docs.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "value").write.partitionBy("source").text(path)
    named = lambda df: df.withColumn("source", F.regexp_extract("path", "source=([^/]*)/", 1))
    return named(readers.file_digests(spark, path, "*.txt")).join(named(readers.listing(spark, path, "*.txt")).select("source", "size"), "source").select("source", "sha256", "size")


_LOOKS = "SELECT user_id::VARCHAR AS path, hour(ts) AS look, max(event_id % 5)::BIGINT AS size, max(event_id % 3)::BIGINT AS modified FROM events GROUP BY 1, 2"


@query(f"""WITH l AS ({_LOOKS})
SELECT *, CASE WHEN row_number() OVER w = 1 THEN 'new' WHEN size = first_value(size) OVER w AND modified = first_value(modified) OVER w THEN 'unchanged' ELSE 'changed' END AS decision
FROM l WINDOW w AS (PARTITION BY path ORDER BY look)""")
def file_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What a stream of looks at a folder does with each file: new, unchanged, or changed since its first sight."""
    looks = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("path"), F.hour("ts").cast("long").alias("look"))
    return files.decided(looks.agg(F.max(F.expr("event_id % 5")).alias("size"), F.max(F.expr("event_id % 3")).alias("modified")), "look")
