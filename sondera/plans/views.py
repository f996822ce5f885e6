"""The patch view: embeddings as patches of images of source families.

Vectors of a label are numbered in vec_id order; five in a row are an image, and 10 (labels 0-4, real) or 20 (labels 5-9, fake) are a
family shared by a real and a fake label. The view only gives the test tables the shape of image patches; real data bring their
image, patch and family columns with them. Labels are few and large, so vectors are numbered by ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.ordering import ordered_rank

IMAGES_PER_LABEL = 1_000_000_000
#: A component of larger magnitude counts as occupied; a patch of the view has the share of its components that do.
OCCUPIED_ABOVE = 0.03


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def patch_view(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding ARRAY<DOUBLE>, label, y, image_id, patch_id, family, occupancy)."""
    rows = ordered_rank(embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label"), ["label"], ["vec_id"], "rn")
    y = F.when(F.col("label") >= 5, 1).otherwise(0)
    family = F.concat_ws("/", (F.col("label") % 5).cast("string"), F.floor(F.col("rn") / F.when(F.col("label") >= 5, 20).otherwise(10)).cast("string"))
    image = F.col("label").cast("long") * IMAGES_PER_LABEL + F.floor(F.col("rn") / 5)
    return rows.select("vec_id", "embedding", "label", y.alias("y"), image.alias("image_id"), (F.col("rn") % 5).cast("int").alias("patch_id"), family.alias("family"), vectors.occupancy(F.col("embedding"), OCCUPIED_ABOVE).alias("occupancy"))
