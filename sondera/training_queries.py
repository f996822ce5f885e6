"""Queries of stored projections, momentum averages and losses, each next to its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import projection, sampling, training
from .plan_queries import QUERIES, query
from .plans.views import table
from .session import scratch_folder

_STEPS = "SELECT o_custkey % 7 AS name, row_number() OVER (PARTITION BY o_custkey % 7 ORDER BY o_orderdate, o_orderkey) - 1 AS step, o_totalprice::DOUBLE AS value FROM orders"


@query(f"""WITH RECURSIVE s AS ({_STEPS}), m AS (SELECT *, 0.999::DOUBLE - (0.999::DOUBLE - 0.9::DOUBLE) * (cos(pi() * least(1, step / 999::DOUBLE)) + 1) / 2 AS momentum FROM s),
t AS (SELECT name, step, momentum * 100000 + (1 - momentum) * value AS x FROM m WHERE step = 0
  UNION ALL SELECT m.name, m.step, m.momentum * t.x + (1 - m.momentum) * m.value FROM t JOIN m ON m.name = t.name AND m.step = t.step + 1)
SELECT name, step, round(x, 4) AS teacher FROM t""")
def momentum_averages(spark: SparkSession, d: str) -> DataFrame:
    """Momentum average of each parameter after every step, by composing ranges of steps."""
    o = table(spark, d, "orders").select((F.col("o_custkey") % 7).alias("name"), "o_orderdate", "o_orderkey", F.col("o_totalprice").cast("double").alias("value"))
    steps = o.withColumn("step", F.row_number().over(Window.partitionBy("name").orderBy("o_orderdate", "o_orderkey")).cast("long") - 1).select("name", "step", "value")
    steps = sampling.ema_schedule(steps, 0.9, 0.999, 1000).withColumn("start", F.lit(100000.0))
    return training.teacher(steps, "name", "step", "value", "momentum", "start").select("name", "step", F.round("teacher", 4).alias("teacher"))


_DISTANCE = "1 - list_inner_product(p, t) / (sqrt(list_inner_product(p, p)) * sqrt(list_inner_product(t, t)))"


@query(f"""WITH e AS (SELECT vec_id // 20 AS image, embedding::DOUBLE[] AS p, list_reverse(embedding::DOUBLE[]) AS t, vec_id % 4 <> 0 AS masked, vec_id % 5 = 1 AS in_region FROM embeddings),
d AS (SELECT *, {_DISTANCE} AS d FROM e), a AS (SELECT avg(d) FILTER (masked) AS masked, avg(d) FILTER (in_region) AS region FROM d),
k AS (SELECT image, i, avg(p[i]) AS p, avg(t[i]) AS t FROM e, (SELECT unnest(range(1, 65)) AS i) GROUP BY image, i),
g AS (SELECT 1 - sum(p * t) / (sqrt(sum(p * p)) * sqrt(sum(t * t))) AS d FROM k GROUP BY image), w AS (SELECT avg(d) AS local_global FROM g)
SELECT round(masked, 9) AS masked, round(region, 9) AS region, round(local_global, 9) AS local_global, round(masked + 0.25 * region + 0.1 * local_global, 9) AS total FROM a, w""")
def reconstruction_losses(spark: SparkSession, d: str) -> DataFrame:
    """Masked, region and local/global loss of vectors against their reversed selves."""
    e = table(spark, d, "embeddings").select(F.expr("vec_id div 20").alias("image"), F.col("embedding").cast("array<double>").alias("predicted"), F.expr("vec_id % 4 <> 0").alias("masked"), F.expr("vec_id % 5 = 1").alias("in_region"))
    out = training.losses(e.withColumn("target", F.reverse("predicted")), "image", 0.25, 0.1)
    return out.select(*[F.round(c, 9).alias(c) for c in ("masked", "region", "local_global", "total")])


def preview_colours(spark: SparkSession, d: str) -> DataFrame:
    """Colours of all patches by a projection that was fitted to evenly sampled real ones, stored, and loaded again. (The fit has no SQL;
    tests hold it against a full decomposition, and the colours against SQL from the stored projection.)"""
    rows = table(spark, d, "embeddings")
    real = rows.where("label < 5").select("label", "vec_id", "embedding")
    fitted = projection.fit(sampling.even_sample(real, ["label"], ["vec_id"], 100, large=True), "embedding")
    path = f"{scratch_folder(spark, 'projection')}/visualization.json"
    projection.store(spark, fitted, path)
    rgb = projection.colours(F.col("embedding"), projection.load(spark, path))
    return rows.select("vec_id", F.posexplode(rgb).alias("channel", "x")).withColumn("x", F.round("x", 6))


QUERIES["preview_colours"] = preview_colours
