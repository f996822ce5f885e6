"""From neighbours to anomaly scores: softmax weights, reconstruction, evidence, image scores, dense maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors

NEIGHBOURS, TEMPERATURE, TOP_FRACTION = 16, 0.07, 0.1


def softmax_weights(candidates: DataFrame, temperature: float = TEMPERATURE, keep: Column | None = None) -> DataFrame:
    """Adds weight: softmax of similarity / temperature over each query's candidates, those not kept having none."""
    if keep is not None:
        candidates = candidates.where(keep)
    w = Window.partitionBy("query_id")
    e = F.exp((F.col("similarity") - F.max("similarity").over(w)) / temperature)
    return candidates.withColumn("e", e).withColumn("weight", F.col("e") / F.sum("e").over(w)).drop("e")


def reconstruct(weighted: DataFrame, bank: DataFrame) -> DataFrame:
    """(query_id, reconstruction): the weighted sum of unit bank vectors. At most the K candidates of a query meet in one row.
    bank: (bank_id, embedding)."""
    unit = bank.toDF("bank_id", "embedding").select("bank_id", vectors.l2_normalise(F.col("embedding").cast("array<double>")).alias("v"))
    rows = weighted.join(unit, "bank_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("weight").alias("w"), "v"))).alias("rows"))
    return rows.select("query_id", vectors.weighted_sum(F.col("rows")).alias("reconstruction"))


def reconstruction_distance(weighted: DataFrame, bank: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, topk_distance): cosine distance of each query from its reconstruction."""
    q = queries.toDF("query_id", "embedding").select("query_id", F.col("embedding").cast("array<double>").alias("q"))
    return reconstruct(weighted, bank).join(q, "query_id").select("query_id", vectors.distance(vectors.cosine(F.col("q"), F.col("reconstruction"))).alias("topk_distance"))


def top_fraction_mean(rows: DataFrame, group: list[str], value: str, fraction: float = TOP_FRACTION, tie: str | None = None, out: str = "score") -> DataFrame:
    """Per group the mean of its ceil(n * fraction) largest values (one at least), n, and how many were used. Summed from
    the largest down, ties by `tie`."""
    w = Window.partitionBy(*group)
    order = w.orderBy(F.col(value).desc(), *([tie] if tie else []))
    ranked = rows.withColumn("__r", F.row_number().over(order)).withColumn("__n", F.count(F.lit(1)).over(w))
    used = F.greatest(F.lit(1), F.ceil(F.col("__n") * F.lit(float(fraction))))
    return ranked.where(F.col("__r") <= used).groupBy(*group).agg(F.avg(value).alias(out), F.max("__n").alias("patches"), F.count(F.lit(1)).alias("scoring_patches"))


def evidence(patches: DataFrame, group: list[str], value: str, tie: str, matches: int, fraction: float = TOP_FRACTION) -> DataFrame:
    """The first `matches` of each group's scoring values, largest first."""
    w = Window.partitionBy(*group)
    ranked = patches.withColumn("place", F.row_number().over(w.orderBy(F.col(value).desc(), tie))).withColumn("__n", F.count(F.lit(1)).over(w))
    used = F.greatest(F.lit(1), F.ceil(F.col("__n") * F.lit(float(fraction))))
    return ranked.where(F.col("place") <= F.least(used, F.lit(matches))).drop("__n")


def dense_map(patches: DataFrame, group: str, place: str, value: str, cells: int, fill: float = -1.0, out: str = "cells") -> DataFrame:
    """(group, array of `cells` values): the value at each place, the fill where a group has none. A group has at most
    `cells` rows."""
    per = patches.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct(F.col(place).cast("int"), F.col(value)))).alias("__m"))
    return per.select(group, F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda k: F.coalesce(F.try_element_at("__m", k), F.lit(fill))).alias(out))


def family_cap(candidates: DataFrame, most: int) -> DataFrame:
    """Adds keep: whether fewer than `most` candidates of its family come before it in rank, kept or not."""
    earlier = F.row_number().over(Window.partitionBy("query_id", "family").orderBy("rank"))
    return candidates.withColumn("keep", earlier <= most)


def boundary(patches: DataFrame, group: str, row: str, column: str, outside: bool = False) -> DataFrame:
    """Adds interior: whether all four neighbours in the grid are there too. Cells beyond the grid count as `outside`; a patch
    looks at its neighbours in its row and column, in order, without a self-join."""
    across, down = Window.partitionBy(group, row).orderBy(column), Window.partitionBy(group, column).orderBy(row)
    has = lambda c, w, d: F.coalesce((F.lag(c, 1).over(w) if d < 0 else F.lead(c, 1).over(w)) == F.col(c) + d, F.lit(outside))
    inner = has(column, across, -1) & has(column, across, 1) & has(row, down, -1) & has(row, down, 1)
    return patches.withColumn("interior", inner)


def foreground(rows: DataFrame, minimum: float) -> DataFrame:
    """The patches (with an occupancy) that have the least share of foreground. Bank, queries and pooled vectors are made of these."""
    return rows.where(F.col("occupancy") >= F.lit(float(minimum)))


def without_foreground(rows: DataFrame, minimum: float, image: str = "image_id") -> DataFrame:
    """(image): images none of whose patches has the least share of foreground, so that they could not be scored."""
    return rows.groupBy(image).agg(F.max("occupancy").alias("most")).where(F.col("most") < F.lit(float(minimum))).select(image)
