"""What training needs besides a network: momentum averages of parameters over steps, and the three-part reconstruction loss with
the gradient of a linear decoder, as sums over tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.ordering import by_ranges
from ..session import arrow_map


def affine_scan(rows: DataFrame, group: str, order: str, a: str, b: str, start: str, out: str) -> DataFrame:
    """Adds x of each row in order within its group: x = a * (x before) + b, from the group's start. Maps x -> a x + b compose to maps of
    that kind, so each range of rows is first composed to one, the ranges' maps of a group are composed in order (a row per range),
    and each range is then walked from the x that it begins with. No task holds more than a range, however long a group is."""
    ranged = by_ranges(rows, [group], [F.col(order)])
    kinds = dict(rows.dtypes)

    def compose(steps: Column) -> Column:
        one = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
        return F.aggregate(steps, one, lambda s, r: F.struct((r["a"] * s["a"]).alias("a"), (r["a"] * s["b"] + r["b"]).alias("b")))

    step = F.struct(F.col(order).alias("o"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    maps = ranged.groupBy(group, "__range").agg(compose(F.array_sort(F.collect_list(step))).alias("m"), F.first(F.col(start).cast("double")).alias("x"))
    per = maps.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("__range", "m"))).alias("ms"), F.first("x").alias("x"))
    begins = per.select(group, F.inline(F.transform("ms", lambda m, k: F.struct(m["__range"].alias("__range"), _apply(compose(F.transform(F.slice("ms", 1, k), lambda y: y["m"])), F.col("x")).alias("__begin")))))
    dealt = ranged.join(begins, [group, "__range"]).repartition(group, "__range").sortWithinPartitions(group, "__range", order)
    names = [c for c in dealt.columns if c not in ("__range", "__begin")]

    def walk(batches):
        key, x = None, 0.0
        for batch in batches:
            col = {c: batch.column(batch.schema.get_field_index(c)) for c in (group, "__range", a, b, "__begin")}
            out_ = np.empty(batch.num_rows)
            for k, (g, r, p, q, begin) in enumerate(zip(*(c.to_pylist() for c in col.values()))):
                if (g, r) != key:
                    key, x = (g, r), begin
                x = float(p) * x + float(q)
                out_[k] = x
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(out_)], [*names, out])

    schema = ", ".join(f"`{n}` {kinds.get(n) or dict(dealt.dtypes)[n]}" for n in names)
    return arrow_map(dealt, walk, f"{schema}, `{out}` double")


def _apply(m: Column, x: Column) -> Column:
    return m["a"] * x + m["b"]


def teacher(steps: DataFrame, name: str, step: str, value: str, momentum: str, start: str, out: str = "teacher") -> DataFrame:
    """Adds the momentum average of a parameter after each step: momentum * (before) + (1 - momentum) * value."""
    rows = steps.withColumns({"__a": F.col(momentum), "__b": (1 - F.col(momentum)) * F.col(value)})
    return affine_scan(rows, name, step, "__a", "__b", start, out).drop("__a", "__b")


def losses(pairs: DataFrame, image: str, region_weight: float, global_weight: float) -> DataFrame:
    """One row: masked (mean cosine distance of masked patches), region (of those of the covered region), local_global (of an image's mean
    vectors, over images) and total. pairs: (image, predicted, target, masked, in_region), a row per patch. No masked patch or no
    region gives null for that part and the total."""
    each = pairs.select(image, "predicted", "target", "masked", "in_region", vectors_distance(F.col("predicted"), F.col("target")).alias("d"))
    local = each.agg(F.avg(F.when(F.col("masked"), F.col("d"))).alias("masked"), F.avg(F.when(F.col("in_region"), F.col("d"))).alias("region"))
    mean = lambda c: vector_to_array(Summarizer.mean(array_to_vector(F.col(c)))).alias(c)
    whole = each.groupBy(image).agg(mean("predicted"), mean("target")).agg(F.avg(vectors_distance(F.col("predicted"), F.col("target"))).alias("local_global"))
    total = F.col("masked") + region_weight * F.col("region") + global_weight * F.col("local_global")
    return local.join(F.broadcast(whole), how="cross").withColumn("total", total)


def vectors_distance(a: Column, b: Column) -> Column:
    return 1.0 - vectors.cosine(a, b)


def linear_gradient(rows: DataFrame, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """(masked loss, its gradient by the weights) of a linear decoder: predicted = weights @ online. rows: (online, target, masked). Tasks sum
    their rows' gradients, and the sums are added; the driver sees matrices of the weights' size."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = shared.value
        total, loss, n = np.zeros(w.shape), 0.0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x, t = (batch.column(k).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1) for k in (0, 1))
            p = x @ w.T
            size_p, size_t = np.linalg.norm(p, axis=1, keepdims=True), np.linalg.norm(t, axis=1, keepdims=True)
            cosine = (p * t).sum(axis=1, keepdims=True) / (size_p * size_t)
            total -= (t / (size_p * size_t) - cosine * p / size_p**2).T @ x
            loss += float((1 - cosine).sum())
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([[loss, float(n), *total.ravel()]], pa.list_(pa.float64()))], ["part"])

    parts = arrow_map(rows.where("masked").select(F.col("online").cast("array<double>"), F.col("target").cast("array<double>")), run, "part array<double>")
    # Summarizer wants a row, and a table without masked patches has none
    parts = parts.unionByName(rows.sparkSession.createDataFrame([([0.0] * (2 + weights.size),)], "part array<double>"))
    loss, n, *total = parts.select(Summarizer.sum(array_to_vector("part")).alias("s")).first().s.toArray()
    shared.destroy()
    if not n:
        raise ValueError("no masked patches")
    return loss / n, np.array(total).reshape(weights.shape) / n


def descend(rows: DataFrame, weights: np.ndarray, rate: float, steps: int) -> tuple[np.ndarray, list[float]]:
    """Weights after so many full gradient steps, and the loss before each."""

    def step(state: tuple[np.ndarray, list[float]], _: int) -> tuple[np.ndarray, list[float]]:
        loss, gradient = linear_gradient(rows, state[0])
        return state[0] - rate * gradient, [*state[1], loss]

    return reduce(step, range(steps), (weights, []))
