"""A colour projection that is fitted once, stored, and applied by later runs."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import arrow_map, discard, materialise, read_text, write_text
from .metrics import exact_quantiles

#: Directions that are followed besides those asked for.
EXTRA = 5


@dataclass(frozen=True)
class Projection:
    mean: list[float]
    components: list[list[float]]  # one list per component
    low: list[float]
    high: list[float]


def _product_map(shared):
    """Each batch's share of (A'A)V, for rows A less the mean, as one row of numbers."""

    def run(batches):
        mean, v = shared.value
        total = np.zeros((len(mean), v.shape[1]))
        for batch in batches:
            if batch.num_rows:
                a = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) - mean
                total += a.T @ (a @ v)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["part"])

    return run


def fit(rows: DataFrame, vector: str, count: int = 3, rounds: int = 4, seed: int = 42, low: float = 0.01, high: float = 0.99) -> Projection:
    """The leading directions of rows of vectors by randomised subspace iteration: each round is one pass, in which every task sums the
    products of its rows and the sums are added; the driver sees a matrix of the vectors' length by a few columns. The largest
    loading of a direction is positive. low and high are the quantiles of the rows' colours."""
    spark = rows.sparkSession
    data = materialise(rows.select(F.col(vector).cast("array<double>").alias("v")), "projected")
    mean = np.array(data.select(Summarizer.mean(array_to_vector("v")).alias("m")).first().m.toArray())
    p = min(len(mean), count + EXTRA)
    v = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(mean), p)))[0]

    def product(v: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast((mean, v))
        parts = arrow_map(data, _product_map(shared), "part array<double>")
        total = parts.select(Summarizer.sum(array_to_vector("part")).alias("s")).first().s.toArray()
        shared.destroy()
        return total.reshape(v.shape)

    for _ in range(rounds):
        v = np.linalg.qr(product(v))[0]
    values, turn = np.linalg.eigh(v.T @ product(v))
    components = (v @ turn[:, np.argsort(-values)[:count]]).T
    components = [(c if c[np.abs(c).argmax()] > 0 else -c).tolist() for c in components]
    out = Projection(mean.tolist(), components, [], [])
    long_ = data.select(F.posexplode(F.array(*_coordinates(F.col("v"), out))).alias("dim", "x"))
    ends = {r.dim: r.q for r in exact_quantiles(long_, ["dim"], "x", [low, high]).collect()}
    discard(data)
    return Projection(out.mean, components, [ends[k][0] for k in range(count)], [ends[k][1] for k in range(count)])


def _coordinates(v: Column, p: Projection) -> list[Column]:
    centred = F.zip_with(v.cast("array<double>"), F.array(*[F.lit(x) for x in p.mean]), lambda x, m: x - m)
    return [F.aggregate(F.zip_with(centred, F.array(*[F.lit(x) for x in c]), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x) for c in p.components]


def colours(v: Column, p: Projection, least: float = 1e-6) -> Column:
    """A colour of 0 to 1 for each component; a range under `least` counts as `least`."""
    scaled = [(x - F.lit(a)) / F.lit(max(b - a, least)) for x, a, b in zip(_coordinates(v, p), p.low, p.high)]
    return F.array(*[F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) for x in scaled])


def store(spark: SparkSession, p: Projection, path: str) -> None:
    write_text(spark, path, json.dumps(asdict(p)))


def load(spark: SparkSession, path: str) -> Projection:
    return Projection(**json.loads(read_text(spark, path)))
