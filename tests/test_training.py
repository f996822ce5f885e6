"""Stored projections, momentum averages, losses and gradients."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sondera.functions import ordering
from sondera.operators import projection, training
from sondera.session import materialise


def vectors(spark, n=400, dim=12, seed=1):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim)) @ np.diag([9, 5, 3] + [0.5] * (dim - 3)) @ np.linalg.qr(rng.normal(size=(dim, dim)))[0] + 2
    return m, spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "id int, v array<double>").repartition(5)


def test_projection_is_that_of_a_full_decomposition(spark, tmp_path):
    m, rows = vectors(spark)
    p = projection.fit(rows, "v")
    _, _, full = np.linalg.svd(m - m.mean(0), full_matrices=False)
    for ours, theirs in zip(np.array(p.components), full):
        assert abs(abs(ours @ theirs) - 1) < 1e-6 and ours[np.abs(ours).argmax()] > 0
    turned = (m - m.mean(0)) @ np.array(p.components).T
    assert np.allclose([p.low, p.high], np.quantile(turned, [0.01, 0.99], axis=0))
    projection.store(spark, p, f"file://{tmp_path}/p.json")
    assert projection.load(spark, f"file://{tmp_path}/p.json") == p
    # the colours by SQL from what was stored
    ours = {r.id: r.rgb for r in rows.select("id", projection.colours(F.col("v"), p).alias("rgb")).collect()}
    con = duckdb.connect()
    frame = rows.toPandas()  # noqa: F841  read by name
    con.execute("CREATE TABLE t AS SELECT id, list_transform(v, lambda x: x::DOUBLE) AS v FROM frame")
    for c in range(3):
        sql = f"SELECT id, greatest(0, least(1, (list_sum(list_transform(list_zip(v, {p.mean}::DOUBLE[], {p.components[c]}::DOUBLE[]), lambda z: (z[1] - z[2]) * z[3])) - {p.low[c]!r}::DOUBLE) / greatest({p.high[c] - p.low[c]!r}::DOUBLE, 1e-6))) FROM t"
        for k, x in con.sql(sql).fetchall():
            assert abs(ours[k][c] - x) < 1e-9


def test_constant_vectors_have_no_colour(spark):
    rows = spark.createDataFrame([(k, [1.0, 2.0, 3.0, 4.0]) for k in range(10)], "id int, v array<double>")
    p = projection.fit(rows, "v")
    assert {tuple(r.rgb) for r in rows.select(projection.colours(F.col("v"), p).alias("rgb")).collect()} == {(0.0, 0.0, 0.0)}


def test_scan_is_a_fold_over_any_ranges(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(g, k, float(rng.uniform(0.5, 1)), float(rng.normal()), 3.0 * g) for g in range(3) for k in range(200 if g == 0 else 5)]
    df = spark.createDataFrame(rows, "g int, k int, a double, b double, x0 double")

    def ranged(d, partition, order):
        return materialise(d.repartitionByRange(9, *[F.col(c) for c in partition], *order).withColumn("__range", F.spark_partition_id()), "ranges")

    for how in (ordering.by_ranges, ranged):
        monkeypatch.setattr(training, "by_ranges", how)
        got = {(r.g, r.k): r.x for r in training.affine_scan(df, "g", "k", "a", "b", "x0", "x").collect()}
        for g in range(3):
            x = 3.0 * g
            for _, k, a, b, _ in (r for r in rows if r[0] == g):
                x = a * x + b
                assert abs(got[g, k] - x) < 1e-9
    assert training.affine_scan(df.where("g > 9"), "g", "k", "a", "b", "x0", "x").count() == 0


def test_gradient_is_that_of_finite_differences(spark):
    rng = np.random.default_rng(3)
    rows = [(rng.normal(size=5).tolist(), rng.normal(size=4).tolist(), bool(k % 3)) for k in range(60)]
    df = spark.createDataFrame(rows, "online array<double>, target array<double>, masked boolean").repartition(4)
    w = rng.normal(size=(4, 5))

    def loss(w):
        d = [1 - (w @ x) @ t / (np.linalg.norm(w @ x) * np.linalg.norm(t)) for x, t, m in ((np.array(a), np.array(b), m) for a, b, m in rows) if m]
        return float(np.mean(d))

    value, gradient = training.linear_gradient(df, w)
    assert abs(value - loss(w)) < 1e-12
    for i, j in ((0, 0), (3, 4), (2, 1)):
        e = np.zeros_like(w)
        e[i, j] = 1e-6
        assert abs((loss(w + e) - loss(w - e)) / 2e-6 - gradient[i, j]) < 1e-7
    _, path = training.descend(df, w, 0.5, 4)
    assert path == sorted(path, reverse=True) and len(path) == 4
    with pytest.raises(ValueError, match="no masked"):
        training.linear_gradient(df.where("NOT masked"), w)


def test_losses_of_known_vectors(spark):
    rows = [(1, [1.0, 0.0], [1.0, 0.0], True, True), (1, [1.0, 0.0], [0.0, 1.0], True, False), (2, [0.0, 2.0], [0.0, 1.0], False, False)]
    r = training.losses(spark.createDataFrame(rows, "image int, predicted array<double>, target array<double>, masked boolean, in_region boolean"), "image", 0.25, 0.1).first()
    assert (r.masked, r.region) == (0.5, 0.0) and abs(r.local_global - (1 - 2**-0.5) / 2) < 1e-12 and abs(r.total - 0.5 - 0.1 * r.local_global) < 1e-12


def test_even_samples_by_ranges_are_those_of_a_window(spark):
    from sondera.operators import sampling

    rows = spark.createDataFrame([(None if g == 2 else g, k) for g in range(3) for k in range(5 if g else 200)], "g int, k int").repartition(6)
    one, two = (sorted(map(repr, sampling.even_sample(rows, ["g"], ["k"], 7, large=x).collect())) for x in (False, True))
    assert one == two and len(one) == 7 + 5 + 5
