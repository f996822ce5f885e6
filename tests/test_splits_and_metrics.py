import numpy as np
import pytest
from pyspark.sql import functions as F

from sondera.functions import ordering
from sondera.operators import diagnostics, grids, metrics, sampling, splits


def families(spark):
    rows = [(f"r{f}-{k}", f"r{f}", 0) for f in range(20) for k in range(2)] + [(f"m{f}-{y}", f"m{f}", y) for f in range(10) for y in (0, 1)] + [(f"f{f}", f"f{f}", 1) for f in range(10)]
    return spark.createDataFrame(rows, "video string, family string, y int")


def test_full_split_counts_and_disjoint_families(spark):
    rows = splits.full_split(families(spark)).cache()
    per = {r.role: r.n for r in rows.groupBy("role").agg(F.countDistinct("family").alias("n")).collect()}
    assert per["calibration"] == 4 and splits.overlapping_families(rows).count() == 0
    assert rows.where("role = 'bank' AND y = 1 OR role = 'calibration' AND y = 1").count() == 0
    assert rows.where("family LIKE 'f%' AND role = 'train_fake'").select("family").distinct().count() == 7
    assert rows.where("role IN ('bank', 'train_fake') AND family NOT LIKE 'f%'").select("family").distinct().count() == 21


def test_full_split_needs_enough_families(spark):
    with pytest.raises(ValueError):
        splits.full_split(families(spark).where("family IN ('r1', 'm1')"))


def test_quota_split_uses_each_family_once(spark):
    out = splits.quota_split(families(spark), {"eval_fake": 4, "train_fake": 3, "bank": 6, "calibration": 3, "eval_real": 5}).collect()
    assert len(out) == 21 and len({r.family for r in out}) == 21
    with pytest.raises(ValueError):
        splits.quota_split(families(spark), {"bank": 99})


def test_even_sample_indices(spark):
    rows = spark.createDataFrame([("v", k) for k in reversed(range(32))], "g string, frame_index int")
    got = sorted(r.frame_index for r in sampling.even_sample(rows, ["g"], ["frame_index"], 10).collect())
    assert got == [0, 3, 6, 10, 13, 17, 20, 24, 27, 31]
    assert sampling.even_sample(rows.limit(6), ["g"], ["frame_index"], 10).count() == 6


def test_even_places_match_linspace(spark):
    for c in (1, 2, 7, 20):
        got = spark.range(1, 80).select("id", ordering.even_places(F.col("id"), c).alias("p")).collect()
        assert all(r.p == (list(range(r.id)) if r.id <= c else np.linspace(0, r.id - 1, c, dtype=int).tolist()) for r in got)


def test_class_limit_and_shards(spark):
    rows = spark.createDataFrame([(f"video{k}", y) for k, y in enumerate((0, 1, 1, 0, 1, 0))], "path string, label int")
    assert sorted(r.path for r in sampling.class_limit(rows, "label", "path", 2).collect()) == ["video0", "video1", "video2", "video3"]
    shards = {r.path: r.shard for r in sampling.round_robin(rows, "path", 2).collect()}
    assert shards == {f"video{k}": k % 2 for k in range(6)}


def test_hashed_rank_is_the_global_order(spark):
    rows = spark.range(3000).withColumn("key", ordering.shuffle_key(1, "x", F.col("id")))
    got = [r.id for r in ordering.hashed_rank(rows, "key", "id", "rank").orderBy("rank").collect()]
    assert got == [r.id for r in rows.orderBy("key", "id").collect()]


def test_ordered_rank_counts_across_ranges(spark):
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("v"), F.when(F.col("id") % 3 > 0, "big").alias("g"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordering.ordered_rank(rows, ["g"], ["v"], "rank").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in ("big", None):
        mine = sorted((r.v, r["rank"]) for r in got if r.g == g)
        assert [k for _, k in mine] == list(range(len(mine))) and mine


def test_ranking_metrics_with_ties(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 200), rng.integers(0, 12, 200) / 4
    rows = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, score double")
    m = metrics.ranking_metrics(rows, spark.createDataFrame([(1.5,)], "threshold double"), []).first()
    pos, neg = s[y == 1], s[y == 0]
    auroc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    ap, before = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        tp, fp = (pos >= t).sum(), (neg >= t).sum()
        ap += (tp / len(pos) - before) * tp / (tp + fp)
        before = tp / len(pos)
    assert np.allclose([m.auroc, m.average_precision, m.fpr, m.tpr], [auroc, ap, (neg > 1.5).mean(), (pos > 1.5).mean()])


def test_histogram_counts_match_numpy(spark):
    x = np.random.default_rng(2).normal(size=500)
    rows = spark.createDataFrame([("a", float(v)) for v in x], "g string, v double")
    got = {r.bin: r["count"] for r in metrics.histogram(rows, "v", "g").collect()}
    want, _ = np.histogram(x, 60)
    assert {k + 1: c for k, c in enumerate(want) if c} == got


def test_early_stopping_needs_the_delta(spark):
    losses = [1.0, 0.9, 0.8995, 0.8993, 0.85, 0.86, 0.87, 0.88, 0.1]
    rows = spark.createDataFrame([("r", k + 1, v) for k, v in enumerate(losses)], "run string, epoch int, loss double")
    r = sampling.early_stopping(rows, "run", 3, 0.001).first()
    assert (r.best_epoch, r.best_loss, r.stop_epoch) == (5, 0.85, 8)


def test_ema_end_points(spark):
    got = [r.momentum for r in sampling.ema_schedule(spark.range(10).withColumnRenamed("id", "step"), 0.996, 1.0, 10).orderBy("step").collect()]
    assert abs(got[0] - 0.996) < 1e-12 and abs(got[-1] - 1.0) < 1e-12


def test_covering_mask_size_and_region(spark):
    cells = [(0, r, c, 1 if r < 7 else 2 + (r + c) % 4) for r in range(14) for c in range(14)]
    got = grids.covering_mask(spark.createDataFrame(cells, "image int, row int, col int, region int"), "image", 0.75, 42).collect()
    assert sum(r.masked for r in got) == 147
    primary = {r.region for r in got if r.in_primary}
    assert len(primary) == 1 and all(r.masked for r in got if r.region in primary)


def test_patch_majority_ties_to_the_least_class(spark):
    pixels = [(0, y, x, c) for (y, x), c in {(0, 0): 5, (0, 1): 5, (1, 0): 2, (1, 1): 2, (0, 2): 9, (0, 3): 9, (1, 2): 9, (1, 3): 1}.items()]
    got = {(r.row, r.col): r["class"] for r in grids.patch_majority(spark.createDataFrame(pixels, "image int, y int, x int, class int"), "image", 2).collect()}
    assert got == {(0, 0): 2, (0, 1): 9}


def test_agreement_of_equal_labels(spark):
    rows = spark.createDataFrame([(k % 2, 1 - k % 2) for k in range(20)], "a int, b int")
    r = diagnostics.agreement(rows, "a", "b").first()
    assert np.allclose([r.ari, r.nmi, r.accuracy], 1)


def test_boxes(spark):
    row = spark.createDataFrame([([[0, 0, 2, 2], [1, 1, 3, 3], [0, 0, 1, 1]], 1000, 500)], "boxes array<array<int>>, w int, h int")
    r = row.select(grids.largest_box(F.col("boxes")).alias("box"), grids.detection_size(F.col("w"), F.col("h"), 640).alias("size"), grids.crop_box(F.array(*[F.lit(float(x)) for x in (10, 10, 20, 30)]), F.lit(0.5), 0.1, F.col("w"), F.col("h")).alias("crop")).first()
    assert r.box == [0, 0, 2, 2] and r.size == [640, 320] and r.crop == [18, 16, 42, 64]
