"""The ways that large tables take give what small ones take: bounds are lowered so that both run on little data."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondera.functions import ordering
from sondera.operators import diagnostics, metadata, metrics, splits
from sondera.plans import checks
from sondera.session import file_exists, folders_in, new_folder, shared_dir, write_text
from sondera.sources import readers

from .test_splits_and_metrics import families


@pytest.mark.parametrize("sketch", [10_000, 100])
def test_quantiles_are_exact_with_and_without_brackets(spark, monkeypatch, sketch):
    monkeypatch.setattr(metrics, "SKETCH", sketch)
    rng = np.random.default_rng(2)
    data = {"a": rng.normal(size=3000).round(2), "b": rng.normal(size=7), "c": np.ones(900), "d": np.array([3.5])}
    rows = spark.createDataFrame([(g, float(x)) for g, xs in data.items() for x in xs] + [("a", None)], "g string, x double").repartition(5)
    for q in ([0.99], [0.0, 0.01, 0.5, 0.99, 1.0]):
        got = {r.g: r.q for r in metrics.exact_quantiles(rows, ["g"], "x", q).collect()}
        for g, xs in data.items():
            assert np.allclose(got[g], np.quantile(xs, q), atol=1e-12)
    one = metrics.exact_quantiles(rows.where("g = 'a'"), [], "x", [0.01, 0.99]).first().q
    assert np.allclose(one, np.quantile(data["a"], [0.01, 0.99]), atol=1e-12)


def test_curves_by_ranges_are_those_of_one_window(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([("xy"[k % 2], float(rng.integers(60)) / 50, int(rng.random() < 0.4)) for k in range(700)], "g string, score double, y int").repartition(6)
    plain = lambda df: sorted(tuple(r) for r in df.collect())
    for group in ([], ["g"]):
        want = plain(metrics.cumulative(rows, group).select(*group, "score", "pos", "neg", "tp", "fp", "p", "n"))
        with monkeypatch.context() as m:
            m.setattr(metrics, "FEW_SCORES", 0)
            assert plain(metrics.cumulative(rows, group).select(*group, "score", "pos", "neg", "tp", "fp", "p", "n")) == want


def test_running_sums(spark):
    rng = np.random.default_rng(1)
    data = [(f"g{k % 3}" if k % 7 else None, k, int(rng.integers(100))) for k in range(500)]
    rows = spark.createDataFrame(data, "g string, k int, x int").repartition(7)
    for before in (False, True):
        got = {r.k: r.s for r in ordering.running_sums(rows, ["g"], [F.col("k").desc()], {"x": "s"}, before).collect()}
        for g in {d[0] for d in data}:
            total = 0
            for _, k, x in sorted((d for d in data if d[0] == g), key=lambda d: -d[1]):
                assert got[k] == total + (0 if before else x)
                total += x


def test_a_signature_by_longer_prefixes_depends_on_rows_alone(spark, monkeypatch):
    a = spark.createDataFrame([(k, "x") for k in range(3000)], "k int, s string")
    monkeypatch.setattr(checks, "LOT", 1)
    one = checks.row_signature(a, ["k", "s"]).first()
    assert one == checks.row_signature(a.orderBy(F.desc("k")), ["k", "s"]).first() and one["rows"] == 3000
    assert one.signature != checks.row_signature(a.where("k <> 7"), ["k", "s"]).first().signature


def test_splits_of_many_families_are_those_of_few(spark, monkeypatch):
    want = sorted(map(tuple, splits.full_split(families(spark)).select("video", "role").collect()))
    monkeypatch.setattr(splits, "FEW_FAMILIES", 0)
    assert sorted(map(tuple, splits.full_split(families(spark)).select("video", "role").collect())) == want


def plain_silhouette(x, label, far):
    out = []
    for i in range(len(x)):
        mean = {c: [far(x[i], x[j]) for j in range(len(x)) if j != i and label[j] == c] for c in set(label)}
        if not mean[label[i]]:
            out.append(0.0)
            continue
        a, b = np.mean(mean[label[i]]), min(np.mean(v) for c, v in mean.items() if c != label[i])
        out.append((b - a) / max(a, b))
    return np.mean(out)


def test_silhouettes_match_all_pairs(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5)) + np.repeat([[0], [2], [4]], 20, axis=0)
    label = [0] * 20 + [1] * 20 + [2] * 19 + [3]
    rows = spark.createDataFrame([(k, label[k], x[k].tolist()) for k in range(60)], "id long, c int, vector array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert abs(diagnostics.silhouette(rows, "c").first()[0] - plain_silhouette(unit, label, lambda a, b: 1 - a @ b)) < 1e-9
    want = plain_silhouette(x, label, lambda a, b: np.linalg.norm(a - b))
    for block in (7, 2048):
        assert abs(diagnostics.silhouette(rows, "c", "euclidean", block).first()[0] - want) < 1e-7


def test_components_span_those_of_a_decomposition(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 6)) * np.array([5, 3, 2, 1, 0.5, 0.1])
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id int, vector array<double>").repartition(3)
    out, share = diagnostics.principal_components(rows, 3)
    got = np.array([r.reduced for r in out.orderBy("id").collect()])
    centred = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    signs = np.sign(vt[np.arange(3), np.abs(vt[:3]).argmax(axis=1)])
    assert np.allclose(got, centred @ (vt[:3] * signs[:, None]).T, atol=1e-8)
    assert abs(share - (s[:3] ** 2).sum() / (s**2).sum()) < 1e-9
    assert abs(diagnostics.explained_variance(out, rows).first()[0] - share) < 1e-9


def test_clusters_are_the_cheapest_of_all_pairs(spark):
    """Two means of a dozen points, against every way of cutting them in two."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(5, 2)), rng.normal(size=(7, 2)) + 2.5])
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id int, vector array<double>")
    cost = lambda part: sum(((x[list(p)] - x[list(p)].mean(axis=0)) ** 2).sum() for p in part)
    every = [(c, tuple(set(range(12)) - set(c))) for n in range(1, 7) for c in itertools.combinations(range(12), n)]
    got = {r.id: r.cluster for r in diagnostics.kmeans(rows, 2, restarts=5, column="vector").collect()}
    mine = [[k for k in got if got[k] == c] for c in (0, 1)]
    assert abs(cost(mine) - min(map(cost, every))) < 1e-9


def test_two_labels_or_manifests_of_one_video_are_errors(spark):
    frame = "array<struct<status string, frame_index int, file string>>"
    labels = spark.createDataFrame([("a.mp4", 0)], "filename string, label int")
    manifest = spark.createDataFrame([("p", "a", "a.mp4", 0, [("ok", 1, "x.png")])], f"part string, video string, source string, label int, frames {frame}")
    parts = spark.createDataFrame([("p", "a.mp4", "REAL", None)], "part string, filename string, label string, original string")
    segmented = spark.createDataFrame([("p-a-frame_000001.jpg",)], "file string")
    assert metadata.video_candidates(labels, manifest, parts, segmented, 5).count() == 1
    with pytest.raises(ValueError, match="more than one label"):
        metadata.video_candidates(labels.unionByName(labels), manifest, parts, segmented, 5)
    with pytest.raises(ValueError, match="more than one manifest"):
        metadata.video_candidates(labels, manifest.unionByName(manifest.withColumn("part", F.lit("q"))), parts, segmented, 5)
    none = metadata.video_candidates(labels, manifest, parts, segmented.limit(0), 5)
    assert tuple(metadata.audit(labels, manifest, none).first()) == (1, 0, 1, 0)


def test_names_of_folders_are_not_escaped(spark):
    root = new_folder(spark, "odd")
    write_text(spark, f"{root}/a b+c%d/é v/metadata.json", '{"source": "s", "label": 0, "frames": []}')
    row = readers.manifests(spark, root).first()
    assert (row.part, row.video) == ("a b+c%d", "é v") and folders_in(spark, root) == ["a b+c%d"] and file_exists(spark, root) and root.startswith(shared_dir(spark))


def test_changed_files(spark):
    recorded = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", "4")], "path string, sha256 string")
    actual = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", None), ("e", "5")], "path string, sha256 string")
    assert sorted(map(tuple, checks.changed_files(recorded, actual).collect())) == [("b", "2", "changed"), ("d", "4", "missing")]
    with pytest.raises(ValueError, match="tuned encoder"):
        checks.require_none(checks.changed_files(recorded, actual), "tuned encoder")
