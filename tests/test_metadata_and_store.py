import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondera.functions import paths
from sondera.operators import metadata
from sondera.plans import checks, control, encoding
from sondera.sources import readers, sinks
from sondera.streaming import scoring as streaming


def write(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))


@pytest.fixture
def dataset(tmp_path):
    write(tmp_path / "labels.csv", "﻿filename,label\na.mp4,0\nb.mp4,1\nc.mp4,0\n")
    frames = [{"status": "ok", "frame_index": k, "file": f"{k}.jpg"} for k in range(3)] + [{"status": "no_face", "frame_index": 9, "file": "9.jpg"}]
    write(tmp_path / "crops/p1/a/metadata.json", {"source": "a.mp4", "label": 0, "settings": {"image_size": "224"}, "frames": frames})
    write(tmp_path / "crops/p1/b/metadata.json", {"source": "b.mp4", "label": 1, "frames": frames[:1]})
    write(tmp_path / "raw/p1/metadata.json", {"a.mp4": {"label": "REAL"}, "b.mp4": {"label": "FAKE", "original": "a.mp4"}})
    return tmp_path


def test_metadata_pipeline(spark, dataset):
    labels = readers.label_csv(spark, f"file://{dataset}/labels.csv")
    assert [r.filename for r in labels.orderBy("filename").collect()] == ["a.mp4", "b.mp4", "c.mp4"]
    manifests = readers.manifests(spark, f"file://{dataset}/crops")
    parts = readers.part_metadata(spark, f"file://{dataset}/raw")
    segmented = spark.createDataFrame([("p1-a-frame_000000.jpg",), ("p1-a-frame_000002.jpg",), ("p1-b-frame_000000.jpg",)], "file string")
    got = {r.video: r for r in metadata.video_candidates(labels, manifests, parts, segmented, 10).collect()}
    assert set(got) == {"p1/a", "p1/b"}
    assert got["p1/a"].family == got["p1/b"].family == "p1/a" and got["p1/b"].y == 1
    assert [f.frame_index for f in got["p1/a"].frames] == [0, 2]
    bad = manifests.withColumn("label", 1 - F.col("label"))
    with pytest.raises(Exception, match="labels differ"):
        metadata.video_candidates(labels, bad, parts, segmented, 10).collect()


def test_listing_and_digests(spark, dataset):
    files = readers.listing(spark, f"file://{dataset}", "*.json")
    assert files.count() == 3
    assert readers.stem_index(files).first().stem == "metadata"
    assert len(readers.file_digests(spark, f"file://{dataset}", "labels.csv").first().sha256) == 64
    write(dataset / "list.txt", "0 v1.mp4\n\n1   part/v 2.mp4\n")
    assert [r.name for r in readers.name_list(spark, f"file://{dataset}/list.txt").collect()] == ["v1.mp4", "part/v 2.mp4"]


def test_unique_match(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1)], "stem string, label int")
    index = spark.createDataFrame([("a", "x/a.mp4"), ("b", "x/b.mp4"), ("b", "y/b.mp4")], "stem string, path string")
    assert [r.path for r in metadata.unique_match(rows, index, "stem").collect()] == ["x/a.mp4"]
    with pytest.raises(Exception, match="not exactly one"):
        metadata.unique_match(spark.createDataFrame([("b", 1)], "stem string, label int"), index, "stem").collect()


def test_paths(spark):
    row = spark.createDataFrame([("p1/v/frame_000001.jpg",)], "p string")
    r = row.select(paths.stem(F.col("p")).alias("s"), paths.suffix(F.col("p")).alias("x"), paths.parent_name(F.col("p")).alias("n"), paths.flat_name(F.col("p")).alias("f"), paths.inside(F.col("p"), F.lit("p1")).alias("i"), paths.flat_name(F.lit("a-b/c/d.jpg")).alias("bad")).first()
    assert tuple(r) == ("frame_000001", ".jpg", "v", "p1-v-frame_000001.jpg", True, None)


def test_bank_round_trip_and_resume(spark, tmp_path):
    patches = spark.createDataFrame([(k, k // 2, k % 2, [1.0, float(k)]) for k in range(6)], "bank_patch_id long, source_idx int, patch_id int, embedding array<double>")
    sources = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "source_idx int, image string")
    where = f"file://{tmp_path}/bank"
    sinks.bank(patches, sources, where, "hash", 0.5, 0.1)
    again, _ = sinks.load_bank(spark, where, "hash")
    assert checks.same_rows(again, patches)
    with pytest.raises(ValueError):
        sinks.load_bank(spark, where, "other")
    assert sinks.pending(patches, patches.where("bank_patch_id < 4"), ["bank_patch_id"]).count() == 2
    with pytest.raises(Exception, match="not finite"):
        sinks.json_report(spark.createDataFrame([(float("nan"),)], "x double"), f"file://{tmp_path}/r")
    good, bad = sinks.quarantine(patches, F.col("bank_patch_id") == 1, "odd")
    assert (good.count(), bad.count()) == (5, 1)


def test_checks(spark):
    v = spark.createDataFrame([([1.0, 2.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([1.0],), (None,)], "v array<double>")
    assert checks.bad_vectors(v, "v", 2).count() == 4
    with pytest.raises(ValueError):
        checks.require_none(checks.duplicates(spark.createDataFrame([(1,), (1,)], "k int"), ["k"]), "keys")
    a = spark.createDataFrame([(k, "x") for k in range(50)], "k int, s string")
    assert checks.row_signature(a, ["k", "s"]).first() == checks.row_signature(a.orderBy(F.desc("k")), ["k", "s"]).first()


def test_control(spark, tmp_path):
    s = control.load_settings(None, {"neighbours": 4, "shuffle_partitions": 7})
    control.freeze(spark, s, str(tmp_path / "e"))
    control.freeze(spark, control.load_settings(None, {"neighbours": 4}), str(tmp_path / "e"))
    with pytest.raises(ValueError):
        control.freeze(spark, control.Settings(), str(tmp_path / "e"))
    assert control.recover(str(tmp_path / "e"), str(tmp_path / "f"))
    assert (tmp_path / "e/settings.json").read_bytes() == (tmp_path / "f/settings.json").read_bytes()
    with control.run_lock(spark, str(tmp_path)), pytest.raises(RuntimeError), control.run_lock(spark, str(tmp_path)):
        pass
    with control.run_lock(spark, str(tmp_path)):
        pass
    with pytest.raises(ValueError):
        control.load_settings(None, {"top_fraction": 2})
    with pytest.raises(RuntimeError):
        control.require_stage(spark, str(tmp_path), "bank")


def test_encoder_hook(spark):
    def make():
        return lambda batch: np.ones((len(batch), 4, 2)) * batch["item_id"].to_numpy()[:, None, None]

    items = spark.createDataFrame([(3,), (5,)], "item_id long")
    got = encoding.encode(items, make, "test").orderBy("item_id", "patch_id").collect()
    assert [(r.item_id, r.patch_id, r.embedding) for r in got][:2] == [(3, 0, [3.0, 3.0]), (3, 1, [3.0, 3.0])] and len(got) == 6


def test_stream_scores_each_file_once(spark, tmp_path):
    bank = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    for k in range(3):
        spark.createDataFrame([(k, [1.0, float(k)], 0)], streaming.SCHEMA).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    for _ in range(2):
        streaming.score_stream(spark, f"file://{tmp_path}/in/*", bank, f"file://{tmp_path}/out", f"file://{tmp_path}/ck", 1).awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out/*").orderBy("vec_id").collect()
    assert [(r.vec_id, r.bank_id) for r in got] == [(0, 0), (1, 0), (2, 1)]


def test_zip_of_unequal_lists_is_an_error(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], [1.0, 2.0]), (2, [], [])], "k int, a array<string>, b array<double>")
    got = rows.select(metadata.zipped(F.col("a"), F.col("b"), "x", "y").alias("z")).collect()
    assert [[tuple(z) for z in r.z] for r in got] == [[("a", 1.0), ("b", 2.0)], []]
    odd = spark.createDataFrame([(1, ["a"], [1.0, 2.0])], "k int, a array<string>, b array<double>")
    with pytest.raises(Exception, match="unequal"):
        odd.select(metadata.zipped(F.col("a"), F.col("b"), "x", "y").alias("z")).collect()
