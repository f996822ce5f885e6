"""The metadata pipeline: labels, manifests and part files joined, audited and sampled into a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..plans import checks
from . import sampling, splits


def label_conflicts(labels: DataFrame, key: str, label: str) -> DataFrame:
    """(key, rows, labels) of keys that come more than once or with several labels."""
    per = labels.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(label).alias("labels"))
    return per.where("rows > 1 OR labels > 1")


def join_audit(labels: DataFrame, items: DataFrame, key: str, size: str) -> DataFrame:
    """One row of counters: labels, labels without an item, items without a label, empty items (size 0), eligible ones."""
    a = labels.select(key).withColumn("l", F.lit(1))
    b = items.select(key, F.col(size).alias("s")).withColumn("i", F.lit(1))
    both = a.join(b, key, "full")
    has = lambda c: F.col(c).isNotNull()
    return both.agg(F.count_if(has("l")).alias("labels"), F.count_if(has("l") & ~has("i")).alias("missing_items"), F.count_if(~has("l")).alias("unlabelled_items"), F.count_if(has("l") & (F.col("s") == 0)).alias("empty_items"), F.count_if(has("l") & (F.col("s") > 0)).alias("eligible"))


def exclude(rows: DataFrame, exclusions: DataFrame, key: str) -> DataFrame:
    return rows.join(exclusions.select(key).distinct(), key, "left_anti")


def unique_match(rows: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """rows joined to the index where the key stands there exactly once; any other number is an error. Repeated rows collapse."""
    once = index.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.any_value("path").alias("path"))
    joined = rows.dropDuplicates().join(once, key, "left")
    bad = F.coalesce(F.col("__n"), F.lit(0)) != 1
    return joined.withColumn("path", F.when(bad, F.raise_error(F.concat(F.lit("not exactly one file for "), F.col(key).cast("string")))).otherwise(F.col("path"))).drop("__n")


def video_candidates(labels: DataFrame, manifests: DataFrame, parts: DataFrame, segmented: DataFrame, frames: int) -> DataFrame:
    """(video, family, y, part, frames): labelled videos whose manifest, part file and label agree, with at most `frames` evenly
    spaced segmented face frames each.

    labels (filename, label); manifests (part, video, source, label, frames ARRAY<STRUCT<status, frame_index, file>>); parts (part,
    filename, label, original); segmented (file). Videos without a label are left out, and so are those without a frame (audit()
    counts them); a video that has two labels or two manifests, or labels that contradict one another, is an error."""
    named = labels.select(paths.stem(F.col("filename")).alias("video"), F.col("label").alias("csv_label"))
    checks.require_none(label_conflicts(named, "video", "csv_label"), "videos with more than one label")
    rows = manifests.join(named, "video")
    checks.require_none(checks.duplicates(rows, ["video"]), "videos with more than one manifest")
    agree = F.col("label") == F.col("csv_label")
    rows = rows.withColumn("y", F.when(agree, F.col("label")).otherwise(F.raise_error(F.concat(F.lit("labels differ for "), F.col("video"))).cast("int")))
    raw = parts.select("part", F.col("filename").alias("source"), F.when(F.col("label") == "FAKE", 1).when(F.col("label") == "REAL", 0).alias("raw_label"), "original")
    rows = rows.join(raw, ["part", "source"], "left")
    same = F.col("raw_label") == F.col("y")
    family = F.when(F.coalesce(same, F.lit(False)), paths.family_key(F.col("part"), F.col("y"), F.col("original"), F.col("source"))).otherwise(F.raise_error(F.concat(F.lit("source label differs or is missing for "), F.col("video"))))
    faces = rows.select("part", "video", "y", family.alias("family"), F.explode(F.filter("frames", lambda f: f["status"] == "ok")).alias("f"))
    faces = faces.withColumn("file", F.concat(F.concat_ws("-", "part", "video", F.format_string("frame_%06d", F.col("f.frame_index"))), F.lit(".jpg")))
    faces = faces.join(segmented.select("file"), "file", "left_semi").select("part", "video", "y", "family", F.col("f.frame_index").alias("frame_index"), "file")
    kept = sampling.even_sample(faces, ["part", "video"], ["frame_index"], frames)
    out = kept.groupBy("part", "video", "y", "family").agg(F.array_sort(F.collect_list(F.struct("frame_index", "file"))).alias("frames"))
    return out.withColumn("video", F.concat_ws("/", "part", "video"))


def audit(labels: DataFrame, manifests: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: csv_videos, missing_manifests (labels without one), zero_face_videos (no frame was left), eligible_videos."""
    a = labels.select(paths.stem(F.col("filename")).alias("stem")).withColumn("l", F.lit(1))
    b = manifests.select(F.col("video").alias("stem")).withColumn("m", F.lit(1))
    c = candidates.select(paths.name(F.col("video")).alias("stem")).withColumn("c", F.lit(1))
    has = lambda x: F.col(x).isNotNull()
    both = a.join(b, "stem", "left").join(c, "stem", "left")
    return both.agg(F.count(F.lit(1)).alias("csv_videos"), F.count_if(~has("m")).alias("missing_manifests"), F.count_if(has("m") & ~has("c")).alias("zero_face_videos"), F.count_if(has("c")).alias("eligible_videos"))


def bank_only_plan(candidates: DataFrame, limit: int, seed: int = splits.SEED) -> DataFrame:
    """The bank of an independent run: frames of the first `limit` real videos in keyed order, with sample_id."""
    chosen = splits.bank_only(candidates, limit, seed)
    rows = chosen.select(F.lit("bank").alias("role"), "video", "family", "y", F.explode("frames").alias("f")).select("role", "video", "family", "y", "f.*")
    return splits.sample_ordinals(rows, "role", "video", "frame_index")


def plan(candidates: DataFrame, seed: int = splits.SEED) -> DataFrame:
    """The full split of video candidates, one row per frame: role, sample_id (per role, by video and frame), video, family, y,
    frame_index, file."""
    split = splits.full_split(candidates, seed)
    rows = split.select("role", "video", "family", "y", F.explode("frames").alias("f")).select("role", "video", "family", "y", "f.*")
    return splits.sample_ordinals(rows, "role", "video", "frame_index")


def zipped(a: Column, b: Column, first: str, second: str) -> Column:
    """Two arrays place by place as structs; arrays of unequal length are an error."""
    checked = F.when(F.size(a) == F.size(b), a).otherwise(F.transform(a, lambda x: F.when(F.raise_error(F.lit("lists of unequal length")).isNull(), x)))
    return F.zip_with(checked, b, lambda x, y: F.struct(x.alias(first), y.alias(second)))
