"""Command line: python -m sondera.cli <stage> --data DIR --output DIR [--settings FILE] [--neighbours N] ...

Stages: bank (split, reference bank), score (held-out images against the bank, both methods), ablation (boundary weights and
family cap on saved evidence), cluster (paired diagnostics), all.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vectors
from .operators import diagnostics, metrics, scoring, search, splits
from .plans import checks, control
from .plans.views import patch_view
from .session import file_exists, local_session, write_text
from .sources import readers, sinks


def build_bank(spark: SparkSession, data: str, output: str, s: control.Settings) -> None:
    """Splits patches by family and writes the plan and the bank of real patches."""
    rows = splits.full_split(patch_view(readers.parquet(spark, f"{data}/embeddings.parquet")), s.seed)
    rows.write.mode("overwrite").partitionBy("role").parquet(f"{output}/plan")
    plan = spark.read.parquet(f"{output}/plan")
    checks.require_none(splits.overlapping_families(plan), "families in several roles")
    checks.require_none(checks.held_out_overlap(plan), "bank families held out")
    checks.require_none(scoring.without_foreground(plan, s.foreground_minimum), "images without foreground patches")
    checks.require_none(checks.bad_vectors(plan.where("role = 'bank'"), "embedding", plan.select(F.size("embedding").alias("d")).first().d), "invalid bank vectors")
    bank = _patches(plan, s).where("role = 'bank'").select(F.col("vec_id").alias("bank_patch_id"), F.col("image_id").alias("source_idx"), "patch_id", "family", "embedding")
    signature = checks.row_signature(plan.select("vec_id", "role"), ["vec_id", "role"]).first().signature
    sinks.bank(bank, bank.select("source_idx", "family").distinct(), f"{output}/bank", signature, s.foreground_minimum, s.top_fraction)


def _patches(plan: DataFrame, s: control.Settings) -> DataFrame:
    return scoring.foreground(plan, s.foreground_minimum)


def score(spark: SparkSession, output: str, s: control.Settings) -> None:
    """Searches held-out patches that have no evidence yet, then calibrates and reports both methods."""
    control.require_stage(spark, output, "bank/complete")
    plan = spark.read.parquet(f"{output}/plan")
    signature = checks.row_signature(plan.select("vec_id", "role"), ["vec_id", "role"]).first().signature
    patches, _ = sinks.load_bank(spark, f"{output}/bank", signature)
    bank = patches.select("bank_patch_id", "embedding")
    todo = held = _patches(plan, s).where("role IN ('calibration', 'evaluation')")
    if file_exists(spark, f"{output}/evidence"):
        todo = sinks.pending(held, spark.read.parquet(f"{output}/evidence"), ["vec_id"])
    if not todo.isEmpty():
        found = search.nearest(todo.select("vec_id", "embedding"), bank, s.neighbours, s.broadcast_bytes)
        weighted = scoring.softmax_weights(found, s.temperature)
        dist = scoring.reconstruction_distance(weighted, bank, todo.select("vec_id", "embedding"))
        lists = weighted.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "bank_id", "similarity", "weight"))).alias("candidates"))
        near = lists.select("query_id", "candidates", vectors.distance(F.col("candidates")[0]["similarity"]).alias("nearest_distance"))
        rows = todo.select("vec_id", "role", "y", "image_id", "patch_id", "family")
        rows.join(near, rows["vec_id"] == near["query_id"]).drop("query_id").join(dist, F.col("vec_id") == F.col("query_id")).drop("query_id").write.mode("append").partitionBy("role").parquet(f"{output}/evidence")
    evidence = spark.read.parquet(f"{output}/evidence")
    long_ = evidence.select("image_id", "role", "y", "patch_id", F.explode(F.create_map(F.lit("nearest"), F.col("nearest_distance"), F.lit("topk"), F.col("topk_distance"))).alias("method", "value"))
    scores = scoring.top_fraction_mean(long_, ["method", "image_id", "role", "y"], "value", s.top_fraction, "patch_id")
    _report(scores, "method", s, f"{output}/scores", f"{output}/metrics")


def ablation(spark: SparkSession, output: str, s: control.Settings) -> None:
    """Reweights saved candidates under a family cap and weighs edge patches down; no new search."""
    evidence = spark.read.parquet(f"{output}/evidence")
    plan = _patches(spark.read.parquet(f"{output}/plan"), s)
    asked = plan.where("role IN ('calibration', 'evaluation')").withColumnRenamed("image_id", "sample_id")
    checks.require_none(checks.evidence_mismatch(asked, evidence.withColumnRenamed("image_id", "sample_id")), "saved evidence is not that of the plan")
    bank = plan.where("role = 'bank'").select(F.col("vec_id").alias("bank_id"), "embedding")
    family = plan.where("role = 'bank'").select(F.col("vec_id").alias("bank_id"), "family")
    candidates = evidence.select(F.col("vec_id").alias("query_id"), F.inline("candidates")).drop("weight").join(family, "bank_id")
    capped = scoring.softmax_weights(scoring.family_cap(candidates, s.family_cap), s.temperature, keep=F.col("keep"))
    held = plan.where("role IN ('calibration', 'evaluation')")
    diverse = scoring.reconstruction_distance(capped, bank, held.select("vec_id", "embedding")).toDF("vec_id", "diverse")
    side = 3
    cells = evidence.select("image_id", "patch_id", F.floor(F.col("patch_id") / side).alias("row"), (F.col("patch_id") % side).alias("col"))
    edge = scoring.boundary(cells, "image_id", "row", "col").select("image_id", "patch_id", F.when(F.col("interior"), 1.0).otherwise(s.boundary_weight).alias("w"))
    rows = evidence.join(diverse, "vec_id").join(edge, ["image_id", "patch_id"])
    base, other, w = F.col("topk_distance"), F.col("diverse"), F.col("w")
    variants = F.create_map(F.lit("topk"), base, F.lit("topk_boundary"), base * w, F.lit("family_cap_topk"), other, F.lit("family_cap_topk_boundary"), other * w)
    long_ = rows.select("image_id", "role", "y", "patch_id", F.explode(variants).alias("variant", "value"))
    scores = scoring.top_fraction_mean(long_, ["variant", "image_id", "role", "y"], "value", s.top_fraction, "patch_id")
    _report(scores, "variant", s, f"{output}/ablation_scores", f"{output}/ablation_report")


def cluster(spark: SparkSession, output: str, s: control.Settings) -> None:
    """Pairs a real and a fake image of each family and reports how far apart they are."""
    plan = _patches(spark.read.parquet(f"{output}/plan"), s).where("role IN ('bank', 'train_fake')")
    pairs = splits.paired_samples(plan.select("family", F.col("image_id").alias("image"), "y").distinct(), 500, s.seed)
    pooled = diagnostics.mean_pool(plan.select("image_id", "embedding"), "image_id")
    rows = pairs.join(pooled, F.col("image") == F.col("image_id")).drop("image_id")
    reduced, explained = diagnostics.principal_components(rows.select("analysis_id", "y", "vector"), 64)
    two = diagnostics.kmeans(reduced, 2, seed=s.seed)
    sinks.csv_report(two.select("analysis_id", "y", "cluster", F.col("reduced")[0].alias("pca_x"), F.col("reduced")[1].alias("pca_y")), f"{output}/projection", ["analysis_id", "y", "cluster", "pca_x", "pca_y"])
    cosines = diagnostics.pair_cosines(rows).agg(F.avg("paired").alias("paired"), F.avg("shifted").alias("shifted"))
    one = lambda df: F.broadcast(df)
    report = cosines.join(one(diagnostics.centroid_cosine(rows)), how="cross").join(one(diagnostics.agreement(two, "y", "cluster")), how="cross").withColumn("pca_explained", F.lit(explained))
    sinks.json_report(report, f"{output}/cluster_report")
    eight = diagnostics.kmeans(reduced, 8, seed=s.seed)
    sinks.json_report(diagnostics.composition(eight.select("cluster", "y")), f"{output}/cluster_composition")
    figures = report.first().asDict()
    for metric in ("cosine", "euclidean"):
        for name, table, label, vector in (("labels", rows, "y", "vector"), ("clusters", two, "cluster", "reduced")):
            one_row = diagnostics.silhouette(table.select(F.col("analysis_id").alias("id"), label, F.col(vector).alias("vector")), label, metric).first()
            figures[f"silhouette_{metric}_{name}"] = one_row.silhouette
    write_text(spark, f"{output}/cluster_report.md", "\n".join(["| figure | value |", "|-|-|", *(f"| {k} | {v:.6g} |" for k, v in figures.items())]) + "\n")


def _report(scores: DataFrame, group: str, s: control.Settings, table: str, report: str) -> None:
    limits = metrics.threshold(scores.where("role = 'calibration'"), s.threshold_quantile, group=[group])
    labelled = scores.join(limits, group).withColumn("prediction", F.when(F.col("score") > F.col("threshold"), "anomaly").otherwise("normal"))
    sinks.json_report(labelled, table)
    sinks.json_report(metrics.ranking_metrics(scores.where("role = 'evaluation'"), limits, [group]), report)


STAGES = ("bank", "score", "ablation", "cluster", "all")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("stage", choices=STAGES)
    parser.add_argument("--data", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--settings")
    for name, kind in (("method", str), ("neighbours", int), ("temperature", float), ("family_cap", int), ("boundary_weight", float), ("top_fraction", float), ("threshold_quantile", float), ("seed", int)):
        parser.add_argument(f"--{name.replace('_', '-')}", type=kind, dest=name)
    args = vars(parser.parse_args(argv))
    stage, data, output, file = (args.pop(k) for k in ("stage", "data", "output", "settings"))
    settings = control.load_settings(file, args)
    spark = SparkSession.getActiveSession() or local_session()
    control.freeze(spark, settings, output)
    with control.run_lock(spark, output):
        if stage in ("bank", "all"):
            build_bank(spark, data, output, settings)
        if stage in ("score", "all"):
            score(spark, output, settings)
        if stage in ("ablation", "all"):
            ablation(spark, output, settings)
        if stage in ("cluster", "all"):
            cluster(spark, output, settings)


if __name__ == "__main__":
    main()
