"""Calibration and ranking metrics, tie-exact and without a global sort of all rows: scores are grouped first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import running_sums
from ..session import materialise

#: Distinct scores that one task may accumulate; more are accumulated by ranges.
FEW_SCORES = 1_000_000
#: Relative error in rank of the sketch that brackets a quantile.
SKETCH = 10_000
#: Brackets of quantiles, one per group and quantile, that may be broadcast.
FEW_BRACKETS = 100_000


def exact_quantiles(rows: DataFrame, group: list[str], value: str, quantiles: list[float]) -> DataFrame:
    """(group, q ARRAY<DOUBLE>): exact quantiles, linearly interpolated between the two nearest ranks; nulls do not count. A sketch
    of bounded size brackets each quantile's ranks; values under a bracket are counted, and only those within it, under a
    thousandth of a large group, are ordered. Small groups are one bracket. Group columns must not be null."""
    rows = rows.select(*group, F.col(value).cast("double").alias("__v")).where("__v IS NOT NULL")
    # four times the sketch's error either way
    ends = [F.lit(min(1.0, max(0.0, q + d * 4.0 / SKETCH))) for q in quantiles for d in (-1, 1)]
    sketch = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.percentile_approx("__v", F.array(*ends), F.lit(SKETCH)).alias("e"))
    small = F.col("n") <= 4 * SKETCH
    brackets = [F.struct(F.lit(k).alias("k"), F.lit(float(q)).alias("q"), F.when(small, F.col("lo")).otherwise(F.col("e")[2 * k]).alias("a"), F.when(small, F.col("hi")).otherwise(F.col("e")[2 * k + 1]).alias("b")) for k, q in enumerate(quantiles)]
    sketch = materialise(sketch.select(*group, F.col("n").alias("__n"), F.inline(F.array(*brackets))), "brackets")
    near = F.broadcast(sketch) if sketch.count() <= FEW_BRACKETS else sketch
    joined = (rows.join(near, group) if group else rows.join(near, how="cross")).where("__v <= b")
    by = [*group, "k", "q", "__n"]
    counted = joined.groupBy(*by, F.when(F.col("__v") >= F.col("a"), F.col("__v")).alias("__x")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*by).orderBy(F.col("__x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = (F.col("__n") - 1) * F.col("q")
    pick = lambda place: F.min(F.when(F.col("upto") > place, F.col("__x")))
    two = counted.withColumn("upto", upto).where("__x IS NOT NULL").groupBy(*by).agg(pick(F.floor(at)).alias("l"), pick(F.ceil(at)).alias("h"), F.min(F.col("upto") - F.col("c")).alias("under"))
    sound = F.col("l").isNotNull() & F.col("h").isNotNull() & (F.col("under") <= F.floor(at))
    exact = F.when(sound, F.col("l") + (F.col("h") - F.col("l")) * (at - F.floor(at))).otherwise(F.raise_error(F.lit("a bracket missed its quantile")).cast("double"))
    return two.select(*group, "k", exact.alias("x")).groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("q"))


def threshold(scores: DataFrame, quantile: float, value: str = "score", group: list[str] | None = None) -> DataFrame:
    """Exact, linearly interpolated quantile."""
    return exact_quantiles(scores, group or [], value, [quantile]).select(*(group or []), F.col("q")[0].alias("threshold"))


def label_scores(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Adds prediction: anomaly if score > threshold (strictly), else normal. thresholds has one row."""
    return scores.join(F.broadcast(thresholds.limit(1)), how="cross").withColumn("prediction", F.when(F.col("score") > F.col("threshold"), "anomaly").otherwise("normal"))


def score_counts(rows: DataFrame, group: list[str]) -> DataFrame:
    """(group, score, pos, neg): labels counted per distinct score."""
    return rows.groupBy(*group, "score").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))


def cumulative(rows: DataFrame, group: list[str]) -> DataFrame:
    """Per distinct score, from the highest down: tp and fp at that threshold, and the totals p and n. Many distinct scores are
    accumulated by ranges, with the totals joined to them."""
    w = Window.partitionBy(*group)
    c = materialise(score_counts(rows, group), "score-counts")
    if c.count() <= FEW_SCORES:
        down = w.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return c.withColumn("tp", F.sum("pos").over(down)).withColumn("fp", F.sum("neg").over(down)).withColumn("p", F.sum("pos").over(w)).withColumn("n", F.sum("neg").over(w))
    summed = running_sums(c, group, [F.col("score").desc()], {"pos": "tp", "neg": "fp"})
    totals = c.groupBy(*group).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return summed.join(totals, group) if group else summed.join(F.broadcast(totals), how="cross")


def ranking_metrics(rows: DataFrame, thresholds: DataFrame, group: list[str]) -> DataFrame:
    """(group, auroc, average_precision, fpr, tpr, threshold): ties count half in auroc; average precision is the step-wise
    sum; fpr and tpr are shares strictly above the threshold. A group without both classes is an error."""
    c = cumulative(rows, group)
    area = F.sum(F.col("pos") * (F.col("n") - F.col("fp") + F.col("neg") * 0.5)).cast("double")
    both = F.when((F.max("p") > 0) & (F.max("n") > 0), F.max("p") * F.max("n")).otherwise(F.raise_error(F.lit("both classes are needed")).cast("bigint"))
    ap = F.sum(F.col("pos").cast("double") / F.col("p") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    curves = c.groupBy(*group).agg((area / both).alias("auroc"), ap.alias("average_precision"))
    above = lambda y: F.avg(F.when(F.col("y") == y, (F.col("score") > F.col("threshold")).cast("double")))
    rates = rows.join(thresholds, group) if group else rows.join(F.broadcast(thresholds.limit(1)), how="cross")
    rates = rates.groupBy(*group).agg(above(0).alias("fpr"), above(1).alias("tpr"), F.max("threshold").alias("threshold"))
    return curves.join(rates, group) if group else curves.join(F.broadcast(rates), how="cross")


def roc_points(rows: DataFrame) -> DataFrame:
    """(fpr, tpr, threshold) at each distinct score and at the start (0, 0, null)."""
    c = cumulative(rows, []).select((F.col("fp") / F.col("n")).alias("fpr"), (F.col("tp") / F.col("p")).alias("tpr"), F.col("score").alias("threshold"))
    return c.unionByName(rows.sparkSession.createDataFrame([(0.0, 0.0, None)], "fpr double, tpr double, threshold double"))


def pr_points(rows: DataFrame) -> DataFrame:
    """(recall, precision, threshold, prevalence) at each distinct score and at the end (recall 0, precision 1)."""
    c = cumulative(rows, [])
    points = c.select((F.col("tp") / F.col("p")).alias("recall"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.col("score").alias("threshold"), (F.col("p") / (F.col("p") + F.col("n"))).alias("prevalence"))
    last = c.limit(1).select(F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"), F.lit(None).cast("double").alias("threshold"), (F.col("p") / (F.col("p") + F.col("n"))).alias("prevalence"))
    return points.unionByName(last)


def histogram(rows: DataFrame, value: str, group: str, bins: int = 60) -> DataFrame:
    """(group, bin from 1, count, density) over the range of all values, equal widths, the last bin closed. Only bins
    that hold values; a range of one value is widened by a half either way."""
    ends = rows.agg(F.min(value).cast("double").alias("lo0"), F.max(value).cast("double").alias("hi0"))
    ends = ends.select(F.when(F.col("lo0") == F.col("hi0"), F.col("lo0") - 0.5).otherwise(F.col("lo0")).alias("lo"), F.when(F.col("lo0") == F.col("hi0"), F.col("hi0") + 0.5).otherwise(F.col("hi0")).alias("hi"))
    cut = F.least(F.lit(bins), (F.floor((F.col(value) - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))) + 1).cast("int"))
    c = rows.join(F.broadcast(ends), how="cross").groupBy(group, cut.alias("bin"), ((F.col("hi") - F.col("lo")) / bins).alias("width")).agg(F.count(F.lit(1)).alias("count"))
    n = F.sum("count").over(Window.partitionBy(group))
    return c.select(group, "bin", "count", (F.col("count") / (n * F.col("width"))).alias("density"))
