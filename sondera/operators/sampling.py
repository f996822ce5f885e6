"""Ordered sampling and bookkeeping within groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import even_places, ordered_rank, running_sums
from ..session import materialise


def even_sample(rows: DataFrame, group: list[str], order: list[str], count: int, large: bool = False) -> DataFrame:
    """At most `count` evenly spaced rows of each ordered group, the first and last included. Groups that may be large are ranked by
    ranges, so that none is one task; many small ones by a window."""
    if large:
        ranked = materialise(ordered_rank(rows, group, order, "__place"), "ranked")
        sizes = ranked.groupBy(*[F.col(c).alias(f"__g{k}") for k, c in enumerate(group)]).agg(F.count(F.lit(1)).alias("__n"))
        on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__g{k}")) for k, c in enumerate(group)])
        placed = ranked.join(sizes, on).drop(*[f"__g{k}" for k in range(len(group))])
        return placed.where(F.array_contains(even_places(F.col("__n"), count), F.col("__place").cast("long"))).drop("__place", "__n")
    w = Window.partitionBy(*group)
    placed = rows.withColumn("__place", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    return placed.where(F.array_contains(even_places(F.col("__n"), count), F.col("__place").cast("long"))).drop("__place", "__n")


def class_limit(rows: DataFrame, label: str, order: str, most: int) -> DataFrame:
    """The first `most` rows of each class in order. The limit is applied before rows are shuffled (window group limit)."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(label).orderBy(order))).where(F.col("__r") <= most).drop("__r")


def first_per_group(rows: DataFrame, group: str, order: Column, value: Column) -> DataFrame:
    return rows.groupBy(group).agg(F.min_by(value, order).alias("first"))


def dedup_last(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row per key: its last value, at the place where it was first seen (first_seen). Both are partial aggregates."""
    others = [c for c in rows.columns if c not in (*key, order)]
    return rows.groupBy(*key).agg(F.min(order).alias("first_seen"), *[F.max_by(c, order).alias(c) for c in others])


def round_robin(rows: DataFrame, order: str, shards: int) -> DataFrame:
    """Adds shard: the row's place in order, modulo the number of shards."""
    return ordered_rank(rows, [], [order], "__rank").withColumn("shard", F.pmod(F.col("__rank"), F.lit(shards)).cast("int")).drop("__rank")


def batches(rows: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """Adds batch: consecutive lots of `size` rows of each ordered group. Rows are ranked by ranges, so a group may be large."""
    return ordered_rank(rows, [group], [order], "__place").withColumn("batch", F.floor(F.col("__place") / size)).drop("__place")


def circular_lead(rows: DataFrame, group: str, order: str, value: str, out: str = "next") -> DataFrame:
    """The next row's value in a group, the last row's next being the first."""
    w = Window.partitionBy(group).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.row_number().over(w) == F.count(F.lit(1)).over(Window.partitionBy(group))
    return rows.withColumn(out, F.when(last, F.first(value).over(whole)).otherwise(F.lead(value).over(w)))


def offsets(groups: DataFrame, order: str, size: str) -> DataFrame:
    """Exclusive running sum of group sizes (one row per group), by ranges of groups."""
    return running_sums(groups, [], [F.col(order)], {size: "offset"}, before=True)


def early_stopping(epochs: DataFrame, run: str, patience: int, minimum_delta: float) -> DataFrame:
    """Per run of (epoch, loss): best_epoch, best_loss and stop_epoch, where a loss only counts as better by more than the delta
    and training stops after `patience` epochs without one. A fold over a run's epochs, which are few."""
    rows = epochs.groupBy(run).agg(F.array_sort(F.collect_list(F.struct("epoch", "loss"))).alias("e"))
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(None).cast("int").alias("at"), F.lit(0).alias("stale"), F.lit(None).cast("int").alias("stop"))

    def step(s: Column, e: Column) -> Column:
        better = s["best"].isNull() | (e["loss"] < s["best"] - minimum_delta)
        stale = F.when(better, 0).otherwise(s["stale"] + 1)
        new = F.struct(
            F.when(better, e["loss"]).otherwise(s["best"]).alias("best"),
            F.when(better, e["epoch"]).otherwise(s["at"]).cast("int").alias("at"),
            stale.alias("stale"),
            F.when(stale >= patience, e["epoch"]).cast("int").alias("stop"),
        )
        return F.when(s["stop"].isNotNull(), s).otherwise(new)

    done = F.aggregate("e", start, step)
    return rows.select(run, done.alias("d")).select(run, F.col("d.at").alias("best_epoch"), F.col("d.best").alias("best_loss"), F.col("d.stop").alias("stop_epoch"))


def improvements(epochs: DataFrame, run: str, minimum_delta: float) -> DataFrame:
    """(run, epoch, loss) of the epochs whose loss is less than that of the last such epoch by more than the delta; the first of a
    run is one. A fold over a run's epochs, which are few."""
    rows = epochs.groupBy(run).agg(F.array_sort(F.collect_list(F.struct("epoch", "loss"))).alias("e"))
    none = F.filter("e", lambda e: F.lit(False))

    def step(kept: Column, e: Column) -> Column:
        better = (F.size(kept) == 0) | (e["loss"] < F.element_at(kept, -1)["loss"] - minimum_delta)
        return F.when(better, F.concat(kept, F.array(e))).otherwise(kept)

    return rows.select(run, F.inline(F.aggregate("e", none, step)))


def weighted_means(rows: DataFrame, by: str, weight: str, values: list[str]) -> DataFrame:
    """Per group sum(value * weight) / sum(weight)."""
    return rows.groupBy(by).agg(*[(F.sum(F.col(v) * F.col(weight)) / F.sum(weight)).alias(v) for v in values])


def ema_schedule(steps: DataFrame, start: float, end: float, total: int) -> DataFrame:
    """Adds momentum to (step): a cosine from start to end over the steps."""
    progress = F.least(F.lit(1.0), F.col("step") / float(max(1, total - 1)))
    return steps.withColumn("momentum", F.lit(end) - (end - start) * (F.cos(F.pi() * progress) + 1) / 2)


def derived_seed(epoch: Column, batch: Column, index: Column) -> Column:
    return epoch * 1_000_003 + batch * 10_007 + index
