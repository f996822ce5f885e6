"""Mixing sources to target weights by a time-varying curriculum.

Training time runs from 0 to 1. Each source has a weight schedule over it, linear between knots. The integral of a source's
weights is its share of the whole run, so the schedule's shape says *when* the source is seen and its integral how much of
it. A source's documents stand in a line in keyed-hash order, once per epoch; a document that begins at token c of a target
of T tokens is due when the schedule's integral reaches c / T of its whole, and inverting that (a quadratic in each linear
piece) gives its training position. Documents sorted by position are the curriculum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, key_hex, lookup_join, materialise, words

#: Base weights by a source's rank in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source is seen more often than this.
MOST_EPOCHS = 3
#: Relative weight at evenly spaced knots of training time, by the same rank: the heavy sources fade, the light ones grow.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
#: Hexadecimal digits of the key that cut each source's order into groups, so that no window holds a whole source.
BUCKET_DIGITS = 3


def integrated(schedule: tuple[float, ...]) -> list[tuple[float, float, float, float, float]]:
    """Pieces (share before, share after, begin, weight at begin, slope) of a schedule linear between evenly spaced knots;
    shares are of the whole integral."""
    step = 1 / (len(schedule) - 1)
    areas = [(a + b) / 2 * step for a, b in zip(schedule, schedule[1:])]
    whole, done, out = sum(areas), 0.0, []
    for k, area in enumerate(areas):
        out.append((done / whole, (done + area) / whole, k * step, schedule[k] / whole, (schedule[k + 1] - schedule[k]) / step / whole))
        done += area
    return out


def invert(share: Column, schedule: tuple[float, ...]) -> Column:
    """Training time at which the schedule's integral reaches the share."""
    out = F.lit(1.0)
    for before, after, begin, weight, slope in reversed(integrated(schedule)):
        rest = F.greatest(share - F.lit(before), F.lit(0.0))
        t = F.lit(begin) + 2.0 * rest / (F.lit(weight) + F.sqrt(F.greatest(F.lit(weight * weight) + 2.0 * slope * rest, F.lit(0.0))))
        out = F.when(share < after, t).otherwise(out)
    return F.least(out, F.lit(1.0))


def position(share: Column, rank: Column, schedules: tuple[tuple[float, ...], ...] = SCHEDULES) -> Column:
    out = None
    for k, s in enumerate(schedules):
        case = F.pmod(rank, F.lit(len(schedules))) == k
        out = F.when(case, invert(share, s)) if out is None else out.when(case, invert(share, s))
    return out


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, rank, target) from (source, size). Sources in code-point order, null last, share the sum of
    all sizes by weight; a target stops at `most` times its source's size and the excess is reshared. The level (words per
    unit of weight) after all resharing is found at once: with sources in order of most * size / weight and the first k of
    them capped, the rest of the sum / the rest of the weights rises with k while caps bind and falls afterwards, so
    the level is its largest value."""
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(w) for w in weights])
    per = per.withColumn("rank", F.row_number().over(order) - 1)
    per = per.withColumn("weight", F.element_at(table, (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("bound", most * F.col("source_size") / F.col("weight"))
    up = Window.orderBy("bound", "rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    per = per.withColumn("capped_before", F.coalesce(F.sum(most * F.col("source_size")).over(up), F.lit(0)))
    per = per.withColumn("weight_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(up), F.lit(0)))
    per = per.withColumn("level_here", (F.sum("source_size").over(whole) - F.col("capped_before")) / F.col("weight_left"))
    per = per.withColumn("level", F.max("level_here").over(whole))
    target = F.when(F.col("bound") <= F.col("level"), (most * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.col("level"))
    return per.select("source", "source_size", "rank", target.alias("target"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, rank, start (words before it in its source's order)
    and occurrences, an array of (epoch, position, words): whole epochs first; of the last, partial one the documents
    up to the target, where the run stops inside the last document.

    A null text has size 0; a null source is a source of its own, last in order; documents of size 0 are never taken;
    repeated rows each take their own place in the order; a very long text is one document like others; an empty table
    gives no rows. Only doc_id, text and source are read, so other columns never clash. The order is keyed by doc_id and
    text, so that rows without a doc_id, or of one doc_id, spread over the buckets too.
    """
    doc_id = F.col("doc_id").cast("long")
    sizes = docs.select(doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), words("text").alias("size"), key_hex(seed, doc_id, F.md5("text")).alias("order_key"), F.spark_partition_id().alias("lot"))
    sizes = materialise(sizes, "sizes")
    per = materialise(targets(sizes, weights, most).coalesce(1), "targets")
    # rows that are alike are one until they are numbered, for each partition that has some, so that they need not share a window
    rows = sizes.groupBy("source", "order_key", "doc_id", "size", "lot").agg(F.count(F.lit(1)).alias("alike"), F.sum("size").alias("sizes"))
    rows = rows.withColumn("bucket", F.substring("order_key", 1, BUCKET_DIGITS))
    counts = rows.groupBy("source", "bucket").agg(F.sum("sizes").alias("n"))
    by_bucket = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), F.coalesce(F.sum("n").over(by_bucket), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("order_key", F.col("doc_id").asc_nulls_first(), "size", "lot").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("sizes").over(inside), F.lit(0)))
    rows = rows.join(bases, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("alike") - 1)))
    rows = rows.withColumn("start", F.col("base") + F.col("inside") + F.col("nth") * F.col("size")).drop("b_source", "b_bucket", "base", "inside", "bucket", "nth", "alike", "sizes", "lot")
    rows = lookup_join(rows, per, "source", F.col("doc_id"))
    goal = F.round("target").cast("long")
    taken = lambda e: F.greatest(F.least(goal - (e * F.col("source_size") + F.col("start")), F.col("size")), F.lit(0))
    due = lambda e: position(F.try_divide(e * F.col("source_size") + F.col("start"), F.col("target")), F.col("rank"))
    epochs = F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long"))
    occurrences = F.filter(F.transform(epochs, lambda e: F.struct(e.alias("epoch"), F.when(taken(e) > 0, due(e)).alias("position"), taken(e).alias("words"))), lambda x: x["words"] > 0)
    return rows.select("doc_id", "size", "source", "source_size", "target", "rank", "start", occurrences.alias("occurrences"))


def curriculum(planned: DataFrame) -> DataFrame:
    """The training order: one row per occurrence of a document, range-sorted by position."""
    rows = planned.select("doc_id", "source", "size", F.explode("occurrences").alias("o")).select("doc_id", "source", "size", "o.*")
    return rows.orderBy("position", "doc_id", "epoch")


def digest(planned: DataFrame) -> DataFrame:
    """One row per document, range-sorted by the position at which it is first due (never: last)."""
    taken = F.aggregate("occurrences", F.lit(0).cast("long"), lambda s, o: s + o["words"])
    first = F.round(F.try_element_at("occurrences", F.lit(1))["position"], 9)
    out = planned.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.size("occurrences").cast("long").alias("n_occurrences"), first.alias("first_position"))
    return out.orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = "mix") -> DataFrame:
    """The documents as the mix trains on them, in the columns of docs: each as often as it occurs, whole, range-sorted by its
    training positions, so that the order of the rows is the curriculum; documents that the mix takes nothing of go.

    Null, empty and blank texts are never taken; a null source is a source of its own; a very long text is one document like
    others. Rows of one doc_id and source count as one document here: they occur where that of them does which occurs most.
    Ties in position are settled by doc_id, epoch and text. Other columns are carried along, whatever their names; no
    rows give none."""
    planned = plan(docs, weights, most, seed)
    best = planned.groupBy("doc_id", "source").agg(F.max(F.struct(F.size("occurrences").alias("n"), "occurrences")).alias("best")).where("best.n > 0")
    best = best.select(F.col("doc_id").alias("__mix_id"), F.col("source").alias("__mix_source"), F.col("best.occurrences").alias("__occurrences"))
    on = docs["doc_id"].cast("long").eqNullSafe(F.col("__mix_id")) & docs["source"].cast("string").eqNullSafe(F.col("__mix_source"))
    out = docs.where(F.coalesce(docs["text"].rlike(WORD), F.lit(False))).join(best.hint("shuffle_hash"), on)
    out = out.withColumn("__due", F.explode("__occurrences"))
    return out.orderBy("__due.position", docs["doc_id"].asc_nulls_last(), "__due.epoch", F.xxhash64(docs["text"])).select(*[docs[c] for c in docs.columns])


def oracle(weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = "mix", table: str = "documents") -> str:
    """DuckDB SQL for digest(plan(documents)), the level being found by trying every number of capped sources."""
    shape = "CASE rank % 3 " + " ".join(f"WHEN {k} THEN {_invert_sql(s)}" for k, s in enumerate(SCHEDULES)) + " END"
    return f"""
WITH sizes AS (SELECT doc_id, source, md5('{seed}|' || coalesce('v' || doc_id, 'n') || '|' || coalesce('v' || md5(text), 'n')) AS order_key, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM {table}),
per0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
per1 AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS rank FROM per0),
per2 AS (SELECT *, {list(weights)}[(rank % {len(weights)} + 1)::INT] AS weight FROM per1),
per3 AS (SELECT *, {most} * source_size / weight::DOUBLE AS bound, row_number() OVER (ORDER BY {most} * source_size / weight::DOUBLE, rank) - 1 AS k FROM per2),
levels AS (SELECT a.k, a.bound, (SELECT (sum(source_size) - coalesce(sum(CASE WHEN b.k < a.k THEN {most} * source_size END), 0))::DOUBLE
  / sum(CASE WHEN b.k >= a.k THEN weight END)::DOUBLE FROM per3 b) AS level FROM per3 a),
chosen AS (SELECT max(level) AS level FROM levels),
per AS (SELECT source, source_size, rank, CASE WHEN bound <= level THEN ({most} * source_size)::DOUBLE ELSE weight * level END AS target FROM per3, chosen),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY order_key, doc_id NULLS FIRST, size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM sizes),
joined AS (SELECT p.doc_id, size, source_size, target, rank, start, round(target)::BIGINT AS goal FROM placed p JOIN per ON p.source IS NOT DISTINCT FROM per.source),
every AS (SELECT *, e.epoch AS epoch, greatest(least(goal - (e.epoch * source_size + start), size), 0) AS w, (e.epoch * source_size + start) / target AS u
  FROM joined, (SELECT unnest(range({most})) AS epoch) e)
SELECT doc_id, size, source_size, target, sum(w)::BIGINT AS taken, count(*) FILTER (w > 0) AS n_occurrences,
  round(min(CASE WHEN w > 0 THEN {shape} END), 9) AS first_position
FROM every GROUP BY doc_id, size, source_size, target, start, rank"""


def _invert_sql(schedule: tuple[float, ...]) -> str:
    cases = "".join(f" WHEN u < {b!r} THEN least({t!r} + 2.0::DOUBLE * greatest(u - {a!r}::DOUBLE, 0) / ({w!r}::DOUBLE + sqrt(greatest({w * w!r}::DOUBLE + 2.0::DOUBLE * {s!r}::DOUBLE * greatest(u - {a!r}::DOUBLE, 0), 0))), 1)" for a, b, t, w, s in integrated(schedule))
    return f"CASE{cases} ELSE 1.0 END"
