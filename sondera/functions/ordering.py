"""Keyed order in place of a shuffle, and ranks that no single task has to count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def shuffle_key(seed: int | Column, salt: str, *columns: Column) -> Column:
    """md5 of seed|salt|columns: an order that looks random, is the same on every engine and needs no state."""
    return F.md5(F.concat_ws("|", seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed)), F.lit(salt), *[c.cast("string") for c in columns]))


def hashed_rank(df: DataFrame, key: str, tie: str, out: str, partition: tuple[str, ...] = ()) -> DataFrame:
    """Adds the 0-based rank of each row by an md5 key (and a tie column), within a partition. Rows are cut into 4096 buckets by
    the key's first digits; counts of the buckets are summed, and each bucket is ranked alone, so neither a global order
    nor a large partition has to fit one task."""
    rows = df.withColumn("__bucket", F.substring(key, 1, 3))
    by = [*partition, "__bucket"]
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    up = Window.partitionBy(*partition).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*[F.col(c).alias(f"__p{k}") for k, c in enumerate(by)], F.coalesce(F.sum("__n").over(up), F.lit(0)).alias("__base"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(key, tie)) - 1
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__p{k}")) for k, c in enumerate(by)])
    joined = rows.withColumn("__place", place).join(base, on)
    return joined.withColumn(out, F.col("__base") + F.col("__place")).drop("__bucket", "__place", "__base", *[f"__p{k}" for k in range(len(by))])


def by_ranges(df: DataFrame, partition: list[str], order: list[Column]) -> DataFrame:
    """df range-partitioned in order, with the number of each row's range. It is written to the shared folder, so that all that
    read it see the same ranges, whatever executors are lost."""
    ranged = df.repartitionByRange(*[F.col(c) for c in partition], *order).withColumn("__range", F.spark_partition_id())
    return materialise(ranged, "ranges")


def ordered_rank(df: DataFrame, partition: list[str], order: list[str], out: str) -> DataFrame:
    """Adds the 0-based rank of each row in order, within partitions that may be few and large: rows are range-partitioned,
    counted per range, and ranked within it. order must not have ties that matter."""
    return running_sums(df.withColumn("__one", F.lit(1).cast("long")), partition, [F.col(c) for c in order], {"__one": out}, before=True).drop("__one")


def running_sums(df: DataFrame, partition: list[str], order: list[Column], sums: dict[str, str], before: bool = False, xor: bool = False) -> DataFrame:
    """Adds the running sum (or exclusive or) of each column of sums, under the name given for it, in order within partitions: up
    to and with each row, or before it. No task holds more than one range of rows, or one row of sums per range."""
    fold = F.bit_xor if xor else F.sum
    ranged = by_ranges(df, partition, order)
    by = [*partition, "__range"]
    whole = ranged.groupBy(*by).agg(*[fold(c).alias(f"__s{k}") for k, c in enumerate(sums)])
    up = Window.partitionBy(*partition).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = whole.select(*[F.col(c).alias(f"__p{k}") for k, c in enumerate(by)], *[F.coalesce(fold(f"__s{k}").over(up), F.lit(0)).alias(f"__b{k}") for k in range(len(sums))])
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__p{k}")) for k, c in enumerate(by)])
    rows = ranged.select("*", *[F.coalesce(fold(c).over(inside), F.lit(0)).alias(f"__i{k}") for k, c in enumerate(sums)]).join(base, on)
    for k, name in enumerate(sums.values()):
        base_k, inside_k = F.col(f"__b{k}"), F.col(f"__i{k}")
        rows = rows.withColumn(name, base_k.bitwiseXOR(inside_k) if xor else base_k + inside_k)
    return rows.drop("__range", *[f"__p{k}" for k in range(len(by))], *[f"__{x}{k}" for k in range(len(sums)) for x in "bi"])


def even_places(n: Column, count: int) -> Column:
    """Array of `count` evenly spaced 0-based places among n, first and last included; all of them if n <= count."""
    if count == 1:
        spread = F.array(F.lit(0).cast("long"))
    else:
        steps = F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))
        step = (n - 1).cast("double") / float(count - 1)
        spread = F.transform(steps, lambda i: F.when(i == count - 1, (n - 1).cast("long")).otherwise(F.floor(i * step).cast("long")))
    return F.when(n <= count, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(spread)
