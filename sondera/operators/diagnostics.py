"""Clustering diagnostics of paired samples."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..session import arrow_map, materialise
from .search import _matrix

#: Rows of a block of a quadratic diagnostic: what moves is the square of the rows by this. Distances are worked out so many rows at a time.
BLOCK, STEP = 8192, 1024


def _mean(column: str) -> Column:
    """Mean vector as an array: one buffer of sums per group, merged like any partial aggregate."""
    return vector_to_array(Summarizer.mean(array_to_vector(F.col(column))))


def mean_pool(patches: DataFrame, group: str) -> DataFrame:
    """(group, vector): mean of a group's vectors, scaled to length one."""
    mean = patches.groupBy(group).agg(_mean("embedding").alias("m"))
    return mean.select(group, vectors.l2_normalise(F.col("m")).alias("vector"))


def centroids(rows: DataFrame, by: str) -> DataFrame:
    """(by, m, n): mean of the vectors, and how many there are."""
    return rows.groupBy(by).agg(_mean("vector").alias("m"), F.count(F.lit(1)).alias("n"))


def centroid_cosine(rows: DataFrame) -> DataFrame:
    """One row: cosine of the centroids of y = 0 and y = 1."""
    two = centroids(rows, "y").agg(F.any_value(F.when(F.col("y") == 0, F.col("m")), True).alias("a"), F.any_value(F.when(F.col("y") == 1, F.col("m")), True).alias("b"))
    return two.select(vectors.cosine(F.col("a"), F.col("b")).alias("centroid_cosine"))


def pair_cosines(rows: DataFrame) -> DataFrame:
    """(pair_id, paired, shifted): dot of each pair's real vector with its own fake vector, and with the next pair's (the last
    with the first's)."""
    pairs = rows.groupBy("pair_id").agg(F.any_value(F.when(F.col("y") == 0, F.col("vector")), True).alias("r"), F.any_value(F.when(F.col("y") == 1, F.col("vector")), True).alias("f"))
    n = rows.agg((F.max("pair_id") + 1).alias("n"))
    step = pairs.join(F.broadcast(n), how="cross").withColumn("next_id", F.pmod(F.col("pair_id") + 1, F.col("n")))
    other = pairs.select(F.col("pair_id").alias("next_id"), F.col("f").alias("g"))
    return step.join(other, "next_id").select("pair_id", vectors.dot(F.col("r"), F.col("f")).alias("paired"), vectors.dot(F.col("r"), F.col("g")).alias("shifted"))


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def composition(rows: DataFrame) -> DataFrame:
    """(cluster, count, real, fake, fake_fraction)."""
    return rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("y") == 0).alias("real"), F.count_if(F.col("y") == 1).alias("fake"), F.avg(F.col("y").cast("double")).alias("fake_fraction"))


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: adjusted Rand index, normalised mutual information (arithmetic mean) of two labellings, and the best accuracy
    of b against a with or without swapping 0 and 1. All of it from the contingency table."""
    c = contingency(rows, a, b)
    every = Window.partitionBy()
    c = c.withColumn("na", F.sum("n").over(Window.partitionBy(a))).withColumn("nb", F.sum("n").over(Window.partitionBy(b))).withColumn("t", F.sum("n").over(every))
    two = lambda x: F.col(x) * (F.col(x) - 1) / 2.0
    ent = lambda x: -(F.col("n") / F.col("t")) * F.log(F.col(x) / F.col("t"))
    s = c.agg(
        F.sum(two("n")).alias("i"), F.sum(two("na") * F.col("n") / F.col("na")).alias("sa"), F.sum(two("nb") * F.col("n") / F.col("nb")).alias("sb"), F.max(two("t")).alias("st"),
        F.sum((F.col("n") / F.col("t")) * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"), F.sum(ent("na")).alias("ha"), F.sum(ent("nb")).alias("hb"),
        F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"), F.max("t").alias("t"),
    )
    chance = F.col("sa") * F.col("sb") / F.col("st")
    whole = (F.col("sa") + F.col("sb")) / 2 - chance
    share = F.col("same") / F.col("t")
    return s.select(F.when(whole == 0, 1.0).otherwise((F.col("i") - chance) / whole).alias("ari"), F.when(F.col("ha") + F.col("hb") == 0, 1.0).otherwise(F.col("mi") / ((F.col("ha") + F.col("hb")) / 2)).alias("nmi"), F.greatest(share, 1 - share).alias("accuracy"))


def _cosine_sums(rows: DataFrame) -> DataFrame:
    """(id, li, lj, n, total): sums of cosine distances of each row to the n rows of each label (itself included, at 0). A row's
    sum over a label is n less its product with the label's sum of unit vectors, so no two rows meet."""
    unit = rows.select("id", "label", vectors.l2_normalise(F.col("vector")).alias("vector"))
    per = centroids(unit, "label").select(F.col("label").alias("lj"), F.col("m").alias("c"), "n")
    each = unit.join(F.broadcast(per.agg(F.collect_list(F.struct("lj", "c", "n")).alias("all"))), how="cross").select("id", F.col("label").alias("li"), "vector", F.inline("all"))
    return each.select("id", "li", "lj", "n", (F.col("n") * (1 - vectors.dot(F.col("vector"), F.col("c")))).alias("total"))


def _euclidean_map(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for k in range(batch.num_rows):
            get = lambda c: batch.column(batch.schema.get_field_index(c))[k].as_py()  # noqa: B023, E731
            (ia, la, a), (_, lb, b) = (pa.ipc.open_stream(get(c)).read_all().combine_chunks().columns for c in ("pack", "other"))
            a, b = _matrix(a), _matrix(b)
            names, lb = np.unique(lb.to_numpy(), return_inverse=True)
            sums, same = np.zeros((len(a), len(names))), get("block") == get("block_b")
            for s, t in ((s, t) for s in range(0, len(a), STEP) for t in range(0, len(b), STEP)):
                p, q = a[s : s + STEP], b[t : t + STEP]
                far = np.sqrt(np.maximum((p * p).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * p @ q.T, 0))
                # the distance of a row to itself is 0, whatever its rounding
                if same and s == t:
                    np.fill_diagonal(far, 0)
                of = lb[t : t + STEP]
                for j in np.unique(of):
                    sums[s : s + STEP, j] += far[:, of == j].sum(1)
            n, m = len(a), len(names)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ia.to_numpy(), m)), pa.array(np.repeat(la.to_numpy(), m)), pa.array(np.tile(names, n)), pa.array(sums.reshape(-1))], ["id", "li", "lj", "total"])


def _euclidean_sums(rows: DataFrame, block: int) -> DataFrame:
    """(id, li, lj, n, total) by Euclidean distance, by pairs of blocks of rows; only sums leave a pair."""
    import pyarrow as pa

    n = max(1, -(-rows.count() // block))

    def pack(t: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        part = t.sort_by("id").select(["id", "label", "vector"])
        with pa.ipc.new_stream(sink, part.schema) as out:
            out.write_table(part)
        return pa.table({"block": t.column("block")[:1], "pack": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    dealt = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vector", F.pmod(F.xxhash64("id"), F.lit(n)).alias("block"))
    packs = materialise(dealt.groupBy("block").applyInArrow(pack, "block long, pack binary"), "vector-blocks")
    pairs = packs.withColumn("block_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).join(packs.toDF("block_b", "other"), "block_b")
    sums = arrow_map(pairs, _euclidean_map, "id long, li long, lj long, total double").groupBy("id", "li", "lj").agg(F.sum("total").alias("total"))
    counts = rows.groupBy(F.col("label").cast("long").alias("lj")).agg(F.count(F.lit(1)).alias("n"))
    return sums.join(F.broadcast(counts), "lj")


def silhouette(rows: DataFrame, label: str, metric: str = "cosine", block: int = BLOCK) -> DataFrame:
    """One row: mean silhouette of (id, label, vector); a row alone in its label counts 0. By cosine distance it takes one pass
    over the rows and one sum per label; by Euclidean distance, where no such sum exists, blocks of rows meet in pairs. Labels are
    clusters: there are few."""
    rows = rows.select("id", F.col(label).alias("label"), "vector")
    sums = _cosine_sums(rows) if metric == "cosine" else _euclidean_sums(rows, block)
    own = F.col("li") == F.col("lj")
    mean = F.try_divide(F.col("total"), (F.col("n") - F.when(own, 1).otherwise(0)).cast("double"))
    s = sums.select("id", own.alias("own"), mean.alias("m")).groupBy("id").agg(F.min(F.when(F.col("own"), F.col("m"))).alias("a"), F.min(F.when(~F.col("own"), F.col("m"))).alias("b"))
    return s.agg(F.avg(F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))).alias("silhouette"))


def principal_components(rows: DataFrame, k: int, most: int = 64) -> tuple[DataFrame, float]:
    """(rows with component array `reduced`, share of variance explained). Vectors are centred first. The largest loading of a
    component is positive, so that its sign does not depend on the solver."""
    first = rows.agg(F.count(F.lit(1)).alias("n"), _mean("vector").alias("m")).first()
    k = min(k, most, len(first.m), max(1, first.n - 1))
    centre = F.array(*[F.lit(float(x)) for x in first.m])
    centred = rows.withColumn("features", array_to_vector(F.zip_with("vector", centre, lambda x, m: x - m)))
    model = PCA(k=k, inputCol="features", outputCol="pcs").fit(centred)
    loadings = model.pc.toArray()
    signs = [1.0 if column[abs(column).argmax()] > 0 else -1.0 for column in loadings.T]
    turned = F.zip_with(vector_to_array("pcs"), F.array(*[F.lit(x) for x in signs]), lambda x, s: x * s)
    return model.transform(centred).withColumn("reduced", turned).drop("features", "pcs"), float(sum(model.explainedVariance))


def rgb_preview(rows: DataFrame, components: str = "reduced", low: float = 0.01, high: float = 0.99, least: float = 1e-6) -> DataFrame:
    """Adds rgb: the first three components, each scaled by its 1 % and 99 % quantiles over all rows and clipped to 0 and 1; a
    range under `least` counts as `least`, so that a constant component gives 0."""
    from .metrics import exact_quantiles

    wide = rows.select(*[F.col(components)[k].alias(f"c{k}") for k in range(3)])
    long_ = wide.select(F.posexplode(F.array("c0", "c1", "c2")).alias("dim", "x"))
    ends = {r.dim: r.q for r in exact_quantiles(long_, ["dim"], "x", [low, high]).collect()}
    scaled = lambda k: (F.col(components)[k] - F.lit(ends[k][0])) / F.lit(max(ends[k][1] - ends[k][0], least))
    return rows.withColumn("rgb", F.array(*[F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled(k))) for k in range(3)]))


def kmeans(rows: DataFrame, k: int, restarts: int = 20, seed: int = 42, column: str = "reduced") -> DataFrame:
    """Adds cluster: the best of several seeded K-Means runs by cost."""
    data = materialise(rows, "points").withColumn("features", array_to_vector(F.col(column)))
    models = [KMeans(k=k, seed=seed + r, featuresCol="features", predictionCol="cluster").fit(data) for r in range(restarts)]
    chosen = min(models, key=lambda m: m.summary.trainingCost)
    out = chosen.transform(data).drop("features")
    return out


def explained_variance(reduced: DataFrame, raw: DataFrame) -> DataFrame:
    """One row: sum of population variances of the reduced components over that of the raw ones."""
    # Summarizer gives the sample variance
    share = (F.col("n") - 1) / F.col("n")
    total = lambda df, c: df.agg(vector_to_array(Summarizer.variance(array_to_vector(F.col(c)))).alias("v"), F.count(F.lit(1)).alias("n")).select((F.aggregate("v", F.lit(0.0), lambda s, x: s + x) * share).alias("s"))
    a, b = total(reduced, "reduced"), total(raw, "vector").withColumnRenamed("s", "t")
    return a.join(F.broadcast(b), how="cross").select((F.col("s") / F.col("t")).alias("explained"))
