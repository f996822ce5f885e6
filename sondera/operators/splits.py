"""Splits that keep source families apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import hashed_rank, ordered_rank, shuffle_key
from ..session import materialise

SEED = 42
#: So many families, by count, are ranked in one task and broadcast; more are ranked by buckets and joined by a shuffle.
FEW_FAMILIES = 100_000


def family_profile(rows: DataFrame) -> DataFrame:
    """(family, items, any_real, all_real) of rows with family and y (0 real, 1 fake)."""
    return rows.groupBy("family").agg(F.count(F.lit(1)).alias("items"), F.bool_or(F.col("y") == 0).alias("any_real"), F.bool_and(F.col("y") == 0).alias("all_real"))


def _ranked(families: DataFrame, salt: str, seed: int, few: bool = False) -> DataFrame:
    keyed = families.withColumn("key", shuffle_key(seed, salt, F.col("family")))
    if few:
        return keyed.withColumn("rank", F.row_number().over(Window.orderBy("key", "family")) - 1).drop("key")
    return hashed_rank(keyed, "key", "family", "rank").drop("key")


def full_split(rows: DataFrame, seed: int = SEED, calibration: float = 0.15, bank: float = 0.70) -> DataFrame:
    """Adds role: calibration families are drawn from the real-only ones, bank families from the other families with a real
    item, and a share of the fake-only ones trains too; of bank families real items are the bank and fake ones train_fake; all
    else is evaluation. Too few families is an error."""
    families = materialise(family_profile(rows), "families")
    n = families.agg(F.count(F.lit(1)).alias("all"), F.count_if("any_real").alias("real"), F.count_if("all_real").alias("only"), F.count_if(~F.col("any_real")).alias("fake")).first()
    n_cal, n_bank, n_fake, few = max(1, int(n.real * calibration)), int(n.real * bank), int(n.fake * bank), n["all"] <= FEW_FAMILIES
    if n.only < n_cal or n_bank < 2 or n_bank + n_cal >= n.real:
        raise ValueError("not enough real-only families for calibration, bank and evaluation")
    small = F.broadcast if few else lambda df: df
    chosen = _ranked(families.where("all_real"), "cal", seed, few).where(F.col("rank") < n_cal).select("family", F.lit("calibration").alias("group"))
    rest = families.where("any_real").join(small(chosen.select("family")), "family", "left_anti")
    train = _ranked(rest, "bank", seed, few).where(F.col("rank") < n_bank).select("family", F.lit("train").alias("group"))
    fake = _ranked(families.where("NOT any_real"), "fake", seed, few).where(F.col("rank") < n_fake).select("family", F.lit("train").alias("group"))
    groups = small(chosen.unionByName(train).unionByName(fake))
    role = F.when(F.col("group") == "calibration", "calibration").when(F.col("group") == "train", F.when(F.col("y") == 0, "bank").otherwise("train_fake")).otherwise("evaluation")
    return rows.join(groups, "family", "left").withColumn("role", role).drop("group")


def quota_split(rows: DataFrame, quotas: dict[str, int], seed: int = SEED) -> DataFrame:
    """(role, video, family, y): one video per family, families used once, taken in the order eval_fake, train_fake, bank,
    calibration, eval_real (missing quotas are 0). rows: (video, family, y). Too few families is an error."""
    out = None
    used = None
    for name, y in (("eval_fake", 1), ("train_fake", 1), ("bank", 0), ("calibration", 0), ("eval_real", 0)):
        want = quotas.get(name, 0)
        if not want:
            continue
        pool = rows.where(F.col("y") == y).withColumn("key", shuffle_key(seed, "real" if y == 0 else "fake", F.col("video")))
        first = pool.groupBy("family").agg(F.min(F.struct("key", "video")).alias("m")).select("family", F.col("m.video").alias("video"), F.col("m.key").alias("key"), F.lit(y).alias("y"))
        if used is not None:
            first = first.join(used, "family", "left_anti")
        part = hashed_rank(first, "key", "video", "rank").where(F.col("rank") < want).select(F.lit("evaluation" if name.startswith("eval") else name).alias("role"), "video", "family", "y")
        out = part if out is None else out.unionByName(part)
        used = out.select("family")
    got = {(r.role, r.y): r.n for r in out.groupBy("role", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    need = {("evaluation" if k.startswith("eval") else k, 1 if "fake" in k else 0): v for k, v in quotas.items() if v}
    short = {k: v for k, v in need.items() if got.get(k, 0) < v}
    if short:
        raise ValueError(f"not enough independent families: {short}, found {got}")
    return out


def bank_only(rows: DataFrame, limit: int, seed: int = SEED) -> DataFrame:
    """The first `limit` real videos in keyed order."""
    keyed = rows.where("y = 0").withColumn("key", shuffle_key(seed, "bank-only", F.col("video")))
    return keyed.orderBy("key", "video").limit(limit).drop("key")


def train_validation(rows: DataFrame, fraction: float, seed: int = SEED) -> DataFrame:
    """Adds part: validation for round-half-even(F * fraction) of the F families (1 to F - 1), else train."""
    families = rows.select("family").distinct()
    n = families.count()
    if n < 2:
        raise ValueError("two families at least")
    take = min(n - 1, max(1, round(n * fraction)))
    held = _ranked(families, "validation", seed).where(F.col("rank") < take).select("family", F.lit("validation").alias("part"))
    return rows.join(held, "family", "left").withColumn("part", F.coalesce("part", F.lit("train")))


def epoch_schedule(rows: DataFrame, id_column: str, epochs: int, limit: int, seed: int = SEED) -> DataFrame:
    """(epoch, place, id): for each epoch a new keyed order of which the first `limit` are used."""
    each = rows.select(F.col(id_column).alias("id"), F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    keyed = each.withColumn("key", F.md5(F.concat_ws("|", (F.lit(seed) + F.col("epoch")).cast("string"), F.lit("epoch"), F.col("id").cast("string"))))
    ranked = hashed_rank(keyed, "key", "id", "place", ("epoch",))
    return ranked.where(F.col("place") < limit).select("epoch", "place", "id")


def paired_samples(rows: DataFrame, count: int, seed: int = SEED) -> DataFrame:
    """(analysis_id, pair_id, y, family, image): of families with bank and train_fake images at most `count`, one image each, in
    keyed order; analysis_id = 2 * pair_id + y. rows: (family, image, y)."""
    pick = rows.groupBy("family", "y").agg(F.min(F.struct(shuffle_key(seed, "pick", F.col("image")).alias("k"), F.col("image"))).alias("m"))
    both = pick.groupBy("family").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("family")
    keyed = both.withColumn("key", shuffle_key(seed, "pair", F.col("family")))
    pairs = hashed_rank(keyed, "key", "family", "pair_id").where(F.col("pair_id") < count).select("family", "pair_id")
    return pick.join(pairs, "family").select((2 * F.col("pair_id") + F.col("y")).alias("analysis_id"), "pair_id", "y", "family", F.col("m.image").alias("image"))


def overlapping_families(rows: DataFrame) -> DataFrame:
    """(family, classes) of families whose roles fall in more than one of the classes train (bank, train_fake), calibration and
    evaluation; a sound split has none."""
    group = F.when(F.col("role").isin("bank", "train_fake"), "train").otherwise(F.col("role"))
    return rows.groupBy("family").agg(F.countDistinct(group).alias("classes")).where("classes > 1")


def sample_ordinals(rows: DataFrame, partition: str, *order: str) -> DataFrame:
    """Adds sample_id: 0-based place in the partition. Partitions are roles, few and large, so places are counted per range."""
    return ordered_rank(rows, [partition], list(order), "sample_id")
