"""Grids of classes: patch majority, regions, and region-covering masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import shuffle_key

# Region numbers, the classes of each region, and the classes outside the face. Hair is both.
BACKGROUND = 0
SKIN = 1
EYEBROWS = 2
EYES = 3
NOSE = 4
MOUTH = 5
HAIR = 6
FACE_BOUNDARY = 7
REGION_CLASSES = {SKIN: (2,), EYEBROWS: (6, 7), EYES: (8, 9, 15), NOSE: (10,), MOUTH: (11, 12, 13), HAIR: (14,), FACE_BOUNDARY: (4, 5)}
NON_FACE = (0, 1, 3, 14, 16, 17, 18, 255)
SKIN_CLASS = 2


def patch_majority(pixels: DataFrame, image: str, patch: int) -> DataFrame:
    """(image, row, col, class): the most frequent class of each patch of `patch` pixels a side, ties to the least class.
    pixels: (image, y, x, class)."""
    c = pixels.groupBy(image, F.floor(F.col("y") / patch).cast("int").alias("row"), F.floor(F.col("x") / patch).cast("int").alias("col"), "class").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(image, "row", "col").agg((-F.max(F.struct("n", (-F.col("class")).alias("c")))["c"]).alias("class"))


def majority(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value): the most frequent value, ties to the least."""
    c = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(*group).agg(F.min_by(value, F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias(value))


def remap(value: Column, groups: dict[int, tuple[int, ...]], other: int) -> Column:
    out = F.lit(other)
    for target, classes in groups.items():
        out = F.when(value.isin(*classes), target).otherwise(out)
    return out


def regions(cells: DataFrame, image: str, groups: dict[int, tuple[int, ...]] = REGION_CLASSES) -> DataFrame:
    """Adds region: the group of a cell's class; skin that touches a non-face cell or the edge is the boundary. cells: (image,
    row, col, class)."""
    outside = F.col("class").isin(*NON_FACE)
    across, down = Window.partitionBy(image, "row").orderBy("col"), Window.partitionBy(image, "col").orderBy("row")
    touch = F.lit(False)
    for w in (across, down):
        for shift in (1, -1):
            touch = touch | F.coalesce(F.lag(outside, shift).over(w), F.lit(True))
    marked = cells.withColumn("__touch", touch)
    region = F.when((F.col("class") == SKIN_CLASS) & F.col("__touch"), FACE_BOUNDARY).otherwise(remap(F.col("class"), groups, BACKGROUND))
    return marked.withColumn("region", region).drop("__touch")


def covering_mask(cells: DataFrame, image: str, ratio: float, seed: int | Column) -> DataFrame:
    """(image, row, col, region, masked, in_primary): one informative region drawn per image is covered whole, every other
    region by its floor share of what is left, and the rest drawn from cells not yet taken, so that the number of masked cells is
    round-half-even(n * ratio), at least 1 and at most n - 1. All draws are keyed orders; seed is one for all images, or an expression of an image. cells: foreground cells (image, row, col,
    region); an image with fewer than two cells or without an informative region is an error."""
    by = Window.partitionBy(image)
    cell_key = shuffle_key(seed, "cell", F.col(image), F.col("row"), F.col("col"))
    rows = cells.withColumn("key", cell_key).withColumn("n", F.count(F.lit(1)).over(by))
    draw = F.min(F.when(F.col("region") >= EYEBROWS, F.struct(shuffle_key(seed, "region", F.col(image), F.col("region")).alias("k"), F.col("region").alias("r")))).over(by)
    rows = rows.withColumn("primary", draw["r"])
    sound = (F.col("n") >= 2) & F.col("primary").isNotNull()
    target = F.least(F.col("n") - 1, F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(float(ratio))).cast("long")))
    rows = rows.withColumn("target", F.when(sound, target).otherwise(F.raise_error(F.lit("no mask: two cells and an informative region are needed")).cast("bigint")))
    own = Window.partitionBy(image, "region").orderBy("key", "row", "col")
    rows = rows.withColumn("place", F.row_number().over(own)).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy(image, "region")))
    first = F.col("region") == F.col("primary")
    rows = rows.withColumn("taken_first", F.sum((first & (F.col("place") <= F.col("target"))).cast("long")).over(by))
    left = F.col("target") - F.col("taken_first")
    share = F.try_divide(left.cast("double"), (F.col("n") - F.sum(first.cast("long")).over(by)).cast("double"))
    quota = F.floor(F.col("size") * F.coalesce(share, F.lit(0.0)))
    rows = rows.withColumn("sure", F.when(first, F.col("place") <= F.col("target")).otherwise(F.col("place") <= quota))
    rows = rows.withColumn("need", F.col("target") - F.sum(F.col("sure").cast("long")).over(by))
    spare = F.row_number().over(Window.partitionBy(image, F.col("sure") | first).orderBy("key", "row", "col"))
    rows = rows.withColumn("masked", F.col("sure") | (~first & (spare <= F.col("need"))))
    return rows.select(image, "row", "col", "region", "masked", (first & F.col("sure")).alias("in_primary"))


def pixel_occupancy(pixels: DataFrame, image: str, patch: int, above: int = 16) -> DataFrame:
    """(image, row, col, occupancy): of each patch of `patch` pixels a side the share of pixels whose brightest channel is above a
    bound: a box average of the foreground. pixels: (image, y, x, r, g, b)."""
    bright = (F.greatest("r", "g", "b") > above).cast("double")
    cell = [F.col(image), F.floor(F.col("y") / patch).cast("int").alias("row"), F.floor(F.col("x") / patch).cast("int").alias("col")]
    return pixels.groupBy(*cell).agg(F.avg(bright).alias("occupancy"))


def area_gate(masks: DataFrame, image: str, least: float) -> DataFrame:
    """(image, area): share of an image's pixels with class 1, null where it has none or it is under the least. masks: (image,
    class), a row per pixel."""
    area = F.avg((F.col("class") == 1).cast("double"))
    return masks.groupBy(image).agg(F.when((area > 0) & (area >= least), area).alias("area"))


def logits_to_class(logits: Column, least: float, uncertain: int = 255) -> Column:
    """Arg-max of an array of logits, or `uncertain` where its softmax is below a confidence."""
    top = F.array_max(logits)
    total = F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x)
    return F.when(1.0 / total >= least, F.array_position(logits, top).cast("int") - 1).otherwise(uncertain)


def bounding_box(cells: DataFrame, image: str) -> DataFrame:
    """(image, x0, y0, x1, y1): half-open box of an image's cells (row, col)."""
    return cells.groupBy(image).agg(F.min("col").alias("x0"), F.min("row").alias("y0"), (F.max("col") + 1).alias("x1"), (F.max("row") + 1).alias("y1"))


def crop(pixels: DataFrame, mask: DataFrame, image: str, keep_background: bool = False) -> DataFrame:
    """(image, row, col, value): the pixels inside the bounding box of each image's mask, counted from the box's corner; those outside
    the mask are 0 unless the background is kept. pixels: (image, row, col, value); mask: (image, row, col), masked cells only. Images
    without a mask have no crop."""
    inside = pixels.join(bounding_box(mask, image), image).where("row >= y0 AND row < y1 AND col >= x0 AND col < x1")
    marked = inside.join(mask.select(image, "row", "col").distinct().withColumn("__m", F.lit(True)), [image, "row", "col"], "left")
    value = F.col("value") if keep_background else F.when(F.col("__m"), F.col("value")).otherwise(F.lit(0))
    return marked.select(image, (F.col("row") - F.col("y0")).alias("row"), (F.col("col") - F.col("x0")).alias("col"), value.alias("value"))


def resize_nearest(pixels: DataFrame, image: str, side: int, target: int) -> DataFrame:
    """(image, row, col, value): square images of one side at another, each pixel that of the source under its centre."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(target - 1)))
    grid = pixels.select(image).distinct().withColumn("row", steps).withColumn("col", steps)
    under = lambda c: F.floor((F.col(c) + 0.5) * (side / target)).cast("int")
    source = pixels.select(image, F.col("row").alias("__y"), F.col("col").alias("__x"), "value")
    return grid.withColumn("__y", under("row")).withColumn("__x", under("col")).join(source, [image, "__y", "__x"]).select(image, "row", "col", "value")


def resize_box(pixels: DataFrame, image: str, factor: int) -> DataFrame:
    """(image, row, col, value): images scaled down by a whole factor, each pixel the mean of those it covers."""
    at = lambda c: F.floor(F.col(c) / factor).cast("int").alias(c)
    return pixels.groupBy(image, at("row"), at("col")).agg(F.avg("value").alias("value"))


def aligned(pixels: DataFrame, template: DataFrame, image: str, most: float = 20.0) -> DataFrame:
    """(image, error, aligned): mean absolute difference of each image from a template over the cells both have, and whether it is
    within the bound, so that the proposed box stands. template: (row, col, value), one small image."""
    both = pixels.join(template.select("row", "col", F.col("value").alias("__t")), ["row", "col"])
    return both.groupBy(image).agg(F.avg(F.abs(F.col("value") - F.col("__t"))).alias("error")).withColumn("aligned", F.col("error") <= most)


def crop_box(box: Column, scale: Column, margin: float, width: Column, height: Column) -> Column:
    """A detection box (array x0, y0, x1, y1) back in frame pixels, widened by a share of its size and clipped to the frame. A box of
    which nothing is left is an error; empty_box tells which those are."""
    out = clipped_box(box, scale, margin, width, height)
    return F.when(empty_box(out), F.raise_error(F.lit("invalid box")).cast("array<bigint>")).otherwise(out)


def empty_box(box: Column) -> Column:
    return (box[2] <= box[0]) | (box[3] <= box[1])


def clipped_box(box: Column, scale: Column, margin: float, width: Column, height: Column) -> Column:
    x0, y0, x1, y1 = (box[k] / scale for k in range(4))
    mx, my = (x1 - x0) * margin, (y1 - y0) * margin
    return F.array(F.greatest(F.lit(0), F.floor(x0 - mx)), F.greatest(F.lit(0), F.floor(y0 - my)), F.least(width.cast("long"), F.ceil(x1 + mx)), F.least(height.cast("long"), F.ceil(y1 + my)))


def detection_size(width: Column, height: Column, longest: int) -> Column:
    """(width, height) scaled down so that neither is above `longest`, each at least 1, rounded half to even."""
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))
    side = lambda x: F.greatest(F.lit(1), F.bround(x * scale).cast("int"))
    return F.array(side(width), side(height))


def largest_box(boxes: Column) -> Column:
    """Of an array of boxes the one of largest area, the first of equals. Inverted boxes have no area."""
    side = lambda a, b: F.greatest(b - a, F.lit(0.0))
    area = lambda b: side(b[0], b[2]) * side(b[1], b[3])
    ranked = F.transform(boxes, lambda b, i: F.struct(area(b).alias("area"), (-i).alias("order"), b.alias("box")))
    return F.array_max(ranked)["box"]
