"""Queries over packed rasters, each next to its SQL. Parts and order lines are read as pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import rasters
from .plan_queries import _GRID, _grid, query
from .plans.views import table
from .session import scratch_folder
from .sources import caches

# ---------------------------------------------------------------- masks

HEIGHT, WIDTH, CLOSING, DILATION, LEAST = 24, 30, 0.05, 0.03, 0.06
_MASK = f"SELECT l_suppkey AS image, (l_partkey % {HEIGHT * WIDTH} // {WIDTH})::INT AS row, (l_partkey % {WIDTH})::INT AS col, (l_quantity > 45)::INT AS value FROM lineitem"


def _masks(spark: SparkSession, d: str) -> DataFrame:
    pixels = table(spark, d, "lineitem").selectExpr("l_suppkey AS image", f"CAST(floor(l_partkey % {HEIGHT * WIDTH} / {WIDTH}) AS INT) AS row", f"CAST(l_partkey % {WIDTH} AS INT) AS col", "CAST(l_quantity > 45 AS INT) AS value")
    return rasters.pack(pixels, "image", HEIGHT, WIDTH, ["value"])


def _dilated(source: str, radius: int, frame: str = f"BETWEEN 0 AND {HEIGHT - 1} AND s.col + dx BETWEEN 0 AND {WIDTH - 1}") -> str:
    kernel = f"SELECT dy, unnest(range(-half, half + 1)) AS dx FROM (SELECT dy, round_even({radius} * sqrt(({radius * radius} - dy * dy) / {radius * radius}::DOUBLE), 0)::INT AS half FROM (SELECT unnest(range(-{radius}, {radius + 1})) AS dy))"
    return f"SELECT DISTINCT s.image, s.row + dy AS row, s.col + dx AS col FROM {source} s, ({kernel}) WHERE s.row + dy {frame}"


@query(f"""WITH RECURSIVE px AS (SELECT DISTINCT image, row, col FROM ({_MASK}) WHERE value = 1),
images AS (SELECT image, count(p.row) AS n FROM (SELECT DISTINCT l_suppkey AS image FROM lineitem) LEFT JOIN px p USING (image) GROUP BY image),
good AS (SELECT image FROM images WHERE n > 0 AND n / {HEIGHT * WIDTH}::DOUBLE >= {LEAST}),
frame AS (SELECT image, r::INT AS row, c::INT AS col FROM good, (SELECT unnest(range({HEIGHT})) AS r), (SELECT unnest(range({WIDTH})) AS c)),
m0 AS (SELECT p.* FROM px p JOIN good USING (image)),
wide AS ({_dilated("m0", 2)}), gap AS (SELECT * FROM frame EXCEPT SELECT * FROM wide), eaten AS ({_dilated("gap", 2)}), closed AS (SELECT * FROM frame EXCEPT SELECT * FROM eaten),
grown AS ({_dilated("closed", 1)}), free AS (SELECT * FROM frame EXCEPT SELECT * FROM grown),
outside AS (
  SELECT image, row, col FROM free WHERE row IN (0, {HEIGHT - 1}) OR col IN (0, {WIDTH - 1})
  UNION
  SELECT f.image, f.row, f.col FROM outside o JOIN free f ON f.image = o.image AND abs(f.row - o.row) + abs(f.col - o.col) = 1),
filled AS (SELECT * FROM frame EXCEPT SELECT * FROM outside)
SELECT image, row, col, (image, row, col) NOT IN (SELECT (image, row, col) FROM grown) AS hole FROM filled
UNION ALL SELECT image, -1, -1, false FROM images WHERE image NOT IN (SELECT image FROM good)""")
def expanded_masks(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of masks closed, dilated and filled, and which of them were holes; a mask that is too small has one row, at -1."""
    masks = _masks(spark, d)
    done = rasters.expand_masks(masks, "image", CLOSING, DILATION, LEAST)
    whole = rasters.pixels_of(done, "image").where("value = 1").drop("value")
    unfilled = rasters.pixels_of(rasters.expand_masks(masks, "image", CLOSING, DILATION, LEAST, fill=False), "image").where("value = 1").select("image", "row", "col", F.lit(False).alias("solid"))
    rows = whole.join(unfilled, ["image", "row", "col"], "left").select("image", "row", "col", F.coalesce("solid", F.lit(True)).alias("hole"))
    return rows.unionByName(done.where("data IS NULL").select("image", F.lit(-1).alias("row"), F.lit(-1).alias("col"), F.lit(False).alias("hole")))


# ---------------------------------------------------------------- resampling


def weights_sql(source: int, target: int, kind: str) -> str:
    """(t, s, w) of an axis."""
    scale = source / target
    every = f"(SELECT unnest(range({target})) AS t), (SELECT unnest(range({source})) AS s)"
    centre = f"((t + 0.5::DOUBLE) * {scale!r}::DOUBLE)"
    if kind == "bilinear":
        at = f"greatest({centre} - 0.5, 0)"
        return f"SELECT t, s, greatest(0, 1 - abs(s - least({at}, {source - 1}))) AS w FROM {every} WHERE abs(s - least({at}, {source - 1})) < 1"
    if kind == "area":
        overlap = f"(least(s + 1, (t + 1) * {scale!r}::DOUBLE) - greatest(s, t * {scale!r}::DOUBLE))"
        return f"SELECT t, s, {overlap} / {scale!r}::DOUBLE AS w FROM {every} WHERE {overlap} > 1e-12"
    wide = max(scale, 1.0)
    x = f"((s - {centre} + 0.5) / {wide!r}::DOUBLE)"
    a = f"abs({x})"
    value, support = {
        "box": (f"CASE WHEN {x} > -0.5 AND {x} <= 0.5 THEN 1.0::DOUBLE ELSE 0 END", 0.5),
        "bicubic": (f"CASE WHEN {a} < 1 THEN (1.5::DOUBLE * {a} - 2.5) * {a} * {a} + 1 WHEN {a} < 2 THEN ((({a} - 5) * {a} + 8) * {a} - 4) * -0.5::DOUBLE ELSE 0 END", 2.0),
    }[kind]
    bound = f"s >= floor(greatest({centre} - {support * wide!r} + 0.5, 0)) AND s < floor({centre} + {support * wide!r} + 0.5)"
    return f"SELECT t, s, v / sum(v) OVER (PARTITION BY t) AS w FROM (SELECT t, s, {value} AS v FROM {every} WHERE {bound}) WHERE v <> 0"


KINDS = (("bilinear", 9, 20), ("bicubic", 9, 17), ("box", 5, 6), ("area", 5, 9))
_WHOLE = f"SELECT i.image, r::INT AS row, c::INT AS col, coalesce(g.value, 0) AS value FROM (SELECT DISTINCT image FROM ({_GRID})) i CROSS JOIN (SELECT unnest(range(14)) AS r) CROSS JOIN (SELECT unnest(range(14)) AS c) LEFT JOIN ({_GRID}) g ON g.image = i.image AND g.row = r AND g.col = c"


@query(
    f"WITH g AS ({_WHOLE}) "
    + " UNION ALL ".join(
        f"SELECT image, '{kind}' AS kind, y.t::INT AS row, x.t::INT AS col, round(sum(value * x.w * y.w), 4) AS value FROM g JOIN ({weights_sql(14, w, kind)}) x ON g.col = x.s JOIN ({weights_sql(14, h, kind)}) y ON g.row = y.s GROUP BY image, y.t, x.t"
        for kind, h, w in KINDS
    )
)
def weighted_resizes(spark: SparkSession, d: str) -> DataFrame:
    """Images at other sizes, larger along one axis and smaller along the other, by four kinds of weights."""
    g = rasters.pack(_grid(spark, d), "image", 14, 14, ["value"])
    out = None
    for kind, h, w in KINDS:
        part = rasters.resampled(g, "image", h, w, kind).select("image", F.lit(kind).alias("kind"), "row", "col", F.round(F.col("values")[0], 4).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


_SHOTS = "SELECT l_suppkey % 50 AS image, (l_partkey % 391 // 23)::INT AS row, (l_partkey % 23)::INT AS col, max(l_quantity * 5 % 40)::INT AS r, max(l_linenumber * 6 % 30)::INT AS g, max(l_partkey % 20)::INT AS b FROM lineitem GROUP BY 1, 2, 3"


@query(f"""WITH p AS ({_SHOTS}), f AS (SELECT image, row, col, (greatest(r, g, b) > 16)::INT AS v FROM p),
o AS (SELECT image, y.t::INT AS row, x.t::INT AS col, sum(v * x.w * y.w) AS occupancy FROM f JOIN ({weights_sql(23, 14, "box")}) x ON f.col = x.s JOIN ({weights_sql(17, 14, "box")}) y ON f.row = y.s GROUP BY ALL)
SELECT image, row, col, row * 14 + col AS patch_id, round(occupancy, 6) AS occupancy FROM o WHERE occupancy >= 0.4""")
def occupied_patches(spark: SparkSession, d: str) -> DataFrame:
    """Patches of a grid of 14 by 14 over images of 17 by 23 that have enough foreground."""
    pixels = table(spark, d, "lineitem").selectExpr("l_suppkey % 50 AS image", "CAST(floor(l_partkey % 391 / 23) AS INT) AS row", "CAST(l_partkey % 23 AS INT) AS col", "CAST(l_quantity * 5 % 40 AS INT) AS r", "CAST(l_linenumber * 6 % 30 AS INT) AS g", "CAST(l_partkey % 20 AS INT) AS b")
    shots = rasters.pack(pixels, "image", 17, 23, ["r", "g", "b"])
    return rasters.foreground(shots, "image", 14, 14, 0.4).withColumn("occupancy", F.round("occupancy", 6))


# ---------------------------------------------------------------- templates

T_HEIGHT, T_WIDTH = 10, 11
#: Template pixels: of an image's own pixels at an offset, or of those of the image before it; every fifth is black.
_TEMPLATE = f"""SELECT i.image, (g.row - i.image % 5)::INT AS row, (g.col - i.image % 4)::INT AS col,
  CASE WHEN (g.row - i.image % 5) * (g.col - i.image % 4) % 5 = 4 THEN 0 ELSE least(255, g.value + (g.row + g.col) % 7) END::INT AS value
FROM (SELECT DISTINCT image FROM g) i JOIN g ON g.image = i.image - (i.image % 6 = 5)::INT WHERE g.row - i.image % 5 BETWEEN 0 AND {T_HEIGHT - 1} AND g.col - i.image % 4 BETWEEN 0 AND {T_WIDTH - 1}"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Images, templates cut from them (of some from another one), and boxes that are proposed: right, wrong or none."""
    whole = rasters.pixels_of(rasters.pack(_grid(spark, d), "image", 14, 14, ["value"]), "image")
    images = whole.select("image").distinct()
    from_image = F.col("of") - (F.col("of") % 6 == 5).cast("int")
    own = images.select(F.col("image").alias("of")).withColumn("image", from_image).join(whole, "image")
    row, col = (F.col("row") - F.col("of") % 5).cast("int"), (F.col("col") - F.col("of") % 4).cast("int")
    value = F.when(row * col % 5 == 4, 0).otherwise(F.least(F.lit(255), F.col("value") + (F.col("row") + F.col("col")) % 7))
    cut = own.select(F.col("of").alias("image"), row.alias("row"), col.alias("col"), value.alias("value")).where(f"row BETWEEN 0 AND {T_HEIGHT - 1} AND col BETWEEN 0 AND {T_WIDTH - 1}")
    named = lambda df, prefix: df.select("image", *[F.col(c).alias(f"{prefix}{c}") for c in ("height", "width", "data")])
    sources, templates = rasters.pack(whole, "image", 14, 14, ["value"]), rasters.pack(cut, "image", T_HEIGHT, T_WIDTH, ["value"])
    at = F.array((F.col("image") % 4).cast("int"), (F.col("image") % 5).cast("int"), (F.col("image") % 4 + T_WIDTH).cast("int"), (F.col("image") % 5 + T_HEIGHT).cast("int"))
    box = F.when(F.col("image") % 3 == 0, at).when(F.col("image") % 3 == 1, F.array(F.lit(0), F.lit(0), F.lit(T_WIDTH), F.lit(T_HEIGHT)))
    return named(sources, "source_").join(named(templates, "template_"), "image").withColumn("box", box)


_LADDER = "SELECT unnest([" + ", ".join(map(str, rasters.FOREGROUND_LADDER)) + "]) AS level"


@query(f"""WITH g AS ({_WHOLE}), t AS ({_TEMPLATE}),
level AS (SELECT image, max(level) AS level FROM (SELECT t.image, l.level, count(*) FILTER (t.value > l.level) AS n FROM t, ({_LADDER}) l GROUP BY ALL) WHERE n >= 64 GROUP BY image),
tries AS (SELECT t.image, y::INT AS top, x::INT AS left, sum((g.value - t.value) ** 2) AS ssd, avg(abs(g.value - t.value)) AS error FROM t JOIN level l USING (image), (SELECT unnest(range({14 - T_HEIGHT + 1})) AS y), (SELECT unnest(range({14 - T_WIDTH + 1})) AS x), g
  WHERE g.image = t.image AND g.row = t.row + y AND g.col = t.col + x AND t.value > l.level GROUP BY ALL),
best AS (SELECT * FROM tries QUALIFY row_number() OVER (PARTITION BY image ORDER BY ssd, top, "left") = 1),
given AS (SELECT image, CASE WHEN image % 3 = 0 THEN image % 4 WHEN image % 3 = 1 THEN 0 END AS "left", CASE WHEN image % 3 = 0 THEN image % 5 WHEN image % 3 = 1 THEN 0 END AS top FROM (SELECT DISTINCT image FROM g)),
proposed AS (SELECT t.* FROM tries t JOIN given USING (image, top, "left") WHERE error <= 20),
found AS (SELECT * FROM proposed UNION ALL SELECT * FROM best WHERE error <= 20 AND image NOT IN (SELECT image FROM proposed)),
every AS (SELECT DISTINCT image FROM t)
SELECT e.image, f."left", f.top, f."left" + {T_WIDTH} AS "right", f.top + {T_HEIGHT} AS bottom, round(f.error, 6) AS error,
  CASE WHEN f.image IS NOT NULL THEN NULL WHEN l.image IS NULL THEN 'template has too little visible foreground' ELSE 'template does not match its source' END AS reason
FROM every e LEFT JOIN found f ON f.image = e.image LEFT JOIN level l ON l.image = e.image""")
def template_search(spark: SparkSession, d: str) -> DataFrame:
    """Where in its image each template stands; the reason where it stands nowhere."""
    found = rasters.find_templates(_pairs(spark, d), "image")
    return found.withColumns({"error": F.round("error", 6), "reason": F.regexp_replace("reason", ": .*", "")})


SETTINGS = {"object_ids": [2, 10, 11], "closing": 0.0, "dilation": 0.0, "least_area": 0.02, "image_size": 14, "grid_size": 7}
_CLASS = "CASE WHEN row BETWEEN image % 5 AND image % 5 + 9 AND col BETWEEN image % 4 AND image % 4 + 10 THEN list_extract([2, 10, 11], (value // 5 % 3 + 1)::INT) ELSE value // 5 % 2 END"


@query(f"""WITH g AS ({_WHOLE}), labels AS (SELECT image, row, col, ({_CLASS})::INT AS label FROM g),
near AS (SELECT l.image, y, x, label FROM labels l, (SELECT unnest(range(14)) AS y), (SELECT unnest(range(14)) AS x)
  WHERE row = image % 5 + floor((y + 0.5::DOUBLE) * {T_HEIGHT / 14!r}::DOUBLE) AND col = image % 4 + floor((x + 0.5::DOUBLE) * {T_WIDTH / 14!r}::DOUBLE)),
cells AS (SELECT image, (y // 2 * 7 + x // 2)::INT AS cell, label, count(*) AS n FROM near GROUP BY ALL)
SELECT image, cell, label, NULL AS reason FROM cells WHERE image % 6 <> 5 AND image IN (SELECT image FROM (SELECT image, count(*) FILTER (value > 0) AS n FROM ({_GRID}) GROUP BY image) WHERE n >= 190) QUALIFY row_number() OVER (PARTITION BY image, cell ORDER BY n DESC, label) = 1
UNION ALL SELECT DISTINCT image, NULL::INT, NULL::INT, 'template does not match its source' FROM g WHERE image % 6 = 5""")
def semantic_cache(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the patches of each image's saved crop, from a cache that two runs fill, and the images that have no crop."""
    pairs = _pairs(spark, d).drop("box")
    whole = _grid(spark, d).groupBy("image").agg(F.count(F.when(F.col("value") > 0, 1)).alias("n")).where("n >= 190").select("image")
    rows = rasters.pixels_of(rasters.pack(_grid(spark, d), "image", 14, 14, ["value"]), "image")
    inside = F.expr("row BETWEEN image % 5 AND image % 5 + 9 AND col BETWEEN image % 4 AND image % 4 + 10")
    label = F.when(inside, F.element_at(F.array(F.lit(2), F.lit(10), F.lit(11)), F.expr("CAST(value div 5 % 3 + 1 AS INT)"))).otherwise(F.expr("CAST(value div 5 % 2 AS INT)"))
    labels = rasters.pack(rows.withColumn("label", label), "image", 14, 14, ["label"])
    images = pairs.join(labels.select("image", *[F.col(c).alias(f"labels_{c}") for c in ("height", "width", "data")]), "image").join(whole, "image")
    path = scratch_folder(spark, "semantic-cache")
    work = lambda df: rasters.semantic_grids(df, "image", SETTINGS)
    caches.update(spark, path, images.where("image % 2 = 0"), "image", SETTINGS, work)
    done = caches.update(spark, path, images, "image", SETTINGS, work)
    cells = done.where("reason IS NULL").select("image", F.posexplode("grid").alias("cell", "label"), F.lit(None).cast("string").alias("reason"))
    none = F.lit(None).cast("int")
    return cells.unionByName(done.where("reason IS NOT NULL").select("image", none.alias("cell"), none.alias("label"), F.regexp_replace("reason", ": .*", "").alias("reason")))
