"""Queries of the metadata plan, of sources and sinks, of pixels and of checks, each next to its SQL.

Labels, manifests, part files and listings are derived from the driver's tables. Those that have to be files are written to the
shared folder first, by the sinks or as small files, and read back by the readers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths, vectors
from .operators import diagnostics, grids, metadata, metrics, sampling, search
from .plans import checks, encoding
from .plans.views import table
from .session import scratch_folder
from .sources import readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


# ---------------------------------------------------------------- the plan

_USER = "CAST(user_id AS STRING)"


def _labels(spark: SparkSession, d: str) -> DataFrame:
    """A label for most users' videos."""
    rows = table(spark, d, "events").select("user_id").distinct().where("user_id % 11 <> 5")
    return rows.select(F.expr(f"concat('v', {_USER}, '.mp4')").alias("filename"), F.expr("CAST(user_id % 2 AS INT)").alias("label"))


def _manifests(spark: SparkSession, d: str) -> DataFrame:
    """A manifest for most users' videos, their events as frames."""
    rows = table(spark, d, "events").where("user_id % 7 <> 3")
    frame = F.expr("struct(CASE WHEN event_type = 'error' THEN 'no_face' ELSE 'ok' END AS status, CAST(event_id AS INT) AS frame_index, format_string('frame_%06d.png', event_id) AS file)")
    rows = rows.groupBy("user_id").agg(F.collect_list(frame).alias("frames"))
    return rows.select(F.expr("concat('p', CAST(user_id % 3 AS STRING))").alias("part"), F.expr(f"concat('v', {_USER})").alias("video"), F.expr(f"concat('v', {_USER}, '.mp4')").alias("source"), F.expr("CAST(user_id % 2 AS INT)").alias("label"), "frames")


def _parts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id").distinct()
    return rows.selectExpr("concat('p', CAST(user_id % 3 AS STRING)) AS part", f"concat('v', {_USER}, '.mp4') AS filename", "IF(user_id % 2 = 1, 'FAKE', 'REAL') AS label", "IF(user_id % 2 = 1, concat('v', CAST(user_id - 1 AS STRING), '.mp4'), NULL) AS original")


def _segmented(spark: SparkSession, d: str) -> DataFrame:
    """Files of the frames whose face was segmented: none of some videos."""
    rows = table(spark, d, "events").where("value > 20 AND user_id % 13 <> 4")
    return rows.selectExpr(f"concat('p', CAST(user_id % 3 AS STRING), '-v', {_USER}, '-', format_string('frame_%06d.jpg', event_id)) AS file")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return metadata.video_candidates(_labels(spark, d), _manifests(spark, d), _parts(spark, d), _segmented(spark, d), 10)


_PLAN = """WITH us AS (SELECT DISTINCT user_id AS u FROM events), lab AS (SELECT u FROM us WHERE u % 11 <> 5), man AS (SELECT u FROM us WHERE u % 7 <> 3),
fr AS (SELECT user_id AS u, event_id FROM events WHERE event_type <> 'error' AND value > 20 AND user_id % 13 <> 4 AND user_id IN (SELECT u FROM lab) AND user_id IN (SELECT u FROM man)),
rk AS (SELECT u, event_id, row_number() OVER (PARTITION BY u ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY u) AS n FROM fr),
kept AS (SELECT DISTINCT u, event_id FROM (SELECT *, unnest(range(10)) AS i FROM rk) WHERE n <= 10 OR k = CASE WHEN i = 9 THEN n - 1 ELSE floor(i * ((n - 1)::DOUBLE / 9.0::DOUBLE)) END),
cand AS (SELECT 'p' || (u % 3) || '/v' || u AS video, (u % 2)::INT AS y, 'p' || (u % 3) || '/v' || (u - u % 2) AS family, event_id::INT AS frame_index,
  'p' || (u % 3) || '-v' || u || '-' || format('frame_{:06d}.jpg', event_id) AS file FROM kept)"""


@query(f"{_PLAN} SELECT * FROM cand")
def plan_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Labelled videos joined to manifests, part files and segmented frames, evenly sampled."""
    return _candidates(spark, d).select("video", "y", "family", F.inline("frames"))


@query(f"""{_PLAN} SELECT (SELECT count(*) FROM lab) AS csv_videos, (SELECT count(*) FROM lab WHERE u NOT IN (SELECT u FROM man)) AS missing_manifests,
(SELECT count(*) FROM lab JOIN man USING (u) WHERE u NOT IN (SELECT u FROM fr)) AS zero_face_videos, (SELECT count(DISTINCT u) FROM fr) AS eligible_videos""")
def plan_audit(spark: SparkSession, d: str) -> DataFrame:
    return metadata.audit(_labels(spark, d), _manifests(spark, d), _candidates(spark, d))


_SPLIT = """, fam AS (SELECT family, bool_or(y = 0) AS any_real, bool_and(y = 0) AS all_real FROM cand GROUP BY family), cnt AS (SELECT count(*) FILTER (any_real) AS nr, count(*) FILTER (NOT any_real) AS nf FROM fam),
cal AS (SELECT family FROM (SELECT family, row_number() OVER (ORDER BY md5('42|cal|' || family), family) AS r FROM fam WHERE all_real), cnt WHERE r <= greatest(1, floor(nr * 0.15::DOUBLE))),
trn AS (SELECT family FROM (SELECT family, row_number() OVER (ORDER BY md5('42|bank|' || family), family) AS r FROM fam WHERE any_real AND family NOT IN (SELECT family FROM cal)), cnt WHERE r <= floor(nr * 0.70::DOUBLE)
  UNION ALL SELECT family FROM (SELECT family, row_number() OVER (ORDER BY md5('42|fake|' || family), family) AS r FROM fam WHERE NOT any_real), cnt WHERE r <= floor(nf * 0.70::DOUBLE)),
ro AS (SELECT *, CASE WHEN family IN (SELECT family FROM cal) THEN 'calibration' WHEN family IN (SELECT family FROM trn) THEN CASE WHEN y = 0 THEN 'bank' ELSE 'train_fake' END ELSE 'evaluation' END AS role FROM cand)"""


@query(f"{_PLAN}{_SPLIT} SELECT role, video, family, y, frame_index, file, row_number() OVER (PARTITION BY role ORDER BY video, frame_index) - 1 AS sample_id FROM ro")
def plan_frames(spark: SparkSession, d: str) -> DataFrame:
    """The whole plan: candidates, family split, and the frames of each role numbered."""
    return metadata.plan(_candidates(spark, d))


@query(f"""{_PLAN}, v AS (SELECT DISTINCT video FROM cand WHERE y = 0 ORDER BY md5('42|bank-only|' || video), video LIMIT 3)
SELECT 'bank' AS role, video, family, y, frame_index, file, row_number() OVER (ORDER BY video, frame_index) - 1 AS sample_id FROM cand WHERE video IN (SELECT video FROM v)""")
def plan_bank_only(spark: SparkSession, d: str) -> DataFrame:
    return metadata.bank_only_plan(_candidates(spark, d), 3)


@query("SELECT c_custkey, 'part' || (c_custkey % 3) || '/c' || c_custkey || '.mp4' AS path, (c_custkey % 5 = 0)::INT AS y, CASE WHEN c_custkey % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM customer WHERE c_custkey % 2 = 0")
def collected_videos(spark: SparkSession, d: str) -> DataFrame:
    """Listed names joined to the one file of each stem, with label and split by membership; repeated rows collapse."""
    c = table(spark, d, "customer")
    stem = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    files = c.select(stem.alias("stem"), F.concat(F.lit("part"), (F.col("c_custkey") % 3).cast("string"), F.lit("/"), stem, F.lit(".mp4")).alias("path"))
    rows = c.where("c_custkey % 2 = 0").select("c_custkey", stem.alias("stem"), F.when(F.col("c_custkey") % 5 == 0, "FAKE").otherwise("REAL").alias("label"))
    listed = c.where("c_custkey % 4 = 0").select(stem.alias("stem")).withColumn("listed", F.lit(1))
    found = metadata.unique_match(rows.unionByName(rows), files, "stem").join(listed, "stem", "left")
    return found.select("c_custkey", "path", F.when(F.col("label") == "FAKE", 1).otherwise(0).alias("y"), F.when(F.col("listed") == 1, "test").otherwise("train").alias("split"))


@query("SELECT count(*) AS videos, count(*) FILTER (k > 0) AS saved, count(*) FILTER (k = 0) AS no_face, sum(bad)::BIGINT AS skipped FROM (SELECT user_id, count(*) FILTER (event_type <> 'error') AS k, count(*) FILTER (event_type = 'error') AS bad FROM events GROUP BY user_id)")
def segmentation_totals(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") != "error").alias("k"), F.count_if(F.col("event_type") == "error").alias("bad"))
    return per.agg(F.count(F.lit(1)).alias("videos"), F.count_if(F.col("k") > 0).alias("saved"), F.count_if(F.col("k") == 0).alias("no_face"), F.sum("bad").alias("skipped"))


# ---------------------------------------------------------------- sources


@query("SELECT DISTINCT 'v' || user_id || '.mp4' AS filename, (user_id % 2)::INT AS label FROM events WHERE user_id % 11 <> 5")
def label_csv_scan(spark: SparkSession, d: str) -> DataFrame:
    """CSV files with header and byte-order mark, one for each third of the users."""
    lines = _labels(spark, d).groupBy((F.xxhash64("filename") % 3).alias("k")).agg(F.concat(F.lit("\ufefffilename,label\n"), F.array_join(F.collect_list(F.concat("filename", F.lit(","), "label")), "\n"), F.lit("\n")).alias("content"))
    root = scratch_folder(spark, "labels")
    sinks.text_files(lines.select(F.concat(F.lit("labels"), "k", F.lit(".csv")).alias("path"), "content"), root)
    return readers.label_csv(spark, root)


def _manifest_files(spark: SparkSession, d: str) -> str:
    """A manifest per video and a part file per part, by their names in the folders, written where the rows are."""
    root = scratch_folder(spark, "crops")
    body = F.to_json(F.struct("source", "label", F.size("frames").alias("frame_count"), "frames"))
    sinks.text_files(_manifests(spark, d).select(F.concat_ws("/", "part", "video", F.lit("metadata.json")).alias("path"), body.alias("content")), f"{root}/crops")
    entries = F.map_from_entries(F.collect_list(F.struct("filename", F.struct("label", "original"))))
    sinks.text_files(_parts(spark, d).groupBy("part").agg(F.to_json(entries).alias("content")).select(F.concat("part", F.lit("/metadata.json")).alias("path"), "content"), f"{root}/raw")
    return root


@query("SELECT 'p' || user_id % 3 AS part, 'v' || user_id AS video, 'v' || user_id || '.mp4' AS source, (user_id % 2)::INT AS label, count(*)::INT AS frame_count, (count(*) FILTER (event_type <> 'error'))::INT AS ok_frames FROM events WHERE user_id % 7 <> 3 GROUP BY user_id")
def manifest_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = readers.manifests(spark, f"{_manifest_files(spark, d)}/crops")
    return rows.select("part", "video", "source", "label", "frame_count", F.size(F.filter("frames", lambda f: f["status"] == "ok")).alias("ok_frames"))


@query("SELECT DISTINCT 'p' || user_id % 3 AS part, 'v' || user_id || '.mp4' AS filename, CASE WHEN user_id % 2 = 1 THEN 'FAKE' ELSE 'REAL' END AS label, CASE WHEN user_id % 2 = 1 THEN 'v' || (user_id - 1) || '.mp4' END AS original FROM events")
def part_metadata_scan(spark: SparkSession, d: str) -> DataFrame:
    return readers.part_metadata(spark, f"{_manifest_files(spark, d)}/raw")


@query("SELECT p_name || ' of ' || p_partkey AS name FROM part")
def name_list_scan(spark: SparkSession, d: str) -> DataFrame:
    """The second field of white-space separated lines, blank lines left out, of a list for each brand."""
    line = F.concat(F.lit(" "), F.col("p_partkey"), F.lit(" \t "), "p_name", F.lit(" of "), "p_partkey")
    lists = table(spark, d, "part").groupBy("p_brand").agg(F.concat(F.array_join(F.collect_list(line), "\n\n"), F.lit("\n  \n")).alias("content"))
    root = scratch_folder(spark, "lists")
    sinks.text_files(lists.select(F.concat("p_brand", F.lit(".txt")).alias("path"), "content"), root)
    return readers.name_list(spark, root)


def _supplier_files(spark: SparkSession, d: str) -> str:
    root = scratch_folder(spark, "files")
    sinks.text_files(table(spark, d, "supplier").select(F.concat("s_nationkey", F.lit("/"), "s_name", F.lit(".txt")).alias("path"), F.concat(F.lit("text of "), "s_name").alias("content")), root)
    return root


@query("SELECT s_name || '.txt' AS name, s_nationkey::VARCHAR AS category, length('text of ' || s_name)::BIGINT AS size FROM supplier")
def file_listing(spark: SparkSession, d: str) -> DataFrame:
    """Files under category folders, with their sizes and no content read."""
    files = readers.listing(spark, _supplier_files(spark, d), "*.txt")
    return files.select(paths.name(F.col("path")).alias("name"), paths.parent_name(F.col("path")).alias("category"), "size")


@query("SELECT s_name AS stem, 1::BIGINT AS files FROM supplier")
def file_stems(spark: SparkSession, d: str) -> DataFrame:
    return readers.stem_index(readers.listing(spark, _supplier_files(spark, d))).select("stem", F.size("paths").cast("long").alias("files"))


@query("SELECT s_name || '.txt' AS name, sha256('text of ' || s_name) AS sha256 FROM supplier")
def file_sha256(spark: SparkSession, d: str) -> DataFrame:
    return readers.file_digests(spark, _supplier_files(spark, d)).select(paths.name(F.col("path")).alias("name"), "sha256")


@query("SELECT n_name AS part, n_nationkey::BIGINT AS place FROM nation WHERE n_nationkey IN (3, 10, 21)")
def requested_parts(spark: SparkSession, d: str) -> DataFrame:
    """Requested parts that are there, each once whatever the request repeats, in numeric order; one that is missing is an error."""
    there = table(spark, d, "nation").select("n_nationkey", "n_name")
    asked = spark.createDataFrame([(21,), (3,), (10,), (3,)], "n_nationkey int").distinct()
    checks.require_none(asked.join(there, "n_nationkey", "left_anti"), "missing parts")
    return asked.join(there, "n_nationkey").orderBy("n_nationkey").select(F.col("n_name").alias("part"), F.col("n_nationkey").cast("long").alias("place"))


# ---------------------------------------------------------------- sinks


@query("SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS price FROM orders")
def json_report_round_trip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("price"))
    path = scratch_folder(spark, "report")
    sinks.json_report(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def csv_report_round_trip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer")
    path = scratch_folder(spark, "report")
    sinks.csv_report(rows, path, ["c_custkey", "c_name", "c_nationkey"])
    return spark.read.schema("c_custkey long, c_name string, c_nationkey int").csv(path, header=True)


@query("SELECT vec_id, CASE WHEN label < 5 THEN 'calibration' ELSE 'evaluation' END AS role, label + CASE WHEN label < 5 THEN 100 ELSE 0 END AS value FROM embeddings")
def evidence_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Evidence by role; writing one role again leaves the other."""
    rows = table(spark, d, "embeddings").select("vec_id", F.when(F.col("label") < 5, "calibration").otherwise("evaluation").alias("role"), "label")
    path = scratch_folder(spark, "evidence")
    sinks.evidence(rows, path)
    sinks.evidence(rows.where("role = 'calibration'").withColumn("label", F.col("label") + 100), path)
    return spark.read.parquet(path).select("vec_id", "role", F.col("label").alias("value"))


@query("SELECT 'cosine' AS method, count(DISTINCT label)::BIGINT AS image_count, count(*) AS patch_count, 0.5::DOUBLE AS foreground_minimum, 0.1::DOUBLE AS top_fraction FROM embeddings")
def bank_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A bank written, checked against its completion row, and counted."""
    e = table(spark, d, "embeddings")
    path = scratch_folder(spark, "bank")
    sinks.bank(e.select(F.col("vec_id").alias("bank_patch_id"), F.col("label").alias("source_idx"), F.lit(0).alias("patch_id"), "embedding"), e.select(F.col("label").alias("source_idx")).distinct(), path, "plan", 0.5, 0.1)
    sinks.load_bank(spark, path, "plan")
    return spark.read.parquet(f"{path}/complete").drop("plan_sha256")


@query("SELECT p_partkey, p_size::INT AS size, p_size % 7 = 0 AS bad, CASE WHEN p_size % 7 = 0 THEN 'alignment' END AS reason FROM part")
def quarantined_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that fail a check go to a report with their reason; the others stay."""
    good, bad = sinks.quarantine(table(spark, d, "part").select("p_partkey", F.col("p_size").cast("int").alias("size")), F.col("size") % 7 == 0, "alignment")
    return good.select("*", F.lit(False).alias("bad"), F.lit(None).cast("string").alias("reason")).unionByName(bad.select("p_partkey", "size", F.lit(True).alias("bad"), "reason"))


# ---------------------------------------------------------------- names and boxes


@query("""WITH u AS (SELECT page_id, url, url || CASE page_id % 3 WHEN 0 THEN '/../x' WHEN 1 THEN '/..x' ELSE '/y/..' END AS other FROM pages)
SELECT page_id, (url LIKE 'https://%' AND NOT regexp_matches(url, '(^|/)\\.\\.(/|$)')) AS inside, (other LIKE 'https://%' AND NOT regexp_matches(other, '(^|/)\\.\\.(/|$)')) AS stepped FROM u""")
def path_containment(spark: SparkSession, d: str) -> DataFrame:
    """Whether a path stays under a folder; a step up never does."""
    u = F.col("url")
    step = F.when(F.col("page_id") % 3 == 0, "/../x").when(F.col("page_id") % 3 == 1, "/..x").otherwise("/y/..")
    return table(spark, d, "pages").select("page_id", paths.inside(u, F.lit("https:/")).alias("inside"), paths.inside(F.concat(u, step), F.lit("https:/")).alias("stepped"))


@query("SELECT user_id, (user_id % 2)::INT AS y, CASE WHEN user_id % 2 = 1 THEN 'FAKE' ELSE 'REAL' END AS decoded, 'out/p' || (user_id % 3) || '/v' || user_id || '/frame_000007.npy' AS target FROM (SELECT DISTINCT user_id FROM events)")
def decoded_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels decoded from their names, and the output path of a frame."""
    rows = _parts(spark, d).withColumn("stem", paths.stem(F.col("filename")))
    y = F.when(F.col("label") == "FAKE", 1).when(F.col("label") == "REAL", 0)
    return rows.select(F.substr("stem", F.lit(2)).cast("long").alias("user_id"), y.alias("y"), F.col("label").alias("decoded"), F.concat_ws("/", F.lit("out"), "part", "stem", paths.frame_file(F.lit(7))).alias("target"))


_BOXES = "SELECT p_partkey, (p_size * 7 % 50)::DOUBLE AS x, (p_size * 3 % 40)::DOUBLE AS y, (p_size + 5)::DOUBLE AS w, (p_size % 9 + 3)::DOUBLE AS h FROM part"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr("p_partkey", "CAST(p_size * 7 % 50 AS DOUBLE) AS x", "CAST(p_size * 3 % 40 AS DOUBLE) AS y", "CAST(p_size + 5 AS DOUBLE) AS w", "CAST(p_size % 9 + 3 AS DOUBLE) AS h")


@query(f"""WITH b AS ({_BOXES}), c AS (SELECT p_partkey, x / 0.5::DOUBLE AS x0, y / 0.5::DOUBLE AS y0, (x + w) / 0.5::DOUBLE AS x1, (y + h) / 0.5::DOUBLE AS y1 FROM b)
SELECT p_partkey, greatest(0, floor(x0 - (x1 - x0) * 0.25::DOUBLE))::BIGINT AS x0, greatest(0, floor(y0 - (y1 - y0) * 0.25::DOUBLE))::BIGINT AS y0,
  least(120, ceil(x1 + (x1 - x0) * 0.25::DOUBLE))::BIGINT AS x1, least(90, ceil(y1 + (y1 - y0) * 0.25::DOUBLE))::BIGINT AS y1 FROM c""")
def crop_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Detections back in frame pixels, widened by a margin and clipped to the frame."""
    box = grids.crop_box(F.array("x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h")), F.lit(0.5), 0.25, F.lit(120), F.lit(90))
    return _boxes(spark, d).select("p_partkey", box.alias("b")).select("p_partkey", *[F.col("b")[k].cast("long").alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))])


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, (l_quantity % 9 + 1) AS w, (l_suppkey % 5 + 1)::DOUBLE AS h, l_partkey % 3 = 0 AS inverted FROM lineitem),
b AS (SELECT l_orderkey, l_linenumber, CASE WHEN inverted THEN w ELSE 0 END AS x0, CASE WHEN inverted THEN h ELSE 0 END AS y0, CASE WHEN inverted THEN 0 ELSE w END AS x1, CASE WHEN inverted THEN 0 ELSE h END AS y1, CASE WHEN inverted THEN 0 ELSE w * h END AS area FROM c)
SELECT l_orderkey, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1 FROM b QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY area DESC, l_linenumber, x0, y0, x1, y1) = 1""")
def largest_detections(spark: SparkSession, d: str) -> DataFrame:
    """Of each frame's detections, some of them inverted, the largest, the first of equals."""
    w, h, inverted = F.expr("CAST(l_quantity % 9 + 1 AS DOUBLE)"), F.expr("CAST(l_suppkey % 5 + 1 AS DOUBLE)"), F.expr("l_partkey % 3 = 0")
    zero = F.lit(0.0)
    box = F.when(inverted, F.array(w, h, zero, zero)).otherwise(F.array(zero, zero, w, h))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", box.alias("box"))
    per = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "box"))).alias("found"))
    best = per.select("l_orderkey", grids.largest_box(F.transform("found", lambda s: s["box"])).alias("b"))
    return best.select("l_orderkey", *[F.col("b")[k].alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))])


@query("""WITH b AS (SELECT p_partkey, (p_size * 7 % 50)::DOUBLE * 3 AS x0, (p_size * 3 % 40)::DOUBLE * 3 AS y0, (p_size % 9 - 2)::DOUBLE AS w, (p_size + 5)::DOUBLE AS h FROM part),
c AS (SELECT p_partkey, greatest(0, floor(x0 - w * 0.25::DOUBLE)) AS x0, greatest(0, floor(y0 - h * 0.25::DOUBLE)) AS y0, least(120, ceil(x0 + w + w * 0.25::DOUBLE)) AS x1, least(90, ceil(y0 + h + h * 0.25::DOUBLE)) AS y1 FROM b)
SELECT p_partkey, x1 > x0 AND y1 > y0 AS valid, CASE WHEN x1 > x0 AND y1 > y0 THEN ((x1 - x0) * (y1 - y0))::BIGINT ELSE 0 END AS pixels FROM c""")
def box_validity(spark: SparkSession, d: str) -> DataFrame:
    """Detections of which the frame leaves nothing, or that are inverted, apart from the others; their crops would be errors."""
    rows = table(spark, d, "part").selectExpr("p_partkey", "CAST(p_size * 7 % 50 AS DOUBLE) * 3 AS x", "CAST(p_size * 3 % 40 AS DOUBLE) * 3 AS y", "CAST(p_size % 9 - 2 AS DOUBLE) AS w", "CAST(p_size + 5 AS DOUBLE) AS h")
    box = grids.clipped_box(F.array("x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h")), F.lit(1.0), 0.25, F.lit(120), F.lit(90))
    good, bad = sinks.quarantine(rows.select("p_partkey", box.alias("b")), grids.empty_box(F.col("b")), "invalid box")
    pixels = (F.col("b")[2] - F.col("b")[0]) * (F.col("b")[3] - F.col("b")[1])
    return good.select("p_partkey", F.lit(True).alias("valid"), pixels.cast("long").alias("pixels")).unionByName(bad.select("p_partkey", F.lit(False).alias("valid"), F.lit(0).cast("long").alias("pixels")))


@query("""WITH l AS (SELECT vec_id, list_transform(embedding[1:19], lambda x: x::DOUBLE * 8) AS z FROM embeddings), p AS (SELECT vec_id, z, list_max(z) AS m FROM l)
SELECT vec_id, (CASE WHEN 1 / list_sum(list_transform(z, lambda x: exp(x - m))) >= 0.2 THEN list_position(z, m) - 1 ELSE 255 END)::INT AS class FROM p""")
def class_from_logits(spark: SparkSession, d: str) -> DataFrame:
    """Class of highest soft-maximum, or 255 where it is not sure enough."""
    z = F.transform(F.slice("embedding", 1, 19), lambda x: x.cast("double") * 8)
    return table(spark, d, "embeddings").select("vec_id", grids.logits_to_class(z, 0.2).alias("class"))


_PIXELS = "SELECT l_partkey % 40 AS image, (l_orderkey % 28)::INT AS y, (l_suppkey % 28)::INT AS x, (l_quantity * 5 % 40)::INT AS r, (l_linenumber * 6 % 30)::INT AS g, (l_partkey % 20)::INT AS b FROM lineitem"


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr("l_partkey % 40 AS image", "CAST(l_orderkey % 28 AS INT) AS y", "CAST(l_suppkey % 28 AS INT) AS x", "CAST(l_quantity * 5 % 40 AS INT) AS r", "CAST(l_linenumber * 6 % 30 AS INT) AS g", "CAST(l_partkey % 20 AS INT) AS b")


_OCCUPANCY = f"SELECT image, y // 14 AS row, x // 14 AS col, avg((greatest(r, g, b) > 16)::INT) AS o FROM ({_PIXELS}) GROUP BY ALL"


@query(f"SELECT image, row, col, round(o, 6) AS occupancy FROM ({_OCCUPANCY})")
def pixel_occupancy(spark: SparkSession, d: str) -> DataFrame:
    """Share of bright pixels of each patch."""
    return grids.pixel_occupancy(_pixels(spark, d), "image", 14).withColumn("occupancy", F.round("occupancy", 6))


@query(f"SELECT image, row, col FROM ({_OCCUPANCY}) WHERE o >= 0.72")
def foreground_patches(spark: SparkSession, d: str) -> DataFrame:
    return grids.pixel_occupancy(_pixels(spark, d), "image", 14).where("occupancy >= 0.72").select("image", "row", "col")


@query("SELECT l_partkey % 40 AS image, CASE WHEN avg((l_linenumber = 1)::INT) >= 0.25 THEN round(avg((l_linenumber = 1)::INT), 6) END AS area FROM lineitem GROUP BY 1")
def area_gate(spark: SparkSession, d: str) -> DataFrame:
    """Face area per image, null where it is too small."""
    rows = table(spark, d, "lineitem").selectExpr("l_partkey % 40 AS image", "l_linenumber AS class")
    return grids.area_gate(rows, "image", 0.25).withColumn("area", F.round("area", 6))


_GRID = "SELECT (p_partkey // 196)::INT AS image, (p_partkey % 196 // 14)::INT AS row, (p_partkey % 14)::INT AS col, (p_size * 5)::INT AS value FROM part"


def _grid(spark: SparkSession, d: str) -> DataFrame:
    """Parts as pixels of images of 14 by 14, their brightness from their size."""
    return table(spark, d, "part").selectExpr("CAST(floor(p_partkey / 196) AS INT) AS image", "CAST(floor(p_partkey % 196 / 14) AS INT) AS row", "CAST(p_partkey % 14 AS INT) AS col", "CAST(p_size * 5 AS INT) AS value")


@query(f"""WITH g AS ({_GRID}), m AS (SELECT * FROM g WHERE value > 180 AND row BETWEEN 3 AND 9), b AS (SELECT image, min(row) AS y0, max(row) AS y1, min(col) AS x0, max(col) AS x1 FROM m GROUP BY image)
SELECT g.image, (g.row - y0)::INT AS row, (g.col - x0)::INT AS col, (CASE WHEN value > 180 AND g.row BETWEEN 3 AND 9 THEN value ELSE 0 END)::INT AS value FROM g JOIN b ON g.image = b.image AND g.row BETWEEN y0 AND y1 AND g.col BETWEEN x0 AND x1""")
def cropped_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Images cut to the box of their mask, black outside the mask."""
    g = _grid(spark, d)
    return grids.crop(g, g.where("value > 180 AND row BETWEEN 3 AND 9"), "image")


@query(f"""WITH g AS ({_GRID}) SELECT image, 'nearest' AS kind, r::INT AS row, c::INT AS col, value::DOUBLE AS value FROM g, (SELECT unnest(range(9)) AS r), (SELECT unnest(range(9)) AS c)
WHERE row = floor((r + 0.5::DOUBLE) * (14 / 9::DOUBLE)) AND col = floor((c + 0.5::DOUBLE) * (14 / 9::DOUBLE))
UNION ALL SELECT image, 'box', (row // 7)::INT, (col // 7)::INT, round(avg(value), 6) FROM g GROUP BY ALL""")
def resized_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Images at another size, by the nearest pixel and by the mean of a box."""
    g = _grid(spark, d)
    near = grids.resize_nearest(g, "image", 14, 9).withColumn("value", F.col("value").cast("double"))
    box = grids.resize_box(g, "image", 7).withColumn("value", F.round("value", 6))
    return near.select("image", F.lit("nearest").alias("kind"), "row", "col", "value").unionByName(box.select("image", F.lit("box").alias("kind"), "row", "col", "value"))


@query(f"""WITH g AS ({_GRID}), t AS (SELECT row, col, value AS t FROM g WHERE image = 0)
SELECT image, round(avg(abs(value - t)), 6) AS error, avg(abs(value - t)) <= 80 AS aligned FROM g JOIN t USING (row, col) GROUP BY image""")
def template_alignment(spark: SparkSession, d: str) -> DataFrame:
    """How far images are from a template, and whether that is near enough."""
    g = _grid(spark, d)
    return grids.aligned(g, g.where("image = 0"), "image", 80.0).withColumn("error", F.round("error", 6))


@query("SELECT vec_id, (k - 5)::INT AS token, round(embedding[k]::DOUBLE, 6) AS x FROM embeddings, (SELECT unnest(range(5, 65)) AS k)")
def patch_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens after the leading class and register tokens, in storage precision."""
    t = table(spark, d, "embeddings").select("vec_id", F.posexplode(vectors.storage_floats(vectors.token_slice(F.col("embedding"), 4))).alias("token", "x"))
    return t.withColumn("x", F.round(F.col("x").cast("double"), 6))


@query("SELECT vec_id AS item_id, k::INT AS patch_id, round(embedding[k * 2 + 3]::DOUBLE, 5) + 0.0 AS a, round(embedding[k * 2 + 4]::DOUBLE, 5) + 0.0 AS b FROM embeddings, (SELECT unnest(range(31)) AS k)")
def encoded_patches(spark: SparkSession, d: str) -> DataFrame:
    """The encoder hook with a function that reshapes a vector into tokens of two numbers, the first left out."""

    def make():
        import numpy as np

        return lambda batch: np.stack(batch["embedding"].tolist()).reshape(len(batch), 32, 2)

    items = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    out = encoding.encode(items, make, "reshape")
    return out.select("item_id", "patch_id", (F.round(F.col("embedding")[0].cast("double"), 5) + 0.0).alias("a"), (F.round(F.col("embedding")[1].cast("double"), 5) + 0.0).alias("b"))


# ---------------------------------------------------------------- checks and figures


@query("""SELECT count(*) AS bank_rows, 64::BIGINT AS dim, (count(*) * 64 * 8 + 1024 * least(16384, count(*)) * 8 + least(16384, count(*)) * 64 * 12 + 536870912)::BIGINT AS bytes, true AS broadcast FROM embeddings""")
def memory_need(spark: SparkSession, d: str) -> DataFrame:
    """What a search of all vectors needs of a worker, and the way it would run."""
    size = table(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    need, way = search.Need(size.n, size.dim).bytes(), search.way(size.n, size.dim)
    return spark.createDataFrame([(size.n, size.dim, need, way.broadcast)], "bank_rows long, dim long, bytes long, broadcast boolean")


@query("SELECT 'evaluation' AS role, conv_id AS sample_id, turn AS patch_id FROM conversations WHERE conv_id % 9 = 0 AND turn = 0 UNION ALL SELECT 'evaluation', conv_id, turn + 1000 FROM conversations WHERE conv_id % 10 = 0 AND turn = 1")
def evidence_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Patches that only the queries or only the saved evidence has."""
    rows = table(spark, d, "conversations").select(F.lit("evaluation").alias("role"), F.col("conv_id").alias("sample_id"), F.col("turn").alias("patch_id"))
    saved = rows.where("NOT (sample_id % 9 = 0 AND patch_id = 0)").unionByName(rows.where("sample_id % 10 = 0 AND patch_id = 1").withColumn("patch_id", F.col("patch_id") + 1000))
    return checks.evidence_mismatch(rows, saved)


@query("""WITH a AS (SELECT s_nationkey AS nation, count(*) AS n FROM supplier GROUP BY 1), b AS (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1),
k AS (SELECT 'nations' AS what, (SELECT count(*) FROM (SELECT nation FROM a EXCEPT ALL SELECT nation FROM b)) + (SELECT count(*) FROM (SELECT nation FROM b EXCEPT ALL SELECT nation FROM a)) AS differ
UNION ALL SELECT 'counts', (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) + (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)))
SELECT what, differ, differ = 0 AS same FROM k""")
def set_equality(spark: SparkSession, d: str) -> DataFrame:
    """Whether suppliers and customers are of the same nations, and as many of each."""
    per = lambda name, key: table(spark, d, name).groupBy(F.col(key).alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    a, b = per("supplier", "s_nationkey"), per("customer", "c_nationkey")
    out = None
    for what, columns in (("nations", ["nation"]), ("counts", ["nation", "n"])):
        one = checks.differing_rows(a.select(*columns), b.select(*columns)).agg(F.count(F.lit(1)).alias("differ")).select(F.lit(what).alias("what"), "differ", (F.col("differ") == 0).alias("same"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT l_orderkey, l_linenumber, count(*) AS rows FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber = 7) GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return checks.duplicates(rows.unionByName(rows.where("l_linenumber = 7")), ["l_orderkey", "l_linenumber"])


@query("""WITH c AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS keys, list(o_totalprice ORDER BY o_orderdate, o_orderkey) AS prices FROM orders GROUP BY 1)
SELECT o_custkey, unnest(range(len(keys)))::INT AS place, unnest(keys) AS o_orderkey, unnest(prices)::DOUBLE AS price FROM c""")
def zipped_lists(spark: SparkSession, d: str) -> DataFrame:
    """Two ordered lists of each customer put side by side place by place; lists of unequal length would be an error."""
    rows = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_totalprice")))
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(rows.alias("r")).select("o_custkey", F.transform("r", lambda x: x["o_orderkey"]).alias("keys"), F.transform("r", lambda x: x["o_totalprice"].cast("double")).alias("prices"))
    return lists.select("o_custkey", F.posexplode(metadata.zipped(F.col("keys"), F.col("prices"), "o_orderkey", "price")).alias("place", "z")).select("o_custkey", "place", "z.o_orderkey", "z.price")


_PRICES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("SELECT " + ", ".join(f"round(quantile_cont({c}, {q}), 4) AS {c}_{n}" for c in _PRICES for q, n in ((0.01, "low"), (0.99, "high"))) + " FROM lineitem")
def column_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """1 % and 99 % quantiles of each column, all columns in one pass."""
    long_ = table(spark, d, "lineitem").select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("x")) for c in _PRICES])))
    q = metrics.exact_quantiles(long_, ["name"], "x", [0.01, 0.99])
    pick = lambda c, k: F.round(F.max(F.when(F.col("name") == c, F.col("q")[k])), 4)
    return q.agg(*[pick(c, k).alias(f"{c}_{n}") for c in _PRICES for k, n in enumerate(("low", "high"))])


@query("""WITH d AS (SELECT a.vec_id AS i, a.label AS li, b.label AS lj, avg(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS m FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY ALL),
s AS (SELECT i, min(m) FILTER (li = lj) AS a, min(m) FILTER (li <> lj) AS b FROM d GROUP BY i)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s""")
def silhouette_euclidean(spark: SparkSession, d: str) -> DataFrame:
    """Mean silhouette of all vectors by Euclidean distance, by pairs of blocks."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", vectors.doubles(F.col("embedding")).alias("vector"))
    return diagnostics.silhouette(rows, "label", "euclidean").select(F.round("silhouette", 6).alias("silhouette"))


@query("""WITH c AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, 0.5::DOUBLE AS c FROM embeddings),
q AS (SELECT quantile_cont(a, 0.01) AS la, quantile_cont(a, 0.99) AS ha, quantile_cont(b, 0.01) AS lb, quantile_cont(b, 0.99) AS hb FROM c)
SELECT vec_id, round(greatest(0, least(1, (a - la) / greatest(ha - la, 1e-6))), 6) AS r, round(greatest(0, least(1, (b - lb) / greatest(hb - lb, 1e-6))), 6) AS g, 0.0::DOUBLE AS b FROM c, q""")
def rgb_preview(spark: SparkSession, d: str) -> DataFrame:
    """Three components as colours between their 1 % and 99 % quantiles; a constant one is 0."""
    rows = table(spark, d, "embeddings").select("vec_id", F.array(F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double"), F.lit(0.5)).alias("reduced"))
    return diagnostics.rgb_preview(rows).select("vec_id", *[F.round(F.col("rgb")[k], 6).alias(n) for k, n in enumerate("rgb")])


@query("SELECT sum(p_size)::BIGINT AS total, sum(CASE WHEN p_type = 'ECONOMY' THEN p_size ELSE 0 END)::BIGINT AS encoder, sum(CASE WHEN p_type <> 'ECONOMY' THEN p_size ELSE 0 END)::BIGINT AS decoder FROM part WHERE p_partkey % 2 = 0")
def parameter_totals(spark: SparkSession, d: str) -> DataFrame:
    """Trainable parameters in all, of the encoder and of the decoder."""
    rows = table(spark, d, "part").where("p_partkey % 2 = 0")
    part = lambda c: F.sum(F.when(c, F.col("p_size")).otherwise(0)).alias
    return rows.agg(F.sum("p_size").alias("total"), part(F.col("p_type") == "ECONOMY")("encoder"), part(F.col("p_type") != "ECONOMY")("decoder"))


@query("""WITH RECURSIVE l AS (SELECT o_orderpriority AS run, month(o_orderdate)::INT AS epoch, round(avg(o_totalprice::DECIMAL(18,2))::DOUBLE, 2) AS loss FROM orders GROUP BY 1, 2),
f AS (SELECT run, epoch, loss, loss AS best, true AS better FROM l WHERE epoch = 1
  UNION ALL SELECT l.run, l.epoch, l.loss, CASE WHEN l.loss < f.best - 500 THEN l.loss ELSE f.best END, l.loss < f.best - 500 FROM f JOIN l ON l.run = f.run AND l.epoch = f.epoch + 1)
SELECT run, epoch, loss FROM f WHERE better""")
def checkpoint_epochs(spark: SparkSession, d: str) -> DataFrame:
    """Epochs at which a run improves on the last checkpoint by more than the least delta, which are those that write one: written, and
    read again."""
    rows = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("run"), F.month("o_orderdate").alias("epoch")).agg(F.round(F.avg(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"), 2).alias("loss"))
    path = scratch_folder(spark, "checkpoints")
    sampling.improvements(rows, "run", 500.0).write.partitionBy("run").parquet(path)
    return spark.read.parquet(path).select(F.col("run").cast("string").alias("run"), "epoch", "loss")


@query("SELECT p.doc_id AS path, CASE WHEN p.doc_id % 13 = 5 THEN 'missing' ELSE 'changed' END AS reason FROM documents p WHERE p.doc_id % 13 = 5 OR p.doc_id % 17 = 3 AND lower(p.text) <> p.text")
def changed_files(spark: SparkSession, d: str) -> DataFrame:
    """Of recorded files those that are gone, or whose content has another digest now."""
    docs = table(spark, d, "documents")
    recorded = docs.select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    now = docs.where("doc_id % 13 <> 5").select(F.col("doc_id").alias("path"), F.sha2(F.when(F.col("doc_id") % 17 == 3, F.lower("text")).otherwise(F.col("text")), 256).alias("sha256"))
    return checks.changed_files(recorded, now).select("path", "reason")


@query("SELECT s_suppkey, s_name, s_nationkey % 3 = 0 AS excluded FROM supplier WHERE NOT (s_nationkey % 3 = 0 AND s_suppkey % 2 = 0)")
def region_cache(spark: SparkSession, d: str) -> DataFrame:
    """Regions kept after exclusions, and the exclusions that stay as a report: written, and read as one table."""
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", (F.col("s_nationkey") % 3 == 0).alias("excluded"))
    gone = rows.where("excluded AND s_suppkey % 2 = 0")
    path = scratch_folder(spark, "regions")
    metadata.exclude(rows, gone, "s_suppkey").write.partitionBy("excluded").parquet(path)
    return readers.parquet(spark, path, "s_suppkey", "s_name", "excluded").withColumn("excluded", F.col("excluded").cast("boolean"))


@query("SELECT family, count(DISTINCT part)::BIGINT AS parts FROM (SELECT user_id % 5 AS family, CASE WHEN user_id % 2 = 0 THEN 'train' ELSE 'test' END AS part FROM events) GROUP BY family HAVING count(DISTINCT part) > 1")
def families_across(spark: SparkSession, d: str) -> DataFrame:
    """Families that stand in more than one part, all parts put together first."""
    rows = table(spark, d, "events").select((F.col("user_id") % 5).alias("family"), F.when(F.col("user_id") % 2 == 0, "train").otherwise("test").alias("part"))
    both = rows.where("part = 'train'").unionByName(rows.where("part = 'test'"))
    return both.groupBy("family").agg(F.countDistinct("part").alias("parts")).where("parts > 1")
