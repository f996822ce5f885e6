"""Line dedup by winnowing, in DataFrame functions only.

Lines with words are hashed. A window is the shortest run of whole lines from a line on that holds at least `min_words` words.
Of each window the least line hash is selected (the last of equal ones): the selected places are the text's fingerprints. Two
texts that share a run of lines with so many words share the window at its first line, and so are bound to share a fingerprint.

Fingerprints are joined by hash. A place whose hash stands at another place too is a match, which is then extended both
ways: to the windows around it that reach forward and those that reach back from each line. Windows that hold no match are
left out here. Extended matches are verified by the hashes of all their lines in order; every run but the first of those
equal to it (by doc_id, then place) is a repeat. Windows forward and back together cover each shared run to both its ends, so
the union of a text's repeats is what it shares with earlier places. Its lines are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, materialise

MIN_WORDS = 50
#: What tells a text apart, none of it null: texts without a doc_id have 0 there and stand last in order.
KEY = ["no_id", "doc_id", "fp"]


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the columns of KEY."""
    return docs.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.xxhash64("text").alias("fp"), "text")


def lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """KEY and found, one row per distinct (doc_id, text) with min_words words: found has (pos, h, w) for each line that has
    words, its place, hash and number of words."""
    each = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("pos"), F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(WORD)).cast("long").alias("w")))
    rows = _keyed(docs.where("text IS NOT NULL")).select(*KEY, F.filter(each, lambda s: s["w"] > 0).alias("found"))
    rows = rows.where(F.aggregate("found", F.lit(0).cast("long"), lambda s, x: s + x["w"]) >= min_words)
    return rows.groupBy(*KEY).agg(F.any_value("found").alias("found"))


def _by_doc():
    return Window.partitionBy(*KEY)


def _counted(each: DataFrame) -> DataFrame:
    """Lines with the words before them and up to them, and of the whole text."""
    running = _by_doc().orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = each.withColumn("upto", F.sum("w").over(running)).withColumn("total", F.sum("w").over(_by_doc()))
    return rows.withColumn("before", F.col("upto") - F.col("w"))


def _ahead(min_words: int):
    """The lines that begin within min_words - 1 words of this one's begin."""
    return _by_doc().orderBy("before").rangeBetween(0, min_words - 1)


def fingerprints(found: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """KEY, pos and h: the selected places, each once, of the texts in lines()."""
    rows = _counted(found.select(*KEY, F.inline("found")))
    least = F.min(F.struct("h", (-F.col("pos")).alias("minus"))).over(_ahead(min_words))
    rows = rows.select(*KEY, "total", "before", least.alias("least")).where(F.col("total") - F.col("before") >= min_words)
    return rows.select(*KEY, (-F.col("least.minus")).alias("pos"), F.col("least.h").alias("h")).distinct()


def matches(marks: DataFrame) -> DataFrame:
    """KEY and places: of each text the fingerprints whose hash is selected at another place too. Places are not paired:
    each meets the one row of its hash."""
    shared = marks.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    return marks.join(shared, "h").groupBy(*KEY).agg(F.collect_list("pos").alias("places"))


def extended(found: DataFrame, matched: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """KEY, content, first and last: the windows with a match in them, forward and back from each line."""
    rows = found.join(matched, KEY)
    line = F.transform("found", lambda s: F.struct(s["pos"].alias("pos"), s["h"].alias("h"), s["w"].alias("w"), F.lit(0).alias("m")))
    mark = F.transform("places", lambda p: F.struct(p.alias("pos"), F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("w"), F.lit(1).alias("m")))
    each = rows.select(*KEY, F.inline(F.concat(line, mark)))
    each = each.withColumn("m", F.max("m").over(Window.partitionBy(*KEY, "pos"))).where("w > 0")
    each = _counted(each)
    ahead, behind = _ahead(min_words), _by_doc().orderBy("upto").rangeBetween(-(min_words - 1), 0)
    run = lambda over: F.collect_list(F.struct("pos", "h", "m")).over(over)
    each = each.select(*KEY, "pos", "upto", "before", "total", run(ahead).alias("ahead"), run(behind).alias("behind"))
    whole = lambda ok, name: F.when(ok & F.exists(name, lambda s: s["m"] == 1), F.array_sort(name))
    both = F.array(whole(F.col("total") - F.col("before") >= min_words, "ahead"), whole(F.col("upto") >= min_words, "behind"))
    each = each.select(*KEY, F.explode(F.array_distinct(F.filter(both, lambda x: x.isNotNull()))).alias("run"))
    content = F.xxhash64(F.transform("run", lambda s: s["h"]))
    return each.select(content.alias("content"), *KEY, F.col("run")[0]["pos"].alias("first"), F.element_at("run", -1)["pos"].alias("last"))


def repeats(runs: DataFrame) -> DataFrame:
    """KEY and spans: for each text with repeats the spans (first, last) of lines to delete, apart from one another and in
    order. Only the part of a repeat after its first equal is deleted where the two overlap."""
    order = F.struct(*KEY, "first", "last")
    earliest = runs.groupBy("content").agg(F.min(order).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    same = F.struct(*KEY) == F.struct(*[F.col(f"f.{k}") for k in KEY])
    later = runs.join(earliest, "content").where(~(same & (F.col("first") == F.col("f.first"))))
    later = later.select(*KEY, F.when(same, F.greatest("first", F.col("f.last") + 1)).otherwise(F.col("first")).alias("first"), "last").where("first <= last").distinct()
    before = _by_doc().orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    begins = later.withColumn("begins", F.when(F.col("first") <= F.max("last").over(before) + 1, 0).otherwise(1))
    island = begins.withColumn("island", F.sum("begins").over(_by_doc().orderBy("first", "last").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = island.groupBy(*KEY, "island").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return merged.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text (without repeated runs), n_lines (before) and n_deleted.

    A null text stays null with no lines; an empty one stays empty and is one line. Lines without words are only deleted
    inside a repeat. Rows with equal doc_id and text are one document: none is a repeat of another, and they get equal
    results; a null doc_id comes last in order. Equal runs at several places are settled by doc_id and place. A very long text
    is worked on whole, in time that grows with its lines. An empty table gives no rows. Columns other than doc_id and text
    are not read, whatever their names.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = materialise(lines(rows, min_words), "lines")
    matched = matches(fingerprints(found, min_words))
    gone = materialise(repeats(extended(found, matched, min_words)), "repeats")
    discard(found)
    joined = _keyed(rows).join(gone.hint("shuffle_hash"), KEY, "left")
    every = F.split("text", "\n", -1)
    begin = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["last"] + 1))
    end = F.concat(F.transform("spans", lambda s: s["first"]), F.array(F.size("every")))
    stay = F.array_join(F.flatten(F.zip_with(begin, end, lambda a, b: F.slice("every", a + 1, b - a))), "\n")
    n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    joined = joined.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "text", n.cast("long").alias("n_lines"), "spans", F.when(F.col("spans").isNotNull(), every).alias("every"))
    deleted = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"] + 1)
    return joined.select("doc_id", F.when(F.col("spans").isNotNull(), stay).otherwise(F.col("text")).alias("text"), "n_lines", F.coalesce(deleted, F.lit(0).cast("long")).alias("n_deleted"))


def oracle(min_words: int = MIN_WORDS) -> str:
    """DuckDB SQL for dedup_lines(documents), on the lines themselves in place of their hashes."""
    return f"""
WITH l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
l1 AS (SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS w FROM l0),
l2 AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS upto, sum(w) OVER (PARTITION BY doc_id)::BIGINT AS total FROM l1 WHERE w > 0),
l3 AS (SELECT *, upto - w AS start FROM l2),
ahead AS (SELECT doc_id, min(pos) OVER f AS a, max(pos) OVER f AS b, string_agg(line, chr(10)) OVER f AS c, total - start >= {min_words} AS ok FROM l3
  WINDOW f AS (PARTITION BY doc_id ORDER BY start RANGE BETWEEN CURRENT ROW AND {min_words - 1} FOLLOWING)),
behind AS (SELECT doc_id, min(pos) OVER f AS a, max(pos) OVER f AS b, string_agg(line, chr(10)) OVER f AS c, upto >= {min_words} AS ok FROM l3
  WINDOW f AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN {min_words - 1} PRECEDING AND CURRENT ROW)),
wins AS (SELECT DISTINCT doc_id, a, b, md5(c) AS c FROM (SELECT * FROM ahead UNION ALL SELECT * FROM behind) WHERE ok),
ranked AS (SELECT *, first_value(doc_id) OVER g AS fd, first_value(a) OVER g AS fa, first_value(b) OVER g AS fb FROM wins WINDOW g AS (PARTITION BY c ORDER BY doc_id, a, b)),
later AS (SELECT doc_id, CASE WHEN doc_id = fd THEN greatest(a, fb + 1) ELSE a END AS a, b FROM ranked WHERE NOT (doc_id = fd AND a = fa)),
gone AS (SELECT doc_id, pos FROM (SELECT doc_id, unnest(range(a, b + 1)) AS pos FROM later WHERE a <= b) GROUP BY ALL),
kept AS (SELECT l0.doc_id, string_agg(line, chr(10) ORDER BY l0.pos) FILTER (g.pos IS NULL) AS text, count(*) AS n_lines, count(g.pos) AS n_deleted
  FROM l0 LEFT JOIN gone g ON l0.doc_id = g.doc_id AND l0.pos = g.pos GROUP BY l0.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_deleted, 0)::BIGINT AS n_deleted
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id"""
