"""The queries of queries.py as DuckDB SQL, written from their definitions."""

from __future__ import annotations

from . import raster_queries, store_queries, training_queries  # noqa: F401  each has its SQL next to its queries
from .plan_queries import ORACLES as PLAN_ORACLES

ORACLES: dict[str, str] = dict(PLAN_ORACLES)

_PATCHES = """
e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rn FROM embeddings),
pv AS (SELECT vec_id, v, label, (label >= 5)::INT AS y, label::BIGINT * 1000000000 + rn // 5 AS image_id, (rn % 5)::INT AS patch_id,
  len(list_filter(v, lambda x: abs(x) > 0.03::DOUBLE)) / 64::DOUBLE AS occupancy, (label % 5)::VARCHAR || '/' || (rn // CASE WHEN label >= 5 THEN 20 ELSE 10 END)::VARCHAR AS family FROM e)"""

_ROLES = (
    _PATCHES
    + """,
fam AS (SELECT family, count(*) AS items, bool_or(y = 0) AS any_real, bool_and(y = 0) AS all_real FROM pv GROUP BY family),
cnt AS (SELECT count(*) FILTER (any_real) AS nr, count(*) FILTER (NOT any_real) AS nf FROM fam),
cal AS (SELECT family FROM (SELECT family, row_number() OVER (ORDER BY md5('42|cal|' || family), family) AS r FROM fam WHERE all_real), cnt
  WHERE r <= greatest(1, floor(nr * 0.15::DOUBLE))),
trn AS (SELECT family FROM (SELECT family, row_number() OVER (ORDER BY md5('42|bank|' || family), family) AS r FROM fam
    WHERE any_real AND family NOT IN (SELECT family FROM cal)), cnt WHERE r <= floor(nr * 0.70::DOUBLE)
  UNION ALL SELECT family FROM (SELECT family, row_number() OVER (ORDER BY md5('42|fake|' || family), family) AS r FROM fam WHERE NOT any_real), cnt
  WHERE r <= floor(nf * 0.70::DOUBLE)),
ro AS (SELECT pv.*, CASE WHEN family IN (SELECT family FROM cal) THEN 'calibration'
  WHEN family IN (SELECT family FROM trn) THEN CASE WHEN y = 0 THEN 'bank' ELSE 'train_fake' END ELSE 'evaluation' END AS role FROM pv)"""
)

_SEARCH = (
    _ROLES
    + """,
u AS (SELECT *, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS w FROM ro WHERE occupancy >= 0.7),
q AS (SELECT vec_id AS query_id, w AS qv, role, y, image_id, patch_id, family AS q_family FROM u WHERE role IN ('calibration', 'evaluation')),
b AS (SELECT vec_id AS bank_id, w AS bv, image_id AS b_image, patch_id AS b_patch, family FROM u WHERE role = 'bank'),
cand AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, bank_id) AS rank
  FROM (SELECT query_id, bank_id, list_inner_product(qv, bv) AS similarity FROM q, b) QUALIFY rank <= 16),
near AS (SELECT query_id, bank_id, greatest(0, least(2, 1 - similarity)) AS nearest_distance FROM cand WHERE rank = 1),
wt AS (SELECT query_id, rank, bank_id, similarity, exp((similarity - max(similarity) OVER g) / 0.07::DOUBLE) AS e FROM cand WINDOW g AS (PARTITION BY query_id)),
weighted AS (SELECT *, e / sum(e) OVER (PARTITION BY query_id) AS weight FROM wt)"""
)

#: The same over every patch, not those of the foreground alone.
_ALL = _SEARCH.replace(" WHERE occupancy >= 0.7", "")


def _distance(weights: str, name: str, column: str) -> str:
    """CTEs: reconstruction and its cosine distance."""
    return f""",
{name}_r AS (SELECT query_id, d, sum(weight * bv[d]) AS r FROM {weights} JOIN b USING (bank_id), (SELECT unnest(range(1, 65)) AS d) GROUP BY query_id, d),
{name} AS (SELECT query_id, greatest(0, least(2, 1 - sum(r * qv[d]) / (sqrt(sum(r * r)) * sqrt(sum(qv[d] * qv[d]))))) AS {column} FROM {name}_r JOIN q USING (query_id) GROUP BY query_id)"""


def _image(rows: str, value: str, name: str, extra: str = "") -> str:
    """CTE: mean of the largest tenth per image. rows has image_id, role, y, patch_id and the value."""
    keys = f"{extra}image_id, role, y"
    return f""",
{name} AS (SELECT {keys}, round(avg({value}), 6) AS score, max(n) AS patches, count(*) AS scoring_patches FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {value} DESC, patch_id) AS r, count(*) OVER (PARTITION BY {keys}) AS n FROM {rows})
  WHERE r <= greatest(1, ceil(n * 0.1::DOUBLE)) GROUP BY {keys})"""


_NEAR_ITEMS = "(SELECT * FROM near JOIN q USING (query_id))"
_TOPK_ITEMS = "(SELECT * FROM topk JOIN q USING (query_id))"
_TOPK = _SEARCH + _distance("weighted", "topk", "topk_distance")
_SCORES = _TOPK + _image(_TOPK_ITEMS, "topk_distance", "s")
_LIMIT = ", t AS (SELECT quantile_cont(score, 0.99) AS threshold FROM s WHERE role = 'calibration'), ev AS (SELECT * FROM s WHERE role = 'evaluation')"


def _curve(rows: str, group: str = "") -> str:
    """CTE cum: per distinct score tp, fp, p and n."""
    by = f"PARTITION BY {group} " if group else ""
    g = f"{group}, " if group else ""
    return f""",
sc AS (SELECT {g}score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM {rows} GROUP BY {g}score),
cum AS (SELECT *, sum(pos) OVER ({by}ORDER BY score DESC) AS tp, sum(neg) OVER ({by}ORDER BY score DESC) AS fp, sum(pos) OVER ({by}) AS p, sum(neg) OVER ({by}) AS n FROM sc)"""


_METRICS = """round(sum(pos * (n - fp + neg * 0.5::DOUBLE)) / max(p * n), 5) AS auroc, round(sum(pos::DOUBLE / p * (tp::DOUBLE / (tp + fp))), 5) AS average_precision"""


def _report(rows: str, group: str) -> str:
    """SELECT of ranking metrics per group, with thresholds from calibration."""
    return (
        f""",
t AS (SELECT {group}, quantile_cont(score, 0.99) AS threshold FROM {rows} WHERE role = 'calibration' GROUP BY {group}),
ev AS (SELECT * FROM {rows} WHERE role = 'evaluation')"""
        + _curve("ev", group)
        + f""",
cv AS (SELECT {group}, {_METRICS} FROM cum GROUP BY {group}),
rt AS (SELECT {group}, round(avg(CASE WHEN y = 0 THEN (score > threshold)::INT END), 5) AS fpr, round(avg(CASE WHEN y = 1 THEN (score > threshold)::INT END), 5) AS tpr,
  round(max(threshold), 5) AS threshold FROM ev JOIN t USING ({group}) GROUP BY {group})
SELECT * FROM cv JOIN rt USING ({group})"""
    )


def _q(name: str, ctes: str, select: str) -> None:
    ORACLES[name] = f"WITH {ctes.strip().lstrip(',')}\n{select}"


# ---------------------------------------------------------------- splits

_q("patch_view_rows", _PATCHES, "SELECT vec_id, label, y, image_id, patch_id, family FROM pv")
_q("family_profile", _ROLES, "SELECT * FROM fam")
_q("role_split_full", _ROLES, "SELECT vec_id, image_id, family, y, role FROM ro")
_q("role_counts", _ROLES, "SELECT role, count(*) AS patches, count(DISTINCT image_id) AS images, count(DISTINCT family) AS families FROM ro GROUP BY role")

_quota = _PATCHES + ", v AS (SELECT DISTINCT image_id AS video, family, y FROM pv)"
_used: list[str] = []
for _name, _y, _n in (("eval_fake", 1, 3), ("train_fake", 1, 2), ("bank", 0, 8), ("calibration", 0, 3), ("eval_real", 0, 3)):
    _out = "".join(f" AND family NOT IN (SELECT family FROM {u})" for u in _used)
    _salt = "fake" if _y else "real"
    _quota += f""",
{_name}_f AS (SELECT family, min(md5('42|{_salt}|' || video)) AS key, arg_min(video, md5('42|{_salt}|' || video)) AS video FROM v WHERE y = {_y}{_out} GROUP BY family),
{_name}_q AS (SELECT '{"evaluation" if _name.startswith("eval") else _name}' AS role, video, family, {_y} AS y FROM {_name}_f ORDER BY key, video LIMIT {_n})"""
    _used.append(f"{_name}_q")
_q("role_split_quota", _quota, " UNION ALL ".join(f"SELECT * FROM {u}" for u in _used))
_q("role_split_bank_only", _PATCHES + ", v AS (SELECT DISTINCT image_id AS video, family, y FROM pv)", "SELECT * FROM v WHERE y = 0 ORDER BY md5('42|bank-only|' || video), video LIMIT 10")
_q(
    "family_overlap_check",
    _ROLES,
    """SELECT (SELECT count(DISTINCT family) FROM ro) AS families,
  (SELECT count(*) FROM (SELECT family FROM ro GROUP BY family HAVING count(DISTINCT CASE WHEN role IN ('bank', 'train_fake') THEN 'train' ELSE role END) > 1)) AS overlapping,
  (SELECT count(DISTINCT family) FROM ro WHERE role IN ('calibration', 'evaluation') AND family IN (SELECT family FROM ro WHERE role = 'bank')) AS held_out_overlapping""",
)
_q(
    "train_validation",
    _ROLES
    + """, i AS (SELECT DISTINCT image_id, family FROM ro WHERE role = 'bank'), f AS (SELECT DISTINCT family FROM i),
h AS (SELECT family FROM (SELECT family, row_number() OVER (ORDER BY md5('42|validation|' || family), family) AS r, count(*) OVER () AS n FROM f)
  WHERE r <= least(n - 1, greatest(1, round_even(n * 0.2::DOUBLE, 0))))""",
    "SELECT image_id, family, CASE WHEN family IN (SELECT family FROM h) THEN 'validation' ELSE 'train' END AS part FROM i",
)
_q(
    "epoch_schedule",
    _ROLES + ", i AS (SELECT DISTINCT image_id AS id FROM ro WHERE role = 'bank')",
    "SELECT epoch, row_number() OVER (PARTITION BY epoch ORDER BY md5((42 + epoch) || '|epoch|' || id), id) - 1 AS place, id FROM i, (SELECT unnest(range(3))::INT AS epoch) QUALIFY place < 20",
)
_q("role_union", _ROLES, "SELECT DISTINCT role, image_id FROM ro WHERE role IN ('bank', 'calibration', 'evaluation')")
_q("family_intersect", _PATCHES, "SELECT family FROM pv WHERE y = 0 INTERSECT SELECT family FROM pv WHERE y = 1")
_q("family_except", _PATCHES, "SELECT family FROM pv WHERE y = 0 EXCEPT SELECT family FROM pv WHERE y = 1")

# ---------------------------------------------------------------- search

_q("foreground_filter", _PATCHES, "SELECT vec_id, image_id, round(len(list_filter(v, lambda x: abs(x) > 0.05)) / len(v), 6) AS occupancy FROM pv WHERE len(list_filter(v, lambda x: abs(x) > 0.05)) / len(v) >= 0.5")
_q("foreground_missing_images", _PATCHES, "SELECT image_id FROM pv GROUP BY image_id HAVING max(len(list_filter(v, lambda x: abs(x) > 0.1)) / len(v)) < 0.25")
ORACLES["l2_normalised"] = """WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings)
SELECT vec_id, (k - 1)::INT AS dim, round(v[k] / l, 6) AS x FROM n, (SELECT unnest(range(1, 65)) AS k)"""
ORACLES["invalid_vectors"] = "SELECT count(*) AS vectors, count(*) FILTER (len(embedding) <> 64 OR list_inner_product(embedding, embedding) = 0) AS invalid FROM embeddings"
_q("bank_index", _ROLES, "SELECT row_number() OVER (ORDER BY image_id, patch_id) - 1 AS bank_patch_id, image_id AS source_image, patch_id, family FROM ro WHERE role = 'bank' AND occupancy >= 0.7")
_q("nn1_distance", _ALL, "SELECT query_id, bank_id, round(nearest_distance, 6) AS distance FROM near")
_q("nn1_image_score", _ALL + _image(_NEAR_ITEMS, "nearest_distance", "s"), "SELECT * FROM s")
_q("topk_neighbors", _ALL, "SELECT query_id, rank, bank_id, round(similarity, 6) AS similarity FROM cand")
_q("topk_weights", _SEARCH, "SELECT query_id, rank, bank_id, round(weight, 6) AS weight FROM weighted")
_q("topk_distance", _ALL + _distance("weighted", "topk", "topk_distance"), "SELECT query_id, round(topk_distance, 6) AS distance FROM topk")
_q("topk_image_score", _SCORES, "SELECT * FROM s")
_q(
    "match_evidence",
    _TOPK
    + """, m AS (SELECT image_id, patch_id, bank_id, round(nearest_distance, 6) AS distance, round(topk_distance, 6) AS anomaly_distance FROM topk JOIN near USING (query_id) JOIN q USING (query_id)),
p AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY anomaly_distance DESC, patch_id) AS place, count(*) OVER (PARTITION BY image_id) AS n FROM m)""",
    """SELECT image_id, place, patch_id // 3 AS query_row, patch_id % 3 AS query_col, bank_id, b_image AS source_image, family AS source_family, b_patch // 3 AS source_row, b_patch % 3 AS source_col,
  distance, anomaly_distance, round(1 - distance, 6) AS cosine_similarity FROM p JOIN b USING (bank_id) WHERE place <= least(2, greatest(1, ceil(n * 0.1::DOUBLE)))""",
)
_q(
    "dense_distance_map",
    _SEARCH + f", m AS (SELECT image_id, patch_id, round(nearest_distance, 6) AS distance FROM {_NEAR_ITEMS})",
    "SELECT i.image_id, c.cell, coalesce(m.distance, -1.0::DOUBLE) AS distance FROM (SELECT DISTINCT image_id FROM m) i CROSS JOIN (SELECT unnest(range(9))::INT AS cell) c LEFT JOIN m ON m.image_id = i.image_id AND m.patch_id = c.cell",
)
_BOTH = _TOPK + _image(_NEAR_ITEMS, "nearest_distance", "a") + _image(_TOPK_ITEMS, "topk_distance", "z")
_q("image_nearest_vs_topk", _BOTH, "SELECT a.image_id, a.score AS nearest, z.score AS topk FROM a JOIN z USING (image_id)")

# ---------------------------------------------------------------- metrics

_q("calibration_threshold", _SCORES + _LIMIT, "SELECT round(threshold, 6) AS threshold FROM t")
_q("image_predictions", _SCORES + _LIMIT, "SELECT image_id, y, score, CASE WHEN score > threshold THEN 'anomaly' ELSE 'normal' END AS prediction FROM ev, t")
_q(
    "eval_metrics",
    _SCORES + _LIMIT + _curve("ev") + f", cv AS (SELECT {_METRICS} FROM cum)",
    "SELECT cv.*, round(avg(CASE WHEN y = 0 THEN (score > threshold)::INT END), 5) AS fpr, round(avg(CASE WHEN y = 1 THEN (score > threshold)::INT END), 5) AS tpr, round(max(threshold), 5) AS threshold FROM ev, t, cv GROUP BY ALL",
)
ORACLES["method_comparison"] = f"WITH {_BOTH}, l AS (SELECT image_id, role, y, 'nearest' AS method, score FROM a UNION ALL SELECT image_id, role, y, 'topk', score FROM z)" + _report("l", "method")
_q("roc_points", _SCORES + _LIMIT + _curve("ev"), "SELECT round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr, score AS threshold FROM cum UNION ALL SELECT 0.0::DOUBLE, 0.0::DOUBLE, NULL::DOUBLE")
_q(
    "pr_points",
    _SCORES + _LIMIT + _curve("ev"),
    "SELECT round(tp / p, 6) AS recall, round(tp / (tp + fp), 6) AS precision, score AS threshold, round(p / (p + n), 6) AS prevalence FROM cum UNION ALL (SELECT 0.0::DOUBLE, 1.0::DOUBLE, NULL::DOUBLE, round(p / (p + n), 6) FROM cum LIMIT 1)",
)


def _histogram(rows: str, value: str, group: str, digits: int) -> str:
    return f"""SELECT {group}, bin, count(*) AS count, round(count(*) / (max(total) * max(width)), {digits}) AS density FROM (
  SELECT {group}, least(60, floor(({value} - lo) * 60 / (hi - lo)) + 1)::INT AS bin, (hi - lo) / 60 AS width, count(*) OVER (PARTITION BY {group}) AS total
  FROM {rows}, (SELECT min({value})::DOUBLE AS lo, max({value})::DOUBLE AS hi FROM {rows})) GROUP BY {group}, bin"""


_q("score_histogram", _SCORES + ", k AS (SELECT score, CASE WHEN role = 'calibration' THEN 'calibration' WHEN y = 0 THEN 'real' ELSE 'fake' END AS kind FROM s)", _histogram("k", "score", "kind", 4))

# ---------------------------------------------------------------- ablation

_CAP = ", cap AS (SELECT query_id, rank, bank_id, similarity, family, row_number() OVER (PARTITION BY query_id, family ORDER BY rank) <= 2 AS keep FROM cand JOIN b USING (bank_id))"
_CAPPED = _TOPK + _CAP
_EDGE = """, cells AS (SELECT image_id, patch_id, patch_id // 3 AS r, patch_id % 3 AS c FROM q),
edge AS (SELECT image_id, patch_id, CASE WHEN (SELECT count(*) FROM cells o WHERE o.image_id = cells.image_id AND abs(o.r - cells.r) + abs(o.c - cells.c) = 1) = 4 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS weight FROM cells)"""
_q("family_cap_candidates", _ALL + _CAP, "SELECT query_id, rank, bank_id, family, keep FROM cap")
_q("boundary_weights", _SEARCH + _EDGE, "SELECT * FROM edge")
_ABLATION = (
    _CAPPED
    + _EDGE
    + ", cw AS (SELECT query_id, rank, bank_id, exp((similarity - max(similarity) OVER g) / 0.07::DOUBLE) AS e FROM cap WHERE keep WINDOW g AS (PARTITION BY query_id)), cww AS (SELECT *, e / sum(e) OVER (PARTITION BY query_id) AS weight FROM cw)"
    + _distance("cww", "div", "diverse")
    + """, base AS (SELECT q.image_id, q.role, q.y, q.patch_id, topk_distance AS base, diverse, weight FROM topk JOIN div USING (query_id) JOIN q USING (query_id) JOIN edge ON edge.image_id = q.image_id AND edge.patch_id = q.patch_id),
l AS (SELECT *, 'topk' AS variant, base AS value FROM base UNION ALL SELECT *, 'topk_boundary', base * weight FROM base
  UNION ALL SELECT *, 'family_cap_topk', diverse FROM base UNION ALL SELECT *, 'family_cap_topk_boundary', diverse * weight FROM base)"""
    + _image("l", "value", "s", "variant, ")
)
_q("ablation_scores", _ABLATION, "SELECT variant, image_id, role, y, score FROM s")
ORACLES["ablation_report"] = "WITH " + _ABLATION.strip() + _report("s", "variant")
_q(
    "kept_candidate_stats",
    _ALL + _CAP + ", k AS (SELECT query_id, count(*) FILTER (keep) AS kept FROM cap GROUP BY query_id), i AS (SELECT image_id, avg(kept) AS m FROM k JOIN q USING (query_id) GROUP BY image_id)",
    "SELECT round(avg(m), 5) AS mean, round(min(m), 5) AS minimum, round(max(m), 5) AS maximum FROM i",
)

# ---------------------------------------------------------------- diagnostics

_PAIRS = (
    _ROLES
    + """, im AS (SELECT DISTINCT family, image_id AS image, y FROM ro WHERE role IN ('bank', 'train_fake')),
pick AS (SELECT family, y, arg_min(image, md5('42|pick|' || image)) AS image FROM im GROUP BY family, y),
pr AS (SELECT family, row_number() OVER (ORDER BY md5('42|pair|' || family), family) - 1 AS pair_id FROM (SELECT family FROM pick GROUP BY family HAVING count(*) = 2) QUALIFY pair_id < 500),
sm AS (SELECT 2 * pair_id + y AS analysis_id, pair_id, y, family, image FROM pick JOIN pr USING (family))"""
)
_POOL = """, ml AS (SELECT image_id, d, avg(v[d]) AS m FROM pv, (SELECT unnest(range(1, 65)) AS d) WHERE occupancy >= 0.7 GROUP BY image_id, d),
pool AS (SELECT image_id, d, m / sqrt(sum(m * m) OVER (PARTITION BY image_id)) AS x FROM ml)"""
_SAMPLED = _PAIRS + _POOL + ", sv AS (SELECT sm.*, d, x FROM sm JOIN pool ON pool.image_id = sm.image)"
_q("paired_samples", _PAIRS, "SELECT * FROM sm")
_q("mean_pool", _PATCHES + _POOL, "SELECT image_id, (d - 1)::INT AS at, round(x, 6) AS x FROM pool")
_q(
    "label_centroid_cosine",
    _SAMPLED + ", c AS (SELECT d, avg(x) FILTER (y = 0) AS a, avg(x) FILTER (y = 1) AS z FROM sv GROUP BY d)",
    "SELECT round(sum(a * z) / sqrt(sum(a * a) * sum(z * z)), 5) AS centroid_cosine FROM c",
)
_COS = _SAMPLED + """, n AS (SELECT max(pair_id) + 1 AS n FROM sm), r AS (SELECT * FROM sv WHERE y = 0), f AS (SELECT * FROM sv WHERE y = 1),
pc AS (SELECT r.pair_id, sum(r.x * f.x) AS paired, sum(r.x * g.x) AS shifted FROM r JOIN f ON f.pair_id = r.pair_id AND f.d = r.d, n JOIN f g ON true WHERE g.pair_id = (r.pair_id + 1) % n AND g.d = r.d GROUP BY r.pair_id)"""
_q("paired_cosine", _COS, "SELECT pair_id, round(paired, 6) AS paired, round(shifted, 6) AS shifted FROM pc")
_q("shifted_advantage", _COS, "SELECT round(avg(paired), 5) AS paired, round(avg(shifted), 5) AS shifted, round(avg(paired) - avg(shifted), 5) AS advantage FROM pc")
_q("pruned_neighbors", _SEARCH, "SELECT query_id, rank::INT AS rank, bank_id, round(similarity, 6) AS similarity FROM cand")
_q(
    "search_pruning",
    _SEARCH
    + """, size AS (SELECT greatest(1, least(4096, count(*) // 8)) AS n FROM b),
piv AS (SELECT bv AS p, row_number() OVER (ORDER BY md5(bank_id::VARCHAR), bank_id) - 1 AS cell FROM b QUALIFY cell < (SELECT n FROM size)),
put AS (SELECT bank_id, cell, acos(greatest(-1, least(1, list_inner_product(bv, p)))) AS angle FROM b, piv QUALIFY row_number() OVER (PARTITION BY bank_id ORDER BY list_inner_product(bv, p) DESC, cell) = 1),
blk AS (SELECT cell, count(*) AS n, min(angle) AS low, max(angle) AS high FROM put GROUP BY cell),
ang AS (SELECT query_id, cell, n, low, high, acos(greatest(-1, least(1, list_inner_product(qv, p)))) AS a FROM q, piv JOIN blk USING (cell)),
bnd AS (SELECT query_id, cell, n, cos(greatest(0, a - high, low - a)) AS bound FROM ang),
hel AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY bound DESC, cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 1 AS at_first FROM bnd),
lst AS (SELECT query_id, max(list_inner_product(qv, bv)) AS least FROM hel JOIN q USING (query_id) JOIN put USING (cell) JOIN b USING (bank_id) WHERE at_first GROUP BY query_id)""",
    "SELECT query_id, count(*) AS blocks, count(*) FILTER (at_first OR bound >= least - 1e-9) AS visited FROM hel JOIN lst USING (query_id) GROUP BY query_id",
)
ORACLES["contingency"] = "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic"
ORACLES["ari_nmi"] = """WITH c AS (SELECT quality AS a, toxic AS z, count(*)::DOUBLE AS n FROM labels GROUP BY ALL), r AS (SELECT a, sum(n) AS n FROM c GROUP BY a), k AS (SELECT z, sum(n) AS n FROM c GROUP BY z),
t AS (SELECT sum(n) AS n FROM c), x AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS i, (SELECT sum(n * (n - 1) / 2) FROM r) AS sa, (SELECT sum(n * (n - 1) / 2) FROM k) AS sb, (SELECT n * (n - 1) / 2 FROM t) AS st,
  (SELECT sum(c.n / t.n * ln(c.n * t.n / (r.n * k.n))) FROM c JOIN r USING (a) JOIN k USING (z), t) AS mi, (SELECT -sum(r.n / t.n * ln(r.n / t.n)) FROM r, t) AS ha, (SELECT -sum(k.n / t.n * ln(k.n / t.n)) FROM k, t) AS hb,
  (SELECT sum(n) FILTER (a = z) / sum(n) FROM c) AS acc)
SELECT round((i - sa * sb / st) / ((sa + sb) / 2 - sa * sb / st), 6) AS ari, round(mi / ((ha + hb) / 2), 6) AS nmi, round(greatest(acc, 1 - acc), 6) AS accuracy FROM x"""
_q("cluster_composition", _PATCHES, "SELECT label % 5 AS cluster, count(*) AS count, count(*) FILTER (y = 0) AS real, count(*) FILTER (y = 1) AS fake, round(avg(y), 6) AS fake_fraction FROM pv GROUP BY label % 5")
_q(
    "silhouette_cosine",
    _SAMPLED + """, sl AS (SELECT analysis_id, y, list(x ORDER BY d) AS x FROM sv GROUP BY analysis_id, y),
dd AS (SELECT i.analysis_id AS i, i.y AS yi, j.y AS yj, avg(greatest(0, least(2, 1 - list_inner_product(i.x, j.x)))) AS m FROM sl i JOIN sl j ON i.analysis_id <> j.analysis_id GROUP BY 1, 2, 3),
sc AS (SELECT i, min(m) FILTER (yi = yj) AS a, min(m) FILTER (yi <> yj) AS z FROM dd GROUP BY i)""",
    "SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (z - a) / greatest(a, z) END), 5) AS silhouette FROM sc",
)

# ---------------------------------------------------------------- metadata and sampling

ORACLES |= {
    "label_join_audit": """SELECT count(l.doc_id) AS labels, count(*) FILTER (l.doc_id IS NOT NULL AND d.doc_id IS NULL) AS missing_items, count(*) FILTER (l.doc_id IS NULL) AS unlabelled_items,
  count(*) FILTER (l.doc_id IS NOT NULL AND n_chars = 0) AS empty_items, count(*) FILTER (l.doc_id IS NOT NULL AND n_chars > 0) AS eligible FROM labels l FULL JOIN documents d ON l.doc_id = d.doc_id""",
    "label_conflicts": "SELECT conv_id, count(*) AS rows, count(DISTINCT role) AS labels FROM conversations GROUP BY conv_id HAVING count(*) > 1 OR count(DISTINCT role) > 1",
    "exclusion_antijoin": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "lookup_join": "SELECT n_name, count(*) AS customers, sum(c_acctbal::DECIMAL(18,2))::DOUBLE AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "matched_documents": "SELECT source, count(*) AS documents FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY source",
    "incremental_pending": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "status_counts": "SELECT CASE o_orderstatus WHEN 'F' THEN 'processed' WHEN 'O' THEN 'skipped' ELSE 'failed' END AS status, count(*) AS n FROM orders GROUP BY 1",
    "even_sample_per_group": """WITH r AS (SELECT user_id, event_id, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, unnest(range(10)) AS i FROM r)
SELECT DISTINCT user_id, event_id FROM g WHERE n <= 10 OR k = CASE WHEN i = 9 THEN n - 1 ELSE floor(i * ((n - 1)::DOUBLE / 9.0::DOUBLE)) END""",
    "class_limit": "SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 20",
    "sample_ordinals": "SELECT role, conv_id, turn, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1 AS sample_id FROM conversations",
    "first_per_group": "SELECT conv_id, arg_min(text, turn) AS first FROM conversations GROUP BY conv_id",
    "dedup_last": "SELECT user_id, event_type, min(event_id) AS first_seen, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type",
    "round_robin_shards": "SELECT event_id, ((row_number() OVER (ORDER BY event_id) - 1) % 3)::INT AS shard FROM events",
    "ordered_batches": "SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 8 AS batch FROM events",
    "circular_lead": "SELECT user_id, event_id, coalesce(lead(event_id) OVER w, first_value(event_id) OVER w) AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
    "group_offsets": "WITH g AS (SELECT l_returnflag || l_linestatus AS kind, count(*) AS n FROM lineitem GROUP BY 1) SELECT kind, n, coalesce(sum(n) OVER (ORDER BY kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM g",
    "early_stopping": """WITH RECURSIVE p AS (SELECT o_orderpriority AS run, date_trunc('month', o_orderdate) AS m, round(avg(o_totalprice::DECIMAL(18,2))::DOUBLE, 2) AS loss FROM orders GROUP BY 1, 2),
e AS (SELECT run, row_number() OVER (PARTITION BY run ORDER BY m) AS epoch, loss FROM p),
f AS (SELECT run, 1::BIGINT AS epoch, loss AS best, 1::BIGINT AS won, 0 AS stale FROM e WHERE epoch = 1
  UNION ALL SELECT e.run, e.epoch, CASE WHEN e.loss < best - 100 THEN e.loss ELSE best END, CASE WHEN e.loss < best - 100 THEN e.epoch ELSE won END, CASE WHEN e.loss < best - 100 THEN 0 ELSE stale + 1 END
  FROM f JOIN e ON e.run = f.run AND e.epoch = f.epoch + 1 WHERE f.stale < 5)
SELECT run, arg_max(won, epoch)::INT AS best_epoch, arg_max(best, epoch) AS best_loss, max(CASE WHEN stale >= 5 THEN epoch END)::INT AS stop_epoch FROM f GROUP BY run""",
    "weighted_epoch_means": "SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS discount, round(sum(l_tax * l_quantity) / sum(l_quantity), 6) AS tax FROM lineitem GROUP BY l_returnflag",
    "ema_schedule": "SELECT p_partkey AS step, round(1.0::DOUBLE - (1.0::DOUBLE - 0.996::DOUBLE) * (cos(pi() * least(1, p_partkey / (SELECT count(*) - 1 FROM part)::DOUBLE)) + 1) / 2, 9) AS momentum FROM part",
    "derived_seeds": "SELECT l_orderkey, l_linenumber, 1000003 + l_orderkey * 10007 + l_linenumber AS seed FROM lineitem",
    "path_functions": r"""SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\.[^.]+$', '\1') AS stem, regexp_extract(regexp_extract(url, '([^/]*)$', 1), '^.+(\.[^.]+)$', 1) AS suffix,
  regexp_extract(url, '^(.*)/[^/]*$', 1) AS parent, coalesce(string_split(url, '/')[-2], '') AS parent_name, format('frame_{:06d}.npy', page_id) AS frame FROM pages""",
    "flat_names": "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type || '-' || user_id || '-' || format('frame_{:06d}.jpg', event_id) END AS flat FROM events",
    "family_keys": "SELECT event_id, (value > 50)::INT AS y, event_type || '/v' || CASE WHEN value > 50 THEN event_id % 50 ELSE event_id END AS family FROM events",
    "json_props": "SELECT json_extract(props, '$.k')::INT AS k, count(*) AS n FROM events GROUP BY 1",
    "row_signature": """WITH d AS (SELECT sha256('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}') AS d FROM nation),
p AS (SELECT d[1:2] AS p, sha256(string_agg(d, '' ORDER BY d)) AS s, count(*) AS n FROM d GROUP BY 1) SELECT sha256(string_agg(s, '' ORDER BY p)) AS signature, sum(n)::BIGINT AS rows FROM p""",
    "text_digests": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "shuffled_order": "SELECT c_custkey, row_number() OVER (ORDER BY md5('42|order|' || c_custkey), c_custkey) - 1 AS place FROM customer",
    "quantiles_by_group": "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.01), 4) AS low, round(quantile_cont(l_extendedprice, 0.99), 4) AS high FROM lineitem GROUP BY l_returnflag",
    "top_fraction_mean": """SELECT l_suppkey, round(avg(p)::DOUBLE, 4) AS score, max(n) AS patches, count(*) AS scoring_patches FROM (SELECT l_suppkey, l_extendedprice::DECIMAL(18,2) AS p,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS r, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) WHERE r <= greatest(1, ceil(n * 0.1::DOUBLE)) GROUP BY l_suppkey""",
    "histogram_60": _histogram("lineitem", "l_quantity", "l_returnflag", 8),
    "top_n": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50",
    "variance_ratio": "WITH l AS (SELECT d, var_pop((embedding::DOUBLE[])[d]) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS d) GROUP BY d) SELECT round(sum(v) FILTER (d <= 8) / sum(v), 6) AS explained FROM l",
    "majority_class": "SELECT cell, class FROM (SELECT p_partkey % 50 AS cell, p_size % 8 AS class, count(*) AS n FROM part GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY cell ORDER BY n DESC, class) = 1",
}

_CELLS = "cells AS (SELECT (p_partkey // 196)::INT AS image, ((p_partkey % 196) // 14)::INT AS row, (p_partkey % 14)::INT AS col, p_size % 19 AS class FROM part)"
_REGIONS = (
    _CELLS
    + """, tc AS (SELECT c.*, (SELECT count(*) FROM cells o WHERE o.image = c.image AND abs(o.row - c.row) + abs(o.col - c.col) = 1 AND o.class NOT IN (0, 1, 3, 14, 16, 17, 18, 255)) < 4 AS touch FROM cells c),
rg AS (SELECT image, row, col, CASE WHEN class = 2 AND touch THEN 7 WHEN class = 2 THEN 1 WHEN class IN (6, 7) THEN 2 WHEN class IN (8, 9, 15) THEN 3 WHEN class = 10 THEN 4 WHEN class IN (11, 12, 13) THEN 5
  WHEN class = 14 THEN 6 WHEN class IN (4, 5) THEN 7 ELSE 0 END AS region FROM tc)"""
)
_q("grid_boundary", _CELLS + ", c AS (SELECT image, row, col FROM cells WHERE class <> 7)", "SELECT c.*, (SELECT count(*) FROM c o WHERE o.image = c.image AND abs(o.row - c.row) + abs(o.col - c.col) = 1) = 4 AS interior FROM c")
_q("semantic_regions", _REGIONS, "SELECT * FROM rg")
def _mask(seed: str) -> str:
    """CTE z: cells with what is covered, drawn by a seed."""
    return f""", f AS (SELECT *, md5({seed} || '|cell|' || image || '|' || row || '|' || col) AS key, count(*) OVER (PARTITION BY image) AS n FROM rg WHERE region <> 0),
pm AS (SELECT image, arg_min(region, md5({seed} || '|region|' || image || '|' || region)) AS pr FROM f WHERE region >= 2 GROUP BY image),
g AS (SELECT f.*, pr, least(n - 1, greatest(1, round_even(n * 0.75::DOUBLE, 0)))::BIGINT AS target, row_number() OVER (PARTITION BY f.image, region ORDER BY key, row, col) AS place, count(*) OVER (PARTITION BY f.image, region) AS size FROM f JOIN pm USING (image)),
h AS (SELECT *, least(target, count(*) FILTER (region = pr) OVER i) AS tf, count(*) FILTER (region = pr) OVER i AS np FROM g WINDOW i AS (PARTITION BY image)),
k AS (SELECT *, CASE WHEN region = pr THEN place <= target ELSE place <= floor(size * coalesce((target - tf)::DOUBLE / nullif(n - np, 0)::DOUBLE, 0)) END AS sure FROM h),
z AS (SELECT *, target - count(*) FILTER (sure) OVER (PARTITION BY image) AS need, row_number() OVER (PARTITION BY image, sure OR region = pr ORDER BY key, row, col) AS spare FROM k)"""


_COVERED = "row, col, region, sure OR (region <> pr AND spare <= need) AS masked, region = pr AND sure AS in_primary FROM z"
_q("covering_mask", _REGIONS + _mask("'42'"), f"SELECT image, {_COVERED}")
_q("prepared_batches", _REGIONS + _mask("(3 * 1000003 + image // 4 * 10007 + image % 4)::VARCHAR"), f"SELECT (image // 4)::BIGINT AS batch, (image % 4)::BIGINT AS place, (3 * 1000003 + image // 4 * 10007 + image % 4)::BIGINT AS seed, image, {_COVERED}")
_q("bounding_boxes", _CELLS, "SELECT image, min(col) AS x0, min(row) AS y0, max(col) + 1 AS x1, max(row) + 1 AS y1 FROM cells WHERE class IN (6, 7, 8) GROUP BY image")
ORACLES["detection_sizes"] = """WITH s AS (SELECT p_partkey, p_size * 40 + 1 AS w, p_size * 23 + p_partkey % 7 + 1 AS h FROM part), k AS (SELECT *, least(1.0::DOUBLE, 640.0::DOUBLE / greatest(w, h)) AS k FROM s)
SELECT p_partkey, greatest(1, round_even(w * k, 0))::INT AS width, greatest(1, round_even(h * k, 0))::INT AS height FROM k"""
ORACLES["event_windows"] = "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
