"""Merkle manifest of a dataset: a tree per source over its rows in order, a tree over the sources' roots, a proof per row.

Executors reduce large blocks of consecutive leaves to one node each. What is left is a small top tree: the driver builds it and
broadcasts it, so that executors read each block's way to the root from it, finish the rows' proofs and fold them. Where even the
blocks' nodes are more than TOP_NODES, they are leaves of a further distributed tier, as often as it takes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import arrow_map
from .common import BROADCAST_ROWS, lower_ascii, materialise

FANOUT = 16
#: Levels of the tree within a block: a block has FANOUT ** BLOCK_LEVELS leaves.
BLOCK_LEVELS = 3
#: Nodes that the driver may hold and broadcast: 64 hex digits each.
TOP_NODES = 1 << 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Equal rows are dealt into so many lots, so that they need not share a range.
LOTS = 256
#: Rows of an output batch.
BATCH = 256

Step = tuple[str, str]  # hex digits of the siblings to the left, and to the right


def node_hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """A value as it enters a leaf: - for null, else its UTF-8 bytes' count, a colon and itself."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def height(n: int) -> int:
    """Levels above n nodes."""
    out = 0
    while n > 1:
        n, out = -(-n // FANOUT), out + 1
    return out


def reduce_levels(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes, and each of so many levels above them."""
    out = [nodes]
    for _ in range(levels):
        out.append([node_hash("".join(out[-1][k : k + FANOUT])) for k in range(0, len(out[-1]), FANOUT)])
    return out


def level_steps(level: list[str]) -> list[Step]:
    """Each node's siblings in its run."""
    out = []
    for k in range(0, len(level), FANOUT):
        run = level[k : k + FANOUT]
        out += [("".join(run[:i]), "".join(run[i + 1 :])) for i in range(len(run))]
    return out


def fold(leaf: str, steps: list[Step]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in steps:
        leaf = node_hash(left + leaf + right)
    return leaf


class Top:
    """The upper trees: each source's levels above its blocks, and the levels above the sources' roots."""

    def __init__(self, nodes: list[tuple[int, int, str]], of_sources: bool):
        """nodes: (tree, place, digest). of_sources: whether trees are sources, whose roots make one more tree."""
        self.trees: dict[int, list[list[str]]] = {}
        for tree, group in groupby(sorted(nodes), key=lambda x: x[0]):
            level = [digest for _, _, digest in group]
            self.trees[tree] = reduce_levels(level, height(len(level)))
        self.ranks = {tree: k for k, tree in enumerate(self.trees)}
        roots = [levels[-1][0] for levels in self.trees.values()]
        self.above = reduce_levels(roots, height(len(roots)) if of_sources else 0)

    @staticmethod
    def _way(levels: list[list[str]], place: int) -> list[Step]:
        out = []
        for level in levels[:-1]:
            first = place - place % FANOUT
            run = level[first : first + FANOUT]
            out.append(("".join(run[: place - first]), "".join(run[place - first + 1 :])))
            place //= FANOUT
        return out

    def way(self, tree: int, place: int) -> tuple[list[Step], str, str]:
        """(siblings from a node to the root, root of its tree, root of all)."""
        levels, above = self.trees[tree], self.above
        root = above[-1][0] if len(above[-1]) == 1 else levels[-1][0]
        return self._way(levels, place) + self._way(above, self.ranks[tree]), levels[-1][0], root


# ---------------------------------------------------------------- kernels over rows sorted by tree, block and place


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Runs of rows of one block: at most as many as a block has, and a row for the block above."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["tree"], row["block"]) != (held[0]["tree"], held[0]["block"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _root_kernel(levels: int):
    def run(batches):
        out: list[tuple] = []
        for rows in _blocks(batches):
            n = rows[0]["n"]
            own = min(levels, height(n))
            top = reduce_levels([r["digest"].hex() for r in rows], own)[-1][0]
            out.append((rows[0]["tree"], rows[0]["block"], -(-n // FANOUT**own), bytes.fromhex(top)))
            if len(out) >= 4096:
                yield _nodes(out)
                out = []
        if out:
            yield _nodes(out)

    return run


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    tree, place, n, digest = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(tree, pa.int64()), pa.array(place, pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.binary())], ["tree", "place", "n", "digest"])


def _strings(rows: list[list[str]]) -> pa.Array:
    offsets = [0]
    for r in rows:
        offsets.append(offsets[-1] + len(r))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([x for r in rows for x in r], pa.string()))


def _proof_kernel(levels: int, top):
    """Finishes proofs: own levels from the block's rows, the rest from the broadcast top tree or from the row of the block above."""

    def run(batches):
        for rows in _blocks(batches):
            if top is None:
                head, rows = rows[0], rows[1:]
                rest, subroot, root = list(zip(head["lefts"], head["rights"])), head["subroot"], head["root"]
            else:
                rest, subroot, root = top.value.way(rows[0]["tree"], rows[0]["block"])
            own = min(levels, height(rows[0]["n"]))
            leaves = [r["digest"].hex() for r in rows]
            steps = [level_steps(level) for level in reduce_levels(leaves, own)[:-1]]
            for a in range(0, len(rows), BATCH):
                part = rows[a : a + BATCH]
                ways = [[steps[k][i // FANOUT**k] for k in range(own)] + rest for i in range(a, a + len(part))]
                folded = [fold((r["claim"] or r["digest"]).hex(), way) for r, way in zip(part, ways)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["tree"] for r in part], pa.int64()), pa.array([r["place"] for r in part], pa.int64()), pa.array([r["key"] for r in part], pa.int64()), pa.array(leaves[a : a + len(part)]), pa.array([subroot] * len(part)), pa.array([root] * len(part)),
                     _strings([[left for left, _ in w] for w in ways]), _strings([[right for _, right in w] for w in ways]), pa.array(folded)],
                    ["tree", "place", "key", "leaf", "subroot", "root", "lefts", "rights", "folded_root"],
                )

    return run


PROOFS = "tree long, place long, key long, leaf string, subroot string, root string, lefts array<string>, rights array<string>, folded_root string"
UPPER = ("lefts array<string>", "rights array<string>", "subroot string", "root string")


def _dealt(nodes: DataFrame, levels: int) -> DataFrame:
    rows = nodes.withColumn("block", F.expr(f"case when place < 0 then block else place div {FANOUT**levels} end") if "block" in nodes.columns else F.expr(f"place div {FANOUT**levels}"))
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")


def _finish(nodes: DataFrame, up: Top | DataFrame, levels: int) -> DataFrame:
    """Proofs of nodes, given the ways of their blocks."""
    if isinstance(up, Top):
        return arrow_map(_dealt(nodes, levels), _proof_kernel(levels, nodes.sparkSession.sparkContext.broadcast(up)), PROOFS)
    heads = up.select("tree", F.lit(-1).cast("long").alias("place"), F.col("place").alias("block"), "lefts", "rights", "subroot", "root")
    return arrow_map(_dealt(nodes.unionByName(heads, allowMissingColumns=True), levels), _proof_kernel(levels, None), PROOFS)


def _climb(nodes: DataFrame, levels: int, most: int, of_sources: bool) -> Top | DataFrame:
    """The ways from nodes (tree, place, n, digest; one row a node, written) to the root: the top tree, where the driver may hold it,
    or a row per node."""
    count = nodes.count()
    if count <= most:
        return Top([(r.tree, r.place, r.digest.hex()) for r in nodes.collect()], of_sources)
    if of_sources and nodes.agg(F.max("n")).first()[0] == 1:
        # every source is down to its root: these are the leaves of the tree of sources
        roots = nodes.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(count).cast("long").alias("n"), "digest")
        ways = _climb(roots, levels, most, False)
        return ways.select(F.col("place").alias("tree"), F.lit(0).cast("long").alias("place"), "lefts", "rights", F.col("leaf").alias("subroot"), "root")
    bare = nodes.withColumns({"key": F.lit(None).cast("long"), "claim": F.lit(None).cast("binary")})
    above = materialise(arrow_map(_dealt(bare, levels), _root_kernel(levels), "tree long, place long, n long, digest binary"), "merkle-nodes")
    return _finish(bare, _climb(above, levels, most, of_sources), levels)


# ---------------------------------------------------------------- leaves


def place_leaves(rows: DataFrame) -> DataFrame:
    """Numbers rows (source, key, digest, ..., lot) within their source, by key (null first) and digest, and sources in bytewise
    order (null first): adds tree (number of the source), place and n (rows of the source). The rows are range-sorted once and
    written; beyond that only a row per source and range is handled."""
    # null is before every string
    order = ["source_key", "no_key", "key", "digest", "lot"]
    rows = rows.withColumns({"source_key": F.coalesce(F.concat(F.lit("v"), "source"), F.lit("")), "no_key": F.col("key").isNotNull()}).drop("source")
    ranged = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("lot", "no_key").withColumn("at", F.monotonically_increasing_id()), "merkle-leaves")
    ranged = ranged.withColumn("range", F.shiftright("at", 33))
    spans = ranged.groupBy("source_key", "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    of_source = Window.partitionBy("source_key")
    before = of_source.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    spans = materialise(
        spans.select("*", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"), F.sum("rows").over(of_source).alias("n"), (F.col("range") == F.min("range").over(of_source)).alias("head")), "merkle-spans"
    )
    heads = spans.where("head")
    up = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = heads.groupBy("range").agg(F.count(F.lit(1)).alias("n_heads")).select("range", F.coalesce(F.sum("n_heads").over(up), F.lit(0)).alias("start"))
    numbers = heads.join(starts, "range").select(F.col("source_key"), (F.col("start") + F.row_number().over(Window.partitionBy("range").orderBy("first")) - 1).alias("tree"))
    spans = spans.drop("rows", "head").join(numbers, "source_key")
    if spans.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        spans = F.broadcast(spans)
    placed = ranged.join(spans, ["source_key", "range"])
    return placed.withColumn("place", F.col("base") + F.col("at") - F.col("first")).drop("at", "range", "first", "base")


def manifest(docs: DataFrame, claim: Column | None = None, levels: int = BLOCK_LEVELS, most: int = TOP_NODES) -> DataFrame:
    """Merkle proofs of all rows of docs (doc_id, source, lang, n_chars, text), and what a copy with other texts folds to.

    claim is the text that the copy to be verified holds in place of each row's text; without it the copy is docs itself.
    Columns: doc_id, source_no (number of the source in bytewise order, null first), place (of the leaf in its source), leaf, subroot,
    root, lefts and rights (siblings from leaf to root, hex digits on either side, one entry a level), folded_root (of the
    claimed leaf with the proof), verified.

    A null in any column is a value of its own in the leaf. Rows without a source make a tree of their own, which stands first; rows
    without a doc_id stand first in their source; rows of one doc_id go by leaf, and equal rows have a leaf each, whichever of
    them takes which. Empty texts are texts of no bytes; very long ones are hashed whole where they are read, and never shuffled.
    A table without rows gives none. Columns other than the five are not read.
    """
    values = {c: docs[c].cast("long" if c in ("doc_id", "n_chars") else "string") for c in FIELDS}
    leaf = leaf_hash([values[c] for c in FIELDS])
    other = None if claim is None else F.unhex(leaf_hash([claim if c == "text" else values[c] for c in FIELDS]))
    # written, for the range sort samples it; a lot is where a row was read
    rows = docs.select(values["source"].alias("source"), values["doc_id"].alias("key"), F.unhex(leaf).alias("digest"), (F.lit(None).cast("binary") if other is None else other).alias("claim"))
    rows = materialise(rows.withColumn("lot", F.pmod(F.monotonically_increasing_id(), F.lit(LOTS)).cast("int")), "merkle-rows")
    leaves = place_leaves(rows).drop("source_key")
    bare = leaves.withColumns({"key": F.lit(None).cast("long"), "claim": F.lit(None).cast("binary")})
    blocks = materialise(arrow_map(_dealt(bare, levels), _root_kernel(levels), "tree long, place long, n long, digest binary"), "merkle-nodes")
    proofs = _finish(leaves, _climb(blocks, levels, most, True), levels)
    return proofs.withColumnsRenamed({"tree": "source_no", "key": "doc_id"}).withColumn("verified", F.col("folded_root") == F.col("root"))


def lowered(docs: DataFrame) -> Column:
    """The texts of a copy in which those whose doc_id has a crc32 divisible by 5 are lower-cased."""
    text = docs["text"].cast("string")
    return F.when(F.crc32(docs["doc_id"].cast("long").cast("string")) % 5 == 0, lower_ascii(text)).otherwise(text)


def digest(proofs: DataFrame) -> DataFrame:
    siblings = F.array_join(F.flatten(F.transform(F.arrays_zip("lefts", "rights"), lambda s: F.array(s["lefts"], s["rights"]))), "")
    return proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", "verified")


def crc32_sql(text: str) -> str:
    """DuckDB: unsigned crc32 of a string of ASCII characters."""
    step = "CASE WHEN (s & 1) = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END"
    char = f"list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda s, k: {step})"
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {char}), 4294967295)"


def oracle() -> str:
    part = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(part(text if c == "text" else c) for c in FIELDS) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('v' || source, '') AS src, {leaf("text")} AS leaf,
    {leaf(f"CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 5 = 0 THEN {lower} ELSE text END")} AS claim
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
tree(lvl, src, place, digest, n) AS (
  SELECT 0, src, place, leaf, count(*) OVER (PARTITION BY src) FROM placed
  UNION ALL
  SELECT lvl + 1, src, place // {FANOUT}, sha256(string_agg(digest, '' ORDER BY place)), (max(n) + {FANOUT - 1}) // {FANOUT} FROM tree WHERE n > 1 GROUP BY lvl, src, place // {FANOUT}),
subroots AS (SELECT src, lvl AS top, digest FROM tree WHERE n = 1),
crown(lvl, place, digest, n) AS (
  SELECT 0, row_number() OVER (ORDER BY src) - 1, digest, count(*) OVER () FROM subroots
  UNION ALL
  SELECT lvl + 1, place // {FANOUT}, sha256(string_agg(digest, '' ORDER BY place)), (max(n) + {FANOUT - 1}) // {FANOUT} FROM crown WHERE n > 1 GROUP BY lvl, place // {FANOUT}),
low AS (
  SELECT lvl, src, place, digest, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM tree WHERE n > 1 WINDOW w AS (PARTITION BY lvl, src, place // {FANOUT} ORDER BY place)),
high AS (
  SELECT lvl, place, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM crown WHERE n > 1 WINDOW w AS (PARTITION BY lvl, place // {FANOUT} ORDER BY place)),
ranked AS (SELECT src, top, digest AS subroot, row_number() OVER (ORDER BY src) - 1 AS rank FROM subroots),
steps AS (
  SELECT p.src, p.place, t.lvl AS pos, t.l, t.r FROM placed p JOIN low t ON t.src = p.src AND t.place = p.place // ({FANOUT} ** t.lvl)::BIGINT
  UNION ALL
  SELECT p.src, p.place, k.top + h.lvl, h.l, h.r FROM placed p JOIN ranked k ON k.src = p.src JOIN high h ON h.place = k.rank // ({FANOUT} ** h.lvl)::BIGINT),
ways AS (SELECT src, place, list({{'l': l, 'r': r}} ORDER BY pos) AS way FROM steps GROUP BY src, place),
folded AS (
  SELECT p.doc_id, p.leaf, k.subroot, (SELECT digest FROM crown WHERE n = 1) AS root, coalesce(w.way, []) AS way,
    list_reduce(list_prepend({{'l': p.claim, 'r': ''}}, coalesce(w.way, [])), lambda a, b: {{'l': sha256(b.l || a.l || b.r), 'r': ''}}).l AS folded_root
  FROM placed p JOIN ranked k ON k.src = p.src LEFT JOIN ways w ON w.src = p.src AND w.place = p.place)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(way, lambda s: s.l || s.r), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM folded"""
