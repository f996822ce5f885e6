"""Prefix trie of conversations, and totals of its subtrees by peeling leaves.

A node is a distinct sequence of first turns. Every node is owned by the member whose id hashes highest, so the nodes that one
conversation owns are consecutive turns of it: a chain, which hangs on a node of another chain. Chains hold a counter of those that
hang on them and are still at work; a chain whose counter is 0 sends its totals to its parent, until only the root's is left. For
nested sets of members the highest hash changes a logarithmic number of times, so the rounds grow with the logarithm of the
conversations, whatever the depth of the trie.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import ordered_rank, running_sums
from ..session import arrow_map
from .common import discard, hex_int, materialise

#: Conversations by number share their first turns in groups of so many; a conversation takes fewer than HEADS of them.
FAMILY, HEADS = 5, 9
#: Ids that are written out in one row on their way to a digest.
CHUNK = 128
KEY = ["depth", "pa", "pb"]


def own_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (0-based, by turn, null first, then by hash), a and b (120 bits of the turn's SHA-256), bytes of its text."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    sha = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.select(conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"), sha.alias("sha"), F.octet_length(text).cast("long").alias("bytes"))
    rows = rows.where("conv_id is not null").select("conv_id", "turn", hex_int(F.substring("sha", 1, 15)).alias("a"), hex_int(F.substring("sha", 16, 15)).alias("b"), "bytes")
    # written, for the range sort samples it and texts are hashed once
    return ordered_rank(materialise(rows, "turns"), ["conv_id"], ["turn", "a", "b"], "place")


def taken(conv_id: Column) -> Column:
    """Turns that a conversation takes from the first of its family."""
    return F.crc32(conv_id.cast("string")) % HEADS


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv_id, length; their turns: conv_id, depth from 1, a, b, bytes, length) after each has taken its first
    turns from the first of its family."""
    turns = materialise(own_turns(conversations).drop("turn"), "placed-turns")
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = sizes.select("conv_id", "n", taken(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    head = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = convs.join(base, "base", "left").select("conv_id", "h", head.alias("m"), (head + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    convs = materialise(convs, "convs")
    rest = turns.join(convs, "conv_id").where("place >= h").withColumn("depth", F.col("m") + F.col("place") - F.col("h") + 1)
    # the conversations c of a family's first b: c - c % FAMILY = b
    first = F.col("conv_id")
    low = F.when(first > 0, first).otherwise(first - (FAMILY - 1))
    high = F.when(first < 0, first).otherwise(first + (FAMILY - 1))
    members = F.filter(F.sequence(low, high), lambda c: c - c % FAMILY == first)
    heads = turns.where((F.col("place") < HEADS - 1) & (first % FAMILY == 0)).withColumn("c", F.explode(members)).where(F.col("place") < taken(F.col("c")))
    heads = heads.drop("conv_id").withColumnRenamed("c", "conv_id").join(convs, "conv_id").withColumn("depth", F.col("place") + 1)
    columns = ["conv_id", "depth", "a", "b", "bytes", "length"]
    return convs.select("conv_id", "length"), rest.select(*columns).unionByName(heads.select(*columns))


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes of the trie of conversations (conv_id, length) and their turns (conv_id, depth, a, b, bytes, length).

    Prefixes are told apart by 128 bits of hashes of their turns, combined by exclusive or, and turns by 120 bits: among 10**12 of
    either two would fall together with odds under 1 in 10**12.
    """
    values = turns.withColumns({"va": F.xxhash64("depth", "a", "b"), "vb": F.xxhash64("b", "a", F.lit(1), "depth")}).drop("a", "b")
    paths = running_sums(values, ["conv_id"], [F.col("depth")], {"va": "pa", "vb": "pb"}, xor=True)
    paths = paths.select("conv_id", "depth", "pa", "pb", F.col("pa").bitwiseXOR(F.col("va")).alias("qa"), F.col("pb").bitwiseXOR(F.col("vb")).alias("qb"), "bytes", "length")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = convs.select("conv_id", zero.alias("depth"), zero.alias("pa"), zero.alias("pb"), none.alias("qa"), none.alias("qb"), zero.alias("bytes"), "length")
    paths = materialise(paths.unionByName(roots), "paths")
    # xxhash64 is a bijection of longs, so an owner is as good as a conversation's id
    nodes = paths.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max(F.xxhash64("conv_id")).alias("owner"), F.min("bytes").alias("bytes"), F.min("qa").alias("qa"), F.min("qb").alias("qb"))
    nodes = materialise(nodes, "nodes")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("pa").alias("qa"), F.col("pb").alias("qb"), F.col("owner").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    linked = nodes.join(parents, ["depth", "qa", "qb"], "left").drop("qa", "qb")
    linked = materialise(linked, "linked-nodes")
    kids = linked.where("depth > 0").groupBy(F.col("parent").alias("owner"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    leaf = F.col("n_children").isNull().cast("long")
    linked = linked.join(kids, ["owner", "depth"], "left").select("*", leaf.alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    linked = materialise(linked.fillna(0, ["n_children"]), "counted-nodes")
    sent, _ = peel(linked)
    attached = sent.where("parent is not null").groupBy(F.col("parent").alias("owner"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    own = linked.join(attached, ["owner", "depth"], "left").withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")})
    summed = running_sums(own, ["owner"], [F.col("depth").desc()], {"leaves": "n_leaves", "saved": "saved_tokens"})
    out = summed.join(ends(paths), KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def peel(nodes: DataFrame) -> tuple[DataFrame, int]:
    """(each chain's message: owner, parent, at (depth of the node that it hangs on), leaves, saved; number of rounds)."""
    foreign = F.col("parent").isNull() | (F.col("parent") != F.col("owner"))
    chains = nodes.groupBy("owner").agg(F.max(F.when(foreign, F.col("parent"))).alias("parent"), (F.min("depth") - 1).alias("at"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    chains = materialise(chains, "chains")
    hanging = chains.where("parent is not null").groupBy(F.col("parent").alias("owner")).agg(F.count(F.lit(1)).alias("open"))
    waiting = materialise(chains.join(hanging, "owner", "left").fillna(0, ["open"]), "waiting")
    discard(chains)
    rounds, sent = 0, []
    while not waiting.isEmpty():
        ready = waiting.where("open = 0").drop("open")
        sent.append(ready)
        messages = ready.where("parent is not null").groupBy(F.col("parent").alias("owner")).agg(F.count(F.lit(1)).alias("n"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        more = {c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")}
        rest = waiting.where("open > 0").join(messages, "owner", "left").withColumns(more | {"open": F.col("open") - F.coalesce("n", F.lit(0))})
        waiting = materialise(rest.select("owner", "parent", "at", "leaves", "saved", "open"), "waiting")
        rounds += 1
    sent.append(waiting.drop("open"))
    return reduce(DataFrame.unionByName, sent), rounds


# ---------------------------------------------------------------- digests of the conversations that end at a node


def _chunk_kernel(batches):
    """Rows sorted by node and id to rows of ids joined by commas, a few at a time."""
    key, ids = None, []

    def row():
        return (*key, ids[0], ",".join(map(str, ids)))

    out = []
    for batch in batches:
        for *k, conv in zip(*(batch.column(c).to_pylist() for c in range(4))):
            if key is not None and (k != key or len(ids) == CHUNK):
                out.append(row())
                ids = []
            key = k
            ids.append(conv)
        if len(out) >= 1024:
            yield _rows(out)
            out = []
    if ids:
        out.append(row())
    if out:
        yield _rows(out)


def _rows(rows):
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*rows))[:4]), pa.array([r[4] for r in rows], pa.string())], [*KEY, "first", "ids"])


def _digest_kernel(batches):
    """Rows of ids in order to a digest a node; what is held is the state of one hash."""
    key, state, out = None, None, []
    for batch in batches:
        for *k, _, ids in zip(*(batch.column(c).to_pylist() for c in range(5))):
            if k == key:
                state.update(b"," + ids.encode())
            else:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
        if len(out) >= 4096:
            yield _digests(out)
            out = []
    if key is not None:
        out.append((*key, state.hexdigest()))
    if out:
        yield _digests(out)


def _digests(rows):
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*rows))[:3]), pa.array([r[3] for r in rows], pa.string())], [*KEY, "ends_sha256"])


def ends(paths: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each node. Ids are written out range by range, so what meets in the one task that a digest
    needs is a row per CHUNK ids."""
    rows = paths.where("depth = length").select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    chunks = arrow_map(rows, _chunk_kernel, "depth long, pa long, pb long, first long, ids string")
    dealt = chunks.repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return arrow_map(dealt, _digest_kernel, "depth long, pa long, pb long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all conversations, rebuilt by families: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, one row per node.

    Null roles and texts are empty. Turns of one number go by the SHA-256 of role and text, and repeated rows are turns of their own.
    Rows without a conv_id belong to no conversation and are not read. Very long texts are hashed where they are read and never
    shuffled; a conversation of very many turns is cut into ranges. A table without conversations has no nodes, not even a root.
    Columns other than conv_id, turn, role and text are not read.
    """
    return trie(*rebuild(conversations))


def oracle() -> str:
    from .merkle import crc32_sql

    return f"""
WITH turns AS (
  SELECT conv_id AS c, strlen(coalesce(text, '')) AS bytes, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS sha,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % {FAMILY} AS base, {crc32_sql("c::VARCHAR")} % {HEADS} AS h, count(*) AS n FROM turns GROUP BY c),
sized AS (SELECT a.*, least(a.h, coalesce(b.n, 0)) AS m FROM convs a LEFT JOIN convs b ON b.c = a.base),
rebuilt AS (
  SELECT s.c, t.place + 1 AS d, t.sha, t.bytes FROM sized s JOIN turns t ON t.c = s.base AND t.place < s.h
  UNION ALL
  SELECT s.c, s.m + t.place - s.h + 1, t.sha, t.bytes FROM sized s JOIN turns t ON t.c = s.c AND t.place >= s.h),
paths AS (
  SELECT c, d, bytes, list(sha) OVER (PARTITION BY c ORDER BY d) AS path, count(*) OVER (PARTITION BY c) AS length FROM rebuilt
  UNION ALL
  SELECT c, 0, 0, []::VARCHAR[], (SELECT count(*) FROM rebuilt r WHERE r.c = s.c) FROM sized s),
nodes AS (
  SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = length), '')) AS ends_sha256
  FROM paths GROUP BY path, d),
kids AS (SELECT path[1:d - 1] AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
counted AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (path)),
above AS (SELECT path[1:k] AS path, sum((n_children = 0)::BIGINT) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM counted) GROUP BY 1)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, a.n_leaves::BIGINT AS n_leaves, a.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM counted n JOIN above a USING (path) LEFT JOIN nodes p ON n.d > 0 AND p.path = n.path[1:n.d - 1]"""
