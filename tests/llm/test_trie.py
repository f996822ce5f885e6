"""The conversation trie against a plain one."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest

from pyspark.sql import functions as F

from sondera.llm import trie

from .conftest import DATA, same

COLUMNS = "conv_id long, turn long, role string, text string"


def sha(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def plain(rows):
    """Rows of the trie of rebuilt conversations, node by node."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, sha(role or "", text or ""), role or "", text or ""))
    convs = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    paths = {}
    for c, ts in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        paths[c] = tuple(convs.get(base, [])[:h] + ts[h:])
    return nodes_of(paths)


def nodes_of(paths):
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    totals = {}
    for path in sorted(members, key=len, reverse=True):
        own = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        below = [totals[k] for k in kids[path]]
        totals[path] = (sum(b[0] for b in below) or 1, own + sum(b[1] for b in below))
    out = []
    for path, ms in members.items():
        ends = ",".join(str(c) for c in sorted(ms) if len(paths[c]) == len(path))
        out.append((min(ms), len(path), min(members[path[:-1]]) if path else None, len(ms), len(kids[path]), *totals[path], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=repr)


EDGE = [
    (0, 1, "user", "Hello"), (0, 2, "assistant", "Hi"), (0, None, None, None), (0, 2, "assistant", "Hi"), (1, 5, "user", ""), (1, 3, "user", "x" * 200_000), (3, 0, None, "é"), (4, 1, "user", "Hello"),
    (-1, 0, "user", "a"), (-2, 0, "user", "a"), (-5, 0, "user", "b"), (-5, 1, "user", "c"), (-7, 0, "user", "b"), (7, 1, "user", "only own"), (12, 1, "a", "1"), (None, 1, "user", "no id"), (None, None, None, None), (2**60, 1, "user", "far"),
]


@pytest.mark.parametrize("case", ["edge", "empty", "data"])
def test_trie(spark, case):
    if case == "data":
        df = spark.read.parquet(f"{DATA}/conversations.parquet")
    else:
        df = spark.createDataFrame([(*r, 1, "x") for r in (EDGE if case == "edge" else [])], COLUMNS + ", depth long, owner string")
    got = [tuple(r) for r in trie.prefix_trie(df).collect()]
    assert order(got) == order(plain([tuple(r)[:4] for r in df.select("conv_id", "turn", "role", "text").collect()]))


def given(spark, paths):
    """Conversations as they are, not rebuilt."""
    rows = [(c, d + 1, *turn, len(path)) for c, path in paths.items() for d, turn in enumerate(path)]
    turns = spark.createDataFrame(rows, "conv_id long, depth long, role string, text string, length long")
    digest = F.sha2(F.concat_ws(":", "role", "text"), 256)
    turns = turns.select("conv_id", "depth", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("a"), F.conv(F.substring(digest, 16, 15), 16, 10).cast("long").alias("b"), F.octet_length("text").cast("long").alias("bytes"), "length")
    return spark.createDataFrame([(c, len(p)) for c, p in paths.items()], "conv_id long, length long"), turns


def test_nested_logs_and_copies(spark):
    """A log of growing prefixes, copies of one conversation, and one long conversation: deep, but few rounds."""
    logs = {k: tuple(("user", f"t{i}") for i in range(k)) for k in range(120)}
    copies = {1000 + k: tuple(("user", f"t{i}") for i in range(5)) + (("bot", "bye"),) for k in range(300)}
    long = {5000: tuple(("bot", f"u{i}") for i in range(700))}
    paths = logs | copies | long
    assert order(tuple(r) for r in trie.trie(*given(spark, paths)).collect()) == order(nodes_of(paths))


def test_rounds_do_not_follow_depth(spark):
    owners = spark.createDataFrame([(c, d) for c in range(150) for d in range(c + 1)], "c long, depth long").groupBy("depth").agg(F.max(F.xxhash64("c")).alias("owner"))
    above = owners.select((F.col("depth") + 1).alias("depth"), F.col("owner").alias("parent"))
    chains = owners.join(above, "depth", "left").withColumns({"leaves": (F.col("depth") == 149).cast("long"), "saved": F.lit(1).cast("long")})
    sent, rounds = trie.peel(chains)
    assert rounds <= 16
    root = sent.where("parent is null").first()
    assert (root.leaves, root.saved) == (1, 150)


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    got = trie.prefix_trie(spark.read.parquet(f"{DATA}/conversations.parquet")).toPandas()
    same(got, con.sql(trie.oracle()).df(), keys=("depth", "conv_id"))
