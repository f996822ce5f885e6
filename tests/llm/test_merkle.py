"""Merkle manifests against a plain version, with the bounds of every tier lowered."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from sondera.llm import merkle

from .conftest import FOLD, same


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """(root, siblings of each node level by level as (left, right))."""
    ways, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for way, k in zip(ways, at):
            run = k - k % 16
            way.append(("".join(level[run:k]), "".join(level[k + 1 : run + 16])))
        level, at = [h("".join(level[k : k + 16])) for k in range(0, len(level), 16)], [k // 16 for k in at]
    return level[0], ways


def plain(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    low = {s: tree([x[2] for x in sorted(groups[s])]) for s in order}
    root, high = tree([low[s][0] for s in order])
    out = []
    for s, above in zip(order, high):
        for (_, _, own, r), way in zip(sorted(groups[s]), low[s][1]):
            way = way + above
            text = r[4].translate(FOLD) if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[4]
            folded = leaf((*r[:4], text))
            for left, right in way:
                folded = h(left + folded + right)
            out.append((r[0], own, low[s][0], root, h("".join(a + b for a, b in way)), folded, folded == root))
    return out


@pytest.mark.parametrize("table, levels, most", [("documents", 3, 1 << 16), ("documents", 1, 4), ("documents", 1, 64), ("edge", 3, 1 << 16), ("edge", 1, 2), ("empty", 3, 1 << 16)])
def test_manifest(request, table, levels, most):
    docs = request.getfixturevalue(table)
    got = merkle.digest(merkle.manifest(docs, merkle.lowered(docs), levels, most)).collect()
    rows = [tuple(r) for r in docs.select(*merkle.FIELDS).collect()]
    want = plain(rows) if rows else []
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {r.verified for r in got} <= {True, False}


def test_many_sources_and_equal_rows(spark):
    rows = [(k, f"s{k % 90}", "en", 1, f"Text {k}") for k in range(400)] + [(7, "s0", "en", 1, "Same")] * 600 + [(None, None, None, None, None)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    want = sorted(map(repr, plain(rows)))
    for levels, most in ((3, 1 << 16), (1, 20), (2, 5)):
        got = merkle.digest(merkle.manifest(docs, merkle.lowered(docs), levels, most)).collect()
        assert sorted(map(repr, map(tuple, got))) == want


def test_proofs_fold_to_the_root(documents):
    """Every stored proof folds its leaf to the root, and no other leaf."""
    for r in merkle.manifest(documents).limit(40).collect():
        steps = list(zip(r.lefts, r.rights))
        assert r.verified and merkle.fold(r.leaf, steps) == r.root != merkle.fold(h("other"), steps)


def test_sql(documents, db):
    got = merkle.digest(merkle.manifest(documents, merkle.lowered(documents))).toPandas()
    same(got, db.sql(merkle.oracle()).df())
