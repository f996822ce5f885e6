import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sondera.functions import vectors
from sondera.operators import scoring, search

BANK = [(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0])]
QUERIES = [(10, [0.9, 0.1, 0.0]), (11, [0.0, 0.2, 0.8])]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, embedding array<double>")


def brute(queries, bank, k):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    out = {}
    for q, v in queries:
        ranked = sorted(((-float(unit(v) @ unit(w)), b) for b, w in bank))
        out[q] = [(b, -s) for s, b in ranked[:k]]
    return out


@pytest.mark.parametrize("limit", [1 << 20, 0])
@pytest.mark.parametrize("k", [1, 3])
def test_nearest_is_brute_force_either_way(spark, limit, k):
    got = {}
    for r in search.nearest(frame(spark, QUERIES), frame(spark, BANK), k, limit).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.bank_id, r.similarity))
    want = brute(QUERIES, BANK, k)
    assert got.keys() == want.keys()
    for q in want:
        assert [b for b, _ in got[q]] == [b for b, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-9)


def test_blocks_agree_with_broadcast_on_random_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    bank = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 8)))]
    queries = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(90, 8)))]
    monkeypatch.setattr(search, "BANK_BLOCK", 64)
    monkeypatch.setattr(search, "QUERY_BLOCK", 32)
    a = search.nearest(frame(spark, queries), frame(spark, bank), 5, 0).orderBy("query_id", "rank").collect()
    want = brute(queries, bank, 5)
    assert len(a) == 450
    assert all(want[r.query_id][r["rank"] - 1][0] == r.bank_id for r in a)


def test_ties_go_to_the_smaller_id(spark):
    bank = [(5, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 1.0])]
    r = search.nearest(frame(spark, [(1, [1.0, 0.0])]), frame(spark, bank), 2).orderBy("rank").collect()
    assert [x.bank_id for x in r] == [3, 5]


def test_zero_norm_and_small_banks_are_errors(spark):
    with pytest.raises(ValueError):
        search.nearest(frame(spark, QUERIES), frame(spark, BANK), 5)
    with pytest.raises(Exception, match="zero-norm"):
        search.nearest(frame(spark, QUERIES), frame(spark, [(0, [0.0, 0.0, 0.0])]), 1).collect()


def test_one_neighbour_reconstruction_is_the_nearest_distance(spark):
    found = search.nearest(frame(spark, QUERIES), frame(spark, BANK), 1)
    dist = scoring.reconstruction_distance(scoring.softmax_weights(found), frame(spark, BANK), frame(spark, QUERIES))
    near = found.select("query_id", vectors.distance(F.col("similarity")).alias("d"))
    for r in dist.join(near, "query_id").collect():
        assert abs(r.topk_distance - r.d) < 1e-9


def test_cap_at_k_keeps_all_and_does_not_refill(spark):
    rows = spark.createDataFrame([(1, k, k, 0.9 - k / 10, "a" if k < 4 else "b") for k in range(1, 6)], "query_id long, rank int, bank_id long, similarity double, family string")
    assert scoring.family_cap(rows, 5).where("NOT keep").count() == 0
    kept = [r["rank"] for r in scoring.family_cap(rows, 2).where("keep").orderBy("rank").collect()]
    assert kept == [1, 2, 4, 5]
    w = scoring.softmax_weights(scoring.family_cap(rows, 2), keep=F.col("keep")).agg(F.sum("weight")).first()[0]
    assert abs(w - 1) < 1e-12


def test_boundary_on_a_grid(spark):
    cells = [(0, r, c) for r in range(3) for c in range(3)] + [(1, 5, 5)]
    got = {(x.image, x.row, x.col): x.interior for x in scoring.boundary(spark.createDataFrame(cells, "image int, row int, col int"), "image", "row", "col").collect()}
    assert [k for k, v in got.items() if v] == [(0, 1, 1)]


def test_memory_decides_the_way():
    need = search.Need(1000, 64).bytes()
    assert need == 1000 * 64 * 8 + 1024 * 1000 * 8 + 1000 * 64 * 12 + (512 << 20)
    assert search.way(1000, 64).broadcast and not search.way(1000, 64, memory=need - 1).broadcast
    assert not search.way(1000, 64, broadcast_bytes=1000 * 64 * 8 - 1).broadcast
    small = search.way(10**7, 768, memory=(512 << 20) + (64 << 20))
    assert not small.broadcast and small.bank_block < search.BANK_BLOCK
    assert search.Need(small.bank_block, 768, query_block=small.query_block, bank_block=small.bank_block).bytes() <= (512 << 20) + (64 << 20)
    with pytest.raises(MemoryError):
        search.way(10**7, 768, memory=512 << 20)


def test_a_memory_that_fits_nothing_fails_before_the_search(spark):
    with pytest.raises(MemoryError):
        search.nearest(frame(spark, QUERIES), frame(spark, BANK), 1, 0, 100)


def clustered(rng, n, dim=16, centres=20):
    c = rng.normal(size=(centres, dim)) * 4
    return c[rng.integers(centres, size=n)] + rng.normal(size=(n, dim)) * 0.2


@pytest.mark.parametrize("k", [1, 7])
def test_pruned_search_is_exact_and_skips_blocks(spark, k):
    rng = np.random.default_rng(11)
    both = clustered(rng, 1400)
    bank = [(i, v.tolist()) for i, v in enumerate(both[:1200])] + [(5000 + i, v.tolist()) for i, v in enumerate(both[:40])]  # and some twice
    queries = [(i, v.tolist()) for i, v in enumerate(both[1200:])] + [(900 + i, v.tolist()) for i, v in enumerate(both[:10])]
    found, visits = search.pruned(frame(spark, queries), frame(spark, bank), k, len(bank), query_block=32, bank_block=24, cell_rows=30)
    want = brute(queries, bank, k)
    got = found.collect()
    assert len(got) == k * len(queries)
    by_query = {}
    for r in got:
        by_query.setdefault(r.query_id, []).append((r["rank"], r.bank_id, r.similarity))
    for q, rows in by_query.items():
        assert np.allclose([s for *_, s in sorted(rows)], [s for _, s in want[q]], atol=1e-12)
        assert len({b for _, b, _ in rows}) == k
    seen = visits.collect()
    assert len(seen) == len(queries) and seen[0].blocks >= 40
    assert sum(v.visited for v in seen) < 0.3 * sum(v.blocks for v in seen)


def test_pruned_search_of_noise_and_of_equal_vectors(spark):
    rng = np.random.default_rng(12)
    bank = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 4)))]
    queries = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(50, 4)))]
    found, _ = search.pruned(frame(spark, queries), frame(spark, bank), 3, len(bank), bank_block=16, cell_rows=10)
    want = brute(queries, bank, 3)
    assert all(want[r.query_id][r["rank"] - 1][0] == r.bank_id for r in found.collect())
    same = [(i, [1.0, 2.0]) for i in range(100)]
    found, _ = search.pruned(frame(spark, [(1, [2.0, 4.0])]), frame(spark, same), 4, 100, bank_block=8, cell_rows=9)
    assert sorted(r.bank_id for r in found.collect()) == [0, 1, 2, 3]


def test_a_query_goes_once_to_a_pack_whatever_its_blocks(spark, monkeypatch):
    """Small blocks of one pack are bits of one row: queries do not move once for each block. Counts and neighbours stay those of blocks."""
    rng = np.random.default_rng(13)
    both = clustered(rng, 700)
    bank, queries = ([(i, v.tolist()) for i, v in enumerate(x)] for x in (both[:600], both[600:]))
    moved, meet = [], search._visited
    monkeypatch.setattr(search, "_visited", lambda visits, *a: moved.append(visits.groupBy("id").count().agg({"count": "max"}).first()[0] or 0) or meet(visits, *a))
    found, visits = search.pruned(frame(spark, queries), frame(spark, bank), 5, len(bank), bank_block=200, cell_rows=4)
    want = brute(queries, bank, 5)
    for r in found.collect():
        assert want[r.query_id][r["rank"] - 1][0] == r.bank_id
    seen = visits.collect()
    assert max(v.visited for v in seen) > 8 and max(moved) <= 3


def test_similarities_are_worked_out_in_bounded_blocks(spark, monkeypatch):
    """However large a bank and a batch of queries are, a worker holds so many similarities and bounds at a time."""
    rng = np.random.default_rng(14)
    bank, queries = rng.normal(size=(700, 6)), rng.normal(size=(300, 6))
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    monkeypatch.setattr(search, "STEP", 128)
    monkeypatch.setattr(search, "BOUNDS_AT_A_TIME", 2048)
    sizes, top = [], search._top
    monkeypatch.setattr(search, "_top", lambda sim, *a: sizes.append(sim.size) or top(sim, *a))

    class Shared:
        value = (np.arange(700), unit(bank))

    batch = pa.record_batch([pa.array(range(300)), pa.array(queries.tolist())], ["id", "embedding"])
    got = pa.Table.from_batches(list(search._broadcast_map(Shared, 3, search.Way(True, search.QUERY_BLOCK, search.BANK_BLOCK))([batch])))
    order = np.argsort(-(unit(queries) @ unit(bank).T), axis=1)[:, :3]
    assert got.column("bank_id").to_pylist() == order.ravel().tolist() and max(sizes) <= 2048


def test_a_bank_passes_by_in_batches(spark, monkeypatch):
    """Beyond a few rows no worker holds the bank, of which only a step meets queries at a time; equal vectors rank by id."""
    rng = np.random.default_rng(16)
    bank = [(i, v.tolist()) for i, v in enumerate(rng.integers(-1, 2, size=(500, 4)) + np.array([0, 0, 0, 3.0]))]
    queries = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 4)))] + [(900, bank[0][1])]
    monkeypatch.setattr(search, "HELD_BYTES", 0)
    monkeypatch.setattr(search, "_broadcast_map", None)
    got = {}
    for r in search.nearest(frame(spark, queries), frame(spark, bank), 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.bank_id, r.similarity))
    want = brute(queries, bank, 20)
    assert got.keys() == want.keys()
    for q in want:
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12)
    first = [b for b, s in got[900] if s > 1 - 1e-12]
    assert len(first) > 2 and first == sorted(first)

    monkeypatch.setattr(search, "STEP", 32)
    monkeypatch.setattr(search, "BOUNDS_AT_A_TIME", 512)
    sizes, better = [], search._Lot._better
    monkeypatch.setattr(search._Lot, "_better", lambda lot, s, ids, sim: sizes.append(sim.size) or better(lot, s, ids, sim))
    rows = [{"pack": p, "lot": 0, "side": side, "id": i, "embedding": v, "least": -2.0, "blocks": None, "block": 0} for p in range(2) for side, x in enumerate((queries, bank)) for i, v in x]
    schema = pa.schema([("pack", pa.int64()), ("lot", pa.int64()), ("side", pa.int32()), ("id", pa.int64()), ("embedding", pa.list_(pa.float64())), ("least", pa.float64()), ("blocks", pa.binary()), ("block", pa.int64())])
    found = pa.Table.from_batches(search._meet_map(20)(pa.Table.from_pylist(rows, schema).to_batches(70))).to_pylist()
    assert len(found) == 2 * 20 * len(queries) and max(sizes) <= 512
    for n, r in enumerate(found):
        assert abs(r["similarity"] - want[r["query_id"]][r["rank"] - 1][1]) < 1e-12


@pytest.mark.parametrize("k", [1, 4])
def test_first_blocks_are_picked_without_sorting_all(monkeypatch, k):
    rng = np.random.default_rng(17)
    rows, bound = rng.integers(1, 4, size=90), rng.integers(12, size=(40, 90)) / 12
    order = np.argsort(-bound, axis=1, kind="stable")
    held = np.cumsum(rows[order], axis=1) - rows[order]
    want = [{int(b) for b, h in zip(*x) if h < k} for x in zip(order, held)]
    monkeypatch.setattr(np, "argsort", None)
    got = search.Index(None, None, None, rows, None, None).first(bound, k)
    assert [set(np.flatnonzero(x).tolist()) for x in got] == want


def test_distances_of_a_block_are_worked_out_in_steps(monkeypatch):
    """Blocks are large, so that few pairs move; a worker still holds a step's distances at a time."""
    from sondera.operators import diagnostics

    monkeypatch.setattr(diagnostics, "STEP", 16)
    shapes, root = [], np.sqrt
    monkeypatch.setattr(np, "sqrt", lambda x: shapes.append(x.shape) or root(x))
    rng = np.random.default_rng(15)
    v, label = rng.normal(size=(50, 3)), rng.integers(3, size=50)
    sink = pa.BufferOutputStream()
    rows = pa.table({"id": pa.array(range(50)), "label": pa.array(label), "vector": pa.array(v.tolist())})
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    pack = sink.getvalue().to_pybytes()
    batch = pa.record_batch({"block": [0], "pack": [pack], "block_b": [0], "other": [pack]})
    got = {(r["id"], r["lj"]): r["total"] for b in diagnostics._euclidean_map([batch]) for r in b.to_pylist()}
    far = root(((v[:, None] - v[None]) ** 2).sum(-1))
    assert all(abs(got[i, j] - far[i, label == j].sum()) < 1e-9 for i in range(50) for j in range(3))
    assert max(map(max, shapes)) <= 16
