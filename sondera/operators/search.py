"""Exact cosine nearest neighbours of queries in a bank of vectors.

Vectors are compared by matrix products in Arrow workers. A bank of a few rows is broadcast, and nothing is shuffled. One of proven
size goes whole to each lot of queries: a task holds its queries and the best that it has found for each, and the bank passes by in
batches. A larger one is an index of cells around pivots: a bank vector
lies in the cell of its nearest pivot, and a block of a cell knows the least and the largest angle to it. By the triangle
inequality of angles no vector of a block is nearer to a query than the difference of angles allows. A query first visits the
blocks of best bound until they hold k vectors, and then only those whose bound reaches the k-th best found, so the result is
exact and most blocks are never visited where vectors lie in clusters. Blocks are small and many, so they do not move one by one:
those that follow one another are a pack, and a query goes once to each pack that has blocks for it, with a bit for each of these.
Either way a worker holds a lot of queries and a batch of the bank, however large these are. Ties go to the smaller bank id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import arrow_map, materialise, ship

#: Bytes of bank vectors (as doubles) that go whole to each lot of queries, and that each worker holds.
BROADCAST_BYTES, HELD_BYTES = 64 << 20, 1 << 20
#: Bytes that a worker may take for a search.
MEMORY = 1 << 30
QUERY_BLOCK, BANK_BLOCK = 1024, 16384
#: Blocks are not made smaller than this.
LEAST_BLOCK = 64
#: Pivots of a bank, at most; their vectors are broadcast.
MOST_PIVOTS = 4096
#: Bounds of queries and blocks, or similarities, that a worker works out at a time.
BOUNDS_AT_A_TIME = 1 << 19
#: Rows of a bank that meet queries at a time, and queries of a lot at most.
STEP, LOT = 1024, 16384
#: Partitions at most that lots of a search are dealt into, one each up to then.
MOST_PARTITIONS = 4096
#: Rounding that a bound allows for.
SLACK = 1e-9


@dataclass(frozen=True)
class Need:
    """Memory that a search takes: the replicated bank, one block of similarities, one widened bank block and a reserve."""

    bank_rows: int
    dim: int
    element: int = 8
    query_block: int = QUERY_BLOCK
    bank_block: int = BANK_BLOCK
    reserve: int = 512 << 20

    def bytes(self) -> int:
        q, b = self.query_block, min(self.bank_block, self.bank_rows)
        return self.bank_rows * self.dim * self.element + q * b * self.element + b * self.dim * (self.element + 4) + self.reserve


@dataclass(frozen=True)
class Way:
    """How a search runs: with the whole bank for each lot of queries or by pairs of blocks, and the sizes of blocks."""

    broadcast: bool
    query_block: int
    bank_block: int


def way(bank_rows: int, dim: int, broadcast_bytes: int = BROADCAST_BYTES, memory: int = MEMORY) -> Way:
    """The way for a bank: broadcast if its vectors are under the bound and all that a worker then needs fits its memory; else blocks,
    halved until two of them fit. A memory that not even the least blocks fit is an error, before any work is done."""
    if bank_rows * dim * 8 <= broadcast_bytes and Need(bank_rows, dim, query_block=QUERY_BLOCK, bank_block=BANK_BLOCK).bytes() <= memory:
        return Way(True, QUERY_BLOCK, BANK_BLOCK)
    q, b = QUERY_BLOCK, BANK_BLOCK
    # a block of the bank is all of the bank that a worker holds
    while (need := Need(min(b, bank_rows), dim, query_block=q, bank_block=b).bytes()) > memory:
        if b <= LEAST_BLOCK:
            raise MemoryError(f"a search of {bank_rows} vectors of {dim} needs {need} bytes a worker at least, {memory} are given")
        q, b = max(LEAST_BLOCK, q // 2), b // 2
    return Way(False, q, b)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(n, -1)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    if not np.isfinite(norm).all() or (norm == 0).any():
        raise ValueError("zero-norm or non-finite vector")
    return m / norm


def best(query: np.ndarray, bank: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, bank id, similarity) of the k best of each query, best first; unit vectors, ids ascending."""
    return _top(query @ bank.T, ids, k)


def _few(sim: np.ndarray, k: int) -> np.ndarray:
    """Which are the k largest of each row or among the first k that equal the k-th."""
    least = np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k, None]
    equal = sim == least
    return (sim > least) | (equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= k))


def _top(sim: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = min(k, sim.shape[1])
    row, col = np.nonzero(_few(sim, k) & (sim > -np.inf))
    value = sim[row, col]
    order = np.lexsort((ids[col], -value, row))
    row, col, value = row[order], col[order], value[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    return row[keep], ids[col[keep]], value[keep]


SCHEMA = "query_id long, rank int, bank_id long, similarity double"


def _out(ids: np.ndarray, row: np.ndarray, bank: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    """Rows in order of row and rank; ranks of a block's own best are worked out again when blocks are merged."""
    rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
    return pa.RecordBatch.from_arrays([pa.array(ids[row], pa.int64()), pa.array(rank, pa.int32()), pa.array(bank, pa.int64()), pa.array(value)], ["query_id", "rank", "bank_id", "similarity"])


def _broadcast_map(shared, k: int, w: Way):
    bank_step = min(w.bank_block, STEP)
    query_step = max(1, min(w.query_block, BOUNDS_AT_A_TIME // bank_step))

    def run(batches):
        ids, bank = shared.value
        for batch in batches:
            for s in range(0, batch.num_rows, query_step):
                part = batch.slice(s, query_step)
                q = _unit(_matrix(part.column(1)))
                found = [best(q, bank[b : b + bank_step], ids[b : b + bank_step], k) for b in range(0, len(ids), bank_step)]
                row, col, value = map(np.concatenate, zip(*found))
                order = np.lexsort((col, -value, row))
                row, col, value = row[order], col[order], value[order]
                keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                yield _out(part.column(0).to_numpy(), row[keep], col[keep], value[keep])

    return run


@dataclass(frozen=True)
class Index:
    """A bank's cells: pivots (unit vectors), and per block its cell, pack, rows, least and largest angle to the pivot. Blocks of a pack
    follow one another."""

    pivots: np.ndarray
    cell: np.ndarray
    pack: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def bounds(self, unit: np.ndarray) -> np.ndarray:
        """Largest similarity that each query can have to a vector of each block."""
        angle = unit @ self.pivots.T
        np.arccos(np.clip(angle, -1, 1, out=angle), out=angle)
        if not np.array_equal(self.cell, np.arange(angle.shape[1])):
            angle = angle[:, self.cell]
        out = angle - self.high
        np.maximum(out, np.subtract(self.low, angle, out=angle), out=out)
        return np.cos(np.maximum(out, 0, out=out), out=out)

    def first(self, bound: np.ndarray, k: int) -> np.ndarray:
        """Which blocks each query visits first: those of best bound, as many as hold k vectors. Each block holds one at least, so
        these are among the k of best bound; of equal bounds the first blocks."""
        out = np.zeros(bound.shape, bool)
        _, order, _ = _top(bound, np.arange(bound.shape[1]), k)
        order = order.reshape(len(bound), -1)
        held = self.rows[order]
        np.put_along_axis(out, order, np.cumsum(held, axis=1) - held < k, axis=1)
        return out


def _assign_map(shared):
    """Bank rows with their cell and angle to its pivot."""

    def run(batches):
        pivots = shared.value
        step = max(1, BOUNDS_AT_A_TIME // len(pivots))
        for batch in batches:
            for s in range(0, batch.num_rows, step):
                part = batch.slice(s, step)
                cosine = _unit(_matrix(part.column(1))) @ pivots.T
                cell = cosine.argmax(axis=1)
                angle = np.arccos(np.clip(cosine[np.arange(len(cell)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell, pa.int64()), pa.array(angle)], ["id", "embedding", "cell", "angle"])

    return run


def build_index(bank: DataFrame, rows: int, block: int, cell_rows: int | None = None) -> tuple[Index, DataFrame]:
    """(index, its rows: pack, block within it, b_id, b_embedding) of a bank (id, embedding). Pivots are the vectors of least md5 of their id, one for each
    `cell_rows` rows but MOST_PIVOTS at most; all vectors are indexed. A cell of more rows than a block has is several blocks, by angle,
    so that each is a ring about the pivot."""
    spark = bank.sparkSession
    n = max(1, min(MOST_PIVOTS, rows // max(1, cell_rows or block)))
    found = bank.orderBy(F.md5(F.col("id").cast("string")), "id").limit(n).toArrow()
    pivots = _unit(_matrix(found.column("embedding")))
    placed = materialise(arrow_map(bank, _assign_map(spark.sparkContext.broadcast(pivots)), "id long, embedding array<double>, cell long, angle double"), "bank-cells")
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
    width = F.greatest(F.ceil(F.col("n") / block), F.lit(1))
    # rings of equal angle, then by hash where a ring is still too large
    ring = F.least(F.floor((F.col("angle") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-12)) * width), width - 1).cast("long")
    ringed = placed.join(F.broadcast(sizes), "cell").withColumn("ring", ring).select("id", "embedding", "cell", "angle", "ring")
    counts = ringed.groupBy("cell", "ring").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("long")
    split = materialise(ringed.join(F.broadcast(counts), ["cell", "ring"]).withColumn("part", part).drop("parts"), "bank-rings")
    table = split.groupBy("cell", "ring", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("angle").alias("low"), F.max("angle").alias("high")).orderBy("cell", "ring", "part").toPandas()
    pack = (table["rows"].cumsum() - table["rows"]) // block
    # as an Arrow table, since rows of Python start workers of their own
    numbers = spark.createDataFrame(pa.table({**{c: table[c].to_numpy() for c in ("cell", "ring", "part")}, "block": table.groupby(pack).cumcount().to_numpy(), "pack": pack.to_numpy()}))
    placed_rows = split.join(F.broadcast(numbers), ["cell", "ring", "part"]).select("pack", "block", F.col("id").alias("b_id"), F.col("embedding").alias("b_embedding"))
    return Index(pivots, table["cell"].to_numpy(), pack.to_numpy(), *(table[c].to_numpy() for c in ("rows", "low", "high"))), placed_rows


VISITS = "pack long, id long, embedding array<double>, least double, blocks binary"


def _needed(index: Index, batch: pa.RecordBatch, k: int):
    """(queries, bounds, blocks visited first) of a few queries at a time."""
    step = max(1, min(QUERY_BLOCK, BOUNDS_AT_A_TIME // len(index.cell)))
    for s in range(0, batch.num_rows, step):
        part = batch.slice(s, step)
        bound = index.bounds(_unit(_matrix(part.column(1))))
        yield part, bound, index.first(bound, k)


def _visit_map(shared, k: int, limit: bool):
    """Queries with the packs that they visit, and bits for the blocks of these: first (id, embedding), or then (id, embedding, least
    similarity)."""

    def run(batches):
        index = shared.value
        starts = np.searchsorted(index.pack, np.unique(index.pack)).tolist() + [len(index.pack)]
        for batch in batches:
            for part, bound, visit in _needed(index, batch, k):
                least = part.column(2).to_numpy() if limit else np.full(part.num_rows, -2.0)
                if limit:
                    visit = ~visit & (bound >= least[:, None] - SLACK)
                for a, b in zip(starts[:-1], starts[1:]):
                    row = np.flatnonzero(visit[:, a:b].any(axis=1))
                    if len(row):
                        bits = [x.tobytes() for x in np.packbits(visit[row, a:b], axis=1)]
                        at = pa.array(row)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), index.pack[a], np.int64)), part.column(0).take(at), part.column(1).take(at), pa.array(least[row]), pa.array(bits, pa.binary())], ["pack", "id", "embedding", "least", "blocks"])

    return run


def _count_map(shared, k: int):
    """How many blocks each query (id, embedding, least similarity) visits, first and then."""

    def run(batches):
        for batch in batches:
            for part, bound, visit in _needed(shared.value, batch, k):
                visit |= bound >= part.column(2).to_numpy()[:, None] - SLACK
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(visit.sum(axis=1).astype(np.int64))], ["query_id", "visited"])

    return run


class _Lot:
    """A lot of queries and the k best of each so far. Bank rows come in order of id, so that one equal to the k-th best is no better."""

    def __init__(self, parts: list[pa.RecordBatch], k: int):
        self.k = k
        self.ids = np.concatenate([p.column("id").to_numpy() for p in parts])
        self.q = np.concatenate([_unit(_matrix(p.column("embedding"))) for p in parts])
        self.floor = np.nextafter(np.concatenate([p.column("least").to_numpy() for p in parts]) - SLACK, -np.inf)
        bits = [x for p in parts for x in p.column("blocks").to_pylist()]
        self.bits = None if bits[0] is None else np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1)
        self.value = np.full((len(self.ids), k), -np.inf)
        self.bank = np.zeros((len(self.ids), k), np.int64)

    def meet(self, ids: np.ndarray, unit: np.ndarray, block: np.ndarray) -> None:
        step = max(1, BOUNDS_AT_A_TIME // max(1, len(ids)))
        for s in range(0, len(self.ids), step):
            at = slice(s, s + step)
            if self.bits is None:
                self._better(s, ids, self.q[at] @ unit.T)
            else:
                visit = np.unpackbits(self.bits[at], axis=1).astype(bool)
                col = np.flatnonzero(visit.any(axis=0)[block])
                if len(col):
                    self._better(s, ids[col], np.where(visit[:, block[col]], self.q[at] @ unit[col].T, -np.inf))

    def _better(self, s: int, ids: np.ndarray, sim: np.ndarray) -> None:
        k, floor = self.k, self.floor[s : s + len(sim)]
        better = sim > floor[:, None]
        if k < sim.shape[1] and np.count_nonzero(better) > 2 * k * len(sim):
            better &= _few(sim, k)
        row, col = np.nonzero(better)
        if not len(row):
            return
        hit = np.unique(row)
        own = s + hit
        row, bank, value = np.concatenate([row, np.repeat(hit, k)]), np.concatenate([ids[col], self.bank[own].ravel()]), np.concatenate([sim[row, col], self.value[own].ravel()])
        order = np.lexsort((bank, -value, row))
        row = row[order]
        best = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
        self.bank[own], self.value[own] = bank[best].reshape(-1, k), value[best].reshape(-1, k)
        self.floor[own] = np.maximum(self.floor[own], self.value[own, -1])

    def found(self):
        step = max(1, BOUNDS_AT_A_TIME // (16 * self.k))
        for s in range(0, len(self.ids), step):
            value = self.value[s : s + step]
            row, col = np.nonzero(value > -np.inf)
            yield _out(self.ids[s : s + step], row, self.bank[s : s + step][row, col], value[row, col])


#: Queries (side 0, with the blocks that they visit, null for all) and the bank's rows (side 1, with their block) of a pack and lot.
MET = "pack long, lot long, side int, id long, embedding array<double>, least double, blocks binary, block long"


def _meet_map(k: int):
    """The k best of each query of a pack and lot, in a stream ordered by pack, lot, side and id."""

    def run(batches):
        key, waiting, lot = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if a == b:
                    continue
                if key != tuple(keys[:2, a]):
                    if lot is not None:
                        yield from lot.found()
                    key, waiting, lot = tuple(keys[:2, a]), [], None
                if keys[2, a] == 0:
                    waiting.append(batch.slice(a, b - a))
                    continue
                if waiting:
                    lot, waiting = _Lot(waiting, k), []
                if lot is not None:
                    for s in range(a, b, STEP):
                        part = batch.slice(s, min(STEP, b - s))
                        lot.meet(part.column("id").to_numpy(), _unit(_matrix(part.column("embedding"))), part.column("block").to_numpy(zero_copy_only=False))
        if lot is not None:
            yield from lot.found()

    return run


def _lots(queries: DataFrame, query_block: int) -> int:
    """Lots that queries are dealt into: as many for each core, and no more rows in one than a task shall hold."""
    cores = queries.sparkSession.sparkContext.defaultParallelism
    return cores * max(1, -(-queries.count() // (cores * max(query_block, LOT))))


def _visited(visits: DataFrame, rows: DataFrame, k: int, lots: int, packs: int = 1) -> DataFrame:
    """(query_id, rank, bank_id, similarity): the k best of each visit. Queries are dealt into lots, and a pack goes to each lot, so that a pack
    that many visit is several tasks."""
    null = lambda t: F.lit(None).cast(t)
    q = visits.select("pack", F.pmod(F.xxhash64("id"), F.lit(lots)).cast("long").alias("lot"), F.lit(0).alias("side"), "id", "embedding", "least", "blocks", null("long").alias("block"))
    lot = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lots - 1).cast("long"))).alias("lot")
    b = rows.select("pack", lot, F.lit(1).alias("side"), F.col("b_id").alias("id"), F.col("b_embedding").cast("array<double>").alias("embedding"), null("double").alias("least"), null("binary").alias("blocks"), "block")
    parts = min(packs * lots, MOST_PARTITIONS)
    dealt = q.unionByName(b).repartitionById(parts, F.pmod(F.col("pack") * lots + F.col("lot"), F.lit(parts)).cast("int"))
    return arrow_map(dealt.sortWithinPartitions("pack", "lot", "side", "id"), _meet_map(k), SCHEMA)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "bank_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "bank_id", "similarity")


def pruned(queries: DataFrame, bank: DataFrame, k: int, rows: int, query_block: int = QUERY_BLOCK, bank_block: int = BANK_BLOCK, cell_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(k nearest, visits: query_id, blocks, visited) by the pivot index. queries and bank are (id, embedding)."""
    ship(queries.sparkSession)
    index, packs = build_index(bank, rows, bank_block, cell_rows)
    shared = queries.sparkSession.sparkContext.broadcast(index)
    queries = queries.select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    lots, n = _lots(queries, query_block), int(index.pack.max()) + 1
    found = materialise(_best(_visited(arrow_map(queries, _visit_map(shared, k, False), VISITS), packs, k, lots, n), k), "first-found")
    least = queries.join(found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), "similarity"), "id").select("id", "embedding", "similarity")
    more = _visited(arrow_map(least, _visit_map(shared, k, True), VISITS), packs, k, lots, n)
    out = _best(found.unionByName(more), k)
    visits = arrow_map(least, _count_map(shared, k), "query_id long, visited long")
    return out, visits.select("query_id", F.lit(len(index.cell)).cast("long").alias("blocks"), "visited")


def nearest(queries: DataFrame, bank: DataFrame, k: int, broadcast_bytes: int = BROADCAST_BYTES, memory: int = MEMORY) -> DataFrame:
    """(query_id, rank from 1, bank_id, similarity) of the k nearest bank vectors of each query; both are (id, embedding). Fewer than
    k bank vectors, a zero norm or a non-finite component is an error, and so is a memory that no way of searching fits."""
    spark = queries.sparkSession
    ship(spark)
    queries, bank = queries.toDF("id", "embedding"), bank.toDF("id", "embedding")
    size = bank.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    if size.n < k:
        raise ValueError(f"{k} neighbours of a bank of {size.n}")
    w = way(size.n, size.dim, broadcast_bytes, memory)
    if w.broadcast and size.n * size.dim * 8 <= HELD_BYTES:
        rows = bank.toArrow()
        ids, m = rows.column("id").to_numpy(), _unit(_matrix(rows.column("embedding")))
        order = np.argsort(ids, kind="stable")
        return arrow_map(queries, _broadcast_map(spark.sparkContext.broadcast((ids[order], m[order])), k, w), SCHEMA)
    if w.broadcast:
        all_ = queries.select(F.lit(0).cast("long").alias("pack"), "id", F.col("embedding").cast("array<double>").alias("embedding"), F.lit(-2.0).alias("least"), F.lit(None).cast("binary").alias("blocks"))
        rows = bank.select(F.lit(0).cast("long").alias("pack"), F.lit(0).cast("long").alias("block"), F.col("id").alias("b_id"), F.col("embedding").alias("b_embedding"))
        return _visited(all_, rows, k, _lots(queries, w.query_block))
    return pruned(queries, bank, k, size.n, w.query_block, w.bank_block)[0]
