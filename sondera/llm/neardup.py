"""MinHash near-duplicate detection.

A document's set is its distinct five-word shingles as 64-bit hashes. Documents with equal sets are one class, held by its
least doc_id from there on. Each class gets minima of many universal hash functions, and the minima in bands of five are its
buckets. Within a bucket classes are first compared by a star, so that a bucket of n alike classes costs n pairs and not
n * n: all are compared with a centre, the class that shares most buckets with others. A pair is a link if its signatures
agree enough and then its full sets do. Components come from alternating large-star and small-star. A bucket whose classes
are then of one component is settled. In the others classes of different components are compared with one another: in
small ones by pairs, in large ones block by block. There a block of classes is one packed row, blocks and not classes are
paired, and two blocks of a bucket's main component never meet. Only links leave a task. So no link between components
is lost, and nothing is capped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import arrow_map
from .common import blobs, column, discard, gram_hashes, materialise, mix, slices, text_buffer, word_hashes
from .components import connected_components


@dataclass(frozen=True)
class Minhash:
    shingle: int = 5
    #: Least similarity in percent: 100 * intersection >= percent * union.
    percent: int = 75
    bands: int = 48
    rows: int = 5
    #: A pair whose share of equal signature bytes is below similarity - slack is not compared further; at 240 minima
    #: the slack is over five standard deviations.
    slack: float = 0.15
    #: Buckets of at most so many classes are compared pair by pair; larger ones by blocks of so many.
    small: int = 24
    block: int = 256
    seed: int = 7

    def least_share(self) -> float:
        """Least share of equal signature bytes, chance agreement of bytes included."""
        least = self.percent / 100 - self.slack
        return least + (1 - least) / 256


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all rows one after another, bounds of the rows)."""
    words, first = word_hashes(buf, offs)
    grams = gram_hashes(words, k)
    sets, bounds = [], np.zeros(len(first), np.int64)
    for r in range(len(first) - 1):
        a, b = first[r], first[r + 1]
        if b - a >= k:
            g = np.sort(grams[a : b - k + 1])
            g = g[np.concatenate([[True], g[1:] != g[:-1]])]
        elif b > a:  # a text of fewer words is one shingle, apart from those of k words by its length
            g = gram_hashes(words[a:b], b - a) ^ np.uint64(b - a)
        else:
            g = grams[:0]
        sets.append(g)
        bounds[r + 1] = bounds[r] + len(g)
    return (np.concatenate(sets) if sets else grams[:0]), bounds


def _functions(p: Minhash) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(p.seed)
    n = p.bands * p.rows
    return r.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, dtype=np.uint64)


def minima(sets: np.ndarray, bounds: np.ndarray, p: Minhash, block: int = 1 << 15) -> np.ndarray:
    """Upper 32 bits of the least a * x + b modulo 2**64 over each row's set, for each function; rows must not be empty."""
    a, b = _functions(p)
    out = np.empty((len(bounds) - 1, len(a)), np.uint32)
    lo = 0
    while lo < len(bounds) - 1:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + block, "right")) - 1)
        x, cuts = sets[bounds[lo] : bounds[hi]], bounds[lo:hi] - bounds[lo]
        if hi == lo + 1:
            # one long row: in blocks, with a running minimum
            best = np.full(len(a), np.uint64(0xFFFFFFFFFFFFFFFF))
            for s in range(0, len(x), block):
                part = x[s : s + block]
                for k in range(len(a)):
                    best[k] = min(best[k], (part * a[k] + b[k]).min())
            out[lo] = best >> np.uint64(32)
        else:
            tmp = np.empty_like(x)
            for k in range(len(a)):
                np.multiply(x, a[k], out=tmp)
                np.add(tmp, b[k], out=tmp)
                out[lo:hi, k] = np.minimum.reduceat(tmp, cuts) >> np.uint64(32)
        lo = hi
    return out


def band_keys(low: np.ndarray, p: Minhash) -> np.ndarray:
    """One 64-bit key per row and band."""
    out = np.empty((len(low), p.bands), np.uint64)
    for b in range(p.bands):
        out[:, b] = gram_hashes_rows(low[:, b * p.rows : (b + 1) * p.rows].astype(np.uint64), b)
    return out


def gram_hashes_rows(values: np.ndarray, salt: int) -> np.ndarray:
    h = np.full(len(values), np.uint64(salt + 1))
    for k in range(values.shape[1]):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + values[:, k])
    return h


def _signature_map(p: Minhash):
    def run(batches):
        for batch in batches:
            ids = column(batch, "doc_id")
            buf, offs = text_buffer(column(batch, "text"))
            for a, b, part, po in slices(buf, offs):
                sets, bounds = shingle_sets(part, po, p.shingle)
                n = np.diff(bounds)
                some = np.flatnonzero(n)
                sums = np.zeros((b - a, 2), np.uint64)
                for k in range(2):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ np.uint64(0xA5A5A5A5 + k)))])
                    sums[:, k] = total[bounds[1:]] - total[bounds[:-1]]
                low = minima(sets, np.concatenate([bounds[some], bounds[-1:]]), p) if len(some) else np.empty((0, p.bands * p.rows), np.uint32)
                keys = band_keys(low, p)
                at = np.zeros(b - a + 1, np.int64)
                at[1:] = np.cumsum(n > 0)
                key_list = pa.ListArray.from_arrays(pa.array(at * p.bands, pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
                sig = blobs((low & np.uint32(0xFF)).astype(np.uint8).reshape(-1), at * p.bands * p.rows)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(n, pa.int64()), pa.array(sums[:, 0].view(np.int64)), pa.array(sums[:, 1].view(np.int64)), key_list, sig],
                    ["doc_id", "n_shingles", "f1", "f2", "keys", "sig"],
                )

    return run


def signatures(docs: DataFrame, p: Minhash) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow_map(rows, _signature_map(p), "doc_id long, n_shingles long, f1 long, f2 long, keys array<long>, sig binary")


def _set_map(p: Minhash):
    def run(batches):
        for batch in batches:
            buf, offs = text_buffer(column(batch, "text"))
            for a, b, part, po in slices(buf, offs):
                sets, bounds = shingle_sets(part, po, p.shingle)
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id").slice(a, b - a), blobs(sets, bounds)], ["doc_id", "members"])

    return run


def _alike_map(p: Minhash):
    """Pairs whose signature bytes agree often enough."""

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(column(batch, c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
            share = (a == b).mean(axis=1) if batch.num_rows else np.empty(0)
            keep = pa.array(share >= p.least_share())
            yield pa.RecordBatch.from_arrays([column(batch, c).filter(keep) for c in ("a", "b")], ["a", "b"])

    return run


def _linked_map(p: Minhash):
    """Pairs whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(column(batch, "set_a"), column(batch, "set_b"))):
                keep[k] = similar(*(np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y)), p.percent)
            yield pa.RecordBatch.from_arrays([column(batch, c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    return run


def _confirmed(pairs: DataFrame, reps: DataFrame, sets: DataFrame, p: Minhash) -> DataFrame:
    """The pairs (a, b) that are links: signatures first, full sets after."""
    side = lambda t, col, x: t.select(F.col("doc_id").alias(x), F.col(col).alias(f"{col}_{x}"))
    sig = pairs.join(side(reps, "sig", "a"), "a").join(side(reps, "sig", "b"), "b")
    alike = arrow_map(sig.select("a", "b", "sig_a", "sig_b"), _alike_map(p), "a long, b long")
    full = alike.join(side(sets, "members", "a"), "a").join(side(sets, "members", "b"), "b")
    return arrow_map(full.select("a", "b", F.col("members_a").alias("set_a"), F.col("members_b").alias("set_b")), _linked_map(p), "a long, b long")


def _near_in_size(p: Minhash):
    return 100 * F.least("n_a", "n_b") >= p.percent * F.greatest("n_a", "n_b")


def _pairs(left: DataFrame, right: DataFrame, p: Minhash) -> DataFrame:
    """Distinct pairs (a, b) of left (key, id, n, comp) and right (key, c, n_c, comp_c) in one bucket, of different components
    and near in size."""
    both = left.join(right, "key").where("comp <> comp_c")
    both = both.select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b"), F.col("n").alias("n_a"), F.col("n_c").alias("n_b"))
    return both.where(100 * F.least("n_a", "n_b") >= p.percent * F.greatest("n_a", "n_b")).select("a", "b").distinct()


def _as_partner(members: DataFrame) -> DataFrame:
    return members.select("key", F.col("id").alias("c"), F.col("n").alias("n_c"), F.col("comp").alias("comp_c"))


def class_components(reps: DataFrame, docs: DataFrame, p: Minhash) -> DataFrame | None:
    """(node, component) of the classes that have links; None if no two classes share a bucket. reps: a signature row per class."""
    bands = reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    # a class is in p.bands buckets at most, so this window is small
    degree = F.sum("size").over(Window.partitionBy("id"))
    left = materialise(bands.join(shared, "key").select("key", "id", "n", degree.alias("degree"), F.col("id").alias("comp")), "buckets")
    if left.isEmpty():
        discard(left)
        return None
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = left.select(F.col("id").alias("doc_id")).distinct()
    sets = arrow_map(plain.join(ids.hint("shuffle_hash"), "doc_id", "left_semi"), _set_map(p), "doc_id long, members binary")
    sets = materialise(sets.dropDuplicates(["doc_id", "members"]), "shingle-sets")
    top = left.groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("minus"), "n")).alias("m"))
    centres = top.select("key", (-F.col("m.minus")).alias("c"), F.col("m.n").alias("n_c"), (-F.col("m.minus")).alias("comp_c"))
    found = materialise(_confirmed(_pairs(left, centres, p), reps, sets, p), "links")
    comp = materialise(connected_components(found), "components")
    # what the stars have not settled
    now = left.drop("comp").join(comp.select(F.col("node").alias("id"), F.col("component").alias("comp")), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    spread = now.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    open_ = materialise(now.join(spread.where("lo < hi AND size > 2").select("key", "size"), "key"), "open-buckets")
    if not open_.isEmpty():
        few, many = open_.where(F.col("size") <= p.small), open_.where(F.col("size") > p.small)
        rest = _confirmed(_pairs(few, _as_partner(few), p), reps, sets, p)
        if not many.isEmpty():
            rest = rest.unionByName(_in_blocks(many, reps, sets, p))
        more = materialise(rest, "links")
        if not more.isEmpty():
            stars = comp.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
            comp = materialise(connected_components(stars.unionByName(more)), "components")
        discard(more)
    discard(found, left, open_, sets)
    return comp


def _in_blocks(open_: DataFrame, reps: DataFrame, sets: DataFrame, p: Minhash) -> DataFrame:
    """Links across components in large buckets.

    A bucket's main component, the one with most classes in it, and the rest are dealt into blocks apart. A block is packed
    into one row, and the rows are paired: any two blocks but two of the main component. Two blocks are one task, which
    compares signatures and gives out only a bit mask per block, of the classes with a partner to compare in full. The
    masked classes are packed again, now with their sets, and links come out, one for each two components that they join.
    Rows grow with the classes in a bucket; what is sent twice is packed blocks, once per block of the rest."""
    held = open_.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("held"), F.sum("n").alias("held_n"))
    per = held.groupBy("key").agg(F.max(F.struct("held", "comp", "held_n")).alias("m"), F.sum("held").alias("size"), F.sum("held_n").alias("weight"))
    blocks = lambda size, weight: F.greatest(F.ceil(size / p.block), F.ceil(weight / (p.block * 2000))).cast("long")
    rest = blocks(F.col("size") - F.col("m.held"), F.col("weight") - F.col("m.held_n"))
    per = per.select("key", F.col("m.comp").alias("main"), rest.alias("n_rest"), blocks(F.col("m.held"), F.col("m.held_n")).alias("n_main"))
    block = F.when(F.col("comp") == F.col("main"), F.col("n_rest") + F.pmod(F.xxhash64("id"), F.col("n_main"))).otherwise(F.pmod(F.xxhash64("id"), F.col("n_rest")))
    dealt = open_.select("key", "id", "n", "comp").join(per, "key").select("key", block.alias("block"), "n_rest", "n_main", "id", "n", "comp")
    marks = dealt.join(reps.select(F.col("doc_id").alias("id"), "sig", "keys"), "id")
    schema = "key long, block long, n_rest long, n_main long, pack binary"
    packs = materialise(marks.groupBy("key", "block").applyInArrow(_pack, schema), "blocks")
    # block k of the rest meets every block from k on, which are the rest and then the main component
    others = F.when(F.col("block") < F.col("n_rest"), F.sequence(F.lit(0).cast("long"), F.col("n_rest") + F.col("n_main") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("n_rest") - 1))
    met = packs.select("key", "block", F.explode(others).alias("other"), "pack")
    met = met.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "pack")
    masks = met.groupBy("key", "lo", "hi").applyInArrow(_busy(p), "key long, block long, other long, mask binary")
    asks = materialise(masks.groupBy("key", "block").agg(F.collect_list(F.struct("other", "mask")).alias("asks")), "asks")
    wanted = arrow_map(packs.join(asks, ["key", "block"]).select("key", "block", "pack", "asks.mask"), _masked_map, "key long, block long, at int, id long, n long, comp long, sig binary, keys array<long>")
    full = wanted.join(sets.select(F.col("doc_id").alias("id"), "members"), "id").withColumn("n_rest", F.lit(0).cast("long")).withColumn("n_main", F.lit(0).cast("long"))
    again = full.groupBy("key", "block").applyInArrow(_pack, schema).drop("n_rest", "n_main")
    met = again.join(asks, ["key", "block"]).select("key", "block", "pack", F.inline("asks"))
    met = met.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "pack", "mask")
    links = materialise(met.groupBy("key", "lo", "hi").applyInArrow(_links_in_block(p), "a long, b long").distinct(), "links")
    discard(packs, asks)
    return links


def _pack(t: pa.Table) -> pa.Table:
    """A block's classes, in order of id, as one Arrow stream."""
    t = t.sort_by("id")
    sink = pa.BufferOutputStream()
    part = t.drop_columns(["key", "block", "n_rest", "n_main"])
    with pa.ipc.new_stream(sink, part.schema) as out:
        out.write_table(part)
    return t.select(["key", "block", "n_rest", "n_main"]).slice(0, 1).append_column("pack", pa.array([sink.getvalue().to_pybytes()], pa.binary()))


def _unpack(pack: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(pack.as_buffer()).read_all().combine_chunks()


def _bits(mask: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(mask, np.uint8), count=n).astype(bool)


def _masked_map(batches):
    """The classes of a block that any mask names, with their places in the block."""
    for batch in batches:
        for k in range(batch.num_rows):
            block = _unpack(column(batch, "pack")[k])
            at = np.flatnonzero(np.logical_or.reduce([_bits(m, block.num_rows) for m in column(batch, "mask")[k].as_py()]))
            rows = block.take(pa.array(at))
            same = lambda name: pa.array(np.full(len(at), column(batch, name)[k].as_py()), pa.int64())
            out = pa.table({"key": same("key"), "block": same("block"), "at": pa.array(at, pa.int32()), **{c: rows.column(c) for c in ("id", "n", "comp", "sig", "keys")}})
            yield from out.combine_chunks().to_batches()


def _two_blocks(t: pa.Table) -> tuple[list[int], list[pa.Table]]:
    """Numbers and classes of the one or two blocks of a task, the lower first."""
    t = t.sort_by("block")
    return t.column("block").to_pylist(), [_unpack(x) for x in t.column("pack")]


def _block_pairs(key: int, blocks: list[pa.Table], p: Minhash) -> list[tuple[int, int]]:
    """Places (in the first block, in the last) of the pairs whose signatures agree enough, most alike first: of different
    components, near in size, and in the first of the buckets that the two classes share."""
    get = lambda t, c: t.column(c).to_numpy()
    wide = lambda t, c, kind: (np.frombuffer(b"".join(t.column(c).to_pylist()), kind) if c == "sig" else t.column(c).combine_chunks().flatten().to_numpy()).reshape(t.num_rows, -1)
    left, right = blocks[0], blocks[-1]
    (n, m), (comp, comp_r) = ([get(t, c) for t in (left, right)] for c in ("n", "comp"))
    (sig, sig_r), (keys, keys_r) = ([wide(t, c, kind) for t in (left, right)] for c, kind in (("sig", np.uint8), ("keys", np.int64)))
    out = []
    for a in range(left.num_rows):
        b = np.arange(a + 1 if len(blocks) == 1 else 0, right.num_rows)
        b = b[(comp_r[b] != comp[a]) & (100 * np.minimum(m[b], n[a]) >= p.percent * np.maximum(m[b], n[a]))]
        share = (sig_r[b] == sig[a]).mean(axis=1) if len(b) else np.empty(0)
        b, share = b[share >= p.least_share()], share[share >= p.least_share()]
        if len(b):
            same = keys_r[b] == keys[a]
            here = keys[a][np.argmax(same, axis=1)] == key
            out += [(-s, a, int(x)) for s, x in zip(share[here], b[here])]
    return [(a, b) for _, a, b in sorted(out)]


def _busy(p: Minhash):
    def run(t: pa.Table) -> pa.Table:
        key = t.column("key")[0].as_py()
        numbers, blocks = _two_blocks(t)
        # a block whose partner is missing cannot be: every block number up to the count holds a class or no row at all
        pairs = _block_pairs(key, blocks, p) if len(blocks) == 2 or t.column("lo")[0] == t.column("hi")[0] else []
        rows = []
        if pairs:
            busy = [np.zeros(b.num_rows, bool) for b in blocks]
            for a, b in pairs:
                busy[0][a] = busy[-1][b] = True
            rows = [(key, numbers[k], numbers[-1 - k], np.packbits(mask).tobytes()) for k, mask in enumerate(busy)]
        kinds = (("key", pa.int64()), ("block", pa.int64()), ("other", pa.int64()), ("mask", pa.binary()))
        return pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds)})

    return run


def similar(u: np.ndarray, v: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets, neither empty."""
    at = np.searchsorted(u, v)
    at[at == len(u)] = 0
    inter = int((u[at] == v).sum())
    return 100 * inter >= percent * (len(u) + len(v) - inter)


def _links_in_block(p: Minhash):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        _, blocks = _two_blocks(t)
        # only what was busy between these two blocks; the rest of a block's packed classes is for other tasks
        for k, mask in enumerate(t.column("mask").to_pylist()):
            named = _bits(mask, 8 * len(mask))
            blocks[k] = blocks[k].filter(pa.array(named[blocks[k].column("at").to_numpy()])).combine_chunks()
        left, right = blocks[0], blocks[-1]
        ids, comps = ([x.column(c).to_pylist() for x in (left, right)] for c in ("id", "comp"))
        sets = [[np.frombuffer(x.as_buffer(), np.uint64) for x in b.column("members")] for b in (left, right)]
        root = {c: c for c in (*comps[0], *comps[1])}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out = []
        for a, b in _block_pairs(t.column("key")[0].as_py(), blocks, p):
            x, y = find(comps[0][a]), find(comps[1][b])
            if x != y and similar(sets[0][a], sets[1][b], p.percent):
                root[max(x, y)] = min(x, y)
                out.append(sorted((ids[0][a], ids[1][b])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, p: Minhash = Minhash()) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links, itself included), kept (doc_id = component_id).

    A null, empty or blank text has no shingles and is linked with nothing. A very long text is one set like others, hashed in
    blocks, whole. A row without a doc_id cannot be named by a link:
    its component_id is null and it is kept. Rows that share a doc_id are one document for linking. Equal texts are
    one class whatever their number. An empty table gives no rows; columns other than doc_id and text are not read. Odds
    that no band joins a pair of similarity 0.75 are (1 - 0.75**5)**48, about 2 in a million, and fall fast above it.
    """
    spark = docs.sparkSession
    sigs = materialise(signatures(docs, p), "signatures")
    some = sigs.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = materialise(some.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep")), "classes")
    # on the representative's id too, so that copies of one text, which carry long rows, do not meet on its key
    reps = sigs.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "n_shingles", "f1", "f2"], "left_semi").dropDuplicates(["doc_id", "f1", "f2"])
    reps = materialise(reps, "class-signatures")
    slim = materialise(sigs.select("doc_id", "n_shingles", "f1", "f2"), "sizes")
    discard(sigs)
    comp = class_components(reps, docs, p)
    discard(reps)
    if comp is None:
        comp = spark.createDataFrame([], "node long, component long")
    if _ids_in_two_classes(slim):
        # then a doc_id joins its classes, and members of a class are links too, each a star already
        own = slim.join(classes, ["n_shingles", "f1", "f2"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
        comp = connected_components(comp.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(own))
        joined = slim.join(comp, slim["doc_id"] == comp["node"], "left")
    else:
        named = classes.join(comp, classes["rep"] == comp["node"], "left").select("n_shingles", "f1", "f2", F.coalesce("component", "rep").alias("component"))
        joined = slim.join(named, ["n_shingles", "f1", "f2"], "left")
    component = F.coalesce("component", "doc_id")
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), kept.alias("kept"))


def _ids_in_two_classes(slim: DataFrame) -> bool:
    per = slim.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("f1").alias("lo"), F.max("f1").alias("hi")).where("lo <> hi")
    return not per.isEmpty()


def keep_one(docs: DataFrame, p: Minhash = Minhash()) -> DataFrame:
    """One document of each component, in the columns of docs, whatever others they are; of rows that share the doc_id kept,
    one stays. Texts that are null, empty or blank, and rows without a doc_id, are linked with nothing and stay, repeated
    rows of the latter included. Ties cannot be: the least doc_id stays. Very long texts are compared whole. No rows give none."""
    out = near_duplicates(docs, p)
    drop = materialise(out.where("NOT kept").select(F.col("doc_id").alias("__drop_id")).distinct(), "dropped")
    kept = docs.join(drop.hint("shuffle_hash"), docs["doc_id"].cast("long") == F.col("__drop_id"), "left_anti")
    again = out.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id").count().where("count > 1")
    if not again.isEmpty():
        names = [f"c{k}" for k in range(len(docs.columns))]
        at = names[[c.lower() for c in docs.columns].index("doc_id")]
        plain = kept.toDF(*names)
        kept = plain.where(f"{at} IS NULL").unionByName(plain.where(f"{at} IS NOT NULL").dropDuplicates([at])).toDF(*docs.columns)
    return kept


def oracle() -> str:
    """DuckDB SQL for near_duplicates(documents): every pair that shares a shingle, and reachability by recursion."""
    return """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
d AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM d a JOIN d b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT k.b, r.c FROM r JOIN both_ways k ON k.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n ON n.doc_id = m.doc_id"""
