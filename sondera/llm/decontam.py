"""Benchmark decontamination by the q-gram lemma and banded alignment.

Items are cut into overlapping windows. A window of n characters that stands in a document with at most e edits shares at least
n + 1 - q * (e + 1) of its q-grams with it, on diagonals (document place minus window place) that differ by at most e. So
shared q-grams are counted in overlapping bands of diagonals, each twice e + 1 wide and begun every e + 1; only bands that meet
the bound are aligned, by dynamic programming over the band, and those within the edit budget are matches.

Items too short for that are found where all their words stand in a row, exactly.

Text is compared in lower case with each run of characters other than letters and digits as one blank (bytes beyond ASCII count as
letters).

The benchmark is indexed in blocks of bounded size. Where there is more than one, a bit set of all its q-grams is made
first, and only documents with enough of their q-grams in it are searched for the blocks; so all documents are read as often for a
benchmark of any size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import arrow_map
from .common import column, gram_hashes, materialise, mix, prefix_hash, row_of, slices, span_hash, text_buffer, word_runs


@dataclass(frozen=True)
class Search:
    q: int = 12
    window: int = 100
    step: int = 50
    #: Edits per character of a window.
    edits: float = 0.06
    #: Shorter items (characters after normalising) are found by all their words only, without edits.
    least_item: int = 40
    #: Characters of benchmark text in a block.
    block: int = 1 << 20
    #: Shared q-grams that are expanded and summed at a time, and bytes of a text whose q-grams are coded at a time.
    lot: int = 1 << 20
    #: Bits of the set that holds the q-grams of a benchmark of several blocks, as a power of two (16 MB).
    sieve_bits: int = 27


_LETTER = np.zeros(256, bool)
_LETTER[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
_LETTER[0x80:] = True


def normalised(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts in lower case, runs of non-letters being one blank."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    buf, offs = text_buffer(pc.utf8_lower(array))
    inside = _LETTER[buf]
    keep = inside.copy()
    keep[:-1] |= inside[1:]  # the last blank of a run stays
    at = np.flatnonzero(keep)
    out = np.where(inside[at], buf[at], np.uint8(32))
    return out, np.searchsorted(at, offs)


def grams(buf: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit code for each place with q bytes from it on (8 <= q <= 16)."""
    if len(buf) < q:
        return np.empty(0, np.uint64)
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(buf, 8)).view("<u8")[:, 0]
    n = len(buf) - q + 1
    return mix(eight[:n] * np.uint64(0x9E3779B97F4A7C15) + eight[q - 8 : q - 8 + n])


def _whole(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(text, np.uint8), np.array([0, len(text)])


def word_grams(buf: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code, row, first byte, end) of each n words in a row of normalised texts."""
    starts, ends, first = word_runs(buf, offs)
    row = row_of(first)
    code = gram_hashes(span_hash(prefix_hash(buf, False), starts, ends), n)
    at = np.flatnonzero(row[: len(code)] == row[n - 1 :])
    return code[at], row[at], starts[at], ends[at + n - 1]


def short_matches(buf: np.ndarray, offs: np.ndarray, index: Index) -> list[tuple[int, int, int]]:
    """(row, number of the item, first place) of the short items whose words stand in a row's text."""
    found: dict[tuple[int, int], int] = {}
    for n, (codes, items) in index.short.items():
        code, row, start, end = word_grams(buf, offs, n)
        for k in np.flatnonzero(np.isin(code, codes)):
            a, b = np.searchsorted(codes, code[k], "left"), np.searchsorted(codes, code[k], "right")
            for item, whole in items[a:b]:
                if buf[start[k] : end[k]].tobytes() == whole:
                    found.setdefault((int(row[k]), item), int(start[k] - offs[row[k]]))
    return [(r, item, at) for (r, item), at in found.items()]


class Index:
    """Windows of one block of items and where their q-grams stand."""

    FILTER_BITS = 20

    def __init__(self, items: list[tuple[int | None, str]], p: Search):
        self.items, self.p = [], p
        windows, owner, begin = [], [], []
        short: dict[int, list[tuple[int, int, bytes]]] = {}
        buf, offs = normalised(pa.array([t or "" for _, t in items], pa.string()))
        for k, (item, _) in enumerate(items):
            text = buf[offs[k] : offs[k + 1]]
            if len(text) < p.least_item:
                words = text.tobytes().split()
                if words:
                    whole = b" ".join(words)
                    short.setdefault(len(words), []).append((int(word_grams(*_whole(whole), len(words))[0][0]), len(self.items), whole))
                    self.items.append(item)
                continue
            at = [0] if len(text) <= p.window + p.step else [*range(0, len(text) - p.window, p.step), len(text) - p.window]
            for a in at:
                windows.append(text[a : a + p.window] if len(at) > 1 else text)
                owner.append(len(self.items))
                begin.append(a)
            self.items.append(item)
        #: By number of words: sorted codes, and for each the item and its bytes.
        self.short = {n: (np.array([c for c, _, _ in sorted(rows)], np.uint64), [(i, w) for _, i, w in sorted(rows)]) for n, rows in short.items()}
        self.owner = np.array(owner, np.int64)
        self.begin = np.array(begin, np.int64)
        self.size = np.array([len(w) for w in windows], np.int64)
        self.budget = np.floor(self.size * p.edits).astype(np.int64)
        self.bound = np.maximum(self.size + 1 - p.q * (self.budget + 1), 1)
        self.letters = np.zeros((len(windows), int(self.size.max(initial=0))), np.uint8)
        codes, places, which = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for w, text in enumerate(windows):
            self.letters[w, : len(text)] = text
            g = grams(text, p.q)
            codes.append(g)
            places.append(np.arange(len(g)))
            which.append(np.full(len(g), w))
        code, place, win = map(np.concatenate, (codes, places, which))
        order = np.argsort(code, kind="stable")
        self.place, self.win = place[order], win[order]
        self.code, self.first = np.unique(code[order], return_index=True)
        self.first = np.append(self.first, len(order))
        self.shift = np.uint64(64 - self.FILTER_BITS)
        self.filter = np.zeros(1 << self.FILTER_BITS, bool)
        self.filter[self.code >> self.shift] = True

    def __len__(self) -> int:
        return len(self.size)


def coded(buf: np.ndarray, offs: np.ndarray, p: Search) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code, place, row) of the q-grams that do not cross rows, a bounded number of bytes at a time."""
    for s in range(0, len(buf) - p.q + 1, p.lot):
        code = grams(buf[s : s + p.lot + p.q - 1], p.q)
        at = np.arange(s, s + len(code))
        row = np.searchsorted(offs, at, "right") - 1
        inside = at + p.q <= offs[row + 1]
        yield code[inside], at[inside], row[inside]


def summed(row: np.ndarray, win: np.ndarray, band: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """The counts added up per row, window and band, in their order."""
    order = np.lexsort((band, win, row))
    row, win, band, count = row[order], win[order], band[order], count[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (win[1:] != win[:-1]) | (band[1:] != band[:-1])
    lead = np.flatnonzero(new)
    return row[lead], win[lead], band[lead], np.add.reduceat(count, lead) if len(lead) else count


def shared_grams(buf: np.ndarray, offs: np.ndarray, index: Index) -> tuple[np.ndarray, ...]:
    """(row, window, band, count) of shared q-grams; band is the diagonal over the width of the window's bands. A q-gram that
    repeats in text and window meets in many places, so places are expanded in lots and summed before the next."""
    p, parts, held, most = index.p, [], 0, 4 * index.p.lot
    none = np.empty(0, np.int64)
    for code, at, row in coded(buf, offs, p):
        maybe = np.flatnonzero(index.filter[code >> index.shift])
        k = np.searchsorted(index.code, code[maybe])
        k[k == len(index.code)] = 0
        same = index.code[k] == code[maybe] if len(index.code) else np.zeros(len(k), bool)
        maybe, k = maybe[same], k[same]
        n = index.first[k + 1] - index.first[k]
        upto = np.cumsum(n)
        lo = 0
        while lo < len(k):
            done = upto[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(upto, done + p.lot, "right")))
            m = n[lo:hi]
            flat = np.repeat(index.first[k[lo:hi]] - (upto[lo:hi] - m - done), m) + np.arange(upto[hi - 1] - done)
            win, where = index.win[flat], np.repeat(maybe[lo:hi], m)
            # from the row's begin on, so that it is the same in any slice and block; never negative
            diagonal = at[where] - offs[row[where]] - index.place[flat] + p.window + p.step
            parts.append(summed(row[where], win, diagonal // (index.budget[win] + 1), np.ones(len(win), np.int64)))
            held += len(parts[-1][0])
            if held > most:
                parts = [summed(*map(np.concatenate, zip(*parts)))]
                held = len(parts[0][0])
                most = max(most, 2 * held)
            lo = hi
    return summed(*map(np.concatenate, zip(*parts))) if parts else (none, none, none, none)


def candidates(buf: np.ndarray, offs: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, window, lowest diagonal) of the bands that meet the q-gram bound."""
    row, win, band, count = shared_grams(buf, offs, index)
    # a band and the next one together are one of the overlapping bands
    near = np.zeros(len(row), bool)
    near[:-1] = (row[1:] == row[:-1]) & (win[1:] == win[:-1]) & (band[1:] == band[:-1] + 1)
    both = count + np.where(near, np.append(count[1:], 0), 0)
    good = both >= index.bound[win]
    # the band before a lone band covers it too, but no further q-grams
    return row[good], win[good], (band * (index.budget[win] + 1) + offs[row])[good] - index.p.window - index.p.step


def align(buf: np.ndarray, offs: np.ndarray, row: np.ndarray, win: np.ndarray, low: np.ndarray, index: Index) -> np.ndarray:
    """Least edit distance of each candidate's window to a stretch of its row that begins on the band's diagonals, widened by
    the edit budget either way."""
    if len(row) == 0:
        return np.empty(0, np.int64)
    e = index.budget[win]
    breadth = int((4 * e + 2).max())
    left = low - e
    k = np.arange(breadth)
    beyond = 1 << 20
    outside = k[None, :] >= (4 * e + 2)[:, None]
    d = np.where(outside, beyond, 0).astype(np.int64)
    result = np.full(len(row), beyond)
    lo, hi = offs[row], offs[row + 1]
    for i in range(int(index.size[win].max())):
        at = left[:, None] + i + k[None, :]
        ok = (at >= lo[:, None]) & (at < hi[:, None])
        letters = np.where(ok, buf[np.clip(at, 0, len(buf) - 1)], np.uint8(0))
        new = d + (letters != index.letters[win, i][:, None])
        new[:, :-1] = np.minimum(new[:, :-1], d[:, 1:] + 1)
        new = np.minimum.accumulate(new - k, axis=1) + k
        d = np.where(outside, beyond, new)
        ends = index.size[win] == i + 1
        result[ends] = d[ends].min(axis=1)
    return result


def search(buf: np.ndarray, offs: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, window, lowest diagonal, distance) of the matches within budget, one per row and window (the nearest)."""
    row, win, low = candidates(buf, offs, index)
    parts = [align(buf, offs, row[s : s + 512], win[s : s + 512], low[s : s + 512], index) for s in range(0, len(row), 512)]
    dist = np.concatenate(parts) if parts else np.empty(0, np.int64)
    good = dist <= index.budget[win]
    row, win, low, dist = row[good], win[good], low[good], dist[good]
    order = np.lexsort((low, dist, win, row))
    row, win, low, dist = row[order], win[order], low[order], dist[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (win[1:] != win[:-1])
    return row[new], win[new], low[new], dist[new]


def matches(buf: np.ndarray, offs: np.ndarray, index: Index) -> list[tuple[int, int, int, int, int, float]]:
    """(row, item, windows matched, least distance, first place in the normalised text, share of the item covered)."""
    row, win, low, dist = search(buf, offs, index)
    out = [(r, index.items[item], 1, 0, at, 1.0) for r, item, at in short_matches(buf, offs, index)]
    key = row * max(1, len(index.items)) + index.owner[win]
    for k in np.unique(key):
        mine = np.flatnonzero(key == k)
        r, item = int(row[mine[0]]), int(index.owner[win[mine[0]]])
        spans = sorted((int(index.begin[w]), int(index.begin[w] + index.size[w])) for w in win[mine])
        covered, end = 0, 0
        for a, b in spans:
            covered += max(0, b - max(a, end))
            end = max(end, b)
        whole = max(int(index.begin[w] + index.size[w]) for w in np.flatnonzero(index.owner == item))
        out.append((r, index.items[item], len(mine), int(dist[mine].min()), max(0, int(low[mine].min() - offs[r])), covered / whole))
    return out


def blocks(benchmark: DataFrame, p: Search) -> Iterator[Index]:
    """Indexes of the items, a block at a time; the driver holds one."""
    lot, size = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        lot.append((item, text))
        size += len(text or "")
        if size >= p.block:
            yield Index(lot, p)
            lot, size = [], 0
    if lot:
        yield Index(lot, p)


class Sieve:
    """What a document must have to match any item of any block: as many q-grams among those of all windows as the least bound,
    or the words of a short item. Both are held as bits, so that its size is fixed."""

    def __init__(self, p: Search):
        self.p, self.least = p, None
        self.bits = np.zeros(1 << (p.sieve_bits - 3), np.uint8)
        self.short: dict[int, np.ndarray] = {}

    def add(self, index: Index) -> None:
        if len(index):
            self.least = min(int(index.bound.min()), self.least or 1 << 30)
            self._set(self.bits, index.code, self.p.sieve_bits)
        for n, (codes, _) in index.short.items():
            self._set(self.short.setdefault(n, np.zeros(1 << 13, np.uint8)), codes, 16)

    @staticmethod
    def _set(bits: np.ndarray, code: np.ndarray, size: int) -> None:
        at = code >> np.uint64(64 - size)
        np.bitwise_or.at(bits, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))

    @staticmethod
    def _has(bits: np.ndarray, code: np.ndarray, size: int) -> np.ndarray:
        at = code >> np.uint64(64 - size)
        return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def maybe(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Whether each row may match."""
        count = np.zeros(len(offs) - 1, np.int64)
        if self.least is not None:
            for code, _, row in coded(buf, offs, self.p):
                count += np.bincount(row[self._has(self.bits, code, self.p.sieve_bits)], minlength=len(count))
        out = count >= (self.least or 1)
        for n, bits in self.short.items():
            code, row, _, _ = word_grams(buf, offs, n)
            out[row[self._has(bits, code, 16)]] = True
        return out


def _sieve(benchmark: DataFrame, p: Search) -> Sieve | None:
    """The sieve of a benchmark of more than one block."""
    sieve, n = Sieve(p), 0
    for n, index in enumerate(blocks(benchmark, p), 1):
        sieve.add(index)
    return sieve if n > 1 else None


def _sieve_map(shared, names: list[str], want: bool):
    def run(batches):
        for batch in batches:
            maybe = np.zeros(batch.num_rows, bool)
            for a, b, buf, offs in _each(batch):
                maybe[a:b] = shared.value.maybe(buf, offs)
            yield batch.select(names).filter(pa.array(maybe == want))

    return run


def _each(batch: pa.RecordBatch):
    texts = column(batch, "text")
    raw, bounds = text_buffer(texts)
    for a, b, _, _ in slices(raw, bounds):
        yield a, b, *normalised(texts.slice(a, b - a))


def _match_map(shared):
    def run(batches):
        index = shared.value
        for batch in batches:
            ids = column(batch, "doc_id")
            for a, _, buf, offs in _each(batch):
                found = matches(buf, offs, index)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([a + m[0] for m in found], pa.int64())), *[pa.array([m[k] for m in found], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.int64()), (4, pa.int64()), (5, pa.float64()))]],
                    ["doc_id", "item_id", "n_windows", "distance", "first_char", "covered"],
                )

    return run


def _clean_map(shared, names: list[str], want: bool = True):
    def run(batches):
        index = shared.value
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for a, _, buf, offs in _each(batch):
                clean[a + search(buf, offs, index)[0]] = False
                clean[[a + r for r, _, _ in short_matches(buf, offs, index)]] = False
            yield batch.select(names).filter(pa.array(clean == want))

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, p: Search = Search()) -> DataFrame:
    """One row per document and benchmark item of which the document holds a window within the edit budget, or, if the item is
    short, all its words in a row: doc_id, item_id, n_windows, distance (the least), first_char (in the normalised text),
    covered (share of the item).

    Null and empty texts, and those without a letter or digit, match nothing, on either side. Rows without an id match like
    others and have null for it. Repeated rows give repeated matches, as do repeated items; an empty table gives no rows.
    Of several places of an item the nearest window counts, then the first. Columns other than doc_id, item_id and text are
    not read, whatever their names. Texts of any length are searched whole, in bounded memory.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sieve = _sieve(benchmark, p)
    if sieve is not None:
        shared = spark.sparkContext.broadcast(sieve)
        rows = materialise(arrow_map(rows, _sieve_map(shared, ["doc_id", "text"], True), "doc_id long, text string"), "maybe-leaking")
    schema = "doc_id long, item_id long, n_windows long, distance long, first_char long, covered double"
    if sieve is None:
        index = next(blocks(benchmark, p), None)
        return spark.createDataFrame([], schema) if index is None else arrow_map(rows, _match_map(spark.sparkContext.broadcast(index)), schema)
    parts = [materialise(found, "leaks") for found in _block_by_block(rows, benchmark, p, lambda df, shared: arrow_map(df, _match_map(shared), schema))]
    return reduce(DataFrame.unionByName, parts)


def _block_by_block(rows: DataFrame, benchmark: DataFrame, p: Search, job: Callable[[DataFrame, Broadcast], DataFrame]) -> Iterator[DataFrame]:
    """job(rows, index) for each block. A block's index leaves driver and executors before the next one is made, so what is yielded
    must be written before it is asked for the next."""
    for index in blocks(benchmark, p):
        shared = rows.sparkSession.sparkContext.broadcast(index)
        try:
            yield job(rows, shared)
        finally:
            shared.destroy()


def keep_clean(docs: DataFrame, benchmark: DataFrame, p: Search = Search()) -> DataFrame:
    """The documents without a match, in the columns of docs, whatever they are. Nulls, empty and very long texts, repeated rows
    and empty tables are as in leaks(); what matches nothing stays."""
    spark = docs.sparkSession
    names = [f"c{k}" for k in range(len(docs.columns))]
    at = names[[c.lower() for c in docs.columns].index("text")]
    plain = docs.toDF(*names)
    kinds = plain.schema
    text = lambda df: df.withColumn("text", F.col(at).cast("string"))
    sieve, clean = _sieve(benchmark, p), None
    if sieve is not None:
        shared = spark.sparkContext.broadcast(sieve)
        clean = arrow_map(text(plain), _sieve_map(shared, names, False), kinds)
        plain = materialise(arrow_map(text(plain), _sieve_map(shared, names, True), kinds), "maybe-leaking")
    if sieve is None:
        for index in blocks(benchmark, p):
            plain = arrow_map(text(plain), _clean_map(spark.sparkContext.broadcast(index), names), kinds)
        return plain.toDF(*docs.columns)
    numbered = materialise(plain.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    found = _block_by_block(text(numbered), benchmark, p, lambda df, shared: arrow_map(df, _clean_map(shared, ["__row"], False), "__row long"))
    held = reduce(DataFrame.unionByName, [materialise(f, "leaking-rows") for f in found]).distinct()
    return clean.unionByName(numbered.join(held, "__row", "left_anti").drop("__row")).toDF(*docs.columns)
