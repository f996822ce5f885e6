"""Shared pieces of the corpus operators: tables in the shared folder (those of the session), joins that stand hot keys, and
vectorised kernels over the byte buffers of Arrow text columns."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_folder, discard, file_exists, folders_in, materialise, new_folder, scratch_folder, shared_dir  # noqa: F401

#: A word is a run of characters other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a lookup table may have to be broadcast; a longer one is joined by a salted shuffle.
BROADCAST_ROWS = 50_000
#: Bytes of text that a kernel works on at a time.
SLICE_BYTES = 1 << 20

_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def read_documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


# ---------------------------------------------------------------- columns


def words(text: Column | str) -> Column:
    """Number of words; 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key_hex(seed: str, *columns: Column) -> Column:
    """Keyed md5 of columns as 32 hex digits; null and "" differ."""
    parts = [F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in columns]
    return F.md5(F.concat_ws("|", F.lit(seed), *parts))


def hex_int(digits: Column) -> Column:
    """At most 15 hex digits as a long."""
    return F.conv(digits, 16, 10).cast("long")


def lookup_join(df: DataFrame, table: DataFrame, on: str, salt: Column, how: str = "left", salts: int = 32) -> DataFrame:
    """df joined to a table of unique keys (null is a key). The table is broadcast if it is counted at BROADCAST_ROWS
    rows at most; otherwise the rows of df are salted and the table repeated once per salt, so that no key is hot."""
    key = "__lookup_key"
    table = table.withColumnRenamed(on, key)
    small = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if small:
        return df.join(F.broadcast(table), F.col(on).eqNullSafe(F.col(key)), how).drop(key)
    df = df.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(salts)))
    table = table.withColumn("__salt_r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    on_both = F.col(on).eqNullSafe(F.col(key)) & (F.col("__salt") == F.col("__salt_r"))
    return df.join(table, on_both, how).drop(key, "__salt", "__salt_r")


# ---------------------------------------------------------------- Arrow text buffers


def text_buffer(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.string())
    n = len(array)
    if array.null_count:
        array = array.fill_null("")
    wide = np.int64 if pa.types.is_large_string(array.type) else np.int32
    _, offsets, data = array.buffers()
    if n == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, wide)[array.offset : array.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offs - offs[0]


def slices(buf: np.ndarray, offsets: np.ndarray, most: int = SLICE_BYTES):
    """Row ranges (first, last, bytes, offsets) of about `most` bytes; a longer text is a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b, buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def _spaces() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[9, 10, 11, 12, 13, 32]] = True
    return t


SPACE = _spaces()


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that do not cross a row's bounds, and for each row the index of its first run
    (with the total at the end)."""
    n = len(inside)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    cut = offsets[(offsets > 0) & (offsets < n)]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_runs(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return runs(~SPACE[buf], offsets)


_BASE = 0x9E3779B97F4A7C13  # 3 modulo 8


@functools.lru_cache(1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def powers(base: int) -> np.ndarray:
        out = np.full(size, np.uint64(base))
        out[0] = 1
        return np.multiply.accumulate(out)

    return powers(_BASE), powers(pow(_BASE, -1, 1 << 64))


@functools.lru_cache(2)
def _byte_table(fold: bool) -> np.ndarray:
    table = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if fold:
        table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x *= _MIX[0]
    x ^= x >> np.uint64(33)
    x *= _MIX[1]
    return x ^ (x >> np.uint64(33))


def prefix_hash(buf: np.ndarray, fold: bool) -> np.ndarray:
    """Polynomial prefix sums modulo 2**64, with a 0 before; fold lower-cases A-Z."""
    size = 1 << max(20, int(len(buf)).bit_length())
    power, _ = _powers(size)
    h = np.empty(len(buf) + 1, np.uint64)
    h[0] = 0
    np.cumsum(_byte_table(fold)[buf] * power[: len(buf)], out=h[1:])
    return h


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans' bytes, equal wherever they stand."""
    _, inverse = _powers(1 << max(20, int(len(h) - 1).bit_length()))
    return mix((h[ends] - h[starts]) * inverse[starts])


def word_hashes(buf: np.ndarray, offsets: np.ndarray, fold: bool = True):
    """(64-bit hash of each word, index of each row's first word)."""
    starts, ends, first = word_runs(buf, offsets)
    return span_hash(prefix_hash(buf, fold), starts, ends), first


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, for each place with n words after it (rows are not told apart)."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        out += hashes[k : k + len(out)] * np.uint64(pow(_BASE, k + 1, 1 << 64))
    return mix(out)


def row_of(first: np.ndarray) -> np.ndarray:
    """Row of each word, from the rows' first words."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def blobs(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary column: row k has the bytes of data[bounds[k]:bounds[k + 1]]."""
    offs = (np.asarray(bounds, np.int64) * data.dtype.itemsize).astype(np.int64)
    out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(data))])
    return out.cast(pa.binary())


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
