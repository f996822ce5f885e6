"""Stupid-backoff scores of documents under n-gram counts of all other documents, computed as joins of tables.

- The n-gram count table (part, n, gram, count) is partitioned by the hash of the gram and summed over the corpus. N-grams that
  occur once are left out: a gram that is not in the table counts as often as the document itself has it.
- The exploded n-grams (part, chunk, n, gram, own count) are those of the documents, dealt into chunks of text; within a chunk each
  gram is one row, so that frequent grams are no hot keys and are summed before they move.
- The two are joined on part and gram. The joined counts go back to the documents of their chunk, whose scores are summed.

Rows of one part (and chunk) are kept as one packed row, its grams in order as compressed differences: as rows of longs they
would take over ten times the input on disk. `count_table` gives the table unpacked. Grams are 56-bit hashes: of 10**12
distinct n-grams about one in 10**5 shares its hash with another.

A document's own counts are taken off first, so it is scored by the rest of the corpus only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import arrow_map
from .common import gram_hashes, row_of, text_buffer, word_hashes, word_runs

BITS = 56


@dataclass(frozen=True)
class Backoff:
    order: int = 3
    alpha: float = 0.4
    #: Text bytes of a chunk, about; the number of chunks follows the input.
    chunk: int = 5 << 20
    #: Parts are 2 ** bits, a quarter to half the number of chunks, since each row has a cost of its own. Up to so many bits a chunk has a row for
    #: each part; beyond it rows would be as many as the square of the chunks, so grams of about sqrt(chunks) chunks are summed first.
    one_level_bits: int = 10


def _column(table, name: str) -> pa.Array:
    return table.column(name).combine_chunks() if isinstance(table, pa.Table) else table.column(name)


def _whole(table: pa.Table) -> pa.RecordBatch:
    """A table as one batch: columns in pieces would be put together, and so copied whole, for each row that is read of them."""
    batches = table.combine_chunks().to_batches()
    return batches[0] if batches else pa.RecordBatch.from_pylist([], schema=table.schema)


def places(words: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(last word, key) of each n-gram that does not cross rows, in order."""
    if len(row) < n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.flatnonzero(row[n - 1 :] == row[: len(row) - n + 1])
    return at + n - 1, (gram_hashes(words, n) >> np.uint64(64 - BITS))[at]


def _pack_map(batches):
    """Rows of one batch and chunk as one compressed Arrow stream, which is less to shuffle and to sort. Rows that agree in doc_id and
    text are one with the number of times, so that a row repeated without end does not fill a chunk."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        once = pa.Table.from_batches([batch]).group_by(["chunk", "doc_id", "text"], use_threads=False).aggregate([([], "count_all")])
        once = once.rename_columns(["chunk", "doc_id", "text", "times"]).sort_by("chunk").combine_chunks()
        chunk = once.column("chunk").to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(chunk) != 0, [True]])) if len(chunk) else np.zeros(1, np.int64)
        numbers, packs = [], []
        for a, b in zip(cuts[:-1], cuts[1:]):
            sink = pa.BufferOutputStream()
            part = once.slice(a, b - a).select(["doc_id", "text", "times"])
            with pa.ipc.new_stream(sink, part.schema, options=options) as out:
                out.write_table(part)
            numbers.append(int(chunk[a]))
            packs.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(packs, pa.binary())], ["chunk", "pack"])


def _unpacked_rows(table: pa.Table) -> pa.Table:
    """(doc_id, text, times) of a chunk. Both passes see the same rows; their order does not matter."""
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in _column(table, "pack")])


def packed(values: np.ndarray) -> bytes:
    """Unsigned integers as planes of bytes, low to high, each compressed where that helps: the low planes of hash differences
    are noise, but their high plane and those of counts are not."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    out = [bytes([width])]
    for k in range(width):
        raw = planes[k].tobytes()
        small = pa.compress(raw, codec="zstd", asbytes=True)
        out.append((len(small) if len(small) < len(raw) else 0).to_bytes(4, "little"))
        out.append(small if len(small) < len(raw) else raw)
    return b"".join(out)


def unpacked(blob, n: int) -> np.ndarray:
    data = memoryview(blob)
    planes, at = np.zeros((8, n), np.uint8), 1
    for k in range(data[0]):
        size = int.from_bytes(data[at : at + 4], "little")
        at += 4
        raw = pa.decompress(data[at : at + size], decompressed_size=n, codec="zstd") if size else data[at : at + n]
        planes[k] = np.frombuffer(raw, np.uint8)
        at += size or n
    return np.ascontiguousarray(planes.T).view("<u8")[:, 0]


GRAMS = "part long, chunk long, n long, size long, keys binary, counts binary"
TABLE = "part long, n long, size long, keys binary, counts binary"
JOINED = "chunk long, n long, part long, size long, sums binary"


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = [x.split() for x in schema.split(", ")]
    return pa.table({name: pa.array([r[k] for r in rows], pa.binary() if kind == "binary" else pa.int64()) for k, (name, kind) in enumerate(kinds)})


def _keys(table: pa.RecordBatch, k: int) -> np.ndarray:
    """The grams of a packed row, from their part's first on, in order."""
    return np.cumsum(unpacked(_column(table, "keys")[k].as_buffer(), _column(table, "size")[k].as_py()), dtype=np.uint64)


def _counts(table: pa.RecordBatch, k: int) -> np.ndarray:
    return unpacked(_column(table, "counts")[k].as_buffer(), _column(table, "size")[k].as_py()).astype(np.int64)


def _steps(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=np.uint64(0)))


def _exploded(p: Backoff, bits: int):
    """The distinct n-grams of a chunk with their counts, a row for each part that has some."""

    def run(table: pa.Table) -> pa.Table:
        chunk = _column(table, "chunk")[0].as_py()
        docs = _unpacked_rows(table)
        words, first = word_hashes(*text_buffer(_column(docs, "text")))
        row, times = row_of(first), _column(docs, "times").to_numpy()
        rows = []
        for n in range(1, p.order + 1):
            last, keys = places(words, row, n)
            if len(times) and times.max() > 1:
                distinct, at = np.unique(keys, return_inverse=True)
                counts = np.zeros(len(distinct), np.int64)
                np.add.at(counts, at, times[row[last]])
            else:
                distinct, counts = np.unique(keys, return_counts=True)
            part = (distinct >> np.uint64(BITS - bits)).astype(np.int64)
            cuts = _cuts(part)
            for a, b in zip(cuts[:-1], cuts[1:]):
                rows.append((int(part[a]), chunk, n, int(b - a), _steps(distinct[a:b] - np.uint64(int(part[a]) << (BITS - bits))), packed(counts[a:b])))
        return _table(GRAMS, rows)

    return run


def _summed(table: pa.Table) -> pa.Table:
    """The count table of a part: its n-grams that occur more than once, over all chunks."""
    table = _whole(table)
    ns, rows = _column(table, "n").to_numpy(), []
    for n in np.unique(ns):
        mine = np.flatnonzero(ns == n)
        key = np.concatenate([_keys(table, int(k)) for k in mine])
        count = np.concatenate([_counts(table, int(k)) for k in mine])
        order = np.argsort(key, kind="stable")
        key = key[order]
        lead = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        total = np.add.reduceat(count[order], lead)
        often = total > 1
        if often.any():
            rows.append((_column(table, "part")[0].as_py(), int(n), int(often.sum()), _steps(key[lead][often]), packed(total[often])))
    return _table(TABLE, rows)


def _joined(grams: pa.Table, table: pa.Table) -> pa.Table:
    """The exploded n-grams of a part with the counts of the table, in their order; those not in it with their own."""
    grams, table = _whole(grams), _whole(table)
    totals = {n: (_keys(table, k), _counts(table, k)) for k, n in enumerate(_column(table, "n").to_pylist())} if table.num_rows else {}
    rows = []
    for k, (chunk, n, part, size) in enumerate(zip(*(_column(grams, c).to_pylist() for c in ("chunk", "n", "part", "size")))):
        key, out = _keys(grams, k), _counts(grams, k)
        if n in totals:
            known, total = totals[n]
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            out = np.where(known[at] == key, total[at], out)
        rows.append((chunk, n, part, size, packed(out)))
    return _table(JOINED, rows)


def _cuts(part: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, np.int64)


def _absolute(table: pa.RecordBatch, rows: np.ndarray, bits: int) -> list[np.ndarray]:
    """The grams of packed rows of parts of so many bits."""
    return [_keys(table, int(k)) + np.uint64(_column(table, "part")[int(k)].as_py() << (BITS - bits)) for k in rows]


def _merged(coarse: int, bits: int):
    """The distinct n-grams of a coarse part of some chunks, with their counts over these: a row for each fine part, under the number of
    the group of chunks."""

    def run(table: pa.Table) -> pa.Table:
        table = _whole(table)
        group, rows = _column(table, "group")[0].as_py(), []
        ns = _column(table, "n").to_numpy()
        for n in np.unique(ns):
            mine = np.flatnonzero(ns == n)
            distinct, at = np.unique(np.concatenate(_absolute(table, mine, coarse)), return_inverse=True)
            counts = np.zeros(len(distinct), np.int64)
            np.add.at(counts, at, np.concatenate([_counts(table, int(k)) for k in mine]))
            part = (distinct >> np.uint64(BITS - bits)).astype(np.int64)
            cuts = _cuts(part)
            for a, b in zip(cuts[:-1], cuts[1:]):
                rows.append((int(part[a]), group, int(n), int(b - a), _steps(distinct[a:b] - np.uint64(int(part[a]) << (BITS - bits))), packed(counts[a:b])))
        return _table(GRAMS, rows)

    return run


def _spread(coarse: int):
    """Counts of a group's distinct n-grams back to the chunks that have them."""

    def run(grams: pa.Table, answers: pa.Table) -> pa.Table:
        grams = _whole(grams)
        ns, rows = _column(grams, "n").to_numpy(), []
        found = sorted(zip(*(_column(answers, c).to_pylist() for c in ("n", "part", "size", "sums"))))
        for n in np.unique(ns):
            mine = np.flatnonzero(ns == n)
            keys = _absolute(grams, mine, coarse)
            distinct = np.unique(np.concatenate(keys))
            sums = np.concatenate([unpacked(s, k) for m, _, k, s in found if m == n])
            if len(sums) != len(distinct):
                raise RuntimeError("summed counts do not fit the group: its rows changed between two reads")
            for k, own in zip(mine, keys):
                rows.append((_column(grams, "chunk")[int(k)].as_py(), int(n), _column(grams, "part")[int(k)].as_py(), len(own), packed(sums[np.searchsorted(distinct, own)])))
        return _table(JOINED, rows)

    return run


def _score(p: Backoff, corpus_words: int):
    def run(packs: pa.Table, joined: pa.Table) -> pa.Table:
        docs = _unpacked_rows(packs)
        words_, first = word_hashes(*text_buffer(_column(docs, "text")))
        row = row_of(first)
        words = len(row)
        answers = sorted(zip(*(_column(joined, c).to_pylist() for c in ("n", "part", "size", "sums"))))
        # for each word: counts in the other documents of the n-gram that it ends, 0 where there is none
        counts = []
        for n in range(1, p.order + 1):
            last, keys = places(words_, row, n)
            distinct, at = np.unique(keys, return_inverse=True)
            mine = [unpacked(s, k) for m, _, k, s in answers if m == n]
            total = np.concatenate(mine).astype(np.int64) if mine else np.empty(0, np.int64)
            if len(total) != len(distinct):
                raise RuntimeError("joined counts do not fit the chunk: its rows changed between two reads")
            pair = row[last] * max(1, len(distinct)) + at
            c = np.zeros(words, np.int64)
            c[last] = total[at]
            del keys, distinct, total, at
            _, own_at, own = np.unique(pair, return_inverse=True, return_counts=True)
            c[last] -= own[own_at]
            del pair, own_at, own
            counts.append(c)
        del words_, answers
        length = np.diff(first)
        place = np.arange(words) - np.repeat(first[:-1], length)
        others = corpus_words - length[row] if words else np.empty(0, np.int64)
        top = np.minimum(place + 1, p.order)
        score = np.zeros(words)
        level = np.full(words, -1)
        for n in range(p.order, 0, -1):
            here = (level < 0) & (top >= n) & (counts[n - 1] > 0)
            i = np.flatnonzero(here)
            context = counts[n - 2][i - 1] if n > 1 else others[i]
            score[i] = np.log(counts[n - 1][i] / context) + (top[i] - n) * np.log(p.alpha)
            level[i] = n
        unseen = level < 0
        level[unseen] = 0
        score[unseen] = top[unseen] * np.log(p.alpha) - np.log(others[unseen] + 1)
        # sums are taken per row, so that the rows before do not change a row's rounding
        log_score = np.array([score[a:b].sum() for a, b in zip(first[:-1], first[1:])]) if words else np.zeros(len(first) - 1)
        hits = np.zeros((len(first) - 1, p.order + 1), np.int64)
        np.add.at(hits, (row, level), 1)
        out = {"doc_id": _column(docs, "doc_id"), "times": _column(docs, "times"), "n_words": pa.array(length, pa.int64()), "log_score": pa.array(log_score)}
        out |= {f"n_order{n}": pa.array(hits[:, n]) for n in range(p.order + 1)}
        return pa.table(out)

    return run


def _size_map(batches):
    for batch in batches:
        buf, offs = text_buffer(batch.column(0))
        n = w = 0
        step = 1 << 20
        k = 0
        while k < len(offs) - 1:
            e = max(k + 1, int(np.searchsorted(offs, offs[k] + step, "right")) - 1)
            n += int(offs[e] - offs[k])
            w += len(word_runs(buf[offs[k] : offs[e]], offs[k : e + 1] - offs[k])[0])
            k = e
        yield pa.RecordBatch.from_pydict({"bytes": [n], "words": [w]})


def _parts(docs: DataFrame, p: Backoff) -> tuple[DataFrame, DataFrame, DataFrame, int, int]:
    """(chunks of packed documents, count table, joined counts by chunk, words of the corpus, bits of a part)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = arrow_map(rows.select("text"), _size_map, "bytes long, words long").agg(F.sum("bytes").alias("b"), F.sum("words").alias("w")).first()
    chunks = max(1, -(-(size.b or 0) // p.chunk))
    bits = max(4, int(chunks).bit_length() - 2)
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("long")
    dealt = arrow_map(rows.select(chunk.alias("chunk"), "doc_id", "text"), _pack_map, "chunk long, pack binary")
    join = lambda grams, table: grams.groupBy("part").cogroup(table.groupBy("part")).applyInArrow(_joined, JOINED)
    if bits <= p.one_level_bits:
        grams = dealt.groupBy("chunk").applyInArrow(_exploded(p, bits), GRAMS)
        table = grams.groupBy("part").applyInArrow(_summed, TABLE)
        return dealt, table, join(grams, table), size.w or 0, bits
    bits += 2
    # two levels: a row of a chunk is a coarse part, a row of a group of chunks a fine one; both carry thousands of grams
    coarse = -(-bits // 2)
    grams = dealt.groupBy("chunk").applyInArrow(_exploded(p, coarse), GRAMS).withColumn("group", F.pmod("chunk", F.lit(1 << (bits - coarse))).cast("long"))
    merged = grams.groupBy("group", "part").applyInArrow(_merged(coarse, bits), GRAMS)
    table = merged.groupBy("part").applyInArrow(_summed, TABLE)
    answers = join(merged, table).withColumnRenamed("chunk", "group").withColumn("coarse", F.shiftright("part", bits - coarse))
    return dealt, table, grams.groupBy("group", "part").cogroup(answers.groupBy("group", "coarse")).applyInArrow(_spread(coarse), JOINED), size.w or 0, bits


def _unpack_map(bits_of_part):
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                part, n = _column(batch, "part")[k].as_py(), _column(batch, "n")[k].as_py()
                grams = _keys(batch, k) + np.uint64(part << bits_of_part)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), n), pa.int32()), pa.array(grams.astype(np.int64)), pa.array(_counts(batch, k))], ["n", "gram", "count"])

    return run


def count_table(docs: DataFrame, p: Backoff = Backoff()) -> DataFrame:
    """(n, gram, count): n-grams that occur more than once in all texts, by their hashes, a row each."""
    _, table, _, _, bits = _parts(docs, p)
    return arrow_map(table, _unpack_map(BITS - bits), "n int, gram long, count long")


def score(docs: DataFrame, p: Backoff = Backoff()) -> DataFrame:
    """doc_id, n_words, log_score (sum of natural logarithms over words), mean_log (null without words), and how many words were
    scored at each order (n_order0: never seen in another document).

    Words are in lower case (A-Z). A null or empty text has no words and score 0; repeated rows are documents of their own
    and see one another; a very long text is scored whole, in a chunk of its own size; an empty table gives no rows. Columns
    other than doc_id and text are not read, whatever their names. A word that no other document has counts as one of the
    other documents' words plus one.
    """
    dealt, _, joined, words_, _ = _parts(docs, p)
    types = "doc_id long, times long, n_words long, log_score double, " + ", ".join(f"n_order{n} long" for n in range(p.order + 1))
    scored = dealt.groupBy("chunk").cogroup(joined.groupBy("chunk")).applyInArrow(_score(p, words_), types)
    scored = scored.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return scored.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round(F.try_divide("log_score", "n_words"), 6).alias("mean_log"), *[f"n_order{n}" for n in range(p.order + 1)])


def oracle(p: Backoff = Backoff()) -> str:
    """DuckDB SQL for score(documents) at order 3."""
    a = f"ln({p.alpha!r}::DOUBLE)"
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS w3, unnest(range(len(ws))) AS i FROM d),
g AS (SELECT *, lag(w3) OVER o AS w2, lag(w3, 2) OVER o AS w1, count(*) OVER (PARTITION BY doc_id) AS len, count(*) OVER () AS n FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, n - len AS others,
  count(*) OVER (PARTITION BY w3) - count(*) OVER (PARTITION BY doc_id, w3) AS c1,
  CASE WHEN i > 0 THEN count(*) OVER (PARTITION BY w2, w3) - count(*) OVER (PARTITION BY doc_id, w2, w3) ELSE 0 END AS c2,
  CASE WHEN i > 1 THEN count(*) OVER (PARTITION BY w1, w2, w3) - count(*) OVER (PARTITION BY doc_id, w1, w2, w3) ELSE 0 END AS c3 FROM g),
x AS (SELECT *, lag(c1) OVER o AS x1, lag(c2) OVER o AS x2, least(i + 1, 3) AS top FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, CASE WHEN c3 > 0 THEN 3 WHEN c2 > 0 THEN 2 WHEN c1 > 0 THEN 1 ELSE 0 END AS lv,
  CASE WHEN c3 > 0 THEN ln(c3::DOUBLE / x2) WHEN c2 > 0 THEN ln(c2::DOUBLE / x1) + (top - 2) * {a} WHEN c1 > 0 THEN ln(c1::DOUBLE / others) + (top - 1) * {a}
  ELSE top * {a} - ln(others + 1) END AS v FROM x),
r AS (SELECT doc_id, count(*) AS k, sum(v) AS v, count(*) FILTER (lv = 0) AS n0, count(*) FILTER (lv = 1) AS n1, count(*) FILTER (lv = 2) AS n2, count(*) FILTER (lv = 3) AS n3 FROM s GROUP BY doc_id)
SELECT documents.doc_id, coalesce(k, 0)::BIGINT AS n_words, coalesce(round(v, 6), 0) AS log_score, round(v / k, 6) AS mean_log,
  coalesce(n0, 0) AS n_order0, coalesce(n1, 0) AS n_order1, coalesce(n2, 0) AS n_order2, coalesce(n3, 0) AS n_order3
FROM documents LEFT JOIN r ON documents.doc_id = r.doc_id"""
