"""Token ids as flat unsigned integer files with 64-bit document offsets, for memory mapping.

Documents are range-partitioned and sorted by doc_id, or by an order that is given; each task encodes its documents and writes three files to the shared
folder: the ids one after another (little-endian, 16 bits where the vocabulary allows it, else 32), the offsets of its
documents in ids (64 bits, with the end), and the doc_ids (64 bits each, then a byte each that is 1 for null). Tasks write
under a name of their attempt and rename at the end, so a repeated task leaves the same files. The number of ids of each file
is summed into bases, so that a document's place in the whole is base + offset; the table of parts holds them.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import arrow_map
from .common import column, materialise, scratch_folder

END_ID = 1
#: Entries that a worker's caches of encoded words and pieces may have before they are emptied.
WORD_ENTRIES, PIECE_ENTRIES = 300_000, 200_000


# ---------------------------------------------------------------- files


class Store:
    """Whole files by name in one folder: of the local file system by open and mmap, of others by Arrow's file systems."""

    def __init__(self, uri: str):
        parsed = urlparse(uri)
        self.local = parsed.scheme in ("", "file")
        if self.local:
            self.root = parsed.path
            os.makedirs(self.root, exist_ok=True)
        else:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(uri)
            self.fs.create_dir(self.root, recursive=True)

    def writer(self, name: str):
        path = f"{self.root}/{name}"
        return open(path, "wb", buffering=1 << 20) if self.local else self.fs.open_output_stream(path)

    def rename(self, old: str, new: str) -> None:
        a, b = f"{self.root}/{old}", f"{self.root}/{new}"
        if self.local:
            os.replace(a, b)
        else:
            self.fs.move(a, b)

    def array(self, name: str, dtype: str) -> np.ndarray | Ranges:
        """The file as an array: memory-mapped where it is local, else read range by range as it is sliced."""
        path = f"{self.root}/{name}"
        if not self.local:
            return Ranges(self.fs.open_input_file(path), np.dtype(dtype))
        if os.path.getsize(path) == 0:
            return np.empty(0, dtype)
        return np.memmap(path, dtype, mode="r")


class Ranges:
    """A file of another store whose slices are read when they are asked for, so that no more of it is held."""

    def __init__(self, file, dtype: np.dtype):
        self.file, self.dtype, self.n = file, dtype, file.size() // dtype.itemsize

    def __getitem__(self, part: slice) -> np.ndarray:
        a, b, _ = part.indices(self.n)
        return np.frombuffer(self.file.read_at(max(0, b - a) * self.dtype.itemsize, a * self.dtype.itemsize), self.dtype)


# ---------------------------------------------------------------- encoding


class Encoder:
    """Encodes texts as the tokenizer does, remembering the ids of words.

    No pattern of the tokenizer joins what blanks or line feeds part, so a text's ids are those of its pieces between
    them, one after another. A piece of Latin letters and marks after them is two words to the tokenizer, so that "word",
    "Word" and "word," share one entry, and such words may go to its BPE model without normalising. Both are tried on samples
    when the encoder is made, and only used where the ids are those of the tokenizer as a whole.
    """

    # letters up to U+00FF are composed, and lower-case to letters up to U+00FF; the apostrophe, < and > are no marks here,
    # since contractions and special tokens hold them
    _plain = re.compile(r'([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*#$%&|()"-]*)')

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        most = max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.dtype = "<u2" if max(most, end_id) < 1 << 16 else "<u4"
        self.code = "H" if self.dtype == "<u2" else "I"
        self.end = np.array([end_id], self.dtype).tobytes()
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.as_bytes = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}
        self.words: dict[str, bytes] = {}
        letters = [chr(c) for c in (*range(97, 123), *range(0xDF, 0x100)) if chr(c).isalpha()]
        samples = [*letters, *["".join(letters[k : k + 7]) for k in range(0, len(letters), 3)], *'.,;:!?*#$%&|()"-', '."', ",-", "...", "***", "$$$"]
        one = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.by_piece = one("\n ".join(samples)) == [i for x in samples for i in one(x)]
        self.by_word = self.by_piece and all(one(a.upper() + b) == one(a) + one(b) for a in ("ab", "z", "été", "über") for b in samples if not b[0].isalpha())
        self.by_model = self.by_word and all(self._model(x) == one(x) for x in samples)
        self.pieces = _Pieces(self)

    def _model(self, word: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(word if word.isascii() else word.translate(self.as_bytes))]

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) >= WORD_ENTRIES:
                self.words.clear()
            ids = array(self.code, self._model(word) if self.by_model else self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
            self.words[word] = ids
        return ids

    def piece(self, piece: str) -> bytes:
        m = self._plain.fullmatch(piece) if self.by_word else None
        if m:
            return self._word(m[1].lower()) + (self._word(m[2]) if m[2] else b"")
        return array(self.code, self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes() if piece else b""

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text and the end id, as bytes."""
        if not self.by_piece:
            return [array(self.code, e.ids).tobytes() + self.end for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if len(self.pieces) >= PIECE_ENTRIES:
            self.pieces.clear()
        get = self.pieces.__getitem__
        return [b"".join(map(get, t.replace("\n", " ").split(" "))) + self.end for t in texts]


class _Pieces(dict):
    """Ids of pieces, worked out when first asked for."""

    def __init__(self, owner: Encoder):
        self.owner = owner

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = self.owner.piece(piece)
        return ids


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def _texts(column_: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in lots of about so many characters; null counts as empty."""
    lot, size, first = [], 0, 0
    for k, x in enumerate(column_):
        t = x.as_py() or ""
        lot.append(t)
        size += len(t)
        if size >= most:
            yield first, lot
            lot, size, first = [], 0, k + 1
    if lot:
        yield first, lot


def _write_map(uri: str, path: str, end_id: int):
    def run(batches):
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        store, enc = Store(uri), encoder(path, end_id)
        offsets, ids, nulls, total = [0], [], [], 0
        name = f"{part:06d}"
        out = None
        for batch in batches:
            docs = column(batch, "doc_id").to_pylist()
            for first, lot in _texts(column(batch, "text")):
                out = out or store.writer(f".{name}.{attempt}.ids")
                for k, raw in enumerate(enc.encode(lot)):
                    out.write(raw)
                    total += len(raw) // len(enc.end)
                    offsets.append(total)
                    doc = docs[first + k]
                    ids.append(doc or 0)
                    nulls.append(doc is None)
        if out is None:
            return
        out.close()
        for kind, data in (("offsets", np.array(offsets, "<i8")), ("docs", np.concatenate([np.array(ids, "<i8").view(np.uint8), np.array(nulls, np.uint8)]))):
            with store.writer(f".{name}.{attempt}.{kind}") as f:
                f.write(data.tobytes())
        for kind in ("ids", "offsets", "docs"):
            store.rename(f".{name}.{attempt}.{kind}", f"{name}.{kind}")
        yield pa.RecordBatch.from_pylist([{"part": part, "n_docs": len(ids), "n_ids": total, "kind": enc.dtype}])

    return run


def _lots(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about so many ids; a longer document is a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def _read_map(uri: str, most: int = 1 << 22):
    def run(batches):
        store = Store(uri)
        for batch in batches:
            for row in batch.to_pylist():
                name, n = f"{row['part']:06d}", row["n_docs"]
                data = store.array(f"{name}.ids", row["kind"])
                offs, raw = (np.asarray(store.array(f"{name}.{kind}", dtype)[: n + 1 if kind == "offsets" else 9 * n]) for kind, dtype in (("offsets", "<i8"), ("docs", "u1")))
                ids, nulls = raw[: 8 * n].view("<i8"), raw[8 * n :].astype(bool)
                for a, b in _lots(offs, most):
                    part = np.asarray(data[offs[a] : offs[b]])
                    crc = [zlib.crc32(part[offs[k] - offs[a] : offs[k + 1] - offs[a]].astype("<u4").tobytes()) for k in range(a, b)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[a:b], pa.int64(), mask=nulls[a:b]), pa.array(offs[a:b] + row["base"], pa.int64()), pa.array(np.diff(offs[a : b + 1]), pa.int64()), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return run


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = END_ID, folder: str | None = None, order: list[Column] | None = None) -> tuple[str, DataFrame]:
    """Writes the files to a folder (one that goes with the application, where none is given) and returns (folder, table of parts): part, n_docs, n_ids, kind (of the integers), base (ids in the parts
    before). The driver sees one row of counts per part.

    Documents stand in ascending doc_id order, null last, those of one doc_id in an order of their texts; or by the columns
    that are given as order. A null text counts as empty and has the end id alone; a very long text is encoded whole, and its
    ids are held in memory once. Repeated rows are documents of their own. An empty table gives no files. Columns other than
    doc_id, text and those of the order are not read, whatever their names.
    """
    spark = docs.sparkSession
    folder = folder or scratch_folder(spark, "tokens")
    # a hash of the text parts rows of one doc_id, or of none, over the ranges, and where they were read those of one text too
    doc_id = docs["doc_id"].cast("long")
    order = order or [doc_id.isNull(), doc_id, F.xxhash64(docs["text"])]
    keys = [f"__key{k}" for k in range(len(order))]
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *[c.alias(k) for c, k in zip(order, keys)], F.monotonically_increasing_id().alias("__lot"))
    sort = [*keys, "__lot"]
    rows = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).select("doc_id", "text")
    parts = sorted(arrow_map(rows, _write_map(folder, tokenizer, end_id), "part long, n_docs long, n_ids long, kind string").collect())
    bases = [0, *accumulate(p.n_ids for p in parts)]
    table = spark.createDataFrame([(*p, b) for p, b in zip(parts, bases)], "part long, n_docs long, n_ids long, kind string, base long")
    return folder, materialise(table, "token-parts")


def stored_order(docs: DataFrame) -> list[Column] | None:
    """Columns by which rows read from files stand as they were written by a sorted job: number of the part (which has five digits or
    more in a file's name), then row. None for rows that come from no file."""
    try:
        at = docs.metadataColumn("_metadata")
        docs.select(at["row_index"]).schema  # noqa: B018  resolves the column
    except AnalysisException:
        return None
    return [part_number(at["file_name"]), at["file_name"], at["row_index"]]


def part_number(file_name: Column) -> Column:
    return F.regexp_extract(file_name, r"part-(\d+)", 1).try_cast("long")


def read_tokens(folder: str, parts: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens (with the end id) and ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers), from the memory-mapped files, one row per document that was written: those of empty or null
    texts, repeated rows and rows without a doc_id (null here) included. No parts give no rows. Nothing else of the
    documents' table is read."""
    n = max(1, parts.count())
    return arrow_map(parts.repartition(n), _read_map(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")
