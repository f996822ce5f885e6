"""A container of named tensors as a Spark data source.

A container is a folder: files of tensors, and an index that names them and is written last. A file begins with the length of a
header (8 bytes, little-endian), then the header in JSON (name: type, shape, byte offsets), then the numbers; each tensor in it is a
range of rows of the whole tensor. Reading plans byte ranges from the headers alone, filters on the name leave out the ranges of
others, and what does not fit (a name or shape that was expected, offsets that do not fit the shape, a file that is too short) is an
error. `spark.read.format("tensors")` gives (name, row, values); a bare file of that layout is read too.
"""

from __future__ import annotations

import json
import math
import struct
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from ..session import ship
from . import stores

#: Bytes of a tensor that are one input partition.
RANGE_BYTES = 32 << 20
#: Numbers of a batch.
BATCH = 1 << 18
TYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "U8": "u1"}
SCHEMA = "name string, row long, values array<double>"
INDEX = "index.json"


@dataclass(frozen=True)
class Tensor:
    """Rows of a tensor in a file: `first` is the number of its first row in the whole tensor."""

    file: str
    name: str
    type: str
    shape: tuple[int, ...]
    start: int
    first: int = 0

    @property
    def row_bytes(self) -> int:
        return np.dtype(TYPES[self.type]).itemsize * math.prod(self.shape[1:])


def header(path: str) -> list[Tensor]:
    """The tensors of a file, from its header; a header that the file does not bear out is an error."""
    size = stores.size_of(path)
    if size < 8:
        raise ValueError(f"{path} has no header")
    (length,) = struct.unpack("<Q", stores.read_range(path, 0, 8))
    if 8 + length > size:
        raise ValueError(f"{path} is shorter than its header")
    out = []
    for name, x in json.loads(stores.read_range(path, 8, length)).items():
        if name == "__metadata__":
            continue
        begin, end = x["data_offsets"]
        t = Tensor(path, name, x["dtype"], tuple(x["shape"]) or (1,), 8 + length + begin)
        if t.type not in TYPES:
            raise ValueError(f"{name} in {path} is of type {t.type}")
        if end - begin != t.row_bytes * t.shape[0]:
            raise ValueError(f"{name} in {path} has offsets that do not fit its shape")
        if 8 + length + end > size:
            raise ValueError(f"{path} is truncated: {name} ends at {8 + length + end} of {size}")
        out.append(t)
    return out


def tensors(path: str) -> list[Tensor]:
    """All tensors of a container, or of a bare file."""
    fs, at = stores.file_system(path)
    if fs.get_file_info(at).type == pafs.FileType.File:
        return header(path)
    if fs.get_file_info(f"{at}/{INDEX}").type != pafs.FileType.File:
        raise FileNotFoundError(f"{path} has no {INDEX}: it was never completed")
    index = json.loads(stores.read_range(f"{path}/{INDEX}", 0, stores.size_of(f"{path}/{INDEX}")))
    out = []
    for file, parts in index["files"].items():
        found = {t.name: t for t in header(f"{path}/{file}")}
        for name, first in parts.items():
            if name not in found:
                raise ValueError(f"{file} lacks {name}")
            out.append(Tensor(**(found[name].__dict__ | {"first": first})))
    return out


def whole_shapes(found: list[Tensor]) -> dict[str, tuple[str, tuple[int, ...]]]:
    """name: (type, shape) of the whole tensors; parts that leave gaps, overlap or differ are an error."""
    by_name = defaultdict(list)
    for t in found:
        by_name[t.name].append(t)
    out = {}
    for name, parts in by_name.items():
        parts.sort(key=lambda t: (t.first, t.shape[0]))
        if len({(t.type, t.shape[1:]) for t in parts}) > 1:
            raise ValueError(f"parts of {name} differ in type or shape")
        at = 0
        for t in parts:
            if t.first != at:
                raise ValueError(f"rows of {name} are missing or double at {min(at, t.first)}")
            at += t.shape[0]
        out[name] = (parts[0].type, (at, *parts[0].shape[1:]))
    return out


def check_expected(found: list[Tensor], expected: dict[str, list[int]]) -> None:
    """The container has exactly the expected names, in the expected shapes."""
    shapes = {name: list(shape) for name, (_, shape) in whole_shapes(found).items()}
    if set(shapes) != set(expected):
        raise ValueError(f"names do not match: missing {sorted(set(expected) - set(shapes))}, unknown {sorted(set(shapes) - set(expected))}")
    for name, shape in expected.items():
        if shapes[name] != list(shape):
            raise ValueError(f"{name} has shape {shapes[name]}, not {list(shape)}")


@dataclass
class Rows(InputPartition):
    tensor: Tensor
    first: int
    count: int


class TensorReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.expected = options["path"], options.get("expected")
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.names: set[str] | None = None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            names = {f.value} if isinstance(f, EqualTo) and f.attribute == ("name",) else set(f.value) if isinstance(f, In) and f.attribute == ("name",) else None
            if names is None:
                yield f
            else:
                self.names = names if self.names is None else self.names & names

    def partitions(self) -> list[Rows]:
        found = tensors(self.path)
        if self.expected:
            check_expected(found, json.loads(self.expected))
        else:
            whole_shapes(found)
        out = []
        for t in found:
            if self.names is None or t.name in self.names:
                step = max(1, self.range_bytes // max(1, t.row_bytes))
                out += [Rows(t, a, min(step, t.shape[0] - a)) for a in range(0, t.shape[0], step)]
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        t, width = partition.tensor, math.prod(partition.tensor.shape[1:])
        step = max(1, BATCH // max(1, width))
        for a in range(partition.first, partition.first + partition.count, step):
            n = min(step, partition.first + partition.count - a)
            values = np.frombuffer(stores.read_range(t.file, t.start + a * t.row_bytes, n * t.row_bytes), TYPES[t.type]).astype(float)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([pa.array([t.name] * n), pa.array(np.arange(a, a + n) + t.first, pa.int64()), lists], ["name", "row", "values"])


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    parts: dict[str, int]


class TensorWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.types, self.shapes = json.loads(options.get("types", "{}")), json.loads(options.get("shapes", "{}"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Rows of a task to one file. They must be sorted by name and row."""
        rows: dict[str, list[np.ndarray]] = {}
        first: dict[str, int] = {}
        held: dict[str, int] = defaultdict(int)
        width: dict[str, int] = {}
        for batch in iterator:
            names, row, values = (batch.column(batch.schema.get_field_index(c)) for c in ("name", "row", "values"))
            ends = np.concatenate([[0], np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
            flat, at = values.flatten().to_numpy(zero_copy_only=False), row.to_numpy(zero_copy_only=False)
            for k, name in enumerate(names.to_pylist()):
                kind = self.types.get(name, "F32")
                part = flat[ends[k] : ends[k + 1]].astype(TYPES[kind])
                if first.setdefault(name, int(at[k])) + held[name] != at[k]:
                    raise ValueError(f"rows of {name} are not consecutive at {at[k]}")
                if width.setdefault(name, len(part)) != len(part):
                    raise ValueError(f"rows of {name} differ in length at {at[k]}")
                if kind.startswith("F") and not np.isfinite(part).all():
                    raise ValueError(f"{name} is not finite at {at[k]}")
                rows.setdefault(name, []).append(part)
                held[name] += 1
        if not rows:
            return Written(None, {})
        entries, offset = {}, 0
        for name, parts in rows.items():
            kind = self.types.get(name, "F32")
            shape = [len(parts), *(self.shapes.get(name) or [width[name]])]
            size = len(parts) * width[name] * np.dtype(TYPES[kind]).itemsize
            if math.prod(shape[1:]) != width[name]:
                raise ValueError(f"rows of {name} have {width[name]} numbers, not {shape[1:]}")
            entries[name] = {"dtype": kind, "shape": shape, "data_offsets": [offset, offset + size]}
            offset += size
        text = json.dumps(entries).encode()
        file = f"part-{uuid.uuid4().hex}.tensors"
        stores.write_file(f"{self.path}/{file}", (x for x in [struct.pack("<Q", len(text)), text, *(b"".join(p.tobytes() for p in parts) for parts in rows.values())]))
        return Written(file, first)

    def commit(self, messages: list[Written | None]) -> None:
        files = {m.file: m.parts for m in messages if m is not None and m.file}
        fs, at = stores.file_system(self.path)
        if not self.overwrite and fs.get_file_info(f"{at}/{INDEX}").type == pafs.FileType.File:
            self.abort(messages)
            raise FileExistsError(f"{self.path} is complete already")
        # checks that the parts make whole tensors before they count
        found = [Tensor(**(t.__dict__ | {"first": parts[t.name]})) for file, parts in files.items() for t in header(f"{self.path}/{file}")]
        try:
            whole_shapes(found)
        except ValueError:
            self.abort(messages)
            raise
        if self.overwrite:
            stores.delete_file(f"{self.path}/{INDEX}")
        stores.write_file(f"{self.path}/{INDEX}", iter([json.dumps({"files": files}, sort_keys=True).encode()]))

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and m.file:
                stores.delete_file(f"{self.path}/{m.file}")


class TensorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TensorReader:
        return TensorReader(self.options)

    def writer(self, schema, overwrite: bool) -> TensorWriter:
        return TensorWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TensorSource)


def read(spark: SparkSession, path: str, expected: dict[str, list[int]] | None = None) -> DataFrame:
    register(spark)
    reader = spark.read.format("tensors").option("path", path)
    return (reader.option("expected", json.dumps(expected)) if expected is not None else reader).load()


def write(rows: DataFrame, path: str, types: dict[str, str] | None = None, shapes: dict[str, list[int]] | None = None) -> None:
    """Writes (name, row, values); rows of each name are 0, 1, 2, ... types: F32 where nothing else is said; shapes: of a row."""
    register(rows.sparkSession)
    rows = rows.selectExpr("name", "CAST(row AS LONG) AS row", "CAST(values AS ARRAY<DOUBLE>) AS values")
    dealt = rows.repartitionByRange("name", "row").sortWithinPartitions("name", "row")
    dealt.write.format("tensors").option("path", path).option("types", json.dumps(types or {})).option("shapes", json.dumps(shapes or {})).mode("append").save()
