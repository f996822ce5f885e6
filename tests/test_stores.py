"""Tensor containers, banks as arrays, digests."""

import hashlib
import json
import os
import resource
import struct

import numpy as np
import pytest

from sondera.sources import arrays, readers, stores, tensors


def rows_of(spark, n=40, name="w", dim=6):
    return spark.createDataFrame([(name, k, [float(k * dim + j) for j in range(dim)]) for k in range(n)], "name string, row long, values array<double>").repartition(3)


def test_round_trip_shapes_and_pushdown(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    both = rows_of(spark).unionByName(rows_of(spark, 7, "bias", 1))
    tensors.write(both, path, {"w": "F64", "bias": "I32"}, {"w": [2, 3]})
    assert tensors.whole_shapes(tensors.tensors(path)) == {"w": ("F64", (40, 2, 3)), "bias": ("I32", (7, 1))}
    got = tensors.read(spark, path, {"w": [40, 2, 3], "bias": [7, 1]}).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, both.collect()))
    reader = tensors.TensorReader({"path": path, "rangeBytes": "100"})
    every = len(reader.partitions())
    list(reader.pushFilters([tensors.EqualTo(("name",), "bias")]))
    assert {p.tensor.name for p in reader.partitions()} == {"bias"} and len(reader.partitions()) < every
    assert tensors.read(spark, path).where("name = 'bias'").count() == 7


def test_a_bare_file_is_read(spark, tmp_path):
    a = np.arange(12, dtype="<f2").reshape(4, 3)
    head = json.dumps({"__metadata__": {"k": "v"}, "a": {"dtype": "F16", "shape": [4, 3], "data_offsets": [0, 24]}}).encode()
    (tmp_path / "m.tensors").write_bytes(struct.pack("<Q", len(head)) + head + a.tobytes())
    got = {r.row: r["values"] for r in tensors.read(spark, f"file://{tmp_path}/m.tensors").collect()}
    assert [got[k] for k in range(4)] == a.tolist()


def test_what_does_not_fit_is_an_error(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    tensors.write(rows_of(spark), path)
    for expected, what in (({"v": [40, 6]}, "names"), ({"w": [41, 6]}, "shape"), ({}, "names")):
        with pytest.raises(Exception, match=what):
            tensors.read(spark, path, expected).collect()
    file = next(p for p in (tmp_path / "c").iterdir() if p.suffix == ".tensors")
    whole = file.read_bytes()
    file.write_bytes(whole[:-4])
    with pytest.raises(Exception, match="truncated"):
        tensors.read(spark, path).collect()
    file.write_bytes(whole[:5])
    with pytest.raises(Exception, match="no header"):
        tensors.read(spark, path).collect()
    file.write_bytes(whole)
    os.remove(tmp_path / "c/index.json")
    with pytest.raises(Exception, match="never completed"):
        tensors.read(spark, path).collect()


def test_writes_that_make_no_whole_tensors_leave_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    for bad in (rows_of(spark).where("row <> 5"), rows_of(spark).where("row > 0"), rows_of(spark).unionByName(rows_of(spark).where("row = 3"))):
        with pytest.raises(Exception):  # noqa: B017
            tensors.write(bad, path)
        assert not (tmp_path / "c/index.json").exists()
    tensors.write(rows_of(spark), path)
    with pytest.raises(Exception, match="complete already"):
        tensors.write(rows_of(spark), path)
    assert tensors.read(spark, path).count() == 40
    with pytest.raises(Exception, match="not finite"):
        tensors.write(spark.createDataFrame([("x", 0, [float("nan")])], "name string, row long, values array<double>"), f"file://{tmp_path}/n")


RECORD = {"plan": "p", "minimum": 0.5}


def built(spark, path):
    patches = spark.createDataFrame([(k, k // 3, k % 3, [k + 0.1, -k / 7]) for k in range(30)], "id int, source_idx int, patch_id int, embedding array<double>")
    arrays.write_bank(patches, path, ["id"], "embedding", ["source_idx", "patch_id"], RECORD, half=True)


def test_bank_as_arrays(spark, tmp_path):
    path = f"file://{tmp_path}/b"
    built(spark, path)
    rows = {r.row: r for r in arrays.aligned(arrays.load_bank(spark, path, RECORD), "embedding", ["source_idx", "patch_id"]).collect()}
    assert len(rows) == 30
    for k, r in rows.items():
        assert (r.source_idx, r.patch_id) == (k // 3, k % 3) and r.embedding == np.array([k + 0.1, -k / 7]).astype(np.float16).astype(float).tolist()


def test_damaged_banks_are_refused(spark, tmp_path):
    path = f"file://{tmp_path}/b"
    built(spark, path)
    with pytest.raises(ValueError, match="something else"):
        arrays.load_bank(spark, path, RECORD | {"plan": "q"})
    file = next(p for p in (tmp_path / "b/arrays").iterdir() if p.suffix == ".tensors")
    whole = file.read_bytes()
    for damage in (whole[:-1], whole[:-1] + bytes([whole[-1] ^ 1]), whole + b"x"):
        file.write_bytes(damage)
        with pytest.raises(ValueError, match="changed"):
            arrays.load_bank(spark, path, RECORD)
    os.remove(file)
    with pytest.raises(ValueError, match="missing"):
        arrays.load_bank(spark, path, RECORD)
    file.write_bytes(whole)
    assert arrays.load_bank(spark, path, RECORD).count() == 90
    (tmp_path / "b/complete.json").unlink()
    with pytest.raises(ValueError, match="incomplete"):
        arrays.load_bank(spark, path, RECORD)


def test_digests_hold_one_chunk(spark, tmp_path):
    (tmp_path / "d e").mkdir()
    big = tmp_path / "d e/big.bin"
    with big.open("wb") as f:
        for k in range(100):
            f.write(bytes([k % 256]) * (1 << 20))
    (tmp_path / "d e/empty.bin").write_bytes(b"")
    want = hashlib.sha256(b"".join(bytes([k % 256]) * (1 << 20) for k in range(100))).hexdigest()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert stores.digest(str(big), 1 << 20) == want
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 64 << 10  # KB
    got = {r.path.rpartition("/")[2]: r.sha256 for r in readers.file_digests(spark, f"file://{tmp_path}", "*.bin").collect()}
    assert got == {"big.bin": want} and stores.digest(str(tmp_path / "d e/empty.bin")) == hashlib.sha256(b"").hexdigest()
