"""Packed rasters: masks, resampling, templates and semantic crops."""

import numpy as np
import pyarrow as pa
import pytest

from sondera.operators import rasters
from sondera.sources import caches


def test_ring_and_nested_rings_are_filled():
    ring = np.zeros((9, 9), bool)
    ring[2:7, 2:7] = True
    ring[3:6, 3:6] = False
    full = np.zeros((9, 9), bool)
    full[2:7, 2:7] = True
    assert (rasters.fill_holes(ring) == full).all()
    nested = ring.copy()
    nested[4, 4] = True
    assert (rasters.fill_holes(nested) == full).all()
    open_ring = ring.copy()
    open_ring[2, 4] = False  # background comes in
    assert (rasters.fill_holes(open_ring) == open_ring).all()
    corner = ring.copy()
    corner[2, 2] = False  # a diagonal gap lets nothing in
    assert rasters.fill_holes(corner)[3:6, 3:6].all() and not rasters.fill_holes(corner)[2, 2]


def plain_fill(mask):
    h, w = mask.shape
    out, todo = np.zeros_like(mask), [(y, x) for y in range(h) for x in range(w) if y in (0, h - 1) or x in (0, w - 1)]
    while todo:
        y, x = todo.pop()
        if 0 <= y < h and 0 <= x < w and not mask[y, x] and not out[y, x]:
            out[y, x] = True
            todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    return ~out


def plain_dilate(mask, r):
    h, w = mask.shape
    out = np.zeros_like(mask)
    for y, x in np.argwhere(mask):
        for dy, half in zip(range(-r, r + 1), rasters.ellipse(r)):
            if 0 <= y + dy < h:
                out[y + dy, max(0, x - half) : x + half + 1] = True
    return out


def test_masks_against_plain_versions():
    rng = np.random.default_rng(3)
    for _ in range(60):
        mask = rng.random((rng.integers(1, 24), rng.integers(1, 24))) < rng.choice([0.1, 0.4, 0.7])
        assert (rasters.fill_holes(mask) == plain_fill(mask)).all()
        for r in (1, 2, 5):
            assert (rasters.dilate(mask, r) == plain_dilate(mask, r)).all()
            closed = rasters.close(mask, r)
            assert (closed == ~plain_dilate(~plain_dilate(mask, r), r)).all() and (closed | mask == closed).all()


def test_expansion_keeps_the_object_and_crops_it():
    mask = np.zeros((20, 30), np.uint8)
    mask[4:16, 8:22] = 1
    mask[8:12, 12:18] = 255
    grown = rasters.expand(mask == 1, 0, 0.1, 0.02)
    assert grown[mask == 1].all() and grown[8:12, 12:18].all()
    rows, cols = np.nonzero(grown)
    assert (cols.min(), rows.min(), cols.max() + 1, rows.max() + 1) == (6, 2, 24, 18)
    assert rasters.expand(np.zeros((20, 30), bool), 0.01, 0.1, 0.02) is None and rasters.expand(mask == 1, 0, 0, 0.5) is None


def test_masks_of_a_table(spark):
    a = np.zeros((6, 7), np.uint8)
    a[1:5, 1:5] = 1
    a[2:4, 2:4] = 0
    rows = [("ring", 6, 7, bytearray(a.tobytes())), ("empty", 6, 7, bytearray(42)), ("null", 6, 7, None)]
    got = {r.k: r.data for r in rasters.expand_masks(spark.createDataFrame(rows, "k string, height int, width int, data binary"), "k", 0.0, 0.0, 0.01).collect()}
    assert np.frombuffer(got["ring"], np.uint8).reshape(6, 7)[1:5, 1:5].all() and got["empty"] is None and got["null"] is None
    assert rasters.expand_masks(spark.createDataFrame([], "k string, height int, width int, data binary"), "k", 0.0, 0.0, 0.01).count() == 0


@pytest.mark.parametrize("kind", ["bilinear", "bicubic", "box", "area", "nearest"])
def test_weights(kind):
    for source, target in ((14, 9), (9, 14), (17, 14), (23, 14), (1, 5), (5, 1), (7, 7)):
        t, s, w = rasters.axis_weights(source, target, kind)
        assert np.allclose(np.bincount(t, w, target), 1) and s.min() >= 0 and s.max() < source
    assert np.allclose(rasters.resample(np.arange(12.0).reshape(3, 4, 1), 3, 4, kind)[:, :, 0], np.arange(12.0).reshape(3, 4))
    assert np.allclose(rasters.resample(np.full((5, 8, 2), 7.0), 3, 11, kind), 7)


def test_known_values():
    row = np.array([[[0.0], [10.0], [20.0], [30.0]]])
    assert np.allclose(rasters.resample(row, 1, 8, "bilinear").ravel(), [0, 2.5, 7.5, 12.5, 17.5, 22.5, 27.5, 30])
    assert np.allclose(rasters.resample(row, 1, 2, "bilinear").ravel(), [5, 25])
    assert np.allclose(rasters.resample(row, 1, 2, "box").ravel(), [5, 25])
    assert np.allclose(rasters.resample(row, 1, 3, "area").ravel(), [2.5, 15, 27.5])
    assert np.allclose(rasters.resample(row, 1, 3, "box").ravel(), [0, 15, 30])  # whole pixels, by their centres
    assert rasters.resample(np.array([[[0], [255], [255]]]), 1, 2, "area", eight_bit=True).ravel().tolist() == [85, 255]


def test_differences_are_exact_and_ties_go_row_by_row():
    rng = np.random.default_rng(4)
    for shape, size in (((20, 17, 3), (6, 5, 3)), ((9, 9, 1), (9, 9, 1)), ((12, 30, 3), (1, 4, 3))):
        source, template = rng.integers(0, 256, shape, dtype=np.uint8), rng.integers(0, 256, size, dtype=np.uint8)
        mask = rng.random(size[:2]) < 0.6
        got = rasters.squared_differences(source, template, mask)
        for y in range(got.shape[0]):
            for x in range(got.shape[1]):
                part = source[y : y + size[0], x : x + size[1]].astype(int)
                assert got[y, x] == ((part - template.astype(int)) ** 2 * mask[:, :, None]).sum()
    tiled = np.tile(np.arange(100, 110, dtype=np.uint8).reshape(1, 10, 1), (30, 3, 1))
    assert rasters.locate(tiled, tiled[:10, 10:20])[:2] == (0, 0)


SETTINGS = {"object_ids": [2], "closing": 0.0, "dilation": 0.0, "least_area": 0.01, "image_size": 224, "grid_size": 14}


def face_labels():
    labels = np.zeros((224, 224), np.uint8)
    labels[42:182, 37:177] = 2
    return labels


def test_semantics_give_the_proposed_crop():
    source = np.repeat(np.indices((224, 224)).sum(0).astype(np.uint8)[:, :, None], 3, axis=2)
    crop = rasters.semantic_crop(face_labels(), source, source[42:182, 37:177], SETTINGS)
    assert crop.shape == (224, 224) and (crop == 2).all()


def test_template_recovers_another_crop_or_is_an_error():
    rng = np.random.default_rng(7)
    source = rng.integers(0, 256, (224, 224, 3), dtype=np.uint8)
    assert rasters.locate(source, source[16:220, 28:223], (37, 42, 177, 182))[:4] == (28, 16, 223, 220)
    dark = rng.integers(0, 35, (224, 224, 3), dtype=np.uint8)
    assert rasters.locate(dark, dark[23:209, 40:201], (37, 42, 177, 182))[:4] == (40, 23, 201, 209)
    with pytest.raises(ValueError, match="does not match"):
        rasters.locate(source, np.full((180, 180, 3), 255, np.uint8))
    with pytest.raises(ValueError, match="too little"):
        rasters.locate(source, np.zeros((50, 50, 3), np.uint8))
    with pytest.raises(ValueError, match="larger"):
        rasters.locate(source, np.zeros((300, 50, 3), np.uint8))


def test_cache_goes_on_quarantines_and_refuses_other_settings(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(5):
        labels = np.zeros((40, 40), np.uint8)
        labels[8:30, 6:34] = 2 if k != 3 else 0  # 3 has no object
        source = rng.integers(0, 256, (40, 40, 3), dtype=np.uint8)
        template = source[8:30, 6:34] if k != 4 else rng.integers(0, 256, (22, 28, 3), dtype=np.uint8)  # 4 is of another image
        row = (k,)
        for a in (labels, source, template):
            p = rasters.packed(a)
            row += (p["height"], p["width"], bytearray(p["data"]))
        rows.append(row)
    columns = "k int, " + ", ".join(f"{p}_height int, {p}_width int, {p}_data binary" for p in ("labels", "source", "template"))
    pairs = spark.createDataFrame(rows, columns)
    settings = SETTINGS | {"image_size": 28, "grid_size": 7}
    path, seen = f"file://{tmp_path}/cache", []

    def work(todo):
        seen.append(sorted(r.k for r in todo.select("k").collect()))
        return rasters.semantic_grids(todo, "k", settings)

    caches.update(spark, path, pairs.where("k IN (0, 3)"), "k", settings, work)
    done = {r.k: r for r in caches.update(spark, path, pairs, "k", settings, work).collect()}
    assert seen == [[0, 3], [1, 2, 4]]
    assert all(set(done[k].grid) == {2} and len(done[k].grid) == 49 for k in (0, 1, 2))
    assert "do not give" in done[3].reason and "does not match" in done[4].reason and done[3].grid is done[4].grid is None
    with pytest.raises(ValueError, match="grid_size"):
        caches.update(spark, path, pairs, "k", settings | {"grid_size": 14}, work)


def test_what_is_made_of_rasters_goes_on_in_small_batches(spark, monkeypatch):
    """A worker holds so many rows or pixels at a time, whatever is made of a batch."""
    from sondera.operators import rasters

    maps = []
    monkeypatch.setattr(rasters, "arrow_map", lambda df, run, schema: maps.append(run))
    monkeypatch.setattr(rasters, "OUT_PIXELS", 50)
    monkeypatch.setattr(rasters, "OUT_ROWS", 16)
    a = np.arange(12 * 10, dtype=np.uint8).reshape(12, 10)
    rows = spark.createDataFrame([("a", 12, 10, a.tobytes()), ("b", 12, 10, None)], "k string, height int, width int, data binary")
    rasters.pixels_of(rows, "k")
    rasters.each_row(rows, lambda r: ({"k": r["k"], "n": n} for n in range(100)), "k string, n int")
    batch = pa.Table.from_pylist([r.asDict() for r in rows.collect()], pa.schema([("k", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("data", pa.binary())])).to_batches()[0]
    pixels, each = (list(run([batch])) for run in maps)
    assert max(b.num_rows for b in pixels) <= 50 and max(b.num_rows for b in each) <= 16
    got = pa.Table.from_batches(pixels).to_pylist()
    assert [(r["k"], r["value"]) for r in got] == [("a", int(x)) for x in a.ravel()] and all(a[r["row"], r["col"]] == r["value"] for r in got)
    assert sum(b.num_rows for b in each) == 200
