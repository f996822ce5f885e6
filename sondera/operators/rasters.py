"""Packed rasters: one image a row (height, width, channels, data: 8-bit values row by row), so that work on an image needs no
shuffle. Masks are expanded (closing, dilation, holes filled), rasters resampled with weights, and templates found in images.

What can fail for one image is returned as its reason, so that the others go on.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import arrow_map, ship

# Falling brightness that tells foreground, and the largest mean error of a match.
FOREGROUND_LADDER = (32, 24, 16, 12, 8, 4, 2, 1, 0)
MOST_ERROR = 20.0
#: A match needs so much visible foreground: pixels, or a share of the template.
LEAST_FOREGROUND, LEAST_FOREGROUND_SHARE = 64, 0.01
#: Brightness above which a pixel is foreground when patches are filtered.
BRIGHT = 16
#: Bytes of rasters that a worker has at hand at a time.
BATCH_BYTES = 32 << 20
#: Rows that a worker makes at a time, and pixels.
OUT_ROWS, OUT_PIXELS = 4096, 1 << 16


def each_row(df: DataFrame, function: Callable[[dict], Iterator[dict]], schema: str) -> DataFrame:
    """Rows of a table, made by a function of one row; batches are worked on a few rows at a time, and what is made goes on as it comes."""
    kind = StructType.fromDDL(schema)
    fields = kind.names

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kind)
        table = lambda out: pa.RecordBatch.from_pydict({f: [r[f] for r in out] for f in fields}, schema=arrow)
        for batch in batches:
            step = max(1, min(OUT_ROWS, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                out, size = [], 0
                for row in batch.slice(at, step).to_pylist():
                    for r in function(row):
                        out.append(r)
                        size += sum(len(x) for x in r.values() if isinstance(x, bytes))
                        if len(out) >= OUT_ROWS or size >= BATCH_BYTES:
                            yield table(out)
                            out, size = [], 0
                if out:
                    yield table(out)

    return arrow_map(df, run, schema)


def raster(row: dict, name: str = "") -> np.ndarray:
    """The raster of a row as height x width x channels; name is before the column names."""
    a = np.frombuffer(row[f"{name}data"], np.uint8)
    return a.reshape(row[f"{name}height"], row[f"{name}width"], -1)


def packed(a: np.ndarray, name: str = "") -> dict:
    a = a[:, :, None] if a.ndim == 2 else a
    return {f"{name}height": a.shape[0], f"{name}width": a.shape[1], f"{name}channels": a.shape[2], f"{name}data": np.ascontiguousarray(a, np.uint8).tobytes()}


RASTER = "height int, width int, channels int, data binary"


def pack(pixels: DataFrame, image: str, height: int, width: int, values: list[str], fill: int = 0) -> DataFrame:
    """(image, height, width, channels, data) of pixels (image, row, col, values...), a shuffle by image. Pixels that are missing have
    the fill; of several at one place the largest counts; those off the frame are an error."""
    kind = dict(pixels.dtypes)[image]

    def one(table: pa.Table) -> pa.Table:
        a = np.full((height, width, len(values)), fill, np.uint8)
        row, col = (table.column(c).to_numpy() for c in ("row", "col"))
        v = np.stack([table.column(c).to_numpy() for c in values], axis=1)
        if len(row) and (row.min() < 0 or col.min() < 0 or row.max() >= height or col.max() >= width):
            raise ValueError(f"pixels off a frame of {width}x{height}")
        for c in range(len(values)):
            order = np.argsort(v[:, c], kind="stable")
            a[row[order], col[order], c] = v[order, c]
        out = {image: [table.column(image)[0].as_py()]} | {k: [x] for k, x in packed(a).items()}
        return pa.table({image: pa.array(out[image], table.schema.field(image).type), "height": pa.array(out["height"], pa.int32()), "width": pa.array(out["width"], pa.int32()), "channels": pa.array(out["channels"], pa.int32()), "data": pa.array(out["data"], pa.binary())})

    ship(pixels.sparkSession)
    return pixels.select(image, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *[F.col(c).cast("int").alias(c) for c in values]).groupBy(image).applyInArrow(one, f"{image} {kind}, {RASTER}")


# ---------------------------------------------------------------- masks


@lru_cache(64)
def ellipse(radius: int) -> tuple[int, ...]:
    """Half widths of an ellipse's rows, from -radius to radius."""
    dy = np.arange(-radius, radius + 1)
    return tuple(np.rint(radius * np.sqrt((radius * radius - dy * dy) / (radius * radius))).astype(int)) if radius else (0,)


def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    """Pixels under an ellipse about any pixel of a boolean mask; what is beyond the frame counts for nothing."""
    h, w = mask.shape
    before = np.zeros((h, w + 1), np.int32)
    np.cumsum(mask, axis=1, out=before[:, 1:])
    at, out, wide = np.arange(w), np.zeros_like(mask), {}
    for dy, half in zip(range(-radius, radius + 1), ellipse(radius)):
        if abs(dy) >= h:
            continue
        if half not in wide:
            wide[half] = before[:, np.minimum(at + half, w - 1) + 1] > before[:, np.maximum(at - half, 0)]
        rows = wide[half]
        out[max(0, dy) : h + min(0, dy)] |= rows[max(0, -dy) : h - max(0, dy)]
    return out


def close(mask: np.ndarray, radius: int) -> np.ndarray:
    """Dilation, then erosion: gaps that the ellipse cannot enter are closed."""
    return ~dilate(~dilate(mask, radius), radius)


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """The mask with all background that does not reach the edge by steps along rows and columns: runs of background are joined with
    those they touch in the row above by union-find, and with the outside at the edge."""
    h, w = mask.shape
    edges = np.diff(np.pad(~mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edges == 1)
    _, end = np.nonzero(edges == -1)
    root = list(range(len(row) + 1))  # the last is the outside

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    outside = len(row)
    for i in np.flatnonzero((row == 0) | (row == h - 1) | (start == 0) | (end == w)):
        root[find(int(i))] = find(outside)
    first = np.searchsorted(row, np.arange(h + 1))
    for y in range(1, h):
        i, j = int(first[y - 1]), int(first[y])
        while i < first[y] and j < first[y + 1]:
            if start[i] < end[j] and start[j] < end[i]:
                root[find(j)] = find(i)
            if end[i] <= end[j]:
                i += 1
            else:
                j += 1
    out, free = mask.copy(), find(outside)
    for i in range(len(row)):
        if find(i) != free:
            out[row[i], start[i] : end[i]] = True
    return out


def expand(mask: np.ndarray, closing: float, dilation: float, least: float, fill: bool = True) -> np.ndarray | None:
    """A mask closed, dilated (radii are shares of the shorter side, rounded up) and filled; None where it is empty or its share of
    the image is under the least."""
    if not mask.any() or mask.mean() < least:
        return None
    side = min(mask.shape)
    for step, ratio in ((close, closing), (dilate, dilation)):
        radius = math.ceil(side * ratio)
        mask = step(mask, radius) if radius else mask
    return fill_holes(mask) if fill else mask


def expand_masks(masks: DataFrame, image: str, closing: float, dilation: float, least: float, fill: bool = True) -> DataFrame:
    """(image, height, width, channels, data) of masks (image and a raster whose value 1 is the object, anything else is not): 1 where the
    expanded mask is. data is null where the mask is empty or too small, or itself null."""

    def one(row):
        found = None if row["data"] is None else expand(raster(row)[:, :, 0] == 1, closing, dilation, least, fill)
        empty = {"height": row["height"], "width": row["width"], "channels": 1, "data": None}
        yield {image: row[image]} | (empty if found is None else packed(found))

    return each_row(masks.select(image, "height", "width", "data"), one, f"{image} {dict(masks.dtypes)[image]}, {RASTER}")


def pixels_of(rasters: DataFrame, image: str) -> DataFrame:
    """(image, row, col, value) of the first channel of each raster; none of those without data."""

    schema, name = f"{image} {dict(rasters.dtypes)[image]}, row int, col int, value int", image
    kind = StructType.fromDDL(schema)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kind)
        for batch in batches:
            batch = batch.filter(batch.column("data").is_valid())
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                a = raster(one.to_pylist()[0])[:, :, 0]
                step = max(1, OUT_PIXELS // max(1, a.shape[1]))
                for top in range(0, a.shape[0], step):
                    part = a[top : top + step]
                    row, col = np.indices(part.shape, np.int32)
                    key = one.column(name).take(pa.array(np.zeros(part.size, np.int64)))
                    yield pa.RecordBatch.from_arrays([key, pa.array((row + np.int32(top)).ravel()), pa.array(col.ravel()), pa.array(part.ravel().astype(np.int32))], schema=arrow)

    return arrow_map(rasters.select(image, "height", "width", "data"), run, schema)


# ---------------------------------------------------------------- resampling


def _cubic(x: np.ndarray, a: float = -0.5) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, ((a + 2) * x - (a + 3)) * x * x + 1, np.where(x < 2, (((x - 5) * x + 8) * x - 4) * a, 0.0))


#: Filters that widen with the scale when an axis shrinks: (function, support).
FILTERS = {"bicubic": (_cubic, 2.0), "box": (lambda x: ((x > -0.5) & (x <= 0.5)).astype(float), 0.5)}


@lru_cache(256)
def axis_weights(source: int, target: int, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(target, source, weight) of an axis, as a sparse table with weights that sum to 1 for each target. bilinear: the two pixels whose
    centres are about that of the target, clamped at the edge; bicubic: a cubic over all pixels that the target covers; box: the mean
    of the pixels whose centre is in the target; area: pixels by the share of them that the target covers; nearest: the pixel
    under the target's centre."""
    scale, t = source / target, np.arange(target)
    centre = (t + 0.5) * scale
    if kind == "nearest":
        return t, np.minimum(np.floor(centre).astype(int), source - 1), np.ones(target)
    if kind == "bilinear":
        at = np.maximum(centre - 0.5, 0)
        low = np.minimum(np.floor(at).astype(int), source - 1)
        part = np.where(low + 1 < source, at - low, 0.0)
        both = np.stack([low, np.minimum(low + 1, source - 1)], axis=1), np.stack([1 - part, part], axis=1)
        return np.repeat(t, 2), both[0].ravel(), both[1].ravel()
    rows = []
    for k in range(target):
        if kind == "area":
            lo, hi = math.floor(k * scale), min(source, math.ceil((k + 1) * scale - 1e-12))
            s = np.arange(lo, hi)
            w = np.minimum(s + 1, (k + 1) * scale) - np.maximum(s, k * scale)
        else:
            f, support = FILTERS[kind]
            wide = max(scale, 1.0)
            lo, hi = max(0, int(centre[k] - support * wide + 0.5)), min(source, int(centre[k] + support * wide + 0.5))
            s = np.arange(lo, hi)
            w = f((s - centre[k] + 0.5) / wide)
        rows.append((np.full(len(s), k), s, w / w.sum()))
    return tuple(np.concatenate(x) for x in zip(*rows))


def _along(a: np.ndarray, size: int, kind: str) -> np.ndarray:
    """a (first axis resampled): weighted rows summed."""
    t, s, w = axis_weights(a.shape[0], size, kind)
    out = np.zeros((size, *a.shape[1:]))
    np.add.at(out, t, w.reshape(-1, *[1] * (a.ndim - 1)) * a[s])
    return out


def resample(a: np.ndarray, height: int, width: int, kind: str, eight_bit: bool = False) -> np.ndarray:
    """A raster (height x width x any) at another size, in two passes: along rows, then along columns. eight_bit rounds each pass to
    whole values of 0 to 255, as images in 8 bits are stored."""
    a = a.astype(float)
    for axis, size in ((1, width), (0, height)):
        a = np.moveaxis(_along(np.moveaxis(a, axis, 0), size, kind), 0, axis)
        if eight_bit:
            a = np.clip(np.floor(a + 0.5), 0, 255)
    return a


def resampled(rasters: DataFrame, image: str, height: int, width: int, kind: str) -> DataFrame:
    """(image, row, col, values): rasters of any size at one size, an array of a double per channel for each pixel."""

    def one(row):
        a = resample(raster(row), height, width, kind)
        for y in range(height):
            for x in range(width):
                yield {image: row[image], "row": y, "col": x, "values": a[y, x].tolist()}

    return each_row(rasters.select(image, "height", "width", "data").where("data is not null"), one, f"{image} {dict(rasters.dtypes)[image]}, row int, col int, values array<double>")


def occupancy(a: np.ndarray, rows: int, cols: int, kind: str = "box", eight_bit: bool = False) -> np.ndarray:
    """Share of each patch whose brightest channel is above BRIGHT."""
    return resample((a.max(axis=2) > BRIGHT) * 255.0, rows, cols, kind, eight_bit) / 255


def foreground(rasters: DataFrame, image: str, rows: int, cols: int, minimum: float, kind: str = "box") -> DataFrame:
    """(image, row, col, patch_id, occupancy) of the patches of a grid over each image that have the least share of foreground. An
    image without any is an error, for it could not be scored."""

    def one(row):
        share = occupancy(raster(row), rows, cols, kind)
        keep = np.argwhere(share >= minimum)
        if not len(keep):
            raise ValueError(f"no foreground patches: {row[image]}")
        for y, x in keep.tolist():
            yield {image: row[image], "row": y, "col": x, "patch_id": y * cols + x, "occupancy": float(share[y, x])}

    return each_row(rasters.select(image, "height", "width", "data"), one, f"{image} {dict(rasters.dtypes)[image]}, row int, col int, patch_id int, occupancy double")


# ---------------------------------------------------------------- templates


def visible(template: np.ndarray, least: int = LEAST_FOREGROUND) -> np.ndarray | None:
    """The template's foreground at the highest brightness of the ladder that leaves enough of it; None if none does."""
    bright = template.max(axis=2)
    enough = max(least, math.ceil(bright.size * LEAST_FOREGROUND_SHARE))
    return next((bright > t for t in FOREGROUND_LADDER if (bright > t).sum() >= enough), None)


def squared_differences(source: np.ndarray, template: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Sum over the mask of squared differences at every offset, exactly: by correlations in the frequency domain (squares of the
    source under the mask, less twice its product with the template, and the template's own), whose sums are whole numbers."""
    h, w = source.shape[0] - mask.shape[0] + 1, source.shape[1] - mask.shape[1] + 1
    shape = source.shape[:2]

    def correlate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.fft.irfft2(np.fft.rfft2(a) * np.conj(np.fft.rfft2(b, shape)), shape)[:h, :w]

    s, t, m = source.astype(float), template.astype(float), mask.astype(float)
    out = correlate((s * s).sum(axis=2), m) + (t * t * m[:, :, None]).sum()
    for c in range(s.shape[2]):
        out -= 2 * correlate(s[:, :, c], t[:, :, c] * m)
    return np.rint(out)


def locate(source: np.ndarray, template: np.ndarray, proposed: tuple[int, int, int, int] | None = None, most: float = MOST_ERROR, least: int = LEAST_FOREGROUND) -> tuple[int, int, int, int, float]:
    """(left, top, right, bottom, mean absolute error) of a template in a source. A proposed box of the right size stands if its error
    over the visible foreground is at most `most`; else the offset of least squared differences, the first in row-major order of
    equals. A template that is too large, too dark, or fits nowhere is a ValueError."""
    height, width = template.shape[:2]
    if height > source.shape[0] or width > source.shape[1]:
        raise ValueError(f"template of {width}x{height} is larger than its source")
    mask = visible(template, least)
    if mask is None:
        raise ValueError(f"template has too little visible foreground: max={template.max()}")

    def error(left: int, top: int) -> float:
        part = source[top : top + height, left : left + width].astype(float)
        return float(np.abs(part - template)[mask].mean())

    if proposed is not None:
        left, top, right, bottom = proposed
        inside = left >= 0 and top >= 0 and right <= source.shape[1] and bottom <= source.shape[0]
        if inside and (right - left, bottom - top) == (width, height) and error(left, top) <= most:
            return left, top, right, bottom, error(left, top)
    top, left = divmod(int(np.argmin(found := squared_differences(source, template, mask))), found.shape[1])
    if error(left, top) > most:
        raise ValueError(f"template does not match its source: mean error={error(left, top):.2f}")
    return left, top, left + width, top + height, error(left, top)


def find_templates(pairs: DataFrame, image: str, most: float = MOST_ERROR, least: int = LEAST_FOREGROUND) -> DataFrame:
    """(image, left, top, right, bottom, error, reason) of pairs (image, source_ and template_ rasters, box: array of left, top, right,
    bottom or null). Where there is no match all but the reason is null."""

    def one(row):
        out = dict.fromkeys(("left", "top", "right", "bottom", "error", "reason")) | {image: row[image]}
        try:
            found = locate(raster(row, "source_"), raster(row, "template_"), row["box"] and tuple(row["box"]), most, least)
            out |= dict(zip(("left", "top", "right", "bottom", "error"), found))
        except ValueError as e:
            out["reason"] = str(e)
        yield out

    columns = [f"{p}{c}" for p in ("source_", "template_") for c in ("height", "width", "data")]
    return each_row(pairs.select(image, *columns, "box"), one, f"{image} {dict(pairs.dtypes)[image]}, left int, top int, right int, bottom int, error double, reason string")


# ---------------------------------------------------------------- semantic crops


def majority_grid(labels: np.ndarray, grid: int) -> np.ndarray:
    """The most frequent label of each patch of a square raster, the least of equals."""
    side = labels.shape[0] // grid
    patches = labels[: side * grid, : side * grid].reshape(grid, side, grid, side).swapaxes(1, 2).reshape(grid * grid, -1)
    counts = np.stack([(patches == v).sum(axis=1) for v in range(256)])
    return counts.argmax(axis=0).astype(np.uint8).reshape(grid, grid)


def semantic_crop(labels: np.ndarray, source: np.ndarray, template: np.ndarray, settings: dict) -> np.ndarray:
    """Labels of a source image within the crop that its saved template shows, at the settings' image_size: the expanded mask of the
    object's labels proposes the crop's box, and the template confirms or moves it. A ValueError where there is no such crop."""
    mask = expand(np.isin(labels, settings["object_ids"]), settings["closing"], settings["dilation"], settings["least_area"])
    if mask is None:
        raise ValueError("the labels do not give the crop's mask")
    rows, cols = np.nonzero(mask)
    box = (int(cols.min()), int(rows.min()), int(cols.max()) + 1, int(rows.max()) + 1)
    left, top, right, bottom, _ = locate(source, template, box, least=settings.get("least_foreground", LEAST_FOREGROUND))
    size = settings["image_size"]
    _, y, _ = axis_weights(bottom - top, size, "nearest")
    _, x, _ = axis_weights(right - left, size, "nearest")
    return labels[top:bottom, left:right][np.ix_(y, x)]


def semantic_grids(pairs: DataFrame, image: str, settings: dict) -> DataFrame:
    """(image, grid: array of the labels of grid x grid patches, reason) of pairs (image, labels_, source_ and template_ rasters).
    An image that has no crop has its reason and a null grid."""

    def one(row):
        out = {image: row[image], "grid": None, "reason": None}
        try:
            crop = semantic_crop(raster(row, "labels_")[:, :, 0], raster(row, "source_"), raster(row, "template_"), settings)
            out["grid"] = majority_grid(crop, settings["grid_size"]).ravel().tolist()
        except ValueError as e:
            out["reason"] = str(e)
        yield out

    columns = [f"{p}{c}" for p in ("labels_", "source_", "template_") for c in ("height", "width", "data")]
    return each_row(pairs.select(image, *columns), one, f"{image} {dict(pairs.dtypes)[image]}, grid array<int>, reason string")
