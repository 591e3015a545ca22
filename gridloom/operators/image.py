"""Pixel kernels on numpy arrays, and how to run them over pages in Arrow batches."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_page(pages: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(page, height, width, data): the kernel over each gray page of (page, height, width, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, h, w, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = kernel(np.frombuffer(data, np.uint8).reshape(h, w))
                yield pa.RecordBatch.from_arrays([pa.array([page], batch.schema.field(0).type), pa.array([out.shape[0]], pa.int32()), pa.array([out.shape[1]], pa.int32()), pa.array([out.tobytes()])], ["page", "height", "width", "data"])

    kind = pages.schema["page"].dataType.simpleString()
    return pages.select("page", F.col("height").cast("int"), F.col("width").cast("int"), "data").mapInArrow(run, f"page {kind}, height int, width int, data binary")


def levels(pages: DataFrame) -> DataFrame:
    """(page, y, x, v): each pixel's value, in JVM expressions alone."""
    value = lambda i: F.conv(F.hex(F.substring("data", i, 1)), 16, 10).cast("int")
    at = F.posexplode(F.transform(F.sequence(F.lit(1), F.length("data")), value))
    flat = pages.where("length(data) > 0").select("page", "width", at.alias("i", "v"))
    return flat.select("page", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).cast("int").alias("x"), "v")


def pixels(pages: DataFrame, below: int = 128) -> DataFrame:
    """(page, y, x) of the dark pixels."""
    return levels(pages).where(F.col("v") < below).select("page", "y", "x")


def png(image: np.ndarray) -> bytes:
    """A gray image as a PNG file."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w = image.shape
    lines = b"".join(b"\0" + line.tobytes() for line in np.ascontiguousarray(image, np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def encoded(data: Column) -> Column:
    """Bytes as base64 text on one line."""
    return F.regexp_replace(F.base64(data), "[\r\n]", "")


def gray(image: np.ndarray) -> np.ndarray:
    """Luma of blue, green, red (and alpha) channels; two-dimensional images as they are."""
    if image.ndim == 2:
        return image.copy()
    if image.ndim != 3 or image.shape[2] not in (3, 4):
        raise ValueError("an image has two dimensions, or three with 3 or 4 channels")
    return np.rint(image[..., :3].astype(float) @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def window_sums(x: np.ndarray, size: int) -> np.ndarray:
    """Sums over size x size windows around each pixel, edges mirrored."""
    before, after = size // 2, size - size // 2 - 1
    s = np.pad(np.pad(x.astype(float), ((before, after), (before, after)), mode="reflect" if min(x.shape) > size // 2 else "edge").cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return s[size:, size:] - s[:-size, size:] - s[size:, :-size] + s[:-size, :-size]


def sauvola(image: np.ndarray, window: int = 25, k: float = 0.34, r: float = 128.0) -> np.ndarray:
    """255 where a pixel is over m (1 + k (s / r - 1)), with m and s of its window; else 0 (Sauvola and Pietikäinen, 2000)."""
    n = window * window
    m = window_sums(image, window) / n
    s = np.sqrt(np.maximum(window_sums(image.astype(float) ** 2, window) / n - m * m, 0))
    return np.where(image > m * (1 + k * (s / r - 1)), 255, 0).astype(np.uint8)


def labels(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """(label of each pixel, number of labels): 8-connected components from 1; 0 is background. Runs of each row are joined to touching runs of the row above."""
    out = np.zeros(mask.shape, np.int32)
    parent: list[int] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above: list[tuple[int, int, int]] = []
    rows: list[tuple[int, int, int, int]] = []
    for y, line in enumerate(mask.astype(bool)):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], line.view(np.int8), [0]))))
        here = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            own = len(parent)
            parent.append(own)
            for c, d, other in above:
                if c <= b and d >= a:
                    x, z = root(own), root(other)
                    parent[max(x, z)] = min(x, z)
            here.append((a, b, own))
            rows.append((y, a, b, own))
        above = here
    number: dict[int, int] = {}
    for y, a, b, own in rows:
        out[y, a:b] = number.setdefault(root(own), len(number) + 1)
    return out, len(number)


def boxes(label: np.ndarray, n: int) -> np.ndarray:
    """A row (area, top, left, height, width, centre x, centre y) for each label."""
    y, x = np.nonzero(label)
    of = label[y, x] - 1
    area = np.bincount(of, minlength=n)
    out = np.zeros((n, 7))
    low_y, low_x, high_y, high_x = np.full(n, 1 << 30), np.full(n, 1 << 30), np.full(n, -1), np.full(n, -1)
    np.minimum.at(low_y, of, y)
    np.minimum.at(low_x, of, x)
    np.maximum.at(high_y, of, y)
    np.maximum.at(high_x, of, x)
    out[:] = np.stack([area, low_y, low_x, high_y - low_y + 1, high_x - low_x + 1, np.bincount(of, x, n) / np.maximum(area, 1), np.bincount(of, y, n) / np.maximum(area, 1)], axis=1)
    return out


def sparser(image: np.ndarray) -> np.ndarray:
    """The foreground mask: the rarer of dark and light."""
    dark = image < 128
    return dark if dark.sum() <= (~dark).sum() else ~dark


def denoised(image: np.ndarray, size: int = 3) -> np.ndarray:
    """Two-valued images lose foreground specks of fewer pixels than `size`; others get a median of an odd window."""
    if size <= 1:
        return image.copy()
    if len(np.unique(image)) <= 2:
        mask = sparser(image)
        label, n = labels(mask)
        small = np.concatenate(([False], np.bincount(label.ravel(), minlength=n + 1)[1:] < size))
        out = image.copy()
        out[small[label]] = 255 if (mask == (image < 128)).all() else 0
        return out
    size += size % 2 == 0
    padded = np.pad(image, size // 2, mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, (size, size)), axis=(2, 3)).astype(np.uint8)


def sampled(image: np.ndarray, x: np.ndarray, y: np.ndarray, nearest: bool, border: int = 255) -> np.ndarray:
    """Values at fractional places; the border's beyond the image."""
    h, w = image.shape
    pad = np.pad(image.astype(float), 1, constant_values=border)
    x, y = np.clip(x, -1, w) + 1, np.clip(y, -1, h) + 1
    if nearest:
        return pad[np.rint(y).astype(int), np.rint(x).astype(int)].astype(np.uint8)
    x0, y0 = np.minimum(x.astype(int), w), np.minimum(y.astype(int), h)
    fx, fy = x - x0, y - y0
    out = pad[y0, x0] * (1 - fx) * (1 - fy) + pad[y0, x0 + 1] * fx * (1 - fy) + pad[y0 + 1, x0] * (1 - fx) * fy + pad[y0 + 1, x0 + 1] * fx * fy
    return np.rint(out).astype(np.uint8)


def rotated(image: np.ndarray, angle: float) -> np.ndarray:
    """Turned by degrees, counter-clockwise, on the same canvas with a white border; below 0.1 a copy."""
    if abs(angle) < 0.1:
        return image.copy()
    h, w = image.shape
    a = np.deg2rad(angle)
    y, x = np.mgrid[:h, :w].astype(float)
    x, y = x - w / 2, y - h / 2
    return sampled(image, np.cos(a) * x - np.sin(a) * y + w / 2, np.sin(a) * x + np.cos(a) * y + h / 2, len(np.unique(image)) <= 2)


def skew(image: np.ndarray, most: float = 15.0, step: float = 0.25) -> float:
    """Degrees by which lines of ink lean, that the rotation by it levels: the angle with the most concentrated row sums; 0 without ink."""
    y, x = np.nonzero(sparser(image))
    if not len(x):
        return 0.0
    best, found = -1.0, 0.0
    for angle in sorted(np.arange(-most, most + step / 2, step), key=abs):
        at = np.rint(y * np.cos(np.deg2rad(angle)) - x * np.sin(np.deg2rad(angle))).astype(int)
        rows = np.bincount(at - at.min()).astype(float)
        score = float((rows * rows).sum())
        if score > best * (1 + 1e-9):
            best, found = score, float(angle)
    return found


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Each new pixel is the mean of the area that it covers (smaller), or lies between its neighbours (larger)."""

    def weights(n: int, m: int) -> np.ndarray:
        if m >= n:
            at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
            low = np.minimum(at.astype(int), max(n - 2, 0))
            out = np.zeros((m, n))
            out[np.arange(m), low] += 1 - (at - low)
            out[np.arange(m), np.minimum(low + 1, n - 1)] += at - low
            return out
        edge = np.arange(m + 1) * n / m
        over = np.minimum(edge[1:, None], np.arange(1, n + 1)) - np.maximum(edge[:-1, None], np.arange(n))
        return np.maximum(over, 0) * m / n

    return np.rint(weights(image.shape[0], height) @ image.astype(float) @ weights(image.shape[1], width).T).astype(np.uint8)


def narrowed(image: np.ndarray, most_width: int | None) -> tuple[np.ndarray, float]:
    """(image of at most that width, its scale)."""
    h, w = image.shape
    if most_width is None or w <= most_width:
        return image, 1.0
    return resized(image, max(1, round(h * most_width / w)), most_width), most_width / w


def closed(mask: np.ndarray, size: int, axis: int) -> np.ndarray:
    """A line mask with gaps of fewer than `size` pixels along the axis filled."""
    m = mask.astype(bool) if axis == 1 else mask.astype(bool).T
    out = m.copy()
    for line, row in zip(m, out, strict=True):
        at = np.flatnonzero(line)
        for a, b in zip(at[:-1], at[1:], strict=True):
            if 1 < b - a <= size:
                row[a:b] = True
    return out if axis == 1 else out.T


def opened(mask: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Only the runs of at least `size` pixels along the axis."""
    m = mask.astype(bool) if axis == 1 else mask.astype(bool).T
    edge = np.diff(np.pad(m.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (ys, a), (_, b) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    out = np.zeros(m.shape, bool)
    for y, s, e in zip(ys, a, b, strict=True):
        if e - s >= size:
            out[y, s:e] = True
    return out if axis == 1 else out.T


def long_thin(mask: np.ndarray, least: int, most: int, axis: int) -> np.ndarray:
    """Components of at least that length along the axis and at most that thickness across."""
    label, n = labels(mask)
    box = boxes(label, n)
    length, thickness = (box[:, 4], box[:, 3]) if axis == 1 else (box[:, 3], box[:, 4])
    return np.concatenate(([False], (length >= least) & (thickness <= most)))[label]


def character_height(image: np.ndarray, least_area: int = 10) -> int:
    """Median height of the ink's components of at least that area and at most an eighth of the page's height; 0 without any."""
    box = boxes(*labels(sparser(image)))
    heights = box[(box[:, 0] >= least_area) & (box[:, 3] <= max(8, image.shape[0] // 8)), 3]
    return int(np.median(heights)) if len(heights) else 0


def component_heights(pages: DataFrame, least_area: int = 10) -> DataFrame:
    """(page, height) of each dark component of at least that many pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, h, w, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = boxes(*labels(np.frombuffer(data, np.uint8).reshape(h, w) < 128))
                tall = found[found[:, 0] >= least_area, 3].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([page] * len(tall), batch.schema.field(0).type), pa.array(tall)], ["page", "height"])

    kind = pages.schema["page"].dataType.simpleString()
    return pages.select("page", F.col("height").cast("int"), F.col("width").cast("int"), "data").mapInArrow(run, f"page {kind}, height int")


def character_sizes(pages: DataFrame, least_area: int = 10) -> DataFrame:
    """(page, average_height, median_height, component_count) of each page's characters; the average is the median, in whole pixels, and all are 0 without any."""
    half = F.floor(F.median("height")).cast("int")
    found = component_heights(pages, least_area).groupBy("page").agg(half.alias("average_height"), half.alias("median_height"), F.count("*").alias("component_count"))
    return pages.select("page").join(found, "page", "left").fillna(0, ["average_height", "median_height", "component_count"])


def deskewed(pages: DataFrame) -> DataFrame:
    """(page, height, width, data, angle): each gray page turned upright by its own skew; `angle` is by how many degrees, so that other images of the page can be turned alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, h, w, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(data, np.uint8).reshape(h, w)
                angle = float(skew(own))
                yield pa.RecordBatch.from_arrays([pa.array([page], batch.schema.field(0).type), pa.array([h], pa.int32()), pa.array([w], pa.int32()), pa.array([rotated(own, angle).tobytes()]), pa.array([angle])], ["page", "height", "width", "data", "angle"])

    kind = pages.schema["page"].dataType.simpleString()
    return pages.select("page", F.col("height").cast("int"), F.col("width").cast("int"), "data").mapInArrow(run, f"page {kind}, height int, width int, data binary, angle double")


def turned_alike(pages: DataFrame, angles: DataFrame) -> DataFrame:
    """(page, height, width, data): pages turned by the angle of (page, angle); the image that lines are looked for in and the one that cells are cut from share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, h, w, data, angle in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = rotated(np.frombuffer(data, np.uint8).reshape(h, w), angle)
                yield pa.RecordBatch.from_arrays([pa.array([page], batch.schema.field(0).type), pa.array([h], pa.int32()), pa.array([w], pa.int32()), pa.array([out.tobytes()])], ["page", "height", "width", "data"])

    kind = pages.schema["page"].dataType.simpleString()
    both = pages.select("page", F.col("height").cast("int"), F.col("width").cast("int"), "data").join(angles.select("page", "angle"), "page")
    return both.select("page", "height", "width", "data", "angle").mapInArrow(run, f"page {kind}, height int, width int, data binary")


def crossing_gate(mask: np.ndarray, other: np.ndarray, least: int) -> np.ndarray:
    """Components of the mask that touch at least `least` distinct components of the other."""
    label, n = labels(mask)
    wide = np.pad(mask, 1)
    wide = np.maximum.reduce([wide[a : a + mask.shape[0], b : b + mask.shape[1]] for a in range(3) for b in range(3)])
    theirs, _ = labels(other)
    grown = np.maximum.reduce([np.pad(label, 1)[a : a + mask.shape[0], b : b + mask.shape[1]] for a in range(3) for b in range(3)])
    both = np.unique(np.stack([grown[wide & (theirs > 0)], theirs[wide & (theirs > 0)]]), axis=1)
    return np.concatenate(([False], np.bincount(both[0], minlength=n + 1)[1:] >= least))[label]


@dataclass(frozen=True)
class Lines:
    """Masks of a form's horizontal and vertical rules."""

    horizontal: np.ndarray
    vertical: np.ndarray


def ruled_lines(image: np.ndarray, scale: float = 1.55, shortest: float | None = None) -> Lines:
    """Rules of a two-valued page: long runs with small gaps closed, thin and long components, that cross the other direction."""
    ink = sparser(image)
    h, w = image.shape
    char = max(1, character_height(image))
    across = max(3, int(char * scale), w // 32)
    down = max(3, int(0.6 * across), h // 80)
    rows = closed(opened(ink, across, 1), min(max(across // 4, 1), max(1, w // 180)), 1)
    cols = closed(opened(ink, down, 0), min(max(down // 2, 1), max(1, h // 180)), 0)
    long_row, long_col = max(18, min(int(0.08 * w), 2 * across)), max(14, min(int(0.08 * h), 3 * down))
    if shortest is not None:
        long_row = min(long_row, max(3, round(w * shortest)))
    thick = max(2, min(24, 2 * char))
    rows, cols = long_thin(rows, long_row, thick, 1), long_thin(cols, long_col, thick, 0)
    if not cols.any():
        cols = long_thin(opened(ink, max(3, int(0.8 * down)), 0), max(14, int(0.55 * long_col)), thick, 0)
    least = 1 if h < 200 else 2
    cols = crossing_gate(cols, rows, least)
    rows = crossing_gate(rows, cols, least)
    return Lines(rows, crossing_gate(cols, rows, least))


def crossing_points(lines: Lines) -> list[tuple[int, int]]:
    """(x, y) of the crossings of rules, small and roundish ones only."""
    label, n = labels(lines.horizontal & lines.vertical)
    area = label.size
    least, share, aspect = (1, 0.02, 4.0) if area < 10_000 else (2, 0.005, 3.0)
    box = boxes(label, n)
    sides = box[:, 3:5]
    good = (box[:, 0] >= least) & (box[:, 0] <= share * area) & (sides.max(axis=1, initial=1) <= aspect * np.maximum(sides.min(axis=1, initial=1 << 30), 1))
    return [(int(x), int(y)) for x, y in box[good, 5:7]]


def quad(mask: np.ndarray, least_share: float = 0.05) -> np.ndarray | None:
    """Corners, from the upper left clockwise, of the largest component that covers 5 % of the page with its box; else null."""
    label, n = labels(mask)
    box = boxes(label, n)
    if not n or (size := box[:, 3] * box[:, 4]).max() < least_share * mask.size:
        return None
    y, x = np.nonzero(label == int(size.argmax()) + 1)
    at = [(x + y).argmin(), (y - x).argmin(), (x + y).argmax(), (y - x).argmax()]
    return np.stack([x[at], y[at]], axis=1).astype(float)


def upright(image: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """The quadrilateral's inside as a rectangle of its longer edges."""
    d = lambda a, b: float(np.hypot(*(corners[a] - corners[b])))
    w, h = max(1, round(max(d(0, 1), d(3, 2)))), max(1, round(max(d(0, 3), d(1, 2))))
    flat = np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], float)
    rows = [r for (u, v), (x, y) in zip(flat, corners, strict=True) for r in ([u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y])]
    m = np.append(np.linalg.lstsq(np.array(rows), corners.ravel(), rcond=None)[0], 1).reshape(3, 3)
    v, u = np.mgrid[:h, :w].astype(float)
    z = m[2, 0] * u + m[2, 1] * v + m[2, 2]
    return sampled(image, (m[0, 0] * u + m[0, 1] * v + m[0, 2]) / z, (m[1, 0] * u + m[1, 1] * v + m[1, 2]) / z, False)


def cell_image(image: np.ndarray, ink: int = 200, pad: int = 8, border: int = 12, height: int = 64, most_scale: float = 4.0) -> np.ndarray:
    """A cell's crop for a recognizer: light ground, cropped to its ink, brought to a height, with a white border."""
    out = 255 - image if image.mean() < 127 else image
    y, x = np.nonzero(out < ink)
    if len(x) >= 2:
        out = out[max(0, y.min() - pad) : y.max() + 1 + pad, max(0, x.min() - pad) : x.max() + 1 + pad]
    scale = min(most_scale, height / out.shape[0])
    if abs(scale - 1) >= 0.05:
        out = resized(out, max(1, round(out.shape[0] * scale)), max(1, round(out.shape[1] * scale)))
    return np.pad(out, border, constant_values=255)


def traced(image: np.ndarray, x: int, radius: int, cost: float = 0.15, least: float = 0.55) -> np.ndarray | None:
    """x of a border on each line, near x, moving by at most a pixel a line: the path with the most ink; null if under 55 % of it is."""
    h, w = image.shape
    lo, hi = max(0, x - radius), min(w, x + radius + 1)
    ink = (image[:, lo:hi] < 128).astype(float)
    score, back = ink[0].copy(), np.zeros(ink.shape, np.int8)
    for y in range(1, h):
        pad = np.pad(score, 1, constant_values=-1e9)
        moves = np.stack([pad[1:-1], pad[:-2] - cost, pad[2:] - cost])
        step = moves.argmax(axis=0)
        back[y] = np.array([0, -1, 1])[step]
        score = moves[step, np.arange(len(step))] + ink[y]
    path = np.zeros(h, int)
    path[-1] = int(score.argmax())
    for y in range(h - 1, 0, -1):
        path[y - 1] = path[y] + back[y, path[y]]
    return path + lo if ink[np.arange(h), path].mean() >= least else None


def redacted(image: np.ndarray, ranges: list[tuple[np.ndarray | int, np.ndarray | int]], overfill: int = 2) -> np.ndarray:
    """The image with columns painted white between left and right edges, which may be a number or one for each line."""
    out = image.copy()
    x = np.arange(image.shape[1])[None, :]
    for left, right in ranges:
        a, b = (np.broadcast_to(np.asarray(v), image.shape[:1])[:, None] for v in (left, right))
        out[(x >= a - overfill) & (x <= b + overfill)] = 255
    return out


def preview(image: np.ndarray, width: int = 40, ramp: str = "@%#*+=-:. ") -> list[str]:
    """Rows of characters, dark to light."""
    small = resized(image, max(1, round(image.shape[0] * width / image.shape[1] / 2)), width)
    return ["".join(ramp[min(len(ramp) - 1, int(v) * len(ramp) // 256)] for v in line) for line in small]


def fold(stages: list[Callable[[DataFrame], DataFrame]], df: DataFrame) -> DataFrame:
    """df through the stages, from first to last."""
    for stage in stages:
        df = df.transform(stage)
    return df
