"""Images as rows: pixels (page, y, x, v) and runs of ink (page, y, start, end), worked on by SQL functions, windows and joins.

Masks are runs, a few for each line of a page instead of a row for each pixel.
What looks at each byte of a page, or follows runs through a page, is a small kernel within the task that has the page.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gridloom.operators.image import levels


def byte(i: Column) -> Column:
    """The value of a page's byte, counted from 1."""
    return F.ascii(F.decode(F.substring("data", i, 1), "ISO-8859-1"))


def spread_out(pages: DataFrame, value) -> DataFrame:
    """(page, y, x, v) with v = value(y, x) for each place of a page of (page, height, width, ...)."""
    places = F.sequence(F.lit(0), F.col("height") * F.col("width") - 1)
    w = F.col("width")
    each = F.transform(places, lambda i: value(F.floor(i / w).cast("int"), (i % w).cast("int")))
    flat = pages.where("height * width > 0").select("page", "width", F.posexplode(each).alias("i", "v"))
    return flat.select("page", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).cast("int").alias("x"), "v")


def mirrored(place: Column, size: Column, before: int, after: int) -> Column:
    """Where a line's pixel stands in the line with mirrored ends: at its own place, and where it is a mirror image."""
    own = [F.when(F.lit(True), place)]
    left = F.when((place >= 1) & (place <= before), -place)
    right = F.when((place <= size - 2) & (place >= size - 1 - after), 2 * (size - 1) - place)
    return F.array_compact(F.array(*own, left, right))


def sauvola(pages: DataFrame, window: int = 25, k: float = 0.34, r: float = 128.0) -> DataFrame:
    """(page, y, x, v): 255 where a pixel is over m (1 + k (s / r - 1)), with m and s of its window, else 0; edges are mirrored.

    Sums run along lines, then down columns, so a pixel is read twice whatever
    the window's size. Pages have more lines and columns than half the window.
    """
    before, after = window // 2, window - window // 2 - 1
    rows = levels(pages).join(pages.select("page", F.col("height").cast("int"), F.col("width").cast("int")), "page")
    wide = rows.select("page", "height", "width", "y", "v", F.col("x").alias("own"), F.explode(mirrored(F.col("x"), F.col("width"), before, after)).alias("x"))
    across = W.partitionBy("page", "y").orderBy("x").rowsBetween(-before, after)
    sums = wide.withColumns({"a": F.sum("v").over(across), "b": F.sum(F.col("v") * F.col("v")).over(across)}).where("x between 0 and width - 1")
    tall = sums.select("page", "height", "x", "v", "a", "b", F.explode(mirrored(F.col("y"), F.col("height"), before, after)).alias("y"))
    down = W.partitionBy("page", "x").orderBy("y").rowsBetween(-before, after)
    whole = tall.withColumns({"a": F.sum("a").over(down), "b": F.sum("b").over(down)}).where("y between 0 and height - 1")
    n = float(window * window)
    m, q = F.col("a").cast("double") / n, F.col("b").cast("double") / n
    s = F.sqrt(F.greatest(q - m * m, F.lit(0.0)))
    return whole.select("page", "y", "x", F.when(F.col("v") > m * (F.lit(1.0) + F.lit(k) * (s / r - 1)), 255).otherwise(0).alias("v"))


def page_lines(data: pa.Buffer, width: int) -> np.ndarray:
    """A page's bytes as lines and columns; a last line that is cut short is left out, or filled with white if it is the only one."""
    values = np.frombuffer(data, np.uint8)
    values = values[: max(width, len(values) // width * width)]
    values = np.pad(values, (0, -len(values) % width), constant_values=255) if len(values) % width else values
    return values.reshape(-1, width)


def per_page(pages: DataFrame, columns: str, kernel: Callable[..., tuple[np.ndarray, ...]], more: str | None = None) -> DataFrame:
    """(page, and int columns) of the rows that kernel(values, and the value of the column `more`) gives for each page's bytes, as lines and columns."""
    fields = T._parse_datatype_string(", ".join(f"{c} int" for c in columns.split())).fields
    own = pages.where("length(data) > 0 and width > 0").select("page", F.col("width").cast("int").alias("width"), "data", F.lit(None).cast("int").alias("more") if more is None else F.col(more).alias("more"))
    schema = T.StructType([pages.schema["page"], *fields])
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for width, data, own_more in zip(batch["width"].to_pylist(), batch["data"], batch["more"].to_pylist(), strict=True):
                found.append(kernel(page_lines(data.as_buffer(), width), own_more))
            if found:
                page = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
                yield pa.RecordBatch.from_arrays([batch["page"].take(page), *(pa.array(np.concatenate(c).astype(np.int32)) for c in zip(*found, strict=True))], schema=types)

    return own.mapInArrow(run, schema)


def line_runs(ink: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, start, end) of the runs of each line, both ends within."""
    edge = np.zeros((ink.shape[0], ink.shape[1] + 1), bool)
    edge[:, :-1] = ink
    edge[:, 1:] ^= ink
    at = np.flatnonzero(edge)
    y, place = np.divmod(at, edge.shape[1])
    return y[::2], place[::2], place[1::2] - 1


def joined_runs(ink: np.ndarray, gap: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, start, end) of long_runs() of closed_runs() of one page's ink."""
    y, start, end = line_runs(ink)
    first, last = np.ones((2, len(y)), bool)
    first[1:] = last[:-1] = (y[1:] != y[:-1]) | (start[1:] - end[:-1] > gap)
    y, start, end = y[first], start[first], end[last]
    long = end - start + 1 >= size
    return y[long], start[long], end[long]


def ink_runs(pages: DataFrame, below: int = 128) -> DataFrame:
    """(page, y, start, end) of the dark runs of each line, both ends dark."""
    return per_page(pages, "y start end", lambda values, _: line_runs(values < below))


def runs_of(pixels: DataFrame) -> DataFrame:
    """(page, y, start, end) of the runs of given pixels (page, y, x)."""
    order = W.partitionBy("page", "y").orderBy("x")
    part = pixels.select("page", "y", "x", (F.col("x") - F.row_number().over(order)).alias("_k"))
    return part.groupBy("page", "y", "_k").agg(F.min("x").alias("start"), F.max("x").alias("end")).drop("_k")


def run_pixels(runs: DataFrame) -> DataFrame:
    """(page, y, x) of the pixels of runs."""
    return runs.select("page", "y", F.explode(F.sequence("start", "end")).alias("x"))


def long_runs(runs: DataFrame, size: int) -> DataFrame:
    """Runs of at least `size` pixels: what an opening along the line leaves."""
    return runs.where(F.col("end") - F.col("start") + 1 >= size)


def closed_runs(runs: DataFrame, size: int) -> DataFrame:
    """Runs with gaps of fewer than `size` pixels between them filled: what a closing along the line gives."""
    line = W.partitionBy("page", "y").orderBy("start")
    new = F.coalesce((F.col("start") - F.lag("end").over(line) > size).cast("int"), F.lit(1))
    marked = runs.withColumn("_new", new).withColumn("_k", F.sum("_new").over(line.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy("page", "y", "_k").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_k")


def whole_pages(rows: DataFrame, order: list[str], schema: T.StructType, kernel: Callable[[pa.Table], pa.Table], size: int = 1 << 20) -> DataFrame:
    """What kernel gives for tables of whole pages of rows (page, ...), in the given order; some `size` rows at a time, but a page is never cut. Rows without a page are left out."""
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if n >= size and len(batch):
                table = pa.Table.from_batches([*held, batch]).combine_chunks()
                cut = np.flatnonzero(changes(table["page"]))[-1]
                if cut:
                    yield from kernel(table.slice(0, cut).combine_chunks()).cast(types).to_batches()
                    batch = table.slice(cut).combine_chunks().to_batches()[0]
                    held, n = [], 0
            held.append(batch)
            n += len(batch)
        if n:
            yield from kernel(pa.Table.from_batches(held).combine_chunks()).cast(types).to_batches()

    return rows.where("page is not null").repartition("page").sortWithinPartitions("page", *order).mapInArrow(run, schema)


def changes(column: pa.ChunkedArray) -> np.ndarray:
    """Whether each value differs from the one before; the first does."""
    values = column.combine_chunks()
    return np.concatenate((np.ones(min(1, len(values)), bool), pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)))


def least_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of the nodes 0 to n - 1 that links a - b lead to from each."""
    label = np.arange(n)
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low < high
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, high[apart], low[apart])
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label = further


def touching(page: np.ndarray, y: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run, run of the line above that it touches) of runs in the order of page, y and start."""
    line = page * (y.max() - y.min() + 2) + y - y.min() + 1
    s, e = start - start.min() + 2, end - start.min() + 2
    wide = e.max() + 3
    before = (line - 1) * wide
    # of runs that overlap, as where a page's id comes twice, the furthest end so far bounds the search
    low = np.searchsorted(np.maximum.accumulate(line * wide + e), before + s - 1)
    many = np.maximum(np.searchsorted(line * wide + s, before + e + 1, "right") - low, 0)
    own = np.repeat(np.arange(len(y)), many)
    other = np.arange(len(own)) + np.repeat(low - np.cumsum(many) + many, many)
    near = e[other] >= s[own] - 1
    return own[near], other[near]


def components(runs: DataFrame) -> DataFrame:
    """runs with `label`: the smallest (y, start) of their 8-connected component, as y * 2^32 + start.

    Runs touch runs of the line above. They move once, to the task of their
    page, which labels many pages at a time.
    """
    own = runs.select("page", "y", "start", "end")

    def labelled(table: pa.Table) -> pa.Table:
        y, start, end = (table[c].to_numpy().astype(np.int64) for c in ("y", "start", "end"))
        first = least_linked(len(y), *touching(np.cumsum(changes(table["page"])), y, start, end))
        return table.append_column("label", pa.array((y[first] << 32) + start[first]))

    return whole_pages(own, ["y", "start"], T.StructType([*own.schema.fields, T.StructField("label", T.LongType())]), labelled)


def least_labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(page, node, label) with the least node that links (page, node, other), either way, lead to from each of the distinct (page, node)."""
    both = nodes.select("page", F.col("node").cast("long"), F.col("node").cast("long").alias("other")).unionByName(links.select("page", F.col("node").cast("long"), F.col("other").cast("long")))

    def labelled(table: pa.Table) -> pa.Table:
        page = np.cumsum(changes(table["page"])) - 1
        values, place = np.unique(np.concatenate((table["node"].to_numpy(), table["other"].to_numpy())), return_inverse=True)
        _, row, at = np.unique(np.tile(page, 2) * len(values) + place, return_index=True, return_inverse=True)
        label = place[row][least_linked(len(row), at[: len(page)], at[len(page) :])]
        return pa.table({"page": table["page"].take(pa.array(row % len(page))), "node": values[place[row]], "label": values[label]})

    return whole_pages(both, [], T.StructType([nodes.schema["page"], T.StructField("node", T.LongType()), T.StructField("label", T.LongType())]), labelled)


def component_boxes(labelled: DataFrame) -> DataFrame:
    """(page, label, area, top, left, height, width, x, y) of each component; x and y are its centre."""
    n = F.col("end") - F.col("start") + 1
    across = F.sum((F.col("start") + F.col("end")) * n / 2) / F.sum(n)
    return labelled.groupBy("page", "label").agg(F.sum(n).alias("area"), F.min("y").alias("top"), F.min("start").alias("left"), (F.max("y") - F.min("y") + 1).alias("height"), (F.max("end") - F.min("start") + 1).alias("width"), across.alias("x"), (F.sum(F.col("y") * n) / F.sum(n)).alias("y"))


def character_sizes(pages: DataFrame, least_area: int = 10) -> DataFrame:
    """(page, average_height, median_height, component_count) of the dark components of at least that many pixels; both heights are the whole part of the median, and all is 0 on a page without."""
    found = component_boxes(components(ink_runs(pages))).where(F.col("area") >= least_area)
    own = found.groupBy("page").agg(F.floor(F.median("height")).cast("int").alias("m"), F.count("*").alias("n"))
    out = pages.select("page").join(own, "page", "left")
    return out.select("page", F.coalesce("m", F.lit(0)).alias("average_height"), F.coalesce("m", F.lit(0)).alias("median_height"), F.coalesce("n", F.lit(0)).alias("component_count"))


def cleaned(pixels: DataFrame, size: int) -> DataFrame:
    """Two-valued pixels (page, y, x, v) whose specks of fewer than `size` pixels have the other value; ink is the rarer value of a page, dark of equals."""
    dark = F.col("v") < 128
    rarer = pixels.groupBy("page").agg((2 * F.count_if(dark) <= F.count("*")).alias("_dark"), F.min("v").alias("_low"), F.max("v").alias("_high"))
    rows = pixels.join(rarer, "page")
    ink = runs_of(rows.where(dark == F.col("_dark")).select("page", "y", "x"))
    labelled = components(ink)
    small = labelled.groupBy("page", "label").agg(F.sum(F.col("end") - F.col("start") + 1).alias("area")).where(F.col("area") < size)
    specks = run_pixels(labelled.join(small, ["page", "label"], "left_semi")).withColumn("_gone", F.lit(True))
    out = rows.join(specks, ["page", "y", "x"], "left")
    return out.select("page", "y", "x", F.when(F.col("_gone"), F.when(F.col("_dark"), 255).otherwise(0)).otherwise(F.col("v")).alias("v"))


def narrowed(pages: DataFrame, most_width: int) -> DataFrame:
    """(page, y, x, v): pages wider than most_width at that width, each pixel the mean of the area that it covers; others as they are."""
    h, w = F.col("height"), F.col("width")
    size = pages.select("page", h.cast("int"), w.cast("int")).withColumns({"th": F.when(w > most_width, F.greatest(F.lit(1), F.rint(h * most_width / w))).otherwise(h).cast("int"), "tw": F.least(w, F.lit(most_width)).cast("int")})

    def shares(place: Column, n: Column, m: Column) -> Column:
        """(to, by) of the places among m that a place among n lies under, and how much of each is it."""
        first, last = F.floor(place * m / n), F.least(m - 1, F.ceil((place + 1) * m / n) - 1)
        part = lambda t: (F.least((t + 1) * n / m, (place + 1).cast("double")) - F.greatest(t * n / m, place.cast("double"))) * m / n
        return F.transform(F.sequence(first.cast("int"), last.cast("int")), lambda t: F.struct(t.alias("to"), part(t).alias("by")))

    rows = levels(pages).join(size, "page")
    rows = rows.select("page", "v", F.col("x"), "width", "tw", F.inline(shares(F.col("y"), h, F.col("th"))))
    rows = rows.select("page", "v", F.col("to").alias("y"), F.col("by").alias("b"), F.inline(shares(F.col("x"), w, F.col("tw"))))
    return rows.groupBy("page", "y", F.col("to").alias("x")).agg(F.bround(F.sum(F.col("v") * F.col("b") * F.col("by")), 0).cast("int").alias("v"))


def between(x: Column, y: Column, height: Column, width: Column, nearest: bool = False, border: int = 255) -> Column:
    """The value at a fractional place of the page in `data`, from its four neighbours, or from the nearest one; the border's beyond the page."""

    def at(row: Column, col: Column) -> Column:
        inside = (row >= 0) & (row < height) & (col >= 0) & (col < width)
        return F.when(inside, byte((row * width + col + 1).cast("int"))).otherwise(border)

    def mixed(u: Column, t: Column) -> Column:
        x0, y0 = F.least(width - 1, F.floor(u)).cast("int"), F.least(height - 1, F.floor(t)).cast("int")
        fx, fy = u - x0, t - y0
        return F.bround(at(y0, x0) * (1 - fx) * (1 - fy) + at(y0, x0 + 1) * fx * (1 - fy) + at(y0 + 1, x0) * (1 - fx) * fy + at(y0 + 1, x0 + 1) * fx * fy, 0).cast("int")

    within = lambda v, most: F.least(most.cast("double"), F.greatest(F.lit(-1.0), v))
    if nearest:
        return at(F.rint(within(y, height)).cast("int"), F.rint(within(x, width)).cast("int"))
    return mixed(within(x, width), within(y, height))


def rotated(pages: DataFrame, angle: float, nearest: bool = False) -> DataFrame:
    """(page, y, x, v): gray pages turned by degrees, counter-clockwise, on the same canvas with a white border; below 0.1 as they are. Two-valued pages stay so with `nearest`."""
    if abs(angle) < 0.1:
        return levels(pages)
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    h, w = F.col("height"), F.col("width")

    def value(y: Column, x: Column) -> Column:
        u, t = x - w / 2, y - h / 2
        return between(F.lit(c) * u - F.lit(s) * t + w / 2, F.lit(s) * u + F.lit(c) * t + h / 2, h, w, nearest)

    return spread_out(pages, value)


def homography(corners: list[tuple[float, float]]) -> tuple[int, int, tuple[float, ...]]:
    """(height, width, to_source) by which the inside of four corners, from the upper left clockwise, becomes a rectangle of its longer edges."""
    d = lambda a, b: math.dist(corners[a], corners[b])
    w, h = max(1, round(max(d(0, 1), d(3, 2)))), max(1, round(max(d(0, 3), d(1, 2))))
    flat = [(0, 0), (w - 1, 0), (w - 1, h - 1), (0, h - 1)]
    rows = [r for (u, v), (x, y) in zip(flat, corners, strict=True) for r in ([u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y])]
    found = np.linalg.lstsq(np.array(rows, float), np.array(corners, float).ravel(), rcond=None)[0]
    return h, w, tuple(float(x) for x in found)


def warped(pages: DataFrame, to_source: tuple[float, ...], height: int, width: int) -> DataFrame:
    """(page, y, x, v) of a canvas of that size whose place (x, y) shows the page at ((a x + b y + c) / (g x + h y + 1), (d x + e y + f) / (...)), with to_source (a, b, c, d, e, f, g, h)."""
    a, b, c, d, e, f, g, h = to_source
    own = pages.select("page", F.lit(height).alias("height"), F.lit(width).alias("width"), F.col("height").alias("_h"), F.col("width").alias("_w"), "data")

    def value(y: Column, x: Column) -> Column:
        under = g * x + h * y + 1
        return between((a * x + b * y + c) / under, (d * x + e * y + f) / under, F.col("_h"), F.col("_w"))

    return spread_out(own, value)


def painted(pages: DataFrame, ranges: list[tuple[float, float]], overfill: int = 2) -> DataFrame:
    """(page, y, x, v): pages with columns white from `overfill` pixels before each range's left edge to as many after its right one."""
    gone = F.lit(False)
    for left, right in ranges:
        gone = gone | F.col("x").between(left - overfill, right + overfill)
    return levels(pages).withColumn("v", F.when(gone, 255).otherwise(F.col("v")))


def redaction_lines(ranges: DataFrame, tables: DataFrame, borders: DataFrame, curves: DataFrame | None = None) -> DataFrame:
    """(page, range, y, left, right, left_by, right_by): where each line of a redacted range begins and ends, and what says so.

    ranges has (page, range, left_index, right_index), the edges that bound it,
    and tables (page, top, bottom). An edge follows its curve (page, index, y, x) if
    that has every line of the table; else the border that matched_borders() found,
    straight from top to bottom; else it stays where the grid has it.
    """
    lines = tables.select("page", "top", "bottom", F.explode(F.sequence("top", F.col("bottom") - 1)).alias("y"))
    if curves is None:
        curves = borders.select("page", "index", F.lit(0).alias("y"), F.col("x").cast("double").alias("x")).limit(0)
    own = curves.join(tables.select("page", "top", "bottom"), "page").where("y >= top and y < bottom")
    whole = own.groupBy("page", "index").agg((F.countDistinct("y") == F.first(F.col("bottom") - F.col("top"))).alias("_whole")).where("_whole").drop("_whole")
    traced = own.join(whole, ["page", "index"]).groupBy("page", "index", "y").agg(F.min("x").cast("double").alias("_x"))
    edges = borders.join(lines, "page").join(traced, ["page", "index", "y"], "left")
    lean = F.col("top_x") + (F.col("bottom_x") - F.col("top_x")) * (F.col("y") - F.col("top")) / (F.col("bottom") - F.col("top"))
    at = edges.select("page", "index", "y", F.coalesce("_x", lean).alias("at"), F.when(F.col("_x").isNotNull(), "curve").when(F.col("matched"), "border").otherwise("grid").alias("by"))
    left = at.select("page", F.col("index").alias("left_index"), "y", F.col("at").alias("left"), F.col("by").alias("left_by"))
    right = at.select("page", F.col("index").alias("right_index"), "y", F.col("at").alias("right"), F.col("by").alias("right_by"))
    return ranges.join(left, ["page", "left_index"]).join(right, ["page", "right_index", "y"]).select("page", "range", "y", "left", "right", "left_by", "right_by")


def painted_lines(pages: DataFrame, lines: DataFrame, overfill: int = 2) -> DataFrame:
    """(page, y, x, v): pages with the stretches of redaction_lines() white, `overfill` pixels more on either side."""
    own = lines.groupBy("page", "y").agg(F.collect_list(F.struct((F.col("left") - overfill).alias("a"), (F.col("right") + overfill).alias("b"))).alias("gone"))
    rows = levels(pages).join(own, ["page", "y"], "left")
    inside = F.coalesce(F.exists("gone", lambda g: (F.col("x") >= g["a"]) & (F.col("x") <= g["b"])), F.lit(False))
    return rows.select("page", "y", "x", F.when(inside, 255).otherwise(F.col("v")).alias("v"))
