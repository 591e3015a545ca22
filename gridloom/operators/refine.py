"""A page's grid from its line masks: profiles give candidates, supports decide, for all pages in one plan.

Masks are measured by small kernels, each over one page; clusters, trimming,
spacing, filling and choices between columns are the axis operators.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gridloom.functions.deploy import bucketed, stored
from gridloom.operators import axis as a

KEYS = ["page"]


def measured(masks: DataFrame, lists: DataFrame | None, schema: str, kernel: Callable[..., tuple]) -> DataFrame:
    """(page, and the fields of schema) that kernel(horizontal, vertical, own) gives for each page; own has the fields of the page's row of `lists`."""
    rows = masks.select("page", F.col("height").cast("int"), F.col("width").cast("int"), "horizontal", "vertical")
    names = [] if lists is None else [c for c in lists.columns if c != "page"]
    # lists are what is hashed; pages in buckets stay where they are
    rows = rows if lists is None else rows.join(lists.hint("shuffle_hash"), "page")
    out = T.StructType([masks.schema["page"], *T._parse_datatype_string(schema).fields])
    types = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for page, h, w, across, down, *own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                both = (np.frombuffer(x, np.uint8).reshape(h, w) > 0 for x in (across, down))
                found.append((page, *kernel(*both, dict(zip(names, own, strict=True)))))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found, strict=True), types, strict=True)], schema=types)

    return rows.select("page", "height", "width", "horizontal", "vertical", *names).mapInArrow(run, out)


def required_masks(masks: DataFrame) -> DataFrame:
    """masks, if each page has both, of its size; else an error that names the page."""

    def bad(c: str) -> Column:
        return F.coalesce(F.octet_length(c) != F.col("height").cast("long") * F.col("width"), F.lit(True))

    said = F.concat(F.lit("page "), F.coalesce(F.col("page").cast("string"), F.lit("null")), F.lit(" has no "), F.when(bad("horizontal"), "horizontal").otherwise("vertical"), F.lit(" mask of its size"))
    return masks.withColumn("horizontal", F.when(bad("horizontal") | bad("vertical"), F.raise_error(said).cast("binary")).otherwise(F.col("horizontal")))


def spread(mask: np.ndarray, radius: int) -> np.ndarray:
    """The mask with every pixel grown to a square."""
    for axis in (0, 1):
        n = mask.shape[axis]
        sums = np.concatenate((np.zeros_like(np.take(mask, [0], axis), int), np.cumsum(mask, axis=axis)), axis=axis)
        lo, hi = np.maximum(np.arange(n) - radius, 0), np.minimum(np.arange(n) + radius + 1, n)
        mask = np.take(sums, hi, axis) > np.take(sums, lo, axis)
    return mask


def meet(across: np.ndarray, down: np.ndarray, rows: list[int], cols: list[int], radius: int) -> np.ndarray:
    """Whether grown horizontal and vertical ink meet near each (row, column)."""
    near = spread(spread(across, radius) & spread(down, radius), radius)
    h, w = near.shape
    return near[np.ix_(np.clip(rows, 0, h - 1), np.clip(cols, 0, w - 1))] if rows and cols else np.zeros((len(rows), len(cols)), bool)


def run_ends(across: np.ndarray, rows: list[int], radius: int, least: int) -> list[int]:
    """Both ends of each run of ink, of `least` columns or more, around each row."""
    out = []
    for y in rows:
        ink = across[max(0, y - radius) : y + radius + 1].any(axis=0)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], ink.astype(np.int8), [0]))))
        for start, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if end - start >= least:
                out += [start, end - 1]
    return out


def profiles(across: np.ndarray, down: np.ndarray, own: dict) -> tuple:
    return across.sum(axis=1).tolist(), down.sum(axis=0).tolist()


def supports(across: np.ndarray, down: np.ndarray, own: dict) -> tuple:
    hits = meet(across, down, own["ys"], own["xs"], own["radius"])
    return (hits.sum(axis=1).tolist(),)


def ends(across: np.ndarray, down: np.ndarray, own: dict) -> tuple:
    """Run ends of all rows, and of the first two; the ink of the band between those, by column."""
    ys, radius, width = own["ys"], max(own["radius"], 2), across.shape[1]
    every = run_ends(across, ys, radius, max(8, width // 90))
    if len(ys) < 2:
        return every, [], []
    return every, run_ends(across, ys[:2], radius, max(4, width // 120)), down[max(0, ys[0]) : ys[1] + 1].sum(axis=0).tolist()


def column_supports(across: np.ndarray, down: np.ndarray, own: dict) -> tuple:
    """Crossings, inked bands between rows, and the header's borders and ink, of each column."""
    ys, xs, radius = own["ys"], own["xs"], own["radius"]
    wide = max(radius, 2)
    crossings = meet(across, down, ys, xs, radius).sum(axis=0)
    inked = np.array([down[:, max(0, x - wide) : x + wide + 1].any(axis=1) for x in xs]).reshape(len(xs), len(down))
    segments, header = np.zeros(len(xs), int), np.zeros(len(xs), int)
    for top, bottom in zip(ys[:-1], ys[1:], strict=True):
        lo, hi = max(0, top), min(len(down), bottom + 1)
        margin = min((hi - lo) // 3, wide)
        band = inked[:, lo + margin : hi - margin]
        segments += band.sum(axis=1) >= max(2, round(band.shape[1] * 0.3))
    if len(ys) > 1:
        borders = meet(across, down, ys[:2], xs, wide)
        band = inked[:, max(0, ys[0]) : ys[1] + 1]
        header = borders.sum(axis=0) + (borders.all(axis=0) & (band.sum(axis=1) >= max(2, round(band.shape[1] * 0.45))))
    return crossings.tolist(), segments.tolist(), header.tolist()


def listed(df: DataFrame, position: str, name: str) -> DataFrame:
    """(page, name): a page's positions in order."""
    return df.groupBy("page").agg(F.array_sort(F.collect_list(F.col(position).cast("int"))).alias(name))


def unfolded(df: DataFrame, *names: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Arrays of equal length as rows, each with the columns to keep."""
    return df.select("page", *keep, F.inline(F.arrays_zip(*names)))


def profile_peaks(df: DataFrame, profile: str, position: str, share: float, least: Column, gap: Column) -> DataFrame:
    """(page, position): peaks of an array profile; least and gap are columns of df."""
    rows = df.select("page", least.cast("double").alias("_least"), gap.alias("_gap"), F.posexplode(profile).alias(position, "value")).where("value > 0")
    return a.peaks(rows, ["page", "_gap"], position, "value", share, F.col("_least"), F.col("_gap")).select("page", position)


def table_rows(found: DataFrame, keep_header: bool = False) -> DataFrame:
    """(page, y, spacing) from row candidates (page, y, support, height): from the first that columns cross, up to a wide gap, close ones merged and missing ones put in.

    Without a regular spacing (0) the candidates from the first crossed one on
    stay; where fewer than two rows would be left, all candidates do. With
    keep_header the first row is merged with no other.
    """
    whole = W.partitionBy("page")
    first = F.coalesce(*[F.min(F.when(F.col("support") >= n, F.col("y"))).over(whole) for n in (2, 1, 0)])
    rows = found.withColumns({"_first": first, "_all": F.count("*").over(whole)}).where("y >= _first and _all > 1")
    crossed = F.col("support") >= 1
    rows = rows.withColumn("_used", (F.count_if(crossed).over(whole) < 2) | crossed)
    low = F.greatest(F.lit(3), F.floor(F.col("height") / 120))
    high = F.greatest(low + 1, F.floor(F.col("height") / 12))
    limits = rows.where("_used").withColumns({"_low": low, "_high": high})
    spacing = a.regular_spacing(limits, KEYS, "y", F.col("_low"), F.col("_high")).select("page", F.greatest(F.when(F.col("spacing").isNotNull(), F.lit(1)), "spacing").alias("spacing"))
    rows = rows.join(spacing, "page")
    even = rows.where("spacing is not null and _used")
    order = whole.orderBy("y")
    wide = F.coalesce((F.col("y") - F.lag("y").over(order) > F.col("spacing") * 3.25).cast("int"), F.lit(0))
    even = even.withColumn("_wide", wide).withColumn("_cut", F.sum("_wide").over(order.rowsBetween(W.unboundedPreceding, 0))).where("_cut = 0")
    even = even.withColumn("_head", (F.row_number().over(order) == 1) & F.lit(keep_header))
    keys = ["page", "spacing"]
    merged = a.clustered(even, [*keys, "_head"], "y", a.merge_tolerance(F.col("spacing"))).select(*keys, "y")
    whole_rows = a.filled(merged, keys, "y", F.col("spacing")).unionByName(rows.where("spacing is null").select("page", F.col("spacing"), F.col("y").cast("long")))
    counted = whole_rows.withColumn("_n", F.count("*").over(whole)).where("_n > 1").select("page", F.col("y").cast("long"), F.coalesce("spacing", F.lit(0)).cast("long").alias("spacing"))
    few = found.join(counted.select("page").distinct(), "page", "left_anti").join(spacing, "page", "left")
    return counted.unionByName(few.select("page", F.col("y").cast("long"), F.coalesce("spacing", F.lit(0)).cast("long").alias("spacing")))


def table_columns(found: DataFrame) -> DataFrame:
    """(page, x) from column candidates (page, x, crossings, segments, header, endpoints, rows, spacing, width): those that look like borders, the best of close ones, without strokes inside a wide field."""
    whole = W.partitionBy("page")
    enough = F.col("crossings") >= F.greatest(F.lit(2), F.least(F.lit(5), F.floor(F.col("rows") / 6)))
    rows = found.withColumn("_some", (F.count_if(enough).over(whole) < 2) | enough)
    least_segments = F.greatest(F.lit(2), F.least(F.lit(4), F.floor(F.greatest(F.lit(0), F.col("rows") - 1) / 12)))
    least_ends = F.greatest(F.lit(3), F.least(F.lit(8), F.floor(F.col("rows") / 4)))
    kept = a.kept_columns(rows, KEYS, least_segments, least_ends, F.col("_some")).withColumn("_n", F.count("*").over(whole))
    few, many = kept.where("_n < 3"), kept.where("_n >= 3")
    apart = a.separation(F.col("spacing"), F.col("width"))
    best = a.best_of_close(many, KEYS, "x", apart, a.column_scores())
    threshold = F.greatest(a.half_even(F.col("spacing") * 6.0), a.half_even(F.col("width") * 0.2))
    narrow = a.without_wide_gap(best, KEYS, "x", "header", F.when(F.col("spacing") > 0, threshold))
    return few.select("page", "x").unionByName(narrow.select("page", "x"))


def is_bucketed(df: DataFrame) -> bool:
    """Whether df reads a table that bucketed() wrote."""
    return all("/gridloom/gridloom_" in f for f in df.inputFiles()) and bool(df.inputFiles())


class Refined(NamedTuple):
    """rows (page, y, spacing), columns (page, x), and cells (page, row, col, x, y, width, height)."""

    rows: DataFrame
    columns: DataFrame
    cells: DataFrame


def refined_grid(masks: DataFrame, centroids: DataFrame | None = None, keep_header: bool = False) -> Refined:
    """Grids of pages (page, height, width, horizontal, vertical), whose masks are bytes, ink where they aren't 0.

    centroids (page, x, y) add column candidates. Pages without ink have no
    rows; a page without one of its masks is an error. The masks are read four
    times, each time with short lists of lines: they are written in buckets of
    their page first, unless they are such a table, so that they move once. What a step finds
    is written, so that the next one doesn't repeat it.
    """
    masks = required_masks(masks if is_bucketed(masks) else bucketed(masks.select("page", "height", "width", "horizontal", "vertical"), "page"))
    size = masks.select("page", F.col("height").cast("int"), F.col("width").cast("int"))
    radius = F.greatest(F.lit(1), F.least(F.lit(10), F.floor(F.least("height", "width") / 250))).cast("int")
    tolerance = F.greatest(F.lit(1), F.least(F.lit(8), F.floor(F.col("width") / 220)))
    size = size.withColumns({"radius": radius, "tolerance": tolerance})
    ink = stored(measured(masks, None, "across array<int>, down array<int>", profiles).join(size, "page"))
    size = ink.drop("across", "down")
    least = lambda c: F.greatest(F.lit(3.0), F.col(c) * 0.02)
    gap = lambda c: F.greatest(F.lit(2), F.floor(F.col(c) / 900))
    ys = profile_peaks(ink, "across", "y", 0.1, least("width"), gap("height"))
    xs = profile_peaks(ink, "down", "x", 0.1, least("height"), gap("width"))
    if centroids is not None:
        more = centroids.select("page", F.col("x").cast("long").alias("x"))
        both = xs.unionByName(more).join(size.select("page", F.greatest(F.lit(5), F.floor(F.col("width") / 200)).alias("_by")), "page")
        pages = more.select("page").distinct()
        close = a.clustered(both.join(pages, "page", "left_semi"), ["page", "_by"], "x", F.col("_by")).select("page", "x")
        xs = xs.join(pages, "page", "left_anti").unionByName(close)
    lines = listed(ys, "y", "ys").join(listed(xs, "x", "xs"), "page", "left").withColumn("xs", F.coalesce("xs", F.array().cast("array<int>"))).join(size.select("page", "radius"), "page")
    lines = stored(lines)
    crossed = measured(masks, lines, "support array<int>", supports).join(lines.select("page", "ys"), "page")
    candidates = unfolded(crossed, "ys", "support").withColumnRenamed("ys", "y").join(size.select("page", "height"), "page")
    rows = stored(table_rows(stored(candidates), keep_header))
    tall = listed(rows, "y", "ys").join(size.select("page", "radius"), "page")
    found = measured(masks, tall, "every array<int>, header array<int>, band array<int>", ends).join(size, "page").join(tall.select("page", "ys"), "page")
    found = stored(found)
    close = lambda df: a.clustered(df, ["page", "tolerance"], "x", F.col("tolerance"))
    observed = found.select("page", "tolerance", F.explode(F.col("every").cast("array<bigint>")).alias("x"))
    at_ends = close(observed)
    counts = a.nearest(observed, at_ends.withColumnRenamed("x", "end"), ["page", "tolerance"], "x", "end").where(F.abs(F.col("x") - F.col("end")) <= F.col("tolerance")).groupBy("page", "end").agg(F.count("*").alias("n"))
    band = F.try_element_at("ys", F.lit(2)) - F.try_element_at("ys", F.lit(1)) + 1
    tops = profile_peaks(found.where(F.size("ys") > 1), "band", "x", 0.12, F.greatest(F.lit(2.0), band * 0.25), F.col("tolerance"))
    heads = close(tops.join(size.select("page", "tolerance"), "page").unionByName(found.select("page", "tolerance", F.explode(F.col("header").cast("array<bigint>")).alias("x"))))
    extra = at_ends.unionByName(heads)
    pages = extra.select("page").distinct()
    joined = close(xs.join(pages, "page", "left_semi").join(size.select("page", "tolerance"), "page").unionByName(extra)).select("page", "x").unionByName(xs.join(pages, "page", "left_anti"))
    wanted = stored(tall.join(listed(joined, "x", "xs"), "page"))
    borders = measured(masks, wanted, "crossings array<int>, segments array<int>, header array<int>", column_supports).join(wanted.select("page", "xs", F.size("ys").alias("rows")), "page")
    # borders is read once: each look at it would measure the masks again
    scored = unfolded(borders, "xs", "crossings", "segments", "header", keep=("rows",)).withColumnRenamed("xs", "x").join(size.select("page", "width", "tolerance"), "page")
    scored = stored(scored)
    ended = scored.select("page", "x", "tolerance").join(counts, "page").where(F.abs(F.col("x") - F.col("end")) <= F.col("tolerance")).groupBy("page", "x").agg(F.sum("n").alias("endpoints"))
    scored = scored.join(ended, ["page", "x"], "left").fillna(0, ["endpoints"]).join(rows.groupBy("page").agg(F.max("spacing").alias("spacing")), "page")
    columns = stored(table_columns(stored(scored)))
    page = size.select("page", "height", "width")
    cells = a.intervals(rows, KEYS, "y", "top", "tall", "row").join(a.intervals(columns, KEYS, "x", "left", "wide", "col"), "page").join(page, "page")
    x, y = F.greatest(F.lit(0), "left"), F.greatest(F.lit(0), "top")
    cells = cells.where((x < F.col("width")) & (y < F.col("height")))
    boxes = cells.select("page", "row", "col", x.alias("x"), y.alias("y"), F.least(F.greatest(F.lit(1), "wide"), F.col("width") - x).alias("width"), F.least(F.greatest(F.lit(1), "tall"), F.col("height") - y).alias("height"))
    return Refined(rows, columns, boxes)
