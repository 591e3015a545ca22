"""The rules of ruled pages as runs: what a page's ink says of its lines, by SQL functions, windows and joins.

A page's bytes are looked at once, by kernels in the task that has the page:
they give the height of its characters, then its long runs of ink, with gaps closed.
A rule's pixels stay runs (page, y, start, end) from there, a few for each line
of a page. Those of vertical rules run along columns, so their y is a column
and start and end are lines, until turned() gives them as runs along lines.
Openings and closings treat what is beyond a page as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.deploy import stored
from gridloom.operators import hough
from gridloom.operators.raster import closed_runs, component_boxes, components, joined_runs, least_labels, least_linked, line_runs, page_lines, per_page, runs_of, touching

#: The scale of a stage and of a plain call, the height of characters where none is found, the least area of one.
STAGE_SCALE, CALL_SCALE, CHARACTER, CHARACTER_AREA = 1.55, 1.7, 10, 10

#: Fixed value: the height in pixels from which a rule must cross two others.
TALL_PAGE = 200


#: Fixed value: the lines of a band, in which runs along lines and runs down columns look for each other.
BAND = 32


def ink_is_dark(data: pa.Buffer) -> bool:
    """Whether fewer of a page's bytes are dark than light; of equals ink is light."""
    return 2 * np.count_nonzero(np.frombuffer(data, np.uint8) < 128) < len(data)


def inks(data: pa.Array, width: pa.Array) -> Iterator[np.ndarray]:
    """The ink of each page as lines and columns; none of pages without bytes."""
    for page, w in zip(data, width.to_pylist(), strict=True):
        own = page.as_buffer() if page.is_valid else b""
        yield (page_lines(own, w) < 128) == ink_is_dark(own) if len(own) else np.zeros((0, 1), bool)


def dark_ink(data: pa.Array) -> pa.Array:
    return pa.array([ink_is_dark(page.as_buffer()) for page in data], pa.bool_())


def with_polarity(pages: DataFrame) -> DataFrame:
    """pages with `dark`: whether ink is dark, which is so if fewer pixels are dark than light; of equals ink is light."""
    return pages.where("length(data) > 0").withColumn("dark", F.arrow_udf(dark_ink, T.BooleanType())("data"))


def character_height(ink: np.ndarray) -> int:
    """The whole part of the median height of the ink's components of at least CHARACTER_AREA pixels; 0 without any."""
    y, start, end = line_runs(ink)
    if not len(y):
        return 0
    first, of = np.unique(least_linked(len(y), *touching(np.zeros_like(y), y, start, end)), return_inverse=True)
    bottom = y[first]
    np.maximum.at(bottom, of, y)
    heights = (bottom - y[first] + 1)[np.bincount(of, end - start + 1) >= CHARACTER_AREA]
    return int(np.median(heights)) if len(heights) else 0


def character_heights(data: pa.Array, width: pa.Array) -> pa.Array:
    return pa.array([character_height(ink) for ink in inks(data, width)], pa.int32())


def run_lists(found: list[tuple[np.ndarray, ...]]) -> pa.Array:
    """An array of (y, start, end) for each page's runs."""
    at = np.cumsum([0, *(len(f[0]) for f in found)])
    columns = [pa.array(np.concatenate([f[i] for f in found] or [at[:0]]), pa.int32()) for i in range(3)]
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(columns, ["y", "start", "end"]))


def rule_runs(data: pa.Array, width: pa.Array, gap_x: pa.Array, across: pa.Array, gap_y: pa.Array, down: pa.Array) -> pa.Array:
    asked = zip(inks(data, width), *(c.to_pylist() for c in (gap_x, across, gap_y, down)), strict=True)
    both = [(joined_runs(ink, gx, a), joined_runs(ink.T, gy, d)) for ink, gx, a, gy, d in asked]
    return pa.StructArray.from_arrays([run_lists([b[i] for b in both]) for i in range(2)], ["level", "upright"])


RUNS = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("y", "start", "end")]))


def long_ink(gap_x: Column, across: Column, gap_y: Column, down: Column) -> Column:
    """(level, upright): the runs of a page's ink along lines and down columns, closed over gaps below gap_x and gap_y and opened to across and down."""
    both = T.StructType([T.StructField("level", RUNS), T.StructField("upright", RUNS)])
    return F.arrow_udf(rule_runs, both)("data", "width", *(c.cast("int") for c in (gap_x, across, gap_y, down)))


def sparse_runs(pages: DataFrame, down: bool = False) -> DataFrame:
    """(page, y, start, end) of the runs of ink of with_polarity() pages along lines, or down columns."""
    return per_page(pages, "y start end", lambda values, dark: line_runs(((values < 128) == dark).T if down else (values < 128) == dark), "dark")


def sizes(pages: DataFrame, ink: DataFrame, scale: float = STAGE_SCALE, shortest: float | None = None) -> DataFrame:
    """A row for each page with what its character height and size ask of rules.

    across and down are the least runs of horizontal and vertical rules, gap_x
    and gap_y the gaps below which runs are closed, long_x and long_y the least lengths of
    a rule, thick its most width, and crossings the rules that it must cross. With
    `shortest`, horizontal rules may be as short as that share of the width.
    """
    tall = component_boxes(components(ink)).where(F.col("area") >= CHARACTER_AREA).groupBy("page").agg(F.floor(F.median("height")).alias("char"))
    return asked(pages.select("page", "height", "width").join(tall, "page", "left"), scale, shortest)


def asked(pages: DataFrame, scale: float = STAGE_SCALE, shortest: float | None = None) -> DataFrame:
    """pages (height, width, char, ...) with what sizes() has of them."""
    w, h = F.col("width"), F.col("height")
    whole = lambda x: F.floor(x).cast("int")
    char = F.when(F.col("char") > 0, F.col("char")).otherwise(CHARACTER)
    own = pages.withColumn("char", char.cast("int"))
    own = own.withColumn("across", F.greatest(F.lit(3), whole(F.col("char") * F.lit(scale)), whole(w / 32)))
    own = own.withColumn("down", F.greatest(F.lit(3), whole(F.col("across") * 0.6), whole(h / 80)))
    long_x = F.greatest(F.lit(18), F.least(whole(w * 0.08), F.col("across") * 2))
    if shortest is not None:
        long_x = F.least(long_x, F.greatest(F.lit(3), F.rint(w * shortest).cast("int")))
    return own.withColumns(
        {
            "gap_x": F.greatest(F.lit(1), F.least(F.greatest(F.lit(1), whole(F.col("across") / 4)), whole(w / 180))),
            "gap_y": F.greatest(F.lit(1), F.least(F.greatest(F.lit(1), whole(F.col("down") / 2)), whole(h / 180))),
            "long_x": long_x,
            "long_y": F.greatest(F.lit(14), F.least(whole(h * 0.08), F.col("down") * 3)),
            "thick": F.greatest(F.lit(2), F.least(F.lit(24), F.col("char") * 2)),
            "crossings": F.when(h < TALL_PAGE, 1).otherwise(2),
        }
    )


def long_thin(labelled: DataFrame, of: DataFrame, least: Column) -> DataFrame:
    """The components that are at least so long along their runs and at most `thick` across; `least` may name columns of sizes()."""
    own = W.partitionBy("page", "label")
    sides = labelled.withColumns({"_long": F.max("end").over(own) - F.min("start").over(own) + 1, "_across": F.max("y").over(own) - F.min("y").over(own) + 1})
    good = sides.join(of.select("page", least.alias("_least"), "thick"), "page").where("_long >= _least and _across <= thick")
    return good.select("page", "y", "start", "end", "label")


def strokes(pages: DataFrame, runs: Column, least: Column) -> DataFrame:
    """(page, y, start, end, label) of long thin components of the runs in a column of pages that have sizes()."""
    return long_thin(components(pages.select("page", F.inline(runs))), pages, least)


def turned(labelled: DataFrame) -> DataFrame:
    """Labelled runs with lines and columns changed about."""
    pixels = labelled.select("page", "label", F.col("y").alias("x"), F.explode(F.sequence("start", "end")).alias("y"))
    part = pixels.withColumn("_k", F.col("x") - F.row_number().over(W.partitionBy("page", "y").orderBy("x")))
    return part.groupBy("page", "y", "label", "_k").agg(F.min("x").alias("start"), F.max("x").alias("end")).select("page", "y", "start", "end", "label")


def merged(runs: DataFrame) -> DataFrame:
    """(page, y, start, end) of runs that may overlap, as the fewest runs that cover the same pixels."""
    line = W.partitionBy("page", "y").orderBy("start", "end")
    reach = F.max("end").over(line.rowsBetween(W.unboundedPreceding, -1))
    new = F.coalesce((F.col("start") > reach + 1).cast("int"), F.lit(1))
    part = runs.withColumn("_new", new).withColumn("_k", F.sum("_new").over(line.rowsBetween(W.unboundedPreceding, 0)))
    return part.groupBy("page", "y", "_k").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_k")


def grown_groups(labelled: DataFrame, dx: int, dy: int) -> DataFrame:
    """(page, label, group): which components become one when each grows by dx at either end and dy above and below.

    Such components have runs at most 2 dx + 1 columns and 2 dy + 1 lines apart, so
    the graph has a node for each component, and few links: rules lie apart.
    """
    reach, lines = 2 * dx + 1, 2 * dy + 1
    near = labelled.select("page", F.explode(F.sequence(F.col("y") - lines, F.col("y") + lines)).alias("y"), (F.col("start") - reach).alias("_s"), (F.col("end") + reach).alias("_e"), F.col("label").alias("node"))
    links = near.join(labelled.withColumnRenamed("label", "other"), ["page", "y"]).where("node < other and start <= _e and _s <= end").select("page", "node", "other").distinct()
    nodes = labelled.select("page", F.col("label").alias("node")).distinct()
    return least_labels(nodes, links).select("page", F.col("node").alias("label"), F.col("label").alias("group"))


def facing(runs: DataFrame, lines: DataFrame, along: int = 0, across: int = 0) -> DataFrame:
    """Pairs of runs, and of runs at right angles to them in `lines`, that have a pixel in common when the latter's runs grow by `across` at either end and are `along` more lines thick to either side.

    Columns of runs are _y, _start, _end and those of lines as they were, but for the labels: label and _other.
    They meet by bands of lines; both orientations stay as they are, so a rule has a row for each line of its thickness, not of its length.
    """
    c = F.col
    low, high = c("start") - along, c("end") + along
    wide = runs.select("page", "label", c("y").alias("_y"), c("start").alias("_start"), c("end").alias("_end"), F.explode(F.sequence(F.floor(low / BAND), F.floor(high / BAND))).alias("_band"))
    near = lines.select("page", "y", "start", "end", c("label").alias("_other"), F.floor(c("y") / BAND).alias("_band"))
    inside = c("y").between(c("_start") - along, c("_end") + along) & c("_y").between(c("start") - across, c("end") + across)
    return wide.join(near, ["page", "_band"]).where(inside)


def crossing(own: DataFrame, other: DataFrame, of: DataFrame, along: int, across: int) -> DataFrame:
    """The components of own that meet at least `crossings` distinct components of other, whose runs are at right angles to own's, when those grow by `across` at their ends and by `along` to either side."""
    met = facing(own, other, along, across).select("page", "label", "_other").distinct()
    groups = grown_groups(other, across, along).select("page", F.col("label").alias("_other"), "group")
    enough = met.join(groups, ["page", "_other"]).groupBy("page", "label").agg(F.countDistinct("group").alias("_n")).join(of.select("page", "crossings"), "page").where("_n >= crossings")
    return stored(own.join(enough.select("page", "label"), ["page", "label"], "left_semi").select("page", "y", "start", "end", "label"))


def drawn(segments: DataFrame) -> DataFrame:
    """(page, y, start, end): runs down columns of segments (page, x1, y1, x2, y2) steeper than 45 degrees, one pixel wide."""
    y1, y2 = F.least("y1", "y2"), F.greatest("y1", "y2")
    x1, x2 = F.when(F.col("y1") <= F.col("y2"), F.col("x1")).otherwise(F.col("x2")), F.when(F.col("y1") <= F.col("y2"), F.col("x2")).otherwise(F.col("x1"))
    lines = segments.select("page", x1.alias("a"), (x2 - x1).alias("dx"), y1.alias("top"), (y2 - y1).alias("dy"), F.explode(F.sequence(y1, y2)).alias("x"))
    at = F.rint(F.col("a") + F.col("dx") * (F.col("x") - F.col("top")) / F.col("dy")).cast("int")
    return runs_of(lines.select("page", at.alias("y"), "x").distinct())


def inverted(data: Column) -> Column:
    """Bytes v as 255 - v."""
    return F.unhex(F.translate(F.hex(data), "0123456789ABCDEF", "FEDCBA9876543210"))


def recovered(pages: DataFrame, columns: DataFrame, weak: DataFrame) -> DataFrame:
    """The vertical rules of weak pages, a part of sizes(), with strokes that votes find among their ink; components are judged anew."""
    own = with_polarity(pages.select("page", "height", "width", "data")).join(weak.select("page"), "page", "left_semi")
    # written, or each look at a byte would turn the whole page over
    own = stored(own.withColumn("data", F.when(F.col("dark"), F.col("data")).otherwise(inverted(F.col("data")))))
    least = F.greatest(F.lit(10), F.floor(F.col("long_y") * 0.7))
    found = hough.steep_segments(own, 0.0).join(weak, "page").where(F.col("length") >= least)
    more = closed_runs(drawn(found), hough.RULE_CLOSE)
    both = merged(columns.join(weak.select("page"), "page", "left_semi").select("page", "y", "start", "end").unionByName(more))
    return long_thin(components(both), weak, least)


def rules(pages: DataFrame, scale: float = STAGE_SCALE, shortest: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(horizontal, upright, sizes) of pages: their ruled_lines() with the vertical ones still as runs down columns, and their sizes()."""
    c = F.col
    # no filter by bytes: it would move below a shuffle of the pages, with all that draws them
    own = pages.where("width > 0").select("page", c("height").cast("int"), c("width").cast("int"), "data")
    own = asked(own.withColumn("char", F.arrow_udf(character_heights, T.IntegerType())("data", "width")), scale, shortest)
    # the task that has a page looks at its bytes; what is written of it is few runs
    own = stored(own.withColumn("ink", long_ink(c("gap_x"), c("across"), c("gap_y"), c("down"))))
    of = own.drop("data", "ink")
    rows = stored(strokes(own, c("ink.level"), c("long_x")))
    columns = stored(strokes(own, c("ink.upright"), c("long_y")))

    def replaced(some: DataFrame, by: DataFrame) -> DataFrame:
        return stored(columns.join(some.select("page"), "page", "left_anti").select("page", "y", "start", "end", "label").unionByName(by))

    bare = of.join(columns.select("page").distinct(), "page", "left_anti")
    if not bare.isEmpty():
        size = F.greatest(F.lit(3), F.floor(c("down") * 0.8))
        shorter = own.join(bare.select("page"), "page", "left_semi").withColumn("ink", long_ink(c("gap_x"), c("across"), F.lit(1), size))
        again = strokes(shorter, c("ink.upright"), F.greatest(F.lit(14), F.floor(c("long_y") * 0.55)))
        columns = replaced(bare, again)
    pixels = lambda runs, name: runs.groupBy("page").agg(F.sum(c("end") - c("start") + 1).alias(name))
    counts = of.join(pixels(columns, "v"), "page", "left").join(pixels(rows, "h"), "page", "left").fillna(0, ["v", "h"])
    weak = stored(counts.where(c("v") < F.greatest(F.lit(10), F.floor(F.greatest(F.lit(1), c("h")) * 0.02))).drop("v", "h"))
    if not weak.isEmpty():
        columns = replaced(weak, recovered(own, columns, weak))
    vertical = crossing(columns, rows, of, 1, 1)
    horizontal = crossing(rows, vertical, of, 1, 3)
    return horizontal, crossing(vertical, horizontal, of, 1, 1), of


def ruled_lines(pages: DataFrame, scale: float = STAGE_SCALE, shortest: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(horizontal, vertical) rules of two-valued pages (page, height, width, data), as labelled runs (page, y, start, end, label) along lines.

    Rules are long runs of ink with small gaps closed, in long thin components,
    that cross others. Pages without vertical rules are tried with shorter runs; where
    there are still few, strokes found by votes are added. Pages without
    pixels, or without rules, have no rows. Each of the two is a written table.
    """
    horizontal, upright, _ = rules(pages, scale, shortest)
    return horizontal, stored(turned(upright))


def detect_lines(pages: DataFrame, scale: float = CALL_SCALE) -> tuple[DataFrame, DataFrame]:
    """ruled_lines() with the larger scale of a plain call."""
    return ruled_lines(pages, scale)


def crossing_points(horizontal: DataFrame, vertical: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, x, y) of where rules cross, whole parts of the centres; only small and roundish crossings count.

    Of pages (page, height, width) under 10,000 pixels a crossing has at least one pixel, 2 %
    of the page at most, and sides of at most 1 to 4; of others two, 0.5 % and 1 to 3.
    """
    v = vertical.select("page", "y", F.col("start").alias("_s"), F.col("end").alias("_e"))
    both = horizontal.join(v, ["page", "y"]).where("start <= _e and _s <= end")
    return centres(both.select("page", "y", F.greatest("start", "_s").alias("start"), F.least("end", "_e").alias("end")), pages)


def page_crossings(pages: DataFrame, scale: float = STAGE_SCALE, shortest: float | None = None) -> DataFrame:
    """The crossing_points() of the ruled_lines() of pages."""
    horizontal, upright, of = rules(pages, scale, shortest)
    # a pixel at a time; those side by side become a run
    both = runs_of(facing(upright, horizontal).select("page", "y", F.col("_y").alias("x")))
    return centres(both, of)


def centres(both: DataFrame, pages: DataFrame) -> DataFrame:
    """The crossing_points() among the pixels that rules have in common, as runs (page, y, start, end)."""
    box = component_boxes(components(both))
    area = pages.select("page", (F.col("height") * F.col("width")).alias("_area"))
    small = F.col("_area") < 10_000
    box = box.join(area, "page").withColumns({"_a": F.greatest("height", "width"), "_b": F.least("height", "width")})
    good = (F.col("area") >= F.when(small, 1).otherwise(2)) & (F.col("area") <= F.col("_area") * F.when(small, 0.02).otherwise(0.005)) & (F.col("_a") <= F.col("_b") * F.when(small, 4).otherwise(3))
    return box.where(good).select("page", F.floor("x").cast("int").alias("x"), F.floor("y").cast("int").alias("y"))
