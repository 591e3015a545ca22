"""Straight strokes as votes: edge pixels vote for (angle, distance), peaks are lines, and gaps cut lines into segments.

Votes are counted in partial aggregates, so a shuffle moves at most one row for
each line of a page that a task has seen. All of it is SQL functions, windows and joins,
but for skew(), where each page's votes are counted and compared in the page's task, as they are far more than its pixels.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators.raster import per_page


def edges(values: np.ndarray, below: int, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of the dark pixels that begin a dark stretch down columns (axis 0) or along lines (axis 1)."""
    dark = values < below
    first = dark.copy()
    if axis == 0:
        first[1:] &= ~dark[:-1]
    else:
        first[:, 1:] &= ~dark[:, :-1]
    return np.nonzero(first)[::-1]


def edge_pixels(pages: DataFrame, below: int = 128, axis: int = 0) -> DataFrame:
    """(page, x, y) of the dark pixels that begin a dark stretch: those below a light one or the page's edge (axis 0), or right of one (axis 1)."""
    return per_page(pages, "x y", lambda values, _: edges(values, below, axis))


def directions(degrees: Sequence[float]) -> Column:
    """The angles as an array of (angle, c, s): a line's direction, in degrees from the x axis, clockwise as y goes down."""
    return F.array(*[F.struct(F.lit(i).alias("angle"), F.lit(math.cos(math.radians(d))).alias("c"), F.lit(math.sin(math.radians(d))).alias("s")) for i, d in enumerate(degrees)])


def distance(x: Column, y: Column, c: Column, s: Column) -> Column:
    """Which of the lines of one direction, a pixel apart, a point lies on."""
    return F.floor(y * c - x * s + 0.5).cast("int")


def votes(points: DataFrame, degrees: Sequence[float]) -> DataFrame:
    """(page, angle, d, n): how many points (page, x, y) lie on each line; angle is a place in `degrees`."""
    both = points.select("page", "x", "y", F.inline(directions(degrees)))
    return both.groupBy("page", "angle", distance(F.col("x"), F.col("y"), F.col("c"), F.col("s")).alias("d")).agg(F.count("*").alias("n"))


def peaks(counted: DataFrame, least: int | Column, angles: int = 2, apart: int = 2) -> DataFrame:
    """The lines (page, angle, d, n) with `least` votes that have the most of those within `angles` places and `apart` pixels.

    Of equals the smallest (angle, d) stays. Only lines that pass the threshold are compared.
    """
    strong = counted.where(F.col("n") >= least)
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-angles, angles + 1) for j in range(-apart, apart + 1) if i or j])
    around = strong.select("page", "n", "angle", "d", F.inline(near)).select("page", (F.col("angle") + F.col("i")).alias("angle"), (F.col("d") + F.col("j")).alias("d"), F.struct("n", -F.col("angle"), -F.col("d")).alias("other"))
    most = around.groupBy("page", "angle", "d").agg(F.max("other").alias("other"))
    own = F.struct("n", -F.col("angle"), -F.col("d"))
    return strong.join(most, ["page", "angle", "d"], "left").where(F.col("other").isNull() | (own > F.col("other"))).select("page", "angle", "d", "n")


def page_peaks(values: np.ndarray, degrees: Sequence[float], least: float, below: int, angles: int = 2, apart: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(angle, d, n) of the peaks() of the votes() of one page's edge pixels, which never leave its task."""
    x, y = edges(values, below, 0)
    c, s = (np.array([f(math.radians(a)) for a in degrees])[:, None] for f in (math.cos, math.sin))
    d = np.floor(y * c - x * s + 0.5).astype(np.int64)
    low = d.min(initial=0) - apart
    wide = d.max(initial=0) - low + apart + 1
    high = len(degrees) + 2 * angles
    n = np.bincount(((np.arange(len(degrees))[:, None] + angles) * wide + d - low).ravel(), minlength=high * wide).reshape(high, wide)
    own = n[angles : high - angles, apart : wide - apart]
    good = (own >= least) & (own > 0)
    for i in range(-angles, angles + 1):
        for j in range(-apart, apart + 1):
            other = n[angles + i : high - angles + i, apart + j : wide - apart + j]
            if i or j:
                good &= own > other if (i, j) < (0, 0) else own >= other
    angle, at = np.nonzero(good)
    return angle, at + low + apart, own[good]


def segments(points: DataFrame, lines: DataFrame, degrees: Sequence[float], most_gap: float, least_length: float | Column, wide: int = 1) -> DataFrame:
    """(page, angle, d, x1, y1, x2, y2, length, slope, points): stretches of points along each line without gaps of more than most_gap.

    A point belongs to every line of `lines` that it is within `wide` pixels of. slope is
    that of the points' regression line, y over x in directions within 45
    degrees of the x axis, else x over y.
    """
    rays = lines.select("page", "angle", "d").join(F.broadcast(points.sparkSession.range(1).select(F.inline(directions(degrees)))), "angle")
    # each line waits at the distances that its points may have
    spread = rays.select("page", "angle", F.col("d").alias("line"), "c", "s", F.explode(F.array(*[F.col("d") + i for i in range(-wide, wide + 1)])).alias("d"))
    used = F.array_sort(F.collect_set(F.struct("angle", "c", "s")))
    asked = points.join(spread.groupBy("page").agg(used.alias("rays")), "page").select("page", "x", "y", F.inline("rays"))
    asked = asked.withColumn("d", distance(F.col("x"), F.col("y"), F.col("c"), F.col("s")))
    met = asked.join(spread.select("page", "angle", "d", "line"), ["page", "angle", "d"])
    met = met.withColumn("t", F.col("x") * F.col("c") + F.col("y") * F.col("s"))
    along = W.partitionBy("page", "angle", "line").orderBy("t", "x", "y")
    cut = (F.col("t") - F.lag("t").over(along) > most_gap).cast("int")
    met = met.withColumn("_cut", F.coalesce(cut, F.lit(0))).withColumn("_part", F.sum("_cut").over(along.rowsBetween(W.unboundedPreceding, 0)))
    flat = F.abs(F.col("c")) >= F.abs(F.col("s"))
    first, last = F.min_by(F.struct("x", "y"), F.struct("t", "x", "y")), F.max_by(F.struct("x", "y"), F.struct("t", "x", "y"))
    ends = met.groupBy("page", "angle", "line", "_part").agg(first.alias("a"), last.alias("b"), (F.max("t") - F.min("t")).alias("length"), F.regr_slope(F.when(flat, F.col("y")).otherwise(F.col("x")), F.when(flat, F.col("x")).otherwise(F.col("y"))).alias("slope"), F.count("*").alias("points"))
    long = ends.where(F.col("length") >= least_length)
    return long.select("page", "angle", F.col("line").alias("d"), F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2"), "length", "slope", "points")


#: The largest angle that counts as skew, the gap that a stroke may have, its least length as a share of the width and in pixels.
MOST_SKEW, SKEW_GAP, SKEW_SHARE, SKEW_LEAST = 15.0, 20, 0.25, 40


def skew(pages: DataFrame, step: float = 0.5, below: int = 128, least: int = SKEW_LEAST) -> DataFrame:
    """(page, angle): the median angle of a page's long strokes within MOST_SKEW degrees of level; 0 where there are none, as on pages without ink."""
    degrees = [i * step for i in range(round(-MOST_SKEW / step), round(MOST_SKEW / step) + 1)]
    points = edge_pixels(pages, below)
    size = pages.select("page", F.greatest(F.lit(float(least)), F.floor(F.col("width") * SKEW_SHARE)).alias("least"))
    strong = per_page(pages, "angle d n", lambda values, _: page_peaks(values, degrees, max(least, values.shape[1] * SKEW_SHARE // 1) * 0.5, below))
    strokes = segments(points, strong, degrees, SKEW_GAP, 0).join(size, "page").where("length >= least")
    angle = F.degrees(F.atan("slope"))
    found = strokes.where(F.abs(angle) <= MOST_SKEW).groupBy("page").agg(F.median(angle).alias("angle"))
    return pages.select("page").join(found, "page", "left").select("page", F.coalesce("angle", F.lit(0.0)).alias("angle"))


#: Fixed values of the recovery of near-vertical rules: votes, gap, least height, height over width, length of the closing stroke.
RULE_VOTES, RULE_GAP, RULE_HEIGHT, RULE_STEEP, RULE_CLOSE = 45, 10, 8, 2, 5


def steep_segments(pages: DataFrame, least_length: float, step: float = 0.5, below: int = 128, least_votes: int = RULE_VOTES) -> DataFrame:
    """segments() of strokes twice as high as wide at least, and 8 pixels or more: weak vertical rules that a run of dark pixels doesn't show."""
    most = math.degrees(math.atan(1 / RULE_STEEP))
    degrees = [90 + i * step for i in range(-int(most / step), int(most / step) + 1)]
    points = edge_pixels(pages, below, 1)
    found = segments(points, peaks(votes(points, degrees), least_votes), degrees, RULE_GAP, max(10.0, least_length))
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    return found.where(dy >= F.greatest(F.lit(RULE_HEIGHT), dx * RULE_STEEP))


def drawn(found: DataFrame) -> DataFrame:
    """(page, x, y) of the pixels of steep segments, one in each row, with gaps of fewer than RULE_CLOSE rows in a column filled."""
    top, bottom = F.least("y1", "y2"), F.greatest("y1", "y2")
    lean = F.coalesce(F.try_divide(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), F.lit(0.0))
    ink = found.select("page", "x1", "y1", lean.alias("lean"), F.explode(F.sequence(top, bottom)).alias("y"))
    ink = ink.select("page", F.floor(F.col("x1") + F.col("lean") * (F.col("y") - F.col("y1")) + 0.5).cast("int").alias("x"), "y").distinct()
    ink = ink.withColumn("then", F.lead("y").over(W.partitionBy("page", "x").orderBy("y")))
    end = F.when(F.col("then") - F.col("y") < RULE_CLOSE, F.col("then") - 1).otherwise(F.col("y"))
    return ink.select("page", "x", F.explode(F.sequence("y", end)).alias("y"))


#: Fixed values of border matching: least tolerance, tolerance as a share of the grid's span, most lean, least share of the height.
NEAR, NEAR_SHARE, MOST_LEAN, RULE_SHARE = 3.0, 0.015, 0.05, 1 / 3


def rules_across(found: DataFrame, tables: DataFrame) -> DataFrame:
    """(page, top_x, bottom_x, length): steep segments as whole lines from a table's top to its bottom.

    tables has (page, top, bottom); short or leaning segments are left out: those
    of less than a third of the height (8 pixels at least), or that move sideways more than 1 in 20.
    """
    rows = found.join(tables.select("page", "top", "bottom"), "page")
    height = F.col("bottom") - F.col("top")
    dy, dx = F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")
    straight = (F.abs(dy) >= F.greatest(F.lit(8), F.floor(height * RULE_SHARE))) & (F.abs(dx) <= F.abs(dy) * MOST_LEAN) & (dy != 0)
    lean = F.try_divide(dx.cast("double"), dy.cast("double"))
    start = F.col("x1") - lean * (F.col("y1") - F.col("top"))
    return rows.where(straight).select("page", start.alias("top_x"), (start + lean * height).alias("bottom_x"), F.abs(dy).cast("double").alias("length"))


def matched_borders(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """(page, index, x, top_x, bottom_x, matched) of each edge (page, index, x): where its border runs.

    That is the rule (page, top_x, bottom_x, length) whose middle is nearest to the edge, the
    longest of equally near ones, within 1.5 % of the page's span of edges and 3
    pixels at least; an edge without one keeps its place. Edges and rules meet
    by buckets of the tolerance's width, so no page pairs all of both.
    """
    span = edges.groupBy("page").agg(F.greatest(F.lit(NEAR), (F.max("x") - F.min("x")) * NEAR_SHARE).alias("near"))
    own = edges.join(span, "page").withColumn("spot", F.floor(F.col("x") / F.col("near")).cast("long"))
    middle = (F.col("top_x") + F.col("bottom_x")) / 2
    spots = F.sequence(F.col("spot") - 1, F.col("spot") + 1)
    candidates = rules.join(span, "page").withColumn("middle", middle).withColumn("spot", F.floor(F.col("middle") / F.col("near")).cast("long"))
    candidates = candidates.select("page", "top_x", "bottom_x", "length", "middle", F.explode(spots).alias("spot"))
    away = F.abs(F.col("middle") - F.col("x"))
    met = own.select("page", "index", "x", "near", "spot").join(candidates, ["page", "spot"]).where(away <= F.col("near"))
    best = met.groupBy("page", "index", "x").agg(F.min_by(F.struct("top_x", "bottom_x"), F.struct(away, -F.col("length"), "top_x", "bottom_x")).alias("rule"))
    out = edges.select("page", "index", "x").join(best, ["page", "index", "x"], "left")
    return out.select("page", "index", "x", F.coalesce("rule.top_x", F.col("x").cast("double")).alias("top_x"), F.coalesce("rule.bottom_x", F.col("x").cast("double")).alias("bottom_x"), F.col("rule").isNotNull().alias("matched"))


def border_rules(pages: DataFrame, tables: DataFrame, row_height: Column, below: int = 128) -> DataFrame:
    """rules_across() of the long vertical strokes on each page; row_height, of tables, is the gap that a stroke may have."""
    degrees = [90 + i * 0.25 for i in range(-12, 13)]
    points = edge_pixels(pages, below, 1).join(tables.select("page", "top", "bottom", row_height.alias("gap")), "page").where("y >= top and y < bottom")
    least = F.greatest(F.lit(10), F.floor((F.col("bottom") - F.col("top")) / 16))
    strong = peaks(votes(points, degrees).join(tables.select("page", "top", "bottom"), "page"), least, 3)
    # the gap differs by page: strokes are cut at single pixels, then joined over up to a row
    pieces = segments(points.select("page", "x", "y"), strong, degrees, 1.5, 0)
    along = W.partitionBy("page", "angle", "d").orderBy("y1", "y2")
    pieces = pieces.join(tables.select("page", row_height.alias("gap")), "page")
    cut = F.coalesce((F.col("y1") - F.max("y2").over(along.rowsBetween(W.unboundedPreceding, -1)) > F.col("gap")).cast("int"), F.lit(0))
    joined = pieces.withColumn("_cut", cut).withColumn("_part", F.sum("_cut").over(along.rowsBetween(W.unboundedPreceding, 0)))
    ends = joined.groupBy("page", "angle", "d", "_part").agg(F.min_by(F.struct("x1", "y1"), F.struct("y1", "x1")).alias("a"), F.max_by(F.struct("x2", "y2"), F.struct("y2", "x2")).alias("b"))
    return rules_across(ends.select("page", F.col("a.x1").alias("x1"), F.col("a.y1").alias("y1"), F.col("b.x2").alias("x2"), F.col("b.y2").alias("y2")), tables)
