"""Axes of a grid as rows: clusters, peaks, gaps, spacing, supports. Keys say whose axis a row is on, so that many pages share a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def half_even(c: Column) -> Column:
    """Rounded to a whole number, halves to even, as a long."""
    return F.bround(c.cast("double"), 0).cast("long")


def with_cluster(df: DataFrame, keys: list[str], position: str, most_gap: float | Column) -> DataFrame:
    """df with `cluster`, numbered from 1: a new one starts where the gap to the position before exceeds most_gap."""
    order = W.partitionBy(*keys).orderBy(position)
    start = F.col(position) - F.lag(position).over(order) > most_gap
    return df.withColumn("cluster", 1 + F.sum(F.when(start, 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0)))


def clustered(df: DataFrame, keys: list[str], position: str, most_gap: float | Column) -> DataFrame:
    """(keys, position): the rounded mean of each cluster."""
    return with_cluster(df, keys, position, most_gap).groupBy(*keys, "cluster").agg(half_even(F.avg(position)).alias(position)).drop("cluster")


def profile(pixels: DataFrame, keys: list[str], axis: str, spine: DataFrame) -> DataFrame:
    """(keys, axis, value): foreground pixels on each line of the spine, zeros included."""
    counts = pixels.groupBy(*keys, axis).agg(F.count("*").alias("value"))
    return spine.join(counts, [*keys, axis], "left").withColumn("value", F.coalesce("value", F.lit(0)))


def moving_average(df: DataFrame, keys: list[str], position: str, value: str, window: int) -> DataFrame:
    """df with `smooth`: sums over `window` rows around each, over the window's full length also at the ends. At most as many rows as an axis has."""
    if window <= 1:
        return df.withColumn("smooth", F.col(value).cast("double"))
    around = W.partitionBy(*keys).orderBy(position).rowsBetween(-(window // 2), (window - 1) // 2)
    return df.withColumn("smooth", F.sum(value).over(around) / F.lit(float(window)))


def peaks(df: DataFrame, keys: list[str], position: str, value: str, share: float, least: float | Column, most_gap: int | Column) -> DataFrame:
    """(keys, position, score, first, last): runs of lines at or over max(least, share of the highest), at their weighted mean."""
    least = least if isinstance(least, Column) else F.lit(float(least))
    whole = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    high = df.withColumn("_cut", F.greatest(least, F.max(value).over(whole) * share)).where(F.col(value) >= F.col("_cut"))
    weighted = F.sum(F.col(position) * F.col(value)) / F.sum(value)
    return with_cluster(high, keys, position, most_gap).groupBy(*keys, "cluster").agg(half_even(weighted).alias(position), F.max(value).cast("double").alias("score"), F.min(F.col(position)).alias("first"), F.max(F.col(position)).alias("last")).drop("cluster")


def runs(df: DataFrame, keys: list[str], position: str, least: int = 1) -> DataFrame:
    """(keys, first, last, length) of runs of consecutive positions."""
    island = F.col(position) - F.row_number().over(W.partitionBy(*keys).orderBy(position))
    out = df.select(*keys, position).distinct().withColumn("_island", island)
    out = out.groupBy(*keys, "_island").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("length"))
    return out.where(F.col("length") >= least).drop("_island")


def endpoints(run_rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, position): both ends of each run."""
    return run_rows.select(*keys, F.explode(F.array("first", "last")).alias("position"))


def regular_spacing(df: DataFrame, keys: list[str], position: str, low: Column, high: Column) -> DataFrame:
    """(keys, spacing): rounded median of the gaps between low and high; null below three positions."""
    order = W.partitionBy(*keys).orderBy(position)
    gaps = df.withColumn("_gap", F.lead(position).over(order) - F.col(position))
    usable = F.when((F.col("_gap") >= low) & (F.col("_gap") <= high), F.col("_gap"))
    return gaps.groupBy(*keys).agg(F.when(F.count("*") >= 3, half_even(F.median(usable))).alias("spacing"))


def merge_tolerance(spacing: Column) -> Column:
    """How close positions are that are one."""
    return F.greatest(F.lit(2), half_even(spacing * 0.45))


def filled(df: DataFrame, keys: list[str], position: str, spacing: Column, most: float = 3.25) -> DataFrame:
    """Positions with the missing ones between regular neighbours put in; wider gaps than `most` spacings stay."""
    order = W.partitionBy(*keys).orderBy(position)
    nxt = F.col("_next") - F.col(position)
    steps = half_even(nxt / spacing)
    inner = F.when((steps > 1) & (nxt <= spacing * most), F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(steps - 1, F.lit(1))), lambda i: half_even(F.col(position) + nxt * i / steps)))
    rows = df.withColumn("_next", F.lead(position).over(order)).withColumn("_all", F.concat(F.array(F.col(position).cast("long")), F.coalesce(inner, F.array().cast("array<bigint>"))))
    return rows.select(*keys, F.explode("_all").alias(position))


def trimmed(df: DataFrame, keys: list[str], position: str, support: str, spacing: Column, most: float = 3.25) -> DataFrame:
    """Rows from the first supported by 2 (else by 1) up to the first gap of more than `most` spacings, of those with support."""
    whole = W.partitionBy(*keys)
    first = F.coalesce(F.min(F.when(F.col(support) >= 2, F.col(position))).over(whole), F.min(F.when(F.col(support) >= 1, F.col(position))).over(whole))
    rows = df.withColumn("_first", first).where((F.col(position) >= F.col("_first")) & (F.col(support) >= 1))
    order = whole.orderBy(position)
    gap = F.coalesce((F.col(position) - F.lag(position).over(order) > spacing * most).cast("int"), F.lit(0))
    return rows.withColumn("_gap", gap).withColumn("_cut", F.sum("_gap").over(order.rowsBetween(W.unboundedPreceding, 0))).where("_cut = 0").drop("_first", "_gap", "_cut")


def supported(df: DataFrame, keys: list[str], support: str, rows: Column) -> DataFrame:
    """Lines with support of at least clamp(rows / 6, 2, 5); all, if fewer than two have it."""
    enough = F.col(support) >= F.greatest(F.lit(2), F.least(F.lit(5), F.floor(rows / 6)))
    return df.withColumn("_n", F.count_if(enough).over(W.partitionBy(*keys))).where((F.col("_n") < 2) | enough).drop("_n")


def near_support(lines: DataFrame, pixels: DataFrame, keys: list[str], position: str, radius: int) -> DataFrame:
    """(keys, position, support): distinct pixels within the radius of each line.

    A range join: both sides are dealt to buckets of the radius's width, a line
    to its own and both neighbours, and equal buckets are compared.
    """
    width = 2 * radius + 1
    wide = lines.select(*keys, position).distinct().withColumn("_b", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: F.floor(F.col(position) / width) + i)))
    spots = pixels.select(*keys, F.col(position).alias("_p")).withColumn("_b", F.floor(F.col("_p") / width)).distinct()
    hits = wide.join(spots, [*keys, "_b"]).where(F.abs(F.col(position) - F.col("_p")) <= radius)
    counts = hits.groupBy(*keys, position).agg(F.countDistinct("_p").alias("support"))
    return lines.select(*keys, position).distinct().join(counts, [*keys, position], "left").withColumn("support", F.coalesce("support", F.lit(0)))


def nearest(points: DataFrame, lines: DataFrame, keys: list[str], point: str, line: str, tolerance: float | None = None) -> DataFrame:
    """points with the nearest line of their keys (the smaller of two as near), null beyond the tolerance.

    An as-of join in both directions: lines and points are laid in one order,
    and each point looks at the last line before and the first one after it.
    """
    both = points.withColumns({"_at": F.col(point), "_line": F.lit(None).cast(lines.schema[line].dataType), "_kind": F.lit(1)}).unionByName(lines.select(*keys, F.col(line).alias("_line")).distinct().withColumns({"_at": F.col("_line"), "_kind": F.lit(0)}), allowMissingColumns=True)
    back = W.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(*keys).orderBy("_at", F.col("_kind").desc()).rowsBetween(0, W.unboundedFollowing)
    out = both.withColumns({"_before": F.last("_line", True).over(back), "_after": F.first("_line", True).over(ahead)}).where("_kind = 1")
    far = lambda c: F.abs(F.col(point) - F.col(c))
    best = F.when(F.col("_after").isNull() | (far("_before") <= far("_after")), F.col("_before")).otherwise(F.col("_after"))
    if tolerance is not None:
        best = F.when(F.abs(F.col(point) - best) <= tolerance, best)
    return out.withColumn(line, best).drop("_at", "_line", "_kind", "_before", "_after")


def best_of_close(df: DataFrame, keys: list[str], position: str, most_gap: float | Column, scores: list[Column]) -> DataFrame:
    """The best row of each cluster of close positions, by the scores in turn, then the smallest position."""
    order = W.partitionBy(*keys, "cluster").orderBy(*[s.desc() for s in scores], F.col(position))
    return with_cluster(df, keys, position, most_gap).withColumn("_at", F.row_number().over(order)).where("_at = 1").drop("_at", "cluster")


def column_scores() -> list[Column]:
    """Order of columns that are close to each other."""
    cross, segments, header, ends = map(F.col, ("crossings", "segments", "header", "endpoints"))
    return [cross + 2 * segments + 4 * header, header, segments, cross, -ends]


#: Rows of ink, and of bands, that one task takes; what a task holds depends on it, not on the size of the tables.
ROWS_A_TASK = 500_000


def segment_support(rows: DataFrame, inked: DataFrame, keys: list[str], share: float = 0.3) -> DataFrame:
    """(keys, column, segments): bands (band, top, bottom) in which at least max(2, share) of the lines of a column are inked; inked has (keys, column, y).

    Rows are counted first, as there are as many tasks as they ask for. All of
    a key's rows meet in one of them, and sums need no further shuffle.
    """
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(rows.count() + inked.count()) // ROWS_A_TASK))
    met = inked.repartition(tasks, *keys).join(rows.repartition(tasks, *keys).hint("merge"), keys)
    hits = met.where("y >= top and y < bottom").groupBy(*keys, "column", "band", "top", "bottom").agg(F.countDistinct("y").alias("n"))
    return hits.where(F.col("n") >= F.greatest(F.lit(2), F.ceil((F.col("bottom") - F.col("top")) * share))).groupBy(*keys, "column").agg(F.count("*").alias("segments"))


def header_support(top: Column, bottom: Column, ink: Column) -> Column:
    """0 to 3: a point for each border that a column meets, a third for both and 45 % ink between."""
    return top.cast("int") + bottom.cast("int") + (top & bottom & (ink >= 0.45)).cast("int")


def kept_columns(df: DataFrame, keys: list[str], least_segments: Column, least_ends: Column, fallback: Column) -> DataFrame:
    """Columns with a header of 2, enough segments or enough ends; where fewer than two have, those with the fallback."""
    good = (F.col("header") >= 2) | (F.col("segments") >= least_segments) | (F.col("endpoints") >= least_ends)
    return df.withColumn("_n", F.count_if(good).over(W.partitionBy(*keys))).where(F.when(F.col("_n") >= 2, good).otherwise(fallback)).drop("_n")


def separation(spacing: Column, width: Column) -> Column:
    return F.least(F.lit(44), F.greatest(F.lit(3), F.greatest(F.floor(width / 250), half_even(spacing / 2))))


def without_wide_gap(df: DataFrame, keys: list[str], position: str, header: str, threshold: Column) -> DataFrame:
    """Columns without those between the last header anchor before the widest gap, the first of equals, if it reaches the threshold, and the gap's right edge."""
    whole, order = W.partitionBy(*keys), W.partitionBy(*keys).orderBy(position)
    rows = df.withColumn("_left", F.lag(position).over(order)).withColumn("_gap", F.col(position) - F.col("_left"))
    widest = F.max(F.struct("_gap", (-F.col(position)).alias("first"), F.col(position).alias("right"), F.col("_left").alias("left"))).over(whole)
    rows = rows.withColumn("_w", F.when(F.count("*").over(whole) >= 4, widest))
    anchor = F.max(F.when((F.col(header) >= 2) & (F.col(position) <= F.col("_w")["left"]), F.col(position))).over(whole)
    cut = (F.col("_w")["_gap"] >= threshold) & (F.col(position) > F.col("_anchor")) & (F.col(position) < F.col("_w")["right"])
    return rows.withColumn("_anchor", anchor).where(~F.coalesce(cut, F.lit(False))).drop("_left", "_gap", "_w", "_anchor")


def intervals(axis: DataFrame, keys: list[str], position: str, start: str, size: str, index: str) -> DataFrame:
    """(keys, index, start, size) between neighbouring lines."""
    order = W.partitionBy(*keys).orderBy(position)
    out = axis.withColumns({index: F.row_number().over(order) - 1, "_next": F.lead(position).over(order)}).where("_next is not null")
    return out.select(*keys, index, F.col(position).alias(start), (F.col("_next") - F.col(position)).alias(size))


def grid_cells(rows: DataFrame, cols: DataFrame, keys: list[str], row_at: str = "y", col_at: str = "x") -> DataFrame:
    """(keys, row, col, x, y, width, height): each row interval with each column interval of the same page; a page's lines bound the product."""
    return intervals(rows, keys, row_at, "y", "height", "row").join(intervals(cols, keys, col_at, "x", "width", "col"), keys).where("width > 0 and height > 0")


def clipped(x: Column, y: Column, width: Column, height: Column, page_width: Column, page_height: Column, padding: int = 0, context: int = 0) -> Column:
    """The box moved in by the padding and out by the context, within the page; null if nothing is left."""
    by = max(0, padding) - max(0, context)
    zero = F.lit(0)
    left, top = F.greatest(zero, x + by), F.greatest(zero, y + by)
    right, bottom = F.least(page_width, x + width - by), F.least(page_height, y + height - by)
    return F.when((right > left) & (bottom > top), F.struct(left.alias("x"), top.alias("y"), (right - left).alias("width"), (bottom - top).alias("height")))


def proportional(df: DataFrame, keys: list[str], order_by: str, weight: str, left: Column, right: Column) -> DataFrame:
    """df with right_edge: edges between left and right in proportion to running weights, as rounded numbers."""
    own = W.partitionBy(*keys).orderBy(order_by)
    share = F.sum(weight).over(own.rowsBetween(W.unboundedPreceding, 0)) / F.sum(weight).over(W.partitionBy(*keys))
    return df.withColumn("right_edge", half_even(left + (right - left) * share))


def strictly_rising(edges: Column) -> Column:
    """An array of whole numbers in which each that isn't over the one before becomes one more than it."""
    step = lambda out, x: F.concat(out, F.array(F.when(F.size(out) > 0, F.greatest(x, F.element_at(out, -1) + 1)).otherwise(x)))
    return F.aggregate(edges, F.array().cast("array<bigint>"), step)


def regular_rows(first: Column, last: Column, n: Column) -> Column:
    """n positions at equal distances, the ends included."""
    return F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: half_even(first + (last - first) * i / (n - 1)))


def count_score(found: Column, expected: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(found - expected) / expected)


def template_confidence(axis: DataFrame, keys: list[str], position: str, columns_score: Column) -> DataFrame:
    """(keys, confidence): the column score and, for three rows or more, a fifth of how even the rows are."""
    order = W.partitionBy(*keys).orderBy(position)
    gaps = axis.withColumn("_gap", F.lead(position).over(order) - F.col(position))
    even = F.greatest(F.lit(0.0), 1 - F.stddev_pop("_gap") / F.avg("_gap"))
    score = F.first(columns_score)
    return gaps.groupBy(*keys).agg(F.when((F.count("*") >= 3) & (F.avg("_gap") > 0), F.least(F.lit(1.0), score * 0.8 + even * 0.2)).otherwise(score).alias("confidence"))


def chosen_grid(refined: Column, raw: Column, template: Column) -> Column:
    """The template's cells if it has any, else the refined ones, else the raw ones."""
    filled_ = lambda c: F.when(F.size(c) > 0, c)
    return F.coalesce(filled_(template), filled_(refined), raw)


def corners(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, top_left, top_right, bottom_right, bottom_left) of a page's corner points, by sums and differences; of equals the leftmost, then the topmost."""
    p = F.struct("x", "y")
    first, last = (lambda c: F.min_by(p, F.struct(c, "x", "y"))), (lambda c: F.min_by(p, F.struct(-c, "x", "y")))
    both, apart = F.col("x") + F.col("y"), F.col("y") - F.col("x")
    return points.groupBy(*keys).agg(first(both).alias("top_left"), first(apart).alias("top_right"), last(both).alias("bottom_right"), last(apart).alias("bottom_left"))


def padded_corners(points: DataFrame, keys: list[str], padding: float, width: Column, height: Column) -> DataFrame:
    """Points moved away from their centre by the padding, within the page."""
    whole = W.partitionBy(*keys)
    out = points.withColumns({"_cx": F.avg("x").over(whole), "_cy": F.avg("y").over(whole)})
    away = F.hypot(F.col("x") - F.col("_cx"), F.col("y") - F.col("_cy"))
    move = lambda c, centre, most: F.greatest(F.lit(0.0), F.least(most - 1.0, F.col(c) + F.coalesce(F.try_divide((F.col(c) - F.col(centre)) * padding, away), F.lit(0.0))))
    return out.withColumns({"px": move("x", "_cx", width), "py": move("y", "_cy", height)}).drop("_cx", "_cy")


def target_size(quad: DataFrame) -> DataFrame:
    """width and height of an upright page from corners(): the longer of opposite edges."""
    d = lambda a, b: F.hypot(F.col(a)["x"] - F.col(b)["x"], F.col(a)["y"] - F.col(b)["y"])
    return quad.withColumns({"width": half_even(F.greatest(d("top_left", "top_right"), d("bottom_left", "bottom_right"))), "height": half_even(F.greatest(d("top_left", "bottom_left"), d("top_right", "bottom_right")))})


def crossings(horizontal: DataFrame, vertical: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels on both masks."""
    return horizontal.join(vertical, [*keys, "y", "x"])


def crossing_components(h_labels: DataFrame, v_labels: DataFrame, keys: list[str], least: int) -> DataFrame:
    """(keys, label, crossed): vertical components that meet at least `least` horizontal ones."""
    both = v_labels.withColumnRenamed("label", "v").join(h_labels.withColumnRenamed("label", "h"), [*keys, "y", "x"])
    return both.groupBy(*keys, F.col("v").alias("label")).agg(F.countDistinct("h").alias("crossed")).where(F.col("crossed") >= least)


def kernel_size(char_height: Column, scale: float, width: Column, height: Column) -> tuple[Column, Column]:
    """(horizontal, vertical) lengths of line kernels."""
    across = F.greatest(F.lit(3), (char_height * scale).cast("int"), F.floor(width / 32).cast("int"))
    return across, F.greatest(F.lit(3), (across * 0.6).cast("int"), F.floor(height / 80).cast("int"))


def crossing_limits(area: Column) -> tuple[Column, Column, Column]:
    """(least area, most share of the page, most aspect) of crossings, by page size."""
    small = area < 10_000
    return F.when(small, 1).otherwise(2), F.when(small, 0.02).otherwise(0.005), F.when(small, 4.0).otherwise(3.0)
