"""Queries of strokes: votes, skew, steep rules and borders."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import hough, raster

from .images import EDGES, pages, rays
from .registry import query, table

DEGREES = [-30.0, 0.0, 30.0, 60.0, 90.0]
RAYS = rays(DEGREES)
VOTES = f"{EDGES}, r(angle, c, s) AS (VALUES {RAYS}), n AS (SELECT page, angle, CAST(floor(y * c - x * s + CAST(0.5 AS DOUBLE)) AS INT) AS d, count(*) AS n FROM e, r GROUP BY ALL)"


@query(f"WITH {EDGES} SELECT page, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM e")
def i5_edges(spark, d):
    return hough.edge_pixels(pages(spark, d))


@query(f"WITH {VOTES} SELECT page, CAST(angle AS INT) AS angle, d, n FROM n")
def i5_votes(spark, d):
    return hough.votes(hough.edge_pixels(pages(spark, d)), DEGREES)


@query(f"WITH {VOTES}, k AS (SELECT * FROM n WHERE n >= 3) SELECT page, CAST(angle AS INT) AS angle, d, n FROM k WHERE NOT EXISTS (SELECT 1 FROM k AS o WHERE o.page = k.page AND abs(o.angle - k.angle) <= 1 AND abs(o.d - k.d) <= 2 AND (o.n > k.n OR (o.n = k.n AND (o.angle < k.angle OR (o.angle = k.angle AND o.d < k.d)))))")
def i5_lines(spark, d):
    return hough.peaks(hough.votes(hough.edge_pixels(pages(spark, d)), DEGREES), 3, 1, 2)


@query(f"""WITH {VOTES}, k AS (SELECT page, angle, d AS line FROM n WHERE n >= 3), m AS (SELECT e.page, k.angle, line, x, y, x * c + y * s AS t FROM e JOIN k USING (page) JOIN r USING (angle) WHERE abs(floor(y * c - x * s + CAST(0.5 AS DOUBLE)) - line) <= 1),
g AS (SELECT *, CASE WHEN t - lag(t) OVER w > 2.5 THEN 1 ELSE 0 END AS cut FROM m WINDOW w AS (PARTITION BY page, angle, line ORDER BY t, x, y)), h AS (SELECT *, sum(cut) OVER (PARTITION BY page, angle, line ORDER BY t, x, y ROWS UNBOUNDED PRECEDING) AS part FROM g)
SELECT page, CAST(angle AS INT) AS angle, line AS d, CAST(arg_min(x, (t, x, y)) AS INT) AS x1, CAST(arg_min(y, (t, x, y)) AS INT) AS y1, CAST(arg_max(x, (t, x, y)) AS INT) AS x2, CAST(arg_max(y, (t, x, y)) AS INT) AS y2, max(t) - min(t) AS length, count(*) AS points FROM h GROUP BY page, angle, line, part HAVING max(t) - min(t) >= 2""")
def i17_segments(spark, d):
    points = hough.edge_pixels(pages(spark, d))
    return hough.segments(points, hough.votes(points, DEGREES).where("n >= 3"), DEGREES, 2.5, 2.0).drop("slope")


BORDERS = """s AS (SELECT l_suppkey AS page, CAST(l_quantity AS DOUBLE) * 10 AS top_x, CAST(l_quantity AS DOUBLE) * 10 + l_linenumber - 4 AS bottom_x, CAST(l_extendedprice AS DOUBLE) AS length FROM lineitem),
e AS (SELECT s_suppkey AS page, CAST(i AS INT) AS index, i * 41 + s_suppkey % 7 AS x FROM supplier, generate_series(0, 12) AS g(i)), n AS (SELECT page, greatest(CAST(3 AS DOUBLE), (max(x) - min(x)) * CAST(0.015 AS DOUBLE)) AS near FROM e GROUP BY page),
b AS (SELECT page, index, arg_min(top_x, (abs((top_x + bottom_x) / 2 - x), -length, top_x, bottom_x)) AS top_x, arg_min(bottom_x, (abs((top_x + bottom_x) / 2 - x), -length, top_x, bottom_x)) AS bottom_x FROM e JOIN n USING (page) JOIN s USING (page) WHERE abs((top_x + bottom_x) / 2 - x) <= near GROUP BY page, index)"""


def borders(spark, d):
    """(edges, their borders): edges of suppliers' pages, and line items as rules."""
    left = F.col("l_quantity").cast("double") * 10
    rules = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("page"), left.alias("top_x"), (left + F.col("l_linenumber") - 4).alias("bottom_x"), F.col("l_extendedprice").alias("length"))
    edges = table(spark, d, "supplier").select(F.col("s_suppkey").alias("page"), F.explode(F.sequence(F.lit(0), F.lit(12))).alias("index")).withColumn("x", F.col("index") * 41 + F.col("page") % 7)
    return edges, hough.matched_borders(edges, rules)


@query(f"""WITH {BORDERS} SELECT page, index, coalesce(top_x, x) AS top_x, coalesce(bottom_x, x) AS bottom_x, top_x IS NOT NULL AS matched FROM e LEFT JOIN b USING (page, index)""")
def i35_matched_borders(spark, d):
    return borders(spark, d)[1].drop("x")


@query(f"""WITH {BORDERS}, k AS (SELECT page, index, CASE WHEN index % 4 = 1 THEN 'curve' WHEN top_x IS NOT NULL THEN 'border' ELSE 'grid' END AS by, y, CASE WHEN index % 4 = 1 THEN x + y % 3 ELSE coalesce(top_x, x) + (coalesce(bottom_x, x) - coalesce(top_x, x)) * (y - 2) / CAST(8 AS DOUBLE) END AS at FROM e LEFT JOIN b USING (page, index), generate_series(2, 9) AS g(y))
SELECT l.page, CAST(l.index // 2 AS INT) AS range, CAST(l.y AS INT) AS y, CAST(l.at AS DOUBLE) AS "left", CAST(r.at AS DOUBLE) AS "right", l.by AS left_by, r.by AS right_by FROM k AS l JOIN k AS r ON l.page = r.page AND l.y = r.y AND r.index = l.index + 1 WHERE l.index % 2 = 0""")
def i33_redaction_lines(spark, d):
    """Every second column is redacted; every fourth edge has a curve, and some of the others a border."""
    edges, found = borders(spark, d)
    pages = table(spark, d, "supplier").select(F.col("s_suppkey").alias("page"), F.lit(2).alias("top"), F.lit(10).alias("bottom"))
    curves = edges.where("index % 4 = 1").select("page", "index", F.explode(F.sequence(F.lit(2), F.lit(9))).alias("y"), "x").withColumn("x", F.col("x") + F.col("y") % 3)
    ranges = edges.where("index % 2 = 0 and index < 12").select("page", F.floor(F.col("index") / 2).cast("int").alias("range"), F.col("index").alias("left_index"), (F.col("index") + 1).alias("right_index"))
    return raster.redaction_lines(ranges, pages, found, curves)
