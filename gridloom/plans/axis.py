"""Queries of axis operators, over events in time and numbers that stand for positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import axis as a

from .registry import query, table

MINUTE = "CAST(floor(epoch(ts) / 60) AS BIGINT) - 28401120"
HOUR = "CAST(floor(epoch(ts) / 3600) AS BIGINT) - 473352"


def minutes(spark, d):
    """(user_id, m): distinct minutes of 2024 with an event of the user."""
    return timed(spark, d).select("user_id", "m").distinct()


def timed(spark, d):
    e = table(spark, d, "events")
    s = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return e.withColumns({"m": F.floor(s / 60) - 28401120, "h": F.floor(s / 3600) - 473352})


CLUSTERS = f"""
e AS (SELECT DISTINCT user_id, {MINUTE} AS m FROM events),
f AS (SELECT *, CASE WHEN m - lag(m) OVER (PARTITION BY user_id ORDER BY m) > 120 THEN 1 ELSE 0 END AS s FROM e),
c AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY m ROWS UNBOUNDED PRECEDING) AS k FROM f),
g AS (SELECT user_id, CAST(round_even(avg(m), 0) AS BIGINT) AS m FROM c GROUP BY user_id, k)"""


@query(f"WITH {CLUSTERS} SELECT * FROM g")
def g4_clusters(spark, d):
    return a.clustered(minutes(spark, d), ["user_id"], "m", 120)


@query(f"WITH RECURSIVE h(hour) AS (SELECT 0 UNION ALL SELECT hour + 1 FROM h WHERE hour < 743), e AS (SELECT {HOUR} AS hour FROM events) SELECT 'all' AS page, h.hour, count(e.hour) AS value FROM h LEFT JOIN e ON h.hour = e.hour GROUP BY h.hour")
def g1_profile(spark, d):
    return hours(spark, d)


def hours(spark, d):
    spine = spark.range(744).select(F.lit("all").alias("page"), F.col("id").alias("hour"))
    return a.profile(timed(spark, d).select(F.lit("all").alias("page"), F.col("h").alias("hour")), ["page"], "hour", spine)


PROFILE = f"h AS (SELECT range AS hour FROM range(744)), e AS (SELECT {HOUR} AS hour FROM events), p AS (SELECT h.hour, count(e.hour) AS value FROM h LEFT JOIN e ON h.hour = e.hour GROUP BY h.hour)"


@query(f"WITH {PROFILE} SELECT hour, sum(value) OVER (ORDER BY hour ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4.0 AS smooth FROM p")
def g2_moving_average(spark, d):
    return a.moving_average(hours(spark, d), ["page"], "hour", "value", 4).select("hour", "smooth")


@query(f"""WITH {PROFILE}, q AS (SELECT * FROM p WHERE value >= greatest(3.0, 0.8 * (SELECT max(value) FROM p))), f AS (SELECT *, CASE WHEN hour - lag(hour) OVER (ORDER BY hour) > 2 THEN 1 ELSE 0 END AS s FROM q), c AS (SELECT *, sum(s) OVER (ORDER BY hour ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT 'all' AS page, CAST(round_even(sum(hour * value) / sum(value), 0) AS BIGINT) AS hour, CAST(max(value) AS DOUBLE) AS score, min(c.hour) AS first, max(c.hour) AS last FROM c GROUP BY k""")
def g3_peaks(spark, d):
    return a.peaks(hours(spark, d), ["page"], "hour", "value", 0.8, 3, 2)


@query(f"""WITH e AS (SELECT DISTINCT user_id, {MINUTE} AS m FROM events), g AS (SELECT user_id, lead(m) OVER (PARTITION BY user_id ORDER BY m) - m AS gap FROM e)
SELECT user_id, CASE WHEN count(*) >= 3 THEN CAST(round_even(median(gap) FILTER (WHERE gap BETWEEN 5 AND 3000), 0) AS BIGINT) END AS spacing FROM g GROUP BY user_id""")
def g9_regular_spacing(spark, d):
    return a.regular_spacing(minutes(spark, d), ["user_id"], "m", F.lit(5), F.lit(3000))


@query(f"""WITH e AS (SELECT DISTINCT user_id, {MINUTE} AS m FROM events), n AS (SELECT *, lead(m) OVER (PARTITION BY user_id ORDER BY m) - m AS gap FROM e), s AS (SELECT *, CAST(round_even(gap / 120.0, 0) AS BIGINT) AS steps FROM n)
SELECT user_id, m FROM e UNION ALL SELECT user_id, CAST(round_even(m + gap * i / CAST(steps AS DOUBLE), 0) AS BIGINT) FROM (SELECT *, unnest(generate_series(1, steps - 1)) AS i FROM s WHERE steps > 1 AND gap <= 390)""")
def g12_fill_missing(spark, d):
    return a.filled(minutes(spark, d), ["user_id"], "m", F.lit(120))


@query("SELECT l_orderkey, min(n) AS first, max(n) AS last, count(*) AS length FROM (SELECT l_orderkey, n, n - row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS g FROM (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem)) GROUP BY l_orderkey, g HAVING count(*) >= 2")
def g22_runs(spark, d):
    return a.runs(table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n")), ["l_orderkey"], "n", 2)


@query("""WITH r AS (SELECT l_orderkey, min(n) AS first, max(n) AS last FROM (SELECT l_orderkey, n, n - row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS g FROM (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem)) GROUP BY l_orderkey, g HAVING count(*) >= 3)
SELECT l_orderkey, first AS position FROM r UNION ALL SELECT l_orderkey, last FROM r""")
def g23_endpoints(spark, d):
    return a.endpoints(a.runs(table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n")), ["l_orderkey"], "n", 3), ["l_orderkey"])


@query(f"""WITH p AS (SELECT event_id, user_id, {MINUTE} AS m FROM events WHERE event_type = 'purchase'), l AS (SELECT DISTINCT user_id, {MINUTE} AS line FROM events WHERE event_type = 'error'),
b AS (SELECT event_id, arg_min(line, (abs(line - m) * 100000 + line)) AS line, min(abs(line - m)) AS gap FROM p JOIN l USING (user_id) GROUP BY event_id)
SELECT p.event_id, p.user_id, p.m, CASE WHEN gap <= 720 THEN line END AS line FROM p LEFT JOIN b USING (event_id)""")
def g24_nearest(spark, d):
    e = timed(spark, d)
    return a.nearest(e.where("event_type = 'purchase'").select("event_id", "user_id", "m"), e.where("event_type = 'error'").select("user_id", F.col("m").alias("line")), ["user_id"], "m", "line", 720)


@query(f"""WITH l AS (SELECT DISTINCT user_id, {MINUTE} AS m FROM events WHERE event_type = 'purchase'), x AS (SELECT DISTINCT user_id, {MINUTE} AS q FROM events WHERE event_type = 'view')
SELECT l.user_id, l.m, count(x.q) AS support FROM l LEFT JOIN x ON x.user_id = l.user_id AND x.q BETWEEN l.m - 300 AND l.m + 300 GROUP BY 1, 2""")
def g8_range_support(spark, d):
    e = timed(spark, d)
    return a.near_support(e.where("event_type = 'purchase'").select("user_id", "m"), e.where("event_type = 'view'").select("user_id", "m"), ["user_id"], "m", 300)


@query("""WITH s AS (SELECT s_nationkey, s_suppkey, s_suppkey % 7 AS crossings, s_suppkey % 3 AS segments, s_suppkey % 4 AS header, s_suppkey % 5 AS endpoints FROM supplier),
f AS (SELECT *, CASE WHEN s_suppkey - lag(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) > 15 THEN 1 ELSE 0 END AS n FROM s), c AS (SELECT *, sum(n) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT s_nationkey, s_suppkey, crossings, segments, header, endpoints FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey, k ORDER BY crossings + 2 * segments + 4 * header DESC, header DESC, segments DESC, crossings DESC, endpoints, s_suppkey) AS r FROM c) WHERE r = 1""")
def g19_best_of_close(spark, d):
    s = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", *[(F.col("s_suppkey") % n).alias(c) for c, n in (("crossings", 7), ("segments", 3), ("header", 4), ("endpoints", 5))])
    return a.best_of_close(s, ["s_nationkey"], "s_suppkey", 15, a.column_scores())


@query("""SELECT p_brand, p_partkey, CAST(round_even(100 + 1000 * (sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) / CAST(sum(p_size) OVER (PARTITION BY p_brand) AS DOUBLE)), 0) AS BIGINT) AS right_edge FROM part""")
def g26_proportional(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_partkey", F.col("p_size").cast("double").alias("w"))
    return a.proportional(p, ["p_brand"], "p_partkey", "w", F.lit(100), F.lit(1100)).select("p_brand", "p_partkey", "right_edge")


@query("""WITH y AS (SELECT n_regionkey AS page, n_nationkey * 10 AS v FROM nation), x AS (SELECT n_regionkey AS page, n_nationkey * 7 AS v FROM nation),
r AS (SELECT page, v AS y, lead(v) OVER w - v AS height, row_number() OVER w - 1 AS "row" FROM y WINDOW w AS (PARTITION BY page ORDER BY v)), c AS (SELECT page, v AS x, lead(v) OVER w - v AS width, row_number() OVER w - 1 AS col FROM x WINDOW w AS (PARTITION BY page ORDER BY v))
SELECT page, "row", col, x, y, width, height FROM r JOIN c USING (page) WHERE height IS NOT NULL AND width IS NOT NULL""")
def g6_grid_cells(spark, d):
    n = table(spark, d, "nation")
    return a.grid_cells(n.select(F.col("n_regionkey").alias("page"), (F.col("n_nationkey") * 10).alias("y")), n.select(F.col("n_regionkey").alias("page"), (F.col("n_nationkey") * 7).alias("x")), ["page"]).select("page", "row", "col", "x", "y", "width", "height")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN w > 0 AND h > 0 THEN x || ',' || y || ',' || w || ',' || h END AS box FROM (SELECT l_orderkey, l_linenumber, greatest(0, l_linenumber * 10 + 2) AS x, greatest(0, CAST(l_quantity AS INT) + 2) AS y,
least(60, l_linenumber * 10 + 12 - 2) - greatest(0, l_linenumber * 10 + 2) AS w, least(40, CAST(l_quantity AS INT) + 9 - 2) - greatest(0, CAST(l_quantity AS INT) + 2) AS h FROM lineitem)""")
def c1_clipped(spark, d):
    box = a.clipped(F.col("l_linenumber") * 10, F.col("l_quantity").cast("int"), F.lit(12), F.lit(9), F.lit(60), F.lit(40), padding=2)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", box.alias("b")).select("l_orderkey", "l_linenumber", F.when(F.col("b").isNotNull(), F.concat_ws(",", "b.x", "b.y", "b.width", "b.height")).alias("box"))


@query("""SELECT c_nationkey, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM (SELECT c_nationkey, CAST(round_even(10 + (c_custkey - 10) * CAST(unnest(generate_series(0, 4)) AS DOUBLE) / 4, 0) AS BIGINT) AS v FROM customer) GROUP BY c_nationkey""")
def g27_regular_rows(spark, d):
    rows = table(spark, d, "customer").select("c_nationkey", F.explode(a.regular_rows(F.lit(10), F.col("c_custkey"), F.lit(5))).alias("v"))
    return rows.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("SELECT o_orderkey, greatest(0.0, 1 - abs(count(*) - 5) / 5.0) AS score FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def g28_count_score(spark, d):
    n = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.count("*").alias("n"))
    return n.select("o_orderkey", a.count_score(F.col("n"), F.lit(5.0)).alias("score"))


@query(f"""WITH e AS (SELECT DISTINCT user_id, {MINUTE} AS m FROM events), g AS (SELECT user_id, lead(m) OVER (PARTITION BY user_id ORDER BY m) - m AS gap FROM e)
SELECT user_id, round(CASE WHEN count(*) >= 3 AND avg(gap) > 0 THEN least(1.0, 0.5 * 0.8 + greatest(0.0, 1 - stddev_pop(gap) / avg(gap)) * 0.2) ELSE 0.5 END, 6) AS confidence FROM g GROUP BY user_id""")
def g29_template_confidence(spark, d):
    return a.template_confidence(minutes(spark, d), ["user_id"], "m", F.lit(0.5)).withColumn("confidence", F.round("confidence", 6))


@query("""WITH s AS (SELECT s_nationkey, s_suppkey, s_suppkey % 4 AS support FROM supplier), f AS (SELECT *, coalesce(min(CASE WHEN support >= 2 THEN s_suppkey END) OVER w, min(CASE WHEN support >= 1 THEN s_suppkey END) OVER w) AS first FROM s WINDOW w AS (PARTITION BY s_nationkey)),
k AS (SELECT * FROM f WHERE s_suppkey >= first AND support >= 1), g AS (SELECT *, coalesce(CAST(s_suppkey - lag(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) > 32.5 AS INT), 0) AS gap FROM k),
c AS (SELECT *, sum(gap) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS UNBOUNDED PRECEDING) AS cut FROM g) SELECT s_nationkey, s_suppkey, support FROM c WHERE cut = 0""")
def g13_trimmed(spark, d):
    s = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", (F.col("s_suppkey") % 4).alias("support"))
    return a.trimmed(s, ["s_nationkey"], "s_suppkey", "support", F.lit(10.0))


@query("""WITH s AS (SELECT s_nationkey, s_suppkey, s_suppkey % 6 AS support FROM supplier), n AS (SELECT *, count_if(support >= 3) OVER (PARTITION BY s_nationkey) AS n FROM s) SELECT s_nationkey, s_suppkey, support FROM n WHERE n < 2 OR support >= 3""")
def g14_supported(spark, d):
    s = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", (F.col("s_suppkey") % 6).alias("support"))
    return a.supported(s, ["s_nationkey"], "support", F.lit(18))


@query("""WITH s AS (SELECT s_nationkey, s_suppkey, s_suppkey % 5 AS header, s_suppkey % 3 AS segments, s_suppkey % 4 AS endpoints FROM supplier), n AS (SELECT *, header >= 4 OR segments >= 2 OR endpoints >= 3 AS good FROM s), k AS (SELECT *, count_if(good) OVER (PARTITION BY s_nationkey) AS n FROM n)
SELECT s_nationkey, s_suppkey, header, segments, endpoints FROM k WHERE CASE WHEN n >= 2 THEN good ELSE s_suppkey % 2 = 0 END""".replace("header >= 4", "header >= 2"))
def g18_kept_columns(spark, d):
    s = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", *[(F.col("s_suppkey") % n).alias(c) for c, n in (("header", 5), ("segments", 3), ("endpoints", 4))])
    return a.kept_columns(s, ["s_nationkey"], F.lit(2), F.lit(3), F.col("s_suppkey") % 2 == 0)


@query("""WITH s AS (SELECT s_nationkey AS k, s_suppkey AS p, s_suppkey % 4 AS header FROM supplier), l AS (SELECT *, lag(p) OVER (PARTITION BY k ORDER BY p) AS q, count(*) OVER (PARTITION BY k) AS n FROM s),
w AS (SELECT k, max(p - q) AS gap FROM l WHERE n >= 4 GROUP BY k), r AS (SELECT l.k, w.gap, min(p) AS hi, min_by(q, p) AS lo FROM l JOIN w ON l.k = w.k AND l.p - l.q = w.gap GROUP BY l.k, w.gap),
a AS (SELECT s.k, max(p) AS anchor FROM s JOIN r ON s.k = r.k AND p <= lo WHERE header >= 2 GROUP BY s.k)
SELECT s.k, p, header FROM s LEFT JOIN r ON s.k = r.k LEFT JOIN a ON s.k = a.k WHERE NOT coalesce(gap >= 20 AND p > anchor AND p < hi, FALSE)""")
def g21_without_wide_gap(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("p"), (F.col("s_suppkey") % 4).alias("header"))
    return a.without_wide_gap(s, ["k"], "p", "header", F.lit(20))


@query("""WITH b AS (SELECT o_orderkey AS page, 0 AS band, 0 AS top, 4 AS bottom FROM orders UNION ALL SELECT o_orderkey, 1, 4, 8 FROM orders), i AS (SELECT DISTINCT l_orderkey AS page, l_suppkey % 2 AS col, l_linenumber AS y FROM lineitem),
h AS (SELECT page, col, band, count(*) AS n FROM i JOIN b USING (page) WHERE y >= top AND y < bottom GROUP BY ALL) SELECT page, col AS "column", count(*) AS segments FROM h WHERE n >= 2 GROUP BY ALL""")
def g15_segment_support(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("page"))
    bands = o.select("page", F.inline(F.array(*[F.struct(F.lit(i).alias("band"), F.lit(t).alias("top"), F.lit(b).alias("bottom")) for i, t, b in ((0, 0, 4), (1, 4, 8))])))
    ink = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_suppkey") % 2).alias("column"), F.col("l_linenumber").alias("y"))
    return a.segment_support(bands, ink, ["page"])


@query("""SELECT s_suppkey, CAST(s_suppkey % 2 = 0 AS INT) + CAST(s_suppkey % 3 = 0 AS INT) + CAST(s_suppkey % 6 = 0 AND s_suppkey / 100.0 >= 0.45 AS INT) AS support FROM supplier""")
def g16_header_support(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", a.header_support(k % 2 == 0, k % 3 == 0, k / 100.0).alias("support"))


@query("SELECT s_suppkey, CAST(least(44, greatest(3, greatest(floor(s_suppkey * 40 / 250.0), round_even(s_suppkey / 2.0, 0)))) AS BIGINT) AS gap FROM supplier")
def g20_separation(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", a.separation(F.col("s_suppkey"), F.col("s_suppkey") * 40).cast("long").alias("gap"))


@query("SELECT s_suppkey, CAST(greatest(2, round_even(s_suppkey * 0.45, 0)) AS BIGINT) AS tolerance FROM supplier")
def g10_merge_tolerance(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", a.merge_tolerance(F.col("s_suppkey")).cast("long").alias("tolerance"))


@query(f"WITH {CLUSTERS}, p AS (SELECT user_id, m FROM g UNION SELECT user_id, {MINUTE} FROM events WHERE event_type = 'signup'), f2 AS (SELECT *, CASE WHEN m - lag(m) OVER (PARTITION BY user_id ORDER BY m) > 60 THEN 1 ELSE 0 END AS s FROM p), c2 AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY m ROWS UNBOUNDED PRECEDING) AS k FROM f2) SELECT user_id, CAST(round_even(avg(m), 0) AS BIGINT) AS m FROM c2 GROUP BY user_id, k")
def g17_header_candidates(spark, d):
    """Peaks and endpoints in one list, close ones merged."""
    points = a.clustered(minutes(spark, d), ["user_id"], "m", 120).unionByName(timed(spark, d).where("event_type = 'signup'").select("user_id", "m")).distinct()
    return a.clustered(points, ["user_id"], "m", 60)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 3 WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS cells FROM orders")
def g30_chosen_grid(spark, d):
    k = F.col("o_orderkey")
    some = lambda n, when: F.when(when, F.array_repeat(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return table(spark, d, "orders").select("o_orderkey", F.size(a.chosen_grid(some(2, k % 2 == 0), some(1, F.lit(True)), some(3, k % 3 == 0))).alias("cells"))


POINTS = "p AS (SELECT l_orderkey AS page, l_partkey % 97 AS x, l_suppkey % 89 AS y, l_partkey % 97 + l_suppkey % 89 AS s, l_suppkey % 89 - l_partkey % 97 AS t FROM lineitem)"


@query(f"WITH {POINTS} SELECT page, min(s) AS top_left, min(t) AS top_right, max(s) AS bottom_right, max(t) AS bottom_left FROM p GROUP BY page")
def i25_corners(spark, d):
    points = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_partkey") % 97).alias("x"), (F.col("l_suppkey") % 89).alias("y"))
    q = a.corners(points, ["page"])
    f = lambda c, sign: (F.col(f"{c}.y") + sign * F.col(f"{c}.x")).alias(c)
    return q.select("page", f("top_left", 1), f("top_right", -1), f("bottom_right", 1), f("bottom_left", -1))


@query(f"""WITH {POINTS}, q AS (SELECT page, arg_min({{'x': x, 'y': y}}, (s, x, y)) AS a, arg_min({{'x': x, 'y': y}}, (t, x, y)) AS b, arg_min({{'x': x, 'y': y}}, (-s, x, y)) AS c, arg_min({{'x': x, 'y': y}}, (-t, x, y)) AS d FROM p GROUP BY page)
SELECT page, CAST(round_even(greatest(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), sqrt((d.x - c.x) ** 2 + (d.y - c.y) ** 2)), 0) AS BIGINT) AS width, CAST(round_even(greatest(sqrt((a.x - d.x) ** 2 + (a.y - d.y) ** 2), sqrt((b.x - c.x) ** 2 + (b.y - c.y) ** 2)), 0) AS BIGINT) AS height FROM q""")
def i27_target_size(spark, d):
    points = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_partkey") % 97).alias("x"), (F.col("l_suppkey") % 89).alias("y"))
    return a.target_size(a.corners(points, ["page"])).select("page", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"))


@query(f"""WITH {POINTS}, c AS (SELECT page, x, y, avg(x) OVER (PARTITION BY page) AS cx, avg(y) OVER (PARTITION BY page) AS cy FROM p)
SELECT page, x, y, round(greatest(0.0, least(96.0, x + coalesce((x - cx) * 4.0 / nullif(sqrt((x - cx) ** 2 + (y - cy) ** 2), 0), 0.0))), 6) AS px, round(greatest(0.0, least(88.0, y + coalesce((y - cy) * 4.0 / nullif(sqrt((x - cx) ** 2 + (y - cy) ** 2), 0), 0.0))), 6) AS py FROM c""")
def i26_padded_corners(spark, d):
    points = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_partkey") % 97).alias("x"), (F.col("l_suppkey") % 89).alias("y"))
    return a.padded_corners(points, ["page"], 4.0, F.lit(97), F.lit(89)).withColumns({"px": F.round("px", 6), "py": F.round("py", 6)})


@query("""WITH h AS (SELECT DISTINCT l_suppkey % 5 AS page, l_linenumber AS y, l_partkey % 50 AS x FROM lineitem WHERE l_returnflag = 'A'), v AS (SELECT DISTINCT l_suppkey % 5 AS page, l_linenumber AS y, l_partkey % 50 AS x FROM lineitem WHERE l_returnflag = 'R') SELECT page, y, x FROM h JOIN v USING (page, y, x)""")
def i22_crossings(spark, d):
    mask = lambda flag: table(spark, d, "lineitem").where(F.col("l_returnflag") == flag).select((F.col("l_suppkey") % 5).alias("page"), F.col("l_linenumber").alias("y"), (F.col("l_partkey") % 50).alias("x")).distinct()
    return a.crossings(mask("A"), mask("R"), ["page"])


@query("""WITH l AS (SELECT l_suppkey % 5 AS page, l_linenumber AS y, l_partkey % 50 AS x, l_partkey % 3 AS label, l_returnflag AS f FROM lineitem) SELECT v.page, v.label, count(DISTINCT h.label) AS crossed FROM l v JOIN l h ON v.page = h.page AND v.y = h.y AND v.x = h.x AND v.f = 'A' AND h.f = 'R' GROUP BY 1, 2 HAVING count(DISTINCT h.label) >= 2""")
def i18_crossing_components(spark, d):
    mask = lambda flag: table(spark, d, "lineitem").where(F.col("l_returnflag") == flag).select((F.col("l_suppkey") % 5).alias("page"), F.col("l_linenumber").alias("y"), (F.col("l_partkey") % 50).alias("x"), (F.col("l_partkey") % 3).alias("label")).distinct()
    return a.crossing_components(mask("R"), mask("A"), ["page"], 2)


@query("""SELECT p_partkey, greatest(3, CAST(trunc(p_size * 1.55) AS INT), CAST(floor(p_retailprice / 32) AS INT)) AS across, greatest(3, CAST(trunc(greatest(3, CAST(trunc(p_size * 1.55) AS INT), CAST(floor(p_retailprice / 32) AS INT)) * 0.6) AS INT), CAST(floor(p_retailprice / 80) AS INT)) AS down FROM part""")
def i15_kernel_size(spark, d):
    across, down = a.kernel_size(F.col("p_size"), 1.55, F.col("p_retailprice"), F.col("p_retailprice"))
    return table(spark, d, "part").select("p_partkey", across.alias("across"), down.alias("down"))


@query("""SELECT p_partkey, CASE WHEN a < 10000 THEN 1 ELSE 2 END AS least, CASE WHEN a < 10000 THEN 0.02 ELSE 0.005 END AS share, CASE WHEN a < 10000 THEN 4.0 ELSE 3.0 END AS aspect FROM (SELECT p_partkey, p_size * p_retailprice AS a FROM part)""")
def i23_crossing_limits(spark, d):
    least, share, aspect = a.crossing_limits(F.col("p_size") * F.col("p_retailprice"))
    return table(spark, d, "part").select("p_partkey", least.alias("least"), share.alias("share"), aspect.alias("aspect"))
