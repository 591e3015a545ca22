"""What grows with the input must not: rounds, plans and rows of the steps that many pages share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridloom.operators import axis, hough, raster, refine, ruling


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_components_move_runs_once(spark):
    """Runs go to their page's task in one shuffle, without joins or written rounds; pages that span batches stay whole."""
    page = np.full((300, 8), 255, np.uint8)
    page[::2] = 0
    page[1::4, 0] = page[3::4, 7] = 0  # one winding stroke
    pages = spark.createDataFrame([(i, 300, 8, bytes(page.ravel())) for i in range(40)], "page long, height int, width int, data binary")
    found = raster.components(raster.ink_runs(pages))
    assert plan_of(found).count("Exchange") == 1 and "Join" not in plan_of(found)
    assert found.select("page", "label").distinct().collect() and {r.label for r in found.collect()} == {0}
    few = raster.whole_pages(raster.ink_runs(pages), ["y", "start"], found.select("page", "y").schema, lambda t: t.select(["page", "y"]).filter(pa.array(raster.changes(t["page"]))), 7)
    assert sorted((r.page, r.y) for r in few.collect()) == [(i, 0) for i in range(40)]


def test_components_where_a_page_comes_twice(spark):
    """Overlapping runs touch by what they cover."""
    runs = spark.createDataFrame([("a", 0, 0, 9), ("a", 0, 2, 3), ("a", 1, 8, 9), ("a", 2, 4, 5), ("b", 1, 8, 9)], "page string, y int, start int, end int")
    got = {(r.page, r.y, r.start): r.label for r in raster.components(runs).collect()}
    assert got == {("a", 0, 0): 0, ("a", 0, 2): 2, ("a", 1, 8): 0, ("a", 2, 4): (2 << 32) + 4, ("b", 1, 8): (1 << 32) + 8}


def test_least_labels_of_chains(spark):
    nodes = spark.createDataFrame([(p, n) for p in (1, 2) for n in range(50)], "page long, node long")
    links = nodes.where((F.col("node") > 0) & (F.col("node") != 20)).select("page", "node", (F.col("node") - 1).alias("other"))
    assert {(r.node, r.label) for r in raster.least_labels(nodes, links).where("page = 2").collect()} == {(n, 0 if n < 20 else 20) for n in range(50)}


def test_peaks_within_a_page_are_those_of_all_votes(spark):
    """The kernel of skew() gives what votes() and peaks() give."""
    rng = np.random.default_rng(5)
    pages = spark.createDataFrame([(i, 12, 9, rng.integers(0, 256, 108, dtype=np.uint8).tobytes()) for i in range(6)], "page long, height int, width int, data binary")
    degrees = [i * 0.5 for i in range(-30, 31)]
    want = hough.peaks(hough.votes(hough.edge_pixels(pages), degrees), 4)
    got = raster.per_page(pages, "angle d n", lambda values, _: hough.page_peaks(values, degrees, 4, 128))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and "votes" not in hough.skew.__code__.co_names


def test_segment_support_has_tasks_by_rows(spark, monkeypatch):
    """More rows make more tasks, not larger ones, and give the same sums."""
    bands = spark.range(40).selectExpr("id as page", "0 as band", "0 as top", "4 as bottom")
    ink = bands.selectExpr("page", "page % 2 as column", "explode(sequence(0, page % 4)) as y")
    want = sorted(map(tuple, axis.segment_support(bands, ink, ["page"]).collect()))
    monkeypatch.setattr(axis, "ROWS_A_TASK", 14)
    found = axis.segment_support(bands, ink, ["page"])
    assert "hashpartitioning(page" in plan_of(found) and ", 10)" in plan_of(found)
    assert sorted(map(tuple, found.collect())) == want == [(i, i % 2, 1) for i in range(40) if i % 4]


def test_masks_are_measured_once_a_pass(spark, monkeypatch):
    """Each of the four kernels of a grid sees each page once."""
    across, down = (np.zeros((60, 60), np.uint8) for _ in range(2))
    across[5:56:10, 5:56] = down[5:56, 5:56:10] = 255
    masks = spark.createDataFrame([(i, 60, 60, across.tobytes(), down.tobytes()) for i in range(6)], "page long, height int, width int, horizontal binary, vertical binary")
    seen = {}
    for name in ("profiles", "supports", "ends", "column_supports"):
        seen[name] = spark.sparkContext.accumulator(0)

        def counted(a, d, own, kernel=getattr(refine, name), done=seen[name]):
            done.add(1)
            return kernel(a, d, own)

        monkeypatch.setattr(refine, name, counted)
    assert refine.refined_grid(masks).cells.count() == 6 * 25
    assert {k: v.value for k, v in seen.items()} == dict.fromkeys(seen, 6)


def test_rules_look_at_a_page_once(spark):
    """Each page's bytes are made once for all that rules ask of them, and an upright rule is a row for each of its columns, whatever its height."""
    page = np.full((110, 90), 255, np.uint8)
    page[10:110:30, 10:80] = page[10:101, 10:80:23] = 0
    seen = spark.sparkContext.accumulator(0)

    @F.udf("binary")
    def drawn(data):
        seen.add(1)
        return data

    rows = [(i, 110, 90, page.tobytes()) for i in range(6)] + [(6, 0, 0, b""), (7, 10, 9, None)]
    pages = spark.createDataFrame(rows, "page long, height int, width int, data binary").repartition(3, "page").withColumn("data", drawn("data"))
    points = ruling.page_crossings(pages, 0.3).collect()
    assert seen.value <= len(rows)
    assert sorted(map(tuple, points)) == [(i, x, y) for i in range(6) for x in range(10, 80, 23) for y in range(10, 110, 30)]
    _, upright, _ = ruling.rules(pages, 0.3)
    assert sorted((r.page, r.y, r.start, r.end) for r in upright.collect()) == [(i, x, 10, 100) for i in range(6) for x in range(10, 80, 23)]
    seen.value = 0
    ruling.ruled_lines(pages, 0.3)
    assert seen.value <= len(rows)
