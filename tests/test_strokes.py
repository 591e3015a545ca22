"""Votes, strokes and borders on drawn pages, and against plain Python."""

from __future__ import annotations

import collections
import itertools
import math
import random

import numpy as np
import pytest

from gridloom.operators import hough, image
from tests.test_operators import form

PAGE = "page int, height int, width int, data binary"


def as_pages(spark, *drawn: np.ndarray):
    return spark.createDataFrame([(i, *p.shape, p.tobytes()) for i, p in enumerate(drawn)], PAGE)


def slanted(height: int, width: int, x0: float, x1: float, y0: int, y1: int, thick: int = 2, gaps=()) -> np.ndarray:
    page = np.full((height, width), 255, np.uint8)
    for y in range(y0, y1):
        if not any(a <= y < b for a, b in gaps):
            x = round(x0 + (x1 - x0) * (y - y0) / (y1 - y0))
            page[y, x : x + thick] = 0
    return page


@pytest.mark.parametrize("angles", [[0.0, 2.0, -3.5, 7.25], [-12.0, 11.1, 0.6, -0.4]])
def test_skew_of_turned_forms(spark, angles):
    """The median stroke leans as the page was turned, within half a degree."""
    page, _, _ = form()
    noisy = page.copy()
    rng = np.random.default_rng(1)
    for _ in range(60):  # handwriting-like strokes
        y, x = rng.integers(10, 400), rng.integers(10, 480)
        for i in range(14):
            noisy[min(419, y + i), min(519, x + i // 2)] = 0
    got = {r.page: r.angle for r in hough.skew(as_pages(spark, *[image.rotated(noisy, -a) for a in angles])).collect()}
    assert all(abs(got[i] - a) <= 0.5 for i, a in enumerate(angles)), got


def test_skew_without_strokes(spark):
    blank = np.full((60, 80), 255, np.uint8)
    steep = slanted(300, 300, 20, 250, 10, 290)
    got = [r.angle for r in hough.skew(as_pages(spark, blank, steep, np.zeros((4, 4), np.uint8))).collect()]
    assert got[0] == got[1] == 0.0 and len(got) == 3


def brute_segments(page: np.ndarray, degrees, threshold, gap, least, angles=2, apart=2):
    h, w = page.shape
    dark = page < 128
    points = [(x, y) for y in range(h) for x in range(w) if dark[y, x] and (x == 0 or not dark[y, x - 1])]
    place = lambda x, y, d: math.floor(y * math.cos(math.radians(d)) - x * math.sin(math.radians(d)) + 0.5)
    votes = collections.Counter((i, place(x, y, d)) for x, y in points for i, d in enumerate(degrees))
    strong = {k: n for k, n in votes.items() if n >= threshold}
    rank = lambda k: (strong[k], -k[0], -k[1])
    peaks = [k for k in strong if all(rank(k) > rank(o) for o in strong if o != k and abs(o[0] - k[0]) <= angles and abs(o[1] - k[1]) <= apart)]
    out = []
    for i, d in peaks:
        c, s = math.cos(math.radians(degrees[i])), math.sin(math.radians(degrees[i]))
        own = sorted((x * c + y * s, x, y) for x, y in points if abs(place(x, y, degrees[i]) - d) <= 1)
        runs = [[own[0]]]
        for a, b in itertools.pairwise(own):
            runs.append([b]) if b[0] - a[0] > gap else runs[-1].append(b)
        out += [(i, d, *r[0][1:], *r[-1][1:], len(r)) for r in runs if r[-1][0] - r[0][0] >= least]
    return sorted(out)


def test_segments_against_brute_force(spark):
    rng = np.random.default_rng(3)
    page = np.where(rng.random((40, 50)) < 0.06, 0, 255).astype(np.uint8)
    for x0, x1 in ((8, 12), (30, 26)):
        page = np.minimum(page, slanted(40, 50, x0, x1, 2, 38, 1, [(15, 18)]))
    degrees = [90 + i * 3 for i in range(-6, 7)]
    points = hough.edge_pixels(as_pages(spark, page), axis=1)
    found = hough.segments(points, hough.peaks(hough.votes(points, degrees), 9), degrees, 6, 12)
    got = sorted((r.angle, r.d, r.x1, r.y1, r.x2, r.y2, r.points) for r in found.collect())
    assert got == brute_segments(page, degrees, 9, 6, 12) and len(got) >= 2


def test_weak_steep_rules_come_back(spark):
    """Leaning and broken rules, which no long run of dark pixels in a column shows, are recovered where they were drawn."""
    gaps = [(y, y + 4) for y in range(40, 380, 30)]
    page, lean = np.full((420, 520), 255, np.uint8), {}
    for x, by in ((60, 9), (200, -14), (400, 25)):
        one = slanted(420, 520, x, x + by, 20, 400, 1, gaps)
        page, lean[x] = np.minimum(page, one), by
    page[210, 20:500] = 0  # a level rule is none of them
    assert not image.opened(page < 128, 60, 0).any()
    found = hough.steep_segments(as_pages(spark, page), 60)
    ink = {(r.x, r.y) for r in hough.drawn(found).collect()}
    for x, by in lean.items():
        near = sum(any((round(x + by * (y - 20) / 380) + i, y) in ink for i in (-1, 0, 1)) for y in range(20, 400))
        assert near >= 0.95 * 380
    assert all(any(abs(x + by * (py - 20) / 380 - px) <= 2.5 for x, by in lean.items()) for px, py in ink)
    assert hough.steep_segments(as_pages(spark, np.full((50, 50), 255, np.uint8)), 60).count() == 0


def test_drawn_gaps(spark):
    found = spark.createDataFrame([(1, 5, 0, 5, 9), (1, 5, 13, 5, 20), (1, 5, 26, 5, 30), (1, 9, 8, 7, 4)], "page int, x1 int, y1 int, x2 int, y2 int")
    got = sorted((r.x, r.y) for r in hough.drawn(found).collect())
    assert got == sorted([(5, y) for y in [*range(21), *range(26, 31)]] + [(7, 4), (8, 5), (8, 6), (9, 7), (9, 8)])


def test_borders_of_a_slanted_form(spark):
    """Edges find the printed rules beside them, leaning ones too, within two pixels; edges without a rule keep their place."""
    rows, cols, lean = [30 + 25 * i for i in range(13)], [50, 150, 260, 330, 450], [6, -7, 0, 5, None]
    page = np.full((360, 520), 255, np.uint8)
    for x, by in zip(cols, lean, strict=True):
        if by is not None:
            page = np.minimum(page, slanted(360, 520, x - by / 2, x + by / 2, 30, 330, 2, [(100, 112), (220, 228)]))
    for x in range(60, 500, 37):  # short strokes
        page[200 + x % 7 : 212, x] = 0
    pages = as_pages(spark, page)
    tables = spark.createDataFrame([(0, rows[0], rows[-1], 25)], "page int, top int, bottom int, row_height int")
    rules = hough.border_rules(pages, tables, tables["row_height"])
    edges = spark.createDataFrame([(0, i, x + d) for i, (x, d) in enumerate(zip(cols, (2, -2, 3, 0, 1), strict=True))], "page int, index int, x int")
    got = {r["index"]: r for r in hough.matched_borders(edges, rules).collect()}
    for i, (x, by) in enumerate(zip(cols, lean, strict=True)):
        if by is None:
            assert not got[i].matched and got[i].top_x == got[i].bottom_x == x + 1
        else:
            assert got[i].matched and abs(got[i].top_x - (x - by / 2)) <= 2 and abs(got[i].bottom_x - (x + by / 2)) <= 2, (i, got[i])


def test_matching_against_brute_force(spark):
    rng = random.Random(4)
    edges = [(p, i, rng.randrange(1000)) for p in range(4) for i in range(12)] + [(9, 0, 5)]
    rules = [(p, a := rng.randrange(-5, 1010), a + rng.randrange(-6, 7), float(rng.randrange(5))) for p in range(5) for _ in range(60)]
    span = {p: max(3.0, (max(x for q, _, x in edges if q == p) - min(x for q, _, x in edges if q == p)) * 0.015) for p, _, _ in edges}
    want = {}
    for p, i, x in edges:
        near = [(abs((a + b) / 2 - x), -n, a, b) for q, a, b, n in rules if q == p and abs((a + b) / 2 - x) <= span[p]]
        want[p, i] = min(near)[2:] if near else (x, x)
    frame = spark.createDataFrame([(p, float(a), float(b), n) for p, a, b, n in rules], "page int, top_x double, bottom_x double, length double")
    got = {(r.page, r["index"]): (r.top_x, r.bottom_x) for r in hough.matched_borders(spark.createDataFrame(edges, "page int, index int, x int"), frame).collect()}
    assert got == want
