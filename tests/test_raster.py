"""Images as rows against numpy kernels and plain Python."""

from __future__ import annotations

import numpy as np
import pytest

from gridloom.operators import image, raster
from tests.test_process import PAGE


@pytest.fixture(scope="module")
def drawn() -> list[np.ndarray]:
    rng = np.random.default_rng(5)
    blobs = np.where(rng.random((23, 31)) < 0.35, rng.integers(0, 100, (23, 31)), rng.integers(150, 256, (23, 31))).astype(np.uint8)
    snake = np.full((15, 17), 255, np.uint8)
    for i in range(0, 15, 2):
        snake[i] = 0
    for i in range(1, 15, 2):
        snake[i, 16 if i % 4 == 1 else 0] = 0
    return [blobs, rng.integers(0, 256, (16, 40)).astype(np.uint8), snake, np.full((9, 12), 255, np.uint8), np.zeros((8, 9), np.uint8)]


@pytest.fixture(scope="module")
def pages(spark, drawn):
    return spark.createDataFrame([(i, *p.shape, p.tobytes()) for i, p in enumerate(drawn)], PAGE)


def whole(rows, shapes) -> list[np.ndarray]:
    out = [np.full(s, -1) for s in shapes]
    for r in rows.collect():
        assert out[r.page][r.y, r.x] == -1
        out[r.page][r.y, r.x] = r.v
    return out


def same(rows, want) -> None:
    for got, w in zip(whole(rows, [w.shape for w in want]), want, strict=True):
        assert (got == w).all()


@pytest.mark.parametrize("window", [3, 5, 6])
def test_sauvola(pages, drawn, window):
    same(raster.sauvola(pages, window), [image.sauvola(p, window) for p in drawn])


def test_turned(pages, drawn):
    for angle in (7.0, -3.5, 0.05):
        got, want = whole(raster.rotated(pages, angle), [p.shape for p in drawn]), [image.rotated(p, angle) for p in drawn]
        for i in (0, 1):  # the others are two-valued
            assert np.abs(got[i] - want[i]).max() <= 1 and (got[i] != want[i]).mean() < 0.01
    got = whole(raster.rotated(pages, 5.0, nearest=True), [p.shape for p in drawn])
    assert (got[2] == image.rotated(drawn[2], 5.0)).all()


@pytest.mark.parametrize("width", [1, 5, 12, 20, 100])
def test_narrowed(pages, drawn, width):
    got, want = whole(raster.narrowed(pages, width), [image.narrowed(p, width)[0].shape for p in drawn]), [image.narrowed(p, width)[0] for p in drawn]
    assert all(np.abs(g - w).max() <= 1 and (g != w).mean() < 0.02 for g, w in zip(got, want, strict=True))


def masks_of(rows, drawn) -> list[np.ndarray]:
    out = [np.zeros(p.shape, bool) for p in drawn]
    for r in rows.collect():
        out[r.page][r.y, r.x] = True
    return out


def test_runs(pages, drawn):
    runs = raster.ink_runs(pages)
    for got, p in zip(masks_of(raster.run_pixels(runs), drawn), drawn, strict=True):
        assert (got == (p < 128)).all()
    for size in (1, 2, 4):
        for op, kernel in ((raster.long_runs, image.opened), (raster.closed_runs, image.closed)):
            for got, p in zip(masks_of(raster.run_pixels(op(runs, size)), drawn), drawn, strict=True):
                assert (got == kernel(p < 128, size, 1)).all()
    assert sorted(map(tuple, raster.runs_of(raster.run_pixels(runs)).select("page", "y", "start", "end").collect())) == sorted(map(tuple, runs.collect()))


def test_components(pages, drawn):
    """As many as a kernel finds, each the same pixels, with the same boxes; a snake over the page is one."""
    labelled = raster.components(raster.ink_runs(pages))
    found = {(r.page, r.top, r.left, r.height, r.width, r.area, round(r.x, 6), round(r.y, 6)) for r in raster.component_boxes(labelled).collect()}
    want = set()
    for i, p in enumerate(drawn):
        for area, top, left, height, width, x, y in image.boxes(*image.labels(p < 128)).tolist():
            want.add((i, int(top), int(left), int(height), int(width), int(area), round(x, 6), round(y, 6)))
    assert found == want and sum(f[0] == 2 for f in found) == 1
    sizes = {r.page: (r.median_height, r.component_count) for r in raster.character_sizes(pages, 4).collect()}
    assert sizes == {r.page: (r.median_height, r.component_count) for r in image.character_sizes(pages, 4).collect()}


@pytest.mark.parametrize("size", [2, 5])
def test_cleaned(spark, size):
    rng = np.random.default_rng(size)
    pages = [np.where(rng.random((20, 25)) < share, 0, 255).astype(np.uint8) for share in (0.2, 0.75, 0.0)]
    df = spark.createDataFrame([(i, *p.shape, p.tobytes()) for i, p in enumerate(pages)], PAGE)
    same(raster.cleaned(raster.levels(df), size), [image.denoised(p, size) for p in pages])


def test_warped(pages, drawn):
    corners = [(2.0, 1.0), (25.0, 3.0), (28.0, 20.0), (1.0, 18.0)]
    h, w, to_source = raster.homography(corners)
    want = image.upright(drawn[0], np.array(corners))
    got = whole(raster.warped(pages.where("page = 0"), to_source, h, w), [want.shape])[0]
    assert (h, w) == want.shape and np.abs(got - want).max() <= 1 and (got != want).mean() < 0.01


def test_painted(pages, drawn):
    same(raster.painted(pages, [(3, 4), (9, 9)], 1), [image.redacted(p, [(3, 4), (9, 9)], 1) for p in drawn])


def test_redaction_by_curve_border_and_grid(spark):
    """Each side of a redacted column follows what is known of its edge; a curve with a gap isn't followed."""
    page = np.full((12, 60), 100, np.uint8)
    pages = spark.createDataFrame([(0, *page.shape, page.tobytes())], PAGE)
    tables = spark.createDataFrame([(0, 2, 10)], "page int, top int, bottom int")
    borders = spark.createDataFrame([(0, 0, 10, 10.0, 10.0, False), (0, 1, 20, 19.0, 23.0, True), (0, 2, 30, 30.0, 30.0, False), (0, 3, 40, 40.0, 48.0, True)], "page int, index int, x int, top_x double, bottom_x double, matched boolean")
    curves = spark.createDataFrame([(0, 2, y, 30 + y % 2) for y in range(2, 10)] + [(0, 3, y, 0) for y in range(2, 9)], "page int, index int, y int, x int")
    ranges = spark.createDataFrame([(0, 0, 0, 1), (0, 1, 2, 3)], "page int, range int, left_index int, right_index int")
    lines = raster.redaction_lines(ranges, tables, borders, curves)
    assert {(r.range, r.left_by, r.right_by) for r in lines.collect()} == {(0, "grid", "border"), (1, "curve", "border")}
    want = page.copy()
    for y in range(2, 10):
        for left, right in ((10, 19 + 4 * (y - 2) / 8), (30 + y % 2, 40 + y - 2)):
            for x in range(60):
                if left - 1 <= x <= right + 1:
                    want[y, x] = 255
    same(raster.painted_lines(pages, lines, 1), [want])
    assert {r.left_by for r in raster.redaction_lines(ranges, tables, borders).collect()} == {"grid"}
