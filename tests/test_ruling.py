"""Rules found as runs against numpy, and against pages drawn for the purpose."""

from __future__ import annotations

import numpy as np

from gridloom.operators import image, raster, ruling
from tests.test_operators import form
from tests.test_process import PAGE


def letters(page: np.ndarray, rng: np.random.Generator, n: int) -> None:
    """n small boxes, as high as a character."""
    h, w = page.shape
    for _ in range(n):
        y, x = rng.integers(0, h - 8), rng.integers(0, w - 6)
        page[y : y + 7, x : x + 1 + rng.integers(1, 5)] = 0


def character_height(mask: np.ndarray, least_area: int = 10) -> int:
    """Median height of the mask's components of at least that area; 0 without any."""
    box = image.boxes(*image.labels(mask))
    heights = box[box[:, 0] >= least_area, 3]
    return int(np.median(heights)) if len(heights) else 0


def crossing_gate(mask: np.ndarray, other: np.ndarray, least: int, dx: int = 1, dy: int = 1) -> np.ndarray:
    """Components of the mask that touch at least `least` distinct components of the other, when that is grown by dx and dy."""
    label, n = image.labels(mask)
    wide = np.pad(other, ((dy, dy), (dx, dx)))
    theirs, _ = image.labels(np.maximum.reduce([wide[a : a + mask.shape[0], b : b + mask.shape[1]] for a in range(2 * dy + 1) for b in range(2 * dx + 1)]))
    both = np.unique(np.stack([label[theirs > 0], theirs[theirs > 0]]), axis=1)
    return np.concatenate(([False], np.bincount(both[0], minlength=n + 1)[1:] >= least))[label]


def ruled_lines(page: np.ndarray, scale: float = 1.55, shortest: float | None = None) -> image.Lines:
    """Rules of a two-valued page: small gaps closed, long runs, thin and long components, that cross the other direction. Of as many dark as light pixels the light ones are ink."""
    dark = page < 128
    ink = dark if 2 * dark.sum() < dark.size else ~dark
    h, w = page.shape
    char = character_height(ink) or 10
    across = max(3, int(char * scale), w // 32)
    down = max(3, int(0.6 * across), h // 80)
    rows = image.opened(image.closed(ink, min(max(across // 4, 1), max(1, w // 180)), 1), across, 1)
    cols = image.opened(image.closed(ink, min(max(down // 2, 1), max(1, h // 180)), 0), down, 0)
    long_row, long_col = max(18, min(int(0.08 * w), 2 * across)), max(14, min(int(0.08 * h), 3 * down))
    if shortest is not None:
        long_row = min(long_row, max(3, round(w * shortest)))
    thick = max(2, min(24, 2 * char))
    rows, cols = image.long_thin(rows, long_row, thick, 1), image.long_thin(cols, long_col, thick, 0)
    if not cols.any():
        cols = image.long_thin(image.opened(ink, max(3, int(0.8 * down)), 0), max(14, int(0.55 * long_col)), thick, 0)
    least = 1 if h < 200 else 2
    cols = crossing_gate(cols, rows, least)
    rows = crossing_gate(rows, cols, least, 1, 3)
    return image.Lines(rows, crossing_gate(cols, rows, least))


def forms() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(11)
    out = {"small": form(0.4)[0], "gaps": form(0.5)[0], "white": np.full((30, 40), 255, np.uint8), "half": np.repeat([[0], [255]], 10, axis=0).repeat(20, axis=1).astype(np.uint8)}
    for p in ("small", "gaps"):
        letters(out[p], rng, 60)
    gaps = out["gaps"]
    gaps[:, 90] = 255
    gaps[rng.integers(0, gaps.shape[0], 6), :] = 255
    gaps[198:208, 20:22] = gaps[203:205, 20:80] = 0  # away from the form, under its rules
    stray = form(0.5)[0]
    letters(stray, rng, 50)
    stray[5:7, 5:90], stray[185:204, 8:10] = 0, 0  # cross nothing
    out["stray"], out["light"] = stray, 255 - stray
    short = np.full((120, 160), 255, np.uint8)
    letters(short, rng, 12)
    for y in (30, 50, 70):
        short[y, 20:140] = 0
    for x in (20, 60, 100, 139):
        short[28:42, x] = short[43:57, x] = short[58:72, x] = 0
    out["short"] = short
    noise = np.where(rng.random((50, 70)) < 0.3, 0, 255).astype(np.uint8)
    out["noise"] = noise
    return out


def masks(runs, drawn) -> dict[str, np.ndarray]:
    out = {k: np.zeros(p.shape, bool) for k, p in drawn.items()}
    for r in runs.collect():
        assert not out[r.page][r.y, r.start : r.end + 1].any()
        out[r.page][r.y, r.start : r.end + 1] = True
    return out


def paged(spark, drawn):
    rows = [(k, *p.shape, p.tobytes()) for k, p in drawn.items()] + [("nothing", 0, 0, b"")]
    return spark.createDataFrame(rows, PAGE.replace("page int", "page string"))


LEANING = (40, 120, 200, 280)


def leaning() -> np.ndarray:
    """A form whose vertical rules lean by a pixel in 24 and are dotted, so that no run of theirs is long."""
    page = np.full((300, 320), 255, np.uint8)
    letters(page, np.random.default_rng(7), 60)
    for y in range(30, 271, 30):
        page[y : y + 2, 30:300] = 0
    for x in LEANING:
        for y in range(30, 272):
            page[y, x - 14 : x + 26] = page[y, x - 14 : x + 26] if (y % 30) in (0, 1) else 255
            if y % 4:
                page[y, x + (y - 30) // 24] = 0
    return page


def test_rules_and_crossings(spark):
    """Masks and crossings are those of numpy below, but for rules that only votes find, which it hasn't."""
    drawn = forms() | {"leaning": leaning()}
    pages = paged(spark, drawn)
    horizontal, vertical = ruling.ruled_lines(pages)
    rows, columns = masks(horizontal, drawn), masks(vertical, drawn)
    points = {k: set() for k in drawn}
    for r in ruling.crossing_points(horizontal, vertical, pages).collect():
        points[r.page].add((r.x, r.y))
    seen = 0
    for k, p in drawn.items():
        if "leaning" in k:
            continue
        want = ruled_lines(p)
        assert (rows[k] == want.horizontal).all() and (columns[k] == want.vertical).all(), k
        assert points[k] == set(image.crossing_points(want)), k
        seen += len(points[k])
    assert seen > 60 and not rows["stray"][5:7, 5:50].any() and not columns["stray"][185:, 8:10].any()
    assert (rows["light"] == rows["stray"]).all() and not rows["white"].any()
    found = columns["leaning"]
    assert not ruled_lines(drawn["leaning"]).vertical.any()
    for x in LEANING:
        assert np.mean([found[y, x + (y - 30) // 24 - 2 : x + (y - 30) // 24 + 3].any() for y in range(40, 262)]) > 0.9
    assert found.sum() < 3 * 4 * 242


def test_sizes(spark):
    """What the scale, the page and a least share of the width ask of rules, by plain Python."""
    drawn = {str(i): np.full(shape, 255, np.uint8) for i, shape in enumerate([(150, 320), (190, 760), (199, 64), (200, 64)])}
    for i, p in enumerate(drawn.values()):
        letters(p, np.random.default_rng(i), 25 if i < 3 else 0)
    own = ruling.with_polarity(paged(spark, drawn))
    ink = ruling.sparse_runs(own).persist()
    for scale, shortest in ((ruling.STAGE_SCALE, None), (ruling.CALL_SCALE, 0.02)):
        for r in ruling.sizes(own, ink, scale, shortest).collect():
            p = drawn[r.page]
            h, w = p.shape
            char = character_height(p == 0) or 10
            across = max(3, int(char * scale), w // 32)
            down = max(3, int(across * 0.6), h // 80)
            long_x = max(18, min(int(w * 0.08), across * 2))
            long_x = long_x if shortest is None else min(long_x, max(3, round(w * shortest)))
            gaps = max(1, min(max(1, across // 4), max(1, w // 180))), max(1, min(max(1, down // 2), max(1, h // 180)))
            assert (r.char, r.across, r.down, r.long_x, r.long_y) == (char, across, down, long_x, max(14, min(int(h * 0.08), down * 3)))
            assert (r.gap_x, r.gap_y, r.thick, r.crossings) == (*gaps, max(2, min(24, char * 2)), 1 if h < 200 else 2)
    ink.unpersist()


def test_page_crossings(spark):
    """Rules at right angles, as runs of their own, cross where those turned along lines do, across bands and pages."""
    drawn = forms() | {"leaning": leaning()}
    pages = paged(spark, drawn)
    want = ruling.crossing_points(*ruling.ruled_lines(pages), pages).collect()
    got = ruling.page_crossings(pages).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len({r.page for r in got}) > 4


def test_ink_of_a_page(spark):
    """The kernels of a page's task against numpy."""
    for k, p in forms().items():
        dark = p < 128
        ink = dark if 2 * dark.sum() < dark.size else ~dark
        assert ruling.ink_is_dark(p.tobytes()) == (ink is dark) and ruling.character_height(ink) == character_height(ink), k
        for gap, size in ((1, 3), (3, 5), (4, 1)):
            got = np.zeros_like(ink)
            for y, start, end in zip(*raster.joined_runs(ink, gap, size), strict=True):
                got[y, start : end + 1] = True
            assert (got == image.opened(image.closed(ink, gap, 1), size, 1)).all(), k
    assert not len(raster.joined_runs(np.zeros((0, 1), bool), 1, 1)[0])
