"""Pages to results in one plan."""

from __future__ import annotations

import json
import re

import numpy as np
import pytest

from gridloom.functions.deploy import bucketed
from gridloom.operators import process, recognize, refine
from gridloom.operators.recognize import Reading
from tests.test_operators import form

PAGE = "page int, height int, width int, data binary"
COLUMNS = "index int, key string, name string, value_type string, format string, range_min double, range_max double, filter_out boolean, width double"


def marked(values: dict[tuple[int, int], int]) -> tuple[np.ndarray, list[int], list[int]]:
    """form() with a gray spot in the middle of some cells, by (row, column)."""
    page, ys, xs = form()
    for (r, c), v in values.items():
        page[ys[r] + 12 : ys[r] + 28, xs[c] + 30 : xs[c] + 70] = v
    return page, ys, xs


class Spot:
    """Reads the value of a cell's spot; none is a blank. Values over 200 are header names."""

    NAMES = {201: "Alpha", 202: " bEta ", 203: "Gamma", 204: "Delta"}

    def recognize(self, cell: np.ndarray) -> Reading:
        inner = cell[cell.shape[0] // 3 : -(cell.shape[0] // 3), cell.shape[1] // 3 : -(cell.shape[1] // 3)]
        value = int(np.median(inner))
        return Reading(self.NAMES.get(value, "" if value > 250 else str(value)), 50.0)


def two_pages(spark):
    head = {(0, c): 201 + c for c in range(4)}
    first, ys, xs = marked(head | {(r, c): 100 + 10 * r + c for r in range(1, 8) for c in range(4)})
    second, _, _ = marked(head | {(r, 0): 150 + r for r in range(1, 8)})
    blank = np.full((300, 300), 255, np.uint8)
    return spark.createDataFrame([(i, *p.shape, p.tobytes()) for i, p in enumerate((first, second, blank), 1)], PAGE), ys, xs


def test_pages_without_a_template(spark):
    """Columns that a header names are read no further, and those that are left are numbered anew."""
    pages, ys, xs = two_pages(spark)
    read = spark.sparkContext.accumulator(0)

    class Counting(Spot):
        def recognize(self, cell):
            read.add(1)
            return super().recognize(cell)

    done = process.processed(pages, Counting, hidden=["BETA", " "], prepare=False)
    cells = {(r.page, r.row, r.col): r for r in done.cells.collect()}
    assert set(cells) == {(p, r, c) for p in (1, 2) for r in range(8) for c in range(3)}
    assert cells[1, 3, 1].text == "132" and cells[1, 3, 1].source_col == 2 and cells[2, 4, 0].text == "154" and cells[2, 4, 1].text == ""
    # eight headers, and seven rows of three columns on either page
    assert read.value == 8 + 2 * 7 * 3
    out = {r.page: json.loads(r.json) for r in process.result_json(done).collect()}
    assert [c["name"] for c in out[1]["columns"]] == ["Alpha", "Gamma", "Delta"] and [c["key"] for c in out[1]["columns"]] == ["column_1", "column_2", "column_3"]
    assert [c["source_index"] for c in out[1]["columns"]] == [0, 1, 2] and out[1]["data_row_count"] == 7 and len(out[1]["cells"]) == 21
    assert out[1]["cells"][0] == {"row": 1, "column_index": 0, "source_column_index": 0, "column_key": "column_1", "column_name": "Alpha", "bbox": out[1]["cells"][0]["bbox"], "ocr_text": "110", "confidence": 50.0}
    box = out[1]["cells"][0]["bbox"]
    assert all(abs(a - b) <= 4 for a, b in zip(box, (xs[0], ys[1], xs[1], ys[2]), strict=True))
    assert out[3] == {"page_number": 3, "image_width": 300, "image_height": 300, "columns": [], "data_row_count": 0, "warning_count": 0, "cells": []}


def test_pages_with_a_template(spark):
    """Template columns lie on the grid; filtered and hidden ones aren't read, and rules judge what is."""
    pages, _, _ = two_pages(spark)
    columns = spark.createDataFrame([(0, "temp", "Temp", "temperature", None, 110.0, 160.0, False, 1.0), (1, "divider_1", "Divider", "text", None, None, None, False, 1.0), (2, "gone", "Gone", "text", None, None, None, True, 1.0), (3, "note", "My note", "text", None, None, None, False, 1.0)], COLUMNS)
    done = process.processed(pages, Spot, process.Template(columns), prepare=False)
    out = {r.page: json.loads(r.json) for r in process.result_json(done).collect()}
    assert [(c["index"], c["source_index"], c["key"]) for c in out[1]["columns"]] == [(0, 0, "temp"), (2, 3, "note")]
    temps = {c["row"]: c for c in out[1]["cells"] if c["column_key"] == "temp"}
    assert temps[1]["ocr_text"] == "110" and "validation_error" not in temps[1]
    assert temps[6]["ocr_text"] == "160" and temps[7]["ocr_text"] == "" and temps[7]["raw_text"] == "170" and temps[7]["validation_error"] == "value above maximum 160"
    assert out[1]["warning_count"] == 1 and {c["ocr_text"] for c in out[1]["cells"] if c["column_key"] == "note"} == {str(103 + 10 * r) for r in range(1, 8)}
    hidden = process.processed(pages, Spot, process.Template(columns), hidden=["my NOTE"], prepare=False)
    assert {r.key for r in hidden.columns.collect()} == {"temp"} and {r.source_col for r in hidden.cells.collect()} == {0, 1}


def test_template_lines(spark):
    rows = spark.createDataFrame([(1, 0), (1, 11), (1, 30), (2, 5)], "page int, y int")
    cols = spark.createDataFrame([(1, 10), (1, 60), (1, 110), (2, 5), (2, 50)], "page int, x int")
    ys, xs = process.template_lines(rows, cols, [1, 2, 1], True)
    assert sorted(r.x for r in xs.collect()) == [10, 35, 85, 110] and sorted(r.y for r in ys.collect()) == [0, 15, 30]
    ys, _ = process.template_lines(rows, cols, [1, 2, 1], False)
    assert sorted(r.y for r in ys.collect()) == [0, 11, 30]


def test_missing_masks_are_an_error(spark):
    page, _, _ = form()
    good = page.tobytes()
    for across, down, said in ((None, good, "page 4 has no horizontal mask"), (good, None, "page 4 has no vertical mask"), (good, good[:-1], "page 4 has no vertical mask")):
        masks = spark.createDataFrame([(4, *page.shape, across, down)], "page int, height int, width int, horizontal binary, vertical binary")
        with pytest.raises(Exception, match=said):
            refine.refined_grid(masks).cells.count()


def exchanged(df) -> list[str]:
    """What the plan's exchanges move: for each, the columns of the scans and kernels below it."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    out = []
    for i, line in enumerate(lines):
        if re.search(r"\bExchange\b", line):
            below = []
            for other in lines[i + 1 :]:
                if depth(other) <= depth(line):
                    break
                below.append(other)
            out.append(" ".join(below))
    return out


def test_pixels_stay_where_they_are(spark):
    """Lists of lines and boxes come to pages in buckets, however large the lists may be; no exchange moves a mask or a page."""
    pages, _, _ = two_pages(spark)
    masks = process.masked(pages)
    lists = spark.range(5000).selectExpr("CAST(id % 3 AS INT) AS page", "CAST(id AS INT) AS y").groupBy("page").agg({"y": "max"}).withColumnRenamed("max(y)", "ys")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = refine.measured(refine.required_masks(masks), lists, "n int", lambda across, down, own: (int(across.sum()),))
        boxes = spark.createDataFrame([(1, 0, 0, 1, 1, 5, 5)], "page int, row int, col int, x int, y int, width int, height int")
        for df in (joined, recognize.crops(masks, boxes)):
            moved = exchanged(df)
            assert moved and not any("horizontal" in m or "data" in m for m in moved)
        plain = masks.select("page", "height", "width", "horizontal", "vertical").repartition(2)
        assert any("horizontal" in m for m in exchanged(refine.measured(plain, lists, "n int", lambda across, down, own: (1,))))
        assert joined.count() == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_buckets(spark):
    df = spark.range(100).withColumnRenamed("id", "page")
    table = bucketed(df, "page")
    assert refine.is_bucketed(table) and not refine.is_bucketed(df) and table.count() == 100
    assert not re.search(r"\bExchange\b", table.groupBy("page").count()._jdf.queryExecution().executedPlan().toString())
