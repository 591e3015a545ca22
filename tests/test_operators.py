"""Operators on drawn forms, small tables and files."""

from __future__ import annotations

import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import axis, image, jobs, recognize, refine, rules, scoring, tables
from gridloom.operators.recognize import Reading
from gridloom.sources import files
from gridloom.streaming import inbox


def form(scale: float = 1.0) -> tuple[np.ndarray, list[int], list[int]]:
    """A white page with 9 horizontal and 5 vertical rules."""
    page = np.full((round(420 * scale), round(520 * scale)), 255, np.uint8)
    ys, xs = [round((40 + 40 * i) * scale) for i in range(9)], [round((60 + 100 * i) * scale) for i in range(5)]
    for y in ys:
        page[y : y + 2, xs[0] : xs[-1] + 2] = 0
    for x in xs:
        page[ys[0] : ys[-1] + 2, x : x + 2] = 0
    return page, ys, xs


@pytest.mark.parametrize("scale", [0.75, 1.0, 1.5])
def test_grid_of_a_drawn_form(spark, scale):
    page, ys, xs = form(scale)
    points = image.crossing_points(image.ruled_lines(page))
    df = spark.createDataFrame([(1, x, y) for x, y in points], "page int, x int, y int")
    cols, rows = axis.clustered(df.select("page", "x").distinct(), ["page"], "x", 10), axis.clustered(df.select("page", "y").distinct(), ["page"], "y", 10)
    got_x, got_y = sorted(r.x for r in cols.collect()), sorted(r.y for r in rows.collect())
    assert len(got_x) == len(xs) and max(abs(a - b) for a, b in zip(got_x, xs, strict=True)) <= 3 * scale
    assert len(got_y) == len(ys) and max(abs(a - b) for a, b in zip(got_y, ys, strict=True)) <= 3 * scale
    cells = axis.grid_cells(rows, cols, ["page"])
    assert cells.count() == 8 * 4


def test_image_kernels():
    page, _, _ = form()
    noisy = page.copy()
    noisy[5, 5] = 0
    assert image.denoised(noisy)[5, 5] == 255 and (image.denoised(page) == page).all()
    assert set(np.unique(image.sauvola(page))) <= {0, 255}
    turned = image.rotated(page, 4.0)
    assert abs(image.skew(turned) + 4.0) <= 0.5 or abs(image.skew(turned) - 4.0) <= 0.5
    assert (image.rotated(page, 0.05) == page).all()
    assert image.labels(np.eye(4, dtype=bool))[1] == 1
    assert image.cell_image(page).shape[0] == 64 + 24
    assert image.narrowed(page, 260)[0].shape == (210, 260)
    assert image.gray(np.zeros((3, 3, 3), np.uint8)).shape == (3, 3)
    with pytest.raises(ValueError):
        image.gray(np.zeros((3, 3, 2), np.uint8))
    corners = image.quad(page == 0)
    assert corners is not None and image.upright(page, corners).shape == (321, 401)
    path = image.traced(page, 62, 5)
    assert path is None or abs(int(np.median(path)) - 60) <= 2
    assert (image.redacted(page, [(100, 120)])[:, 98:123] == 255).all()
    assert len(image.preview(page, 20)) == 8
    assert (image.closed(np.array([[1, 0, 1, 0, 0, 0, 1]], bool), 2, 1)[0] == [1, 1, 1, 0, 0, 0, 1]).all()


@pytest.mark.parametrize("text, error", [("7.5", "value below minimum 12.5"), ("30", None), ("45.75", None), (" 3 3\t", None), ("3O.1", "expected temperature pattern"), ("60.26", "value above maximum 60.25"), (" ", "expected temperature pattern"), ("12.5\n", None)])
def test_validation(spark, text, error):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(rules.validation_error(F.col("t"), F.lit("temperature"), F.lit(rules.TEMPERATURE), F.lit(12.5), F.lit(60.25)).alias("e")).first().e
    assert got == error


def test_unknown_verifier_mode(spark):
    with pytest.raises(ValueError, match="sometimes"):
        rules.needs_verifier("sometimes", F.lit("x"))


def test_scoring_without_cells(spark):
    empty = spark.createDataFrame([], "key string, text string, truth string, value_type string")
    row = scoring.scored_by(scoring.with_matches(empty)).first()
    assert (row.scored_cells, row.exact_accuracy) == (0, None)


def test_truth_errors_of_a_valid_table(spark):
    headers = spark.createDataFrame([(0, "High"), (1, "lo")], "index int, header string")
    columns = spark.createDataFrame([("hi", "High"), ("lo", "Low")], "key string, name string")
    assert scoring.truth_errors(headers, columns, 3, 3).count() == 0


def test_files(spark, tmp_path):
    form_json = {"id": "f1", "name": "Form", "description": "", "table": {"column_widths": [1.0, 2.0], "uniform_row_height": True}, "columns": [{"index": 0, "key": "hi", "name": "High", "value_type": "temperature", "range": {"min": 50, "max": 110}, "common_values": [], "filter_out": False}, {"index": 2, "key": "x", "name": "X", "value_type": "text", "common_values": [], "filter_out": True}]}
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "f1.json").write_text(json.dumps(form_json))
    every = files.templates(spark, str(tmp_path / "t"))
    assert files.template_columns(every).count() == 2
    assert [r.error for r in files.template_errors(every).collect()] == ["indexes aren't 0, 1, 2, ..."]
    with pytest.raises(ValueError, match="f1"):
        files.template(spark, str(tmp_path / "t"), "nope")
    (tmp_path / "truth.csv").write_text('﻿Date,Comments\n1-Jan,"two\nlines, ""quoted"""\n2-Jan,\n')
    got = {(r.row, r.header): r.value for r in files.truth_table(spark, str(tmp_path / "truth.csv")).collect()}
    assert got == {(0, "Date"): "1-Jan", (0, "Comments"): 'two\nlines, "quoted"', (1, "Date"): "2-Jan", (1, "Comments"): ""}
    (tmp_path / "env").write_text("# c\n\nA = 'x=y'\nno\n")
    assert [tuple(r) for r in files.settings(spark, str(tmp_path / "env")).collect()] == [("A", "x=y")]
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.PDF").write_bytes(b"..%PDF-1.4")
    (tmp_path / "up" / "b.exe").write_bytes(b"MZ")
    refused = {r.name: r.error for r in jobs.upload_errors(files.uploads(spark, str(tmp_path / "up"))).collect()}
    assert refused == {"b.exe": "type"}
    assert [r.name for r in files.listing(spark, str(tmp_path / "up"), containing="A", suffixes=(".exe",)).collect()] == []


def test_pages_through_kernels(spark):
    page, _, _ = form()
    df = spark.createDataFrame([(7, *page.shape, bytearray(page.tobytes()))], "page int, height int, width int, data binary")
    row = image.per_page(df, lambda x: 255 - x).first()
    assert (np.frombuffer(row.data, np.uint8).reshape(row.height, row.width) == 255 - page).all()
    assert image.pixels(df).count() == int((page < 128).sum())


def test_stream_resumes(spark, tmp_path):
    """A second run over the same checkpoint takes only what is new."""
    source, out, check = (f"file://{tmp_path}/{n}" for n in ("in", "out", "check"))
    spark.range(5).write.parquet(source)
    assert inbox.drained(spark, source, out, check, lambda df: df, "id long").count() == 5
    spark.range(5, 7).write.mode("append").parquet(source)
    assert sorted(r.id for r in inbox.drained(spark, source, out, check, lambda df: df, "id long").collect()) == list(range(7))


def test_compacting_keeps_empty_columns(spark):
    cells = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 5, "b")], "page int, row int, col int, text string")
    spine = spark.createDataFrame([(1, 0), (1, 3), (1, 5)], "page int, col int")
    assert {(r.source_col, r.col) for r in tables.compacted(cells, spine, ["page"]).collect()} == {(0, 0), (5, 2)}


def test_rising_edges(spark):
    df = spark.range(1).select(axis.strictly_rising(F.array(*[F.lit(x).cast("long") for x in (3, 3, 4, 9)])).alias("e"))
    assert df.first().e == [3, 4, 5, 9]


class Flaky:
    def __init__(self, errors):
        self.errors = list(errors)

    def recognize(self, cell):
        if self.errors:
            raise RuntimeError(self.errors.pop(0))
        return recognize.Reading("ok")


def test_retries():
    waits: list[float] = []
    assert recognize.Retrying(Flaky(["Timed out", "HTTP error 503"]), sleep=waits.append).recognize(np.zeros((2, 2))).text == "ok"
    assert waits == [1.0, 2.0]
    for errors in (["HTTP error 401", "x"], ["strange"], ["timeout"] * 3):
        with pytest.raises(RuntimeError):
            recognize.Retrying(Flaky(errors), sleep=lambda s: None).recognize(np.zeros((2, 2)))


def test_unknown_recognizer():
    with pytest.raises(ValueError, match="darkness"):
        recognize.engine("nope")


def test_failing_cells_are_marked(spark):
    cells = spark.createDataFrame([(1, 0, 0, 2, 2, bytearray(4))], "page int, row int, col int, height int, width int, data binary")
    row = recognize.read_cells(cells, lambda: Flaky(["broken"]), prepare=False).first()
    assert (row.text, row.validation_error) == ("", "broken")


def test_cell_images_can_be_read_back(spark, tmp_path):
    page, _, _ = form(0.75)
    crops = spark.createDataFrame([("a_row_001.png", *page.shape, bytearray(page.tobytes()))], "name string, height int, width int, data binary")
    assert [r.name for r in files.write_cell_images(crops, f"file://{tmp_path}/cells").collect()] == ["a_row_001.png"]
    row = files.rasters(spark, f"file://{tmp_path}/cells").first()
    assert (row.height, row.width, row.channels) == (*page.shape, 1) and bytes(row.data) == page.tobytes()


def ink(height: int, width: int, ys: dict[int, tuple[int, int]], xs: dict[int, tuple[int, int]]):
    """Masks with one-pixel rules: y to (first, last x), x to (first, last y)."""
    across, down = np.zeros((height, width), np.uint8), np.zeros((height, width), np.uint8)
    for y, (a, b) in ys.items():
        across[y, a : b + 1] = 255
    for x, (a, b) in xs.items():
        down[a : b + 1, x] = 255
    return height, width, across.tobytes(), down.tobytes()


def test_refined_grid(spark):
    wide = (5, 61)
    pages = [
        (1, *ink(90, 70, {10: wide, 17: wide, 31: wide, 38: wide}, {5: (10, 38), 33: (10, 38), 61: (10, 38)})),  # a row is missing
        (2, *ink(90, 70, {}, {})),
        (3, *ink(90, 70, {2: wide, 10: wide, 17: wide, 24: wide, 60: wide}, {5: (10, 24), 6: (10, 24), 61: (10, 24)})),  # a rule above, one far below, a column twice
    ]
    masks = spark.createDataFrame(pages, "page int, height int, width int, horizontal binary, vertical binary")
    found = refine.refined_grid(masks)
    lines = lambda df, c: {p: sorted(r[c] for r in df.where(f"page = {p}").collect()) for p in (1, 2, 3)}
    assert lines(found.rows, "y") == {1: [10, 17, 24, 31, 38], 2: [], 3: [10, 17, 24]}
    columns = lines(found.columns, "x")
    assert columns[1] == [5, 33, 61] and columns[2] == [] and len(columns[3]) == 2 and columns[3][0] in (5, 6) and columns[3][1] == 61
    boxes = {(r.page, r.row, r.col): (r.x, r.y, r.width, r.height) for r in found.cells.collect()}
    assert len(boxes) == 8 + 2 and boxes[1, 1, 0] == (5, 17, 28, 7)
    with_centres = refine.refined_grid(masks, spark.createDataFrame([(1, 19, 12)], "page int, x int, y int"))
    assert lines(with_centres.rows, "y")[1] == [10, 17, 24, 31, 38]


class Modes:
    """Reads by mode: what it gives in turn."""

    def recognize(self, cell):
        return Reading("9x", 50.0)

    def recognize_modes(self, cell, rule):
        yield Reading("9x", 80.0)
        yield Reading(" 41.5 ", 20.0)
        raise AssertionError("asked for more than was needed")


def crops_of(spark, columns):
    return spark.createDataFrame([(1, i, c, 2, 2, b"\x00\x01\x02\x03") for i, c in enumerate(columns)], "page int, row int, col int, height int, width int, data binary")


RULES = "index int, key string, name string, value_type string, pattern string, range_min double, range_max double"


def test_reading_with_rules_and_a_verifier(spark):
    rule = spark.createDataFrame([(0, "t", "Temp", "temperature", r"\d{1,3}(\.\d)?", 40.0, 45.0)], RULES)
    cells = crops_of(spark, [0, 1])

    class Says:
        def __init__(self, text):
            self.text = text

        def recognize(self, cell):
            if self.text is None:
                raise RuntimeError("request failed")
            return Reading(self.text, 10.0)

    read = lambda **more: {r.col: (r.text, r.raw_text, r.validation_error) for r in recognize.read_with_rules(cells, rule, lambda: Says("12"), prepare=False, **more).collect()}
    assert read() == {0: ("", "12", "value below minimum 40"), 1: ("12", None, None)}
    assert read(verifier=lambda: Says("43"), mode="invalid") == {0: ("43", "12", None), 1: ("12", None, None)}
    assert read(verifier=lambda: Says("99"), mode="always")[0][0] == "" and read(verifier=lambda: Says("99"), mode="always")[0][2] == "value above maximum 45"
    assert read(verifier=lambda: Says(None), mode="always")[1] == ("12", None, None)


def test_modes_of_a_recognizer(spark):
    rule = spark.createDataFrame([(0, "t", "Temp", "temperature", r"\d{1,3}(\.\d)?", 40.0, 45.0)], RULES)
    tried = recognize.attempts(recognize.with_rule(crops_of(spark, [0, 1]), rule), Modes, prepare=False)
    got = {r.col: (r.text, r.confidence, r.raw_text) for r in recognize.judged(tried).collect()}
    assert got[1] == ("9x", 50.0, None)
    assert got[0] == ("41.5", 20.0, " 41.5 ")


def test_cached_readings(spark):
    cells = crops_of(spark, [0, 1, 2])  # equal pixels: one reading
    none = spark.createDataFrame([], "cache_key string, text string, confidence double, raw_text string, validation_error string")
    count = spark.sparkContext.accumulator(0)

    def read(df):
        class Counting:
            def recognize(self, cell):
                count.add(1)
                return Reading("7")

        return recognize.read_cells(df, Counting, prepare=False)

    readings, added = recognize.read_cached(cells, none, "v1", read)
    added = spark.createDataFrame(added.collect(), added.schema)
    assert count.value == 1 and [r.text for r in recognize.read_cached(cells, added, "v1", read)[0].collect()] == ["7"] * 3
    assert count.value == 1 and recognize.read_cached(cells, added, "v2", read)[1].count() == 1


def test_vision_over_http(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Answers(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            seen.append((json.loads(body), self.headers["Idempotency-Key"]))
            if len(seen) == 1:
                self.send_error(503)
                return
            text = json.dumps({"message": {"content": '{"text": " 41.5", "status": "ok"}' if "Temp" in seen[-1][0]["messages"][0]["content"] else '{"text": "", "status": "blank"}'}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(text)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    rule = spark.createDataFrame([(0, "t", "Temp", "temperature", r"\d{1,3}(\.\d)?", 40.0, 45.0)], RULES)
    model = recognize.Vision(f"http://127.0.0.1:{server.server_port}/chat", "m")
    rows = {r.col: r for r in recognize.read_by_vision(crops_of(spark, [0, 1]).coalesce(1), rule, model, wait=0.01).collect()}
    server.shutdown()
    assert (rows[0].text, rows[0].validation_error) == ("41.5", None) and (rows[1].text, rows[1].validation_error) == ("", None)
    assert len(seen) == 3 and len({k for _, k in seen}) == 2  # a retry has its request's key
    broken = recognize.read_by_vision(crops_of(spark, [1]), rule, recognize.Vision("", ""), wait=0.01).first()
    assert broken.text == "" and "not configured" in broken.validation_error


def test_mixed_folder(spark, tmp_path):
    page = np.full((4, 6), 200, np.uint8)
    for name in ("a.png", "b.PNG"):
        (tmp_path / name).write_bytes(image.png(page))
    (tmp_path / "notes.txt").write_text("x")
    got = files.documents(spark, f"file://{tmp_path}")
    assert sorted((r.path.split("/")[-1], r.page, r.height, r.width) for r in got.collect()) == [("a.png", 1, 4, 6), ("b.PNG", 1, 4, 6)]
    (tmp_path / "c.Pdf").write_bytes(b"%PDF two pages")
    with pytest.raises(RuntimeError):
        files.documents(spark, f"file://{tmp_path}")
    got = files.documents(spark, f"file://{tmp_path}", lambda content: [page, page])
    assert sorted((r.path.split("/")[-1], r.page) for r in got.select("path", "page").collect()) == [("a.png", 1), ("b.PNG", 1), ("c.Pdf", 1), ("c.Pdf", 2)]
    found = files.found_in(spark, [f"file://{tmp_path}", f"file://{tmp_path}/a.png"])
    assert found.count() == 2
    assert files.template_ids(spark, f"file://{tmp_path}/none").count() == 0


def test_empty_metrics_file(spark, tmp_path):
    files.write_csv(spark.createDataFrame([], "a int, b int"), f"file://{tmp_path}/m")
    assert "".join(p.read_text() for p in (tmp_path / "m").glob("part-*")) == ""


def test_pages_laid_end_to_end(spark):
    pages = [(p, 1 + p % 3) for p in range(40)]
    cells = spark.createDataFrame([(p, r) for p, n in pages for r in range(n + 1)], "page long, row int")
    got = scoring.global_rows(cells, spark.createDataFrame(pages, "page long, data_row_count long"), run=7)
    assert sorted(r.global_row for r in got.collect()) == list(range(sum(n for _, n in pages)))


def test_drained_stream_stops(spark, tmp_path):
    """A stream of many triggers stops once the drain file is there, with all that had arrived, cancelled jobs left out."""
    source, status = f"file://{tmp_path}/in", tmp_path / "status.json"
    spark.range(6).withColumnRenamed("id", "job_id").write.parquet(source)
    cancelled, seen = spark.createDataFrame([(2,), (4,)], "job_id long"), []
    stream = inbox.arrivals(spark, source, "job_id long", 1)
    query = inbox.start(stream, lambda batch, n: seen.extend(r.job_id for r in inbox.without_cancelled(batch, cancelled).collect()), f"file://{tmp_path}/check", "100 milliseconds")
    (tmp_path / "drain").write_text("")
    inbox.run_until_drained(query, f"file://{tmp_path}/drain", f"file://{status}", 0.1)
    assert sorted(seen) == [0, 1, 3, 5] and not query.isActive
    assert json.loads(status.read_text())["state"] == "stopped"


def streamed(spark, tmp_path, batches, schema, plan, mode):
    """What a stream over the batches, one after another, has written."""
    source = f"file://{tmp_path}/in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        query = plan(inbox.arrivals(spark, source, schema)).writeStream.outputMode(mode).format("parquet" if mode == "append" else "memory").queryName(f"q{abs(hash(str(tmp_path)))}").option("checkpointLocation", f"file://{tmp_path}/check").option("path", f"file://{tmp_path}/out").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"file://{tmp_path}/out") if mode == "append" else spark.table(f"q{abs(hash(str(tmp_path)))}")


def test_leases_of_a_stream(spark, tmp_path):
    """A lease is given out once no beat came for its time; an open one isn't."""
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    batches = [[(1, at(0)), (1, at(5)), (2, at(1))], [(2, at(40))], [(3, at(59))]]
    got = streamed(spark, tmp_path, batches, "job_id int, at timestamp", lambda s: inbox.expired_leases(s, 10), "append").collect()
    assert {(r.job_id, r.last_beat) for r in got} == {(1, at(5)), (2, at(1)), (2, at(40))}


def test_late_events_of_a_stream(spark, tmp_path):
    """A window is given out once the watermark is past it, without what came too late."""
    at = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    batches = [[("a", at(1)), ("a", at(1, 30))], [("a", at(5))], [("a", at(1, 40)), ("b", at(9))], [("b", at(9, 5))]]
    got = streamed(spark, tmp_path, batches, "kind string, at timestamp", lambda s: inbox.windowed_counts(s, "at", "kind", "1 hour", "1 hour"), "append").collect()
    assert {(r.start, r.kind, r.n) for r in got} == {(at(1), "a", 2), (at(5), "a", 1)}


def test_pages_turned_alike(spark):
    page, _, _ = form()
    turned = image.rotated(page, 4.0)
    pages = spark.createDataFrame([(1, *turned.shape, turned.tobytes())], "page int, height int, width int, data binary")
    first = image.deskewed(pages)
    assert abs(abs(first.first().angle) - 4.0) <= 0.5
    again = image.turned_alike(pages, first.select("page", "angle"))
    assert bytes(again.first().data) == bytes(first.first().data)
    assert image.character_sizes(spark.createDataFrame([(1, 20, 20, b"\xff" * 400)], "page int, height int, width int, data binary")).first()["component_count"] == 0
