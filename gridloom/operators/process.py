"""From gray pages to results: rules, grid, crops, readings and JSON in one plan for all pages.

Pixels move once, when pages and masks are written in buckets of their page;
every later join brings lists of lines or boxes to them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.deploy import bucketed, stored
from gridloom.functions.text import is_divider, normalized_column_name, strip
from gridloom.operators import axis as a
from gridloom.operators import image, recognize
from gridloom.operators.refine import refined_grid, required_masks
from gridloom.operators.rules import column_rules
from gridloom.operators.tables import generic_columns

Engine = Callable[[], recognize.Engine]


def masked(pages: DataFrame, k: float = 0.34, shortest: float | None = None) -> DataFrame:
    """(page, height, width, data, horizontal, vertical, centroids) of gray pages, in buckets of their page.

    Masks are the rules of the binarized page; centroids are where they cross.
    """
    kind = pages.schema["page"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (h, w, data) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                lines = image.ruled_lines(image.sauvola(np.frombuffer(data, np.uint8).reshape(h, w), k=k), shortest=shortest)
                masks = [pa.array([(m * np.uint8(255)).tobytes()]) for m in (lines.horizontal, lines.vertical)]
                points = pa.array([[{"x": x, "y": y} for x, y in image.crossing_points(lines)]], pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())])))
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, *masks, points], ["page", "height", "width", "data", "horizontal", "vertical", "centroids"])

    plain = pages.select("page", F.col("height").cast("int"), F.col("width").cast("int"), "data")
    return bucketed(plain.mapInArrow(run, f"page {kind}, height int, width int, data binary, horizontal binary, vertical binary, centroids array<struct<x: int, y: int>>"), "page")


def centroids(masks: DataFrame) -> DataFrame:
    """(page, x, y) of the crossings; a page without masks is an error."""
    return required_masks(masks).select("page", F.inline("centroids"))


def template_lines(rows: DataFrame, columns: DataFrame, widths: Sequence[float], uniform: bool) -> tuple[DataFrame, DataFrame]:
    """(rows (page, y), columns (page, x)) of a template on the pages whose grid has two lines each way: columns in proportion to its widths, rows evenly if they are uniform."""
    share = np.cumsum([0.0, *widths]) / sum(widths)
    span = columns.groupBy("page").agg(F.min("x").alias("left"), F.max("x").alias("right")).where("right > left")
    tall = rows.groupBy("page").agg(F.min("y").alias("top"), F.max("y").alias("bottom"), F.count("*").alias("n")).where("bottom > top")
    edges = F.array(*[a.half_even(F.col("left") + (F.col("right") - F.col("left")) * float(s)).cast("long") for s in share])
    xs = span.join(tall.select("page"), "page").select("page", F.explode(a.strictly_rising(edges)).alias("x"))
    own = tall.join(span.select("page"), "page")
    ys = own.select("page", F.explode(a.regular_rows(F.col("top"), F.col("bottom"), F.col("n"))).alias("y")) if uniform else rows.join(own.select("page"), "page", "left_semi").select("page", "y")
    return ys, xs


@dataclass(frozen=True)
class Template:
    """What processing needs of a form template: columns has index, key, name, value_type, format, range_min, range_max, filter_out and width."""

    columns: DataFrame
    uniform: bool = False
    keep_header: bool = False
    shortest: float | None = None


@dataclass(frozen=True)
class Processed:
    """cells (page, row, col, source_col, x, y, width, height and a reading), columns (page, col, source_col, key, name, ...), and pages (page, height, width, data_rows)."""

    cells: DataFrame
    columns: DataFrame
    pages: DataFrame


def processed(pages: DataFrame, engine: Engine, template: Template | None = None, hidden: Sequence[str] = (), verifier: Engine | None = None, mode: str = "off", k: float = 0.34, prepare: bool = True) -> Processed:
    """Tables of gray pages (page, height, width, data).

    With a template its columns lie on the found grid, those that it filters
    out or that `hidden` names aren't read, dividers aside they have names, and
    cells are read under their columns' rules. Without one, `hidden` names
    headers: row 0 is read first, and columns whose header is among them are
    read no further. Columns that are left are numbered anew, and row 0 is the header.
    """
    masks = masked(pages, k, template.shortest if template else None)
    found = refined_grid(masks, centroids(masks), template.keep_header if template else False)
    boxes = found.cells
    wanted = [n for n in hidden if n.strip()]
    rules = None
    if template is not None:
        listed = template.columns.orderBy("index").collect()  # a form has some 20 columns
        ys, xs = template_lines(found.rows, found.columns, [float(r.width) for r in listed], template.uniform)
        fitted = a.grid_cells(ys, xs, ["page"])
        boxes = fitted.unionByName(boxes.join(fitted.select("page").distinct(), "page", "left_anti"))
        names = template.columns.sparkSession.createDataFrame([(n,) for n in wanted], "name string").select(normalized_column_name(F.col("name")).alias("plain")).distinct()
        plain = template.columns.withColumn("plain", normalized_column_name(F.col("name")))
        gone = plain.join(names, "plain", "left_semi").select("index").union(template.columns.where("filter_out").select("index")).distinct()
        shown = stored(template.columns.join(gone, "index", "left_anti"))
        rules = column_rules(shown)
        boxes = boxes.join(shown.select(F.col("index").alias("col")), "col", "left_semi")
    boxes = stored(boxes.select("page", "row", "col", "x", "y", "width", "height"))
    read = lambda own: read_boxes(masks, own, rules, engine, verifier, mode, prepare)
    if template is None and wanted:
        names = boxes.sparkSession.createDataFrame([(n,) for n in wanted], "name string").select(normalized_column_name(F.col("name")).alias("plain")).distinct()
        heads = stored(read(boxes.where("row = 0")))
        gone = heads.withColumn("plain", normalized_column_name(F.col("text"))).join(names, "plain", "left_semi").select("page", "col").distinct()
        boxes = stored(boxes.join(gone, ["page", "col"], "left_anti"))
        readings = heads.join(gone, ["page", "col"], "left_anti").unionByName(read(boxes.where("row > 0")))
    else:
        readings = read(boxes)
    order = W.partitionBy("page").orderBy("col")
    dense = boxes.select("page", "col").distinct().withColumn("new", F.row_number().over(order) - 1)
    cells = stored(boxes.join(readings, ["page", "row", "col"]).join(dense, ["page", "col"]))
    cells = cells.select("page", "row", F.col("new").alias("col"), F.col("col").alias("source_col"), "x", "y", "width", "height", *recognize.READING)
    if template is None:
        heads = cells.where("row = 0").select("page", "col", strip(F.col("text")).alias("header"))
        key, name = generic_columns(F.col("col"), F.col("header"))
        none = lambda kind: F.lit(None).cast(kind)
        columns = heads.select("page", "col", F.col("col").alias("source_col"), key.alias("key"), name.alias("name"), none("string").alias("value_type"), none("string").alias("format"), none("double").alias("range_min"), none("double").alias("range_max"))
    else:
        own = shown.select(F.col("index").alias("source_col"), "key", "name", "value_type", "format", "range_min", "range_max")
        columns = cells.select("page", "col", "source_col").distinct().join(own.where(~is_divider(F.col("key"))), "source_col").select("page", "col", *own.columns)
    size = masks.select("page", "height", "width").join(boxes.groupBy("page").agg(F.greatest(F.lit(0), F.max("row")).alias("data_rows")), "page", "left")
    return Processed(cells, columns, size.withColumn("data_rows", F.coalesce("data_rows", F.lit(0))))


def read_boxes(masks: DataFrame, boxes: DataFrame, rules: DataFrame | None, engine: Engine, verifier: Engine | None, mode: str, prepare: bool) -> DataFrame:
    """(page, row, col, READING) of boxes on the pages of a bucketed table."""
    crops = recognize.crops(masks, boxes)
    if rules is None:
        rules = masks.sparkSession.createDataFrame([], "index int, key string, name string, value_type string, pattern string, range_min double, range_max double")
    return recognize.read_with_rules(crops, rules, engine, verifier, mode, prepare)


def result_json(done: Processed) -> DataFrame:
    """(page, json): a result's page with its columns and its cells below the header; null fields are left out, but for the confidence."""
    place = F.struct("row", F.col("col").alias("column_index"), F.col("c.source_col").alias("source_column_index"), F.col("c.key").alias("column_key"), F.col("c.name").alias("column_name"), F.array("x", "y", F.col("x") + F.col("width"), F.col("y") + F.col("height")).alias("bbox"), F.col("text").alias("ocr_text"))
    first, rest = F.to_json(place), F.to_json(F.struct("raw_text", "validation_error"))
    inner = lambda text: F.substring(text, F.lit(2), F.length(text) - 2)
    cell = F.concat(F.lit("{"), F.concat_ws(",", inner(first), F.concat(F.lit('"confidence":'), F.coalesce(F.col("confidence").cast("string"), F.lit("null"))), F.nullif(inner(rest), F.lit(""))), F.lit("}"))
    own = done.columns.select("page", "col", F.struct("source_col", "key", "name").alias("c"))
    joined = done.cells.where("row > 0").join(own, ["page", "col"]).select("page", "validation_error", F.struct("row", "col", cell.alias("json")).alias("cell"))
    cells = joined.groupBy("page").agg(F.transform(F.array_sort(F.collect_list("cell")), lambda c: c["json"]).alias("cells"), F.count("validation_error").alias("warning_count"))
    column = F.struct(F.col("col").alias("index"), F.col("source_col").alias("source_index"), "key", "name", "value_type", "format", "range_min", "range_max")
    columns = done.columns.groupBy("page").agg(F.array_sort(F.collect_list(column)).alias("columns"))
    rows = done.pages.join(columns, "page", "left").join(cells, "page", "left")
    none = F.array().cast(columns.schema["columns"].dataType)
    head = F.to_json(F.struct(F.col("page").alias("page_number"), F.col("width").alias("image_width"), F.col("height").alias("image_height"), F.coalesce("columns", none).alias("columns"), F.col("data_rows").alias("data_row_count"), F.coalesce("warning_count", F.lit(0)).alias("warning_count")))
    body = F.array_join(F.coalesce("cells", F.array().cast("array<string>")), ",")
    return rows.select("page", F.concat(F.lit("{"), inner(head), F.lit(',"cells":['), body, F.lit("]}")).alias("json"))
