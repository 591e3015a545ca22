"""Readers and writers of forms, templates, truths and results."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RASTER = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp")

TEMPLATE_SCHEMA = """id string, name string, description string,
`table` struct<column_widths: array<double>, uniform_row_height: boolean, preserve_header_row: boolean, min_horizontal_line_length_ratio: double>,
redaction struct<follow_column_borders: boolean, follow_curved_borders: boolean>,
preprocessing struct<max_width: int, binarization_k: double>,
columns array<struct<`index`: int, `key`: string, name: string, value_type: string, format: string, `range`: struct<min: double, max: double>, common_values: array<string>, filter_out: boolean>>"""


def listing(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = RASTER, containing: str | None = None, recursive: bool = False) -> DataFrame:
    """(path, name, length) of a folder's files with one of the suffixes, whose name has the text in it, case aside; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder).select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length")
    low = F.lower("name")
    out = files.where(F.exists(F.array(*map(F.lit, suffixes)), lambda s: low.endswith(s)))
    return out.where(low.contains(containing.lower())) if containing else out


def found_in(spark: SparkSession, paths: list[str], suffixes: tuple[str, ...] = RASTER, recursive: bool = False) -> DataFrame:
    """listing() of a mixed list of files and folders; a file that is named twice, or lies in a named folder, comes once."""
    parts = [listing(spark, p, suffixes, recursive=recursive) for p in paths]
    out = parts[0] if parts else spark.createDataFrame([], "path string, name string, length long")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["path"])


def either_case(suffix: str) -> str:
    """A path filter for names with the suffix, case aside."""
    return "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)


def rasters(spark: SparkSession, folder: str) -> DataFrame:
    """(path, height, width, channels, data) of a folder's images, by suffix; one that can't be read is an error."""
    only = "{" + ",".join(map(either_case, RASTER)) + "}"
    out = spark.read.format("image").option("dropInvalid", False).option("pathGlobFilter", only).load(folder).select("image.*")
    ok = F.assert_true(F.col("height") > 0, F.concat(F.lit("unreadable image "), "origin"))
    return out.select(F.col("origin").alias("path"), "height", "width", F.col("nChannels").alias("channels"), "data").where(F.coalesce(ok.cast("string"), F.lit("")) == "")


def documents(spark: SparkSession, folder: str, pdf_pages=None) -> DataFrame:
    """(path, page, height, width, channels, data) of a folder's images, one page each, and PDFs, by `pdf_pages`.

    pdf_pages is a function from contents to pages; a PDF without pages is an
    error, and so is any PDF without such a function. Other files don't count.
    """
    pdfs = spark.read.format("binaryFile").option("pathGlobFilter", either_case(".pdf")).load(folder)
    images = rasters(spark, folder).select("path", F.lit(1).alias("page"), "height", "width", "channels", "data")
    if pdf_pages is None:
        if pdfs.select("path").limit(1).count():
            raise RuntimeError("no PDF reader is installed; give pdf_pages")
        return images

    def run(batches):
        import pandas as pd

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                pages = pdf_pages(content)
                if not pages:
                    raise ValueError(f"{path} has no pages")
                yield pd.DataFrame([(path, i, *p.shape[:2], 1 if p.ndim == 2 else p.shape[2], p.tobytes()) for i, p in enumerate(pages, 1)], columns=["path", "page", "height", "width", "channels", "data"])

    return images.unionByName(pdfs.select("path", "content").mapInPandas(run, "path string, page int, height int, width int, channels int, data binary"))


def template_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(id): names of a folder's template files without .json, in order; none for a folder that doesn't exist."""
    store, name = fs.FileSystem.from_uri(folder)
    if store.get_file_info(name).type == fs.FileType.NotFound:
        return spark.createDataFrame([], "id string")
    return listing(spark, folder, (".json",)).select(F.regexp_replace("name", r"(?i)\.json\z", "").alias("id")).orderBy("id")


def templates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TEMPLATE_SCHEMA).json(path, multiLine=True)


def template(spark: SparkSession, path: str, wanted: str) -> DataFrame:
    """One template; an unknown id is an error that names the choices."""
    every = templates(spark, path)
    if not every.where(F.col("id") == wanted).limit(1).count():
        ids = [r.id for r in every.select("id").orderBy("id").limit(1000).collect()]
        raise ValueError(f"unknown template {wanted!r}; choose one of {', '.join(ids)}")
    return every.where(F.col("id") == wanted)


def template_columns(every: DataFrame) -> DataFrame:
    """(template_id, index, key, name, value_type, format, range_min, range_max, common_values, filter_out, width)."""
    c = F.col("c")
    return every.select(F.col("id").alias("template_id"), F.col("table.column_widths").alias("w"), F.explode("columns").alias("c")).select("template_id", c["index"].alias("index"), c["key"].alias("key"), c["name"].alias("name"), c["value_type"].alias("value_type"), c["format"].alias("format"), c["range"]["min"].alias("range_min"), c["range"]["max"].alias("range_max"), c["common_values"].alias("common_values"), F.coalesce(c["filter_out"], F.lit(False)).alias("filter_out"), F.try_element_at("w", c["index"] + 1).alias("width"))


def template_errors(every: DataFrame) -> DataFrame:
    """(id, error) for each rule that a template breaks."""
    w, t = F.col("table.column_widths"), F.col("table")
    indexes = F.array_sort(F.transform("columns", lambda c: c["index"]))
    bad = F.array(
        F.when(F.size(w) != F.size("columns"), "widths and columns differ in number"),
        F.when(F.exists(w, lambda x: x <= 0), "a width isn't positive"),
        F.when(indexes != F.sequence(F.lit(0), F.size("columns") - 1), "indexes aren't 0, 1, 2, ..."),
        F.when(~t["min_horizontal_line_length_ratio"].between(1e-12, 1), "line ratio outside (0, 1]"),
        F.when(F.col("preprocessing.max_width") < 100, "max_width under 100"),
        F.when((F.col("preprocessing.binarization_k") <= 0) | (F.col("preprocessing.binarization_k") >= 1), "k outside (0, 1)"),
    )
    return every.select("id", F.explode(F.array_compact(bad)).alias("error"))


def truth_table(spark: SparkSession, path: str) -> DataFrame:
    """(row, index, header, value) of a truth CSV: all text, nulls as blanks, byte order mark dropped, quoted cells over several lines."""
    wide = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST", enforceSchema=False)
    names = wide.columns
    row = F.monotonically_increasing_id()
    cells = F.array(*[F.struct(F.lit(i).alias("index"), F.lit(n.lstrip("﻿")).alias("header"), F.coalesce(F.col(f"`{n}`"), F.lit("")).alias("value")) for i, n in enumerate(names)])
    at = F.row_number().over(W.orderBy("_r")) - 1  # a form has some 30 rows; one file is one split
    return wide.select(row.alias("_r"), cells.alias("_c")).select(at.alias("row"), "_c").select("row", F.inline("_c"))


def settings(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a KEY=value file; blank lines, comments and lines without = don't count, quotes around values go."""
    line = F.trim("value")
    rows = spark.read.text(path).where((line != "") & ~line.startswith("#") & line.contains("="))
    part = F.split(line, "=", 2)
    return rows.select(F.trim(part[0]).alias("key"), F.regexp_replace(F.trim(part[1]), r"""\A["']|["']\z""", "").alias("value"))


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, length, sha256, head) of uploaded files; the reader passes over empty files, which have no content to take in."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length", F.sha2("content", 256).alias("sha256"), F.substring("content", 1, 1024).alias("head"))


def cells_json(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, json) of a table: counts and cells; empty optional fields are left out, but for the confidence."""
    optional = F.to_json(F.struct("raw_text", "validation_error"))
    cell = F.concat(F.expr("substring(to_json(struct(row, col, bbox, text)), 1, length(to_json(struct(row, col, bbox, text))) - 1)"), F.lit(',"confidence":'), F.coalesce(F.col("confidence").cast("string"), F.lit("null")), F.when(optional == "{}", "}").otherwise(F.concat(F.lit(","), F.expr("substring(to_json(struct(raw_text, validation_error)), 2)"))))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "col", cell.alias("json")))), lambda x: x["json"]), ",")
    counts = F.concat(F.lit('{"row_count":'), (F.max("row") + 1).cast("string"), F.lit(',"col_count":'), (F.max("col") + 1).cast("string"), F.lit(',"cells":['))
    return cells.groupBy(*keys).agg(F.concat(counts, listed, F.lit("]}")).alias("json"))


def csv_text(rows: DataFrame, keys: list[str], row: str, columns: list[str]) -> DataFrame:
    """(keys, csv): a matrix as one CSV text with \\n line ends."""
    quoted = [F.when(F.coalesce(F.col(c), F.lit("")).rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(F.col(c), F.lit(""))) for c in columns]
    lines = F.sort_array(F.collect_list(F.struct(F.col(row).alias("r"), F.concat_ws(",", *quoted).alias("line"))))
    return rows.groupBy(*keys).agg(F.concat(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), F.lit("\n")).alias("csv"))


def write_csv(df: DataFrame, folder: str) -> None:
    """A small table, such as metrics, as one CSV file with a header; an empty one gives an empty file without it."""
    if df.isEmpty():
        df.sparkSession.createDataFrame([], "value string").coalesce(1).write.mode("overwrite").text(folder)
        return
    df.coalesce(1).write.mode("overwrite").csv(folder, header=True, quote='"', escape='"')


def write_cell_images(crops: DataFrame, folder: str) -> DataFrame:
    """(name, path) of the PNG files written for crops (name, height, width, data), below a folder that all executors share."""
    from gridloom.operators.image import png

    def run(batches):
        import numpy as np
        import pyarrow as pa

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for name, h, w, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_output_stream(f"{base}/{name}") as out:
                    out.write(png(np.frombuffer(data, np.uint8).reshape(h, w)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f"{folder}/{n}" for n in batch.column(0).to_pylist()])], ["name", "path"])

    return crops.select("name", "height", "width", "data").mapInArrow(run, "name string, path string")


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


RESULT_SCHEMA = """filename string, template_id string, template_name string, ocr_engine string, warning_count int,
pages array<struct<page_number: int, image_width: int, image_height: int, skew_angle: double, data_row_count: int, warning_count: int,
columns: array<struct<`index`: int, source_index: int, `key`: string, name: string, value_type: string, format: string, range_min: double, range_max: double>>,
cells: array<struct<`row`: int, column_index: int, source_column_index: int, column_key: string, column_name: string, bbox: array<int>, ocr_text: string, reviewed_text: string, was_edited: boolean, confidence: double, raw_text: string, validation_error: string, ground_truth_text: string, ground_truth_match: boolean, state: string>>>>"""


def results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT_SCHEMA).json(path, multiLine=True)


def result_cells(result: DataFrame) -> DataFrame:
    """(filename, page_number, and the fields of each cell)."""
    return result.select("filename", F.explode("pages").alias("p")).select("filename", F.col("p.page_number").alias("page_number"), F.inline("p.cells"))
