"""Tables of cells in long form: columns dropped and renumbered, matrices, headers, summaries, edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.text import normalized_column_name, parsed_cell_file, strip


def matrix(cells: DataFrame, keys: list[str], row: str, columns: list[int], col: str = "col", text: str = "text", order: str = "ord", fill: str = "") -> DataFrame:
    """(keys, row, c0, c1, ...): one column for each of `columns`; of several cells at a place the last by `order` counts."""
    wide = cells.groupBy(*keys, row).pivot(col, columns).agg(F.max_by(text, order))
    return wide.select(*keys, row, *[F.coalesce(F.col(f"`{c}`"), F.lit(fill)).alias(f"c{c}") for c in columns])


def table_size(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row_count, col_count), from the largest indexes."""
    return cells.groupBy(*keys).agg((F.max("row") + 1).alias("row_count"), (F.max("col") + 1).alias("col_count"))


def without_named(cells: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """Cells outside the columns whose header, in row 0, is one of `names` (name)."""
    wanted = names.select(normalized_column_name(F.col("name")).alias("_name")).distinct()
    gone = cells.where("row = 0").withColumn("_name", normalized_column_name(F.col("text"))).join(wanted, "_name").select(*keys, "col").distinct()
    return cells.join(gone, [*keys, "col"], "left_anti")


def headed(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, col, header, text): the cells under the first row, each with the first row's text of its column; a column without one has none."""
    head = cells.where("row = 0").groupBy(*keys, "col").agg(F.max("text").alias("header"))
    return cells.where("row > 0").join(head, [*keys, "col"], "left").select(*keys, "row", "col", "header", "text")


def without_columns(cells: DataFrame, gone: list[int]) -> DataFrame:
    return cells.where(~F.col("col").isin(*gone)) if gone else cells


def compacted(cells: DataFrame, spine: DataFrame, keys: list[str]) -> DataFrame:
    """cells with source_col, and col renumbered without gaps over the columns of the spine (keys, col), empty ones included."""
    dense = spine.select(*keys, "col").distinct().withColumn("_new", F.row_number().over(W.partitionBy(*keys).orderBy("col")) - 1)
    return cells.join(dense, [*keys, "col"]).withColumnRenamed("col", "source_col").withColumnRenamed("_new", "col")


def with_header(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """A row 0 with the names of `columns` (col, name) before the cells, whose rows move down."""
    head = columns.select(F.lit(0).alias("row"), "col", F.col("name").alias("text"))
    return head.unionByName(cells.select((F.col("row") + 1).alias("row"), "col", "text"))


def kept_columns(columns: DataFrame, hidden: DataFrame) -> DataFrame:
    """Template columns that are neither filtered out nor among the hidden names (name)."""
    names = hidden.select(normalized_column_name(F.col("name")).alias("_name")).distinct()
    return columns.where("not filter_out").withColumn("_name", normalized_column_name(F.col("name"))).join(names, "_name", "left_anti").drop("_name")


def generic_columns(index: Column, name: Column) -> tuple[Column, Column]:
    """(key, name) of a column without a template."""
    return F.concat(F.lit("column_"), (index + 1).cast("string")), F.coalesce(F.nullif(strip(name), F.lit("")), F.concat(F.lit("Column "), (index + 1).cast("string")))


def unique_headers(df: DataFrame, keys: list[str], index: str, name: str) -> DataFrame:
    """df with `header`: blank names by number, and repeated ones numbered from the second on."""
    base = F.coalesce(F.nullif(strip(F.col(name)), F.lit("")), F.concat(F.lit("Column "), (F.col(index) + 1).cast("string")))
    at = F.row_number().over(W.partitionBy(*keys, "_base").orderBy(index))
    return df.withColumn("_base", base).withColumn("_n", at).withColumn("header", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit(" ("), F.col("_n").cast("string"), F.lit(")")))).drop("_base", "_n")


def is_flagged(text: Column, confidence: Column, least: float = 90) -> Column:
    """Whether a cell needs a look: blank, without confidence, or below `least`."""
    return (strip(F.coalesce(text, F.lit(""))) == "") | confidence.isNull() | F.coalesce(confidence < least, F.lit(False))


def summary(cells: DataFrame, keys: list[str], least: float = 90) -> DataFrame:
    """(keys, cells, mean_confidence, flagged)."""
    return cells.groupBy(*keys).agg(F.count("*").alias("cells"), F.bround(F.avg("confidence"), 0).alias("mean_confidence"), F.count_if(is_flagged(F.col("text"), F.col("confidence"), least)).alias("flagged"))


def review_rows(cells: DataFrame, keys: list[str], needs_review: Column) -> DataFrame:
    """The cells of rows in which some cell needs review."""
    rows = cells.where(needs_review).select(*keys, "row").distinct()
    return cells.join(rows, [*keys, "row"], "left_semi")


def edited(cells: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """cells with reviewed_text and was_edited after edits (keys, text, seq); of several edits to a cell the last counts."""
    last = edits.groupBy(*keys).agg(F.max_by("text", "seq").alias("_new"))
    new = F.coalesce("_new", "reviewed_text")
    return cells.join(last, keys, "left").withColumn("reviewed_text", new).withColumn("was_edited", F.coalesce(F.col("reviewed_text") != F.col("text"), F.lit(False))).drop("_new")


def unknown_edits(edits: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    return edits.join(cells.select(*keys).distinct(), keys, "left_anti")


def label_manifest(images: DataFrame, columns: DataFrame, skip_header: bool = False) -> DataFrame:
    """Rows to label from cell images (source, name), with what the template's `columns` say; blanks where they say nothing."""
    parts = images.withColumns(parsed_cell_file(F.col("name")))
    if skip_header:
        parts = parts.where("row <> 0")
    meta = ["column_name", "value_type", "format", "range_min", "range_max"]
    out = parts.join(columns, "column_key", "left")
    return out.select("name", F.lit("").alias("label"), F.lit("unlabeled").alias("label_status"), "source", "column_key", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in meta], "row", "x", "y", "width", "height", F.lit("").alias("notes"))


def result_matrix(cells: DataFrame, keys: list[str], columns: list[str], rows: Column) -> DataFrame:
    """(keys, row, columns): rows 1 to `rows`, reviewed text before what was read, blank where there is no cell."""
    spine = cells.groupBy(*keys).agg(rows.alias("_n")).select(*keys, F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("row"))
    wide = cells.groupBy(*keys, "row").pivot("key", columns).agg(F.max(F.coalesce("reviewed_text", "text")))
    return spine.join(wide, [*keys, "row"], "left").fillna("", columns)


def merged_ranges(df: DataFrame, keys: list[str], index: str, is_divider: Column, redacted: Column) -> DataFrame:
    """(keys, first, last) of redacted columns; ranges with only dividers between them are one."""
    plain = F.sum(F.when(~redacted & ~is_divider, 1).otherwise(0)).over(W.partitionBy(*keys).orderBy(index).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("_run", plain).where(redacted & ~is_divider).groupBy(*keys, "_run").agg(F.min(index).alias("first"), F.max(index).alias("last")).drop("_run")
