"""Scoring of recognized cells against the truth, and of reviews."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.text import exact_value, longest_suffix, normalized_header, same_exact


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null if there is no whole."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def with_matches(cells: DataFrame) -> DataFrame:
    """cells (text, truth, value_type) with exact_match and normalized_match.

    Exact values are a projection of their own, which Spark keeps apart from the
    comparisons that use them several times.
    """
    plain = cells.withColumns({"_text": exact_value(F.col("text")), "_truth": exact_value(F.col("truth"))})
    text, truth = F.col("_text"), F.col("_truth")
    return plain.withColumns({"exact_match": text == truth, "normalized_match": same_exact(text, truth, F.col("value_type"))}).drop("_text", "_truth")


def cell_state(matched: Column, error: Column) -> Column:
    """State of a scored cell, from whether it matched and its validation error."""
    wrong, warned = ~matched, error.isNotNull()
    return F.when(wrong & warned, "mismatch_and_warning").when(wrong, "ground_truth_mismatch").when(warned, "validation_warning").otherwise("correct")


def cleared_state(error: Column) -> Column:
    """State without a truth."""
    return F.when(error.isNotNull(), "validation_warning")


def metrics() -> list[Column]:
    """Aggregates over cells with matches; accuracies are null without cells."""
    scored = F.count("normalized_match")
    exact, normal = F.count_if(F.coalesce("exact_match", F.lit(False))), F.count_if(F.coalesce("normalized_match", F.lit(False)))
    return [scored.alias("scored_cells"), exact.alias("exact_correct"), normal.alias("normalized_correct"), (scored - normal).alias("incorrect"), ratio(exact, scored).alias("exact_accuracy"), ratio(normal, scored).alias("normalized_accuracy")]


def scored_by(cells: DataFrame, *keys: str) -> DataFrame:
    return cells.groupBy(*keys).agg(*metrics()) if keys else cells.agg(*metrics())


def scored_sets(cells: DataFrame, sets: list[list[str]]) -> DataFrame:
    """metrics() for several groupings at once, in one pass; `level` is the grouping's bit mask."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    return cells.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(F.grouping_id().alias("level"), *metrics())


def scored_columns(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """metrics() for each declared column, zeros for those without cells."""
    out = columns.select("index", "key").join(scored_by(cells, "key"), "key", "left")
    return out.fillna(0, ["scored_cells", "exact_correct", "normalized_correct", "incorrect"])


def row_correctness(cells: DataFrame, *row: str) -> DataFrame:
    """Whether all scored cells of each row match, exactly and normalized; rows without scored cells are left out."""
    scored = F.col("normalized_match").isNotNull()
    rows = cells.groupBy(*row).agg(F.bool_and(F.when(scored, F.col("exact_match"))).alias("fully_exact"), F.bool_and("normalized_match").alias("fully_normalized"))
    return rows.where(F.col("fully_normalized").isNotNull())


def global_rows(cells: DataFrame, pages: DataFrame, run: int = 4096) -> DataFrame:
    """cells (page, row) with global_row: pages (page, data_row_count) laid end to end.

    Pages are numbers. Their starts come from sums over runs of `run` page
    numbers and from windows within a run, so that only one row for each run
    meets in one task.
    """
    own = pages.select("page", "data_row_count", F.floor(F.col("page") / run).alias("_run"))
    ahead = W.orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    runs = own.groupBy("_run").agg(F.sum("data_row_count").alias("_rows")).select("_run", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_start"))
    before = W.partitionBy("_run").orderBy("page").rowsBetween(W.unboundedPreceding, -1)
    starts = own.withColumn("_before", F.coalesce(F.sum("data_row_count").over(before), F.lit(0))).join(runs, "_run").select("page", "data_row_count", (F.col("_start") + F.col("_before")).alias("start"))
    return cells.join(starts, "page").where("row >= 0 and row < data_row_count").withColumn("global_row", F.col("start") + F.col("row")).drop("start", "data_row_count")


def truth_errors(headers: DataFrame, columns: DataFrame, truth_rows: int, result_rows: int) -> DataFrame:
    """(step, error, detail) of each fault of a truth table, in the order in which they count.

    headers has index and header; columns has key and name. The first row by
    (step, detail) is the one to report; no row means the table is valid.
    """
    h = headers.withColumn("plain", normalized_header(F.coalesce("header", F.lit(""))))
    alias = columns.select("key", F.explode(F.array(normalized_header(F.col("key")), normalized_header(F.col("name")))).alias("plain")).distinct()
    known = h.join(alias, "plain")
    fault = lambda df, step, error, detail: df.select(F.lit(step).alias("step"), F.lit(error).alias("error"), detail.cast("string").alias("detail"))
    parts = [
        fault(h.agg(F.count("*").alias("n")).where("n = 0"), 1, "no header", F.lit("")),
        fault(h.where("plain = ''"), 2, "blank header", F.col("index")),
        fault(h.where("plain <> ''").groupBy("plain").count().where("count > 1"), 3, "duplicate header", F.col("plain")),
        fault(h.where("plain <> ''").join(alias, "plain", "left_anti"), 4, "unknown column", F.col("header")),
        fault(known.groupBy("key").agg(F.countDistinct("plain").alias("n")).where("n > 1"), 5, "two headers for a column", F.col("key")),
        fault(columns.join(known, "key", "left_anti"), 6, "missing column", F.col("key")),
    ]
    if truth_rows != result_rows:
        parts.append(fault(h.sparkSession.range(1), 7, "row count", F.lit(f"{truth_rows} for {result_rows}")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def header_mapping(headers: DataFrame, columns: DataFrame) -> DataFrame:
    """(key, index): the header of each column, by key first and then by name, the earliest of equals."""
    h = headers.withColumn("plain", normalized_header(F.col("header")))
    by = columns.select("key", F.explode(F.array(F.struct(F.lit(0).alias("rank"), normalized_header(F.col("key")).alias("plain")), F.struct(F.lit(1).alias("rank"), normalized_header(F.col("name")).alias("plain")))).alias("a")).select("key", "a.*")
    first = W.partitionBy("key").orderBy("rank", "index")
    return by.join(h, "plain").withColumn("_at", F.row_number().over(first)).where("_at = 1").select("key", "index")


def pair_score(result: DataFrame, truth: DataFrame) -> DataFrame:
    """Cells (row, key, value_type, text) against (row, key, truth): only rows and columns that both have, with matches."""
    return with_matches(result.join(truth, ["row", "key"]))


def pair_summary(result: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: rows and columns compared, what each side lacks, and the metrics.

    Cells meet once, in a full join; its rows are counted by row and by column in one aggregate over both.
    """
    here = F.lit(True)
    met = result.select("row", "key", "value_type", "text", here.alias("mine")).join(truth.select("row", "key", "truth", here.alias("theirs")), ["row", "key"], "full")
    both = F.col("mine") & F.col("theirs")
    cells = with_matches(met).withColumns({c: F.when(both, F.col(c)) for c in ("exact_match", "normalized_match")})
    sums = [F.bool_or("mine").alias("mine"), F.bool_or("theirs").alias("theirs"), F.count("normalized_match").alias("scored"), F.count_if("exact_match").alias("exact"), F.count_if("normalized_match").alias("normal")]
    by = cells.groupingSets([["row"], ["key"]], "row", "key").agg(F.grouping("key").alias("_rows"), *sums)
    mine, theirs, of_row, of_key = F.coalesce("mine", F.lit(False)), F.coalesce("theirs", F.lit(False)), F.col("_rows") == 1, F.col("_rows") == 0
    lacking = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(of_key & c, F.col("key")))), "; ")
    row = of_row & F.col("row").isNotNull()
    total = lambda c: F.coalesce(F.sum(F.when(of_key, F.col(c))), F.lit(0))
    out = by.agg(F.count_if(row & mine).alias("ocr_rows"), F.count_if(row & theirs).alias("truth_rows"), lacking(theirs & ~mine).alias("missing_result_columns"), lacking(mine & ~theirs).alias("missing_truth_columns"), F.count_if(of_key & mine & theirs).alias("columns_compared"), total("scored").alias("scored_cells"), total("exact").alias("exact_correct"), total("normal").alias("normalized_correct"))
    share = lambda c: ratio(F.col(c), F.nullif("scored_cells", F.lit(0)))
    out = out.withColumns({"incorrect": F.col("scored_cells") - F.col("normalized_correct"), "exact_accuracy": share("exact_correct"), "normalized_accuracy": share("normalized_correct")})
    return out.withColumns({"rows_compared": F.least("ocr_rows", "truth_rows"), "row_count_difference": F.col("ocr_rows") - F.col("truth_rows")})


def file_pairs(results: DataFrame, truths: DataFrame, template_ids: list[str]) -> DataFrame:
    """(result_file, truth_file, template_id) for each result file name, ending in _<template id>_llm.csv, whose template has a truth file; both sides have `name`."""
    stem = F.regexp_extract("name", r"\A(.*)\.csv\z", 1)
    named = results.select(F.col("name").alias("result_file"), longest_suffix(stem, template_ids, "_llm").alias("template_id")).where("template_id is not null")
    return named.join(truths.select(F.col("name").alias("truth_file"), F.regexp_extract("name", r"\A(.*)\.csv\z", 1).alias("template_id")), "template_id").select("result_file", "truth_file", "template_id")


def mapped_headers(cells: DataFrame, columns: DataFrame, file: str) -> DataFrame:
    """(file, template_id, key, index): the header of each column in each file, by key before name; of equal headers the last counts, as a reader of named fields has it."""
    heads = cells.select(file, "template_id", "index", normalized_header(F.col("header")).alias("plain")).distinct().groupBy(file, "template_id", "plain").agg(F.max("index").alias("index"))
    names = F.array(F.struct(F.lit(0).alias("rank"), normalized_header(F.col("key")).alias("plain")), F.struct(F.lit(1).alias("rank"), normalized_header(F.col("name")).alias("plain")))
    alias = columns.select("template_id", "key", F.explode(names).alias("a")).select("template_id", "key", "a.*")
    return heads.join(alias, ["template_id", "plain"]).groupBy(file, "template_id", "key").agg(F.min_by("index", "rank").alias("index"))


class PairScores(NamedTuple):
    """by_cell, by_column and summary of scored pairs of files."""

    by_cell: DataFrame
    by_column: DataFrame
    summary: DataFrame


def scored_pairs(results: DataFrame, truths: DataFrame, columns: DataFrame) -> PairScores:
    """Result files against the truth of their template.

    results has (result_file, template_id, row, index, header, value), truths
    the same without result_file; rows count from 0. columns has (template_id,
    index, key, name, value_type, filter_out). Only columns that aren't filtered
    out, that both files have, and rows that both files have are compared; the
    summary says what was left out. Files without a truth don't count.
    """
    shown = columns.where(~F.coalesce("filter_out", F.lit(False)))
    many = results.groupBy("result_file", "template_id").agg((F.max("row") + 1).alias("ocr_rows")).join(truths.groupBy("template_id").agg((F.max("row") + 1).alias("truth_rows")), "template_id")
    files = many.withColumns({"rows_compared": F.least("ocr_rows", "truth_rows"), "row_count_difference": F.col("ocr_rows") - F.col("truth_rows")})
    mine = mapped_headers(results, shown, "result_file")
    theirs = mapped_headers(truths.withColumn("truth_file", F.col("template_id")), shown, "truth_file").drop("truth_file")
    every = files.select("result_file", "template_id").join(shown.select("template_id", F.col("index").alias("place"), "key", "name", "value_type"), "template_id")
    every = every.join(mine.withColumnRenamed("index", "result_index"), ["result_file", "template_id", "key"], "left").join(theirs.withColumnRenamed("index", "truth_index"), ["template_id", "key"], "left")
    both = every.where("result_index is not null and truth_index is not null")
    read = results.select("result_file", "template_id", "row", F.col("index").alias("result_index"), F.col("value").alias("text")).join(both, ["result_file", "template_id", "result_index"])
    cells = read.join(truths.select("template_id", "row", F.col("index").alias("truth_index"), F.col("value").alias("truth")), ["template_id", "row", "truth_index"])
    scored = with_matches(cells)
    by_cell = scored.select("result_file", "template_id", (F.col("row") + 1).alias("row_number"), F.col("key").alias("column_key"), F.col("name").alias("column_name"), "value_type", F.col("text").alias("ocr_value"), F.col("truth").alias("ground_truth_value"), "exact_match", "normalized_match")
    by_column = scored.groupBy("result_file", "template_id", F.col("key").alias("column_key"), F.col("name").alias("column_name"), "value_type").agg(*metrics())
    rows = scored.groupBy("result_file", "template_id", "row").agg(F.bool_and("exact_match").alias("e"), F.bool_and("normalized_match").alias("n"), F.count("normalized_match").alias("cells"), F.count_if("exact_match").alias("exact"), F.count_if("normalized_match").alias("normal"))
    totals = rows.groupBy("result_file", "template_id").agg(F.sum("cells").alias("scored_cells"), F.sum("exact").alias("exact_correct"), F.sum("normal").alias("normalized_correct"), F.count_if("e").alias("fully_exact_rows"), F.count_if("n").alias("fully_normalized_rows"))
    lacking = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNull(), F.struct("place", "name")))), lambda x: x["name"]), "; ")
    gaps = every.groupBy("result_file", "template_id").agg(F.count_if(F.col("result_index").isNotNull() & F.col("truth_index").isNotNull()).alias("columns_compared"), lacking("result_index").alias("missing_result_columns"), lacking("truth_index").alias("missing_truth_columns"))
    summary = files.join(gaps, ["result_file", "template_id"], "left").join(totals, ["result_file", "template_id"], "left").fillna(0, ["columns_compared", "scored_cells", "exact_correct", "normalized_correct", "fully_exact_rows", "fully_normalized_rows"])
    shares = {"exact_accuracy": ratio(F.col("exact_correct"), F.nullif("scored_cells", F.lit(0))), "normalized_accuracy": ratio(F.col("normalized_correct"), F.nullif("scored_cells", F.lit(0)))}
    return PairScores(by_cell, by_column, summary.withColumns(shares))


def review_metrics(flagged: Column, wrong: Column) -> list[Column]:
    """Precision, recall and F1 of review flags against wrong cells, with false alarms and missed errors."""
    hit, flags, errors = F.count_if(flagged & wrong), F.count_if(flagged), F.count_if(wrong)
    p, r = ratio(hit, flags), ratio(hit, errors)
    return [hit.alias("true_flags"), flags.alias("flagged"), errors.alias("wrong"), p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).alias("f1"), (flags - hit).alias("false_alarms"), (errors - hit).alias("missed_errors")]


def character_error_rate(text: Column, truth: Column) -> Column:
    """Edits over the truth's characters; null for an empty truth."""
    return F.try_divide(F.levenshtein(exact_value(text), exact_value(truth)).cast("double"), F.length(exact_value(truth)).cast("double"))


def split_of(source: Column, shares: tuple[int, int, int] = (70, 15, 15)) -> Column:
    """train, validation or test; all rows of one source fall together."""
    at = F.pmod(F.crc32(source.cast("binary")), F.lit(100))
    return F.when(at < shares[0], "train").when(at < shares[0] + shares[1], "validation").otherwise("test")


def paired(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (keys, value_type, text, truth) that two runs have both read: the keys, right_before, right_after."""
    one, two = (with_matches(df).select(*keys, F.col("normalized_match").alias(name)) for df, name in ((before, "right_before"), (after, "right_after")))
    return one.join(two, keys)


def run_comparison(pairs: DataFrame, *by: str) -> DataFrame:
    """(by, cells, both_right, won, lost, both_wrong, change, statistic): what a second run won and lost, in one aggregate.

    change is the difference in accuracy, statistic McNemar's with the
    continuity correction, null where no cell changed sides. Cells that either run couldn't score don't count.
    """
    a, b = F.col("right_before"), F.col("right_after")
    won, lost = F.count_if(~a & b), F.count_if(a & ~b)
    cells = F.count_if(a.isNotNull() & b.isNotNull())
    moved = won + lost
    statistic = F.try_divide(F.pow(F.greatest(F.abs(won - lost) - 1, F.lit(0)), F.lit(2.0)), moved.cast("double"))
    return pairs.groupBy(*by).agg(cells.alias("cells"), F.count_if(a & b).alias("both_right"), won.alias("won"), lost.alias("lost"), F.count_if(~a & ~b).alias("both_wrong"), ratio(won - lost, cells).alias("change"), statistic.alias("statistic"))


def hardest_cells(cells: DataFrame, by: str, order: list[str], most: int = 20) -> DataFrame:
    """The `most` cells of each group with the highest character error rate, ties by `order`; rank counts from 1. Tasks keep that many of a group before the shuffle."""
    rated = cells.withColumn("cer", character_error_rate(F.col("text"), F.col("truth"))).where("cer > 0")
    ranked = rated.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.col("cer").desc(), *order)))
    return ranked.where(F.col("rank") <= most)


def split_sizes(rows: DataFrame, source: str) -> DataFrame:
    """(split, sources, rows) of a table that is split by source; a row without a source goes by the empty name."""
    own = rows.groupBy(F.coalesce(source, F.lit("")).alias("source")).agg(F.count("*").alias("n"))
    return own.groupBy(split_of(F.col("source")).alias("split")).agg(F.count("*").alias("sources"), F.sum("n").alias("rows"))
