"""Queries that write a table, read it back with a reader of forms, and so check both ways."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import recognize
from gridloom.operators.axis import grid_cells
from gridloom.sources import files

from .images import pages
from .registry import query, table
from .streams import scratch


@query("""SELECT n_nationkey AS "row", h AS header, CASE h WHEN 'Key' THEN CAST(n_nationkey AS VARCHAR) WHEN 'Name' THEN n_name || ', "of"' || chr(10) || n_regionkey ELSE '' END AS value FROM nation, (VALUES ('Key'), ('Name'), ('Comments')) AS v(h)""")
def src6_truth_table(spark, d):
    out = scratch(spark)
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("Key"), F.concat("n_name", F.lit(', "of"\n'), F.col("n_regionkey").cast("string")).alias("Name"), F.lit(None).cast("string").alias("Comments"))
    files.write_csv(n.orderBy("Key"), out)
    return files.truth_table(spark, out).select("row", "header", "value")


@query("""SELECT 'form_' || r_regionkey AS template_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT) AS index, lower(n_name) AS key, CASE WHEN n_nationkey % 2 = 0 THEN 'temperature' ELSE 'text' END AS value_type, n_nationkey % 3 = 0 AS filter_out, 1.5 AS width FROM nation JOIN region ON n_regionkey = r_regionkey""")
def src4_templates(spark, d):
    out, k = scratch(spark), F.col("n_nationkey")
    column = F.struct(F.col("i").alias("index"), F.lower("n_name").alias("key"), F.col("n_name").alias("name"), F.when(k % 2 == 0, "temperature").otherwise("text").alias("value_type"), (k % 3 == 0).alias("filter_out"))
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    ranked = rows.groupBy("r_regionkey", "r_name").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("l")).select("r_regionkey", "r_name", F.posexplode("l").alias("i", "n")).select("r_regionkey", "r_name", "i", "n.*")
    forms = ranked.groupBy("r_regionkey", "r_name").agg(F.sort_array(F.collect_list(column)).alias("columns"))
    forms = forms.select(F.col("r_regionkey").alias("part"), F.concat(F.lit("form_"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"), F.struct(F.transform("columns", lambda c: F.lit(1.5)).alias("column_widths")).alias("table"), "columns")
    forms.repartition(8, "part").write.partitionBy("part").json(out)
    return files.template_columns(files.templates(spark, out)).select("template_id", "index", "key", "value_type", "filter_out", "width")


@query("""SELECT 'r' || r_regionkey AS filename, 1 AS page_number, n_nationkey AS "row", 'name' AS column_key, n_name AS ocr_text FROM nation JOIN region ON n_regionkey = r_regionkey""")
def src8_results(spark, d):
    out = scratch(spark)
    cell = F.struct(F.col("n_nationkey").alias("row"), F.lit("name").alias("column_key"), F.col("n_name").alias("ocr_text"))
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(cell).alias("cells"))
    rows = rows.select(F.col("n_regionkey").alias("part"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("filename"), F.array(F.struct(F.lit(1).alias("page_number"), "cells")).alias("pages"))
    rows.repartition(8, "part").write.partitionBy("part").json(out)
    return files.result_cells(files.results(spark, out)).select("filename", "page_number", "row", "column_key", "ocr_text")


@query("SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'K' || n_nationkey END AS key, n_name || '=' || n_regionkey AS value FROM nation WHERE n_nationkey % 3 = 0")
def src11_settings(spark, d):
    out, k = scratch(spark), F.col("n_nationkey")
    line = F.when(k % 3 == 0, F.concat(F.lit(" K"), k.cast("string"), F.lit(' = "'), "n_name", F.lit("="), F.col("n_regionkey").cast("string"), F.lit('"'))).when(k % 3 == 1, F.concat(F.lit("# x="), "n_name")).otherwise("no value")
    table(spark, d, "nation").select(line.alias("value")).write.text(out)
    return files.settings(spark, out)


LEVELS = "l AS (SELECT vec_id AS page, (i - 1) // 8 AS y, (i - 1) % 8 AS x, least(255, greatest(0, CAST(floor(CAST(embedding[i] AS DOUBLE) * 256 + 128) AS INT))) AS v FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings))"


@query(f"""WITH {LEVELS} SELECT page, CAST(y // 4 AS INT) AS "row", CAST(x // 4 AS INT) AS col, CAST(round_even(255 - avg(v), 0) AS INT) AS darkness, round(round((255 - avg(v)) / 255 * 100, 3), 2) AS confidence FROM l GROUP BY 1, 2, 3""")
def c4_recognized_cells(spark, d):
    """Each page's four quarters as cells, cut and read."""
    p = pages(spark, d)
    lines = p.select("page", F.explode(F.array(*map(F.lit, (0, 4, 8)))).alias("y"))
    cells = grid_cells(lines, lines.withColumnRenamed("y", "x"), ["page"])
    read = recognize.read_cells(recognize.crops(p, cells), recognize.engine("fake"), prepare=False)
    return read.select("page", "row", "col", F.col("text").cast("int").alias("darkness"), F.round("confidence", 2).alias("confidence"))


@query("SELECT n_nationkey AS index FROM nation WHERE (n_nationkey % 4 = 0 OR n_nationkey IN (5, 6)) AND n_nationkey % 3 <> 0")
def i34_redacted_columns(spark, d):
    k = F.col("n_nationkey")
    columns = table(spark, d, "nation").select(k.alias("index"), F.when(k % 3 == 0, "Divider_1").otherwise("x").alias("key"), (k % 4 == 0).alias("filter_out"))
    return recognize.redacted_columns(columns, [5, 6])
