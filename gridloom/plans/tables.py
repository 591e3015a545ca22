"""Queries of table operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators import tables as c

from .registry import query, table


def line_cells(spark, d):
    """Line items as cells: row by order, column by line number."""
    return table(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("page"), F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"), F.concat("l_returnflag", "l_linestatus").alias("text"), (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 1000 + F.col("l_quantity")).alias("ord"))


@query("""WITH c AS (SELECT l_orderkey AS "row", l_linenumber AS col, max_by(l_returnflag || l_linestatus, l_partkey * 1000000 + l_suppkey * 1000 + l_quantity) AS t FROM lineitem GROUP BY 1, 2)
SELECT "row" % 50 AS page, "row", coalesce(max(t) FILTER (WHERE col = 1), '') AS c1, coalesce(max(t) FILTER (WHERE col = 2), '') AS c2, coalesce(max(t) FILTER (WHERE col = 3), '') AS c3 FROM c GROUP BY "row" HAVING TRUE""")
def c3_matrix(spark, d):
    return c.matrix(line_cells(spark, d), ["page"], "row", [1, 2, 3])


@query("""WITH c AS (SELECT DISTINCT o_custkey AS page, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS "row", o_orderkey % 3 AS col, o_orderpriority AS text FROM orders), h AS (SELECT page, col, text AS header FROM c WHERE "row" = 0)
SELECT c.page, c."row", c.col, header, text FROM c LEFT JOIN h ON c.page = h.page AND c.col = h.col WHERE c."row" > 0""")
def c15_headed(spark, d):
    at = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return c.headed(table(spark, d, "orders").select(F.col("o_custkey").alias("page"), at.alias("row"), (F.col("o_orderkey") % 3).alias("col"), F.col("o_orderpriority").alias("text")), ["page"])


@query("""SELECT l_orderkey % 50 AS page, max(l_orderkey) + 1 AS row_count, max(l_linenumber) + 1 AS col_count FROM lineitem GROUP BY 1""")
def c4_table_size(spark, d):
    return c.table_size(line_cells(spark, d), ["page"])


@query("""SELECT l_orderkey, l_linenumber, p_brand, p_type FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size < 20""")
def c5_rule_join(spark, d):
    rules = table(spark, d, "part").where("p_size < 20").select("p_partkey", "p_brand", "p_type")
    return table(spark, d, "lineitem").join(rules, F.col("l_partkey") == F.col("p_partkey"), "left").select("l_orderkey", "l_linenumber", "p_brand", "p_type")


@query("""WITH t AS (SELECT c_nationkey AS page, c_custkey // 25 AS "row", c_custkey % 25 AS col, c_mktsegment AS text FROM customer), g AS (SELECT page, col FROM t WHERE "row" = 0 AND lower(text) IN ('household', 'machinery')) SELECT page, "row", col, text FROM t ANTI JOIN g USING (page, col)""")
def c6_without_named(spark, d):
    cells = table(spark, d, "customer").select(F.col("c_nationkey").alias("page"), F.floor(F.col("c_custkey") / 25).alias("row"), (F.col("c_custkey") % 25).alias("col"), F.col("c_mktsegment").alias("text"))
    return c.without_named(cells, spark.createDataFrame([("Household ",), (" machinery",)], "name string"), ["page"]).select("page", "row", "col", "text")


@query("""SELECT l_orderkey % 50 AS page, l_linenumber AS col, count(*) AS n FROM lineitem WHERE l_linenumber NOT IN (2, 5, 99) GROUP BY 1, 2""")
def c7_without_columns(spark, d):
    return c.without_columns(line_cells(spark, d), [2, 5, 99]).groupBy("page", "col").agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT l_orderkey % 50 AS page, l_linenumber AS source_col, l_returnflag || l_linestatus AS text FROM lineitem WHERE l_linenumber NOT IN (2, 5)), s AS (SELECT page, source_col, row_number() OVER (PARTITION BY page ORDER BY source_col) - 1 AS col FROM (SELECT DISTINCT page, source_col FROM k)) SELECT page, source_col, col, count(*) AS n FROM k JOIN s USING (page, source_col) GROUP BY ALL""")
def c8_compacted(spark, d):
    kept = c.without_columns(line_cells(spark, d), [2, 5])
    return c.compacted(kept, kept.select("page", "col"), ["page"]).groupBy("page", "source_col", "col").agg(F.count("*").alias("n"))


@query("""SELECT 0 AS "row", r_regionkey AS col, r_name AS text FROM region UNION ALL SELECT n_nationkey + 1, n_regionkey, n_name FROM nation""")
def c9_with_header(spark, d):
    cells = table(spark, d, "nation").select(F.col("n_nationkey").alias("row"), F.col("n_regionkey").alias("col"), F.col("n_name").alias("text"))
    return c.with_header(cells, table(spark, d, "region").select(F.col("r_regionkey").alias("col"), F.col("r_name").alias("name")))


@query("""WITH c AS (SELECT l_orderkey AS "row", l_linenumber AS col FROM lineitem WHERE l_linenumber > 0) SELECT col, r_name, count(*) AS n FROM c JOIN region ON r_regionkey = col - 1 GROUP BY ALL""")
def c11_source_columns(spark, d):
    names = table(spark, d, "region").select((F.col("r_regionkey") + 1).alias("col"), "r_name")
    return line_cells(spark, d).where("col > 0").join(names, "col").groupBy("col", "r_name").agg(F.count("*").alias("n"))


@query("""SELECT n_nationkey AS index, n_name AS name, n_nationkey % 5 = 0 AS filter_out FROM nation WHERE n_nationkey % 5 <> 0 AND n_name NOT IN ('NATION_3', 'NATION_7')""")
def c12_kept_columns(spark, d):
    columns = table(spark, d, "nation").select(F.col("n_nationkey").alias("index"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 5 == 0).alias("filter_out"))
    return c.kept_columns(columns, spark.createDataFrame([("nation_3",), (" NATION_7 ",)], "name string"))


@query("""SELECT n_nationkey, 'column_' || (n_nationkey + 1) AS key, CASE WHEN n_nationkey % 3 = 0 THEN 'Column ' || (n_nationkey + 1) ELSE n_name END AS name FROM nation""")
def c13_generic_columns(spark, d):
    key, name = c.generic_columns(F.col("n_nationkey"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).otherwise("  "))
    return table(spark, d, "nation").select("n_nationkey", key.alias("key"), name.alias("name"))


@query("""WITH b AS (SELECT p_type, p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'Column ' || (p_partkey + 1) ELSE p_brand END AS base FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY p_type, base ORDER BY p_partkey) AS i FROM b) SELECT p_type, p_partkey, CASE WHEN i = 1 THEN base ELSE base || ' (' || i || ')' END AS header FROM n""")
def c14_unique_headers(spark, d):
    p = table(spark, d, "part").select("p_type", "p_partkey", F.when(F.col("p_partkey") % 9 != 0, F.col("p_brand")).otherwise(" ").alias("name"))
    return c.unique_headers(p, ["p_type"], "p_partkey", "name").select("p_type", "p_partkey", "header")


@query("""SELECT c_nationkey, count(*) AS cells, round_even(avg(CASE WHEN c_custkey % 4 > 0 THEN c_acctbal / 100 END), 0) AS mean_confidence, count_if(c_custkey % 4 = 0 OR c_acctbal / 100 < 90) AS flagged FROM customer GROUP BY c_nationkey""")
def c16_summary(spark, d):
    cells = table(spark, d, "customer").select("c_nationkey", F.col("c_name").alias("text"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_acctbal") / 100).alias("confidence"))
    return c.summary(cells, ["c_nationkey"])


@query("""SELECT n_nationkey FROM nation WHERE n_name = 'NATION_4'""")
def c17_rule_names(spark, d):
    from gridloom.operators.rules import rule_names

    return rule_names(table(spark, d, "nation").withColumns({"name": F.replace("n_name", F.lit("_"), F.lit(" ")), "key": F.lower("n_name")}), " Nation_4 ").select("n_nationkey")


@query("""SELECT r_name, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name""")
def c18_sorted_names(spark, d):
    rows = table(spark, d, "region").join(table(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), ",").alias("names"))


@query("SELECT p_brand AS name FROM part WHERE p_size < 5 UNION SELECT p_type FROM part WHERE p_size > 45")
def c19_filter_union(spark, d):
    p = table(spark, d, "part")
    return p.where("p_size < 5").select(F.col("p_brand").alias("name")).union(p.where("p_size > 45").select("p_type")).distinct()


@query("""SELECT l_orderkey % 50 AS page, l_orderkey AS "row", l_linenumber AS col, l_returnflag || l_linestatus AS text FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag || l_linestatus = 'NF')""")
def c20_review_rows(spark, d):
    return c.review_rows(line_cells(spark, d), ["page"], F.col("text") == "NF").select("page", "row", "col", "text")


@query("""WITH e AS (SELECT o_custkey AS c_custkey, max_by(o_orderpriority, o_orderkey) AS t FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT c_custkey, coalesce(t, c_mktsegment) AS reviewed_text, coalesce(t, c_mktsegment) <> c_mktsegment AS was_edited FROM customer LEFT JOIN e USING (c_custkey)""")
def c21_edited(spark, d):
    cells = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("text"), F.col("c_mktsegment").alias("reviewed_text"))
    edits = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("text"), F.col("o_orderkey").alias("seq"))
    return c.edited(cells, edits, ["c_custkey"]).select("c_custkey", "reviewed_text", "was_edited")


@query("SELECT DISTINCT o_custkey + 5 AS c_custkey FROM orders WHERE o_custkey + 5 NOT IN (SELECT c_custkey FROM customer)")
def c21_unknown_edits(spark, d):
    edits = table(spark, d, "orders").select((F.col("o_custkey") + 5).alias("c_custkey")).distinct()
    return c.unknown_edits(edits, table(spark, d, "customer"), ["c_custkey"])


@query("""SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'hi' ELSE 'note' END AS column_key, CASE WHEN o_orderkey % 3 = 0 THEN 'temperature' ELSE '' END AS value_type, o_orderkey % 32 AS "row", count(*) AS n FROM orders WHERE o_orderkey % 32 <> 0 GROUP BY ALL""")
def c22_label_manifest(spark, d):
    from gridloom.functions.text import cell_file_name

    name = cell_file_name(F.when(F.col("o_orderkey") % 3 == 0, "hi").otherwise("note"), (F.col("o_orderkey") % 32).cast("int"), F.lit(0), F.lit(1), F.lit(2), F.lit(3), F.lit(4))
    images = table(spark, d, "orders").select(F.lit("scan").alias("source"), name.alias("name"))
    columns = spark.createDataFrame([("hi", "High", "temperature", None, 50.0, 110.0)], "column_key string, column_name string, value_type string, format string, range_min double, range_max double")
    return c.label_manifest(images, columns, skip_header=True).groupBy("column_key", "value_type", "row").agg(F.count("*").alias("n"))


@query("""SELECT lang, count_if(n_chars < 200) AS warning_count FROM documents GROUP BY lang""")
def c23_warning_count(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count_if(F.col("n_chars") < 200).alias("warning_count"))


@query("""WITH s AS (SELECT n_regionkey, unnest(generate_series(1, max(n_nationkey))) AS "row" FROM nation GROUP BY 1), t AS (SELECT n_regionkey, n_nationkey AS "row", n_name FROM nation) SELECT n_regionkey, "row", coalesce(n_name, '') AS even, '' AS odd FROM s LEFT JOIN t USING (n_regionkey, "row")""")
def snk3_result_matrix(spark, d):
    cells = table(spark, d, "nation").select("n_regionkey", F.col("n_nationkey").alias("row"), F.lit("even").alias("key"), F.col("n_name").alias("text"), F.lit(None).cast("string").alias("reviewed_text"))
    return c.result_matrix(cells, ["n_regionkey"], ["even", "odd"], F.max("row"))


@query("""WITH r AS (SELECT n_regionkey, n_nationkey, n_nationkey % 2 = 0 AS gone, n_nationkey % 3 = 0 AS divider FROM nation), s AS (SELECT *, sum(CASE WHEN NOT gone AND NOT divider THEN 1 ELSE 0 END) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS UNBOUNDED PRECEDING) AS k FROM r) SELECT n_regionkey, min(n_nationkey) AS first, max(n_nationkey) AS last FROM s WHERE gone AND NOT divider GROUP BY n_regionkey, k""")
def i33_merged_ranges(spark, d):
    n = F.col("n_nationkey")
    return c.merged_ranges(table(spark, d, "nation"), ["n_regionkey"], "n_nationkey", n % 3 == 0, n % 2 == 0)


@query("""SELECT n_regionkey, '{"row_count":' || (max(n_nationkey) + 1) || ',"col_count":1,"cells":[' || string_agg('{"row":' || n_nationkey || ',"col":0,"bbox":[0,0,1,1],"text":"' || n_name || '","confidence":null}', ',' ORDER BY n_nationkey) || ']}' AS json FROM nation GROUP BY n_regionkey""")
def snk2_cells_json(spark, d):
    from gridloom.sources.files import cells_json

    nothing = F.lit(None)
    cells = table(spark, d, "nation").select("n_regionkey", F.col("n_nationkey").alias("row"), F.lit(0).alias("col"), F.array(*map(F.lit, (0, 0, 1, 1))).alias("bbox"), F.col("n_name").alias("text"), nothing.cast("double").alias("confidence"), nothing.cast("string").alias("raw_text"), nothing.cast("string").alias("validation_error"))
    return cells_json(cells, ["n_regionkey"])


@query("""SELECT n_regionkey, string_agg(n_nationkey || ',' || CASE WHEN n_nationkey % 2 = 0 THEN chr(34) || 'a,b ' || chr(34) || chr(34) || n_name || chr(34) || chr(34) || chr(34) ELSE n_name END, chr(10) ORDER BY n_nationkey) || chr(10) AS csv FROM nation GROUP BY n_regionkey""")
def snk1_csv_text(spark, d):
    from gridloom.sources.files import csv_text

    n = table(spark, d, "nation").select("n_regionkey", "n_nationkey", F.col("n_nationkey").cast("string").alias("k"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit('a,b "'), "n_name", F.lit('"'))).otherwise(F.col("n_name")).alias("v"))
    return csv_text(n, ["n_regionkey"], "n_nationkey", ["k", "v"])
