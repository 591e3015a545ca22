"""Queries that score, over tables that stand for recognized cells and their truth."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.text import normalized_value
from gridloom.operators import scoring as s

from .registry import crc32_sql, query, table

#: Line items as cells: four columns of an order's rows, some misread on purpose.
CELLS_SQL = r"""
i AS (SELECT l_orderkey AS page, l_linenumber AS "row", l_partkey, l_quantity, l_returnflag, l_linestatus, l_shipdate, l_suppkey FROM lineitem),
cells AS (
  SELECT page, "row", 'temp' AS key, 'temperature' AS value_type, CASE WHEN l_partkey % 7 = 0 THEN '12.34' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) || '.0' END AS text, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS truth,
    CASE WHEN l_partkey % 7 = 0 THEN 12.34 = CAST(l_quantity AS INT) ELSE TRUE END AS normalized_match, CASE WHEN l_partkey % 11 = 0 THEN 'low' END AS error FROM i
  UNION ALL SELECT page, "row", 'day', 'date_dd_mon', strftime(l_shipdate, '%d-%b'), strftime(CASE WHEN l_partkey % 5 = 0 THEN l_shipdate + INTERVAL 1 DAY ELSE l_shipdate END, '%d %b'), l_partkey % 5 <> 0, NULL FROM i
  UNION ALL SELECT page, "row", 'note', 'english_text', ' ' || l_returnflag || '-' || l_linestatus || CASE WHEN l_partkey % 3 = 0 THEN '!' ELSE '' END, lower(l_returnflag) || l_linestatus, TRUE, NULL FROM i
  UNION ALL SELECT page, "row", 'flag', 'text', l_returnflag, CASE WHEN l_suppkey % 4 = 0 THEN l_linestatus ELSE lower(l_returnflag) END, CASE WHEN l_suppkey % 4 = 0 THEN l_returnflag = l_linestatus ELSE TRUE END, NULL FROM i),
m AS (SELECT *, trim(text) = trim(truth) AS exact_match FROM cells)"""
METRICS_SQL = """count(normalized_match) AS scored_cells, count_if(exact_match) AS exact_correct, count_if(normalized_match) AS normalized_correct, count(normalized_match) - count_if(normalized_match) AS incorrect,
  CAST(count_if(exact_match) AS DOUBLE) / nullif(count(normalized_match), 0) AS exact_accuracy, CAST(count_if(normalized_match) AS DOUBLE) / nullif(count(normalized_match), 0) AS normalized_accuracy"""


def raw_cells(spark, d):
    i = table(spark, d, "lineitem").withColumn("q", F.col("l_quantity").cast("int").cast("string"))
    bad = lambda c, n: F.col(c) % n == 0
    late = F.when(bad("l_partkey", 5), F.col("l_shipdate") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("l_shipdate"))
    cell = lambda key, kind, text, truth, error=None: F.struct(F.lit(key).alias("key"), F.lit(kind).alias("value_type"), text.alias("text"), truth.alias("truth"), (F.lit(None).cast("string") if error is None else error).alias("error"))
    four = F.array(
        cell("temp", "temperature", F.when(bad("l_partkey", 7), "12.34").otherwise(F.concat("q", F.lit(".0"))), F.col("q"), F.when(bad("l_partkey", 11), "low")),
        cell("day", "date_dd_mon", F.date_format("l_shipdate", "dd-MMM"), F.date_format(late, "dd MMM")),
        cell("note", "english_text", F.concat(F.lit(" "), "l_returnflag", F.lit("-"), "l_linestatus", F.when(bad("l_partkey", 3), "!").otherwise("")), F.concat(F.lower("l_returnflag"), "l_linestatus")),
        cell("flag", "text", F.col("l_returnflag"), F.when(bad("l_suppkey", 4), F.col("l_linestatus")).otherwise(F.lower("l_returnflag"))),
    )
    return i.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("row"), F.inline(four))


def cells(spark, d):
    return s.with_matches(raw_cells(spark, d))


@query("""SELECT doc_id, CASE lang WHEN 'en' THEN length(regexp_replace(lower(replace(text, 'ß', 'ss')), '[^a-z0-9]', '', 'g')) ELSE length(trim(regexp_replace(lower(replace(text, 'ß', 'ss')), '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g'))) END AS n FROM documents""")
def s4_normalized_value(spark, d):
    kind = F.when(F.col("lang") == "en", "english_text").otherwise("text")
    return table(spark, d, "documents").select("doc_id", F.length(normalized_value(F.col("text"), kind)).cast("long").alias("n"))


@query(f"WITH {CELLS_SQL} SELECT key, {METRICS_SQL} FROM m GROUP BY key")
def s10_normalized_accuracy(spark, d):
    return s.scored_by(cells(spark, d), "key")


@query(f"WITH {CELLS_SQL} SELECT key, exact_match, count(*) AS n FROM m GROUP BY 1, 2")
def s3_exact_match(spark, d):
    return cells(spark, d).groupBy("key", "exact_match").agg(F.count("*").alias("n"))


@query(f"""WITH {CELLS_SQL} SELECT key, CASE WHEN NOT normalized_match AND error IS NOT NULL THEN 'mismatch_and_warning' WHEN NOT normalized_match THEN 'ground_truth_mismatch' WHEN error IS NOT NULL THEN 'validation_warning' ELSE 'correct' END AS state, count(*) AS n FROM m GROUP BY 1, 2""")
def s7_cell_state(spark, d):
    return cells(spark, d).groupBy("key", s.cell_state(F.col("normalized_match"), F.col("error")).alias("state")).agg(F.count("*").alias("n"))


@query(f"WITH {CELLS_SQL} SELECT {METRICS_SQL} FROM m")
def s8_overall(spark, d):
    return s.scored_by(cells(spark, d))


@query(f"""WITH {CELLS_SQL}, r AS (SELECT page, "row", bool_and(exact_match) AS e, bool_and(normalized_match) AS n FROM m GROUP BY 1, 2) SELECT count(*) AS scored_rows, count_if(e) AS fully_exact_rows, count_if(n) AS fully_normalized_rows FROM r""")
def s9_s17_full_rows(spark, d):
    rows = s.row_correctness(cells(spark, d), "page", "row")
    return rows.agg(F.count("*").alias("scored_rows"), F.count_if("fully_exact").alias("fully_exact_rows"), F.count_if("fully_normalized").alias("fully_normalized_rows"))


@query(f"""WITH {CELLS_SQL}, c(index, key) AS (VALUES (0, 'temp'), (1, 'day'), (2, 'note'), (3, 'flag'), (4, 'initials')), g AS (SELECT key, {METRICS_SQL} FROM m GROUP BY key)
SELECT key, index, coalesce(scored_cells, 0) AS scored_cells, coalesce(exact_correct, 0) AS exact_correct, coalesce(normalized_correct, 0) AS normalized_correct, coalesce(incorrect, 0) AS incorrect, exact_accuracy, normalized_accuracy FROM c LEFT JOIN g USING (key)""")
def s10_declared_columns(spark, d):
    columns = spark.createDataFrame([(i, k) for i, k in enumerate(("temp", "day", "note", "flag", "initials"))], "index int, key string")
    return s.scored_columns(cells(spark, d), columns)


@query(f"WITH {CELLS_SQL} SELECT page % 10 AS section, key, GROUPING_ID(page % 10, key) AS level, {METRICS_SQL} FROM m GROUP BY GROUPING SETS ((page % 10), (key), ())")
def s11_grouping_sets(spark, d):
    return s.scored_sets(cells(spark, d).withColumn("section", F.col("page") % 10), [["section"], ["key"], []])


@query("""SELECT o_orderkey AS page, l_linenumber AS "row", start + l_linenumber AS global_row FROM (SELECT o_orderkey, CAST(coalesce(sum(n) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, n
FROM (SELECT o_orderkey, CAST(1 + o_orderkey % 7 AS BIGINT) AS n FROM orders)) JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber < n""")
def s5_global_rows(spark, d):
    pages = table(spark, d, "orders").select(F.col("o_orderkey").alias("page"), (1 + F.col("o_orderkey") % 7).alias("data_row_count"))
    return s.global_rows(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("row")), pages)


@query(f"WITH {CELLS_SQL} SELECT key, count(*) AS n, count(error) AS warned FROM m GROUP BY key")
def s12_cleared_state(spark, d):
    return cells(spark, d).select("key", s.cleared_state(F.col("error")).alias("state")).groupBy("key").agg(F.count("*").alias("n"), F.count("state").alias("warned"))


#: Names of result files that end in a template's id, and of truth files; some have no template, some templates no truth.
@query("""WITH f AS (SELECT 'scan_' || o_orderkey || '_' || CASE o_orderkey % 5 WHEN 0 THEN 'farm' WHEN 1 THEN 'old_farm' WHEN 2 THEN 'herd' WHEN 3 THEN 'barn' ELSE 'none' END || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '_llm' END || '.csv' AS name, o_orderkey % 5 AS k FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 < 3)
SELECT name AS result_file, t || '.csv' AS truth_file, t AS template_id FROM (SELECT name, CASE k WHEN 0 THEN 'farm' WHEN 1 THEN 'old_farm' ELSE 'herd' END AS t FROM f)""")
def s13_pairs(spark, d):
    k = F.col("o_orderkey")
    kind = F.when(k % 5 == 0, "farm").when(k % 5 == 1, "old_farm").when(k % 5 == 2, "herd").when(k % 5 == 3, "barn").otherwise("none")
    results = table(spark, d, "orders").select(F.concat(F.lit("scan_"), k.cast("string"), F.lit("_"), kind, F.when(k % 7 == 0, ".csv").otherwise("_llm.csv")).alias("name"))
    truths = spark.createDataFrame([("farm.csv",), ("old_farm.csv",), ("herd.csv",), ("unused.csv",)], "name string")
    return s.file_pairs(results, truths, ["farm", "old_farm", "herd", "barn"])


#: Orders as rows of 50 result files of 5 templates, customers as the truth of 4 of them.
PAIRS_SQL = """
rn AS (SELECT CAST(o_custkey % 50 AS VARCHAR) || '_llm.csv' AS result_file, 't' || o_custkey % 5 AS template_id, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) - 1 AS "row", o_orderstatus AS status, CAST(CAST(floor(o_totalprice / 1000) AS INT) AS VARCHAR) || '.0' AS price, o_orderpriority AS urgency FROM orders),
tn AS (SELECT 't' || c_nationkey % 4 AS template_id, row_number() OVER (PARTITION BY c_nationkey % 4 ORDER BY c_custkey) - 1 AS "row", CASE c_custkey % 3 WHEN 0 THEN 'O' WHEN 1 THEN ' f' ELSE 'P' END AS status, CAST(100 + c_custkey % 50 AS VARCHAR) AS price FROM customer),
n AS (SELECT * FROM (SELECT result_file, template_id, max("row") + 1 AS ocr_rows FROM rn GROUP BY 1, 2) JOIN (SELECT template_id, max("row") + 1 AS truth_rows FROM tn GROUP BY 1) USING (template_id)),
j AS (SELECT result_file, rn.template_id, "row", rn.status AS s, tn.status AS t, rn.price AS p, tn.price AS q FROM rn JOIN tn USING (template_id, "row")),
cell AS (SELECT result_file, template_id, "row", 'status' AS column_key, 'State' AS column_name, 'text' AS value_type, s AS ocr_value, t AS ground_truth_value, s = trim(t) AS exact_match, lower(s) = lower(trim(t)) AS normalized_match FROM j
  UNION ALL SELECT result_file, template_id, "row", 'price', 'Total price', 'temperature', p, q, p = q, CAST(p AS DOUBLE) = CAST(q AS DOUBLE) FROM j)"""


def scored_pairs(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    named = lambda *cols: F.inline(F.array(*[F.struct(F.lit(i).alias("index"), F.lit(h).alias("header"), v.alias("value")) for i, (h, v) in enumerate(cols)]))
    at = F.row_number().over(W.partitionBy(F.col("o_custkey") % 50).orderBy("o_orderkey")) - 1
    price = F.concat(F.floor(F.col("o_totalprice") / 1000).cast("int").cast("string"), F.lit(".0"))
    results = o.select(F.concat((F.col("o_custkey") % 50).cast("string"), F.lit("_llm.csv")).alias("result_file"), F.concat(F.lit("t"), (F.col("o_custkey") % 5).cast("string")).alias("template_id"), at.alias("row"), "o_orderstatus", price.alias("price"), "o_orderpriority")
    results = results.select("result_file", "template_id", "row", named(("STATUS", F.col("o_orderstatus")), ("total_PRICE", F.col("price")), ("Urgency", F.col("o_orderpriority"))))
    k = F.col("c_custkey")
    at = F.row_number().over(W.partitionBy(F.col("c_nationkey") % 4).orderBy("c_custkey")) - 1
    truths = c.select(F.concat(F.lit("t"), (F.col("c_nationkey") % 4).cast("string")).alias("template_id"), at.alias("row"), F.when(k % 3 == 0, "O").when(k % 3 == 1, " f").otherwise("P").alias("status"), (100 + k % 50).cast("string").alias("price"))
    truths = truths.select("template_id", "row", named(("Price", F.col("price")), ("State", F.col("status")), ("secret", F.col("status"))))
    kinds = [(i, *x) for i, x in enumerate((("status", "State", "text", False), ("price", "Total price", "temperature", False), ("urgency", "Urgency", "text", False), ("note", "Note", "text", False), ("secret", "Secret", "text", True)))]
    columns = spark.createDataFrame([(f"t{t}", *x) for t in range(5) for x in kinds], "template_id string, index int, key string, name string, value_type string, filter_out boolean")
    return s.scored_pairs(results, truths, columns)


@query(f"WITH {PAIRS_SQL} SELECT result_file, template_id, \"row\" + 1 AS row_number, column_key, column_name, value_type, ocr_value, ground_truth_value, exact_match, normalized_match FROM cell")
def s16_by_cell(spark, d):
    return scored_pairs(spark, d).by_cell


@query(f"WITH {PAIRS_SQL}, m AS (SELECT * FROM cell) SELECT result_file, template_id, column_key, column_name, value_type, {METRICS_SQL} FROM m GROUP BY ALL")
def s16_by_column(spark, d):
    return scored_pairs(spark, d).by_column


@query(f"""WITH {PAIRS_SQL}, r AS (SELECT result_file, "row", bool_and(exact_match) AS e, bool_and(normalized_match) AS n, count(*) AS c, count_if(exact_match) AS x, count_if(normalized_match) AS y FROM cell GROUP BY 1, 2),
t AS (SELECT result_file, CAST(sum(c) AS BIGINT) AS scored_cells, CAST(sum(x) AS BIGINT) AS exact_correct, CAST(sum(y) AS BIGINT) AS normalized_correct, count_if(e) AS fully_exact_rows, count_if(n) AS fully_normalized_rows FROM r GROUP BY 1)
SELECT n.*, least(ocr_rows, truth_rows) AS rows_compared, ocr_rows - truth_rows AS row_count_difference, 2 AS columns_compared, 'Note' AS missing_result_columns, 'Urgency; Note' AS missing_truth_columns, scored_cells, exact_correct, normalized_correct, fully_exact_rows, fully_normalized_rows,
CAST(exact_correct AS DOUBLE) / scored_cells AS exact_accuracy, CAST(normalized_correct AS DOUBLE) / scored_cells AS normalized_accuracy FROM n JOIN t USING (result_file)""")
def s16_summary(spark, d):
    return scored_pairs(spark, d).summary


@query("""WITH c AS (SELECT n_nationkey AS i, n_name, CASE n_nationkey % 3 WHEN 0 THEN replace(lower(n_name), ' ', '_') ELSE 'k' || n_nationkey END AS key FROM nation) SELECT key, i AS index FROM c WHERE i % 3 < 2""")
def s14_header_mapping(spark, d):
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    key = F.when(k % 3 == 0, F.replace(F.lower("n_name"), F.lit(" "), F.lit("_"))).otherwise(F.concat(F.lit("k"), k.cast("string")))
    name = F.when(k % 3 == 1, F.concat(F.lit("  "), F.initcap("n_name"))).otherwise(F.concat(F.lit("other "), k.cast("string")))
    return s.header_mapping(n.select(k.alias("index"), F.col("n_name").alias("header")), n.select(key.alias("key"), name.alias("name")))


@query("""WITH h AS (SELECT n_nationkey AS i, CASE n_nationkey % 6 WHEN 0 THEN ' ' WHEN 1 THEN r_name ELSE n_name END AS header FROM nation JOIN region ON n_regionkey = r_regionkey), p AS (SELECT *, lower(trim(header)) AS plain FROM h),
c AS (SELECT 'c' || n_nationkey AS key, lower(n_name) AS plain FROM nation WHERE n_nationkey % 6 <> 5)
SELECT 2 AS step, 'blank header' AS error, CAST(i AS VARCHAR) AS detail FROM p WHERE plain = '' UNION ALL SELECT 3, 'duplicate header', plain FROM p WHERE plain <> '' GROUP BY plain HAVING count(*) > 1
UNION ALL SELECT 4, 'unknown column', header FROM p WHERE plain <> '' AND plain NOT IN (SELECT plain FROM c) UNION ALL SELECT 6, 'missing column', key FROM c WHERE plain NOT IN (SELECT plain FROM p) UNION ALL SELECT 7, 'row count', '31 for 32'""")
def s1_truth_errors(spark, d):
    k = F.col("n_nationkey")
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    headers = n.select(k.alias("index"), F.when(k % 6 == 0, " ").when(k % 6 == 1, F.col("r_name")).otherwise(F.col("n_name")).alias("header"))
    return s.truth_errors(headers, n.where(k % 6 != 5).select(F.concat(F.lit("c"), k.cast("string")).alias("key"), F.col("n_name").alias("name")), 31, 32)


@query(f"""WITH {CELLS_SQL}, o AS (SELECT * FROM m QUALIFY count(*) OVER (PARTITION BY page, "row", key) = 1), a AS (SELECT * FROM o WHERE key <> 'flag'), b AS (SELECT * FROM o WHERE key <> 'day'), p AS (SELECT a.exact_match, a.normalized_match FROM a JOIN b USING (page, "row", key)),
x AS (SELECT count(DISTINCT page * 10 + "row") AS n FROM a), y AS (SELECT count(DISTINCT page * 10 + "row") AS n FROM b)
SELECT x.n AS ocr_rows, y.n AS truth_rows, 'flag' AS missing_result_columns, 'day' AS missing_truth_columns, 2 AS columns_compared, least(x.n, y.n) AS rows_compared, x.n - y.n AS row_count_difference, z.* FROM x, y, (SELECT {METRICS_SQL} FROM p) z""")
def s15_pair_summary(spark, d):
    cell = raw_cells(spark, d).withColumn("row", F.col("page") * 10 + F.col("row"))
    cell = cell.withColumn("n", F.count("*").over(W.partitionBy("row", "key"))).where("n = 1")
    result = cell.where("key <> 'flag'").select("row", "key", "value_type", "text")
    return s.pair_summary(result, cell.where("key <> 'day'").select("row", "key", "truth"))


@query("""SELECT count_if(toxic = 1 AND quality = 0) AS true_flags, count_if(toxic = 1) AS flagged, count_if(quality = 0) AS wrong, CAST(count_if(toxic = 1 AND quality = 0) AS DOUBLE) / nullif(count_if(toxic = 1), 0) AS precision,
CAST(count_if(toxic = 1 AND quality = 0) AS DOUBLE) / nullif(count_if(quality = 0), 0) AS recall, CASE WHEN count_if(toxic = 1 AND quality = 0) > 0 THEN 2.0 * count_if(toxic = 1 AND quality = 0) / (count_if(toxic = 1) + count_if(quality = 0)) END AS f1,
count_if(toxic = 1 AND quality <> 0) AS false_alarms, count_if(quality = 0 AND toxic <> 1) AS missed_errors FROM labels""")
def s18_review_prf(spark, d):
    return table(spark, d, "labels").agg(*s.review_metrics(F.col("toxic") == 1, F.col("quality") == 0))


@query("""SELECT lang, count_if(toxic = 1) AS flagged, count_if(quality = 0) AS wrong, count_if(toxic = 1 AND quality <> 0) AS false_alarms FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def s19_review_by_column(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    return rows.groupBy("lang").agg(*s.review_metrics(F.col("toxic") == 1, F.col("quality") == 0)).select("lang", "flagged", "wrong", "false_alarms")


@query("SELECT source, count_if(toxic = 1 OR quality = 0) AS to_review FROM documents JOIN labels USING (doc_id) GROUP BY source")
def s20_review_count(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(F.count_if((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("to_review"))


@query("SELECT p_partkey, CAST(levenshtein(p_name, p_name || ' ' || p_type) AS DOUBLE) / length(p_name || ' ' || p_type) AS cer FROM part")
def s22_character_error_rate(spark, d):
    return table(spark, d, "part").select("p_partkey", s.character_error_rate(F.col("p_name"), F.concat_ws(" ", "p_name", "p_type")).alias("cer"))


@query(f"""WITH {CELLS_SQL}, u AS (SELECT * FROM m QUALIFY count(*) OVER (PARTITION BY page, "row", key) = 1), p AS (SELECT key, normalized_match AS a, normalized_match OR page % 3 = 0 AS b FROM u WHERE NOT (key = 'flag' AND page % 3 = 0)
UNION ALL SELECT key, normalized_match, upper(truth) = 'X' FROM u WHERE key = 'flag' AND page % 3 = 0)
SELECT key, count(*) AS cells, count_if(a AND b) AS both_right, count_if(NOT a AND b) AS won, count_if(a AND NOT b) AS lost, count_if(NOT a AND NOT b) AS both_wrong, CAST(count_if(NOT a AND b) - count_if(a AND NOT b) AS DOUBLE) / count(*) AS change,
pow(greatest(abs(count_if(NOT a AND b) - count_if(a AND NOT b)) - 1, 0), 2) / nullif(count_if(a <> b), 0) AS statistic FROM p GROUP BY key""")
def s22_run_comparison(spark, d):
    """A second run that reads every third page without a mistake, but for one column that it reads as X there."""
    before = raw_cells(spark, d).withColumn("n", F.count("*").over(W.partitionBy("page", "row", "key"))).where("n = 1").drop("n")
    again = F.when(F.col("page") % 3 > 0, F.col("text")).when(F.col("key") == "flag", "X").otherwise(F.col("truth"))
    return s.run_comparison(s.paired(before, before.withColumn("text", again), ["page", "row", "key"]), "key")


@query("""WITH c AS (SELECT p_brand, p_partkey, CAST(levenshtein(p_name, p_type) AS DOUBLE) / length(p_type) AS cer FROM part)
SELECT p_brand, p_partkey, cer, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY cer DESC, p_partkey) AS INT) AS rank FROM c WHERE cer > 0 QUALIFY rank <= 5""")
def s22_hardest_cells(spark, d):
    cells = table(spark, d, "part").select("p_brand", "p_partkey", F.col("p_name").alias("text"), F.col("p_type").alias("truth"))
    return s.hardest_cells(cells, "p_brand", ["p_partkey"], 5).select("p_brand", "p_partkey", "cer", "rank")


@query(f"""WITH c AS (SELECT source, count(*) AS n, {crc32_sql("source")} % 100 AS place FROM (SELECT coalesce(source, '') AS source FROM documents) GROUP BY source)
SELECT CASE WHEN place < 70 THEN 'train' WHEN place < 85 THEN 'validation' ELSE 'test' END AS split, count(*) AS sources, CAST(sum(n) AS BIGINT) AS rows FROM c GROUP BY 1""")
def s22_split_sizes(spark, d):
    return s.split_sizes(table(spark, d, "documents"), "source")
