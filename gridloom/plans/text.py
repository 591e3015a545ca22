"""Queries of text functions, names, dates and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import text as t
from gridloom.operators import rules as r

from .registry import query, table

WS = r"[ \t\r\n\f\x0B]"
FOLD = "lower(replace(replace({0}, 'ß', 'ss'), 'ẞ', 'ss'))"
STRIP = rf"regexp_replace({{0}}, '\A{WS}+|{WS}+\z', '', 'g')"
SQUEEZE = rf"trim(regexp_replace({{0}}, '{WS}+', ' ', 'g'))"


@query(f"SELECT page_id, {SQUEEZE.format('replace(' + FOLD.format('url') + chr(44) + chr(39) + '_' + chr(39) + chr(44) + chr(39) + ' ' + chr(39) + ')')} AS header FROM pages")
def str1_normalized_header(spark, d):
    return table(spark, d, "pages").select("page_id", t.normalized_header(F.col("url")).alias("header"))


@query(f"SELECT p_partkey, {SQUEEZE.format(FOLD.format('p_type || chr(9) || p_name'))} AS name FROM part")
def str2_column_name(spark, d):
    return table(spark, d, "part").select("p_partkey", t.normalized_column_name(F.concat("p_type", F.lit("\t"), "p_name")).alias("name"))


@query(f"SELECT doc_id, md5({STRIP.format('replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))')}) AS exact FROM documents")
def str3_exact_value(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(t.exact_value(F.col("text"))).alias("exact"))


@query(rf"SELECT doc_id, md5(regexp_replace({FOLD.format('text')}, '[^\p{{L}}\p{{N}}]', '', 'g')) AS plain FROM documents")
def str4_unicode_alnum(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(t.unicode_alnum(F.col("text"))).alias("plain"))


@query(f"SELECT doc_id, length(regexp_replace({FOLD.format('text')}, '[^a-z0-9]', '', 'g')) AS n FROM documents")
def str5_ascii_alnum(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(t.ascii_alnum(F.col("text"))).cast("long").alias("n"))


@query("""SELECT p_partkey, CASE WHEN p_name LIKE '%ring%' THEN 'ring_form' WHEN p_name LIKE '%red%' THEN 'red_form' WHEN p_name LIKE '%small%' THEN 'small_form' END AS template_id FROM part""")
def str6_first_alias(spark, d):
    return table(spark, d, "part").select("p_partkey", t.first_alias(F.col("p_name"), [("ring", "ring_form"), ("red", "red_form"), ("small", "small_form")]).alias("template_id"))


@query("""SELECT p_partkey, CASE WHEN n LIKE '%\\_small\\_ring\\_llm' ESCAPE '\\' THEN 'small_ring' WHEN n LIKE '%\\_widget\\_llm' ESCAPE '\\' THEN 'widget' WHEN n LIKE '%\\_ring\\_llm' ESCAPE '\\' THEN 'ring' END AS template_id
FROM (SELECT p_partkey, 'x_' || replace(p_name, ' ', '_') || '_llm' AS n FROM part)""")
def str7_longest_suffix(spark, d):
    name = F.concat(F.lit("x_"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("_llm"))
    return table(spark, d, "part").select("p_partkey", t.longest_suffix(name, ["ring", "small_ring", "widget"], "_llm").alias("template_id"))


@query("SELECT p_type AS stem, count(*) AS n FROM part GROUP BY p_type")
def str8_without_suffix(spark, d):
    return table(spark, d, "part").groupBy(t.without_suffix(F.concat("p_type", F.lit("_redacted")), "_redacted").alias("stem")).agg(F.count("*").alias("n"))


@query(rf"""SELECT l_orderkey, l_linenumber, coalesce(nullif(regexp_replace(regexp_replace(l_returnflag || ' / ' || l_linestatus, '[^A-Za-z0-9_-]+', '_', 'g'), '\A_+|_+\z', '', 'g'), ''), 'col_000')
  || printf('_row_%03d_coords_x%04d_y%04d_w%04d_h%04d.png', l_linenumber, CAST(l_quantity AS INT), l_suppkey % 10000, 30, 12) AS file FROM lineitem""")
def str9_cell_file_name(spark, d):
    key = F.concat("l_returnflag", F.lit(" / "), "l_linestatus")
    name = t.cell_file_name(key, F.col("l_linenumber"), F.lit(0), F.col("l_quantity").cast("int"), (F.col("l_suppkey") % 10000).cast("int"), F.lit(30), F.lit(12))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", name.alias("file"))


@query(r"""WITH n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'cover.png' ELSE printf('%s_row_%03d_coords_x%04d_y%04d_w%04d_h%04d.png', lower(o_orderstatus), o_orderkey % 32, o_orderkey % 900, 7, 40, 12) END AS f FROM orders)
SELECT o_orderkey, regexp_extract(f, '\A(.+)_row_(\d+)_coords_x(\d+)_y(\d+)_w(\d+)_h(\d+)\.png\z', 1) AS column_key, CASE WHEN f = 'cover.png' THEN -1 ELSE o_orderkey % 32 END AS "row",
  CASE WHEN f <> 'cover.png' THEN o_orderkey % 900 END AS x, CASE WHEN f <> 'cover.png' THEN 7 END AS y, CASE WHEN f <> 'cover.png' THEN 40 END AS width, CASE WHEN f <> 'cover.png' THEN 12 END AS height FROM n""")
def str10_parse_cell_file(spark, d):
    o = table(spark, d, "orders")
    name = F.when(F.col("o_orderkey") % 5 == 0, "cover.png").otherwise(t.cell_file_name(F.lower("o_orderstatus"), (F.col("o_orderkey") % 32).cast("int"), F.lit(0), (F.col("o_orderkey") % 900).cast("int"), F.lit(7), F.lit(40), F.lit(12)))
    return o.select("o_orderkey", name.alias("f")).withColumns(t.parsed_cell_file(F.col("f"))).drop("f")


@query("SELECT p_partkey, CASE WHEN p_brand = p_type THEN p_brand ELSE p_brand || '|' || p_type END AS names FROM part")
def str11_name_list(spark, d):
    listed = F.concat_ws(",", F.lit(" "), "p_brand", F.concat(F.lit(" "), F.col("p_type")), "p_brand")
    return table(spark, d, "part").select("p_partkey", F.array_join(t.name_list(listed), "|").alias("names"))


@query("SELECT event_id, props AS inner_json FROM events")
def str12_without_fence(spark, d):
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    return table(spark, d, "events").select("event_id", t.without_fence(fenced).alias("inner_json"))


@query("SELECT p_type LIKE 'S%' AS divider, count(*) AS n FROM part GROUP BY 1")
def str13_divider(spark, d):
    key = F.concat(F.when(F.col("p_type").startswith("S"), F.lit("Divider ")).otherwise(""), F.col("p_type"))
    return table(spark, d, "part").groupBy(t.is_divider(key).alias("divider")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 1 THEN 'read as ' || c_mktsegment || '?' END AS note FROM customer")
def str14_raw_note(spark, d):
    raw = F.when(F.col("c_custkey") % 2 == 1, F.concat("c_mktsegment", F.lit("?"))).otherwise(F.concat("c_mktsegment", F.lit(" ")))
    return table(spark, d, "customer").select("c_custkey", t.raw_note(F.col("c_mktsegment"), raw).alias("note"))


@query("SELECT o_orderkey, lower(strftime(o_orderdate, '%d%b')) AS day FROM orders")
def str15_day_month(spark, d):
    return table(spark, d, "orders").select("o_orderkey", t.day_month(F.date_format("o_orderdate", "d - MMMM")).alias("day"))


@query("SELECT event_id, CASE WHEN s < 60 THEN s || 's' ELSE (s // 60) || 'm ' || printf('%02d', s % 60) || 's' END AS took FROM (SELECT event_id, CAST(floor(value * 10) AS BIGINT) AS s FROM events)")
def dt1_elapsed(spark, d):
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    end = F.timestamp_seconds(F.unix_timestamp(start) + F.floor(F.col("value") * 10))
    return table(spark, d, "events").select("event_id", t.elapsed(start, end).alias("took"))


@query("SELECT event_id, ts >= TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 90 SECOND AND ts <= TIMESTAMP '2024-01-10 00:00:05' AS fresh FROM events")
def dt2_heartbeat_fresh(spark, d):
    return table(spark, d, "events").select("event_id", t.is_fresh(F.col("ts").cast("timestamp"), F.to_timestamp(F.lit("2024-01-10 00:00:00")), 90).alias("fresh"))


@query("SELECT l_orderkey, l_linenumber, least(100.0, l_quantity * 100.0 / 40) AS percent FROM lineitem")
def math1_progress(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", t.progress(F.col("l_quantity"), F.lit(40)).alias("percent"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS content FROM events")
def r15_chat_content(spark, d):
    text = F.get_json_object("props", "$.k")
    shapes = [F.to_json(F.struct(F.struct(text.alias("content")).alias("message"))), F.to_json(F.struct(text.alias("response"))), F.to_json(F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("message"))).alias("choices"))), F.to_json(F.struct(F.array(F.struct(text.alias("text"))).alias("choices")))]
    answer = F.element_at(F.array(*shapes), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", r.chat_content(answer).alias("content"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN event_type ELSE json_extract_string(props, '$.k') END AS answer, CASE WHEN event_id % 4 = 2 THEN 'uncertain' ELSE 'ok' END AS status FROM events""")
def r16_parsed_answer(spark, d):
    body = F.concat(F.lit('{"text": " '), F.get_json_object("props", "$.k"), F.lit('"'), F.when(F.col("event_id") % 4 == 2, ', "status": "Uncertain"').otherwise(""), F.lit("}"))
    answer = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("event_id") % 4 == 3, F.concat(F.lit(' "'), "event_type", F.lit('" '))).otherwise(F.concat(F.lit("Here: "), body, F.lit(" done")))
    text, status = r.parsed_answer(answer)
    return table(spark, d, "events").select("event_id", text.alias("answer"), status.alias("status"))


@query("""SELECT event_id, CASE WHEN event_type IN ('view', 'signup') OR event_type = 'error' AND value <= 20 THEN NULL ELSE 'llm returned status ok' END AS error FROM events""")
def r17_answer_error(spark, d):
    text = F.when(F.col("event_type") == "view", "x").otherwise("")
    status = F.when(F.col("event_type") == "signup", "blank").when((F.col("event_type") == "error") & (F.col("value") <= 20), "illegible").otherwise("ok")
    return table(spark, d, "events").select("event_id", r.answer_error(text, status).alias("error"))
