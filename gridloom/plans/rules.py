"""Queries of column rules and recognition."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import rules as r

from .registry import query, table


@query(r"""WITH c AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 7 = 0 THEN p_size || '/' ELSE ' ' || CAST(p_size AS VARCHAR) || '.5' END AS raw FROM part), n AS (SELECT p_partkey, regexp_replace(raw, '[ \t\r\n]+', '', 'g') AS t FROM c)
SELECT p_partkey, CASE WHEN NOT regexp_full_match(t, '\d{1,3}(\.\d{1,2})?') THEN 'expected temperature pattern' WHEN CAST(t AS DOUBLE) < 10 THEN 'value below minimum 10' WHEN CAST(t AS DOUBLE) > 40.25 THEN 'value above maximum 40.25' END AS error FROM n""")
def r8_validate(spark, d):
    raw = F.when(F.col("p_partkey") % 5 == 0, "").when(F.col("p_partkey") % 7 == 0, F.concat(F.col("p_size").cast("string"), F.lit("/"))).otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(".5")))
    return table(spark, d, "part").select("p_partkey", r.validation_error(raw, F.lit("temperature"), F.lit(r.TEMPERATURE), F.lit(10.0), F.lit(40.25)).alias("error"))


@query(r"""SELECT c_custkey, regexp_replace(c_mktsegment || ' ' || c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN '[ \t]+' ELSE '\A\s+|\s+\z' END, '', 'g') AS text FROM customer""")
def r7_normalized_text(spark, d):
    text = F.concat(F.lit(" "), "c_mktsegment", F.lit(" "), F.col("c_nationkey").cast("string"), F.lit(" "))
    return table(spark, d, "customer").select("c_custkey", r.normalized_text(text, F.when(F.col("c_custkey") % 2 == 0, "temperature").otherwise("text")).alias("text"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '\\d{1,3}(\\.\\d{1,2})?' END AS pattern, CASE WHEN p_size % 2 = 0 THEN p_size END AS range_min FROM part""".replace("\\\\", "\\"))
def r6_column_rules(spark, d):
    columns = table(spark, d, "part").select(F.col("p_partkey").alias("index"), F.col("p_brand").alias("key"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, "temperature").otherwise("text").alias("value_type"), F.col("p_size").alias("range_min"), (F.col("p_size") + 1).alias("range_max"))
    return r.column_rules(columns).select(F.col("index").alias("p_partkey"), "pattern", "range_min")


@query("""WITH a AS (SELECT l_orderkey, l_linenumber * 10000000 + l_partkey * 100 + l_suppkey % 100 AS attempt, l_shipdate, CAST(l_quantity AS VARCHAR) AS text, CASE WHEN l_linenumber % 3 > 0 THEN l_discount END AS confidence, CASE WHEN l_quantity < 40 THEN 'low' END AS error FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY error IS NULL DESC, CASE WHEN error IS NULL THEN attempt END, CASE WHEN error IS NOT NULL THEN confidence END DESC NULLS LAST, attempt) AS i FROM a)
SELECT l_orderkey, attempt, CASE WHEN error IS NULL THEN text ELSE '' END AS text, CASE WHEN error IS NOT NULL THEN text END AS raw_text FROM k WHERE i = 1""")
def r9_best_attempt(spark, d):
    a = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 10000000 + F.col("l_partkey") * 100 + F.col("l_suppkey") % 100).alias("attempt"), F.col("l_quantity").cast("string").alias("text"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_discount")).alias("confidence"), F.when(F.col("l_quantity") < 40, "low").alias("error"))
    return r.best_attempt(a, ["l_orderkey"]).select("l_orderkey", "attempt", "text", "raw_text")


@query("SELECT p_partkey, CASE p_size WHEN 13 THEN '13,7,8' WHEN 7 THEN '7,13,8' WHEN 8 THEN '8,13,7' ELSE p_size || ',13,7,8' END AS modes FROM part")
def r11_retry_modes(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat_ws(",", r.retry_modes(F.col("p_size"), F.array(*map(F.lit, (13, 7, 8, 13)))).cast("array<string>")).alias("modes"))


@query("SELECT event_type, count_if(value > 50) AS invalid, count(*) AS always, 0 AS off FROM events GROUP BY 1")
def r12_needs_verifier(spark, d):
    error = F.when(F.col("value") > 50, "bad")
    return table(spark, d, "events").groupBy("event_type").agg(*[F.count_if(r.needs_verifier(m, error)).alias(m) for m in ("invalid", "always", "off")])


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'ocr' WHEN value > 50 THEN '' ELSE event_type END AS text, CASE WHEN event_type = 'error' THEN 'first' WHEN value > 50 THEN 'range' END AS error FROM events""")
def r13_verified(spark, d):
    failed = F.col("event_type") == "error"
    text, error = r.verified(F.lit("ocr"), F.lit("first"), F.when(failed, "").otherwise(F.col("event_type")), F.when(failed, "llm failed"), F.when(~failed & (F.col("value") > 50), "range"))
    return table(spark, d, "events").select("event_id", text.alias("text"), error.alias("error"))


@query("""SELECT p_partkey, 'Transcribe the handwriting in this table cell.' || chr(10) || 'Column: ' || p_name || chr(10) || 'Type: ' || p_type || CASE WHEN p_size > 20 THEN chr(10) || 'Range: ' || p_size || ' to 100.5' ELSE '' END || CASE WHEN p_size > 30 THEN chr(10) || 'A first reading was: ' || p_brand ELSE '' END
|| chr(10) || 'Answer with JSON: {"text": ..., "status": "ok" | "blank" | "illegible" | "uncertain"}.' AS prompt FROM part""")
def r14_prompt(spark, d):
    low = F.when(F.col("p_size") > 20, F.col("p_size").cast("double"))
    return table(spark, d, "part").select("p_partkey", r.prompt(F.col("p_type"), F.col("p_name"), low, F.lit(100.5), F.when(F.col("p_size") > 30, F.col("p_brand")).otherwise("")).alias("prompt"))


@query("""SELECT event_type, CASE event_type WHEN 'error' THEN 'permanent' WHEN 'click' THEN 'transient' WHEN 'view' THEN 'permanent' ELSE 'other' END AS class, count(*) AS n FROM events GROUP BY 1, 2""")
def r19_error_class(spark, d):
    message = F.when(F.col("event_type") == "error", "HTTP Error 401").when(F.col("event_type") == "click", "Read Timeout").when(F.col("event_type") == "view", "request failed: FORBIDDEN").when(F.col("event_type") == "signup", "no idea")
    return table(spark, d, "events").groupBy("event_type", r.error_class(message).alias("class")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'table_not_found' WHEN 'click' THEN 'llm_authorization' WHEN 'view' THEN 'ground_truth_invalid' ELSE 'processing_failed' END AS code FROM events""")
def r20_safe_error(spark, d):
    message = F.when(F.col("event_type") == "error", "Could not find the table.").when(F.col("event_type") == "click", "status 403").otherwise("x")
    return table(spark, d, "events").select("event_id", r.safe_error(message, F.col("event_type") == "view").alias("code"))


@query("""WITH k AS (SELECT doc_id, sha256(strlen(lang) || ':' || lang || '|' || strlen(coalesce(text, '')) || ':' || coalesce(text, '')) AS cache_key FROM documents), c AS (SELECT cache_key FROM k WHERE doc_id % 4 = 0)
SELECT min(doc_id) AS request_id, cache_key FROM k WHERE cache_key NOT IN (SELECT cache_key FROM c) GROUP BY cache_key""")
def r21_uncached(spark, d):
    k = table(spark, d, "documents").select(F.col("doc_id").alias("request_id"), r.cache_key(F.col("lang"), F.col("text")).alias("cache_key"))
    return r.uncached(k, k.where("request_id % 4 = 0")).select("request_id", "cache_key")


@query("SELECT avg(l_discount) FILTER (WHERE l_discount >= 0.02) AS confidence, l_returnflag FROM lineitem GROUP BY l_returnflag")
def r3_mean_confidence(spark, d):
    c = table(spark, d, "lineitem")
    return c.groupBy("l_returnflag").agg(F.avg(F.when(F.col("l_discount") >= 0.02, F.col("l_discount"))).alias("confidence"))
