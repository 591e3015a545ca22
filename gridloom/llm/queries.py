"""Corpus queries of the catalogue: thin callers of the operators, with their digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .classifier import fold, quality
from .common import LOWER, UPPER
from .decontamination import contamination, items_digest
from .languages import languages
from .licenses import license_scan
from .merkle import leaf_of, manifest
from .mixing import mixture
from .ppm import scores
from .repeats import without_repeats
from .rules import quality_rules
from .sharding import shard_rows
from .simhash import near_duplicates
from .table_sql import manifest_sql, vectors_sql
from .vectors import compressed
from .warc import through_warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(table(spark, folder, "documents")).select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(table(spark, folder, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items_digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_jump_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard_rows(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    read = through_warc(table(spark, folder, "pages"))
    return read.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan(table(spark, folder, "documents")).select("row.doc_id", "license", "coverage", F.array_join("licenses.license", ",").alias("licenses"))


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), shingle=4, radius=4).withColumnRenamed("id", "doc_id")


def op8_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return without_repeats(table(spark, folder, "documents")).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_ppm(spark: SparkSession, folder: str) -> DataFrame:
    return scores(table(spark, folder, "documents"), held=fold(F.col("id"), 7) == 2).withColumnRenamed("id", "doc_id")


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    scored = quality(table(spark, folder, "documents"), table(spark, folder, "labels"), usable=fold(F.col("id"), 3) != 1)
    return scored.select("row.doc_id", F.coalesce(fold(F.col("row.doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_language_id(spark: SparkSession, folder: str) -> DataFrame:
    found = languages(table(spark, folder, "documents"), usable=F.coalesce(fold(F.col("doc_id"), 4) != 2, F.lit(False)))
    return found.select("row.doc_id", F.coalesce(fold(F.col("row.doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    tampered = F.when(fold(F.col("doc_id"), 5) == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    check = leaf_of([*map(F.col, ("doc_id", "source", "lang", "n_chars")), tampered])
    whole = manifest(table(spark, folder, "documents"), check=check)
    return whole.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    codes, _ = compressed(table(spark, folder, "embeddings"))
    return codes.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


WORDS_SQL = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT r, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 8),
h AS (SELECT r, i, ' ' || word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o || ' ' || lead(word, 5) OVER o || ' ' || lead(word, 6) OVER o || ' ' || lead(word, 7) OVER o AS s FROM v WINDOW o AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM h WHERE s IS NOT NULL),
c AS (SELECT r, count(DISTINCT x) AS n_repeat_words FROM (SELECT r, unnest(generate_series(i, i + 7)) AS x FROM g WHERE n > 1) GROUP BY r),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT doc_id, t, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN c USING (r) LEFT JOIN l USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars > 15 * n_words OR word_chars < 2 * n_words OR 10 * n_symbols > 3 * n_words OR 2 * n_dup_lines > n_lines
    OR length(regexp_replace(t, '[^A-Z]', '', 'g')) > length(regexp_replace(t, '[^a-z]', '', 'g'))) AS kept
FROM b
"""

OP2_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len({WORDS_SQL}), 0) AS size, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS draw FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM p),
w AS (SELECT *, place % 3 + 1 AS weight FROM r),
f AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
  3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
  coalesce(sum(weight) OVER (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM w),
l AS (SELECT *, CAST(total - filled AS DOUBLE) / CAST(all_weight - gone AS DOUBLE) AS level FROM f),
g AS (SELECT arg_min(level, gone) AS fill FROM l WHERE level * weight <= source_size * 3),
t AS (SELECT source, place, source_size, least(fill * weight, CAST(source_size * 3 AS DOUBLE)) AS target FROM w, g),
n AS (SELECT CAST(ceil(sum(target) / 16) AS BIGINT) AS blocks, sum(target) AS whole FROM t),
seats AS (SELECT place, target, unnest(generate_series(0, CAST(ceil(target * n.blocks / greatest(n.whole, 1e-9)) AS BIGINT) + 3)) AS k FROM t, n),
ranked AS (SELECT place, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, place, k) AS seat FROM seats),
won AS (SELECT place, count(*) AS blocks FROM ranked WHERE seat <= (SELECT blocks FROM n) GROUP BY place),
held AS (SELECT source, CAST('0x' || draw[1:2] AS INT) * 8 // 256 AS shard, CAST(sum(size) AS BIGINT) AS held FROM d GROUP BY ALL),
cells AS (SELECT held.*, t.place, t.source_size, t.target, coalesce(won.blocks, 0) AS blocks FROM held JOIN t ON held.source IS NOT DISTINCT FROM t.source LEFT JOIN won ON won.place = t.place),
asked AS (SELECT place, shard, blocks, CAST(held AS DOUBLE) AS held, unnest(generate_series(0, CAST(ceil(held * blocks / greatest(source_size, 1)) AS BIGINT) + 3)) AS k FROM cells),
placed AS (SELECT place, shard, blocks, row_number() OVER (PARTITION BY place ORDER BY held / (2 * k + 1) DESC, shard, k) AS seat FROM asked),
dealt AS (SELECT place, shard, count(*) AS quota FROM placed WHERE seat <= blocks GROUP BY ALL),
q AS (SELECT cells.*, least(coalesce(quota, 0) * 16, held * 3) AS wanted FROM cells LEFT JOIN dealt USING (place, shard)),
line AS (SELECT *, CAST('0x' || draw[1:2] AS INT) * 8 // 256 AS shard, coalesce(sum(size) OVER (PARTITION BY source, CAST('0x' || draw[1:2] AS INT) * 8 // 256 ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d)
SELECT doc_id, size, source_size, target,
  CAST(coalesce(wanted // held, 0) * size + greatest(0, least(size, wanted - coalesce(wanted // held, 0) * held - start)) AS BIGINT) AS taken
FROM line JOIN q ON line.source IS NOT DISTINCT FROM q.source AND line.shard = q.shard
"""

FOLDED = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3_SQL = rf"""
WITH q AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {FOLDED} AS w FROM benchmark),
i AS (SELECT item, w, least(len(w), 10) AS k, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS p FROM q WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM i),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({FOLDED}, []) AS w FROM documents),
spots AS (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k),
found AS (SELECT r, p, spots.k, item FROM spots JOIN windows ON spots.k = windows.k AND array_to_string(w[p:p + spots.k - 1], ' ') = s),
hits AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(generate_series(p, p + k - 1)) AS x FROM found) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""

OP5_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS head FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN head IS NULL OR page_id IS NOT DISTINCT FROM head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM head THEN head END AS refers_to
FROM p LEFT JOIN f USING (d)
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_quality_rules, op2_mixing, op3_decontamination, op4_jump_sharding, op5_warc, op6_license_scan, op7_simhash, op8_repeated_passages, op9_ppm, op10_quality_classifier, op11_language_id, op12_merkle_manifest, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1_SQL, "op2_mixing": OP2_SQL, "op3_decontamination": OP3_SQL, "op5_warc": OP5_SQL, "op12_merkle_manifest": manifest_sql(), "op13_vector_codes": vectors_sql()}
