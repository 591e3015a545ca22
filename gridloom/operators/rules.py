"""Column rules: templates as rows, validation, retries and verification of recognized text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.text import NUMBER, SPACE, normalized_header, strip, without_fence

TEMPERATURE = r"\d{1,3}(\.\d{1,2})?"
#: Parts of messages, fixed values.
PERMANENT = ("not configured", "authorization", "unauthorized", "forbidden", "http error 401", "http error 403")
TRANSIENT = ("request failed", "timed out", "timeout", "temporary", "connection", "rate limit", "http error 429", "http error 500", "http error 502", "http error 503", "http error 504")

#: Parts of the messages of failures that a later attempt, or other settings, may mend, fixed values.
PASSING = ("request failed", "timed out", "timeout", "temporary", "connection", "rate limit", "not configured", "authorization", "forbidden")


def column_rules(columns: DataFrame) -> DataFrame:
    """(index, key, name, value_type, pattern, range_min, range_max, whitelist) from template columns; only temperatures are validated."""
    warm = F.col("value_type") == "temperature"
    return columns.select("index", "key", "name", "value_type", F.when(warm, TEMPERATURE).alias("pattern"), *[F.when(warm, F.col(c)).alias(c) for c in ("range_min", "range_max")], F.when(warm, "0123456789.").alias("whitelist"))


def normalized_text(text: Column, value_type: Column) -> Column:
    """Temperatures lose all white space, other text that at its ends."""
    return F.when(value_type == "temperature", F.regexp_replace(text, f"{SPACE}+", "")).otherwise(strip(text))


def plain_number(c: Column) -> Column:
    """A number without trailing zeros."""
    return F.regexp_replace(F.call_function("format_number", c, F.lit("0.######")), ",", "")


def validation_error(text: Column, value_type: Column, pattern: Column, low: Column, high: Column) -> Column:
    """Null for valid text, else why it isn't: pattern, then number, then range; a blank has no range."""
    t = normalized_text(text, value_type)
    value = F.when(t.rlike(NUMBER), t.try_cast("double"))
    ranged = (t != "") & (low.isNotNull() | high.isNotNull())
    misfit = pattern.isNotNull() & ~F.regexp_like(t, F.concat(F.lit(r"\A(?:"), pattern, F.lit(r")\z")))
    return (
        F.when(misfit, F.concat(F.lit("expected "), value_type, F.lit(" pattern")))
        .when(ranged & value.isNull(), F.concat(F.lit("expected numeric "), value_type))
        .when(ranged & (value < low), F.concat(F.lit("value below minimum "), plain_number(low)))
        .when(ranged & (value > high), F.concat(F.lit("value above maximum "), plain_number(high)))
    )


def with_rules(cells: DataFrame, rules: DataFrame) -> DataFrame:
    """cells with the rule of their column, where there is one."""
    return cells.join(rules.withColumnRenamed("index", "col"), "col", "left")


def best_attempt(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """One attempt for each key: the first valid one; without one, the most confident, blanked, its text kept as raw_text.

    attempts has attempt, text, confidence and error. Attempts without a confidence come last.
    """
    valid = F.col("error").isNull()
    order = W.partitionBy(*keys).orderBy(valid.desc(), F.when(valid, F.col("attempt")), F.when(~valid, F.col("confidence")).desc_nulls_last(), "attempt")
    best = attempts.withColumn("_at", F.row_number().over(order)).where("_at = 1").drop("_at")
    return best.withColumn("raw_text", F.when(F.col("error").isNotNull(), F.col("text"))).withColumn("text", F.when(F.col("error").isNull(), F.col("text")).otherwise(""))


def retry_modes(base: Column, retries: Column) -> Column:
    """The base mode and the retries, each once, in order."""
    return F.array_distinct(F.concat(F.array(base), retries))


def needs_verifier(mode: str, error: Column) -> Column:
    """Whether a cell goes to the verifier, under mode off, always or invalid."""
    if mode not in ("off", "always", "invalid"):
        raise ValueError(f"unknown verifier mode {mode!r}; choose off, always or invalid")
    return {"off": F.lit(False), "always": F.lit(True), "invalid": error.isNotNull()}[mode]


def verified(text: Column, error: Column, seen: Column, seen_error: Column, seen_invalid: Column) -> tuple[Column, Column]:
    """(text, error) after a verifier's answer: its failure keeps the text, its invalid text blanks the cell, else it replaces the text."""
    failed = seen_error.isNotNull() & (strip(F.coalesce(seen, F.lit(""))) == "")
    invalid = seen_invalid.isNotNull() & (strip(F.coalesce(seen, F.lit(""))) != "")
    return F.when(failed, text).when(invalid, F.lit("")).otherwise(strip(seen)), F.when(failed, error).when(invalid, seen_invalid)


def prompt(value_type: Column, name: Column, low: Column, high: Column, guess: Column) -> Column:
    """Instructions for a recognizer; parts that the rule lacks are left out."""
    return F.concat_ws(
        "\n",
        F.lit("Transcribe the handwriting in this table cell."),
        F.concat(F.lit("Column: "), name),
        F.concat(F.lit("Type: "), value_type),
        F.concat(F.lit("Range: "), plain_number(low), F.lit(" to "), plain_number(high)),
        F.concat(F.lit("A first reading was: "), F.when(guess != "", guess)),
        F.lit('Answer with JSON: {"text": ..., "status": "ok" | "blank" | "illegible" | "uncertain"}.'),
    )


def chat_content(response: Column) -> Column:
    """The message of a chat response, in any of four shapes; null if it has none."""
    return F.coalesce(*[F.get_json_object(response, p) for p in ("$.message.content", "$.response", "$.choices[0].message.content", "$.choices[0].text")])


def parsed_answer(content: Column) -> tuple[Column, Column]:
    """(text, status) of an answer: JSON, or the widest {...} in it, or else the bare text without quotes."""
    plain = without_fence(content)
    inner = F.regexp_extract(plain, r"(?s)(\{.*\})", 1)
    data = F.coalesce(*[F.when(F.try_parse_json(x).isNotNull() & x.startswith("{"), x) for x in (plain, inner)])
    text = F.coalesce(strip(F.get_json_object(data, "$.text")), F.lit(""))
    status = F.coalesce(F.nullif(strip(F.lower(F.get_json_object(data, "$.status"))), F.lit("")), F.lit("ok"))
    bare = F.regexp_replace(strip(plain), r'\A"+|"+\z', "")
    return F.when(data.isNotNull(), text).otherwise(bare), F.when(data.isNotNull(), status).otherwise("ok")


def answer_error(text: Column, status: Column) -> Column:
    """Null for text, and for blank, illegible or uncertain without text; else the status."""
    return F.when((text == "") & ~status.isin("blank", "illegible", "uncertain"), F.concat(F.lit("llm returned status "), status))


def error_class(message: Column) -> Column:
    """permanent, transient or other; permanent marks win."""
    low = F.lower(F.coalesce(message, F.lit("")))
    has = lambda marks: F.exists(F.array(*map(F.lit, marks)), lambda m: low.contains(m))
    return F.when(has(PERMANENT), "permanent").when(has(TRANSIENT), "transient").otherwise("other")


def safe_error(message: Column, truth_invalid: Column) -> Column:
    """A code for an error that users may see."""
    low = F.lower(message)
    return (
        F.when(low.contains("could not find the table"), "table_not_found")
        .when(low.contains("llm ocr is not configured"), "llm_not_configured")
        .when(low.contains("403") | low.contains("forbidden"), "llm_authorization")
        .when(truth_invalid, "ground_truth_invalid")
        .otherwise("processing_failed")
    )


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts, each with its length, so that they can't run into one another."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("|", *[F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in texts]).cast("binary"), 256)


def is_passing(text: Column, error: Column) -> Column:
    """Whether a reading is a failure that may pass: no text, and an error with one of the marks."""
    low = F.lower(F.coalesce(error, F.lit("")))
    return (strip(F.coalesce(text, F.lit(""))) == "") & F.exists(F.array(*map(F.lit, PASSING)), lambda m: low.contains(m))


def uncached(requests: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Requests whose key the cache lacks, each key once (its smallest request_id)."""
    one = W.partitionBy(key).orderBy("request_id")
    return requests.join(cache.select(key).distinct(), key, "left_anti").withColumn("_at", F.row_number().over(one)).where("_at = 1").drop("_at")


def rule_names(columns: DataFrame, name: str) -> DataFrame:
    """Template columns that go by a name or key, white space, case and underscores aside."""
    wanted = normalized_header(F.lit(name))
    return columns.where((normalized_header(F.col("name")) == wanted) | (normalized_header(F.col("key")) == wanted))
