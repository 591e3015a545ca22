"""Cells cut from pages and read by a recognizer, with retries and a cache of what was read before."""

from __future__ import annotations

import base64
import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from gridloom.functions.deploy import stored
from gridloom.operators import image
from gridloom.operators.rules import PERMANENT, TRANSIENT, answer_error, cache_key, chat_content, is_passing, needs_verifier, normalized_text, parsed_answer, prompt, uncached, validation_error, verified


@dataclass(frozen=True)
class Reading:
    """What a recognizer read in a cell."""

    text: str
    confidence: float | None = None
    raw_text: str | None = None
    validation_error: str | None = None


class Engine(Protocol):
    """A recognizer of single cell images."""

    def recognize(self, cell: np.ndarray) -> Reading: ...


_FACTORIES: dict[str, Callable[[], Engine]] = {}
#: Other names that recognizers go by, fixed values.
ALIASES = {"llm": "llm-vision", "trocr": "trocr-handwritten"}


def register(factory: Callable[[], Engine], *names: str) -> None:
    """Makes a recognizer known by its names; the factory runs once in each task that uses it."""
    for name in names:
        _FACTORIES[name.lower()] = factory


def engine(name: str) -> Callable[[], Engine]:
    """The factory of a recognizer; an unknown name is an error that lists the choices."""
    name = name.lower() if name.lower() in _FACTORIES else ALIASES.get(name.lower(), name)
    if name.lower() not in _FACTORIES:
        raise ValueError(f"unknown recognizer {name!r}; choose one of {', '.join(sorted(_FACTORIES)) or 'none'}")
    return _FACTORIES[name.lower()]


class Darkness:
    """A recognizer for tests: the mean darkness as a number; it needs no model and always gives the same."""

    def recognize(self, cell: np.ndarray) -> Reading:
        dark = 255 - float(cell.mean())
        return Reading(f"{dark:.0f}", round(dark / 255 * 100, 3))


register(Darkness, "darkness", "fake")


class Retrying:
    """A recognizer that tries another one again after passing errors, waiting twice as long each time; lasting errors end it at once."""

    def __init__(self, inner: Engine, attempts: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> None:
        self.inner, self.attempts, self.wait, self.sleep = inner, max(1, attempts), wait, sleep

    def recognize(self, cell: np.ndarray) -> Reading:
        for attempt in range(1, self.attempts + 1):
            try:
                return self.inner.recognize(cell)
            except Exception as error:
                message = str(error).lower()
                lasting = any(m in message for m in PERMANENT) or not any(m in message for m in TRANSIENT)
                if lasting or attempt == self.attempts:
                    raise
                self.sleep(self.wait * 2 ** (attempt - 1))
        raise AssertionError("not reached")


def crops(pages: DataFrame, cells: DataFrame, padding: int = 0) -> DataFrame:
    """(page, row, col, height, width, data) of each cell (page, row, col, x, y, width, height), clipped to its page; empty ones are left out.

    A page meets the list of its own cells, which its size bounds, so that its
    bytes are sent once.
    """
    own = cells.groupBy("page").agg(F.collect_list(F.struct("row", "col", "x", "y", "width", "height")).alias("cells"))
    both = pages.select("page", F.col("height").cast("int"), F.col("width").cast("int"), "data").join(own.hint("shuffle_hash"), "page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, h, w, data, listed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                whole, rows = np.frombuffer(data, np.uint8).reshape(h, w), []
                for c in sorted(listed, key=lambda c: (c["row"], c["col"])):
                    top, left = max(0, c["y"] + padding), max(0, c["x"] + padding)
                    part = whole[top : max(top, c["y"] + c["height"] - padding), left : max(left, c["x"] + c["width"] - padding)]
                    if part.size:
                        rows.append((page, c["row"], c["col"], *part.shape, part.tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()], strict=True)], ["page", "row", "col", "height", "width", "data"])

    kind = pages.schema["page"].dataType.simpleString()
    return both.select("page", "height", "width", "data", "cells").mapInArrow(run, f"page {kind}, row int, col int, height int, width int, data binary")


def cell_key(settings: str, version: int = 1) -> Column:
    """Cache key of a crop: the cache's version, the crop's shape and bytes, and the settings it is read with."""
    return cache_key(F.lit(version), F.col("height"), F.col("width"), F.hex("data"), F.lit(settings))


def read_cells(cells: DataFrame, make: Callable[[], Engine], prepare: bool = True, done: Accumulator | None = None) -> DataFrame:
    """(page, row, col, text, confidence, raw_text, validation_error) of crops; an error becomes the cell's validation_error, and `done` counts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = make()
        for batch in batches:
            rows = []
            for page, row, col, h, w, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cell = np.frombuffer(data, np.uint8).reshape(h, w)
                try:
                    r = reader.recognize(image.cell_image(cell) if prepare else cell)
                except Exception as error:
                    r = Reading("", None, None, str(error) or type(error).__name__)
                rows.append((page, row, col, r.text, r.confidence, r.raw_text, r.validation_error))
                if done is not None:
                    done.add(1)
            if rows:
                types = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], ["page", "row", "col", "text", "confidence", "raw_text", "validation_error"])

    kind = cells.schema["page"].dataType.simpleString()
    own = cells.select("page", "row", "col", "height", "width", "data")
    return own.mapInArrow(run, f"page {kind}, row int, col int, text string, confidence double, raw_text string, validation_error string")


RULE = ("key", "name", "value_type", "pattern", "range_min", "range_max", "modes")
ATTEMPT = "struct<text: string, confidence: double, raw_text: string, error: string>"


def with_rule(cells: DataFrame, rules: DataFrame) -> DataFrame:
    """Crops with the rule of their column as a struct `rule`, null without one; rules has index and some of RULE."""
    have = [c for c in RULE if c in rules.columns]
    own = rules.select(F.col("index").alias("col"), F.struct(*have, *[F.lit(None).cast("string").alias(c) for c in RULE if c not in have]).alias("rule"))
    return cells.join(own, "col", "left")


def rule_error(text: Column) -> Column:
    """validation_error() by the columns of `rule`; null without a rule."""
    c = F.col("rule")
    return F.when(c.isNotNull(), validation_error(text, c["value_type"], c["pattern"], c["range_min"].cast("double"), c["range_max"].cast("double")))


def attempts(cells: DataFrame, make: Callable[[], Engine], prepare: bool = True) -> DataFrame:
    """Crops with `attempts`, an array of ATTEMPT.

    A recognizer with `recognize_modes(cell, rule)` gives one reading for each
    mode of the rule, and is asked for the next only while the caller wants
    more; any other one reads once. An error becomes that attempt's error.
    """
    kept = [c for c in cells.columns]
    schema = cells.withColumn("attempts", F.lit(None).cast(f"array<{ATTEMPT}>")).schema
    out = to_arrow_schema(schema)
    place = {c: i for i, c in enumerate(kept)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = make()
        for batch in batches:
            found = []
            rules = batch.column(place["rule"]).to_pylist() if "rule" in place else [None] * len(batch)
            for h, w, data, rule in zip(*(batch.column(place[c]).to_pylist() for c in ("height", "width", "data")), rules, strict=True):
                cell = np.frombuffer(data, np.uint8).reshape(h, w)
                cell = image.cell_image(cell) if prepare else cell
                tries = []
                try:
                    many = rule is not None and hasattr(reader, "recognize_modes")
                    for one in reader.recognize_modes(cell, rule) if many else [reader.recognize(cell)]:
                        tries.append({"text": one.text, "confidence": one.confidence, "raw_text": one.raw_text, "error": one.validation_error})
                except Exception as error:
                    tries.append({"text": "", "confidence": None, "raw_text": None, "error": str(error) or type(error).__name__})
                found.append(tries)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, out.field("attempts").type)], schema=out)

    return cells.mapInArrow(run, schema)


def judged(tried: DataFrame) -> DataFrame:
    """attempts() with text, confidence, raw_text and validation_error: the first reading that its rule allows, else the most confident one, blanked.

    Without a rule the first reading stands. A reading that failed keeps its
    error; one that a rule refuses keeps its text as raw_text.
    """
    allowed = lambda a: a["error"].isNull() & rule_error(a["text"]).isNull()
    good = F.try_element_at(F.filter("attempts", allowed), F.lit(1))
    surest = F.try_element_at(F.array_sort(F.col("attempts"), lambda a, b: F.when(F.coalesce(a["confidence"], F.lit(-1.0)) > F.coalesce(b["confidence"], F.lit(-1.0)), -1).when(F.coalesce(a["confidence"], F.lit(-1.0)) < F.coalesce(b["confidence"], F.lit(-1.0)), 1).otherwise(0)), F.lit(1))
    rows = tried.withColumns({"_good": good, "_best": F.when(F.col("rule").isNull(), F.try_element_at("attempts", F.lit(1))).otherwise(surest)})
    plain = F.when(F.col("rule").isNull(), F.col("_good.text")).otherwise(normalized_text(F.col("_good.text"), F.col("rule.value_type")))
    found = F.col("_good").isNotNull()
    failed = F.col("_best.error")
    return rows.withColumns(
        {
            "text": F.when(found, plain).when(F.col("rule").isNull(), F.col("_best.text")).otherwise(""),
            "confidence": F.when(found, F.col("_good.confidence")).otherwise(F.col("_best.confidence")),
            "raw_text": F.when(found, F.when(plain != F.col("_good.text"), F.col("_good.text")).otherwise(F.col("_good.raw_text"))).otherwise(F.coalesce("_best.raw_text", F.when(F.col("rule").isNotNull(), F.nullif("_best.text", F.lit(""))))),
            "validation_error": F.when(~found, F.coalesce(failed, rule_error(F.col("_best.text")))),
        }
    ).drop("_good", "_best", "attempts")


READING = ("text", "confidence", "raw_text", "validation_error")


def read_with_rules(cells: DataFrame, rules: DataFrame, make: Callable[[], Engine], verifier: Callable[[], Engine] | None = None, mode: str = "off", prepare: bool = True) -> DataFrame:
    """(page, row, col, text, confidence, raw_text, validation_error) of crops, under the rules of their columns and a verifier's second look.

    The verifier reads the crops for which needs_verifier() says so; its
    failure keeps what was read, an answer that the rule refuses blanks the
    cell, else its answer counts. Crops pass through both recognizers in one
    stage, and nothing is read twice.
    """
    read = judged(attempts(with_rule(cells, rules), make, prepare))
    if verifier is not None and mode != "off":
        read = second_look(read.withColumn("asked", needs_verifier(mode, F.col("validation_error"))), verifier, prepare)
        failure, seen = F.col("seen.error"), F.col("seen.text")
        text, error = verified(F.col("text"), F.col("validation_error"), seen, failure, rule_error(seen))
        asked = F.col("asked")
        read = read.withColumns({"text": F.when(asked, text).otherwise(F.col("text")), "validation_error": F.when(asked, error).otherwise(F.col("validation_error")), "raw_text": F.when(asked & (text != F.col("text")), F.coalesce("raw_text", F.nullif("text", F.lit("")))).otherwise(F.col("raw_text"))})
    return read.select("page", "row", "col", *READING)


def second_look(read: DataFrame, make: Callable[[], Engine], prepare: bool) -> DataFrame:
    """Rows with `seen`, an ATTEMPT of the verifier where `asked` is true."""
    schema = read.withColumn("seen", F.lit(None).cast(ATTEMPT)).schema
    out = to_arrow_schema(schema)
    place = {c: i for i, c in enumerate(read.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            seen = []
            for h, w, data, asked in zip(*(batch.column(place[c]).to_pylist() for c in ("height", "width", "data", "asked")), strict=True):
                if not asked:
                    seen.append(None)
                    continue
                reader = reader or make()
                cell = np.frombuffer(data, np.uint8).reshape(h, w)
                try:
                    one = reader.recognize(image.cell_image(cell) if prepare else cell)
                    seen.append({"text": one.text, "confidence": one.confidence, "raw_text": one.raw_text, "error": one.validation_error})
                except Exception as error:
                    seen.append({"text": "", "confidence": None, "raw_text": None, "error": str(error) or type(error).__name__})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seen, out.field("seen").type)], schema=out)

    return read.mapInArrow(run, schema)


def read_once(cells: DataFrame, cache: DataFrame, settings: str, read: Callable[[DataFrame], DataFrame], version: int = 1) -> tuple[DataFrame, DataFrame]:
    """(cells with their cache_key, readings (cache_key, READING) of one crop of each key that the cache lacks)."""
    keyed = cells.withColumn("cache_key", cell_key(settings, version))
    fresh = uncached(keyed.withColumn("request_id", F.struct("page", "row", "col")), cache).drop("request_id")
    return keyed, read(fresh).join(fresh.select("page", "row", "col", "cache_key"), ["page", "row", "col"]).select("cache_key", *READING)


def read_cached(cells: DataFrame, cache: DataFrame, settings: str, read: Callable[[DataFrame], DataFrame], version: int = 1) -> tuple[DataFrame, DataFrame]:
    """(readings of all crops, rows to add to the cache): only one crop of each key that the cache lacks is read, and once.

    cache has cache_key and the columns of READING; settings says all that a
    reading depends on beside the pixels, and rows of other versions have other
    keys. Failures that may pass are readings, but not for the cache: those
    cells are read again next time.
    """
    keyed, found = read_once(cells, cache, settings, read, version)
    found = stored(found)
    known = cache.select("cache_key", *READING).dropDuplicates(["cache_key"]).unionByName(found)
    readings = keyed.select("page", "row", "col", "cache_key").join(known, "cache_key").select("page", "row", "col", *READING)
    return readings, found.where(~is_passing(F.col("text"), F.col("validation_error")))


@dataclass(frozen=True)
class Vision:
    """A vision model behind an HTTP chat address."""

    url: str
    model: str
    timeout: float = 120.0

    def ask(self, prompt_text: str, cell: np.ndarray) -> str:
        """The response to a prompt with an image; the same request has the same Idempotency-Key."""
        if not self.url or not self.model:
            raise RuntimeError("llm ocr is not configured: give an address and a model")
        message = {"role": "user", "content": prompt_text, "images": [base64.b64encode(image.png(cell)).decode()]}
        body = json.dumps({"model": self.model, "messages": [message], "stream": False}).encode()
        headers = {"Content-Type": "application/json", "Accept": "application/json", "Idempotency-Key": hashlib.sha256(body).hexdigest()}
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url, body, headers, method="POST"), timeout=self.timeout) as response:
                return response.read().decode()
        except OSError as error:  # urllib's errors and timeouts are among them
            raise RuntimeError(f"llm ocr request failed: {error}") from error


def request_log(prompt_text: Column, data: Column) -> Column:
    """What a log may keep of a request: the prompt, and of the image its base64 length and SHA-256."""
    encoded = image.encoded(data)
    return F.struct(prompt_text.alias("prompt"), F.length(encoded).alias("image_base64_length"), F.sha2(encoded.cast("binary"), 256).alias("image_sha256"))


def read_by_vision(cells: DataFrame, rules: DataFrame, model: Vision, attempts_: int = 3, wait: float = 1.0) -> DataFrame:
    """(page, row, col, text, confidence, raw_text, validation_error) of crops by a vision model; prompts and answers are columns.

    Passing errors are tried again as by Retrying. An answer without text that
    says blank, illegible or uncertain is a blank cell; other such answers, and
    failed requests, are errors. A rule that refuses the text blanks it.
    """
    c = F.col("rule")
    words = prompt(c["value_type"], c["name"], c["range_min"].cast("double"), c["range_max"].cast("double"), F.lit(None).cast("string"))
    asked = with_rule(cells, rules).withColumn("prompt", words)
    kind = cells.schema["page"].dataType.simpleString()
    schema = asked.select("page", "row", "col", "rule").withColumns({"response": F.lit(None).cast("string"), "failure": F.lit(None).cast("string")}).schema
    out = to_arrow_schema(schema)

    class Asking:
        def __init__(self, text: str) -> None:
            self.text = text

        def recognize(self, cell: np.ndarray) -> Reading:
            return Reading(model.ask(self.text, cell))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers, failures = [], []
            for text, h, w, data in zip(*(batch.column(i).to_pylist() for i in range(4, 8)), strict=True):
                try:
                    answers.append(Retrying(Asking(text), attempts_, wait).recognize(np.frombuffer(data, np.uint8).reshape(h, w)).text)
                    failures.append(None)
                except Exception as error:
                    answers.append(None)
                    failures.append(str(error))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(answers, pa.string()), pa.array(failures, pa.string())], schema=out)

    rows = asked.select("page", "row", "col", "rule", "prompt", "height", "width", "data").mapInArrow(run, schema)
    content = F.coalesce(chat_content(F.col("response")), F.lit(""))
    text, status = parsed_answer(content)
    rows = rows.withColumns({"_content": content, "_text": text, "_status": status})
    plain = F.when(c.isNull(), F.col("_text")).otherwise(normalized_text(F.col("_text"), c["value_type"]))
    refused = F.when(F.col("_text") != "", rule_error(F.col("_text")))
    error = F.coalesce("failure", answer_error(F.col("_text"), F.col("_status")), refused)
    raw = F.when(F.col("failure").isNull() & ((F.col("_text") == "") | (F.col("_text") != F.trim("_content"))), F.col("_content"))
    out_text = F.when(error.isNull(), plain).otherwise("")
    return rows.select(F.col("page").cast(kind), "row", "col", out_text.alias("text"), F.lit(None).cast("double").alias("confidence"), raw.alias("raw_text"), error.alias("validation_error"))


def redacted_columns(columns: DataFrame, extra: list[int]) -> DataFrame:
    """(index) of the columns to redact: filtered ones and extra ones, dividers never."""
    gone = F.col("filter_out") | F.col("index").isin(*extra) if extra else F.col("filter_out")
    return columns.where(gone & ~F.lower("key").startswith("divider")).select("index")
