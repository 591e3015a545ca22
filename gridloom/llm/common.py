"""Helpers that several corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gridloom.functions.deploy import shared_root

#: ASCII blanks that separate words; bytes.split() uses the same six.
BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path below the one that driver and executors share."""
    return f"{shared_root(spark)}/gridloom/{uuid.uuid4().hex}"


#: Whether Spark drops an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, **options: int) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, no executor holds the only copy, and the shuffle files behind it go. `options` are the writer's."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string column's UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(column: pa.Array, most: int = 1 << 24) -> Iterator[tuple[int, list[bytes]]]:
    """as_bytes in runs of rows of about that many bytes, with the first row's index; rows stay whole."""
    run: list[bytes] = []
    first = held = 0
    for i, x in enumerate(column.cast(pa.binary())):
        b = x.as_py() or b""
        if run and held + len(b) > most:
            yield first, run
            run, first, held = [], i, 0
        run.append(b)
        held += len(b)
    if run:
        yield first, run


def batched(rows: Iterable[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches."""
    out: list[tuple] = []
    for row in rows:
        out.append(row)
        if len(out) >= size:
            yield columns_of(out, schema)
            out = []
    if out:
        yield columns_of(out, schema)


def columns_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def per_text(df: DataFrame, text_col: str, carry: list[str], schema: str, work) -> DataFrame:
    """A struct column `row` of the carried columns, and the columns of schema that work() gives.

    work is called once a task and gives a function from a list of UTF-8 texts
    (null: empty) to one Arrow array or list for each column of schema. A
    struct keeps carried names apart from result names.
    """
    source = df.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(text_col).cast("string").alias("text"))
    results_schema = T._parse_datatype_string(schema)
    out = T.StructType([source.schema["row"], *results_schema.fields])
    types = to_arrow_schema(results_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = work()
        for batch in batches:
            for first, texts in pieces(batch.column(1)):
                results = f(texts)
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, t.type) for x, t in zip(results, types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), *arrays], ["row", *types.names])

    return source.mapInArrow(run, out)
