"""Readings of crops that arrive as a stream, with what was read before in a table beside it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.recognize import READING, cell_key, read_once
from gridloom.operators.rules import is_passing

from .inbox import at_path, exists

ATTEMPT = "cache_key string, text string, confidence double, raw_text string, validation_error string"


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    """(cache_key, READING) of all that was ever read, failures too."""
    store, name = at_path(folder)
    store.create_dir(name, recursive=True)
    return spark.read.schema(ATTEMPT).option("recursiveFileLookup", True).parquet(folder)


def standing(tried: DataFrame) -> DataFrame:
    """Attempts that needn't be made again, one for each key."""
    return tried.where(~is_passing(F.col("text"), F.col("validation_error"))).dropDuplicates(["cache_key"])


def reading_each(cache: str, out: str, settings: str, read: Callable[[DataFrame], DataFrame], version: int = 1) -> Callable[[DataFrame, int], None]:
    """What a stream of crops (page, row, col, height, width, data) does with a batch: its readings go to `out`, a folder for each batch.

    Only keys that no attempt in `cache` stands for are read. Several streams
    may share a cache. A batch's attempts are written, under `out` and the batch's
    number, before they are used: a batch that runs again after a stop finds
    them and reads nothing twice.
    Failures that may pass show in the batch's readings, and are tried
    again in later batches. Another version or other settings have other keys.
    """

    stream = hashlib.sha256(out.encode()).hexdigest()[:16]

    def each(batch: DataFrame, number: int) -> None:
        spark, own = batch.sparkSession, f"{cache}/version={version}/stream={stream}/batch={number}"
        if not exists(f"{own}/_SUCCESS"):
            _, found = read_once(batch, standing(attempts(spark, cache)), settings, read, version)
            found.write.mode("overwrite").parquet(own)
        # what was read now comes before what failed earlier
        tried = attempts(spark, cache).withColumn("passing", is_passing(F.col("text"), F.col("validation_error")))
        tried = tried.withColumn("now", F.input_file_name().contains(f"/stream={stream}/batch={number}/"))
        best = tried.groupBy("cache_key").agg(F.min_by(F.struct(*READING), F.struct("passing", ~F.col("now"))).alias("r"))
        keyed = batch.select("page", "row", "col", cell_key(settings, version).alias("cache_key"))
        keyed.join(best, "cache_key").select("page", "row", "col", "r.*").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return each
