"""Shards by jump consistent hashing, with gapless slots."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key (Lamping and Veach, 2014): each added shard takes its share of keys and moves no other."""
    key = keys.astype(np.uint64).copy()
    at = np.zeros(len(key), np.int64)
    ahead = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(live):
            at[live] = ahead[live]
            key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
            span = (key[live] >> np.uint64(33)).astype(np.float64) + 1.0
            ahead[live] = ((at[live] + 1) * (2.0**31 / span)).astype(np.int64)
            live = live[ahead[live] < shards]
    return at


def jump_shard(key: Column, shards: int) -> Column:
    """jump() of a long column, in Arrow batches."""

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return shard(key)


def stable_key(id_col: Column) -> Column:
    """60 bits of the MD5 of the id's text, as a long; a null id counts as the text 'null'."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def shard_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, rows_a_part: int = 1_000_000) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for each row of df.

    The id and the number of shards alone decide the shard (law 'key'), and
    grown_shard is the shard if there were one more. size is the text's UTF-8
    bytes plus 16, a null text counting as empty. Slots number a shard's rows
    from 0 without gaps, in order of (bucket of the id's hash, hash, id, crc, size); rows equal in
    all of these get neighbouring slots in any order. Null ids share one shard.
    Slots come from counts of (shard, bucket of the hash) and a rank within the
    bucket, so that a shard's rows needn't meet in one task; a bucket of more than
    `rows_a_part` rows, such as that of rows without an id, is dealt to parts,
    and its slots follow the parts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), stable_key(F.col(id_col)).alias("key"))
    rows = rows.withColumn("shard", jump_shard(F.col("key"), shards)).withColumn("grown_shard", jump_shard(F.col("key"), shards + 1))
    rows = written(rows.withColumns({"bucket": (F.col("key") % 1024).cast("int"), "tie": F.monotonically_increasing_id()}))
    buckets = rows.groupBy("shard", "bucket").agg(F.ceil(F.count("*") / rows_a_part).alias("parts"))
    rows = rows.join(buckets, ["shard", "bucket"]).withColumn("part", F.pmod(F.xxhash64("tie"), F.col("parts")))
    before = W.partitionBy("shard").orderBy("bucket", "part").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "bucket", "part").count().select("shard", "bucket", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = W.partitionBy("shard", "bucket", "part").orderBy("key", "id", "text_crc32", "size")
    placed = rows.withColumn("rank", F.row_number().over(within)).join(starts, ["shard", "bucket", "part"])
    return placed.select("id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"), "grown_shard")


def with_shard(df: DataFrame, id_col: str = "doc_id", shards: int = 40) -> DataFrame:
    """df with columns shard and grown_shard, as shard_rows() has them, in place of any of those names; no row moves."""
    key = stable_key(F.col(id_col))
    return df.withColumns({"shard": jump_shard(key, shards), "grown_shard": jump_shard(key, shards + 1)})
