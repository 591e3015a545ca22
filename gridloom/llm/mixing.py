"""Sources mixed to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BLANK, let, written


def size_in_words(text: Column) -> Column:
    """Words of a text, as a long; 0 for null."""
    return let(F.split(F.coalesce(text, F.lit("")), BLANK), lambda p: (F.size(p) - F.when(F.element_at(p, 1) == "", 1).otherwise(0) - F.when((F.size(p) > 1) & (F.element_at(p, -1) == ""), 1).otherwise(0)).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, rank, weight, source_size, target) for each source of (source, size).

    Sources in code point order, null last, weigh `weights`, repeating, and
    share all sizes; a target stops at `most` times its source's size and the
    excess goes to the others by weight. Sources fill up in order of size over
    weight, so the fill level follows from running sums over that order. The
    windows run over one row per source, not over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = W.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("rank", F.row_number().over(named) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    every = W.partitionBy()
    order = W.orderBy(F.col("source_size") / F.col("weight"), "rank")
    per = per.withColumns({"total": F.sum("source_size").over(every), "all_weight": F.sum("weight").over(every)})
    done = order.rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumns({"full": F.coalesce(F.sum("source_size").over(done), F.lit(0)) * most, "gone": F.coalesce(F.sum("weight").over(done), F.lit(0))})
    level = (F.col("total") - F.col("full")) / (F.col("all_weight") - F.col("gone"))
    per = per.withColumn("level", F.when(level * F.col("weight") <= F.col("source_size") * most, level))
    per = per.withColumn("fill", F.min(F.when(F.col("level").isNotNull(), F.struct("gone", "level"))).over(every)["level"])
    target = F.least(F.coalesce(F.col("fill"), F.lit(0.0)) * F.col("weight"), (F.col("source_size") * most).cast("double"))
    return per.select("source", "rank", "weight", "source_size", target.alias("target"))


def quotas(targets: DataFrame, block: int = 16) -> DataFrame:
    """targets (rank, target) with `blocks`: how many blocks of `block` tokens each source gets out of all."""
    seats = F.ceil(F.sum("target").over(W.partitionBy()) / block)
    return apportioned(targets.withColumn("seats", seats), []).drop("seats")


def shard_quotas(cells: DataFrame) -> DataFrame:
    """cells (source, rank, shard, held, blocks) with `quota`: the source's blocks apportioned to its shards by the words that they hold."""
    rank = F.dense_rank().over(W.orderBy("rank", "shard"))
    own = cells.select(F.col("source"), "shard", rank.alias("rank"), F.col("held").cast("double").alias("target"), F.col("blocks").alias("seats"))
    won = apportioned(own, ["source"]).select(F.col("source").alias("_s"), F.col("shard").alias("_h"), F.col("blocks").alias("quota"))
    return cells.join(won, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h"))).drop("_s", "_h")


def apportioned(t: DataFrame, keys: list[str]) -> DataFrame:
    """t (rank, target, seats) with `blocks`: the seats of each group of keys by Sainte-Laguë; ranks are unique.

    Seats go to the highest quotients target / (2 k + 1). Let T be a group's
    targets, N its seats and m its members. With divisor T / (N - m / 2), or
    with none at all for small N, rounding gives each member seats that it wins
    in any case; with T / (N + m / 2) it gives at least N seats. Only the
    quotients between the two, some 2 m, are ranked; ties go to the first rank.
    """
    columns, every = t.columns, W.partitionBy(*keys)
    t = t.withColumns({"T": F.sum("target").over(every), "m": F.count("*").over(every)})
    sure = F.when(F.col("seats") > F.col("m") / 2, F.floor(F.try_divide(F.col("target") * (F.col("seats") - F.col("m") / 2), F.col("T")) + 0.5)).otherwise(0)
    t = t.withColumn("sure", F.coalesce(sure, F.lit(0)).cast("long"))
    may = F.floor(F.try_divide(F.col("target") * (F.col("seats") + F.col("m") / 2), F.col("T")) + 0.5)
    t = t.withColumns({"may": F.greatest(F.coalesce(may, F.lit(0)).cast("long"), "sure"), "open": F.col("seats") - F.sum("sure").over(every)})
    asked = t.where("may > sure").select(*keys, "rank", "target", "open", F.explode(F.sequence("sure", F.col("may") - 1)).alias("k"))
    order = every.orderBy((F.col("target") / (2 * F.col("k") + 1)).desc(), "rank", "k")
    won = asked.withColumn("place", F.row_number().over(order)).where("place <= open").groupBy("rank").agg(F.count("*").alias("more"))
    return t.join(won, "rank", "left").select(*columns, (F.col("sure") + F.coalesce("more", F.lit(0))).alias("blocks"))


def mixture(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block: int = 16, seed: int = 7, shards: int = 8) -> DataFrame:
    """(id, source, size, source_size, target, taken) for each row of df.

    A hash of the id, drawn by the seed, deals a source's documents to `shards`
    (256 at most) and orders them there, so that each shard has a line of the
    source's words, cut into blocks of `block`. The source's quota of blocks is
    apportioned to its shards by what they hold. A shard takes its quota from
    its line's start, and from the start again as often as the quota is longer
    than the line, up to `most` times in all; taken counts a document's words
    in those blocks. Null and wordless texts have size 0 and take 0; a null
    source is a source of its own; rows equal in id and size may swap places.

    Documents meet only in sums by (source, bucket of the order). Only the
    bucket in which a shard's last block ends is ranked row by row.
    """
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_in_words(F.col(text_col)).alias("size"), draw.alias("draw"))
    shard = F.floor(F.conv(F.substring("draw", 1, 2), 16, 10).cast("int") * shards / 256).cast("int")
    rows = written(rows.withColumns({"bucket": F.substring("draw", 1, 3), "shard": shard}))
    buckets = written(rows.groupBy("source", "shard", "bucket").agg(F.sum("size").alias("size")))
    sources = quotas(source_targets(buckets, weights, most), block).select(F.col("source").alias("of"), "rank", "source_size", "target", "blocks")
    cells = buckets.groupBy("source", "shard").agg(F.sum("size").alias("held")).join(sources, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    quota = shard_quotas(written(cells))
    quota = quota.withColumn("wanted", F.least(F.col("quota") * block, F.col("held") * most))
    whole = F.coalesce(F.floor(F.try_divide(F.col("wanted"), F.col("held"))), F.lit(0))
    quota = quota.withColumn("whole", whole).withColumn("rest", F.col("wanted") - F.col("whole") * F.col("held"))
    quota = written(quota.select(F.col("source").alias("of"), F.col("shard").alias("part"), "source_size", "target", "whole", "rest"))
    mine = F.col("source").eqNullSafe(F.col("of")) & (F.col("shard") == F.col("part"))
    own = W.partitionBy("source", "shard").orderBy("bucket")
    placed = buckets.withColumnRenamed("size", "held").withColumn("start", F.sum("held").over(own) - F.col("held")).join(quota, mine)
    # the bucket in which the rest ends, with the room in it, and the last bucket before it
    ends = placed.groupBy("source", "shard").agg(F.max(F.when((F.col("start") + F.col("held") <= F.col("rest")) & (F.col("held") > 0), F.col("bucket"))).alias("upto"), F.max(F.when((F.col("start") < F.col("rest")) & (F.col("rest") < F.col("start") + F.col("held")), F.struct("bucket", (F.col("rest") - F.col("start")).alias("room")))).alias("cut"))
    plan = ends.join(quota, mine).select("of", "part", "source_size", "target", "whole", "upto", "cut.bucket", "cut.room").withColumnRenamed("bucket", "cut")
    rows = rows.join(written(plan), mine).drop("of", "part")
    inside = F.coalesce(F.col("bucket") == F.col("cut"), F.lit(False))
    base = F.col("whole") * F.col("size")
    out = ["id", "source", "size", "source_size", "target"]
    plain = rows.where(~inside).select(*out, (base + F.when(F.col("bucket") <= F.col("upto"), F.col("size")).otherwise(0)).alias("taken"))
    line = W.partitionBy("source", "shard").orderBy("draw", "id", "size")
    before = F.coalesce(F.sum("size").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    split = rows.where(inside).withColumn("before", before)
    split = split.select(*out, (base + F.greatest(F.lit(0), F.least("size", F.col("room") - F.col("before")))).alias("taken"))
    return plain.unionByName(split).withColumn("taken", F.col("taken").cast("long"))
