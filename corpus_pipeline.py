"""From raw documents to shards of a training mix.

STAGES run in order, each over the whole table that the one before wrote. All
but the last return the columns of documents; the last adds the shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.deploy import ship
from gridloom.llm.classifier import quality
from gridloom.llm.common import written
from gridloom.llm.decontamination import contamination
from gridloom.llm.mixing import mixture
from gridloom.llm.sharding import with_shard
from gridloom.llm.simhash import similar_documents


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a column for its rows' key: the doc_id, or for a null one a hash of the text, which comes after every id."""
    number = "decimal(38,0)"
    return docs.withColumn("_key", F.coalesce(F.col("doc_id").cast(number), F.lit(str(1 << 65)).cast(number) + F.xxhash64("text").cast(number)).cast(number))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labels, scores at 0.5 or more.

    Null, empty and wordless texts score alike, so all of them stay or all go;
    repeated rows do too. Labels of one class only, or none, keep every row.
    """
    ship(spark)
    scored = quality(docs, read(spark, sf_dir, "labels"), carry=tuple(docs.columns))
    return scored.where("score >= 0.5").select("row.*")


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near copies (five-word shingles, similarity of 0.8 or more).

    A row without an id comes after those with one. Of rows with the same id
    and text one stays. Texts without words, nulls among them, are copies of
    each other.
    """
    ship(spark)
    rows = keyed(docs)
    groups = similar_documents(rows, "_key", shingle=5, similarity=0.8)
    first = groups.where("id = component_id").select(F.col("id").alias("_key")).distinct()
    return rows.join(first, "_key", "left_semi").withColumn("_text", F.xxhash64("text")).dropDuplicates(["_key", "_text"]).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and wordless texts have none, and stay; an empty benchmark keeps every row."""
    ship(spark)
    found = contamination(docs, read(spark, sf_dir, "benchmark"), carry=tuple(docs.columns))
    return found.where("n_hit = 0").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; one that it takes in part comes if that is half of it or more.

    Texts without words have nothing to give to the mix and don't come. Rows
    with the same id come as often as the one of them that comes most.
    """
    taken = mixture(keyed(docs), "_key")
    times = F.floor(F.try_divide(F.col("taken") + F.col("size") / 2, F.col("size"))).cast("int")
    plan = taken.select(F.col("id").alias("_key"), times.alias("_times")).where("_times > 0").groupBy("_key").agg(F.max("_times").alias("_times"))
    return keyed(docs).join(plan, "_key").select(*docs.columns, F.explode(F.sequence(F.lit(1), "_times"))).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard of 40, and of 41; rows without an id share one."""
    ship(spark)
    return with_shard(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("near duplicates", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: SQL can express neither the classifier nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
