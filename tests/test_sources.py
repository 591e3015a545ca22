"""Pages as a data source, and files that appear at the commit."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import scoring
from gridloom.sources import pages, sinks


def backend() -> pages.Backend:
    """Documents whose contents are their number of pages; a page is gray if its number is odd, else in color, and tells its number and task."""

    def count(data: bytes) -> int:
        return int(data or b"0")

    def page(data: bytes, number: int) -> np.ndarray:
        return np.full((2, 3) if number % 2 else (2, 3, 3), number, np.uint8)

    return pages.Backend(count, page)


def test_pages_of_documents(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.PDF").write_text("7")
    (tmp_path / "deep" / "b.pdf").write_text("1")
    (tmp_path / "c.txt").write_text("9")
    df = pages.pages(spark, f"file://{tmp_path}", backend(), most=3)
    rows = sorted((r.path.rsplit("/", 1)[1], r.page, r.height, r.width, r.channels, bytes(r.data)) for r in df.collect())
    shape = lambda n: (2, 3, 1 if n % 2 else 3, bytes([n]) * (6 if n % 2 else 18))
    assert rows == [("a.PDF", n, *shape(n)) for n in range(1, 8)] + [("b.pdf", 1, *shape(1))]
    # pages of one document are read by several tasks
    tasks = df.withColumn("task", F.spark_partition_id()).groupBy("path").agg(F.countDistinct("task").alias("n")).orderBy(F.desc("n")).collect()
    assert [r.n for r in tasks] == [3, 1] and df.rdd.getNumPartitions() == 4
    assert df.where("page > 6").select("page").collect()[0].page == 7


def test_documents_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "a.pdf").write_text("2")
    pages.register(spark)
    with pytest.raises(Exception, match="give a backend"):
        spark.read.format("pages").load(f"file://{tmp_path}").count()
    (tmp_path / "b.pdf").write_text("")
    with pytest.raises(Exception, match="b.pdf has no pages"):
        pages.pages(spark, f"file://{tmp_path}", backend()).count()


def test_a_folder_without_documents(spark, tmp_path):
    assert pages.pages(spark, f"file://{tmp_path}", backend()).count() == 0


def test_stream_of_documents(spark, tmp_path):
    """Each document comes once, over stops too."""
    source, out = tmp_path / "in", f"file://{tmp_path}/out"
    source.mkdir()

    def run():
        stream = pages.pages(spark, f"file://{source}", backend(), most=2, stream=True)
        query = stream.drop("data").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r.path.rsplit("/", 1)[1], r.page) for r in spark.read.parquet(out).collect())

    (source / "b.pdf").write_text("3")
    assert run() == [("b.pdf", 1), ("b.pdf", 2), ("b.pdf", 3)]
    assert run() == [("b.pdf", 1), ("b.pdf", 2), ("b.pdf", 3)]
    (source / "a.pdf").write_text("1")
    assert run() == [("a.pdf", 1), ("b.pdf", 1), ("b.pdf", 2), ("b.pdf", 3)]


CROP = "name string, height int, width int, data binary, error string"


def crops(spark, n: int):
    return spark.createDataFrame([(f"c{i:02d}.png", 2, 2, bytes([i]) * 4, None) for i in range(n)] + [("bad.png", None, None, None, "no ink")], CROP).repartition(4)


def files(folder) -> list[str]:
    return sorted(p.name for p in folder.iterdir())


def test_images_appear_at_the_commit(spark, tmp_path):
    folder = tmp_path / "out"
    sinks.save_cell_images(crops(spark, 9), f"file://{folder}")
    assert files(folder) == [f"c{i:02d}.png" for i in range(9)] + ["failures.json"]
    assert json.loads((folder / "failures.json").read_text()) == [{"name": "bad.png", "error": "no ink"}]
    back = spark.read.format("image").option("pathGlobFilter", "*.png").load(f"file://{folder}").select("image.*").collect()
    assert sorted(bytes(r.data) for r in back) == [bytes([i]) * 4 for i in range(9)]
    with pytest.raises(Exception, match="say overwrite"):
        sinks.save_cell_images(crops(spark, 3), f"file://{folder}")
    assert len(files(folder)) == 10
    sinks.save_cell_images(crops(spark, 3), f"file://{folder}", overwrite=True)
    assert len(files(folder)) == 10


def test_a_failing_task_leaves_no_files(spark, tmp_path):
    folder = tmp_path / "out"
    broken = crops(spark, 9).withColumn("width", F.when(F.col("name") == "c05.png", 3).otherwise(F.col("width")))
    with pytest.raises(Exception, match="reshape"):
        sinks.save_cell_images(broken, f"file://{folder}")
    assert not folder.exists() or files(folder) == []
    twice = crops(spark, 2).unionByName(crops(spark, 1))
    with pytest.raises(Exception, match="several images"):
        sinks.save_cell_images(twice, f"file://{folder}")
    assert not folder.exists() or files(folder) == []
    with pytest.raises(Exception, match="error"):
        crops(spark, 1).drop("error").write.format("cell_images").mode("append").save(f"file://{folder}")


def test_run_comparison(spark):
    pairs = [("a", True, False)] * 3 + [("a", False, True)] * 10 + [("a", True, True)] * 4 + [("a", None, True), ("b", False, False)]
    got = {r.key: r for r in scoring.run_comparison(spark.createDataFrame(pairs, "key string, right_before boolean, right_after boolean"), "key").collect()}
    a = got["a"]
    assert (a.cells, a.both_right, a.won, a.lost, a.both_wrong) == (17, 4, 10, 3, 0) and abs(a.change - 7 / 17) < 1e-12 and abs(a.statistic - 36 / 13) < 1e-12
    assert got["b"].statistic is None and got["b"].both_wrong == 1


def test_no_source_lies_in_two_parts(spark):
    rows = spark.createDataFrame([(f"s{i % 90}" if i % 7 else None, i) for i in range(900)], "source string, i int")
    split = rows.select("source", scoring.split_of(F.coalesce("source", F.lit(""))).alias("split")).distinct()
    assert split.groupBy("source").count().where("count > 1").count() == 0
    sizes = {r.split: (r.sources, r.rows) for r in scoring.split_sizes(rows, "source").collect()}
    assert sum(n for n, _ in sizes.values()) == 91 and sum(n for _, n in sizes.values()) == 900 and sizes["train"][0] > 45
