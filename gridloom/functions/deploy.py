"""What a session needs: this package on its executors, and a folder that all of them share."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()
_local: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a local session may lack that setting, and gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        name = spark.sparkContext.applicationId
        root = _local.setdefault(name, "") or "file://" + tempfile.mkdtemp(prefix="gridloom-")
        _local[name] = root
    return root.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, which cuts its lineage."""
    path = f"{shared_root(df.sparkSession)}/gridloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """df as a table in buckets of the key, one file each, so that joins by the key move only their other side.

    It is known to the session's catalogue under a name of its own; its files
    are in the shared folder.
    """
    spark, name = df.sparkSession, f"gridloom_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", f"{shared_root(spark)}/gridloom/{name}").saveAsTable(name)
    return spark.table(name)


def ship(spark: SparkSession) -> None:
    """Makes the package importable in Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    _sent.add(context.applicationId)
    package = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp()
    copied = shutil.copytree(package, f"{folder}/tree/{package.name}", ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", copied.parent if isinstance(copied, Path) else Path(copied).parent))
