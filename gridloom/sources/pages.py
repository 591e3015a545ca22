"""Pages of documents as a data source: partitions are ranges of pages, streams go by file."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SCHEMA = "path string, page int, height int, width int, channels int, data binary"


@dataclass(frozen=True)
class Backend:
    """How a kind of document is read: how many pages contents have, and a page of them (from 1) as an array of uint8."""

    count: Callable[[bytes], int]
    page: Callable[[bytes, int], object]


@dataclass
class PageRange(InputPartition):
    """Pages first to last of a file."""

    path: str
    first: int
    last: int


def listed(folder: str, suffix: str) -> list[tuple[int, str]]:
    """(time of change in nanoseconds, path) of a folder's files with the suffix, case aside, in order."""
    store, base = fs.FileSystem.from_uri(folder)
    found = store.get_file_info(fs.FileSelector(base, recursive=True))
    lead = folder[: len(folder) - len(base)] if folder.endswith(base) else ""
    return sorted((f.mtime_ns, lead + f.path) for f in found if f.type == fs.FileType.File and f.base_name.lower().endswith(suffix))


def contents(path: str) -> bytes:
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as file:
        return file.read()


class Reading:
    """What batch and stream readers share."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.types = to_arrow_schema(schema)
        self.folder, self.suffix = options["path"].rstrip("/"), options.get("suffix", ".pdf").lower()
        self.step = max(1, int(options.get("pages", 8)))
        if "backend" not in options:
            raise RuntimeError("no reader of pages is installed; give a backend")
        self.backend: Backend = cloudpickle.loads(bytes.fromhex(options["backend"]))

    def ranges(self, paths: list[str]) -> list[PageRange]:
        out = []
        for path in paths:
            n = self.backend.count(contents(path))
            if n < 1:
                raise ValueError(f"{path} has no pages")
            out += [PageRange(path, i, min(n, i + self.step - 1)) for i in range(1, n + 1, self.step)]
        return out

    def read(self, partition: PageRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's one partition of a folder without documents
            return
        data = contents(partition.path)
        for number in range(partition.first, partition.last + 1):
            p = self.backend.page(data, number)
            row = (partition.path, number, *p.shape[:2], 1 if p.ndim == 2 else p.shape[2], p.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, self.types.types, strict=True)], schema=self.types)


class PageReader(Reading, DataSourceReader):
    def partitions(self) -> list[PageRange]:
        return self.ranges([path for _, path in listed(self.folder, self.suffix)])


class PageStream(Reading, DataSourceStreamReader):
    """Files in order of their change; an offset is the last file that was taken, so a file comes once, and whole."""

    def initialOffset(self) -> dict:
        return {"at": -1, "path": ""}

    def latestOffset(self) -> dict:
        found = listed(self.folder, self.suffix)
        return {"at": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[PageRange]:
        low, high = (start["at"], start["path"]), (end["at"], end["path"])
        return self.ranges([path for at, path in listed(self.folder, self.suffix) if low < (at, path) <= high])

    def commit(self, end: dict) -> None:
        pass


class PageSource(DataSource):
    """Format ``pages``: SCHEMA rows of a folder's documents.

    Options: path; suffix (.pdf); pages, the most pages of a partition, so that
    one document is read by several tasks; backend, see with_backend(). A
    document without pages is an error, and so is a read without a backend.
    """

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(schema, self.options)

    def streamReader(self, schema: StructType) -> PageStream:
        return PageStream(schema, self.options)


def with_backend(backend: Backend) -> str:
    """A backend as the value of an option."""
    return cloudpickle.dumps(backend).hex()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageSource)


def pages(spark: SparkSession, folder: str, backend: Backend, suffix: str = ".pdf", most: int = 8, stream: bool = False) -> DataFrame:
    """The pages of a folder's documents, `most` of them in a partition; as a stream, of those that come too."""
    register(spark)
    source = spark.readStream if stream else spark.read
    return source.format("pages").option("suffix", suffix).option("pages", most).option("backend", with_backend(backend)).load(folder)
