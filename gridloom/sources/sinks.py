"""Files that appear when a write is committed: images and the list of what failed."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from gridloom.operators.image import png

#: What a write needs of its rows; error is null where there is an image.
COLUMNS = ("name", "height", "width", "data", "error")


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: (name, file below the staging folder), and what failed."""

    files: list[tuple[str, str]]
    failures: list[dict[str, str]]


class ImageWriter(DataSourceArrowWriter):
    """Tasks write below a staging folder of this write; the driver moves files to their names at the commit, or drops them all."""

    def __init__(self, folder: str, overwrite: bool) -> None:
        self.folder, self.staging, self.overwrite = folder, f"{folder}/_staging-{uuid.uuid4().hex}", overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, base = fs.FileSystem.from_uri(self.staging)
        attempt = f"{base}/{uuid.uuid4().hex}"
        store.create_dir(attempt, recursive=True)
        out = Written([], [])
        for batch in batches:
            for name, h, w, data, error in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in COLUMNS), strict=True):
                if error is not None:
                    out.failures.append({"name": name, "error": error})
                    continue
                place = f"{attempt}/{len(out.files)}.png"
                with store.open_output_stream(place) as file:
                    file.write(png(np.frombuffer(data, np.uint8).reshape(h, w)))
                out.files.append((name, place))
        return out

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        files = [f for m in done for f in m.files]
        names = [n for n, _ in files]
        store, base = fs.FileSystem.from_uri(self.folder)
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError(f"several images are called {next(n for n in names if names.count(n) > 1)}")
        if not self.overwrite and any(i.type != fs.FileType.NotFound for i in store.get_file_info([f"{base}/{n}" for n in names])):
            self.abort(messages)
            raise FileExistsError(f"{self.folder} has images of these names; say overwrite")
        for name, place in files:
            store.move(place, f"{base}/{name}")
        failures = sorted((f for m in done for f in m.failures), key=lambda f: (f["name"], f["error"]))
        with store.open_output_stream(f"{base}/failures.json") as out:
            out.write(json.dumps(failures, indent=2, ensure_ascii=False).encode() + b"\n")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, base = fs.FileSystem.from_uri(self.staging)
        if store.get_file_info(base).type == fs.FileType.Directory:
            store.delete_dir(base)


class ImageSink(DataSource):
    """Format ``cell_images``: PNG files of rows of COLUMNS, and failures.json with the rows that have an error."""

    @classmethod
    def name(cls) -> str:
        return "cell_images"

    def writer(self, schema: StructType, overwrite: bool) -> ImageWriter:
        lacking = [c for c in COLUMNS if c not in schema.names]
        if lacking:
            raise ValueError(f"images need the columns {', '.join(lacking)}")
        return ImageWriter(self.options["path"].rstrip("/"), overwrite)


def save_cell_images(crops: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Writes crops (name, height, width, data, error) below a folder that all executors share: all of them at the end, or none.

    Of a lost or repeated task only the attempt that Spark counts is kept. What
    the driver moves are names: keep a folder to some 100,000 images. Two
    images of one name, or one that is there already (but with overwrite), fail the write.
    """
    crops.sparkSession.dataSource.register(ImageSink)
    crops.select(*COLUMNS).write.format("cell_images").mode("overwrite" if overwrite else "append").save(folder)
