"""Pickled image batches as a Spark data source: ``spark.read.format("image_batches").load(path)``.

A file is read by several tasks, each of which makes rows of its own range of the file's images. Only the columns of the given schema
are made (``spark.read.schema("img_id bigint, label int")``). The options ``split`` and ``labels`` choose before reading: files of the other split
are not opened, and images of other labels are not unpacked. (Filters are not pushed down by themselves: Spark 4.1 keeps what one query pushed
into a Python source for the next query on the same DataFrame, which then misses rows.) Paths are what
Arrow's file systems open: local and mounted folders, HDFS, S3. For stores that only Spark reads there is ``images.read_batches``."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from mosaiq.sources.images import SCHEMA, _Plain

#: Images of 3,072 bytes that a task unpacks at once.
AT_ONCE = 1024


def _files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all files of a folder but hidden ones."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    found = system.get_file_info(inner)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    every = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner))
    return sorted((f.path, f.size) for f in every if f.type == fs.FileType.File and f.base_name[0] not in "._")


def _open(path: str, inner: str) -> io.BufferedIOBase:
    from pyarrow import fs

    system = fs.FileSystem.from_uri(path)[0] if "://" in path else fs.LocalFileSystem()
    return system.open_input_file(inner)


def split_of(name: str) -> str:
    return "test" if name.rsplit("/", 1)[-1].startswith("test") else "train"


@dataclass
class Part(InputPartition):
    """The ``index``-th of ``parts`` equal ranges of a file's images."""

    file: str
    index: int
    parts: int


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.path, self.names = options["path"], schema.names
        self.bytes = int(options.get("bytespertask", 8 << 20))
        self.split = options.get("split")
        self.labels = [int(x) for x in options["labels"].split(",")] if "labels" in options else None

    def partitions(self) -> list[Part]:
        files = [f for f in _files(self.path) if self.split in (None, split_of(f[0]))]
        return [Part(name, i, parts) for name, size in files for parts in [max(1, -(-size // self.bytes))] for i in range(parts)]

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file is left
            return
        with _open(self.path, partition.file) as f:
            raw = {k.decode() if isinstance(k, bytes) else k: v for k, v in _Plain(io.BytesIO(f.read()), encoding="bytes").load().items()}
        data, labels = np.asarray(raw["data"]), np.asarray(raw["labels"] if "labels" in raw else raw["fine_labels"], np.int32)
        base = partition.file.rsplit("/", 1)[-1]
        number = int("".join(c for c in base if c.isdigit()) or 0)
        low, high = (len(data) * k // partition.parts for k in (partition.index, partition.index + 1))
        for start in range(low, high, AT_ONCE):
            at = np.arange(start, min(high, start + AT_ONCE))
            if self.labels is not None:
                at = at[np.isin(labels[at], self.labels)]
            if len(at):
                yield self._rows(data, labels, at, number, split_of(base))

    def _rows(self, data: np.ndarray, labels: np.ndarray, at: np.ndarray, number: int, split: str) -> pa.RecordBatch:
        made = []
        for name in self.names:
            if name in ("r", "g", "b"):
                c = "rgb".index(name)
                plane = pa.array(data[at, c * 1024 : (c + 1) * 1024].astype(np.int32).ravel())
                made.append(pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * 1024), plane))
            else:
                made.append({"img_id": lambda: pa.array(number * 1_000_000 + at), "label": lambda: pa.array(labels[at]), "split": lambda: pa.array([split] * len(at))}[name]())
        return pa.RecordBatch.from_arrays(made, self.names)


class ImageBatches(DataSource):
    """Options: ``path``; ``bytesPerTask``, how much of a file a task reads (8 MB); ``split``, train or test; ``labels``, numbers with commas between."""

    @classmethod
    def name(cls) -> str:
        return "image_batches"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        known = dict(x.split(" ") for x in SCHEMA.split(", "))
        for f in schema:
            if known.get(f.name) != f.dataType.simpleString():
                raise ValueError(f"no column {f.name} {f.dataType.simpleString()}; there are: {SCHEMA}")
        return _Reader(schema, {k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ImageBatches)
