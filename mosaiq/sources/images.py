"""Sources of images: (img_id, label, split, r, g, b), each plane an array of 1024 values."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "img_id bigint, label int, split string, r array<int>, g array<int>, b array<int>"
#: Images drawn at once.
AT_ONCE = 128


def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Images of rows (vec_id, label, embedding), ``AT_ONCE`` in a batch at most, whatever the batches that come."""
    y, x = np.divmod(np.arange(1024), 32)
    for whole in batches:
        for start in range(0, whole.num_rows, AT_ONCE):
            b = whole.slice(start, AT_ONCE)
            ids = b.column("vec_id").to_numpy()
            blobs = b.column("embedding").flatten().to_numpy().reshape(len(ids), 64).astype(np.float64)
            planes = []
            for c in range(3):
                v = np.floor(128 + 400 * blobs[:, (8 * (y // 4) + x // 4 + 21 * c) % 64])
                p = np.clip(v + np.fmod(ids[:, None] * 17 + y * 7 + x * 13 + c * 29, 41) - 20, 0, 255).astype(np.int32)
                planes.append(pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * 1024), pa.array(p.ravel())))
            split = pa.array(np.where(ids % 5 == 0, "test", "train"))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), split, *planes], ["img_id", "label", "split", "r", "g", "b"])


def derived_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image for each row of ``embeddings``: blobs of 8 by 8 from its 64 values, turned for each colour, and a
    pattern of the id. Every fifth is a test image."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    return rows.mapInArrow(drawn, SCHEMA)


class _Plain(pickle.Unpickler):
    """Reads arrays and built-in values, nothing else."""

    _ALLOWED = {("numpy", "ndarray"), ("numpy", "dtype"), ("numpy.core.multiarray", "_reconstruct"), ("numpy._core.multiarray", "_reconstruct"), ("numpy.core.multiarray", "scalar"), ("numpy._core.multiarray", "scalar"), ("_codecs", "encode")}

    def find_class(self, module: str, name: str):
        if (module, name) not in self._ALLOWED:
            raise pickle.UnpicklingError(f"{module}.{name} is not allowed in an image batch")
        return super().find_class(module, name)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Images from pickled batch files: a dict with ``data`` (rows of 3072 bytes, one plane after the other) and
    ``labels`` or ``fine_labels``. Files named test_* are the test split. One task reads a file."""
    import io

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                raw = {k.decode() if isinstance(k, bytes) else k: v for k, v in _Plain(io.BytesIO(content), encoding="bytes").load().items()}
                data = np.asarray(raw["data"]).astype(np.int32)
                labels = raw["labels"] if "labels" in raw else raw["fine_labels"]
                base = name.rsplit("/", 1)[-1]
                number = int("".join(c for c in base if c.isdigit()) or 0)
                yield pd.DataFrame({"img_id": number * 1_000_000 + np.arange(len(data)), "label": np.asarray(labels, np.int32), "split": "test" if base.startswith("test") else "train", **{k: list(data[:, c * 1024 : (c + 1) * 1024]) for c, k in enumerate("rgb")}})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, SCHEMA)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Parquet of the image schema, or pickled batches."""
    if path.endswith(".parquet"):
        return spark.read.schema(SCHEMA).parquet(path)
    return read_batches(spark, path)
