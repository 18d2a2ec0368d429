"""A cache of feature tables by configuration and input."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.operators.scaling import apply_scale


def short_hash(value) -> str:
    """A name of 16 hex digits for a configuration: two checksums, of its JSON with sorted keys and of that reversed."""
    text = json.dumps(value, sort_keys=True).encode()
    return f"{zlib.crc32(text):08x}{zlib.crc32(text[::-1]):08x}"


def fingerprint(rows: DataFrame) -> dict:
    """Count and order-free hash of the rows, so that other input is not taken for the cached one."""
    n, h = rows.select(F.xxhash64(*rows.columns).alias("h")).agg(F.count(F.lit(1)), F.bit_xor("h")).first()
    return {"rows": n, "hash": h}


def cached(rows: DataFrame, build: Callable[[DataFrame], DataFrame], folder: str, tag: str, config: dict, force: bool = False) -> DataFrame:
    """``build(rows)``, read from ``folder`` if the same configuration and input were built before. The manifest
    is written last: without it the features are built anew."""
    spark = rows.sparkSession
    about = {"config": config, "tag": tag, "input": fingerprint(rows)}
    path = f"{folder}/{tag}_{short_hash(about)}"
    try:
        if not force and json.loads(spark.read.text(f"{path}.manifest").first()[0]) == about:
            return spark.read.parquet(f"{path}.parquet")
    except (AnalysisException, TypeError):
        pass  # not there, or empty
    build(rows).write.mode("overwrite").parquet(f"{path}.parquet")
    spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.manifest")
    return spark.read.parquet(f"{path}.parquet")


def scaled_path(path: str, use_var: bool, eps: float, scale: float) -> str:
    """Where a scaled copy goes; unlike a name with whole numbers, 16.0 and 16.5 differ."""
    return f"{path}_diag{int(use_var)}_eps{eps!r}_s{scale!r}"


def write_scaled(vectors: DataFrame, inverse: DataFrame, path: str, scale: float = 16.0, column: str = "f") -> DataFrame:
    """Writes ``vectors`` scaled by ``inverse`` (pos, inv) to ``path``, in place of what is there, and reads them back."""
    apply_scale(vectors, inverse, column, scale).write.mode("overwrite").parquet(f"{path}.parquet")
    return vectors.sparkSession.read.parquet(f"{path}.parquet")
