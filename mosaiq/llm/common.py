"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

#: ASCII white space; what lies between is a word.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Without one, a session on a single machine (``local[n]``, as in tests)
    gets a temporary folder; on a cluster that is an error, as executors would not share it."""
    context, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if named is None and context.getCheckpointDir() is None and not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named or tempfile.mkdtemp())
    return named or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and reads it from there: cuts the lineage and
    survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """For what an operator needs only until its result is written: gives a function that writes a DataFrame as
    compressed Parquet to the shared folder and reads it back, like ``cut``; all of it is deleted at the end."""
    folder = f"{shared_folder(spark)}/work-{uuid.uuid4().hex}"

    def keep(df: DataFrame) -> DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        delete(spark, folder)


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared storage, whatever file system that is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Frees the shuffle files of jobs that are over. Spark removes them when the driver's JVM finds that nothing
    refers to them any more; this asks it to look now, not when its heap happens to fill, and gives its cleaner, which
    works on the side, a moment."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def give_back() -> None:
    """Returns what a batch has freed to the system. Python workers live on from stage to stage, and else keep their
    largest batch's memory beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def text_key(text: Column | str) -> Column:
    """16 bytes that stand for a text; a null text counts as an empty one."""
    return F.unhex(F.md5(F.coalesce(_col(text), F.lit(""))))


def words(text: Column | str) -> Column:
    """The words of a text as an array; none for a null."""
    return F.filter(F.split(F.coalesce(_col(text), F.lit("")), SPACE), lambda w: w != "")


def id_crc(doc_id: Column | str) -> Column:
    """CRC-32 of an id written as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(_col(doc_id).cast("string"), F.lit("")).cast("binary"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row."""
    return F.get(F.transform(F.array(value), body), 0)


def numbered(df: DataFrame, group: list[str], name: str) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... within each group, gapless, in the order of the rows of ``df``,
    which must read from stable storage (``cut``). A group of any size is numbered in parallel:
    each input partition numbers its own rows, and a table of counts gives the offsets; it is
    broadcast if its counted size is small, else joined by a shuffle. No nulls in ``group``."""
    counts = df.groupBy(F.spark_partition_id().alias("_pid"), *group).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(counts.select("_pid", *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from")))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        for b in batches:
            own = np.zeros(b.num_rows, np.int64)
            for g in group:  # by Arrow: the hash tables of pandas end a text at a zero character
                coded = b.column(g).dictionary_encode()
                own = np.unique(own * (len(coded.dictionary) + 1) + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            order = np.argsort(own, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(own[order]) > 0))[: b.num_rows]
            sizes = np.diff(np.append(first, b.num_rows))
            keys = list(zip(*[b.column(g).take(pa.array(order[first])).to_pylist() for g in group], strict=True))
            full = np.empty(b.num_rows, np.int64)
            full[order] = np.arange(b.num_rows) + np.repeat(np.array([seen.get(k, 0) for k in keys], np.int64) - first, sizes)
            for k, n in zip(keys, sizes.tolist(), strict=True):
                seen[k] = seen.get(k, 0) + n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(full)], [*b.schema.names, "_rank"])

    schema = StructType([*df.schema.fields, StructField("_pid", IntegerType()), StructField("_rank", LongType())])
    own = df.withColumn("_pid", F.spark_partition_id()).mapInArrow(number, schema)  # not the task's number, which another plan around it changes
    same = [own["_pid"] == starts["_pid"]] + [own[g] == starts[f"_g{i}"] for i, g in enumerate(group)]
    out = own.join(small(starts, 64), same, "inner")
    return out.select(*[own[c] for c in df.columns], (F.col("_rank") + F.col("_from")).cast("long").alias(name))


def ordered(df: DataFrame, by: list[str]) -> DataFrame:
    """The rows sorted over all partitions by ``by``, ties in any order, on stable storage."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut(df.repartitionByRange(n, *by).sortWithinPartitions(*by))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (node, root) for each node, root the least
    node that it can reach. No edges give no rows; loops and nulls are left out.

    First each node keeps its least smaller neighbour only, and its other smaller neighbours are linked with
    that one, until every node has one: a forest. A node's smaller neighbours are sorted and streamed, and a
    root with very many nodes below it is no key of that exchange. Then each node's parent becomes its parent's
    parent until nothing moves; rows of one parent are split over tasks by the adaptive join."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = least = last = None
        told: set[tuple] = set()  # links between smaller neighbours come again and again: each once, mostly
        for b in batches:
            out = []
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if x != u:
                    u, least, last = x, y, y
                    out.append((x, y, False))
                elif y != last:
                    last = y
                    if (y, least) not in told:
                        told.add((y, least))
                        out.append((y, least, True))
            if len(told) > 1 << 18:
                told.clear()
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in ((0, b.schema.types[0]), (1, b.schema.types[1]), (2, pa.bool_()))], ["u", "v", "open"])

    kind = edges.schema["a"].dataType.simpleString()
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    while True:
        now = cut(now.repartition("u").sortWithinPartitions("u", "v").mapInArrow(contract, f"u {kind}, v {kind}, open boolean"))
        if now.where("open").isEmpty():
            break
        now = now.select("u", "v")
    now = now.select("u", "v")
    while True:
        up = now.select(F.col("u").alias("p"), F.col("v").alias("pp"))
        now = cut(now.join(up, F.col("v") == F.col("p"), "left").select("u", F.coalesce("pp", "v").alias("v"), F.col("pp").isNotNull().alias("open")))
        if now.where("open").isEmpty():
            break
        now = now.select("u", "v")
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def fits_broadcast(df: DataFrame, row_bytes: int, limit: int = 16 << 20) -> bool:
    """Whether ``df``, counted now, stays under ``limit`` bytes; callers shuffle if it does not."""
    return df.count() * row_bytes <= limit


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted size allows it, else unchanged."""
    return F.broadcast(df) if fits_broadcast(df, row_bytes) else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
