"""Statistics of feature columns and diagonal scaling. Vectors are arrays; statistics go by position."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_position(vectors: DataFrame, column: str, *keep: str) -> DataFrame:
    return vectors.select(*keep, F.posexplode(column).alias("pos", "x"))


def moments(vectors: DataFrame, column: str = "f", *group: str) -> DataFrame:
    """(n, mean, m2) of each position: mergeable, and merged by Spark's partial aggregation."""
    x = F.col("x").cast("double")
    return by_position(vectors, column, *group).groupBy(*group, "pos").agg(F.count("x").alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count("x")).alias("m2"), F.avg(x * x).alias("ms"))


def merge(parts: DataFrame) -> DataFrame:
    """Joins moments (pos, n, mean, m2) of disjoint parts: the pooled mean, and the sums of squares within parts and of the parts' means around
    it. Those are summed up as differences, so that large means with small deviations lose nothing. ``parts`` is read twice."""
    whole = parts.groupBy("pos").agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    own = parts.join(F.broadcast(whole), "pos")  # one row for each position: the length of a vector
    off = F.col("mean") - F.col("_mean")
    return own.groupBy("pos").agg(F.first("_n").alias("n"), F.first("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * off * off).alias("m2"))


def variance(m2: Column, n: Column, ddof: int = 0) -> Column:
    return F.greatest(m2 / F.greatest(n - ddof, F.lit(1)), F.lit(0.0))


def inverse_deviation(vectors: DataFrame, column: str = "f", use_var: bool = True, eps: float = 1e-6) -> DataFrame:
    """(pos, inv): 1 / sqrt(variance + eps), or of the mean square, in single precision."""
    m = moments(vectors, column)
    spread = variance(F.col("m2"), F.col("n")) if use_var else F.col("ms")
    return m.select("pos", (1 / F.sqrt(spread + eps)).cast("float").alias("inv"))


def one_row(table: DataFrame, value: str, name: str) -> DataFrame:
    """A table (pos, value) of one feature vector's length as a single row with an array."""
    return table.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", value))), lambda s: s[value]).alias(name))


def apply_scale(vectors: DataFrame, inverse: DataFrame, column: str = "f", scale: float = 16.0) -> DataFrame:
    """Whole numbers, half to even, within 16 bits: x * inv * scale in single precision. ``inverse`` has one
    row for each position; it is broadcast as one array."""
    inv = F.broadcast(one_row(inverse, "inv", "_inv"))
    value = lambda x, i: F.greatest(F.lit(-32768), F.least(F.lit(32767), F.bround(x.cast("float") * i * F.lit(scale).cast("float")).cast("int")))
    return vectors.crossJoin(inv).withColumn(column, F.zip_with(column, "_inv", value)).drop("_inv")


def grammar_scale(vectors: DataFrame, fit_on: DataFrame, column: str = "f", eps: float = 10.0, factor: float = 32.0, use_var: bool = True) -> DataFrame:
    """x / (sqrt(var + eps) / factor), or x / ((std + eps) / factor), unrounded. ``fit_on`` is the table that
    gives the statistics: the training rows, or the table itself."""
    m = moments(fit_on, column)
    var = variance(F.col("m2"), F.col("n"))
    size = F.sqrt(var + eps) if use_var else F.sqrt(var) + eps
    row = F.broadcast(one_row(m.select("pos", (size / factor).alias("s")), "s", "_s"))
    return vectors.crossJoin(row).withColumn(column, F.zip_with(column, "_s", lambda x, s: x / s)).drop("_s")


def correlated(vectors: DataFrame, column: str = "f", limit: float = 0.99, block: int = 512) -> DataFrame:
    """Pairs of positions (a before b) with an absolute correlation ``r`` above ``limit``. Each task makes the products X'X of its rows, in blocks of
    columns, by matrix products; blocks of all tasks are added up where they meet, one after the other, and only pairs above the
    limit leave them. A task holds one matrix of the vector's length squared. Vectors are taken from the first one, so that large
    means cost no digits. A position that never changes correlates with none; null vectors are left out; no rows give none."""
    own = vectors.where(F.col(column).isNotNull()).select(F.transform(column, lambda v: v.cast("double")).alias("x"))
    first = own.first()
    center = np.array(first.x if first else [], float)
    d = len(center)
    parts = [(i, j) for i in range(0, d, block) for j in range(i, d, block)]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, gram = 0, np.zeros(d), np.zeros((d, d))
        for b in batches:
            for start in range(0, b.num_rows, 1024):
                x = b.column(0).slice(start, 1024).flatten().to_numpy().reshape(-1, d) - center
                n, sums = n + len(x), sums + x.sum(axis=0)
                for i, j in parts:
                    gram[i : i + block, j : j + block] += x[:, i : i + block].T @ x[:, j : j + block]
        square = np.diag(gram)
        for i, j in parts if n else []:
            own = [np.concatenate([[n], sums[i : i + block], sums[j : j + block], square[i : i + block], square[j : j + block], gram[i : i + block, j : j + block].ravel()])]
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([x.tobytes() for x in own], pa.binary())], ["i", "j", "sums"])

    def told(i: int, j: int, total: np.ndarray) -> pa.RecordBatch:
        ni, nj = min(block, d - i), min(block, d - j)
        n, si, sj, qi, qj, gram = np.split(total, np.cumsum([1, ni, nj, ni, nj]))
        vi, vj = qi - si * si / n, qj - sj * sj / n
        scale = np.sqrt(np.maximum(vi, 0))[:, None] * np.sqrt(np.maximum(vj, 0))[None, :]
        fine = (vi > 1e-12 * qi)[:, None] & (vj > 1e-12 * qj)[None, :]
        r = np.where(fine, (gram.reshape(ni, nj) - si[:, None] * sj[None, :] / n) / np.where(fine, scale, 1), 0.0)
        a, b = np.nonzero((np.abs(r) > limit) & (i + np.arange(ni)[:, None] < j + np.arange(nj)[None, :]))
        return pa.RecordBatch.from_arrays([pa.array((i + a).astype(np.int32)), pa.array((j + b).astype(np.int32)), pa.array(r[a, b])], ["a", "b", "r"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for i, j, data in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "sums")), strict=True):
                x = np.frombuffer(data, np.float64)
                if (i, j) == key:
                    total = total + x
                    continue
                if key:
                    yield told(*key, total)
                key, total = (i, j), x
        if key:
            yield told(*key, total)

    blocks = own.mapInArrow(products, "i int, j int, sums binary").repartition("i", "j").sortWithinPartitions("i", "j")
    return blocks.mapInArrow(added, "a int, b int, r double")


def kept_columns(vectors: DataFrame, column: str = "f", least: float = 1e-8, limit: float = 0.99) -> DataFrame:
    """(pos, kept, same_as): which positions of the vectors are worth keeping. Those with a variance of ``least`` or less go, and those
    that correlate beyond ``limit`` with one before them; ``same_as`` is the first such."""
    m = moments(vectors, column)
    twins = correlated(vectors, column, limit).groupBy(F.col("b").alias("pos")).agg(F.min("a").alias("same_as"))
    varies = variance(F.col("m2"), F.col("n")) > least
    return m.select("pos", varies.alias("varies")).join(twins, "pos", "left").select("pos", (F.col("varies") & F.col("same_as").isNull()).alias("kept"), "same_as")
