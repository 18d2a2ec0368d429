"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosines, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import components, cut

#: Vectors compared together at most, on each side.
BLOCK = 1024


def signs(vectors: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    """One bucket number for each vector and table: on which sides of random hyperplanes it lies."""
    planes = np.random.default_rng(seed).standard_normal((vectors.shape[1], tables * bits))
    sides = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return (sides * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)


def linked(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of rows of ``x`` and ``y`` (of length 1) with cosine ``least`` or more."""
    return np.nonzero(x @ y.T >= least)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal ``keys`` in sorted batches, also those that go on in the next batch."""
    held: list[pa.Table] = []
    for b in batches:
        t = pa.Table.from_batches([*[x for h in held for x in h.to_batches()], b]).combine_chunks()
        new = np.zeros(len(t), bool)
        for k in keys:
            v = t[k].combine_chunks().to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        starts = [0, *np.flatnonzero(new).tolist()]
        for i, j in zip(starts, starts[1:], strict=False):
            yield t.slice(i, j - i)
        held = [t.slice(starts[-1])] if len(t) else []
    yield from held


def _matrix(t: pa.Table, name: str) -> np.ndarray:
    return t[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)


def _compare(t: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The links of one pair of blocks, each counted only in the first table that has both vectors in
    one bucket: the places of the vectors that link, the number of vectors (with their copies) that each links
    to, and the place of the least vector of its component here."""
    table, left, right = (t[k][0].as_py() for k in ("table", "i", "j"))
    v = _matrix(t, "vector").astype(np.float64)
    v /= np.abs(v).max(axis=1)[:, None]  # squares of large components would overflow
    v /= np.sqrt((v * v).sum(axis=1))[:, None]
    buckets, block = _matrix(t, "buckets")[:, :table], t["block"].to_numpy()
    one = np.flatnonzero(block == left)
    two = np.flatnonzero(block == right)
    p, q = linked(v[one], v[two], least)
    p, q = one[p], two[q]
    if left == right:
        p, q = p[p < q], q[p < q]
    step = 1 << 16
    new = [~(buckets[p[a : a + step]] == buckets[q[a : a + step]]).any(axis=1) for a in range(0, len(p), step)]
    if not new:
        return None
    new = np.concatenate(new)
    p, q = p[new], q[new]
    if not len(p):
        return None
    copies, n = t["copies"].to_numpy(), len(t)
    links = (np.bincount(p, weights=copies[q], minlength=n) + np.bincount(q, weights=copies[p], minlength=n)).astype(np.int64)
    root = np.arange(n)
    while True:  # least place among neighbours, then of that one, until nothing changes
        before = root.copy()
        np.minimum.at(root, p, root[q])
        np.minimum.at(root, q, root[p])
        root = root[root]
        if (root == before).all():
            break
    own = np.flatnonzero(links)
    return own, links[own], root[own]


def near_vectors(rows: DataFrame, least: float = 0.98, tables: int = 32, bits: int = 20, seed: int = 11, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row. Vectors of one label link if their cosine is
    ``least`` or more. Rows of equal vector and label are one node with a count, so copies are not
    compared. Nodes that share a bucket in some table are compared exactly, in double precision, in
    blocks of about ``BLOCK``: a large bucket becomes many tasks, and no pair is emitted.

    With the defaults a pair at cosine 0.98 shares a bucket with a probability above 0.9999. Vectors that
    are null, empty, zero, or hold null or non-finite components, and null labels, link with nothing;
    vectors of different lengths don't link. ``component_id`` is the least vec_id of the component; a
    null vec_id is kept as a row, and is its own component if no other id is there."""
    own_type = rows.schema[vector].dataType.simpleString()
    value = F.col(vector) if own_type == "array<float>" else F.col(vector).cast("array<double>")
    all_rows = cut(rows.select(F.col(vec_id).alias("vec_id"), value.alias("vector"), F.col(label).alias("label"), F.monotonically_increasing_id().alias("row")))
    fine = F.col("label").isNotNull() & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False)) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    tidy = F.transform("vector", lambda x: x + F.lit(0.0))  # -0.0 becomes 0.0
    keyed = all_rows.where(fine).withColumn("node", F.unhex(F.md5(F.concat_ws(",", F.col("label").cast("string"), tidy.cast("string")))))
    nodes = cut(keyed.groupBy("node").agg(F.first("vector").alias("vector"), F.first("label").alias("label"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id")))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for size, part in b.groupby(b["vector"].map(len)):
                v = np.stack(part["vector"].to_numpy()).astype(np.float64)
                v = v / np.abs(v).max(axis=1)[:, None]
                yield part[["node", "label", "copies", "vector"]].assign(size=size, buckets=list(signs(v, tables, bits, seed)))

    kind, own_type = (nodes.schema[k].dataType.simpleString() for k in ("label", "vector"))
    own = cut(nodes.select("node", "label", "copies", "vector").mapInPandas(hashed, f"node binary, label {kind}, copies long, vector {own_type}, size int, buckets array<int>"))
    flat = own.select("node", F.posexplode("buckets").alias("table", "bucket"), F.xxhash64("label", "size", "table", "bucket").alias("place"), F.col("label").cast("string").alias("kind"), "size")
    full = flat.groupBy("table", "place").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # places are hashes: whatever else meets there is parted by label and size before it is compared
    met = flat.join(full, ["table", "place"]).withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
    met = met.withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    group = ["table", "place", "i", "j"]
    blocks = met.select("*", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).select("node", *group, "kind", "size", "block")
    alike = [*group, "kind", "size"]
    work = blocks.join(own.select("node", "copies", "vector", "buckets"), "node").repartition(*group).sortWithinPartitions(*alike, "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, alike):
            if (got := _compare(t, least)) is not None:
                nodes_at = t["node"].combine_chunks()
                yield pa.RecordBatch.from_arrays([nodes_at.take(pa.array(got[0])), pa.array(got[1]), nodes_at.take(pa.array(got[2]))], ["node", "links", "root"])

    found = work.mapInArrow(compare, "node binary, links long, root binary")
    found = cut(found)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    group = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    state = nodes.select("node", "copies", "first_id").join(links, "node", "left").join(group, "node", "left").withColumn("root", F.coalesce("root", "node"))
    state = cut(state)
    ids = state.groupBy("root").agg(F.min("first_id").alias("component_id"))
    state = cut(state.join(ids, "root").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    good = keyed.select("vec_id", "node").join(state, "node").select("vec_id", "n_links", "component_id")
    alone = all_rows.where(~F.coalesce(fine, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
