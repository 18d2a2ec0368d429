"""The perceptron learnt from a stream: its weights are state that goes from one small batch to the next.

Rows are dealt to ``shards`` by a hash of their key. Each shard has its own weights, which Spark keeps in the checkpoint, so a stream that is
started again goes on from there. Within a small batch a shard takes its rows in the order of their keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mosaiq.operators.learn import perceptron_pass

_SHARD = "shard int, seen bigint, w array<bigint>, total array<bigint>"


def learn_online(stream: DataFrame, classes: int, width: int, shards: int = 1, key: str = "img_id", column: str = "f", label: str = "label", step: int = 1, limit: int = 12_000, margin: int = 80) -> DataFrame:
    """A stream of (shard, seen, w, total), a row for each shard that a small batch had rows for: after how many rows, the weights
    and their sum over all rows so far, class after class. Write it in ``update`` mode. A row without a label or vector is left out."""
    rows = stream.where(F.col(label).isNotNull() & F.col(column).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"), F.transform(column, lambda v: v.cast("bigint")).alias("f"))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))

    def go_on(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, w, total = state.get if state.exists else (0, [0] * (classes * width), [0] * (classes * width))
        own = pd.concat(list(batches)).sort_values("key", kind="stable")  # one shard's part of one small batch
        w, total = (np.array(a, np.int64).reshape(classes, width) for a in (w, total))
        w, more, n = perceptron_pass([own], w, step, limit, margin)
        state.update((seen + n, w.ravel().tolist(), (total + more).ravel().tolist()))
        yield pd.DataFrame({"shard": [int(group[0])], "seen": [seen + n], "w": [w.ravel().tolist()], "total": [(total + more).ravel().tolist()]})

    return dealt.groupBy("shard").applyInPandasWithState(go_on, _SHARD, "seen bigint, w array<bigint>, total array<bigint>", "update", GroupStateTimeout.NoTimeout)


def latest_weights(updates: DataFrame, classes: int) -> DataFrame:
    """(label, w), as the batch learner gives it, from all that ``learn_online`` has written: the floor of the mean over all rows of all shards."""
    last = updates.groupBy("shard").agg(F.max_by(F.struct("seen", "total"), "seen").alias("s")).select("shard", "s.seen", F.posexplode("s.total").alias("pos", "v"))
    width = F.max("pos").over(_everything()) + 1
    each = last.withColumn("width", (width / classes).cast("int"))
    summed = each.groupBy(F.floor(F.col("pos") / F.col("width")).cast("int").alias("label"), F.pmod(F.col("pos"), F.col("width")).alias("at")).agg(F.floor(F.sum("v") / F.sum("seen")).alias("v"))
    return summed.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("w"))


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))
