"""Mixing sources to target weights by proportionate fair (Pfair) scheduling.

Each source is a task, each block of its documents a job. Block k of a source with weight w is released
at floor(k/w) and due at ceil((k+1)/w), exactly, in whole numbers; the earliest deadline goes first, so that at every slot
each source is less than one block off its target.

The stream is cut into segments that Spark schedules at the same time. At a cut every source has had floor or ceil of its share: those
whose next blocks are due first have had the larger. Not at every slot can that be so with all windows kept; the next slot where it can is
taken, by the condition of Hall for the blocks of both sides. Between two such cuts earliest deadline first then meets every deadline.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import cut, numbered, ordered, small, text_key


def _named(value: Column) -> Column:
    """A value as text, so that null differs from every value."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def row_key(doc_id: str, text: str, source: str) -> Column:
    """16 bytes that stand for the id, the source and the text of a row."""
    return F.unhex(F.md5(F.concat(F.md5(_named(F.col(doc_id))), F.md5(_named(F.col(source))), F.hex(text_key(text)))))


def whole_weights(weights: list[float]) -> tuple[list[int], int]:
    """Whole numbers in exactly the proportion of ``weights``, and their sum."""
    exact = [Fraction(w) for w in weights]
    base = lcm(*[w.denominator for w in exact]) if exact else 1
    out = [int(w * base) for w in exact]
    return out, sum(out)


def counts_at(w: list[int], total: int, slot: int) -> list[int]:
    """How many blocks each source has had before ``slot`` if a cut is there: floor of its share, and one more for those whose next blocks
    are due first, of several the first source."""
    k = [x * slot // total for x in w]
    due = sorted((-(-(k[i] + 1) * total // x), i) for i, x in enumerate(w) if x * slot % total)
    for _, i in due[: slot - sum(k)]:
        k[i] += 1
    return k


def can_cut(w: list[int], total: int, slot: int, done: list[int]) -> bool:
    """Whether all windows can be kept on both sides of ``slot`` with ``done`` blocks before it: no stretch that begins or ends there has more
    blocks to hold than slots. Only stretches that end before the deadline of a block that is done already, or begin after the release
    of one that is not, can have."""
    end = max((-(-done[i] * total // x) for i, x in enumerate(w) if done[i] * total > x * slot), default=slot)
    start = min((done[i] * total // x for i, x in enumerate(w) if done[i] * total < x * slot), default=slot)
    dues = {-(-(k + 1) * total // x) for i, x in enumerate(w) for k in range(done[i], x * end // total)}
    releases = {k * total // x for i, x in enumerate(w) for k in range(-(-x * start // total), done[i])}
    return all(sum(max(0, x * t // total - d) for x, d in zip(w, done, strict=True)) <= t - slot for t in dues) and all(sum(max(0, d + -x * t // total) for x, d in zip(w, done, strict=True)) <= slot - t for t in releases)


def cuts(w: list[int], total: int, end: int, segment: int) -> list[tuple[int, list[int]]]:
    """Slots about ``segment`` apart where the stream is cut, and the blocks each source has had there; the first is 0."""
    out, slot = [(0, [0] * len(w))], segment
    while slot < end:
        done = counts_at(w, total, slot)
        if can_cut(w, total, slot, done):
            out.append((slot, done))
            slot += segment
        else:
            slot += 1
    return out


def one_segment(w: list[int], total: int, start: int, stop: int, first: list[int], last: list[int] | None) -> Iterator[tuple[int, int, int]]:
    """(source, block, slot) for the slots from ``start`` to ``stop``: earliest deadline first among the released blocks from ``first`` on, to ``last``
    if the stream is cut at ``stop``. Ties: the first source."""
    done, ready = list(first), []
    waiting = [(max(start, done[i] * total // x), i) for i, x in enumerate(w) if last is None or done[i] < last[i]]
    heapq.heapify(waiting)
    for slot in range(start, stop):
        while waiting and waiting[0][0] <= slot:
            i = heapq.heappop(waiting)[1]
            due = -(-(done[i] + 1) * total // w[i])
            heapq.heappush(ready, (due if last is None else min(due, stop), i))
        due, i = heapq.heappop(ready)
        if slot >= due:
            raise AssertionError("a deadline is missed")
        yield i, done[i], slot
        done[i] += 1
        if last is None or done[i] < last[i]:
            heapq.heappush(waiting, (max(slot + 1, done[i] * total // w[i]), i))


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.8, block_rows: int = 16, segment: int = 1 << 14, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Where each document stands in the mixed stream: doc_id, source, row_key, copy, block, place (in its
    block), epoch and slot (of its block). ``weights`` are targets by source; without them they are
    the sources' document counts to the power ``alpha``. The stream ends when every document has
    been placed once; sources that run out start over, so nothing is dropped. A source that
    ``weights`` doesn't name, or gives no weight, gets the least of the given ones.

    Rows of equal source, id and text are documents of their own, told apart by ``copy`` (0, 1, ...). A null source is
    a source of its own, a null text counts as an empty one, null ids are ids like others. An empty table gives an
    empty result. Segments of about ``segment`` slots are scheduled each by a task; the driver holds the sources and the cuts."""
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).alias("doc_id"), _named(F.col(source)).alias("source"), row_key(doc_id, text, source).alias("row_key"))
    own = ordered(own, ["source", "row_key"])
    counts = dict(sorted((r[0], r[1]) for r in own.groupBy("source").count().toLocalIterator()))
    if weights is None:
        target = {k: n**alpha for k, n in counts.items()}
    else:
        least = min((w for w in weights.values() if w > 0), default=1.0)
        target = {k: weights.get(k[1:] if k else None) or least for k in counts}
        target = {k: w if w > 0 else least for k, w in target.items()}
    names, blocks = list(counts), [-(-n // block_rows) for n in counts.values()]
    w, total = whole_weights(list(target.values()))
    end = max((-(-b * total // x) for b, x in zip(blocks, w, strict=True)), default=0)  # the last block of each source is due by then
    at = cuts(w, total, end, segment) if names else []
    parts = [(slot, at[i + 1][0] if i + 1 < len(at) else end, done, at[i + 1][1] if i + 1 < len(at) else None) for i, (slot, done) in enumerate(at)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start, stop, first, last in b.itertuples(index=False, name=None):
                whole = lambda counts: None if counts is None else [int(n) for n in counts]  # noqa: E731  not NumPy's numbers, which overflow
                made = list(one_segment(w, total, int(start), int(stop), whole(first), whole(last)))
                i, k, slot = zip(*made, strict=True)
                yield pd.DataFrame({"source": [names[x] for x in i], "block": [n % blocks[x] for x, n in zip(i, k, strict=True)], "epoch": [n // blocks[x] for x, n in zip(i, k, strict=True)], "slot": slot, "last": [n == blocks[x] - 1 for x, n in zip(i, k, strict=True)]})

    segments = spark.createDataFrame(parts, "start long, stop long, first array<long>, last array<long>")
    plan = cut(segments.repartition(max(1, len(parts)), "start").mapInPandas(run, "source string, block long, epoch long, slot long, last boolean"))
    stop = plan.where("last").agg(F.max("slot")).first()[0]
    plan = plan.where(F.col("slot") <= (-1 if stop is None else stop)).select(F.col("source").alias("p_source"), F.col("block").alias("p_block"), "epoch", "slot")
    ranked = numbered(own, ["source"], "rank")
    repeated = ranked.groupBy("row_key").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    ranked = ranked.join(small(cut(repeated), 64), "row_key", "left").withColumn("copy", F.coalesce(F.col("rank") - F.col("first"), F.lit(0)))
    ranked = ranked.withColumns({"block": F.floor(F.col("rank") / block_rows), "place": (F.col("rank") % block_rows).cast("int")})
    placed = ranked.join(small(plan, 96), (F.col("source") == F.col("p_source")) & (F.col("block") == F.col("p_block")))
    name = F.when(F.col("source") != "", F.expr("substring(source, 2)"))
    return placed.select("doc_id", name.alias("source"), "row_key", "copy", "block", "place", F.col("epoch").cast("int").alias("epoch"), "slot")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``docs`` in the order of the mixed stream, rows of sources below their target repeated; all columns stay as they are,
    whatever their names. Nulls, repeated rows and an empty table as in ``schedule``: every row is there at least once."""
    plan = cut(schedule(docs, weights, doc_id=doc_id, text=text, source=source, **options)).select(F.col("row_key").alias("key"), "copy", "slot", "place")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key(doc_id, text, source).alias("key"))
    twice = cut(plan.where("copy > 0").select("key").distinct())
    if twice.isEmpty():
        placed = rows.join(plan, "key")
    else:
        twice = small(twice, 40)
        again = numbered(cut(rows.join(twice, "key", "left_semi")), ["key"], "copy").join(plan, ["key", "copy"])
        placed = rows.join(twice, "key", "left_anti").join(plan, "key").unionByName(again.select("key", "row", "copy", "slot", "place"))
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartitionByRange(n, "slot", "place").sortWithinPartitions("slot", "place").select("row.*")
