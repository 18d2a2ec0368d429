"""Best-fit-decreasing bin packing of indivisible groups of documents into shards.

Groups of equal texts never part. Best-fit-decreasing handles groups by falling size, and groups of
one size are alike, so the packing needs only how many groups there are of each size. That table has
at most sqrt(2 * total bytes) rows; the driver packs it, and Spark gives every group its shard.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import cut, numbered, small, text_key


@dataclass
class _Node:
    key: tuple[int, int]
    left: _Node | None = None
    right: _Node | None = None
    height: int = 1


@dataclass
class Bins:
    """Open bins in an AVL tree by (room left, bin): the tightest bin for a size is found in log time."""

    root: _Node | None = field(default=None)

    def tightest(self, size: int) -> tuple[int, int] | None:
        at, best = self.root, None
        while at:
            if at.key[0] >= size:
                best, at = at.key, at.left
            else:
                at = at.right
        return best

    def add(self, key: tuple[int, int]) -> None:
        self.root = _add(self.root, key)

    def remove(self, key: tuple[int, int]) -> None:
        self.root = _remove(self.root, key)


def _h(n: _Node | None) -> int:
    return n.height if n else 0


def _fixed(n: _Node) -> _Node:
    n.height = 1 + max(_h(n.left), _h(n.right))
    lean = _h(n.left) - _h(n.right)
    if lean > 1:
        if _h(n.left.left) < _h(n.left.right):
            n.left = _turn(n.left, "right", "left")
        return _turn(n, "left", "right")
    if lean < -1:
        if _h(n.right.right) < _h(n.right.left):
            n.right = _turn(n.right, "left", "right")
        return _turn(n, "right", "left")
    return n


def _turn(n: _Node, up: str, down: str) -> _Node:
    top = getattr(n, up)
    setattr(n, up, getattr(top, down))
    setattr(top, down, n)
    for x in (n, top):
        x.height = 1 + max(_h(x.left), _h(x.right))
    return top


def _add(n: _Node | None, key: tuple[int, int]) -> _Node:
    if n is None:
        return _Node(key)
    if key < n.key:
        n.left = _add(n.left, key)
    else:
        n.right = _add(n.right, key)
    return _fixed(n)


def _remove(n: _Node | None, key: tuple[int, int]) -> _Node | None:
    if n is None:
        return None
    if key < n.key:
        n.left = _remove(n.left, key)
    elif key > n.key:
        n.right = _remove(n.right, key)
    elif n.left is None or n.right is None:
        return n.left or n.right
    else:
        least = n.right
        while least.left:
            least = least.left
        n.key, n.right = least.key, _remove(n.right, least.key)
    return _fixed(n)


def pack_sizes(counts: list[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit-decreasing of ``counts`` (size, groups of it). Returns the number of bins and rows
    (size, first rank, end rank, first bin, groups in each bin): the groups of a size with ranks
    from first to end fill bins from the first one on, so many in each. A group larger than the
    capacity gets a bin of its own."""
    bins, n, plan = Bins(), 0, []
    for size, left in sorted(counts, reverse=True):
        rank = 0
        while left and (best := bins.tightest(size)):
            take = min(left, best[0] // size)
            bins.remove(best)
            bins.add((best[0] - take * size, best[1]))
            plan.append((size, rank, rank + take, best[1], take))
            rank, left = rank + take, left - take
        if left:
            each = max(1, capacity // size)
            plan.append((size, rank, rank + left, n, each))
            while left > 0:
                bins.add((max(0, capacity - min(left, each) * size), n))
                n, left = n + 1, left - each
    return plan, n


def capacity_for(counts: list[tuple[int, int]], shards: int) -> int:
    """A least capacity with which the groups need no more than ``shards`` bins: from the even share up in growing steps until one
    does, then by bisection. Many small groups fill bins to a byte or so, so that the first steps mostly do."""
    if not counts:
        return 1
    total, largest = sum(s * n for s, n in counts), max(s for s, _ in counts)
    low = high = max(-(-total // shards), largest)
    step = 1
    while pack_sizes(counts, high)[1] > shards:
        low, high, step = high + 1, high + step, step * 2
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if pack_sizes(counts, middle)[1] <= shards else (middle + 1, high)
    return low


def pack_shards(counts: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """A plan like that of ``pack_sizes`` for so many shards. A group larger than the even share has a shard of
    its own, and the others are packed into the remaining shards with the least capacity for them alone."""
    left, plan, alone, given = dict(counts), [], 0, {}
    total = sum(s * n for s, n in counts)
    while left and shards - alone > 1 and (size := max(left)) * (shards - alone) > total:
        rank = given.get(size, 0)
        plan.append((size, rank, rank + 1, alone, 1))
        given[size], alone, total = rank + 1, alone + 1, total - size
        left[size] -= 1
        if not left[size]:
            del left[size]
    rest = list(left.items())
    for size, start, end, first, each in pack_sizes(rest, capacity_for(rest, shards - alone))[0]:
        past = given.get(size, 0)
        plan.append((size, start + past, end + past, first + alone, each))
    return plan


def shard_documents(docs: DataFrame, shards: int | None = 8, capacity: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document with its shard and its slot there. Give ``capacity`` in bytes to have as few
    shards as best-fit-decreasing needs, or ``shards`` to have so many of the least capacity, but for groups larger than the even share.

    A document's size is the UTF-8 bytes of its text plus 1. Null texts count as empty ones and are
    one group with them; null and repeated ids are kept as rows of their own; an empty table gives
    an empty result. Columns of ``docs`` other than the two named are not read."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), text_key(text).alias("group_key")))
    groups = cut(rows.groupBy("group_key").agg(F.sum("size").alias("group_size")))
    counts = [(r[0], r[1]) for r in groups.groupBy("group_size").count().toLocalIterator()]
    plan = pack_sizes(counts, capacity)[0] if capacity else pack_shards(counts, shards)
    planned = spark.createDataFrame(plan, "p_size long, p_from long, p_to long, p_bin long, p_each long")
    ranked = numbered(groups, ["group_size"], "rank")
    fits = (F.col("group_size") == F.col("p_size")) & (F.col("rank") >= F.col("p_from")) & (F.col("rank") < F.col("p_to"))
    shard = F.col("p_bin") + F.floor((F.col("rank") - F.col("p_from")) / F.col("p_each"))
    placed = ranked.join(small(planned, 64), fits).select("group_key", shard.cast("int").alias("shard"))
    return numbered(cut(rows.join(placed, "group_key").drop("group_key")), ["shard"], "slot")
