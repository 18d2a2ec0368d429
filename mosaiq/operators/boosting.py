"""Multiclass gradient boosting: leaf-wise trees on binned features with a softmax over all classes.

In each round every class gets a tree. For one level of all of them Spark makes one pass over the rows: tasks add up the gradients, second
derivatives and rows of each (class, node, feature, bin), these histograms are summed and searched for the best split where they meet, and
the driver gets one candidate for each node and block of features: no histogram and no row.

Leaf-wise growth splits the leaf of the greatest gain until there are ``leaves`` of them. That tree is a part of the one that splits all nodes down to
``depth``, so the levels are made for all nodes together and the order of splits is followed afterwards: ``depth`` passes a round, not one a leaf.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions.storage import workspace
from mosaiq.operators.scaling import by_position

#: Features whose histograms are made and travel together; bytes of histograms that a task holds, about; rounds after which scores are written.
BLOCK, HELD, KEEP = 64, 256 << 20, 8
#: Gains that differ by no more than this part are equal: sums are not made in one order.
SAME = 1e-9


@dataclass
class Tree:
    """Nodes are numbered like a heap, 1 is the root. ``split``: node to (feature, bin): rows of greater bins go to 2 * node + 1. ``value``: of leaves."""

    split: dict[int, tuple[int, int]] = field(default_factory=dict)
    value: dict[int, float] = field(default_factory=dict)

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """Where each row ends. ``bins``: (rows, features)."""
        at = np.ones(len(bins), np.int64)
        if not self.split:
            return at
        size = 2 * max(self.split) + 2
        feature, limit = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        for node, (f, b) in self.split.items():
            feature[node], limit[node] = f, b
        rows = np.arange(len(bins))
        for _ in range(max(self.split).bit_length()):
            f = feature[at]
            at = np.where(f >= 0, 2 * at + (bins[rows, np.maximum(f, 0)] > limit[at]), at)
        return at

    def scores(self, bins: np.ndarray) -> np.ndarray:
        of = np.zeros(2 * max(self.split, default=0) + 2)
        for node, v in self.value.items():
            of[node] = v
        return of[self.nodes(bins)]


@dataclass
class Boosted:
    """``limits``: for each feature the upper ends of its bins but the last. ``start``: scores before the first round. ``rounds``: a tree for each class."""

    classes: list[int]
    limits: list[list[float]]
    start: list[float]
    rounds: list[list[Tree]]
    losses: list[float] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.limits)), np.uint8)
        for k, limits in enumerate(self.limits):
            out[:, k] = np.searchsorted(limits, x[:, k], side="left")
        return out


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def derivatives(scores: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log loss by each class's score; the second one as for independent classes, times k / (k - 1)."""
    p, k = softmax(scores), scores.shape[1]
    g = p.copy()
    g[np.arange(len(label)), label] -= 1
    return g, k / max(1, k - 1) * p * (1 - p)


def add_histogram(total: np.ndarray, bins: np.ndarray, place: np.ndarray, weights: list[np.ndarray]) -> None:
    """Adds to ``total`` (weight, place, feature, bin) the sums over the rows; rows with place -1 are left out."""
    own, (_, places, width, n_bins) = place >= 0, total.shape
    at = ((place[own, None] * width + np.arange(width)) * n_bins + bins[own]).ravel()
    for k, w in enumerate(weights):
        total[k] += np.bincount(at, weights=np.repeat(w[own], width), minlength=places * width * n_bins).reshape(places, width, n_bins)


def best_split(h: np.ndarray, least_rows: float, least_hessian: float, l2: float) -> tuple[float, int, int, list[float], list[float]]:
    """Of one node's histograms (gradient, second derivative, rows; feature; bin): gain, feature and bin of the best split (gain 0: none), the three
    sums to the left of it, and of all. Ties: the first feature, the lowest bin."""
    left = np.cumsum(h, axis=2)
    whole = left[:, 0, -1]
    right = whole[:, None, None] - left
    fine = (left[2] >= least_rows) & (right[2] >= least_rows) & (left[1] >= least_hessian) & (right[1] >= least_hessian)
    gain = np.where(fine, left[0] ** 2 / np.where(fine, left[1] + l2, 1) + right[0] ** 2 / np.where(fine, right[1] + l2, 1) - whole[0] ** 2 / max(whole[1] + l2, 1e-300), 0.0)
    f, b = np.unravel_index(int(np.argmax(gain >= gain.max() * (1 - SAME))), gain.shape)
    return float(max(0.0, gain[f, b])), int(f), int(b), left[:, f, b].tolist(), whole.tolist()


def leaf_wise(found: dict[int, tuple], leaves: int, rate: float, l2: float) -> Tree:
    """The tree that splits the leaf of the greatest gain (ties: the lower node) until it has ``leaves``. ``found``: for each node the result of ``best_split``."""
    value = lambda sums: -rate * sums[0] / (sums[1] + l2) if sums[1] + l2 > 0 else 0.0
    tree, waiting = Tree(value={1: value(found[1][4])}), []

    def offer(node: int) -> None:
        if node in found and found[node][0] > 0:
            heapq.heappush(waiting, (-float(f"{found[node][0]:.9g}"), node))

    offer(1)
    while waiting and len(tree.value) < leaves:
        node = heapq.heappop(waiting)[1]
        _, f, b, left, whole = found[node]
        tree.split[node] = f, b
        del tree.value[node]
        for child, sums in ((2 * node, left), (2 * node + 1, [w - v for w, v in zip(whole, left, strict=True)])):
            tree.value[child] = value(sums)
            offer(child)
    return tree


def bin_limits(rows: DataFrame, column: str, bins: int) -> list[list[float]]:
    """For each feature at most ``bins`` - 1 distinct values, at equal steps of rank; the greatest value is none of them."""
    steps = [k / bins for k in range(1, bins)]
    x = F.col("x").cast("double")
    each = by_position(rows, column).groupBy("pos").agg(F.array_sort(F.array_distinct(F.percentile_approx(x, steps, 10_000))).alias("limits"), F.max(x).alias("top"))
    return [[v for v in r.limits if v < r.top] for r in each.select("pos", "limits", "top").orderBy("pos").collect()]


_STATE = "label int, held boolean, bins binary, scores array<double>"


def _unpack(b: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    bins = np.frombuffer(b"".join(b.column("bins").to_pylist()), np.uint8).reshape(b.num_rows, width)
    scores = b.column("scores").flatten().to_numpy().reshape(b.num_rows, -1)
    return b.column("label").to_numpy(), b.column("held").to_numpy(zero_copy_only=False), bins, scores


def _with(scores: np.ndarray, bins: np.ndarray, rounds: list[list[Tree]]) -> np.ndarray:
    scores = scores.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            scores[:, k] += tree.scores(bins)
    return scores


def _told(total: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
    """Histograms (weight, node, feature, bin), a node and block of features at a time: sent together they would be copied whole several times."""
    for node in range(total.shape[1]):
        for first in range(0, total.shape[2], block):
            sums = total[:, node, first : first + block].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int32()), pa.array([first], pa.int32()), pa.array([sums], pa.binary())], ["node", "first", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(node, first feature, sums) of what comes sorted by these. Sums are added where they lie in the batch, which is not copied."""
    key, total = None, None
    for b in batches:
        sums = b.column("sums")
        for i, own in enumerate(zip(b.column("node").to_pylist(), b.column("first").to_pylist(), strict=True)):
            part = np.frombuffer(sums[i].as_buffer(), np.float64)
            if own == key:
                total += part
                continue
            if key is not None:
                yield *key, total
            key, total = own, part.copy()
    if key is not None:
        yield *key, total


def fit_trees(
    rows: DataFrame, column: str = "f", label: str = "label", rounds: int = 100, depth: int = 8, leaves: int = 31, rate: float = 0.1, bins: int = 255,
    least_rows: int = 20, least_hessian: float = 1e-3, l2: float = 0.0, held_out: str | None = None, patience: int = 100,
) -> Boosted:
    """Trees for ``rows`` (an array ``column`` of numbers, a whole-number ``label``). ``held_out`` names a boolean column: its rows are not learnt from, and
    the rounds end when their log loss has not fallen for ``patience`` rounds; those after the best one are dropped. Rows with a null label or vector
    are left out. The driver holds the bins' limits and the trees; each task the histograms of some nodes, ``HELD`` bytes at most or one node's."""
    spark = rows.sparkSession
    if not 1 <= depth <= 16 or not 2 <= bins <= 256:
        raise ValueError("depth must be 1 to 16, bins 2 to 256")
    own = rows.where(F.col(label).isNotNull() & F.col(column).isNotNull()).select(F.col(label).cast("int").alias("label"), (F.coalesce(F.col(held_out), F.lit(False)) if held_out else F.lit(False)).alias("held"), F.transform(column, lambda v: v.cast("double")).alias("x"))
    sizes = {r[0]: r[1] for r in own.where("not held").groupBy("label").count().orderBy("label").collect()}
    if not sizes:
        raise ValueError("no rows to learn from")
    model = Boosted(list(sizes), bin_limits(own.where("not held"), "x", bins), [float(np.log(n / sum(sizes.values()))) for n in sizes.values()], [])
    k, width, n_bins = len(sizes), len(model.limits), bins

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            binned = model.binned(b.column("x").flatten().to_numpy().reshape(b.num_rows, width))
            place = np.searchsorted(model.classes, b.column("label").to_numpy())
            known = np.isin(b.column("label").to_numpy(), model.classes)  # a held-out row of an unseen class tells nothing
            ends = pa.array(np.arange(known.sum() + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays([pa.array(place[known].astype(np.int32)), b.column("held").filter(pa.array(known)), pa.array([x.tobytes() for x in binned[known]], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(np.tile(model.start, known.sum())))], ["label", "held", "bins", "scores"])

    with workspace(spark) as keep:
        state, pending = keep(own.mapInArrow(begin, _STATE)), []
        best = (np.inf, 0)
        for _ in range(rounds):
            found: list[dict[int, tuple]] = [{} for _ in range(k)]
            for level in range(depth):
                nodes = [(c, n) for c in range(k) for n in range(1 << level, 2 << level) if n == 1 or (n >> 1 in found[c] and found[c][n >> 1][0] > 0)]
                at_once = max(1, HELD // (24 * width * n_bins))
                for start in range(0, len(nodes), at_once):
                    some = nodes[start : start + at_once]
                    for c, n, split in _candidates(state, pending, found, some, width, n_bins, least_rows, least_hessian, l2):
                        if n not in found[c] or split[0] > found[c][n][0] * (1 + SAME):  # blocks come in the order of features
                            found[c][n] = split
            trees = [leaf_wise(f, leaves, rate, l2) for f in found]
            model.rounds.append(trees)
            pending = [*pending, trees]
            if len(pending) == KEEP:
                state, pending = keep(_moved(state, pending, width)), []
            if held_out:
                loss = _loss(state, pending, width)
                model.losses.append(loss)
                best = min(best, (loss, len(model.losses)))
                if len(model.losses) - best[1] >= patience:
                    break
    if held_out and best[1]:
        model.rounds = model.rounds[: best[1]]
    return model


def _candidates(state: DataFrame, pending: list[list[Tree]], found: list[dict[int, tuple]], nodes: list[tuple[int, int]], width: int, n_bins: int, least_rows: int, least_hessian: float, l2: float) -> list[tuple]:
    """(class, node, best split) for each of ``nodes`` and each block of features."""
    partial = [Tree({n: s[1:3] for n, s in f.items() if s[0] > 0}) for f in found]
    classes = sorted({c for c, _ in nodes})
    place = {pair: i for i, pair in enumerate(nodes)}
    lookup = {c: np.full(2 * max(n for _, n in nodes) + 2, -1, np.int64) for c in classes}
    for (c, n), i in place.items():
        lookup[c][n] = i

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, len(nodes), width, n_bins))
        for b in batches:
            label, held, binned, scores = _unpack(b, width)
            label, binned, scores = label[~held], binned[~held], scores[~held]
            g, h = derivatives(_with(scores, binned, pending), label)
            for c in classes:
                at = partial[c].nodes(binned)
                own = np.where(at < len(lookup[c]), lookup[c][np.minimum(at, len(lookup[c]) - 1)], -1)
                low, high = min(place[p] for p in nodes if p[0] == c), max(place[p] for p in nodes if p[0] == c) + 1
                for first in range(0, width, BLOCK):
                    block = slice(first, first + BLOCK)
                    add_histogram(total[:, low:high, block], binned[:, block], np.where(own >= 0, own - low, -1), [g[:, c], h[:, c], np.ones(len(label))])
        yield from _told(total, BLOCK)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best split of each node and block of features."""
        for node, first, total in _added(batches):
            gain, f, b, left, whole = best_split(total.reshape(3, -1, n_bins), least_rows, least_hessian, l2)
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int32()), pa.array([gain]), pa.array([first + f], pa.int32()), pa.array([b], pa.int32()), pa.array([left]), pa.array([whole])], ["node", "gain", "feature", "bin", "left", "whole"])

    summed = state.mapInArrow(sums, "node int, first int, sums binary").repartition("node", "first").sortWithinPartitions("node", "first")
    out = summed.mapInArrow(search, "node int, gain double, feature int, bin int, left array<double>, whole array<double>").collect()
    return [(*nodes[r.node], (r.gain, r.feature, r.bin, list(r.left), list(r.whole))) for r in sorted(out, key=lambda r: (r.node, r.feature))]


def _moved(state: DataFrame, pending: list[list[Tree]], width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, _, binned, scores = _unpack(b, width)
            new = _with(scores, binned, pending)
            ends = pa.array(np.arange(len(new) + 1, dtype=np.int32) * new.shape[1])
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("held"), b.column("bins"), pa.ListArray.from_arrays(ends, pa.array(new.ravel()))], ["label", "held", "bins", "scores"])

    return state.mapInArrow(run, _STATE)


def _loss(state: DataFrame, pending: list[list[Tree]], width: int) -> float:
    """The mean log loss of the rows that are held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0.0, 0
        for b in batches:
            label, held, binned, scores = _unpack(b, width)
            p = softmax(_with(scores[held], binned[held], pending))
            total -= float(np.log(np.maximum(p[np.arange(len(p)), label[held]], 1e-300)).sum())
            n += len(p)
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([n], pa.int64())], ["total", "n"])

    total, n = state.where("held").mapInArrow(run, "total double, n bigint").agg(F.sum("total"), F.sum("n")).first()
    return total / n if n else float("inf")


def tree_probabilities(rows: DataFrame, model: Boosted, column: str = "f") -> DataFrame:
    """``rows`` with ``scores``: the probability of each of ``model.classes``; null for a null vector."""
    kind = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            has = b.column("_x").is_valid().to_numpy(zero_copy_only=False)
            x = b.column("_x").flatten().to_numpy().reshape(int(has.sum()), len(model.limits))
            bins = model.binned(x) if len(x) else np.zeros((0, len(model.limits)), np.uint8)
            p = iter(softmax(_with(np.tile(model.start, (len(x), 1)), bins, model.rounds)).tolist())
            scores = pa.array([next(p) if ok else None for ok in has.tolist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kind.names if c != "scores"], scores], [*[c for c in kind.names if c != "scores"], "scores"])

    ready = rows.withColumn("_x", F.transform(column, lambda v: v.cast("double")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind if f.name != "scores")
    return ready.mapInArrow(run, f"{fields}, scores array<double>")


def save_trees(spark: SparkSession, model: Boosted, path: str) -> None:
    """One row for each node, and one about the model, in place of what is there."""
    nodes = [(r, c, n, *(t.split.get(n, (None, None))), t.value.get(n)) for r, trees in enumerate(model.rounds) for c, t in enumerate(trees) for n in sorted({*t.split, *t.value})]
    about = json.dumps({"classes": model.classes, "limits": model.limits, "start": model.start, "losses": model.losses, "rounds": len(model.rounds)})
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
    spark.createDataFrame(nodes, "round int, class int, node long, feature int, bin int, value double").write.mode("overwrite").parquet(f"{path}/nodes")


def load_trees(spark: SparkSession, path: str) -> Boosted:
    """A missing path is an error: nothing is trained instead."""
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    rounds = [[Tree() for _ in about["classes"]] for _ in range(about["rounds"])]
    for r in spark.read.parquet(f"{path}/nodes").toLocalIterator():
        tree = rounds[r["round"]][r["class"]]
        if r.feature is None:
            tree.value[r.node] = r.value
        else:
            tree.split[r.node] = r.feature, r.bin
    return Boosted(about["classes"], about["limits"], about["start"], rounds, about["losses"])
