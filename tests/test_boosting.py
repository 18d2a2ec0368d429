"""Multiclass boosting against a plain version that grows one leaf at a time, and on the tables."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mosaiq import queries
from mosaiq.operators import boosting


def plain_fit(x, y, k, rounds, depth, leaves, rate, limits, least_rows, least_hessian=1e-3):
    """Scores of the rows after the last round: one leaf is split after the other."""
    bins = np.stack([np.searchsorted(lim, x[:, f], side="left") for f, lim in enumerate(limits)], axis=1)
    n = len(y)
    scores = np.tile(np.log(np.bincount(y, minlength=k) / n), (n, 1))
    for _ in range(rounds):
        e = np.exp(scores)
        p = e / e.sum(axis=1, keepdims=True)
        new = scores.copy()
        for c in range(k):
            g, h = p[:, c] - (y == c), k / (k - 1) * p[:, c] * (1 - p[:, c])

            def best(rows):
                out = (0.0, 0, 0)
                for f in range(x.shape[1]):
                    for b in range(len(limits[f])):
                        left = rows[bins[rows, f] <= b]
                        right = rows[bins[rows, f] > b]
                        if min(len(left), len(right)) < least_rows or min(h[left].sum(), h[right].sum()) < least_hessian:
                            continue
                        gain = sum(s * g[r].sum() ** 2 / h[r].sum() for s, r in ((1, left), (1, right), (-1, rows)))
                        if gain > out[0] * (1 + 1e-9) + 1e-12:
                            out = (gain, f, b)
                return out

            open_ = [(1, np.arange(n), *best(np.arange(n)))]
            while len(open_) < leaves:
                can = [o for o in open_ if o[2] > 0 and o[0].bit_length() <= depth]
                if not can:
                    break
                top = max(can, key=lambda o: (float(f"{o[2]:.9g}"), -o[0]))
                open_ = [o for o in open_ if o is not top]
                node, rows, _, f, b = top
                for child, part in ((2 * node, rows[bins[rows, f] <= b]), (2 * node + 1, rows[bins[rows, f] > b])):
                    open_.append((child, part, *best(part)))
            for _, rows, *_ in open_:
                new[rows, c] -= rate * g[rows].sum() / h[rows].sum()
        scores = new
    return scores


@pytest.fixture(scope="module")
def points():
    r = np.random.default_rng(3)
    y = r.integers(0, 3, 240)
    x = np.round(r.normal(size=(240, 4)) + np.stack([y, -y, y == 1, 0 * y], axis=1), 2)
    return x, y


@pytest.mark.parametrize(("depth", "leaves", "bins"), [(4, 5, 255), (3, 8, 16), (6, 100, 12), (1, 2, 8)])
def test_equals_the_plain_version(spark, points, depth, leaves, bins, monkeypatch):
    monkeypatch.setattr(boosting, "KEEP", 2)
    monkeypatch.setattr(boosting, "BLOCK", 3)
    if depth == 4:
        monkeypatch.setattr(boosting, "HELD", 24 * 4 * bins * 5)  # five nodes at once
    x, y = points
    rows = spark.createDataFrame([(i, int(c) + 7, [float(v) for v in p]) for i, (p, c) in enumerate(zip(x, y, strict=True))], "id int, label int, f array<double>").repartition(5)
    model = boosting.fit_trees(rows, rounds=3, depth=depth, leaves=leaves, rate=0.3, bins=bins, least_rows=5)
    assert model.classes == [7, 8, 9] and all(len(t.value) <= leaves for trees in model.rounds for t in trees)
    if bins == 255:
        assert [len(lim) for lim in model.limits] == [min(254, len(set(c)) - 1) for c in x.T]
    want = boosting.softmax(plain_fit(x, y, 3, 3, depth, leaves, 0.3, model.limits, 5))
    got = {r.id: r.scores for r in boosting.tree_probabilities(rows, model).collect()}
    assert np.allclose([got[i] for i in range(len(y))], want, atol=1e-9)


def test_early_stop_save_load_and_nulls(spark, points, tmp_path):
    x, y = points
    r = np.random.default_rng(1)
    noise = r.permutation(y)  # labels that tell nothing: the loss soon grows
    rows = spark.createDataFrame([(i, int(c), [float(v) for v in p], i % 4 == 0) for i, (p, c) in enumerate(zip(x, noise, strict=True))] + [(900, None, [0.0] * 4, False), (901, 1, None, True)], "id int, label int, f array<double>, held boolean")
    model = boosting.fit_trees(rows, rounds=30, depth=3, leaves=6, rate=0.5, least_rows=5, held_out="held", patience=3)
    assert len(model.losses) < 30 and len(model.rounds) == int(np.argmin(model.losses)) + 1
    boosting.save_trees(spark, model, f"{tmp_path}/model")
    again = boosting.load_trees(spark, f"{tmp_path}/model")
    assert again == model
    scored = boosting.tree_probabilities(rows, again).orderBy("id").collect()
    assert scored[-1].scores is None and all(abs(sum(s.scores) - 1) < 1e-9 for s in scored[:-1])
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        boosting.load_trees(spark, f"{tmp_path}/nothing")
    with pytest.raises(ValueError, match="no rows"):
        boosting.fit_trees(rows.where("false"))


class Steps:
    """Stands for a table: keeps the functions that it is mapped by."""

    def __init__(self):
        self.functions = []

    def mapInArrow(self, f, schema):
        self.functions.append(f)
        return self

    def repartition(self, *columns):
        return self

    sortWithinPartitions = repartition

    def collect(self):
        return []


def most_memory(function, batches):
    """What it yields, and the most bytes that Python and NumPy held meanwhile."""
    tracemalloc.start()
    try:
        out = list(function(iter(batches)))
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_tasks_hold_histograms_once():
    """The one that makes them sends a node and block at a time; the one that adds them up copies no batch of up to 64 MB."""
    k, width, n_bins, n, tasks = 10, 64, 255, 40, 5
    r = np.random.default_rng(5)
    bins, label = r.integers(0, n_bins, (n, width)).astype(np.uint8), (np.arange(n) % k).astype(np.int32)
    scores = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(r.normal(size=n * k)))
    rows = pa.RecordBatch.from_arrays([pa.array(label), pa.array([False] * n), pa.array([b.tobytes() for b in bins], pa.binary()), scores], ["label", "held", "bins", "scores"])
    state, nodes = Steps(), [(c, node) for c in range(k) for node in (2, 3)]
    boosting._candidates(state, [], [{1: (1.0, 0, 127, [], [])} for _ in range(k)], nodes, width, n_bins, 1, 0.0, 0.0)
    sums, search = state.functions
    whole, one = 24 * len(nodes) * width * n_bins, 24 * width * n_bins
    sent, most = most_memory(sums, [rows])
    assert most < 1.5 * whole and max(b.nbytes for b in sent) < 1.1 * one, (most / whole, max(b.nbytes for b in sent) / one)
    met = pa.Table.from_batches(sent * tasks).sort_by([("node", "ascending"), ("first", "ascending")]).combine_chunks().to_batches()
    found, most = most_memory(search, met)
    assert len(met) == 1 and most < 0.2 * tasks * whole, most / whole
    assert [b.column("node")[0].as_py() for b in found] == list(range(len(nodes)))
    left = int((bins[:, 0] <= 127).sum())
    assert [b.column("whole")[0].as_py()[2] for b in found] == [tasks * left, tasks * (n - left)] * k


def test_better_than_the_discriminant(spark):
    """On the images of sf0.01, with a label that is no linear function of the features."""
    own = queries.vectors(spark, "/root/testdata/sf0.01").withColumn("label", (F.get("f", 3) * F.get("f", 40) + F.get("f", 17) > 40).cast("int") + (F.get("f", 9) > 8).cast("int"))
    own = own.cache()
    train, test = own.where("split = 'train'"), own.where("split = 'test'")
    right = lambda scored, classes: scored.where(F.element_at(F.array(*map(F.lit, classes)), queries.learn.argmax(F.col("scores")) + 1) == F.col("label")).count() / test.count()
    model = boosting.fit_trees(train, rounds=20, depth=4, leaves=12)
    other = queries.learn.fit_discriminant(train)
    trees, linear = right(boosting.tree_probabilities(test, model), model.classes), right(queries.learn.discriminant_scores(test, other), other.first().classes)
    own.unpersist()
    assert trees > linear and trees > 0.7, (trees, linear)
