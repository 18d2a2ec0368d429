"""Pruning of columns, forms over GF(2), neighbours of orbits, and the order of passes against plain versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq import queries
from mosaiq.operators import forms, morphology, neighbours, scaling
from mosaiq.plans import passes
from mosaiq.plans.featurizer import Featurizer


def test_merge_of_large_means(spark):
    r = np.random.default_rng(2)
    x = 1e8 + r.normal(size=(7000, 2))
    rows = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, f array<double>")
    got = {m.pos: m for m in scaling.merge(scaling.moments(rows.withColumn("part", F.floor(F.col("id") / 1000)), "f", "part")).collect()}
    for k in range(2):
        exact = float(((x[:, k] - x[:, k].mean()) ** 2).sum())
        assert got[k].n == 7000 and got[k].m2 == pytest.approx(exact, rel=1e-7) and got[k]["mean"] == pytest.approx(x[:, k].mean(), rel=1e-13)


@pytest.mark.parametrize("block", [3, 512])
def test_correlations_against_numpy(spark, block):
    r = np.random.default_rng(1)
    base = r.normal(size=(300, 4))
    x = np.concatenate([base, base[:, :1] * -3 + 5, base[:, 1:2] + 0.05 * r.normal(size=(300, 1)), np.full((300, 1), 7.5), 1e9 + base[:, 2:3], r.normal(size=(300, 2))], axis=1)
    rows = spark.createDataFrame([([float(v) for v in p],) for p in x] + [(None,)], "f array<double>").repartition(7)
    with np.errstate(invalid="ignore"):
        c = np.corrcoef(x.T)
    for limit in (0.05, 0.99):
        want = {(a, b): c[a, b] for a, b in itertools.combinations(range(x.shape[1]), 2) if abs(c[a, b]) > limit}
        got = {(p.a, p.b): p.r for p in scaling.correlated(rows, limit=limit, block=block).collect()}
        assert set(got) == set(want) and all(got[p] == pytest.approx(want[p], abs=1e-6) for p in want)
    kept = {p.pos: (p.kept, p.same_as) for p in scaling.kept_columns(rows.where("f is not null")).collect()}
    assert [k for k in range(10) if not kept[k][0]] == [4, 5, 6, 7] and (kept[4][1], kept[5][1], kept[6][1], kept[7][1]) == (0, 1, None, 2)
    assert scaling.correlated(rows.limit(0)).count() == 0


def test_whole_vectors_against_numpy(spark, sf_dir):
    own = Featurizer().features(queries.images(spark, sf_dir))
    x = np.array([r.f for r in own.select("f").collect()], float)
    var = x.var(axis=0)
    live = var > 1e-8
    c = np.zeros((x.shape[1],) * 2)
    c[np.ix_(live, live)] = np.corrcoef(x[:, live].T)
    close = np.abs(np.abs(c) - 0.99) < 1e-9
    assert not close.any()
    twin = np.triu(np.abs(c) > 0.99, 1)
    want = {k: (bool(live[k] and not twin[:, k].any()), int(np.argmax(twin[:, k])) if twin[:, k].any() else None) for k in range(x.shape[1])}
    assert {r.pos: (r.kept, r.same_as) for r in queries.kept_columns_full(spark, sf_dir).collect()} == want


def test_forms_against_matrices(spark):
    r = np.random.default_rng(5)
    entries = [(f, int(i), int(j)) for f in range(3) for i, j in r.integers(0, 1024, (200, 2))] + [(0, 5, 9), (0, 5, 9), (1, 7, 7)]
    linear = [(0, int(i)) for i in r.integers(0, 1024, 90)]
    made = forms.quadratic_forms(spark.createDataFrame(entries, "form int, i int, j int"), spark.createDataFrame(linear, "form int, i int"), spark.createDataFrame([(f, f + 1) for f in range(4)], "form int, c int"))
    bits = r.integers(0, 2, (6, 1024))
    masks = spark.createDataFrame([(k, [int(sum(int(b[32 * y + x]) << x for x in range(32))) for y in range(32)]) for k, b in enumerate(bits)] + [(6, None)], "id int, m array<bigint>")
    got = {(x.id, x.form): x.value for x in forms.form_values(masks, made).collect()}
    for f in range(4):
        a, b = np.zeros((1024, 1024), np.int64), np.zeros(1024, np.int64)
        for g, i, j in entries:
            a[i, j] += g == f
        for g, i in linear:
            b[i] += g == f
        for k, x in enumerate(bits):
            assert got[k, f] == (x @ a @ x + b @ x + f + 1) % 2
        assert got[6, f] is None
    with pytest.raises(ValueError, match="bytes"):
        forms.form_values(masks, made, limit=10)


@pytest.mark.parametrize("pivots", [1, 5, 40])
def test_neighbours_against_all_pairs(spark, pivots):
    """Orbits under cyclic shifts, with ties, copies, clusters and fewer rows than neighbours."""
    r = random.Random(7)
    base = [[r.randrange(4) * s for _ in range(4)] for s in (1, 1, 5) for _ in range(25)]
    rows = [(i, i % 3, [v[s:] + v[:s] for s in range(4)]) for i, v in enumerate(base + base[:5])]
    asked = [(i, rows[i][2][i % 4]) for i in range(0, 80, 7)] + [(1000, [9, 9, 9, 9])]
    df = spark.createDataFrame(rows, "id long, label int, orbit array<array<int>>").repartition(4)
    own = spark.createDataFrame(asked, "query long, q array<int>")
    for data, k in ((df, 6), (df.where("id < 4"), 6)):
        here = {x.id: x for x in data.collect()}
        got = neighbours.nearest_orbits(data, own, k, pivots).cache()
        for q, v in asked:
            far = sorted((min(sum((a - b) ** 2 for a, b in zip(v, t, strict=True)) for t in x.orbit), i) for i, x in here.items() if i != q)[:k]
            mine = got.where(F.col("query") == q).orderBy("rank").collect()
            assert [(x.distance, x.id, x.label) for x in mine] == [(d, i, here[i].label) for d, i in far]
        votes = {x.query: x.label for x in neighbours.vote(got).collect()}
        for q, _ in asked:
            labels = [x.label for x in got.where(F.col("query") == q).orderBy("rank").collect()]
            assert votes.get(q) == (max(dict.fromkeys(labels), key=lambda c: (labels.count(c), -labels.index(c))) if labels else None)
        got.unpersist()


def test_order_of_passes_against_all_orders(spark, sf_dir):
    own = queries.gray100(spark, sf_dir).select("label", "m").limit(60).cache()
    every = {"life": morphology.life, "dilation": morphology.dilate8, "erosion": morphology.erode8, "edge": morphology.edge}
    found = {r.order: r for r in passes.search_order(own, every).collect()}
    assert set(found) == {">".join(p) for p in itertools.permutations(every)}
    for order in ("life>dilation>erosion>edge", "edge>erosion>life>dilation", "dilation>edge>life>erosion"):
        m = F.col("m")
        for name in order.split(">"):
            m = every[name](m)
        n = own.select("label", queries.stats.count(m).alias("n")).toPandas()
        whole, within = n.n.var(ddof=0) * len(n), sum(g.var(ddof=0) * len(g) for _, g in n.groupby("label").n)
        assert found[order].score == pytest.approx((whole - within) / whole if whole else 0.0, abs=1e-9)
    best = max(found.values(), key=lambda r: (r.score, [-ord(c) for c in r.order]))
    assert [r.order for r in found.values() if r.best] == [best.order]
    few = passes.search_order(own, every, beam=2).collect()
    assert len(few) <= 2 and sum(r.best for r in few) == 1 and all(found[r.order].score == pytest.approx(r.score) for r in few)
    assert passes.search_order(own.limit(0), every).count() == 0
    own.unpersist()


@pytest.mark.parametrize("kind", ["whole", "fractions", "far off"])
def test_a_part_of_the_rows_against_all_pairs(kind):
    """Queries meet rows by matrix products: ties by id, the row of the query's own id left out, nothing beyond its reach, no digit lost."""
    r = np.random.default_rng(3)
    own = {"whole": r.integers(0, 3, (60, 4)), "fractions": r.normal(size=(60, 4)), "far off": 1e8 + r.normal(size=(60, 4))}[kind].astype(float)
    own[30:40] = own[:10]
    orbits = np.concatenate([np.roll(own, s, axis=1) for s in range(4)], axis=1)
    ids = r.permutation(60)
    part = neighbours.Part(ids, orbits, 4)
    asked, q = np.append(ids[:20], 999), np.append(own[:20], own[:1] + 0.5, axis=0)
    reach = np.where(np.arange(21) % 3, np.inf, 1.0)
    got = list(zip(*part.nearest(asked, q, reach, 7), strict=True))
    for i in range(21):
        far = sorted((float(min(((q[i] - t) ** 2).sum() for t in orbits[j].reshape(4, 4))), int(ids[j])) for j in range(60) if ids[j] != asked[i])
        want = [(d, k) for d, k in far if d <= reach[i] ** 2][:7]
        assert [(d, k) for at, k, d in got if at == i][: len(want)] == want


def test_cells_in_several_parts(spark, monkeypatch):
    r = np.random.default_rng(5)
    rows = [(i, i % 3, [v, v[::-1]]) for i, v in enumerate(r.integers(0, 4, (200, 6)).tolist())]
    df = spark.createDataFrame(rows, "id long, label int, orbit array<array<int>>")
    asked = df.where("id % 5 = 0").select(F.col("id").alias("query"), F.get("orbit", 0).alias("q"))
    whole = sorted(map(tuple, neighbours.nearest_orbits(df, asked, 4, 3).collect()))
    monkeypatch.setattr(neighbours, "ROWS", 8)
    assert sorted(map(tuple, neighbours.nearest_orbits(df, asked, 4, 3).collect())) == whole and len(whole) == 160
    assert neighbours.nearest_orbits(df.where("id < 0"), asked).columns == ["query", "rank", "id", "distance", "label"]


def test_grids_of_all_forms(spark, sf_dir):
    own = queries.images(spark, sf_dir).limit(3)
    made = {x.img_id: x.f for x in queries.batches.map_images(own, queries.batches.orbit_grid_kernel(100), "f", queries.LongType()).collect()}
    gray = own.withColumn("gray", queries.planes.gray_u8(*queries.rgb()))
    for e in (0, 3, 6):
        for x in gray.select("img_id", queries.stats.grid(queries.boards.at_least(queries.symmetry.moved(F.col("gray"), e), 100)).alias("v")).collect():
            assert made[x.img_id][e * 64 : e * 64 + 64] == x.v
