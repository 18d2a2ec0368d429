"""Layouts, hand-made masks, invariants, sources, the cache, the stream and the learners."""

import pickle
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq import __main__ as command_line
from mosaiq.operators import cayley, learn, morphology, scaling, stats, symmetry
from mosaiq.plans import grammar
from mosaiq.plans.featurizer import Featurizer, parse_ints
from mosaiq.sources import cache, images
from mosaiq.streaming import moments


def board(test):
    return [sum(1 << x for x in range(32) if test(y, x)) for y in range(32)]


MASKS = {
    "empty": board(lambda y, x: False), "full": board(lambda y, x: True), "centre": board(lambda y, x: (y, x) == (16, 16)),
    "corner": board(lambda y, x: (y, x) == (0, 0)), "checkers": board(lambda y, x: (y + x) % 2 == 0), "left": board(lambda y, x: x < 16),
}


@pytest.fixture(scope="module")
def masks(spark):
    return spark.createDataFrame(list(MASKS.items()), "name string, m array<bigint>")


def by_name(masks, column):
    return {r.name: r.v for r in masks.select("name", column.alias("v")).collect()}


def test_hand_made_masks(masks):
    m = F.col("m")
    assert by_name(masks, stats.count(m)) == {"empty": 0, "full": 1024, "centre": 1, "corner": 1, "checkers": 512, "left": 512}
    sparse = lambda v: {i: n for i, n in enumerate(v) if n}
    got = by_name(masks, stats.pattern_histogram(m))
    assert {k: sparse(v) for k, v in got.items()} == {"empty": {0: 961}, "full": {15: 961}, "centre": {0: 957, 1: 1, 2: 1, 4: 1, 8: 1}, "corner": {0: 960, 1: 1}, "checkers": {9: 481, 6: 480}, "left": {15: 465, 5: 31, 0: 465}}
    got = by_name(masks, stats.transition_histogram(m))
    assert sparse(got["left"][:4]) == {3: 480, 2: 32, 0: 480} and sparse(got["left"][12:]) == {3: 465, 1: 31, 0: 465}
    assert sparse(got["corner"][12:]) == {0: 961} and all([sum(v[k : k + 4]) for k in (0, 4, 8, 12)] == [992, 992, 961, 961] for v in got.values())


def test_morphology_of_hand_made_masks(masks):
    n = {name: by_name(masks, stats.count(f(F.col("m")))) for name, f in (("erode4", morphology.erode4), ("edge", morphology.edge), ("erode8", morphology.erode8), ("dilate4", morphology.dilate4), ("dilate8", morphology.dilate8))}
    assert (n["erode4"]["full"], n["edge"]["full"], n["erode8"]["full"]) == (1024, 0, 900)
    assert (n["dilate4"]["centre"], n["erode4"]["centre"], n["edge"]["centre"], n["dilate8"]["centre"]) == (5, 0, 5, 9)


def test_unknown_rule_is_an_error():
    with pytest.raises(ValueError):
        morphology.automaton(None, 1, "none such")


def test_layouts():
    assert (Featurizer().size, Featurizer().n_masks) == (3872, 31)
    assert (Featurizer(gray=(64, 128, 192)).size, Featurizer(ca_steps=2).n_masks) == (3194, 93)
    assert parse_ints(" 1, 2,,3") == (1, 2, 3) and parse_ints(None) == ()


def test_grammar_types():
    assert sum(map(grammar.size, grammar.first_programs())) == 2509
    assert sum(map(grammar.size, grammar.second_programs())) == 4778
    with pytest.raises(TypeError):
        grammar.check(grammar.CA(grammar.Gray(), 1))


def pictures(spark, n, seed=1):
    r = random.Random(seed)
    return spark.createDataFrame([(i, i % 2, "train", *[[r.randrange(256) for _ in range(1024)] for _ in "rgb"]) for i in range(n)], images.SCHEMA)


def test_symmetries_against_numpy(spark):
    own = pictures(spark, 2)
    whole = {r.img_id: np.array(r.r).reshape(32, 32) for r in own.collect()}
    for r in symmetry.orbit(own).collect():
        want = np.rot90(whole[r.img_id], r.element // 2)
        want = want[:, ::-1] if r.element % 2 else want
        assert (np.array(r.r).reshape(32, 32) == want).all()


def test_pooled_features_do_not_see_symmetries(spark):
    f = Featurizer(gray=(100,), gradients=False, red_green=(20,), yellow_blue=(), saturation=())
    own = pictures(spark, 1)
    turned = symmetry.orbit(own).where("element = 3").select(*own.columns)
    for how in ("mean", "max", "median"):
        assert f.invariant(own, how).first().f == f.invariant(turned, how).first().f


@pytest.mark.parametrize("options", [{}, {"ca_steps": 2, "gray": (100,), "red_green": (20,), "lbp_flip_invariant": True, "lbp_eps": 3}, {"ca_steps": 1, "ca_diagonal": False, "ca_birth": (3, 4), "ca_survive": (2, 4), "markov": False, "bins": 1, "blocks": 8, "bias": False, "yellow_blue": ()}])
def test_vectors_of_batches_equal_those_of_columns(spark, options):
    f = Featurizer(**options)
    own = pictures(spark, 3)
    got = {r.img_id: r.f for r in f.features(own).collect()}
    assert got == {r.img_id: r.f for r in f.declared(own).collect()} and all(len(v) == f.size for v in got.values())


def test_pooled_and_stacked_vectors_against_the_eight_vectors(spark):
    f = Featurizer(gray=(100,), gradients=False, red_green=(20,), yellow_blue=(), saturation=())
    own = pictures(spark, 2)
    eight = {(r.img_id, r.element): r.f for r in f.features(symmetry.orbit(own)).collect()}
    for r in f.equivariant(own).collect():
        assert r.f == [v for e in range(8) for v in eight[r.img_id, e]]
    for how, of in (("mean", np.mean), ("max", np.max), ("median", np.median)):
        for r in f.invariant(own, how).collect():
            assert r.f == np.rint(of([eight[r.img_id, e] for e in range(8)], axis=0)).astype(int).tolist()


def test_programs_of_batches_equal_those_of_columns(spark):
    """Every kind of node: the first list whole, and of the second one input of each kind with every statistic."""
    own = pictures(spark, 2).unionByName(spark.createDataFrame([(9, 0, "train", [0] * 1024, [0] * 1024, [0] * 1024)], images.SCHEMA))
    g = grammar
    some = [s(x) for x in (g.Threshold(g.OppYB(), 60), g.Edge(g.Gray()), g.Edge(g.OppRG()), g.Sat(), g.OppRG(), g.Gray()) for s in (g.GridStats, g.Pat2x2, g.Markov4, g.Moments)]
    for programs in (g.first_programs(), [*some, g.LBP(g.Gray()), g.RGBHist(), g.RGBBlocks(), g.RGBHist(g.Img(), 1)]):
        got = {r.img_id: r.f for r in g.evaluate(own, programs).collect()}
        for r in g.declared(own, programs).collect():
            assert got[r.img_id] == pytest.approx(r.f, rel=1e-5, abs=1e-5)
    whole = g.evaluate(own, g.second_programs()).first()
    assert len(whole.f) == 4778


def test_merged_moments_equal_those_of_all(spark):
    rows = spark.createDataFrame([(i, [float(i * k % 17) for k in (1, 3, 5)]) for i in range(50)], "id long, f array<double>")
    parts = scaling.moments(rows.withColumn("part", F.col("id") % 4), "f", "part")
    one = {r.pos: (r.n, round(r.mean, 9), round(r.m2, 6)) for r in scaling.moments(rows).collect()}
    assert {r.pos: (r.n, round(r.mean, 9), round(r.m2, 6)) for r in scaling.merge(parts).collect()} == one


def test_scores_of_ties_take_the_first(spark):
    rows = spark.createDataFrame([([1, 3, 3],), ([5, 5, 5],), ([-7, -9, -7],)], "s array<int>")
    assert [tuple(r) for r in rows.select(learn.argmax(F.col("s")), learn.runner_up(F.col("s"))).collect()] == [(1, 2), (0, 1), (0, 2)]


def plain_perceptron(x, y, classes, orders, margin, limit, step=1):
    w = np.zeros((classes, x.shape[1]), np.int64)
    total, n = np.zeros_like(w), 0
    for order in orders:
        for i in order:
            scores = w @ x[i]
            best = int(np.argmax(scores))
            rest = scores.copy()
            rest[best] = np.iinfo(np.int64).min
            if best != y[i] or scores[best] - rest.max() < margin:
                rival = best if best != y[i] else int(np.argmax(rest))
                w[y[i]] = np.clip(w[y[i]] + step * x[i], -limit, limit)
                w[rival] = np.clip(w[rival] - step * x[i], -limit, limit)
            total, n = total + w, n + 1
    return total // n


def test_perceptron_of_one_shard_is_the_sequential_rule(spark):
    r = np.random.default_rng(3)
    x, y = r.integers(-5, 9, (60, 4)), r.integers(0, 3, 60)
    rows = spark.createDataFrame([(i, int(y[i]), [int(v) for v in x[i]]) for i in range(60)], "img_id long, label int, f array<int>").repartition(3)
    orders = [[a.img_id for a in rows.orderBy(F.xxhash64("img_id", F.lit(e), F.lit(0)), "img_id").collect()] for e in range(3)]
    seen = []
    got = {a.label: a.w for a in learn.fit_perceptron(rows, 3, epochs=3, shards=1, margin=20, limit=40, after_epoch=lambda e, w: seen.append((e, w.count()))).collect()}
    want = plain_perceptron(x, y, 3, orders, 20, 40)
    assert got == {c: want[c].tolist() for c in range(3)} and (want < 0).any() and seen == [(0, 3), (1, 3), (2, 3)]
    many = {a.label: a.w for a in learn.fit_perceptron(rows, 3, epochs=2, shards=3).collect()}
    assert set(many) == {0, 1, 2} and all(len(w) == 4 for w in many.values())


def test_ridge_against_the_normal_equations(spark):
    r = np.random.default_rng(4)
    x, y = r.normal(size=(80, 3)), r.integers(0, 3, 80)
    rows = spark.createDataFrame([(i, int(y[i]), [float(v) for v in x[i]]) for i in range(80)], "img_id long, label int, f array<double>")
    models = learn.fit_ridge(rows, 3, alpha=2.0)
    centre = x - x.mean(axis=0)
    for c, m in enumerate(models):
        t = np.where(y == c, 1.0, -1.0)
        w = np.linalg.solve(centre.T @ centre + 2.0 * np.eye(3), centre.T @ (t - t.mean()))
        assert m.coefficients.toArray() == pytest.approx(w, abs=1e-6) and m.intercept == pytest.approx(t.mean() - x.mean(axis=0) @ w, abs=1e-6)
    scores = np.array([a.scores for a in learn.ridge_scores(rows, models).orderBy("img_id").collect()])
    assert scores.shape == (80, 3)


def test_models_are_saved_and_read(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 2, [float(i % 2), float(i)]) for i in range(20)], "img_id long, label int, f array<double>")
    model = learn.fit_forest(rows, trees=3, depth=2)
    learn.save_model(model, str(tmp_path / "m"))
    same = learn.load_model(str(tmp_path / "m"))
    assert [a.predicted for a in learn.predict(same, rows).collect()] == [a.predicted for a in learn.predict(model, rows).collect()]
    with pytest.raises(Exception, match="does not exist|not exist"):
        learn.load_model(str(tmp_path / "none"))


def test_group_relations():
    r, s = cayley.turned, cayley.mirrored
    for g in range(8):
        assert r(r(r(r(g)))) == s(s(g)) == g and s(r(s(r(g)))) == g


def test_batches_are_read(spark, tmp_path):
    data = np.arange(2 * 3072, dtype=np.int64).reshape(2, 3072) % 256
    for name, key in (("data_batch_1", b"labels"), ("test_batch", b"fine_labels")):
        (tmp_path / name).write_bytes(pickle.dumps({b"data": data.astype(np.uint8), key: [3, 4]}))
    got = images.read_images(spark, str(tmp_path)).orderBy("img_id").collect()
    assert [(r.label, r.split) for r in got] == [(3, "test"), (4, "test"), (3, "train"), (4, "train")]
    assert list(got[0].g) == data[0, 1024:2048].tolist()


def test_cache(spark, tmp_path):
    calls = []

    def build(rows):
        calls.append(1)
        return rows.withColumn("f", F.col("x") + 1)

    rows = spark.createDataFrame([(1,), (2,)], "x int")
    for given, config, want in ((rows, {"a": 1}, 1), (rows, {"a": 1}, 1), (rows, {"a": 2}, 2), (rows.limit(1), {"a": 2}, 3)):
        assert cache.cached(given, build, str(tmp_path), "t", config).count() == given.count()
        assert len(calls) == want
    assert cache.scaled_path("p", True, 10.0, 16.0) != cache.scaled_path("p", True, 10.0, 16.5)


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i), float(i * i % 7)]) for i in range(30)], "id long, f array<double>").repartition(3)
    rows.write.parquet(str(tmp_path / "in"))
    stream = moments.running_moments(moments.feature_stream(spark, str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    q.stop()
    m = scaling.moments(rows)
    want = {r.pos: (r.n, r.mean, pytest.approx(r.var)) for r in m.select("pos", "n", "mean", scaling.variance(F.col("m2"), F.col("n")).alias("var")).collect()}
    assert {r.pos: (r.n, r["mean"], r["var"]) for r in spark.table("running").collect()} == want


@pytest.mark.parametrize("flags", ["--epochs 2 --flip_train --flip_eval --diag_scale --no_lbp", "--classifier diaglda --no_diag_use_var --diag_scale --use_d4 --d4_pooling max", "--classifier lightgbm --lgbm_n_estimators 2 --lgbm_max_depth 2 --save_model {0}/m --flip_eval"])
def test_command_line(spark, tmp_path, flags):
    own = pictures(spark, 24)
    split = F.when(F.col("img_id") % 3 == 0, "test").otherwise("train")
    bright = F.transform("r", lambda v: F.least(F.lit(255), v + 120 * F.col("label")))
    own.withColumns({"split": split, "r": bright}).write.parquet(str(tmp_path / "in.parquet"))
    common = f"--data_root {tmp_path}/in.parquet --cache_dir {tmp_path}/cache --gray_thresholds 80,120 --rg_tpos 20 --yb_tpos= --sat_th 60 --no_grad "
    got = command_line.main((common + flags.format(tmp_path)).split(), spark)
    assert (got["train"], got["test"]) == (32 if "flip_train" in flags else 16, 8) and 0 <= got["accuracy"] <= 1
    assert len(got["by_epoch"]) == (2 if "epochs" in flags else 0) and (tmp_path / "m").exists() == ("save_model" in flags)


def test_scaled_copies_are_written_anew(spark, tmp_path):
    rows = spark.createDataFrame([(i, [i, 3 * i]) for i in range(9)], "img_id long, f array<int>")
    inverse = scaling.inverse_deviation(rows, eps=1.0)
    for scale in (4.0, 8.0):
        got = cache.write_scaled(rows, inverse, str(tmp_path / "x"), scale)
        assert {r.img_id: r.f for r in got.collect()} == {r.img_id: r.f for r in scaling.apply_scale(rows, inverse, scale=scale).collect()}
