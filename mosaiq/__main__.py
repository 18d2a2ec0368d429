"""``python -m mosaiq``: images to features, optional scaling, a classifier, its accuracy. Prints one line of JSON.

``--data_root`` is a folder of pickled batches or a ``.parquet`` of the image schema. Features and their scaled copies are kept in
``--cache_dir``, which all executors must share."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.operators import boosting, learn, scaling, symmetry
from mosaiq.plans.featurizer import Featurizer, parse_ints
from mosaiq.sources import cache
from mosaiq.sources.images import read_images

# The names of the flags and what they are if not given.
VALUES = {
    "data_root": "./cifar10_data", "cache_dir": "./feat_cache", "save_model": "", "load_model": "",
    "seed": 0, "epochs": 8, "step": 1, "wmax": 12000, "margin": 80,
    "gray_thresholds": "40,60,80,100,120,140", "grad_th": 12, "rg_tpos": "20,50,80", "yb_tpos": "20,50,80", "sat_th": "30,60,90",
    "blocks": 4, "color_hist_bins": 4, "lbp_eps": 0,
    "ca_steps": 0, "ca_birth_min": 5, "ca_birth_max": 8, "ca_survive_min": 4, "ca_survive_max": 8,
    "diag_eps": 1e-6, "diag_scale_factor": 16.0,
    "lgbm_n_estimators": 500, "lgbm_max_depth": 8, "lgbm_num_leaves": 256, "lgbm_learning_rate": 0.05,
}
SWITCHES = ("force_feat", "flip_eval", "flip_train", "no_edges", "no_grad", "no_markov", "no_lbp", "lbp_flip_invariant", "no_bias", "ca_no_diag", "diag_scale", "use_d4")
#: Taken and without effect: Spark divides the work.
NO_EFFECT = {"chunk_feat": 512, "num_workers": 1}


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="mosaiq", description=__doc__)
    for name, default in (VALUES | NO_EFFECT).items():
        p.add_argument(f"--{name}", type=type(default), default=default, help="no effect" if name in NO_EFFECT else None)
    for name in SWITCHES:
        p.add_argument(f"--{name}", action="store_true")
    p.add_argument("--diag_use_var", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--no_diag_use_var", dest="diag_use_var", action="store_false")
    p.add_argument("--classifier", choices=("perceptron", "diaglda", "lightgbm"), default="perceptron")
    p.add_argument("--d4_pooling", choices=("mean", "max", "median"), default="mean")
    return p.parse_args(argv)


def featurizer(a: argparse.Namespace) -> Featurizer:
    return Featurizer(
        gray=parse_ints(a.gray_thresholds), gradient=a.grad_th, red_green=parse_ints(a.rg_tpos), yellow_blue=parse_ints(a.yb_tpos), saturation=parse_ints(a.sat_th),
        blocks=a.blocks, bins=a.color_hist_bins, lbp_eps=a.lbp_eps, lbp_flip_invariant=a.lbp_flip_invariant, edges=not a.no_edges, gradients=not a.no_grad, markov=not a.no_markov,
        lbp=not a.no_lbp, bias=not a.no_bias, ca_steps=a.ca_steps, ca_birth=(a.ca_birth_min, a.ca_birth_max), ca_survive=(a.ca_survive_min, a.ca_survive_max), ca_diagonal=not a.ca_no_diag,
    )


def vectors(a: argparse.Namespace, images: DataFrame) -> DataFrame:
    """(img_id, label, split, flipped, f) of the images and, where they are asked for, of their mirror images, cached."""
    f = featurizer(a)
    config = f.config() | {"d4": a.d4_pooling if a.use_d4 else None}
    build = (lambda rows: f.invariant(rows, a.d4_pooling)) if a.use_d4 else f.features
    every = images.withColumn("flipped", F.lit(False))
    if a.flip_eval or a.flip_train:
        every = every.unionByName(every.withColumns({"flipped": F.lit(True)} | {c: symmetry.flip_x(F.col(c)) for c in ("r", "g", "b")}))
    own = cache.cached(every, build, a.cache_dir, "both" if a.flip_eval or a.flip_train else "own", config, a.force_feat)
    if not a.diag_scale:
        return own
    inverse = scaling.inverse_deviation(own.where("split = 'train' and not flipped"), use_var=a.diag_use_var, eps=a.diag_eps)
    path = cache.scaled_path(f"{a.cache_dir}/{cache.short_hash(config | {'input': cache.fingerprint(images)})}", a.diag_use_var, a.diag_eps, a.diag_scale_factor)
    return cache.write_scaled(own, inverse, path, a.diag_scale_factor)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    a = arguments(argv)
    spark = spark or SparkSession.builder.appName("mosaiq").getOrCreate()
    own = vectors(a, read_images(spark, a.data_root))
    train, test, mirror = own.where("split = 'train'"), own.where("split = 'test' and not flipped"), own.where("split = 'test' and flipped")
    train = train if a.flip_train else train.where("not flipped")
    by_epoch: list[float] = []
    correct = lambda scored: scored.agg(learn.accuracy(learn.argmax(F.col("scores")), F.col("label"))).first()[0]
    if a.classifier == "perceptron":
        classes = own.agg(F.max("label")).first()[0] + 1
        note = lambda _, weights: by_epoch.append(correct(learn.perceptron_scores(test, weights)))
        key = F.when(F.col("flipped"), -1 - F.col("img_id")).otherwise(F.col("img_id"))
        weights = learn.fit_perceptron(train.withColumn("img_id", key), classes, a.epochs, seed=a.seed, step=a.step, limit=a.wmax, margin=a.margin, after_epoch=note)
        score = lambda rows: learn.perceptron_scores(rows, weights)
    elif a.classifier == "diaglda":
        model = learn.fit_discriminant(train).cache()
        classes = model.first().classes
        score = lambda rows: learn.discriminant_scores(rows, model).withColumn("label", F.array_position(F.array(*map(F.lit, classes)), F.col("label")).cast("int") - 1)
    else:
        model = boosting.load_trees(spark, a.load_model) if a.load_model else boosting.fit_trees(train, rounds=a.lgbm_n_estimators, depth=a.lgbm_max_depth, leaves=a.lgbm_num_leaves, rate=a.lgbm_learning_rate)
        if a.save_model:
            boosting.save_trees(spark, model, a.save_model)
        score = lambda rows: boosting.tree_probabilities(rows, model).withColumn("label", F.array_position(F.array(*map(F.lit, model.classes)), F.col("label")).cast("int") - 1)
    scored = learn.with_flips(score(test), score(mirror)) if a.flip_eval else score(test)
    return {"classifier": a.classifier, "features": featurizer(a).size, "train": train.count(), "test": test.count(), "accuracy": correct(scored), "by_epoch": by_epoch}


if __name__ == "__main__":
    print(json.dumps(main()))
