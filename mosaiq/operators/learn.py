"""Classifiers on feature vectors, scoring and evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.functions.lambdas import let, total
from mosaiq.operators.scaling import by_position


def argmax(scores: Column) -> Column:
    """The first of the largest."""
    return let(scores, lambda s: F.array_position(s, F.array_max(s)) - 1).cast("int")


def runner_up(scores: Column) -> Column:
    """The first of the largest among the others."""
    return let(scores, lambda s: argmax(F.transform(s, lambda v, i: F.when(i != argmax(s), v))))


def dot(x: Column, w: Column) -> Column:
    return total(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0))


def stratified_split(rows: DataFrame, key: str, label: str, test: float = 0.1, seed: int = 42) -> DataFrame:
    """``held_out``: the first tenth of each label by a hash of the key. The hash is cut into 4096 slots, which are
    counted by label; only the slot that the limit falls in is ranked."""
    h = F.xxhash64(key, F.lit(seed))
    own = rows.withColumns({"_h": h, "_slot": F.pmod(F.shiftright(h, 20), F.lit(4096))})
    slots = own.groupBy(F.col(label).alias("_l"), F.col("_slot").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))


    order = Window.partitionBy("_l").orderBy("_s")
    limits = slots.select("_l", "_s", "_n", (F.sum("_n").over(order) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy("_l")).alias("_all"))
    met = own.join(limits, own[label].eqNullSafe(F.col("_l")) & (F.col("_slot") == F.col("_s")))
    quota = F.ceil(F.col("_all") * test)
    rank = F.row_number().over(Window.partitionBy("_l", "_slot").orderBy("_h", key))
    return met.withColumn("held_out", F.col("_before") + rank <= quota).select(*rows.columns, "held_out")


def epoch_order(rows: DataFrame, key: str, epoch: int, seed: int = 0) -> DataFrame:
    """A fixed shuffle for each epoch."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(epoch), F.lit(seed)), key)


def coin(key: str, epoch: int, seed: int = 0) -> Column:
    """A fair coin for each row and epoch."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(epoch), F.lit(seed + 1)), F.lit(2)) == 1


# ---- diagonal discriminant: class means, pooled variance, log priors


def fit_discriminant(rows: DataFrame, column: str = "f", label: str = "label", eps: float = 1e-9) -> DataFrame:
    """One row: classes, w (one array for each class) and const, sorted by class."""
    x = F.col("x").cast("double")
    each = by_position(rows, column, label).groupBy(label, "pos").agg(F.avg(x).alias("mu"), F.count("x").alias("n"), (F.var_pop(x) * F.count("x")).alias("ss"))
    pooled = each.groupBy("pos").agg(F.greatest(F.sum("ss") / F.sum("n"), F.lit(eps)).alias("s2"))
    sizes = each.where("pos = 0").select(F.col(label).alias("_l"), "n", F.log((F.col("n") + 1e-12) / F.sum("n").over(_all())).alias("prior"))
    joined = each.join(pooled, "pos")
    by_class = joined.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", (F.col("mu") / F.col("s2")).alias("w")))), lambda s: s["w"]).alias("w"), (-0.5 * F.sum(F.col("mu") * F.col("mu") / F.col("s2"))).alias("c"))
    full = by_class.join(sizes, F.col(label) == F.col("_l"))
    listed = full.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), "w", (F.col("c") + F.col("prior")).alias("c")))).alias("m"))
    return listed.select(F.transform("m", lambda s: s["label"]).alias("classes"), F.transform("m", lambda s: s["w"]).alias("w"), F.transform("m", lambda s: s["c"]).alias("const"))


def _all():


    return Window.partitionBy(F.lit(0))


def discriminant_scores(rows: DataFrame, model: DataFrame, column: str = "f") -> DataFrame:
    """``scores`` by class; ``model`` is one row of classes times positions and is broadcast."""
    own = rows.crossJoin(F.broadcast(model))
    return own.withColumn("scores", F.transform("w", lambda w, k: dot(F.col(column), w) + F.get("const", k))).drop("w", "const")


def with_flips(scored: DataFrame, flipped: DataFrame, key: str = "img_id") -> DataFrame:
    """Adds the scores of the mirror images."""
    other = flipped.select(F.col(key).alias("_key"), F.col("scores").alias("_scores"))
    return scored.join(other, scored[key] == other["_key"]).withColumn("scores", F.zip_with("scores", "_scores", lambda a, b: a + b)).drop("_key", "_scores")


def accuracy(predicted: Column, label: Column) -> Column:
    return F.avg((predicted == label).cast("double"))


# ---- averaged clipped perceptron


def perceptron_pass(batches: Iterable[pd.DataFrame], start: np.ndarray, step: int, limit: int, margin: int) -> tuple[np.ndarray, np.ndarray, int]:
    """One pass over rows (label, f), from the weights ``start``: the weights in the end, their sum over all rows, and the number of rows.
    A row changes the weights unless its label leads the best other class by ``margin``."""
    w, total, seen = start.copy(), np.zeros_like(start), 0
    for b in batches:
        for x, label in zip(np.stack(b["f"].to_numpy()).astype(np.int64) if len(b) else [], b["label"], strict=True):
            scores = w @ x
            others = np.delete(np.arange(len(w)), label)
            rival = others[np.argmax(scores[others])]  # the first of the largest
            first = scores[rival] > scores[label] or (scores[rival] == scores[label] and rival < label)
            if first or scores[label] - scores[rival] < margin:
                w[label] = np.clip(w[label] + step * x, -limit, limit)
                w[rival] = np.clip(w[rival] - step * x, -limit, limit)
            total += w
            seen += 1
    return w, total, seen


def _pass(batches: Iterator[pd.DataFrame], start: np.ndarray, step: int, limit: int, margin: int) -> Iterator[pd.DataFrame]:
    """``perceptron_pass`` over the rows of a task, a row for each class."""
    w, total, seen = perceptron_pass(batches, start, step, limit, margin)
    if seen:
        yield pd.DataFrame({"label": range(len(w)), "w": list(w), "total": list(total), "seen": seen})


def fit_perceptron(rows: DataFrame, classes: int, epochs: int = 8, shards: int = 8, key: str = "img_id", column: str = "f", label: str = "label", seed: int = 0, step: int = 1, limit: int = 12_000, margin: int = 80, after_epoch: Callable[[int, DataFrame], None] | None = None) -> DataFrame:
    """(label, w): the floor of the average of the weights after each row. The rule depends on the order of rows, which a hash of
    the key and the epoch gives. In each epoch every one of ``shards`` tasks goes over its rows once, batch by batch, from the weights so
    far, and the weights of all tasks, by their rows, are averaged for the next one (iterative parameter mixing); one shard is
    the plain sequential rule, more are faster, whatever the number of rows. What the driver holds is the model. ``after_epoch`` gets the number of the epoch and the weights (label, w), not averaged."""
    spark = rows.sparkSession
    own = rows.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"), F.col(column).alias("f"))
    width = own.agg(F.max(F.size("f"))).first()[0]
    w = np.zeros((classes, width or 0), np.int64)
    total, seen = np.zeros_like(w), 0
    for epoch in range(epochs):
        order = F.xxhash64("key", F.lit(epoch), F.lit(seed))
        dealt = own.withColumn("order", order).repartition(shards, "order").sortWithinPartitions("order", "key")
        trained = dealt.mapInPandas(lambda it, w=w: _pass(it, w, step, limit, margin), "label int, w array<bigint>, total array<bigint>, seen bigint")
        each = trained.select("label", "seen", F.posexplode(F.arrays_zip("w", "total")).alias("pos", "v"))
        merged = each.groupBy("label", "pos").agg(F.floor(F.sum(F.col("v.w") * F.col("seen")) / F.sum("seen")).alias("w"), F.sum("v.total").alias("total"), F.sum("seen").alias("seen")).collect()
        for r in merged:
            w[r.label, r.pos] = r.w
            total[r.label, r.pos] += r.total
        seen += merged[0].seen if merged else 0
        if after_epoch:
            after_epoch(epoch, spark.createDataFrame([(i, [int(v) for v in x]) for i, x in enumerate(w)], "label int, w array<bigint>"))
    mean = total // max(1, seen)
    return spark.createDataFrame([(i, [int(v) for v in x]) for i, x in enumerate(mean)], "label int, w array<bigint>")


def perceptron_scores(rows: DataFrame, weights: DataFrame, column: str = "f") -> DataFrame:
    model = weights.agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "w"))), lambda s: s["w"]).alias("_w"))
    own = rows.crossJoin(F.broadcast(model))
    return own.withColumn("scores", F.transform("_w", lambda w: total(F.zip_with(F.col(column), w, lambda a, b: a.cast("bigint") * b)))).drop("_w")


# ---- trees


def fit_forest(rows: DataFrame, column: str = "f", label: str = "label", trees: int = 50, depth: int = 8, seed: int = 0) -> PipelineModel:
    ready = rows.select(F.col(label).cast("double").alias("label"), array_to_vector(F.transform(column, lambda v: v.cast("double"))).alias("features"))
    return Pipeline(stages=[RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed)]).fit(ready)


def fit_boosted(rows: DataFrame, column: str = "f", label: str = "label", rounds: int = 20, depth: int = 4, rate: float = 0.1, held_out: str | None = None, seed: int = 0) -> PipelineModel:
    """Boosted trees, one against the rest. ``held_out`` names a boolean column: its rows stop the boosting early."""
    extra = [F.col(held_out)] if held_out else []
    ready = rows.select(F.col(label).cast("double").alias("label"), array_to_vector(F.transform(column, lambda v: v.cast("double"))).alias("features"), *extra)
    one = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed)
    if held_out:
        one = one.setValidationIndicatorCol(held_out)
    return Pipeline(stages=[OneVsRest(classifier=one, parallelism=2)]).fit(ready)


def predict(model: PipelineModel, rows: DataFrame, column: str = "f") -> DataFrame:
    out = model.transform(rows.withColumn("features", array_to_vector(F.transform(column, lambda v: v.cast("double")))))
    return out.withColumn("predicted", F.col("prediction").cast("int")).drop("features", "prediction", "rawPrediction")


def with_mean_probabilities(model: PipelineModel, rows: DataFrame, flipped: DataFrame, key: str = "img_id", column: str = "f") -> DataFrame:
    """``rows`` with ``scores``: the mean of the probabilities of an image and of its mirror image."""
    both = with_flips(probabilities(model, rows, column), probabilities(model, flipped, column), key)
    return both.withColumn("scores", F.transform("scores", lambda p: p / 2))


# ---- ridge


def fit_ridge(rows: DataFrame, classes: int, alpha: float = 1.0, column: str = "f", label: str = "label") -> list[LinearRegressionModel]:
    """For each class the plane of least squares to 1 for its rows and -1 for others, plus ``alpha`` times the squared length of
    its slopes: normal equations, summed up by Spark."""
    ready = rows.select(F.col(label).alias("own"), array_to_vector(F.transform(column, lambda v: v.cast("double"))).alias("features"))
    sizes = {r[0]: r[1] for r in ready.groupBy("own").count().collect()}
    n = max(1, sum(sizes.values()))

    def one(c: int) -> LinearRegressionModel:
        share = sizes.get(c, 0) / n
        spread = 2 * (share * (1 - share)) ** 0.5  # Spark divides the penalty by the deviation of the labels
        model = LinearRegression(regParam=alpha * spread / n, elasticNetParam=0.0, standardization=False, solver="normal")
        return model.fit(ready.select("features", F.when(F.col("own") == c, 1.0).otherwise(-1.0).alias("label")))

    return [one(c) for c in range(classes)]


def ridge_scores(rows: DataFrame, models: list[LinearRegressionModel], column: str = "f") -> DataFrame:
    def score(m: LinearRegressionModel) -> Column:
        return dot(F.transform(column, lambda v: v.cast("double")), F.array(*[F.lit(float(x)) for x in m.coefficients])) + F.lit(float(m.intercept))

    return rows.withColumn("scores", F.array(*[score(m) for m in models]))


# ---- fitted models on disk


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """A missing path is an error: nothing is trained instead."""
    return PipelineModel.load(path)


def probabilities(model: PipelineModel, rows: DataFrame, column: str = "f") -> DataFrame:
    out = model.transform(rows.withColumn("features", array_to_vector(F.transform(column, lambda v: v.cast("double")))))
    return out.withColumn("scores", vector_to_array("probability")).drop("features", "prediction", "rawPrediction", "probability")


def one_hot_scores(model: PipelineModel, rows: DataFrame, column: str = "f") -> DataFrame:
    """``rows`` with ``scores``: the model's raw score of each class (one against the rest), or its probabilities."""
    out = model.transform(rows.withColumn("features", array_to_vector(F.transform(column, lambda v: v.cast("double")))))
    of = "probability" if "probability" in out.columns else "rawPrediction"
    return out.withColumn("scores", vector_to_array(of)).select(*rows.columns, "scores")
