"""The best order of passes over masks: a search in which orders share what their beginnings have made.

One level of the search applies every pass to the masks of every order so far, in one Spark job for all of them, and writes the masks down; so
each beginning is made once, from that one pass shorter. Without a beam all orders are tried; with one, only the best of each level go on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.functions.lambdas import total
from mosaiq.functions.storage import workspace

Pass = Callable[[Column], Column]


def separation(masks: DataFrame) -> DataFrame:
    """(order, score): how much of the variance of the set pixels lies between labels, 0 to 1. ``masks``: (order, label, m)."""
    n = total(F.transform("m", lambda v: F.bit_count(v).cast("bigint"))).cast("double")
    own = masks.select("order", "label", n.alias("n")).groupBy("order", "label").agg(F.count("n").alias("k"), F.avg("n").alias("mean"), F.var_pop("n").alias("var"))
    whole = own.groupBy("order").agg((F.sum(F.col("k") * F.col("mean")) / F.sum("k")).alias("_mean"))
    met = own.join(F.broadcast(whole), "order")  # one row for each order of a level
    off = F.col("mean") - F.col("_mean")
    between, within = F.sum(F.col("k") * off * off), F.sum(F.col("k") * F.col("var"))
    return met.groupBy("order").agg(F.coalesce(F.try_divide(between, between + within), F.lit(0.0)).alias("score"))


def search_order(masks: DataFrame, passes: dict[str, Pass], beam: int | None = None, score: Callable[[DataFrame], DataFrame] = separation) -> DataFrame:
    """(order, score, best): the orders of all ``passes``, each used once, that were tried to the end, as text (``a>b>c``), by the score of what they
    make of ``masks`` (label, m). ``best``: the greatest score, of several the first by name. ``beam``: how many of a level go on; None: all."""
    spark = masks.sparkSession
    if not passes:
        raise ValueError("no passes")
    with workspace(spark) as keep:
        state = masks.select(F.lit("").alias("order"), "label", "m")
        for _ in passes:
            used = lambda name: F.array_contains(F.split("order", ">"), name)
            steps = [state.where(~used(name)).select(F.concat_ws(">", F.nullif("order", F.lit("")), F.lit(name)).alias("order"), "label", f(F.col("m")).alias("m")) for name, f in passes.items()]
            level = steps[0]
            for s in steps[1:]:
                level = level.unionByName(s)
            state = keep(level)
            found = keep(score(state))
            if beam is not None:
                chosen = [r.order for r in found.orderBy(F.desc("score"), "order").limit(beam).collect()]
                state, found = state.where(F.col("order").isin(chosen)), found.where(F.col("order").isin(chosen))
        best = found.orderBy(F.desc("score"), "order").first()
        rows = [(r.order, r.score, r.order == best.order) for r in found.collect()] if best else []  # one for each order tried
    return spark.createDataFrame(rows, "order string, score double, best boolean")
