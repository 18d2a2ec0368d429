"""Every stage of the pipeline on nulls, no rows, repeats, ties, long texts, clashing names, and without ``n_chars``."""

import collections

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

CLASH = ("row", "key", "slot", "secrets", "node", "score", "toxic", "bin", "label", "copy", "place", "_secret_key")
FILTERS = dict(corpus_pipeline.STAGES[:-1])


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    long = "long " + " ".join(f"w{i % 9973}" for i in range(1_500_000))  # some 10 MB
    more = spark.createDataFrame([(900, long, "en", "s0", len(long)), (901, long + " more", "en", "s0", 5)], docs.schema)
    docs.unionByName(more).write.parquet(f"{path}/documents.parquet")
    docs.where("doc_id < 40").select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic")).write.parquet(f"{path}/labels.parquet")
    return path


def rows(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("name", list(FILTERS))
def test_stages(spark, docs, none, folder, name):
    run = FILTERS[name]
    key = ("doc_id", F.md5(F.coalesce("text", F.lit("null"))), "lang", "source")
    small = docs.where("doc_id is null or doc_id not in (103, 104, 105)")
    got = rows(run(spark, small, folder), *key)
    assert run(spark, none, folder).count() == 0 and run(spark, none, folder).columns == none.columns
    wide = small.select("*", *[F.lit("mine").alias(c) for c in CLASH])
    out = run(spark, wide, folder)
    assert out.columns == wide.columns and rows(out, *key) == got and rows(out, *[F.col(f"`{c}`") for c in CLASH]).keys() == {("mine",) * len(CLASH)}
    bare = small.select("doc_id", "text", "source")
    assert run(spark, bare, folder).columns == bare.columns and run(spark, bare, folder).count() == sum(got.values())
    before = rows(small, *key)
    assert got.keys() <= before.keys() or name == "secrets"
    assert all(n <= before.get(k, n) for k, n in got.items()) or name in ("secrets", "mixing")
    assert name == "toxicity" or sum(got.values()) >= (small.select("text").distinct().count() - 4 if name == "near_duplicates" else sum(before.values()))


def test_whole_run_with_every_case(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert len(ids & {900, 901}) == 1  # two near copies of 10 MB
    assert ids <= {r.doc_id for r in docs.select("doc_id").collect()} and len(ids) > 30
    whole = out.where("doc_id in (900, 901)").agg(F.sum("length")).first()[0]
    assert whole % 1_500_002 in (0, 1_500_001, 1)  # all its words and an end, as often as its source came round
    docs.limit(0).write.parquet(f"{folder}/none/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{folder}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0
