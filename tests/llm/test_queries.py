"""The registered queries on the small tables, and the pipeline against its parts."""

import corpus_pipeline
from mosaiq.llm import minhash, queries


def test_pipeline(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.toxicity_stage(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    kept = kept.cache()
    left = minhash.drop_near_duplicates(kept)
    assert {r.doc_id for r in out} == {r.doc_id for r in left.collect()}
    assert not any("AKIA" in r.text and len(r.text.split("AKIA")[1].split()[0]) >= 14 for r in out)


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries() if k.startswith("op")) == list(range(1, 14))
