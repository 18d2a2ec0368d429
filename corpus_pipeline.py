"""The corpus pipeline: five stages from ``documents`` to packed training sequences."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm import minhash, mixing, packing, secrets, toxicity
from mosaiq.llm.common import delete, id_crc, read, shared_folder


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't score as toxic. The model learns from the labels of the rows that op4 learns from. Null and
    empty texts are never toxic, repeated rows share their fate, all columns stay, no rows give none; without labels
    of both classes every document stays."""
    learn = docs.where(F.pmod(id_crc("doc_id"), F.lit(3)) != 1)
    return toxicity.drop_toxic(docs, toxicity.fit(toxicity.labelled_texts(learn, read(spark, sf_dir, "labels"))))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id. Null texts are empty ones, which are one
    group; of repeated rows one stays; all columns stay; no rows give none."""
    return minhash.drop_near_duplicates(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind, and ``n_chars`` of those, if there is such a column, counted anew. Null and empty texts and
    repeated rows stay as they are, as do all other columns; no rows give none."""
    known = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    found = secrets.find_secrets(known)
    clean = secrets.redact(F.col("text"), F.col("secrets"))
    put = {"text": clean}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.when(F.size("secrets") > 0, F.length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return found.select(*[put[c].alias(c) if c in put else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mixed stream, those of sources below their target repeated. A null source is a
    source; every row, repeated ones too, is there at least once; all columns stay; no rows give none."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: one row for each piece of a document in a bin. A null text gives an empty piece, an empty
    one its end, repeated rows are packed each, other columns are left out; no rows give none."""
    return packing.pack_texts(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: A learnt classifier and consistent sampling have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each reads what the one before has written to the shared folder. What a stage
    has read is deleted when its own result is written; the last one's input stays, for the result reads it."""
    docs, folder, before = read(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
