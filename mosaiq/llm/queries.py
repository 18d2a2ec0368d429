"""Queries of this subpackage: ``opN_<name>`` applies operator N to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm import alignment, embeddings, katz, minhash, mixing, packing, quality, runs, secrets, sharding, sql, toxicity, urls, warc
from mosaiq.llm.common import cut, delete, id_crc, let, read, shared_folder, words, workspace


def op1_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(read(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_judge_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_pages(read(spark, sf_dir, "pages"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(read(spark, sf_dir, "documents")).select("doc_id", "source", "block", "place", "epoch", "slot")


def op4_score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.pmod(id_crc("doc_id"), F.lit(3)) == 1
    marked = toxicity.labelled_texts(docs.where(~held_out), read(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, toxicity.fit(marked))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_passages", "n_toxic_tokens")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(read(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = ~F.col("base_failed") & (F.size("failed") == 0)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.array_join("failed", ",").alias("failed"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "copy_of", "class_id", "kept")


def op7_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def _is_rule(place: int):
    """Whether a span is of the rule at that place. (Spark hands a function of two parameters the element's index.)"""
    return lambda span: span["order"] == place


def op8_find_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    n = len(secrets.BASE)
    base = F.filter("secrets", lambda s: s["order"] < n)
    counts = [F.size(F.filter("secrets", _is_rule(i))).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(secrets.BASE)]
    return out.select("doc_id", *counts, F.sha2(secrets.spans_text(base), 256).alias("base_sha256"), secrets.spans_text(F.col("secrets")).alias("spans"))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(read(spark, sf_dir, "embeddings"))


def op10_score_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return katz.score_texts(docs, F.pmod(id_crc("doc_id"), F.lit(7)) == 2)


def made_periodic(doc_id: str, text: str):
    """The text of every tenth id (by its CRC h) with the words from a = g % n on made periodic: word i is word a + (i - a) % p of the n words,
    g = h // 10, p = 1 + (n - a) // (3 + g % 8). Words are then joined by one space; other texts stay."""
    h = id_crc(doc_id)
    g = F.floor(h / 10)

    def of(w):
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    return F.when((h % 10 == 0) & F.col(text).rlike(r"[^\x20\x09-\x0D]"), let(words(text), of)).otherwise(F.col(text))


def op11_collapse_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", made_periodic("doc_id", "text").alias("text"))
    found = runs.collapse_runs(docs)
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    best = F.aggregate("runs", F.get("runs", 0), lambda best, r: F.when(more(r, best), r).otherwise(best))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    own = found.select("doc_id", "runs", best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length div best.period")
    return own.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    with workspace(spark) as keep:
        aligned = alignment.align(read(spark, sf_dir, "documents").select("doc_id", "text"))
        digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
        own = keep(aligned.select("doc_id", "n_a", "n_b", "n_groups", digest.alias("groups_sha256"), "a", "b", "n", F.monotonically_increasing_id().alias("row")))
        sums = alignment.link_sums(own)
        out = own.drop("a", "b", "n").join(sums, "row", "left")
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
        return cut(out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256"))


def op13_assemble_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    with workspace(spark) as keep:
        folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
        try:
            warc.write_archives(read(spark, sf_dir, "pages"), folder)
            records = keep(warc.read_archives(spark, folder).drop("payload"))
        finally:
            delete(spark, folder)
        found = warc.page_captures(keep(warc.captures(records)))
        return cut(found.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to_page").alias("refers_to")))


# What of op1, op2 and op10 no method decides, from their own results, so that SQL can be held against it.


def fixed1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and checksums, and two laws: equal texts are in one shard, and a shard's slots have no gaps."""
    rows = cut(op1_shard_documents(spark, sf_dir))
    groups = rows.groupBy("size", "text_crc32").agg(F.countDistinct("shard").alias("shards_of_text"))
    full = rows.groupBy("shard").agg(((F.max("slot") + 1 == F.count(F.lit(1))) & (F.countDistinct("slot") == F.count(F.lit(1)))).alias("gapless"))
    return rows.join(groups, ["size", "text_crc32"]).join(full, "shard").select("doc_id", "size", "text_crc32", "law", "shards_of_text", "gapless")


def fixed2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule, and the verdict where a rule decides it."""
    out = op2_judge_pages(spark, sf_dir)
    return out.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


def fixed10_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that the counts of single tokens give."""
    out = op10_score_texts(spark, sf_dir)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith(("op", "fixed")) and callable(f)}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
