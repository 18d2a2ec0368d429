"""What the registered queries return: columns, types, one row for each row of the table, and no caps."""

import zlib

import pytest

from mosaiq.llm import queries

RETURNS = {
    "op1_shard_documents": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op2_judge_pages": "page_id bigint, host string, path string, rule string, verdict string",
    "op4_score_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op6_near_duplicates": "doc_id bigint, class_id bigint, kept boolean",
    "op8_find_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op9_near_vectors": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op10_score_texts": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op11_collapse_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    "op12_align_tokenizers": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
    "op13_assemble_captures": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
}


@pytest.mark.parametrize("name", list(RETURNS))
def test_columns_and_rows(name, spark, sf_dir):
    df = queries.queries()[name](spark, sf_dir)
    kinds = dict(df.dtypes)
    for field in RETURNS[name].split(", "):
        column, kind = field.split(" ")
        assert kinds[column] == kind, column
    table, key = {"op2": ("pages", "page_id"), "op9": ("embeddings", "vec_id"), "op13": ("pages", "page_id")}.get(name.split("_")[0], ("documents", "doc_id"))
    want = sorted(r[0] for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key).collect())
    assert sorted(r[0] for r in df.select(key).collect()) == want


def test_shards_hold_nearly_equal_bytes(spark, sf_dir):
    rows = queries.op1_shard_documents(spark, sf_dir).collect()
    size = {s: sum(r["size"] for r in rows if r.shard == s) for s in range(8)}
    assert set(size) == {r.shard for r in rows}
    assert max(size.values()) - min(size.values()) <= 0.02 * max(size.values())


def test_held_out_rows(spark, sf_dir):
    for name, by, rest in (("op4_score_toxicity", 3, 1), ("op10_score_texts", 7, 2)):
        for r in queries.queries()[name](spark, sf_dir).collect():
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % by == rest)


def test_packing_keeps_all_tokens(spark, sf_dir):
    import re

    rows = queries.op7_pack_documents(spark, sf_dir).collect()
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert got == {d.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) + 1 for d in docs}


def test_near_vectors_of_the_table(spark, sf_dir):
    import numpy as np

    own = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    v = np.array([r.embedding for r in own], float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    label = np.array([r.label for r in own])
    near = (v @ v.T >= 0.98) & (label[:, None] == label[None, :])
    want = {r.vec_id: int(n) - 1 for r, n in zip(own, near.sum(axis=1), strict=True)}
    assert {r.vec_id: r.n_links for r in queries.op9_near_vectors(spark, sf_dir).collect()} == want


def test_counts_of_secrets_against_plain_patterns(spark, tmp_path):
    """The query itself: its three counts and its hash, over the table and some rows with several secrets."""
    import hashlib
    import re

    kinds = (("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16))
    more = [(10_000_000, 'password=abcdefghijkl token: "ABCDEFGHIJKLMNOP" AKIA00000000000000 0123456789abcdef 0123456789abcdef0 deadbeef'), (10_000_001, "AKIA1 secret=short"), (10_000_002, None)]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    got = queries.op8_find_secrets(spark, str(tmp_path)).collect()
    assert len(got) == len(text)
    for r in got:
        spans = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, pattern, group, least) in enumerate(kinds) for m in re.finditer(pattern, text[r.doc_id], re.A) if len(m[group]) >= least]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in spans) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(x[2] for x in sorted(spans)).encode()).hexdigest()
    assert sum(r.n_assign + r.n_access + r.n_hex > 0 for r in got) > 20
