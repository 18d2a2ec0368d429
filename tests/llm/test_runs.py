"""Periodic runs against their definition, on small alphabets, on whole tables and on edge cases."""

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mosaiq.llm import queries
from mosaiq.llm.runs import collapse_runs, runs

WORD = r"[^\x20\x09-\x0D]+"


def plain_runs(x, least=24, times=3):
    """For every period the stretches of equal words at that distance; those of no smaller period count."""
    n, out = len(x), []
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and x[i] == x[i + p]:
                i += 1
            size = i - s + p
            if i > s and size >= max(least, times * p) and not any(all(x[k] == x[k + q] for k in range(s, s + size - q)) for q in range(1, p)):
                out.append((s, size, p))
            i += i == s
    return sorted(out, key=lambda f: (f[0], f[2]))


def of_row(doc_id, text):
    w = re.findall(WORD, text or "")
    h = zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, size, p in found for i in range(s + p, s + size)}
    best = min(found, key=lambda f: (-Fraction(f[1], f[2]), f[0], f[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{size},{p}\n" for s, size, p in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(1, 7)), max_size=12), st.sampled_from([(1, 2), (4, 2), (1, 3), (9, 3), (24, 3)]))
def test_all_runs_of_small_alphabets(parts, limits):
    x = [v for word, times in parts for v in word * times]
    assert runs(x, 3, *limits) == plain_runs(x, *limits)


@pytest.mark.parametrize("make", [lambda n: [0] * n, lambda n: [0, 1] * (n // 2), lambda n: list(range(n)), lambda n: [bin(i).count("1") & 1 for i in range(n)], lambda n: sum(([0] * k + [1] for k in range(int((2 * n) ** 0.5))), [])])
def test_time_grows_with_the_text(make):
    took = []
    for n in (40_000, 160_000):
        x, began = make(n), time.process_time()
        runs(x, max(x))
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.2


def test_query_on_a_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    small = {r.doc_id: r.text for r in docs if len(r.text or "") < 12_000}
    got = [tuple(r) for r in queries.op11_collapse_runs(spark, sf_dir).collect()]
    assert len(got) == len(docs)
    checked = [g for g in got if g[0] in small]
    assert sorted(checked) == sorted(of_row(k, t) for k, t in small.items())
    assert sum(g[1] > 0 for g in checked) > 5


def test_edge_cases(spark, docs, none, clash, tmp_path):
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    extra = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(("a " * 24, "a " * 23, "x " + "a b c d e f g h " * 3 + "a", "a\tb\n" * 50 + "é é", " ".join(["q"] * 30 + ["r"] * 30)))] + [(10_000, "a " * 24)] * 2, "doc_id long, text string")
    extra.write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    want = [of_row(r.doc_id, r.text) for r in docs.select("doc_id", "text").unionByName(extra).collect() if len(r.text or "") < 12_000]
    got = [tuple(r) for r in queries.op11_collapse_runs(spark, str(tmp_path)).collect()]
    short = [g for g in got if g[0] not in (103, 104, 105)]
    assert sorted(short, key=str) == sorted(want, key=str) and len(got) == docs.count() + 7
    assert collapse_runs(none).count() == 0
    assert collapse_runs(clash.withColumn("runs", clash.doc_id)).columns == [c for c in clash.columns if c != "text"] + ["runs", "collapsed"]


def test_real_outputs(spark):
    out = collapse_runs(spark.createDataFrame([("in b c " + "b c " * 14 + "out",)], "text string")).first()
    assert [tuple(r) for r in out.runs] == [(1, 30, 2)] and out.collapsed == "in b c out"
