"""The language model's buckets stay bounded whatever is in every text."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mosaiq.llm import katz


def test_a_history_of_every_text_is_dealt_to_many_buckets():
    """Every text begins alike, and one trigram is in all: no bucket gets more than its share of either."""
    texts = pa.array([f"the same begin x{i} y{i}" for i in range(20_000)])
    hashes, at, _ = katz.tokens(texts)
    counts = np.bincount(at)
    frequent = counts > 1000
    head = katz.Head(len(at), len(hashes), hashes[frequent], counts[frequent], -(-counts[frequent] // 500), 200)
    for about in (True, False):
        rows: dict[int, int] = {}
        for blob in katz._blobs(katz.tokens(texts), np.zeros(len(texts), np.int64), 0, head, about):
            rows[blob[0]] = rows.get(blob[0], 0) + blob[2]
        assert sum(rows.values()) == len(at) if about else sum(rows.values()) <= len(at)
        assert max(rows.values()) < 4 * len(at) / 200, max(rows.values())


def test_blobs_and_buckets_give_the_trigrams_back():
    texts = pa.array(["a b a b a b c", "", "b a b", "rare1 a rare2 b rare1 a rare2", "a b a b"])
    held = np.array([0, 0, 1, 0, 0])
    hashes, at, _ = katz.tokens(texts)
    name = {int(h): w for h, w in zip(hashes, ["?"] * len(hashes), strict=True)}
    counts = np.bincount(at)
    some = counts >= 3
    head = katz.Head(len(at), len(hashes), hashes[some], counts[some], np.where(counts[some] > 4, 2, 1), 3)
    own = lambda t: [katz.PAD, katz.END, *[int(h) for h in katz.tokens(pa.array([t]))[0][katz.tokens(pa.array([t]))[1]]]]
    want: dict[tuple, int] = {}
    for k, t in enumerate(texts.to_pylist()):
        w = own(t)
        for g in zip(w, w[1:], w[2:], strict=False):
            want[g] = want.get(g, 0) + (1 - int(held[k]))
    names = [x.split(" ")[0] for x in katz._BLOB.split(", ")]
    for about in (True, False):
        got: dict[tuple, int] = {}
        blobs = list(katz._blobs(katz.tokens(texts), held, 0, head, about))
        for bucket in {b[0] for b in blobs}:
            table = pa.table({k: [b[i] for b in blobs if b[0] == bucket] for i, k in enumerate(names)})
            b = katz.Bucket(table, head)
            for i, c in enumerate(b.c3):
                g = (int(b.words[b.u[i]]), int(b.words[b.v[b.pair[i]]]), int(b.words[b.w[b.pair[i]]]))
                got[g] = got.get(g, 0) + int(c)
        assert {g: n for g, n in got.items() if n} == {g: n for g, n in want.items() if n} and name


def test_sums_of_texts_travel_in_arrays(spark, monkeypatch):
    """Texts of unlike words meet nearly all buckets; the rows that buckets send are not as many as buckets times texts."""
    monkeypatch.setattr(katz, "BUCKET", 100)
    seen = []
    monkeypatch.setattr(katz, "scored", lambda *given, f=katz.scored: seen.append(f(*given).count()) or f(*given))
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 31 + k * k) % 997}" for k in range(50))) for i in range(200)], "doc_id long, text string").repartition(2)
    got = {r.doc_id: r for r in katz.score_texts(docs, F.col("doc_id") % 5 == 0).collect()}
    assert sorted(got) == list(range(200)) and all(r.n_tokens == 51 and r.held_out == (i % 5 == 0) and r.score < 0 for i, r in got.items())
    assert 20 < seen[0] < 200, seen  # 82 buckets, two input partitions


@pytest.mark.parametrize("about", [True, False])
def test_trigrams_are_the_same_however_they_are_sorted(monkeypatch, about):
    """By numbers that hold what is sorted, or, where these are too long, by the order of a part of them."""
    r = np.random.default_rng(4)
    texts = pa.array([" ".join(f"w{int(x)}" for x in r.zipf(1.5, 60) % 300) for _ in range(80)] + ["", " \n ", " a  a\ta "])
    hashes, at, owner = katz.tokens(texts)
    counts = np.bincount(at)
    some = counts > 3
    head = katz.Head(len(at), len(hashes), hashes[some], counts[some], np.where(counts[some] > 40, -(-counts[some] // 40), 1), 20)
    names = [x.split(" ")[0] for x in katz._BLOB.split(", ")]

    def told() -> dict:
        blobs, out = list(katz._blobs((hashes, at, owner), np.arange(len(texts)) % 2, 0, head, about)), {}
        for bucket in {b[0] for b in blobs}:
            b = katz.Bucket(pa.table({k: [x[i] for x in blobs if x[0] == bucket] for i, k in enumerate(names)}), head)
            for text, tri, times in zip(b.text, b.tri, b.times, strict=True):
                p = b.pair[tri]
                g = (bucket, int(text), int(b.words[b.u[tri]]), int(b.words[b.v[p]]), int(b.words[b.w[p]]))
                out[g] = out.get(g, 0) + int(times)
        return out

    want = told()
    assert sum(want.values()) == (len(at) if about else int((owner % 2 == 0).sum()))
    monkeypatch.setattr(katz, "BITS", 1)
    assert told() == want


def test_words_of_all_slices_are_not_sorted_again_for_each(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(katz, "slices", lambda texts: ((i, texts.slice(i, 1)) for i in range(len(texts))))
    monkeypatch.setattr(katz.np, "unique", lambda x, *a, f=np.unique, **b: sizes.append(len(x)) or f(x, *a, **b))
    words: dict[str, int] = {}
    texts = [" ".join(f"w{i}x{k % 40}" for k in range(50)) for i in range(100)]
    for w in " ".join(texts).split():
        words[w] = words.get(w, 0) + 1
    made = []

    class Told:
        def mapInArrow(self, run, _):  # noqa: N802
            made.extend(run(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])))
            return spark.createDataFrame(pa.Table.from_batches(made).to_pandas())

    got = {r.word: r.n for r in katz.word_counts(Told()).collect()}
    assert sorted(got.values()) == sorted([*words.values(), 100])
    assert sum(sizes) < 4 * 50 * 100, sum(sizes)
