"""Pairs of exactly the limit, just above and just below it."""

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from mosaiq.llm import minhash


def pair(shared, one, two):
    """Two texts of distinct words, with so many common words at the beginning and own ones after them."""
    word = lambda k, n: [f"{k}{i}" for i in range(n)]
    return " ".join(word("s", shared) + word("a", one)), " ".join(word("s", shared) + word("b", two))


@pytest.mark.parametrize(("shared", "one", "two", "near"), [(404, 50, 50, True), (404, 37, 63, True), (404, 100, 0, True), (403, 50, 50, False), (404, 50, 51, False), (8, 1, 0, True), (8, 1, 1, False), (2004, 333, 167, True)])
def test_similarity_at_the_limit(shared, one, two, near):
    texts = pa.array(pair(shared, one, two))
    doc, shingle, times = minhash.counted(*minhash.shingles(texts))
    (x, nx), (y, ny) = ((shingle[doc == k], times[doc == k]) for k in (0, 1))
    got = minhash.similarity(x, nx, y, ny, minhash.Idf([], 100))
    assert got == Fraction(shared - 4, shared - 4 + one + two) and (got >= minhash.LEAST) == near == minhash.is_near(x, nx, y, ny, minhash.Idf([], 100))


def test_similarity_with_several_weights():
    x, y = np.arange(6, dtype=np.uint64), np.arange(2, 8, dtype=np.uint64)
    nx, ny = np.array([1, 2, 3, 1, 1, 5]), np.array([2, 1, 4, 1, 1, 1])
    idf = minhash.Idf([(2, 30), (5, 60)], 100)
    wx, wy = nx * idf(x), ny * idf(y)
    both = sum(min(nx[i], ny[i - 2]) * float(idf(x[i : i + 1])[0]) for i in range(2, 6))
    assert float(minhash.similarity(x, nx, y, ny, idf)) == pytest.approx(both / (wx.sum() + wy.sum() - both), rel=1e-12)


def test_pairs_at_the_limit_are_joined(spark):
    """Of many pairs at exactly 4/5 none is lost, neither where a text meets its center nor within a bucket; those just below stay apart."""
    rows = []
    for k in range(60):
        shared = 404 if k % 3 else 403
        one, two = pair(shared, 50, 50)
        rows += [(2 * k, " ".join(f"{w}x{k}" for w in one.split())), (2 * k + 1, " ".join(f"{w}x{k}" for w in two.split()))]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * k] == 2 * k and got[2 * k + 1] == (2 * k if k % 3 else 2 * k + 1) for k in range(60))
