"""The weights that near-duplicate texts are sampled by: all document frequencies, exactly."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.llm import minhash
from mosaiq.llm.common import text_key, workspace


@pytest.mark.parametrize("sizes", [{}, {"TOKENS": 30, "BUCKET": 50}])
def test_samples_weigh_by_all_document_frequencies(spark, monkeypatch, sizes):
    """Rare shingles do not weigh alike: of 120 texts some shingles are in one, some in two to five, one in all."""
    for k, v in sizes.items():
        monkeypatch.setattr(minhash, k, v)
    texts = ["in every text of all " + " ".join(f"g{i % 7 % 5}x{i // 10}y{k}" for k in range(12)) + f" own{i} " * (1 + i % 3 * 4) for i in range(117)] + ["", " ", "two words"]
    own = lambda t: collections.Counter(tuple(t.split()[i : i + 5]) for i in range(max(len(t.split()) - 4, 1))) if t.split() else {}
    df = collections.Counter(s for t in texts for s in own(t))
    assert len(set(df.values())) > 3 and 117 in df.values()
    want = {t: sorted(n * np.log1p(120 / df[s]) for s, n in own(t).items()) for t in texts}
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3).select(text_key("text").alias("node"), F.col("text"))
    got = {}
    with workspace(spark) as keep:
        parts, told, idf, n_docs = minhash._counted_in(rows, keep)
        assert n_docs == 120 and len(idf.keys) == sum(n > 6 for n in df.values())
        each = collections.defaultdict(list)
        for r in told.where("slice is not null").collect():
            each[r.slice].append(r.asDict())
        for r in parts.collect():
            _, part = minhash._opened(bytes(r.texts))
            d, s, n = minhash.counted(*minhash.shingles(part))
            weight = minhash.tf_idf(s, n, each[r.slice], n_docs)
            got |= {t: sorted(weight[d == i]) for i, t in enumerate(part.to_pylist())}
    assert got.keys() == want.keys()
    for t in want:
        assert got[t] == pytest.approx(want[t], rel=1e-12), t
