"""Tables with very many near rows: vectors around the limit against all pairs, texts with a known similarity."""

import random

import numpy as np

from mosaiq.llm import embeddings, minhash


def test_vectors_around_the_limit(spark):
    """5,000 vectors of 5 labels: pairs just above, at and just below 0.98, copies, chains, and a dense cluster of 1,300."""
    r = np.random.default_rng(9)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    base = unit(r.standard_normal((1800, 64)))
    turned = unit(r.standard_normal((1800, 64)))
    turned = unit(turned - (turned * base).sum(axis=1, keepdims=True) * base)
    cosine = r.choice([0.95, 0.9795, 0.97999, 0.98, 0.98001, 0.9805, 0.99], 1800)[:, None]
    near = cosine * base + np.sqrt(1 - cosine**2) * turned
    center = unit(r.standard_normal(64))
    cluster = unit(center + r.standard_normal((1300, 64)) * 0.015)
    whole = np.float32(np.concatenate([base, near, cluster, base[:100]]) * r.uniform(0.1, 50, (5000, 1)))
    label = np.concatenate([np.arange(1800) % 5, np.arange(1800) % 5, np.zeros(1300, int), (np.arange(100) + (np.arange(100) % 3 == 0)) % 5])
    order = r.permutation(5000)
    df = spark.createDataFrame([(int(i), [float(x) for x in whole[i]], int(label[i])) for i in order], "vec_id long, embedding array<float>, label int").repartition(6)
    got = {x.vec_id: x for x in embeddings.near_vectors(df).collect()}
    links, root = np.zeros(5000, int), np.arange(5000)

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for c in range(5):
        at = np.flatnonzero(label == c)
        v = whole[at].astype(float)
        size = np.sqrt((v * v).sum(axis=1))
        hit = v @ v.T / (size[:, None] * size[None, :]) >= 0.98
        np.fill_diagonal(hit, False)
        links[at] = hit.sum(axis=1)
        for i, j in zip(*np.nonzero(np.triu(hit)), strict=True):
            a, b = sorted((find(at[i]), find(at[j])))
            root[b] = a
    assert links.sum() > 1300 * 1000
    wrong = [i for i in range(5000) if got[i].n_links != links[i]]
    assert len(wrong) <= 2 * 1800 * 0.005, len(wrong)  # what hyperplanes may miss; below the limit nothing is linked
    assert all(got[i].n_links <= links[i] for i in range(5000))
    same = sum(got[i].component_id == find(i) for i in range(5000))
    assert same >= 5000 - 2 * len(wrong)


def test_recall_of_several_hundred_near_pairs(spark):
    """Texts that share 80 to 95 of 100 shingles with one other: all are joined, and those that share 70 to 79 never."""
    r, rows, want = random.Random(6), [], {}
    for k in range(400):
        n = r.randint(60, 300)
        share = r.choice([r.uniform(0.8, 0.95), r.uniform(0.7, 0.79)])
        own = round(n * (1 - share) / (2 * share))  # of each text beside the n common shingles
        common = [f"c{k}x{i}" for i in range(n + 4)]
        a, b = (common + [f"{side}{k}x{i}" for i in range(own)] for side in "ab")
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        want[k] = 5 * n >= 4 * (n + 2 * own)
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    joined = {k: got[2 * k] == got[2 * k + 1] for k in want}
    assert not any(joined[k] for k in want if not want[k])
    assert sum(joined[k] for k in want if want[k]) == sum(want.values()) > 150
