import numpy as np
from pyspark.sql import functions as F

from mosaiq.llm import embeddings


def brute(rows, least=0.98):
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    links = [set() for _ in rows]
    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows):
            if i != j and a is not None and a == b and ok(v) and ok(w) and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    links[i].add(j)
    part = list(range(len(rows)))
    for _ in rows:
        for i, s in enumerate(links):
            for j in s:
                part[i] = part[j] = min(part[i], part[j])
    ids = {}
    for i, k in enumerate(part):
        if rows[i][0] is not None:
            ids[k] = min(ids.get(k, rows[i][0]), rows[i][0])
    return sorted((str(r[0]), len(s), str(ids.get(k))) for r, s, k in zip(rows, links, part, strict=True))


def rows():
    r = np.random.default_rng(2)
    f = lambda v: [float(x) for x in np.float32(v)]
    out = []
    for c in range(6):
        center = r.standard_normal(16)
        out += [(len(out) + k, f(center + r.standard_normal(16) * 0.09), c % 2) for k in range(12)]
    out += [(200, out[0][1], 0), (201, out[0][1], 0), (202, out[0][1], 1), (203, out[0][1], None), (0, out[0][1], 0)]
    out += [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] + [1.0] * 15, 0), (303, [None] + [1.0] * 15, 0), (304, [float("inf")] + [1.0] * 15, 0), (305, [], 0), (306, [1.0, 2.0], 0), (307, [2.0, 4.0], 0), (None, out[20][1], 1), (None, [5.0, 6.0], 7)]
    return out


def test_near_vectors(spark, monkeypatch):
    own = rows()
    df = spark.createDataFrame(own, "vec_id long, embedding array<float>, label int").repartition(3)
    get = lambda d: sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in embeddings.near_vectors(d).collect())
    assert get(df) == brute(own)
    monkeypatch.setattr(embeddings, "BLOCK", 3)  # large buckets become several tasks
    assert get(df.withColumn("node", F.lit(1)).withColumn("table", F.lit(2))) == brute(own)


def test_empty(spark):
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
