"""The whole score of a text against its definition, recall on a table, and time on long texts."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.llm import queries, toxicity

MODEL = toxicity.Model({"bad": 2.5, "vile": 3.1, "worth*": 2.2, "good": -1.5, "awful": 2.9, "mean": 1.2}, -0.2, 1.1, 0.2, a=-3.0, b=0.6)


def name_of(word):
    """A token's entry of the model: its lower case without rims, else the first stem that has one."""
    bare = word.lower().strip(toxicity.RIM)
    return next((f for f in [bare, *[bare[:n] + "*" for n in toxicity.STEMS if len(bare) > 5]] if f in MODEL.scores), None)


def plain_segments(score, lo, hi):
    """All maximal scoring segments: the best one, of equal ones the shortest and first, then what is left and right of it."""
    best = max(((score[i:j].sum(), i - j, -i, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0,))
    if best[0] <= 1e-12:
        return []
    i, j = best[3], best[4]
    return [*plain_segments(score, lo, i), (i, j), *plain_segments(score, j, hi)]


def plain_score(text):
    words = (text or "").split()
    names = [name_of(w) for w in words]
    score = np.array([MODEL.scores.get(k, MODEL.rest) for k in names])
    expected = lambda s: MODEL.k * len(words) * math.exp(-MODEL.rate * s)
    found = []

    def distinct(i, j):
        """The sum of a part in which each named token of positive score counts once."""
        once, total = set(), 0.0
        for k in range(i, j):
            again = score[k] > 0 and names[k] in once
            once.add(names[k])
            total += MODEL.rest if again else score[k]
        return total

    def search(i, j):
        at = [k for k in range(i, j) if score[k] > 0]
        best = max(((round(distinct(a, b + 1), 9), -b, -a, a, b) for a in at for b in at if a <= b), default=None)
        if best and expected(best[0]) <= 0.05:
            found.append(expected(distinct(best[3], best[4] + 1)))
            search(i, best[3])
            search(best[4] + 1, j)

    for i, j in plain_segments(score, 0, len(score)):
        if expected(score[i:j].sum()) <= 0.05:
            own = [names[k] for k in range(i, j) if score[k] > 0]
            if len(set(own)) == len(own):
                found.append(expected(score[i:j].sum()))
            else:
                search(i, j)
    x = max(0.0, sum(-math.log(e) for e in found) - math.lgamma(len(found) + 1))
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, MODEL.a + MODEL.b * x)))), len(found)


def test_scores_by_their_definition(spark):
    r = random.Random(12)
    rows = [(0, None), (1, ""), (2, "fine words only")]
    for k in range(150):
        some = ["Bad!", "vile", "Worthless,", "worthy", "good", "awful.", "mean", *["plain"] * r.choice([3, 12]), '"bad"']
        rows.append((3 + k, " ".join(r.choice(some) for _ in range(r.randint(1, 45)))))
    got = {x.doc_id: (x.score, x.n_passages) for x in toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), MODEL).collect()}
    for k, text in rows:
        want = plain_score(text)
        assert got[k][0] == pytest.approx(want[0], abs=1e-6), (text, got[k], want)
    assert sum(n > 1 for _, n in got.values()) > 10


@pytest.mark.parametrize(("sf", "recall", "wrong"), [("0.1", 0.9, 0.001), ("0.01", 0.7, 0.0)])
def test_recall_on_rows_that_nothing_was_learnt_from(spark, sf, recall, wrong):
    folder = f"/root/testdata/sf{sf}"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    seen = queries.op4_score_toxicity(spark, folder).where("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("predicted").alias("k"))
    of = {r.toxic: r.k / r.n for r in seen.collect()}
    assert of[1] >= recall and of[0] <= wrong, of


def test_time_grows_with_the_text():
    r, took = random.Random(3), []
    values = np.array([-0.2] + [1 + 4 * r.random() for _ in range(179)])
    for n in (40_000, 160_000):
        token = np.array([r.randrange(1, 180) for _ in range(n)])
        began = time.process_time()
        found = toxicity.passages(values[token], token, MODEL)
        took.append(time.process_time() - began)
        assert len(found) > n / 1000
    assert took[1] < 8 * took[0]
