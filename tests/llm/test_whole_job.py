"""Cases in which an operator once did less than the whole job."""

import collections
import functools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mosaiq.llm import katz, minhash, mixing, packing, queries, sharding, toxicity, urls


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_samples_agree_with_the_probability_of_the_similarity():
    """Weight in few shingles: 6 shared ones a hundred times, and 60 unlike ones on each side."""
    r, n = np.random.default_rng(5), 200
    doc, shingle, weight = [], [], []
    for k in range(n):
        shared = r.integers(0, 2**64, 6, np.uint64)
        for side in (0, 1):
            own = np.concatenate([shared, r.integers(0, 2**64, 60, np.uint64)])
            order = np.argsort(own)
            doc.append(np.full(66, 2 * k + side))
            shingle.append(own[order])
            weight.append(np.repeat([100.0, 1.0], [6, 60])[order] * 3.04)
    got = minhash.samples(np.concatenate(doc), np.concatenate(shingle), np.concatenate(weight), 2 * n)
    assert abs((got[::2] == got[1::2]).mean() - 600 / 720) < 0.02
    by = minhash.bands(got)
    assert (by[::2] == by[1::2]).any(axis=1).all()


def test_near_duplicates_with_repeated_lines(spark):
    """A line a hundred times and another remainder: every pair links, and no others do."""
    rows = []
    for k in range(20):
        line = words(6, 900 + k)
        for side in (0, 1):
            rows.append((2 * k + side, " ".join([line] * 100) + " " + words(60, 1000 + 2 * k + side)))
    for k in range(0, 40, 2):
        a, b = (collections.Counter(zip(*[t.split()[i:] for i in range(5)], strict=False)) for t in (rows[k][1], rows[k + 1][1]))
        assert 0.8 < sum((a & b).values()) / sum((a | b).values()) < 0.85
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.class_id for x in got} == {i: i - i % 2 for i in range(40)}


@pytest.mark.parametrize("sizes", [{}, {"BUCKET": 40, "TOKENS": 50}, {"BUCKET": 60, "SPLIT": 12, "HEAD": 0.01}, {"BUCKET": 25, "SPLIT": 5, "HEAD": 0.005, "TOKENS": 30}, {"HEAD": 1.0}])
def test_language_model_of_all_words(spark, monkeypatch, sizes):
    """Against a plain recursive version: no word and no n-gram is left out, however the work is dealt."""
    order = 3
    for k, v in sizes.items():
        monkeypatch.setattr(katz, k, v)
    r = random.Random(3)
    word = lambda: r.choice(("a", "b", "c")) if r.random() < 0.5 else f"w{int(r.expovariate(0.02))}"
    own = [(i, " ".join(word() for _ in range(r.randint(0, 60)))) for i in range(60)] + [(60, None), (61, "A b unseen"), (62, ""), (63, "a b " * 40), (64, "a b " * 40)]
    docs = spark.createDataFrame(own, "doc_id long, text string").repartition(3)
    tok = lambda t: (t or "").lower().split() + ["\n"]
    sized = lambda t, n: [tuple((["<"] * order + ["\n"] + tok(t))[i + order + 2 - n : i + order + 2]) for i in range(len(tok(t)))]
    train = [t for i, t in own if i % 4]
    count = {n: collections.Counter(g for t in train for g in sized(t, n)) for n in range(1, order + 1)}
    total = sum(count[1].values())
    d = {n: katz.discounts(collections.Counter(count[n].values())) for n in count}
    after = collections.defaultdict(list)
    for n in count:
        for g in count[n]:
            after[g[:-1]].append(g)

    @functools.cache
    def of(h):
        """(denominator, alpha) of a history."""
        n = len(h) + 1
        mass = sum(count[n][g] * (d[n][count[n][g]] if count[n][g] <= 5 else 1) for g in after[h])
        share = sum(p(g[1:]) for g in after[h])
        room = sum(count[n][g] for g in after[h]) + 1
        return (mass, 1.0) if share > 1 - 1e-9 else (room, (1 - mass / room) / (1 - share))

    @functools.cache
    def p(g):
        n, k = len(g), count[len(g)][g]
        if n == 1:
            return (k or 1) / (total + 1)
        if k:
            return k * (d[n][k] if k <= 5 else 1) / of(g[:-1])[0]
        return (of(g[:-1])[1] if after[g[:-1]] else 1.0) * p(g[1:])

    for h in [h for h in list(after) if len(h) == order - 1][:20]:  # exactly normalised
        assert abs(sum(p((*h, w[0])) for w in [*count[1], ("never",)]) - 1) < 1e-9
    want = {i: (len(tok(t)), sum((w,) in count[1] for w in tok(t)), total, sum(math.log10((count[1][(w,)] + 1) / (total + len(count[1]) + 1)) for w in tok(t)), sum(math.log10(p(g)) for g in sized(t, order))) for i, t in own}
    got = katz.score_texts(docs, F.pmod("doc_id", F.lit(4)) == 0).collect()
    assert len(got) == len(want)
    for x in got:
        assert (x.n_tokens, x.n_known, x.train_tokens) == want[x.doc_id][:3], x
        assert (x.base_score, x.score) == pytest.approx(want[x.doc_id][3:], abs=1e-6), x


def test_query_of_the_language_model_learns_every_ngram(spark, sf_dir, monkeypatch):
    """The numbers of n-grams that the discounts are made of, against plain counts over the table."""
    import re
    import zlib

    asked = []
    monkeypatch.setattr(katz, "discounts", lambda seen, f=katz.discounts: asked.append(seen) or f(seen))
    queries.op10_score_texts(spark, sf_dir)
    count = {2: collections.Counter(), 3: collections.Counter()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        if zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            t = ["<", "\n", *re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")), "\n"]
            for n in count:
                count[n].update(tuple(t[i + 1 - n : i + 1]) for i in range(2, len(t)))
    assert asked == [{k: sum(x == k for x in count[n].values()) for k in range(1, 7)} for n in (2, 3)]


def test_language_model_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None), (1, "a b")], "doc_id long, text string")
    got = katz.score_texts(docs, F.lit(True)).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.score) for r in got) == [("1", 3, 0, 0, 0.0), ("1", 3, 0, 0, 0.0), ("None", 1, 0, 0, 0.0)]
    assert katz.score_texts(docs.limit(0), F.lit(True)).count() == 0


TOXIC = toxicity.Model({f"bad{k}": 3.0 for k in range(6)}, -0.1, 1.0, 0.1)


def passages_of(text):
    return next(toxicity.found_passages(pa.array([text]), TOXIC))


def test_toxic_passage_after_single_hits():
    bad, gap = [f"bad{k}" for k in range(6)], ["fine"] * 60
    text = [w for b in bad for w in [b, *gap]] + bad
    assert [x[:2] for x in passages_of(" ".join(text))] == [(len(text) - 6, len(text))]
    near = [w for b in bad for w in [b, *gap[:20]]] + bad  # one maximal segment holds them all
    assert (len(near) - 6, len(near)) in [x[:2] for x in passages_of(" ".join(near))]


@pytest.mark.parametrize("gap", [0, 5, 500])
def test_equal_toxic_passages_are_all_found(gap):
    bad = [f"bad{k}" for k in range(6)]
    assert [x[:2] for x in passages_of(" ".join([*bad, *["fine"] * gap, *bad]))] == [(0, 6), (6 + gap, 12 + gap)]


def test_one_word_repeated_is_no_passage():
    assert passages_of("bad1 " * 200) == []


def test_densest_against_brute_force():
    r = random.Random(8)
    for _ in range(200):
        places = sorted(r.sample(range(60), r.randint(1, 14)))
        known = [(p, k, 1.0 + ord(k) % 5 / 3, -0.3 * (p - q - 1)) for p, q in zip(places, [-1, *places], strict=False) for k in [r.choice("abcd")]]
        value = lambda a, b: sum({k: s for _, k, s, _ in known[a : b + 1]}.values()) - 0.3 * (known[b][0] + 1 - known[a][0] - len({k for _, k, _, _ in known[a : b + 1]}))  # noqa: E731, B023
        a, b, got = toxicity.densest(known, -0.3)
        assert got == pytest.approx(max(value(i, j) for i in range(len(known)) for j in range(i, len(known)))) and got == pytest.approx(value(a, b))


def test_only_texts_with_a_significant_run_are_searched():
    """The best run of each text against brute force, and passages with the search of every text."""
    r = random.Random(4)
    score = np.array([r.choice([-0.4, -0.1, 0.3, 1.7]) for _ in range(400)])
    bounds = np.array([0, 0, 5, 130, 130, 131, 400])
    want = [max([0.0, *(score[i:j].sum() for i in range(a, b) for j in range(i + 1, b + 1))]) for a, b in zip(bounds, bounds[1:], strict=False)]
    assert toxicity.best_sums(score, bounds) == pytest.approx(want)


def test_what_is_counted_is_what_is_looked_up(spark):
    forms = [f.to_pylist() for f in toxicity.forms(pa.array(['"Worthless,', "Idiot!", "..."]))]
    assert list(zip(*forms, strict=True)) == [("worthless", "worth*", "wort*"), ("idiot", None, None), (None, None, None)]
    assert toxicity.known_as(pa.array(["WORTHY.", "worth", "x"]), pa.array(["wort*", "x"])).tolist() == [0, -1, 1]
    rows = [("Worthless words. words", 1, 0), ("words", 1, 1), ("", 0, 0), (None, 0, 1)]
    got = {x.token: x for x in toxicity.token_counts(spark.createDataFrame(rows, "text string, toxic int, half int").fillna("")).collect()}
    assert set(got) == {"worthless", "worth*", "wort*", "words"}
    assert (got["words"].n_2, got["words"].n_3, got["words"].used_2, got["words"].n_0) == (1, 1, 2, 0)


def test_parameters_of_the_extreme_value_law():
    """Scores of 1 and -1: rate = log(q / p), and k by the best runs of random texts."""
    p, n = 0.3, 2000
    rate, k = toxicity.karlin(np.array([1.0, -1.0]), np.array([p, 1 - p]))
    assert rate == pytest.approx(math.log(0.7 / 0.3), rel=1e-6)
    r = np.random.default_rng(2)
    bounds = np.arange(0, 4001 * n, n)
    best = toxicity.best_sums(np.where(r.random(4000 * n) < p, 1.0, -1.0), bounds)
    for at in (8, 10):  # a lattice law: a score above at - 1 is at least at
        assert (best >= at).mean() == pytest.approx(1 - math.exp(-k * n * math.exp(-rate * (at - 0.5))), abs=0.12)


def test_two_passages_far_apart_are_two(spark):
    r = random.Random(6)
    plain = lambda n: " ".join(r.choice(("lorem", "ipsum", "dolor", "sit", "amet")) for _ in range(n))
    rows = [(f"{plain(60)} vile {plain(3)} horrid {plain(4)} nasty {plain(60)}", 1) for _ in range(80)] + [(plain(120), 0) for _ in range(200)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"))
    assert model.rest < 0 and 0 < model.k <= 1
    text = f"vile horrid nasty {plain(300)} vile horrid nasty"
    assert [x[:2] for x in next(toxicity.found_passages(pa.array([text]), model))] == [(0, 3), (303, 306)]


@pytest.mark.parametrize("large", [333, 150])
def test_a_hot_group_leaves_the_other_shards_even(spark, large):
    """A group of a third, or 15 %, of all bytes: its own shard, and the others nearly equal."""
    plan = sharding.pack_shards([(large, 1), (1, 1000 - large)], 8)
    used = [0] * 8
    for size, lo, hi, first, each in plan:
        for rank in range(lo, hi):
            used[first + (rank - lo) // each] += size
    even = (1000 - large) / 7
    assert sorted(used)[-1] == large and even - 7 <= min(used) and sorted(used)[-2] <= even + 1
    rows = [(i, "copy" if i < large else f"{i:04}") for i in range(1000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(collections.Counter(x.shard for x in got).values()) == sorted(used)


def least_cost(sizes, lengths):
    """By trying every way to part the sizes into bins."""
    best = math.inf

    def add(k, bins):
        nonlocal best
        if k == len(sizes):
            best = min(best, sum(packing.cost(min(c for c in lengths if c >= b)) for b in bins))
            return
        for i, b in enumerate(bins):
            if b + sizes[k] <= max(lengths):
                add(k + 1, [*bins[:i], b + sizes[k], *bins[i + 1 :]])
        add(k + 1, [*bins, sizes[k]])

    add(0, [])
    return best


def test_packing_against_the_optimum_of_tiny_cells():
    r, lengths, hits, shrunk, plans = random.Random(1), (512, 1024, 2048, 4096), 0, 0, set()
    for _ in range(150):
        sizes = [r.choice((r.randint(1, 4096), r.randint(1, 700))) for _ in range(r.randint(1, 7))]
        got = packing.best_fit(sizes, lengths)
        bins = {b: c for b, _, c in got}
        held = {b: sum(s for s, x in zip(sizes, got, strict=True) if x[0] == b) for b in bins}
        assert all(c == min(x for x in lengths if x >= held[b]) for b, c in bins.items())
        cost, least = sum(map(packing.cost, bins.values())), least_cost(sizes, lengths)
        assert least - 1e-6 <= cost <= 1.5 * least
        hits += cost <= least + 1e-6
        order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
        one = packing._one_plan(sizes, order, lengths, lengths)[1]
        shrunk += any(u <= 2048 for u in packing._one_plan(sizes, order, lengths, (4096,))[1])
        plans.add(sum(packing.cost(min(c for c in lengths if c >= u)) for u in one) - cost > 1e-6)
    assert hits >= 120 and shrunk and plans == {True, False}  # opening with all lengths is not always best


def test_bins_shrink_to_their_contents():
    """Opened longer than what comes into them in the end, in plans of least cost."""
    r, lengths, shrunk = random.Random(2), (512, 1024, 2048, 4096), 0
    for _ in range(200):
        sizes = [r.randint(1, 900) for _ in range(r.randint(2, 40))]
        out, opened, final = packing.least_cost_plan(sizes, lengths)
        held = [sum(s for s, (b, _) in zip(sizes, out, strict=True) if b == k) for k in range(len(final))]
        assert final == [min(c for c in lengths if c >= h) for h in held] and all(a >= b for a, b in zip(opened, final, strict=True))
        shrunk += opened != final
    assert shrunk


def test_trust_and_distrust_keep_their_mass(spark):
    """Hosts that are only linked to are hosts too: nothing is lost there."""
    pages = [(1, "https://a.org/x", '<a href="https://mid.net/1">'), (2, "https://b.org/", '<a href="//mid.net"> <a href="https://end.example/">'), (3, "https://x.com/de/1", '<a href="http://mid.net/">'), (4, "https://y.net/", '<a href="https://x.com/de/">'), (5, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    hosts = df.select(urls.host_of(F.col("url")).alias("host"), "html")
    links = urls.host_edges(hosts)
    known = hosts.select("host").where("host <> ''")
    seeds = spark.createDataFrame([("a.org", 0.5, 0.0), ("b.org", 0.5, 0.0), ("x.com", 0.0, 1.0), ("y.net", 0.0, 0.0)], "host string, trust double, distrust double")
    got = {r.host: r for r in urls.propagate(urls.both_ways(links, known), seeds).collect()}
    assert sum(r.trust for r in got.values()) == pytest.approx(1) and sum(r.distrust for r in got.values()) == pytest.approx(1)
    assert got["mid.net"].trust > 0.2 and got["y.net"].distrust > 0.2


def test_query_of_the_mix_deviates_less_than_a_block(spark, sf_dir):
    """At every slot, by the query's own rows; and every document is in the stream as often as its source came round."""
    rows = queries.op3_mix_sources(spark, sf_dir).collect()
    n = collections.Counter(r.source for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    whole = sum(v**0.8 for v in n.values())
    at = collections.defaultdict(set)
    for r in rows:
        at[r.slot].add((r.source, r.block, r.epoch))
    assert sorted(at) == list(range(len(at))) and all(len(x) == 1 for x in at.values())
    done = collections.Counter()
    for slot in range(len(at)):
        ((source, block, epoch),) = at[slot]
        assert epoch * -(-n[source] // 16) + block == done[source]  # blocks in order, over and over
        done[source] += 1
        assert all(abs(done[k] - (slot + 1) * v**0.8 / whole) < 1 for k, v in n.items())
    assert collections.Counter((r.slot, r.place) for r in rows).most_common(1)[0][1] == 1
    assert collections.Counter(r.source for r in rows if r.epoch == 0) == n


def test_mix_keeps_repeated_rows_and_odd_sources(spark):
    rows = [(i, "same", s, str(i)) for i in (1, 1, 1, 2) for s in (None, "", "\x00", "a")] + [(None, None, "a", "x"), (None, "", "a", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mine string")
    plan = mixing.schedule(docs, block_rows=2, segment=64).where("epoch = 0").collect()
    assert collections.Counter((r.doc_id, r.source) for r in plan) == collections.Counter((r[0], r[2]) for r in rows)
    clash = docs.select("*", *[F.col("mine").alias(k) for k in ("_slot", "_id", "row", "key", "copy", "slot", "place", "row_key")])
    got = mixing.mix(clash, block_rows=2, segment=64)
    assert got.columns == clash.columns
    out = [r.asDict() for r in got.collect()]
    assert collections.Counter((r["doc_id"], r["text"], r["source"], r["mine"]) for r in out).keys() == collections.Counter(rows).keys()
    assert all(r[k] == r["mine"] for r in out for k in clash.columns[4:]) and len(out) >= len(rows)
    least = collections.Counter(tuple(r.values())[:4] for r in out)
    assert all(least[k] >= n for k, n in collections.Counter(rows).items())


CLASH = ("_id", "_node", "node", "row", "own", "key", "copy", "slot", "_doc", "_url", "found", "rule", "verdict", "toxic", "score", "host", "path", "_slot", "component", "class_id", "kept")


@pytest.mark.parametrize("name", ["drop_near_duplicates", "drop_toxic", "redact", "mix"])
def test_filters_keep_columns_with_clashing_names(docs, none, name):
    import corpus_pipeline
    from mosaiq.llm import secrets

    run = {
        "drop_near_duplicates": minhash.drop_near_duplicates,
        "drop_toxic": lambda d: toxicity.drop_toxic(d, toxicity.Model({"aaaaaa": 6.0}, -0.1, 1.0, 0.1)),
        "redact": lambda d: corpus_pipeline.secret_stage(d.sparkSession, d, ""),
        "mix": lambda d: mixing.mix(d, block_rows=2, segment=64),
    }[name]
    wide = docs.select("*", *[F.lit("mine").alias(k) for k in CLASH])
    out = run(wide)
    assert out.columns == wide.columns
    key = lambda df: sorted(map(str, df.select("doc_id", "text").collect()))
    assert key(out) == key(run(docs)) and {r[k] for r in out.collect() for k in CLASH} <= {"mine"}
    assert secrets is not None and run(none).count() == 0


def test_pages_with_clashing_names_and_repeats(spark):
    pages = [(1, "https://a.org/x", '<a href="https://mid.net/1">'), (1, "https://a.org/x", '<a href="https://mid.net/1">'), (None, None, None), (2, "no url", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    wide = df.select("*", *[F.lit("mine").alias(k) for k in CLASH if k != "host"], F.lit("mine").alias("host"))
    key = lambda d: sorted(map(str, urls.judge_pages(d).collect()))
    assert key(wide) == key(df) and len(key(df)) == 4 and urls.judge_pages(df.limit(0)).count() == 0
