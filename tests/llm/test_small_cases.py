"""Every document operator on nulls, empty, long, tied and repeated rows, an empty table and clashing columns."""

import collections
import fractions
import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from mosaiq.llm import katz, minhash, mixing, packing, quality, secrets, sharding, toxicity
from mosaiq.llm.common import id_crc

WORD = r"[^\x20\x09-\x0D]+"
MODEL = toxicity.Model({"bad": 6.0, "awful": 6.0}, -0.1, 1.0, 0.1, -2.0, 0.5)
OPERATORS = {
    "shard": lambda d: sharding.shard_documents(d, 3).drop("group_key"),
    "quality": lambda d: quality.judge(d).select("doc_id", "n_words", "n_repeat_words", "n_dup_lines", "failed", "base_failed"),
    "secrets": lambda d: secrets.find_secrets(d).select("doc_id", F.to_json("secrets").alias("spans")),
    "mixing": lambda d: mixing.schedule(d, block_rows=2, segment=64),
    "packing": packing.pack_documents,
    "pack_texts": packing.pack_texts,
    "toxicity": lambda d: toxicity.score_documents(d, MODEL),
    "minhash": minhash.near_duplicates,
    "lm": lambda d: katz.score_texts(d, F.pmod(id_crc("doc_id"), F.lit(7)) == 2),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_table_and_clashing_names(name, docs, none, clash):
    run = OPERATORS[name]
    assert run(none).count() == 0
    key = lambda df: sorted(map(str, df.select(*[c for c in df.columns if c not in ("bin", "slot", "shard", "place", "capacity")]).collect()))
    assert key(run(clash)) == key(run(docs))


def test_sharding(docs):
    got = sharding.shard_documents(docs, 3).collect()
    want = collections.Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    by = collections.defaultdict(set)
    for r in got:
        by[r.text_crc32].add(r.shard)
    assert all(len(x) == 1 for x in by.values())


def brute_best_fit(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fit = [(free, i) for i, free in enumerate(bins) if free >= s]
        if fit:
            bins[min(fit)[1]] -= s
        else:
            bins.append(capacity - s)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(6))
def test_pack_sizes_is_best_fit_decreasing(seed):
    import random

    r = random.Random(seed)
    sizes = [r.randint(1, 60) for _ in range(300)]
    plan, n = sharding.pack_sizes(list(collections.Counter(sizes).items()), 100)
    used = [0] * n
    for size, lo, hi, first, each in plan:
        for rank in range(lo, hi):
            used[first + (rank - lo) // each] += size
    assert sorted(100 - u for u in used) == brute_best_fit(sizes, 100)


def test_quality(docs):
    for r in quality.judge(docs).collect():
        t = r.text or ""
        w = re.findall(WORD, t)
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        n = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {k + j for k, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if n[x] > 1 for j in range(3)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 50 or 2 * len(cover) > len(w))


def spans_of(t):
    out = []
    for order, rule in enumerate(secrets.RULES):
        out += [(m.start(), order, f"{rule.kind}:{m.start()}:{m.end()}") for m in re.finditer(rule.pattern, t, re.A) if len(m[rule.group]) >= rule.least]
    return ",".join(x[2] for x in sorted(out))


def test_secrets(docs):
    got = secrets.find_secrets(docs).select("text", secrets.spans_text(F.col("secrets")).alias("s"), secrets.redact(F.col("text"), F.col("secrets")).alias("clean")).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.s == spans_of(r.text or "")
        assert r.clean == r.text if not r.s else "abcdefghijkl1234" not in r.clean
    assert sum(r.s != "" for r in got) == 2


def test_trigram_queries():
    assert secrets.trigram_query(r"[0-9a-f]{16,}") is None
    assert secrets.trigram_query(r"AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert secrets.trigram_query(r"x?secrets?") == [frozenset({"sec", "ecr", "cre", "ret"})]
    assert secrets.trigram_query(r"ab(c|.)d") is None


@pytest.mark.parametrize("weights", [[5, 3.3, 1, 0.2], [1.0] * 30, [1000.0] + [1.0] * 29, [0.1, 0.2, 0.7], [1 / 3] * 3, [900, 50, 30, 10, 5, 5], [1.0], [n**0.8 for n in (9123, 55, 1200, 1201, 17, 3)]])
@pytest.mark.parametrize("segment", [7, 500, 10**9])
def test_mixing_keeps_within_a_block_of_the_true_weights(weights, segment):
    """Over fifty periods of 1,024 slots, whatever the segments; blocks of a source in order, every slot once."""
    w, total = mixing.whole_weights(weights)
    exact = [fractions.Fraction(x) / sum(map(fractions.Fraction, weights)) for x in weights]
    end = 50 * 1024
    at = mixing.cuts(w, total, end, segment)
    assert len(at) > 0.5 * end / segment or segment > 7
    done, slot = [0] * len(w), 0
    for n, (start, first) in enumerate(at):
        assert first == done and start == slot
        stop, last = (at[n + 1] if n + 1 < len(at) else (end, None))
        for i, k, s in mixing.one_segment(w, total, start, stop, first, last):
            assert (k, s) == (done[i], slot)
            done[i], slot = done[i] + 1, slot + 1
            assert s % 5 or all(abs(d - slot * x) < 1 for d, x in zip(done, exact, strict=True))
    assert slot == end


def test_mixing_of_large_counts(spark):
    """Weights whose whole numbers have more than 64 bits, in several segments."""
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 7 == 0, "b").otherwise(F.concat(F.lit("s"), F.col("id") % 11)).alias("source"))
    n = {r[0]: r[1] for r in docs.groupBy("source").count().collect()}
    rows = mixing.schedule(docs, block_rows=4, segment=1000).select("source", "slot", "epoch").distinct().orderBy("slot").collect()
    whole, done = sum(v**0.8 for v in n.values()), collections.Counter()
    assert [r.slot for r in rows] == list(range(len(rows))) and len(rows) > 7000
    for r in rows:
        done[r.source] += 1
        assert all(abs(done[k] - (r.slot + 1) * v**0.8 / whole) < 1 for k, v in n.items())


def test_mixing_documents(docs):
    plan = mixing.schedule(docs, {"s0": 5, "s1": 1, "s2": 1}, block_rows=2, segment=64).collect()
    assert {(r.doc_id, r.source) for r in plan} == {(r.doc_id, r.source) for r in docs.collect()}
    slots = collections.defaultdict(set)
    for r in plan:
        slots[r.slot].add(r.source)
    assert all(len(x) == 1 for x in slots.values()) and sorted(slots) == list(range(len(slots)))
    mixed = mixing.mix(docs, {"s0": 5, "s1": 1, "s2": 1}, block_rows=2, segment=64)
    assert mixed.columns == docs.columns
    assert {(r.doc_id, r.text) for r in mixed.collect()} == {(r.doc_id, r.text) for r in docs.collect()}


def test_packing_round_trip(docs):
    lengths = (64, 128, 512)
    out = packing.pack_texts(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), lengths, cell=17).collect()
    whole = {r.doc_id: r.text or "" for r in docs.collect()}
    by, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
        bins[r.bin].append(r)
    for k, pieces in by.items():
        pieces.sort(key=lambda r: r.piece)
        assert "".join(p.text for p in pieces) == whole[k]
        assert sum(p.length for p in pieces) == len(re.findall(WORD, whole[k])) + 1
    for b in bins.values():
        used = sum(r.length for r in b)
        assert {r.capacity for r in b} == {min(c for c in lengths if c >= used)}
        at = 0
        for r in sorted(b, key=lambda r: r.place):
            assert r.place == at
            at += r.length


def test_segments_against_brute_force():
    import random

    def brute(x):  # the recursive definition: best segment, then left and right of it
        best = max(((sum(x[a:b]), -a, b) for a in range(len(x)) for b in range(a + 1, len(x) + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        a, b = -best[1], best[2]
        return brute(x[:a]) + [(a, b)] + [(s + b, e + b) for s, e in brute(x[b:])]

    r = random.Random(3)
    for _ in range(200):
        x = [r.choice([-1.37, -0.61, 0.93, 2.11, -3.07]) + r.random() * 1e-3 for _ in range(14)]
        got = toxicity.segments([(i, i + 1, v) for i, v in enumerate(x)])
        assert [(s, e) for s, e, _ in got] == brute(x)


def test_toxicity_learns(spark):
    import random

    r = random.Random(5)
    clean = lambda: " ".join(r.choice(("lorem", "ipsum", "dolor", "sit", "amet")) for _ in range(80))
    toxic = lambda: clean() + " nasty " + clean() + " vile. horrid " + clean()
    rows = [(toxic(), 1) for _ in range(60)] + [(clean(), 0) for _ in range(200)] + [(None, 0), ("", None)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"))
    test = spark.createDataFrame([(i, toxic() if i % 2 else clean()) for i in range(40)] + [(90, None), (91, "")], "doc_id long, text string")
    for x in toxicity.score_documents(test, model).collect():
        assert (x.score >= 0.7) == (x.doc_id < 40 and x.doc_id % 2 == 1)
    assert toxicity.drop_toxic(test, model).count() == 22


def shingles_of(t):
    w = re.findall(WORD, t)
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else collections.Counter()


@pytest.mark.parametrize("blocks", [{}, {"BLOCK": 2}, {"WEIGHT": 500}])
def test_near_duplicates(docs, monkeypatch, blocks):
    monkeypatch.setattr(minhash, "TOKENS", 500)
    for k, v in blocks.items():
        monkeypatch.setattr(minhash, k, v)
    own = docs.collect()
    texts = sorted({r.text or "" for r in own})
    sets = {t: shingles_of(t) for t in texts}
    n = len(own)
    df = collections.Counter(s for r in own for s in sets[r.text or ""])
    import math

    top = math.log1p(1 / minhash.COMMON)
    weight = lambda s: math.log1p(n / df[s]) if df[s] > minhash.COMMON * n else top
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b]:
                both = sum(min(k, sets[b][s]) * weight(s) for s, k in sets[a].items())
                either = sum(k * weight(s) for t in (a, b) for s, k in sets[t].items()) - both
                if both / either >= 0.8:
                    root[find(a)] = find(b)
    ids = collections.defaultdict(list)
    for r in own:
        ids[find(r.text or "")].append(r.doc_id)
    want = {t: min((i for i in ids[find(t)] if i is not None), default=None) for t in texts}
    got = minhash.near_duplicates(docs)
    keys = {hashlib.md5(t.encode()).digest(): t for t in texts}
    for r in got.collect():
        assert r.class_id == want[keys[bytes(r.node)]], r
    left = minhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert left.count() == len({find(t) for t in texts})


def test_common_shingles_are_counted_exactly(spark):
    rows = [(i, "one two three four five six " + " ".join(f"w{i}x{k}" for k in range(20))) for i in range(50)]
    idf = minhash.common_shingles(spark.createDataFrame(rows, "doc_id long, text string"), "text")
    assert len(idf.keys) == 2  # two windows lie within the six shared words


