"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extreme-value theory."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import cut, give_back, small, text_key

#: Word rims that are not part of a token.
RIM = ".,;:!?|\"'`()[]{}<>*#$%&_-"
STEMS = (5, 4)
#: Bytes of text handled at once, or one text.
BYTES = 1 << 22


@dataclass(frozen=True)
class Model:
    """``scores``: log-odds of the tokens, and of stems written with ``*``, that differ between toxic and clean
    texts; ``rest``: that of any other token within a toxic passage; ``rate`` and ``k``: Karlin's parameters of the
    extreme-value law of a clean text's best segment; ``a`` and ``b``: from evidence to probability."""

    scores: dict[str, float]
    rest: float
    rate: float
    k: float
    a: float = 0.0
    b: float = 1.0

    def expected(self, score: float, n: int) -> float:
        """Segments of such a score that clean text of ``n`` tokens has on average."""
        return self.k * n * math.exp(-self.rate * score)


def forms(words: pa.Array) -> list[pa.Array]:
    """What words are looked up as, in this order: in lower case without their rims, then the stems of longer ones; null where
    there is none."""
    bare = pc.utf8_trim(pc.utf8_lower(words), characters=RIM)
    longer = pc.greater(pc.utf8_length(bare), STEMS[0])
    none, star, nothing = (pa.scalar(x, bare.type) for x in (None, "*", ""))
    stems = [pc.if_else(longer, pc.binary_join_element_wise(pc.utf8_slice_codeunits(bare, 0, n), star, nothing), none) for n in STEMS]
    return [pc.if_else(pc.equal(bare, ""), none, bare), *stems]


def known_as(words: pa.Array, names: pa.Array) -> np.ndarray:
    """For each word the place among ``names`` of the first of its forms that is there, else -1."""
    out = np.full(len(words), -1)
    for form in forms(words):
        at = pc.fill_null(pc.index_in(form, value_set=names.cast(form.type)), -1).to_numpy(zero_copy_only=False)
        out = np.where(out < 0, at, out)
    return out


def tokenised(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of ``texts``, the place of each token among them, and where each text's tokens begin and end."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(full).dictionary_encode()
    before = np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))
    bounds = lists.offsets.to_numpy()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), before[bounds - bounds[0]]


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // BYTES
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield texts.slice(a, b - a)
    give_back()


def segments(items: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, in linear time (Ruzzo and Tompa). ``items``: (start, end, score), one
    after the other; returned likewise. A run of tokens of equal negative score may be one item."""
    found: list[list[float]] = []  # start, end, sum left of it, sum with it, the one before with a smaller left sum
    total = 0.0
    for start, end, score in items:
        before, total = total, total + score
        if score <= 0:
            continue
        new = [start, end, before, total, len(found) - 1]
        while True:
            j = new[4]
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new[4] = j
                break
            new = [found[j][0], new[1], found[j][2], new[3], found[j][4]]
            del found[j:]
        found.append(new)
    return [(int(s), int(e), right - left) for s, e, left, right, _ in found]


#: Sums that differ by less are equal: of equal parts the one that ends first counts, then the one that begins first.
TIE = 1e-9


def _scan(known: list[tuple[int, int, float, float]], rest: float) -> tuple[int, int, float, list[int]]:
    """``densest``, and the places where a new beginning is better than all before it, so that no best part goes over them.

    A later beginning never loses against an earlier one: a token that the earlier part has already is new to it. So beginnings stand in a list, best first,
    with the differences of neighbours; a token changes one difference, and a beginning that falls behind the next is gone for good."""
    n = len(known)
    upto = list(range(n + 1))  # upto[k + 1] - 1: the last beginning in the list not after k
    after, before, ahead = [0] * n, [0] * n, [0.0] * n
    seen: dict[int, int] = {}
    first = last = 0
    top = low = 0.0
    best, cuts = (0, 0, -math.inf), []
    for r, (_, own, score, between) in enumerate(known):
        twin = seen.get(own, -1)
        seen[own] = r
        if not r:
            top = low = score
        else:
            top += between + (score if first > twin else rest)
            low += between + (score if last > twin else rest)
            k = twin + 1
            while upto[k] != k:
                upto[k] = upto[upto[k]]
                k = upto[k]
            c = k - 1
            if c >= 0 and c != last:
                ahead[c] -= score - rest
                while ahead[c] < -TIE:
                    upto[c + 1] = c
                    if c == first:
                        first, top = after[c], top - ahead[c]
                        break
                    p = before[c]
                    ahead[p] += ahead[c]
                    after[p], before[after[c]] = after[c], p
                    c = p
            gap = low - score
            while gap < -TIE and last >= 0:
                upto[last + 1] = last
                last = -1 if last == first else before[last]
                gap += ahead[last] if last >= 0 else 0.0
            if last < 0:
                cuts.append(r)
                first, top = r, score
            else:
                ahead[last], after[last], before[r] = gap, r, last
            last, low = r, score
        if top > best[2] + TIE:
            best = (first, r, top)
    return (*best, cuts)


def densest(known: list[tuple[int, int, float, float]], rest: float) -> tuple[int, int, float]:
    """The best part of ``known`` (place, token, score, what lies between it and the one before) as (first, last, score)
    when equal tokens within it count once, and repeats as ``rest``, which is less than any score. In nearly linear time."""
    return _scan(known, rest)[:3]


def passages(score: np.ndarray, token: np.ndarray, model: Model, alpha: float = 0.05) -> list[tuple[int, int, float]]:
    """Significant segments (first token, end token, expected number of such in clean text of that length) of a text,
    given the log-odds and the name of each of its tokens. Every occurrence counts; but the log-odds are about whether
    a text holds a token, so equal tokens prove nothing more within one segment: a segment with repeats
    is searched for its best part without them, then left and right of it."""
    n, sums = len(score), np.append(0.0, np.cumsum(score))
    known, items, at = [], [], 0
    for i in np.flatnonzero(score > 0).tolist():
        gap = float(sums[i] - sums[at])
        if i > at:
            items.append((at, i, gap))
        items.append((i, i + 1, float(score[i])))
        known.append((i, int(token[i]), float(score[i]), gap))
        at = i + 1
    out, k = [], 0
    for start, end, total in segments(items):
        while k < len(known) and known[k][0] < start:
            k += 1
        first = k
        while k < len(known) and known[k][0] < end:
            k += 1
        if model.expected(total, n) > alpha:
            continue
        own = known[first:k]
        if len({x[1] for x in own}) == len(own):
            out.append((start, end, model.expected(total, n)))
            continue
        parts = [own]
        while parts:
            part = parts.pop()
            a, b, best, cuts = _scan(part, model.rest)
            if cuts:  # what lies between them is searched by itself, so that a long text is not gone over for each passage
                parts += [part[x:y] for x, y in zip([0, *cuts], [*cuts, len(part)], strict=True)]
                continue
            if model.expected(best, n) <= alpha:
                out.append((part[a][0], part[b][0] + 1, model.expected(best, n)))
                parts += [x for x in (part[:a], part[b + 1 :]) if x]
    return sorted(out)


def best_sums(score: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text the largest sum of any run of its tokens, at least 0; ``bounds``: where its tokens begin and end."""
    n, sizes = len(bounds) - 1, np.diff(bounds)
    out, has = np.zeros(n), np.flatnonzero(sizes)
    if not len(score):
        return out
    total = np.append(0.0, np.cumsum(score))
    owner = np.repeat(np.arange(n), sizes)
    start = total[bounds[:-1]][owner]
    before, after = total[:-1] - start, total[1:] - start
    far = 2 * float(np.abs(after).max()) + 1  # puts each text's sums below those of the texts before it
    low = np.minimum.accumulate(before - far * owner) + far * owner
    out[has] = np.maximum(0, np.maximum.reduceat(after - low, bounds[:-1][has]))
    return out


def found_passages(texts: pa.Array, model: Model, alpha: float = 0.05) -> Iterator[list[tuple[int, int, float]]]:
    """The significant segments of each text. Only a text whose best run of tokens is significant can have any, so the
    others are not searched further; that changes no result."""
    names, values = pa.array(list(model.scores), pa.string()), np.append(list(model.scores.values()), model.rest)
    for part in slices(texts):
        words, at, bounds = tokenised(part)
        token = known_as(words, names)[at]
        score = values[token]  # the last value is that of tokens without a place
        sizes = np.diff(bounds)
        need = np.log(np.maximum(model.k * sizes / alpha, 1e-300)) / model.rate - 1e-6
        likely = (best_sums(score, bounds) >= need) & (sizes > 0)
        for i in range(len(part)):
            some = slice(bounds[i], bounds[i + 1])
            yield passages(score[some], token[some], model, alpha) if likely[i] else []


def evidence(found: list[tuple[int, int, float]]) -> float:
    """Of r segments together: the sum of their normalised scores less log r! (Karlin and Altschul)."""
    return max(0.0, sum(-math.log(max(e, 1e-300)) for _, _, e in found) - math.lgamma(len(found) + 1))


def probability(x: float, model: Model) -> float:
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, model.a + model.b * x))))


def karlin(values: np.ndarray, shares: np.ndarray, step: float = 0.05, reach: float = 30.0) -> tuple[float, float]:
    """(rate, k) of the law of the best segment of random tokens that score ``values`` with probabilities ``shares``; the
    mean score must be below 0. rate: the positive root of sum(p * exp(rate * score)) = 1. k: exp(-2 * sum over j of
    (E(exp(rate * S_j); S_j < 0) + P(S_j >= 0)) / j) / (rate * E(X exp(rate * X))), S_j the sum of j scores X, put on a
    grid of ``step``; sums below -``reach`` weigh nothing."""
    total = lambda r: float((shares * np.exp(np.minimum(r * values, 500.0))).sum()) - 1
    low, high = 1e-6, 1.0
    while total(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if total(middle) < 0 else (low, middle)
    rate, size = high, round(reach / step)
    at = np.clip(np.rint(values / step).astype(int), -size, size)
    one = np.bincount(at + size, weights=shares, minlength=2 * size + 1)
    grid, now, sigma = np.arange(-size, size + 1) * step, np.zeros(2 * size + 1), 0.0
    now[size] = 1.0
    for j in range(1, 1000):
        now = np.convolve(now, one)[size : 3 * size + 1]
        part = float((np.exp(np.minimum(rate * grid, 0.0)) * now).sum()) / j
        sigma += part
        if part < 1e-7:
            break
    mean = float((shares * values * np.exp(np.minimum(rate * values, 500.0))).sum())
    return rate, min(1.0, max(1e-6, math.exp(-2 * sigma) / max(1e-9, rate * mean)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's fit, with his targets and a small ridge, by Newton steps."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w, z = np.zeros(2), np.stack([np.ones(len(x)), np.minimum(x, 60.0)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (t - p) - 1e-3 * w)
        w = w + np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 1e-3))


def token_counts(sample: DataFrame) -> DataFrame:
    """(token, n1, n0, u1, u0, n1_a, n0_a, ...) of ``sample`` (text, toxic, half): in how many toxic and clean texts each token or
    stem is, how often it is there, and both for half ``a`` (0) and ``b`` (1) alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            group = b.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64) * 2 + b.column("half").to_numpy(zero_copy_only=False)
            first = 0
            for part in slices(b.column("text")):
                words, at, bounds = tokenised(part)
                coded = pa.concat_arrays(forms(words)).dictionary_encode()
                codes = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64).reshape(1 + len(STEMS), len(words))
                n_keys = max(1, len(coded.dictionary))
                token = codes[:, at].ravel()
                text = np.tile(np.repeat(np.arange(len(part)), np.diff(bounds)), len(codes))
                pair, times = np.unique(text[token >= 0] * n_keys + token[token >= 0], return_counts=True)
                key, of = pair % n_keys, group[first + pair // n_keys]
                cell, n = np.unique(key * 4 + of, return_counts=True)
                used = np.bincount(key * 4 + of, weights=times, minlength=4 * n_keys)[cell].astype(np.int64)
                names_at = coded.dictionary.cast(pa.string()).take(pa.array(cell // 4))
                yield pa.RecordBatch.from_arrays([names_at, pa.array(cell % 4), pa.array(n), pa.array(used)], ["token", "g", "n", "used"])
                first += len(part)

    out = sample.select("text", "toxic", "half").mapInArrow(run, "token string, g long, n long, used long")
    total = lambda c, g: F.sum(F.when(F.col("g") == g, F.col(c)).otherwise(0)).alias(f"{c}_{g}")
    return out.groupBy("token").agg(*[total(c, g) for c in ("n", "used") for g in range(4)])


def _odds(counts: DataFrame, halves: tuple[int, ...], n1: int, n0: int, least_z: float, least_odds: float, prior: float) -> list:
    """(token, score, occurrences in clean texts) of the tokens whose log-odds lie ``least_odds`` or more, and ``least_z`` standard
    deviations or more, from 0."""
    of = lambda c, toxic: sum((F.col(f"{c}_{2 * toxic + h}") for h in halves), F.lit(0))
    a = F.lit(0.5) + prior * (of("n", 1) + of("n", 0)) / (n1 + n0)
    x1, x0, total = of("n", 1) + a, of("n", 0) + a, prior + 1.0
    odds = F.log(x1 / (n1 + total - F.least(x1, F.lit(float(n1) + total - 0.5)))) - F.log(x0 / (n0 + total - F.least(x0, F.lit(float(n0) + total - 0.5))))
    found = counts.where(of("n", 1) + of("n", 0) >= 2).select("token", odds.alias("s"), (odds / F.sqrt(1 / x1 + 1 / x0)).alias("z"), of("used", 0).alias("used"))
    return found.where((F.abs("z") >= least_z) & (F.abs("s") >= least_odds)).collect()


def _spacing(sample: DataFrame, scores: dict[str, float]) -> float:
    """The median number of tokens from one token of positive score to the next in the toxic texts."""
    names, values = pa.array(list(scores), pa.string()), np.append(list(scores.values()), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b.column(0)):
                words, at, bounds = tokenised(part)
                place = np.flatnonzero(values[known_as(words, names)[at]] > 0)
                text = np.searchsorted(bounds, place, side="right")
                gap, n = np.unique(np.diff(place)[text[1:] == text[:-1]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gap.astype(np.int64)), pa.array(n.astype(np.int64))], ["gap", "n"])

    gaps = sample.where("toxic = 1").select("text").mapInArrow(run, "gap long, n long")
    return gaps.agg(F.percentile("gap", F.lit(0.5), F.col("n"))).first()[0] or 10.0


def fit(labelled: DataFrame, per_class: int = 12_000, least_z: float = 3.0, least_odds: float = 1.0, prior: float = 50.0, seed: int = 7) -> Model:
    """Learns from ``labelled`` (text, toxic). Of each class at most about ``per_class`` rows are taken, chosen
    by a hash of their text, and equal texts once; so the model stays of bounded size. A token's score
    is its log-odds between the classes' texts, with a Dirichlet prior of ``prior`` texts in
    proportion to the token's frequency, where it lies ``least_odds``, and ``least_z`` standard deviations, or more from 0: weaker
    ones tell how long a text is. All other tokens
    share the log-odds of not being such a token within a toxic passage, from how densely those stand in toxic texts.
    Probabilities are calibrated on rows that the scores used for them were not learnt from: each half of
    the sample with the scores of the other half. Without rows of both classes nothing is toxic; labels other than 0
    and 1 are left out, and null texts count as empty."""
    rows = labelled.where("toxic in (0, 1)").select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))
    sizes = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Model({}, -0.1, 1.0, 0.1, a=-3.0 if 1 not in sizes else 0.0)
    pick = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 30))
    keep = [(F.col("toxic") == c) & (pick < int((1 << 30) * min(1.0, per_class / n))) for c, n in sizes.items()]
    sample = rows.where(keep[0] | keep[1]).groupBy(text_key("text").alias("key")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = cut(sample.select("text", "toxic", F.pmod(F.xxhash64("text", F.lit(seed + 1)), F.lit(2)).cast("int").alias("half")))
    counts = cut(token_counts(sample))
    held = {(r[0], r[1]): (r[2], r[3]) for r in sample.groupBy("toxic", "half").agg(F.count(F.lit(1)), F.sum(F.size(F.split("text", r"\s+")))).collect()}
    rest = None

    def learnt(halves: tuple[int, ...]) -> Model:
        n1, n0 = (sum(held.get((c, h), (0, 0))[0] for h in halves) for c in (1, 0))
        found = _odds(counts, halves, n1, n0, least_z, least_odds, prior)
        scores = {r["token"]: max(-8.0, min(8.0, r["s"])) for r in found}
        clean = sum(held.get((0, h), (0, 0))[1] for h in halves) or 1
        gap = rest if rest is not None else math.log1p(-1 / max(2.0, _spacing(sample, scores)))
        # a stem counts only where the word itself has no score: this counts it more often, so k and rate are on the safe side
        p = np.array([(r["used"] + 0.5) / (clean + 1) for r in found], float)
        p *= min(1.0, 0.99 / max(p.sum(), 1e-9))
        rate, k = karlin(np.append(list(scores.values()), gap), np.append(p, 1 - p.sum()))
        return Model(scores, gap, rate, k)

    whole = learnt((0, 1))
    rest = whole.rest
    models = [learnt((1,)), learnt((0,))]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for half, model in enumerate(models):
                some = b.filter(pc.equal(b.column("half"), half))
                found = found_passages(some.column("text"), model)
                yield pa.RecordBatch.from_arrays([pa.array([evidence(f) for f in found], pa.float64()), some.column("toxic")], ["x", "toxic"])

    seen = sample.mapInArrow(score, "x double, toxic int").toPandas()
    a, b = _logistic(seen["x"].to_numpy(), seen["toxic"].to_numpy())
    return replace(whole, a=a, b=b)


def judged(text: Column, model: Model) -> Column:
    """(score, n_passages, n_toxic_tokens) of a text as a struct; of a null as of an empty one."""

    @F.arrow_udf("struct<score:double,n_passages:int,n_toxic_tokens:int>")
    def run(texts: pa.Array) -> pa.Array:
        found = list(found_passages(texts, model))
        columns = [pa.array([probability(evidence(f), model) for f in found], pa.float64()), pa.array([len(f) for f in found], pa.int32()), pa.array([sum(e - s for s, e, _ in f) for f in found], pa.int32())]
        return pa.StructArray.from_arrays(columns, ["score", "n_passages", "n_toxic_tokens"])

    return run(F.coalesce(text, F.lit("")))


def score_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, n_passages, n_toxic_tokens) for every row; whole texts are searched, a null or empty
    one has no passages. Repeated rows are scored each, null ids stay, no rows give none."""
    return docs.select(F.col(doc_id).alias("doc_id"), judged(F.col(text), model).alias("found")).select("doc_id", "found.*")


def drop_toxic(docs: DataFrame, model: Model, limit: float = 0.7, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text scores ``limit`` or more; null and empty texts have no passages, repeated
    rows are judged alike, all columns stay as they are, and no rows give none."""
    return docs.where(judged(F.col(text), model)["score"] < limit)


def labelled_texts(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, toxic) of the documents with a label; several labels of one id count as toxic if one does.
    The labels are broadcast if their counted size is small, else joined by a shuffle."""
    marks = labels.where("toxic is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic"))
    return docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("text")).join(small(marks, 48), F.col("_doc") == F.col("_id")).select("text", "toxic")
