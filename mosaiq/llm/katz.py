"""Katz backoff language model of order three over all words: Good-Turing discounted counts, evaluated recursively.

P(w | u v) of a trigram is its discounted share of the history (u, v) if it was seen, once included, else alpha(u, v) times
P(w | v); that is the discounted share of v likewise, else alpha(v) times P(w); and a word's own P is its share of the tokens, where all
unseen words have one share together. What a history gives to seen words and what it gives to others add up to one. The
history of a text's first word is the end of a text and what is before it.

No word and no n-gram is left out. Words are told apart by 64-bit hashes. All trigrams with one middle word v are in one bucket, with
all bigrams after v; so a bucket has all that alpha(v), alpha(u, v) and its tokens' probabilities need, but for the counts of single
words, which it asks for. The histories of a word with very many tokens are dealt to several buckets, whose counts of bigrams are then
added up in Spark; and histories (u, v) of two such words are dealt further, by w, or by text if w is such a word too, and the
counts of their trigrams and what they keep are added up in Spark as well. So no bucket grows with a word, a history or a trigram that is in
every text, and buckets are as many as the tokens ask for; each holds about half a million.

Trigrams travel as compressed arrays, twice: first counts only, summed up over the texts of a slice, and then, with the discounts known,
those of each text to be scored; each bucket adds up its part of every text, and these sums travel as arrays too. Frequent words are written by their rank, others by their hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import cut, give_back, release, workspace

#: Good-Turing discounts counts up to this one.
LARGEST = 5
#: Tokens of a slice of texts, of a bucket, and of a word whose histories stay together (or 1/256 of all), about.
TOKENS, BUCKET, SPLIT = 1 << 20, 1 << 19, 1 << 19
#: Counts of words that are at least this part of the tokens, 1 / HEAD at most, are sent to the tasks; the others are joined.
HEAD = 1e-6
#: Buckets that are scored together, and texts of an input partition (a power of two) whose sums travel together.
JOINED, RANGE = 3, 1 << 12
#: Bits of the numbers that are sorted together with their places; what needs more is sorted by its order.
BITS = 63
#: Hashes of the end of a text and of what is before it: of strings that are no words.
END, PAD = (int(x) for x in pd.util.hash_array(np.array(["\n", "\n\n"], object)).view(np.int64))
_U = np.uint64


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Parts of ``texts`` of about ``TOKENS`` words, or one text, and where they begin."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // (TOKENS * 6)
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield a, texts.slice(a, b - a)
    give_back()


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes of the tokens, sorted, the place of each token among them, and the text of each token.
    Tokens are the words, A-Z in lower case, and one end."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    coded = lists.flatten().dictionary_encode()
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    at = coded.indices.to_numpy(zero_copy_only=False)
    empty = pc.index(coded.dictionary, "").as_py()
    if empty >= 0:
        full = at != empty
        at, owner = at[full], owner[full]
    names = pc.ascii_lower(coded.dictionary).to_numpy(zero_copy_only=False).astype(object)  # words that differ in case only meet in one hash
    known = pd.util.hash_array(names, categorize=False).view(np.int64) if len(names) else np.zeros(0, np.int64)
    if empty >= 0:
        known[empty] = END  # of no token
    hashes, same = np.unique(np.append(known, END), return_inverse=True)
    sizes = np.bincount(owner, minlength=len(texts))
    out = np.full(len(owner) + len(texts), same[-1], np.int64)
    out[np.arange(len(owner)) + owner] = same[at]
    return hashes, out, np.repeat(np.arange(len(texts)), sizes + 1)


def discounts(seen: dict[int, int]) -> np.ndarray:
    """Katz's discount for each count up to LARGEST, from how many n-grams were seen so often."""
    out = np.ones(LARGEST + 1)
    n = [0, *[seen.get(r, 0) for r in range(1, LARGEST + 2)]]
    for r in range(1, LARGEST + 1):
        out[r] = (r - 0.5) / r
        if n[1] and n[r] and n[r + 1]:
            top = (LARGEST + 1) * n[LARGEST + 1] / n[1]
            d = ((r + 1) * n[r + 1] / n[r] / r - top) / (1 - top) if top < 1 else 0
            out[r] = d if 0 < d <= 1 else out[r]
    return out


def word_counts(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            words, same = np.unique(np.concatenate([np.zeros(0, np.int64), *[x for x, _ in held]]), return_inverse=True)
            return words, np.bincount(same, weights=np.concatenate([np.zeros(0), *[x for _, x in held]]), minlength=len(words)).astype(np.int64)

        for b in batches:
            for _, part in slices(b.column(0)):
                hashes, at, _ = tokens(part)
                held.append((hashes, np.bincount(at, minlength=len(hashes))))
                if sum(len(x) for x, _ in held) > TOKENS:
                    held = [merged()]
                    if len(held[0][0]) > TOKENS // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], ["word", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], ["word", "n"])

    return texts.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Head:
    """Of the training tokens: their number, that of distinct ones, and the frequent words, sorted, with their counts and in how
    many parts their histories are dealt. Later also the discounts of bigrams and trigrams, and for words in parts the
    count, kept mass and share of their bigrams."""

    total: int
    types: int
    words: np.ndarray
    counts: np.ndarray
    parts: np.ndarray
    buckets: int
    d2: np.ndarray = field(default_factory=lambda: np.ones(0))
    d3: np.ndarray = field(default_factory=lambda: np.ones(0))
    dealt: dict[int, tuple[float, float, float]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.by_rank = self.words[np.argsort(-self.counts, kind="stable")]
        self.rank = np.empty(len(self.words), np.int64)
        self.rank[np.argsort(-self.counts, kind="stable")] = np.arange(len(self.words))

    def of(self, values: np.ndarray, asked: np.ndarray, other: int) -> np.ndarray:
        """``values`` of the frequent words among ``asked``, ``other`` for the rest."""
        if not len(self.words):
            return np.full(len(asked), other, np.int64)
        at = np.minimum(np.searchsorted(self.words, asked), len(self.words) - 1)
        return np.where(self.words[at] == asked, values[at], other)

    def parts_of(self, asked: np.ndarray) -> np.ndarray:
        """In how many parts; what is before a text is as frequent as the end of one."""
        return self.of(self.parts, np.where(asked == PAD, END, asked), 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _packed(a: np.ndarray) -> bytes:
    """Compressed, the bytes of one rank next to each other."""
    return pa.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, kind: str) -> np.ndarray:
    kind = np.dtype(kind)
    raw = pa.decompress(data, decompressed_size=n * kind.itemsize, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T).view(kind).ravel()


_BLOB = "bucket long, first long, n long, d long, k long, words binary, codes binary, runs binary, texts binary, times binary"
_ABOUT = pa.schema([("number", pa.int64()), ("doc_id", pa.string()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64())])


def _blobs(split: tuple[np.ndarray, np.ndarray, np.ndarray], held: np.ndarray, first: int, head: Head, texts: bool) -> Iterator[tuple]:
    """The distinct trigrams of each text of some, as ``tokens`` gives them, with how often it has them, by bucket. Texts have the numbers from ``first``
    on, of which the lowest bit tells that the text is held out. Without ``texts``: the trigrams of all texts together, counted in training texts
    only; what only others have counts 0, for those texts' buckets ask for words and sums too."""
    hashes, at, owner = split
    words = np.append(hashes, PAD)
    end, pad, n, size = int(np.searchsorted(hashes, END)), len(hashes), len(at), len(hashes) + 1
    if not n:
        return
    new = np.append(True, owner[1:] != owner[:-1])
    v = np.where(new, end, np.append(end, at)[:n])
    u = np.where(new, pad, np.append(pad, v)[:n])
    parts, mixed = head.parts_of(words), _mix(words.view(_U))
    # places: (word, part), of which most words have one, sorted by bucket; a token's place is that of v, and of its part by what is about it
    starts = np.cumsum(parts) - parts
    own = np.repeat(np.arange(size), parts)
    buckets = (_mix(mixed[own] + (np.arange(len(own)) - starts[own]).astype(_U)) % _U(head.buckets)).astype(np.int64)
    order = np.argsort(buckets, kind="stable")
    rank, own, buckets = np.empty_like(order), own[order], buckets[order]
    rank[order] = np.arange(len(order))
    place = starts[v]
    some = np.flatnonzero((parts > 1)[v])
    if len(some):
        by = mixed[u[some]]
        hot = np.flatnonzero(parts[u[some]] > 1)
        if len(hot):
            w = at[some[hot]]
            by[hot] = _mix(by[hot] + mixed[w] * _U(5))
            very = parts[w] > 1
            whole = np.add.reduceat(mixed[at], np.flatnonzero(new))  # of a text, whichever slice it is in
            by[hot[very]] = _mix(by[hot[very]] + whole[owner[some[hot[very]]]])
        place[some] += (by % parts[v[some]].astype(_U)).astype(np.int64)
    place = rank[place]
    # one sort of numbers that hold all that is sorted by: (place, u, w) and whether it is learnt, or (place, u) and the token
    wide, most = size.bit_length(), len(own).bit_length()
    if not texts and most + 2 * wide + 1 <= BITS:
        key = np.sort((((place << wide | u) << wide | at) << 1) | held[owner])
        start = np.flatnonzero(np.append(True, (key[1:] ^ key[:-1]) > 1))
        times = np.diff(np.append(0, np.cumsum(1 - (key & 1)))[np.append(start, n)])
        key = key[start] >> 1
        place, u, w = key >> 2 * wide, key >> wide & (1 << wide) - 1, key & (1 << wide) - 1
    else:
        long = n.bit_length()
        if most + wide + long <= BITS:
            key = np.sort((place << wide | u) << long | np.arange(n))
            use = key & (1 << long) - 1
            key >>= long
        else:
            key = place * size + u
            use = np.argsort(key, kind="stable")
            key = key[use]
        w, of = at[use], owner[use]  # a trigram that a text has again and again can be told more than once
        start = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (w[1:] != w[:-1]) | (of[1:] != of[:-1])))
        times = np.diff(np.append(start, n)) if texts else np.add.reduceat(1 - held[of], start)
        use = use[start]
        place, u, w, owner = place[use], u[use], w[start], of[start]
    runs = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    length, v, bucket = np.diff(np.append(runs, len(place))).astype(np.uint32), own[place[runs]], buckets[place[runs]]
    ranks, times = head.of(head.rank, words, -1), times.astype(np.uint32)
    if texts:
        told = (owner * 2 + held[owner]).astype(np.uint32)
    begins = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    for i, j in zip(begins, np.append(begins[1:], len(runs)), strict=True):
        a, b = int(runs[i]), int(runs[j]) if j < len(runs) else len(place)
        codes = np.concatenate([v[i:j], u[a:b], w[a:b]])
        coded = ranks[codes]
        rare = np.flatnonzero(coded < 0)
        used, at_rare = np.unique(codes[rare], return_inverse=True)
        coded[rare] = len(head.by_rank) + at_rare
        yield (int(bucket[i]), first, b - a, len(used), int(j - i), _packed(np.diff(words[used].view(_U), prepend=_U(0))), _packed(coded.astype(np.uint32)), _packed(length[i:j]), _packed(told[a:b]) if texts else b"", _packed(times[a:b]))


def packed_trigrams(rows: DataFrame, sent, about: bool) -> DataFrame:
    """Blobs of the trigrams of ``rows`` (doc_id, held_out, text) by bucket: counts, or with ``about`` those of each text, and then also, under
    buckets below 0, what each text is and the part that frequent words have in its counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, pid = sent.value, TaskContext.get().partitionId()
        number = pid << 33
        names = [x.split()[0] for x in _BLOB.split(", ")]
        for b in batches:
            for start, part in slices(b.column(2)):
                held = b.column(1).slice(start, len(part)).to_numpy(zero_copy_only=False).astype(np.int64)
                hashes, at, owner = tokens(part)
                out = list(_blobs((hashes, at, owner), held, number, head, about))
                if about:
                    n = head.of(head.counts, hashes, 0)[at]
                    total = lambda x: np.bincount(owner, weights=x, minlength=len(part))  # noqa: E731, B023
                    columns = [pa.array(number + 2 * np.arange(len(part)) + held), b.column(0).slice(start, len(part)), b.column(1).slice(start, len(part)), pa.array(np.bincount(owner, minlength=len(part))), pa.array(total(n > 0).astype(np.int64)), pa.array(total(np.log10(n + 1.0)))]
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, _ABOUT) as w:
                        w.write_batch(pa.RecordBatch.from_arrays(columns, schema=_ABOUT))
                    out.append((-1 - pid, number, 0, 0, 0, sink.getvalue().to_pybytes(), b"", b"", b"", b""))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64() if i < 5 else pa.binary()) for i in range(10)], names)
                number += 2 * len(part)

    return rows.mapInArrow(run, _BLOB)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values, sorted, a place of each, and which of them each value is. Values are not below 0; where they and their places
    fit into one number, those are sorted."""
    wide = len(x).bit_length()
    if len(x) and int(x.max()).bit_length() + wide <= BITS:
        x = np.sort(x << wide | np.arange(len(x)))
        order = x & (1 << wide) - 1
        x >>= wide
    else:
        order = np.argsort(x)
        x = x[order]
    new = np.append(True, x[1:] != x[:-1])[: len(x)]
    which = np.empty(len(x), np.int64)
    which[order] = np.cumsum(new) - 1
    return x[new], order[new], which


class Bucket:
    """The trigrams of a bucket. ``words``: hashes; ``text``, ``times`` and ``tri`` of each row; of each distinct trigram ``c3``, the
    count in training texts, its ``history`` and its ``pair``; of each distinct bigram its words ``v`` and ``w`` and ``c2``. ``histories``: v * size + u,
    ``trigrams``: history * size + w, sorted. ``hot``: trigrams of histories that are dealt to several buckets."""

    def __init__(self, blobs: pa.Table, head: Head) -> None:
        rows = blobs.select([x.split(" ")[0] for x in _BLOB.split(", ")]).to_pylist()
        n_head = len(head.by_rank)
        rare = [np.cumsum(_unpacked(r["words"], r["d"], "u8"), dtype=_U).view(np.int64) for r in rows]
        codes = [_unpacked(r["codes"], 2 * r["n"] + r["k"], "u4").astype(np.int64) for r in rows]
        used = np.zeros(n_head, bool)
        for c in codes:
            used[c[c < n_head]] = True
        own = np.sort(np.concatenate([head.by_rank[used], *rare]))
        self.words = own[np.append(True, own[1:] != own[:-1])[: len(own)]]
        place = np.zeros(n_head, np.int64)
        place[used] = np.searchsorted(self.words, head.by_rank[used])
        parts = []
        for r, c, own in zip(rows, codes, rare, strict=True):
            code = np.concatenate([place, np.searchsorted(self.words, own)])[c]
            runs = _unpacked(r["runs"], r["k"], "u4").astype(np.int64)
            parts.append((np.repeat(code[: r["k"]], runs), code[r["k"] : r["k"] + r["n"]], code[r["k"] + r["n"] :]))
        v, u, w = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.text = np.concatenate([r["first"] + _unpacked(r["texts"], r["n"], "u4").astype(np.int64) if r["texts"] else np.zeros(r["n"], np.int64) for r in rows])
        self.times = np.concatenate([_unpacked(r["times"], r["n"], "u4") for r in rows]).astype(np.float64)
        size = len(self.words)
        self.histories, _, history = _distinct(v * size + u)
        self.trigrams, at, self.tri = _distinct(history * size + w)
        self.c3 = np.bincount(self.tri, weights=self.times * (self.text % 2 == 0), minlength=len(at))
        self.history = history[at]
        pairs, _, self.pair = _distinct(v[at] * size + w[at])
        self.v, self.w = pairs // size, pairs % size
        self.c2 = np.bincount(self.pair, weights=self.c3, minlength=len(pairs))
        many = head.parts_of(self.words) > 1
        self.hot = many[u[at]] & many[v[at]]
        self.u = u[at]


def _kept(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    return n * np.where(n <= LARGEST, d[np.minimum(n, LARGEST).astype(np.int64)], 1.0)


def backed_off(n: np.ndarray, kept: np.ndarray, group: np.ndarray, lower: np.ndarray, known: tuple[np.ndarray, ...] | None = None) -> np.ndarray:
    """P of n-grams with the counts ``n``, discounted ``kept``, by history ``group``; ``lower``: P without the first word. ``known``: for some
    histories (number, count, kept, share of lower P of the seen) of all n-grams, where not all are here."""
    seen = n > 0
    sums = [np.bincount(group, weights=x) for x in (n, kept, lower * seen)]
    if known is not None:
        for total, x in zip(sums, known[1:], strict=True):
            total[known[0]] = x
    count, mass, share = sums
    whole = share > 1 - 1e-9  # every word was seen: nothing is left to back off to
    room = np.where(whole, mass, count + 1)  # the one keeps some mass for the unseen
    alpha = np.where((count == 0) | whole, 1.0, (1 - mass / np.where(room > 0, room, 1)) / np.where(whole, 1.0, 1 - share))
    return np.where(seen, kept / np.where(room > 0, room, 1)[group], alpha[group] * lower)


def _numbers(c: np.ndarray) -> np.ndarray:
    """How many are 1, 2, ... LARGEST + 1."""
    return np.bincount(np.minimum(c, LARGEST + 2).astype(np.int64), minlength=LARGEST + 3)[1 : LARGEST + 2]


_TOLD = "what int, bucket long, u long, v long, w long, n long"


def counted(blobs: DataFrame, sent) -> DataFrame:
    """What the buckets tell before they are scored: (what, bucket, u, v, w, n). what 2 and 3: how many bigrams and trigrams (n) occur v
    times; 1: the bucket needs the count of the word w; 4: it has the bigram (v, w), of a word in parts, n times; 5: the trigram (u, v, w), of a history
    in parts."""

    def run(table: pa.Table) -> pa.Table:
        head = sent.value
        b, bucket = Bucket(table, head), table["bucket"][0].as_py()
        in_parts = (head.of(head.parts, b.words, 1) > 1)[b.v]
        rare = b.words[np.unique(b.w)]
        rare = rare[head.of(head.counts, rare, 0) == 0]
        out = []

        def add(what: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray) -> None:
            k = len(n)
            out.append(pa.table({"what": np.full(k, what, np.int32), "bucket": np.full(k, bucket, np.int64), "u": u.astype(np.int64), "v": v.astype(np.int64), "w": w.astype(np.int64), "n": n.astype(np.int64)}))

        r = np.arange(1, LARGEST + 2)
        add(3, 0 * r, r, 0 * r, _numbers(b.c3[~b.hot]))
        add(2, 0 * r, r, 0 * r, _numbers(b.c2[~in_parts]))
        add(1, 0 * rare, 0 * rare, rare, 0 * rare)
        add(4, b.w[in_parts] * 0, b.words[b.v[in_parts]], b.words[b.w[in_parts]], b.c2[in_parts])
        add(5, b.words[b.u[b.hot]], b.words[b.v[b.pair[b.hot]]], b.words[b.w[b.pair[b.hot]]], b.c3[b.hot])
        del b
        give_back()
        return pa.concat_tables(out)

    return blobs.groupBy("bucket").applyInArrow(run, _TOLD)


_SCORED = "range long, n long, k long, texts binary, score binary, rare binary, base binary, known binary, about binary"


def _ranges(numbers: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Ranges of ``RANGE`` texts, and where their numbers, which are sorted, begin and end."""
    own = numbers // (2 * RANGE)
    bounds = [*np.flatnonzero(np.append(True, own[1:] != own[:-1]))[: len(own)].tolist(), len(own)]
    for a, b in zip(bounds, bounds[1:], strict=False):
        yield int(own[a]), a, b


def _bucket_sums(left: pa.Table, right: pa.Table, head: Head) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One bucket's part of the texts' scores: their numbers, and the sums of each."""
    b = Bucket(left, head)
    size = len(b.words)
    has = {k: right[k].is_valid().combine_chunks().to_numpy(zero_copy_only=False) for k in "uvw"}
    value = {k: right[k].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False) for k in ("u", "v", "w", "n", "mass", "share")}
    place = {k: np.searchsorted(b.words, value[k]) for k in "uvw"}
    single, double, triple, whole = ~has["v"], has["v"] & ~has["u"], has["u"] & has["w"], has["u"] & ~has["w"]
    frequent = head.of(head.counts, b.words, 0)
    count = frequent.copy()
    count[place["w"][single]] = value["n"][single]
    lowest = np.maximum(count, 1) / (head.total + 1)
    if double.any():  # bigrams of words in parts, from all of them; the pairs are sorted by v and w
        b.c2[np.searchsorted(b.v * size + b.w, place["v"][double] * size + place["w"][double])] = value["n"][double]
    history = np.searchsorted(b.histories, place["v"] * size + place["u"])
    if triple.any():
        b.c3[np.searchsorted(b.trigrams, history[triple] * size + place["w"][triple])] = value["n"][triple]
    known = [(i, *head.dealt[x]) for i, x in zip(*[a[np.isin(b.words, list(head.dealt))] for a in (np.arange(size), b.words)], strict=True) if i <= b.v.max()] if head.dealt else []
    two = backed_off(b.c2, _kept(b.c2, head.d2), b.v, lowest[b.w], tuple(map(np.array, zip(*known, strict=True))) if known else None)
    dealt = (history[whole], *(value[k][whole] for k in ("n", "mass", "share"))) if whole.any() else None
    three = np.log10(backed_off(b.c3, _kept(b.c3, head.d3), b.history, two[b.pair], dealt))
    numbers, _, text = _distinct(b.text)
    rare = np.where(frequent == 0, count, 0)[b.w][b.pair]  # of each trigram's last word
    at = np.flatnonzero((rare > 0)[b.tri])
    of, n, times = text[at], rare[b.tri[at]], b.times[at]
    sums = [np.bincount(t, weights=x, minlength=len(numbers)) for t, x in ((text, b.times * three[b.tri]), (of, times * np.log10(n + 1.0)), (of, times))]
    return numbers, *sums


def scored(blobs: DataFrame, answers: DataFrame, sent) -> DataFrame:
    """The parts that ``JOINED`` buckets have in the score, base score and known words of each text, added up, packed by ranges of texts; and the rows about
    the texts of each range. ``answers``: (bucket, u, v, w, n, mass, share): the counts of the words, with v of the bigrams and with u of the trigrams
    that the buckets asked for; without w the count, kept mass and share of a history.

    A text meets nearly all buckets as long as they are fewer than its words. So there is no row for each text and bucket: there are arrays,
    of one entry at most for each token."""
    kind = pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.binary()) for x in _SCORED.split(", ")])

    def told(rows: list[tuple]) -> pa.Table:
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kind)], schema=kind)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        head, out = sent.value, []
        if not len(left):
            return kind.empty_table()
        if left["bucket"][0].as_py() < 0:
            t = pa.concat_tables([pa.ipc.open_stream(x.as_py()).read_all() for x in left["words"]]).sort_by("number").combine_chunks()
            for of, a, b in _ranges(t["number"].to_numpy()):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, _ABOUT) as w:
                    w.write_table(t.slice(a, b - a))
                out.append((of, 0, 0, b"", b"", b"", b"", b"", sink.getvalue().to_pybytes()))
            return told(out)
        give_back()
        own = lambda t, bucket: t.filter(pc.equal(t["bucket"], bucket))
        each = [_bucket_sums(own(left, k), own(right, k), head) for k in pc.unique(left["bucket"]).to_pylist()]
        numbers, at = np.unique(np.concatenate([x[0] for x in each]), return_inverse=True)
        score, base, known = (np.bincount(at, weights=np.concatenate([x[i] for x in each]), minlength=len(numbers)) for i in (1, 2, 3))
        for of, a, b in _ranges(numbers):
            rare = np.flatnonzero(known[a:b])
            texts = np.diff(numbers[a:b] - 2 * RANGE * of, prepend=0)
            packed = [_packed(x) for x in (texts.astype(np.uint16), score[a:b], np.diff(rare, prepend=0).astype(np.uint16), base[a:b][rare], known[a:b][rare].astype(np.uint32))]
            out.append((of, b - a, len(rare), *packed, None))
        del each, numbers, at, score, base, known
        give_back()
        return told(out)

    dealt = lambda df: df.withColumn("dealt", F.when(F.col("bucket") < 0, F.col("bucket")).otherwise(F.expr(f"bucket div {JOINED}"))).groupBy("dealt")
    return dealt(blobs).cogroup(dealt(answers)).applyInArrow(run, _SCORED)


def summed(parts: DataFrame) -> DataFrame:
    """Adds up the ``scored`` parts: a row for each text. A range's sums are arrays of its length, its parts are streamed."""
    names = ("doc_id", "held_out", "n_tokens", "known", "base", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, about, sums = None, [], np.zeros((3, 2 * RANGE))

        def told() -> Iterator[pa.RecordBatch]:
            for b in pa.concat_tables(about).to_batches():
                at = b.column("number").to_numpy() % (2 * RANGE)
                score, base, known = sums[:, at]
                columns = [pa.array(b.column("known").to_numpy() + known.astype(np.int64)), pa.array(b.column("base").to_numpy() + base), pa.array(score)]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names[:3]], *columns], list(names))

        for batch in batches:
            for i in range(batch.num_rows):  # one row at a time: they are long
                r = batch.slice(i, 1).to_pylist()[0]
                if r["range"] != now:
                    if about:
                        yield from told()
                    now, about, sums = r["range"], [], np.zeros((3, 2 * RANGE))
                if r["about"] is not None:
                    about.append(pa.ipc.open_stream(r["about"]).read_all())
                    continue
                n, k = r["n"], r["k"]
                at = np.cumsum(_unpacked(r["texts"], n, "u2"), dtype=np.int64)
                sums[0, at] += _unpacked(r["score"], n, "f8")
                if k:
                    rare = at[np.cumsum(_unpacked(r["rare"], k, "u2"), dtype=np.int64)]
                    sums[1, rare] += _unpacked(r["base"], k, "f8")
                    sums[2, rare] += _unpacked(r["known"], k, "u4")
            give_back()
        if about:
            yield from told()

    kinds = "doc_id string, held_out boolean, n_tokens long, known long, base double, score double"
    return parts.repartition("range").sortWithinPartitions("range").mapInArrow(run, kinds)


def score_texts(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Learns from the rows of ``docs`` where ``held_out`` is false, and scores all: (doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score). ``score`` is the log10 probability of the text and its end. Null texts count as
    empty ones: one token, the end. Null ids stay. Repeated rows are scored each, and learnt from each; without training rows every
    token is unseen; no rows give none."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), held_out.alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    with workspace(spark) as keep:
        words = keep(word_counts(rows.where("not held_out").select("text")))
        total, types = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        top = words.where(F.col("n") >= max(1.0, HEAD * total)).toPandas().sort_values("word")
        counts = top["n"].to_numpy(np.int64)
        most = max(min(SPLIT, total // 256 + 1), int(np.ceil(HEAD * total)), 1)  # so that every word in parts is a frequent one
        head = Head(total, types, top["word"].to_numpy(np.int64), counts, np.where(counts > most, -(-counts // most), 1), total // BUCKET + 1)
        sent = spark.sparkContext.broadcast(head)
        told = keep(counted(packed_trigrams(rows, sent, False), sent))
        release(spark)
        numbers = {(r[0], r[1]): r[2] for r in told.where("what in (2, 3)").groupBy("what", "v").agg(F.sum("n")).collect()}
        pairs = keep(told.where("what = 4").groupBy("v", "w").agg(F.sum("n").alias("n")))
        triples = keep(told.where("what = 5").groupBy("u", "v", "w").agg(F.sum("n").alias("n")))
        for k, grams in ((2, pairs), (3, triples)):
            for r in grams.where((F.col("n") > 0) & (F.col("n") <= LARGEST + 1)).groupBy("n").count().collect():
                numbers[k, r[0]] = numbers.get((k, r[0]), 0) + r[1]
        head.d2, head.d3 = (discounts({r: numbers.get((k, r), 0) for r in range(1, LARGEST + 2)}) for k in (2, 3))
        n = F.col("n")
        kept = lambda d: n * F.when(n <= LARGEST, F.element_at(F.array(*[F.lit(float(x)) for x in d]), F.least(n, F.lit(LARGEST)).cast("int") + 1)).otherwise(1.0)
        lower = F.greatest(F.coalesce("c", F.lit(0)), F.lit(1)) / (total + 1.0)
        with_words = pairs.where("n > 0").join(words.select(F.col("word").alias("w"), F.col("n").alias("c")), "w", "left")
        dealt = with_words.groupBy("v").agg(F.sum("n").alias("count"), F.sum(kept(head.d2)).alias("mass"), F.sum(lower).alias("share")).collect()  # one for each word in parts
        head.dealt = {r[0]: (float(r[1]), r[2], r[3]) for r in dealt}
        sent.unpersist()
        sent = spark.sparkContext.broadcast(head)
        # what histories in parts keep, and what their words have without the first: each bigram was seen, so its discounted share of v
        room = spark.createDataFrame([(r[0], r[2] if r[3] > 1 - 1e-9 else r[1] + 1.0) for r in dealt], "v long, room double")
        second = pairs.where("n > 0").join(F.broadcast(room), "v").select("v", "w", (kept(head.d2) / F.col("room")).alias("p"))
        sums = triples.where("n > 0").join(second, ["v", "w"]).groupBy("u", "v").agg(F.sum("n").alias("n"), F.sum(kept(head.d3)).alias("mass"), F.sum("p").alias("share"))
        none = lambda kind, name: F.lit(None).cast(kind).alias(name)
        tail = (none("double", "mass"), none("double", "share"))
        single = told.where("what = 1").select("bucket", "w").join(words.select(F.col("word").alias("w"), "n"), "w").select("bucket", none("long", "u"), none("long", "v"), "w", "n", *tail)
        double = told.where("what = 4").select("bucket", "v", "w").join(pairs, ["v", "w"]).select("bucket", none("long", "u"), "v", "w", "n", *tail)
        five = told.where("what = 5")
        triple = five.select("bucket", "u", "v", "w").join(triples, ["u", "v", "w"]).select("bucket", "u", "v", "w", "n", *tail)
        whole = five.select("bucket", "u", "v").distinct().join(sums, ["u", "v"]).select("bucket", "u", "v", none("long", "w"), "n", "mass", "share")
        answers = keep(single.unionByName(double).unionByName(triple).unionByName(whole))
        release(spark)
        sums = summed(scored(packed_trigrams(rows, sent, True), answers, sent))
        base = float(np.log10(total + types + 1.0))
        kind = docs.schema[doc_id].dataType.simpleString()
        out = cut(sums.select(F.col("doc_id").cast(kind).alias("doc_id"), "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * base).alias("base_score"), "score"))
    sent.unpersist()  # else each run's table stays in the workers' memory
    release(spark)
    return out
