"""Near-duplicate texts: improved consistent weighted sampling over TF-IDF shingles.

1. Equal texts become one class; what follows is about classes.
2. A shingle weighs its count in the text times its idf. The document frequencies of all shingles are counted exactly:
   the texts are put into slices, the distinct shingles of each are dealt to buckets by ranges of their hashes, and each bucket
   answers every slice with the frequencies of its shingles.
3. Consistent weighted sampling: ``BANDS * ROWS`` independent samples of each text. Each shingle's Gamma and
   uniform variates come from a hash of it and of the sample's number, and all shingles of the text compete
   in every sample. Texts that agree in all rows of a band are candidates.
4. Weighted Jaccard similarity, computed exactly, decides; there shingles in at most 1/20 of the documents weigh alike, so that
   what sets a text apart from its near copies does not weigh more than what they share. First each text is compared with one other: the least
   of those that its buckets begin with. Buckets that still hold several components are then compared in
   blocks, every pair of texts of different components, and only what joins components is returned. Texts
   of a bucket's largest component meet only those outside it, so a large group is not copied for each block;
   of buckets that hold the same texts one is compared.

Texts travel as texts (they compress, hashes of shingles don't) and are cut into shingles where they are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import components, cut, give_back, release, small, text_key, workspace
from mosaiq.llm.katz import _packed, _unpacked

SHINGLE, LEAST = 5, Fraction(4, 5)
BANDS, ROWS = 16, 3
#: For the decision, shingles in a larger part of the documents weigh less.
COMMON = 0.05
#: Texts, and bytes of them, compared together at most, on each side (about); columns at once.
BLOCK, WEIGHT, COLUMNS = 256, 1 << 22, 1 << 14
#: Tokens handled at once; shingles sampled at once; times TOKENS in a slice of texts; distinct shingles of slices in a bucket, about.
TOKENS, AT_ONCE, SLICE, BUCKET = 1 << 18, 1 << 15, 4, 1 << 21

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) for every window of ``width`` words, by text: a place in ``texts`` and a 64-bit hash. A text
    of fewer words, but some, has one shingle: all of it."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    names = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object)) if len(flat) else np.zeros(0, _U)
    own = coded.indices.to_numpy()[full]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(lists.offsets.to_numpy()))[full]
    sizes = np.bincount(owner, minlength=len(texts))
    n = max(0, len(own) - width + 1)
    total = np.zeros(n, _U)
    for k in range(width):
        total += _mix(names + _U(k * 0x9E3779B97F4A7C15 % 2**64))[own[k : k + n]]
    whole = owner[:n] == owner[width - 1 :] if n else np.zeros(0, bool)
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    first = np.concatenate([[0], np.cumsum(sizes)])
    extra = np.zeros(len(short), _U)
    for k in range(width - 1):
        has = sizes[short] > k
        extra[has] = _mix(extra[has] ^ names[own[first[short[has]] + k]] ^ _U(k + 1))
    doc, shingle = np.concatenate([owner[:n][whole], short]), np.concatenate([_mix(total[whole]), extra])
    order = np.argsort(doc, kind="stable")  # two sorted runs: a merge
    return doc[order], shingle[order]


def counted(doc: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle), sorted, with how often the text has the shingle; ``doc`` is sorted."""
    s, ends = shingle.copy(), np.flatnonzero(np.diff(doc)) + 1
    for part in np.split(s, ends):
        part.sort()
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    new[ends] = True
    at = np.flatnonzero(new)
    return doc[at], s[at], np.diff(np.append(at, len(s)))


def _slices(texts: pa.Array, times: int = 1) -> Iterator[tuple[int, pa.Array]]:
    """Parts of ``texts`` of about ``times`` * ``TOKENS`` words, or one text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // (times * TOKENS * 6)
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield a, texts.slice(a, b - a)
    give_back()


class Idf:
    """Weights in the decision: those of the common shingles, sorted by shingle; all others weigh ``top``."""

    def __init__(self, counts: list[tuple[int, int]], n_docs: int) -> None:
        counts = sorted((k % 2**64, n) for k, n in counts)
        self.top = float(np.log1p(1 / COMMON))
        self.keys = np.array([k for k, _ in counts], _U)
        self.values = np.log1p(n_docs / np.array([n for _, n in counts], float)) if counts else np.zeros(0)

    def __call__(self, shingle: np.ndarray) -> np.ndarray:
        out = np.full(len(shingle), self.top)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, shingle), len(self.keys) - 1)
            hit = self.keys[at] == shingle
            out[hit] = self.values[at[hit]]
        return out


def sliced(rows: DataFrame) -> DataFrame:
    """(slice, n, size, texts): ``rows`` (node, text) in numbered slices. They are to be written before they are used: which texts
    a slice has is then settled, whatever order rows come in when they are read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for b in batches:
            for at, part in _slices(b.column(1), SLICE):
                sink = pa.BufferOutputStream()
                own = pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), part], ["node", "text"])
                with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_batch(own)
                size = pc.sum(pc.binary_length(part)).as_py()
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (number, len(part), size, sink.getvalue().to_pybytes())], ["slice", "n", "size", "texts"])
                number += 1

    return rows.mapInArrow(run, "slice long, n long, size long, texts binary")


def _opened(texts: bytes) -> tuple[pa.Array, pa.Array]:
    """The nodes and texts of a slice."""
    (batch,) = pa.ipc.open_stream(texts)
    return batch.column(0), batch.column(1)


def frequencies(parts: DataFrame, n_docs: int, size: int) -> DataFrame:
    """In how many of all documents each shingle of each slice of ``parts`` is: (slice, bucket, n, df), where ``df`` has the packed frequencies of the
    n distinct shingles that the slice has in the bucket, in their order. Without a slice: shingles in more than ``COMMON`` of the
    documents, n times. Buckets are as many as the bytes ask for, and a shingle comes once at most from a slice, so none grows."""
    buckets = size // (6 * BUCKET) + 1
    bounds = np.array([-(-(k << 64) // buckets) for k in range(1, buckets)], _U)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                _, s, _ = counted(*shingles(_opened(b.column(1)[i].as_py())[1]))
                s.sort()
                start = np.flatnonzero(np.append(True, s[1:] != s[:-1]))[: len(s)]
                times, s = np.diff(np.append(start, len(s))).astype(np.uint32), s[start]
                cuts = [0, *np.searchsorted(s, bounds).tolist(), len(s)]
                out = [(k, b.column(0)[i].as_py(), y - x, _packed(np.diff(s[x:y], prepend=_U(0))), _packed(times[x:y])) for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if y > x]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64() if k < 3 else pa.binary()) for k in range(5)], ["bucket", "slice", "n", "shingles", "times"])
            give_back()

    def total(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        every = np.concatenate([np.cumsum(_unpacked(r["shingles"], r["n"], "u8"), dtype=_U) for r in rows])
        times = np.concatenate([_unpacked(r["times"], r["n"], "u4") for r in rows]).astype(np.int64)
        order = np.argsort(every)
        every, times = every[order], times[order]
        new = np.append(True, every[1:] != every[:-1])
        df = np.add.reduceat(times, np.flatnonzero(new))
        each = np.empty(len(order), np.uint32)
        each[order] = df[np.cumsum(new) - 1]
        ends = np.cumsum([r["n"] for r in rows])
        common, bucket = df > COMMON * n_docs, rows[0]["bucket"]
        out = [(r["slice"], bucket, r["n"], _packed(each[e - r["n"] : e]), None) for r, e in zip(rows, ends, strict=True)]
        out += [(None, bucket, n, None, k) for n, k in zip(df[common].tolist(), every[new][common].view(np.int64).tolist(), strict=True)]
        del every, times, order, new, df, each
        give_back()
        return pa.table({k: pa.array([r[i] for r in out], pa.binary() if k == "df" else pa.int64()) for i, k in enumerate(("slice", "bucket", "n", "df", "shingle"))})

    blobs = parts.select("slice", "texts").mapInArrow(deal, "bucket long, slice long, n long, shingles binary, times binary")
    return blobs.groupBy("bucket").applyInArrow(total, "slice long, bucket long, n long, df binary, shingle long")


def _counted_in(rows: DataFrame, keep) -> tuple[DataFrame, DataFrame, Idf, int]:
    """Slices of ``rows`` (node, text), the frequencies of their shingles, weights for the decision, and the number of rows."""
    parts = keep(sliced(rows))
    n_docs, size = parts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    told = keep(frequencies(parts, n_docs, size))
    # no more than (mean shingles of a text) / COMMON
    return parts, told, Idf([tuple(r) for r in told.where("slice is null").select("shingle", "n").collect()], n_docs), n_docs


def common_shingles(docs: DataFrame, text: str) -> Idf:
    """Counts exactly, over all documents, the shingles in more than ``COMMON`` of them."""
    rows = docs.select(F.lit(b"").alias("node"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    with workspace(docs.sparkSession) as keep:
        return _counted_in(rows, keep)[2]


def tf_idf(shingle: np.ndarray, times: np.ndarray, told: list[dict], n_docs: int) -> np.ndarray:
    """The weights of the shingles of a slice's texts: how often the text has it, times log(1 + documents / documents with it)."""
    order = np.argsort(shingle)
    s = shingle[order]
    which = np.empty(len(s), np.int64)
    which[order] = np.cumsum(np.append(True, s[1:] != s[:-1])[: len(s)]) - 1
    df = np.concatenate([np.ones(0, np.uint32), *[_unpacked(r["df"], r["n"], "u4") for r in sorted(told, key=lambda r: r["bucket"])]])
    return times * np.log1p(n_docs / df)[which]


def _uniforms(x: np.ndarray) -> np.ndarray:
    """Two uniforms in (0, 1] from 64 bits, one after the other: the upper 23 bits of each half."""
    return np.float32(2) - ((x.view(np.uint32) >> np.uint32(9)) | np.uint32(0x3F800000)).view(np.float32)


def samples(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
    """``BANDS * ROWS`` independent consistent weighted samples (Ioffe) of each text: each has its own r, c and beta for
    every shingle, and the least over all shingles of the text wins. A sample is a hash of the winner and of its
    quantised weight; two texts agree in one with the probability of their weighted Jaccard similarity. Texts without
    shingles have none (0). ``doc`` is sorted, and each text's shingles are, so that ties fall alike in all texts."""
    bins = BANDS * ROWS
    best, out = np.full((bins, n_docs), np.inf, np.float32), np.zeros((bins, n_docs), _U)
    log_w = np.log(weight).astype(np.float32)
    for start in range(0, len(shingle), AT_ONCE):  # arrays that stay in the processor's cache
        d, s, w = doc[start : start + AT_ONCE], shingle[start : start + AT_ONCE], log_w[start : start + AT_ONCE]
        first = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
        own, sizes = d[first], np.diff(np.append(first, len(d)))
        for k in range(bins):
            x = _mix(s + _U((k + 1) * 0xD1B54A32D192ED03 % 2**64))
            y = x * _U(0x9FB21C651E98DF25)
            y ^= y >> _U(32)
            u, v = _uniforms(x), _uniforms(y)
            r = np.maximum(-np.log(u[::2] * u[1::2]), np.float32(1e-7))
            c = np.maximum(-np.log(v[::2] * v[1::2]), np.float32(1e-30))
            low = x.view(np.uint32) & np.uint32(511)  # bits that u has not used
            beta = (low[::2] | (low[1::2] << np.uint32(9))).astype(np.float32) * np.float32(2.0**-18)
            t = np.floor(w / r + beta)
            a = np.log(c) - r * (t - beta + np.float32(1))
            least = np.minimum.reduceat(a, first)
            won = np.flatnonzero(a == np.repeat(least, sizes))
            won = won[np.append(True, d[won[1:]] != d[won[:-1]])]
            better = least < best[k, own]  # a text can begin in an earlier part
            at, won = own[better], won[better]
            best[k, at] = least[better]
            out[k, at] = _mix(s[won] ^ _mix(t[won].astype(np.int64).view(_U))) | _U(1)
    return out.T


def bands(sampled: np.ndarray) -> np.ndarray:
    """One hash for each text and band, of the band's number and its samples."""
    by = sampled.reshape(len(sampled), BANDS, ROWS)
    out = np.tile(np.arange(1, BANDS + 1, dtype=_U), (len(sampled), 1))
    for k in range(ROWS):
        out = _mix(out ^ by[:, :, k])
    return out


def similarity(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, idf: Idf) -> Fraction:
    """Weighted Jaccard similarity of two texts, as sorted shingles and their counts: the exact ratio of the sums of the weights. Equal
    weights are counted together, so that no sum is rounded."""
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    weights, at = np.unique(np.concatenate([idf(x[i]), idf(x), idf(y)]), return_inverse=True)
    counts = np.stack([np.bincount(a, weights=n, minlength=len(weights)) for a, n in zip(np.split(at, [len(i), len(i) + len(x)]), (np.minimum(nx[i], ny[j]), nx, ny), strict=True)])
    both, one, two = (sum((Fraction(float(w)) * int(n) for w, n in zip(weights, c, strict=True) if n), Fraction(0)) for c in counts)
    either = one + two - both
    return both / either if either else Fraction(0)


def is_near(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, idf: Idf) -> bool:
    """Whether the similarity is ``LEAST`` or more; the exact ratio is only made where rounded sums can't tell."""
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = float((np.minimum(nx[i], ny[j]) * idf(x[i])).sum())
    either = float((nx * idf(x)).sum() + (ny * idf(y)).sum()) - both
    over = both - float(LEAST) * either
    return over > 0 if abs(over) > 1e-9 * either else similarity(x, nx, y, ny, idf) >= LEAST


def _joined(group: pa.Table, idf: Idf) -> pa.Table:
    """What joins components among the texts of one pair of blocks of a bucket: (a, b)."""
    column = lambda k: group[k].combine_chunks()
    n = len(group)
    of, shingle, times = counted(*shingles(column("text")))
    sizes = np.bincount(of, minlength=n)
    ends = np.cumsum(sizes)
    text = lambda k: (shingle[ends[k] - sizes[k] : ends[k]], times[ends[k] - sizes[k] : ends[k]])
    # a shingle that a text has n times is n features, so that minima of counts are common features
    owner, every = np.repeat(np.repeat(np.arange(n, dtype=np.int32), sizes), times), np.repeat(shingle, times)
    nth = np.arange(len(every)) - np.repeat(np.cumsum(times) - times, times)
    weight = idf(every)
    total = np.bincount(owner, weights=weight, minlength=n)
    _, at, held = np.unique(_mix(every + nth.astype(_U) * _U(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    use = np.flatnonzero(held[at] > 1)
    use = use[np.argsort(at[use])]
    place = (np.cumsum(held > 1) - 1)[at[use]]
    both = np.zeros((n, n))
    for start in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):  # some columns at a time: bounded memory
        some = slice(*np.searchsorted(place, (start, start + COLUMNS)))
        dense = np.zeros((n, COLUMNS), np.float32)
        dense[owner[use[some]], place[some] - start] = np.sqrt(weight[use[some]])
        both += dense @ dense.T
    part = column("component").dictionary_encode().indices.to_numpy()
    block, node = column("block").to_numpy(), column("node").to_pylist()
    likely = (both >= (float(LEAST) - 1e-3) * (total[:, None] + total[None, :] - both)) & (part[:, None] != part[None, :])
    if group["i"][0].as_py() != group["j"][0].as_py():
        likely &= block[:, None] != block[None, :]
    root, out = list(range(int(part.max()) + 1)), []

    def find(c: int) -> int:
        while root[c] != c:
            c = root[c]
        return c

    for p, q in zip(*np.nonzero(np.triu(likely, 1)), strict=True):
        if find(part[p]) != find(part[q]) and is_near(*text(p), *text(q), idf):
            root[find(part[p])] = find(part[q])
            out += [p, q]
    least: dict[int, bytes] = {}  # links go to the least text of what is joined, so that none is linked with very many lesser ones
    for k in out:
        least[find(part[k])] = min(node[k], least.get(find(part[k]), node[k]))
    out = [(node[k], least[find(part[k])]) for k in dict.fromkeys(out) if node[k] != least[find(part[k])]]
    return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([x for _, x in out], pa.binary())})


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, node, copy_of, class_id, kept) for every row: ``node`` stands for its text, ``copy_of`` is the least
    id of that text, ``class_id`` the least id of all texts that links reach, and ``kept`` marks the
    row of the class with that id. Texts link if the weighted Jaccard similarity of their shingles, with the weights of the decision,
    is 0.8 or more and they share a bucket (probability above 0.9999 where it is 0.8 by the weights of the samples too, 0.9998 at 0.75, 0.98 at 0.6).

    Null texts count as empty ones. Texts without words are near only to themselves. Null ids are kept as
    rows; they are a class's id only if it has no other. Of repeated rows (one id, one text) all are
    marked ``kept``. An empty table gives an empty result. Columns other than the two named are not read."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def sketch(left: pa.Table, right: pa.Table) -> pa.Table:
        names, out = ["node", "bands"], [pa.table({"node": pa.array([], pa.binary()), "bands": pa.array([], pa.list_(pa.int64()))})]
        for texts in left["texts"].to_pylist():
            node, part = _opened(texts)
            d, s, n = counted(*shingles(part))
            found = bands(samples(d, s, tf_idf(s, n, right.to_pylist(), n_docs), len(part)))
            has = np.bincount(d, minlength=len(part)) > 0
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * BANDS)]).astype(np.int32)), pa.array(found[has].view(np.int64).ravel()))
            out.append(pa.Table.from_arrays([node, lists], names))
        give_back()
        return pa.concat_tables(out)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center, other = None, None
        for b in batches:
            for at, part in _slices(b.column("text")):
                d, s, n = counted(*shingles(part))
                ends = np.searchsorted(d, np.arange(len(part) + 1))
                centers, near = b.column("center").slice(at, len(part)).to_pylist(), np.zeros(len(part), bool)
                for i, name in enumerate(centers):
                    if name != center:
                        center, other = name, counted(*shingles(b.column("c_text").slice(at + i, 1)))[1:]
                    near[i] = is_near(s[ends[i] : ends[i + 1]], n[ends[i] : ends[i + 1]], *other, idf)
                yield pa.RecordBatch.from_arrays([b.column(k).slice(at, len(part)).filter(pa.array(near)) for k in ("node", "center")], ["a", "b"])

    with workspace(docs.sparkSession) as keep:
        nodes = cut(rows.select("doc_id", text_key("text").alias("node")))
        with workspace(docs.sparkSession) as aside:
            parts, told, idf, n_docs = _counted_in(rows.select(text_key("text").alias("node"), "text"), aside)
            release(docs.sparkSession)
            each = told.where("slice is not null").select("slice", "bucket", "n", "df").groupBy("slice")
            own = keep(parts.select("slice", "texts").groupBy("slice").cogroup(each).applyInArrow(sketch, "node binary, bands array<long>").distinct())
        flat = own.select("node", F.explode("bands").alias("bucket"))
        full = flat.groupBy("bucket").agg(F.min("node").alias("center"), F.max("node").alias("last")).where("center <> last").drop("last")
        met = keep(flat.join(full, "bucket"))
        pairs = met.where("node <> center").groupBy("node").agg(F.min("center").alias("center"))
        wanted = keep(met.select("node").distinct())
        keyed = rows.select(text_key("text").alias("node"), "text").join(small(wanted, 40), "node", "left_semi")
        content = keep(keyed.groupBy("node").agg(F.first("text").alias("text")))
        release(docs.sparkSession)

        center = content.select(F.col("node").alias("center"), F.col("text").alias("c_text"))
        first = content.join(pairs, "node").join(center, "center").select("node", "center", "text", "c_text")
        links = keep(first.mapInArrow(verify, "a binary, b binary"))
        about = content.select("node", F.octet_length("text").alias("size")).join(components(links), "node", "left").select("node", "size", F.coalesce("root", "node").alias("component"))
        state = keep(met.select("node", "bucket").join(about, "node"))
        sizes = state.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("w"), F.bit_xor(F.xxhash64("node")).alias("x"))
        by = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component", "w")).alias("main"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.bit_xor("x").alias("x")).where(F.col("n") > F.col("main.n"))
        by = by.groupBy("x", "n", "w").agg(F.min(F.struct("bucket", "main")).alias("b")).select("b.bucket", "b.main", "n", "w")
        parts = lambda n, w: F.greatest(F.ceil(n / BLOCK), F.ceil(w / WEIGHT)).cast("int")
        open_ones = by.select("bucket", F.col("main.component").alias("main"), parts(F.col("main.n"), F.col("main.w")).alias("main_parts"), parts(F.col("n") - F.col("main.n"), F.col("w") - F.col("main.w")).alias("parts"))
        # blocks of the largest component have numbers below 0 and meet only those of the others
        rest = state.join(open_ones, "bucket").withColumn("in_main", F.col("component") == F.col("main"))
        own_block = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
        rest = rest.withColumn("block", F.when(F.col("in_main"), -1 - own_block("main_parts")).otherwise(own_block("parts")))
        other = rest.select("*", F.explode(F.sequence(F.when(F.col("in_main"), F.lit(0)).otherwise(-F.col("main_parts")), F.col("parts") - 1)).alias("other"))
        blocks = other.select("node", "bucket", "block", "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        more = keep(blocks.join(content, "node").groupBy("bucket", "i", "j").applyInArrow(lambda g: _joined(g, idf), "a binary, b binary"))
        release(docs.sparkSession)
        group = components(links.unionByName(more))
        ids = cut(nodes.groupBy("node").agg(F.min("doc_id").alias("copy_of")).join(group, "node", "left").withColumn("root", F.coalesce("root", "node")))
    classes = ids.groupBy("root").agg(F.min("copy_of").alias("class_id"))
    named = ids.join(classes, "root").select("node", "copy_of", "class_id")
    return nodes.join(named, "node").select("doc_id", "node", "copy_of", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class of near duplicates, all its columns as they are, whatever their names.
    Null texts count as empty ones and are one class with them; null ids are ids like others here; of
    repeated rows (one id, one text) one stays; an empty table gives an empty result."""
    found = cut(near_duplicates(docs, doc_id, text))
    own, row = F.struct(F.col(doc_id).alias("id"), text_key(text).alias("node")).alias("own"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, own)
    key = lambda df: df.select(F.struct(F.col("doc_id").alias("id"), "node").alias("key"))
    same = F.col("own.id").eqNullSafe(F.col("key.id")) & (F.col("own.node") == F.col("key.node"))
    left = rows.join(small(key(found.where("not kept")), 64), same, "left_anti")
    twice = key(found.where("kept").groupBy("doc_id", "node").count().where("count > 1"))
    if not twice.isEmpty():
        again = left.join(twice, same, "left_semi").dropDuplicates(["own"])
        left = left.join(twice, same, "left_anti").unionByName(again)
    return left.select("row.*")
