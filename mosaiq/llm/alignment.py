"""Alignment of two tokenizers over the same bytes, and how often their tokens end together over all documents.

Tokens of A and B that end at one byte are linked; between such bytes lie groups. What a pair of ids counts over all documents needs a
shuffle: each document's pairs with their multiplicities are dealt by the id of side B, together with the counts of that id's pairs.
Spark sorts each of these streams on disk where it must, counts before postings, so a task holds the counts of one bucket of ids, and of
the postings a batch. It finds the largest count of each B id and sends each document its part; parts are added up by document.
An id of very many documents is dealt to several tasks by document, each with that id's counts.

Texts are cut where neither tokenizer joins anything: before a single space between two characters that are no white space. The
first splits there by its pattern; of the second no piece has a space after another character, which is tested when it is loaded. So each
distinct unit is encoded and aligned once, all new ones of some texts together, and a document's groups are those of its units in order.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import cut, give_back

FOLDER = "/opt/tokenizers"
#: Bytes of texts handled at once, about; units that a worker remembers, and pairs that it counts; postings of a bucket, about, and the least number of buckets.
BYTES, REMEMBERED, BUCKET, BUCKETS = 2 << 20, 1 << 19, 1 << 22, 32


def byte_of_character() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones of Latin-1 stand for themselves, the others, in
    order, for the characters from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


class Side:
    """One tokenizer: ids of texts that begin with a space, and the bytes of each id; ``cuts``: whether texts may be cut into units."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.encode_special_tokens = True
            of = byte_of_character()
            self.encode = lambda texts: [e.ids for e in own.encode_batch_fast(texts, add_special_tokens=False)]
            names = [own.id_to_token(i) or "" for i in range(own.get_vocab_size())]
            self.bytes = [bytes(of[c] for c in name) if all(c in of for c in name) else name.encode() for name in names]
            self.cuts = True
        else:
            from sentencepiece import SentencePieceProcessor

            own = SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: own.encode([t[1:] for t in texts], num_threads=1)  # it adds the space
            names = [own.id_to_piece(i) for i in range(own.get_piece_size())]
            self.bytes = [bytes([int(n[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", n) else n.replace("▁", " ").encode() for n in names]
            self.cuts = not any(re.search("[^▁]▁", n) for n in names)
        self.size = np.array([len(b) for b in self.bytes])


def cut_units(texts: pa.Array, cuts: bool = True) -> tuple[pa.Array, np.ndarray]:
    """The units of ``texts``, which all begin with a space and go on, and how many each has. A unit begins at a space that stands alone between
    characters which can't be white space: visible ASCII, or those of two bytes from U+00C0 on."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[: ends[-1]] if data is not None else np.zeros(0, np.uint8)
    starts = ends[:-1]
    if cuts and len(raw) > 3:
        at = np.flatnonzero(raw[:-1] == 32)
        at = at[(at >= ends[0] + 2) & (at < ends[-1] - 1)]
        seen = lambda x: (x > 32) & (x < 127)
        lead = lambda x: (x >= 0xC3) & (x <= 0xDF)
        last, after = raw[at - 1], raw[at + 1]
        at = at[(seen(last) | ((last >= 0x80) & lead(raw[at - 2]))) & (seen(after) | lead(after))]
        at = at[~np.isin(at, ends)]  # a text's first space is its own
        starts = np.union1d(starts, at)
    offsets = np.append(starts, ends[-1])
    sizes = np.diff(np.searchsorted(starts, ends))
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), data), sizes


class Units:
    """Alignments of distinct units. ``known``: the units; of each ``n_a`` and ``n_b``, its tokens (-1: they don't give its bytes back), and where
    its part of ``codes`` (tokens in the order of the groups' text) and ``links`` (b << 32 | a, one for each group) begins."""

    def __init__(self, a: Side, b: Side) -> None:
        self.a, self.b = a, b
        ids_a, ids_b = range(len(a.bytes)), range(len(b.bytes))
        # code 2 * id for a token and 2 * id + 1 for one that ends its side of a group, ids of B after those of A; then ids of B that end a text
        self.names = pa.array([f"{i}{c}" for i in ids_a for c in ",|"] + [f"{i}{c}" for i in ids_b for c in ",;"] + [str(i) for i in ids_b], pa.large_string())
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.n_a, self.n_b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.codes, self.links = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.first_code, self.first_link = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def places(self, units: pa.Array) -> np.ndarray:
        """Where ``units``, which are distinct, are; new ones are aligned."""
        if len(self.known) > REMEMBERED:
            self.forget()
        at = pc.index_in(units, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = len(self.known) + np.arange(len(new))
            self._learn(units.take(pa.array(new)))
        return at

    def _learn(self, units: pa.Array) -> None:
        texts, n = units.to_pylist(), len(units)
        sides, fine = [], np.ones(n, bool)
        whole = np.frombuffer(b"".join(t.encode() for t in texts), np.uint8)
        sizes = pc.binary_length(units).to_numpy(zero_copy_only=False)
        for side in (self.a, self.b):
            ids = side.encode(texts)
            count = np.fromiter(map(len, ids), np.int64, n)
            flat = np.fromiter(chain.from_iterable(ids), np.int64, int(count.sum()))
            owner = np.repeat(np.arange(n), count)
            long = np.bincount(owner, weights=side.size[flat], minlength=n) == sizes
            own = np.frombuffer(b"".join(map(side.bytes.__getitem__, flat[long[owner]].tolist())), np.uint8)
            of = np.repeat(np.arange(n), sizes)
            same = own == whole[long[of]]
            long[of[long[of]][~same]] = False
            fine &= long
            sides.append((flat, owner, side.size))
        ends = []
        for flat, owner, size in sides:
            keep = fine[owner]
            ends.append((flat[keep], owner[keep], np.cumsum(size[flat[keep]])))
        (ids_a, own_a, end_a), (ids_b, own_b, end_b) = ends
        last_a, last_b = np.isin(end_a, end_b), np.isin(end_b, end_a)
        group = lambda last: np.cumsum(last) - last
        order = np.argsort(np.concatenate([2 * group(last_a), 2 * group(last_b) + 1]), kind="stable")
        codes = np.concatenate([2 * ids_a + last_a, 2 * len(self.a.bytes) + 2 * ids_b + last_b])[order]
        count = lambda own: np.bincount(own, minlength=n)
        add = lambda first, own: np.append(first, first[-1] + np.cumsum(count(own)))
        self.codes, self.links = np.append(self.codes, codes.astype(np.int32)), np.append(self.links, ids_b[last_b] << 32 | ids_a[last_a])
        self.first_code, self.first_link = add(self.first_code, np.append(own_a, own_b)), add(self.first_link, own_b[last_b])
        self.n_a, self.n_b = np.append(self.n_a, np.where(fine, count(own_a), -1)), np.append(self.n_b, np.where(fine, count(own_b), -1))
        self.known = pa.concat_arrays([self.known, units])


@lru_cache(maxsize=2)
def units_of(path_a: str, path_b: str) -> Units:
    return Units(Side(path_a), Side(path_b))


_ALIGNED = "n_a bigint, n_b bigint, n_groups bigint, groups string, a array<int>, b array<int>, n array<int>"


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each part, one part after the other."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _align_texts(texts: pa.Array, known: Units) -> list[pa.Array]:
    """``_ALIGNED`` for some texts."""
    n = len(texts)
    bad = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    units, sizes = cut_units(pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts.cast(pa.large_string()), pa.scalar(" ", pa.large_string())), known.a.cuts and known.b.cuts)
    coded = units.dictionary_encode()
    place, unit = known.places(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(n), sizes)
    bad[owner[known.n_a[place][unit] < 0]] = True
    owner, unit = owner[~bad[owner]], unit[~bad[owner]]
    at = place[unit]
    total = lambda x: np.bincount(owner, weights=x[at], minlength=n).astype(np.int64)
    # the groups as text: all tokens in order, then one text from those of each document
    n_codes, n_links = np.diff(known.first_code), np.diff(known.first_link)
    codes = known.codes[_spread(known.first_code[at], n_codes[at])]
    ends = np.cumsum(total(n_codes))
    ended = ends[~bad] - 1
    codes[ended] = 2 * len(known.a.bytes) + 2 * len(known.b.bytes) + (codes[ended] - 2 * len(known.a.bytes)) // 2
    groups = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.append(0, ends)), known.names.take(pa.array(codes))), pa.scalar("", pa.large_string()))
    # the pairs of each text with how often it has them, from its distinct units
    key, times = np.unique(owner * len(place) + unit, return_counts=True)
    own = place[key % max(1, len(place))]
    each = n_links[own]
    pairs, code = np.unique(known.links[_spread(known.first_link[own], each)], return_inverse=True)
    full, inverse = np.unique(np.repeat(key // max(1, len(place)), each) * len(pairs) + code, return_inverse=True)
    counts = np.bincount(inverse, weights=np.repeat(times, each), minlength=len(full))
    pair = pairs[full % max(1, len(pairs))]
    offsets = pa.array(np.searchsorted(full // max(1, len(pairs)), np.arange(n + 1)).astype(np.int32))
    listed = lambda x: pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32)))
    return [pa.array(total(known.n_a)), pa.array(total(known.n_b)), pa.array(total(n_links)), groups.cast(pa.string()), listed(pair & 0xFFFFFFFF), listed(pair >> 32), listed(counts)]


def align(docs: DataFrame, text: str = "text", path_a: str = f"{FOLDER}/byte_bpe_50k.json", path_b: str = f"{FOLDER}/piece_bpe_32k.model") -> DataFrame:
    """``docs`` without ``text``, with ``n_a`` and ``n_b`` tokens, ``n_groups``, ``groups`` as text (``a1,a2|b1;a3|b2,b3``), and the distinct linked
    pairs as arrays ``a``, ``b`` and ``n`` (how often), in the order of b and a.

    Both tokenizers encode a space and the text without special tokens. Null and empty texts have no tokens, nor has a text whose
    tokens of either side don't give those bytes back: zeros, an empty text and empty arrays. Repeated rows are aligned each, nulls in other
    columns stay, an empty table gives an empty result; columns that are named like the new ones are overwritten."""
    made = [x.split(" ")[0] for x in _ALIGNED.split(", ")]
    keep = [c for c in docs.columns if c not in (text, *made)]
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("_none"))
    rows = docs.select(row.alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = units_of(path_a, path_b)
        for batch in batches:
            block = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)) // BYTES
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if e > s:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), *_align_texts(batch.column(1).slice(s, e - s), known)], ["row", *made])
            give_back()

    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {_ALIGNED}")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], *made)


# ---- counts over all documents


def _packed(a: np.ndarray) -> bytes:
    return pa.compress(a.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


#: Postings (kind 1: a document's pairs) or counts (kind 0) of one bucket: ``key`` is b << 32 | a, ``size`` rows.
_BLOB = "bucket bigint, kind int, size bigint, key binary, row binary, n binary"
_NAMES = [x.split(" ")[0] for x in _BLOB.split(", ")]


def _blobs(kind: int, bucket: np.ndarray, key: np.ndarray, row: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((row, key, bucket))
    bucket, key, row, n = bucket[order], key[order], row[order], n[order]
    bounds = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else np.zeros(1, np.int64)
    out = [(int(bucket[s]), kind, int(e - s), _packed(np.diff(key[s:e], prepend=0)), _packed(row[s:e]), _packed(n[s:e])) for s, e in zip(bounds, bounds[1:], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], _NAMES)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Row, key and n of each pair of the documents of a batch (row, a, b, n)."""
    a, b, n = (batch.column(k).flatten().to_numpy().astype(np.int64) for k in ("a", "b", "n"))
    sizes = pc.list_value_length(batch.column("a")).to_numpy(zero_copy_only=False)
    return np.repeat(batch.column("row").to_numpy(), sizes), b << 32 | a, n


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(key, n, docs) for each linked pair: how many links, in how many documents. Tasks add up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, np.int64), np.zeros((2, 0))

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), *[pa.array(s.astype(np.int64)) for s in sums]], ["key", "n", "docs"])

        for batch in batches:
            _, key, n = _flat(batch)
            keys, at = np.unique(np.concatenate([keys, key]), return_inverse=True)
            sums = np.stack([np.bincount(at, weights=np.concatenate([old, new]), minlength=len(keys)) for old, new in zip(sums, (n, np.ones(len(n))), strict=True)])
            if len(keys) > REMEMBERED:
                yield told()
                keys, sums = keys[:0], sums[:, :0]
        yield told()

    parts = aligned.select(F.lit(0).cast("bigint").alias("row"), "a", "b", "n").mapInArrow(run, "key bigint, n bigint, docs bigint")
    return parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def link_sums(aligned: DataFrame, row: str = "row") -> DataFrame:
    """(row, n_best, count_sum) for each row of ``aligned`` with links: how many of its links have the highest count of their B id, ties
    included, and the sum of the counts over its links. ``row`` is a long that tells rows apart; ``aligned`` is read three times."""
    own = aligned.select(F.col(row).alias("row"), "a", "b", "n")
    counts = cut(pair_counts(own))
    by_id = counts.groupBy(F.shiftright("key", 32).alias("b")).agg(F.sum("docs").alias("docs"))
    total = by_id.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    buckets = max(BUCKETS, total // BUCKET + 1)
    # ids of more postings than a bucket should have: no more than total / BUCKET, nor than B has ids
    hot = np.array(sorted((r.b, -(-r.docs // BUCKET)) for r in by_id.where(F.col("docs") > BUCKET).collect()), np.int64).reshape(-1, 2)

    def parts(b: np.ndarray) -> np.ndarray:
        if not len(hot):
            return np.ones(len(b), np.int64)
        at = np.minimum(np.searchsorted(hot[:, 0], b), len(hot) - 1)
        return np.where(hot[at, 0] == b, hot[at, 1], 1)

    def place(b: np.ndarray, part: np.ndarray) -> np.ndarray:
        """The bucket of an id's part: hot ids have buckets of their own."""
        return np.where(parts(b) > 1, buckets + (b << 20) + part, b * 2654435761 % (1 << 32) % buckets)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, key, n = _flat(batch)
            b = key >> 32
            yield _blobs(1, place(b, (r ^ r >> 33) % parts(b)), key, r, n.astype(np.int32))
            give_back()

    def deal_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n = (batch.column(k).to_numpy() for k in ("key", "n"))
            times = parts(key >> 32)
            part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            key, n = np.repeat(key, times), np.repeat(n, times)
            yield _blobs(0, place(key >> 32, part), key, 0 * key, n)

    def cogroup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, ready, got = None, None, []
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                if x["bucket"] != bucket:
                    bucket, ready, got = x["bucket"], None, []
                key = np.cumsum(_unpacked(x["key"], x["size"], "i8"))
                if x["kind"] == 0:
                    got.append((key, _unpacked(x["n"], x["size"], "i8")))
                    continue
                if ready is None:
                    keys, count = (np.concatenate(c) for c in zip(*got, strict=True))
                    order = np.argsort(keys)
                    keys, count = keys[order], count[order]
                    _, group = np.unique(keys >> 32, return_inverse=True)
                    most = np.zeros(group.max() + 1, np.int64)
                    np.maximum.at(most, group, count)
                    ready, got = (keys, count, count == most[group]), []
                at = np.searchsorted(ready[0], key)
                n = _unpacked(x["n"], x["size"], "i4").astype(np.int64)
                rows, inverse = np.unique(_unpacked(x["row"], x["size"], "i8"), return_inverse=True)
                best, sums = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
                np.add.at(best, inverse, n * ready[2][at])
                np.add.at(sums, inverse, n * ready[1][at])
                out.append((rows, best, sums))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["row", "n_best", "count_sum"])

    streams = own.mapInArrow(deal, _BLOB).unionByName(counts.select("key", "n").mapInArrow(deal_counts, _BLOB))
    met = streams.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(cogroup, "row bigint, n_best bigint, count_sum bigint")
    return met.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
