"""Periodic runs of words by the linear-time method of Ellert and Fischer.

Every run with the period p holds a Lyndon word of p words, in the order of the words or in the opposite one, that is the longest Lyndon
word which begins there: it reaches to the next smaller suffix. So for both orders the next smaller suffix of every word is found,
with how far the two suffixes agree, and a run is what agrees to both sides of such a pair.

Suffixes are compared word by word on the ordered alphabet; there are no suffix arrays, trees or hashes of windows. Suffixes that wait for
a smaller one stand on a stack, each with how far it agrees with the one below; so what a new suffix matched of one of them is known
of the next, and is only gone on with if both agree equally far. Matches that were made before are used again: where the text repeats
what was matched, the comparison's outcome is that of its image in the earlier part, and words are compared only beyond the furthest
match so far. So each word is compared a bounded number of times, whatever the text repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import give_back

#: Words of a slice of texts, about; words compared at once; matches shorter than SHORT are not worth remembering.
TOKENS, STEP, SHORT = 1 << 20, 64, 8

RUN = "struct<start:bigint,length:bigint,period:bigint>"


def lyndon_pairs(x: list[int], least: int, times: int) -> list[tuple[int, int, int]]:
    """(i, p, r) for the words i whose next smaller suffix is i + p if both agree in r words, by i + p; those only that can be the first of
    a run of ``least`` words and ``times`` periods: r > (times - 2) * p, as i is in the run's first period, and 2 * p + r > least.
    ``x``: ranks of 0 or more; a suffix that ends is smaller than one that goes on."""
    n = len(x)
    x = [*x, -1]
    stack, agree, out = [0] if n else [], [-1], []
    known: dict[tuple[int, int], int] = {}
    furthest = copy_from = shift = 0  # x[copy_from:furthest] is x[copy_from - shift:furthest - shift]
    for j in range(1, n):
        v = x[j]
        while stack and x[stack[-1]] > v:
            stack.pop()
            agree.pop()
        if not stack or x[stack[-1]] < v:
            agree.append(0 if stack else -1)
            stack.append(j)
            continue
        a = 1
        while True:
            top = stack[-1]
            if j < furthest and top >= copy_from:
                before = known.get((top - shift, j - shift))
                if before is not None:
                    a = max(a, min(before, furthest - j))
            while x[top + a] == x[j + a]:
                a += 1
                if a % STEP == 0:
                    while j + a + STEP <= n and x[top + a : top + a + STEP] == x[j + a : j + a + STEP]:
                        a += STEP
            if a >= SHORT:
                known[top, j] = a
                if j + a > furthest:
                    furthest, copy_from, shift = j + a, j, j - top
            if x[top + a] < x[j + a]:
                below = a
                break
            while True:  # top is larger: j ends its Lyndon word, and that of those below that agree with top for longer
                if a > (times - 2) * (j - top) and 2 * (j - top) + a > least:
                    out.append((top, j - top, a))
                stack.pop()
                below = agree.pop()
                if below <= a:
                    break
                top = stack[-1]
            if below < a:
                break  # the one below is smaller, as it is than top
        agree.append(below if stack else -1)
        stack.append(j)
    return out


def runs(x: list[int], top: int, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least ``least`` words and ``times`` (two or more) periods, by start and period. ``x``: ranks of
    0 to ``top``."""
    found: set[tuple[int, int, int]] = set()
    for order in (x, [top - v for v in x]):
        pairs = lyndon_pairs(order, least, times)
        seen = {(i, p) for i, p, r in pairs if r >= p}
        for i, p, r in pairs:
            if (i - p, p) in seen:
                continue  # another Lyndon word of the same run
            k = 0
            while k < i and x[i - 1 - k] == x[i - 1 - k + p]:
                k += 1
            if k + p + r >= max(least, times * p):
                found.add((i - k, k + p + r, p))
    return sorted(found, key=lambda f: (f[0], f[2]))


def dropped(found: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Of ``n`` words those that some run has after its first period."""
    out = np.zeros(n, bool)
    for start, length, period in found:
        out[start + period : start + length] = True
    return out


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Parts of ``texts`` of about ``TOKENS`` words, or one text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // (TOKENS * 6)
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield texts.slice(a, b - a)
    give_back()


def _of_slice(texts: pa.Array, least: int, times: int) -> tuple[pa.Array, pa.Array]:
    """The runs of each text, and the text without repeats."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))[full]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    codes = rank[coded.indices.to_numpy(zero_copy_only=False)] if len(order) else np.zeros(0, np.int64)
    ends = np.cumsum(np.bincount(owner, minlength=len(texts)))
    gone, found = np.zeros(len(codes), bool), []
    for k, end in enumerate(ends):
        start = int(ends[k - 1]) if k else 0
        own = runs(codes[start:end].tolist(), max(0, len(order) - 1), least, times) if end - start >= least else []
        if own:
            gone[start:end] = dropped(own, int(end) - start)
        found.append([{"start": s, "length": n, "period": p} for s, n, p in own])
    kept = pc.take(coded.dictionary, coded.indices.filter(pa.array(~gone)))
    left = np.concatenate([[0], np.cumsum(np.bincount(owner[~gone], minlength=len(texts)))])
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(left, pa.int64()), kept), pa.scalar(" ", pa.large_string()))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    return pa.array(found, kind), joined.cast(pa.string())


def collapse_runs(docs: DataFrame, text: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """``docs`` without ``text`` and with ``runs``, an array of (start, length, period) in words, by start and period, and ``collapsed``: the words
    but those that a run has after its first period, joined by one space.

    A run is a stretch of words with the smallest period q, of max(``least``, ``times`` * q) words or more, that no neighbouring
    word extends keeping q. Words are what ASCII white space separates. A null text counts as an empty one: no runs, an empty text.
    Repeated rows are treated each, nulls in other columns stay, an empty table gives an empty result; columns named ``runs`` or ``collapsed`` are
    overwritten. Each text is one row's work, so nothing is shuffled."""
    keep = [c for c in docs.columns if c not in (text, "runs", "collapsed")]
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("_none"))
    rows = docs.select(row.alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for part in _slices(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), *_of_slice(part, least, times)], ["row", "runs", "collapsed"])
                at += len(part)

    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, runs array<{RUN}>, collapsed string")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], "runs", "collapsed")
