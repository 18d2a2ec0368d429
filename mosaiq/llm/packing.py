"""Variable-capacity best-fit packing of token sequences into training sequences of several lengths.

A packed sequence never leaves its cell: a bounded number of documents of one input partition. So which bin a document is in
depends on the table's partitions; what a bin may hold, and that every token is in one, does not."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import WORD, give_back, words

LENGTHS = (512, 1024, 2048, 4096)
#: Documents packed together at most; bins do not span such cells.
CELL = 20_000


def cost(length: int, fixed: float = 64.0, square: float = 65536.0) -> float:
    """What a training sequence costs: its tokens, a fixed part, and a part that grows with the square."""
    return length + fixed + length * length / square


def _one_plan(sizes: list[int], order: list[int], lengths: tuple[int, ...], opened: tuple[int, ...]) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Best fit with bins of the lengths ``opened`` only: (bin, offset) for each size, what each bin holds, and the length it
    was opened with: of those that hold the size, the one of least cost for each token that can come into it."""
    room: list[tuple[int, int]] = []
    used: list[int] = []
    first: list[int] = []
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    left, costs = sum(sizes), {c: cost(c) for c in opened}
    for i in order:
        size = sizes[i]
        at = bisect_left(room, (size, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free = min((c for c in opened if c >= size), key=lambda c: (costs[c] / min(c, left), c))
            b = len(used)
            used.append(0)
            first.append(free)
        out[i] = (b, used[b])
        used[b] += size
        left -= size
        if free > size:
            insort(room, (free - size, b))
    return out, used, first


def least_cost_plan(sizes: list[int], lengths: tuple[int, ...]) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """(bin, offset) for each size, the length that each bin was opened with, and its length in the end. Each set of lengths
    that can hold the sizes gives a plan; in each, every bin shrinks to the least length that holds its contents, and
    the plan of least cost wins."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    best = None
    for k in range(len(lengths), 0, -1):
        for opened in combinations(lengths, k):
            if sizes and opened[-1] < sizes[order[0]]:
                continue
            out, used, first = _one_plan(sizes, order, lengths, opened)
            final = [lengths[bisect_left(lengths, u)] for u in used]
            total = sum(map(cost, final))
            if best is None or total < best[0]:
                best = total, out, first, final
    return best[1:] if best else ([], [], [])


def best_fit(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> list[tuple[int, int, int]]:
    """For each size (1 to the largest length): (bin, offset, capacity of the bin). Sizes go by falling
    length into the open bin with the least room that holds them; else a bin is opened. Which lengths bins are
    opened with is chosen for all bins together, and bins shrink at the end (``least_cost_plan``)."""
    out, _, final = least_cost_plan(sizes, tuple(sorted(lengths)))
    return [(b, at, final[b]) for b, at in out]


def _cells(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Batches joined up to ``rows`` rows."""
    held, n = [], 0
    for b in batches:
        for at in range(0, len(b), rows):
            part = b.iloc[at : at + rows]
            if n + len(part) > rows:
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
            held.append(part)
            n += len(part)
    if held:
        yield pd.concat(held, ignore_index=True)


def _packed(cell: pd.DataFrame, lengths: tuple[int, ...], first: int) -> pd.DataFrame:
    top = max(lengths)
    pieces = [(row, k, k * top, min(top, n - k * top)) for row, n in enumerate(cell["n_tokens"]) for k in range(-(-n // top))]
    places = best_fit([p[3] for p in pieces], lengths)
    out = pd.DataFrame(pieces, columns=["row", "piece", "start", "length"])
    out["bin"] = [first + b for b, _, _ in places]
    out["place"] = [at for _, at, _ in places]
    out["capacity"] = [c for _, _, c in places]
    return out


def pack_lengths(sized: DataFrame, lengths: tuple[int, ...] = LENGTHS, cell: int = CELL) -> DataFrame:
    """Packs ``sized`` (doc_id, n_tokens): doc_id, piece, start, length, bin, place, capacity. Sequences
    beyond the largest length are cut into pieces of it. Each input partition is packed by its own
    task in cells of bounded size, without a shuffle. Rows without tokens, or with null, take no place
    and do not appear; repeated ids are packed as rows of their own; no rows give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 40
        for c in _cells(batches, cell):
            out = _packed(c, lengths, first)
            first += int(out["bin"].max() - first + 1) if len(out) else 0
            yield pd.DataFrame({"doc_id": c["doc_id"].to_numpy()[out["row"]], **{k: out[k] for k in ("piece", "start", "length", "bin", "place", "capacity")}})

    kind = sized.schema["doc_id"].dataType.simpleString()
    have = sized.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens")).where("n_tokens > 0")
    nulls = have.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas has no null integers
    out = nulls.mapInPandas(run, "doc_id string, piece int, start long, length int, bin long, place int, capacity int")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def pack_documents(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``pack_lengths`` of whole texts; a token is a word, and one more ends each text (null: none)."""
    return pack_lengths(docs.select(F.col(doc_id).alias("doc_id"), (F.size(words(text)) + 1).alias("n_tokens")), lengths)


def pack_texts(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, cell: int = 2_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``pack_documents``, and with ``text``, what each piece holds: the pieces of a document, in
    order, are its text to the last character. A null text gives an empty piece."""

    def cut_at(body: str, starts: list[int]) -> list[str]:
        at = [m.start() for m in re.finditer(WORD, body)] + [len(body)]
        ends = [0, *[at[min(s, len(at) - 1)] for s in starts[1:]], len(body)]
        return [body[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        for b in batches:
            for start in range(0, b.num_rows, cell):
                ids, texts = (b.column(i).slice(start, cell) for i in (0, 1))
                out = _packed(pd.DataFrame({"n_tokens": pc.count_substring_regex(texts, pattern=WORD).to_numpy(zero_copy_only=False).astype(np.int64) + 1}), lengths, first)
                first += int(out["bin"].max() - first + 1)
                row = out["row"].to_numpy(np.int64)
                held = np.isin(row, row[out["piece"].to_numpy() > 0])  # of several pieces; the others are whole texts
                pieces = texts.take(pa.array(row, mask=held))
                if held.any():
                    cuts = {(r, k): x for r, starts in out[held].groupby("row")["start"] for k, x in enumerate(cut_at(texts[r].as_py(), list(starts)))}
                    pieces = pc.replace_with_mask(pieces, pa.array(held), pa.array([cuts[r, k] for r, k in zip(row[held], out["piece"].to_numpy()[held], strict=True)], pieces.type))
                columns = [pa.array(out[k].to_numpy(), t) for k, t in (("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("bin", pa.int64()), ("place", pa.int32()), ("capacity", pa.int32()))]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), *columns, pieces], ["doc_id", "piece", "start", "length", "bin", "place", "capacity", "text"])
            give_back()

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length int, bin long, place int, capacity int, text string")
