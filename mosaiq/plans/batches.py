"""Feature kernels over batches of images: whole-array NumPy on (images, 32, 32), inside ``mapInArrow`` tasks.

The same features as column expressions are in ``operators``; Spark interprets those pixel by pixel, so the long vectors are
made here. Spark partitions the work, no row meets another, and a task holds some images at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DataType, StructField, StructType

from mosaiq.functions.planes import SIDE
from mosaiq.operators.stats import AROUND
from mosaiq.operators.symmetry import ELEMENTS, source_index

#: Images handled at once.
AT_ONCE = 64


def map_images(images: DataFrame, kernel: Callable[..., np.ndarray], name: str, element: DataType) -> DataFrame:
    """``images`` without r, g and b and with ``name``, an array: what ``kernel(r, g, b)`` gives for each image."""
    keep = [c for c in images.columns if c not in ("r", "g", "b")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, AT_ONCE):
                part = b.slice(start, AT_ONCE)
                own = kernel(*[part.column(c).flatten().to_numpy().reshape(-1, SIDE, SIDE) for c in ("r", "g", "b")])
                ends = pa.array(np.arange(0, own.size + 1, own.shape[1]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.ListArray.from_arrays(ends, pa.array(own.ravel()))], [*keep, name])

    return images.mapInArrow(run, StructType([*[images.schema[c] for c in keep], StructField(name, ArrayType(element))]))


@cache
def _sources(element: int) -> np.ndarray:
    return np.array([source_index(element, i) for i in range(SIDE * SIDE)])


def moved(plane: np.ndarray, element: int) -> np.ndarray:
    """One of the eight symmetries, as ``symmetry.moved``."""
    return plane.reshape(len(plane), -1)[:, _sources(element)].reshape(plane.shape)


def orbit(kernel: Callable[..., np.ndarray], r: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(symmetry, image, position)"""
    return np.stack([kernel(*(moved(p, e) for p in (r, g, b))) for e in range(len(ELEMENTS))])


def pooled(vectors: np.ndarray, how: str) -> np.ndarray:
    """Over the first axis; halves are rounded to even."""
    if how not in ("mean", "max", "median"):
        raise ValueError(f"unknown pooling {how!r}: mean, max or median")
    return vectors.max(axis=0) if how == "max" else np.rint(getattr(np, how)(vectors, axis=0)).astype(vectors.dtype)


def histograms(codes: np.ndarray, n: int) -> np.ndarray:
    """How often each of 0 to n - 1 is among the last axis."""
    rows = codes.reshape(-1, codes.shape[-1]).astype(np.int64)
    counts = np.bincount((rows + n * np.arange(len(rows))[:, None]).ravel(), minlength=n * len(rows))
    return counts.reshape(*codes.shape[:-1], n)


def _flat(a: np.ndarray) -> np.ndarray:
    return a.reshape(*a.shape[:-2], -1)


def around(m: np.ndarray, pad: int = 0) -> list[np.ndarray]:
    """What lies left, right, above, below, and then at the corners, of each pixel."""
    wide = np.pad(m, [(0, 0)] * (m.ndim - 2) + [(1, 1), (1, 1)], constant_values=pad)
    at = lambda dy, dx: wide[..., 1 + dy : 1 + dy + SIDE, 1 + dx : 1 + dx + SIDE]
    return [at(0, -1), at(0, 1), at(-1, 0), at(1, 0), at(-1, -1), at(-1, 1), at(1, -1), at(1, 1)]


def edge(m: np.ndarray) -> np.ndarray:
    out, low = m.copy(), m.copy()
    for near, shut in zip(around(m)[:4], around(m, 1)[:4], strict=True):
        out |= near
        low &= shut
    return out ^ low


def step(m: np.ndarray, birth: tuple[int, int], survive: tuple[int, int], diagonal: bool = True) -> np.ndarray:
    n = sum(a.astype(np.int8) for a in around(m)[: 8 if diagonal else 4])
    return np.where(m > 0, (n >= survive[0]) & (n <= survive[1]), (n >= birth[0]) & (n <= birth[1])).astype(m.dtype)


def grids(values: np.ndarray, n: int = 8) -> np.ndarray:
    """Sums of all, of n row bands, of n column bands, of n by n cells."""
    k = SIDE // n
    cells = values.reshape(*values.shape[:-2], n, k, n, k).sum(axis=(-3, -1))
    return np.concatenate([cells.sum(axis=(-2, -1))[..., None], cells.sum(axis=-1), cells.sum(axis=-2), _flat(cells)], axis=-1)


def transitions(m: np.ndarray) -> np.ndarray:
    pairs = ((m[..., :-1], m[..., 1:]), (m[..., :-1, :], m[..., 1:, :]), (m[..., :-1, :-1], m[..., 1:, 1:]), (m[..., :-1, 1:], m[..., 1:, :-1]))
    return np.concatenate([histograms(_flat(2 * a + b), 4) for a, b in pairs], axis=-1)


def patterns(m: np.ndarray) -> np.ndarray:
    return histograms(_flat(m[..., :-1, :-1] + 2 * m[..., :-1, 1:] + 4 * m[..., 1:, :-1] + 8 * m[..., 1:, 1:]), 16)


def lbp(plane: np.ndarray, eps: int = 0, flip_invariant: bool = False) -> np.ndarray:
    """Counts of the local binary patterns of the inner pixels, as ``stats.lbp_histogram``."""
    inner, code = plane[:, 1:-1, 1:-1], np.zeros((len(plane), SIDE - 2, SIDE - 2), np.int64)
    for k, d in enumerate(AROUND):
        dy, dx = divmod(d + 1, SIDE)
        dx -= 1
        code |= (plane[:, 1 + dy : SIDE - 1 + dy, 1 + dx : SIDE - 1 + dx] >= inner + eps).astype(np.int64) << k
    if flip_invariant:
        turned = sum(((code >> a) & 1) << b for a, b in ((0, 4), (1, 3), (2, 2), (3, 1), (4, 0), (5, 7), (6, 6), (7, 5)))
        code = np.minimum(code, turned)
    return histograms(_flat(code), 256)


def block_sums(r: np.ndarray, g: np.ndarray, b: np.ndarray, blocks: int) -> np.ndarray:
    k = SIDE // blocks
    return np.stack([p.reshape(-1, blocks, k, blocks, k).sum(axis=(2, 4)) for p in (r, g, b)], axis=-1).reshape(len(r), -1)


def colours(r: np.ndarray, g: np.ndarray, b: np.ndarray, bins: int) -> np.ndarray:
    if bins <= 1:
        return np.zeros((len(r), 1), np.int64)
    low = lambda p: (p.astype(np.int64) * bins) >> 8
    return histograms(_flat((low(r) * bins + low(g)) * bins + low(b)), bins**3)


def gray_of(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (77 * r + 150 * g + 29 * b) >> 8


def bank_of(f, r: np.ndarray, g: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """The masks of a ``Featurizer`` in the order of its vector, each followed by its automaton's states."""

    def masks() -> Iterator[np.ndarray]:
        gray = gray_of(r, g, b)
        for t in f.gray:
            yield gray >= t
            if f.edges:
                yield edge(gray >= t)
        if f.gradients:
            dx, dy = np.zeros_like(gray), np.zeros_like(gray)
            dx[:, :, :-1], dy[:, :-1] = np.diff(gray, axis=2), np.diff(gray, axis=1)
            yield from (dx > f.gradient, dx < -f.gradient, dy > f.gradient, dy < -f.gradient)
        for plane, limits, by in ((r - g, f.red_green, 1), (2 * b - r - g, f.yellow_blue, 2)):
            for t in limits:
                yield from (plane >= by * t, plane <= -by * t)
        spread = np.maximum(np.maximum(r, g), b) - np.minimum(np.minimum(r, g), b)
        for t in f.saturation:
            yield spread >= t

    out = []
    for m in masks():
        out.append(m.astype(np.uint8))
        for _ in range(f.ca_steps):
            out.append(step(out[-1], f.ca_birth, f.ca_survive, f.ca_diagonal))
    return out


def count_kernel(f) -> Callable[..., np.ndarray]:
    """How many pixels each mask of a ``Featurizer`` has."""
    return lambda *planes: np.stack([m.sum(axis=(1, 2), dtype=np.int64) for m in bank_of(f, *(p.astype(np.int32) for p in planes))], axis=1)


def orbit_grid_kernel(t: int) -> Callable[..., np.ndarray]:
    """The 8 by 8 cells of the mask gray >= t, for all eight symmetries one after the other."""

    def run(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
        m = (gray_of(*(p.astype(np.int32) for p in (r, g, b))) >= t).astype(np.int32)
        return np.concatenate([grids(moved(m, e))[:, 17:] for e in range(len(ELEMENTS))], axis=1)

    return run


def lbp_kernel(eps: int = 0, flip_invariant: bool = False) -> Callable[..., np.ndarray]:
    return lambda *planes: lbp(gray_of(*(p.astype(np.int32) for p in planes)), eps, flip_invariant)


def vector_kernel(f) -> Callable[..., np.ndarray]:
    """The kernel of a ``Featurizer``: its whole vector for each image."""

    def run(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
        r, g, b = (p.astype(np.int32) for p in (r, g, b))
        gray, bank = gray_of(r, g, b), bank_of(f, r, g, b)
        parts = []
        if bank:
            own = np.stack(bank, axis=1)
            blocks = [grids(own.astype(np.int32)), patterns(own), *([transitions(own)] if f.markov else [])]
            parts.append(np.concatenate(blocks, axis=-1).reshape(len(r), -1))
        if f.lbp:
            parts.append(lbp(gray, f.lbp_eps, f.lbp_flip_invariant))
        parts += [np.rint(block_sums(r, g, b, f.blocks) / (SIDE // f.blocks) ** 2).astype(np.int64), colours(r, g, b, f.bins)]
        if f.bias:
            parts.append(np.ones((len(r), 1), np.int64))
        return np.concatenate(parts, axis=1).astype(np.int32)

    return run
