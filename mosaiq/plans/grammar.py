"""A small typed language of image features. Programs are frozen trees; they compile to columns.

Types: image, plane (single precision), mask (a bitboard), vector. Planes and masks that several programs
use become columns of their own, so each is computed once for an image."""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from mosaiq.functions import planes
from mosaiq.functions.planes import SIDE
from mosaiq.operators import boards, morphology, stats
from mosaiq.plans import batches


@dataclass(frozen=True)
class Node:
    pass


@dataclass(frozen=True)
class Img(Node):
    pass


@dataclass(frozen=True)
class R(Node):
    of: Node = Img()


@dataclass(frozen=True)
class G(Node):
    of: Node = Img()


@dataclass(frozen=True)
class B(Node):
    of: Node = Img()


@dataclass(frozen=True)
class Gray(Node):
    of: Node = Img()


@dataclass(frozen=True)
class OppRG(Node):
    of: Node = Img()


@dataclass(frozen=True)
class OppYB(Node):
    of: Node = Img()


@dataclass(frozen=True)
class Sat(Node):
    of: Node = Img()


@dataclass(frozen=True)
class Threshold(Node):
    of: Node
    t: float


@dataclass(frozen=True)
class Edge(Node):
    of: Node


@dataclass(frozen=True)
class CA(Node):
    of: Node
    steps: int
    rule: str = "life"


@dataclass(frozen=True)
class GridStats(Node):
    of: Node
    grid_n: int = 8


@dataclass(frozen=True)
class Pat2x2(Node):
    of: Node


@dataclass(frozen=True)
class Markov4(Node):
    of: Node


@dataclass(frozen=True)
class Moments(Node):
    of: Node


@dataclass(frozen=True)
class LBP(Node):
    of: Node = Img()
    eps: int = 0


@dataclass(frozen=True)
class RGBHist(Node):
    of: Node = Img()
    bins: int = 4


@dataclass(frozen=True)
class RGBBlocks(Node):
    of: Node = Img()
    blocks: int = 4


@dataclass(frozen=True)
class Concat(Node):
    left: Node
    right: Node


CHANNELS = (R, G, B, Gray, OppRG, OppYB, Sat)
MASKS = (Threshold, Edge, CA)


def kind(node: Node) -> str:
    if isinstance(node, Img):
        return "image"
    return "plane" if isinstance(node, CHANNELS) else "mask" if isinstance(node, MASKS) else "vector"


def check(node: Node) -> None:
    """Raises a TypeError where a node's input has the wrong type."""
    need = {Threshold: ("plane",), Edge: ("plane",), CA: ("mask",), GridStats: ("plane", "mask"), Pat2x2: ("plane", "mask"), Markov4: ("plane", "mask"), Moments: ("plane", "mask"), Concat: ("vector",)}
    for f in fields(node):
        child = getattr(node, f.name)
        if isinstance(child, Node):
            if type(node) in need and kind(child) not in need[type(node)]:
                raise TypeError(f"{type(node).__name__} can't be applied to the {kind(child)} {child}")
            check(child)


def size(node: Node) -> int:
    if isinstance(node, GridStats):
        return 1 + 2 * node.grid_n + node.grid_n**2
    if isinstance(node, Concat):
        return size(node.left) + size(node.right)
    if isinstance(node, RGBHist):
        return node.bins**3 if node.bins > 1 else 1
    if isinstance(node, RGBBlocks):
        return 3 * node.blocks**2
    return {Pat2x2: 16, Markov4: 4, Moments: 4, LBP: 256}[type(node)]


class Compiler:
    """Compiles programs over the columns r, g and b. ``shared``: the columns of planes and masks by node."""

    def __init__(self) -> None:
        self.shared: dict[Node, str] = {}

    def need(self, node: Node) -> None:
        """Notes the planes and masks below ``node``, inputs before what uses them."""
        for f in fields(node):
            child = getattr(node, f.name)
            if isinstance(child, Node):
                self.need(child)
        if kind(node) in ("plane", "mask") and node not in self.shared:
            self.shared[node] = f"_n{len(self.shared)}"

    def column(self, node: Node) -> Column:
        r, g, b = (F.col(c) for c in "rgb")
        if node in self.shared:
            return F.col(self.shared[node])
        return self.build(node, r, g, b)

    def build(self, node: Node, r: Column, g: Column, b: Column) -> Column:
        match node:
            case R():
                return planes.g_plane(r)
            case G():
                return planes.g_plane(g)
            case B():
                return planes.g_plane(b)
            case Gray():
                return planes.g_gray(r, g, b)
            case OppRG():
                return planes.g_opponent_rg(r, g)
            case OppYB():
                return planes.g_opponent_yb(r, g, b)
            case Sat():
                return planes.g_saturation(r, g, b)
            case Threshold(of, t):
                return boards.above(self.column(of), t)
            case Edge(of):
                return boards.sobel(self.column(of), exact=isinstance(of, R | G | B | OppRG))
            case CA(of, steps, rule):
                return morphology.automaton(self.column(of), steps, rule)
            case GridStats(of, n):
                return stats.g_grid_board(self.column(of), n) if kind(of) == "mask" else stats.g_grid(self.column(of), n)
            case Pat2x2(of):
                return stats.g_patterns(self._mask(of))
            case Markov4(of):
                return stats.g_transitions(self._mask(of))
            case Moments(of):
                return stats.g_moments(boards.unpack(self.column(of)) if kind(of) == "mask" else self.column(of))
            case LBP(_, eps):
                return stats.g_lbp(r, g, b, eps)
            case RGBHist(_, bins):
                return stats.g_colours(r, g, b, bins)
            case RGBBlocks(_, blocks):
                return stats.g_blocks(r, g, b, blocks)
            case Concat(left, right):
                return F.concat(self.column(left), self.column(right))
        raise ValueError(f"unknown node {node!r}")

    def _mask(self, node: Node) -> Column:
        """A plane counts as set above one half."""
        return self.column(node) if kind(node) == "mask" else boards.above(self.column(node), 0.5)


def declared(images: DataFrame, programs: list[Node], name: str = "f") -> DataFrame:
    """``evaluate`` as column expressions only: for some programs; the plan of very many takes long to make."""
    for p in programs:
        check(p)
    own, keep = Compiler(), [c for c in images.columns if c not in ("r", "g", "b")]
    for p in programs:
        own.need(p)
    r, g, b = (F.col(c) for c in "rgb")
    out = images
    for which in ("plane", "mask"):
        level = {own.shared[n]: n for n in own.shared if kind(n) == which}
        while level:
            ready = {c: n for c, n in level.items() if all(own.shared.get(getattr(n, f.name)) not in level for f in fields(n) if isinstance(getattr(n, f.name), Node))}
            out = out.withColumns({c: own.build(n, r, g, b) for c, n in ready.items()})
            level = {c: n for c, n in level.items() if c not in ready}
    return out.select(*keep, F.concat(*[own.column(p) for p in programs]).alias(name))


class Batch:
    """The value of each node for a batch of images; planes and masks that several programs use are made once."""

    def __init__(self, r: np.ndarray, g: np.ndarray, b: np.ndarray) -> None:
        self.rgb = tuple(p.astype(np.int32) for p in (r, g, b))
        self.known: dict[Node, np.ndarray] = {}

    def __getitem__(self, node: Node) -> np.ndarray:
        if kind(node) not in ("plane", "mask"):
            return self.vector(node)
        if node not in self.known:
            self.known[node] = self.plane(node) if kind(node) == "plane" else self.mask(node)
        return self.known[node]

    def plane(self, node: Node) -> np.ndarray:
        r, g, b = self.rgb
        f = np.float32
        match node:
            case R():
                return r.astype(f)
            case G():
                return g.astype(f)
            case B():
                return b.astype(f)
            case Gray():
                return f(0.299) * r.astype(f) + f(0.587) * g.astype(f) + f(0.114) * b.astype(f)
            case OppRG():
                return (r - g).astype(f)
            case OppYB():
                return ((r + g) / 2).astype(f) - b.astype(f)
            case Sat():
                high, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
                return np.where(high > 0, (high - low).astype(f) / (high.astype(f) + f(1e-9)), f(0))
        raise ValueError(f"unknown node {node!r}")

    def mask(self, node: Node) -> np.ndarray:
        match node:
            case Threshold(of, t):
                return (self[of] > np.float32(t)).astype(np.uint8)
            case Edge(of):
                left, right, up, down, ul, ur, dl, dr = batches.around(self[of])
                gx, gy = (ur - ul) + 2 * (right - left) + (dr - dl), (dl - ul) + 2 * (down - up) + (dr - ur)
                square = gx * gx + gy * gy
                return (square > 2500 if isinstance(of, R | G | B | OppRG) else np.sqrt(square.astype(np.float64)).astype(np.float32) > 50).astype(np.uint8)
            case CA(of, steps, rule):
                if rule not in morphology.RULES:
                    raise ValueError(f"unknown rule {rule!r}; known: {', '.join(morphology.RULES)}")
                every = lambda m, join: join.reduce([m, *batches.around(m)])
                erode, dilate = (lambda m: every(m, np.bitwise_and)), (lambda m: every(m, np.bitwise_or))
                turns = {"life": [lambda m: batches.step(m, (3, 3), (2, 3))] * steps, "erosion": [erode] * steps, "dilation": [dilate] * steps, "opening": [erode] * steps + [dilate] * steps, "closing": [dilate] * steps + [erode] * steps}
                out = self[of]
                for turn in turns[rule]:
                    out = turn(out)
                return out
        raise ValueError(f"unknown node {node!r}")

    def bits(self, node: Node) -> np.ndarray:
        """A plane counts as set above one half."""
        return self[node] if kind(node) == "mask" else (self[node] > 0.5).astype(np.uint8)

    def vector(self, node: Node) -> np.ndarray:
        r, g, b = self.rgb
        match node:
            case GridStats(of, n):
                k = SIDE // n
                return batches.grids(self[of].astype(np.float64), n) / np.repeat([SIDE * SIDE, k * SIDE, k * k], [1, 2 * n, n * n])
            case Pat2x2(of):
                m = self.bits(of)
                codes = 8 * m[:, ::2, ::2] + 4 * m[:, ::2, 1::2] + 2 * m[:, 1::2, ::2] + m[:, 1::2, 1::2]
                return batches.histograms(codes.reshape(len(m), -1), 16) / (256 + 1e-9)
            case Markov4(of):
                t = batches.transitions(self.bits(of))
                return (t[:, :4] + t[:, 4:8]) / (1984 + 1e-9)
            case Moments(of):
                v = self[of].reshape(len(r), -1).astype(np.float64)
                mean = v.mean(axis=1, keepdims=True)
                two, three, four = (((v - mean) ** k).mean(axis=1) for k in (2, 3, 4))
                safe = np.where(two > 0, two, 1)
                return np.stack([mean[:, 0], np.sqrt(two), np.where(two > 0, three / safe**1.5, 0), np.where(two > 0, four / safe**2 - 3, 0)], axis=1)
            case LBP(_, eps):
                return batches.lbp((0.299 * r + 0.587 * g + 0.114 * b).astype(np.float32).astype(np.int32), eps) / (900 + 1e-9)
            case RGBHist(_, bins):
                return batches.colours(r, g, b, bins) / (1024 + 1e-9) if bins > 1 else np.ones((len(r), 1))
            case RGBBlocks(_, blocks):
                return (batches.block_sums(r, g, b, blocks) / (SIDE // blocks) ** 2).astype(np.float32) / np.float32(255)
            case Concat(left, right):
                return np.concatenate([self[left], self[right]], axis=1)
        raise ValueError(f"unknown node {node!r}")


def evaluate(images: DataFrame, programs: list[Node], name: str = "f") -> DataFrame:
    """``images`` without their planes and with the vectors of all programs, one after the other."""
    for p in programs:
        check(p)

    def kernel(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
        own = Batch(r, g, b)
        return np.concatenate([own[p] for p in programs], axis=1).astype(np.float32)

    return batches.map_images(images, kernel, name, FloatType())


# The order and the thresholds of both lists decide what each position of their vectors means.


def first_programs() -> list[Node]:
    """41 programs, 2,509 values."""
    gray = Threshold(Gray(), 120)
    grids = [Threshold(c(), t) for c in (R, G, B) for t in (80, 120)]
    grids += [Threshold(Gray(), t) for t in (60, 100, 140, 180)]
    grids += [Threshold(c(), t) for c in (OppRG, OppYB) for t in (80, 120)]
    grids += [Threshold(Sat(), t * 255) for t in (0.3, 0.5)]
    five = [gray, Threshold(OppRG(), 100), *[Threshold(c(), 120) for c in (R, G, B)]]
    out: list[Node] = [GridStats(m) for m in grids] + [Pat2x2(m) for m in five]
    out += [GridStats(CA(gray, n, rule)) for n, rule in ((1, "life"), (2, "life"), (1, "erosion"), (1, "dilation"), (1, "opening"), (1, "closing"))]
    out += [GridStats(CA(Threshold(c(), 120), 1, "erosion")) for c in (R, G, B)]
    out += [Markov4(m) for m in five] + [Moments(m) for m in five[:2]]
    out.append(Concat(GridStats(gray), Markov4(gray)))
    return out + [Concat(GridStats(Threshold(c(), 120)), Pat2x2(Threshold(c(), 120))) for c in (R, G, B)]


def second_programs() -> list[Node]:
    """171 programs, 4,778 values: every channel by threshold, edge and plain, by statistic; LBP and colours."""
    inputs: list[Node] = [Threshold(c(), t) for c in CHANNELS for t in (60, 100, 140, 180)]
    inputs += [Edge(c()) for c in CHANNELS] + [c() for c in CHANNELS]
    return [s(x) for x in inputs for s in (GridStats, Pat2x2, Markov4, Moments)] + [LBP(Gray()), RGBHist(), RGBBlocks()]
