"""The integer feature vector of an image: mask blocks, LBP, block means, colour histogram, bias."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from mosaiq.functions import planes
from mosaiq.functions.lambdas import let
from mosaiq.operators import boards, morphology, stats
from mosaiq.plans import batches


def parse_ints(text: str | None) -> tuple[int, ...]:
    return tuple(int(x) for x in (text or "").split(",") if x.strip())


@dataclass(frozen=True)
class Featurizer:
    gray: tuple[int, ...] = (40, 60, 80, 100, 120, 140)
    gradient: int = 12
    red_green: tuple[int, ...] = (20, 50, 80)
    yellow_blue: tuple[int, ...] = (20, 50, 80)
    saturation: tuple[int, ...] = (30, 60, 90)
    blocks: int = 4
    bins: int = 4
    lbp_eps: int = 0
    lbp_flip_invariant: bool = False
    edges: bool = True
    gradients: bool = True
    markov: bool = True
    lbp: bool = True
    bias: bool = True
    ca_steps: int = 0
    ca_birth: tuple[int, int] = (5, 8)
    ca_survive: tuple[int, int] = (4, 8)
    ca_diagonal: bool = True

    def config(self) -> dict:
        return asdict(self)

    @property
    def block_size(self) -> int:
        return 1 + 8 + 8 + 64 + 16 + (16 if self.markov else 0)

    @property
    def n_masks(self) -> int:
        own = len(self.gray) * (2 if self.edges else 1) + (4 if self.gradients else 0)
        own += 2 * len(self.red_green) + 2 * len(self.yellow_blue) + len(self.saturation)
        return own * (1 + max(0, self.ca_steps))

    @property
    def size(self) -> int:
        return self.n_masks * self.block_size + (256 if self.lbp else 0) + 3 * self.blocks**2 + (self.bins**3 if self.bins > 1 else 1) + (1 if self.bias else 0)

    def with_planes(self, images: DataFrame) -> DataFrame:
        r, g, b = (F.col(c) for c in "rgb")
        return images.withColumns({"gray": planes.gray_u8(r, g, b), "rg": planes.opponent_rg(r, g), "yb": planes.opponent_yb2(r, g, b), "sat": planes.saturation(r, g, b)})

    def masks(self) -> list[tuple[str, Column]]:
        """(name, board) in the order of the vector, from the columns of ``with_planes``."""
        gray, out = F.col("gray"), []
        for t in self.gray:
            out.append((f"gray>={t}", boards.at_least(gray, t)))
            if self.edges:
                out.append((f"edge gray>={t}", morphology.edge(boards.at_least(gray, t))))
        if self.gradients:
            out += list(zip(("dx+", "dx-", "dy+", "dy-"), boards.gradients(gray, self.gradient), strict=True))
        for t in self.red_green:
            out += [(f"rg>={t}", boards.at_least(F.col("rg"), t)), (f"rg<=-{t}", boards.at_most(F.col("rg"), -t))]
        for t in self.yellow_blue:
            out += [(f"yb>={2 * t}", boards.at_least(F.col("yb"), 2 * t)), (f"yb<=-{2 * t}", boards.at_most(F.col("yb"), -2 * t))]
        return out + [(f"sat>={t}", boards.at_least(F.col("sat"), t)) for t in self.saturation]

    def bank(self) -> Column:
        """All boards of an image, each followed by its automaton's states, as an array of arrays."""
        rule = {"birth": self.ca_birth, "survive": self.ca_survive, "diagonal": self.ca_diagonal}
        seeds = F.array(*[m for _, m in self.masks()])
        if self.ca_steps <= 0:
            return seeds

        def states(m: Column) -> Column:
            # each state is bound before the next step reads it
            def more(have: Column, n: int) -> Column:
                return have if n == 0 else let(have, lambda h: more(F.concat(h, F.array(morphology.step(F.element_at(h, -1), **rule))), n - 1))

            return more(F.array(m), self.ca_steps)

        return F.flatten(F.transform(seeds, states))

    def block(self, board: Column) -> Column:
        parts = [stats.projections(board), stats.pattern_histogram(board)]
        return F.concat(*parts, *([stats.transition_histogram(board)] if self.markov else []))

    def features(self, images: DataFrame, name: str = "f") -> DataFrame:
        """``images`` without their planes and with the vector."""
        return batches.map_images(images, batches.vector_kernel(self), name, IntegerType())

    def declared(self, images: DataFrame, name: str = "f") -> DataFrame:
        """``features`` as column expressions only. Planes, then masks, then the vector are columns of
        their own, so that none is computed twice."""
        keep = [c for c in images.columns if c not in ("r", "g", "b")]
        r, g, b = (F.col(c) for c in "rgb")
        own = self.with_planes(images).withColumn("bank", self.bank())
        parts = [F.flatten(F.transform("bank", self.block))]
        if self.lbp:
            parts.append(stats.lbp_histogram(F.col("gray"), self.lbp_eps, self.lbp_flip_invariant))
        parts += [stats.block_means(r, g, b, self.blocks), stats.colour_histogram(r, g, b, self.bins)]
        if self.bias:
            parts.append(F.array(F.lit(1)))
        return own.select(*keep, F.concat(*[F.transform(p, lambda v: v.cast("int")) for p in parts]).alias(name))

    def invariant(self, images: DataFrame, how: str = "mean", name: str = "f") -> DataFrame:
        """Pools the vectors of the eight symmetries of each image, by position."""
        own = batches.vector_kernel(self)
        return batches.map_images(images, lambda r, g, b: batches.pooled(batches.orbit(own, r, g, b), how), name, IntegerType())

    def equivariant(self, images: DataFrame, name: str = "f") -> DataFrame:
        """The vectors of the eight symmetries one after the other."""
        own = batches.vector_kernel(self)
        return batches.map_images(images, lambda r, g, b: np.concatenate(list(batches.orbit(own, r, g, b)), axis=1), name, IntegerType())
