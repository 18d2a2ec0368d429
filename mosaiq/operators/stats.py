"""Histograms and projections of masks and planes, as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mosaiq.functions.lambdas import band, histogram, indexes, left, let, right, total
from mosaiq.functions.planes import SIDE
from mosaiq.operators.boards import INNER, unpack


def _long(x: int) -> Column:
    return F.lit(x).cast("bigint")


def count(board: Column) -> Column:
    return total(F.transform(board, lambda v: F.bit_count(v).cast("bigint")))


def grid(board: Column, n: int = 8) -> Column:
    """Counts of n by n cells, row by row."""
    k = SIDE // n
    cell = lambda m, j: total(F.transform(F.slice(m, F.floor(j / n).cast("int") * k + 1, k), lambda v: F.bit_count(right(v, (j % n) * k).bitwiseAND(_long((1 << k) - 1))).cast("bigint")))
    return let(board, lambda m: F.transform(indexes(n * n), lambda j: cell(m, j)))


def projections(board: Column, n: int = 8) -> Column:
    """The count, n row bands, n column bands, n by n cells: the roll-ups of one grid."""

    def up(g: Column) -> Column:
        rows = F.transform(indexes(n), lambda i: total(F.slice(g, i * n + 1, n)))
        cols = F.transform(indexes(n), lambda j: total(F.transform(indexes(n), lambda i: F.get(g, i * n + j))))
        return F.concat(F.array(total(g)), rows, cols, g)

    return let(grid(board, n), up)


def _as(v: Column, bit: Column) -> Column:
    """``v`` if bit is 1, else its complement."""
    return v.bitwiseXOR(bit - 1)


def _bit(code: Column, k: int) -> Column:
    return right(code, k).bitwiseAND(F.lit(1)).cast("bigint")


def pattern_histogram(board: Column) -> Column:
    """All 961 windows of 2 by 2 by code: upper left 1, upper right 2, lower left 4, lower right 8."""

    def one(m: Column, code: Column) -> Column:
        def windows(v: Column, w: Column) -> Column:
            hit = band(_as(v, _bit(code, 0)), _as(right(v, 1), _bit(code, 1)), _as(w, _bit(code, 2)), _as(right(w, 1), _bit(code, 3)), _long(INNER))
            return F.bit_count(hit).cast("bigint")

        return total(F.zip_with(F.slice(m, 1, SIDE - 1), F.slice(m, 2, SIDE - 1), windows))

    return let(board, lambda m: F.transform(indexes(16), lambda code: one(m, code)))


def transition_histogram(board: Column) -> Column:
    """Transitions to the E, S, SE and SW neighbour: for each the counts of (from, to) 00, 01, 10, 11."""
    full = (1 << SIDE) - 1

    def pairs(first: Column, second: Column, mask: int) -> Column:
        # the count of 00 is what the others leave
        return F.transform(indexes(4), lambda code: total(F.zip_with(first, second, lambda v, w: F.bit_count(band(_as(v, _bit(code, 1)), _as(w, _bit(code, 0)), _long(mask))).cast("bigint"))))

    def all_four(m: Column) -> Column:
        up, down = F.slice(m, 1, SIDE - 1), F.slice(m, 2, SIDE - 1)
        shifted = lambda a: F.transform(a, lambda v: right(v, 1))
        return F.concat(pairs(m, shifted(m), INNER), pairs(up, down, full), pairs(up, shifted(down), INNER), pairs(shifted(up), down, INNER))

    return let(board, all_four)


#: The neighbours E, NE, N, NW, W, SW, S, SE as offsets in a plane, for bits 0 to 7.
AROUND = (1, -31, -32, -33, -1, 31, 32, 33)


def lbp_codes(plane: Column, eps: int = 0) -> Column:
    """Local binary patterns of the 30 by 30 inner pixels: bit k is set if neighbour k is ``>= pixel + eps``."""

    def code(p: Column, j: Column) -> Column:
        i = (F.floor(j / 30) + 1) * SIDE + j % 30 + 1
        return let(i.cast("int"), lambda i: let(F.get(p, i), lambda c: sum((F.when(F.get(p, i + d) >= c + eps, 1 << k).otherwise(0) for k, d in enumerate(AROUND)), F.lit(0))))

    return let(plane, lambda p: F.transform(indexes(900), lambda j: code(p, j)))


def mirrored(code: Column) -> Column:
    """An LBP code seen in a mirror: bits 0 and 4, 1 and 3, 5 and 7 change places."""
    swaps = {0: 4, 1: 3, 2: 2, 3: 1, 4: 0, 5: 7, 6: 6, 7: 5}
    return sum((left(_bit(code, a).cast("int"), b) for a, b in swaps.items()), F.lit(0))


def lbp_histogram(plane: Column, eps: int = 0, flip_invariant: bool = False) -> Column:
    codes = lbp_codes(plane, eps)
    return histogram(F.transform(codes, lambda c: F.least(c, mirrored(c))) if flip_invariant else codes, 256)


def block_sums(r: Column, g: Column, b: Column, blocks: int = 4) -> Column:
    """Sums of blocks by blocks squares, by block row, block column, colour."""
    k = SIDE // blocks

    def one(p: Column, j: Column) -> Column:
        return total(F.transform(indexes(k), lambda y: total(F.transform(F.slice(p, ((F.floor(j / blocks) * k + y) * SIDE + (j % blocks) * k).cast("int") + 1, k), lambda v: v.cast("bigint")))))

    return let(F.array(r, g, b), lambda c: F.flatten(F.transform(indexes(blocks * blocks), lambda j: F.array(*[one(F.get(c, k), j) for k in range(3)]))))


def block_means(r: Column, g: Column, b: Column, blocks: int = 4) -> Column:
    """Means rounded half to even."""
    n = float((SIDE // blocks) ** 2)
    return F.transform(block_sums(r, g, b, blocks), lambda s: F.bround(s / F.lit(n)).cast("bigint"))


def colour_histogram(r: Column, g: Column, b: Column, bins: int = 4) -> Column:
    """Counts by (v * bins) >> 8 of each colour, red first; a single 0 for one bin or less."""
    if bins <= 1:
        return F.array(_long(0))
    low = lambda v: right(v * bins, 8)
    rg = F.zip_with(r, g, lambda x, y: low(x) * (bins * bins) + low(y) * bins)
    return histogram(F.zip_with(rg, b, lambda s, z: s + low(z)), bins**3)


# ---- the grammar's statistics: fractions in place of counts, other layouts


def _share(values: Column, n: float) -> Column:
    return F.transform(values, lambda v: (v.cast("double") / F.lit(n)).cast("float"))


def g_grid(values: Column, n: int = 8) -> Column:
    """Means of a plane (or of a mask as 0 and 1): all, row bands, column bands, cells."""
    k = SIDE // n

    def cells(p: Column) -> Column:
        return F.transform(indexes(n * n), lambda j: total(F.transform(indexes(k), lambda y: total(F.transform(F.slice(p, ((F.floor(j / n) * k + y) * SIDE + (j % n) * k).cast("int") + 1, k), lambda v: v.cast("double")), F.lit(0.0))), F.lit(0.0)))

    def up(g: Column) -> Column:
        rows = F.transform(indexes(n), lambda i: total(F.slice(g, i * n + 1, n), F.lit(0.0)))
        cols = F.transform(indexes(n), lambda j: total(F.transform(indexes(n), lambda i: F.get(g, i * n + j)), F.lit(0.0)))
        band_n = float(k * SIDE)
        return F.concat(_share(F.array(total(g, F.lit(0.0))), float(SIDE * SIDE)), _share(rows, band_n), _share(cols, band_n), _share(g, float(k * k)))

    return let(let(values, cells), up)


def g_grid_board(board: Column, n: int = 8) -> Column:
    k = SIDE // n
    size = lambda i: F.when(i == 0, float(SIDE * SIDE)).when(i <= 2 * n, float(k * SIDE)).otherwise(float(k * k))
    return F.transform(projections(board, n), lambda v, i: (v / size(i)).cast("float"))


def g_patterns(board: Column) -> Column:
    """The 256 windows of 2 by 2 that do not overlap, upper left 8 to lower right 1, as fractions."""

    def codes(b: Column) -> Column:
        at = lambda j, dy, dx: F.get(b, ((F.floor(j / 16) * 2 + dy) * SIDE + (j % 16) * 2 + dx).cast("int"))
        return F.transform(indexes(256), lambda j: 8 * at(j, 0, 0) + 4 * at(j, 0, 1) + 2 * at(j, 1, 0) + at(j, 1, 1))

    return _share(histogram(let(unpack(board), codes), 16), 256.0 + 1e-9)


def g_transitions(board: Column) -> Column:
    """Horizontal and vertical transitions together: 00, 01, 10, 11 as fractions of 1984."""
    return let(transition_histogram(board), lambda t: _share(F.transform(indexes(4), lambda k: F.get(t, k) + F.get(t, k + 4)), 1984.0 + 1e-9))


def g_moments(values: Column) -> Column:
    """Mean, standard deviation, skewness, excess kurtosis, of the population; 0 for the last two if all are equal."""

    def up(p: Column) -> Column:
        n = F.size(p)
        power = lambda m, k: total(F.transform(p, lambda v: F.pow(v.cast("double") - m, F.lit(k))), F.lit(0.0)) / n
        return let(total(F.transform(p, lambda v: v.cast("double")), F.lit(0.0)) / n, lambda m: let(F.array(power(m, 2), power(m, 3), power(m, 4)), lambda c: F.transform(F.array(m, F.sqrt(F.get(c, 0)), F.when(F.get(c, 0) > 0, F.get(c, 1) / F.pow(F.get(c, 0), F.lit(1.5))).otherwise(0.0), F.when(F.get(c, 0) > 0, F.get(c, 2) / (F.get(c, 0) * F.get(c, 0)) - 3).otherwise(0.0)), lambda v: v.cast("float"))))

    return let(values, up)


def g_lbp(r: Column, g: Column, b: Column, eps: int = 0) -> Column:
    """LBP fractions of the double-precision gray, cut to whole numbers."""
    from mosaiq.functions.planes import g_gray_double

    whole = F.transform(g_gray_double(r, g, b), lambda v: v.cast("int"))
    return _share(lbp_histogram(whole, eps), 900.0 + 1e-9)


def g_colours(r: Column, g: Column, b: Column, bins: int = 4) -> Column:
    return F.array(F.lit(1.0).cast("float")) if bins <= 1 else _share(colour_histogram(r, g, b, bins), 1024.0 + 1e-9)


def g_blocks(r: Column, g: Column, b: Column, blocks: int = 4) -> Column:
    n = float((SIDE // blocks) ** 2)
    return F.transform(block_sums(r, g, b, blocks), lambda s: ((s / F.lit(n)).cast("float") / F.lit(255.0).cast("float")).cast("float"))
