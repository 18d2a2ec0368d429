"""Queries of the image engine by name, each with its SQL on the long form of the same images.

Spark works on arrays and bitboards; the SQL works on one row for each pixel. Results that are vectors are
returned as rows (img_id, pos, v)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from mosaiq.functions import planes, tables
from mosaiq.functions.lambdas import indexes, left, total
from mosaiq.operators import boards, boosting, cayley, forms, learn, morphology, neighbours, scaling, stats, symmetry, tableau
from mosaiq.plans import batches, grammar, passes
from mosaiq.plans.featurizer import Featurizer
from mosaiq.sources.images import derived_images

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

def rgb() -> tuple[Column, ...]:
    return tuple(F.col(c) for c in "rgb")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---- the long form in SQL


def _colour(c: int) -> str:
    return f"least(255, greatest(0, CAST(floor(128 + 400 * CAST(e.embedding[1 + (8 * (y // 4) + (x // 4) + 21 * {c}) % 64] AS DOUBLE)) AS BIGINT) + ((e.vec_id * 17 + y * 7 + x * 13 + {c} * 29) % 41) - 20))"


PX = f"""px0 AS MATERIALIZED (SELECT e.vec_id AS img_id, e.label, y, x, {_colour(0)} AS r, {_colour(1)} AS g, {_colour(2)} AS b
FROM embeddings e, (SELECT unnest(range(32)) AS y), (SELECT unnest(range(32)) AS x)),
px AS MATERIALIZED (SELECT *, (77*r + 150*g + 29*b) >> 8 AS gray, r - g AS rg, 2*b - r - g AS yb, greatest(r,g,b) - least(r,g,b) AS sat,
CAST(0.299 AS FLOAT)*CAST(r AS FLOAT) + CAST(0.587 AS FLOAT)*CAST(g AS FLOAT) + CAST(0.114 AS FLOAT)*CAST(b AS FLOAT) AS fgray,
CAST((r + g) / 2.0 AS FLOAT) - CAST(b AS FLOAT) AS fyb,
CASE WHEN greatest(r,g,b) > 0 THEN CAST(greatest(r,g,b) - least(r,g,b) AS FLOAT) / (CAST(greatest(r,g,b) AS FLOAT) + CAST(1e-9 AS FLOAT)) ELSE 0 END AS fsat FROM px0),
img AS (SELECT vec_id AS img_id, label FROM embeddings)"""
ROW, COL = "(PARTITION BY img_id, y ORDER BY x)", "(PARTITION BY img_id, x ORDER BY y)"


def mask(test: str, name: str = "m") -> str:
    return f"{name} AS MATERIALIZED (SELECT img_id, label, y, x, CASE WHEN {test} THEN 1 ELSE 0 END AS v FROM px)"


def near(source: str, name: str) -> str:
    """The mask with the number n8 of its set neighbours, n4 of those at its sides, and the least of the sides."""
    return f"""{name}_h AS (SELECT *, coalesce(lag(v) OVER {ROW}, 0) AS l, coalesce(lead(v) OVER {ROW}, 0) AS r, coalesce(lag(v) OVER {COL}, 0) AS u, coalesce(lead(v) OVER {COL}, 0) AS d,
least(coalesce(lag(v) OVER {ROW}, 1), coalesce(lead(v) OVER {ROW}, 1), coalesce(lag(v) OVER {COL}, 1), coalesce(lead(v) OVER {COL}, 1)) AS low FROM {source}),
{name} AS MATERIALIZED (SELECT img_id, label, y, x, v, low, l + r + u + d AS n4, l + r + u + d + coalesce(lag(l + r) OVER {COL}, 0) + coalesce(lead(l + r) OVER {COL}, 0) AS n8 FROM {name}_h)"""


def after(source: str, rule: str, name: str) -> str:
    """The mask after a rule over v, n4, n8 and low of ``near``."""
    return near(source, f"{name}_n") + f",\n{name} AS MATERIALIZED (SELECT img_id, label, y, x, CASE WHEN {rule} THEN 1 ELSE 0 END AS v FROM {name}_n)"


def with_(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join([PX, *parts]) + "\n" + select


def counts_of(name: str) -> str:
    return f"SELECT img_id, CAST(sum(v) AS BIGINT) AS n FROM {name} GROUP BY img_id"


def dense(codes: str, n: int, value: str = "coalesce(c.n, 0)") -> str:
    """(img_id, pos, v) for pos 0 to n - 1 from a table of (img_id, code) rows."""
    return f"""SELECT i.img_id, CAST(k.pos AS INTEGER) AS pos, {value} AS v FROM img i CROSS JOIN (SELECT unnest(range({n})) AS pos) k
LEFT JOIN (SELECT img_id, code, CAST(count(*) AS BIGINT) AS n FROM ({codes}) GROUP BY img_id, code) c ON c.img_id = i.img_id AND c.code = k.pos"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_images(spark, sf_dir)


def long(rows: DataFrame, values: Column, kind: str = "bigint") -> DataFrame:
    out = rows.select("img_id", F.posexplode(values).alias("pos", "v"))
    return out.select("img_id", "pos", F.round(F.col("v").cast("double"), 5).alias("v") if kind == "double" else F.col("v").cast(kind).alias("v"))


def gray100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img_id, label, m): the mask that most queries look at."""
    own = images(spark, sf_dir).withColumn("gray", planes.gray_u8(*rgb()))
    return own.select("img_id", "label", "split", boards.at_least(F.col("gray"), 100).alias("m"))


M100 = mask("gray >= 100")

# ---- planes


@query("gray_mean_by_label", with_(M100, select="SELECT label, CAST(count(*) AS BIGINT) AS images, CAST(sum(n) AS BIGINT) AS pixels FROM (SELECT img_id, label, sum(v) AS n FROM m GROUP BY img_id, label) GROUP BY label"))
def gray_mean_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set pixels of the mask gray >= 100 by label: the flagship, from image to aggregate."""
    own = gray100(spark, sf_dir).select("label", stats.count(F.col("m")).alias("n"))
    return own.groupBy("label").agg(F.count(F.lit(1)).alias("images"), F.sum("n").alias("pixels"))


def _sums(name: str, sql: str, **columns: Callable[..., Column]):
    @query(name, with_(select=f"SELECT img_id, {sql} FROM px GROUP BY img_id"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = images(spark, sf_dir)
        return own.select("img_id", *[total(F.transform(p(*rgb()), lambda v: v.cast("bigint"))).alias(k) for k, p in columns.items()])


_sums("gray_plane_sum", "CAST(sum(gray) AS BIGINT) AS gray", gray=planes.gray_u8)
_sums("opponent_sums", "CAST(sum(rg) AS BIGINT) AS rg, CAST(sum(yb) AS BIGINT) AS yb", rg=lambda r, g, b: planes.opponent_rg(r, g), yb=planes.opponent_yb2)
_sums("saturation_sum", "CAST(sum(sat) AS BIGINT) AS sat", sat=planes.saturation)


@query("grammar_planes", with_(select="""SELECT img_id, CAST(sum(CAST(floor(fgray) AS BIGINT)) AS BIGINT) AS gray, CAST(sum(CAST(2 * fyb AS BIGINT)) AS BIGINT) AS yb,
CAST(sum(CAST(floor(fsat * 1000) AS BIGINT)) AS BIGINT) AS sat, CAST(sum(CAST(floor(CAST(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS FLOAT)) AS BIGINT)) AS BIGINT) AS gray64 FROM px GROUP BY img_id"""))
def grammar_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = lambda p, by=1: total(F.transform(p, lambda v: F.floor(v * F.lit(by).cast("float")).cast("bigint")))
    return images(spark, sf_dir).select("img_id", whole(planes.g_gray(*rgb())).alias("gray"), whole(planes.g_opponent_yb(*rgb()), 2).alias("yb"), whole(planes.g_saturation(*rgb()), 1000).alias("sat"), whole(planes.g_gray_double(*rgb())).alias("gray64"))


@query("clip_i16", with_(select="SELECT img_id, CAST(sum(greatest(-32768, least(32767, yb * 1000))) AS BIGINT) AS n FROM px GROUP BY img_id"))
def clip_i16(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.transform(planes.opponent_yb2(*rgb()), lambda v: v * 1000)
    return images(spark, sf_dir).select("img_id", total(F.transform(planes.clip_i16(wide), lambda v: v.cast("bigint"))).alias("n"))


# ---- masks

_GRADIENTS = ("dx > 12", "dx < -12", "dy > 12", "dy < -12")
_GRAD = f"grad AS MATERIALIZED (SELECT *, coalesce(lead(gray) OVER {ROW} - gray, 0) AS dx, coalesce(lead(gray) OVER {COL} - gray, 0) AS dy FROM px)"


def _bank_sql() -> str:
    parts, rows, at = [_GRAD], [], 0
    for t in (40, 60, 80, 100, 120, 140):
        parts += [mask(f"gray >= {t}", f"g{t}"), near(f"g{t}", f"g{t}_n")]
        rows.append(f"SELECT img_id, {at} AS pos, sum(v) AS v FROM g{t} GROUP BY img_id")
        rows.append(f"SELECT img_id, {at + 1} AS pos, sum(CASE WHEN (v = 1 OR n4 > 0) AND NOT (v = 1 AND low = 1) THEN 1 ELSE 0 END) AS v FROM g{t}_n GROUP BY img_id")
        at += 2
    tests = [("grad", t) for t in _GRADIENTS] + [("px", x) for t in (20, 50, 80) for x in (f"rg >= {t}", f"rg <= -{t}")] + [("px", x) for t in (40, 100, 160) for x in (f"yb >= {t}", f"yb <= -{t}")] + [("px", f"sat >= {t}") for t in (30, 60, 90)]
    for source, t in tests:
        rows.append(f"SELECT img_id, {at} AS pos, sum(CASE WHEN {t} THEN 1 ELSE 0 END) AS v FROM {source} GROUP BY img_id")
        at += 1
    return with_(*parts, select="SELECT img_id, CAST(pos AS INTEGER) AS pos, CAST(v AS BIGINT) AS v FROM (" + "\nUNION ALL ".join(rows) + ")")


@query("mask_bank_counts", _bank_sql())
def mask_bank_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = batches.map_images(images(spark, sf_dir), batches.count_kernel(Featurizer()), "n", LongType())
    return long(own, F.col("n"))


@query("grad_masks", with_(_GRAD, select="SELECT img_id, " + ", ".join(f"CAST(sum(CASE WHEN {t} THEN 1 ELSE 0 END) AS BIGINT) AS n{i}" for i, t in enumerate(_GRADIENTS)) + " FROM grad GROUP BY img_id"))
def grad_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = images(spark, sf_dir).withColumn("gray", planes.gray_u8(*rgb()))
    return own.select("img_id", *[stats.count(m).alias(f"n{i}") for i, m in enumerate(boards.gradients(F.col("gray"), 12))])


@query("grammar_threshold_counts", with_(select="""SELECT img_id, CAST(sum(CASE WHEN fgray > 120 THEN 1 ELSE 0 END) AS BIGINT) AS gray, CAST(sum(CASE WHEN r > 120 THEN 1 ELSE 0 END) AS BIGINT) AS red,
CAST(sum(CASE WHEN fyb > 80 THEN 1 ELSE 0 END) AS BIGINT) AS yb, CAST(sum(CASE WHEN fsat > 76.5 THEN 1 ELSE 0 END) AS BIGINT) AS sat FROM px GROUP BY img_id"""))
def grammar_threshold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda p, t: stats.count(boards.above(p, t))
    return images(spark, sf_dir).select("img_id", n(planes.g_gray(*rgb()), 120).alias("gray"), n(planes.g_plane(F.col("r")), 120).alias("red"), n(planes.g_opponent_yb(*rgb()), 80).alias("yb"), n(planes.g_saturation(*rgb()), 76.5).alias("sat"))


_SOBEL = f"""s0 AS (SELECT img_id, y, x, coalesce(lag(r) OVER {ROW}, 0) AS l, r AS c, coalesce(lead(r) OVER {ROW}, 0) AS rr FROM px),
s1 AS (SELECT img_id, (rr - l) * 2 + coalesce(lag(rr - l) OVER {COL}, 0) + coalesce(lead(rr - l) OVER {COL}, 0) AS gx,
coalesce(lead(l + 2*c + rr) OVER {COL}, 0) - coalesce(lag(l + 2*c + rr) OVER {COL}, 0) AS gy FROM s0)"""


@query("sobel_edge_counts", with_(_SOBEL, select="SELECT img_id, CAST(sum(CASE WHEN gx*gx + gy*gy > 2500 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM s1 GROUP BY img_id"))
def sobel_edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).select("img_id", stats.count(boards.sobel(F.col("r"), exact=True)).alias("n"))


# ---- morphology and automata


def _board(name: str, f, *rules: str):
    parts, source = [], "m"
    for i, rule in enumerate(rules):
        parts.append(after(source, rule, f"{name}{i}"))
        source = f"{name}{i}"

    @query(name, with_(M100, *parts, select=counts_of(source)))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return gray100(spark, sf_dir).select("img_id", stats.count(f(F.col("m"))).alias("n"))


_STEP = "(v = 0 AND n8 BETWEEN 5 AND 8) OR (v = 1 AND n8 BETWEEN 4 AND 8)"
_LIFE = "(v = 0 AND n8 = 3) OR (v = 1 AND n8 BETWEEN 2 AND 3)"
_ERODE, _DILATE = "v = 1 AND n8 = 8", "v = 1 OR n8 > 0"
_board("dilate4", morphology.dilate4, "v = 1 OR n4 > 0")
_board("erode4", morphology.erode4, "v = 1 AND low = 1")
_board("edge_xor", morphology.edge, "(v = 1 OR n4 > 0) AND NOT (v = 1 AND low = 1)")
_board("ca_step", morphology.step, _STEP)
_board("ca_4neigh", lambda m: morphology.step(m, birth=(3, 4), survive=(2, 4), diagonal=False), "(v = 0 AND n4 >= 3) OR (v = 1 AND n4 >= 2)")
_board("life", morphology.life, _LIFE)
_board("life_2", lambda m: morphology.automaton(m, 2, "life"), _LIFE, _LIFE)
_board("erosion3", morphology.erode8, _ERODE)
_board("dilation3", morphology.dilate8, _DILATE)
_board("opening3", lambda m: morphology.automaton(m, 1, "opening"), _ERODE, _DILATE)
_board("closing3", lambda m: morphology.automaton(m, 1, "closing"), _DILATE, _ERODE)


@query("ca_run_k", with_(M100, after("m", _STEP, "k1"), after("k1", _STEP, "k2"), after("k2", _STEP, "k3"), select="SELECT img_id, CAST(pos AS INTEGER) AS pos, CAST(n AS BIGINT) AS v FROM (" + " UNION ALL ".join(f"SELECT img_id, {i - 1} AS pos, sum(v) AS n FROM k{i} GROUP BY img_id" for i in (1, 2, 3)) + ")"))
def ca_run_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = gray100(spark, sf_dir)
    for i in range(3):  # each state is a column that the next step reads
        own = own.withColumn(f"k{i}", morphology.step(F.col(f"k{i - 1}" if i else "m")))
    return long(own, F.array(*[stats.count(F.col(f"k{i}")) for i in range(3)]))


# ---- histograms

_CUBE = "SELECT img_id, CASE WHEN gy IS NULL AND gx IS NULL THEN 0 WHEN gx IS NULL THEN 1 + gy WHEN gy IS NULL THEN 9 + gx ELSE 17 + 8 * gy + gx END AS pos, sum(v) AS n FROM (SELECT img_id, y // 4 AS gy, x // 4 AS gx, v FROM m) GROUP BY GROUPING SETS ((img_id), (img_id, gy), (img_id, gx), (img_id, gy, gx))"


@query("ca_states_sql", SQL["ca_run_k"])
def ca_states_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the table function, in SQL."""
    tables.register(spark)
    own = spark.sql("SELECT img_id, s.step - 1 AS pos, s.m FROM {masks}, LATERAL automaton_states(m, 3) s", masks=gray100(spark, sf_dir).select("img_id", "m"))
    return own.select("img_id", "pos", stats.count(F.col("m")).alias("v"))


@query("grid_cube", with_(M100, select=f"SELECT img_id, CAST(pos AS INTEGER) AS pos, CAST(n AS BIGINT) AS v FROM ({_CUBE})"))
def grid_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(gray100(spark, sf_dir), stats.projections(F.col("m")))


_WINDOWS = f"w AS MATERIALIZED (SELECT img_id, y, x, v AS a, lead(v) OVER {ROW} AS b, lead(v) OVER {COL} AS c, lag(v) OVER {ROW} AS l FROM m), w2 AS MATERIALIZED (SELECT *, lead(b) OVER {COL} AS d, lead(l) OVER {COL} AS sw FROM w)"


@query("pat2x2", with_(M100, _WINDOWS, select=dense("SELECT img_id, a + 2*b + 4*c + 8*d AS code FROM w2 WHERE y < 31 AND x < 31", 16)))
def pat2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(gray100(spark, sf_dir), stats.pattern_histogram(F.col("m")))


_MARKOV = "SELECT img_id, 2*a + b AS code FROM w2 WHERE x < 31 UNION ALL SELECT img_id, 4 + 2*a + c FROM w2 WHERE y < 31 UNION ALL SELECT img_id, 8 + 2*a + d FROM w2 WHERE y < 31 AND x < 31 UNION ALL SELECT img_id, 12 + 2*a + sw FROM w2 WHERE y < 31 AND x > 0"


@query("markov4dir", with_(M100, _WINDOWS, select=dense(_MARKOV, 16)))
def markov4dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(gray100(spark, sf_dir), stats.transition_histogram(F.col("m")))


def _lbp(value: str, source: str = "px") -> str:
    order = ("e", "ne", "n", "nw", "w", "sw", "s", "se")
    code = " + ".join(f"CASE WHEN {k} >= c THEN {1 << i} ELSE 0 END" for i, k in enumerate(order))
    return f"""l0 AS (SELECT img_id, y, x, {value} AS c, lag({value}) OVER {ROW} AS w, lead({value}) OVER {ROW} AS e FROM {source}),
l1 AS (SELECT *, lag(c) OVER {COL} AS n, lead(c) OVER {COL} AS s, lag(w) OVER {COL} AS nw, lead(w) OVER {COL} AS sw, lag(e) OVER {COL} AS ne, lead(e) OVER {COL} AS se FROM l0),
lbp AS MATERIALIZED (SELECT img_id, {code} AS code FROM l1 WHERE y BETWEEN 1 AND 30 AND x BETWEEN 1 AND 30)"""


_MIRROR = " + ".join(f"((code >> {a}) & 1) * {1 << b}" for a, b in ((0, 4), (1, 3), (2, 2), (3, 1), (4, 0), (5, 7), (6, 6), (7, 5)))


@query("lbp256", with_(_lbp("gray"), select=dense("SELECT img_id, code FROM lbp", 256)))
def lbp256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(batches.map_images(images(spark, sf_dir), batches.lbp_kernel(), "n", LongType()), F.col("n"))


@query("lbp_flip_invariant", with_(_lbp("gray"), select=dense(f"SELECT img_id, least(code, {_MIRROR}) AS code FROM lbp", 256)))
def lbp_flip_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = images(spark, sf_dir).withColumn("gray", planes.gray_u8(*rgb()))
    return long(own, stats.lbp_histogram(F.col("gray"), flip_invariant=True))


_BLOCKS = "SELECT img_id, (y // 8) * 12 + (x // 8) * 3 + {k} AS pos, sum({c}) AS s FROM px GROUP BY img_id, y // 8, x // 8"
_BLOCK_SUMS = " UNION ALL ".join(_BLOCKS.format(k=k, c=c) for k, c in enumerate("rgb"))


@query("block_means", with_(select=f"SELECT img_id, CAST(pos AS INTEGER) AS pos, CAST(round_even(s / 64.0::DOUBLE, 0) AS BIGINT) AS v FROM ({_BLOCK_SUMS})"))
def block_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(images(spark, sf_dir), stats.block_means(*rgb()))


_HIST = "SELECT img_id, ((r * 4) >> 8) * 16 + ((g * 4) >> 8) * 4 + ((b * 4) >> 8) AS code FROM px"


@query("rgb_hist", with_(select=dense(_HIST, 64)))
def rgb_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(images(spark, sf_dir), stats.colour_histogram(*rgb()))


# ---- the grammar's statistics


def _program(name: str, sql: str, *programs: grammar.Node):
    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return long(grammar.evaluate(images(spark, sf_dir), list(programs)), F.col("f"), "double")


_G120 = mask("fgray > 120")
_GRAY = grammar.Threshold(grammar.Gray(), 120)
_GRID_SIZE = "CASE WHEN pos = 0 THEN 1024.0 WHEN pos <= 16 THEN 128.0 ELSE 16.0 END"
_program("g_gridstats", with_(_G120, select=f"SELECT img_id, CAST(pos AS INTEGER) AS pos, round(CAST(CAST(n / ({_GRID_SIZE})::DOUBLE AS FLOAT) AS DOUBLE), 5) AS v FROM ({_CUBE})"), grammar.GridStats(_GRAY))
_program("g_pat2x2", with_(_G120, _WINDOWS, select=dense("SELECT img_id, 8*a + 4*b + 2*c + d AS code FROM w2 WHERE y % 2 = 0 AND x % 2 = 0", 16, "round(coalesce(c.n, 0) / 256.0::DOUBLE, 5)")), grammar.Pat2x2(_GRAY))
_program("g_markov4", with_(_G120, _WINDOWS, select=dense("SELECT img_id, 2*a + b AS code FROM w2 WHERE x < 31 UNION ALL SELECT img_id, 2*a + c FROM w2 WHERE y < 31", 4, "round(CAST(CAST(coalesce(c.n, 0) / 1984.0::DOUBLE AS FLOAT) AS DOUBLE), 5)")), grammar.Markov4(_GRAY))
_MOMENTS = """mu AS (SELECT img_id, avg(CAST({v} AS DOUBLE)) AS m FROM {t} GROUP BY img_id),
mo AS (SELECT p.img_id, any_value(m) AS m, avg(pow({v} - m, 2)) AS c2, avg(pow({v} - m, 3)) AS c3, avg(pow({v} - m, 4)) AS c4 FROM {t} p JOIN mu USING (img_id) GROUP BY p.img_id)"""
_MOMENT_ROWS = "SELECT img_id, 0 AS pos, round(CAST(CAST(m AS FLOAT) AS DOUBLE), 3) AS v FROM mo UNION ALL SELECT img_id, 1, round(CAST(CAST(sqrt(c2) AS FLOAT) AS DOUBLE), 3) FROM mo UNION ALL SELECT img_id, 2, round(CAST(CAST(CASE WHEN c2 > 0 THEN c3 / pow(c2, 1.5) ELSE 0 END AS FLOAT) AS DOUBLE), 3) FROM mo UNION ALL SELECT img_id, 3, round(CAST(CAST(CASE WHEN c2 > 0 THEN c4 / (c2 * c2) - 3 ELSE 0 END AS FLOAT) AS DOUBLE), 3) FROM mo"


def _rounded3(name: str, sql: str, program: grammar.Node):
    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = grammar.evaluate(images(spark, sf_dir), [program]).select("img_id", F.posexplode("f").alias("pos", "v"))
        return out.select("img_id", "pos", F.round(F.col("v").cast("double"), 3).alias("v"))


_rounded3("g_moments", with_(_MOMENTS.format(v="r", t="px"), select=f"SELECT img_id, CAST(pos AS INTEGER) AS pos, v FROM ({_MOMENT_ROWS})"), grammar.Moments(grammar.R()))
_rounded3("g_direct_stats", with_("m AS (SELECT img_id, y, x, g AS v FROM px)", select=f"SELECT img_id, CAST(pos AS INTEGER) AS pos, round(CAST(CAST(n / ({_GRID_SIZE})::DOUBLE AS FLOAT) AS DOUBLE), 3) AS v FROM ({_CUBE})"), grammar.GridStats(grammar.G()))
_program("g_lbp", with_(_lbp("CAST(trunc(CAST(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS FLOAT)) AS INTEGER)"), select=dense("SELECT img_id, code FROM lbp", 256, "round(CAST(CAST(coalesce(c.n, 0) / 900.0::DOUBLE AS FLOAT) AS DOUBLE), 5)")), grammar.LBP())
_program("g_rgbhist", with_(select=dense(_HIST, 64, "round(coalesce(c.n, 0) / 1024.0::DOUBLE, 5)")), grammar.RGBHist())
_program("g_rgbblocks", with_(select=f"SELECT img_id, CAST(pos AS INTEGER) AS pos, round(CAST(CAST(s / 64.0::DOUBLE AS FLOAT) / CAST(255 AS FLOAT) AS DOUBLE), 5) AS v FROM ({_BLOCK_SUMS})"), grammar.RGBBlocks())

# ---- whole vectors: rows of 32 bits in SQL

_FULL, _INNER = (1 << 32) - 1, (1 << 31) - 1


def _bits(v: str, set_: int) -> str:
    return v if set_ else f"xor({v}, {_FULL}::BIGINT)"


def _sum_of(bits: str, when: str = "") -> str:
    return f"CAST(sum(CASE WHEN {when} THEN bit_count({bits}) ELSE 0 END) AS BIGINT)" if when else f"CAST(sum(bit_count({bits})) AS BIGINT)"


def _pair(a: str, b: str, code: int, inner: int, when: str = "") -> str:
    """Pixels with ``a`` and ``b`` (a row and a shifted or lower one) as the two bits of ``code``."""
    return _sum_of(f"({_bits(a, code >> 1)} & {_bits(b, code & 1)} & {inner}::BIGINT)", when)


def _block_lists() -> dict[str, list[str]]:
    """The values of a mask from its rows m and the rows below, n, which the last row has not."""
    cell, low = (lambda j: f"((m >> {4 * j}) & 15)"), "n IS NOT NULL"
    grid = [_sum_of("m"), *[_sum_of("m", f"y // 4 = {i}") for i in range(8)], *[_sum_of(cell(j)) for j in range(8)], *[_sum_of(cell(j), f"y // 4 = {i}") for i in range(8) for j in range(8)]]
    window = lambda c: f"({_bits('m', c & 1)} & {_bits('(m >> 1)', c >> 1 & 1)} & {_bits('n', c >> 2 & 1)} & {_bits('(n >> 1)', c >> 3 & 1)} & {_INNER}::BIGINT)"
    ways = (("m", "(m >> 1)", _INNER, ""), ("m", "n", _FULL, low), ("m", "(n >> 1)", _INNER, low), ("(m >> 1)", "n", _INNER, low))
    return {"grid": grid, "patterns": [_sum_of(window(c), low) for c in range(16)], "transitions": [_pair(a, b, c, inner, when) for a, b, inner, when in ways for c in range(4)]}


def _vector_sql(f: Featurizer, source: str = "px") -> list[str]:
    """CTEs, the last of them vx (img_id, pos, v): the whole vector of every image of ``source``."""
    tests: list[str | int] = []  # a number: the edge of that mask
    for t in f.gray:
        tests += [f"gray >= {t}"] + ([len(tests)] if f.edges else [])
    if f.gradients:
        tests += [f"{d} {c} {x}" for d in ("dx", "dy") for c, x in ((">", f.gradient), ("<", -f.gradient))]
    tests += [x for t in f.red_green for x in (f"rg >= {t}", f"rg <= -{t}")] + [x for t in f.yellow_blue for x in (f"yb >= {2 * t}", f"yb <= -{2 * t}")] + [f"sat >= {t}" for t in f.saturation]
    rows = ", ".join(f"sum(CASE WHEN {t} THEN 1::BIGINT << x ELSE 0 END)::BIGINT AS m{i}" for i, t in enumerate(tests) if isinstance(t, str))
    near = lambda i, step, out: f"coalesce({step}(m{i}) OVER (PARTITION BY img_id ORDER BY y), {out}::BIGINT)"
    edge = lambda i: f"xor(m{i} | ((m{i} << 1) & {_FULL}::BIGINT) | (m{i} >> 1) | {near(i, 'lag', 0)} | {near(i, 'lead', 0)}, m{i} & (((m{i} << 1) & {_FULL}::BIGINT) | 1) & ((m{i} >> 1) | {1 << 31}::BIGINT) & {near(i, 'lag', _FULL)} & {near(i, 'lead', _FULL)})"
    bank = ", ".join(f"m{i}" if isinstance(t, str) else edge(t) for i, t in enumerate(tests))
    own = _block_lists()
    values = own["grid"] + own["patterns"] + (own["transitions"] if f.markov else [])
    at, parts = len(tests) * len(values), [f"SELECT img_id, k * {len(values)} + unnest(range({len(values)})) AS pos, unnest(l) AS v FROM vb"]
    ids, lbp = f"(SELECT DISTINCT img_id FROM {source}) i", []
    if f.lbp:
        lbp = [_lbp("gray", source)]
        parts.append(f"SELECT img_id, {at} + unnest(range(256)), unnest(list_transform(range(256), lambda c: coalesce(map_extract_value(h, c), 0))) FROM (SELECT img_id, histogram(code::BIGINT) AS h FROM lbp GROUP BY img_id)")
        at += 256
    k = 32 // f.blocks
    parts += [f"SELECT img_id, {at} + (y // {k}) * {3 * f.blocks} + (x // {k}) * 3 + {c}, CAST(round_even(sum({p}) / {float(k * k)}::DOUBLE, 0) AS BIGINT) FROM {source} GROUP BY img_id, y // {k}, x // {k}" for c, p in enumerate("rgb")]
    at += 3 * f.blocks**2
    parts.append(f"SELECT img_id, {at} + unnest(range({f.bins**3})), unnest(list_transform(range({f.bins**3}), lambda c: coalesce(map_extract_value(h, c), 0))) FROM (SELECT img_id, histogram((((r * {f.bins}) >> 8) * {f.bins**2} + ((g * {f.bins}) >> 8) * {f.bins} + ((b * {f.bins}) >> 8))::BIGINT) AS h FROM {source} GROUP BY img_id)")
    parts.append(f"SELECT img_id, {f.size - 1}, 1 FROM {ids}")
    return [
        f"vg AS (SELECT *, coalesce(lead(gray) OVER {ROW} - gray, 0) AS dx, coalesce(lead(gray) OVER {COL} - gray, 0) AS dy FROM {source})",
        f"vr AS MATERIALIZED (SELECT img_id, y, {rows} FROM vg GROUP BY img_id, y)",
        f"vm AS MATERIALIZED (SELECT img_id, y, unnest(range({len(tests)})) AS k, unnest(l) AS m FROM (SELECT img_id, y, [{bank}] AS l FROM vr))",
        "vn AS (SELECT *, lead(m) OVER (PARTITION BY img_id, k ORDER BY y) AS n FROM vm)",
        f"vb AS MATERIALIZED (SELECT img_id, k, [{', '.join(values)}] AS l FROM vn GROUP BY img_id, k)", *lbp,
        "vx AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")",
    ]


_AS_TEXT = "SELECT img_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY pos) AS f FROM {t} GROUP BY img_id"

# ---- symmetries

_D4 = "d4 AS (SELECT p.*, k.g AS e, CASE k.g // 2 WHEN 0 THEN y WHEN 1 THEN 31 - x WHEN 2 THEN 31 - y ELSE x END AS ry, CASE k.g // 2 WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN 31 - x ELSE 31 - y END AS rx FROM px p CROSS JOIN (SELECT unnest(range(8)) AS g) k), d8 AS MATERIALIZED (SELECT img_id, e, gray, r, g, b, rg, yb, sat, ry AS y, CASE WHEN e % 2 = 1 THEN 31 - rx ELSE rx END AS x FROM d4)"


@query("d4_orbit", with_(_D4, select="SELECT img_id, CAST(e AS INTEGER) AS element, CAST(sum(gray * (y * 37 + x)) AS BIGINT) AS checksum FROM d8 GROUP BY img_id, e"))
def d4_orbit(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = symmetry.orbit(images(spark, sf_dir))
    weigh = lambda p: total(F.transform(p, lambda v, i: v.cast("bigint") * (F.floor(i / 32) * 37 + i % 32)))
    return own.select("img_id", "element", weigh(planes.gray_u8(*rgb())).alias("checksum"))


@query("d4_orbit_sql", SQL["d4_orbit"])
def d4_orbit_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the table function, in SQL."""
    tables.register(spark)
    own = spark.sql("SELECT img_id, o.* FROM {images} i, LATERAL d4_orbit(i.r, i.g, i.b) o", images=images(spark, sf_dir))
    weigh = lambda p: total(F.transform(p, lambda v, i: v.cast("bigint") * (F.floor(i / 32) * 37 + i % 32)))
    return own.select("img_id", "element", weigh(planes.gray_u8(*rgb())).alias("checksum"))


_D8 = _D4 + ", q8 AS MATERIALIZED (SELECT * REPLACE (img_id * 8 + e AS img_id) FROM d8)"
_D4_GRID = _D4 + ", d4g AS (SELECT img_id, e, (y // 4) * 8 + x // 4 AS pos, sum(CASE WHEN gray >= 100 THEN 1 ELSE 0 END) AS n FROM d8 GROUP BY ALL)"


_SMALL = Featurizer(gray=(100,), edges=False, gradients=False, red_green=(), yellow_blue=(), saturation=(), lbp=False, bias=True)


def joined(rows: DataFrame, column: str = "f") -> DataFrame:
    """(img_id, f): a vector of whole numbers as one text, so that each value counts."""
    return rows.select("img_id", F.array_join(F.col(column).cast("array<string>"), ",").alias("f"))


def _pooled(how: str, sql: str):
    @query(f"d4_pool_{how}", with_(_D8, *_vector_sql(_SMALL, "q8"), f"pl AS (SELECT img_id // 8 AS img_id, pos, CAST({sql} AS BIGINT) AS v FROM vx GROUP BY ALL)", select=_AS_TEXT.format(t="pl")))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return joined(_SMALL.invariant(images(spark, sf_dir), how))


_pooled("mean", "round_even(avg(v), 0)")
_pooled("max", "max(v)")
_pooled("median", "round_even(median(v), 0)")


@query("d4_equivariant", with_(_D8, *_vector_sql(_SMALL, "q8"), f"eq AS (SELECT img_id // 8 AS img_id, img_id % 8 * {_SMALL.size} + pos AS pos, v FROM vx)", select=_AS_TEXT.format(t="eq")))
def d4_equivariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of the eight symmetries, one after the other."""
    return joined(_SMALL.equivariant(images(spark, sf_dir)))


@query("flip_x", with_(select="SELECT img_id, CAST(sum(r * (y * 37 + 31 - x)) AS BIGINT) AS checksum FROM px GROUP BY img_id"))
def flip_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    weigh = total(F.transform(symmetry.flip_x(F.col("r")), lambda v, i: v.cast("bigint") * (F.floor(i / 32) * 37 + i % 32)))
    return images(spark, sf_dir).select("img_id", weigh.alias("checksum"))


# ---- vectors


@query("feature_vector_block", with_(M100, _WINDOWS, select=f"SELECT img_id, CAST(pos AS INTEGER) AS pos, CAST(n AS BIGINT) AS v FROM ({_CUBE}) UNION ALL SELECT img_id, pos + 81, v FROM ({dense('SELECT img_id, a + 2*b + 4*c + 8*d AS code FROM w2 WHERE y < 31 AND x < 31', 16)}) UNION ALL SELECT img_id, pos + 97, v FROM ({dense(_MARKOV, 16)})"))
def feature_vector_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block of the mask gray >= 100 out of the whole vector: the seventh."""
    f = Featurizer()
    own = f.features(images(spark, sf_dir))
    return long(own, F.slice("f", 6 * f.block_size + 1, f.block_size))


@query("feature_vector", with_(*_vector_sql(Featurizer()), select=_AS_TEXT.format(t="vx")))
def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 3,872 values of every image."""
    return joined(Featurizer().features(images(spark, sf_dir)))


@query("feature_dims", "SELECT * FROM (VALUES ('all', CAST(3872 AS BIGINT), CAST(31 AS BIGINT)), ('three thresholds', 3194, 25), ('two steps', 10878, 93)) t(name, size, masks)")
def feature_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {"all": Featurizer(), "three thresholds": Featurizer(gray=(64, 128, 192)), "two steps": Featurizer(ca_steps=2)}
    return spark.createDataFrame([(k, f.size, f.n_masks) for k, f in made.items()], "name string, size bigint, masks bigint")


def _dims(name: str, programs: list[grammar.Node], n: int, size: int):
    @query(name, f"SELECT CAST({n} AS BIGINT) AS programs, CAST({size} AS BIGINT) AS size")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.createDataFrame([(len(programs), sum(grammar.size(p) for p in programs))], "programs bigint, size bigint")


_dims("v5_program_dims", grammar.first_programs(), 41, 2509)
_dims("v6_program_dims", grammar.second_programs(), 171, 4778)


def _programs_sql() -> str:
    """The first list of programs from rows of bits: each mask's counts, then each program's fractions as whole numbers."""
    channel = {"R": "r", "G": "g", "B": "b", "Gray": "fgray", "OppRG": "rg", "OppYB": "fyb", "Sat": "fsat"}
    rules = {"life": [_LIFE], "erosion": [_ERODE], "dilation": [_DILATE], "opening": [_ERODE, _DILATE], "closing": [_DILATE, _ERODE]}
    masks: dict[grammar.Node, int] = {}
    parts, tables, at = [], [], 0

    def of(node: grammar.Node) -> int:
        if node not in masks:
            masks[node] = len(masks)
        return masks[node]

    def add(node: grammar.Node) -> None:
        nonlocal at
        if isinstance(node, grammar.Concat):
            add(node.left)
            add(node.right)
            return
        k, n = of(node.of), grammar.size(node)
        share = lambda x, by: f"CAST(round(CAST(CAST({x} / {by}::DOUBLE AS FLOAT) AS DOUBLE) * 100000) AS BIGINT)"
        if isinstance(node, grammar.Moments):
            p = "(g[1] / 1024.0::DOUBLE)"
            var = f"({p} * (1 - {p}))"
            own = [p, f"sqrt({var})", f"CASE WHEN {var} > 0 THEN (1 - 2 * {p}) / sqrt({var}) ELSE 0 END", f"CASE WHEN {var} > 0 THEN (1 - 6 * {var}) / {var} ELSE 0 END"]
            values = "[" + ", ".join(f"CAST(round(({x}) * 100) AS BIGINT)" for x in own) + "]"
        elif isinstance(node, grammar.GridStats):
            values = f"list_transform(range(1, 82), lambda i: CASE WHEN i = 1 THEN {share('g[i]', 1024)} WHEN i <= 17 THEN {share('g[i]', 128)} ELSE {share('g[i]', 16)} END)"
        else:
            values = f"list_transform({'p' if n == 16 else 't'}, lambda v: {share('v', '(256 + 1e-9)' if n == 16 else '(1984 + 1e-9)')})"
        parts.append(f"SELECT img_id, {at} + unnest(range({n})) AS pos, unnest({values}) AS v FROM vb WHERE k = {k}")
        at += n

    for p in grammar.first_programs():
        add(p)
    bits, joins = [], []
    for node, k in masks.items():
        if isinstance(node, grammar.Threshold):
            bits.append(f"sum(CASE WHEN {channel[type(node.of).__name__]} > {node.t}::FLOAT THEN 1::BIGINT << x ELSE 0 END)::BIGINT AS m{k}")
            continue
        tables.append(mask(f"{channel[type(node.of.of).__name__]} > {node.of.t}::FLOAT", f"s{k}"))
        name = f"s{k}"
        for i, rule in enumerate(r for r in (rules[node.rule] if node.rule in ("opening", "closing") else rules[node.rule] * node.steps)):
            tables.append(after(name, rule, f"s{k}_{i}"))
            name = f"s{k}_{i}"
        tables.append(f"b{k} AS (SELECT img_id, y, sum(v::BIGINT << x)::BIGINT AS m{k} FROM {name} GROUP BY img_id, y)")
        joins.append(f"JOIN b{k} USING (img_id, y)")
    own, even = _block_lists(), 0x55555555
    window = lambda c: f"({_bits('m', c >> 3 & 1)} & {_bits('(m >> 1)', c >> 2 & 1)} & {_bits('n', c >> 1 & 1)} & {_bits('(n >> 1)', c & 1)} & {even}::BIGINT)"
    pooled = ", ".join(f"{own['transitions'][c]} + {own['transitions'][4 + c]}" for c in range(4))
    tables += [
        f"vr AS MATERIALIZED (SELECT img_id, y, {', '.join(bits)} FROM px GROUP BY img_id, y)",
        f"vm AS MATERIALIZED (SELECT img_id, y, unnest(range({len(masks)})) AS k, unnest([{', '.join(f'm{k}' for k in range(len(masks)))}]) AS m FROM vr {' '.join(joins)})",
        "vn AS (SELECT *, lead(m) OVER (PARTITION BY img_id, k ORDER BY y) AS n FROM vm)",
        f"vb AS MATERIALIZED (SELECT img_id, k, [{', '.join(own['grid'])}] AS g, [{', '.join(_sum_of(window(c), 'y % 2 = 0') for c in range(16))}] AS p, [{pooled}] AS t FROM vn GROUP BY img_id, k)",
        "vx AS (" + " UNION ALL ".join(parts) + ")",
    ]
    return with_(*tables, select=_AS_TEXT.format(t="vx"))


@query("v5_programs", _programs_sql())
def v5_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 2,509 values of every image, in hundred thousandths (moments in hundredths), half up."""
    programs, by = grammar.first_programs(), []
    for p in programs:
        by += [100 if isinstance(p, grammar.Moments) else 100_000] * grammar.size(p)
    scale = F.array(*[F.lit(x) for x in by])
    own = grammar.evaluate(images(spark, sf_dir), programs).withColumn("f", F.zip_with("f", scale, lambda v, k: F.round(v.cast("double") * k).cast("bigint")))
    return joined(own)


@query("v6_programs")
def v6_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 4,778 values of every image."""
    return grammar.evaluate(images(spark, sf_dir), grammar.second_programs()).select("img_id", "f")


# ---- global statistics, on the grid of the mask gray >= 100 as a vector of 65


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img_id, label, split, f): 64 cells and a bias."""
    return gray100(spark, sf_dir).select("img_id", "label", "split", F.concat(stats.grid(F.col("m")), F.array(F.lit(1).cast("bigint"))).alias("f"))


_VEC = M100 + ", vec AS MATERIALIZED (SELECT img_id, label, CASE WHEN img_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, (y // 4) * 8 + x // 4 AS pos, CAST(sum(v) AS DOUBLE) AS x FROM m GROUP BY ALL UNION ALL SELECT img_id, label, CASE WHEN img_id % 5 = 0 THEN 'test' ELSE 'train' END, 64, 1 FROM img)"


@query("running_var", with_(_VEC, select="SELECT CAST(pos AS INTEGER) AS pos, CAST(count(*) AS BIGINT) AS n, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS var FROM vec GROUP BY pos"))
def running_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = scaling.moments(vectors(spark, sf_dir))
    return m.select("pos", "n", F.round("mean", 6).alias("mean"), F.round(scaling.variance(F.col("m2"), F.col("n")), 6).alias("var"))


@query("welford_merge", SQL["running_var"])
def welford_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = scaling.moments(vectors(spark, sf_dir).withColumn("part", F.col("img_id") % 7), "f", "part")
    m = scaling.merge(parts)
    return m.select("pos", "n", F.round("mean", 6).alias("mean"), F.round(scaling.variance(F.col("m2"), F.col("n")), 6).alias("var"))


def _invstd(name: str, use_var: bool, sql: str):
    @query(name, with_(_VEC, select=f"SELECT CAST(pos AS INTEGER) AS pos, round(1000 / sqrt({sql} + 10), 2) AS inv FROM vec WHERE split = 'train' GROUP BY pos"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        inv = scaling.inverse_deviation(vectors(spark, sf_dir).where("split = 'train'"), use_var=use_var, eps=10.0)
        return inv.select("pos", F.round(1000 * F.col("inv").cast("double"), 2).alias("inv"))


_invstd("diag_invstd_var", True, "var_pop(x)")
_invstd("diag_invstd_ms", False, "avg(x * x)")


@query("diag_apply", with_(_VEC, "inv AS (SELECT pos, CAST(1 / sqrt(var_pop(x) + 10) AS FLOAT) AS inv FROM vec WHERE split = 'train' GROUP BY pos)", select="SELECT img_id, CAST(pos AS INTEGER) AS pos, CAST(greatest(-32768, least(32767, round_even(CAST(x AS FLOAT) * inv * CAST(16 AS FLOAT), 0))) AS BIGINT) AS v FROM vec JOIN inv USING (pos)"))
def diag_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = vectors(spark, sf_dir)
    inv = scaling.inverse_deviation(own.where("split = 'train'"), eps=10.0)
    return long(scaling.apply_scale(own, inv, scale=16.0), F.col("f"))


@query("grammar_diag_scale", with_(_VEC, "sc AS (SELECT pos, sqrt(var_pop(x) + 10) / 32 AS s FROM vec GROUP BY pos)", select="SELECT img_id, CAST(pos AS INTEGER) AS pos, round(x / s, 5) AS v FROM vec JOIN sc USING (pos)"))
def grammar_diag_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = vectors(spark, sf_dir)
    return long(scaling.grammar_scale(own, own), F.col("f"), "double")


@query("grammar_diag_scale_std", with_(_VEC, "sc AS (SELECT pos, (stddev_pop(x) + 10) / 32 AS s FROM vec GROUP BY pos)", select="SELECT img_id, CAST(pos AS INTEGER) AS pos, round(x / s, 5) AS v FROM vec JOIN sc USING (pos)"))
def grammar_diag_scale_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = vectors(spark, sf_dir)
    return long(scaling.grammar_scale(own, own, use_var=False), F.col("f"), "double")


@query("stratified_split", "SELECT label, CAST(count(*) AS BIGINT) AS n, CAST(ceil(count(*) * 0.1) AS BIGINT) AS held_out FROM embeddings GROUP BY label")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = learn.stratified_split(images(spark, sf_dir).select("img_id", "label"), "img_id", "label")
    return own.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("held_out").cast("bigint")).alias("held_out"))


@query("flip_augment_union", with_(select="SELECT img_id, f AS flipped, CAST(sum(r * (y * 37 + CASE WHEN f THEN 31 - x ELSE x END)) AS BIGINT) AS checksum FROM px CROSS JOIN (SELECT unnest([true, false]) AS f) GROUP BY img_id, f"))
def flip_augment_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = images(spark, sf_dir).select("img_id", "r")
    both = own.withColumn("flipped", F.lit(False)).unionByName(own.select("img_id", symmetry.flip_x(F.col("r")).alias("r"), F.lit(True).alias("flipped")))
    weigh = total(F.transform(F.col("r"), lambda v, i: v.cast("bigint") * (F.floor(i / 32) * 37 + i % 32)))
    return both.select("img_id", "flipped", weigh.alias("checksum"))


@query("shuffle_epoch")
def shuffle_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("img_id"))
    return learn.epoch_order(own, "img_id", 1).withColumn("flip", learn.coin("img_id", 1))


# ---- learners

_LDA = """mu AS MATERIALIZED (SELECT label, pos, avg(x) AS mu, count(*) AS n, var_pop(x) * count(*) AS ss FROM vec WHERE split = 'train' GROUP BY label, pos),
s2 AS MATERIALIZED (SELECT pos, greatest(sum(ss) / sum(n), 1e-9) AS s2 FROM mu GROUP BY pos),
cl AS MATERIALIZED (SELECT mu.label, -0.5 * sum(mu * mu / s2) + ln((any_value(n) + 1e-12) / (SELECT sum(n) FROM mu WHERE pos = 0)) AS c FROM mu JOIN s2 USING (pos) GROUP BY mu.label),
sc AS MATERIALIZED (SELECT v.img_id, v.label AS own, mu.label, sum(v.x * mu / s2) + any_value(c) AS s FROM vec v JOIN mu USING (pos) JOIN s2 USING (pos) JOIN cl ON cl.label = mu.label WHERE v.split = 'test' GROUP BY v.img_id, v.label, mu.label),
rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY s DESC, label) AS k FROM sc)"""


def _trained(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = vectors(spark, sf_dir)
    return learn.fit_discriminant(own.where("split = 'train'")), own.where("split = 'test'")


@query("lda_fit", with_(_VEC, _LDA, select="SELECT label, CAST(pos AS INTEGER) AS pos, round(CASE WHEN pos = 64 THEN 0 ELSE mu / s2 END, 6) AS w, round((SELECT c FROM cl WHERE cl.label = mu.label) + 0.5e9, 3) AS c FROM mu JOIN s2 USING (pos)"))
def lda_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _ = _trained(spark, sf_dir)
    each = model.select(F.explode(F.arrays_zip("classes", "w", "const")).alias("m")).select(F.col("m.classes").alias("label"), F.posexplode("m.w").alias("pos", "w"), F.col("m.const").alias("c"))
    return each.select("label", "pos", F.round(F.when(F.col("pos") == 64, 0.0).otherwise(F.col("w")), 6).alias("w"), F.round(F.col("c") + 0.5e9, 3).alias("c"))


@query("lda_predict", with_(_VEC, _LDA, select="SELECT img_id, CAST(max(CASE WHEN k = 1 THEN label END) AS INTEGER) AS best, CAST(max(CASE WHEN k = 2 THEN label END) AS INTEGER) AS second FROM rk GROUP BY img_id"))
def lda_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, test = _trained(spark, sf_dir)
    scored = learn.discriminant_scores(test, model)
    return scored.select("img_id", F.get("classes", learn.argmax(F.col("scores"))).alias("best"), F.get("classes", learn.runner_up(F.col("scores"))).alias("second"))


@query("lda_accuracy", with_(_VEC, _LDA, select="SELECT round(avg(CASE WHEN label = own THEN 1.0 ELSE 0.0 END), 6) AS accuracy, CAST(count(*) AS BIGINT) AS n FROM rk WHERE k = 1"))
def lda_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, test = _trained(spark, sf_dir)
    scored = learn.discriminant_scores(test, model)
    best = F.get("classes", learn.argmax(F.col("scores")))
    return scored.agg(F.round(learn.accuracy(best, F.col("label")), 6).alias("accuracy"), F.count(F.lit(1)).alias("n"))


@query("argmax_first", "WITH h AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings), q AS (SELECT vec_id, i, floor(v * 10) AS s FROM h), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, i) AS k FROM q) SELECT vec_id, CAST(max(CASE WHEN k = 1 THEN i END) AS INTEGER) AS best, CAST(max(CASE WHEN k = 2 THEN i END) AS INTEGER) AS second FROM k GROUP BY vec_id")
def argmax_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ties by design: the embeddings cut to tenths."""
    own = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda v: F.floor(v * F.lit(10).cast("float"))).alias("s"))
    return own.select("vec_id", learn.argmax(F.col("s")).alias("best"), learn.runner_up(F.col("s")).alias("second"))


@query("runner_up", SQL["argmax_first"])
def runner_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by ranking rows."""
    from pyspark.sql import Window

    own = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode(F.transform("embedding", lambda v: F.floor(v * F.lit(10).cast("float")))).alias("i", "s"))
    k = own.withColumn("k", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("s"), "i"))).where("k <= 2")
    return k.groupBy("vec_id").agg(F.max(F.when(F.col("k") == 1, F.col("i"))).alias("best"), F.max(F.when(F.col("k") == 2, F.col("i"))).alias("second"))


_FLIP_SCORES = """fv AS MATERIALIZED (SELECT img_id, (pos // 8) * 8 + 7 - pos % 8 AS pos, x FROM vec WHERE pos < 64 AND split = 'test' UNION ALL SELECT img_id, 64, 1 FROM vec WHERE pos = 64 AND split = 'test'),
fs AS (SELECT v.img_id, mu.label, sum(v.x * mu / s2) + any_value(c) AS s FROM fv v JOIN mu USING (pos) JOIN s2 USING (pos) JOIN cl ON cl.label = mu.label GROUP BY v.img_id, mu.label),
fr AS (SELECT sc.img_id, sc.own, sc.label, row_number() OVER (PARTITION BY sc.img_id ORDER BY sc.s + fs.s DESC, sc.label) AS k FROM sc JOIN fs ON fs.img_id = sc.img_id AND fs.label = sc.label)"""


@query("flip_ensemble", with_(_VEC, _LDA, _FLIP_SCORES, select="SELECT img_id, CAST(label AS INTEGER) AS best FROM fr WHERE k = 1"))
def flip_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, test = _trained(spark, sf_dir)
    own = images(spark, sf_dir).where("split = 'test'").withColumn("gray", symmetry.flip_x(planes.gray_u8(*rgb())))
    flipped = own.select("img_id", F.concat(stats.grid(boards.at_least(F.col("gray"), 100)), F.array(F.lit(1).cast("bigint"))).alias("f"))
    both = learn.with_flips(learn.discriminant_scores(test, model), learn.discriminant_scores(flipped, model))
    return both.select("img_id", F.get("classes", learn.argmax(F.col("scores"))).alias("best"))


@query("perceptron_fit")
def perceptron_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.fit_perceptron(vectors(spark, sf_dir).where("split = 'train'"), classes=10, epochs=2)


@query("perceptron_accuracy")
def perceptron_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = vectors(spark, sf_dir)
    weights = learn.fit_perceptron(own.where("split = 'train'"), classes=10, epochs=2)
    scored = learn.perceptron_scores(own.where("split = 'test'"), weights)
    return scored.agg(learn.accuracy(learn.argmax(F.col("scores")), F.col("label")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


@query("trees_rf")
def trees_rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = vectors(spark, sf_dir)
    out = learn.predict(learn.fit_forest(own.where("split = 'train'"), trees=10, depth=5), own.where("split = 'test'"))
    return out.select("img_id", "label", "predicted")


@query("trees_ovr")
def trees_ovr(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = vectors(spark, sf_dir)
    out = learn.predict(learn.fit_boosted(own.where("split = 'train'"), rounds=2, depth=2), own.where("split = 'test'"))
    return out.select("img_id", "label", "predicted")


def flipped_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vectors`` of the mirror images."""
    own = images(spark, sf_dir).withColumn("gray", symmetry.flip_x(planes.gray_u8(*rgb())))
    return own.select("img_id", "label", "split", F.concat(stats.grid(boards.at_least(F.col("gray"), 100)), F.array(F.lit(1).cast("bigint"))).alias("f"))


@query("perceptron_flip_accuracy")
def perceptron_flip_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on images and mirror images; scores of both are added."""
    own, mirror = vectors(spark, sf_dir), flipped_vectors(spark, sf_dir)
    both = own.unionByName(mirror.withColumn("img_id", -1 - F.col("img_id"))).where("split = 'train'")
    weights = learn.fit_perceptron(both, classes=10, epochs=2)
    scored = learn.with_flips(learn.perceptron_scores(own.where("split = 'test'"), weights), learn.perceptron_scores(mirror.where("split = 'test'"), weights))
    return scored.agg(learn.accuracy(learn.argmax(F.col("scores")), F.col("label")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


@query("perceptron_by_epoch")
def perceptron_by_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accuracy of the weights after each epoch, before they are averaged."""
    own, seen = vectors(spark, sf_dir).cache(), []

    def note(epoch: int, weights: DataFrame) -> None:
        scored = learn.perceptron_scores(own.where("split = 'test'"), weights)
        seen.append((epoch, scored.agg(learn.accuracy(learn.argmax(F.col("scores")), F.col("label"))).first()[0]))

    learn.fit_perceptron(own.where("split = 'train'"), classes=10, epochs=3, after_epoch=note)
    own.unpersist()
    return spark.createDataFrame(seen, "epoch int, accuracy double")


@query("trees_rf_flip")
def trees_rf_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the probabilities of an image and of its mirror image."""
    own, mirror = vectors(spark, sf_dir), flipped_vectors(spark, sf_dir)
    model = learn.fit_forest(own.where("split = 'train'"), trees=10, depth=5)
    out = learn.with_mean_probabilities(model, own.where("split = 'test'"), mirror.where("split = 'test'"))
    return out.select("img_id", "label", learn.argmax(F.col("scores")).alias("predicted"))


@query("trees_early_stop")
def trees_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of each label is held out; boosting stops when it gets no better there."""
    own = vectors(spark, sf_dir)
    train = learn.stratified_split(own.where("split = 'train'"), "img_id", "label")
    out = learn.predict(learn.fit_boosted(train, rounds=3, depth=2, held_out="held_out"), own.where("split = 'test'"))
    return out.select("img_id", "label", "predicted")


def _best_class(model: boosting.Boosted) -> Column:
    return F.element_at(F.array(*map(F.lit, model.classes)), learn.argmax(F.col("scores")) + 1)


@query("trees_multiclass")
def trees_multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees for all classes at once, grown leaf by leaf."""
    own = vectors(spark, sf_dir)
    model = boosting.fit_trees(own.where("split = 'train'"), rounds=20, depth=4, leaves=12, rate=0.1)
    return boosting.tree_probabilities(own.where("split = 'test'"), model).select("img_id", "label", _best_class(model).alias("predicted"))


@query("trees_multiclass_early_stop")
def trees_multiclass_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of each label is held out; the rounds after the one with the least loss there are dropped, and images and mirror images are
    judged by the mean of their probabilities."""
    own, mirror = vectors(spark, sf_dir), flipped_vectors(spark, sf_dir)
    train = learn.stratified_split(own.where("split = 'train'"), "img_id", "label")
    model = boosting.fit_trees(train, rounds=12, depth=4, leaves=12, rate=0.3, held_out="held_out", patience=3)
    both = learn.with_flips(*[boosting.tree_probabilities(v.where("split = 'test'"), model) for v in (own, mirror)])
    return both.select("img_id", "label", _best_class(model).alias("predicted"), F.lit(len(model.rounds)).alias("rounds"))


@query("ridge_accuracy")
def ridge_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = vectors(spark, sf_dir)
    scored = learn.ridge_scores(own.where("split = 'test'"), learn.fit_ridge(own.where("split = 'train'"), classes=10))
    return scored.agg(learn.accuracy(learn.argmax(F.col("scores")), F.col("label")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


# ---- the group as a graph


@query("cayley_edges", "SELECT CAST(g AS INTEGER) AS g, step, CAST(CASE WHEN step = 'r' THEN g // 4 * 4 + (g + 1) % 4 ELSE 4 - g // 4 * 4 + (4 - g % 4) % 4 END AS INTEGER) AS next FROM (SELECT unnest(range(8)) AS g) CROSS JOIN (SELECT unnest(['r', 's']) AS step)")
def cayley_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cayley.edges(spark)


_OWN, _ALONG_R, _ALONG_S, _BIAS = ((1, -1, 0, 2), (0, 1, 1, -1)), ((2, 0, -1, 0), (-1, 1, 0, 1)), ((0, 1, 0, -2), (1, 0, -2, 1)), (5, -3)


def _messages_sql() -> str:
    side = lambda t, w: " + ".join(f"({x}) * {t}.q[{i + 1}]" for i, x in enumerate(w))
    rows = ", ".join(f"greatest(0, {side('o', _OWN[j])} + {side('a', _ALONG_R[j])} + {side('b', _ALONG_S[j])} + ({b}))::DOUBLE AS h{j}" for j, b in enumerate(_BIAS))
    quarters = "qs AS (SELECT img_id, e % 2 * 4 + e // 2 AS g, y // 16 * 2 + x // 16 AS k, sum(CASE WHEN gray >= 100 THEN 1 ELSE 0 END) AS n FROM d8 GROUP BY ALL), q AS MATERIALIZED (SELECT img_id, g, list(n ORDER BY k) AS q FROM qs GROUP BY img_id, g)"
    h = f"h AS (SELECT o.img_id, {rows} FROM q o JOIN q a ON a.img_id = o.img_id AND a.g = o.g // 4 * 4 + (o.g + 1) % 4 JOIN q b ON b.img_id = o.img_id AND b.g = 4 - o.g // 4 * 4 + (4 - o.g % 4) % 4)"
    return with_(_D4, quarters, h, select="SELECT img_id, CAST(0 AS INTEGER) AS pos, avg(h0) AS v FROM h GROUP BY img_id UNION ALL SELECT img_id, 1, avg(h1) FROM h GROUP BY img_id")


@query("cayley_messages", _messages_sql())
def cayley_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step of messages over the orbit of an image's four quarters, and the mean over the group."""
    own = images(spark, sf_dir).withColumn("gray", planes.gray_u8(*rgb()))
    quarters = lambda e: F.transform(stats.grid(boards.at_least(symmetry.moved(F.col("gray"), e), 100), 2), lambda v: v.cast("double"))
    orbit = own.select("img_id", cayley.by_rotation(F.array(*[quarters(e) for e in range(8)])).alias("o"))
    out = orbit.select("img_id", cayley.pooled(cayley.layer(F.col("o"), _OWN, _ALONG_R, _ALONG_S, _BIAS)).alias("f"))
    return out.select("img_id", F.posexplode("f").alias("pos", "v"))


_TABLEAU = "b AS (SELECT vec_id, list_transform(embedding, lambda v: CASE WHEN v > 0 THEN 1 ELSE 0 END) AS b FROM embeddings), t0 AS (SELECT vec_id, b[1:32] AS x, b[33:64] AS z, 0 AS p FROM b)"


def _tableau_sql() -> str:
    """Lists of bits, gate by gate."""
    parts, put = [_TABLEAU], lambda k, q, v: f"list_concat({k}[1:{q}], [{v}], {k}[{q + 2}:32])"
    for i, (gate, q) in enumerate(_GATES):
        x, z = f"x[{q + 1}]", f"z[{q + 1}]"
        new = (put("x", q, z), put("z", q, x)) if gate == "h" else ("x", put("z", q, f"xor({x}, {z})"))
        parts.append(f"t{i + 1} AS (SELECT vec_id, {new[0]} AS x, {new[1]} AS z, xor(p, {x} & {z}) AS p FROM t{i})")
    number = lambda k: f"CAST(list_sum(list_transform(range(32), lambda i: {k}[i + 1]::BIGINT << i)) AS BIGINT)"
    return "WITH " + ",\n".join(parts) + f"\nSELECT vec_id, {number('x')} AS x, {number('z')} AS z, CAST(p AS INTEGER) AS phase FROM t{len(_GATES)}"


_GATES = (("h", 3), ("s", 3), ("s", 5), ("h", 5), ("h", 3), ("s", 31), ("h", 0), ("s", 5))


@query("tableau_gates", _tableau_sql())
def tableau_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates on stabiliser rows made of the signs of the embeddings."""
    bits = lambda start: total(F.transform(F.slice("embedding", start, 32), lambda v, i: F.when(v > 0, left(F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", bits(1).alias("x"), bits(33).alias("z"), F.lit(0).alias("phase"))
    for gate, qubit in _GATES:
        rows = (tableau.hadamard if gate == "h" else tableau.phase)(rows, qubit)
    return rows


# ---- forms over bits


@query("z2_quadratic", with_(M100, "bl AS (SELECT img_id, y // 2 AS by, x // 2 AS bx, sum(v) AS n FROM m GROUP BY ALL)", select="SELECT img_id, CAST(sum((n * (n - 1) // 2) % 2) AS BIGINT) AS odd FROM bl GROUP BY img_id"))
def z2_quadratic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form that adds all products of two different bits of a 2 by 2 block, over GF(2): odd blocks."""
    cells = stats.grid(F.col("m"), 16)
    return gray100(spark, sf_dir).select("img_id", total(F.transform(cells, lambda n: F.floor(n * (n - 1) / 2) % 2)).alias("odd"))


_TWO = "two AS (SELECT img_id, CASE WHEN gray >= 100 THEN 1 ELSE 0 END AS a, CASE WHEN sat >= 60 THEN 1 ELSE 0 END AS b, CASE WHEN rg >= 20 THEN 1 ELSE 0 END AS c FROM px)"


def _three(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = images(spark, sf_dir)
    return own.select("img_id", boards.at_least(planes.gray_u8(*rgb()), 100).alias("a"), boards.at_least(planes.saturation(*rgb()), 60).alias("b"), boards.at_least(planes.opponent_rg(*rgb()[:2]), 20).alias("c"))


@query("quad_pairs", with_(_TWO, select="SELECT img_id, CAST(sum(a * b) AS BIGINT) AS both, CAST(sum(x) AS BIGINT) AS either, CAST(sum(a) % 2 AS BIGINT) AS parity FROM (SELECT img_id, a, b, CASE WHEN a = b THEN 0 ELSE 1 END AS x FROM two) GROUP BY img_id"))
def quad_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.zip_with("a", "b", lambda x, y: x.bitwiseAND(y))
    either = F.zip_with("a", "b", lambda x, y: x.bitwiseXOR(y))
    return _three(spark, sf_dir).select("img_id", stats.count(both).alias("both"), stats.count(either).alias("either"), (stats.count(F.col("a")) % 2).alias("parity"))


@query("local_cubic", with_(_TWO, select="SELECT img_id, CAST(sum(a * b * c) AS BIGINT) AS n FROM two GROUP BY img_id"))
def local_cubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.zip_with("a", "b", lambda x, y: x.bitwiseAND(y))
    return _three(spark, sf_dir).select("img_id", stats.count(F.zip_with(both, "c", lambda x, y: x.bitwiseAND(y))).alias("n"))


@query("cayley_knn", with_(_D4_GRID, "t AS MATERIALIZED (SELECT * FROM d4g WHERE e = 0 AND img_id % 50 = 0), ds AS (SELECT t.img_id AS query, o.img_id, o.e, sum((t.n - o.n) * (t.n - o.n)) AS d FROM t JOIN d4g o ON o.pos = t.pos AND o.img_id <> t.img_id GROUP BY ALL)", select="SELECT query, CAST(min(d) AS BIGINT) AS distance FROM ds GROUP BY query"))
def cayley_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each query (ids divisible by 50) the least distance to another image in any of its eight forms."""
    return _neighbours(spark, sf_dir, 1).select("query", F.col("distance").cast("bigint").alias("distance"))


_NEIGHBOURS = """t AS MATERIALIZED (SELECT * FROM d4g WHERE e = 0 AND img_id % 50 = 0), ds AS (SELECT t.img_id AS query, o.img_id AS id, o.e, sum((t.n - o.n) * (t.n - o.n)) AS d FROM t JOIN d4g o ON o.pos = t.pos AND o.img_id <> t.img_id GROUP BY ALL),
dm AS (SELECT query, id, min(d) AS d FROM ds GROUP BY ALL), nb AS MATERIALIZED (SELECT dm.*, label, row_number() OVER (PARTITION BY query ORDER BY d, id) AS rank FROM dm JOIN img ON img.img_id = dm.id QUALIFY rank <= 5)"""


def _neighbours(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """The ``k`` nearest images of each query (ids divisible by 50), in any of their eight forms."""
    own = batches.map_images(images(spark, sf_dir), batches.orbit_grid_kernel(100), "f", LongType())
    orbit = F.transform(indexes(8), lambda e: F.slice("f", e * 64 + 1, 64))
    rows = own.select(F.col("img_id").alias("id"), "label", orbit.alias("orbit"))
    return neighbours.nearest_orbits(rows, rows.where("id % 50 = 0").select(F.col("id").alias("query"), F.get("orbit", 0).alias("q")), k)


@query("cayley_neighbours", with_(_D4_GRID, _NEIGHBOURS, select="SELECT query, CAST(rank AS INTEGER) AS rank, id, CAST(d AS BIGINT) AS distance, label FROM nb"))
def cayley_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir).withColumn("distance", F.col("distance").cast("bigint"))


@query("cayley_vote", with_(_D4_GRID, _NEIGHBOURS, "vt AS (SELECT query, label, count(*) AS n, min(rank) AS f FROM nb GROUP BY ALL)", select="SELECT query, arg_max(label, n * 100 - f) AS label FROM vt GROUP BY query"))
def cayley_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.vote(_neighbours(spark, sf_dir))


@query("z2_forms", with_(M100, """mp AS MATERIALIZED (SELECT img_id, y * 32 + x AS i, v FROM m), ml AS MATERIALIZED (SELECT img_id, list(v ORDER BY i) AS l FROM mp GROUP BY img_id),
en AS MATERIALIZED (SELECT 0 AS form, i, (5 * i + 7) % 1024 AS j FROM range(1024) t(i) UNION ALL SELECT 1, i, (i + 33) % 1024 FROM range(1024) t(i) UNION ALL SELECT 1, i, (i + 1) % 1024 FROM range(1024) t(i) UNION ALL SELECT 2, i, (i * i + 3) % 1024 FROM range(1024) t(i)),
qd AS (SELECT img_id, form, sum(l[i + 1] * l[j + 1]) AS n FROM ml CROSS JOIN en GROUP BY ALL),
ln AS (SELECT img_id, form, sum(CASE WHEN i % (form + 3) = 0 THEN v ELSE 0 END) AS n FROM mp CROSS JOIN (SELECT unnest(range(3)) AS form) GROUP BY ALL)""", select="SELECT qd.img_id, CAST(qd.form AS BIGINT) AS form, CAST((qd.n + ln.n + qd.form % 2) % 2 AS INTEGER) AS value FROM qd JOIN ln ON ln.img_id = qd.img_id AND ln.form = qd.form"))
def z2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three forms with some 1,000 to 2,000 entries, a linear part and a constant each, on the mask gray >= 100."""
    i = spark.range(1024).withColumnRenamed("id", "i")
    entry = lambda form, j: i.select(F.lit(form).cast("bigint").alias("form"), "i", (j % 1024).alias("j"))
    entries = entry(0, 5 * F.col("i") + 7).unionByName(entry(1, F.col("i") + 33)).unionByName(entry(1, F.col("i") + 1)).unionByName(entry(2, F.col("i") * F.col("i") + 3))
    each = spark.range(3).withColumnRenamed("id", "form")
    linear = each.crossJoin(i).where(F.col("i") % (F.col("form") + 3) == 0)
    bank = forms.quadratic_forms(entries, linear, each.withColumn("c", F.col("form") % 2))
    return forms.form_values(gray100(spark, sf_dir).select("img_id", "m"), bank).select("img_id", "form", "value")


_PASSES = {"life": (morphology.life, _LIFE), "dilation": (morphology.dilate8, _DILATE), "erosion": (morphology.erode8, _ERODE)}


def _orders_sql() -> str:
    parts, made = [], {(): "m"}
    orders = [()]
    for _ in _PASSES:
        orders = [(*o, p) for o in orders for p in _PASSES if p not in o]
        for o in orders:
            made[o] = "p_" + "_".join(o)
            parts.append(after(made[o[:-1]], _PASSES[o[-1]][1], made[o]))
    each = " UNION ALL ".join(f"SELECT '{'>'.join(o)}' AS o, img_id, label, sum(v) AS n FROM {made[o]} GROUP BY img_id, label" for o in orders)
    parts.append(f"al AS MATERIALIZED ({each}), lb AS (SELECT o, label, count(*) AS k, avg(n) AS mu, var_pop(n) AS var FROM al GROUP BY o, label), wm AS (SELECT o, sum(k * mu) / sum(k) AS m FROM lb GROUP BY o)")
    parts.append("sc AS (SELECT o, CASE WHEN sum(k * (mu - m) * (mu - m)) + sum(k * var) > 0 THEN sum(k * (mu - m) * (mu - m)) / (sum(k * (mu - m) * (mu - m)) + sum(k * var)) ELSE 0 END AS s FROM lb JOIN wm USING (o) GROUP BY o)")
    return with_(M100, *parts, select='SELECT o AS "order", round(s, 6) AS score, row_number() OVER (ORDER BY round(s, 12) DESC, o) = 1 AS best FROM sc')


@query("phase_order", _orders_sql())
def phase_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which order of three passes over the mask parts the labels best."""
    found = passes.search_order(gray100(spark, sf_dir).select("label", "m"), {k: f for k, (f, _) in _PASSES.items()})
    return found.select("order", F.round("score", 6).alias("score"), "best")


@query("kept_columns_full")
def kept_columns_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the 3,872 values of whole vectors vary and are not told by an earlier one."""
    return scaling.kept_columns(Featurizer().features(images(spark, sf_dir)))


@query("dce_columns", with_(_VEC, select="SELECT CAST(pos AS INTEGER) AS pos FROM vec GROUP BY pos HAVING var_pop(x) <= 1e-8"))
def dce_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions that never change."""
    m = scaling.moments(vectors(spark, sf_dir))
    return m.where(scaling.variance(F.col("m2"), F.col("n")) <= 1e-8).select("pos")


@query("cse_columns", with_(_VEC, "c AS (SELECT a.pos AS a, b.pos AS b, corr(a.x, b.x) AS r FROM vec a JOIN vec b ON a.img_id = b.img_id AND a.pos < b.pos GROUP BY a.pos, b.pos)", select="SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, round(r, 6) AS r FROM c WHERE NOT isnan(r) AND abs(r) > 0.1"))
def cse_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions that tell much the same."""
    return scaling.correlated(vectors(spark, sf_dir), limit=0.1).select("a", "b", F.round("r", 6).alias("r"))


_PRODUCTS = "pr AS (SELECT img_id, pos, CAST(x AS BIGINT) AS v FROM vec UNION ALL SELECT a.img_id, 65 + a.pos * 65 + b.pos, CAST(a.x * b.x AS BIGINT) FROM vec a JOIN vec b ON a.img_id = b.img_id AND a.pos <= b.pos)"


@query("quadratic_ir", with_(_VEC, _PRODUCTS, select=_AS_TEXT.format(t="pr")))
def quadratic_ir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values and all their products, each pair once."""
    d = F.size("f")
    products = F.flatten(F.transform("f", lambda v, i: F.transform(F.slice("f", i + 1, d - i), lambda w: v * w)))
    return joined(vectors(spark, sf_dir).withColumn("f", F.concat("f", products)))


@query("pass_entropy", with_(M100, _WINDOWS, f"tr AS ({dense('SELECT img_id, 2*a + b AS code FROM w2 WHERE x < 31', 4)})", select="SELECT img_id, round(-sum(CASE WHEN v > 0 THEN v / 992.0::DOUBLE * log2(v / 992.0::DOUBLE) ELSE 0 END), 6) AS bits FROM tr GROUP BY img_id"))
def pass_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.transform(F.slice(stats.transition_histogram(F.col("m")), 1, 4), lambda v: v / F.lit(992.0))
    bits = total(F.transform(p, lambda v: F.when(v > 0, -v * F.log2(v)).otherwise(0.0)), F.lit(0.0))
    return gray100(spark, sf_dir).select("img_id", F.round(bits, 6).alias("bits"))
