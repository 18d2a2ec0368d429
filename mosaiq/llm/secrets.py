"""Secret scans: a trigram inverted index finds the texts that a rule can match; only those are searched."""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import cut, small


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` count if the group (0: all) has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE


def _alternatives(tree, most: int) -> list[tuple[str, ...]]:
    """Literal runs that a match must hold, one tuple for each way to match; the last run is still open."""
    ways: list[tuple[str, ...]] = [("",)]
    for op, arg in tree:
        if op is sre.LITERAL:
            nexts = [(chr(arg),)]
        elif op is sre.SUBPATTERN:
            nexts = _alternatives(arg[3], most)
        elif op is sre.BRANCH:
            nexts = [w for x in arg[1] for w in _alternatives(x, most)]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[:2] == (0, 1):
            nexts = [("",), *_alternatives(arg[2], most)]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] == arg[1] and arg[0] * len(arg[2]) <= 16:
            nexts = _alternatives(list(arg[2]) * arg[0], most)
        else:
            nexts = [("", "")]
        ways = [(*w[:-1], w[-1] + n[0], *n[1:]) for w in ways for n in nexts]
        if len(ways) > most:
            return [("", "")]
    return ways


def trigram_query(pattern: str, most: int = 64) -> list[frozenset[str]] | None:
    """The query of a regex over lower-case trigrams: it can match only where all trigrams of one of
    these sets occur. None if some way to match has no trigram that must occur."""
    ways = {frozenset(r[i : i + 3].lower() for r in w for i in range(len(r) - 2)) for w in _alternatives(_parser.parse(pattern), most)}
    ways = {w for w in ways if not any(v < w for v in ways)}
    return None if frozenset() in ways else sorted(ways, key=sorted)


def postings(docs: DataFrame, trigrams: list[str], text: str = "text") -> DataFrame:
    """The inverted index: (trigram, key) for each of ``trigrams``, by its place in the list, and each
    text with it; key is a hash of the text."""
    low = F.lower(F.col(text))
    held = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))
    return docs.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("key"), F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> tuple[DataFrame | None, list[int]]:
    """(key, rules): bit r is set if rule r can match the text; and the rules without a query. For each set
    of a query the postings of its trigrams are intersected: a text must be in all of them."""
    spark = docs.sparkSession
    queries = [trigram_query(r.pattern) for r in rules]
    whole = [i for i, q in enumerate(queries) if q is None]
    wanted = sorted({t for q in queries for ways in q or () for t in ways})
    if not wanted:
        return None, whole
    terms = [(wanted.index(t), r, w, 1 << k, (1 << len(ways)) - 1) for r, q in enumerate(queries) for w, ways in enumerate(q or ()) for k, t in enumerate(sorted(ways))]
    terms_df = F.broadcast(spark.createDataFrame(terms, "trigram int, rule int, way int, bit long, full long"))
    met = postings(docs, wanted, text).join(terms_df, "trigram").groupBy("key", "rule", "way").agg(F.bit_or("bit").alias("bits"), F.max("full").alias("full"))
    one = F.element_at(F.array(*[F.lit(1 << r) for r in range(len(rules))]), F.col("rule") + 1)
    return met.where("bits = full").groupBy("key").agg(F.bit_or(one.cast("long")).alias("rules")), whole


def matches(body: Column, rule: Rule, order: int) -> Column:
    """All matches of a rule in a text, from left to right: array of (start, order, kind, end, secret),
    in code points, end exclusive."""
    pattern = F.lit(rule.pattern)
    found, between = F.regexp_extract_all(body, pattern, 0), F.split(body, rule.pattern, -1)
    held = F.regexp_extract_all(body, pattern, rule.group) if rule.group else found
    steps = F.arrays_zip(found.alias("m"), F.slice(between, 1, F.size(found)).alias("b"), held.alias("g"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        one = F.struct(start.alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.length(x["g"]) >= rule.least, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    none = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")
    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: every span of every rule, by start and then in the order of the rules. A
    null or empty text has none; equal texts and repeated rows have the same, each row its own; no rows give none; a column ``secrets`` is replaced, and columns
    ``_secret_key`` and ``_secret_rules`` are dropped. Whole
    texts are searched, but by a rule with a trigram query only where the index allows a match. The
    index's answer is broadcast if its counted size is small, else joined by a shuffle."""
    docs = docs.drop("_secret_key", "_secret_rules")
    may, whole = candidates(docs, rules, text)
    none = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")
    body = F.col(text)
    full = docs
    if may is not None:
        may = cut(may).select(F.col("key").alias("_secret_key"), F.col("rules").alias("_secret_rules"))
        full = docs.join(small(may, 48), F.xxhash64(body) == F.col("_secret_key"), "left")
    full = full.withColumn("_secret_rules", F.coalesce(F.col("_secret_rules"), F.lit(0).cast("long")) if may is not None else F.lit(0).cast("long"))
    each = []
    for i, rule in enumerate(rules):
        try_it = body.rlike(rule.pattern) if i in whole else F.col("_secret_rules").bitwiseAND(F.lit(1 << i)) != 0
        each.append(F.when(body.isNotNull() & try_it, matches(body, rule, i)).otherwise(none))
    return full.withColumn("secrets", F.sort_array(F.concat(*each))).drop("_secret_key", "_secret_rules")


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(body: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets."""

    def step(acc: Column, s: Column) -> Column:
        put = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"))
        over = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["at"], put).otherwise(over)

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.when(F.size(spans) == 0, body).otherwise(F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body)))))
