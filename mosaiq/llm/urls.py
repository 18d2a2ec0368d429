"""URL filters: rules for hosts and paths, and trust propagated over the links between hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import cut, small

#: (verdict, host and path)
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(rule: str, host: Column, path: Column) -> Column:
    domain, slash, rest = rule.partition("/")
    return ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + rest)


def rule_of(rules, host: Column, path: Column) -> Column:
    """(verdict, rule) of the longest rule that fits, as a struct, or null."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        found = F.when(_fits(rule, host, path), F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """Weighted edges (src, dst, w) between hosts: links in the pages, w by how many pages have the link;
    and an edge each way between a host and its parent domain if pages come from both. The weights
    out of a host add up to 1. ``pages``: host, html."""
    link = r"(?i)\b(?:href|src)\s*=\s*[\"']?\s*((?:https?:)?//[^\s\"'<>]+)"
    links = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(link), 1), lambda u: host_of(F.concat(F.lit("x:"), F.regexp_replace(u, "(?i)^https?:", "")))))).alias("dst"))
    links = links.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))
    hosts = pages.where("host <> ''").select("host").distinct()
    parents = hosts.select("host", F.regexp_replace("host", r"^[^.]*\.", "").alias("parent")).where("host <> parent")
    family = parents.join(hosts.select(F.col("host").alias("parent")), "parent", "left_semi")
    family = family.select(F.explode(F.array(F.struct(F.col("host").alias("src"), F.col("parent").alias("dst")), F.struct(F.col("parent").alias("src"), F.col("host").alias("dst")))).alias("e")).select("e.src", "e.dst", F.lit(1).cast("long").alias("w"))
    both = links.unionByName(family).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    out = both.groupBy("src").agg(F.sum("w").alias("total"))
    return both.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("w"))


def both_ways(links: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, trust_w, distrust_w) over ``hosts`` and all hosts in ``links``, those without a page too: trust goes along
    a link, distrust back; what goes out of a host in either way adds up to 1. Where nothing does, the
    host keeps its own."""
    back = links.groupBy("dst").agg(F.sum("w").alias("s"))
    away = links.join(back, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0).alias("trust_w"), (F.col("w") / F.col("s")).alias("distrust_w"))
    along = links.select("src", "dst", F.col("w").alias("trust_w"), F.lit(0.0).alias("distrust_w"))
    own = hosts.select("host").unionByName(links.select(F.explode(F.array("src", "dst")).alias("host"))).distinct()
    every = along.unionByName(away).unionByName(own.select(F.col("host").alias("src"), F.col("host").alias("dst"), F.lit(0.0).alias("trust_w"), F.lit(0.0).alias("distrust_w")))
    sums = every.groupBy("src", "dst").agg(F.sum("trust_w").alias("trust_w"), F.sum("distrust_w").alias("distrust_w"))
    left = every.groupBy("src").agg((F.sum("trust_w") == 0).alias("t"), (F.sum("distrust_w") == 0).alias("d"))
    own = F.col("src") == F.col("dst")
    return cut(sums.join(left, "src").select("src", "dst", F.when(own & F.col("t"), 1.0).otherwise(F.col("trust_w")).alias("trust_w"), F.when(own & F.col("d"), 1.0).otherwise(F.col("distrust_w")).alias("distrust_w")).where("trust_w + distrust_w > 0"))


def propagate(edges: DataFrame, seeds: DataFrame, steps: int = 20, damping: float = 0.85, every: int = 5) -> DataFrame:
    """Personalised PageRank for trust and for distrust at once: (host, trust, distrust). ``seeds`` (host, trust,
    distrust; each adds up to 1), ``edges`` (src, dst, trust_w, distrust_w). Hosts that nothing leaves must
    have an edge to themselves. The edges are broadcast if their counted size is small, else joined
    by a shuffle; the state is written to stable storage after every few steps."""
    back = seeds.select("host", ((1 - damping) * F.col("trust")).alias("trust"), ((1 - damping) * F.col("distrust")).alias("distrust"))
    state, links = seeds, small(edges, 96)
    for step in range(1, steps + 1):
        moved = state.join(links, state["host"] == links["src"]).select(F.col("dst").alias("host"), (damping * F.col("trust") * F.col("trust_w")).alias("trust"), (damping * F.col("distrust") * F.col("distrust_w")).alias("distrust"))
        state = moved.unionByName(back).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        if step % every == 0 or step == steps:
            state = cut(state)
    return state


def judge_pages(pages: DataFrame, rules=RULES, steps: int = 20, ratio: float = 1.0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A verdict for every page: the longest rule that fits its url, else the method's. The method
    gives trust to hosts by their share of pages that rules allow, distrust by their share of pages
    that rules block; trust flows along links, distrust against them (a page that links to a blocked host
    is suspect). A host is blocked if its distrust, per seed, is above ``ratio`` times its trust.

    Null urls, and urls without ``://``, have empty host and path and are allowed, as are hosts that
    neither reaches. Repeated pages stay; an empty table gives an empty result."""
    seen = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("_url"), F.col(html).alias("html"))
    seen = seen.select("page_id", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"), "html")
    seen = seen.withColumn("found", rule_of(rules, F.col("host"), F.col("path")))
    links = cut(host_edges(seen))
    votes = cut(seen.where("host <> ''").groupBy("host").agg(F.count_if(F.col("found.verdict") == "allow").alias("a"), F.count_if(F.col("found.verdict") == "block").alias("b")))
    allowed, blocked = votes.agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    seeds = votes.select("host", (F.col("a") / max(1, allowed)).alias("trust"), (F.col("b") / max(1, blocked)).alias("distrust"))
    scores = propagate(both_ways(links, votes.select("host")), seeds, steps)
    out = seen.drop("html").join(small(scores, 64), "host", "left")
    bad = F.coalesce(F.col("distrust"), F.lit(0.0)) > ratio * F.coalesce(F.col("trust"), F.lit(0.0))
    verdict = F.coalesce(F.col("found.verdict"), F.when(bad, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
