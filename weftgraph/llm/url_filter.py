"""URL filter: host and path rules, and for the other pages trust and distrust that spread over the links of hosts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._tables import stored

#: Host, path, verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules: tuple) -> Column:
    """The struct (rule, verdict) of the longest rule that fits, null where none does. Longest by host and path
    together, then by host."""
    order = sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), -len(r[0]), r))
    out = None
    for h, p, verdict in order:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, weight, share): links between different hosts. weight: the share of this link among the source's links;
    share: that among the links on its pages, or weight if these have none.

    Absolute and scheme-relative href targets count once for each host pair and page; besides, a host and the
    domain it belongs to vouch for each other, as one link each.
    """
    host = host_of(F.col(url_col))
    target = F.explode(F.array_distinct(F.regexp_extract_all(F.col(html_col), F.lit(r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""), F.lit(1))))
    # Summed in each task first, so a host with a third of all links is no hot key.
    links = pages.select(host.alias("src"), target.alias("dst")).select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    links = links.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    hosts = pages.select(host.alias("src")).where("src <> ''").distinct()
    parent = hosts.select("src", F.regexp_extract("src", r"^[^.]+\.([^.]+\..+)$", 1).alias("dst")).where("dst <> ''")
    vouched = parent.unionByName(parent.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select("src", "dst", F.lit(1).alias("n"), F.lit(0).alias("on_page"))
    links = links.withColumn("on_page", F.col("n")).unionByName(vouched).groupBy("src", "dst").agg(F.sum("n").alias("n"), F.sum("on_page").alias("on_page"))
    weight = F.col("n") / F.col("total")
    share = F.when(F.col("all_on_page") > 0, F.col("on_page") / F.greatest("all_on_page", F.lit(1))).otherwise(weight)
    totals = links.groupBy("src").agg(F.sum("n").alias("total"), F.sum("on_page").alias("all_on_page"))
    return links.join(totals, "src").select("src", "dst", weight.alias("weight"), share.alias("share"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.5, tolerance: float = 1e-3) -> DataFrame:
    """(host, score): personalised PageRank, not normalised: score = (1 - damping) * seed + damping * sum of the
    shares that scores pass on along edges (src, dst, weight). seeds: (host, seed between 0 and 1). Rounds go on until what is
    left can't reach `tolerance`: each shrinks it by the factor damping."""
    base = stored(seeds.select("host", ((1 - damping) * F.col("seed")).alias("base")), "seeds")
    score = base.select("host", F.col("base").alias("score"))
    for _ in range(math.ceil(math.log(tolerance) / math.log(damping))):
        sent = score.join(edges, score["host"] == edges["src"]).select(F.col("dst").alias("host"), (damping * F.col("score") * F.col("weight")).alias("score"))
        score = stored(sent.unionByName(base.select("host", F.col("base").alias("score"))).groupBy("host").agg(F.sum("score").alias("score")), "score")
    return score


def judge_urls(pages: DataFrame, rules: tuple = RULES, threshold: float = 0.5, damping: float = 0.5, tolerance: float = 1e-3, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict) for every row.

    A page that a rule fits gets its verdict. The rules' verdicts seed the propagation: a host's trust seed is the
    share of its pages that rules allow, its distrust seed the share that they block. Trust spreads along links;
    distrust spreads against them, from a host to those that link to it, to each by the share of its own links, however many
    they are: a host is as bad as what it links to. A page without a rule is blocked if its
    host's distrust exceeds its trust by threshold * (1 - damping) at least, what a host with that share of blocked pages
    has from itself alone (at a threshold and damping of a half also one all of whose links lead to blocked hosts); else
    allowed. Both are within `tolerance` of their limits. Null and malformed urls have an empty host and path, no rule, and are
    allowed. Ids may be null or repeat; rules must not repeat a host and path.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    pages = rows.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = pages.withColumn("r", matched(F.col("host"), F.col("path"), rules)).select("id", "host", "path", "r.rule", "r.verdict")
    hosts = ruled.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("n"), F.count_if(F.expr("verdict <=> 'allow'")).alias("good"), F.count_if(F.expr("verdict <=> 'block'")).alias("bad")
    )
    hosts = stored(hosts, "hosts")
    edges = stored(host_edges(rows), "edges")
    back = edges.where("share > 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("share").alias("weight"))
    trust = propagate(edges, hosts.select("host", (F.col("good") / F.col("n")).alias("seed")), damping, tolerance)
    distrust = propagate(stored(back, "edges"), hosts.select("host", (F.col("bad") / F.col("n")).alias("seed")), damping, tolerance)
    scores = trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host", "full_outer")
    # The last digits of sums of shares don't decide.
    bad = F.coalesce("distrust", F.lit(0.0)) - F.coalesce("trust", F.lit(0.0)) >= threshold * (1 - damping) - 1e-9
    verdicts = scores.select("host", F.when(bad, "block").otherwise("allow").alias("by_host"))
    out = ruled.join(verdicts, "host", "left")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", "by_host", F.lit("allow")).alias("verdict"))
