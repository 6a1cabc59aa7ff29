"""URL verdicts by rules, and for the rest by trust and distrust propagated over links between hosts.

DataFrame functions only. Hosts whose pages the rules allow are trusted seeds, those whose pages they block are
distrusted ones, each by the share of its pages. Trust flows along links (personalised PageRank: a page that a
trusted host links to gains), distrust against them (a host that links to a blocked one gains). A host whose
distrust exceeds its trust by the threshold is blocked. Links are counted per pair of hosts before anything is
joined, so that an iteration handles at most a row per pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, store

DAMPING, ROUNDS, THRESHOLD = 0.85, 12, 0.25
#: Rounds between written ranks, which keep the plan short.
STORED = 4
Rule = tuple[str, str, str]


def host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched(rules: list[Rule], of_host: Column, of_path: Column) -> tuple[Column, Column]:
    """The longest fitting rule, as text, and its verdict; null without one. Of equally long ones block wins. rules: verdict, host, path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((of_host == h) | F.endswith(of_host, F.lit("." + h))) & F.startswith(of_path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def links(pages: DataFrame) -> DataFrame:
    """source, target, n: links between different hosts. Relative links stay on their host and count for nothing."""
    targets = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?i)href\s*=\s*[\"']?(?:https?:)?//([^/?#\"'>\s:]+)"), F.lit(1))
    pairs = pages.select(host(F.col("url")).alias("source"), F.explode(targets).alias("target"))
    pairs = pairs.withColumn("target", ascii_lower(F.col("target"))).where((F.col("source") != "") & (F.col("source") != F.col("target")))
    return pairs.groupBy("source", "target").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """edges: source, target, n. seeds: host, seed. Returns host, rank: what rests at each host, on the seeds' scale."""
    out = edges.groupBy("source").agg(F.sum("n").alias("all"))
    shares = store(edges.join(out, "source").select("source", "target", (F.col("n") / F.col("all")).alias("share")), "shares")
    base = seeds.select("host", ((1 - damping) * F.col("seed")).alias("rank"))
    if shares.isEmpty():
        return base.select("host", (F.col("rank") / (1 - damping)).alias("rank"))
    ranks = base
    for i in range(rounds):
        flow = ranks.join(shares, ranks["host"] == shares["source"]).select(F.col("target").alias("host"), (damping * F.col("rank") * F.col("share")).alias("rank"))
        ranks = flow.union(base).groupBy("host").agg(F.sum("rank").alias("rank"))
        if i % STORED == STORED - 1:
            ranks = store(ranks, "ranks")
    return ranks.select("host", (F.col("rank") / (1 - damping)).alias("rank"))


def judge(pages: DataFrame, rules: list[Rule], threshold: float = THRESHOLD) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    host: between the first `://` and `/`, `?`, `#` or the end, A-Z in lower case; path: what follows up to `?`
    or `#`. Both are empty for null urls and those without `://`, which no rule fits and which are allowed. A
    rule covers its host and all subdomains where the path starts with its own. Hosts without rules or links
    are allowed. Repeated rows each count as a page. Empty table: no rows. Other columns are not read.
    """
    own = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = matched(rules, F.col("host"), F.col("path"))
    own = own.withColumn("rule", rule).withColumn("by_rule", verdict)
    share = lambda v: F.avg(F.when(F.col("by_rule") == v, 1.0).otherwise(0.0))
    seeds = store(own.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust")), "seeds")
    edges = store(links(pages), "links")
    against = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "n")
    trust = propagate(edges, seeds.select("host", F.col("trust").alias("seed"))).withColumnRenamed("rank", "trust")
    distrust = propagate(against, seeds.select("host", F.col("distrust").alias("seed"))).withColumnRenamed("rank", "distrust")
    hosts = trust.join(distrust, "host", "full")
    judged = own.join(hosts, "host", "left").select("page_id", "host", "path", "rule", "by_rule", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    by_host = F.when(F.col("distrust") - F.col("trust") > threshold, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_host).alias("verdict"), "trust", "distrust")
