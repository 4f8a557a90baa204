"""URL filter: host and path rules, and link-graph propagation for what no rule decides.

Hosts are nodes. A page links its host to every known host that an attribute of its HTML links to, and a host to the
domain it is a subdomain of. Trust is a personalised PageRank that starts at hosts with allowed pages and follows links;
distrust starts at hosts with blocked pages and follows links backwards. Mass at hosts without links returns to the
seeds, so each is a distribution over hosts; rounds go on until what moves is a negligible share. Both are compared as
ratios, whatever the number of hosts: a host with more distrust than trust is blocked.

Defined cases: a null url, or one without ://, has an empty host and path, meets no rule and is allowed by default,
as is any host that neither trust nor distrust reaches; repeated pages are judged one by one; a null html has no
links; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stored

#: The host of an attribute that holds an absolute link, with a scheme or without.
LINK = r"(?:[Hh][Rr][Ee][Ff]|[Ss][Rr][Cc]|[Aa][Cc][Tt][Ii][Oo][Nn])\s*=\s*[\"']?\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#\"'\s<>]+)"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("block", "net", "/"),
    UrlRule("allow", "example.net", "/en/"),
    UrlRule("block", "example.com", "/de/"),
    UrlRule("allow", "org", "/fr/"),
)


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rules(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """pages with host, path, rule and ruled (the rule's verdict): the longest rule that fits, or nulls."""
    fits = lambda r: ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        rule, ruled = F.when(fits(r), r.text).otherwise(rule), F.when(fits(r), r.verdict).otherwise(ruled)
    return pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumns({"rule": rule, "ruled": ruled})


def _parent(host: Column) -> Column:
    """The domain without its first label, while at least three labels are left; else null."""
    return F.when(F.size(F.split(host, r"\.")) > 3, F.regexp_extract(host, r"^[^.]*\.(.*)$", 1))


def host_edges(judged: DataFrame) -> DataFrame:
    """src, dst, weight: how many pages of src link to dst, and one more for the domain above src."""
    own = judged.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"))
    up = own.select(F.col("host").alias("src"), _parent(F.col("host")).alias("dst")).where("dst IS NOT NULL")
    hosts = own.select("host").unionByName(up.select(F.col("dst").alias("host"))).distinct()
    names = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1), _lower))
    named = judged.where("host <> ''").select(F.col("host").alias("src"), F.explode(names).alias("dst"))
    # counted before the join, so that a common pair moves as one row per task
    named = named.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))
    known = named.join(hosts.withColumnRenamed("host", "dst"), "dst", "left_semi").select("src", "dst", "weight")
    return known.unionByName(up.withColumn("weight", F.lit(1))).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def shares_of(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """rows with value as a share of its sum over by."""
    total = rows.groupBy(*by).agg(F.sum(value).alias("_total"))
    return rows.join(total, by).withColumn(name, F.col(value) / F.col("_total")).drop("_total")


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """kind, host, score: personalised PageRank of each kind, summing to 1. edges: (kind, src, dst, weight); seeds: (kind,
    host, mass). Each round moves what the last one brought; the rounds end when that is at most `tolerance` of all."""
    out = shares_of(edges, ["kind", "src"], "weight", "share").select("kind", F.col("src").alias("host"), "dst", "share")
    out = stored(out, "trust-edges")
    came = stored(shares_of(seeds, ["kind"], "mass", "score").select("kind", "host", "score"), "trust-seeds")
    every, rounds = came, math.ceil(math.log(tolerance) / math.log(damping))
    for _ in range(rounds):
        moved = came.join(out, ["kind", "host"]).groupBy("kind", F.col("dst").alias("host")).agg((damping * F.sum(F.col("score") * F.col("share"))).alias("score"))
        came = stored(moved, "trust-moved")
        left = came.groupBy("kind").agg(F.sum("score").alias("n")).agg(F.max("n")).first()[0]
        every = every.unionByName(came)
        if left is None or left <= tolerance:
            break
    # mass that a host without links would lose returns to the seeds: the same vector, scaled
    return shares_of(every.groupBy("kind", "host").agg(F.sum("score").alias("sum")), ["kind"], "sum", "score").select("kind", "host", "score")


def host_trust(judged: DataFrame, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """host, trust, distrust. Seeds weigh as many pages as rules allow or block on them."""
    edges = stored(host_edges(judged), "trust-links")
    both = edges.withColumn("kind", F.lit("allow")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", F.lit("block").alias("kind")))
    seeds = judged.where("ruled IS NOT NULL AND host <> ''").groupBy(F.col("ruled").alias("kind"), "host").agg(F.count("*").alias("mass"))
    score = propagate(both, seeds, damping, tolerance)
    part = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0))
    return score.groupBy("host").agg(part("allow").alias("trust"), part("block").alias("distrust"))


#: Distrust must exceed trust by this ratio, so that sums in another order decide alike.
MARGIN = 1e-9


def filter_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, margin: float = MARGIN, **options) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every row of pages (page_id, url, html)."""
    judged = match_rules(pages.select("page_id", "url", "html"), rules)
    trust = host_trust(judged, **options).withColumnRenamed("host", "_host")
    found = judged.drop("html").join(trust, F.col("host") == F.col("_host"), "left")
    doubted = F.coalesce(F.col("distrust") > F.col("trust") * (1 + margin), F.lit(False))
    verdict = F.coalesce("ruled", F.when(doubted, "block").otherwise("allow"))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
