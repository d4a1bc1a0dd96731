"""URL verdicts: path-scoped host rules first, then link-graph propagation between hosts.

Hosts that the rules settle are seeds. Personalised PageRank spreads trust from the trusted seeds along
links; reversed, it spreads distrust from the blocked seeds to the hosts that link to them. A host whose
distrust outweighs its trust and exceeds its threshold is blocked where no rule fits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: (host, path, verdict). A rule fits its host and subdomains, and paths that start with its path.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: Scores have settled when a round adds no more than this to all of them, or than a thousandth of the mean score.
TOLERANCE = 1e-6


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, its verdict) of the longest rule that fits, or nulls. The rule list is configuration, so it is an expression."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct links between different hosts: src, dst, n. Values of href are quoted or bare; //host/x is on the other host
    under the page's scheme. Relative links stay on their host and add nothing."""
    value = F.explode(F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(r"""(?i)href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""), F.lit(1)))
    links = pages.select(url_host(F.col("url")).alias("src"), value.alias("_to")).withColumn("_to", F.regexp_replace("_to", r"""^["'\s]+|["'\s]+$""", ""))
    links = links.where(F.col("_to").rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:)?//"))
    links = links.select("src", url_host(F.when(F.col("_to").startswith("//"), F.concat(F.lit("http:"), "_to")).otherwise(F.col("_to"))).alias("dst"))
    return links.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, follow: float = 0.85) -> DataFrame:
    """host, trust, distrust: personalised PageRank over edges from seeds (host, verdict, weight).

    Both directions run in one table keyed by (side, host): trust follows links, distrust goes against
    them. Every round is one join on the sending host and one sum by the receiving host, which combines
    before the shuffle, so a host with very many links is no single task's work. Hosts that send nothing on
    return their score to the seeds, which is the same as scaling each side's scores to a sum of one.
    Rounds go on until one adds at most tolerance to all scores together. Each adds at most `follow` of what the
    round before added, which bounds their number; it is an error if they don't settle within it.
    """
    one_way = edges.select(F.lit("allow").alias("side"), F.col("src").alias("host"), F.col("dst").alias("to"), "n")
    other = edges.select(F.lit("block").alias("side"), F.col("dst").alias("host"), F.col("src").alias("to"), "n")
    both = one_way.union(other)
    out = both.groupBy("side", "host").agg(F.sum("n").alias("total"))
    steps = materialize(both.join(out, ["side", "host"]).select("side", "host", "to", (F.col("n") / F.col("total")).alias("share")), "host-steps")
    total = seeds.groupBy(F.col("verdict").alias("side")).agg(F.sum("weight").alias("total"))
    start = F.lit(1 - follow) * F.col("weight") / F.col("total")
    jump = materialize(seeds.withColumnRenamed("verdict", "side").join(F.broadcast(total), "side").select("side", "host", start.alias("p"), F.lit(0.0).alias("was")), "host-seeds")
    rank, most = jump, math.ceil(math.log(tolerance / 2) / math.log(follow)) + 8
    for k in range(most):
        sent = rank.join(steps, ["side", "host"]).select("side", F.col("to").alias("host"), (F.lit(follow) * F.col("p") * F.col("share")).alias("p"), F.lit(0.0).alias("was"))
        held = rank.select("side", "host", F.lit(0.0).alias("p"), F.col("p").alias("was"))
        rank = materialize(sent.unionByName(jump).unionByName(held).groupBy("side", "host").agg(F.sum("p").alias("p"), F.sum("was").alias("was")), f"host-rank-{k}")
        if (rank.agg(F.sum(F.abs(F.col("p") - F.col("was"))).alias("d")).first()["d"] or 0.0) <= tolerance:
            break
    else:
        raise RuntimeError(f"host scores did not settle in {most} rounds")
    side = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("p"))), F.lit(0.0))
    sums = rank.groupBy("side").agg(F.sum("p").alias("sum"))  # two rows
    rank = rank.join(F.broadcast(sums), "side").withColumn("p", F.col("p") / F.col("sum"))
    return rank.groupBy("host").agg(side("allow").alias("trust"), side("block").alias("distrust"))


def url_verdicts(pages: DataFrame, rules=RULES, tolerance: float = TOLERANCE, threshold: float = 2.0) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust; one row per input row.

    A null url, or one without "://", has host and path '', no rule, and is allowed: no host speaks
    against it. A host is a seed of the side that settles at least half of its pages; for that an empty
    path stands for the root. A page no rule
    fits is blocked if its host's distrust exceeds threshold times its trust and the mean score of
    all hosts. Null html has no links; repeated rows stay; an empty table gives an empty result.
    """
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, said = matched_rule(F.col("host"), F.col("path"), rules)
    judged = parts.select("page_id", "host", "path", rule.alias("rule"), said.alias("said"))
    _, settled = matched_rule(F.col("host"), F.when(F.col("path") == "", "/").otherwise(F.col("path")), rules)
    by_host = materialize(
        parts.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(settled == "allow").alias("allow"), F.count_if(settled == "block").alias("block")), "hosts"
    )
    seeds = by_host.select("host", F.when(2 * F.col("block") >= F.col("n"), "block").when(2 * F.col("allow") >= F.col("n"), "allow").alias("verdict"), F.greatest("allow", "block").alias("weight")).where("verdict is not null")
    mean = 1.0 / max(1, by_host.count())  # of scores that add up to one
    scores = propagate(materialize(host_edges(pages), "host-edges"), seeds, min(tolerance, mean / 1000))
    scores = materialize(scores, "host-scores")
    distrusted = (F.col("distrust") > threshold * F.col("trust")) & (F.col("distrust") > mean)
    return judged.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("said", F.when(distrusted, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
