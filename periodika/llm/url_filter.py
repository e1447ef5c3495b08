"""URL filters: rules first, then trust and distrust spread over the links between hosts.

A rule (host, path) fits its host and all subdomains where the url's path starts with the rule's; the longest rule wins,
by host and then by path. Urls without a rule are judged by their host: personalised PageRank spreads trust from the
hosts that rules allow, along links; distrust spreads from the hosts that rules block, against the links (who links to a
bad host is suspect). A host is blocked if its distrust is over ``RATIO`` times its trust and over ``LEAST`` of the mean; at
exactly that it is allowed.

Rounds go on until the ranks' summed change is below ``TOLERANCE``. Each round shrinks the change by ``DAMPING`` at least, so that
takes ``MOST_ROUNDS`` rounds at most, whatever the graph. What hosts without links would pass on goes back to the seeds; the
fixed point of that is the fixed point without them, divided by its sum, so ranks are divided by their sum at the end, and
trust and distrust each add up to 1.

Edges: absolute links in the pages, and one in both directions between a host and its parent domain, as far up as
the domains are hosts of pages or links themselves. Only DataFrame functions; ranks of each round are written to the shared folder.

Defined results: a null url, or one without ``://``, has empty host and path and is allowed (no rule, no host); null html
has no links; repeated rows are each judged and count each as a page of their host; without rules, or pages that they fit, all ranks are 0 and
every url is allowed; of rules with one host and path the first wins; a link counts as often as it occurs, in texts of any length; empty tables
give empty results; columns ``host``, ``path``, ``rule`` and ``verdict`` of the input give way to the operator's.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Saved, sized

DAMPING, TOLERANCE = 0.85, 1e-4
#: From here on the change, 2 at first, is below the tolerance.
MOST_ROUNDS = math.ceil(math.log(TOLERANCE / 2) / math.log(DAMPING))
RATIO, LEAST = 2.0, 0.01
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the contract.
RULES = [Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"), Rule("net", "/es/", "block"), Rule("net", "/fr/", "block")]


def url_host(url: str) -> Column:
    c = F.coalesce(F.col(url), F.lit(""))
    return F.translate(F.regexp_extract(c, r"^(?s:.*?)://([^/?#]*)", 1), _UPPER, _LOWER)


def url_path(url: str) -> Column:
    c = F.coalesce(F.col(url), F.lit(""))
    return F.regexp_extract(c, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the rule that wins, or null."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.host), -len(r.path))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        got = F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, got) if out is None else out.when(fits, got)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def spread(edges: DataFrame, seeds: DataFrame) -> Saved:
    """way, host and rank by personalised PageRank along edges (way, src, dst, share) from seeds (way, host, seed), for each way at once.

    The seeds of a way add up to 1, or are all 0; so do its ranks.
    """
    ranks = Saved(seeds.select("way", "host", F.col("seed").alias("rank")), "ranks")
    changed = 1.0
    while changed >= TOLERANCE:
        sent = edges.join(ranks.df.select("way", F.col("host").alias("src"), "rank").filter("rank > 0").hint("merge"), ["way", "src"])
        got = sent.groupBy("way", F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        parts = seeds.select("way", "host", ((1 - DAMPING) * F.col("seed")).alias("rank"), F.lit(0.0).alias("was"))
        parts = parts.unionByName(got.select("way", "host", (DAMPING * F.col("got")).alias("rank"), F.lit(0.0).alias("was")))
        parts = parts.unionByName(ranks.df.select("way", "host", F.lit(0.0).alias("rank"), F.col("rank").alias("was")))
        following = Saved(parts.groupBy("way", "host").agg(F.sum("rank").alias("rank"), F.sum("was").alias("was")), "ranks")
        ranks.drop()
        ranks = following
        changed = ranks.df.groupBy("way").agg(F.sum(F.abs(F.col("rank") - F.col("was"))).alias("c")).agg(F.max("c")).first()[0] or 0.0
    total = ranks.df.groupBy("way").agg(F.sum("rank").alias("total"))  # a row for each way
    out = Saved(ranks.df.join(F.broadcast(total), "way").select("way", "host", F.when(F.col("total") > 0, F.col("rank") / F.col("total")).otherwise(0.0).alias("rank")), "ranks")
    ranks.drop()
    return out


def _with_shares(edges: DataFrame) -> DataFrame:
    out = edges.groupBy("way", "src").agg(F.sum("n").alias("all"))
    return edges.join(out.hint("merge"), ["way", "src"]).select("way", "src", "dst", (F.col("n") / F.col("all")).alias("share"))


def host_verdicts(pages: DataFrame, rules: list[Rule], url: str = "url", html: str = "html") -> Saved:
    """host, trust, distrust and verdict of every host of ``pages`` and of its links."""
    judged = pages.select(url_host(url).alias("host"), matched(url_host(url), url_path(url), rules).alias("m")).filter("host <> ''")
    own = Saved(judged.groupBy("host").agg(F.count_if(F.col("m.verdict") == "allow").alias("trust"), F.count_if(F.col("m.verdict") == "block").alias("distrust")), "hosts")
    targets = F.regexp_extract_all(F.col(html), F.lit(r"""(?i)href\s*=\s*["']?(?:[a-z]+:)?//([^/?#"'<>\s]+)"""), 1)
    linked = (
        pages.filter(F.col(html).contains("//")).select(url_host(url).alias("src"), F.explode(targets).alias("dst"))
        .select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).filter("src <> '' AND src <> dst")
        .groupBy("src", "dst").agg(F.count("*").alias("n"))
    )
    linked = Saved(linked, "linked")
    names = Saved(own.df.select("host").unionByName(linked.df.select(F.col("dst").alias("host"))).distinct(), "names")
    labels = F.split("host", "[.]")
    above = names.df.select("host", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(labels))), lambda i: F.array_join(F.slice(labels, i, F.greatest(F.size(labels), F.lit(1))), "."))).alias("parent")).filter("parent <> ''")
    family = above.join(names.df.select(F.col("host").alias("parent")).hint("merge"), "parent", "left_semi").select(F.col("host").alias("src"), F.col("parent").alias("dst"), F.lit(1).cast("long").alias("n"))
    both = linked.df.unionByName(family).unionByName(family.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")).groupBy("src", "dst").agg(F.sum("n").alias("n"))
    along = Saved(both, "links")
    edges = along.df.withColumn("way", F.lit("trust")).unionByName(along.df.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n", F.lit("distrust").alias("way")))
    edges = Saved(_with_shares(edges), "edges")
    given = own.df.select("host", F.explode(F.array(*(F.struct(F.lit(w).alias("way"), F.col(w).cast("double").alias("n")) for w in ("trust", "distrust")))).alias("x")).select("host", "x.*").filter("n > 0")
    total = given.groupBy("way").agg(F.sum("n").alias("total"))  # two rows
    seeds = Saved(given.join(F.broadcast(total), "way").select("way", "host", (F.col("n") / F.col("total")).alias("seed")), "seeds")
    ranks = spread(edges.df, seeds.df)
    n = max(1, names.count())
    of = ranks.df.groupBy("host").agg(*(F.sum(F.when(F.col("way") == w, F.col("rank")).otherwise(0.0)).alias(w) for w in ("trust", "distrust")))
    bad = (F.col("distrust") > RATIO * F.col("trust")) & (F.col("distrust") > LEAST / n)
    known = names.df.join(of.hint("merge"), "host", "left").fillna(0.0, ["trust", "distrust"])
    out = Saved(known.withColumn("verdict", F.when(bad, "block").otherwise("allow")), "verdicts")
    for done in (own, linked, names, along, edges, seeds, ranks):
        done.drop()
    return out


def judge(pages: DataFrame, keep: list[str], rules: list[Rule] = RULES, url: str = "url", html: str = "html") -> DataFrame:
    """``keep`` columns of ``pages`` with host, path, rule and verdict."""
    verdicts = host_verdicts(pages, rules, url, html)
    blocked = Saved(verdicts.df.filter("verdict = 'block'").select(F.col("host").alias("__host"), F.lit("block").alias("__verdict")), "blocked")
    keep = [c for c in keep if c not in ("host", "path", "rule", "verdict")]
    verdicts.drop()
    parsed = pages.select(*keep, url_host(url).alias("host"), url_path(url).alias("path")).withColumn("__m", matched(F.col("host"), F.col("path"), rules))
    out = parsed.join(sized(blocked.df, blocked.count()), F.col("host") == F.col("__host"), "left")
    return out.select(*keep, "host", "path", F.col("__m.rule").alias("rule"), F.coalesce("__m.verdict", "__verdict", F.lit("allow")).alias("verdict"))
