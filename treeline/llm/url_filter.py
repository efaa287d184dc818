"""URL filter: rules first, and for the rest trust and distrust along the host graph.

Hosts link to hosts where a page of one names an absolute address of the other.
Trust is a personalised PageRank from the hosts that allow rules cover; distrust
is the same on reversed edges from the hosts that block rules cover, since who
links to bad hosts is suspect. A seed's weight is the share of its pages under
such rules. Values are in units of a whole seed: each seed gives its weight once
and no mass returns to the seeds, so hosts without a path to a host do not bear on
it. A host is blocked when its distrust reaches ``least`` and exceeds ``ratio``
times its trust.

Both walks run as one table of (kind, host, value), joined with the edges and
summed in every round, until no host's value changes by ``tolerance`` of itself or
after ``rounds``, so mass goes at most ``rounds`` links far.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path: what follows up to ``?``, ``#`` or the end. A null url and one
without ``://`` have neither, fit no rule, and are judged as the host ''. A rule
fits its host and all subdomains where the path starts with the rule's; the
longest rule wins (host and path together), block before allow at equal length.
Null html has no links, links of a host to itself do not count, repeated rows
count as pages of their own. Without pages there are no rows. Rules are a list
that people write; it becomes one expression.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from treeline.llm.skew import for_every_salt, hot_keys, salted
from treeline.llm.store import stored

DAMPING, ROUNDS, TOLERANCE, RATIO, LEAST = 0.85, 20, 1e-4, 2.0, 0.25
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?is)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s<>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    known = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(known, _URL, 1), _UPPER, _LOWER), F.regexp_extract(known, _URL, 2)


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """``rule, verdict`` of the longest fitting rule, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r.verdict == "block")):  # longest last
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        named = F.struct(F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, named).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, links`` between different hosts, of ``pages (host, html)``."""
    target = F.explode_outer(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)))
    found = pages.select(F.col("host").alias("src"), target.alias("found"))
    return found.select("src", F.translate("found", _UPPER, _LOWER).alias("dst")).where(
        "dst is not null and dst <> src and src <> ''"
    ).groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(
    seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE,
    returning: bool = True,
) -> DataFrame:
    """``kind, host, value`` of the walks from ``seeds (kind, host, seed)`` over ``edges (kind, src, dst, share)``.

    ``share`` sums to 1 over the edges of a host. ``returning``: mass that no edge takes on goes
    back to the seeds of its kind, and values of a kind sum to the sum of its seeds.
    """
    sums = seeds.groupBy("kind").agg(F.sum("seed").alias("total"))
    totals = {r["kind"]: r["total"] for r in sums.collect()} if returning else {}
    ranks = seeds.select("kind", "host", F.col("seed").alias("value"))
    for _ in range(rounds if not edges.isEmpty() else 0):
        moved = edges.join(ranks.withColumnRenamed("host", "src"), ["kind", "src"]).groupBy("kind", "dst").agg(
            (F.sum(F.col("value") * F.col("share")) * damping).alias("flow")
        ).select("kind", F.col("dst").alias("host"), "flow")
        moved = stored(moved, "flow")
        back = F.lit(0.0 if returning else 1.0)
        flows = moved.groupBy("kind").agg(F.sum("flow").alias("flow"))
        flow = {r["kind"]: r["flow"] for r in flows.collect()} if returning else {}
        for kind, total in totals.items():  # trust and distrust
            rest = 1 - flow.get(kind, 0.0) / total if total else 0.0
            back = F.when(F.col("kind") == kind, F.lit(rest)).otherwise(back)
        value = F.coalesce("flow", F.lit(0.0)) + F.coalesce("seed", F.lit(0.0)) * back
        new = stored(moved.join(seeds, ["kind", "host"], "full").select("kind", "host", value.alias("value")), "ranks")
        was = ranks.withColumnRenamed("value", "was")
        now, then = F.coalesce("value", F.lit(0.0)), F.coalesce("was", F.lit(0.0))
        change = new.join(was, ["kind", "host"], "full").where((now > 0) | (then > 0)).agg(
            F.max(F.abs(now - then) / F.greatest(now, then))
        ).first()[0]
        ranks = new
        if change is None or change < tolerance:
            break
    return ranks


def judge_urls(pages: DataFrame, rules: Sequence[Rule], ratio: float = RATIO, least: float = LEAST, **walk) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` of every row of ``pages (page_id, url, html)``."""
    host, path = url_parts(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    ruled = parsed.withColumn("found", best_rule(F.col("host"), F.col("path"), rules))
    slim = stored(ruled.select("page_id", "host", "path", "found.rule", "found.verdict"), "urls")
    edges = stored(host_edges(parsed), "host-edges")
    counted = slim.groupBy("host").agg(
        F.count("*").alias("pages"), F.count_if(F.col("verdict") == "allow").alias("allowed"),
        F.count_if(F.col("verdict") == "block").alias("blocked"),
    )
    kinds = F.explode(F.array(
        F.struct(F.lit("trust").alias("kind"), (F.col("allowed") / F.col("pages")).alias("seed")),
        F.struct(F.lit("distrust").alias("kind"), (F.col("blocked") / F.col("pages")).alias("seed")),
    ))
    seeds = stored(counted.select("host", kinds.alias("k")).select("k.kind", "host", "k.seed").where("seed > 0"), "seeds")
    both = edges.withColumn("kind", F.lit("trust")).unionByName(edges.select(
        F.col("dst").alias("src"), F.col("src").alias("dst"), "links", F.lit("distrust").alias("kind")
    ))
    out = both.groupBy("kind", "src").agg(F.sum("links").alias("out"))
    shares = stored(both.join(out, ["kind", "src"]).select(
        "kind", "src", "dst", (F.col("links") / F.col("out")).alias("share")
    ), "edge-shares")
    values = propagate(seeds, shares, returning=False, **walk).groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("value"))).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("value"))).alias("distrust"),
    )
    hot = hot_keys(slim, "host")
    joined = salted(slim, "host", hot, "page_id", "path").join(
        for_every_salt(values, "host", hot), ["host", "salt"], "left"
    )
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    own = F.when((distrust >= least) & (distrust > trust * ratio), F.lit("block")).otherwise(F.lit("allow"))
    return joined.select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"),
        trust.alias("trust"), distrust.alias("distrust"),
    )
