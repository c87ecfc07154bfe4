"""URL filter: fixed rules first, link-graph propagation for the hosts that no rule decides.

Rules name a host and a path; a rule fits the host and its subdomains when the URL's path starts with the rule's, and
the longest rule wins (a block rule on equal length). For URLs without a rule the host decides. Hosts are nodes, absolute
links of their pages are edges. Trust starts at hosts in proportion to their share of pages that a rule allows and
follows links; distrust starts in proportion to the share that a rule blocks and follows links backwards. Both are
personalised PageRank with restart, in units of the restart mass (a host's own seed counts fully), and a host is blocked
when its distrust exceeds its trust by more than ``margin``.

Edges are counted per host pair before anything is joined, so a host with a third of all pages is a few rows. The
iterations go on until no score moves by more than ``tolerance`` (an error after ``most_iterations``) and are cut by reliable checkpoints.

Defined results: a null URL or one without ``://`` has an empty host and path and, with no rule to fit, is judged by the
empty host's score; null html has no links; a null page_id is passed through; repeated rows are pages of their own; an
empty table gives an empty result. Only page_id, url and html are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stavelake.llm.common import cut


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Graph:
    damping: float = 0.85
    margin: float = 0.5
    #: More iterations than this mean that the scores do not settle: an error, not a result.
    most_iterations: int = 500
    tolerance: float = 1e-4
    checkpoint_every: int = 5


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and action of the longest rule that fits; null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.action != "block"))

    def fits(rule: Rule) -> Column:
        return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)

    def first(value) -> Column:
        return reduce(lambda chain, r: chain.when(fits(r), value(r)), ordered, F.when(F.lit(False), F.lit(None).cast("string")))

    return first(lambda r: r.text), first(lambda r: r.action)


def judged(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """page_id, host, path, rule, action per page."""
    parts = pages.select(pages["page_id"], host_of(pages["url"]).alias("host"), path_of(pages["url"]).alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    return parts.select("page_id", "host", "path", rule.alias("rule"), action.alias("action"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links) between different hosts."""
    links = F.regexp_extract_all(F.coalesce(pages["html"], F.lit("")), F.lit(LINK), F.lit(1))
    found = pages.select(host_of(pages["url"]).alias("src"), F.explode_outer(links).alias("to"))
    named = found.select("src", F.translate("to", UPPER, LOWER).alias("dst")).where("src <> '' AND dst <> src")
    return named.groupBy("src", "dst").agg(F.count("*").alias("links"))


def host_scores(pages: DataFrame, per_page: DataFrame, graph: Graph) -> DataFrame:
    """(host, trust, distrust) of every host with a page or a link."""
    edges = cut(host_edges(pages))
    out = edges.groupBy("src").agg(F.sum("links").alias("all"))
    into = edges.groupBy("dst").agg(F.sum("links").alias("all"))
    steps = cut(
        edges.join(out, "src").select(F.lit("trust").alias("s_kind"), F.col("src").alias("s_from"), F.col("dst").alias("s_to"), (F.col("links") / F.col("all")).alias("part"))
        .unionByName(
            edges.join(into, "dst").select(F.lit("distrust").alias("s_kind"), F.col("dst").alias("s_from"), F.col("src").alias("s_to"), (F.col("links") / F.col("all")).alias("part"))
        )
    )
    share = lambda action: F.avg(F.when(F.col("action") == action, 1.0).otherwise(0.0))
    own = per_page.groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    seeds = cut(own.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "seed")))
    score = seeds.select("kind", "host", F.col("seed").alias("score"))
    for i in range(1, graph.most_iterations + 1):
        flow = score.join(steps, (F.col("kind") == F.col("s_kind")) & (F.col("host") == F.col("s_from"))).select(
            F.col("s_kind").alias("kind"), F.col("s_to").alias("host"), (F.col("score") * F.col("part") * graph.damping).alias("score")
        )
        base = seeds.select("kind", "host", F.col("seed").alias("score"))
        new = base.unionByName(flow).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if i % graph.checkpoint_every:
            score = new
            continue
        new = cut(new)
        last = new.join(score.withColumnRenamed("score", "old"), ["kind", "host"], "left")
        moved = last.agg(F.max(F.abs(F.col("score") - F.coalesce("old", F.lit(0.0))))).first()[0] or 0.0
        score = new
        if moved <= graph.tolerance:
            break
    else:
        raise RuntimeError(f"host scores still move after {graph.most_iterations} iterations")
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0)).alias(kind)
    return score.groupBy("host").agg(of("trust"), of("distrust"))


def filtered(pages: DataFrame, rules: tuple[Rule, ...], graph: Graph = Graph()) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust per page."""
    per_page = judged(pages, rules)
    scores = cut(host_scores(pages, per_page, graph))  # written, so that the join can split a host with very many pages
    blocked = F.coalesce(F.col("distrust") - F.col("trust") > graph.margin, F.lit(False))
    return per_page.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("action", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
