"""URL filters: rules for hosts and paths, and trust and distrust that spread over the links between hosts.

Rules decide the urls that they fit. For the rest, trust flows from the hosts of allowed urls along links and distrust
from the hosts of blocked urls against them (who links to a bad host is bad), both as personalised PageRank over
weighted host edges of mass one each; a host of whose trust and distrust more than the threshold is distrust is blocked.
Everything is Spark SQL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverloom.llm import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Share of rank that follows links, and rounds of propagation between two tests of convergence.
DAMPING, ROUNDS = 0.85, 10
#: A host is blocked where distrust is more than this share of its trust and distrust: the two kinds have equal masses,
#: so at one half a host goes where more of the blocked seeds' mass than of the trusted ones' reaches it.
THRESHOLD = 0.5
#: Ranks have converged when a round moves less than this in each kind.
TOLERANCE = 1e-7
#: Links in a page: absolute or scheme-relative targets of href attributes.
LINK = r"""(?i)href\s*=\s*["']?\s*((?:https?:)?//[^\s"'<>]+)"""


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    action: str  # allow or block

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules that the query uses.
RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)


def host_of(url: Column) -> Column:
    """What follows the first :// up to a slash, question mark, number sign or the end, with A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, number sign or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as a struct (rule, action); null where none does. Equal lengths: the first one."""
    ordered = sorted(rules, key=lambda r: -len(r.text))
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for r in reversed(ordered):
        at = (host == r.host) | host.endswith("." + r.host)
        out = F.when(at & path.startswith(r.path), F.struct(F.lit(r.text).alias("rule"), F.lit(r.action).alias("action"))).otherwise(out)
    return out


def judged(pages: DataFrame, rules: tuple[Rule, ...], url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, __action; columns of these names are replaced."""
    pages = pages.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    fits = rule_of(F.col("host"), F.col("path"), rules)
    return pages.withColumn("__fit", fits).withColumn("rule", F.col("__fit.rule")).withColumn("__action", F.col("__fit.action")).drop("__fit")


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, weight): links from a host's pages to another host, counted. Links within a host say nothing."""
    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(LINK), 1)).alias("to"))
    target = F.translate(F.regexp_extract("to", r"//([^/?#]*)", 1), UPPER, LOWER)
    links = links.select("src", target.alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, *, damping: float = DAMPING, rounds: int | None = None) -> DataFrame:
    """(kind, host, score) by personalised PageRank from ``seeds`` (kind, host, weight) over (kind, src, dst, weight).

    A kind's seeds share a mass of one by weight, and all rank that does not follow a link returns to them, that of hosts
    without links out included: each kind's scores sum to one in every round, so kinds can be compared. There are as
    many ``rounds`` as given, else until they move less than TOLERANCE. Every round joins rank with the edges, is summed
    by target with partial aggregation, and is written to the shared folder. No seeds give no scores.
    """
    total = edges.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    steps = common.written(edges.join(total, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("total")).alias("p")), "edges")
    linking = common.written(steps.select("kind", F.col("src").alias("host")).distinct(), "linking")
    mass = seeds.groupBy("kind").agg(F.sum("weight").alias("mass"))
    start = common.written(seeds.join(mass, "kind").select("kind", "host", (F.col("weight") / F.col("mass")).alias("score")), "seeds")

    def moved(rank: DataFrame) -> DataFrame:
        to = rank.withColumnRenamed("host", "src").join(steps, ["kind", "src"])
        to = to.select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("p") * damping).alias("score"))
        ends = rank.join(linking, ["kind", "host"], "left_anti").groupBy("kind").agg(F.sum("score").alias("ends"))  # a row per kind
        back = F.lit(1 - damping) + F.lit(damping) * F.coalesce("ends", F.lit(0.0))
        home = start.join(ends, "kind", "left").select("kind", "host", (F.col("score") * back).alias("score"))
        return to.unionByName(home).groupBy("kind", "host").agg(F.sum("score").alias("score"))

    rank = start
    if rounds is not None:
        for _ in range(rounds):
            rank = common.written(moved(rank), "rank")
        return rank
    while True:
        with common.Scratch(edges.sparkSession) as scratch:
            for _ in range(ROUNDS - 1):
                rank = common.written(moved(rank), "rank")
            new = scratch.keep(moved(rank), "rank")
            both = new.unionByName(rank.withColumn("score", -F.col("score"))).groupBy("kind", "host").agg(F.abs(F.sum("score")).alias("x"))
            change = [r["x"] for r in both.groupBy("kind").agg(F.sum("x").alias("x")).collect()]
        rank = new
        if max(change, default=0.0) < TOLERANCE:
            return rank


def host_scores(pages: DataFrame, rules: tuple[Rule, ...], *, url_col: str = "url", html_col: str = "html", rounds: int | None = None) -> DataFrame:
    """(host, trust, distrust) of hosts that a seed reaches.

    Seeds are the hosts of urls that a rule decides, weighted by how many; trust follows links, distrust goes against
    them.
    """
    seen = judged(pages.select(url_col), rules, url_col).where("__action is not null")
    seeds = seen.groupBy(F.when(F.col("__action") == "allow", "trust").otherwise("distrust").alias("kind"), "host")
    seeds = seeds.agg(F.count("*").cast("double").alias("weight"))
    edges = common.written(host_edges(pages, url_col, html_col), "host-edges")
    both = edges.withColumn("kind", F.lit("trust")).unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    )
    rank = propagate(both, seeds, rounds=rounds)
    score = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    return rank.groupBy("host").agg(score("trust"), score("distrust"))


def judge(
    pages: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    *,
    url_col: str = "url",
    html_col: str = "html",
    threshold: float = THRESHOLD,
    rounds: int | None = None,
) -> DataFrame:
    """``pages`` without their html, with host, path, rule, trust, distrust and verdict.

    The verdict is the rule's, else ``block`` where distrust is more than ``threshold`` of the host's trust and distrust,
    else ``allow``: a tie at one half and hosts that nothing reaches are allowed. Null urls and urls without :// have an
    empty host and path and are allowed. A null html has no links; one of any length is read whole. Repeated rows are
    judged alike, and their links count as often. An empty table gives an empty one. Other columns stay; those of
    ``pages`` named like new ones are replaced. Host scores meet the pages by a join on the host
    that broadcasts them where they are small and is split by adaptive execution where one host has most pages.
    """
    with common.Scratch(pages.sparkSession) as scratch:
        scores = scratch.keep(host_scores(pages, rules, url_col=url_col, html_col=html_col, rounds=rounds), "host-scores")
    slim = judged(pages.drop(html_col, "host", "path", "rule", "verdict", "trust", "distrust"), rules, url_col)
    found = slim.join(scores, "host", "left")
    method = F.when(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")), "block").otherwise("allow")
    names = [c for c in slim.columns if c not in ("host", "path", "rule", "__action")]
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return found.select(*names, "host", "path", "rule", zero("trust"), zero("distrust"), F.coalesce("__action", method).alias("verdict"))
