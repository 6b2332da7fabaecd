"""URL filters: rules by host and path, and trust propagated over the links between hosts.

Rules decide where they fit. Elsewhere the host's reputation does: a personalised PageRank
spreads trust from the hosts of allowed pages along links, and a second one spreads distrust
from the hosts of blocked pages against them, to those that link there. Built-in Spark
expressions, joins and aggregations only.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, stored


@dataclass(frozen=True)
class Settings:
    damping: float = 0.85
    rounds: int = 16
    #: Rounds between two writes that cut the lineage.
    stored_every: int = 4
    #: The share of distrust in a host's trust and distrust from which the host is blocked.
    block_from: float = 0.5
    #: Whether a host and the host above it (blog.a.com, a.com) count as linked both ways.
    parent_links: bool = True


_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)href\s*=\s*["']?(?:[a-z]+:)?//([^/?#"'\s<>]+)"""


def url_host(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, A-Z lower-cased; empty without ://."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def url_path(url: Column) -> Column:
    """After the host, up to ? or #; empty without ://."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _suffixes(host: Column) -> Column:
    """The host itself and all hosts above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): for each host the rules that fit it or a host above it."""
    by_host = rules.select(
        lower_ascii(F.regexp_extract("rule", "^[^/]*", 0)).alias("_suffix"),
        F.struct(F.regexp_extract("rule", "(?s)/.*$", 0).alias("path"), "rule", "verdict").alias("_rule"),
    )
    met = hosts.select("host", F.explode(F.array_distinct(_suffixes(F.col("host")))).alias("_suffix")).join(by_host, "_suffix")
    return met.groupBy("host").agg(F.collect_set("_rule").alias("rules"))


def _best_rule(path: Column) -> Column:
    """The longest rule whose path the url's path starts with; of equals, block before allow."""
    fits = F.filter("rules", lambda r: F.startswith(path, r["path"]))
    ranked = F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("n"), (r["verdict"] == "block").alias("b"), r["rule"].alias("rule"), r["verdict"].alias("verdict")))
    return F.array_max(ranked)


def host_links(pages: DataFrame, html: str = "html", parent_links: bool = True) -> DataFrame:
    """(src, dst, weight) from a table with ``host`` and html: distinct absolute links by page."""
    linked = pages.select(
        F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.col(html), F.lit(_LINK), 1), lower_ascii))).alias("dst")
    )
    if parent_links:
        hosts = pages.select("host").distinct()
        above = hosts.select("host", F.regexp_extract("host", r"^[^.]*\.(.+\..+)$", 1).alias("up")).where("up <> ''")
        linked = linked.union(above.select("host", "up")).union(above.select("up", "host"))
    return linked.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def propagate(links: DataFrame, seeds: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trusted, blocked: numbers of its pages).

    Both walks are steps of one table, told apart by ``kind``. A host shares its value among
    its links by their weight; what a host without links holds is not passed on. The number
    of rounds is fixed. Hosts that neither walk reaches are absent.
    """
    both = links.select(F.lit("trust").alias("kind"), F.col("src").alias("at"), F.col("dst").alias("to"), "weight").union(
        links.select(F.lit("distrust"), "dst", "src", "weight")
    )
    out = both.groupBy("kind", "at").agg(F.sum("weight").alias("_all"))
    steps = stored(both.join(out, ["kind", "at"]).select("kind", "at", "to", (F.col("weight") / F.col("_all")).alias("share")), "op1-steps")
    start = seeds.select("host", F.explode(F.create_map(F.lit("trust"), "trusted", F.lit("distrust"), "blocked")).alias("kind", "seed")).where("seed > 0")
    total = start.groupBy("kind").agg(F.sum("seed").alias("_all"))
    start = stored(start.join(total, "kind").select("kind", "host", (F.col("seed") / F.col("_all") * (1 - s.damping)).alias("value")), "op1-seeds")
    values = start
    for turn in range(1, s.rounds + 1):
        moved = values.withColumnRenamed("host", "at").join(steps, ["kind", "at"])
        moved = moved.select("kind", F.col("to").alias("host"), (s.damping * F.col("value") * F.col("share")).alias("value"))
        values = start.unionByName(moved).groupBy("kind", "host").agg(F.sum("value").alias("value"))
        if turn % s.stored_every == 0:
            values = stored(values, f"op1-values-{turn}")
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("value"))), F.lit(0.0)).alias(kind)
    return values.groupBy("host").agg(of("trust"), of("distrust"))


def judge_urls(
    pages: DataFrame, rules: DataFrame, settings: Settings = Settings(), url: str = "url", html: str = "html", page_id: str = "page_id"
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, host_trust, host_distrust.

    ``rules`` has rule (host and path, like example.com/en/) and verdict (allow or block). A
    rule fits its host and all hosts below it where the path starts with the rule's; the
    longest wins, and of equally long ones block. Pages without a rule get their host's
    verdict: block where distrust has at least ``block_from`` of trust plus distrust, else
    allow, which also holds for hosts that no walk reaches. A null url, or one without ://,
    has an empty host and path and is allowed. Null html has no links. Pages keep their number,
    repeated ones too; other columns are not looked at. No pages, no rows.
    """
    s = settings
    rows = pages.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"), F.col(html).alias("_html"))
    hosts = rows.select("host").where("host <> ''").distinct()
    fitting = stored(_rules_of_hosts(hosts, rules), "op1-rules")
    ruled = rows.select("page_id", "host", "path").join(fitting, "host", "left").withColumn("_best", _best_rule(F.col("path")))
    # Counts by host are aggregated map-side, so a host with a third of all pages is no hot key.
    seeds = ruled.where("_best is not null").groupBy("host").agg(
        F.count_if(F.col("_best.verdict") == "allow").alias("trusted"), F.count_if(F.col("_best.verdict") == "block").alias("blocked")
    )
    links = host_links(rows.select("host", F.col("_html").alias("html")), "html", s.parent_links)
    values = stored(propagate(links, seeds, s), "op1-hosts")
    about = fitting.join(values, "host", "full")
    judged = rows.select("page_id", "host", "path").join(about, "host", "left").withColumn("_best", _best_rule(F.col("path")))
    distrusted = F.coalesce(F.col("distrust") >= s.block_from * (F.col("trust") + F.col("distrust")), F.lit(False)) & (F.col("distrust") > 0)
    return judged.select(
        "page_id", "host", "path", F.col("_best.rule").alias("rule"),
        F.coalesce(F.col("_best.verdict"), F.when(distrusted, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("host_trust"), F.coalesce("distrust", F.lit(0.0)).alias("host_distrust"),
    )
