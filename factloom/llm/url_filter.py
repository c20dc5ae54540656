"""URL filters: rules for hosts and paths first, and for hosts that no rule speaks of trust and distrust that spread over links.

A rule (host, path, verdict) fits its host and all subdomains where the url's path starts with the rule's path; the longest host and path win,
and of equally long ones the block. Pages that rules allow make their hosts trusted seeds, pages that rules block make theirs distrusted ones,
each weighted by its pages. Trust goes along host edges as a personalised PageRank that restarts at the trusted seeds; distrust goes against
them (whoever links to a distrusted host is distrusted) and restarts at the distrusted ones. An edge's weight is the number of pages that
link from the one host to the other; besides, every host and the domain above it (down to two labels) are linked both ways by one, since
relative links stay inside a site. A host is blocked where at least so many percent of what reached it is distrust; one that nothing
reached is allowed.

Masses are whole numbers of a fixed unit and shares are rounded down, so results are the same under any partitioning. Pages are reduced to
host pairs before anything is shuffled; the rules that fit a host are looked up once per host; pages of one host (which may be a third of
all) meet its row in many tasks. Each round's masses are written and read again.

A null url, or one without ://, has an empty host and path, which no rule fits and no link reaches: allow. A null html has no links. Repeated
rows are judged each and count each; null ids stay; other columns are not read; an empty table gives no rows. Texts are scanned whole by
regular expressions of linear time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, dealt_lookup, discard, materialize

Rule = tuple[str, str, str]
#: The rules of the registered query.
RULES: tuple[Rule, ...] = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: All trust, and all distrust, in units; the percent that goes on along links; rounds; the percent of distrust from which a host is blocked.
UNIT, DAMPING, ROUNDS, BLOCK_PERCENT = 10**18, 85, 8, 50
#: What an absolute link in HTML looks like; its group is the host.
LINK = r"[Hh][Rr][Ee][Ff][\t\n\f\r ]*=[\t\n\f\r ]*[\"']?[\t\n\f\r ]*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#\"'<>\t\n\f\r ]+)"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def domains(host: Column) -> Column:
    """The host and all domains above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def fitting_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, rules: of every host, what may fit its pages, the strongest first."""
    order = F.struct((-F.length(F.concat("rule_host", "rule_path"))).alias("size"), F.when(F.col("rule_verdict") == "block", 0).otherwise(1).alias("first"), F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_path").alias("path"), F.col("rule_verdict").alias("verdict"))
    found = hosts.select("host", F.explode(domains(F.col("host"))).alias("rule_host")).join(rules, "rule_host").groupBy("host").agg(F.sort_array(F.collect_list(order)).alias("rules"))
    return hosts.join(found, "host", "left")


def by_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every page; the last two null where no rule fits."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    candidates = fitting_rules(urls.select("host").distinct(), rules)
    first = F.try_element_at(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(1))
    return dealt_lookup(urls, candidates, "host", ["page_id", "path"]).select("page_id", "host", "path", first["rule"].alias("rule"), first["verdict"].alias("verdict"))


def link_edges(pages: DataFrame) -> DataFrame:
    """src, dst, weight: from how many pages of one host links go to the other; none to itself."""
    targets = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), 1), lambda h: F.translate(h, UPPER, LOWER)))
    pairs = pages.where(F.contains(F.col("html"), F.lit("//"))).select(host_of(F.col("url")).alias("src"), F.explode(targets).alias("dst"))
    return pairs.where("src != '' and src != dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def domain_edges(hosts: DataFrame) -> DataFrame:
    """src, dst, weight: every host and domain with the one above it, both ways, down to two labels."""
    steps = F.transform(domains(F.col("host")), lambda d: F.struct(d.alias("low"), F.regexp_extract(d, r"^[^.]*\.(.*)$", 1).alias("up")))
    pairs = hosts.select(F.explode(steps).alias("x")).select("x.low", "x.up").where(F.contains(F.col("up"), F.lit("."))).distinct()
    return pairs.select(F.explode(F.array(F.struct(F.col("low").alias("src"), F.col("up").alias("dst")), F.struct(F.col("up").alias("src"), F.col("low").alias("dst")))).alias("e")).select("e.src", "e.dst", F.lit(1).cast("long").alias("weight"))


def shares(edges: DataFrame) -> DataFrame:
    """kind, src, dst, weight, out: trust along the edges, distrust against them; out is all weight that leaves src."""
    both = edges.select(F.explode(F.array(F.struct(F.lit("trust").alias("kind"), "src", "dst", "weight"), F.struct(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))).alias("e")).select("e.*")
    return both.join(both.groupBy("kind", "src").agg(F.sum("weight").alias("out")), ["kind", "src"])


def spread(seeds: DataFrame, edges: DataFrame, rounds: int, damping: int) -> DataFrame:
    """kind, host, mass after so many rounds. seeds: kind, host, seed."""
    edges = materialize(shares(edges), "host_edges")
    seeds = materialize(seeds, "host_seeds")
    masses, before = seeds.select("kind", "host", F.col("seed").alias("mass")), None
    for i in range(rounds):
        moved = masses.withColumnRenamed("host", "src").join(edges, ["kind", "src"]).select("kind", F.col("dst").alias("host"), F.expr(f"(mass div 100 * {damping}) div out * weight").alias("mass"))
        again = seeds.select("kind", "host", F.expr(f"seed div 100 * {100 - damping}").alias("mass"))
        masses = materialize(moved.unionByName(again).groupBy("kind", "host").agg(F.sum("mass").alias("mass")).where("mass > 0"), f"host_masses_{i}")
        if before is not None:
            discard(before)
        before = masses
    discard(edges, seeds)
    return masses


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] | DataFrame = RULES, rounds: int = ROUNDS, damping: int = DAMPING, block_percent: int = BLOCK_PERCENT) -> DataFrame:
    """page_id, host, path, rule, verdict, by_rule, trust, distrust of every row of pages (page_id, url, html). rules: tuples, or a table (rule_host, rule_path, rule_verdict)."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "rule_host string, rule_path string, rule_verdict string")
    judged = materialize(by_rules(pages, rules), "judged_pages")
    hosts = materialize(judged.groupBy("host").agg(F.count_if(F.col("verdict") == "allow").alias("trust"), F.count_if(F.col("verdict") == "block").alias("distrust")), "hosts")
    edges = materialize(link_edges(pages), "links")
    known = hosts.select("host").unionByName(edges.select(F.explode(F.array("src", "dst")).alias("host"))).where("host != ''").distinct()
    edges = edges.unionByName(domain_edges(known)).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    kinds = [hosts.where(f"{k} > 0 and host != ''").select(F.lit(k).alias("kind"), "host", F.col(k).alias("n")) for k in ("trust", "distrust")]
    weighted = reduce(DataFrame.unionByName, kinds)
    seeds = weighted.join(weighted.groupBy("kind").agg(F.sum("n").alias("all")), "kind").select("kind", "host", F.expr(f"{UNIT} div all * n").alias("seed"))
    masses = spread(seeds, edges, rounds, damping)
    mass = {k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass"))), F.lit(0)) for k in ("trust", "distrust")}
    verdicts = hosts.select("host").join(masses.groupBy("host").agg(*(m.alias(k) for k, m in mass.items())), "host", "left").fillna(0, ["trust", "distrust"])
    blocked = (F.col("distrust") > 0) & F.expr(f"distrust div 100 * {100 - block_percent} >= trust div 100 * {block_percent}")
    by_method = F.when(blocked, "block").otherwise("allow")
    out = dealt_lookup(judged, verdicts, "host", ["page_id", "path"])
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", by_method).alias("verdict"), F.col("verdict").isNotNull().alias("by_rule"), "trust", "distrust")
