"""URL filter: host and path rules first, then trust and distrust propagated over the link graph of the hosts.

A url's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; its path goes on up to ``?``, ``#`` or the end. A rule ``(host, path, verdict)`` fits
its host and all subdomains where the url's path starts with the rule's; of several the longest
wins. Urls without a rule get the verdict of their host:

* **Edges.** ``host_links`` takes the absolute links of every page and counts, per pair of hosts, the pages that link.
  Links to the own host are left out.
* **Trust** is personalised PageRank along the links, starting from every host with its pages that a rule
  allows; **distrust** is the same walk against the links, starting from the pages that a rule blocks. Both
  are kept in units of pages (the start vector is not scaled to 1), and a host without links that way keeps
  its mass. A round is one join and one grouped sum for both, written to the shared scratch folder;
  rounds go on until both vectors stand still, ``ROUNDS`` at most (walks longer than that carry less
  than 0.2 % of the mass).
* **Threshold.** A host is blocked when its distrust exceeds its trust by more than ``LIMIT`` of its pages.
  Without links that is: more than half of its pages, net of allowed ones, are blocked by rules.

Hosts are joined, never gathered: a host with a third of all pages is one row of the host table, and Spark
splits its side of the join. Rules are a table of any size, broadcast only when proven small.

A null url, or one without ``://``, has empty host and path, fits no rule and is allowed. Null or empty html has no
links. Repeated rows and ids stay and get the same verdict each; pages with a null ``page_id`` are judged like
any other. Of rules that differ only in the verdict ``block`` wins. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.operators.joins import broadcast_if_small
from linkweave.session import literal_rows, materialize, release_scratch, scratch_tables

DAMPING = 0.85
ROUNDS = 40
STILL = 1e-12
LIMIT = 0.5
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]
LINK = r"""(?i)\bhref[\x20\x09-\x0D]*+=[\x20\x09-\x0D]*+["']?[\x20\x09-\x0D]*+(?:[a-z][a-z0-9+.\-]*+:)?//([^/?#"'<>\x20\x09-\x0D\\]++)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return literal_rows(spark, rules, "host string, path string, verdict string")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``(host, host_rules)`` of the hosts that some rule's host covers; longest rules first."""
    labels = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("n")).first().n or 0  # no longer suffix can fit
    parts = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max(1, labels)))),
                         lambda k: F.array_join(F.slice(parts, -k, k), "."))
    text = F.concat("host", "path")
    known = rules.select(F.col("host").alias("rule_host"), F.struct(
        F.length(text).alias("size"), F.col("verdict").alias("verdict"), F.col("path").alias("path"), text.alias("rule")).alias("fit"))
    return (hosts.select("host", F.explode(suffix).alias("rule_host")).join(broadcast_if_small(known), "rule_host")
            .groupBy("host").agg(F.sort_array(F.collect_list("fit"), asc=False).alias("host_rules")))


def apply_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``(page_id, host, path, rule, rule_verdict)`` of every page."""
    url = F.col("url").cast("string")
    parsed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    fits = host_rules(parsed.select("host").distinct(), rules)
    first = F.get(F.filter("host_rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    return (parsed.join(fits, "host", "left").select("page_id", "host", "path", first.alias("first"))
            .select("page_id", "host", "path", F.col("first.rule").alias("rule"), F.col("first.verdict").alias("rule_verdict")))


def host_links(pages: DataFrame) -> DataFrame:
    """``(src, dst, n)``: pages of host ``src`` that link to host ``dst``."""
    found = F.transform(F.regexp_extract_all(F.col("html").cast("string"), F.lit(LINK), F.lit(1)),
                        lambda h: F.translate(h, _UPPER, _LOWER))
    ends = pages.select(host_of(F.col("url").cast("string")).alias("src"), F.explode(F.array_distinct(found)).alias("dst"))
    return ends.where("src <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, still: float = STILL) -> DataFrame:
    """``(host, trust, distrust)`` of every host in ``seeds(host, allowed, blocked)`` or on a link."""
    spark = seeds.sparkSession
    before = set(scratch_tables(spark))
    links = materialize(links, "url-links")
    first = seeds.select("host", F.inline(F.array(
        F.struct(F.lit("trust").alias("kind"), F.col("allowed").cast("double").alias("seed")),
        F.struct(F.lit("distrust").alias("kind"), F.col("blocked").cast("double").alias("seed")))))
    if links.isEmpty():
        return first.groupBy("host").pivot("kind", ["trust", "distrust"]).agg(F.sum("seed"))
    steps = links.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n").union(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "n"))
    total = steps.groupBy("kind", "host").agg(F.sum("n").alias("total"))
    shares = materialize(steps.join(total, ["kind", "host"]).select("kind", "host", "to", (F.col("n") / F.col("total")).alias("share")),
                         "url-shares")
    nodes = links.select("src").union(links.select("dst")).distinct().select(
        F.col("src").alias("host"), F.explode(F.array(F.lit("trust"), F.lit("distrust"))).alias("kind"))
    leaves = shares.groupBy("kind", "host").agg(F.lit(True).alias("leaves"))
    state = (nodes.join(first, ["kind", "host"], "left").join(leaves, ["kind", "host"], "left")
             .select("kind", "host", F.coalesce("seed", F.lit(0.0)).alias("seed"), F.coalesce("leaves", F.lit(False)).alias("leaves")))
    state = materialize(state.select("*", F.col("seed").alias("mass")), "url-mass")
    kept = set(scratch_tables(spark))
    for _ in range(rounds):
        into = (state.join(shares, ["kind", "host"]).groupBy("kind", F.col("to").alias("host"))
                .agg(F.sum(F.col("mass") * F.col("share")).alias("came")))
        came = F.coalesce("came", F.lit(0.0)) + F.when(F.col("leaves"), F.lit(0.0)).otherwise(F.col("mass"))
        state = materialize(state.join(into, ["kind", "host"], "left").select(
            "kind", "host", "seed", "leaves", (F.lit(1 - damping) * F.col("seed") + F.lit(damping) * came).alias("mass"),
            F.col("mass").alias("was")), "url-mass")
        moved = state.agg(F.sum(F.abs(F.col("mass") - F.col("was"))).alias("moved"), F.sum("mass").alias("mass")).first()
        done = [p for p in scratch_tables(spark) if p not in kept]
        release_scratch(spark, done[:-1])
        if moved.moved <= still * max(moved.mass, 1.0):
            break
    alone = first.join(state.select("kind", "host"), ["kind", "host"], "left_anti").select("kind", "host", F.col("seed").alias("mass"))
    out = materialize(state.select("kind", "host", "mass").union(alone).groupBy("host").pivot("kind", ["trust", "distrust"])
                      .agg(F.sum("mass")), "url-scores")
    release_scratch(spark, [p for p in scratch_tables(spark) if p not in before][:-1])
    return out


def judge(pages: DataFrame, rules: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, limit: float = LIMIT) -> DataFrame:
    """``(page_id, host, path, rule, verdict, trust, distrust)`` of every page; the last two are the host's."""
    ruled = materialize(apply_rules(pages, rules), "url-rules")
    count = lambda verdict: F.count_if(F.col("rule_verdict") == verdict)
    hosts = materialize(ruled.where("host <> ''").groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"), count("allow").alias("allowed"), count("block").alias("blocked")), "url-hosts")
    scores = propagate(hosts, host_links(pages), damping, rounds)
    over = F.round(F.col("distrust") - F.col("trust") - F.lit(limit) * F.col("pages"), 9) > 0
    verdicts = hosts.join(scores, "host").select("host", "trust", "distrust", F.when(over, "block").otherwise("allow").alias("host_verdict"))
    return ruled.join(verdicts, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", "host_verdict", F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
