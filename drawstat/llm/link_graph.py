"""URL filter by rules and by trust that flows along links between hosts, in DataFrame functions only.

A rule (host, path, allow) fits a url whose host is the rule's or below it and whose path starts with the rule's;
the longest rule decides. Where none fits, the host decides: every page that a rule allows gives its host one unit of
trust and every page that a rule blocks one of distrust. Trust walks along the links as in personalised PageRank,
a host passing ``PASSED`` of what reaches it to the hosts it links to; distrust walks the same links
backwards, from a blocked host to those that link to it. A host with more distrust than trust is blocked.

Mass is counted in whole millionths, so sums do not depend on their order and a lost executor changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawstat.llm.common import keep

# Fixed values of the query: (host, path, allow)
RULES = (("org", "/", True), ("example.org", "/es/", False), ("example.org", "/en/1", False), ("com", "/fr/", True), ("com", "/de/", False))
UNIT = 1_000_000      # mass of one seed page
PASSED = (85, 100)    # share of its mass that a host passes on
STEPS = 12            # links a unit of mass walks at most; 0.85 ** 12 is 14 %
TOLERATED = (1, 1)    # a host is blocked when distrust exceeds this many times its trust
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""<[aA][ \t\n\f\r][^>]*?[hH][rR][eE][fF][ \t\n\f\r]*=[ \t\n\f\r]*["']?[ \t\n\f\r]*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#"'> \t\n\f\r]+)"""


def lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(text, _UPPER, _LOWER)


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def linked_hosts(html: Column) -> Column:
    """Distinct hosts that a page names in absolute or scheme-relative links."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(LINK), F.lit(1)), lower))


def rule_table(pages: DataFrame, rules: Sequence[tuple[str, str, bool]]) -> DataFrame:
    rows = [(h, p, f"{h}{p}", a) for h, p, a in rules]
    return pages.sparkSession.createDataFrame(rows, "rule_host string, rule_path string, rule string, allow boolean")


def fitting_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): for every host that a rule's host fits, these rules, the longest first (of equal length the one
    with the longer host). Only endings of a host with as many labels as some rule has are looked up."""
    deepest = rules.agg(F.max(F.size(F.split("rule_host", r"\.")))).first()[0]
    if deepest is None:
        return hosts.select("host", F.array().cast("array<struct<rule:string,path:string,allow:boolean>>").alias("rules")).limit(0)
    labels = F.split("host", r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.least(F.lit(deepest), F.size(labels))),
                          lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    fits = hosts.select("host", F.explode(endings).alias("rule_host")).join(rules, "rule_host")
    ordered = F.sort_array(F.collect_list(F.struct(
        (-F.length("rule")).alias("shortness"), (-F.length("rule_host")).alias("general"), "allow", "rule", F.col("rule_path").alias("path"))))
    return fits.groupBy("host").agg(ordered.alias("found")).select(
        "host", F.transform("found", lambda r: F.struct(r["rule"].alias("rule"), r["path"].alias("path"), r["allow"].alias("allow"))).alias("rules"))


def flows(links: DataFrame) -> DataFrame:
    """(kind, host, to, share, total): trust goes from a host to those it links to, distrust the other way; of the
    mass of ``host`` the part ``share / total`` goes to ``to``. ``links`` (host, to, pages) has no loops."""
    trust = links.select(F.lit("trust").alias("kind"), "host", "to", F.col("pages").alias("share"))
    distrust = links.select(F.lit("distrust").alias("kind"), F.col("to").alias("host"), F.col("host").alias("to"), F.col("pages").alias("share"))
    both = keep(trust.unionAll(distrust), "flows")
    totals = keep(both.groupBy("kind", "host").agg(F.sum("share").alias("total")), "flow-totals")
    return keep(both.join(totals, ["kind", "host"]), "shares")


def propagate(seeds: DataFrame, links: DataFrame, steps: int = STEPS, passed: tuple[int, int] = PASSED) -> DataFrame:
    """(host, trust, distrust) of every host that mass reaches. ``seeds`` (kind, host, mass) are counted themselves.

    The sum over steps of what arrives, each step one join of the moving mass with the links and one sum per
    host that is combined before it moves. It ends early when nothing moves any more."""
    shares = flows(links)
    moving = keep(seeds.filter("host <> ''"), "moving")
    arrived = [moving]
    for _ in range(steps):
        if moving.isEmpty():
            break
        given = moving.select("kind", "host", F.expr(f"mass * {passed[0]} div {passed[1]}").cast("decimal(19,0)").alias("given"))
        part = F.expr("given * cast(share as decimal(18,0)) div cast(total as decimal(18,0))")
        sent = given.join(shares, ["kind", "host"]).select("kind", F.col("to").alias("host"), part.alias("mass"))
        moving = keep(sent.groupBy("kind", "host").agg(F.sum("mass").alias("mass")).filter("mass > 0"), "moving")
        arrived.append(moving)
    mass = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass"))), F.lit(0)).alias(k) for k in ("trust", "distrust")]
    return reduce(DataFrame.unionAll, arrived).groupBy("host").agg(*mass)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, bool]] = RULES, steps: int = STEPS, passed: tuple[int, int] = PASSED,
          tolerated: tuple[int, int] = TOLERATED) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html; other columns are ignored): page_id, host, path, rule (its host
    and path, null without one), verdict (``allow`` or ``block``), trust, distrust (of the host).

    A null url, or one without ``://``, has an empty host and path; no rule fits it, it has no links, and it is
    allowed. A null html has no links. Links within a host do not count; a page counts once for every host it
    links to. Rows that repeat are judged, and seed, as often as they occur. A host that no mass reaches, or as much
    of both, is allowed. Of two rules with one text the blocking one decides. An empty table gives no rows."""
    rows = keep(pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"),
                             linked_hosts(F.col("html")).alias("linked")), "pages")
    candidates = keep(fitting_rules(rows.select("host").distinct(), rule_table(pages, rules)), "host-rules")
    fitting = F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"]))
    ruled = keep(rows.drop("linked").join(candidates, "host", "left").select("page_id", "host", "path", F.get(fitting, F.lit(0)).alias("fit")), "ruled")

    seeds = ruled.filter("fit IS NOT NULL").groupBy(F.when(F.col("fit.allow"), "trust").otherwise("distrust").alias("kind"), "host").agg(
        (F.count("*") * UNIT).alias("mass"))
    links = rows.select("host", F.explode("linked").alias("to")).filter("host <> '' AND host <> to").groupBy("host", "to").agg(
        F.count("*").alias("pages"))
    scores = keep(propagate(seeds, links, steps, passed), "host-scores")
    trust, distrust = (F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in ("trust", "distrust"))
    blocked = F.when(F.col("fit").isNotNull(), ~F.col("fit.allow")).otherwise(distrust * tolerated[1] > trust * tolerated[0])
    return ruled.join(scores, "host", "left").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.when(blocked, "block").otherwise("allow").alias("verdict"),
        trust.alias("trust"), distrust.alias("distrust"))
