"""URL filters: rules first, then trust and distrust propagated over the links between hosts.

A rule names a host and the beginning of a path; it fits that host and its subdomains, and the
longest fitting rule decides. Pages no rule fits are judged by their host. Hosts whose pages rules
allow are trusted seeds, hosts whose pages rules block are distrusted seeds. Personalised PageRank
carries trust along the links and distrust against them (who links to bad hosts is suspect). A host
is blocked when its distrust is more than ``THRESHOLD`` times its trust; ranks that differ by less than
their precision count as equal. Ranks are kept to significant digits, so that neither the number of
seeds nor the distance from them makes one vanish, and the walks go on until no rank changes.

Defined cases: a null URL, or one without ``://``, has an empty host and path and is allowed; so is a
host that neither walk reaches. Null or empty pages have no links. Repeated rows are judged one by
one; their links count each. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annoweave.llm.common import stored
from annoweave.session import discard, scratch_path, settle

#: host, path, verdict
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
DAMPING = 0.85
#: Steps in which a walk over few hosts settles. It limits nothing: walks end when their ranks do.
STEPS = 200
THRESHOLD = 1.0
_DIGITS = 12  # significant ones kept of a rank after each step, so that the order of sums does not show
_SAME = 1e-10  # of a rank; smaller changes are those of its last digits
_TIE = 1e-9  # of trust; what is left of a walk once its steps change less than _SAME
_LEAST = 2.3e-308  # a rank that a walk reaches never falls to zero
_BROADCAST_HOSTS = 200_000


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, in lower case."""
    return F.coalesce(_ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _longest_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, says in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """Links between different hosts with the number of times each occurs: source, target, n.

    ``pages`` has host and html. A link without a host of its own stays on its page's host, and
    links of a host to itself carry nothing; both are left out.
    """
    marks = F.regexp_extract_all("html", F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?([^\"'\s>]+)"), F.lit(1))
    targets = pages.select(F.col("host").alias("source"), F.explode(marks).alias("link"))
    linked = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    return (targets.select("source", host_of(linked).alias("target"))
            .where("source <> '' and target <> '' and source <> target")
            .groupBy("source", "target").agg(F.count(F.lit(1)).alias("n")))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING) -> DataFrame:
    """Personalised PageRank: host, rank.

    ``links`` has source, target and n, ``seeds`` host and share (shares sum to one). At each step a
    walker goes on with probability ``damping`` and otherwise restarts; what reaches a host without
    links ends there. A step is a join on the host that gives and a sum on the one that receives;
    ranks are settled after each step, so a lost executor costs one step. The last step is the one
    that reaches no new host and changes no rank by more than ``_SAME`` of it.
    """
    spark = links.sparkSession
    start = settle(seeds.select("host", ((1.0 - damping) * F.col("share")).alias("rank")))
    if links.isEmpty():
        return start
    out = links.groupBy("source").agg(F.sum("n").alias("all_n"))
    parts = settle(links.join(out, "source").select(
        "source", "target", (damping * F.col("n") / F.col("all_n")).alias("part")))
    ranks, last = start, None
    unknown = F.lit(None).cast("double")
    digits = F.format_string(f"%.{_DIGITS - 1}e", F.greatest(F.sum("rank"), F.lit(_LEAST))).cast("double")
    while True:
        moved = (ranks.join(parts, ranks["host"] == parts["source"])
                 .select(F.col("target").alias("host"), (F.col("rank") * F.col("part")).alias("rank"),
                         unknown.alias("before")))
        known = ranks.select("host", F.lit(0.0).alias("rank"), F.col("rank").alias("before"))
        step = (moved.unionByName(start.withColumn("before", unknown)).unionByName(known).groupBy("host")
                .agg(digits.alias("rank"), F.max("before").alias("before")))
        moves = F.col("before").isNull() | (F.abs(F.col("rank") - F.col("before")) > _SAME * F.col("rank"))
        path = scratch_path(spark, "url-ranks")
        step.select("host", "rank", moves.alias("moves")).write.parquet(path)
        ranks = spark.read.schema("host string, rank double, moves boolean").parquet(path)
        if last is not None:
            discard(spark, last)
        last = path
        if ranks.where("moves").isEmpty():
            return ranks.select("host", "rank")


def _seeds(judged: DataFrame, says: str) -> DataFrame:
    """Hosts with pages that rules judge so, each with its share of those pages."""
    hosts = (judged.where((F.col("host") != "") & (F.col("by_rule") == says))
             .groupBy("host").agg(F.count(F.lit(1)).alias("n")))
    whole = hosts.agg(F.sum("n").alias("whole"))
    return hosts.join(F.broadcast(whole)).select("host", (F.col("n") / F.col("whole")).alias("share"))


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every page."""
    url = F.col("url")
    plain = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), "html")
    rule, verdict = _longest_rule(F.col("host"), F.col("path"), rules)
    judged = plain.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))
    judged = stored(judged, "url-rules")
    links = settle(host_links(plain))
    back = links.select(F.col("target").alias("source"), F.col("source").alias("target"), "n")
    trust = propagate(links, _seeds(judged, "allow")).withColumnRenamed("rank", "trust")
    doubt = propagate(back, _seeds(judged, "block")).withColumnRenamed("rank", "distrust")
    hosts = trust.join(doubt, "host", "full")
    hosts = settle(hosts.select(F.col("host").alias("_host"), F.coalesce("trust", F.lit(0.0)).alias("trust"),
                                F.coalesce("distrust", F.lit(0.0)).alias("distrust")))
    if hosts.count() <= _BROADCAST_HOSTS:
        hosts = F.broadcast(hosts)
    found = judged.join(hosts, judged["host"] == F.col("_host"), "left")
    bad = F.coalesce(F.col("distrust") > threshold * (1.0 + _TIE) * F.col("trust"), F.lit(False))
    return found.select("page_id", "host", "path", "rule",
                        F.coalesce("by_rule", F.when(bad, "block").otherwise("allow")).alias("verdict"),
                        F.coalesce("trust", F.lit(0.0)).alias("trust"),
                        F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
