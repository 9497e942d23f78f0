"""URL filter: rules first, then trust and distrust propagated over the host graph.

A url is judged by the longest rule that fits its host (or a domain above it) and the start
of its path.  Urls without a rule get the verdict of their host.  A host is a trusted seed as far as
the rules allow its pages and a blocked seed as far as they block them: the two shares are its
teleport weights.  Personalised PageRank spreads trust from the trusted along links, and distrust from
the blocked against them (who links to the blocked is suspect); a host whose distrust reaches the
threshold and exceeds its trust is blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import crowd_of, discard, join_hot, materialise

# Fixed values: (verdict, host, path prefix).
RULES: tuple[tuple[str, str, str], ...] = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"^(?s).*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def match_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct ``rule, verdict`` of the longest rule that fits, or null.

    The rules lie in a map by host, and a url looks up its host and every domain above it,
    so the work for a url grows with the labels of its host, not with the rules.
    """
    by_host: dict[str, list] = {}
    for verdict, name, prefix in rules:
        entry = F.struct(F.lit(len(name + prefix)).alias("size"), F.lit(name + prefix).alias("rule"), F.lit(prefix).alias("path"), F.lit(verdict).alias("verdict"))
        by_host.setdefault(name, []).append(entry)
    if not by_host:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    table = F.create_map(*[x for name, entries in by_host.items() for x in (F.lit(name), F.array(*entries))])
    parts = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    fitting = F.filter(F.flatten(F.filter(F.transform(domains, lambda d: F.try_element_at(table, d)), lambda x: x.isNotNull())), lambda x: F.startswith(path, x["path"]))
    best = F.array_max(fitting)
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def host_links(pages: DataFrame) -> DataFrame:
    """Distinct links between different hosts (``src, dst``): absolute and protocol-relative
    targets of href and src attributes.  Links within a host say nothing about it."""
    targets = F.regexp_extract_all("html", F.lit(r"(?i)(?:href|src)\s*=\s*[\"']?((?:https?:)?//[^\"'\s>]+)"), 1)
    found = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(targets)).alias("target"))
    target = F.when(F.startswith("target", F.lit("//")), F.concat(F.lit("http:"), F.col("target"))).otherwise(F.col("target"))
    return found.select("src", host_of(target).alias("dst")).where("src <> '' and dst <> '' and src <> dst").distinct()


def propagate(seeds: DataFrame, links: DataFrame, damping: float = 0.85, rounds: int = 10) -> DataFrame:
    """``host, trust, distrust`` after ``rounds`` steps of both personalised PageRanks.

    ``seeds`` (``host, trusted, blocked``) hold the teleport weights, which are not normalised, so a
    score keeps its meaning whatever the number of hosts.  Trust divides among the hosts that
    one links to, distrust among those that link to one.
    """
    by_src, by_dst = crowd_of(links, "src"), crowd_of(links, "dst")  # hosts with very many links are dealt out
    counted = join_hot(links, links.groupBy("src").agg(F.count("*").alias("n_out")), "src", crowd=by_src)
    counted = join_hot(counted, links.groupBy("dst").agg(F.count("*").alias("n_in")), "dst", crowd=by_dst)
    links = materialise(counted.select("src", "dst", "n_out", "n_in"), "links")
    base = seeds.select("host", ((1 - damping) * F.col("trusted")).alias("t0"), ((1 - damping) * F.col("blocked")).alias("b0"))
    now = seeds.select("host", F.col("trusted").cast("double").alias("trust"), F.col("blocked").cast("double").alias("distrust"))
    now = materialise(now, "ranks")
    # without links the first round is the last that changes anything
    for _ in range(rounds if links.limit(1).count() else min(rounds, 1)):
        forward = join_hot(links, now.withColumnRenamed("host", "src"), "src", crowd=by_src).select(F.col("dst").alias("host"), (damping * F.col("trust") / F.col("n_out")).alias("trust"), F.lit(0.0).alias("distrust"))
        backward = join_hot(links, now.withColumnRenamed("host", "dst"), "dst", crowd=by_dst).select(F.col("src").alias("host"), F.lit(0.0).alias("trust"), (damping * F.col("distrust") / F.col("n_in")).alias("distrust"))
        flow = forward.union(backward).union(base.select("host", F.col("t0"), F.col("b0"))).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        before, now = now, materialise(flow, "ranks")
        discard(before)
    discard(links)
    return now


def judge_urls(pages: DataFrame, rules=RULES, threshold: float = 0.075, damping: float = 0.85, rounds: int = 10) -> DataFrame:
    """One row per page: ``page_id, host, path, rule`` (null where none fits), ``verdict``,
    ``trust`` and ``distrust`` of its host.

    A host without links keeps ``1 - damping`` of its two shares, so the threshold blocks it if at least half of its
    pages are blocked.  A null url or one without ``://`` has an empty host and path, no rule, and is
    allowed.  A null html has no links.  Repeated rows come back as often as they came and count as
    often; other columns are ignored.  The rules are literals of the plan, so they must be few.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = materialise(urls.withColumn("match", match_rule(F.col("host"), F.col("path"), rules)), "judged")
    named = judged.where("host <> ''")
    share = lambda v: F.avg(F.coalesce((F.col("match.verdict") == v).cast("double"), F.lit(0.0)))
    seeds = materialise(named.groupBy("host").agg(share("allow").alias("trusted"), share("block").alias("blocked")), "seeds")
    links = materialise(host_links(pages), "host-links")
    outside = links.select(F.col("dst").alias("host")).distinct().join(seeds, "host", "left_anti").select("host", F.lit(0.0).alias("trusted"), F.lit(0.0).alias("blocked"))
    ranks = propagate(materialise(seeds.union(outside), "seeds"), links, damping, rounds)
    nameless = judged.where("host = ''").select("*", F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust"))
    ranked = join_hot(named, ranks, "host", "left").select(*judged.columns, "trust", "distrust").union(nameless)
    out = ranked.select("page_id", "host", "path", F.col("match.rule").alias("rule"), F.col("match.verdict").alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    # at 12 places the order of sums does not matter
    bad, good = F.round("distrust", 12), F.round("trust", 12)
    method = F.when((bad >= threshold) & (bad > good), "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce("verdict", method))
