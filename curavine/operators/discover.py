"""Discovery of sites: aggregation, selection, rotation, robots rules and block lists."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from .. import rules as fixed
from ..functions.text import first_filled, text
from ..functions.url import domain as domain_of
from ..functions.url import host as host_of
from ..functions.url import host_suffixes, path, path_query
from .keys import top_n


def domain_summary(rows: DataFrame, domain: str, score: str, query: str, url: str, order: str, image: Column, html: Column, samples: int = 12) -> DataFrame:
    """Per domain: records, image_records, html_records, score, queries (sorted), sample_urls (the first distinct ones).

    Samples are cut to their number before they are gathered, so that no list grows with the domain.
    """
    base = rows.groupBy(domain).agg(F.count(F.lit(1)).alias("records"), F.count_if(image).alias("image_records"), F.count_if(html).alias("html_records"), F.sum(score).alias("score"))
    queries = rows.select(domain, query).distinct().groupBy(domain).agg(F.sort_array(F.collect_list(query)).alias("queries"))
    urls = rows.groupBy(domain, url).agg(F.min(order).alias("__o"))
    urls = urls.withColumn("__r", F.row_number().over(Window.partitionBy(domain).orderBy("__o"))).where(F.col("__r") <= samples)
    urls = urls.groupBy(domain).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", url))), lambda s: s[url]).alias("sample_urls"))
    return base.join(queries, domain).join(urls, domain)


def best_domains(summary: DataFrame, domain: str, limit: int) -> DataFrame:
    return summary.orderBy(F.col("score").desc(), F.col("records").desc(), F.col(domain)).limit(limit)


def select_sites(urls: DataFrame, host: str, score: str, order: str, existing: DataFrame, sites: int, per_site: int) -> DataFrame:
    """URLs of the sites with the fewest known candidates, then the best score of their first URL; per_site each."""
    first = urls.groupBy(host).agg(F.min_by(score, order).alias("__first"), F.min(order).alias("__at"))
    ranked = first.join(existing, host, "left").orderBy(F.coalesce(F.col("existing"), F.lit(0)), F.col("__first").desc(), F.col("__at")).limit(sites)
    ranked = ranked.select(host, "__at", F.coalesce(F.col("existing"), F.lit(0)).alias("existing"))
    rows = urls.join(ranked, host).withColumn("rank", F.row_number().over(Window.partitionBy(host).orderBy(F.col(score).desc(), F.col(order))))
    return rows.where(F.col("rank") <= per_site).drop("__at")


def existing_counts(candidates: DataFrame, url: str, fallback: str, name: str = "host") -> DataFrame:
    """Known candidates of each site: of the URL's domain, or of the fallback's where the URL is empty.

    What is no URL counts as a site's name. Rows with neither don't count.
    """
    given = F.coalesce(first_filled(url, fallback), F.lit(""))
    site = F.coalesce(F.nullif(domain_of(given), F.lit("")), F.lower(F.regexp_replace(given, r"^www\.", "")))
    return candidates.select(site.alias(name)).where(F.col(name) != "").groupBy(name).agg(F.count(F.lit(1)).alias("existing"))


def select_found(found: DataFrame, url: str, score: str, least: float, per_site: int, most: int) -> DataFrame:
    """The best finds: of those with the least score or more, so many of each site and so many in all, best first.

    Equal scores come in the order of their URLs. The sites' ranks are cut before rows are shuffled.
    """
    best = [F.col(score).desc(), F.col(url)]
    rows = found.where(F.col(score) >= least).withColumn("__site", domain_of(url))
    return top_n(rows, ["__site"], best, per_site).drop("__site").orderBy(*best).limit(most)


def by_quality(domains: DataFrame, domain: str, order: str, stats: DataFrame, blocked: list[str], quality: str = "quality") -> DataFrame:
    """Distinct domains that aren't blocked, the better sources first, equal ones as they first occurred.

    stats: one row for each domain; domains without one come last, after low ones. Adds quality_rank.
    """
    rows = domains.where((text(domain) != "") & ~text(domain).isin(*blocked)).groupBy(domain).agg(F.min(order).alias(order))
    rank = F.lit(0)
    for value, n in fixed.QUALITY_RANKS.items():
        rank = F.when(F.col(quality) == value, n).otherwise(rank)
    return rows.join(stats.select(domain, quality), domain, "left").select(domain, order, rank.alias("quality_rank")).orderBy(F.col("quality_rank").desc(), order)


def hits_per_query(results: DataFrame, memo: str, queries: list[str]) -> DataFrame:
    """How many results name each query in their memo: one aggregation with a count for each of a run's queries."""
    counts = [F.struct(F.lit(q).alias("query"), F.count_if(F.contains(text(memo), F.lit(q))).alias("hits")) for q in queries]
    return results.agg(F.array(*counts).cast("array<struct<query:string,hits:bigint>>").alias("counts")).select(F.inline("counts"))


def expand(templates: DataFrame, values: DataFrame, template: str, value: str, hole: str, limit: int | None = None) -> DataFrame:
    """Every template with every value in place of the hole; both are lists that a configuration holds."""
    out = templates.crossJoin(values).withColumn("query", F.replace(F.col(template), F.lit(hole), F.col(value)))
    return out if limit is None else out.orderBy(template, value).limit(limit)


def not_blocked(df: DataFrame, url: str, blocked: DataFrame, name: str = "domain") -> DataFrame:
    """Rows whose host is neither on the list nor below a domain on it: an equi-join on the suffixes of the distinct hosts."""
    keyed = df.withColumn("__host", host_of(url))
    hosts = df.select(F.col(url).alias("__url")).select(host_of("__url").alias("__host"), host_suffixes("__url").alias("__names")).distinct()
    hits = hosts.select("__host", F.explode("__names").alias(name)).join(blocked.select(F.lower(name).alias(name)).distinct(), name).select("__host").distinct()
    return keyed.join(hits, "__host", "left_anti").drop("__host")


def crawl_order(links: DataFrame, seeds: list[str], relevance: DataFrame, budget: int) -> DataFrame:
    """URLs in the order in which a crawl would visit them: breadth first, the more relevant ones earlier.

    A static link table (source, target) stands for the pages. Each round is a join; the frontier is part of
    the budget, which the caller sets, and so stays small.
    """
    spark = links.sparkSession
    found = spark.createDataFrame([(s, 0, i) for i, s in enumerate(seeds)], "url string, depth int, place long")
    edge, depth = found, 0
    while found.count() < budget:
        depth += 1
        new = edge.select(F.col("url").alias("source")).join(links, "source").select(F.col("target").alias("url")).distinct().join(found.select("url"), "url", "left_anti")
        best = [F.coalesce("relevance", F.lit(0)).desc(), F.col("url")]
        new = new.join(relevance, "url", "left").orderBy(*best).limit(budget)  # what is ranked is never more than the budget
        new = new.withColumn("place", F.row_number().over(Window.orderBy(*best))).select("url", F.lit(depth).alias("depth"), F.col("place").cast("long"))
        edge = new.checkpoint() if spark.sparkContext.getCheckpointDir() else new.cache()
        if edge.isEmpty():
            break
        found = found.union(edge)
    return found.orderBy("depth", "place").limit(budget)


# --- robots rules ---------------------------------------------------------------------------------------


def parse_rules(body: str | None, dialect: str = "any", agent: str = "curavine") -> list[tuple[int, str, str]]:
    """(position, allow or disallow, path) of the rules for us in a robots.txt.

    any: rules under the last "User-agent: *" line count, empty paths don't. group: the first group that names
    a part of our agent, else the group of *, where a group's agents are the lines before its rules; keep: as
    any, with empty paths kept.
    """
    lines = []
    for raw in re.split(r"\r?\n", body or ""):
        key, colon, value = raw.split("#")[0].partition(":")
        if colon:
            lines.append((key.strip().lower(), value.strip()))
    if dialect in ("any", "keep"):
        rules, ours = [], False
        for key, value in lines:
            if key == "user-agent":
                ours = value == "*"
            elif ours and key in ("allow", "disallow") and (value or dialect == "keep"):
                rules.append((key, value))
    else:
        groups: list[tuple[list[str], list[tuple[str, str]]]] = []
        for key, value in lines:
            if key == "user-agent":
                if not groups or groups[-1][1]:
                    groups.append(([], []))
                groups[-1][0].append(value.lower())
            elif key in ("allow", "disallow") and groups and value:
                groups[-1][1].append((key, value))
        named = [g for g in groups if any(a != "*" and a and a in agent.lower() for a in g[0])] or [g for g in groups if "*" in g[0]]
        rules = named[0][1] if named else []
    return [(i, k, v) for i, (k, v) in enumerate(rules)]


@F.udtf(returnType=StructType().add("ord", IntegerType()).add("kind", StringType()).add("rule", StringType()))
class RobotsRules:
    """Table function over a robots.txt."""

    def eval(self, body: str, dialect: str = "any"):
        yield from parse_rules(body, dialect)


def sitemaps(body: str | Column) -> Column:
    """Distinct http(s) URLs of a robots.txt's Sitemap lines."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(body) if isinstance(body, str) else body, F.lit("")), F.lit(r"(?im)^[ \t]*sitemap[ \t]*:[ \t]*(https?://[^\s#]+)"), F.lit(1)))


#: Tasks that the paths of one host are dealt out to for rules that have a wildcard within their first characters, and these characters.
SALTS, SHORT = 16, 3


def _rest_matches(at: str, literal: str, body: str, ends: str) -> Column:
    """Whether a path goes on from a rule's literal beginning as the rule does: its pieces between * follow one another.

    Each piece is looked for from the end of the one before, which finds a way if there is any. With a final $, the
    last piece has to be the path's end.
    """
    last = f"element_at(split({body}, '[*]'), -1)"
    pieces = f"slice(split({body}, '[*]'), 2, greatest(size(split({body}, '[*]')) - 2, 0))"
    # where the next piece may begin; 0 if one was not found
    reached = f"aggregate({pieces}, CAST(length({literal}) + 1 AS INT), (p, s) -> CASE WHEN p = 0 OR s = '' THEN p WHEN locate(s, {at}, p) = 0 THEN 0 ELSE locate(s, {at}, p) + length(s) END)"
    after = f"CASE WHEN {ends} THEN endswith({at}, {last}) AND length({at}) - length({last}) + 1 >= p ELSE {last} = '' OR locate({last}, {at}, p) > 0 END"
    wild = f"exists(array({reached}), p -> p > 0 AND {after})"
    return F.expr(f"CASE WHEN NOT contains({body}, '*') THEN NOT {ends} OR {at} = {literal} ELSE {wild} END")


def allowed(urls: DataFrame, url: str, rules: DataFrame, host: str = "host", with_query: bool = False) -> DataFrame:
    """Adds allowed: the longest matching rule of the URL's host decides, the first of equal ones; none allows.

    rules: host, ord, kind, rule. * stands for anything, a final $ for the end; lengths are counted without
    both, or, with_query, in full on path and query, where an empty rule matches nothing. A rule's beginning up to
    its first * is a prefix of the paths that it matches. Paths meet rules by an equi-join on host and prefix, with one
    prefix for each length that rules of the host have; only what follows a * is then looked for.
    """
    at = path_query(url) if with_query else path(url)
    keyed = urls.withColumn("__p", at)
    # of equal rules only the first can decide
    own = rules.groupBy(F.col(host).alias("__host"), "rule").agg(F.min_by("kind", "ord").alias("kind"), F.min("ord").alias("ord"))
    own = own.select("__host", "ord", "kind", "rule", F.endswith("rule", F.lit("$")).alias("__ends"), F.regexp_replace("rule", r"\$$", "").alias("__body"))
    own = own.where("rule <> ''") if with_query else own.where("rule is not null")
    own = own.withColumn("__prefix", F.substring_index("__body", "*", 1))
    lengths = own.groupBy("__host").agg(F.collect_set(F.length("__prefix")).alias("__lengths"))
    length = F.length("rule") if with_query else F.length(F.regexp_replace("rule", r"[*$]", ""))
    paths = keyed.select(F.col(host).alias("__host"), "__p").distinct().join(lengths, "__host")
    paths = paths.select("__host", "__p", F.explode(F.filter("__lengths", lambda n: n <= F.length("__p"))).alias("__n"))
    paths = paths.select("__host", "__p", F.left("__p", F.col("__n")).alias("__prefix"))
    # most paths of a host share the shortest prefixes: these are dealt out to several tasks, each with the rules that begin so
    short = F.length("__prefix") <= SHORT
    paths = paths.withColumn("__salt", F.when(short, F.pmod(F.xxhash64("__p"), F.lit(SALTS))).otherwise(0).cast("int"))
    own = own.withColumn("__salt", F.explode(F.when(short, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    # so many tasks however few bytes they read: what they compare is the work
    paths = paths.repartition(int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__host", "__prefix", "__salt")
    own = own.withColumn("__last", F.element_at(F.split("__body", "[*]"), -1))
    hits = paths.join(own, ["__host", "__prefix", "__salt"]).where(F.contains("__p", "__last")).where(_rest_matches("__p", "__prefix", "__body", "__ends"))
    best = hits.groupBy("__host", "__p").agg(F.max_by("kind", F.struct(length.alias("n"), (-F.col("ord")).alias("o"))).alias("__kind"))
    best = best.withColumnsRenamed({"__host": host})
    out = keyed.join(best, [host, "__p"], "left").withColumn("allowed", F.coalesce(F.col("__kind") != "disallow", F.lit(True)))
    return out.select(*urls.columns, "allowed")


@F.pandas_udf(ArrayType(StringType()))
def usable_patterns(lists: pd.Series) -> pd.Series:
    """Patterns of a site's rules, of which invalid ones are made plain text; for a table of sites, not of pages."""

    def usable(pattern: str) -> str:
        try:
            re.compile(pattern)
        except re.error:
            return re.escape(pattern)
        return pattern

    return lists.map(lambda x: None if x is None else [usable(p) for p in x if p is not None])


def adapter_accepts(signal: Column, rejects: Column, accepts: Column) -> Column:
    """Pattern lists of a site's adapter: any reject is a no; an empty list of accepts is a yes."""
    hit = lambda patterns: F.exists(patterns, lambda p: F.rlike(signal, F.concat(F.lit("(?i)"), p)))
    return ~F.coalesce(hit(rejects), F.lit(False)) & ((F.coalesce(F.size(accepts), F.lit(0)) == 0) | F.coalesce(hit(accepts), F.lit(False)))
