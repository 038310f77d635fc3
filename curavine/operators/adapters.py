"""Adapters of sites: which of a site's pages are read, and which of their pictures count, by pattern lists of the site.

A site's patterns are compiled once in a worker, not for each page. Pages meet their adapter by a join on the domain and
stay where the join puts them: a site may have any share of the pages, so they are not gathered by site.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import weburl
from ..functions.images import pictures
from ..functions.text import text

#: What shows that a page asks for a proof that a person reads it, and how much of the page is looked at.
_BLOCKED, _BLOCKED_CHARS = re.compile(r"captcha|recaptcha|hcaptcha|ロボットではありません", re.I), 20_000
_LISTS = ("page_patterns", "reject_patterns", "accept_patterns")


@functools.lru_cache(maxsize=4096)
def matcher(patterns: tuple[str, ...]) -> Callable[[str], bool]:
    """Whether a text matches any of some patterns, whatever the case; invalid patterns are looked for as plain text."""
    found, plain = [], []
    for p in patterns:
        try:
            found.append(re.compile(p, re.I))
        except re.error:
            plain.append(p.lower())
    return lambda value: any(p.search(value) for p in found) or any(p in value.lower() for p in plain)


def with_adapter(pages: DataFrame, adapters: DataFrame, domain: str = "domain") -> DataFrame:
    """Pages of the sites that have an enabled adapter, with its company and pattern lists.

    adapters: domain, enabled, company, page_patterns, reject_patterns, accept_patterns; null lists are empty. Domains
    are compared in lower case without a leading www. Where a domain has several adapters, the first by company counts.
    """
    bare = lambda c: F.regexp_replace(F.lower(text(c)), r"^www\.", "")
    none = F.array().cast("array<string>")
    lists = [F.filter(F.coalesce(F.col(c), none), lambda p: p.isNotNull()).alias(c) for c in _LISTS]
    own = adapters.where(F.coalesce(F.col("enabled"), F.lit(False))).select(bare("domain").alias("__domain"), F.coalesce("company", "domain").alias("company"), *lists)
    own = own.groupBy("__domain").agg(F.min_by(F.struct("company", *_LISTS), F.col("company")).alias("__a")).select("__domain", "__a.*")
    return pages.withColumn("__domain", bare(domain)).join(own, "__domain").drop("__domain")


def adapter_pictures(pages: DataFrame, adapters: DataFrame, url: str = "url", html: str = "html", domain: str = "domain", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., company, page_url, image_url, found_in, alt, near, title) of the pictures that adapters let through.

    A page is read if its URL matches one of the site's page patterns, or there are none, and it isn't a page that asks
    for a captcha. A picture counts if address, alt text, caption, context and page title match no reject pattern,
    and an accept pattern, if there are any. Null markup has no pictures.
    """
    kept = list(dict.fromkeys(keep))
    rows = with_adapter(pages, adapters, domain).select(*kept, "company", F.col(url).alias("__url"), F.col(html).alias("__html"), *_LISTS)

    def run(batches):
        for batch in batches:
            at, out = [], []
            lists = [batch.column(c).to_pylist() for c in _LISTS]
            for k, (address, page, *patterns) in enumerate(zip(batch.column("__url").to_pylist(), batch.column("__html").to_pylist(), *lists)):
                read, reject, accept = (tuple(p) for p in patterns)
                if not address or not page or (read and not matcher(read)(address)) or _BLOCKED.search(page[:_BLOCKED_CHARS]):
                    continue
                for _, image, found_in, alt, _, _, caption, near, title in pictures(page, address):
                    signal = " ".join(filter(None, (image, alt, caption, near, title)))
                    if not (reject and matcher(reject)(signal)) and (not accept or matcher(accept)(signal)):
                        at.append(k)
                        out.append((address, image, found_in, alt, near, alt or title))
            own = pa.array(at, pa.int32())
            columns = [batch.column(c).take(own) for c in (*kept, "company")] + [pa.array(c, pa.string()) for c in (zip(*out) if out else [[]] * 6)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "company", "page_url", "image_url", "found_in", "alt", "near", "title"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (*kept, "company"))
    return rows.mapInArrow(run, schema + ", page_url string, image_url string, found_in string, alt string, near string, title string")


def page_matches(url: Column | str, patterns: Column | str) -> Column:
    """Whether a URL matches one of a site's patterns, or there are none, as a column."""

    @F.arrow_udf("boolean")
    def matches(urls: pa.Array, lists: pa.Array) -> pa.Array:
        return pa.array([u is not None and (not p or matcher(tuple(x for x in p if x is not None))(u)) for u, p in zip(urls.to_pylist(), lists.to_pylist())], pa.bool_())

    return matches(url, patterns)


_LINKED = re.compile(r"(?:src|data-src|href)=[\"']([^\"']+)[\"']", re.I)


def site_pictures(pages: DataFrame, url: str = "url", html: str = "html", domain: str = "domain", keep: tuple[str, ...] = (), sites: list[tuple[str, str, str, str]] | None = None) -> DataFrame:
    """(keep..., page_url, image_url) of the plans on pages of single sites, told by the addresses of pages and files.

    sites are (domain, pages, files, files that are none), rules.SITES if not given; other domains' pages are left
    out before their markup is read. Whatever a page loads or links to counts, each address of a page once.
    """
    known = rules.SITES if sites is None else sites
    bare = F.regexp_replace(F.lower(text(domain)), r"^www\.", "")
    steps = [(bare == F.lit(d)) & text(url).rlike("(?i)" + shown) for d, shown, *_ in known]
    site = F.coalesce(*(F.when(c, F.lit(k)) for k, c in enumerate(steps)), F.lit(-1))
    kept = list(dict.fromkeys(keep))
    rows = pages.withColumn("__site", site).where("__site >= 0").select(*kept, F.col(url).alias("__url"), F.col(html).alias("__html"), "__site")
    patterns = [(re.compile(files, re.I), re.compile(none, re.I)) for _, _, files, none in known]

    def run(batches):
        for batch in batches:
            at, out = [], []
            for k, (address, page, which) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("__url", "__html", "__site")))):
                if not page or _BLOCKED.search(page[:_BLOCKED_CHARS]):
                    continue
                files, none = patterns[which]
                links = dict.fromkeys(weburl.absolute(link, address) for link in _LINKED.findall(page))
                found = [u for u in links if u and files.search(u) and not none.search(u)]
                at += [k] * len(found)
                out += [(address, u) for u in found]
            own = pa.array(at, pa.int32())
            columns = [batch.column(c).take(own) for c in kept] + [pa.array([x[i] for x in out], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "page_url", "image_url"])

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), "page_url string, image_url string"])
    return rows.mapInArrow(run, schema)
