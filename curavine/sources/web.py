"""Saved web material: sitemaps, archive indexes and records, search and CMS answers, pasted links.

Fetching is no part of the engine: pages, answers and archive files come as tables or files.
"""

from __future__ import annotations

import gzip
import json
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ..functions.text import collapse_space, decode_references, first_filled, links, text
from ..functions.url import priority_sitemap, unwrap
from .sitemaps import in_text


def sitemap_urls(df: DataFrame, body: str, *keep: str) -> DataFrame:
    """(keep..., loc, lastmod, images) of the url blocks of sitemaps."""
    block = F.explode(F.regexp_extract_all(text(body), F.lit(r"(?is)<url\b[^>]*>(.*?)</url>"), F.lit(1))).alias("b")
    one = lambda tag: F.trim(decode_references(F.regexp_extract("b", rf"(?is)<{tag}(?:\s[^>]*)?>\s*(.*?)\s*</{tag}>", 1)))
    images = F.transform(F.regexp_extract_all("b", F.lit(r"(?is)<image:loc(?:\s[^>]*)?>\s*(.*?)\s*</image:loc>"), F.lit(1)), decode_references)
    return df.select(*keep, block).select(*keep, one("loc").alias("loc"), F.nullif(one("lastmod"), F.lit("")).alias("lastmod"), images.alias("images")).where("loc != ''")


def child_sitemaps(body: Column | str, most: int = 20) -> Column:
    """array<struct<loc,lastmod>> of the first sitemaps worth reading that an index names; the others don't count for the number."""
    decoded = F.transform(in_text(body), lambda c: F.struct(decode_references(c["loc"]).alias("loc"), c["lastmod"].alias("lastmod")))
    return F.slice(F.filter(decoded, lambda c: priority_sitemap(c["loc"])), 1, most)


def locations(body: Column | str) -> Column:
    """Distinct loc elements, whatever they stand in."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text(body), F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), decode_references))


#: Fields of an archive index record, all text as delivered.
INDEX = "url string, mime string, status string, timestamp string, digest string, filename string, offset string, length string"


def index_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """Records of an archive index's JSON lines; lines that aren't JSON objects with a URL are left out."""
    v = F.try_parse_json(column)
    fields = [f.split()[0] for f in INDEX.split(", ")]
    out = lines.select("*", *(F.try_variant_get(v, f"$.{f}", "string").alias(f"r_{f}") for f in fields)).where("r_url is not null")
    number = lambda c: F.col(c).try_cast("long")
    return out.withColumns({"r_offset": number("r_offset"), "r_length": number("r_length")})


@F.pandas_udf(StringType())
def archived_body(data: pd.Series) -> pd.Series:
    """Body of a gzipped archive record of an HTTP answer: what follows the second empty line; null if it can't be read."""

    def one(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        try:
            raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
        except (OSError, EOFError, zlib.error):
            return None
        parts = raw.split(b"\r\n\r\n", 2)
        return parts[2].decode("utf-8", "replace") if len(parts) == 3 else None

    return data.map(one)


def answers(df: DataFrame, provider: str, column: str = "value") -> DataFrame:
    """(url, page, title, thumbnail) of the pictures in an image search's JSON answer."""
    v = F.try_parse_json(column)
    # Where three providers put the list and its fields.
    items, paths = {
        "brave": ("$.results", ("$.properties.url", "$.url", "$.title", "$.thumbnail.src")),
        "google": ("$.items", ("$.link", "$.image.contextLink", "$.title", "$.image.thumbnailLink")),
        "bing": ("$.value", ("$.contentUrl", "$.hostPageUrl", "$.name", "$.thumbnailUrl")),
    }[provider]
    rows = df.select(F.explode(F.try_variant_get(v, items, "array<variant>")).alias("i"))
    get = lambda p: F.coalesce(F.try_variant_get("i", p, "string"), F.lit(""))
    return rows.select(*(get(p).alias(n) for p, n in zip(paths, ("url", "page", "title", "thumbnail")))).where("url != ''")


@F.pandas_udf(ArrayType(StructType().add("url", StringType()).add("text", StringType())))
def _topics(answers: pd.Series) -> pd.Series:
    def one(value: str | None) -> list[dict]:
        try:
            answer = json.loads(value or "")
        except (ValueError, RecursionError):
            return []
        if not isinstance(answer, dict):
            return []
        shown = lambda x: x if isinstance(x, str) else ""
        listed = lambda x: [i for i in x if isinstance(i, dict)] if isinstance(x, list) else []
        found = [(answer.get("AbstractURL"), shown(answer.get("Heading")) or shown(answer.get("AbstractText")))]
        found += [(i.get("FirstURL"), shown(i.get("Text"))) for i in listed(answer.get("Results"))]
        left = listed(answer.get("RelatedTopics"))[::-1]
        while left:
            item = left.pop()
            if isinstance(item.get("Topics"), list):
                left += listed(item["Topics"])[::-1]
            else:
                found.append((item.get("FirstURL"), shown(item.get("Text"))))
        return [{"url": u, "text": t} for u, t in found if isinstance(u, str) and u]

    return answers.map(one)


def topics(df: DataFrame, column: str = "value") -> DataFrame:
    """(url, text) of a search answer's abstract, results and related topics, however deep these nest."""
    return df.select(F.explode(_topics(F.col(column).cast("string"))).alias("i")).select("i.url", "i.text")


def posts(df: DataFrame, column: str = "value") -> DataFrame:
    """(link, modified, title, content) of a CMS's JSON answer, an array of posts."""
    rows = df.select(F.explode(F.try_variant_get(F.try_parse_json(column), "$", "array<variant>")).alias("i"))
    get = lambda p: F.try_variant_get("i", p, "string")
    return rows.select(get("$.link").alias("link"), get("$.modified_gmt").alias("modified"), get("$.title.rendered").alias("title"), get("$.content.rendered").alias("content")).where("link is not null")


def pasted(df: DataFrame, column: str = "value") -> DataFrame:
    """Distinct (url, title) of pasted text: links of markup, a JSON list or object of results, and bare URLs."""
    v = F.try_parse_json(column)
    none = F.array().cast("array<struct<href:string,anchor:string>>")
    first = lambda i, *paths: F.coalesce(*(F.nullif(F.try_variant_get(i, p, "string"), F.lit("")) for p in paths))
    item = lambda i: F.struct(first(i, "$.url", "$.href", "$.link", "$").alias("href"), F.coalesce(first(i, "$.title", "$.text", "$.label"), F.lit("")).alias("anchor"))
    listed = [F.coalesce(F.transform(F.try_variant_get(v, p, "array<variant>"), item), none) for p in ("$", "$.items", "$.links", "$.results", "$.urls")]
    bare = F.transform(F.regexp_extract_all(text(column), F.lit(r"https?://[^\s\"'<>]+"), F.lit(0)), lambda u: F.struct(u.alias("href"), F.lit("").alias("anchor")))
    every = F.concat(*listed, links(column), bare)
    rows = df.select(F.posexplode(every).alias("place", "l")).select("place", unwrap("l.href").alias("url"), F.col("l.anchor").alias("title")).where("url rlike '^https?://'")
    return rows.groupBy("url").agg(F.min_by("title", "place").alias("title"), F.min("place").alias("place"))


def flatten_package(candidates: DataFrame, images: str = "images") -> DataFrame:
    """One row per picture of crawled candidates, with what it needs of its candidate."""
    out = candidates.select("*", F.posexplode(images).alias("place", "image"))
    return out.withColumn("title", collapse_space(first_filled("image.alt", "title"))).drop(images)
