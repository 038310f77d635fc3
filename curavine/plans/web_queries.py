"""Registered queries over web material that Spark derives from the tables: archives, markup, sitemaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import images, weburl
from ..functions import text as T
from ..functions import url as U
from ..operators import adapters, curate, discover
from ..scratch import new_folder, written
from ..sources import archive, sitemaps
from .registry import query, table

# --- archives ----------------------------------------------------------------------------------------------


def _archived(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """The pages as archive files in the scratch folder, and their index."""
    folder = new_folder(spark, "archive")
    return written(archive.write_archive(table(spark, d, "pages").select("page_id", "url", "html"), folder), "archive-index"), folder


@query("SELECT page_id, url, length(coalesce(html, '')) AS n_chars, sha256(coalesce(html, '')) AS body_sha256 FROM pages")
def archived_pages(spark: SparkSession, d: str) -> DataFrame:
    """Bodies of archive records, read by the offsets and lengths of an index."""
    index, folder = _archived(spark, d)
    found = archive.archived(index, folder)
    return found.select("page_id", "url", F.length("body").cast("long").alias("n_chars"), F.sha2(F.col("body").cast("binary"), 256).alias("body_sha256"))


@query("SELECT coalesce(url, '') AS url, sha256(coalesce(html, '')) AS body_sha256, 200 AS status, 'text/html' AS mime, 'response' AS kind FROM pages")
def archive_records(spark: SparkSession, d: str) -> DataFrame:
    """The records of whole archives, each file read in ranges by the data source."""
    _, folder = _archived(spark, d)
    archive.register(spark)
    found = spark.read.format("curavine_archive").option("rangeBytes", 4_000_000).load(folder).where("length is not null")
    return found.select("url", F.sha2(F.col("body").cast("binary"), 256).alias("body_sha256"), "status", "mime", "kind")


# --- pictures, links and documents of pages ------------------------------------------------------------------

# the pages' markup with a picture, or a document, made of each link
_LINK = '<a href="(/[^"]*)">([^<]*)</a>'
_SHOWN = '<img data-src="{0}.png?s=1" alt=" {1}  plan"><img srcset="{0}.png?s=1 1x, /x/..{0}-2x.png 2x">'
_FILED = [('<a href="(/[a-z][^"]*)">([^<]*)</a>', '<a class=x href="{0}.pdf">Plan  <b>{1}</b></a>'), ('<a href="(/[A-M][^"]*)">([^<]*)</a>', "<a href='{0}.PDF#page=2'>{1}</a>")]
_HOST = r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1))"
_ORIGIN = "lower(regexp_extract(url, '^[a-z]+://[^/?#]+'))"


def _escaped(sql: str) -> str:
    """A path as addresses have it: letters beyond ASCII as %XX."""
    return f"array_to_string(list_transform(string_split({sql}, ''), lambda c: CASE WHEN regexp_matches(c, '^[!-~]$') THEN c ELSE url_encode(c) END), '')"


@query(rf"""
    WITH i AS (SELECT page_id, url, unnest(regexp_extract_all(html, '{_LINK}', 1)) AS link, unnest(regexp_extract_all(html, '{_LINK}', 2)) AS label, unnest(range(len(regexp_extract_all(html, '{_LINK}')))) AS i FROM pages),
    p AS (SELECT page_id, i * 2 AS place, {_ORIGIN} || {_escaped("link")} || '.png?s=1' AS address, 'data-src' AS found_in, trim(regexp_replace(label || ' plan', '\s+', ' ', 'g')) AS alt FROM i
          UNION ALL SELECT page_id, i * 2 + 1, {_ORIGIN} || {_escaped("link")} || '-2x.png', 'srcset', '' FROM i)
    SELECT page_id, address, found_in, alt FROM p QUALIFY row_number() OVER (PARTITION BY page_id, address ORDER BY place) = 1""")
def page_pictures(spark: SparkSession, d: str) -> DataFrame:
    """The pictures of pages, one made of each link: attributes, sets of sources, addresses, each once."""
    spark.udtf.register("html_pictures", images.HtmlPictures)
    shown = F.regexp_replace("html", _LINK, "<a href='$1'>$2</a>" + _SHOWN.format("$1", "$2"))
    table(spark, d, "pages").select("page_id", "url", shown.alias("html")).createOrReplaceTempView("pages_with_pictures")
    return spark.sql("SELECT page_id, i.url AS address, found_in, alt FROM pages_with_pictures p, LATERAL html_pictures(p.html, p.url) i")


@query(rf"""
    WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?href\s*=\s*["'']([^"'']+)["''][^>]*>', 1)) AS link FROM pages)
    SELECT {_ORIGIN} || {_escaped("link")} AS address, count(*) AS n, count(DISTINCT page_id) AS pages FROM l GROUP BY 1""")
def link_addresses(spark: SparkSession, d: str) -> DataFrame:
    """How often pages link to each address."""
    links = table(spark, d, "pages").select("page_id", "url", F.explode(T.links("html")).alias("l"))
    # with backslashes, and by way of other folders: the address is the same
    odd = F.regexp_replace("url", "^(https?)://([^/?#]+).*$", r"$1:\\\\$2\\x?#y")
    found = links.select("page_id", weburl.web_address(F.concat(F.lit("./z/..\\.."), F.col("l.href")), odd).alias("address"))
    return found.groupBy("address").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("pages"))


@query(rf"""
    WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '{_LINK}', 1)) AS link, unnest(regexp_extract_all(html, '{_LINK}', 2)) AS label, unnest(range(len(regexp_extract_all(html, '{_LINK}')))) AS i FROM pages),
    f AS (SELECT page_id, i, {_ORIGIN} || {_escaped("link")} || CASE WHEN regexp_matches(link, '^/[a-z]') THEN '.pdf' ELSE '.PDF#page=2' END AS document,
                 CASE WHEN regexp_matches(link, '^/[a-z]') THEN 'Plan ' ELSE '' END || trim(regexp_replace(label, '\s+', ' ', 'g')) AS label FROM l WHERE regexp_matches(link, '^/[a-zA-M]')),
    c AS (SELECT * FROM f WHERE regexp_matches(document || ' ' || label, '(?i)間取り|madori|plan|floorplan|catalog|catalogue|カタログ|プラン|商品|lineup'))
    SELECT page_id, document, label, 'review' AS status, 'pdf-rendering-not-enabled' AS reason FROM c WHERE document NOT IN (SELECT document FROM c WHERE page_id % 3 = 0) ORDER BY page_id, i LIMIT 200""")
def documents_for_review(spark: SparkSession, d: str) -> DataFrame:
    """Documents with plans that pages link to, but those processed before, within a run's number of documents."""
    spark.udtf.register("document_links", images.DocumentLinks)
    html = F.col("html")
    for pattern, to in _FILED:
        html = F.regexp_replace(html, pattern, to.format("$1", "$2"))
    table(spark, d, "pages").select("page_id", "url", html.alias("html")).createOrReplaceTempView("pages_with_documents")
    found = spark.sql("SELECT page_id, position, i.url AS document, label, '' AS picture FROM pages_with_documents p, LATERAL document_links(p.html, p.url) i")
    before = found.where("page_id % 3 = 0").select(F.col("document").alias("url"))
    review, _ = curate.route_documents(found, before, "page_id", "document", "picture", ["page_id", "position"], 200)
    return review.select("page_id", "document", "label", "status", "reason")


# --- sitemaps ------------------------------------------------------------------------------------------------


@query("""
    WITH p AS (SELECT page_id, page_id % 30 AS k, url FROM pages WHERE url IS NOT NULL),
    f AS (SELECT DISTINCT k FROM p WHERE k % 4 <> 0 ORDER BY k LIMIT 20)
    SELECT url AS loc, 'https://s.example/works-' || k || '.xml' AS sitemap, CASE WHEN page_id % 2 = 0 THEN '2024-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') ELSE '2023-12-31' END AS lastmod,
           CASE WHEN page_id % 5 = 0 THEN 2 ELSE 0 END AS images
    FROM p JOIN f USING (k) WHERE page_id % 5 = 0 OR regexp_matches(lower(url), '/plan/|/plans/|/madori/|/floorplan/|/floor-plan/|/layout/|/lineup/|/product/|/hiraya/|/works/|/case/|/example/|/model/|/housing/|/home/|間取り|施工事例|プラン|平屋|3ldk|4ldk')""")
def sitemap_tree(spark: SparkSession, d: str) -> DataFrame:
    """URLs of an index's first twenty sitemaps that are worth reading, from XML files that the pages are written to."""
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"))
    picture = lambda n: F.concat("url", F.lit(f"&<{n}>.png"))
    rows = table(spark, d, "pages").where("url is not null").select(
        F.col("url").alias("loc"), F.when(F.col("page_id") % 2 == 0, day).alias("lastmod"), F.when(F.col("page_id") % 5 == 0, F.array(picture(1), picture(2))).otherwise(F.array()).alias("images"),
        (F.col("page_id") % 30).cast("int").alias("k"),
    )
    folder = new_folder(spark, "sitemaps")
    sitemaps.write_urls(rows.repartition("k"), f"{folder}/urls", "k")
    name = F.concat(F.lit("https://s.example/"), F.when(F.col("k") % 4 == 0, "feed-").otherwise("works-"), F.col("k").cast("string"), F.lit(".xml"))
    sitemaps.write_children(rows.select("k").distinct().select(name.alias("loc"), F.lit("2023-12-31").alias("lastmod")), f"{folder}/index")
    children = sitemaps.read_children(spark, f"{folder}/index").withColumn("k", F.regexp_extract("loc", r"(\d+)", 1).cast("int"))
    first = sitemaps.first_children(children.withColumn("index", F.lit("all")), "index", "k")
    urls = sitemaps.read_urls(spark, f"{folder}/urls").withColumn("k", F.regexp_extract("sitemap", r"k=(\d+)", 1).cast("int")).withColumn("sitemap", name)
    return sitemaps.tree(first, urls).select("loc", "sitemap", "lastmod", F.size("images").alias("images"))


# --- robots rules --------------------------------------------------------------------------------------------

_RULE = """CASE page_id % 5 WHEN 0 THEN path WHEN 1 THEN left(path, 4) || '*' || right(path, 1) WHEN 2 THEN '/*' || right(path, 2) || '$' WHEN 3 THEN left(path, 5) ELSE left(path, 2) || '*/' || '*' || right(path, 3) END"""
_AT = "coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), ''), '/')"


def _robots_sql(at: str, length: str) -> str:
    """Every path against every rule of its host, by LIKE."""
    like = "replace(rtrim(rule, '$'), '*', '%') || CASE WHEN ends_with(rule, '$') THEN '' ELSE '%' END"
    return f"""
        WITH p AS (SELECT page_id, regexp_replace({_HOST}, '^(www|blog|m)\\.', '') AS host, {at} AS target, {_AT} AS path FROM pages),
        r AS (SELECT host, page_id AS ord, CASE WHEN page_id % 3 = 0 THEN 'allow' ELSE 'disallow' END AS kind, {_RULE} AS rule FROM p),
        b AS (SELECT page_id, kind FROM p JOIN r USING (host) WHERE target LIKE {like} QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY {length} DESC, ord) = 1)
        SELECT page_id, coalesce(kind <> 'disallow', true) AS allowed FROM p LEFT JOIN b USING (page_id)"""


def _robots(spark: SparkSession, d: str, with_query: bool) -> DataFrame:
    """Pages under rules that their host's pages make: one rule of each page."""
    host = F.regexp_replace(U.host("url"), r"^(www|blog|m)\.", "")
    pages = table(spark, d, "pages").select("page_id", "url", host.alias("host"), U.path("url").alias("path"))
    rules = pages.select("host", F.col("page_id").alias("ord"), F.when(F.col("page_id") % 3 == 0, "allow").otherwise("disallow").alias("kind"), F.expr(_RULE).alias("rule"))
    return discover.allowed(pages, "url", rules, "host", with_query).select("page_id", "allowed")


@query(_robots_sql(_AT, "length(replace(replace(rule, '*', ''), '$', ''))"))
def robots_by_path(spark: SparkSession, d: str) -> DataFrame:
    """The dialect that looks at paths, and counts lengths without * and $."""
    return _robots(spark, d, False)


@query(_robots_sql(f"{_AT} || regexp_extract(url, '^[^?#]*(\\?[^#]*)?', 1)", "length(rule)"))
def robots_by_path_and_query(spark: SparkSession, d: str) -> DataFrame:
    """The dialect that looks at paths with their queries, and counts lengths in full."""
    return _robots(spark, d, True)


# --- adapters ------------------------------------------------------------------------------------------------


@query(rf"""
    WITH i AS (SELECT page_id, url, regexp_replace({_HOST}, '^www\.', '') AS domain, unnest(regexp_extract_all(html, '{_LINK}', 1)) AS link, unnest(range(len(regexp_extract_all(html, '{_LINK}')))) AS i FROM pages),
    p AS (SELECT page_id, url, domain, i * 2 AS place, {_ORIGIN} || {_escaped("link")} || '.png?s=1' AS address FROM i UNION ALL SELECT page_id, url, domain, i * 2 + 1, {_ORIGIN} || {_escaped("link")} || '-2x.png' FROM i),
    o AS (SELECT *, length(domain) % 4 AS n FROM p QUALIFY row_number() OVER (PARTITION BY page_id, address ORDER BY place) = 1)
    SELECT page_id, domain || ' homes' AS company, address FROM o
    WHERE CASE n WHEN 0 THEN contains(url, '/en/') AND contains(address, '?s=1') WHEN 1 THEN NOT contains(address, '-2x')
                 WHEN 2 THEN regexp_matches(url, '[0-9]\.html|/de/') AND NOT contains(address, '?s=1') AND regexp_matches(lower(address), '^[^ ]*/[a-m][^/ ]*-2x') ELSE false END""")
def adapter_pictures(spark: SparkSession, d: str) -> DataFrame:
    """Pictures of pages that the adapters of their sites let through; some patterns are no regular expressions."""
    shown = F.regexp_replace("html", _LINK, "<a href='$1'>$2</a>" + _SHOWN.format("$1", "$2"))
    pages = table(spark, d, "pages").select("page_id", "url", U.domain("url").alias("domain"), shown.alias("html"))
    n = F.length("domain") % 4
    lists = lambda *by_n: F.element_at(F.array(*(F.array(*map(F.lit, x)).cast("array<string>") for x in by_n)), n + 1)
    sites = pages.select("domain").distinct().select(
        F.concat(F.lit("WWW."), F.upper("domain")).alias("domain"), (n != 3).alias("enabled"), F.concat("domain", F.lit(" homes")).alias("company"),
        lists(["/en/", "(x"], [], [r"[0-9]\.html", "/de/"], []).alias("page_patterns"), lists([], ["^[^ ]*-2x"], ["?s=1", "x{{"], []).alias("reject_patterns"), lists(["?s=1"], [], ["^[^ ]*/[a-m][^/ ]*-2x", "*no"], []).alias("accept_patterns"),
    )
    return adapters.adapter_pictures(pages, sites, keep=("page_id",)).select("page_id", "company", F.col("image_url").alias("address"))


# --- pictures as crawls see them -----------------------------------------------------------------------------

# file, alt text, kind and score in a crawl, score in an archived page; a null kind or score: left out
_SEEN = [
    ("madori", "", "floorplan", 210, 120), ("exterior", "x", "exterior", 20, None), ("kitchen", "4LDK", "interior", 57, None), ("logo", "x", None, None, None), ("plot", "x", "sitePlan", 70, None), ("house", "4LDK 間取り図", "floorplan", 257, 155),
    ("garden", "間取り図", "exterior", 110, 40), ("plan_3", "", "other", 0, None), ("a", "x", "other", 0, None), ("room", "x", "other", 0, None), ("icon_madori", "", None, None, None), ("b.svg?x", "間取り図", None, None, 120),
]
_SEEN_SQL = " ".join(f"SELECT {i} AS form, '{f}' AS file, {alt!r} AS alt, {'NULL' if k is None else repr(k)} AS kind, {'NULL' if s is None else s} AS crawl, {'NULL' if a is None else a} AS archive" + (" UNION ALL" if i < len(_SEEN) - 1 else "") for i, (f, alt, k, s, a) in enumerate(_SEEN))
_SEEN_ROWS = f"SELECT page_id, {_ORIGIN} || '/i/' || page_id || '/' || file || '.png' AS address, f.* FROM pages JOIN ({_SEEN_SQL}) f ON (page_id + form) % 3 = 0 WHERE url IS NOT NULL AND html IS NOT NULL"


def _with_seen(spark: SparkSession, d: str) -> DataFrame:
    """Pages with pictures of a third of the forms each."""
    one = lambda i, f, alt: F.when((F.col("page_id") + i) % 3 == 0, F.concat(F.lit(f'<p><img data-src="/i/'), F.col("page_id").cast("string"), F.lit(f'/{f}.png" alt="{alt}"></p>'))).otherwise("")  # noqa: E731, F541
    pages = table(spark, d, "pages").where("url IS NOT NULL AND html IS NOT NULL")
    return pages.select("page_id", "url", F.concat("html", *(one(i, f, alt) for i, (f, alt, *_) in enumerate(_SEEN))).alias("html"))


@query(f"SELECT page_id, address, kind, crawl AS score FROM ({_SEEN_ROWS}) WHERE kind IS NOT NULL")
def crawled_page_pictures(spark: SparkSession, d: str) -> DataFrame:
    """Kinds and scores of pages' pictures in a crawl; decorative ones and photos labelled as rooms are left out."""
    spark.udtf.register("crawled_pictures", images.CrawledPictures)
    _with_seen(spark, d).createOrReplaceTempView("pages_as_crawled")
    return spark.sql("SELECT page_id, i.url AS address, kind, score FROM pages_as_crawled p, LATERAL crawled_pictures(p.html, p.url) i")


@query(f"SELECT page_id, address, archive AS score FROM ({_SEEN_ROWS}) WHERE archive IS NOT NULL")
def archived_page_pictures(spark: SparkSession, d: str) -> DataFrame:
    """Pictures of archived pages whose names tell of plans, with their scores."""
    spark.udtf.register("archived_pictures", images.ArchivedPictures)
    _with_seen(spark, d).createOrReplaceTempView("pages_as_archived")
    return spark.sql("SELECT page_id, i.url AS address, score FROM pages_as_archived p, LATERAL archived_pictures(p.html, p.url) i")
