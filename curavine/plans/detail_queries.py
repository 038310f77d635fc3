"""Registered queries of single sources, predicates and functions, each over a whole table with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, meta
from ..functions import score as SC
from ..functions import text as T
from ..functions import url as U
from ..operators import convert, curate, discover, keys, plans, search
from ..scratch import new_folder
from ..sources import files, web
from .registry import query, table

_HOST = r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1))"
_PATH = r"coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), ''), '/')"


# --- sources -------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS line FROM orders")
def lines_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Orders written as JSON lines in one file and read again with their place in it."""
    path = new_folder(spark, "lines")
    files.write_lines(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").orderBy("o_orderkey").coalesce(1), path)
    rows = files.read_lines_in_order(spark, path, "o_orderkey long, o_orderstatus string, o_totalprice double")
    return keys.numbered_within(rows, [], ["ord"], "line").select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("line").cast("long").alias("line"))


@query("""
    SELECT page_id, url, 'text/html' AS mime, page_id * 10 AS at, CASE WHEN page_id % 5 = 0 THEN NULL ELSE page_id + 1 END AS size FROM pages WHERE page_id % 7 <> 0 AND url IS NOT NULL""")
def index_lines(spark: SparkSession, d: str) -> DataFrame:
    """Records of an archive index; every seventh line is broken, and numbers are text."""
    line = F.to_json(F.struct("url", F.lit("text/html").alias("mime"), (F.col("page_id") * 10).cast("string").alias("offset"), F.when(F.col("page_id") % 5 == 0, "x").otherwise((F.col("page_id") + 1).cast("string")).alias("length")))
    lines = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 7 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value"))
    return web.index_records(lines).select("page_id", F.col("r_url").alias("url"), F.col("r_mime").alias("mime"), F.col("r_offset").alias("at"), F.col("r_length").alias("size"))


@query(f"""
    WITH p AS (SELECT page_id, {_PATH} AS path FROM pages)
    SELECT page_id, 'any' AS dialect, 0 AS ord, 'disallow' AS kind, path AS rule FROM p UNION ALL SELECT page_id, 'any', 1, 'allow', '/a' || page_id FROM p
    UNION ALL SELECT page_id, 'keep', 0, 'disallow', path FROM p UNION ALL SELECT page_id, 'keep', 1, 'allow', '' FROM p UNION ALL SELECT page_id, 'keep', 2, 'allow', '/a' || page_id FROM p
    UNION ALL SELECT page_id, 'group', 0, 'disallow', '/g' || page_id FROM p UNION ALL SELECT page_id, 'sitemap', 0, 'sitemap', 'https://s.example/' || page_id || '.xml' FROM p""")
def robots_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Rules and sitemaps of robots.txt bodies that pages make, by three dialects."""
    spark.udtf.register("robots_rules", discover.RobotsRules)
    body = F.format_string("User-agent: x\nDisallow: /no\n\nUser-Agent: *\r\nDisallow: %s # c\nAllow:\nallow: /a%d\nuser-agent: Curavine\nDisallow: /g%d\nSitemap: https://s.example/%d.xml\nsitemap: ftp://no", U.path("url"), *[F.col("page_id")] * 3)
    pages = table(spark, d, "pages").select("page_id", body.alias("body"))
    pages.createOrReplaceTempView("pages_with_robots")
    rules = " UNION ALL ".join(f"SELECT page_id, '{k}' AS dialect, ord, kind, rule FROM pages_with_robots p, LATERAL robots_rules(p.body, '{k}')" for k in ("any", "keep", "group"))
    maps = pages.select("page_id", F.lit("sitemap").alias("dialect"), F.posexplode(discover.sitemaps("body")).alias("ord", "rule")).select("page_id", "dialect", "ord", F.lit("sitemap").alias("kind"), "rule")
    return spark.sql(rules).unionByName(maps)


@query("""
    SELECT 'https://i/' || p_partkey || '.png' AS url, 'https://p/' || p_brand AS page, p_name AS title, 'https://t/' || p_partkey AS thumbnail FROM part WHERE p_partkey % 4 <> 0""")
def image_answers(spark: SparkSession, d: str) -> DataFrame:
    """Pictures in an image search's answers, two in each; those without an address don't count."""
    k = F.col("p_partkey")
    one = F.struct(
        F.when(k % 4 != 0, F.struct(F.concat(F.lit("https://i/"), k, F.lit(".png")).alias("url"))).alias("properties"), F.concat(F.lit("https://p/"), "p_brand").alias("url"), F.col("p_name").alias("title"),
        F.struct(F.concat(F.lit("https://t/"), k).alias("src")).alias("thumbnail"),
    )
    answers = table(spark, d, "part").groupBy(F.floor(k / 2).alias("n")).agg(F.to_json(F.struct(F.collect_list(one).alias("results"))).alias("value"))
    return web.answers(answers, "brave")


@query("SELECT 'https://c/' || doc_id AS link, '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS modified, lang AS title, text AS content FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")
def cms_posts(spark: SparkSession, d: str) -> DataFrame:
    """Posts of a CMS's answers, with whole documents as their contents."""
    rendered = lambda c: F.struct(F.col(c).alias("rendered"))
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"))
    post = F.struct(F.concat(F.lit("https://c/"), "doc_id").alias("link"), day.alias("modified_gmt"), rendered("lang").alias("title"), rendered("text").alias("content"))
    rows = table(spark, d, "documents").where("text IS NOT NULL AND lang IS NOT NULL").select(F.to_json(F.array(post)).alias("value"))
    return web.posts(rows)


@query("SELECT DISTINCT url, 'x' AS title FROM pages WHERE url IS NOT NULL UNION ALL SELECT 'https://p.example/' || page_id, '' FROM pages UNION ALL SELECT 'https://j.example/' || page_id, 'j' || page_id FROM pages WHERE page_id % 3 = 0")
def pasted_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of pasted texts: markup, bare addresses and JSON lists."""
    k = F.col("page_id").cast("string")
    pages = table(spark, d, "pages")
    markup = pages.select(F.concat(F.lit('<a href="'), F.coalesce("url", F.lit("")), F.lit('">x</a> and https://p.example/'), k).alias("value"))
    listed = pages.where("page_id % 3 = 0").select(F.concat(F.lit('[{"href": "https://j.example/'), k, F.lit('", "label": "j'), k, F.lit('"}, "no link"]')).alias("value"))
    return web.pasted(markup.union(listed)).select("url", "title")


# --- predicates ------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, coalesce(nullif(CASE WHEN p_size % 3 = 0 THEN '  ' WHEN p_size % 3 = 1 THEN p_type END, '  '), 'none') AS p_type, coalesce(CASE WHEN p_size % 2 = 0 THEN p_size END, 7) AS p_size, 'new' AS status FROM part")
def defaults_filled(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, "  ").when(F.col("p_size") % 3 == 1, F.col("p_type")).alias("p_type"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("p_size"))
    return convert.with_defaults(p, {"p_type": "none", "p_size": 7, "status": "new"})


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 10 GROUP BY 1")
def lines_kept(spark: SparkSession, d: str) -> DataFrame:
    """Orders with the lines that meet a predicate; those left without any go."""
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_returnflag", "l_quantity")).alias("items"))
    return convert.filter_nested(o, "items", lambda i: (i["l_returnflag"] == "R") & (i["l_quantity"] > 10)).select("l_orderkey", F.col("n_images").cast("long").alias("n"))


@query("""
    SELECT event_id, CASE WHEN event_type = 'purchase' THEN true WHEN value < 10 THEN false WHEN event_type = 'error' THEN false WHEN event_type = 'view' AND value < 50 THEN false WHEN value / 100 >= 0.65 THEN true ELSE event_id % 2 = 0 END AS shown FROM events""")
def shown_items(spark: SparkSession, d: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    shown = convert.shown(kind == "purchase", value < 10, kind == "error", (kind == "view") & (value < 50), value / 100, F.col("event_id") % 2 == 0)
    return table(spark, d, "events").select("event_id", shown.alias("shown"))


@query(rf"""
    SELECT page_id, NOT regexp_matches(url, '/de/') AND regexp_matches(url, '/en/|/fr/') AS relevant, regexp_matches(url, 'html') OR (NOT regexp_matches(url, '/de/') AND regexp_matches(url, '/en/|/fr/')) AS excepted,
           regexp_replace({_HOST}, '^www\.', '') = (SELECT min(regexp_replace({_HOST}, '^www\.', '')) FROM pages) AND regexp_matches(url, '(?i)/EN/') AS only FROM pages WHERE url IS NOT NULL""")
def relevant_urls(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").where("url IS NOT NULL").select("page_id", "url", U.domain("url").alias("source_domain"))
    site = pages.agg(F.min("source_domain")).first()[0] or "none"
    only = curate.only(pages.withColumn("image_url", F.col("url")), site, "/EN/").select("page_id", F.lit(True).alias("only"))
    rows = pages.select("page_id", U.deny_then_allow("url", "/de/", "/en/|/fr/").alias("relevant"), U.allow_then_deny("url", "html", "/de/", "/en/|/fr/").alias("excepted"))
    return rows.join(only, "page_id", "left").withColumn("only", F.coalesce("only", F.lit(False)))


@query("SELECT p_partkey, p_size * 20 < 260 OR p_size * 7 < 180 OR (p_size * 20.0) / (p_size * 7) > 3.5 OR (p_size * 20.0) / (p_size * 7) < 0.22 AS small FROM part")
def small_pictures(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", SC.small_or_banner(F.col("p_size") * 20, F.col("p_size") * 7).alias("small"))


@query("""
    SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'disabled' WHEN s_suppkey % 9 = 0 THEN 'no-url' WHEN s_nationkey < 5 AND s_suppkey % 2 = 0 THEN 'portal-not-acknowledged' WHEN s_nationkey < 5 AND s_suppkey % 3 = 0 THEN 'portal-stores-images' END AS gate FROM supplier""")
def crawl_gates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    gate = curate.crawl_gate(F.col("s_acctbal") >= 0, F.when(k % 9 == 0, "").otherwise("u"), F.col("s_nationkey") < 5, k % 2 != 0, k % 3 == 0)
    return table(spark, d, "supplier").select("s_suppkey", gate.alias("gate"))


# --- joins, aggregates, orders -----------------------------------------------------------------------------------


@query("""
    WITH k AS (SELECT coalesce(nullif(source, ''), 'unknown') AS domain, count(*) AS candidates FROM documents GROUP BY 1)
    SELECT domain, candidates, CASE WHEN length(domain) % 3 = 0 THEN 'seen ' || domain WHEN length(domain) % 3 = 1 THEN 'before ' || domain END AS last_crawled_at FROM k""")
def quality_with_states(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of sources with the time of their last crawl: by state, or else as the run before had it."""
    docs = table(spark, d, "documents").select("source", F.lit("candidate").alias("kind"))
    names = docs.select(F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("unknown")).alias("domain")).distinct()
    n = F.length("domain") % 3
    states = names.select("domain", F.when(n == 0, F.concat(F.lit("seen "), "domain")).when(n == 1, "").alias("last_crawled_at"))
    before = names.where(n == 1).select("domain", F.concat(F.lit("before "), "domain").alias("last_crawled_at"))
    return curate.source_quality(docs, "source", "kind", states, before).select("domain", "candidates", "last_crawled_at")


@query("SELECT p_partkey // 3 AS g, 'https://t/' || (p_partkey // 3) || '_' || substr(p_brand, 7) || '_heimen1.webp' AS url FROM part WHERE p_partkey % 3 = 1 EXCEPT SELECT p_partkey // 3, 'https://t/' || (p_partkey // 3) || '_' || substr(p_brand, 7) || '_heimen1.webp' FROM part WHERE p_partkey % 3 = 0")
def companion_pictures(spark: SparkSession, d: str) -> DataFrame:
    """First floors that second floors imply and their group lacks."""
    p = table(spark, d, "part").where("p_partkey % 3 < 2")
    url = F.concat(F.lit("https://t/"), F.floor(F.col("p_partkey") / 3).cast("string"), F.lit("_"), F.substring("p_brand", 7, 9), F.when(F.col("p_partkey") % 3 == 1, "_heimen2.webp").otherwise("_heimen1.webp"))
    return plans.companions(p.select(F.floor(F.col("p_partkey") / 3).alias("g"), url.alias("url")), "g", "url", "_heimen2", "_heimen1")


@query("""
    SELECT 'image:d' || (p_partkey // 2 % 5) || ':https://x/madori' || (p_partkey // 2) || '.png' AS key, count(*) AS n, CASE WHEN count(*) = 2 THEN '2階建' ELSE '' END AS floors, CAST(min(p_size) + 0.5 AS DOUBLE) AS area,
           string_agg('https://x/madori' || (p_partkey // 2) || '_' || (p_partkey % 2 + 1) || 'f.png', ' ' ORDER BY p_partkey) AS images
    FROM part GROUP BY p_partkey // 2""")
def plan_groups(spark: SparkSession, d: str) -> DataFrame:
    """Pictures of one plan's floors as a plan, the lowest floor first; the area is that of the smallest part on a plan."""
    k = F.floor(F.col("p_partkey") / 2)
    least = F.min("p_size").over(keys.Window.partitionBy(k))
    rows = table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("d"), (k % 5).cast("string")).alias("domain"), F.lit("").alias("page_url"), F.concat(F.lit("https://x/madori"), k.cast("string"), F.lit("_"), (F.col("p_partkey") % 2 + 1).cast("string"), F.lit("f.png")).alias("image_url"),
        F.lit("").alias("title"), F.lit("").alias("alt"), F.lit("").alias("layout"), (least + 0.5).alias("area"), F.lit("").alias("floors"), F.lit("2026").alias("last_seen"),
    )
    out = plans.group_plans(rows)
    first = F.element_at("images", 1)
    plan = F.regexp_extract(first, r"madori(\d+)", 1)
    key = F.concat(F.lit("image:d"), (plan.cast("long") % 5).cast("string"), F.lit(":"), F.regexp_replace(first, "_[12]f", ""))
    return out.select(key.alias("key"), F.col("n_images").alias("n"), F.when(F.col("n_images") == 2, F.col("floors")).otherwise("").alias("floors"), F.round("area", 6).alias("area"), F.array_join("images", " ").alias("images"))


@query("SELECT s_suppkey, CAST((s_suppkey % 47 + 5) % 47 AS INTEGER) AS next_index, CAST(s_suppkey % 3 + (s_suppkey % 47 + 5) // 47 AS INTEGER) AS rounds, least(s_suppkey % 130 + 1, 120) AS runs FROM supplier")
def rotation_states(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 47).alias("next_index"), (F.col("s_suppkey") % 3).alias("completed_rounds"), F.array_repeat(F.lit("r"), (F.col("s_suppkey") % 130).cast("int")).alias("runs"))
    return curate.advance(s, 5, 47, F.lit("now")).select("s_suppkey", "next_index", F.col("completed_rounds").cast("int").alias("rounds"), F.size("runs").cast("long").alias("runs"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS oldest, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS newest FROM orders")
def result_orders(spark: SparkSession, d: str) -> DataFrame:
    """Places of all rows of a result list, by the oldest and by the newest first."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    by = lambda kind: search.order_by(kind, "o_orderdate", F.lit(""), F.lit(""), F.lit(""), "o_orderkey")
    rows = keys.numbered_within(keys.numbered_within(rows, [], by("oldest"), "oldest"), [], by("newest"), "newest")
    return rows.select("o_orderkey", F.col("oldest").cast("long").alias("oldest"), F.col("newest").cast("long").alias("newest"))


# --- functions ---------------------------------------------------------------------------------------------------


@query(rf"""
    SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, {_HOST} || ' ' || regexp_replace({_HOST}, '^[^.]*\.', '') AS suffixes,
           CASE WHEN regexp_matches({_PATH}, '/[^/]+\.[A-Za-z0-9]{{2,5}}$') THEN regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]+$', '') ELSE regexp_replace(url, '[?#].*$', '') END AS parent,
           regexp_replace({_HOST}, '^www\.', '') || regexp_replace({_PATH}, '[^/]*$', '') || '*' AS prefix FROM pages WHERE url IS NOT NULL""")
def page_parts(spark: SparkSession, d: str) -> DataFrame:
    """Attributes of a tag, suffixes of a host, the folder of an address and its index query."""
    tag = F.regexp_extract("html", "<html[^>]*>", 0)
    rows = table(spark, d, "pages").where("url IS NOT NULL")
    return rows.select("page_id", F.coalesce(T.attributes(tag)["lang"], F.lit("")).alias("lang"), F.array_join(F.slice(U.host_suffixes("url"), 1, 2), " ").alias("suffixes"), U.parent_url("url").alias("parent"), U.index_queries("url")[0].alias("prefix"))


@query("""
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '3LDK' WHEN 1 THEN '4SLDK' END AS layout, CASE WHEN p_size % 2 = 0 THEN floor(p_size * 3.305785::DOUBLE * 100 + 0.5) / 100 ELSE p_size + 0.5 END::DOUBLE AS area,
           CASE p_size % 3 WHEN 0 THEN '平屋' WHEN 1 THEN '2階建て' ELSE '3階建て' END AS floors, CASE WHEN p_partkey % 2 = 0 THEN '南東' ELSE '北' END AS direction, CAST(1000 + p_size AS DOUBLE) AS price, CASE WHEN p_partkey % 5 = 0 THEN 0.58 ELSE 0.92 END::DOUBLE AS confidence
    FROM part""")
def plan_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts from the words near a picture, or else from its page's title."""
    size = F.col("p_size").cast("string")
    rooms = F.when(F.col("p_partkey") % 4 == 0, "３LDK 3LDK ").when(F.col("p_partkey") % 4 == 1, "4SLDK ").otherwise("")
    area = F.concat(F.lit("延床面積 "), size, F.when(F.col("p_size") % 2 == 0, "坪").otherwise(".5㎡"))
    floors = F.element_at(F.array(*map(F.lit, ("平屋", "2階建て", "三階建て"))), F.col("p_size") % 3 + 1)
    said = F.concat(rooms, area, F.lit(" "), floors, F.when(F.col("p_partkey") % 2 == 0, " 南東向き").otherwise(" 玄関は北"), F.lit(" "), (F.col("p_size") + 1000).cast("string"), F.lit("万円"))
    far = F.col("p_partkey") % 5 == 0
    facts = table(spark, d, "part").select("p_partkey", meta.extract(F.when(far, said), F.when(~far, said), F.lit(""), F.lit("")).alias("m"))
    return facts.select("p_partkey", F.col("m.layout.value").alias("layout"), F.col("m.total_floor_area.value").alias("area"), F.col("m.floors.value").alias("floors"), F.col("m.entrance_direction.value").alias("direction"), F.col("m.price.value").alias("price"), F.col("m.total_floor_area.confidence").alias("confidence"))


@query("""
    SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'floorplan' WHEN 1 THEN 'exterior' WHEN 2 THEN 'interior' WHEN 3 THEN 'sitePlan' ELSE 'other' END AS kind,
           CASE p_partkey % 5 WHEN 0 THEN 210 WHEN 1 THEN 20 WHEN 2 THEN 10 WHEN 3 THEN 70 ELSE -130 END + CASE WHEN p_size % 2 = 0 THEN 47 ELSE 0 END AS score FROM part""")
def picture_scores(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of pictures by their words, and the scores of kinds and words."""
    file = F.element_at(F.array(*map(F.lit, ("madori", "exterior", "interior", "plot", "mv"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    alt, url = F.when(F.col("p_size") % 2 == 0, "4LDK").otherwise("x"), F.concat(F.lit("https://x/"), file, F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".png"))
    rows = table(spark, d, "part").select("p_partkey", alt.alias("alt"), url.alias("url"))
    kind = SC.picture_kind("alt", "url", F.lit(False))
    return rows.withColumn("kind", kind).select("p_partkey", "kind", SC.picture_score("alt", "url", F.col("kind")).alias("score"))


@query("""
    SELECT o_orderkey, contains(lower(o_orderpriority), 'high') AS high, strftime(o_orderdate, '%Y/%m/%d') AS day, CASE WHEN o_orderkey % 13 <= 1 THEN 1 WHEN o_orderkey % 13 <= 4 THEN 2 ELSE 3 END AS columns,
           left(sha256('https://x/' || o_orderkey || '||' || lower(o_orderstatus)), 16) AS weak
    FROM (SELECT *, o_orderstatus AS s FROM orders)""".replace("lower(o_orderstatus)", "o_orderstatus || '|'"))
def display_values(spark: SparkSession, d: str) -> DataFrame:
    """Keyword hits, days, grids and weak hashes, by the library's functions."""
    o = table(spark, d, "orders")
    url = F.concat(F.lit("https://X/"), F.col("o_orderkey").cast("string"), F.lit("/?utm_source=a"))
    weak = hashing.weak_hash(url, F.lit(""), F.concat(F.lit(" "), "o_orderstatus", F.lit(" ")), F.lit(""))
    return o.select("o_orderkey", T.contains_ci("o_orderpriority", " HIGH ").alias("high"), T.day(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("day"), T.grid(F.col("o_orderkey") % 13)["columns"].alias("columns"), weak.alias("weak"))
