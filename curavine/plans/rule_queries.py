"""Registered queries of the curation rules over whole tables: names, sizes and addresses of parts and pages make the
candidates. The SQL says for each form of a candidate what the rules make of it, and takes no pattern from the library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions import meta
from ..functions import score as SC
from ..functions import url as U
from ..operators import convert, curate, plans
from .registry import query, table


def _form(n: Column, forms: list[str]) -> Column:
    """The form whose turn it is, with {k} for the part's number, {name} for its name and {brand} for its brand."""
    out = F.element_at(F.array(*map(F.lit, forms)), (n % len(forms) + 1).cast("int"))
    for key, value in (("{k}", F.col("p_partkey").cast("string")), ("{name}", F.col("p_name")), ("{brand}", F.regexp_replace("p_brand", "[^0-9]", ""))):
        out = F.replace(out, F.lit(key), value)
    return out


def _sql_form(forms: list[str | None], column: str = "p_partkey") -> str:
    """The same in SQL; None is null."""
    cases = " ".join(f"WHEN {i} THEN " + ("NULL" if f is None else "'" + f.replace("'", "''") + "'") for i, f in enumerate(forms))
    return f"replace(replace(replace(CASE {column} % {len(forms)} {cases} END, '{{k}}', CAST(p_partkey AS VARCHAR)), '{{name}}', p_name), '{{brand}}', regexp_replace(p_brand, '[^0-9]', '', 'g'))"


_FLOORS = [
    ("{name} 1f", 1.0), ("{name} 2F ", 2.0), ("{name}1.5階部分", 1.5), ("{name}_2f.png", 2.0), ("{name}12階部分", 2.0), ("{name} img01.suumo.com/front/gazo/chumon/{k}/main/b_m03.jpg", 3.0),
    ("be-enough.jp/{k}/plan{k}-img02.png", 1.0), ("{name} 二階間取り", 2.0), ("{name}_heimen3.png", 3.0), ("{name}", 9.0), ("家 {k}", 9.0),
]


@query(f"SELECT p_partkey, CASE p_partkey % {len(_FLOORS)} {' '.join(f'WHEN {i} THEN {v}' for i, (_, v) in enumerate(_FLOORS))} END::DOUBLE AS floor FROM part")
def floor_orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", plans.floor_order(_form(F.col("p_partkey"), [f for f, _ in _FLOORS])).alias("floor"))


_TITLES = [
    ("{name}の1階部分間取り", "{name}間取り"), ("{name}（2階部分）間取り図", "{name} 間取り図"), ("{name}の間取り図 2枚目", "{name}の間取り図"), ("{name}   3枚目", "{name}"), ("{name} 間取り2F", "{name} 間取り"),
    ("{name} 1f", "{name}"), ("1階の間取り", ""), ("3 階部分の{name}", "の{name}"), ("{name}　二階部分 ", "{name}"), ("{name}", "{name}"),
]


@query(f"SELECT p_partkey, {_sql_form([p for _, p in _TITLES])} AS plain FROM part")
def plain_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", plans.plain_title(_form(F.col("p_partkey"), [t for t, _ in _TITLES])).alias("plain"))


# address, alt text, title, reason
_CLEANED = [
    ("https://x/madori/plan_{k}.png", "", "間取り図", ""), ("https://x/common/{k}.png", "{name}", "", "common-ui-image"), ("https://x/living{k}.jpg", "", "{name}", "room-photo"), ("https://x/page{k}", "", "", "non-image-url"),
    ("https://x/b{k}.png", "", "リビングの {name}", "photo-only-title"), ("https://x/b{k}.png", "", "打ち合わせの間取り図", "process-photo"), ("https://x/madori{k}.png", "", "打ち合わせの様子", ""), ("https://www.yuyuhome.co.jp/a{k}.png", "", "", "domain-photo-gallery"),
    ("https://www.yuyuhome.co.jp/plan{k}.png", "", "", ""), ("https://be-enough.jp/{k}/plan{k}-img01.jpg", "", "", "be-enough-site-plan-or-elevation"), ("https://sfc.jp/a{k}.png", "", "土間あり", "sfc-photo-section"), ("https://x/b{k}.png", "間取り 玄関", "", ""),
    ("https://x/{k}/thum.png", "", "", "text-or-thumbnail-image"), ("https://x/gallery{k}.png", "", "", "photo-or-system-image"), ("https://x/a{k}-300x200.png", "", "", "small-thumbnail"), ("https://genmai-home.com/a{k}.png", "", "", "blog-non-plan-image"),
    ("https://x/uploads/{k}.png", "{name}", "{name}", ""),
]


@query(f"SELECT p_partkey, CASE WHEN p_size <= 12 OR p_size > 45 THEN 'small-or-banner-image' ELSE {_sql_form([r for *_, r in _CLEANED])} END AS reason FROM part")
def cleanup_reasons(spark: SparkSession, d: str) -> DataFrame:
    form = lambda i: _form(F.col("p_partkey"), [c[i] for c in _CLEANED])
    # widths from 20 x 13 on are large enough at a height of 400; from 46 on pictures are banners
    rows = table(spark, d, "part").select("p_partkey", form(0).alias("url"), form(1).alias("alt"), form(2).alias("title"), (F.col("p_size") * 20).alias("width"), F.when(F.col("p_size") > 45, 200).otherwise(400).alias("height"))
    return rows.select("p_partkey", curate.cleanup_reason("url", "alt", "title", "width", "height").alias("reason"))


# address, alt text, title, least visual score from which it is evidence: over 1 never
_EVIDENCE = [
    ("https://x/{k}a.png", "", "{name} 間取り図", 0.55), ("https://x/img_12.png", "", "{name} 間取り図", 2), ("https://x/{k}a.png", "{name} 間取り", "", 0), ("https://x/thum.png", "間取り", "{name}", 2), ("https://x/{k}a.png", "間取り", "{name} 作成中", 2),
    ("https://x/madori{k}.png", "", "{name} 作成中", 0), ("https://www.hamaguri.co.jp/a.png", "間取り", "{name}", 2), ("https://yuyuhome.co.jp/a.png", "間取り", "平面図 {name}", 0.7), ("https://hirayakoubou.net/ys-1a-fig.png", "", "", 0.45),
    ("https://irohaie.com/like1.png", "{name}", "", 0.55), ("https://be-enough.jp/p/plan1-img04.jpg", "", "", 2), ("https://x/{k}", "{name}", "", 2),
]


@query(f"SELECT p_partkey, p_size / 50.0 >= CASE p_partkey % {len(_EVIDENCE)} {' '.join(f'WHEN {i} THEN {e[3]}' for i, e in enumerate(_EVIDENCE))} END AS evidence FROM part")
def acceptance_evidence(spark: SparkSession, d: str) -> DataFrame:
    form = lambda i: _form(F.col("p_partkey"), [e[i] for e in _EVIDENCE])
    rows = table(spark, d, "part").select("p_partkey", form(0).alias("url"), form(1).alias("alt"), form(2).alias("title"), (F.col("p_size") / 50).alias("visual"))
    return rows.select("p_partkey", SC.acceptance_evidence("url", "alt", F.lit(""), "title", F.col("visual")).alias("evidence"))


# page, picture, title, key
_PLANS = [
    ("https://cleverlyhome.com/kurashi/plan/{k}?x=1", "https://c/a.png", "{name}の1階部分", "sequence:d:https://cleverlyhome.com/kurashi/plan/{k}:3LDK:{brand}.50:{name}"), ("https://forumu.co.jp/madori/madori-{k}.html", "https://f/i/madori_9{k}.png", "", "page-image:d:https://forumu.co.jp/madori/madori-{k}.html:madori_9{k}"),
    ("https://suumo.jp/chumon/tn_x/rn_y/z/jitsurei/jc_{k}/", "https://i/a.png", "1階間取り", "detail-page:d:https://suumo.jp/chumon/tn_x/rn_y/z/jitsurei/jc_{k}/"), ("https://z/p{k}", "https://z/ie/myhome/img/{k}_8.jpg", "2階間取り", "sequence:d:https://z/p{k}:sfc-{k}-7"),
    ("https://x/p{k}", "https://x/madori{k}_2f.png?v=2", "", "image:d:https://x/madori{k}.png"), ("https://x/q{k}", "https://i/a.png", "1階間取り", "record:{k}"), ("https://x/works/{k}/", "https://i/{k}.png", "{name} 2F", "detail-page:d:https://x/works/{k}/"),
]


@query(f"SELECT p_partkey, {_sql_form([k for *_, k in _PLANS])} AS key FROM part")
def plan_keys(spark: SparkSession, d: str) -> DataFrame:
    form = lambda i: _form(F.col("p_partkey"), [p[i] for p in _PLANS])
    area = F.regexp_replace("p_brand", "[^0-9]", "").cast("double") + 0.5
    rows = table(spark, d, "part").select("p_partkey", F.lit("d").alias("domain"), form(0).alias("page"), form(1).alias("image"), form(2).alias("title"), F.lit("").alias("alt"), F.lit("3LDK").alias("layout"), area.alias("area"))
    return rows.select("p_partkey", plans.group_key("p_partkey", "domain", "page", "image", "title", "alt", "layout", "area").alias("key"))


# what pages' addresses go on with
_ENDS = ["/madori/1", "/works/3ldk?category=1", "/plan/plan12/", "/blog/a", "/company/works/floorplan", "/sitemap.xml", "/a%E9%96%93%E5%8F%96.png", "/hiraya/contact", "/layout.jpg", "", "/about"]
_BARE = "regexp_replace(url, '[?#].*$', '')"


def _sql_score(of: str, pairs: list[tuple[str, float]]) -> str:
    return "CAST(" + " + ".join(f"CASE WHEN regexp_matches({of}, '{p}') THEN {w} ELSE 0 END" for p, w in pairs) + " AS DOUBLE)"


_URL_SQL = {
    "crawl": [(r"(?i)間取り|間取|平面図|図面|madori|floor.?plan|layout|プラン集", 120), (r"[2-5]ldk|[2-5]LDK|平屋|二階建|2階建|3階建|坪|帖", 40), (r"(?i)施工事例|works|case|建築実例|実例|注文住宅|建売|分譲|gallery|construction|jitsurei|sekou", 35), (r"(?i)contact|inquiry|privacy|company|recruit|news|blog/tag|category|login|event|seminar", -60)],
    "archive": [(r"(?i)間取り図|間取り|間取|madori", 120), (r"(?i)floor.?plan|floor_plan|layout|平面図|図面", 95), (r"(?i)/works/|/case/|施工事例|建築実例", 25), (r"(?i)column|blog|news|article|まとめ|ranking", -60), (r"(?i)\.(?:jpe?g|png|webp|gif)(?:[?#].*)?$", 20)],
    "seed": [(r"(?i)/plan/plan[0-9]+/?$", 120), (r"(?i)madori|間取り|floor.?plan|floor_plan|layout|平面図|図面", 90), (r"(?i)施工事例|建築実例|works|case", 45), (r"(?i)column|blog|news|financial|english|diversity|company", -80)],
}


def _ended(spark: SparkSession, d: str) -> DataFrame:
    """Pages with addresses that go on to folders of many kinds."""
    end = F.element_at(F.array(*map(F.lit, _ENDS)), (F.col("page_id") % len(_ENDS) + 1).cast("int"))
    return table(spark, d, "pages").where("url is not null").select("page_id", F.concat(F.regexp_replace("url", r"[?#].*$", ""), end).alias("url"))


_ENDED = f"(SELECT page_id, {_BARE} || CASE page_id % {len(_ENDS)} {' '.join(f'WHEN {i} THEN {chr(39)}{e}{chr(39)}' for i, e in enumerate(_ENDS))} END AS url FROM pages WHERE url IS NOT NULL)"


@query(f"SELECT page_id, {_sql_score('url', _URL_SQL['crawl'])} AS crawl, {_sql_score('url_decode(url)', _URL_SQL['archive'])} AS archive, {_sql_score('url', _URL_SQL['seed'])} AS seed FROM {_ENDED}")
def url_scores(spark: SparkSession, d: str) -> DataFrame:
    return _ended(spark, d).select("page_id", *(U.url_score("url", step).alias(step) for step in _URL_SQL))


@query(f"""
    SELECT page_id, NOT regexp_matches(lower(url), '/news/|/blog/|/staff/|/event/|/recruit/|/privacy/|/company/|/contact/|/youtube/|/ranking/|/campaign/|/voice/|/faq/')
           AND regexp_matches(lower(url), '/plan/|/plans/|/madori/|/floorplan/|/floor-plan/|/layout/|/lineup/|/product/|/hiraya/|/works/|/case/|/example/|/model/|/housing/|/home/|間取り|施工事例|プラン|平屋|3ldk|4ldk') AS first,
           regexp_matches(lower(url), 'sitemap|post|page|works|plan|product|case|image|floor|madori') AS sitemap FROM {_ENDED}""")
def priority_urls(spark: SparkSession, d: str) -> DataFrame:
    return _ended(spark, d).select("page_id", U.priority("url").alias("first"), U.priority_sitemap("url").alias("sitemap"))


@query("""
    WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, p_name, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 7 ORDER BY l_linenumber, l_partkey, l_suppkey) AS i,
                      p_name || CASE l_linenumber % 3 WHEN 0 THEN ' 3 ldk' WHEN 1 THEN ' 2F' ELSE '' END AS alt FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'R'),
    k AS (SELECT l_orderkey, count(*) AS n, string_agg(alt, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS alts, arg_min(alt, (l_linenumber, l_partkey, l_suppkey)) AS first FROM l WHERE i = 1 GROUP BY 1)
    SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN first ELSE '家' || o_orderkey END AS title, CASE WHEN contains(alts, '3 ldk') THEN '3LDK' ELSE '4LDK' END AS layout,
           CASE WHEN contains(alts, '2F') THEN '2階建' ELSE '' END AS floors, CASE WHEN o_orderstatus = 'O' THEN '工務店' ELSE 'web' END AS company, n
    FROM k JOIN orders ON o_orderkey = l_orderkey""")
def collected_items(spark: SparkSession, d: str) -> DataFrame:
    """Orders as candidates, their parts as pictures, of which those with one address count once."""
    parts_ = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    lines = table(spark, d, "lineitem").join(parts_, "l_partkey")
    alt = F.concat("p_name", F.when(F.col("l_linenumber") % 3 == 0, " 3 ldk").when(F.col("l_linenumber") % 3 == 1, " 2F").otherwise(""))
    # the sizes of one picture have one address
    url = F.concat(F.lit("https://x/"), (F.col("l_partkey") % 7).cast("string"), F.when(F.col("l_linenumber") % 2 == 0, "-300x200").otherwise(""), F.lit(".png?v="), F.col("l_suppkey").cast("string"))
    none = F.lit(None).cast("string")
    picture = F.struct(F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("at"), F.struct(F.col("l_linenumber").cast("string").alias("id"), url.alias("url"), none.alias("data_url"), none.alias("thumbnail_url"), alt.alias("alt"), F.when(F.col("l_returnflag") == "R", "exterior").otherwise("floorplan").alias("kind")).alias("i"))
    images = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(picture)), lambda p: p["i"]).alias("images"))
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "").otherwise(F.concat(F.lit("家"), F.col("o_orderkey").cast("string"))).alias("title"), F.lit("web").alias("source"), F.when(F.col("o_orderstatus") == "O", "工務店").otherwise("").alias("company"),
        F.lit("4LDK").alias("layout"), F.lit("").alias("floors"),
    )
    out = convert.collected(orders.join(images.withColumnRenamed("l_orderkey", "id"), "id"))
    return out.select("id", "title", "layout", "floors", "company", F.size("images").cast("long").alias("n"))


_COMPANIES = [("施工会社：{name}工務店 | 家", None), ("売主 A{brand}不動産", "A{brand}不動産"), ("{name} 会社名:　木の家{k}｜x", "木の家{k}"), ("{name}", ""), ("会社名 あ", ""), ("建築会社{brand}住建 {name}", "{brand}住建")]


@query(f"SELECT p_partkey, coalesce({_sql_form([c for _, c in _COMPANIES])}, regexp_extract(p_name || '工務店', '^[^ |]{{2,40}}')) AS company FROM part")
def company_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", meta.company(_form(F.col("p_partkey"), [c for c, _ in _COMPANIES])).alias("company"))


assert set(_URL_SQL) <= set(rules.URL_SCORES)
