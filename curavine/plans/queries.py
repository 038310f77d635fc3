"""Registered queries: each applies operators to whole tables; beside it stands the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions import hashing as H
from ..functions import meta
from ..functions import score as SC
from ..functions import text as T
from ..functions import url as U
from ..operators import convert, curate, discover, keys, plans, promotion, search, upsert
from ..scratch import new_folder
from ..streaming import crawl_gate, incremental, review
from . import detail_queries, rule_queries, web_queries  # noqa: F401
from .registry import QUERIES, SQL, query, table  # noqa: F401


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A short list that a configuration would hold."""
    return spark.createDataFrame(rows, schema)


# --- sources and statistics ------------------------------------------------------------------------------

_KIND = """CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 1 THEN 'rejected' WHEN l.quality = 1 THEN 'accepted' ELSE 'review' END"""


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels")
    kind = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "accepted").when(F.col("quality").isNotNull(), "review")
    j = docs.join(labels, "doc_id", "left")
    return j.select("source", F.explode(F.array_compact(F.array(F.lit("candidate"), kind))).alias("kind"))


@query("""
    WITH k AS (SELECT d.source, {kind} AS kind FROM documents d LEFT JOIN labels l USING (doc_id)),
    n AS (SELECT coalesce(nullif(source, ''), 'unknown') AS domain, count(*) AS candidates, count(*) FILTER (kind = 'accepted') AS accepted,
                 count(*) FILTER (kind = 'rejected') AS rejected, count(*) FILTER (kind = 'review') AS review FROM k GROUP BY 1)
    SELECT *, floor((2000 * accepted + candidates) / (2 * candidates)) / 1000.0 AS rate,
           CASE WHEN floor((2000 * accepted + candidates) / (2 * candidates)) / 1000.0 >= 0.3 AND accepted >= 5 THEN 'high'
                WHEN floor((2000 * accepted + candidates) / (2 * candidates)) / 1000.0 >= 0.1 THEN 'medium' ELSE 'low' END AS quality
    FROM n""".replace("{kind}", _KIND))
def source_quality(spark: SparkSession, d: str) -> DataFrame:
    return curate.source_quality(_kinds(spark, d), "source", "kind")


@query("""SELECT event_type, count(*) AS errors FROM events WHERE value < 10 GROUP BY 1""")
def error_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("status", F.when(F.col("value") < 10, "error").otherwise("ok"))
    return curate.error_counts(e, "event_type", F.col("status"))


@query("""
    SELECT count(*) AS orders, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_totalprice > 100000) AS large,
           CAST(sum(greatest(1, n)) AS BIGINT) AS at_least_one, CAST(sum(n) AS BIGINT) AS lines
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    o = table(spark, d, "orders").join(n, "o_orderkey", "left")
    counted = {"orders": F.lit(True), "finished": F.col("o_orderstatus") == "F", "large": F.col("o_totalprice") > 100000}
    return convert.totals(o, counted, F.sum(F.greatest(F.lit(1), "n")).alias("at_least_one"), F.sum("n").alias("lines"))


# --- by key ----------------------------------------------------------------------------------------------


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedupe_keep_first(spark: SparkSession, d: str) -> DataFrame:
    # the text itself isn't shuffled: its digest is the key
    rows = table(spark, d, "documents").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("k"))
    return keys.keep_first(rows, ["k"], ["doc_id"]).drop("k")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def argmax_first(spark: SparkSession, d: str) -> DataFrame:
    return keys.arg_max_first(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", "o_orderkey")


_HOST = r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1))"
_SCORE = r"(CASE WHEN regexp_matches(url, '/en/') THEN 2.0 ELSE 0.0 END + CASE WHEN regexp_matches(url, '[?&]utm_') THEN -1.0 ELSE 0.0 END + CASE WHEN regexp_matches(url, '\.html') THEN 0.5 ELSE 0.0 END)"
_WEIGHTS = [("/en/", 2.0), ("[?&]utm_", -1.0), (r"\.html", 0.5)]


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "url").withColumns({"domain": U.domain("url"), "score": U.pattern_score("url", _WEIGHTS)})


@query(rf"""
    SELECT page_id, domain, score FROM (SELECT page_id, regexp_replace({_HOST}, '^www\.', '') AS domain, CAST({_SCORE} AS DOUBLE) AS score FROM pages)
    QUALIFY row_number() OVER (PARTITION BY domain ORDER BY score DESC, page_id) <= 2""")
def top_per_host(spark: SparkSession, d: str) -> DataFrame:
    return keys.top_n(_pages(spark, d), ["domain"], [F.col("score").desc(), F.col("page_id")], 2).select("page_id", "domain", "score")


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS seen, least(0.35::DOUBLE, 0.03::DOUBLE * (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)) AS penalty FROM documents")
def diversity_penalty(spark: SparkSession, d: str) -> DataFrame:
    out = keys.seen_before(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id")
    return out.withColumns({"seen": F.col("seen").cast("long"), "penalty": F.least(F.lit(0.35), F.lit(0.03) * F.col("seen"))})


@query("""
    WITH t AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn, min(doc_id) OVER (PARTITION BY source) AS first FROM documents)
    SELECT doc_id, source, row_number() OVER (ORDER BY turn, first) AS position FROM t""")
def interleave_sources(spark: SparkSession, d: str) -> DataFrame:
    return keys.interleave(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "source", F.col("position").cast("long").alias("position"))


@query("""
    WITH f AS (SELECT *, min(CASE WHEN l_quantity > 25 THEN l_linenumber END) OVER (PARTITION BY l_orderkey) AS first FROM lineitem)
    SELECT l_orderkey, l_linenumber FROM f WHERE first IS NULL OR l_linenumber <= first""")
def first_accepted_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("l_orderkey"), "l_linenumber", (F.col("l_quantity") > 25).alias("ok"))
    return keys.first_accepted(rows, "l_orderkey", "l_linenumber", "ok").select(F.col("l_orderkey").cast("long").alias("l_orderkey"), "l_linenumber")


@query("SELECT l_orderkey, l_partkey - (l_linenumber - 1) AS island, count(*) AS n FROM lineitem GROUP BY 1, 2")
def island_groups(spark: SparkSession, d: str) -> DataFrame:
    return keys.islands(table(spark, d, "lineitem"), "l_partkey", "l_linenumber").groupBy("l_orderkey", "island").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey, l_linenumber, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS BIGINT) AS returned FROM lineitem""")
def running_matches(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("place", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return keys.running_count(li, ["l_orderkey"], "place", F.col("l_returnflag") == "R", "returned").select("l_orderkey", "l_linenumber", "returned")


@query("SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS parts, count(*) AS n FROM lineitem GROUP BY 1")
def grouped_lists(spark: SparkSession, d: str) -> DataFrame:
    one = F.struct("l_linenumber", "l_partkey")
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("m"), F.count(F.lit(1)).alias("n"))
    return g.select("l_orderkey", F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ",").alias("parts"), "n")


@query("""
    WITH flat AS (SELECT o_custkey, o_orderkey, l_partkey, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
    SELECT o_orderkey, count(*) AS kept FROM (SELECT * FROM flat QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY o_orderkey, l_linenumber) = 1) GROUP BY 1""")
def nested_items_first(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("items"))
    return keys.nested_first(li, "items", lambda i: i["l_partkey"], "o_orderkey").select("o_orderkey", F.size("items").cast("long").alias("kept"))


@query("""
    SELECT c_custkey * 2 AS id, c_name AS name FROM customer
    UNION ALL SELECT s_suppkey * 3, s_name FROM supplier WHERE s_suppkey * 3 NOT IN (SELECT c_custkey * 2 FROM customer)""")
def union_left_wins(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select((F.col("c_custkey") * 2).alias("id"), F.col("c_name").alias("name"))
    return keys.union_first(a, table(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("id"), F.col("s_name").alias("name")), ["id"], "name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000 AND o_custkey IS NOT NULL)")
def except_keys(spark: SparkSession, d: str) -> DataFrame:
    return keys.except_keys(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT n_nationkey, n_name, ((n_nationkey - 20) % 25 + 25) % 25 AS turn FROM nation WHERE ((n_nationkey - 20) % 25 + 25) % 25 < 8")
def rotating_batch(spark: SparkSession, d: str) -> DataFrame:
    return keys.rotate(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", 20, 8, 25)


# --- search ----------------------------------------------------------------------------------------------


@query("""
    SELECT p_partkey, p_name FROM part WHERE (contains(lower(p_name), 'an') OR contains(lower(p_brand), 'an') OR contains(lower(p_type), 'an'))
      AND p_brand = 'Brand#13' AND p_size >= 5 AND p_size <= 40""")
def search_facets(spark: SparkSession, d: str) -> DataFrame:
    f = search.Filters(keyword=" AN ", equals={"p_brand": "Brand#13", "p_type": "all"}, ranges={"p_size": ("5", "40"), "p_retailprice": ("", "abc")})
    return search.search(table(spark, d, "part"), f, ["p_name", "p_brand", "p_type"]).select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part WHERE CASE WHEN p_size > 10 THEN p_size END >= 12")
def search_missing_bound(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("p_size", F.when(F.col("p_size") > 10, F.col("p_size")))
    return search.search(p, search.Filters(ranges={"p_size": (12, "")}), []).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE false")
def search_unsupported(spark: SparkSession, d: str) -> DataFrame:
    f = search.Filters(keyword="a", flags={"favourite": True})
    return search.search(table(spark, d, "part"), f, ["p_name"], unsupported=["favourite"]).select("p_partkey")


@query("SELECT DISTINCT p_brand AS value FROM part WHERE p_brand <> ''")
def facet_values(spark: SparkSession, d: str) -> DataFrame:
    return search.facet(table(spark, d, "part"), F.col("p_brand"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part QUALIFY rank > 80 AND rank <= 120")
def sorted_page(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col("p_retailprice").desc(), F.col("p_partkey").asc()]
    return keys.paged(table(spark, d, "part").select("p_partkey", "p_retailprice"), order, 3, 40).select("p_partkey", F.col("rank").cast("long").alias("rank"))


@query("SELECT p_partkey, place FROM (VALUES (0, 17), (1, 5), (2, 999999999)) v(place, k) JOIN part ON p_partkey = k")
def compare_in_order(spark: SparkSession, d: str) -> DataFrame:
    return search.in_given_order(table(spark, d, "part").select("p_partkey"), "p_partkey", [17, 5, 999999999]).select("p_partkey", "place")


@query("""
    WITH m AS (SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_custkey % 500 = s_suppkey AND s_suppkey > 0
               UNION SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND CAST(floor(c_acctbal / 10) AS BIGINT) = CAST(floor(s_acctbal / 10) AS BIGINT))
    SELECT c_custkey, min(s_suppkey) AS s_suppkey FROM m GROUP BY 1""")
def same_entity(spark: SparkSession, d: str) -> DataFrame:
    bal = lambda c: F.floor(F.col(c) / 10).cast("long")
    c = table(spark, d, "customer").select("c_custkey", F.array(F.when(F.col("c_custkey") % 500 > 0, (F.col("c_custkey") % 500).cast("string")).otherwise("")).alias("cu"), F.col("c_nationkey").cast("string").alias("cn"), bal("c_acctbal").alias("cb"))
    s = table(spark, d, "supplier").select("s_suppkey", F.array(F.col("s_suppkey").cast("string")).alias("su"), F.col("s_nationkey").cast("string").alias("sn"), bal("s_acctbal").alias("sb"))
    s = s.withColumn("ord", F.col("s_suppkey"))
    return search.same_entity(c, s, "c_custkey", "s_suppkey", F.col("cu"), F.col("su"), ["cn", "cb"], ["sn", "sb"], "ord")


# --- upserts, routing, cleanup -----------------------------------------------------------------------------


@query("""
    WITH s AS (SELECT o_orderkey * 2 AS id, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS first_seen, strftime(o_orderdate, '%Y-%m-%d') AS last_seen FROM orders),
    i AS (SELECT o_orderkey * 3 AS id, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'N' END AS status, '1999-01-01' AS first_seen, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE '1996-06-01' END AS last_seen FROM orders)
    SELECT coalesce(s.id, i.id) AS id, coalesce(i.status, s.status) AS status, coalesce(s.first_seen, i.first_seen) AS first_seen,
           CASE WHEN nullif(i.last_seen, '') IS NULL THEN s.last_seen WHEN s.last_seen IS NULL OR i.last_seen > s.last_seen THEN i.last_seen ELSE s.last_seen END AS last_seen,
           CASE WHEN s.id IS NULL THEN 1 ELSE 0 END AS side
    FROM s FULL JOIN i ON s.id = i.id""")
def upsert_by_id(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    s = o.select((F.col("o_orderkey") * 2).alias("id"), F.col("o_orderstatus").alias("status"), F.col("day").alias("first_seen"), F.col("day").alias("last_seen"), F.col("o_orderkey").alias("ord"))
    i = o.select(
        (F.col("o_orderkey") * 3).alias("id"), F.when(F.col("o_orderkey") % 6 != 0, "N").alias("status"), F.lit("1999-01-01").alias("first_seen"),
        F.when(F.col("o_orderkey") % 9 == 0, "").otherwise("1996-06-01").alias("last_seen"), F.col("o_orderkey").alias("ord"),
    )
    return upsert.upsert(s, i).select("id", "status", "first_seen", "last_seen", "side")


@query("SELECT count(*) AS before, (SELECT count(*) FROM (SELECT o_orderkey * 2 AS id FROM orders UNION SELECT o_orderkey * 3 FROM orders)) AS after, (SELECT count(*) FROM orders WHERE o_orderkey * 3 NOT IN (SELECT o_orderkey * 2 FROM orders)) AS added FROM orders")
def upsert_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows before, after and added of an upsert, counted while it is written."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("status"))
    path = new_folder(spark, "upsert-counts")
    n = upsert.write_counted(o.withColumn("id", F.col("ord") * 2), o.withColumn("id", F.col("ord") * 3), lambda rows: rows.write.parquet(path))
    return spark.createDataFrame([(n["before"], n["after"], n["added"])], "before long, after long, added long")


@query("""
    SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL OR b.conf > coalesce(a.conf, -1.0) THEN b.conf ELSE a.conf END AS conf,
           CASE WHEN a.v IS NULL THEN b.v WHEN b.v IS NOT NULL AND b.c > a.c THEN b.v ELSE a.v END AS v
    FROM (SELECT p_partkey * 2 AS id, CAST(p_size AS DOUBLE) / 50 AS conf, nullif(p_brand, 'Brand#11') AS v, CAST(p_size AS DOUBLE) AS c FROM part) a
    FULL JOIN (SELECT p_partkey * 3 AS id, 0.5::DOUBLE AS conf, p_type AS v, 25.0::DOUBLE AS c FROM part) b ON a.id = b.id""")
def merge_better(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    fact = lambda v, c: F.struct(v.alias("value"), c.cast("double").alias("confidence")).alias("fact")
    a = p.select((F.col("p_partkey") * 2).alias("id"), (F.col("p_size").cast("double") / 50).alias("conf"), fact(F.nullif(F.col("p_brand"), F.lit("Brand#11")), F.col("p_size")))
    b = p.select((F.col("p_partkey") * 3).alias("id"), F.lit(0.5).cast("double").alias("conf"), fact(F.col("p_type"), F.lit(25.0)))
    return upsert.merge_accepted(a, b, "id", ["fact"], "conf", []).select("id", "conf", F.col("fact.value").alias("v"))


@query("""
    WITH c AS (SELECT c_custkey AS id, 'http://x/' || (c_custkey % 400) || '.png' AS url FROM customer)
    SELECT id FROM c WHERE id NOT IN (SELECT s_suppkey * 7 FROM supplier) AND id NOT IN (SELECT s_suppkey FROM supplier)
      AND url NOT IN (SELECT 'http://x/' || (s_suppkey + 100) || '.png' FROM supplier)""")
def admit_new(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("http://X/"), (F.col("c_custkey") % 400).cast("string"), F.lit("-300x200.png?v=1")).alias("url"))
    s = table(spark, d, "supplier")
    rejected = s.select((F.col("s_suppkey") * 7).alias("id"))
    accepted = s.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("http://x/"), (F.col("s_suppkey") + 100).cast("string"), F.lit(".png")).alias("a_url"))
    return curate.admit(c, rejected, accepted, "id", "url", "a_url").select("id")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN '2026-01-01' ELSE '2025-01-01' END AS last_seen FROM customer")
def touch_seen(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("2025-01-01").alias("last_seen"))
    return curate.touch(c, table(spark, d, "orders").select(F.col("o_custkey").alias("id")), "id", "last_seen", F.lit("2026-01-01"))


@query("""
    WITH s AS (SELECT d.doc_id, least(1.0, d.n_chars / 4000.0)::DOUBLE AS visual, l.quality, l.toxic, l.doc_id IS NOT NULL AS checked FROM documents d LEFT JOIN labels l USING (doc_id)),
    f AS (SELECT *, CASE WHEN checked THEN least(1.0, greatest(0.0, quality * 0.8::DOUBLE + visual * 0.2::DOUBLE)) ELSE least(0.84::DOUBLE, visual) END AS confidence FROM s)
    SELECT doc_id, CASE WHEN coalesce(toxic, 0) = 1 THEN 'reject' WHEN checked AND quality = 0 THEN 'reject' WHEN checked AND confidence >= 0.85 THEN 'accept'
                        WHEN confidence >= 0.6 OR visual >= 0.45 THEN 'review' ELSE 'reject' END AS route,
           CASE WHEN coalesce(toxic, 0) = 1 THEN 'hard-reject' WHEN checked AND quality = 0 THEN 'not-a-plan' WHEN checked AND confidence >= 0.85 THEN ''
                WHEN confidence >= 0.6 OR visual >= 0.45 THEN CASE WHEN checked THEN 'uncertain' ELSE 'unchecked-or-visual-only' END ELSE 'low-confidence' END AS reason
    FROM f""")
def route_three_way(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    checked = F.col("quality").isNotNull()
    j = j.withColumn("visual", F.least(F.lit(1.0), F.col("n_chars") / F.lit(4000.0)))
    j = j.withColumn("confidence", SC.final_confidence(checked, F.lit(False), F.lit(False), F.col("quality").cast("double"), F.col("visual")))
    out = curate.route(j, "visual", "confidence", checked, F.col("quality") == 1, F.coalesce(F.col("toxic") == 1, F.lit(False)), checked, F.lit(False), F.lit(True))
    # evidence is asked of accepted rows only here: unchecked ones are routed by their scores
    return out.select("doc_id", "route", "reason")


@query("""
    WITH r AS (SELECT doc_id, sha256(text) AS h, CAST(n_chars AS DOUBLE) AS score, 'u' || (doc_id % 700) AS u, CASE WHEN doc_id % 11 = 0 THEN 'rule' ELSE '' END AS reason FROM documents),
    b AS (SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY score DESC, doc_id) AS best FROM r),
    o AS (SELECT *, CASE WHEN best <> doc_id THEN 'duplicate-hash' ELSE reason END AS own FROM b),
    f AS (SELECT *, min(CASE WHEN own = '' THEN doc_id END) OVER (PARTITION BY u) AS first FROM o)
    SELECT doc_id, CASE WHEN first < doc_id THEN 'duplicate-url' ELSE own END AS why, (first IS NULL OR first >= doc_id) AND own = '' AS kept FROM f""")
def clean_accepted(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "documents").select(
        "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"), F.col("n_chars").cast("double").alias("score"),
        F.concat(F.lit("u"), (F.col("doc_id") % 700).cast("string")).alias("u"), F.when(F.col("doc_id") % 11 == 0, "rule").otherwise("").alias("reason"),
    )
    return curate.clean(r, "doc_id", "doc_id", "u", "h", "score", "reason").select("doc_id", "why", "kept")


@query("""
    SELECT o_orderkey, 'expensive' AS "check" FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT o_orderkey, 'open' FROM orders WHERE o_orderstatus = 'O'
    UNION ALL SELECT o_orderkey, 'urgent' FROM orders WHERE o_orderpriority = '1-URGENT'""")
def validate_rules(spark: SparkSession, d: str) -> DataFrame:
    checks = {"expensive": F.col("o_totalprice") > 200000, "open": F.col("o_orderstatus") == "O", "urgent": F.col("o_orderpriority") == "1-URGENT"}
    return curate.validate(table(spark, d, "orders"), "o_orderkey", checks)


@query("""
    WITH s AS (SELECT 'n' || n_nationkey AS domain, n_nationkey % 3 AS failures, 'ok' AS last_status, NULL::VARCHAR AS block_reason, TIMESTAMP '2026-01-01' AS t FROM nation),
    o AS (SELECT 'n' || (n_nationkey + 10) AS domain, n_nationkey % 2 = 0 AS ok, CASE WHEN n_nationkey % 4 = 1 THEN 'captcha' ELSE 'http' END AS reason FROM nation)
    SELECT coalesce(s.domain, o.domain) AS domain, CAST(CASE WHEN ok THEN 0 WHEN ok IS NULL THEN coalesce(failures, 0) ELSE coalesce(failures, 0) + 1 END AS INTEGER) AS failures,
           CASE WHEN ok THEN 'ok' WHEN ok IS NULL THEN last_status ELSE 'stopped' END AS last_status, CASE WHEN NOT ok THEN reason END AS block_reason,
           CASE WHEN NOT ok THEN strftime(TIMESTAMP '2026-03-01' + CASE WHEN reason = 'captcha' THEN INTERVAL 72 HOUR ELSE INTERVAL 24 HOUR END, '%Y-%m-%d %H') END AS next_crawl
    FROM s FULL JOIN o ON s.domain = o.domain""")
def backoff_state(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").withColumn("domain", F.concat(F.lit("n"), F.col("n_nationkey").cast("string")))
    s = n.select("domain", (F.col("n_nationkey") % 3).alias("failures"), F.lit("ok").alias("last_status"), F.lit(None).cast("string").alias("block_reason"), F.lit(None).cast("timestamp_ntz").alias("next_crawl_after"), F.expr("timestamp_ntz'2026-01-01'").alias("last_crawled_at"))
    o = n.select(F.concat(F.lit("n"), (F.col("n_nationkey") + 10).cast("string")).alias("domain"), (F.col("n_nationkey") % 2 == 0).alias("ok"), F.when(F.col("n_nationkey") % 4 == 1, "captcha").otherwise("http").alias("reason"))
    out = curate.next_state(s, o, F.expr("timestamp_ntz'2026-03-01'"), {"captcha": 72})
    return out.select("domain", F.col("failures").cast("int").alias("failures"), "last_status", "block_reason", F.date_format("next_crawl_after", "yyyy-MM-dd HH").alias("next_crawl"))


@query("SELECT event_id FROM events WHERE value IS NULL OR ts <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
def due_now(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("next_crawl_after", F.when(F.col("value").isNotNull(), F.col("ts")))
    now = e.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("now"))
    return curate.due(e.crossJoin(F.broadcast(now)), F.col("now")).select("event_id")  # now is one row


_ANSWER = """CASE WHEN quality IS NULL THEN NULL WHEN doc_id % 11 = 0 THEN 'no {{answer' WHEN doc_id % 13 = 0 THEN '{{"isFloorplan": true}}' ELSE
    concat('Sure: {{"category": "', CASE WHEN doc_id % 7 = 0 THEN 'photo' ELSE 'floorplan' END, '", "isFloorplan": ', CASE WHEN quality = 1 THEN 'true' ELSE 'false' END, ', "isTopDownPlan": ', CASE WHEN doc_id % 5 = 0 THEN '"true"' ELSE 'true' END,
           ', "hasWallsOrRoomBoundaries": ', CASE WHEN doc_id % 3 = 0 THEN 'null' ELSE 'true' END, ', "confidence": ', CASE WHEN doc_id % 17 = 0 THEN '1.7' WHEN doc_id % 2 = 0 THEN '0.95' ELSE '0.8' END, '}} ok') END"""


@query("""
    WITH a AS (SELECT d.doc_id, least(1.0, n_chars / 4000.0)::DOUBLE AS visual, quality, toxic, doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND quality IS NOT NULL AS checked FROM documents d LEFT JOIN labels l USING (doc_id)),
    f AS (SELECT *, checked AND quality = 1 AS is_plan, checked AND doc_id % 5 <> 0 AS top_down, checked AND doc_id % 3 <> 0 AS walls, CASE WHEN NOT checked THEN 0.0 WHEN doc_id % 17 = 0 THEN 1.0 WHEN doc_id % 2 = 0 THEN 0.95 ELSE 0.8 END::DOUBLE AS c, doc_id % 4 <> 0 AS named FROM a),
    g AS (SELECT *, is_plan AND top_down AND walls AND doc_id % 7 <> 0 AS full_flags, least(1.0, greatest(0.0, c * 0.8::DOUBLE + visual * 0.2::DOUBLE)) AS weighted FROM f),
    h AS (SELECT *, CASE WHEN NOT checked THEN least(0.84::DOUBLE, visual) WHEN full_flags AND named THEN greatest(weighted, least(0.97::DOUBLE, c * 0.92::DOUBLE + visual * 0.08::DOUBLE + 0.02::DOUBLE)) ELSE weighted END AS confidence FROM g)
    SELECT doc_id, CASE WHEN quality IS NULL THEN 'unchecked' WHEN checked THEN 'checked' ELSE 'error' END AS status, is_plan, top_down, walls, full_flags,
           CASE WHEN coalesce(toxic, 0) = 1 THEN 'reject' WHEN checked AND NOT is_plan THEN 'reject' WHEN full_flags AND confidence >= 0.85 AND named THEN 'accept'
                WHEN confidence >= 0.6 OR visual >= 0.45 OR named OR quality IS NOT NULL THEN 'review' ELSE 'reject' END AS route
    FROM h""")
def promoted(spark: SparkSession, d: str) -> DataFrame:
    """Documents as candidates with a model's answers: accepted are those with all four flags, and words for a plan."""
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    rows = rows.select(
        "doc_id", F.least(F.lit(1.0), F.col("n_chars") / F.lit(4000.0)).alias("visual"), F.when(F.col("doc_id") % 4 == 0, "https://x.jp/uploads/a.png").otherwise("https://x.jp/uploads/madori_1.png").alias("image_url"),
        F.lit("").alias("alt"), F.lit("").alias("caption"), F.lit("").alias("title"), F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).alias("hard_rejects"), promotion.model_review(F.expr(_ANSWER.replace("{{", "{").replace("}}", "}"))).alias("review"),
    )
    out = promotion.promote(rows)
    return out.select("doc_id", "review.status", "review.is_plan", "review.top_down", "review.walls", promotion.fully_positive("review").alias("full_flags"), "route")


@query("""
    WITH c AS (SELECT doc_id, coalesce(source, '') AS domain, least(1.0, n_chars / 4000.0)::DOUBLE AS visual, CASE WHEN quality IS NULL THEN 'unchecked' WHEN toxic = 1 THEN 'error' ELSE 'checked' END AS status FROM documents LEFT JOIN labels USING (doc_id)),
    e AS (SELECT *, count(*) FILTER (status = 'error') OVER (PARTITION BY domain) AS errors, row_number() OVER (PARTITION BY domain ORDER BY doc_id) - 1 AS seen FROM c),
    p AS (SELECT *, visual + CASE WHEN doc_id % 3 = 0 THEN 0.35::DOUBLE ELSE 0 END - CASE WHEN doc_id % 5 = 0 THEN 0.6::DOUBLE ELSE 0 END - least(1.0, errors * 0.3::DOUBLE) - CASE WHEN status = 'checked' THEN 0.4::DOUBLE ELSE 0 END
                    - CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END - least(0.35::DOUBLE, seen * 0.03::DOUBLE) AS priority FROM e)
    SELECT doc_id, errors, seen, round(priority, 6) AS priority, row_number() OVER (ORDER BY priority DESC, doc_id) AS place FROM p""")
def promotion_order(spark: SparkSession, d: str) -> DataFrame:
    """The order in which documents, as candidates, are looked at: errors of their source, running numbers within it, a place among all."""
    rows = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    rows = rows.select(
        "doc_id", F.col("source").alias("domain"), F.least(F.lit(1.0), F.col("n_chars") / F.lit(4000.0)).alias("visual"), F.when(F.col("quality").isNull(), "unchecked").when(F.col("toxic") == 1, "error").otherwise("checked").alias("model_status"),
        F.concat(F.lit("https://x.jp/i/"), F.when(F.col("doc_id") % 3 == 0, "madori").otherwise("a"), F.when(F.col("doc_id") % 5 == 0, "_photo").otherwise(""), F.lit(".png")).alias("image_url"),
        F.lit("").alias("alt"), F.lit("").alias("caption"), F.lit("").alias("title"), F.when(F.col("doc_id") % 7 == 0, "https://x.jp/a.pdf").alias("pdf_url"),
    )
    out = promotion.promotion_order(rows, "doc_id")
    return out.select("doc_id", "errors", F.col("seen").cast("long").alias("seen"), F.round("priority", 6).alias("priority"), F.col("place").cast("long").alias("place"))


@query("""
    WITH b AS (SELECT event_id AS ord, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'log' || (event_id % 500) END AS id, strftime(ts, '%Y-%m-%d') AS created, event_type AS site, CAST(user_id AS VARCHAR) AS url, 'm' AS message, 0 AS side FROM events WHERE event_id % 2 = 0
               UNION ALL SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'log' || (event_id % 700) END, strftime(ts, '%Y-%m-%d'), event_type, CAST(user_id AS VARCHAR), 'm', 1 FROM events WHERE event_id % 2 = 1)
    SELECT ord, id FROM b QUALIFY row_number() OVER (PARTITION BY coalesce(nullif('i' || id, 'i'), 'k' || created || ':' || site || ':' || url || ':' || message) ORDER BY side, ord) = 1""")
def merged_logs(spark: SparkSession, d: str) -> DataFrame:
    """The logs of two crawls, each entry once."""
    e = table(spark, d, "events")
    own = lambda rest, n, none: e.where(F.col("event_id") % 2 == rest).select(
        F.col("event_id").alias("ord"), F.when(F.col("event_id") % 3 == 0, F.lit(none)).otherwise(F.concat(F.lit("log"), (F.col("event_id") % n).cast("string"))).alias("id"),
        F.date_format("ts", "yyyy-MM-dd").alias("created"), F.col("event_type").alias("site"), F.col("user_id").cast("string").alias("url"), F.lit("m").alias("message"),
    )
    return promotion.merge_logs(own(0, 500, ""), own(1, 700, None), "ord").select("ord", "id")


# --- discovery -------------------------------------------------------------------------------------------


@query(rf"""
    WITH p AS (SELECT page_id, url, regexp_replace({_HOST}, '^www\.', '') AS domain, CAST({_SCORE} AS DOUBLE) AS score, regexp_extract(url, '://[^/]+/([a-z]+)/', 1) AS q FROM pages)
    SELECT domain, count(*) AS records, count(*) FILTER (contains(url, '.html')) AS html_records, count(*) FILTER (contains(url, '?')) AS image_records, sum(score) AS score,
           array_to_string(list_sort(list(DISTINCT q)), ',') AS queries, array_to_string(list(url ORDER BY page_id)[1:2], ' ') AS samples
    FROM p GROUP BY 1""")
def domain_discovery(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d).withColumn("q", F.regexp_extract("url", "://[^/]+/([a-z]+)/", 1))
    s = discover.domain_summary(p, "domain", "score", "q", "url", "page_id", F.contains("url", F.lit("?")), F.contains("url", F.lit(".html")), samples=2)
    return s.select("domain", "records", "html_records", "image_records", "score", F.array_join("queries", ",").alias("queries"), F.array_join("sample_urls", " ").alias("samples"))


@query(rf"""
    WITH p AS (SELECT page_id, url, {_HOST} AS host, CAST({_SCORE} AS DOUBLE) AS score FROM pages),
    h AS (SELECT host, arg_min(score, page_id) AS first, min(page_id) AS page, CASE WHEN min(page_id) % 5 < 2 THEN min(page_id) % 5 END AS existing FROM p GROUP BY 1),
    t AS (SELECT *, coalesce(existing, 0) AS n FROM h ORDER BY coalesce(existing, 0), first DESC, page LIMIT 20)
    SELECT page_id, t.host, CAST(n AS BIGINT) AS existing, row_number() OVER (PARTITION BY t.host ORDER BY p.score DESC, page_id) AS rank FROM p JOIN t ON p.host = t.host
    QUALIFY rank <= 2""")
def site_selection(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", "url", U.host("url").alias("host"), U.pattern_score("url", _WEIGHTS).alias("score"))
    known = p.groupBy("host").agg(F.min("page_id").alias("m")).select("host", (F.col("m") % 5).alias("existing")).where("existing < 2")
    out = discover.select_sites(p, "host", "score", "page_id", known, 20, 2)
    return out.select("page_id", "host", F.col("existing").cast("long").alias("existing"), F.col("rank").cast("long").alias("rank"))


_BLOCKED = ["example.org", "m.ththth.example.net", "com"]


@query(rf"""
    SELECT page_id FROM (SELECT page_id, {_HOST} AS h FROM pages)
    WHERE NOT (h = 'example.org' OR ends_with(h, '.example.org') OR h = 'm.ththth.example.net' OR ends_with(h, '.m.ththth.example.net') OR h = 'com' OR ends_with(h, '.com'))""")
def block_list(spark: SparkSession, d: str) -> DataFrame:
    return discover.not_blocked(table(spark, d, "pages").select("page_id", "url"), "url", _values(spark, [(b,) for b in _BLOCKED], "domain string")).select("page_id")


_ROBOTS = [(0, "disallow", "/fr/"), (1, "allow", "/fr/8*"), (2, "disallow", "/*0$"), (3, "allow", "/en/"), (4, "disallow", "/de/")]


@query(r"""
    WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages),
    r AS (SELECT * FROM (VALUES (0, 'disallow', '^/fr/', 4), (1, 'allow', '^/fr/8.*', 5), (2, 'disallow', '^/.*0$', 2), (3, 'allow', '^/en/', 4), (4, 'disallow', '^/de/', 4)) v(ord, kind, re, n)),
    b AS (SELECT page_id, kind FROM p JOIN r ON regexp_matches(path, re) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC, ord) = 1)
    SELECT page_id, coalesce(kind <> 'disallow', true) AS allowed FROM p LEFT JOIN b USING (page_id)""")
def robots_longest_match(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", "url", F.lit("any").alias("host"))
    return discover.allowed(p, "url", _values(spark, [("any", *r) for r in _ROBOTS], "host string, ord int, kind string, rule string")).select("page_id", "allowed")


@query("SELECT r_name, n_name, replace('houses in {place}, ' || r_name, '{place}', n_name) AS query FROM region CROSS JOIN nation")
def template_expansion(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "region").select("r_name", F.concat(F.lit("houses in {place}, "), "r_name").alias("t"))
    return discover.expand(t, table(spark, d, "nation").select("n_name"), "t", "n_name", "{place}").drop("t")


# --- text, URLs, identifiers -------------------------------------------------------------------------------

_TEXT = r"regexp_replace(regexp_replace({}, '<[^>]+>', ' ', 'g'), '[\s\x{{a0}}\x{{3000}}]+', ' ', 'g')"
_DECODED = "replace(replace(replace(replace(replace(replace({}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' ')"


def _sql_tag(tag: str) -> str:
    raw = rf"regexp_extract(html, '(?is)<{tag}\b[^>]*>(.*?)</{tag}>', 1)"
    stripped = rf"regexp_replace({raw}, '<[^>]+>', ' ', 'g')"
    return rf"trim(regexp_replace({_DECODED.format(stripped)}, '[\s\x{{a0}}\x{{3000}}]+', ' ', 'g'))"


@query(rf"""SELECT page_id, {_sql_tag('title')} AS title, {_sql_tag('h1')} AS h1,
            len(regexp_extract_all(html, '(?is)<a\b[^>]*?href\s*=\s*["'']([^"'']+)["''][^>]*>(.*?)</a>')) AS n_links FROM pages""")
def page_heads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.tag_text("html", "title").alias("title"), T.tag_text("html", "h1").alias("h1"), F.size(T.links("html")).cast("long").alias("n_links"))


@query(r"""
    WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?href\s*=\s*["'']([^"'']+)["''][^>]*>', 1)) AS href FROM pages)
    SELECT href, count(*) AS n FROM l GROUP BY 1""")
def link_targets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.explode(T.links("html")).alias("l")).groupBy(F.col("l.href").alias("href")).agg(F.count(F.lit(1)).alias("n"))


@query(rf"""
    WITH u AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS b FROM pages)
    SELECT page_id, {_HOST} AS host, regexp_replace({_HOST}, '^www\.', '') AS domain,
           lower(regexp_replace(rtrim(regexp_replace(regexp_replace(regexp_replace(b, '([?&])(utm_source|utm_medium|utm_campaign|utm_term|utm_content|fbclid|gclid|yclid)=[^&]*', '\1', 'g'), '&+', '&', 'g'), '\?&', '?'), '?&'), '/$', '')) AS key,
           b AS no_fragment, lower(regexp_replace(url, '[?#].*$', '')) AS no_query,
           lower(coalesce(nullif(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+(/[^?#]*)', 1), ''), '/')) AS path
    FROM u""")
def url_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(
        "page_id", U.host("url").alias("host"), U.domain("url").alias("domain"), U.without_tracking("url").alias("key"), U.without_fragment("url").alias("no_fragment"),
        U.without_query("url").alias("no_query"), U.parts("url")["path"].alias("path"),
    )


@query("""
    SELECT page_id, sha256(array_to_string(list_filter([url, '', CAST(page_id AS VARCHAR)], lambda x: x <> ''), '|')) AS stable_id, left(sha1(url), 16) AS sha1_16, left(sha1(url), 10) AS sha1_10,
           left(sha256(lower(regexp_replace(url, '[?#].*$', '')) || '||' || CAST(page_id AS VARCHAR)), 16) AS weak
    FROM pages""")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", "url")
    weak = F.substring(F.sha2(F.concat_ws("|", U.without_query("url"), F.lit(""), F.col("page_id").cast("string")), 256), 1, 16)
    return p.select("page_id", H.stable_id("url", F.lit(""), F.col("page_id").cast("string")).alias("stable_id"), H.short_sha1("url").alias("sha1_16"), H.short_sha1("url", 10).alias("sha1_10"), weak.alias("weak"))


def _clean(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\x{{a0}}\x{{3000}}]+', ' ', 'g'))"


@query(f"SELECT doc_id, left({_clean('text')}, 500) AS snippet, length({_clean('text')}) AS n FROM documents")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.snippet("text").alias("snippet"), F.length(T.collapse_space("text")).cast("long").alias("n"))


@query(f"""
    SELECT p_partkey, CASE WHEN p_retailprice <> 0 THEN floor(p_retailprice / 3.305785::DOUBLE * 100 + 0.5) / 100 END AS tsubo,
           array_to_string(list_filter(list_transform(regexp_split_to_array(p_name || ', #' || p_brand || '、x', '[,\n、#]+'), lambda x: {_clean('x')}), lambda x: x <> ''), '|') AS tags,
           left({_clean("regexp_replace(p_name || '/a:b', '[\\\\/:*?<>|]+', '_', 'g')")}, 80) AS filename
    FROM part""")
def part_labels(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(
        "p_partkey", T.area_to_tsubo("p_retailprice").alias("tsubo"), F.array_join(T.parse_tags(F.concat("p_name", F.lit(", #"), "p_brand", F.lit("、x"))), "|").alias("tags"),
        T.safe_filename(F.concat("p_name", F.lit("/a:b"))).alias("filename"),
    )


@query("""
    SELECT p_partkey, place, label, value FROM (
        SELECT p_partkey, 0 AS place, 'brand' AS label, p_brand AS value FROM part UNION ALL SELECT p_partkey, 1, 'type', p_type FROM part UNION ALL SELECT p_partkey, 2, 'size', CAST(p_size AS VARCHAR) FROM part)
    WHERE value <> ''""")
def label_rows(spark: SparkSession, d: str) -> DataFrame:
    return convert.labels(table(spark, d, "part"), "p_partkey", {"brand": F.col("p_brand"), "type": F.col("p_type"), "size": F.col("p_size")})


_KIND_SQL = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in rules.BLOCK_PAGES)


@query(rf"""
    WITH s AS (SELECT doc_id, lower(left(trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[\s\x{{a0}}\x{{3000}}]+', ' ', 'g')), 4000)) AS t FROM documents)
    SELECT doc_id, CASE {_KIND_SQL} END AS kind FROM s""")
def block_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", curate.block_page("text").alias("kind"))


def _sql_visual() -> str:
    tokens = " + ".join(f"CASE WHEN regexp_matches(s, '(?i){p}') THEN 0.18::DOUBLE ELSE 0 END" for p in rules.PLAN_TOKENS)
    evidence = " OR ".join(f"regexp_matches(s, '(?i){p}')" for p in rules.PLAN_TOKENS)
    rejects = " + ".join(f"CASE WHEN regexp_matches(s, '(?i){p}') AND NOT ({spared} AND ({evidence})) THEN 1 ELSE 0 END" for p, spared in rules.HARD_REJECTS)
    category = " ".join(f"WHEN regexp_matches(s, '(?i){p}') THEN '{n}'" for n, p in rules.REJECT_CATEGORIES)
    return f"""
        WITH t AS (SELECT page_id, {_clean("lower(regexp_replace(url, '[?#].*$', '')) || ' ' || " + _sql_tag('title'))} AS s FROM pages),
        v AS (SELECT page_id, s, {tokens} AS tokens, {rejects} AS rejects,
                     CASE WHEN regexp_matches(s, '(?i){rules.PAGE_CONTEXT}') THEN 0.12::DOUBLE ELSE 0 END AS context,
                     CASE WHEN regexp_matches(s, '(?i){rules.GENERIC_FILE}') THEN 0.08::DOUBLE ELSE 0 END AS generic FROM t)
        SELECT page_id, CAST(rejects AS BIGINT) AS rejects, round(least(1.0, greatest(0.0, 0.25 + tokens + context - generic - rejects * 0.35::DOUBLE)), 6) AS score,
               CASE WHEN rejects > 0 THEN CASE {category} ELSE 'other' END ELSE 'unknown' END AS category FROM v"""


@query(_sql_visual())
def visual_scores(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "pages").select("page_id", T.collapse_space(F.concat_ws(" ", U.without_query("url"), T.tag_text("html", "title"))).alias("s"))
    v = s.select("page_id", SC.visual(F.col("s"), F.col("s"), F.lit(None), F.lit(None)).alias("v"))
    return v.select("page_id", F.size("v.hard_rejects").cast("long").alias("rejects"), F.round("v.score", 6).alias("score"), F.col("v.category").alias("category"))


# --- incremental and nested --------------------------------------------------------------------------------


@query("""
    WITH w AS (SELECT event_type, max(ts) - INTERVAL 2 DAY AS w FROM events WHERE event_type <> 'purchase' GROUP BY 1)
    SELECT event_id FROM events LEFT JOIN w USING (event_type) WHERE w IS NULL OR ts > w""")
def new_since_watermark(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    state = e.where("event_type <> 'purchase'").groupBy("event_type").agg((F.max("ts") - F.expr("INTERVAL 2 DAY")).alias("watermark"))
    return incremental.new_since(e, state, "event_type", "ts").select("event_id")


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream of its files; the pattern also finds a table that is one file."""
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name[:-1]}[{name[-1]}].parquet")


@query(SQL["new_since_watermark"])
def news_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same from a stream, whose state begins with the marks."""
    e = table(spark, d, "events")
    marks = e.where("event_type <> 'purchase'").groupBy("event_type").agg((F.max("ts") - F.expr("INTERVAL 2 DAY")).alias("watermark"))
    out = crawl_gate.news(_stream(spark, d, "events").select("event_id", "event_type", "ts"), "event_type", "ts", marks)
    return crawl_gate.run_available(out, new_folder(spark, "news")).select("event_id")


@query("""
    WITH RECURSIVE e AS (SELECT event_id, user_id, ts, value >= 10 AS ok, CASE event_type WHEN 'purchase' THEN 72 WHEN 'error' THEN 6 ELSE 24 END AS hours FROM events),
    v AS (SELECT user_id, event_id, ts, CASE WHEN ok THEN 0 ELSE 1 END AS failures, CASE WHEN NOT ok THEN ts + to_hours(hours) END AS until
          FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1
          UNION ALL
          SELECT user_id, event_id, ts, CASE WHEN ok THEN 0 ELSE failures + 1 END, CASE WHEN NOT ok THEN ts + to_hours(hours) END
          FROM (SELECT e.*, v.failures, row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS i
                FROM v JOIN e ON e.user_id = v.user_id AND (e.ts > v.ts OR e.ts = v.ts AND e.event_id > v.event_id) AND e.ts >= coalesce(v.until, v.ts)) WHERE i = 1)
    SELECT e.event_id, v.event_id IS NOT NULL AS admitted, CAST(last_value(failures IGNORE NULLS) OVER w AS INTEGER) AS failures,
           strftime((last_value(CASE WHEN v.event_id IS NOT NULL THEN {'u': until} END IGNORE NULLS) OVER w).u, '%Y-%m-%d %H:%M:%S') AS until
    FROM e LEFT JOIN v USING (event_id) WINDOW w AS (PARTITION BY e.user_id ORDER BY e.ts, e.event_id ROWS UNBOUNDED PRECEDING)""")
def visits_after_back_off(spark: SparkSession, d: str) -> DataFrame:
    """Which visits back-offs let through: a stream with state and timers for each user."""
    e = _stream(spark, d, "events")
    out = crawl_gate.back_off(e, "user_id", "event_id", "ts", F.col("value") >= 10, F.col("event_type"), {"purchase": 72, "error": 6})
    visits = crawl_gate.run_available(out, new_folder(spark, "visits")).where("kind = 'visit'")
    return visits.select(F.col("visit").alias("event_id"), "admitted", "failures", F.date_format("until", "yyyy-MM-dd HH:mm:ss").alias("until"))


@query("""
    WITH p AS (SELECT event_id, event_type, value, event_type = 'signup' AS checked, CASE event_type WHEN 'purchase' THEN 0 WHEN 'error' THEN 5 ELSE 1 END AS priority FROM events),
    b AS (SELECT event_id FROM p WHERE NOT checked ORDER BY priority, event_id LIMIT 300)
    SELECT event_id, b.event_id IS NOT NULL AS asked,
           CASE WHEN checked THEN value >= 50 WHEN b.event_id IS NOT NULL AND event_id % 5 <> 0 THEN event_id % 2 = 0 AND value / 100 >= 0.65 AND event_type <> 'error' ELSE true END AS kept
    FROM p LEFT JOIN b USING (event_id)""")
def review_within_budget(spark: SparkSession, d: str) -> DataFrame:
    """A review pass over a stream, with a budget of questions in its state."""
    e = _stream(spark, d, "events").select("event_id", "event_type", "value")
    answers = table(spark, d, "events").where("event_id % 5 <> 0").select("event_id", (F.col("event_id") % 2 == 0).alias("is_plan"), (F.col("value") / 100).alias("confidence"))
    kind = F.col("event_type")
    priority = F.when(kind == "purchase", 0).when(kind == "error", 5).otherwise(1)
    out = review.review_stream(e, answers, "event_id", "event_id", priority, kind == "signup", F.col("value") >= 50, kind == "error", 300)
    return crawl_gate.run_available(out, new_folder(spark, "review")).select("event_id", "asked", "kept")


@query("SELECT event_type, max(event_id) AS watermark FROM events GROUP BY 1")
def raised_watermarks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", "event_id")
    state = e.groupBy("event_type").agg(F.min("event_id").alias("watermark"))
    return incremental.raise_watermarks(e, state, "event_type", "event_id")


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)")
def processed_set(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return incremental.not_processed(e, table(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id")), "user_id").select("event_id")


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k"))


@query("""
    WITH g AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) AS q, list(DISTINCT l_returnflag) AS f FROM lineitem GROUP BY 1)
    SELECT l_orderkey, len(list_filter(q, lambda x: x > 30)) AS large, list_sum(q) AS total, len(list_filter(q, lambda x: x = 50)) > 0 AS any_50, array_to_string(list_sort(f), ',') AS flags,
           list_filter(q, lambda x: x > 30)[1] AS first_large FROM g""")
def array_functions(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("m"), F.collect_set("l_returnflag").alias("f"))
    q = F.transform("m", lambda x: x["l_quantity"])
    large = F.filter(q, lambda x: x > 30)
    return g.select(
        "l_orderkey", F.size(large).cast("long").alias("large"), F.aggregate(q, F.lit(0.0), lambda a, x: a + x).alias("total"), F.exists(q, lambda x: x == 50).alias("any_50"),
        F.array_join(F.array_sort("f"), ",").alias("flags"), F.try_element_at(large, F.lit(1)).alias("first_large"),
    )


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def review_budget(spark: SparkSession, d: str) -> DataFrame:
    return curate.review_budget(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 25)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('sample|' || o_orderkey), o_orderkey LIMIT 100")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return keys.seeded_sample(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 100, "o_orderkey")


# --- discovery and merging of crawls -------------------------------------------------------------------------

@query(rf"""SELECT regexp_replace({_HOST}, '^www\.', '') AS host, count(*) AS existing FROM pages WHERE {_HOST} <> '' GROUP BY 1""")
def existing_counts(spark: SparkSession, d: str) -> DataFrame:
    return discover.existing_counts(table(spark, d, "pages").withColumn("source", F.lit("")), "url", "source")


@query(rf"""
    SELECT domain, url, score FROM (SELECT url, regexp_replace({_HOST}, '^www\.', '') AS domain, CAST({_SCORE} AS DOUBLE) AS score FROM pages) WHERE score >= 0.5
    QUALIFY row_number() OVER (PARTITION BY domain ORDER BY score DESC, url) <= 3 ORDER BY score DESC, url LIMIT 50""")
def found_selection(spark: SparkSession, d: str) -> DataFrame:
    return discover.select_found(_pages(spark, d).drop("page_id"), "url", "score", 0.5, 3, 50)


@query("""
    WITH q AS (SELECT s_nationkey, CASE WHEN avg(s_acctbal) > 5000 THEN 'high' WHEN avg(s_acctbal) > 4000 THEN 'medium' WHEN avg(s_acctbal) > 3000 THEN 'low' END AS quality FROM supplier GROUP BY 1)
    SELECT n_name AS domain, n_nationkey AS ord, CASE quality WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS quality_rank
    FROM nation LEFT JOIN q ON s_nationkey = n_nationkey WHERE n_name NOT IN ('FRANCE', 'NATION_3', '')""")
def quality_order(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("domain"), F.col("n_nationkey").alias("ord"))
    mean = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.avg("s_acctbal").alias("m"))
    stats = n.join(mean, "n_nationkey").select("domain", F.when(F.col("m") > 5000, "high").when(F.col("m") > 4000, "medium").when(F.col("m") > 3000, "low").alias("quality"))
    return discover.by_quality(n, "domain", "ord", stats, ["FRANCE", "NATION_3"])


_NAMED = ["the", "and ", "zzzz", ""]


@query(" UNION ALL ".join(f"SELECT '{q}' AS query, count(*) FILTER (contains(coalesce(text, ''), '{q}')) AS hits FROM documents" for q in _NAMED))
def query_hits(spark: SparkSession, d: str) -> DataFrame:
    return discover.hits_per_query(table(spark, d, "documents"), "text", _NAMED)


@query("""
    WITH r AS (SELECT l_orderkey, l_returnflag FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_returnflag DESC) = 1)
    SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'O'), l_returnflag) AS status FROM orders LEFT JOIN r ON l_orderkey = o_orderkey""")
def review_fallback(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("O")).alias("status"))
    r = table(spark, d, "lineitem").withColumnsRenamed({"l_orderkey": "o_orderkey", "l_returnflag": "status"})
    return curate.with_review(o, r, "o_orderkey", "status", F.struct("l_linenumber", "l_partkey", "l_suppkey", "status"))


@query("""
    SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment ELSE coalesce(n_name, '') END AS source
    FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""")
def site_names(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("site"), F.concat(F.lit(" "), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).otherwise(""), F.lit("　")).alias("source"))
    sites = table(spark, d, "nation").select(F.col("n_nationkey").alias("site"), "n_name", F.col("n_nationkey").alias("ord"))
    return curate.with_site(c, sites, "site", "source", "n_name", "ord").select("c_custkey", "source")


def _orders_with_parts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as candidates, their lines as pictures in order."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", F.concat(F.lit("http://x/"), F.col("l_partkey").cast("string")).alias("url"))
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("images"))
    return items.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")


@query("""
    WITH l AS (SELECT l_orderkey, min(struct_pack(a := l_linenumber, b := l_partkey, c := l_suppkey)) AS first, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1),
    b AS (SELECT o_custkey, l_orderkey, 'http://x/' || first.b AS url, n, 0 AS side FROM l JOIN orders ON o_orderkey = l_orderkey),
    both_sides AS (SELECT * FROM b UNION ALL SELECT o_custkey + 1, l_orderkey, url, n, 1 FROM b)
    SELECT o_custkey AS page, l_orderkey AS ord, url, n FROM both_sides QUALIFY row_number() OVER (PARTITION BY o_custkey, url ORDER BY side, l_orderkey) = 1""")
def merged_crawls(spark: SparkSession, d: str) -> DataFrame:
    base = _orders_with_parts(spark, d)
    out = curate.merge_crawls(base, base.withColumn("o_custkey", F.col("o_custkey") + 1), "images", "o_custkey", "l_orderkey", lambda i: i["l_returnflag"] != "R")
    return out.select(F.col("o_custkey").alias("page"), F.col("l_orderkey").alias("ord"), F.element_at("images", 1)["url"].alias("url"), F.col("n_images").cast("long").alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END AS status, 'kept' AS a, 'new' AS b FROM orders""")
def spread_records(spark: SparkSession, d: str) -> DataFrame:
    entry = lambda **kv: F.create_map(*(x for k, v in kv.items() for x in (F.lit(k), v)))
    both = convert.spread(entry(a=F.lit("kept"), status=F.lit("old")), entry(b=F.lit("new"), status=F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus"))))
    return table(spark, d, "orders").select("o_orderkey", both.alias("m")).select("o_orderkey", *(F.col("m")[k].alias(k) for k in ("status", "a", "b")))


@query("""
    WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 6 END, l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem)
    SELECT l_orderkey, string_agg(l_partkey, ',' ORDER BY place) AS parts FROM l WHERE place <= 3 GROUP BY 1""")
def pictures_by_kind(spark: SparkSession, d: str) -> DataFrame:
    o = _orders_with_parts(spark, d)
    kind = lambda i: F.when(i["l_returnflag"] == "R", "floorplan").when(i["l_returnflag"] == "A", "sitePlan").otherwise("unknown")
    o = o.withColumn("images", F.transform("images", lambda i: i.withField("kind", kind(i)))).withColumns({"has": F.col("l_orderkey") > 10, "at": F.col("o_custkey")})
    out = convert.candidate_view(o, "has", "at", "images", most=3).withColumn("images", convert.without_fields(F.col("images"), "url", "kind"))
    return out.select("l_orderkey", F.array_join(F.transform("images", lambda i: i["l_partkey"].cast("string")), ",").alias("parts"))


@query("SELECT s_suppkey AS id FROM supplier UNION SELECT user_id FROM events WHERE user_id IS NOT NULL")
def processed_keys(spark: SparkSession, d: str) -> DataFrame:
    return incremental.processed_with(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), table(spark, d, "events").select(F.col("user_id").alias("id")), "id")
