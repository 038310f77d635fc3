import random
import re

from pyspark.sql import functions as F

from curavine.functions import score
from curavine.operators import convert, curate, discover, keys, plans, search, upsert
from curavine.plans import curation


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_keep_first_and_ties(spark):
    df = table(spark, [("a", 3, 1.0), ("a", 1, 5.0), ("b", 2, 7.0), ("b", 0, 7.0), (None, 4, 1.0), (None, 5, 1.0)], "k string, ord int, s double")
    assert sorted(r.ord for r in keys.keep_first(df, ["k"], ["ord"]).collect()) == [0, 1, 4]
    assert sorted(r.ord for r in keys.keep_first(df, ["k"], ["ord"], by_blank=False).collect()) == [0, 1, 4, 5]
    assert sorted(r.ord for r in keys.arg_max_first(df, ["k"], "s", "ord").collect()) == [0, 1, 4]


def test_interleave_takes_turns(spark):
    df = table(spark, [("a", 1), ("a", 2), ("a", 3), ("b", 4), ("c", 5), ("c", 6), (None, 7)], "k string, ord int")
    got = {r.position: (r.k, r.ord) for r in keys.interleave(df, "k", "ord").collect()}
    assert [got[i] for i in range(1, 8)] == [("a", 1), ("b", 4), ("c", 5), (None, 7), ("a", 2), ("c", 6), ("a", 3)]


def test_paging_is_clamped(spark):
    df = spark.range(45)
    page = lambda p: sorted(r["rank"] for r in keys.paged(df, [F.col("id")], p, 20).collect())
    assert page(3) == page(9) == [41, 42, 43, 44, 45] and page(0) == list(range(1, 21))
    assert keys.paged(spark.range(0), [F.col("id")], 2, 20).count() == 0


def test_nested_first_drops_empty_parents(spark):
    df = table(spark, [(1, ["a", "b", "a"]), (2, ["b"]), (3, ["c", "a"])], "ord int, items array<string>")
    got = {r.ord: r["items"] for r in keys.nested_first(df, "items", lambda i: i, "ord").collect()}
    assert got == {1: ["a", "b"], 3: ["c"]}


def fold(stored, incoming):
    """Reference by loop: one row after another."""
    out = {}
    for r in stored:
        if r[0]:
            out[r[0]] = dict(zip(("v", "first_seen", "last_seen"), r[1:4]))
    for r in incoming:
        if not r[0]:
            continue
        now = out.setdefault(r[0], {"v": None, "first_seen": None, "last_seen": None})
        now["v"] = r[1] if r[1] is not None else now["v"]
        now["first_seen"] = now["first_seen"] or r[2] or None
        now["last_seen"] = max(now["last_seen"] or "", r[3] or "") or None
    return {k: (v["v"], v["first_seen"] or None, v["last_seen"] or None) for k, v in out.items()}


def test_upsert_equals_a_loop(spark):
    random.seed(5)
    pick = lambda *x: random.choice(x)
    make = lambda n: [(pick("a", "b", "c", "d", "e", None, ""), pick(None, "x", "y", "z"), pick(None, "", "2020", "2021"), pick(None, "", "2022", "2023"), i) for i in range(n)]
    schema = "id string, v string, first_seen string, last_seen string, ord int"
    for _ in range(4):
        stored, incoming = make(8), make(12)
        got = upsert.upsert(table(spark, stored, schema), table(spark, incoming, schema))
        assert {r.id: (r.v, r.first_seen or None, r.last_seen or None) for r in got.collect()} == fold(stored, incoming)
    again = upsert.upsert(got.select("id", "v", "first_seen", "last_seen", "ord"), table(spark, incoming, schema))
    assert sorted(map(str, again.select("id", "v", "last_seen").collect())) == sorted(map(str, got.select("id", "v", "last_seen").collect()))
    n = upsert.counts(table(spark, stored, schema), got).first()
    assert n.before == 8 and n.added == max(0, n.after - 8)


def test_counts_while_writing(spark, tmp_path):
    rows = lambda a, b: table(spark, [(str(i), i) for i in range(a, b)], "id string, ord int")
    jobs = []
    n = upsert.write_counted(rows(0, 50), rows(40, 75), lambda df: jobs.append(df) or df.write.parquet(f"{tmp_path}/a"))
    assert n == {"before": 50, "after": 75, "added": 25} and spark.read.parquet(f"{tmp_path}/a").count() == 75 and len(jobs) == 1
    assert upsert.write_counted(rows(0, 3), rows(0, 0), lambda df: df.write.parquet(f"{tmp_path}/b")) == {"before": 3, "after": 3, "added": 0}


def test_import_replaces_or_merges(spark):
    a, b = table(spark, [(1, "x", 0), (2, "y", 1)], "id int, v string, ord int"), table(spark, [(2, "n", 0), (2, "m", 1)], "id int, v string, ord int")
    got = lambda r: {x.id: x.v for x in upsert.replace_or_merge(a, b, "id", "ord", r).collect()}
    assert got(True) == {2: "m"} and got(False) == {1: "x", 2: "m"}


def test_search_bounds(spark):
    df = table(spark, [(1, None), (2, 5.0), (3, 9.0)], "id int, a double")
    found = lambda lo, hi: sorted(r.id for r in search.search(df, search.Filters(ranges={"a": (lo, hi)}), []).collect())
    assert found("", "") == found("abc", None or "") == [1, 2, 3]
    assert found("6", "") == [3] and found("", 5) == [2]


def test_search_tags_and_items(spark):
    df = table(spark, [(1, "A plan", ["Red"], [("plan",)]), (2, None, None, None)], "id int, t string, tags array<string>, images array<struct<kind:string>>")
    ids = lambda **k: [r.id for r in search.search(df, search.Filters(**k), ["t"], tags="tags").collect()]
    assert ids(keyword="RED") == [1] and ids(tag="re") == [1]
    assert ids(has_item={("images", "plan"): "without"}) == [2] and ids(has_item={("images", "plan"): "with"}) == [1]
    assert search.search(df, search.Filters(tag="x"), ["t"]).count() == 0


def test_orders(spark):
    df = table(spark, [(1, "2020", "い", ""), (2, "2021", "あ", "2LDK"), (3, "2021", "う", "1LDK")], "ord int, time string, title string, layout string")
    got = lambda k: [r.ord for r in df.orderBy(*search.order_by(k, "time", F.lit(""), F.col("layout"), F.col("title"), "ord")).collect()]
    assert got("newest") == [2, 3, 1] and got("oldest") == [1, 2, 3] and got("source") == [2, 1, 3] and got("layout") == [3, 2, 1]


def test_clean_keeps_the_first_good_row(spark):
    rows = [("a", 1, "u", "h1", 1.0, "bad"), ("b", 2, "u", "h2", 1.0, ""), ("c", 3, "u", "h3", 1.0, ""), ("d", 4, "", "h4", 1.0, ""), ("e", 5, "", "h4", 2.0, ""), ("f", 6, None, None, 0.0, ""), ("g", 7, None, None, 0.0, "")]
    out = curate.clean(table(spark, rows, "id string, ord int, u string, h string, s double, r string"), "id", "ord", "u", "h", "s", "r")
    assert {r.id: r.why for r in out.collect()} == {"a": "bad", "b": "", "c": "duplicate-url", "d": "duplicate-hash", "e": "", "f": "", "g": ""}


def test_clean_equals_a_loop(spark):
    random.seed(9)
    for _ in range(3):
        rows = [(i, random.choice(["u1", "u2", "u3", ""]), random.choice(["h1", "h2", "h3", "h4", None]), float(random.randint(0, 3)), random.choice(["", "", "", "x"])) for i in range(40)]
        best, seen, want = {}, set(), {}
        for i, _, h, s, _ in rows:
            if h and (h not in best or s > best[h][1]):
                best[h] = (i, s)
        for i, u, h, _, reason in rows:
            why = "duplicate-url" if u and u in seen else "duplicate-hash" if h and best[h][0] != i else reason
            want[i] = why
            if not why and u:
                seen.add(u)
        got = curate.clean(table(spark, rows, "id int, u string, h string, s double, r string"), "id", "id", "u", "h", "s", "r")
        assert {r.id: r.why for r in got.collect()} == want


def test_route_thresholds(spark):
    rows = [(1, 0.2, 0.85, True, True), (2, 0.2, 0.8499, True, True), (3, 0.2, 0.5999, False, False), (4, 0.2, 0.6, False, False), (5, 0.45, 0.1, False, False), (6, 0.9, 0.9, True, False)]
    df = table(spark, rows, "id int, v double, c double, checked boolean, positive boolean")
    out = curate.route(df, "v", "c", F.col("checked"), F.col("positive"), F.col("id") == 0, F.col("checked") & F.col("positive") & (F.col("id") == 1), F.lit(False), F.lit(True))
    assert {r.id: r.route for r in out.collect()} == {1: "accept", 2: "review", 3: "reject", 4: "review", 5: "review", 6: "reject"}


def test_quality_buckets(spark):
    df = table(spark, [(0.3, 4), (0.3, 5), (0.1, 0), (0.099, 9), (0.0, 0)], "r double, a int")
    assert [x[0] for x in df.select(curate.quality(F.col("r"), F.col("a"))).collect()] == ["medium", "high", "medium", "low", "low"]


def test_cleanup_reasons(spark):
    rows = [
        ("https://x/madori/plan_1.png", "", "間取り図", 800, 600), ("https://x/common/a.png", "", "", 0, 0), ("https://x/p.png", "", "", 100, 100), ("https://x/living.jpg", "", "", 800, 600),
        ("https://x/page", "", "", 0, 0), ("https://x/b.png", "", "リビングの", 800, 600), ("https://x/b.png", "", "打ち合わせの間取り図", 800, 600), ("https://x/madori.png", "", "打ち合わせの様子", 800, 600),
        ("https://www.yuyuhome.co.jp/a.png", "", "", 800, 600), ("https://www.yuyuhome.co.jp/plan.png", "", "", 800, 600), ("https://be-enough.jp/x/plan3-img01.jpg", "", "", 800, 600), ("https://sfc.jp/a.png", "", "土間あり", 800, 600),
        ("https://x/b.png", "間取り 玄関", "", 800, 600), ("12-3.jpg", "", "", 800, 600),
    ]
    df = table(spark, rows, "u string, a string, t string, w int, h int")
    assert [r[0] for r in df.select(curate.cleanup_reason("u", "a", "t", "w", "h")).collect()] == ["", "common-ui-image", "small-or-banner-image", "room-photo", "non-image-url", "photo-only-title", "process-photo", "", "domain-photo-gallery", "", "be-enough-site-plan-or-elevation", "sfc-photo-section", "", "generic-uploaded-photo"]


def test_evidence_of_single_sites(spark):
    rows = [
        ("https://x/a.png", "", "間取り図", 0.6, True), ("https://x/a.png", "", "間取り図", 0.5, False), ("https://x/img_12.png", "", "間取り図", 0.9, False), ("https://x/a.png", "間取り", "", 0.0, True),
        ("https://x/thum.png", "間取り", "", 1.0, False), ("https://x/a.png", "間取り", "作成中", 1.0, False), ("https://x/madori.png", "", "作成中", 0.0, True), ("https://www.hamaguri.co.jp/a.png", "間取り", "", 1.0, False),
        ("https://yuyuhome.co.jp/a.png", "間取り", "平面図", 0.7, True), ("https://yuyuhome.co.jp/a.png", "間取り", "平面図", 0.6, False), ("https://hirayakoubou.net/ys-1a-fig.png", "", "", 0.45, True), ("https://hirayakoubou.net/madori.png", "", "", 1.0, False),
        ("https://irohaie.com/like1.png", "", "", 0.55, True), ("https://irohaie.com/b.png", "間取り", "", 0.9, False), ("https://be-enough.jp/p/plan1-img02.jpg", "", "", 0.45, True), ("https://be-enough.jp/p/plan1-img04.jpg", "", "", 1.0, False),
        ("https://with-e-home.com/img/uploads/plans/2024-01-02/a.png", "", "", 0.5, True), ("https://with-e-home.com/img/uploads/plans/2024-01-02/a.png", "", "", 0.4, False),
    ]
    df = table(spark, rows, "u string, a string, t string, v double, want boolean")
    got = df.select("u", "t", "v", "want", score.acceptance_evidence("u", "a", F.lit(""), "t", F.col("v")).alias("got")).collect()
    assert [tuple(r) for r in got if r.got != r.want] == []


def test_floors_and_plain_titles(spark):
    floors = [("plan 1f", 1.0), ("plan 2F ", 2.0), ("x1.5階部分", 1.5), ("a_2f.png", 2.0), ("12階部分", 2.0), ("img01.suumo.com/front/gazo/chumon/a/main/b_m03.jpg", 3.0), ("be-enough.jp/a/plan1-img02.png", 1.0), ("家", 9.0), (None, 9.0)]
    df = table(spark, floors, "s string, f double")
    assert [r[0] for r in df.select(plans.floor_order(F.col("s"))).collect()] == [f for _, f in floors]
    titles = [("A邸の1階部分間取り", "A邸間取り"), ("A邸（2階部分）間取り図", "A邸 間取り図"), ("家の間取り図 2枚目", "家の間取り図"), ("家　3枚目", "家"), ("間取り2F", "間取り"), ("1階の間取り", ""), ("3 階部分の家", "の家")]
    df = table(spark, titles, "t string, w string")
    assert [r[0] for r in df.select(plans.plain_title("t")).collect()] == [w for _, w in titles]


def test_keys_of_plans(spark):
    s = "id string, domain string, page string, image string, title string, alt string, layout string, area double"
    rows = [
        ("1", "c", "https://cleverlyhome.com/kurashi/plan/7", "https://c/a.png", "家の1階部分", "", "3LDK", 99.5, "sequence:c:https://cleverlyhome.com/kurashi/plan/7:3LDK:99.50:家"),
        ("2", "c", "https://cleverlyhome.com/kurashi/plan/7", "https://c/b.png", "2F", "", None, None, "sequence:c:https://cleverlyhome.com/kurashi/plan/7:layout-unknown:area-unknown:2F"),
        ("3", "f", "https://forumu.co.jp/madori/madori-12.html", "https://f/i/madori_12.png", "", "", None, None, "page-image:f:https://forumu.co.jp/madori/madori-12.html:madori_12"),
        ("4", "s", "https://suumo.jp/chumon/tn_x/rn_y/z/jitsurei/jc_5/", "https://i/a.png", "1階間取り", "", None, None, "detail-page:s:https://suumo.jp/chumon/tn_x/rn_y/z/jitsurei/jc_5/"), ("5", "s", "https://x/q", "https://i/a.png", "1階間取り", "", None, None, "record:5"),
    ]
    df = table(spark, rows, s + ", want string")
    for r in df.select("id", "want", plans.group_key("id", "domain", "page", "image", "title", "alt", "layout", "area").alias("got")).collect():
        assert r.got == r.want


def test_robots_dialects():
    body = "User-agent: x\nDisallow: /no\nUser-agent: *\nDisallow: /a # c\nAllow:\nUser-agent: curavine\nDisallow: /b\n"
    assert discover.parse_rules(body) == [(0, "disallow", "/a")]
    assert discover.parse_rules(body, "keep") == [(0, "disallow", "/a"), (1, "allow", "")]
    assert discover.parse_rules(body, "group") == [(0, "disallow", "/b")]
    assert discover.parse_rules(body, "group", agent="other") == [(0, "disallow", "/a")]
    assert discover.parse_rules(None) == []


def test_robots_matching(spark):
    urls = table(spark, [(1, "https://h/a/x"), (2, "https://h/a"), (3, "https://h/b"), (4, "https://h/c?d=1"), (5, "https://other/")], "id int, url string").withColumn("host", F.regexp_extract("url", "//([^/]+)", 1))
    rules = table(spark, [("h", 0, "disallow", "/a*"), ("h", 1, "allow", "/a$"), ("h", 2, "disallow", "/b"), ("h", 3, "allow", "/b"), ("h", 4, "disallow", "/c?d")], "host string, ord int, kind string, rule string")
    assert {r.id: r.allowed for r in discover.allowed(urls, "url", rules).collect()} == {1: False, 2: False, 3: False, 4: True, 5: True}
    assert {r.id: r.allowed for r in discover.allowed(urls, "url", rules, with_query=True).collect()} == {1: False, 2: False, 3: False, 4: False, 5: True}
    assert spark.createDataFrame([("Sitemap: https://h/s.xml\nsitemap:https://h/s.xml",)], "b string").select(discover.sitemaps("b")).first()[0] == ["https://h/s.xml"]


def test_block_list_matches_whole_labels(spark):
    df = table(spark, [(1, "http://sub.example.com/"), (2, "http://notexample.com/"), (3, "http://example.com"), (4, "nonsense")], "id int, url string")
    got = discover.not_blocked(df, "url", table(spark, [("Example.com",)], "domain string"))
    assert sorted(r.id for r in got.collect()) == [2, 4]


def test_invalid_patterns_of_an_adapter_are_plain_text(spark):
    df = table(spark, [("a plan(1", ["x["], ["plan("]), ("ax[", ["x["], []), ("b", [], ["^B$"]), (None, ["b"], ["c"])], "s string, no array<string>, yes array<string>")
    got = df.select(discover.adapter_accepts(F.col("s"), discover.usable_patterns("no"), discover.usable_patterns("yes"))).collect()
    assert [r[0] for r in got] == [True, False, True, False]


def test_rows_without_keys_do_not_meet(spark):
    df = table(spark, [(1, None, True), (2, "", True), (3, None, False), (4, "a", False), (5, "a", True), (6, "a", False), (7, "b", False)], "ord int, k string, ok boolean")
    assert sorted(r.ord for r in keys.first_accepted(df, "k", "ord", "ok").collect()) == [1, 2, 3, 4, 5, 7]
    assert sorted(r.ord for r in keys.keep_first(df, ["k"], ["ord"], by_blank=False).collect()) == [1, 2, 3, 4, 7]
    many = table(spark, [(k * 1000 + i, k) for k, n in enumerate((700, 3, 41)) for i in range(n)], "ord int, src int")
    got = [r.src for r in keys.interleave(many, "src", "ord").orderBy("position").collect()]
    want = [k for i in range(700) for k, n in enumerate((700, 3, 41)) if i < n]
    assert got == want


def test_crawl_order(spark):
    links = table(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "a"), ("d", "e")], "source string, target string")
    out = discover.crawl_order(links, ["a"], table(spark, [("c", 5)], "url string, relevance int"), 4)
    assert [r.url for r in out.collect()] == ["a", "c", "b", "d"]


def test_plan_groups(spark):
    s = "id string, domain string, page_url string, image_url string, title string, alt string, layout string, area double, floors string, last_seen string"
    rows = [
        ("1", "x", "https://x/p", "https://x/madori_2f.png", "青い家 2F", "", None, 100.0, None, "2026-01-02"), ("2", "x", "https://x/p", "https://x/madori_1f.png", "青い家 1F", "", "3LDK", 100.0, "", "2026-01-03"),
        ("3", "x", "https://x/q", "https://x/photo.png", "one", "", None, None, None, None), ("4", "y", "https://y/case/77/", "https://y/a.png", "1階部分", "", None, None, None, None),
        ("5", "y", "https://y/case/77/", "https://y/b.png", "2階部分 4LDK", "", None, None, None, None), ("6", "z", "https://z/p", "https://z/ie/myhome/img/12_8.jpg", "2階間取り", "", None, None, None, None),
        ("7", "z", "https://z/p", "https://z/ie/myhome/img/12_7.jpg", "1階間取り", "", None, None, None, None),
    ]
    out = {tuple(r.images): r for r in plans.group_plans(table(spark, rows, s)).collect()}
    blue = out["https://x/madori_1f.png", "https://x/madori_2f.png"]
    assert (blue.title, blue.layout, blue.floors, blue.tsubo, blue.fetched_at, blue.n_images) == ("青い家", "3LDK", "2階建", 30.25, "2026-01-03", 2)
    case = out["https://y/a.png", "https://y/b.png"]
    assert case.layout == "4LDK" and case.floors == "2階建" and case.group_id.startswith("group:detail-page:y:")
    assert out["https://z/ie/myhome/img/12_7.jpg", "https://z/ie/myhome/img/12_8.jpg"].group_id.startswith("group:sequence:z:")
    assert out[("https://x/photo.png",)].group_id == "3" and out[("https://x/photo.png",)].title == "one"
    stats = plans.feed_stats(table(spark, rows, s), plans.group_plans(table(spark, rows, s)), "domain").first()
    assert (stats.accepted, stats.plans, stats.multi_image, stats.domains) == (7, 4, 3, {"x": 3, "y": 2, "z": 2})


def test_companion_pictures(spark):
    df = table(spark, [("g", "https://t/1_heimen2.webp"), ("h", "https://t/2_heimen2.webp"), ("h", "https://t/2_heimen1.webp")], "g string, url string")
    assert [tuple(r) for r in plans.companions(df, "g", "url", "_heimen2", "_heimen1").collect()] == [("g", "https://t/1_heimen1.webp")]


def test_conversions(spark):
    df = table(spark, [(1, " ", None, ["a", "b-madori"]), (2, "t", 4.0, [])], "id int, title string, area double, images array<string>")
    assert [r.title for r in convert.with_defaults(df, {"title": "none", "kind": "x"}).orderBy("id").collect()] == ["none", "t"]
    assert [r.id for r in convert.filter_nested(df, "images", lambda i: i != "a").collect()] == [1]
    assert df.select(convert.strong_only(F.col("images"), lambda i: i)).first()[0] == ["b-madori"]
    assert convert.image_total(df, "images", True).first()[0] == 3 and convert.image_total(df, "images").first()[0] == 2
    p = convert.to_property(df.withColumn("tags", F.lit(None).cast("array<string>")), "new").orderBy("id").collect()
    assert p[1].tsubo == 1.21 and p[1].tags == ["new"]
    a = table(spark, [('says {"isFloorplan": true, "confidence": 1.7, "reason": "r"} ok',), ("nothing",), (None,)], "a string")
    assert [tuple(r[0]) for r in a.select(convert.parse_answer("a")).collect()] == [(True, 1.0, "r"), (False, 0.0, ""), (False, 0.0, "")]


def test_block_page_order(spark):
    df = table(spark, [("<p>Access Denied captcha",), ("please sign in",), ("<b>forbidden</b>",), ("fine " * 1000 + "captcha",)], "h string")
    assert [r[0] for r in df.select(curate.block_page("h")).collect()] == ["captcha", "login", "denied", None]


def test_adapter_patterns(spark):
    df = table(spark, [("http://x/plan/1", [], ["plan"]), ("http://x/plan/1", ["/1$"], ["plan"]), ("http://x/", None, []), ("http://x/", None, ["plan"])], "u string, r array<string>, a array<string>")
    assert [r[0] for r in df.select(discover.adapter_accepts(F.col("u"), F.col("r"), F.col("a"))).collect()] == [True, False, True, False]


def test_gate(spark):
    df = table(spark, [(True, "u", False, False, False), (False, "u", False, False, False), (True, "", False, False, False), (True, "u", True, False, False), (True, "u", True, True, True)], "e boolean, u string, p boolean, a boolean, s boolean")
    assert [r[0] for r in df.select(curate.crawl_gate(*(F.col(c) for c in "eupas"))).collect()] == [None, "disabled", "no-url", "portal-not-acknowledged", "portal-stores-images"]


def test_picture_kinds(spark):
    df = table(spark, [("間取り図", "https://x/a.png"), ("", "https://x/living.jpg"), (None, "https://x/site-plan.svg"), ("", "https://x/logo.png")], "a string, u string")
    k = score.picture_kind("a", "u")
    assert [tuple(r) for r in df.select(k, score.picture_score("a", "u", k)).collect()] == [("floorplan", 210), ("interior", 10), ("sitePlan", -10), ("other", -130)]


def test_review_pass(spark):
    s = "key string, ord int, checked boolean, was boolean, asked boolean, hard boolean, strong boolean"
    rows = [("a", 1, True, False, False, False, False), ("b", 2, False, None, False, True, False), ("c", 3, False, None, True, False, False), ("d", 4, False, None, False, False, True), ("e", 5, False, None, False, False, False)]
    df, c = table(spark, rows, s), F.col
    budget = curate.review_keys(df, "key", "ord", c("checked"), c("asked"), c("hard"), c("strong"), 2)
    assert sorted(r.key for r in budget.collect()) == ["c", "d"]
    answers = table(spark, [("c", True, 0.7), ("d", True, 0.6)], "key string, is_plan boolean, confidence double")
    out = curate.review_pass(df, budget, answers, "key", c("checked"), c("was"), c("hard"))
    assert {r.key: r.kept for r in out.collect()} == {"a": False, "b": True, "c": True, "d": False, "e": True}
    past = table(spark, [(None, True, None, 0.95, "a top-down drawing"), ("error", None, None, None, None)], "s string, p boolean, c string, f double, r string").select(curate.past_answer(c("s"), c("p"), c("c"), c("f"), c("r")))
    assert [tuple(r[0]) for r in past.collect()] == [("checked", "floorplan", True, True), ("error", "other", False, False)]


def test_rotation_history(spark):
    df = table(spark, [(45, 1, ["r"] * 120)], "next_index int, completed_rounds int, runs array<string>")
    r = curate.advance(df, 5, 47, F.lit("new")).first()
    assert (r.next_index, r.completed_rounds, len(r.runs), r.runs[-1]) == (3, 2, 120, "new")
    assert search.compare_list([], 1) == [1] and search.compare_list([1, 2], 3) == [2, 3] and search.compare_list([1, 2], 1) == [2]


def test_curation_run(spark):
    s = "id string, ord int, domain string, page_url string, image_url string, title string, alt string, near string, width int, height int, model_status string, model_category string, model_plan boolean, model_top_down boolean, model_walls boolean, model_confidence double, layout string, area double, floors string, last_seen string"
    def row(i, url, title, status, plan, conf, walls=True):
        return str(i), i, "d", "https://d/p", url, title, "", "", 900, 900, status, "floorplan" if plan else None, plan, plan, walls and plan, conf, None, None, None, "2026"

    rows = [
        row(1, "https://d/madori/plan_1f.png", "間取り図 1F", "checked", True, 0.95), row(2, "https://d/madori/plan_2f.png", "間取り図 2F", "checked", True, 0.95), row(3, "https://d/madori/plan_1f.png?v=2", "間取り図 1F", "checked", True, 0.95),
        row(4, "https://d/logo.png", "", None, None, None), row(5, "https://d/uploads/x.png", "", None, None, None), row(6, "https://d/known.png", "", None, None, None), row(7, "https://d/img/madori.png", "", "checked", False, 0.9),
        row(8, "https://d/uploads/y.png", "", "checked", True, 0.3), row(9, "https://d/madori/photo_of_plan_3.png", "間取り図", "checked", True, 0.99, walls=False),
    ]
    done = table(spark, [("x", "https://d/known.png")], "id string, image_url string")
    r = curation.curated(table(spark, rows, s), done, done.limit(0))
    assert sorted(x.id for x in r.accepted.collect()) == ["1", "2"]
    assert {x.id: x.reason for x in r.rejected.collect()} == {"4": "hard-reject", "5": "low-confidence", "7": "not-a-plan"}
    assert sorted((x.id, x.reason) for x in r.review.collect()) == [("8", "uncertain"), ("9", "uncertain")]  # a plan without walls is looked at again
    plan = r.plans.collect()
    assert len(plan) == 1 and plan[0].n_images == 2 and plan[0].floors == "2階建"
    q = r.stats.first()
    assert (q.candidates, q.accepted, q.rejected, q.review, q.rate, q.quality) == (9, 2, 3, 2, 0.222, "medium")


def test_quality_keeps_the_time_of_an_earlier_run(spark):
    kinds = table(spark, [("a", "candidate"), ("b", "candidate"), ("c", "candidate")], "d string, k string")
    states = table(spark, [("a", "2026-02"), ("b", None)], "domain string, last_crawled_at string")
    before = table(spark, [("a", "2025-01"), ("b", "2025-02"), ("z", "2025-03")], "domain string, last_crawled_at string")
    at = lambda *x: {r.domain: r.last_crawled_at for r in curate.source_quality(kinds, "d", "k", *x).collect()}
    assert at(states, before) == {"a": "2026-02", "b": "2025-02", "c": None}
    assert at(None, before) == {"a": "2025-01", "b": "2025-02", "c": None}


def test_quality_order_and_hits_on_empty_tables(spark):
    d = table(spark, [("a", 1), ("b", 2), ("a", 3), ("c", 4), (None, 5), ("x", 6)], "domain string, ord int")
    stats = table(spark, [("b", "low"), ("c", "high")], "domain string, quality string")
    assert [(r.domain, r.quality_rank) for r in discover.by_quality(d, "domain", "ord", stats, ["x"]).collect()] == [("c", 3), ("b", 1), ("a", 0)]
    assert discover.by_quality(d.limit(0), "domain", "ord", stats, []).count() == 0
    assert [tuple(r) for r in discover.hits_per_query(d.limit(0), "domain", ["a"]).collect()] == [("a", 0)]
    assert discover.hits_per_query(d, "domain", []).count() == 0


def test_spread_of_missing_maps(spark):
    df = spark.sql("SELECT map('a', 1) AS l, CAST(NULL AS map<string,int>) AS r UNION ALL SELECT NULL, NULL UNION ALL SELECT map('a', 1, 'b', 2), map('b', CAST(NULL AS int))")
    assert [r.m for r in df.select(convert.spread(F.col("l"), F.col("r")).alias("m")).collect()] == [{"a": 1}, None, {"a": 1, "b": None}]


def test_candidates_with_plans_come_first(spark):
    df = table(spark, [(1, False, "2026", []), (2, True, "2025", [("a", "other"), ("b", "floorplan")]), (3, None, "2027", None)], "id int, plan boolean, at string, images array<struct<id:string,kind:string>>")
    got = convert.candidate_view(df, "plan", "at", "images", 1).collect()
    assert [r.id for r in got] == [2, 3, 1] and [i.id for i in got[0].images] == ["b"] and got[1].images is None


def test_robots_rules_equal_patterns(spark):
    """Prefixes and pieces find what one pattern for each rule finds, also with thousands of rules for a host."""
    random.seed(8)
    piece = lambda n: "".join(random.choices("ab/", k=random.randint(0, n)))
    rules = [("h", i, random.choice(["allow", "disallow"]), "/" + piece(4) + "".join("*" + piece(2) for _ in range(random.randint(0, 3))) + random.choice(["", "", "$"])) for i in range(60)]
    rules += [("h", 100, "allow", "*"), ("h", 101, "allow", "*a$"), ("h", 102, "allow", "/a**b"), ("h", 103, "disallow", "/$"), ("other", 0, "disallow", "/")]
    paths = sorted({"/" + piece(9) for _ in range(200)} | {"/"})
    urls = table(spark, [("h", "http://h.jp" + p) for p in paths] + [("none", "http://n.jp/a")], "host string, url string")

    def by_pattern(path, n):
        hits = [(n(r), -o, k) for h, o, k, r in rules if h == "h" and re.match("".join(".*" if c == "*" else re.escape(c) for c in r.removesuffix("$")) + ("$" if r.endswith("$") else ""), path)]
        return max(hits)[2] != "disallow" if hits else True

    for with_query, n in ((False, lambda r: len(r.replace("*", "").replace("$", ""))), (True, len)):
        got = {r.url: r.allowed for r in discover.allowed(urls, "url", table(spark, rules, "host string, ord int, kind string, rule string"), with_query=with_query).collect()}
        assert got == {"http://h.jp" + p: by_pattern(p, n) for p in paths} | {"http://n.jp/a": True}
    many = table(spark, [("h", i, "disallow", f"/x/{i}/") for i in range(3000)] + [("h", 5000, "disallow", "")], "host string, ord int, kind string, rule string")
    asked = table(spark, [("h", f"http://h.jp/x/{i}/y") for i in range(2990, 3010)], "host string, url string")
    plan = discover.allowed(asked, "url", many, with_query=True)
    assert sum(r.allowed for r in plan.collect()) == 10
    assert "rlike" not in plan._jdf.queryExecution().optimizedPlan().toString().lower()
