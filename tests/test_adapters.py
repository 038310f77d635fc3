"""Adapters of sites: pages and pictures by the patterns of their site."""

from pyspark.sql import functions as F

from curavine.operators import adapters

SCHEMA = "domain string, enabled boolean, company string, page_patterns array<string>, reject_patterns array<string>, accept_patterns array<string>"
PAGE = "<title>t</title><p>near</p><img src=/madori.png alt=plan><img src=/photo.png alt=x><img src=/plan(1.png>"


def test_pictures_by_site(spark):
    sites = [
        ("WWW.a.jp", True, "A", ["/works/"], ["photo"], ["madori", "plan(1"]), ("b.jp", True, None, None, None, None), ("c.jp", False, "C", [], [], []), ("d.jp", True, "D", [None, "[x"], ["PHOTO", None], []), ("d.jp", True, "E", [], [], []),
        ("e.jp", None, "E", [], [], []),
    ]
    pages = [(1, "https://www.a.jp/works/1", "www.a.jp", PAGE), (2, "https://a.jp/blog/1", "a.jp", PAGE), (3, "https://b.jp/", "B.jp", PAGE), (4, "https://c.jp/", "c.jp", PAGE), (5, "https://d.jp/[x", "d.jp", PAGE), (6, "https://d.jp/y", "d.jp", PAGE),
             (7, "https://b.jp/2", "b.jp", "hCaptcha" + PAGE), (8, "https://b.jp/3", "b.jp", None), (9, None, "b.jp", PAGE), (10, "https://e.jp/", "e.jp", PAGE), (11, "https://b.jp/4", None, PAGE)]
    df = spark.createDataFrame(pages, "id int, url string, domain string, html string").withColumn("company", F.lit("clash"))
    got = adapters.adapter_pictures(df.drop("company"), spark.createDataFrame(sites, SCHEMA), keep=("id",)).collect()
    assert sorted((r.id, r.company, r.image_url.rsplit("/", 1)[1]) for r in got) == [
        (1, "A", "madori.png"), (1, "A", "plan(1.png"), (3, "b.jp", "madori.png"), (3, "b.jp", "photo.png"), (3, "b.jp", "plan(1.png"), (5, "D", "madori.png"), (5, "D", "plan(1.png"),
    ]
    assert {r.title for r in got} == {"plan", "x", "t"} and all("near" in r.near for r in got)
    assert adapters.adapter_pictures(df.drop("company").limit(0), spark.createDataFrame(sites, SCHEMA)).count() == 0
    assert adapters.adapter_pictures(df.drop("company"), spark.createDataFrame([], SCHEMA)).count() == 0
    flags = df.join(spark.createDataFrame([("www.a.jp", ["/works/", "("])], "domain string, p array<string>"), "domain", "left")
    assert {r.id: r[1] for r in flags.select("id", adapters.page_matches("url", "p")).where("id < 4").collect()} == {1: True, 2: True, 3: True}


def test_patterns_are_compiled_once():
    adapters.matcher.cache_clear()
    for _ in range(1000):
        assert adapters.matcher(("a+", "?b"))("xA") and adapters.matcher(("a+", "?b"))("?B") and not adapters.matcher(("a+", "?b"))("b")
    assert adapters.matcher.cache_info().misses == 1


def test_plans_of_single_sites(spark):
    img = lambda *links: "".join(f"<img src='{x}'>" for x in links)
    pages = [
        (1, "https://suumo.jp/chumon/tn_a/rn_b/c/jitsurei/jc_1/", "suumo.jp", img("https://img01.suumo.com/front/gazo/chumon/1/2/main/a_m01.jpg", "https://img01.suumo.com/front/gazo/chumon/1/2/main/a_p01.jpg")),
        (2, "https://www.toyotahome.co.jp/housing/howto/madori/design/detail.html?id=3", "www.toyotahome.co.jp", img("/floorplan/12_heimen1.webp", "/floorplan/12_ritumen1.webp", "/common/floorplan/1_heimen.webp", "/floorplan/12_heimen1.webp")),
        (3, "https://hirayakoubou.net/plan/ys-1a/", "hirayakoubou.net", '<a href="/wp-content/uploads/ys-1a-fig.png">x</a>' + img("/wp-content/uploads/logo-fig.png")), (4, "https://hirayakoubou.net/plan/sample/", "hirayakoubou.net", img("/wp-content/uploads/a-fig.png")),
        (5, "https://www.iidasangyo.co.jp/order/plan/planhouse/", "www.iidasangyo.co.jp", img("img/3ldk_1.jpg", "img/3ldk_1_s.jpg", "https://x.jp/planhouse/img/3ldk_1.jpg")),
        (6, "https://www.universalhome.co.jp/concept_plan/hiraya/a1/", "www.universalhome.co.jp", img("img/img_floor_1.png", "img/img_1.png")), (7, "https://www.universalhome.co.jp/concept_plan/hiraya/a1", "www.universalhome.co.jp", "captcha" + img("img/img_floor_1.png")),
        (8, "https://other.jp/", "other.jp", img("/floorplan/12_heimen1.webp")), (9, None, None, None),
    ]
    df = spark.createDataFrame(pages, "id int, url string, domain string, html string")
    got = sorted((r.id, r.image_url.split("/", 3)[3]) for r in adapters.site_pictures(df, keep=("id",)).collect())
    assert got == [(1, "front/gazo/chumon/1/2/main/a_m01.jpg"), (2, "floorplan/12_heimen1.webp"), (3, "wp-content/uploads/ys-1a-fig.png"), (5, "order/plan/planhouse/img/3ldk_1.jpg"), (6, "concept_plan/hiraya/a1/img/img_floor_1.png")]
    assert adapters.site_pictures(df.limit(0)).count() == 0
