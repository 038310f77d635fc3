import struct

import pytest
from pyspark.sql import functions as F

from curavine.functions import hashing, images, meta, score
from curavine.functions import text as T
from curavine.functions import url as U


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("make", "given", "expected"),
    [
        (T.collapse_space, "  a　b \n c ", "a b c"),
        (T.collapse_space, None, ""),
        (T.decode_references, "&amp;lt;&quot;&#39;&nbsp;$1", "<\"' $1"),
        (T.strip_html, "<script>x<b></script><p>a&amp;b</p><style>q</style>c", "a&b c"),
        (lambda x: T.tag_text(x, "title"), "<TITLE lang=x>A\n<i>b</i></title>", "A b"),
        (lambda x: T.tag_text(x, "h1"), "<p>none", ""),
        (lambda x: T.meta_content(x, "og:image"), "<meta content='u.png' property=\"og:image\">", "u.png"),
        (lambda x: T.safe_filename(x), 'a/b:*?"c', "a_b_c"),
        (lambda x: T.day(x), "2026-07-02T21:57:55Z", "2026/07/02"),
        (lambda x: T.day(x), "soon", ""),
        (U.host, "HTTPS://user@WWW.Example.com:80/x", "www.example.com"),
        (U.host, "not a url", ""),
        (U.domain, "http://www.example.com/", "example.com"),
        (U.without_tracking, "https://Ex.com/A/?utm_source=x&b=2&gclid=1#top", "https://ex.com/a/?b=2"),
        (U.without_tracking, "https://ex.com/a/?utm_source=x", "https://ex.com/a"),
        (U.without_tracking, "http://ex.com", "http://ex.com"),
        (U.without_tracking, " Not A URL?utm_source=1 ", "not a url?utm_source=1"),
        (U.without_tracking, "http://ex.com/%zz?utm_source=1", "http://ex.com/%zz?utm_source=1"),
        (U.without_tracking, "http://ex.com/a%20b+c", "http://ex.com/a b+c"),
        (U.without_fragment, "ftp://x/y#z", ""),
        (U.image_key, "https://x/A-300x200.JPG?v=1", "https://x/a.jpg"),
        (U.image_key, "https://x/%E9%zz.png", "https://x/%e9%zz.png"),
        (U.parent_url, "https://x/a/b.html?q", "https://x/a/"),
        (U.parent_url, "https://x/a/b", "https://x/a/b"),
        (U.unwrap, "https://s/?uddg=https%3A%2F%2Fx.com%2Fy&z=1", "https://x.com/y"),
        (U.unwrap, "https://s/ck?u=a1aHR0cHM6Ly94LmNvbS95", "https://x.com/y"),
        (hashing.short_sha1, "abc", "a9993e364706816a"),
    ],
)
def test_text_and_url(spark, make, given, expected):
    assert one(spark, given, make) == expected


def test_nested_results(spark):
    tag = "<img SRC='a.png' alt=\"x &amp; y\" src='b.png'>"
    assert one(spark, tag, T.attributes) == {"src": "b.png", "alt": "x & y"}
    assert [tuple(r) for r in one(spark, "a.png 300w, b.png 1200w, c.png 2x, d.png", T.srcset)] == [("c.png", 2000.0), ("b.png", 1200.0), ("a.png", 300.0), ("d.png", 0.0)]
    assert [tuple(r) for r in one(spark, "<a class=k href='/x?a&amp;b'>T <b>u</b></a>", T.links)] == [("/x?a&b", "T u")]
    assert one(spark, "<a href='p.pdf?x=1'><a href='p.pdf?x=1'><a href='q.PDF'>", T.pdf_links) == ["p.pdf?x=1", "q.PDF"]
    assert one(spark, "a, b、c#d\n,", T.parse_tags) == ["a", "b", "c", "d"]
    assert one(spark, "http://a.b.example.com/", U.host_suffixes) == ["a.b.example.com", "b.example.com", "example.com", "com"]
    assert one(spark, "x", U.host_suffixes) == []
    assert one(spark, "https://www.x.jp/a/b.html", U.index_queries) == ["x.jp/a/*", "www.x.jp/a/*"]
    assert tuple(one(spark, "https://x/a%20B/c.png", U.parts)) == ("/a b/c.png", "c.png", "a b")
    assert tuple(one(spark, 5, T.grid, "int")) == (3, 2)


def test_keyword_is_no_pattern(spark):
    assert one(spark, "100% Wool_x", lambda x: T.contains_ci(x, " % wool_ "))
    assert not one(spark, "1000 wool", lambda x: T.contains_ci(x, "%"))


def test_numbers(spark):
    df = spark.createDataFrame([(100.0,), (0.0,), (None,), (float("nan"),)], "a double")
    assert [r[0] for r in df.select(T.area_to_tsubo("a")).collect()] == [30.25, None, None, None]
    r = spark.createDataFrame([(3, 10), (1, 3), (0, 0), (4, 9)], "a long, c long").select(T.ratio3(F.col("a"), F.col("c")))
    assert [x[0] for x in r.collect()] == [0.3, 0.333, 0.0, 0.444]


def test_stable_id_leaves_out_empty_parts(spark):
    import hashlib

    df = spark.createDataFrame([("a", None, "", "b")], "a string, b string, c string, d string")
    assert df.select(hashing.stable_id("a", "b", "c", "d")).first()[0] == hashlib.sha256(b"a|b").hexdigest()


def test_resolve(spark):
    df = spark.createDataFrame([("https://x.com/a/b", "../c.png"), ("https://x.com", "javascript:void(0)"), (None, None)], "b string, l string")
    assert [r[0] for r in df.select(U.resolve("b", "l")).collect()] == ["https://x.com/c.png", "", ""]


def test_metadata_takes_the_first_source(spark):
    df = spark.createDataFrame(
        [("2階建て 4LDK", "延床面積 100.5㎡ 土地 50坪 玄関は南東 新築3LDK家", "価格 2,980 平屋", ""), ("", "平屋 3LDK", "", "3SLDK"), (None, None, None, None)],
        "title string, near string, page string, alt string",
    )
    rows = [r[0] for r in df.select(meta.extract("title", "near", "page", "alt")).collect()]
    assert (rows[0].layout.value, rows[0].layout.confidence) == ("3LDK", 0.92)
    assert rows[0].total_floor_area.value == 100.5 and rows[0].site_area.value == 165.29
    assert rows[0].floors.value == "2階建て" and rows[0].floors.source == "page-title"
    assert rows[0].entrance_direction.value == "南東" and rows[0].price.value == 2980.0
    assert rows[1].layout.value == "3SLDK"
    assert rows[2].layout.value is None and rows[2].layout.confidence == 0.0


def test_visual_scores(spark):
    df = spark.createDataFrame([("madori 1f.png 間取り図", 800, 600), ("logo.png", 100, 50), ("kitchen madori.png", None, None), ("x", 2000, 100)], "s string, w int, h int")
    v = [r[0] for r in df.select(score.visual(F.col("s"), F.col("s"), "w", "h")).collect()]
    assert v[0].score == pytest.approx(0.25 + 0.36) and v[0].category == "unknown"
    assert v[1].category == "logo" and v[1].score == 0.0
    assert v[2].hard_rejects == []  # room words don't count beside plan words
    assert v[3].score == 0.0


def test_final_confidence(spark):
    c = lambda *a: spark.range(1).select(score.final_confidence(*(F.lit(x) for x in a))).first()[0]
    assert c(False, True, True, 1.0, 0.9) == 0.84
    assert c(True, False, True, 0.5, 0.5) == 0.5
    assert c(True, True, True, 1.0, 1.0) == 1.0
    assert c(True, True, True, 0.9, 0.5) == pytest.approx(0.92 * 0.9 + 0.04 + 0.02)


def test_small_or_banner(spark):
    df = spark.createDataFrame([(259, 500), (260, 180), (1000, 200), (None, 5)], "w int, h int")
    assert [r[0] for r in df.select(score.small_or_banner("w", "h")).collect()] == [True, False, True, False]


def test_crawled_pictures(spark):
    page = """<meta property="og:image" content="/og.jpg"><h1>平屋の間取り</h1><img data-src-pc=/up/madori1.png alt="間取り図"><img data-lazy="/x/logo.png"><img data-bg="/k/kitchen.jpg">
    <a href=/big/floor-plan_01.jpg>open</a><i style="background:url(/s/bg.gif)"></i><script>var u = "https://c.jp/img/q.webp";</script><img src=/r/1.jpg alt="家｜リビング ">
    <img src=/blog/1.jpg alt="おすすめ">"""
    got = {r[1]: r for r in images.crawled_pictures(page, "https://h.jp/p/")}
    assert got.keys() == {"https://h.jp/og.jpg", "https://h.jp/up/madori1.png", "https://h.jp/k/kitchen.jpg", "https://h.jp/big/floor-plan_01.jpg", "https://h.jp/s/bg.gif", "https://c.jp/img/q.webp"}
    best = got["https://h.jp/up/madori1.png"]
    assert best[2] == "floorplan" and best[5] == 210 and got["https://h.jp/og.jpg"][5] == 0
    assert [r[5] for r in got.values()] == sorted((r[5] for r in got.values()), reverse=True)
    assert got["https://h.jp/k/kitchen.jpg"][2] == "interior" and got["https://h.jp/big/floor-plan_01.jpg"][2] == "floorplan"
    plain = "<title>間取り</title><img src=/img/a.jpg width=500><img src=/img/photo.jpg width=500>"
    assert [r[2:5] for r in images.crawled_pictures(plain, "https://h.jp/", loose=True)] == [("floorplan", "", True), ("other", "", False)]
    assert images.crawled_pictures(None, "https://h.jp/") == []
    spark.udtf.register("crawled_pictures", images.CrawledPictures)
    assert spark.sql("SELECT url FROM crawled_pictures('<img src=z.png>', 'https://h.jp/')").first()[0] == "https://h.jp/z.png"


def test_image_headers(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480)
    gif = b"GIF89a" + struct.pack("<HH", 3, 4) + b"\0\0"
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08" + struct.pack(">HH", 20, 10) + b"\0" * 8
    webp = b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    df = spark.createDataFrame([(png,), (gif,), (jpeg,), (webp,), (b"nothing at all",), (None,)], "d binary")
    got = [tuple(r[0]) for r in df.select(images.image_size("d")).collect()]
    assert got == [(640, 480, "png"), (3, 4, "gif"), (10, 20, "jpeg"), (100, 50, "webp"), (None, None, None), (None, None, None)]


def test_pixels(spark):
    white = bytes([255, 255, 255, 255]) * (300 * 200 - 3000) + bytes([0, 0, 0, 255]) * 3000
    red = bytes([200, 30, 30, 255]) * (300 * 200)
    df = spark.createDataFrame([(300, 200, white), (300, 200, red), (50, 50, red), (None, None, None)], "w int, h int, d binary")
    r = [x[0] for x in df.select(images.byte_features("w", "h", "d")).collect()]
    assert r[0].plan_like and not r[0].hard_reject
    assert r[1].photo_like and r[1].reason == "photo"
    assert r[2].reason == "small" and r[3].reason == "unreadable"


def test_standard_addresses_have_one_key(spark):
    rows = ["https://日本語.jp/a", "HTTPS://日本語。JP:443/a", "https://xn--wgv71a119e.jp/x/../a", "https://a.example/b?c=1&d=%E3%81%82", "no url", None, "https://a.example/x/./b", "https://a.example:443/%2e/b"]
    df = spark.createDataFrame([(x,) for x in rows], "u string")
    got = [r[0] for r in df.select(U.standard("u")).collect()]
    assert got == ["https://xn--wgv71a119e.jp/a"] * 3 + ["https://a.example/b?c=1&d=%E3%81%82", "no url", "", "https://a.example/x/b", "https://a.example/b"]
    assert [r[0] for r in df.select(U.host(U.standard("u"))).limit(3).collect()] == ["xn--wgv71a119e.jp"] * 3
