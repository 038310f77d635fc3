"""Tags in one pass, and the pictures of pages with their contexts: against a loop, and in time that grows with the page."""

import random
import re
import time

import pytest

from curavine.functions import images, markup


def test_pictures_of_a_page(spark):
    page = """<title>T &amp; t</title><article><p>around</p><figure><img data-src="a.jpg" src="data:x" srcset="a.jpg 1x, b.jpg 2x" alt=" plan  1" width="30"><figcaption>cap <b>x</b></figcaption></figure></article>
    <div style="background:url('c.png')"></div><source srcset="d.webp"><i style=url(e.png)>"""
    rows = list(images.pictures(page))
    # img elements come first, then source elements, then styles
    assert [(r[1], r[2]) for r in rows] == [("a.jpg", "data-src"), ("b.jpg", "srcset"), ("d.webp", "picture-source"), ("c.png", "css-background"), ("e.png", "css-background")]
    assert rows[0][3:7] == ("plan 1", 30, None, "cap x") and rows[0][7].startswith("cap x cap x plan 1 T &amp; t around") and rows[0][8] == "T &amp; t"
    assert rows[2][6] == "" and rows[3][3] == ""
    assert list(images.pictures(None)) == [] and list(images.pictures("", "x")) == []
    assert [r[1] for r in images.pictures("<img src=' /é.png '><img src=../b.jpg><img src=javascript:x><img src='#'><img src='//日本.jp/c'>", "https://a.jp/x/y")] == ["https://a.jp/%C3%A9.png", "https://a.jp/b.jpg", "https://xn--wgv71a.jp/c"]
    spark.udtf.register("html_pictures", images.HtmlPictures)
    assert spark.sql("SELECT url FROM html_pictures('<img src=\"z.png\">', 'http://a/b')").first()[0] == "http://a/z.png"
    assert spark.sql("SELECT url FROM html_pictures('<img src=\"z.png\">')").first()[0] == "z.png"


def test_pictures_in_unquoted_and_further_attributes():
    page = """<img src=a.jpg width=30><img data-large_image="b.jpg" data-bg='c.jpg'><img data-background-image="d.jpg" srcset="e.jpg 1x,f.jpg 2x,/w_3,h_4/g.jpg 3x">
    <source srcset="h.webp,i.webp"><source srcset="data:image/png;base64,AAAA 1x, j.webp 2x"><img data-srcset="k.jpg 1x, l.jpg 2x">"""
    rows = list(images.pictures(page))
    assert [r[1] for r in rows] == ["a.jpg", "b.jpg", "c.jpg", "d.jpg", "e.jpg", "f.jpg", "/w_3,h_4/g.jpg", "k.jpg", "l.jpg", "h.webp", "i.webp", "j.webp"]
    assert rows[0][4] == 30


def looked_up(page, at, name):
    """The block around a place by a search from there: the last opening tag before it, the first closing one behind it."""
    opens = [m.start() for m in re.finditer(rf"<{name}\b[^>]*>", page[:at])]
    close = re.search(f"</{name}>", page[at:])
    if opens and close and at + close.end() - opens[-1] <= images.LONGEST:
        return opens[-1], at + close.end()
    return None


def test_contexts_equal_searches():
    random.seed(6)
    parts = [*(f"<{n}>" for n in images.ENCLOSING), *(f"</{n}>" for n in images.ENCLOSING), "<div class='x'>", "<img src=a.png>", "<source srcset=b.png>", "word ", "long " * 300, "<p>", "</p>", "</div >", "<section", ">"]
    for _ in range(300):
        page = "".join(random.choices(parts, k=random.randint(1, 60)))
        for _, at, _, blocks in images._contexts(page):
            want = [(n, *found) for n in images.ENCLOSING if (found := looked_up(page, at, n))]
            assert blocks == want, (page, at)


def test_helpers_equal_patterns():
    random.seed(7)
    parts = ["<", ">", "<>", "<a>", "<script>", "</script>", "<style x>", "</style>", "x", " url(", "url('", 'url("', "a.png", ")", "'", '"', "')", "/i/b.jpg", "<b ", "=", "\n"]
    for _ in range(2000):
        page = "".join(random.choices(parts, k=random.randint(0, 25)))
        assert markup.without_tags(page) == re.sub("<[^>]+>", " ", page)
        assert [x for _, x in markup.style_urls(page)] == [m[1] for m in re.findall(r"url\((['\"]?)([^)'\"]+)\1\)", page)]
        assert markup.without_code(page) == re.sub(r"<style\b[^>]*>[\s\S]*?</style>", " ", re.sub(r"<script\b[^>]*>[\s\S]*?</script>", " ", page))
        assert [page[t.end : e] for t, e, _ in markup.elements(page, "script")] == re.findall(r"<script\b[^>]*>([\s\S]*?)</script>", page)


PAGES = {
    "pictures": lambda n: "".join(f"<li><img src={k}.png alt='a'>" for k in range(n)), "in blocks": lambda n: "".join(f"<div><figure><img src={k}.png><figcaption>c</figcaption></figure></div>" for k in range(n)),
    "unclosed scripts": lambda n: "<script>" * n + "<img src=a.png>", "unclosed links": lambda n: "<a href=x.png>" * n, "open tags": lambda n: "<" * n + "<img src=a.png", "styles": lambda n: "url(" * n, "quotes": lambda n: "'" * n + '"/a.png?.png?' * n,
    "headings": lambda n: "<h1>" * n + "<title>" * n, "meta": lambda n: "<meta content='x' name='og:title>" * n,
}


@pytest.mark.parametrize("kind", PAGES)
def test_time_grows_with_the_page(kind):
    def seconds(n):
        page, start = PAGES[kind](n), time.process_time()
        list(images.pictures(page, "https://a.jp/"))
        images.crawled_pictures(page, "https://a.jp/", loose=True)
        images.archived_pictures(page, "https://a.jp/", loose=True)
        return time.process_time() - start

    seconds(100)
    small, large = seconds(2000), seconds(16_000)
    assert large < 8 * 3 * max(small, 0.02)  # eight times the page; with its square it would be 64


def test_archived_pictures(spark):
    page = """<meta property="og:title" content="平屋の家"><meta name="twitter:image" content="/madori_1.png"><h1>x</h1><p>間取り</p><img src=/up/floor-plan.jpg alt="間取り図 3LDK"><img src=/img/a.jpg width=500><img src=/img/kitchen.jpg width=500>
    <img src=/x/logo_madori.png><img src=undefined><img src=/a.svg alt=間取り図><a href=/plan/madori_3.webp><b>open</b></a><img src=ftp://a.jp/madori.png><i style="background:url(/exterior.png)">"""
    got = {r[1].removeprefix("https://h.jp"): r[2:] for r in images.archived_pictures(page, "https://h.jp/p/")}
    assert got == {"/madori_1.png": ("floorplan", "OG image", False, 120), "/up/floor-plan.jpg": ("floorplan", "間取り図 3LDK", False, 155), "/plan/madori_3.webp": ("floorplan", "open", False, 120)}
    loose = {r[1].removeprefix("https://h.jp"): r[2:] for r in images.archived_pictures(page, "https://h.jp/p/", loose=True)}
    assert loose["/img/a.jpg"] == ("floorplan", "平屋の家", True, 45) and "/img/kitchen.jpg" not in loose and "/exterior.png" not in loose and loose["/plan/madori_3.webp"][2] is False
    assert [r[-1] for r in images.archived_pictures(page, "https://h.jp/p/", loose=True)] == sorted((r[-1] for r in loose.values()), reverse=True)
    assert len(images.archived_pictures("".join(f"<img src=madori{k}.png>" for k in range(60)), "https://h.jp/")) == 40
    assert images.archived_pictures(None, "x") == []
    spark.udtf.register("archived_pictures", images.ArchivedPictures)
    assert spark.sql("SELECT kind FROM archived_pictures('<img src=madori.png>', 'https://h.jp/')").first()[0] == "floorplan"
