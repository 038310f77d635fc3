"""Sitemap files through Spark's XML reader: the same as patterns over whole texts, and as files come in."""

from curavine.sources import sitemaps, web

MAP = """<?xml version="1.0" encoding="UTF-8"?>
<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:image="http://www.google.com/schemas/sitemap-image/1.1">
<url><loc> https://h.jp/works/1?a&amp;b=日本 </loc><lastmod>2024-01-02</lastmod><image:image><image:loc> https://h.jp/1.png </image:loc><image:title>t</image:title></image:image><image:image><image:loc>https://h.jp/2.png</image:loc></image:image></url>
<url><loc lang="ja">https://h.jp/about</loc></url><url><lastmod>2024</lastmod></url><url><loc><![CDATA[https://h.jp/plan/&2]]></loc><lastmod/></url>
<url><loc>https://h.jp/pic</loc><image:image><image:loc>https://h.jp/3.png</image:loc></image:image></url></urlset>"""
INDEX = "<sitemapindex>" + "".join(f"<sitemap><loc>https://h.jp/{n}.xml</loc>{m}</sitemap>" for n, m in (("news", ""), ("works-1", "<lastmod>2023</lastmod>"), ("plan-2", ""), ("post-3", ""))) + "</sitemapindex>"


def key(rows):
    return sorted((r.loc, r.lastmod or "", tuple(r.images)) for r in rows)


def test_files_equal_texts(spark, tmp_path):
    (tmp_path / "a.xml").write_text(MAP)
    (tmp_path / "b.xml").write_text("<urlset>" + "".join(f"<url><loc>https://h.jp/{k}</loc></url>" for k in range(5000)) + "</urlset>")
    rows = sitemaps.read_urls(spark, str(tmp_path)).collect()
    assert len(rows) == 4 + 5000 and {r.sitemap.rsplit("/", 1)[1] for r in rows} == {"a.xml", "b.xml"}
    own = [r for r in rows if r.sitemap.endswith("a.xml")]
    assert key(own) == sorted([("https://h.jp/works/1?a&b=日本", "2024-01-02", ("https://h.jp/1.png", "https://h.jp/2.png")), ("https://h.jp/about", "", ()), ("https://h.jp/plan/&2", "", ()), ("https://h.jp/pic", "", ("https://h.jp/3.png",))])
    plain = MAP.replace("<![CDATA[https://h.jp/plan/&2]]>", "https://h.jp/plan/&amp;2")
    texts = spark.createDataFrame([(plain,)], "body string")
    assert key(web.sitemap_urls(texts, "body").collect()) == key(own)


def test_an_index_leads_to_its_children(spark, tmp_path):
    (tmp_path / "index.xml").write_text(INDEX)
    children = sitemaps.read_children(spark, f"{tmp_path}/index.xml")
    assert sorted((r.loc, r.lastmod) for r in children.collect()) == [(f"https://h.jp/{n}.xml", m) for n, m in (("news", None), ("plan-2", None), ("post-3", None), ("works-1", "2023"))]
    first = sitemaps.first_children(children, "sitemap", "loc", 2)
    assert sorted(r.loc for r in first.collect()) == ["https://h.jp/plan-2.xml", "https://h.jp/post-3.xml"]
    urls = spark.createDataFrame(
        [("https://h.jp/works-1.xml", "https://h.jp/works/1", None, []), ("https://h.jp/works-1.xml", "https://h.jp/about", "2024", []), ("https://h.jp/works-1.xml", "https://h.jp/about2", "2024", ["i"]), ("https://h.jp/news.xml", "https://h.jp/plan/", None, [])],
        "sitemap string, loc string, lastmod string, images array<string>")
    got = sitemaps.tree(sitemaps.first_children(children, "sitemap", "loc"), urls)
    assert sorted((r.loc, r.lastmod) for r in got.collect()) == [("https://h.jp/about2", "2024"), ("https://h.jp/works/1", "2023")]


def test_files_as_they_come_in(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.xml").write_text(MAP)
    run = lambda: sitemaps.stream_urls(spark, str(inbox)).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    run()
    (inbox / "c.xml").write_text("<urlset><url><loc>https://h.jp/new</loc></url></urlset>")
    run()
    assert key(spark.read.parquet(f"{tmp_path}/out").collect()) == key(sitemaps.read_urls(spark, str(inbox)).collect())


def test_written_sitemaps_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("https://h.jp/é?a&b<c", "2024", ["x&y", "z"], 1), ("https://h.jp/2", None, [], 2)], "loc string, lastmod string, images array<string>, k int")
    sitemaps.write_urls(rows, f"{tmp_path}/w", "k")
    assert key(sitemaps.read_urls(spark, f"{tmp_path}/w").collect()) == key(rows.collect())
    sitemaps.write_children(rows, f"{tmp_path}/i")
    assert sorted(r.loc for r in sitemaps.read_children(spark, f"{tmp_path}/i").collect()) == ["https://h.jp/2", "https://h.jp/é?a&b<c"]
