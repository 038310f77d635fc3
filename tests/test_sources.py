import gzip
import json
import time

import pytest
from pyspark.sql import functions as F

from curavine.sources import files, web
from curavine.streaming import incremental


def test_json_lines(spark, tmp_path):
    path = f"file://{tmp_path}/a.jsonl"
    (tmp_path / "a.jsonl").write_text('{"id":"b","n":1}\n\n{"id":"a","n":2}\n')
    assert [(r.id, r.n) for r in files.read_lines_in_order(spark, path, "id string, n int").orderBy("ord").collect()] == [("b", 1), ("a", 2)]
    assert files.read_lines(spark, f"file://{tmp_path}/none", "id string").count() == 0
    (tmp_path / "bad.jsonl").write_text('{"id":"b"}\n{oops\n')
    assert files.read_lines(spark, f"file://{tmp_path}/bad.jsonl", "id string", tolerant=True).select("id").collect()[0].id == "b"
    with pytest.raises(Exception):
        files.read_lines(spark, f"file://{tmp_path}/bad.jsonl", "id string").collect()
    files.write_lines(spark.createDataFrame([("x",)], "id string"), f"file://{tmp_path}/out")
    files.ensure(spark, f"file://{tmp_path}/out", spark.createDataFrame([("y",)], "id string"))
    assert files.read_lines(spark, f"file://{tmp_path}/out", "id string").first().id == "x"


def test_documents_and_packages(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"version": 1, "generatedAt": "t", "source": "s", "candidates": [{"id": "a", "images": [{"url": "u", "alt": " x "}]}, {"id": "b", "images": []}]}, indent=1))
    schema = "version int, generatedAt string, source string, candidates array<struct<id:string,images:array<struct<url:string,alt:string>>>>"
    p = files.read_document(spark, f"file://{tmp_path}/p.json", schema)
    rows = files.package(p, "candidates")
    assert [(r.place, r.id) for r in rows.orderBy("place").collect()] == [(0, "a"), (1, "b")]
    flat = web.flatten_package(rows.drop("place").withColumn("title", F.lit("t")))
    assert [(r.id, r.title) for r in flat.select("id", "title").collect()] == [("a", "x")]
    assert files.read_document(spark, f"file://{tmp_path}/none.json", schema, optional=True).count() == 0
    m = spark.sql("select map('d', named_struct('n', 1)) m")
    assert tuple(files.entries(m, "m").first()) == ("d", 1)
    files.write_document(spark.range(1), f"file://{tmp_path}/doc", n=F.lit(1), items=F.array(F.lit("a")))
    assert json.loads(spark.read.text(f"file://{tmp_path}/doc", wholetext=True).first()[0]) == {"n": 1, "items": ["a"]}


def test_store(spark, tmp_path):
    s = files.Store(spark, f"file://{tmp_path}/store", "id int, v string")
    assert s.all().count() == 0
    s.put(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"))
    s.put(spark.createDataFrame([(2, "c")], "id int, v string"))
    assert sorted(map(tuple, s.all().collect())) == [(1, "a"), (2, "c")]
    s.delete(spark.createDataFrame([(1,)], "id int"))
    assert [tuple(r) for r in s.all().collect()] == [(2, "c")]
    s.clear()
    assert s.all().count() == 0


def test_a_broken_line_is_named_wherever_it_is(spark, tmp_path):
    rows = [f'{{"id": "r{k}", "n": {k}}}' for k in range(400)]
    rows[7:7] = ["", "   "]
    (tmp_path / "a.jsonl").write_text("\n".join(rows) + "\n")
    rows[333], rows[380] = '{"id": "broken', "no json"
    (tmp_path / "b.jsonl").write_text("\r\n".join(rows))
    (tmp_path / "c.jsonl").write_text("")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("700", "3000", "128m"):  # many splits of a file, some, and one
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            assert size == "128m" or spark.read.text(f"{tmp_path}/b.jsonl").rdd.getNumPartitions() > 2
            got = files.broken_lines(spark, str(tmp_path)).collect()
            assert [(r.file.rsplit("/", 1)[1], r.line, r.text) for r in got] == [("b.jsonl", 332, '{"id": "broken')]  # two blank lines aren't counted
            with pytest.raises(ValueError, match=r"b\.jsonl:332: "):
                files.read_checked_lines(spark, f"{tmp_path}/b.jsonl", "id string, n int")
            assert files.read_checked_lines(spark, f"{tmp_path}/a.jsonl", "id string, n int").count() == 400
        assert files.read_checked_lines(spark, f"{tmp_path}/none.jsonl", "id string").count() == 0 == files.broken_lines(spark, f"{tmp_path}/c.jsonl").count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_sitemaps(spark):
    body = "<urlset><url><loc> https://x/a?b&amp;c </loc><lastmod>2026-01-01</lastmod><image:image><image:loc>i.png</image:loc></image:image></url><url><loc></loc></url></urlset>"
    df = spark.createDataFrame([(1, body), (2, None)], "id int, b string")
    assert [tuple(r) for r in web.sitemap_urls(df, "b", "id").collect()] == [(1, "https://x/a?b&c", "2026-01-01", ["i.png"])]
    index = spark.createDataFrame([("<sitemapindex><sitemap><loc>u1</loc></sitemap><sitemap a='b'><loc c=d>works2</loc><lastmod>2026</lastmod></sitemap><sitemap><loc>plan3&amp;</loc></sitemap></sitemapindex>",)], "b string")
    # those worth reading are chosen before they are counted
    assert [tuple(c) for c in index.select(web.child_sitemaps("b", 1)).first()[0]] == [("works2", "2026")]
    assert [tuple(c) for c in index.select(web.child_sitemaps("b")).first()[0]] == [("works2", "2026"), ("plan3&", None)]
    assert index.select(web.locations("b")).first()[0] == ["u1", "plan3&"]


def test_archive(spark):
    record = gzip.compress(b"WARC/1.0\r\nA: b\r\n\r\nHTTP/1.1 200 OK\r\nC: d\r\n\r\n<p>body\r\n\r\nmore")
    df = spark.createDataFrame([(record,), (b"broken",), (None,)], "d binary")
    assert [r[0] for r in df.select(web.archived_body("d")).collect()] == ["<p>body\r\n\r\nmore", None, None]
    lines = spark.createDataFrame([('{"url":"u","offset":"12","length":"x"}',), ("nonsense",), ("{}",)], "value string")
    assert [(r.r_url, r.r_offset, r.r_length) for r in web.index_records(lines).collect()] == [("u", 12, None)]


def test_answers(spark):
    one = lambda x: spark.createDataFrame([(json.dumps(x),)], "value string")
    assert tuple(web.answers(one({"value": [{"contentUrl": "c", "name": "n"}, {}]}), "bing").first()) == ("c", "", "n", "")
    assert web.answers(one({"items": [{"link": "l", "image": {"contextLink": "p"}}]}), "google").first().page == "p"
    nested = {"RelatedTopics": [{"FirstURL": "a", "Text": "A"}, {"Topics": [{"FirstURL": "b", "Text": "B"}]}]}
    assert sorted(r.url for r in web.topics(one(nested)).collect()) == ["a", "b"]
    deep = {"FirstURL": "d", "Text": "D"}
    for _ in range(5):
        deep = {"Topics": [deep]}
    whole = {"AbstractURL": "h", "Heading": "H", "Results": [{"FirstURL": "r", "Text": "R"}], "RelatedTopics": [deep]}
    assert [tuple(r) for r in web.topics(one(whole)).collect()] == [("h", "H"), ("r", "R"), ("d", "D")]
    assert web.topics(spark.createDataFrame([(None,), ("x",), ("[]",)], "value string")).count() == 0
    assert web.posts(one([{"link": "l", "title": {"rendered": "t"}}])).first().title == "t"
    text = spark.createDataFrame([('<a href="https://s/?uddg=https%3A%2F%2Fx.com">T</a> https://y.com/z',), ('[{"url":"https://j.com","title":"J"}]',)], "value string")
    assert {r.url: r.title for r in web.pasted(text).collect()}.keys() >= {"https://x.com", "https://y.com/z", "https://j.com"}


def test_pasted_lists_and_fields(spark):
    texts = ['{"items":[{"href":"https:\\/\\/a.com\\/x","text":"A"}]}', '{"links":[{"link":"https://b.com","label":"B"},"https:\\/\\/c.com"]}', '{"results":[{"url":"","href":"https://d.com","title":"","text":"D"}]}']
    got = web.pasted(spark.createDataFrame([(t,) for t in texts], "value string"))
    assert {r.url: r.title for r in got.collect()} == {"https://a.com/x": "A", "https://b.com": "B", "https://c.com": "", "https://d.com": "D"}


def test_watermarks_and_processed(spark):
    rows = spark.createDataFrame([("a", "2020", 1), ("a", "2022", 2), ("b", "2019", 3), ("b", None, 4)], "k string, t string, id int")
    state = spark.createDataFrame([("a", "2020")], "k string, watermark string")
    assert sorted(r.id for r in incremental.new_since(rows, state, "k", "t").collect()) == [2, 3, 4]
    assert {r.k: r.watermark for r in incremental.raise_watermarks(rows, state, "k", "t").collect()} == {"a": "2022", "b": "2019"}
    assert incremental.feed_changed(rows.limit(0).selectExpr("t generatedAt", "id n"), rows.limit(1).selectExpr("t generatedAt", "id n"))


def test_streams(spark, tmp_path):
    inbox, out = tmp_path / "in", f"file://{tmp_path}/out"
    inbox.mkdir()
    (inbox / "1.json").write_text('{"k":"a","t":"2020","v":1}\n{"k":"a","t":"2020","v":2}')
    seen = []
    q = incremental.watch_feed(spark, f"file://{inbox}", "k string, t string, v int", lambda df, n: seen.append((n, df.count())), f"file://{tmp_path}/cp", every="1 second")
    for _ in range(60):
        time.sleep(0.5)
        if seen:
            break
    q.stop()
    assert seen and seen[0][0] == 0
    stream = spark.readStream.schema("k string, t string, v int").json(f"file://{inbox}")
    sink = incremental.upsert_sink(out, "k", "v")
    run = lambda: stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"file://{tmp_path}/cp2").trigger(availableNow=True).start().awaitTermination()
    run()
    (inbox / "2.json").write_text('{"k":"b","t":"2021","v":3}')
    run()
    sink(spark.createDataFrame([("b", "2021", 3)], "k string, t string, v int"), 1)  # the same batch once more
    assert sorted(tuple(r) for r in spark.read.parquet(f"{out}/b1").select("k", "v").collect()) == [("a", 1), ("b", 3)]


def test_crawl_state_has_defaults_and_a_time(spark, tmp_path):
    path = str(tmp_path / "state")
    fresh = files.read_state(spark, path).collect()
    assert len(fresh) == 1 and fresh[0].schemaVersion == 1 and fresh[0].domains == {} and fresh[0].pdf.processedUrls == [] and fresh[0].updatedAt is None
    part = spark.sql("SELECT named_struct('processedUrls', array('u')) AS pdf, map('d', named_struct('failures', 2)) AS domains")
    files.write_state(part, path)
    row = files.read_state(spark, path).first()
    assert row.pdf.processedUrls == ["u"] and row.commonCrawl.processedIndexes == [] and row.domains["d"].failures == 2
    assert row.schemaVersion == 1 and row.updatedAt.endswith("Z")
