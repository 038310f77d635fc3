"""URLs by the rules of the URL Standard: what parses to what, and what isn't a URL."""

import pytest
from pyspark.sql import functions as F

from curavine.functions import weburl

BASE = "http://example.org/foo/bar?q#f"
CASES = [
    # international host names, in any form, have one address
    ("https://日本語.jp/間取り?図=平屋#階", None, "https://xn--wgv71a119e.jp/%E9%96%93%E5%8F%96%E3%82%8A?%E5%9B%B3=%E5%B9%B3%E5%B1%8B#%E9%9A%8E"), ("https://日本語。ＪＰ/", None, "https://xn--wgv71a119e.jp/"),
    ("http://MÜNCHEN.de", None, "http://xn--mnchen-3ya.de/"), ("http://faß.de/", None, "http://xn--fa-hia.de/"), ("http://xn--mnchen-3ya.de/", None, "http://xn--mnchen-3ya.de/"), ("http://%E6%97%A5%E6%9C%AC.jp", None, "http://xn--wgv71a.jp/"),
    ("http://ＧＯ.com", None, "http://go.com/"), ("http://GOO\u200b\u2060goo.com", None, "http://googoo.com/"), ("http://ex%41mple.com/", None, "http://example.com/"),
    # ports, users, backslashes, tabs and spaces around
    ("HTTP://User:p%40ss@EXAMPLE.com:80/a", None, "http://User:p%40ss@example.com/a"), ("https://a.b:443", None, "https://a.b/"), ("https://a.b:80/x", None, "https://a.b:80/x"), ("http://a.b:/x", None, "http://a.b/x"), ("http://a.b:0080/x", None, "http://a.b/x"),
    ("http:\\\\a.b\\c\\..\\d?x\\y", None, "http://a.b/d?x\\y"), ("  http://a.b/\tc\n ", None, "http://a.b/c"), ("http:////a.b/c", None, "http://a.b/c"), ("http:a.b/c", None, "http://a.b/c"), ("http://a@b@c/", None, "http://a%40b@c/"),
    ("http://a b@c/", None, "http://a%20b@c/"), ("http://:@c/d", None, "http://c/d"), ("http://u:@c/d", None, "http://u@c/d"),
    # dots and escapes of paths, queries and fragments
    ("http://a/./b/../c/%2E%2e/d/.", None, "http://a/d/"), ("http://a/..", None, "http://a/"), ("http://a/b/..", None, "http://a/"), ("http://a//b//", None, "http://a//b//"), ("http://a/x y\"<>`{}|^", None, "http://a/x%20y%22%3C%3E%60%7B%7D|%5E"),
    ("http://a/?x y'\"<>`{}|#x y'\"<>`{}|", None, "http://a/?x%20y%27%22%3C%3E`{}|#x%20y'%22%3C%3E%60{}|"), ("http://a/%zz%4", None, "http://a/%zz%4"), ("http://a/?", None, "http://a/?"), ("http://a/#", None, "http://a/#"), ("http://a?b/../c", None, "http://a/?b/../c"),
    # addresses of machines
    ("http://192.168.0.1/", None, "http://192.168.0.1/"), ("http://0x7f.1/", None, "http://127.0.0.1/"), ("http://017700000001", None, "http://127.0.0.1/"), ("http://256/", None, "http://0.0.1.0/"), ("http://[::1]:8080/", None, "http://[::1]:8080/"),
    ("http://[2001:DB8:0:0:1:0:0:1]", None, "http://[2001:db8::1:0:0:1]/"), ("http://[::127.0.0.1]", None, "http://[::7f00:1]/"), ("http://1.2.3.4.", None, "http://1.2.3.4/"),
    # against a base
    ("", BASE, "http://example.org/foo/bar?q"), ("#g", BASE, "http://example.org/foo/bar?q#g"), ("?r", BASE, "http://example.org/foo/bar?r"), ("baz", BASE, "http://example.org/foo/baz"), ("../baz/", BASE, "http://example.org/baz/"), ("/x", BASE, "http://example.org/x"),
    ("//日本.jp/y", BASE, "http://xn--wgv71a.jp/y"), ("\\\\h\\y", BASE, "http://h/y"), ("http:baz", BASE, "http://example.org/foo/baz"), ("https:baz", BASE, "https://baz/"), (".", BASE, "http://example.org/foo/"), ("..", BASE, "http://example.org/"), ("a:b", BASE, "a:b"),
    ("画像 1.png", "https://x.jp/間取り/", "https://x.jp/%E9%96%93%E5%8F%96%E3%82%8A/%E7%94%BB%E5%83%8F%201.png"), ("http:///h/y", BASE, "http://h/y"), ("http:/y", BASE, "http://example.org/y"),
    # other schemes
    ("mailto:a b@c.d?s=x y", None, "mailto:a b@c.d?s=x%20y"), ("data:text/plain,<a>#x", None, "data:text/plain,<a>#x"), ("foo://Host/a/../b", None, "foo://Host/b"), ("foo:/a/./b", None, "foo:/a/b"), ("foo://", None, "foo://"), ("file:///a/../b", None, "file:///b"), ("file://localhost/x", None, "file:///x"),
    ("ws://a:80/", None, "ws://a/"), ("foo:/.//p", None, "foo:/.//p"),
]
BAD = [
    ("", None), ("no url", None), ("//a", None), ("http://", None), ("http://a b/", None), ("http://a:99999/", None), ("http://a:b/", None), ("http://[::1", None), ("http://[1::2::3]/", None), ("http://1.2.3.4.5/", None), ("http://256.1.1.1/", None),
    ("http://%zz/", None), ("http://a<b/", None), ("http://xn--/", None), ("http://@/", None), ("x", "mailto:a@b"), ("http://a%00b", None), ("https://%ff", None), ("http://:80", None),
]


@pytest.mark.parametrize("link, base, want", CASES)
def test_urls(link, base, want):
    found = weburl.parse(link, weburl.parse(base) if base else None)
    assert found is not None and found.href() == want
    assert weburl.parse(want).href() == want  # its own address


@pytest.mark.parametrize("link, base", BAD)
def test_what_is_no_url(link, base):
    assert weburl.parse(link, weburl.parse(base) if base else None) is None


def test_columns(spark):
    rows = [("../b?x#y", "http://日本.jp/a/c"), ("javascript:void(0)", "http://a/"), ("mailto:x", "http://a/"), ("x", None), (None, "http://a/"), ("", "http://a/b"), ("http://[", "http://a/"), ("https://A:443\\b", None)]
    df = spark.createDataFrame(rows, "link string, base string")
    assert [r[0] for r in df.select(weburl.web_address("link", "base")).collect()] == ["http://xn--wgv71a.jp/b?x#y", "", "", "", "", "", "", "https://a/b"]
    got = df.select(weburl.web_parts(F.coalesce("base", "link")).alias("p")).select("p.*").collect()
    assert tuple(got[0]) == ("http://xn--wgv71a.jp/a/c", "http", "xn--wgv71a.jp", None, "/a/c", None, None) and tuple(got[3]) == (None,) * 7
    assert df.limit(0).select(weburl.web_address("link", "base")).count() == 0


def test_time_grows_with_the_length():
    weburl.parse("http://a/" + "../" * 200_000 + "x" * 200_000 + "?" + "é" * 100_000)
    weburl.parse("http://" + "a." * 100_000 + "b/")
