import pytest
from pyspark.sql import functions as F

from sluice.functions import ids, urls

BASE = "https://a.com/b/c?d#e"
#: What browsers give for new URL(raw).href; None where it throws.
ALONE = {
    "HTTP://EXAMPLE.com:80/../a/./b/../c?x=1#f": "http://example.com/a/c?x=1#f",
    "http:\\\\x.com\\a\\b?c\\d": "http://x.com/a/b?c\\d",
    " \n ht\ttp://a\n.com/\r ": "http://a.com/",
    "http://ex%41mple.com": "http://example.com/",
    "https://münchen.de/ä?ö=1#ü": "https://xn--mnchen-3ya.de/%C3%A4?%C3%B6=1#%C3%BC",
    "https://例え。テスト/": "https://xn--r8jz45g.xn--zckzah/",
    "https://i❤.ws/": "https://xn--i-7iq.ws/",
    "https:example.org": "https://example.org/",
    "https:////example.org//x": "https://example.org//x",
    "http://a:b@c:29/d": "http://a:b@c:29/d",
    "http://u@ser:p@ss@c/": "http://u%40ser:p%40ss@c/",
    "http://:@c/": "http://c/",
    "http://foo.com:/x": "http://foo.com/x",
    "http://foo.com:00080/x": "http://foo.com/x",
    "http://foo.com:0/x": "http://foo.com:0/x",
    "https://foo.com:80/x": "https://foo.com:80/x",
    "http://foo.com:65536/x": None,
    "http://foo.com:b/x": None,
    "http://1.2.3.4/": "http://1.2.3.4/",
    "http://1.2.3.4.5/": None,
    "http://1.2.256.4/": None,
    "http://[::1]:8080/": "http://[::1]:8080/",
    "http://a b/": None,
    "http://a%00b/": None,
    "http://": None,
    "http:///a": "http://a/",
    "http://a/?q='x' \"<>`{}": "http://a/?q=%27x%27%20%22%3C%3E`{}",
    "http://a/'x' \"<>`{}|^[]": "http://a/'x'%20%22%3C%3E%60%7B%7D|^[]",
    "http://a/#'x' \"<>`{}": "http://a/#'x'%20%22%3C%3E%60{}",
    "http://a/%2e/b/%2E%2e/c/.%2e": "http://a/",
    "http://a/b/..": "http://a/",
    "http://a/b/.": "http://a/b/",
    "http://a/../../x/...": "http://a/x/...",
    "http://a?": "http://a/?",
    "http://a/#": "http://a/#",
    "http://a/😀": "http://a/%F0%9F%98%80",
    "http://a/50%": "http://a/50%",
    "ftp://X.y:21/z": "ftp://x.y/z",
    "mailto:X@y": "mailto:X@y",
    "JavaScript:alert(1)": "javascript:alert(1)",
    "https://news.example.com/a/b-c_d.html?x=1&y=2#z": "https://news.example.com/a/b-c_d.html?x=1&y=2#z",
    "foo/bar": None,
    "": None,
}
#: new URL(raw, BASE).href
JOINED = {
    "": "https://a.com/b/c?d", "?x y": "https://a.com/b/c?x%20y", "#f": "https://a.com/b/c?d#f", "g": "https://a.com/b/g", "../../g": "https://a.com/g", "g/..": "https://a.com/b/",
    "..": "https://a.com/", ".": "https://a.com/b/", "/x/./y": "https://a.com/x/y", "//B.com/x": "https://b.com/x", "\\\\b.com\\x": "https://b.com/x", "\\x\\y": "https://a.com/x/y", "https:x": "https://a.com/b/x",
    "https:/x": "https://a.com/x", "https://x": "https://x/", "http:x": "http://x/", "..%2Fx": "https://a.com/b/..%2Fx", "a:b": "a:b", " /p\tq ": "https://a.com/pq", "//": None, "x?a/../b": "https://a.com/b/x?a/../b",
    "/clean/path?x=1": "https://a.com/clean/path?x=1", "https://a b": None,
}


def test_alone(spark):
    frame = spark.createDataFrame(list(enumerate(ALONE)), "n int, raw string")
    got = {r["raw"]: r["u"] for r in frame.select("raw", urls.serialised(F.col("raw")).alias("u")).collect()}
    assert {k: v for k, v in got.items() if v != ALONE[k]} == {}
    shown = {r["raw"]: r["u"] for r in frame.select("raw", urls.normalized_url("raw").alias("u")).collect()}
    assert shown == {k: v if v is not None else k.strip() for k, v in ALONE.items()}


def test_against_a_base(spark):
    frame = spark.createDataFrame([(raw, base) for raw in JOINED for base in (BASE, " HTTPS://A.com:443/x/../b/c?d#e")], "raw string, base string")
    got = {(r["raw"], r["base"]): r["u"] for r in frame.select("raw", "base", urls.resolved_url("raw", "base").alias("u")).collect()}
    assert {k: v for k, v in got.items() if v != (JOINED[k[0]] if JOINED[k[0]] is not None else k[0])} == {}


@pytest.mark.parametrize(("raw", "base", "want"), [("/x", "no url", "/x"), ("http://x", "no url", "http://x"), ("/x", None, "/x"), ("http://x", None, "http://x/"), (None, BASE, None), ("x", "mailto:y", "x"), ("http://x", "mailto:y", "http://x/")])
def test_without_a_sound_base(spark, raw, base, want):
    frame = spark.createDataFrame([(raw, base)], "raw string, base string")
    assert frame.select(urls.resolved_url("raw", "base")).first()[0] == want


def test_no_python_and_without_query(spark):
    frame = spark.createDataFrame([("https://A.com?x#y",), ("a b?c",), (None,), ("https://a.com/B#c?d",)], "u string")
    got = frame.select(ids.url_without_query("u").alias("v"), urls.resolved_url("u", "u").alias("w"))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert [r["v"] for r in got.collect()] == ["https://a.com/", "a b", None, "https://a.com/b"]
