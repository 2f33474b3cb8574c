import pytest
from pyspark.sql import functions as F

from sluice.functions import ids, text, urls
from sluice.operators import extract as X


@pytest.fixture
def pages(spark):
    return lambda *html, url="https://x.org/s/sub/?mode=hot", api=None: spark.createDataFrame([(i, url, h, api) for i, h in enumerate(html)], "page_id long, url string, html string, api_payload string")


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("page_id", "pos").collect()]


def test_titleline_rows(pages):
    one = "<tr class='athing'><td><span class=\"titleline\"><a href='item?id=1&amp;x'>A <b>x</b></a></span></tr>"
    got = rows(X.titleline_rows(pages(one + one.replace("A", "a") + one.replace("athing", "athing b"))), "title", "url", "summary", "raw_html_snippet")
    assert got == [("A x", "https://x.org/s/sub/item?id=1&amp;x", None, "A x")]


def test_article_links_fall_back_by_page(pages):
    got = X.article_links(pages('<a id="article-link-1" href="/u">T</a><h2><a href="/no">n</a></h2>', '<h2><a href="/v">V</a></h2>'))
    assert rows(got, "page_id", "url", "raw_html_snippet") == [(0, "https://x.org/u", "T"), (1, "https://x.org/v", "V")]


def test_cards(pages):
    thumb = '<div class="thumb thumb_rel item"><a href="/video/1/" title="T"><img src="data:x"><img src="S.jpg" data-original="I.jpg"></a></div>'
    assert rows(X.thumb_cards(pages(thumb)), "title", "url", "preview_image_url") == [("T", "https://x.org/video/1/", "https://x.org/s/sub/I.jpg")]
    poster = '<div class="item"><a href="/v/1" class="poster"><img src="I"></a><div><a href=" " class="title">T</a></div></div>'
    assert rows(X.poster_cards(pages(poster)), "title", "url") == [("T", "https://x.org/v/1")]


def test_sections_and_ranked_rows(pages):
    html = '<div class="board-hot-title">Hot {0}</div><div class="miso-post-list"><ul class="post-list"><li class="post-row"><a href="U{0}">+3 T<span class="count">+9</span></a></li><li class="post-row"><a href="V">W</a></li></ul></div>'
    assert rows(X.sectioned_list(pages(html.format("L") + html.format("Z")), {"L": "Label"}), "title", "summary") == [("T +9", "Label · 댓글 +9"), ("W", "Label")]
    ranked = '<ul class="td ufl"><li>1</li><li><b>no</b></li><li class="tit"><a href="U">T</a></li><li>12.11</li></ul>'
    assert rows(X.ranked_rows(pages(ranked)), "title", "summary") == [("T", "1위 · 12.11")]


STATUS = "https://x.com/i/status/"


def test_ranked_anchors_take_the_marker_before_them(pages):
    anchor = '<a href="https://video.twimg.com/ext_tw_video/{}/a.mp4">VideoURL</a>'
    html = anchor.format(4) + '<img src="rank1.png">1위 <img src="https://pbs.twimg.com/p.jpg"><a href="https://x.com/u/status/11?s=1">s</a>' + anchor.format(5) + '<img src="rank2.png">2위 <a href="https://x.com/i/status/12">s</a>' + anchor.format(5) + anchor.format(6)
    got = rows(X.ranked_anchors(pages(html)), "dedupe_key", "title", "preview_image_url", "summary")
    image = "https://pbs.twimg.com/p.jpg"
    assert got == [("twidouga:video-id:4", f"1위 - {STATUS}11", image, f"{STATUS}11"), ("twidouga:video-id:5", f"1위 - {STATUS}11", image, f"{STATUS}11"), ("twidouga:video-id:6", f"2위 - {STATUS}12", None, f"{STATUS}12")]
    plain = rows(X.ranked_anchors(pages(anchor.format(8))), "title", "url")
    assert plain == [("1위 - https://video.twimg.com/ext_tw_video/8/a.mp4", "https://video.twimg.com/ext_tw_video/8/a.mp4")]


def test_ranked_articles(pages):
    card = '<article><div class="absolute top-3 left-3">{0}</div><video src="https://v/amplify_video/{1}/a" poster="p.jpg"></video><a href="https://x.com/i/status/1?s=2">T{0}</a><i class="lucide-eye"></i><span>{2}</span></article>'
    got = rows(X.ranked_articles(pages(card.format(2, 7, 5) + card.format(1, 7, 99) + card.format(3, 8, "1,099") + "<article>none</article>" + card.format(0, 9, 4))), "title", "dedupe_key", "summary", "raw_html_snippet")
    assert got == [("0위 - T0", "xranking:video-id:9", f"{STATUS}1", "조회수 4"), ("1위 - T1", "xranking:video-id:7", f"{STATUS}1", "조회수 99"), ("3위 - T3", "xranking:video-id:8", f"{STATUS}1", None)]


def test_api_rows_and_fallback(pages):
    api = '{"success":true,"data":[{"id":5,"direct_url":"https://d/video/9","ranking":"2x","play_count":12,"title":"Q","posts":[{"id":"77"}]},{"id":"6","direct_url":"https://d/video/8","ranking":1,"play_count":"12","posts":[{"id":78,"uploader":{"display_name":"N"}}]},{"title":"no"},null]}'
    assert rows(X.api_or_images(pages("", api=api)), "title", "dedupe_key", "summary", "raw_html_snippet") == [("1위 - N님의 동영상", "nimi:video-id:6", f"{STATUS}78", None), ("2위 - Q", "nimi:video-id:5", f"{STATUS}77", "조회수 12")]
    image = '<div>1</div><a href="https://x.com/i/status/5"><img src="https://pbs.twimg.com/amplify_video_thumb/3/1.jpg" alt="x"></a><svg></svg><span>1,379</span>'
    shot = "https://pbs.twimg.com/amplify_video_thumb/3/1.jpg"
    assert rows(X.api_or_images(pages(image, api="nope")), "title", "url", "dedupe_key", "raw_html_snippet") == [("1위 - x", shot, "nimi:preview-id:3", "조회수 1379")]
    assert rows(X.api_or_images(pages(image, api="[]")), "title") == [] and rows(X.api_or_images(pages(image, api="{}")), "pos") == [(0,)]
    s = '<img src="https://pbs.twimg.com/1.jpg" alt="x"> https://video.twimg.com/abSc.mp4 '
    assert rows(X.image_chunk_ranking(pages(s)), "url") == [("https://video.twimg.com/ab",)] and rows(X.image_chunk_ranking(pages(s), compat_s_class=False), "url") == [("https://video.twimg.com/abSc.mp4",)]


def test_packed_chunks_and_anchors(pages):
    packed = """<script>self.__next_f.push([1,'{"id":{"__t":"u","v":"a1"},"title":"T \\\\u0041","prev'])</script><script>self.__next_f.push([1,"iew\\":\\"I.jpg\\"}"])</script>"""
    cards = '<a title="T" href="/s/x/y?p=1&amp;mode=new"><img src="data:x" alt="no"></a><img alt="t" src="I">'
    got = rows(X.payload_or_anchors(pages(packed, cards)), "page_id", "title", "url", "preview_image_url")
    assert got == [(0, "T A", "https://x.org/s/sub/a1?mode=hot", "https://x.org/s/sub/I.jpg"), (1, "T", "https://x.org/s/x/y?mode=new", "https://x.org/s/sub/I")]


def test_anchor_cards_look_at_the_raw_page(pages):
    far = '<a title="A" href="s/x/y/z"><i></i>' + "<a>" * 1400 + '<img src="/late"><img alt="A" src="/by-title">'
    near = "<a title='B' href='https://x.org/s/q/r?mode=new&amp;p=2'>" + "<a>" * 1000 + "<img src='/near'>"
    got = rows(X.dom_anchor_cards(pages(far, near, url="https://x.org/?mode=hot")), "title", "url", "preview_image_url")
    assert got == [("A", "https://x.org/s/x/y?mode=hot", "https://x.org/by-title"), ("B", "https://x.org/s/q/r?mode=new", "https://x.org/near")]


def test_registry(pages):
    assert X.extract("list_links", pages('<li><a href="/a">A</a></li>')).count() == 1
    with pytest.raises(KeyError):
        X.extract("constructor", pages(""))


def test_hash_vectors(spark):
    known = {"": "00001505", "a": "0002b5c4", "abc": "0b873285", "https://example.com/a|hello": "e7000c23", "조회수": "0ab00c01", "\U0001f600x": "0a70d1e0"}
    frame = spark.createDataFrame([(x,) for x in known], "c string")
    assert {r["c"]: r["h"] for r in frame.select("c", ids.djb2x("c").alias("h")).collect()} == known


def test_urls(spark):
    cases = [("a", "https://x.org", "https://x.org/a"), ("../q", "https://x.org/b/c/d", "https://x.org/b/q"), ("//h/p", "http://x.org", "http://h/p"), ("?z", "http://x.org/a?b#c", "http://x.org/a?z"), ("HTTP://A.com:80", "http://x", "http://a.com/"), ("mailto:x", "http://x.org", "mailto:x"), ("http://[", "http://x.org", "http://[")]
    frame = spark.createDataFrame(cases, "a string, b string, want string")
    assert all(r["got"] == r["want"] for r in frame.select("want", urls.resolved_url("a", "b").alias("got")).collect())
    one = spark.createDataFrame([("https://A.org:443/x?period=24H", "https://a.org/y", "https://a.org:8443/", "ftp://a.org/")], "a string, b string, c string, d string")
    got = one.select(urls.same_origin("a", "b"), urls.same_origin("a", "c"), urls.same_origin("d", "d"), urls.first_alias("a", ("time", "period"), {"24h": "daily"}), urls.http_target("d")).first()
    assert tuple(got) == (True, False, False, "daily", None)


def test_text(spark):
    one = spark.createDataFrame([("&amp;lt; <b>x</b>  y﻿ ", " 3abc", "<i a='' b=c data-a=\"z\">")], "a string, b string, c string")
    got = one.select(text.clean_text("a"), text.parse_int("b"), text.attribute("c", "a"), text.attribute("c", "b"), text.attribute("c", "q"), text.clip_text(F.lit("abcdef"), 5)).first()
    assert tuple(got) == ("< x y", 3, "", "c", None, "ab...")
    labels = F.array(F.lit("zz"), F.lit("인기 순"))
    assert one.select(urls.label_contains(labels, {"실시간": "realtime", "인기": "ranking"})).first()[0] == "ranking"


#: Script literals as they stand, and their texts.
LITERALS = {
    "a\\x41\\u0042\\n\\q\\\r\nz\\": "aAB\nqz\\", "\\\\n\\\\\\n": "\\n\\\n", "\\ud83d\\ude00": "😀", "\\ud83dx\\ude00\\ud83d": "\ufffdx\ufffd\ufffd", "😀\\u{1}": "😀u{1}", "\\r\\t\\b\\f\\v\\0": "\r\t\b\f\v\0",
    "a\\\nb\\\rc\\\r\nd": "abcd", "\\u12G4\\xZ1": "u12G4xZ1", "\\'\\\"": "'\"", "": "", "plain": "plain", "\\u4E2D\\u6587": "中文", "d83dde00\\x20": "d83dde00 ",
}
#: Packed strings, and their values.
PACKED = {"\\u0041": "A", 'a\\"b': 'a\\"b', 'a"b': 'a"b', "a\\qb": "a\\qb", "a\\/b\\n": "a/b\n", "a\nb": "a\nb", "\\": "\\", "": "", "\\u00e9\"": 'é"'}


def test_script_literals(spark):
    frame = spark.createDataFrame([(x,) for x in LITERALS], "s string").select("s", text.script_text("s").alias("t"))
    assert {r["s"]: r["t"] for r in frame.collect()} == LITERALS
    assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()
    long = "\\u0041" * 50_000 + "x" * 100_000
    assert spark.createDataFrame([(long,)], "s string").select(text.script_text("s")).first()[0] == "A" * 50_000 + "x" * 100_000


def test_packed_strings(spark):
    frame = spark.createDataFrame([(x,) for x in PACKED], "s string").select("s", text.packed_text("s").alias("t"))
    assert {r["s"]: r["t"] for r in frame.collect()} == PACKED


@pytest.mark.parametrize("place", [0, 200, *range(270, 284)])
def test_clip_counts_units(spark, place):
    for length in (279, 280, 281, 400):
        whole = "x" * min(place, length - 2) + "😀" + "y" * (length - 2 - min(place, length - 2))  # so many units
        got = spark.createDataFrame([(whole,)], "s string").select(text.clip_snippet("s"), text.utf16_units("s")).first()
        cut = whole.encode("utf-16-be")[: 2 * 277].decode("utf-16-be", "ignore") + "..."
        assert tuple(got) == (whole if length <= 280 else cut, length)


def test_page_rows_are_told_apart(spark):
    primary, fallback = '<a id="article-link-1" href="/p">P</a>', '<h2><a href="/f">F</a></h2>'
    given = [(7, "https://x.org/a", primary + fallback), (7, "https://x.org/b", fallback), (None, "https://x.org/c", primary), (None, "https://x.org/c", primary + fallback), (8, "https://x.org/d", fallback), (8, "https://x.org/d", fallback), (9, None, None)]
    frame = spark.createDataFrame(given, "page_id long, url string, html string").repartition(3)
    got = sorted(((r["page_id"], r["title"], r["url"]) for r in X.article_links(frame).collect()), key=repr)
    assert got == sorted([(7, "P", "https://x.org/p"), (7, "F", "https://x.org/f"), (None, "P", "https://x.org/p"), (None, "P", "https://x.org/p"), (8, "F", "https://x.org/f")], key=repr)
    assert X.article_links(frame.limit(0)).collect() == []


def test_equal_page_rows_are_one_page(spark):
    """Ranks, places and joined chunks of a repeated page are those of the page."""
    anchors = '<img src="rank1.png">1위<a href="https://video.twimg.com/amplify_video/1/a">Video URL</a><img src="rank2.png">2위<a href="https://video.twimg.com/amplify_video/2/b">Video URL</a><a href="https://video.twimg.com/amplify_video/3/c">Video URL</a>'
    packed = """<script>self.__next_f.push([1,'{"id":{"__t":"u","v":"a1"},"title":"T","prev'])</script><script>self.__next_f.push([1,"iew\\":\\"I.jpg\\"}"])</script>"""
    for name, html in (("ranked_anchors", anchors), ("packed_payload", packed), ("payload_or_anchors", packed)):
        one = [(1, "https://x.org/s/sub", html, "x")]
        ddl = "page_id long, url string, html string, pos string"
        once, thrice = (sorted(map(tuple, X.extract(name, spark.createDataFrame(r, ddl).repartition(2)).collect())) for r in (one, one * 3))
        assert once and once == thrice


def test_next_image_by_offsets(spark):
    """Against the text itself: the first image tag that is whole within the 4,000 characters from an anchor's start."""
    import random
    import re

    rng = random.Random(4)
    made = []
    for n in range(25):
        parts = []
        for i in range(60):
            parts.append(rng.choice([f'<a title="T{i}" href="/s/x/{i}">', f'<img src="I{i}">', f'<IMG src="data:{i}">', f'<a title="U{i}" href="/s/y/{i}" x="<img src=in{i}>">', "x" * rng.randrange(0, 2500), "<b>", "<abc>", "<a", "😀", f'<a title="V{i} <a title=W{i}" href="/s/z/{i}">']))
        made.append((n, "https://x.org/s/sub", "".join(parts)))
    want = set()
    for n, _, html in made:
        for m in re.finditer(r"(?i)<a\b[^>]*>", html):
            image = re.search(r"(?i)<img\b[^>]*>", html[m.start() : m.start() + 4000])
            title, src = re.search(r'title="([^"]+)"', m[0]), image and re.search(r"src=[\"']?([^\"'>]+)", image[0])
            if title and src and not src[1].startswith("data:"):
                want.add((n, title[1], f"https://x.org/s/{src[1]}"))
    frame = spark.createDataFrame(made + made[:3], "page_id long, url string, html string").repartition(4)
    got = {(r["page_id"], r["title"], r["preview_image_url"]) for r in X.dom_anchor_cards(frame).collect()}
    assert got == want and len(want) > 200


def test_tags_hold_no_text_around_them(spark):
    anchors = 3000
    frame = spark.createDataFrame([(1, "u", "<a href=x>" * anchors + "y" * 50_000)], "page_id long, url string, html string")
    size = X._tags(frame).agg(F.sum(F.length("tag"))).first()[0]
    assert size == 10 * anchors
