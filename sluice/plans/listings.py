"""Registered queries for the extractors: pages of each layout are written out of `part`, extracted, and compared with SQL over `part`.

A page holds the 20 parts with p_partkey // 20 = page_id. Each layout puts obstacles beside the cards: cards that lack a
part, copies, markup and entities in titles. The SQL takes what must come out from the columns, without any html.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import extract

QUERIES: dict = {}
ORACLES: dict = {}
PER_PAGE = 20


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def filled(template: str) -> Column:
    """The template with {column} replaced by the column's text."""
    pieces = template.replace("{", "\0{").replace("}", "\0").split("\0")
    return F.concat(*(F.col(x[1:]).cast("string") if x.startswith("{") else F.lit(x) for x in pieces if x))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    own = spark.read.parquet(f"{sf_dir}/part.parquet").select(key.alias("k"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    return own.select("*", F.floor(F.col("k") / PER_PAGE).cast("bigint").alias("page_id"), (F.col("k") % PER_PAGE).cast("int").alias("i"), (F.col("k") % PER_PAGE + 1).alias("n"))


def listing(spark: SparkSession, sf_dir: str, card: str | Column, head: str = "", tail: str = "", between: str = "\n", payload: bool = False) -> DataFrame:
    """page_id, url, html, api_payload: a card for each part, in order."""
    body = filled(card) if isinstance(card, str) else card
    cards = parts(spark, sf_dir).groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", body.alias("c")))), lambda x: x["c"]), between).alias("cards"))
    html = F.concat(F.lit(head), "cards", F.lit(tail))
    url = F.concat(F.lit("https://site"), (F.col("page_id") % 7).cast("string"), F.lit(".example/list/?mode=hot"))
    none = F.lit(None).cast("string")
    return cards.select("page_id", url.alias("url"), (none if payload else html).alias("html"), (html if payload else none).alias("api_payload"))


_PARTS = "(SELECT p_partkey AS k, p_name AS name, p_brand AS brand, p_size AS size, p_partkey // 20 AS page_id, (p_partkey % 20)::INT AS i, p_partkey % 20 + 1 AS n, 'https://site' || (p_partkey // 20 % 7) || '.example' AS site FROM part)"
_NONE = "NULL::VARCHAR"


def _rows(title: str, url: str, where: str = "true", pos: str = "i", key: str = _NONE, image: str = _NONE, summary: str = _NONE, snippet: str = _NONE) -> str:
    return f"SELECT page_id, ({pos})::INT AS pos, {title} AS title, {url} AS url, {key} AS dedupe_key, {image} AS preview_image_url, {summary} AS summary, NULL::DOUBLE AS price, {snippet} AS raw_html_snippet FROM {_PARTS} WHERE {where}"


def _numbered(order: str, **more: str) -> str:
    """The same with pos as the place among the page's rows."""
    inner = _rows(pos="0", **more)
    return f"SELECT * REPLACE ((row_number() OVER (PARTITION BY page_id ORDER BY {order}) - 1)::INT AS pos) FROM ({inner})"


@query(_rows("name || ' & ' || brand", "site || '/list/item?id=' || k", snippet="name || ' & ' || brand"))
def titleline_rows(spark, sf_dir):
    card = """<tr class='athing' id='{k}'><td>{n}.</td><td><span class="titleline"><a href="item?id={k}">{name} &amp; <b>{brand}</b></a></span></td></tr><tr class="athing"><td><span class="titleline">\n<a href="item?id={k}">{name}  &amp; {brand} </a></span></td></tr>"""
    return extract.extract("titleline_rows", listing(spark, sf_dir, card)).withColumn("pos", F.floor(F.col("pos") / 2).cast("int"))


@query(_rows("name", "site || '/u/' || k", where="page_id % 2 = 0", snippet="name") + " UNION ALL " + _rows("name || ' h'", "site || '/h/' || k", where="page_id % 2 = 1", snippet="name || ' h'"))
def article_links(spark, sf_dir):
    heading = filled('<h2 class="t"><i></i><a class="c" href="/h/{k}">{name} h</a></h2>')
    both = F.when(F.col("page_id") % 2 == 0, F.concat(filled('<a id="article-link-{k}" class="c" href="/u/{k}"> {name}\n</a>'), heading)).otherwise(heading)
    return extract.extract("article_links", listing(spark, sf_dir, both))


@query(_rows("CASE WHEN k % 3 = 0 THEN name || ' <' ELSE brand END", "site || '/video/' || k || '/'", where="k % 5 <> 4", image="CASE WHEN k % 2 = 0 THEN site || '/list/i/' || k || '.jpg' ELSE 'https://img.example/' || k || '.jpg' END"))
def thumb_cards(spark, sf_dir):
    title = F.when(F.col("k") % 3 == 0, filled(' title="{name} &lt;"')).otherwise(F.lit(""))
    href = F.when(F.col("k") % 5 == 4, filled("/album/{k}/")).otherwise(filled("/video/{k}/"))
    image = F.when(F.col("k") % 2 == 0, filled('<img src="data:image/gif" data-original="i/{k}.jpg">')).otherwise(filled('<img data-original="data:x"><img src="https://img.example/{k}.jpg">'))
    card = F.concat(F.lit('<div class="thumb thumb_rel item  "><a href="'), href, F.lit('"'), title, F.lit(">"), image, filled('<div class="title">{brand}</div></a></div>'))
    return extract.extract("thumb_cards", listing(spark, sf_dir, card))


@query(_rows("name", "CASE WHEN k % 4 = 0 THEN site || '/v/p' || k ELSE site || '/v/' || k END", where="k % 6 <> 5", image="site || '/i/' || k"))
def poster_cards(spark, sf_dir):
    href = F.when(F.col("k") % 6 == 5, filled("/w/{k}")).when(F.col("k") % 4 == 0, F.lit("  ")).otherwise(filled(" /v/{k} "))
    card = F.concat(filled('<div class="item"><div><a href="/v/p{k}" class="poster"><img alt="" src=" /i/{k} "></a></div><div><a href="'), href, filled('" class="title"><b>{name}</b></a></div></div>'))
    return extract.extract("poster_cards", listing(spark, sf_dir, card))


@query(_numbered("CASE WHEN summary LIKE '일간%' THEN 0 ELSE 1 END, k", title="name || ' +' || size", url="site || '/p?a=1&b=' || k", where="i % 3 <> 2", summary="CASE WHEN i % 3 = 0 THEN '일간 베스트 · 댓글 +' ELSE '주간 베스트 · 댓글 +' END || size").replace("NULL::DOUBLE AS price", "NULL::DOUBLE AS price, k", 1).replace("SELECT * REPLACE", "SELECT * EXCLUDE (k) REPLACE", 1))
def sectioned_list(spark, sf_dir):
    row = filled('<li class="post-row"><i></i><a href="/p?a=1&amp;b={k}">+{n} {name}<span class="count ">+{size}</span></a></li>')
    section = lambda r, label: F.concat(F.lit(f'<div class="board-hot-title"><b>{label}</b></div> <div class="miso-post-list"><p></p><ul class="post-list">'), F.array_join(F.transform(F.filter("rows", lambda x: x["i"] % 3 == r), lambda x: x["c"]), ""), F.lit("</ul></div>"))
    pages = listing(spark, sf_dir, "{k}").select("page_id", "url").join(parts(spark, sf_dir).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("i", row.alias("c")))).alias("rows")), "page_id")
    return extract.extract("sectioned_list", pages.select("page_id", "url", F.concat(section(0, "오늘의 베스트"), section(2, "다른 글"), section(1, "주간 베스트")).alias("html")))


@query(_rows("name", "site || '/t/' || k", where="k % 7 <> 6", summary="n || '위' || CASE WHEN k % 2 = 0 THEN ' · 12.' || size ELSE '' END"))
def ranked_rows(spark, sf_dir):
    date = F.when(F.col("k") % 2 == 0, filled("<li> 12.{size} </li>")).otherwise(filled("<li><i>{size}</i></li>"))
    href = F.when(F.col("k") % 7 == 6, F.lit(" ")).otherwise(filled("/t/{k}"))
    card = F.concat(filled('<ul class="td ufl"><li>{n}</li><li><b>x</b></li><li class="tit a"> <a href="'), href, filled('">{name}</a> </li>'), date, F.lit("</ul>"))
    return extract.extract("ranked_rows", listing(spark, sf_dir, card))


_STATUS = "'https://x.com/i/status/' || (1000 + k)"
_VIDEO = "'https://video.twimg.com/amplify_video/' || k || '/vid/a.mp4?tag=14'"
_POSTER = "'https://pbs.twimg.com/amplify_video_thumb/' || k || '/img/a.jpg'"


@query(_numbered("CASE WHEN k % 20 = 0 THEN 1 ELSE n END", title="CASE WHEN i = 0 THEN 0 ELSE n END || '위 - ' || " + _STATUS, url=_VIDEO, key="'twidouga:video-id:' || k", image=_POSTER, summary=_STATUS).replace("NULL::DOUBLE AS price", "NULL::DOUBLE AS price, k, n", 1).replace("SELECT * REPLACE", "SELECT * EXCLUDE (k, n) REPLACE", 1))
def ranked_anchors(spark, sf_dir):
    rank = F.when(F.col("i") == 0, F.lit("0")).otherwise(F.col("n").cast("string"))
    image = filled('<img alt="" src="https://pbs.twimg.com/amplify_video_thumb/{k}/img/a.jpg">')
    post = F.concat(F.lit('<a href="https://x.com/user/status/'), (F.col("k") + 1000).cast("string"), F.lit('?s=20">post</a>'))
    video = filled('<a class="v" href="https://video.twimg.com/amplify_video/{k}/vid/a.mp4?tag=14"> 動画URL </a>')
    card = F.concat(filled('<img src="/img/rank{n}.png"> '), rank, F.lit("위\r\n"), image, post, video, F.when(F.col("k") % 4 == 0, video).otherwise(F.lit("")))
    return extract.extract("ranked_anchors", listing(spark, sf_dir, card, head='<img src="rank.png">'))


@query(_numbered("n", title="n || '위 - ' || CASE WHEN k % 3 = 0 THEN " + _STATUS + " ELSE name END", url=_VIDEO, where="k % 5 <> 4", key="'xranking:video-id:' || k", image=_POSTER, summary=_STATUS, snippet="CASE WHEN k % 2 = 0 THEN '조회수 ' || size END").replace("NULL::DOUBLE AS price", "NULL::DOUBLE AS price, n", 1).replace("SELECT * REPLACE", "SELECT * EXCLUDE (n) REPLACE", 1))
def ranked_articles(spark, sf_dir):
    badge = filled('<article class="a"><div class="b absolute top-3 left-3 c"> {n} </div>')
    other = filled('<article><div class="absolute top-3 left-3">99</div>')
    video = F.when(F.col("k") % 5 == 4, F.lit("<video></video>")).otherwise(filled('<video controls src=" https://video.twimg.com/amplify_video/{k}/vid/a.mp4?tag=14" poster="https://pbs.twimg.com/amplify_video_thumb/{k}/img/a.jpg"></video>'))
    label = F.when(F.col("k") % 3 == 0, F.lit("<i></i>")).otherwise(filled("{name}"))
    post = F.concat(F.lit('<a href="https://x.com/i/status/'), (F.col("k") + 1000).cast("string"), F.lit('?a=1&amp;b=2">'), label, F.lit("</a>"))
    views = F.when(F.col("k") % 2 == 0, filled('<i class="lucide-eye"></i><span> {size} </span>')).otherwise(filled('<i class="lucide-eye"></i><span>1,{size}</span>'))
    end = F.lit("</article>")
    return extract.extract("ranked_articles", listing(spark, sf_dir, F.concat(other, video, post, views, end, badge, video, post, views, end)))


def _api_pages(spark, sf_dir):
    ident = F.when(F.col("k") % 2 == 0, filled('"video_id":" v{k} ","id":7')).otherwise(filled('"video_id":null,"id":{k}'))
    title = F.when(F.col("k") % 3 == 0, filled('"title":"<b>{name}</b>"')).otherwise(F.lit('"title":" "'))
    uploader = F.when(F.col("k") % 3 == 1, filled('{"display_name":"{brand}"}'.replace('{"', "\x01").replace('"}', "\x02"))).otherwise(F.lit("null"))
    uploader = F.replace(F.replace(uploader, F.lit("\x01"), F.lit('{"')), F.lit("\x02"), F.lit('"}'))
    views = F.when(F.col("k") % 4 == 0, filled('"play_count":"{size}"')).otherwise(filled('"play_count":{size}'))
    direct = F.when(F.col("k") % 5 == 4, F.lit('"direct_url":null')).otherwise(filled('"direct_url":"https://video.twimg.com/amplify_video/{k}/vid/a.mp4?tag=14"'))
    posts = F.concat(F.lit('"posts":[{"id":"x","uploader":'), uploader, F.lit('},{"id":'), (F.col("k") + 1000).cast("string"), F.lit("}]"))
    thumb = filled('"ranking":"{n}x","thumbnail_url":" https://pbs.twimg.com/amplify_video_thumb/{k}/img/a.jpg"')
    comma = F.lit(",")
    card = F.concat(F.lit("{"), ident, comma, title, comma, direct, comma, thumb, comma, views, comma, posts, F.lit("}"))
    return listing(spark, sf_dir, card, head=' {"success":true,"data":[', tail="]}", between=",", payload=True)


@query(_numbered("n", title="n || '위 - ' || CASE k % 3 WHEN 0 THEN name WHEN 1 THEN brand || '님의 동영상' ELSE " + _STATUS + " END", url=_VIDEO, where="k % 5 <> 4", key="'nimi:video-id:' || CASE WHEN k % 2 = 0 THEN 'v' ELSE '' END || k", image=_POSTER, summary=_STATUS, snippet="CASE WHEN k % 4 <> 0 THEN '조회수 ' || size END").replace("NULL::DOUBLE AS price", "NULL::DOUBLE AS price, n", 1).replace("SELECT * REPLACE", "SELECT * EXCLUDE (n) REPLACE", 1))
def json_ranking(spark, sf_dir):
    return extract.extract("json_ranking", _api_pages(spark, sf_dir))


def _image_pages(spark, sf_dir):
    post = F.concat(filled("<div>x</div><div>{n}위</div>"), F.lit('<a href="https://x.com/i/status/'), (F.col("k") + 1000).cast("string"), F.lit('">'))
    alt = F.when(F.col("k") % 3 == 0, filled("{name}")).otherwise(F.lit(""))
    image = F.concat(filled('<img class="c" src="https://pbs.twimg.com/amplify_video_thumb/{k}/img/a.jpg" alt="'), alt, F.lit('"></a>'))
    video = F.when(F.col("page_id") % 2 == 0, filled('<script>"https://video.twimg.com/amplify_video/{k}/vid/a.mp4\\"</script>')).otherwise(F.lit(""))
    views = F.when(F.col("k") % 3 == 0, filled("<p>조회수 1,{size}</p>")).when(F.col("k") % 3 == 1, filled('<i class="lucide-eye"></i><span class="x"> {size} </span>')).otherwise(F.lit("<p></p>"))
    return listing(spark, sf_dir, F.concat(post, image, video, views))


@query(_numbered("n", title="n || '위 - ' || CASE WHEN k % 3 = 0 THEN name ELSE " + _STATUS + " END", url="CASE WHEN page_id % 2 = 0 THEN 'https://video.twimg.com/amplify_video/' || k || '/vid/a.mp4' ELSE " + _POSTER + " END", key="'nimi:' || CASE WHEN page_id % 2 = 0 THEN 'video' ELSE 'preview' END || '-id:' || k", image=_POSTER, summary=_STATUS, snippet="CASE k % 3 WHEN 0 THEN '조회수 1' || size WHEN 1 THEN '조회수 ' || size END").replace("NULL::DOUBLE AS price", "NULL::DOUBLE AS price, n", 1).replace("SELECT * REPLACE", "SELECT * EXCLUDE (n) REPLACE", 1))
def image_chunk_ranking(spark, sf_dir):
    return extract.extract("image_chunk_ranking", _image_pages(spark, sf_dir))


def _packed_pages(spark, sf_dir):
    record = '~"id":~"__t":"u","v":"a{k}"^,"title":"{name} \\"{brand}","x":1,"preview":"https://img.example/{k}.jpg"^'
    double = F.replace(F.replace(filled(record), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    single = F.replace(F.replace(filled(record), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    half = F.floor(F.length(single) / 2).cast("int")
    wrap = lambda q, x: F.concat(F.lit(f"<script>self.__next_f.push([1, {q}"), x, F.lit(f"{q},]);</script>"))
    split = F.concat(wrap("'", F.substring(single, F.lit(1), half - F.when(F.substring(single, half, F.lit(1)) == "\\", 1).otherwise(0))), wrap("'", F.substring(single, half + 1 - F.when(F.substring(single, half, F.lit(1)) == "\\", 1).otherwise(0), F.lit(10_000))))
    card = F.when(F.col("k") % 2 == 0, wrap('"', double)).otherwise(split)
    card = F.translate(card, "~^", "{}")
    return listing(spark, sf_dir, card)


@query(_rows("name || ' \\\"' || brand", "site || '/s/pornvideo/a' || k || '?mode=hot'", image="'https://img.example/' || k || '.jpg'"))
def packed_payload(spark, sf_dir):
    return extract.extract("packed_payload", _packed_pages(spark, sf_dir))


def _anchor_pages(spark, sf_dir):
    mode = F.when(F.col("k") % 2 == 0, F.lit("&amp;mode=new")).otherwise(F.lit(""))
    href = F.when(F.col("k") % 5 == 4, filled("/t/x/y{k}")).otherwise(F.concat(filled("/s/x/y{k}/more?p=1"), mode))
    near = F.when(F.col("k") % 3 == 0, filled("<img src='/i/{k}' alt='other'>")).when(F.col("k") % 3 == 1, filled('<img src=https://img.example/{k} alt="">')).otherwise(filled('<img src="data:x">' + "<p>" * 1500 + '<img src="/late/{k}" alt="{name} {k}">'))
    return listing(spark, sf_dir, F.concat(filled('<a data-x="1" title="{name} {k}" href="'), href, F.lit('">'), near, F.lit("</a>")))


@query(_rows("name || ' ' || k", "site || '/s/x/y' || k || CASE WHEN k % 2 = 0 THEN '?mode=new' ELSE '?mode=hot' END", where="k % 5 <> 4", image="CASE WHEN k % 3 = 0 THEN site || '/i/' || k WHEN k % 3 = 1 THEN 'https://img.example/' || k ELSE site || '/late/' || k END"))
def dom_anchor_cards(spark, sf_dir):
    return extract.extract("dom_anchor_cards", _anchor_pages(spark, sf_dir))


def _half(odd: int, frame: DataFrame) -> DataFrame:
    return frame.filter(F.col("page_id") % 2 == odd)


@query(f"SELECT * FROM ({ORACLES['json_ranking']}) WHERE page_id % 2 = 0 AND page_id % 10 <> 0 UNION ALL SELECT * FROM ({ORACLES['image_chunk_ranking']}) WHERE page_id % 2 = 1")
def api_or_images(spark, sf_dir):
    """Payloads; images where the payload is no array; and, of pages with images, those with an empty array, which give nothing."""
    broken = F.when(F.col("page_id") % 4 == 1, F.lit('{"data":5}')).otherwise(F.lit("nope"))
    images = _image_pages(spark, sf_dir)
    empty = images.filter("page_id % 10 = 0").withColumn("api_payload", F.when(F.col("page_id") % 20 == 0, "[]").otherwise('{"data":[]}'))
    both = _half(0, _api_pages(spark, sf_dir)).filter("page_id % 10 <> 0").unionByName(_half(1, images).withColumn("api_payload", broken)).unionByName(empty)
    return extract.extract("api_or_images", both)


@query(f"SELECT * FROM ({ORACLES['packed_payload']}) WHERE page_id % 2 = 0 UNION ALL SELECT * FROM ({ORACLES['dom_anchor_cards']}) WHERE page_id % 2 = 1")
def payload_or_anchors(spark, sf_dir):
    return extract.extract("payload_or_anchors", _half(0, _packed_pages(spark, sf_dir)).unionByName(_half(1, _anchor_pages(spark, sf_dir))))
