"""Table extractors: one page to many rows (page_id, pos, title, url, dedupe_key, preview_image_url, summary, price, raw_html_snippet).

Each takes pages(page_id, url, html[, api_payload]) and keeps page order in pos. Lazy gaps between the
parts of a record are not bounded by the record, so a record without a part takes it from the next.
Page rows are told apart by these columns: different rows that share a page_id, or have none, are pages of their own, and equal rows are one page. Pages without
html give no rows; an empty table gives none. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import ids, text, urls
from sluice.operators.dedupe import keep_best, keep_first, link_key

#: Characters from the start of a card's anchor in which its preview is sought.
LOOK_AHEAD = 4000
#: Hosts and paths of the served pages, and what identifies a video, a preview and a post.
VIDEO_LINK, IMAGE_LINK, POST_LINK = r"https?://video\.twimg\.com/", r"https?://pbs\.twimg\.com/", r"https?://x\.com/"
VIDEO_PATH, PREVIEW_PATH = r"(?i)/(?:amplify_video|ext_tw_video)/(\d+)/", r"(?i)/(?:amplify_video_thumb|ext_tw_video_thumb)/(\d+)/"
POST_PREFIX = "https://x.com/i/status/"
VIDEO_LABELS = r"(?:동영상\s*URL|動画\s*URL|Video\s*URL)"
#: Section labels, the section taken where a URL names none, and the end of a title made of a name.
SECTIONS = {"오늘의 베스트": "일간 베스트", "주간 베스트": "주간 베스트"}
DEFAULT_SECTION = "pornvideo"
NAME_SUFFIX = "님의 동영상"
#: The markup of the served pages and script payloads, a pattern for each thing that is read.
TITLELINE = r"""<tr class=["']athing["'][\s\S]*?<span class=["']titleline["'][^>]*>\s*<a[^>]*href=["']([^"']+)["'][^>]*>([\s\S]*?)</a>"""
ARTICLE_LINK = r"""<a[^>]*id=["']article-link-[^"']+["'][^>]*href=["']([^"']+)["'][^>]*>([\s\S]*?)</a>"""
HEADING_LINK = r"""<h2[^>]*>[\s\S]*?<a[^>]*href=["']([^"']+)["'][^>]*>([\s\S]*?)</a>[\s\S]*?</h2>"""
THUMB = r'(?i)<div class="thumb\s+thumb_rel\s+item[^"]*"[\s\S]*?<a\s+([^>]*?)>([\s\S]*?)</a>[\s\S]*?</div>'
THUMB_TITLE = r'(?i)<div class="title"[^>]*>([\s\S]*?)</div>'
THUMB_IMAGE = r"""(?i)<img[^>]+(?:data-original|src)=["']([^"']+)["'][^>]*>"""
POSTER = r'(?i)<div class="item">[\s\S]*?<a href="([^"]+)" class="poster">[\s\S]*?<img[^>]+src="([^"]+)"[^>]*>[\s\S]*?<a href="([^"]+)" class="title">([\s\S]*?)</a>[\s\S]*?</div>\s*</div>'
SECTION = r'(?i)<div class="board-hot-title">([\s\S]*?)</div>\s*<div class="miso-post-list">[\s\S]*?<ul class="post-list">([\s\S]*?)</ul>'
SECTION_ROW = r'(?i)<li class="post-row">[\s\S]*?<a href="([^"]+)"[^>]*>([\s\S]*?)</a>\s*</li>'
SECTION_COUNT = r'(?i)<span class="count[^"]*">\s*\+?(\d+)\s*</span>'
RANKED_ROW = r'(?i)<ul class="td ufl">([\s\S]*?)</ul>'
RANKED_CELL = r"(?i)<li>\s*([^<]+?)\s*</li>"
RANKED_LINK = r'(?i)<li class="tit[^"]*">\s*<a href="([^"]+)">([\s\S]*?)</a>\s*</li>'
RANK_IMAGE = r"""(?i)(?=<img\s+[^>]*src=["'][^"']*rank\d+\.png["'][^>]*>\s*\d+\s*위)"""
RANK_VALUE = r"""(?i)^<img\s+[^>]*src=["'][^"']*rank\d+\.png["'][^>]*>\s*(\d+)\s*위"""
VIDEO_ANCHOR = rf"""(?i)<a\s+[^>]*href=["']({VIDEO_LINK}[^"']+)["'][^>]*>\s*{VIDEO_LABELS}\s*</a\s*>"""
ANY_POST = rf"""(?i)href=["']({POST_LINK}[^"']+)["']"""
SHOT = rf"""(?i)<img\s+[^>]*src=["']({IMAGE_LINK}[^"']+)["'][^>]*>"""
ARTICLE = r"(?i)<article\b[\s\S]*?</article>"
BADGE = r"""(?i)<div[^>]*class=["'][^"']*absolute\s+top-3\s+left-3[^"']*["'][^>]*>\s*(\d+)\s*</div>"""
POST_ANCHOR = rf"""(?i)<a[^>]*href=["']({POST_LINK}(?:[^"'/]+/status/\d+|i/status/\d+)[^"']*)["'][^>]*>([\s\S]*?)</a>"""
ARTICLE_VIEWS = r"(?i)lucide-eye[\s\S]*?<span>\s*(\d+)\s*</span>"
CARD_IMAGE = rf"""(?i)<img\b(?=[^>]*src=["']{IMAGE_LINK}[^"']+["'])(?=[^>]*alt=["'][^"']*["'])[^>]*>"""
CARD_RANK = r"(?i)>(\d{1,3})(?:\s*위)?\s*</(?:div|span|strong|p|b)>"
CARD_SOURCE = rf"""(?i)\bsrc=["']({IMAGE_LINK}[^"']+)["']"""
_TEXT = r'((?:[^"\\]|\\.)*+)'
_PUSH = r"""self\.__next_f\.push\(\[\s*1\s*,\s*(?:'((?:[^'\\]|\\[\s\S])*+)'|"((?:[^"\\]|\\[\s\S])*+)")\s*,?\s*\]\)"""
RECORD = rf'"id":\{{"__t":"u","v":"([^"]+)"\}},"title":"{_TEXT}"[\s\S]*?"preview":"{_TEXT}"'
#: Where a card shows its views, the first that matches counts.
VIEWS = (r"(?i)조회수\s*([\d,]+)", r"(?i)lucide-eye[\s\S]{0,200}?<span[^>]*>\s*([\d,]+)\s*</span>", r"(?i)<svg[^>]*[\s\S]{0,200}?<span[^>]*>\s*([\d,]+)\s*</span>")
COLUMNS = ("page_id", "pos", "title", "url", "dedupe_key", "preview_image_url", "summary", "price", "raw_html_snippet")


def found(pages: DataFrame, pattern: str, source: str = "html", **groups: int) -> DataFrame:
    """A row for each match, with the named groups."""
    rows = pages.select(*pages.columns, F.posexplode(F.regexp_extract_all(F.col(source), F.lit(pattern), F.lit(0))).alias("pos", "_match"))
    return rows.select(*pages.columns, "pos", "_match", *(F.regexp_extract("_match", pattern, g).alias(n) for n, g in groups.items()))


def shaped(rows: DataFrame) -> DataFrame:
    have = set(rows.columns)
    kinds = {"price": "double", "pos": "int"}
    return rows.select(*(F.col(c) if c in have else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS))


def by_row(extractor: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The extractor with a page_id of its own for each different page row while it runs."""

    @wraps(extractor)
    def run(pages: DataFrame, *args, **more) -> DataFrame:
        own = [c for c in ("url", "html", "api_payload") if c in pages.columns]
        told = pages.select(F.struct(F.col("page_id").alias("id"), F.xxhash64(*own).alias("row")).alias("page_id"), *own)
        return extractor(told, *args, **more).withColumn("page_id", F.col("page_id.id"))

    return run


def firsts(rows: DataFrame) -> DataFrame:
    """Rows with title and URL, the first of each within its page."""
    return shaped(keep_first(rows.filter("title <> '' AND url <> ''"), ["page_id"], link_key()))


def resolved(raw: Column | str, base: str = "url") -> Column:
    return urls.resolved_url(text.decode_entities(text.trim_ws(raw)), F.col(base))


def _links(pages: DataFrame, pattern: str) -> DataFrame:
    rows = found(pages, pattern, href=1, label=2)
    return rows.filter(text.trim_ws("href") != "").select("page_id", "pos", text.clean_text("label").alias("title"), resolved("href").alias("url"))


@by_row
def list_links(pages: DataFrame) -> DataFrame:
    """Anchors that stand alone in list items."""
    return firsts(_links(pages, r'(?i)<li><a\s+href="([^"]*)"[^>]*>([\s\S]*?)</a>'))


def addressed(raw: Column | str, base: str = "url") -> Column:
    """The address as it stands, entities and all, against its page."""
    return urls.resolved_url(text.trim_ws(raw), F.col(base))


def _titled(pages: DataFrame, pattern: str) -> DataFrame:
    """Matches with address and label; the label is also the snippet."""
    rows = found(pages, pattern, href=1, label=2)
    title = text.clean_text("label")
    return firsts(rows.select("page_id", "pos", title.alias("title"), addressed("href").alias("url"), title.alias("raw_html_snippet")))


@by_row
def titleline_rows(pages: DataFrame) -> DataFrame:
    return _titled(pages, TITLELINE)


@by_row
def article_links(pages: DataFrame) -> DataFrame:
    """Anchors with an article-link id; headline anchors on pages that have none."""
    first = _titled(pages, ARTICLE_LINK)
    other = _titled(pages, HEADING_LINK)
    return fallback_union(first, other)


def fallback_union(primary: DataFrame, fallback: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """The primary rows, and the fallback's of pages that have none (or are not among `done`)."""
    pages = (primary if done is None else done).select("page_id").distinct()
    return primary.unionByName(fallback.join(pages, "page_id", "left_anti").select(*primary.columns))


@by_row
def thumb_cards(pages: DataFrame) -> DataFrame:
    """Cards of a linked image: titled by attribute, else by the inner title; the first image that is no data: address."""
    rows = found(pages, THUMB, tag=1, inner=2)
    href, title = text.attribute_anywhere("tag", "href"), text.blank_to_null(text.attribute_anywhere("tag", "title"))
    label = F.coalesce(title, F.regexp_extract("inner", THUMB_TITLE, 1))
    images = F.transform(F.regexp_extract_all("inner", F.lit(THUMB_IMAGE), F.lit(1)), text.trim_ws)
    image = F.get(F.filter(images, lambda x: (x != "") & ~x.startswith("data:")), F.lit(0))
    rows = rows.filter(F.contains(href, F.lit("/video/")))
    return firsts(rows.select("page_id", "pos", text.clean_text(label).alias("title"), addressed(href).alias("url"), urls.resolved_url(image, F.col("url")).alias("preview_image_url")))


@by_row
def poster_cards(pages: DataFrame) -> DataFrame:
    pattern = POSTER
    rows = found(pages, pattern, poster=1, image=2, href=3, label=4)
    href = F.coalesce(F.nullif(text.trim_ws("href"), F.lit("")), text.trim_ws("poster"))
    return firsts(rows.filter(F.contains(href, F.lit("/v/"))).select("page_id", "pos", text.clean_text("label").alias("title"), addressed(href).alias("url"), addressed("image").alias("preview_image_url")))


@by_row
def sectioned_list(pages: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """Rows of sections whose label is known; the summary is the label and the number of comments."""
    sections = found(pages, SECTION, label=1, body=2)
    sections = sections.withColumn("section", text.section_label("label", labels or SECTIONS)).filter("section IS NOT NULL").withColumnRenamed("pos", "section_pos").drop("_match", "label")
    rows = found(sections, SECTION_ROW, "body", href=1, inner=2)
    comments = F.concat(F.lit("댓글 +"), text.first_match(SECTION_COUNT, "inner"))
    rows = rows.filter(text.trim_ws("href") != "").select("page_id", "section_pos", "pos", text.without_badge("inner").alias("title"), resolved("href").alias("url"), F.concat_ws(" · ", "section", comments).alias("summary"))
    order = Window.partitionBy("page_id").orderBy("section_pos", "pos")
    return firsts(rows.withColumn("pos", F.dense_rank().over(order) - 1))


@by_row
def ranked_rows(pages: DataFrame) -> DataFrame:
    """Lists of cells: the title link, and the plain cells rank and date as 'N위 · date'."""
    rows = found(pages, RANKED_ROW, body=1)
    cells = F.transform(F.regexp_extract_all("body", F.lit(RANKED_CELL), F.lit(1)), text.clean_text)
    link = RANKED_LINK
    rank, date = (text.blank_to_null(F.get(cells, F.lit(i))) for i in (0, 1))
    summary = F.concat_ws(" · ", F.concat(rank, F.lit("위")), date)
    rows = rows.withColumn("href", text.trim_ws(F.regexp_extract("body", link, 1))).filter("href <> ''")
    return firsts(rows.select("page_id", "pos", text.clean_text(F.regexp_extract("body", link, 2)).alias("title"), addressed("href").alias("url"), summary.alias("summary")))


def _best(rows: DataFrame) -> DataFrame:
    """One row for each dedupe key of a page, the best rank's, in the order of ranks."""
    kept = keep_best(rows.filter("title <> '' AND url <> ''"), ["page_id"], F.col("dedupe_key"))
    order = Window.partitionBy("page_id").orderBy("rank_order", "first_pos")
    return shaped(kept.withColumn("pos", F.row_number().over(order) - 1))


@by_row
def ranked_anchors(pages: DataFrame, namespace: str = "twidouga") -> DataFrame:
    """Video anchors with the last rank marker before them (the first where none is), and that segment's post and preview.

    A rank of 0 stays in the title and orders as the entry's place.
    """
    marker = RANK_IMAGE
    html = F.replace("html", F.lit("\r\n"), F.lit("\n"))
    parts = F.transform(F.split(html, marker, -1), lambda x: F.struct(x.alias("part"), F.regexp_extract(x, RANK_VALUE, 1).try_cast("bigint").alias("rank")))

    def following(all: Column) -> Column:
        """Each part with the part and rank that it takes: the next one's where it has no rank itself."""
        own = lambda x, i: F.when(x["rank"].isNull() & (i + 1 < F.size(all)), F.get(all, i + 1)).otherwise(x)
        return F.transform(all, lambda x, i: F.struct(x["part"].alias("part"), own(x, i)["part"].alias("context"), own(x, i)["rank"].alias("rank")))

    segments = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode(urls.let(parts, following)).alias("seg", "x")).select("page_id", "page_url", "seg", "x.*")
    rows = found(segments, VIDEO_ANCHOR, "part", href=1)
    order = Window.partitionBy("page_id").orderBy("seg", "pos")
    rows = rows.withColumn("entry", F.dense_rank().over(order).cast("bigint")).withColumn("pos", F.col("entry") - 1)
    status = ids.status_url(text.first_match(ANY_POST, "context"), POST_PREFIX)
    image = text.first_match(SHOT, "context")
    rows = rows.withColumn("status", status).withColumn("url", addressed("href", "page_url"))
    shown = F.coalesce("rank", "entry")
    return _best(rows.select("page_id", "pos", F.when(shown > 0, shown).otherwise(F.col("entry")).alias("rank_order"), ids.ranked_title(shown, F.col("status"), F.col("url")).alias("title"), "url", ids.video_key(namespace, "url", VIDEO_PATH).alias("dedupe_key"), F.col("status").alias("summary"), addressed(image, "page_url").alias("preview_image_url")))


@by_row
def ranked_articles(pages: DataFrame, namespace: str = "xranking") -> DataFrame:
    """Articles with a video: badge rank (0 counts) or place, post and its text, poster; the snippet is the view count."""
    rows = found(pages, ARTICLE)
    of = lambda name: text.trim_ws(F.regexp_extract("_match", rf"""(?i)<video\b[^>]*\b{name}=["']([^"']+)["'][^>]*>""", 1))
    rows = rows.withColumn("source", of("src")).filter("source <> ''")
    rows = rows.withColumn("entry", F.dense_rank().over(Window.partitionBy("page_id").orderBy("pos")))
    badge = text.first_match(BADGE, "_match")
    rank = F.coalesce(badge.try_cast("bigint"), F.col("entry").cast("bigint"))
    anchor = POST_ANCHOR
    status = ids.status_url(text.blank_to_null(text.decode_entities(F.regexp_extract("_match", anchor, 1))), POST_PREFIX)
    views = F.concat(F.lit("조회수 "), text.first_match(ARTICLE_VIEWS, "_match"))
    rows = rows.withColumn("rank_order", rank).withColumn("status", status).withColumn("video", resolved("source"))
    card = text.optional_text(F.regexp_extract("_match", anchor, 2))
    key = ids.video_key(namespace, "video", VIDEO_PATH)
    poster = resolved(text.blank_to_null(of("poster")))
    return _best(rows.select("page_id", "pos", "rank_order", ids.ranked_title("rank_order", card, F.col("status"), F.col("video")).alias("title"), F.col("video").alias("url"), key.alias("dedupe_key"), poster.alias("preview_image_url"), F.col("status").alias("summary"), views.alias("raw_html_snippet")))


def _payload_rows(pages: DataFrame) -> DataFrame:
    """The pages with their payload's array, bare or under data, as variant _v; null where there is none."""
    parsed = F.try_parse_json(F.when(text.trim_ws("api_payload").rlike(r"^[{\[]"), F.col("api_payload")))
    is_array = lambda v: F.schema_of_variant(v).startswith("ARRAY")
    inner = F.try_variant_get("_v", "$.data", "variant")
    return pages.withColumn("_v", parsed).withColumn("_v", F.when(is_array("_v"), F.col("_v")).when(is_array(inner), inner))


@by_row
def json_ranking(pages: DataFrame, namespace: str = "nimi", suffix: str = NAME_SUFFIX) -> DataFrame:
    """Rows of an API array, bare or under data; ids may be numbers or texts. The snippet is the view count."""
    root = _payload_rows(pages).filter("_v IS NOT NULL")
    each = root.select("page_id", F.col("url").alias("page_url"), F.posexplode(F.try_variant_get("_v", "$", "array<variant>")).alias("pos", "v"))
    get = lambda path: F.try_variant_get("v", path, "string")
    rows = each.withColumn("direct", text.trim_ws(get("$.direct_url"))).filter("direct <> ''").withColumn("direct", addressed("direct", "page_url"))
    rows = rows.withColumn("entry", F.dense_rank().over(Window.partitionBy("page_id").orderBy("pos")).cast("bigint"))
    posts = F.transform(F.coalesce(F.try_variant_get("v", "$.posts", "array<variant>"), F.array().cast("array<variant>")), lambda p: F.try_variant_get(p, "$.id", "string"))
    status = F.concat(F.lit(POST_PREFIX), ids.first_digits_id(posts))
    by = lambda field: F.concat(text.optional_text(get(f"$.posts[0].uploader.{field}")), F.lit(suffix))
    name = F.coalesce(text.optional_text(get("$.title")), by("display_name"), by("handle"))
    thumb = addressed(text.blank_to_null(text.trim_ws(get("$.thumbnail_url"))), "page_url")
    rows = rows.withColumn("rank_order", text.rank_or(get("$.ranking"), "entry")).withColumn("status", status).withColumn("thumb", thumb)
    key = ids.ranked_key(namespace, ids.explicit_id(get("$.video_id"), get("$.id")), "direct", "thumb", "status", VIDEO_PATH, PREVIEW_PATH)
    return _best(rows.select("page_id", "pos", "rank_order", ids.ranked_title("rank_order", text.optional_text(name), F.col("status"), F.col("direct")).alias("title"), F.col("direct").alias("url"), key.alias("dedupe_key"), F.col("thumb").alias("preview_image_url"), F.col("status").alias("summary"), text.views_snippet(F.try_variant_get("v", "$.play_count", "variant")).alias("raw_html_snippet")))


def shown_views(c: Column | str) -> Column:
    """'조회수 n' without thousands separators."""
    return F.concat(F.lit("조회수 "), F.replace(F.coalesce(*(text.first_match(x, c) for x in VIEWS)), F.lit(","), F.lit("")))


@by_row
def image_chunk_ranking(pages: DataFrame, namespace: str = "nimi", compat_s_class: bool = True) -> DataFrame:
    """Each card image owns the text between its neighbours: rank before it, video and views after it.

    Addresses in script literals end at the letter s, a backslash, a quote or <, as the class that they are read with says;
    compat_s_class=False ends them at white space instead of the letter.
    """
    stop = r"""[^"'\\<s]""" if compat_s_class else r"""[^"'\\<\s]"""
    image = CARD_IMAGE
    pieces = F.split("html", image, -1)
    tags = F.regexp_extract_all("html", F.lit(image), F.lit(0))
    chunk = F.transform(tags, lambda t, i: F.struct(t.alias("tag"), F.get(pieces, i).alias("before"), F.concat(t, F.get(pieces, i + 1)).alias("after")))
    rows = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode(chunk).alias("pos", "c")).select("page_id", "page_url", "pos", "c.*")
    rows = rows.withColumn("entry", (F.col("pos") + 1).cast("bigint"))
    ranks = F.filter(F.transform(F.regexp_extract_all("before", F.lit(CARD_RANK), F.lit(1)), lambda x: x.cast("bigint")), lambda x: x > 0)
    rank = F.coalesce(F.try_element_at(ranks, F.lit(-1)), F.col("entry"))
    movie_at, status_at = rf"(?i)({VIDEO_LINK}{stop}+)", rf"""(?i)({POST_LINK}(?:[^"'/]+/status/\d+|i/status/\d+){stop}*)"""
    movie = resolved(F.coalesce(text.first_match(movie_at, "after"), text.first_match(movie_at, "before")), "page_url")
    status = ids.status_url(F.coalesce(text.first_match(status_at, "before"), text.first_match(status_at, "after")), POST_PREFIX)
    thumb = resolved(text.first_match(CARD_SOURCE, "tag"), "page_url")
    rows = rows.withColumn("rank_order", rank).withColumn("movie", movie).withColumn("status", status).withColumn("thumb", thumb)
    rows = rows.withColumn("target", F.coalesce("movie", "thumb"))
    alt = text.optional_text(text.clean_text(text.decode_entities(text.attribute_anywhere("tag", "alt"))))
    key = ids.ranked_key(namespace, F.lit(None).cast("string"), "target", "thumb", "status", VIDEO_PATH, PREVIEW_PATH)
    return _best(rows.select("page_id", "pos", "rank_order", ids.ranked_title("rank_order", alt, F.col("status"), F.col("thumb")).alias("title"), F.col("target").alias("url"), key.alias("dedupe_key"), F.col("thumb").alias("preview_image_url"), F.col("status").alias("summary"), shown_views("after").alias("raw_html_snippet")))


@by_row
def api_or_images(pages: DataFrame, **more) -> DataFrame:
    """The API's rows; the images' only on pages whose payload is no array at all, so an empty array gives no rows."""
    valid = _payload_rows(pages)
    return json_ranking(valid.filter("_v IS NOT NULL").drop("_v"), **more).unionByName(image_chunk_ranking(valid.filter("_v IS NULL").drop("_v"), **more))


@by_row
def packed_payload(pages: DataFrame) -> DataFrame:
    """Records out of script chunks, decoded and joined in order; out of the page itself where no chunk is."""
    chunks = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(_PUSH), F.lit(0))).alias("n", "c"))
    chunks = chunks.withColumn("t", text.script_text(F.coalesce(text.first_match(_PUSH, "c", 1), text.first_match(_PUSH, "c", 2))))
    joined = chunks.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("n", "t"))), lambda x: x["t"]), "").alias("payload"))
    whole = pages.join(joined, "page_id", "left").withColumn("payload", F.coalesce(F.nullif("payload", F.lit("")), "html"))
    rows = found(whole, RECORD, "payload", key=1, label=2, image=3)
    rows = rows.withColumn("image", text.trim_ws("image")).withColumn("key", text.trim_ws("key")).filter("key <> '' AND image <> ''")
    section = F.coalesce(F.nullif(F.regexp_extract(urls.path_of("url"), "^/s/([^/]+)", 1), F.lit("")), F.lit(DEFAULT_SECTION))
    path = F.concat(F.lit("/s/"), section, F.lit("/"), F.col("key"))
    return firsts(rows.select("page_id", "pos", text.clean_text(text.packed_text("label")).alias("title"), urls.article_url("url", path, urls.query_param("url", "mode")).alias("url"), addressed("image").alias("preview_image_url")))


def _tags(pages: DataFrame) -> DataFrame:
    """The anchor and image tags of each page: n, tag, start (its offset in the page), is_image, inner (it stands within one of its kind) and, for anchors, pos (its place among them).

    Offsets come from the lengths between tags, so a page's rows hold its tags and no more. Equal page rows give their tags once.
    """
    token = r"(?i)(?=(<(?:a|img)\b[^>]*>))<"
    lengths = F.transform(F.split("html", token, -1), lambda x: F.length(x))
    found = F.arrays_zip(F.regexp_extract_all("html", F.lit(token), F.lit(1)).alias("tag"), lengths.alias("gap"))
    rows = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode(found).alias("n", "x")).select("page_id", "page_url", "n", "x.*").filter("tag IS NOT NULL")
    rows = rows.repartition("page_id").groupBy("page_id", "n").agg(*(F.min(c).alias(c) for c in ("page_url", "tag", "gap")))
    so_far = Window.partitionBy("page_id").orderBy("n")
    rows = rows.withColumn("is_image", F.lower(F.left("tag", F.lit(4))) == "<img").withColumn("start", F.sum("gap").over(so_far) + F.col("n"))
    before = Window.partitionBy("page_id", "is_image").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.max(F.col("start") + F.length("tag")).over(before) > F.col("start"), F.lit(False)))
    return rows.withColumn("pos", (F.count_if(~F.col("is_image") & ~F.col("inner")).over(so_far) - 1).cast("int"))


@by_row
def dom_anchor_cards(pages: DataFrame) -> DataFrame:
    """Titled anchors to /s/x/y; preview from the first image within LOOK_AHEAD characters of the anchor, else the first with the title as alt."""
    tags = _tags(pages)
    after = Window.partitionBy("page_id").orderBy(F.desc("n"))
    image = F.when(F.col("is_image"), F.struct("tag", (F.col("start") + F.length("tag")).alias("end")))
    # the next image from here on, which an attribute of the anchor itself may hold; it counts where it ends within reach
    ahead = F.last(image, ignorenulls=True).over(after)
    rows = tags.withColumn("ahead", ahead).filter("NOT is_image AND NOT inner")
    rows = rows.withColumn("ahead", F.when(F.col("ahead.end") <= F.col("start") + LOOK_AHEAD, F.col("ahead.tag")).otherwise(""))
    near = text.trim_ws(text.loose_attribute("ahead", "src"))
    rows = rows.select("page_id", "page_url", "pos", text.decode_entities(text.loose_attribute("tag", "href")).alias("href"), text.clean_text(text.decode_entities(text.loose_attribute("tag", "title"))).alias("title"), F.when((near != "") & ~near.startswith("data:"), near).alias("near"))
    rows = rows.filter((F.col("title") != "") & F.regexp_replace("href", r"(?i)^https?://[^/]+", "").rlike(r"(?i)^/?s/[^/?#]+/[^/?#]+"))
    rows = rows.withColumn("target", urls.resolved_url(F.col("href"), F.col("page_url")))
    images = tags.filter("is_image AND NOT inner").select("page_id", "n", F.col("tag").alias("img"))
    images = images.withColumn("alt", F.lower(text.clean_text(text.decode_entities(text.loose_attribute("img", "alt"))))).withColumn("src", text.trim_ws(text.loose_attribute("img", "src"))).filter("alt <> '' AND src <> ''")
    lookup = keep_first(images, ["page_id"], F.col("alt"), "n").select("page_id", "alt", "src")
    rows = rows.withColumn("alt", F.lower("title")).join(lookup, ["page_id", "alt"], "left").withColumn("preview_image_url", F.coalesce("near", "src")).filter("preview_image_url IS NOT NULL")
    mode = F.coalesce(urls.query_param("target", "mode"), urls.query_param("page_url", "mode"))
    path = F.regexp_extract(urls.path_of("target"), "^/s/[^/]+/[^/]+", 0)
    url = F.when(path != "", urls.article_url("page_url", path, mode)).otherwise(F.col("target"))
    return firsts(rows.select("page_id", "pos", "title", url.alias("url"), urls.resolved_url(F.col("preview_image_url"), F.col("page_url")).alias("preview_image_url")))


@by_row
def payload_or_anchors(pages: DataFrame) -> DataFrame:
    return fallback_union(packed_payload(pages), dom_anchor_cards(pages))


#: Extractors by name; others may be added.
REGISTRY: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (list_links, titleline_rows, article_links, thumb_cards, poster_cards, sectioned_list, ranked_rows, ranked_anchors, ranked_articles, api_or_images, json_ranking, image_chunk_ranking, packed_payload, dom_anchor_cards, payload_or_anchors)}


def extract(parser: str, pages: DataFrame, **more) -> DataFrame:
    """Rows of the named extractor; an unknown name is an error."""
    if parser not in REGISTRY:
        raise KeyError(f"unknown parser: {parser}")
    return REGISTRY[parser](pages, **more)
