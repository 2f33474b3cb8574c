"""Registered queries over the driver's tables, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.functions import ids, text, urls
from sluice.functions.text import RE2_WS
from sluice.operators import extract, views
from sluice.operators.dedupe import keep_best, keep_first, keep_last, link_key
from sluice.operators.state import decide, run_status
from sluice.plans import listings, live

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _clean_sql(x: str) -> str:
    x = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for name, letter in text.ENTITIES:
        x = f"replace({x}, '{name}', '{letter if letter != chr(39) else chr(39) * 2}')"
    return f"trim(regexp_replace({x}, '{RE2_WS}+', ' ', 'g'), ' ')"


def _hash_sql(x: str) -> str:
    return f"printf('%08x', list_reduce(list_prepend(5381::BIGINT, list_transform(string_split({x}, ''), lambda c: unicode(c)::BIGINT)), lambda a, b: xor((a * 33) & 4294967295, b)))"


_ORIGIN = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
_LINKS = rf"""links AS (
  SELECT page_id, url AS page_url, (i - 1)::INT AS pos, hrefs[i] AS href, {_clean_sql('labels[i]')} AS title
  FROM (SELECT page_id, url, regexp_extract_all(html, '<li><a\s+href="([^"]*)"[^>]*>([^<]*)</a>', 1) AS hrefs, regexp_extract_all(html, '<li><a\s+href="([^"]*)"[^>]*>([^<]*)</a>', 2) AS labels FROM pages),
  LATERAL (SELECT unnest(generate_series(1, len(hrefs))) AS i)),
named AS (SELECT *, regexp_extract(page_url, '^(https?://[^/?#]+)', 1) || href AS url FROM links WHERE href LIKE '/%'),
firsts AS (SELECT * FROM named WHERE title <> '' QUALIFY row_number() OVER (PARTITION BY page_id, lower(url) || '|' || lower(title) ORDER BY pos) = 1)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, pos, title, url of the plain list links of all pages, in column functions."""
    pages = table(spark, sf_dir, "pages")
    rows = extract.found(pages, r'<li><a\s+href="([^"]*)"[^>]*>([^<]*)</a>', href=1, label=2).filter(F.col("href").startswith("/"))
    return rows.select("page_id", "pos", text.clean_text("label").alias("title"), urls.absolute_url("href", "url").alias("url"), F.col("url").alias("page_url"))


@query(f"WITH {_LINKS} SELECT regexp_extract(lower(url), '^https?://([^/?#:]+)', 1) AS site_id, count(*)::BIGINT AS n_links, count(DISTINCT url)::BIGINT AS n_urls, max({_hash_sql(chr(39) + chr(39) + ' || lower(url) || ' + chr(39) + '|' + chr(39) + ' || lower(title)')}) AS last_hash FROM firsts GROUP BY 1")
def links_per_host(spark, sf_dir):
    rows = keep_first(links(spark, sf_dir).filter("title <> ''"), ["page_id"], link_key())
    host = F.regexp_extract(urls.origin("url"), "://([^:]+)", 1)
    hashed = ids.djb2x(F.concat(F.lower("url"), F.lit("|"), F.lower(text.trim_ws("title"))))
    return rows.groupBy(host.alias("site_id")).agg(F.count(F.lit(1)).alias("n_links"), F.countDistinct("url").alias("n_urls"), F.max(hashed).alias("last_hash"))


@query(f"SELECT page_id, {_clean_sql(chr(34) + 'h1' + chr(34))} AS title FROM (SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1 FROM pages)")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.clean_text(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)).alias("title"))


@query(f"WITH {_LINKS} SELECT page_id, pos, title, href FROM links")
def extract_links(spark, sf_dir):
    rows = extract.found(table(spark, sf_dir, "pages"), r'<li><a\s+href="([^"]*)"[^>]*>([^<]*)</a>', href=1, label=2)
    return rows.select("page_id", "pos", text.clean_text("label").alias("title"), "href")


@query(f"WITH {_LINKS} SELECT page_id, pos, url FROM named")
def absolute_url(spark, sf_dir):
    return links(spark, sf_dir).select("page_id", "pos", "url")


@query("SELECT page_id, lower(CASE WHEN regexp_full_match(url, 'https?://[^/?#]+([?#].*)?') THEN regexp_replace(url, '[?#].*$', '') || '/' ELSE regexp_replace(url, '[?#].*$', '') END) AS bare_url, regexp_extract(lower(url), '^(https?://[^/?#:]+)', 1) AS origin FROM pages")
def url_no_query(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", ids.url_without_query("url").alias("bare_url"), urls.origin("url").alias("origin"))


@query(f"WITH {_LINKS} SELECT page_id, pos, title, url FROM firsts")
def dedupe_first(spark, sf_dir):
    return keep_first(links(spark, sf_dir).filter("title <> ''"), ["page_id"], link_key()).select("page_id", "pos", "title", "url")


_LINES = "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::DOUBLE AS rank_order, l_orderkey::BIGINT * 10 + l_linenumber::BIGINT AS pos FROM lineitem"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey"), F.col("l_quantity").cast("double").alias("rank_order"), (F.col("l_orderkey").cast("bigint") * 10 + F.col("l_linenumber").cast("bigint")).alias("pos"))


@query(f"SELECT l_partkey, rank_order, pos, min(pos) OVER (PARTITION BY l_partkey) AS first_pos FROM ({_LINES}) QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY pos DESC) = 1")
def dedupe_last(spark, sf_dir):
    return keep_last(_lines(spark, sf_dir), [], F.col("l_partkey"))


@query(f"SELECT l_partkey, rank_order, pos, min(pos) OVER (PARTITION BY l_partkey) AS first_pos FROM ({_LINES}) QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY rank_order, pos) = 1")
def dedupe_rank(spark, sf_dir):
    return keep_best(_lines(spark, sf_dir), [], F.col("l_partkey"))


@query(f"SELECT page_id, 'site:' || {_hash_sql(chr(39) + chr(39) + ' || lower(url) || ' + chr(39) + '|' + chr(39) + ' || lower(title)')} AS id FROM (SELECT page_id, url, {_clean_sql('h1')} AS title FROM (SELECT *, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1 FROM pages))")
def item_id(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("title", text.clean_text(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)))
    return pages.select("page_id", ids.item_id(F.lit("site"), "url", "title").alias("id"))


@query("""WITH sites AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS id, 'https://' || regexp_extract(url, '^https?://([^/?#]+)', 1) || '/' AS site_url, '.*/' || split_part(regexp_extract(url, '^https?://([^/?#]+)', 1), '.', 1) || '/.*' AS rx, count(*) AS n FROM pages GROUP BY ALL)
SELECT page_id, id AS site_id FROM pages, sites WHERE regexp_extract(lower(url), '^(https?://[^/?#]+)', 1) = regexp_extract(lower(site_url), '^(https?://[^/?#]+)', 1) OR regexp_full_match(url, rx)""")
def site_match(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    sites = pages.select(host.alias("id")).distinct()
    sites = sites.select("id", F.concat(F.lit("https://"), "id", F.lit("/")).alias("url"), F.lit(None).cast("string").alias("configured_url"), F.array(F.concat(F.lit("*/"), F.split_part("id", F.lit("."), F.lit(1)), F.lit("/*"))).alias("match_patterns"))
    return views.matching_sites(pages.select("page_id", "url"), sites).select("page_id", "site_id")


@query("""WITH globs AS (SELECT DISTINCT '*' || left(regexp_extract(url, '^https?://([^/?#]+)', 1), 7) || '*/' || left(regexp_extract(url, '/([0-9]+)', 1), 1) || '*' AS own FROM pages)
SELECT page_id, own AS site_id FROM pages JOIN globs ON url LIKE replace(own, '*', '%')""")
def glob_match(spark, sf_dir):
    """Pages by patterns of which no literal is a whole part of a path: the start of each host and number, anywhere."""
    from sluice.operators.patterns import glob_hits

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, number = F.regexp_extract("url", "^https?://([^/?#]+)", 1), F.regexp_extract("url", "/([0-9]+)", 1)
    glob = F.concat(F.lit("*"), F.left(host, F.lit(7)), F.lit("*/"), F.left(number, F.lit(1)), F.lit("*"))
    patterns = pages.select(glob.alias("site_id"), glob.alias("glob")).distinct()
    return glob_hits(pages, patterns).select("page_id", "site_id")


_BATCH = "WITH ev AS (SELECT event_type || ':' || user_id::VARCHAR AS id, event_type AS site_id, (epoch_us(ts) // 1000)::BIGINT AS t, user_id FROM events), old AS (SELECT id, min(site_id) AS site_id, min(t) AS t0, max(t) AS t1, count(*)::BIGINT AS n, min(user_id) AS u FROM ev WHERE t < 1705276800000 GROUP BY id), batch AS (SELECT id, min(site_id) AS site_id FROM ev WHERE t >= 1705276800000 GROUP BY id), items AS (SELECT * FROM old WHERE u % 5 <> 0), log AS (SELECT * FROM old WHERE u % 7 <> 0)"


def _state(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("id"), F.col("event_type").alias("site_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), "user_id")
    old = events.filter("t < 1705276800000").groupBy("id").agg(F.min("site_id").alias("site_id"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.count(F.lit(1)).alias("n"), F.min("user_id").alias("u"))
    batch = events.filter("t >= 1705276800000").groupBy("id").agg(F.min("site_id").alias("site_id")).withColumn("crawled_at", F.lit(1705276800000).cast("bigint"))
    items = old.filter("u % 5 <> 0").select("id", "site_id", F.col("t0").alias("crawled_at"))
    log = old.filter("u % 7 <> 0").select("id", "site_id", F.col("id").alias("item_id"), F.col("t0").alias("first_seen_at"), F.col("t1").alias("last_seen_at"), F.col("n").alias("seen_count"))
    return batch, items, log


@query(f"{_BATCH} SELECT b.id, CASE WHEN l.id IS NULL AND i.id IS NULL THEN 'insert' WHEN l.id IS NULL THEN 'relog' WHEN i.id IS NULL THEN 'tombstone' ELSE 'repeat' END AS decision, coalesce(l.t0, i.t0, 1705276800000)::BIGINT AS first_seen_at, CASE WHEN l.id IS NOT NULL THEN l.n + 1 WHEN i.id IS NOT NULL THEN 2 ELSE 1 END::BIGINT AS seen_count FROM batch b LEFT JOIN log l ON l.id = b.id LEFT JOIN items i ON i.id = b.id")
def upsert_decision(spark, sf_dir):
    from sluice.operators.state import merge

    batch, items, log = _state(spark, sf_dir)
    merged = merge(batch, items, log)
    kind = F.when(F.col("is_fresh"), "insert").when(F.col("old_count").isNull(), "relog").when(F.col("item_at").isNull(), "tombstone").otherwise("repeat")
    decided = merged.decided.select("id", "is_fresh", "item_at", F.col("seen_count").alias("old_count"))
    return decided.join(merged.log, "id").select("id", kind.alias("decision"), "first_seen_at", "seen_count")


@query(f"{_BATCH} SELECT b.id FROM batch b WHERE EXISTS (SELECT 1 FROM log l WHERE l.id = b.id) AND NOT EXISTS (SELECT 1 FROM items i WHERE i.id = b.id)")
def tombstone_recrawl(spark, sf_dir):
    batch, items, log = _state(spark, sf_dir)
    return decide(batch, items, log).filter("item_at IS NULL AND seen_count IS NOT NULL").select("id")


@query("SELECT event_type || ':' || user_id::VARCHAR AS id, min(epoch_us(ts) // 1000)::BIGINT AS first_seen_at, max(epoch_us(ts) // 1000)::BIGINT AS last_seen_at, count(DISTINCT ts::DATE)::BIGINT AS seen_count FROM events GROUP BY 1")
def seen_log(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    return events.groupBy(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("id")).agg(F.min("ms").alias("first_seen_at"), F.max("ms").alias("last_seen_at"), F.countDistinct(F.to_date("ts")).alias("seen_count"))


def _rows(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("site_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("crawled_at"), F.col("event_id").alias("id"))


@query("SELECT event_type AS site_id, (epoch_us(ts) // 1000)::BIGINT AS crawled_at, event_id AS id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC)::INT AS place FROM events QUALIFY place <= 200")
def top_items(spark, sf_dir):
    return views.top_of_each(_rows(spark, sf_dir))


@query("SELECT event_id AS id, (epoch_us(ts) // 1000)::BIGINT AS crawled_at, event_type AS site_id FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 200")
def top_items_of_site(spark, sf_dir):
    return views.top_of_site(_rows(spark, sf_dir), "purchase")


@query("SELECT event_id AS run_id, event_type AS site_id, (epoch_us(ts) // 1000)::BIGINT AS started_at FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_run(spark, sf_dir):
    return views.latest_run(_rows(spark, sf_dir).select(F.col("id").alias("run_id"), "site_id", F.col("crawled_at").alias("started_at")))


@query("SELECT s.site_id, count(e.event_id)::BIGINT AS n_items FROM (SELECT DISTINCT event_type AS site_id FROM events UNION SELECT 'missing') s LEFT JOIN events e ON e.event_type = s.site_id GROUP BY 1")
def counts_zero_fill(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return views.counts(rows, rows.select("site_id").union(spark.sql("SELECT 'missing' AS site_id")).distinct())


@query("SELECT count(*)::BIGINT AS total FROM events")
def total_count(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return views.counts(rows, rows.select("site_id").distinct()).agg(F.sum("n_items").alias("total"))


@query("""WITH day AS (SELECT ts::DATE AS d, event_type || ':' || user_id::VARCHAR AS id FROM events), firsts AS (SELECT id, min(d) AS d0 FROM day GROUP BY id)
SELECT strftime(d, '%Y-%m-%d') AS run_id, count(DISTINCT day.id)::BIGINT AS parsed_count, count(DISTINCT day.id) FILTER (d = d0)::BIGINT AS stored_count, CASE WHEN count(*) FILTER (d = d0) > 0 THEN 'success' ELSE 'partial' END AS status, CASE WHEN count(*) FILTER (d = d0) = 0 THEN 'NO_ITEMS' END AS error_code FROM day JOIN firsts USING (id) GROUP BY d""")
def run_summaries(spark, sf_dir):
    day = table(spark, sf_dir, "events").select(F.to_date("ts").alias("d"), F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("id")).distinct()
    marked = day.withColumn("fresh", F.col("d") == F.min("d").over(Window.partitionBy("id")))
    runs = marked.groupBy("d").agg(F.count(F.lit(1)).alias("parsed_count"), F.count_if("fresh").alias("stored_count"))
    return runs.select(F.date_format("d", "yyyy-MM-dd").alias("run_id"), "parsed_count", "stored_count", *run_status(F.col("stored_count")))


@query("""SELECT p.event_id, coalesce(s.event_id, f.event_id) AS marker FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY ALL) s ON s.user_id = p.user_id AND s.ts <= p.ts
LEFT JOIN (SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type = 'signup' GROUP BY 1) f ON f.user_id = p.user_id""")
def asof_marker(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "signup"))
    own = F.when(F.col("event_type") == "signup", F.col("event_id"))
    w = Window.partitionBy("user_id").orderBy("ts", (F.col("event_type") == "purchase"), "event_id")
    first = F.min_by(own, F.when(own.isNotNull(), F.struct("ts", "event_id"))).over(Window.partitionBy("user_id"))
    marked = rows.withColumn("marker", F.coalesce(F.last(own, ignorenulls=True).over(w), first))
    return marked.filter("event_type = 'purchase'").select("event_id", "marker")


@query(f"WITH {_LINKS} SELECT page_id, pos, lag(title) OVER w AS before, lead(title) OVER w AS after FROM links WINDOW w AS (PARTITION BY page_id ORDER BY pos)")
def neighbour_chunks(spark, sf_dir):
    rows = extract_links(spark, sf_dir)
    w = Window.partitionBy("page_id").orderBy("pos")
    return rows.select("page_id", "pos", F.lag("title").over(w).alias("before"), F.lead("title").over(w).alias("after"))


@query("SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS joined FROM conversations GROUP BY 1")
def chunk_concat(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "").alias("joined"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN '조회수 ' || json_extract_string(props, '$.k') END AS views, coalesce(nullif(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0), event_id)::BIGINT AS rank_order FROM events")
def json_fields(spark, sf_dir):
    v = F.try_parse_json("props")
    k = F.try_variant_get(v, "$.k", "string")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), text.views_snippet(F.try_variant_get(v, "$.k", "variant")).alias("views"), text.rank_or(k, F.col("event_id").cast("bigint")).alias("rank_order"))


_TRIMMED = f"nullif(regexp_replace(text, '^{RE2_WS}+|{RE2_WS}+$', '', 'g'), '')"


@query(f"SELECT doc_id, CASE WHEN length(t) <= 280 THEN t ELSE left(t, 277) || '...' END AS snippet FROM (SELECT doc_id, {_TRIMMED} AS t FROM documents)")
def clip_snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clip_snippet("text").alias("snippet"))


@query("SELECT page_id, 'h1' AS source, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS title FROM pages WHERE NOT regexp_matches(html, '<h2>[^<]*</h2>') AND regexp_matches(html, '<h1>[^<]*</h1>') UNION ALL SELECT page_id, 'h2', regexp_extract(html, '<h2>([^<]*)</h2>', 1) FROM pages WHERE regexp_matches(html, '<h2>[^<]*</h2>')")
def fallback_union(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    rows = [pages.filter(F.col("html").rlike(f"<{h}>[^<]*</{h}>")).select("page_id", F.lit(h).alias("source"), F.regexp_extract("html", f"<{h}>([^<]*)</{h}>", 1).alias("title")) for h in ("h2", "h1")]
    return extract.fallback_union(*rows)


@query("SELECT page_id, CASE WHEN page_id % 3 <> 0 AND regexp_matches(s, '(?i)^https?://') THEN s ELSE url END AS link FROM (SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN 'https://example.com/i/status/' || page_id ELSE 'text' END AS s FROM pages)")
def title_link(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("site", F.concat(F.lit("s"), (F.col("page_id") % 3).cast("string")))
    summary = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://example.com/i/status/"), F.col("page_id").cast("string"))).otherwise("text")
    return pages.select("page_id", urls.title_link("site", summary, "url", ("s1", "s2")).alias("link"))


#: The views and the aliases of periods.
VIEWS = ("ranking", "realtime", "recent")
PERIODS = {"hourly": "hourly", "1h": "hourly", "daily": "daily", "24h": "daily", "weekly": "weekly", "7d": "weekly", "monthly": "monthly", "30d": "monthly"}


@query(f"""SELECT page_id, view, period, {_ORIGIN} || '/api/' || view || '?period=' || period AS api_url FROM (SELECT page_id, url, coalesce(nullif(regexp_extract(lower(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)), '(?:^|/)({"|".join(VIEWS)})(?:/|$)', 1), ''), 'ranking') AS view,
CASE lower(regexp_extract(url, '[?&]page=([^&#]*)', 1)) WHEN '1' THEN 'hourly' WHEN '2' THEN 'daily' WHEN '3' THEN 'weekly' ELSE 'hourly' END AS period FROM pages)""")
def period_from_url(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    view = F.coalesce(urls.first_segment_in("url", VIEWS), F.lit("ranking"))
    period = F.coalesce(urls.first_alias("url", ("period", "time", "page"), PERIODS | {"1": "hourly", "2": "daily", "3": "weekly"}), F.lit("hourly"))
    return pages.select("page_id", "url", view.alias("view"), period.alias("period")).select("page_id", "view", "period", urls.api_url("url", "view", "period").alias("api_url"))


@query(f"SELECT {_ORIGIN} || '/*' AS pattern FROM pages UNION SELECT 'https://example.com/*'")
def distinct_patterns(spark, sf_dir):
    own = table(spark, sf_dir, "pages").select(F.concat(F.regexp_extract("url", "^(https?://[^/?#]+)", 1), F.lit("/*")).alias("pattern"))
    return own.union(spark.sql("SELECT 'https://example.com/*' AS pattern")).distinct()


@query("SELECT page_id::VARCHAR AS id, CASE WHEN page_id % 4 = 0 THEN 'https://other.example/' || page_id ELSE url END AS configured_url FROM pages")
def config_merge(spark, sf_dir):
    sites = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), "url")
    own = sites.filter("CAST(id AS BIGINT) % 2 = 0").select("id", F.when(F.col("id").cast("bigint") % 4 == 0, F.concat(F.lit(" https://other.example/"), "id")).otherwise(" \t").alias("override_url"))
    return views.configured(sites, own).select("id", "configured_url")


@query("SELECT a.page_id, regexp_extract(lower(a.url), '^(https?://[^/?#]+)', 1) = regexp_extract(lower(b.url), '^(https?://[^/?#]+)', 1) AS same FROM pages a JOIN pages b ON b.page_id = a.page_id + 1")
def same_origin(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    other = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next_url"))
    return pages.join(other, "page_id").select("page_id", urls.same_origin("url", "next_url").alias("same"))


_NORMAL = "CASE WHEN regexp_full_match(url, 'https?://[^/?#]+') THEN url || '/' ELSE url END"


@query(f"SELECT page_id, {_NORMAL} AS url, CASE WHEN page_id % 3 = 1 THEN {_NORMAL} END AS preview_url FROM pages")
def normalized_urls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    preview = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" Data:"), "url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("\t"), "url", F.lit(" "))).otherwise(" ")
    shown = F.regexp_replace("url", "^https://", "HTTPS://")
    return pages.select("page_id", urls.normalized_url(shown).alias("url"), urls.preview_url(preview).alias("preview_url"))


_O, _H = "regexp_extract(url, '^https?://[^/?#]*', 0)", "regexp_extract(url, '^https?://([^/?#]+)', 1)"


@query(f"""SELECT page_id, CASE page_id % 12 WHEN 0 THEN 'https://' || {_H} || '/a/b' WHEN 1 THEN {_O} || '/xy' WHEN 2 THEN 'http://xn--bcher-kva.' || {_H} || '/%C3%BC' WHEN 3 THEN 'https://' || {_H} || '/p:1'
WHEN 4 THEN 'http://' || {_H} || '/' WHEN 5 THEN {_O} || '/a/d/' WHEN 6 THEN regexp_extract(url, '^[^?#]*', 0) || '?q=a%20b&c=%27d%27' WHEN 7 THEN {_O} || '/z#%3Cf%3E' WHEN 8 THEN 'http://' || {_H} || ':99999/' WHEN 9 THEN 'http://a b/'
WHEN 10 THEN split_part(url, ':', 1) || '://u:p@' || {_H} || '/%7Bx%7D|%60' ELSE 'mailto:A@b.c' END AS url, CASE WHEN page_id % 12 = 6 THEN lower(regexp_extract(url, '^[^?#]*', 0)) WHEN page_id % 12 = 0 THEN 'https://' || {_H} || '/a/b' END AS bare_url FROM pages""")
def url_cases(spark, sf_dir):
    """References as they stand in pages, against the page: backslashes, tabs, hosts beyond ASCII, ports, dots, letters to encode, and what is no URL."""
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    around = lambda a, b: F.concat(F.lit(a), host, F.lit(b))
    cases = [
        F.concat(F.lit("HTTPS:\\\\"), F.upper(host), F.lit("\\a\\b")), F.lit(" \t/x\ty "), around("http://bücher.", "/ü"), around("https://", ":443/p:1"), around("http://", ":0080"), F.lit("/a/./b/../c/%2E%2e/d/."),
        F.lit("?q=a b&c='d'"), F.lit("../../../../../../z#<f>"), around("http://", ":99999/"), F.lit("http://a b/"), around("//u:p@", "/{x}|`"), F.lit("MAILTO:A@b.c"),
    ]
    raw, place = F.lit(None).cast("string"), F.col("page_id") % len(cases)
    for i, case in enumerate(cases):
        raw = F.when(place == i, case).otherwise(raw)
    pages = table(spark, sf_dir, "pages").select("page_id", urls.resolved_url(raw, "url").alias("url"))
    return pages.select("page_id", "url", F.when((F.col("page_id") % 12).isin(0, 6), ids.url_without_query("url")).alias("bare_url"))


@query("""SELECT doc_id, 'ABq' || chr(92) || 'n😀' || chr(65533) || '|z' || chr(9) || replace(source, chr(92), '') || chr(92) AS script,
CASE doc_id % 3 WHEN 0 THEN 'x"' || source || 'é' WHEN 1 THEN source || chr(92) || '"' ELSE source || chr(92) || 'q' END AS packed FROM documents""")
def script_texts(spark, sf_dir):
    """Script literals and packed strings with every kind of escape around the source of each document."""
    literal = F.concat(F.lit("\\u0041\\x42\\q\\\\n\\ud83d\\ude00\\ud83d|\\\r\nz\\t"), F.replace("source", F.lit("\\"), F.lit("")), F.lit("\\"))
    packed = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('x"'), "source", F.lit("\\u00e9"))).when(F.col("doc_id") % 3 == 1, F.concat("source", F.lit('\\"'))).otherwise(F.concat("source", F.lit("\\q")))
    return table(spark, sf_dir, "documents").select("doc_id", text.script_text(literal).alias("script"), text.packed_text(packed).alias("packed"))


@query(f"""SELECT doc_id, CASE WHEN length(u) + wide <= 280 THEN u ELSE left(u, (SELECT max(m) FROM (SELECT unnest(range(138, 278)) AS m) WHERE m + len(list_filter(string_split(left(u, m), ''), lambda x: unicode(x) > 65535)) <= 277)) || '...' END AS snippet, (length(u) + wide)::INT AS units
FROM (SELECT *, len(list_filter(string_split(u, ''), lambda x: unicode(x) > 65535)) AS wide FROM (SELECT doc_id, left(t, 270 + doc_id % 14) || '😀' || substr(t, 271 + doc_id % 14) AS u FROM (SELECT doc_id, {_TRIMMED} AS t FROM documents)))""")
def clip_units(spark, sf_dir):
    """Snippets of texts with a character of two units at the place where they are cut, and their length in units."""
    place = (F.lit(270) + F.col("doc_id") % 14).cast("int")
    whole = table(spark, sf_dir, "documents").select("doc_id", text.blank_to_null(text.trim_ws("text")).alias("t"))
    whole = whole.select("doc_id", F.concat(F.left("t", place), F.lit("😀"), F.col("t").substr(place + 1, F.length("t"))).alias("u"))
    return whole.select("doc_id", text.clip_snippet("u").alias("snippet"), text.utf16_units("u").alias("units"))


_ENCODED = "url_encode(url)"
for _letter in "/:?=&#%@+,;~":
    _ENCODED = f"replace({_ENCODED}, '%{ord(_letter):02X}', '{_letter}')"


@query(f"WITH {_LINKS} SELECT page_id, pos, title, {_ENCODED} AS url, NULL::VARCHAR AS dedupe_key, NULL::VARCHAR AS preview_image_url, NULL::VARCHAR AS summary, NULL::DOUBLE AS price, NULL::VARCHAR AS raw_html_snippet FROM firsts")
def list_links(spark, sf_dir):
    return extract.list_links(table(spark, sf_dir, "pages"))


@query(f"SELECT page_id, {_clean_sql('html')} AS words FROM pages")
def page_words(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.clean_text("html").alias("words"))


class _Paragraphs:
    """A parser as a user may write one: paragraphs, numbered from page to page of a host."""

    def __init__(self) -> None:
        self.n = 0

    def parse(self, page: dict):
        for title in re.findall("<p>([^<]*)</p>", page["html"] or ""):
            self.n += 1
            yield {"title": title, "url": f"#p{self.n}", "price": self.n}


@query(f"""SELECT page_id, (i - 1)::INT AS pos, title, regexp_replace(url, '#.*$', '') || '#p' || n AS url, n::DOUBLE AS price FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id, i) AS n
FROM (SELECT page_id, url, host, i, {_clean_sql('heads[i]')} AS title FROM (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract_all(html, '<p>([^<]*)</p>', 1) AS heads FROM pages), LATERAL (SELECT unnest(generate_series(1, len(heads))) AS i))) WHERE title <> ''""")
def outside_parser(spark, sf_dir):
    """A parser from outside, run as a table function over the pages of each host in order."""
    from sluice.operators import extension

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"))
    extension.register(spark, "numbered_paragraphs", _Paragraphs, by=("host",), order=("page_id",))
    return extract.extract("numbered_paragraphs", pages).select("page_id", "pos", "title", "url", "price")


_IDENT = f"'s' || (doc_id % 3) || ':' || {_hash_sql(chr(39) + chr(39) + ' || key')}"


@query(f"""SELECT {_IDENT} AS id, 's' || (doc_id % 3) AS site_id, doc_id AS pos, title, url, CASE WHEN doc_id % 2 = 0 THEN 'https://i.example/' || doc_id END AS preview_image_url, {_TRIMMED} AS summary, doc_id / 4.0::DOUBLE AS price,
CASE WHEN length({_TRIMMED}) <= 280 THEN {_TRIMMED} ELSE left({_TRIMMED}, 277) || '...' END AS raw_html_snippet, 7::BIGINT AS crawled_at
FROM (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 'dedupe:key ' || doc_id ELSE lower(url) || '|' || lower(title) END AS key FROM (SELECT *, 'Title ' || doc_id AS title, 'https://a.example/' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '?Q' ELSE '/' END AS url FROM documents)) WHERE doc_id % 9 <> 0""")
def normalised_items(spark, sf_dir):
    """Parsed rows as items: whole summaries, clipped snippets."""
    from sluice.operators.state import normalised

    key = F.col("doc_id").cast("string")
    rows = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")).alias("site_id"), F.col("doc_id").alias("pos"),
        F.when(F.col("doc_id") % 9 == 0, F.lit(" 　")).otherwise(F.concat(F.lit("﻿ Title "), key, F.lit("\n"))).alias("title"),
        F.concat(F.lit(" HTTPS://A.example:443/x/../"), key, F.when(F.col("doc_id") % 5 == 0, "?Q").otherwise("/")).alias("url"),
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" KEY "), key)).otherwise(" ").alias("dedupe_key"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://i.example/"), key)).otherwise("data:x").alias("preview_image_url"),
        F.col("text").alias("summary"), (F.col("doc_id") / 4).alias("price"), F.col("text").alias("raw_html_snippet"),
    )
    return normalised(rows, 7)


@query("SELECT event_id AS run_id, event_type AS site_id, (epoch_us(ts) // 1000)::BIGINT AS started_at, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC)::INT AS place FROM events QUALIFY place <= 20")
def run_history(spark, sf_dir):
    return views.run_history(_rows(spark, sf_dir).select(F.col("id").alias("run_id"), "site_id", F.col("crawled_at").alias("started_at")))


@query("SELECT c.c_custkey AS id, n.n_name AS site_name, n.n_regionkey AS region FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey AND n.n_nationkey % 7 <> 0")
def site_lookup(spark, sf_dir):
    sites = table(spark, sf_dir, "nation").filter("n_nationkey % 7 <> 0").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("site_id"))
    return views.site_of(rows, sites, "name", "region").select("id", F.col("name").alias("site_name"), "region")


@query(f"""SELECT page_id, view, period, CASE WHEN view = 'ranking' THEN o || '/api/tw/ranking?period=' || period ELSE o || '/api/tw/' || view END AS api_url FROM (
SELECT page_id, {_ORIGIN} AS o, CASE WHEN page_id % 4 = 0 THEN ['ranking', 'realtime', 'recent'][page_id // 4 % 3 + 1] ELSE ['realtime', 'recent', 'ranking', 'ranking'][page_id % 4 + 1] END AS view,
CASE WHEN page_id % 5 = 0 THEN ['hourly', 'daily', 'weekly', 'monthly'][page_id // 5 % 4 + 1] ELSE ['monthly', 'monthly', 'weekly', 'daily', 'daily', 'hourly', 'hourly'][page_id % 7 + 1] END AS period FROM pages)""")
def shown_view(spark, sf_dir):
    """View and period by URL, else by the labels of the active tab and button."""
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    k = F.col("page_id")
    path = F.when(k % 4 == 0, pick(("/Ranking", "/realtime", "/a/recent "), F.floor(k / 4) % 3)).otherwise("/start")
    asked = F.when(k % 5 == 0, pick(("?time=Hour", "?period=zz&range=day", "?filter=WEEKLY", "?period=month"), F.floor(k / 5) % 4)).otherwise("?q=1")
    tab = pick(("실시간 인기", "<b>신규</b>", "인기", "없음"), k % 4)
    button = pick(("1달", "1개월 전체", "1주", "24시간", "1일", "1시간", "기타"), k % 7)
    html = F.concat(F.lit('<a class="tab" href="x">신규</a><a class="x tab-active y" href="x"> </a><button class="bg-violet-500/20"><i>'), tab, F.lit('</i></button><button class="shadow-violet-500/50 b"> '), button, F.lit("</button>"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_extract("url", "^https?://[^/?#]+", 0), path, asked).alias("url"), html.alias("html"))
    return pages.select("page_id", urls.active_view("html", "url").alias("view"), urls.active_period("html", "url").alias("period"), urls.active_api_url("html", "url").alias("api_url"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '수집 가능한 아이템이 없습니다.' WHEN 1 THEN '페이지 구조를 파싱하지 못했습니다. 사이트 구조 변경 여부를 확인하세요.' ELSE '알 수 없는 오류가 발생했습니다.' END AS message,
strftime(ts, '%y. %-m. %-d. ') || CASE WHEN hour(ts) < 12 THEN '오전' ELSE '오후' END || strftime(ts, ' %-I:%M:%S') AS shown FROM events""")
def shown_runs(spark, sf_dir):
    code = F.get(F.array(F.lit("NO_ITEMS"), F.lit("PARSE_FAILED"), F.lit("SOMETHING"), F.lit(None).cast("string")), (F.col("event_id") % 4).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", text.error_message(code).alias("message"), text.shown_time(F.unix_millis(F.col("ts").cast("timestamp"))).alias("shown"))


@query("SELECT n_name AS id, CASE WHEN n_nationkey % 4 = 0 THEN 'https://o.example/' || n_nationkey ELSE 'https://' || lower(n_name) || '.example' END AS configured_url FROM nation")
def settings_merge(spark, sf_dir):
    """Overrides out of settings texts: blank, numeric and corrupt ones leave the default."""
    nation = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey").cast("string")
    value = F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit('" https://o.example/'), k, F.lit('"'))).when(F.col("n_nationkey") % 4 == 1, F.lit('"  "')).when(F.col("n_nationkey") % 4 == 2, F.lit("5")).otherwise(F.lit('"https://o.example'))
    settings = nation.select(F.concat(F.lit('{"'), "n_name", F.lit('":'), value, F.lit("}")).alias("settings"))
    sites = nation.select(F.col("n_name").alias("id"), F.concat(F.lit("https://"), F.lower("n_name"), F.lit(".example")).alias("url"))
    return views.configured(sites, views.overrides(settings)).select("id", "configured_url")


@query(f"{_BATCH} SELECT count(*)::BIGINT AS parsed_count, count(*) FILTER (l.id IS NULL AND i.id IS NULL)::BIGINT AS stored_count, count(*) FILTER (l.id IS NOT NULL OR i.id IS NOT NULL)::BIGINT AS skipped_count, CASE WHEN count(*) FILTER (l.id IS NULL AND i.id IS NULL) > 0 THEN 'success' ELSE 'partial' END AS status, CASE WHEN count(*) FILTER (l.id IS NULL AND i.id IS NULL) = 0 THEN 'NO_ITEMS' END AS error_code FROM batch b LEFT JOIN log l ON l.id = b.id LEFT JOIN items i ON i.id = b.id")
def batch_summary(spark, sf_dir):
    from sluice.operators.state import run_summary

    batch, items, log = _state(spark, sf_dir)
    return run_summary(decide(batch, items, log), batch.count())


@query(f"{_BATCH} SELECT id, site_id, t0 AS crawled_at FROM items WHERE id NOT IN (SELECT id FROM batch WHERE id LIKE '%3')")
def deleted_items(spark, sf_dir):
    from sluice.operators.state import deleted

    batch, items, _ = _state(spark, sf_dir)
    return deleted(items, batch.filter(F.col("id").endswith("3")))


@query("SELECT event_id AS run_id, CASE WHEN event_id % 5 = 0 THEN 'failed' WHEN user_id % 3 > 0 THEN 'success' ELSE 'partial' END AS status, CASE WHEN event_id % 5 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'PARSE_FAILED' ELSE 'UNKNOWN' END WHEN user_id % 3 = 0 THEN 'NO_ITEMS' END AS error_code FROM events")
def run_states(spark, sf_dir):
    code = F.when(F.col("event_id") % 2 == 0, "PARSE_FAILED")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), *run_status(F.col("user_id") % 3, F.col("event_id") % 5 == 0, code))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 AND page_id % 2 = 0 THEN '[1]' WHEN page_id % 5 <> 4 THEN html END AS input, CASE WHEN page_id % 5 = 4 THEN 'CONTENT_SCRIPT_UNAVAILABLE' END AS source_error FROM pages""")
def page_inputs(spark, sf_dir):
    """Pages whose html comes from the fallback, is missing, or gives way to an API body."""
    from sluice.sources.store import page_source, parser_input

    k = F.col("page_id")
    pages = table(spark, sf_dir, "pages").select("page_id", F.when(k % 5 < 2, F.col("html")).alias("html"), F.when(k % 5 != 4, F.col("html")).alias("fallback_html"), F.when(k % 2 == 0, " [1]\n").otherwise("<p>").alias("api_payload"), F.when(k % 3 == 0, "api").otherwise("html").alias("parser_id"))
    return parser_input(page_source(pages), ("api",)).select("page_id", "input", "source_error")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url END AS target FROM pages")
def link_targets(spark, sf_dir):
    raw = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" "), "url", F.lit("\n"))).when(F.col("page_id") % 3 == 1, "javascript:void(0)").otherwise("/path")
    return table(spark, sf_dir, "pages").select("page_id", urls.http_target(raw).alias("target"))


QUERIES |= listings.QUERIES | live.QUERIES
ORACLES |= listings.ORACLES | live.ORACLES
