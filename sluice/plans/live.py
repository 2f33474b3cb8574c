"""Registered queries over streams: events as crawls of their kind, one a day, remembered in keyed state and listed from it.

The days come in three parts, each a new start from the checkpoint of the one before; the last brings the first part again. An event is a
sighting of its user's item; each 97th deletes the item that day. The SQL knows nothing of parts, replays or state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.sources import clustered
from sluice.sources.shared import new_folder
from sluice.streaming import memory

QUERIES: dict = {}
ORACLES: dict = {}
_DAY_MS = 86_400_000


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as rows of crawls."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / _DAY_MS) * _DAY_MS
    ident = F.concat_ws(":", "event_type", F.col("user_id").cast("string"))
    kinds = F.when(F.col("event_id") % 97 == 0, F.array(F.lit("seen"), F.lit("deleted"))).otherwise(F.array(F.lit("seen")))
    return events.select(
        F.explode(kinds).alias("kind"), ident.alias("id"), F.col("event_type").alias("site_id"), at.cast("bigint").alias("crawled_at"), F.col("event_id").cast("bigint").alias("pos"),
        F.concat(F.lit("Title "), ident).alias("title"), F.concat(F.lit("https://example.com/"), ident).alias("url"), F.lit(None).cast("string").alias("preview_image_url"),
        F.lit(None).cast("string").alias("summary"), F.col("value").cast("double").alias("price"), F.lit(None).cast("string").alias("raw_html_snippet"),
    )


def remembered(spark: SparkSession, sf_dir: str) -> str:
    """The checkpoint of the query that has read all parts."""
    rows, folder = crawls(spark, sf_dir), new_folder(spark, "crawls")
    bounds = rows.agg(F.min("crawled_at").alias("a"), F.max("crawled_at").alias("b")).first()
    if bounds["a"] is None:
        return f"{folder}/checkpoint"
    third = F.floor((F.col("crawled_at") - bounds["a"]) * 3 / (bounds["b"] - bounds["a"] + 1))
    for part in (third == 0, third == 1, third != 1):
        rows.filter(part).write.mode("append").parquet(f"{folder}/rows")
        stream = spark.readStream.schema(memory.CRAWL).parquet(f"{folder}/rows")
        memory.remember(stream, f"{folder}/checkpoint").awaitTermination()
    return f"{folder}/checkpoint"


_SEEN = f"""WITH day AS (SELECT DISTINCT event_type || ':' || user_id AS id, event_type AS site_id, (epoch_us(ts) // 86400000000 * {_DAY_MS})::BIGINT AS day_at FROM events),
gone AS (SELECT event_type || ':' || user_id AS id, min((epoch_us(ts) // 86400000000 * {_DAY_MS})::BIGINT) AS gone_at FROM events WHERE event_id % 97 = 0 GROUP BY 1),
log AS (SELECT id, site_id, min(day_at) AS first_seen_at, max(day_at) AS last_seen_at, count(*)::BIGINT AS seen_count FROM day GROUP BY ALL)"""


@query(f"{_SEEN} SELECT log.*, CASE WHEN gone_at IS NULL THEN first_seen_at END AS item_at, CASE WHEN gone_at IS NULL THEN 'Title ' || id END AS title FROM log LEFT JOIN gone USING (id)")
def memory_log(spark, sf_dir):
    checkpoint = remembered(spark, sf_dir)
    items = memory.items(spark, checkpoint).select("id", F.col("crawled_at").alias("item_at"), "title")
    return memory.log(spark, checkpoint).join(items, "id", "left")


@query(f"""{_SEEN}, held AS (SELECT * FROM log WHERE id NOT IN (SELECT id FROM gone))
SELECT site_id, row_number() OVER (PARTITION BY site_id ORDER BY first_seen_at DESC, id DESC)::INT AS place, first_seen_at AS crawled_at, id, count(*) OVER (PARTITION BY site_id) AS n_items FROM held QUALIFY place <= 200""")
def live_newest(spark, sf_dir):
    checkpoint = remembered(spark, sf_dir)
    return memory.newest(spark, checkpoint).join(memory.counts(spark, checkpoint), "site_id")


@query(f"""{_SEEN}, crawl AS (SELECT d.site_id, d.day_at AS crawled_at, count(*) FILTER (d.day_at = l.first_seen_at) AS stored_count, count(*) FILTER (d.day_at > l.first_seen_at) AS skipped_count, count(*) FILTER (d.day_at = g.gone_at) AS deleted_count
  FROM day d JOIN log l ON l.id = d.id LEFT JOIN gone g ON g.id = d.id GROUP BY ALL)
SELECT *, CASE WHEN stored_count > 0 THEN 'success' ELSE 'partial' END AS status, CASE WHEN stored_count = 0 THEN 'NO_ITEMS' END AS error_code,
  crawled_at = max(crawled_at) OVER (PARTITION BY site_id) AS is_latest FROM crawl""")
def live_runs(spark, sf_dir):
    checkpoint = remembered(spark, sf_dir)
    latest = memory.latest_runs(spark, checkpoint).select("site_id", F.col("crawled_at").alias("latest"))
    return memory.runs(spark, checkpoint).join(latest, "site_id").withColumn("is_latest", F.col("crawled_at") == F.col("latest")).drop("latest")


@query("SELECT source AS site_id, n_chars::BIGINT AS crawled_at, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC)::INT AS place FROM documents QUALIFY place <= 200")
def clustered_top_items(spark, sf_dir):
    """Documents, in two parts as they come, clustered by source and length; each source's longest from the ends of its ranges."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("site_id"), F.col("n_chars").cast("bigint").alias("crawled_at"), F.col("doc_id").alias("id"))
    folder = new_folder(spark, "clustered")
    for part in (F.col("id") % 2 == 0, F.col("id") % 2 == 1):
        clustered.append(rows.filter(part), folder)
    return clustered.top_of_each(spark, folder)
