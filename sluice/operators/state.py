"""Merge with memory: unseen items are inserted, seen ones only logged, deleted ones stay away.

| log | item | items | log row | counted |
| no | no | insert | (t, t, 1) | inserted |
| yes | any | as it is | last = t, count + 1 | skipped |
| no | yes | as it is | (item's time, t, 2) | skipped |
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.ids import item_id
from sluice.functions.text import blank_to_null, clip_snippet, trim_ws
from sluice.functions.urls import normalized_url, preview_url
from sluice.operators.dedupe import keep_last

ITEMS = "id string, site_id string, title string, url string, preview_image_url string, summary string, price double, raw_html_snippet string, crawled_at bigint"
LOG = "id string, site_id string, item_id string, first_seen_at bigint, last_seen_at bigint, seen_count bigint"
RUNS = "run_id string, site_id string, started_at bigint, finished_at bigint, status string, item_count bigint, error_code string"


def normalised(parsed: DataFrame, crawled_at: int) -> DataFrame:
    """Items out of parsed rows (site_id, pos, title, url and the optional columns); rows without title or url go."""
    rows = parsed.withColumn("title", trim_ws("title")).withColumn("url", normalized_url("url")).filter("title <> '' AND url <> ''")
    return rows.select(
        item_id("site_id", "url", "title", "dedupe_key").alias("id"), "site_id", "pos", "title", "url",
        preview_url("preview_image_url").alias("preview_image_url"), blank_to_null(trim_ws("summary")).alias("summary"),
        F.col("price").cast("double").alias("price"), clip_snippet("raw_html_snippet").alias("raw_html_snippet"), F.lit(crawled_at).cast("bigint").alias("crawled_at"),
    )


def one_batch(items: DataFrame) -> DataFrame:
    return keep_last(items, [], F.col("id"))


@dataclass
class Merged:
    items: DataFrame
    log: DataFrame
    decided: DataFrame  # the batch with is_fresh


def decide(batch: DataFrame, items: DataFrame, log: DataFrame) -> DataFrame:
    """The batch with what items and log know of each id; both sides join on id, once."""
    old = items.select("id", F.col("crawled_at").alias("item_at"))
    seen = log.select("id", "first_seen_at", "last_seen_at", "seen_count")
    return batch.join(old, "id", "left").join(seen, "id", "left").withColumn("is_fresh", F.col("item_at").isNull() & F.col("seen_count").isNull())


def merge(batch: DataFrame, items: DataFrame, log: DataFrame) -> Merged:
    """New items and log for a batch that holds each id once."""
    decided = decide(batch, items, log)
    fresh = decided.filter("is_fresh").select(*items.columns)
    logged = decided.select(
        "id", "site_id", F.col("id").alias("item_id"),
        F.coalesce("first_seen_at", "item_at", "crawled_at").alias("first_seen_at"),
        F.col("crawled_at").alias("last_seen_at"),
        F.when(F.col("seen_count").isNotNull(), F.col("seen_count") + 1).when(F.col("item_at").isNotNull(), 2).otherwise(1).cast("bigint").alias("seen_count"),
    )
    rest = log.join(batch.select("id"), "id", "left_anti")
    return Merged(items.unionByName(fresh), rest.select(*log.columns).unionByName(logged.select(*log.columns)), decided)


def deleted(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Items without the given ids; the log keeps them."""
    return items.join(ids.select("id"), "id", "left_anti").select(*items.columns)


def run_summary(decided: DataFrame, parsed_count: int) -> DataFrame:
    """parsed, stored and skipped counts, status and error code of one crawl."""
    counts = decided.agg(F.count_if("is_fresh").alias("stored_count"), F.count_if(~F.col("is_fresh")).alias("skipped_count"))
    return counts.select(F.lit(parsed_count).cast("bigint").alias("parsed_count"), "stored_count", "skipped_count", *run_status(F.col("stored_count")))


def run_status(stored, failed=None, code=None) -> tuple:
    """Success where something was stored, else partial with NO_ITEMS; failed runs keep their own code."""
    status = F.when(stored > 0, "success").otherwise("partial")
    error = F.when(stored == 0, "NO_ITEMS")
    if failed is not None:
        status, error = F.when(failed, "failed").otherwise(status), F.when(failed, F.coalesce(code, F.lit("UNKNOWN"))).otherwise(error)
    return status.alias("status"), error.alias("error_code")
