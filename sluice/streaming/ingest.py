"""Incremental ingest: each micro-batch is one crawl that is merged into the store."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.state import RUNS, run_status
from sluice.sources.store import Store


def ingest(stream: DataFrame, store: Store, normalise: Callable[[DataFrame, int], DataFrame], checkpoint: str, clock: Callable[[int], int] | None = None, views: Callable[[Store], None] | None = None):
    """Start a query that upserts each micro-batch, puts a run for each of its sites and refreshes the views.

    Items, log and runs change in one commit. A run's id begins with its batch id, so a batch that comes again after
    a failure finds its runs and is not merged twice. clock gives the crawl time in ms, the wall clock by default.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        run = f"batch-{batch_id}"
        if not store.read("crawl_runs").filter(F.split_part("run_id", F.lit(":"), F.lit(1)) == run).isEmpty():
            return
        now = clock(batch_id) if clock else time.time_ns() // 1_000_000

        def runs(decided: DataFrame | None) -> DataFrame:
            if decided is None:
                return batch.sparkSession.createDataFrame([(run, None, now, now, "partial", 0, "NO_ITEMS")], RUNS)
            of_site = decided.groupBy("site_id").agg(F.count_if("is_fresh").alias("item_count"))
            at = F.lit(now).cast("bigint")
            return of_site.select(F.concat(F.lit(f"{run}:"), F.coalesce("site_id", F.lit(""))).alias("run_id"), "site_id", at.alias("started_at"), at.alias("finished_at"), *run_status(F.col("item_count")), F.col("item_count")).select("run_id", "site_id", "started_at", "finished_at", "status", "item_count", "error_code")

        store.upsert(normalise(batch, now), runs=runs)
        if views:
            views(store)

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
