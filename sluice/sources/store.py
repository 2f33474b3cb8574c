"""Snapshot store for items, log and runs: a change writes the buckets that it touches, then one pointer moves.

Each table is dealt to buckets by a hash of its key. A snapshot is a manifest that names the folder of each bucket, so
what a change leaves alone is neither read nor written, and several tables change together. Old snapshots
and the folders that only they name are deleted after KEPT more commits.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.state import ITEMS, LOG, RUNS, Merged, deleted, merge, one_batch, run_summary

TABLES = {"items": ITEMS, "item_log": LOG, "crawl_runs": RUNS}
KEYS = {"items": "id", "item_log": "id", "crawl_runs": "run_id"}
#: Snapshots that readers may still use.
KEPT = 2


class Store:
    """One writer per store. Readers see the snapshot that the pointer names."""

    def __init__(self, spark: SparkSession, folder: str, parts: int | None = None):
        """parts: buckets of a new store; an existing one keeps its own."""
        self.spark, self.folder = spark, folder.rstrip("/")
        now = self._manifest()
        self.parts = now["parts"] if now else parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _pointers(self) -> list[str]:
        """Names current-<step>-<snapshot>, oldest first."""
        return sorted(x.getPath().getName() for x in self._files().globStatus(self._path("current-*")) or [])

    def snapshot(self) -> str | None:
        names = self._pointers()
        return names[-1].split("-", 2)[2] if names else None

    def _manifest(self, name: str | None = None) -> dict | None:
        name = name or self.snapshot()
        if name is None:
            return None
        stream = self._files().open(self._path(f"manifest-{name}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _put(self, name: str, body: bytes) -> None:
        stream = self._files().create(self._path(name), False)
        try:
            stream.write(body)
        finally:
            stream.close()

    def bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def read(self, table: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """The whole table, or some of its buckets."""
        held = (self._manifest() or {"tables": {}})["tables"].get(table, {})
        paths = [f"{self.folder}/{p}" for b, p in sorted(held.items()) if buckets is None or int(b) in set(buckets)]
        return self.spark.read.schema(TABLES[table]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[table])

    def commit(self, buckets: dict[str, list[int]] | None = None, **tables: DataFrame) -> None:
        """Replace the tables, or those of their buckets that are given, in one step: the creation of the pointer file."""
        name = uuid.uuid4().hex
        old = self._manifest()
        manifest = {"parts": self.parts, "tables": {t: dict(x) for t, x in (old or {"tables": {}})["tables"].items()}}
        for table, rows in tables.items():
            touched = (buckets or {}).get(table)
            dealt = rows.select(*rows.columns, self.bucket(KEYS[table]).alias("bucket")).repartition(min(self.parts, len(touched) if touched is not None else self.parts) or 1, "bucket")
            dealt.write.partitionBy("bucket").parquet(f"{self.folder}/{name}/{table}")
            held = {} if touched is None else {b: p for b, p in manifest["tables"].get(table, {}).items() if int(b) not in set(touched)}
            for x in self._files().globStatus(self._path(f"{name}/{table}/bucket=*")) or []:
                folder = x.getPath().getName()
                held[folder.removeprefix("bucket=")] = f"{name}/{table}/{folder}"
            manifest["tables"][table] = held
        self._put(f"manifest-{name}.json", json.dumps(manifest).encode())
        step = int(self._pointers()[-1].split("-")[1]) if self._pointers() else 0
        self._put(f"current-{step + 1:09d}-{name}", b"")
        self._expire()

    def _expire(self) -> None:
        names = self._pointers()
        gone, kept = names[:-KEPT], names[-KEPT:]
        used = {p for x in kept for t in self._manifest(x.split("-", 2)[2])["tables"].values() for p in t.values()}
        for x in gone:
            own = x.split("-", 2)[2]
            stale = {p for t in self._manifest(own)["tables"].values() for p in t.values()} - used
            for p in (*stale, x, f"manifest-{own}.json"):
                self._files().delete(self._path(p), True)

    def touched(self, rows: DataFrame, key: str) -> list[int]:
        """Buckets of the rows: at most as many as the store has."""
        return [r["b"] for r in rows.select(self.bucket(key).alias("b")).distinct().collect()]

    def upsert(self, items: DataFrame, parsed_count: int | None = None, runs: Callable[[DataFrame | None], DataFrame] | None = None) -> tuple[int, int]:
        """Merge a batch of normalised items; inserted and skipped counts. An empty batch leaves items and log as they are.

        runs makes run rows out of the decided batch (None where it is empty), which the same commit puts by run_id.
        """
        batch = one_batch(items).drop("pos", "first_pos").persist()
        decided = None
        try:
            tables, buckets, counts = {}, {}, (0, 0)
            own = self.touched(batch, "id")
            if own:
                merged: Merged = merge(batch, self.read("items", own), self.read("item_log", own))
                decided = merged.decided.persist()
                row = run_summary(decided, parsed_count or 0).first()
                counts = row["stored_count"], row["skipped_count"]
                tables |= {"item_log": merged.log} | ({"items": merged.items} if counts[0] else {})
                buckets |= {"items": own, "item_log": own}
            if runs:
                rows = runs(decided)
                tables["crawl_runs"], buckets["crawl_runs"] = self._with_runs(rows)
            if tables:
                self.commit(buckets, **tables)
            return counts
        finally:
            batch.unpersist()
            if decided is not None:
                decided.unpersist()

    def _with_runs(self, run: DataFrame) -> tuple[DataFrame, list[int]]:
        own = self.touched(run, "run_id")
        old = self.read("crawl_runs", own)
        return old.join(run.select("run_id"), "run_id", "left_anti").select(*old.columns).unionByName(run), own

    def save_run(self, run: DataFrame) -> None:
        """Put by run_id: the new row replaces an old one."""
        rows, own = self._with_runs(run)
        self.commit({"crawl_runs": own}, crawl_runs=rows)

    def delete(self, ids: DataFrame) -> None:
        own = self.touched(ids, "id")
        if own:
            self.commit({"items": own}, items=deleted(self.read("items", own), ids))

    def clear(self) -> None:
        self.commit(**{t: self.spark.createDataFrame([], ddl) for t, ddl in TABLES.items()})


def page_source(pages: DataFrame) -> DataFrame:
    """html with its fallback, and the API body where it looks like JSON; pages with neither are marked."""
    out = pages.withColumn("html", F.coalesce("html", "fallback_html")) if "fallback_html" in pages.columns else pages
    if "api_payload" in pages.columns:
        body = F.btrim("api_payload", F.lit(" \t\r\n"))
        out = out.withColumn("api_payload", F.when(body.rlike(r"^[{\[]"), body))
    return out.withColumn("source_error", F.when(F.col("html").isNull(), "CONTENT_SCRIPT_UNAVAILABLE"))


def parser_input(pages: DataFrame, api_parsers: tuple[str, ...]) -> DataFrame:
    """input: the API body for parsers that prefer it, where there is one, else the html."""
    return pages.withColumn("input", F.when(F.col("parser_id").isin(*api_parsers), F.coalesce("api_payload", "html")).otherwise(F.col("html")))
