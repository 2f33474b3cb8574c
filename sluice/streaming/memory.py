"""Memory of crawls as keyed state: one streaming query that costs what a batch holds, and views that follow it.

Rows of crawls come as a stream: kind ('seen', 'deleted' or 'crawl'), id, site_id, crawled_at and the columns of an item. Two stateful
operators keep what they say, each with its own keys, in the state store of one checkpoint:

* `Memory`, by id: the item and its log row. A time that the log has passed changes nothing, so a batch that comes again, in whole or in
  part, and a late row leave every count as it is. A deleted item stays away, its log stays.
* `Newest`, by site and shard: how many items there are, the newest of them, and what each crawl stored and skipped. Changes of
  items arrive as rows of `Memory`; a deletion takes its item back and the next one moves up.

A batch reads and writes the state of its own ids, and of its sites' shards the crawl times that it touches. A site is split into shards by a hash
of the id, so that no task holds a large site. Readers (`items`, `log`, `counts`, `newest`, `runs`) read the state as tables.

Nulls: rows without id that are no 'crawl', without kind or without crawled_at say nothing. A null site is a site of its own. Of rows of one id and time the
one with the greatest pos counts, ties by its columns; a deletion of that time comes after. An empty stream leaves empty views.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from sluice.operators.state import run_status

ITEM = ("title", "url", "preview_image_url", "summary", "price", "raw_html_snippet")
_ITEM_STATE = "site_id string, title string, url string, preview_image_url string, summary string, price double, raw_html_snippet string, crawled_at bigint"
_LOG_STATE = "site_id string, first_seen_at bigint, last_seen_at bigint, seen_count bigint"
#: Columns of the rows that a crawl brings.
CRAWL = "kind string, id string, site_id string, crawled_at bigint, pos bigint, title string, url string, preview_image_url string, summary string, price double, raw_html_snippet string"
#: Rows of changes: decision is insert, repeat, tombstone, relog, deleted or crawl; item_at is the time by which the item is listed.
CHANGE = "id string, site_id string, crawled_at bigint, item_at bigint, decision string"
_VIEW = "site_id string, shard int, n bigint, stored bigint, skipped bigint, deleted bigint"
#: Newest items that a view holds, and shards of a site.
NEWEST, SHARDS = 200, 8
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",  # a batch writes its own changes, not the store
}
#: The state reader counts operators from the last one of the query.
_OPERATOR = {"item": 1, "log": 1, "view": 0, "runs": 0}


_EMPTY = {
    "item": f"key struct<key string>, value struct<{_ITEM_STATE}>",
    "log": f"key struct<key string>, value struct<{_LOG_STATE}>",
    "view": "key struct<site_id string, shard int>, value struct<n bigint, newest array<struct<crawled_at bigint, id string>>>",
    "runs": "key struct<site_id string, shard int>, user_map_key struct<crawled_at bigint>, user_map_value struct<stored bigint, skipped bigint, deleted bigint>",
}


class Memory(StatefulProcessor):
    """Item and log row of one id."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.item = handle.getValueState("item", _ITEM_STATE)
        self.log = handle.getValueState("log", _LOG_STATE)

    def handleInitialState(self, key, state: Row, timerValues) -> None:  # noqa: N802, N803
        """An item or a log row that is known from before; one that is not comes as a row of nulls."""
        for held, row in ((self.item, state.item), (self.log, state.log)):
            values = tuple(row.values() if isinstance(row, dict) else row or (None,))
            if values[-1] is not None:
                held.update(values)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        at: dict[tuple[int, bool], Row] = {}
        for r in rows:
            when = (r.crawled_at, r.kind == "deleted")
            if when not in at or _later(r, at[when]):
                at[when] = r
        item = self.item.get() if self.item.exists() else None
        log = self.log.get() if self.log.exists() else None
        had_item, had_log = item, log
        for t, deleted in sorted(at):
            row = at[t, deleted]
            if row.kind == "crawl":
                if log is None:
                    log = (row.site_id, t, t, 1)
                    yield Row(id=None, site_id=row.site_id, crawled_at=t, item_at=None, decision="crawl")
            elif deleted:
                if item is not None:
                    yield Row(id=key[0], site_id=item[0], crawled_at=t, item_at=item[-1], decision="deleted")
                    item = None
            elif log is not None:
                if t > log[2]:
                    log = (log[0], log[1], t, log[3] + 1)
                    yield Row(id=key[0], site_id=log[0], crawled_at=t, item_at=None, decision="repeat" if item is not None else "tombstone")
            elif item is not None:
                if t > item[-1]:
                    log = (item[0], item[-1], t, 2)
                    yield Row(id=key[0], site_id=item[0], crawled_at=t, item_at=None, decision="relog")
            else:
                item = (row.site_id, *(row[c] for c in ITEM), t)
                log = (row.site_id, t, t, 1)
                yield Row(id=key[0], site_id=row.site_id, crawled_at=t, item_at=t, decision="insert")
        if item != had_item:
            self.item.update(item) if item is not None else self.item.clear()
        if log != had_log:
            self.log.update(log)

    def close(self) -> None:
        pass


def _later(a: Row, b: Row) -> bool:
    """Whether a counts before b of the same id and time."""
    order = lambda r: (r.pos is not None, r.pos or 0, [(r[c] is not None, str(r[c])) for c in ("site_id", *ITEM)])
    return order(a) > order(b)


class Newest(StatefulProcessor):
    """Count, newest items and crawls of one shard of a site."""

    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.view = handle.getValueState("view", "n bigint, newest array<struct<crawled_at:bigint,id:string>>")
        self.held = handle.getMapState("held", "crawled_at bigint", "ids array<string>")
        self.times = handle.getValueState("times", "at array<bigint>")
        self.runs = handle.getMapState("runs", "crawled_at bigint", "stored bigint, skipped bigint, deleted bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        moved: dict[int, tuple[set, set]] = {}
        runs: dict[int, list[int]] = {}
        for r in rows:
            run = runs.setdefault(r.crawled_at, [0, 0, 0])
            if r.decision == "insert":
                run[0] += 1
                moved.setdefault(r.item_at, (set(), set()))[0].add(r.id)
            elif r.decision == "deleted":
                run[2] += 1
                moved.setdefault(r.item_at, (set(), set()))[1].add(r.id)
            elif r.decision != "crawl":
                run[1] += 1
        for t, own in runs.items():
            old = self.runs.getValue((t,)) if self.runs.containsKey((t,)) else (0, 0, 0)
            self.runs.updateValue((t,), tuple(a + b for a, b in zip(old, own)))
        n, newest = self.view.get() if self.view.exists() else (0, [])
        newest = [tuple(x) for x in newest]
        if moved:
            times = set(self.times.get()[0]) if self.times.exists() else set()
            n += self._move(moved, times)
            self.times.update((sorted(times),))
            newest = self._first(times)
        self.view.update((n, newest))
        total = [sum(x) for x in zip(*runs.values())]
        yield Row(site_id=key[0], shard=key[1], n=n, stored=total[0], skipped=total[1], deleted=total[2])

    def _move(self, moved: dict[int, tuple[set, set]], times: set[int]) -> int:
        """Put and take the items of each time that changed; by how much the count grew."""
        grown = 0
        for t, (put, taken) in moved.items():
            old = set(self.held.getValue((t,))[0]) if t in times else set()
            now = (old | put) - taken
            grown += len(now) - len(old)
            if now:
                self.held.updateValue((t,), (sorted(now),))
                times.add(t)
            elif t in times:
                self.held.removeKey((t,))
                times.remove(t)
        return grown

    def _first(self, times: set[int]) -> list[tuple[int, str]]:
        """The newest items, read from the latest time on until there are enough."""
        out: list[tuple[int, str]] = []
        for t in sorted(times, reverse=True):
            if len(out) >= self.k:
                break
            out += [(t, x) for x in sorted(self.held.getValue((t,))[0], reverse=True)[: self.k - len(out)]]
        return out

    def close(self) -> None:
        pass


def changes(crawls: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The changes that a stream of crawls makes; known (id, item, log) is what is remembered from before the first batch."""
    rows = crawls.filter("crawled_at IS NOT NULL AND (kind = 'crawl' OR kind IN ('seen', 'deleted') AND id IS NOT NULL)")
    own = F.when(F.col("kind") == "crawl", F.concat_ws(":", F.lit("crawl"), F.coalesce("site_id", F.lit("")), F.col("crawled_at").cast("string"))).otherwise(F.concat(F.lit("item:"), "id"))
    keyed = rows.withColumn("key", own).groupBy("key")
    start = known.withColumn("key", F.concat(F.lit("item:"), "id")).groupBy("key") if known is not None else None
    out = keyed.transformWithState(statefulProcessor=Memory(), outputStructType=CHANGE, outputMode="Append", timeMode="None", initialState=start)
    return out.withColumn("id", F.substring("id", len("item:") + 1, 1 << 30))


def known_before(items: DataFrame, log: DataFrame) -> DataFrame:
    """What the tables of items and log remember, as the state that a query begins with."""
    names = [x.split(" ")[0] for x in _ITEM_STATE.split(", ")]
    own = items.select("id", F.struct(*names).alias("item"))
    seen = log.select("id", F.struct("site_id", "first_seen_at", "last_seen_at", "seen_count").alias("log"))
    return own.join(seen, "id", "full").select("id", "item", "log")


def remember(crawls: DataFrame, checkpoint: str, known: DataFrame | None = None, follow: Callable[[DataFrame, int], None] | None = None, k: int = NEWEST, shards: int = SHARDS) -> StreamingQuery:
    """Start the query over all that is there. follow(rows, batch) gets the shards that a batch changed, with their new counts."""
    spark = crawls.sparkSession
    dealt = changes(crawls, known).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    views = dealt.groupBy("site_id", "shard").transformWithState(statefulProcessor=Newest(k), outputStructType=_VIEW, outputMode="Append", timeMode="None")
    before = {x: spark.conf.get(x, None) for x in _SETTINGS}
    for name, value in _SETTINGS.items():
        spark.conf.set(name, value)
    try:
        return views.writeStream.foreachBatch(follow or (lambda rows, batch: rows.write.format("noop").mode("overwrite").save())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """One state variable as a table: its key's columns and its value's, as of the last batch; empty before the first."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits/0")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        return spark.createDataFrame([], _EMPTY[name])
    return spark.read.format("statestore").option("operatorId", _OPERATOR[name]).option("stateVarName", name).load(checkpoint)


def items(spark: SparkSession, checkpoint: str) -> DataFrame:
    return state(spark, checkpoint, "item").select(F.substring("key.key", len("item:") + 1, 1 << 30).alias("id"), "value.*")


def log(spark: SparkSession, checkpoint: str) -> DataFrame:
    own = state(spark, checkpoint, "log").filter(F.col("key.key").startswith("item:"))
    return own.select(F.substring("key.key", len("item:") + 1, 1 << 30).alias("id"), "value.*")


def counts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """site_id and its number of items."""
    return state(spark, checkpoint, "view").groupBy(F.col("key.site_id").alias("site_id")).agg(F.sum("value.n").alias("n_items"))


def newest(spark: SparkSession, checkpoint: str, k: int = NEWEST) -> DataFrame:
    """site_id, place, crawled_at, id of each site's newest items: those of its shards, merged."""
    each = state(spark, checkpoint, "view").select(F.col("key.site_id").alias("site_id"), F.explode("value.newest").alias("x")).select("site_id", "x.*")
    order = Window.partitionBy("site_id").orderBy(F.desc("crawled_at"), F.desc("id"))
    return each.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select("site_id", "place", "crawled_at", "id")


def runs(spark: SparkSession, checkpoint: str) -> DataFrame:
    """site_id, crawled_at, stored, skipped and deleted counts, status and error code of each crawl."""
    each = state(spark, checkpoint, "runs").select(F.col("key.site_id").alias("site_id"), F.col("user_map_key.crawled_at").alias("crawled_at"), "user_map_value.*")
    whole = each.groupBy("site_id", "crawled_at").agg(*(F.sum(c).alias(f"{c}_count") for c in ("stored", "skipped", "deleted")))
    return whole.select("*", *run_status(F.col("stored_count")))


def latest_runs(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Each site's last crawl."""
    every = runs(spark, checkpoint)
    return every.groupBy("site_id").agg(F.max_by(F.struct(*(c for c in every.columns if c != "site_id")), "crawled_at").alias("r")).select("site_id", "r.*")
