import random
from collections import Counter, defaultdict

import pytest

from sluice.streaming import memory

T = 1_700_000_000_000


class Truth:
    """The same rules in dictionaries, row by row."""

    def __init__(self):
        self.items, self.log, self.runs = {}, {}, defaultdict(Counter)

    def batch(self, rows):
        best = {}
        for r in rows:
            kind, ident, site, t = r[:4]
            if kind is None or t is None or ident is None and kind != "crawl":
                continue
            if kind == "crawl":
                self.runs[site, t] += Counter()
                continue
            at = (t, kind == "deleted", ident)
            order = lambda x: (x[4] is not None, x[4] or 0, x[2] is not None, str(x[2]), x[5])
            if at not in best or order(r) > order(best[at]):
                best[at] = r
        for (t, deleted, ident), r in sorted(best.items(), key=lambda x: x[0]):
            site = r[2]
            if deleted:
                if ident in self.items:
                    self.runs[self.items[ident][0], t]["deleted"] += 1
                    del self.items[ident]
            elif ident in self.log:
                own, first, last, n = self.log[ident]
                if t > last:
                    self.log[ident] = (own, first, t, n + 1)
                    self.runs[own, t]["skipped"] += 1
            else:
                self.items[ident] = (site, r[5], t)
                self.log[ident] = (site, t, t, 1)
                self.runs[site, t]["stored"] += 1

    def newest(self, k):
        by_site = defaultdict(list)
        for ident, (site, _, t) in self.items.items():
            by_site[site].append((t, ident))
        return sorted(((site, i, t, x) for site, own in by_site.items() for i, (t, x) in enumerate(sorted(own, reverse=True)[:k], 1)), key=repr)


def row(kind, ident, site, t, pos=0, title="x"):
    return (kind, ident, site, t, pos, title, "https://e.example/", None, None, 1.5, None)


class Stream:
    def __init__(self, spark, folder, k=5):
        self.spark, self.folder, self.k = spark, str(folder), k

    def __call__(self, rows, **more):
        self.spark.createDataFrame(rows, memory.CRAWL).coalesce(2).write.mode("append").parquet(f"{self.folder}/in")
        stream = self.spark.readStream.schema(memory.CRAWL).parquet(f"{self.folder}/in")
        query = memory.remember(stream, f"{self.folder}/checkpoint", k=self.k, shards=3, **more)
        query.awaitTermination()
        return query.lastProgress

    def state(self):
        at = self.spark, f"{self.folder}/checkpoint"
        return {
            "items": sorted((r["id"], r["site_id"], r["title"], r["crawled_at"]) for r in memory.items(*at).collect()),
            "log": sorted((r["id"], r["site_id"], r["first_seen_at"], r["last_seen_at"], r["seen_count"]) for r in memory.log(*at).collect()),
            "counts": {r["site_id"]: r["n_items"] for r in memory.counts(*at).collect() if r["n_items"]},
            "newest": sorted(map(tuple, memory.newest(*at, k=self.k).collect()), key=repr),
            "runs": {(r["site_id"], r["crawled_at"]): (r["stored_count"], r["skipped_count"], r["deleted_count"], r["status"], r["error_code"]) for r in memory.runs(*at).collect()},
        }


def same(state, truth, k=5):
    assert state["items"] == sorted((i, s, title, t) for i, (s, title, t) in truth.items.items())
    assert state["log"] == sorted((i, *x) for i, x in truth.log.items())
    assert state["counts"] == dict(Counter(s for s, _, _ in truth.items.values()))
    assert state["newest"] == truth.newest(k)
    assert state["runs"] == {at: (c["stored"], c["skipped"], c["deleted"], "success" if c["stored"] else "partial", None if c["stored"] else "NO_ITEMS") for at, c in truth.runs.items()}


@pytest.fixture
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_equal_to_recomputation_after_random_batches(spark, tmp_path, few_partitions):
    rng, stream, truth, sent = random.Random(1), Stream(spark, tmp_path), Truth(), []
    for n in range(4):
        t = T + n * 1000
        rows = [row("crawl", None, f"s{rng.randrange(3)}", t)]
        for pos in range(60):
            ident = f"i{rng.randrange(40)}"
            when = t - rng.choice([0, 0, 0, 0, 1000, 2500])  # some come late
            rows.append(row(rng.choice(["seen"] * 4 + ["deleted"]), ident, rng.choice([f"s{int(ident[1:]) % 3}", None]) if n else f"s{int(ident[1:]) % 3}", when, rng.choice([pos, None]), f"title {rng.randrange(5)}"))
        rows += [row("seen", None, "s0", t), row(None, "i1", "s1", t), row("seen", "i1", "s1", None)]
        rows += rng.sample(sent, len(sent) // 2)  # and some again
        sent += rows
        stream(rows)
        truth.batch(rows)
    same(stream.state(), truth)


def test_replays_late_rows_and_restarts_change_no_count(spark, tmp_path, few_partitions):
    stream, truth = Stream(spark, tmp_path), Truth()
    first = [row("seen", f"i{n}", "s", T, n) for n in range(12)]
    second = [row("seen", f"i{n}", "s", T + 10, n) for n in range(6, 18)] + [row("deleted", "i17", "s", T + 10), row("deleted", "i0", "s", T + 10)]
    for rows in (first, second):
        stream(rows)
        truth.batch(rows)
    before = stream.state()
    same(before, truth)
    assert [x[3] for x in before["newest"]] == ["i16", "i15", "i14", "i13", "i12"]  # i17 was taken back
    changed = []
    stream(first + second + [row("seen", "i3", "s", T - 5), row("deleted", "i17", "s", T + 10)], follow=lambda rows, batch: changed.extend(rows.collect()))
    assert stream.state() == before and changed == []
    stream([row("deleted", f"i{n}", "s", T + 20) for n in range(12, 17)], follow=lambda rows, batch: changed.extend(rows.collect()))
    after = stream.state()
    assert [x[3] for x in after["newest"]] == ["i9", "i8", "i7", "i6", "i5"] and after["counts"] == {"s": 11}
    assert sum(r["deleted"] for r in changed) == 5


def test_a_batch_costs_its_own_rows(spark, tmp_path, few_partitions):
    stream = Stream(spark, tmp_path)
    stream([row("seen", f"i{n}", f"s{n % 7}", T, n) for n in range(2000)])
    progress = stream([row("seen", "i1", "s1", T + 1), row("seen", "new", "s1", T + 1)])
    views, memories = progress["stateOperators"]
    assert progress["numInputRows"] == 2
    assert memories["numRowsUpdated"] <= 4  # an item and two rows of the log
    assert views["numRowsUpdated"] <= 2 * 4  # views, times, held and runs of the shards that are concerned


def test_starts_with_what_is_known(spark, tmp_path, few_partitions):
    items = spark.createDataFrame([("a", "s", "A", "u", None, None, 1.0, None, T), ("b", "s", "B", "u", None, None, 1.0, None, T)], "id string, " + memory._ITEM_STATE)
    log = spark.createDataFrame([("a", "s", T, T, 3), ("c", "s", T, T, 1)], "id string, " + memory._LOG_STATE)
    stream = Stream(spark, tmp_path)
    stream([row("seen", x, "s", T + 7) for x in "abcd"], known=memory.known_before(items, log))
    state = stream.state()
    assert state["log"] == [("a", "s", T, T + 7, 4), ("b", "s", T, T + 7, 2), ("c", "s", T, T + 7, 2), ("d", "s", T + 7, T + 7, 1)]
    assert [x[0] for x in state["items"]] == ["a", "b", "d"]


def test_an_empty_stream_leaves_empty_views(spark, tmp_path, few_partitions):
    stream = Stream(spark, tmp_path)
    stream([])
    assert stream.state() == {"items": [], "log": [], "counts": {}, "newest": [], "runs": {}}
