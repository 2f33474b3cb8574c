import pandas as pd
import pytest

from sluice.operators import state
from sluice.sources.store import Store, page_source, parser_input

PARSED = "site_id string, pos int, title string, url string, dedupe_key string, preview_image_url string, summary string, price double, raw_html_snippet string"


def batch(spark, now, *rows):
    rows = [(r.get("site", "s"), i, r.get("title", "T"), r.get("url", "https://a.org/1"), r.get("key"), r.get("preview"), r.get("summary"), None, None) for i, r in enumerate(rows)]
    return state.normalised(spark.createDataFrame(rows, PARSED), now)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), parts=2)


def log(store):
    return sorted((r["first_seen_at"], r["last_seen_at"], r["seen_count"]) for r in store.read("item_log").collect())


def test_new_then_repeat(spark, store):
    assert store.upsert(batch(spark, 100, {"summary": "one"})) == (1, 0)
    assert store.upsert(batch(spark, 200, {"summary": "two"})) == (0, 1)
    rows = store.read("items").collect()
    assert [(r["summary"], r["crawled_at"]) for r in rows] == [("one", 100)] and log(store) == [(100, 200, 2)]


def test_duplicates_in_a_batch_last_wins_and_count_once(spark, store):
    assert store.upsert(batch(spark, 100, {"summary": "one"}, {"title": " t ", "url": "HTTPS://A.org/1", "summary": "two"})) == (1, 0)
    assert store.read("items").first()["summary"] == "two" and log(store) == [(100, 100, 1)]


def test_mixed_batch_and_empty_batch(spark, store):
    store.upsert(batch(spark, 100, {}))
    assert store.upsert(batch(spark, 200, {}, {"url": "https://a.org/2"})) == (1, 1)
    before = store.snapshot()
    assert store.upsert(batch(spark, 300, {"title": "  "})) == (0, 0) and store.snapshot() == before


def test_item_without_log(spark, store):
    items = batch(spark, 50, {}).drop("pos")
    store.commit(items=items)
    assert store.upsert(batch(spark, 100, {})) == (0, 1) and log(store) == [(50, 100, 2)]


def test_deleted_items_stay_away(spark, store):
    store.upsert(batch(spark, 100, {}))
    store.delete(store.read("items").select("id"))
    assert store.upsert(batch(spark, 200, {})) == (0, 1)
    assert store.read("items").count() == 0 and log(store) == [(100, 200, 2)]
    store.clear()
    assert store.upsert(batch(spark, 300, {})) == (1, 0)


def test_identity_prefers_the_dedupe_key_and_keeps_sites_apart(spark):
    ids = [r["id"] for r in batch(spark, 1, {"key": " K "}, {"key": "k", "title": "other"}, {"key": "k", "site": "z"}, {"key": " "}, {}).orderBy("pos").collect()]
    assert ids[0] == ids[1] and ids[2] != ids[0] and ids[3] == ids[4] != ids[0]


def test_normalised_fields(spark):
    row = batch(spark, 1, {"summary": " " + "x" * 300, "preview": "data:image/png", "title": " T\t"}).first()
    assert row["summary"] == "x" * 300 and row["preview_image_url"] is None and row["title"] == "T"


def test_commits_touch_only_their_buckets_and_old_snapshots_go(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), parts=16)
    store.upsert(batch(spark, 100, *({"url": f"https://a.org/{i}"} for i in range(40))))
    before = store._manifest()["tables"]["items"]
    store.upsert(batch(spark, 200, {"url": "https://a.org/new"}))
    after = store._manifest()["tables"]["items"]
    assert len(before) > 8 and sum(before.get(b) != p for b, p in after.items()) == 1
    for i in range(4):
        store.upsert(batch(spark, 300 + i, {"url": "https://a.org/new"}))
    assert len(store._pointers()) == 2 and len(list((tmp_path / "store").glob("manifest-*.json"))) == 2
    assert store.read("items").count() == 41 and Store(spark, str(tmp_path / "store"), parts=3).parts == 16
    assert store.read("item_log").filter("seen_count = 5").count() == 1


def test_runs_are_put_by_id(spark, store):
    row = lambda status: spark.createDataFrame([("r", "s", 1, 2, status, 0, None)], state.RUNS)
    store.save_run(row("failed"))
    store.save_run(row("success"))
    assert [r["status"] for r in store.read("crawl_runs").collect()] == ["success"]


def test_sources(spark):
    pages = spark.createDataFrame([(1, None, "f", " [1] ", "api"), (2, "h", None, "<html>", "api"), (3, None, None, "{}", "html")], "page_id long, html string, fallback_html string, api_payload string, parser_id string")
    got = {r["page_id"]: (r["input"], r["source_error"]) for r in parser_input(page_source(pages), ("api",)).collect()}
    assert got == {1: ("[1]", None), 2: ("h", None), 3: (None, "CONTENT_SCRIPT_UNAVAILABLE")}


def test_stream_equals_the_fold_of_its_files(spark, tmp_path):
    from sluice.streaming.ingest import ingest

    for i, urls in enumerate((["https://a.org/1", "https://a.org/2"], ["https://a.org/2"], ["https://a.org/3", "https://a.org/1"])):
        rows = pd.DataFrame({"site_id": "s", "pos": range(len(urls)), "title": "T", "url": urls}).assign(dedupe_key=None, preview_image_url=None, summary=None, price=None, raw_html_snippet=None)
        spark.createDataFrame(rows, PARSED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(PARSED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store, seen = Store(spark, str(tmp_path / "store"), parts=2), []
    ingest(stream, store, state.normalised, str(tmp_path / "ck"), clock=lambda i: 100 * (i + 1), views=lambda s: seen.append(s.read("items").count())).awaitTermination()
    assert store.read("items").count() == 3 and sum(r[2] for r in log(store)) == 5
    runs = store.read("crawl_runs").orderBy("run_id").collect()
    assert [(r["run_id"], r["site_id"], r["item_count"], r["status"]) for r in runs] == [("batch-0:s", "s", 2, "success"), ("batch-1:s", "s", 0, "partial"), ("batch-2:s", "s", 1, "success")] and seen[-1] == 3


def test_a_crash_between_commit_and_checkpoint_counts_once(spark, tmp_path):
    from sluice.streaming.ingest import ingest

    rows = pd.DataFrame({"site_id": ["s", "z"], "pos": [0, 1], "title": "T", "url": "https://a.org/1"}).assign(dedupe_key=None, preview_image_url=None, summary=None, price=None, raw_html_snippet=None)
    spark.createDataFrame(rows, PARSED).coalesce(1).write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"), parts=2)

    def run(views=None):
        stream = spark.readStream.schema(PARSED).parquet(str(tmp_path / "in"))
        ingest(stream, store, state.normalised, str(tmp_path / "ck"), views=views).awaitTermination()

    def crash(_):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run(crash)
    run()
    assert [r[2] for r in log(store)] == [1, 1] and store.read("items").count() == 2
    assert sorted(r["run_id"] for r in store.read("crawl_runs").collect()) == ["batch-0:s", "batch-0:z"]
