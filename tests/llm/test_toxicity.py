import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import toxicity as T


def maximal(scores):
    """All maximal segments by recursion: the best (shortest, then first), then left and right of it."""
    best = None
    for a in range(len(scores)):
        for b in range(a, len(scores)):
            s = sum(scores[a : b + 1])
            if s > 0 and (best is None or (s, -(b - a), -a) > best[0]):
                best = (s, -(b - a), -a), a, b
    if best is None:
        return []
    _, a, b = best
    return maximal(scores[:a]) + [(a, b, best[0][0])] + [(x + b + 1, y + b + 1, s) for x, y, s in maximal(scores[b + 1 :])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([None, None, 5, 7, 16]), max_size=14))
def test_segments_are_all_maximal_ones(words):
    rest = -4
    scores = [rest if x is None else x for x in words]
    got = T.segments([(i, x) for i, x in enumerate(words) if x is not None], rest)
    assert sorted(s for _, _, s in got) == sorted(s for _, _, s in maximal(scores))
    assert all(sum(scores[a : b + 1]) == s for a, b, s in got)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    documents, labels = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "labels"))
    out = T.toxicity(documents, labels).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    right = [r["predicted"] == r["toxic"] for r in out]
    caught = [r["predicted"] for r in out if r["toxic"]]
    assert len(right) > 500 and sum(right) / len(right) >= 0.97 and sum(r["predicted"] and not r["toxic"] for r in out) <= 3
    assert sum(caught) >= 0.85 * len(caught)


def test_odd_rows(spark):
    bad = "you are a moron and scum number{}"
    rows = [(i, (bad if i % 3 == 0 else "calm words about item{} and more").format(i) + f" x{i} y{i * 7}") for i in range(240)]
    rows += [(900, None), (901, ""), (902, "!!! \n"), (903, "moron " * 30_000), (903, "moron scum"), (904, "calm " * 30_000)]
    documents = spark.createDataFrame([(a, b, "z", 0.5) for a, b in rows], "doc_id long, text string, toxic string, score double")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(200)] + [(5, 0, None), (None, 1, 1), (900, 1, 1), (7777, 1, 0)], "doc_id long, quality int, toxic int")
    out = T.toxicity(documents, labels).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5)
        assert r["predicted"] == int(r["doc_id"] == 903 or r["doc_id"] < 240 and r["doc_id"] % 3 == 0)


def test_without_labels_or_documents(spark):
    documents = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert T.toxicity(documents, labels).select("score", "predicted").collect() == [(0.0, 0)]
    assert T.toxicity(documents.limit(0), labels).count() == 0


def test_rows_without_id(spark):
    documents = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert T.toxicity(documents, labels).select("doc_id", "held_out", "score").collect() == [(None, False, 0.0)] * 2
