import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import warc


def test_surt():
    assert warc.surt("http://u@WWW.a.com:80/x?y#z") == "com,a,www)/x?y"
    assert warc.surt(None) == ")/" and warc.surt("https://b.org") == "org,b)/"


ROWS = [(1, "http://a.com/1", "x" * 100), (2, "http://a.com/2", "x" * 100), (0, "http://b.com/ü\t", "x" * 99), (7, None, "x" * 99), (5, "http://a.com/2", "é" * 50), (3, "u", "é" * 50), (3, "u", "é" * 50), (8, "http://b.com/%09\r\nX: y", None), (9, "e", ""), (None, "n", "WARC/1.1\r\n\r\n" * 40)]


def expected():
    firsts = {}
    for i, _, h in ROWS:
        if i is not None:
            firsts[h or ""] = min(firsts.get(h or "", i), i)
    for i, url, h in ROWS:
        b = (h or "").encode()
        to = firsts[h] if len(b) >= 100 and i is not None and firsts[h] != i else None
        yield i, url, len(b), hashlib.sha256(b).hexdigest(), "revisit" if to is not None else "response", to


@pytest.mark.parametrize("block", [3000, 2])
def test_round_trip(spark, tmp_path, block):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 AS file", "'x' AS digest", "2 AS k")
    parts = warc.index(warc.write(pages, str(tmp_path)).persist(), str(tmp_path), block).persist()
    key = lambda r: tuple(str(x) for x in r)
    got = warc.captures(pages.union(pages), parts, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(expected(), key=key)
    some = warc.captures(pages.filter("url = 'u'"), parts, str(tmp_path)).collect()
    assert [r["page_id"] for r in some] == [3, 3]
    held = parts.collect()
    assert sorted(x["page_id"] for x in warc.lookup(held, str(tmp_path), "http://a.com/2")) == [2, 5]
    assert warc.lookup(held, str(tmp_path), "http://zz.com/") == [] and len(warc.lookup(held, str(tmp_path), "u")) == 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", max_size=2), max_size=30), st.integers(1, 4), st.text("abcd", max_size=2))
def test_binary_search_reaches_every_stretch_with_the_key(keys, size, key):
    keys = sorted(keys)
    stretches = [keys[i : i + size] for i in range(0, len(keys), size)]
    found = warc.reach([x[0] for x in stretches], key)
    assert {i for i, x in enumerate(stretches) if key in x} <= set(found)
    assert len([i for i in found if key not in stretches[i]]) <= 1
    lines = [[x] for x in keys]
    assert len(warc.of_key(lines, keys, key)) == keys.count(key)


def test_nothing_is_left(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    assert warc.round_trip(pages, str(tmp_path / "w")).count() == len(ROWS) and not (tmp_path / "w").exists()


def test_a_torn_payload_is_an_error():
    whole = warc.record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None)
    assert warc.parse(whole)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse(whole.replace(b"abc", b"abd"))


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(pages, str(tmp_path)).count() == 0
