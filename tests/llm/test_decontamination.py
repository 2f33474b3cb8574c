import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import decontamination as D


def least_edits(pattern, text):
    letters, steps = np.array([ord(x) for x in text]), np.arange(len(text) + 1)
    now = np.zeros(len(text) + 1, int)
    for i, x in enumerate(pattern, 1):
        now = np.concatenate([[i], np.minimum(now[:-1] + (letters != ord(x)), now[1:] + 1)])
        now = np.minimum.accumulate(now - steps) + steps
    return int(now.min())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab", min_size=1, max_size=12), st.text(alphabet="ab", max_size=20), st.integers(0, 4))
def test_alignment_over_all_diagonals_is_the_least_edits(pattern, text, budget):
    got = D.alignment(D.codes(pattern), D.codes(text), -len(pattern), len(text), budget)
    assert got == min(least_edits(pattern, text), budget + 1)


def corpus():
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(draw.choice((3, 8, 12, 20, 60)))) for i in range(25)] + [(50, None), (51, " "), (52, "Zq"), (53, "é ü 日本 " * 8), (None, prose(9))]
    rows = [(0, None), (1, ""), (2, "the zq here"), (3, "thezqhere"), (4, "É  Ü\n日本 " * 9)]
    for key in range(10, 90):
        item = draw.choice(items[:25])[1]
        letters = list(item.upper() if key % 5 == 0 else item.replace(" ", " \n"))
        for _ in range(draw.choice((0, 0, 2, 6, 30))):
            letters[draw.randrange(len(letters))] = draw.choice(("", "x", "yy"))
        rows.append((key, prose(30) + " " + "".join(letters) + " " + prose(30) if key % 3 else prose(80)))
    return items, rows


@pytest.mark.parametrize("block,segment,entries", [(D.BLOCK, D.SEGMENT, D.ENTRIES), (200, 64, 50)])
def test_search_equals_brute_force(block, segment, entries, monkeypatch):
    monkeypatch.setattr(D, "ENTRIES", entries)
    items, rows = corpus()
    want = {}
    for key, text in rows:
        text = D.plain(text)
        want[key] = set()
        for item, own in items:
            own = D.plain(own)
            if item is None or not own:
                continue
            if len(own) < D.Q:
                if f" {own} " in f" {text} ":
                    want[key].add(item)
                continue
            bench = D.Benchmark([[item] for _ in D.pieces(own)], D.pieces(own), [], D.Q, D.EDITS)
            if any(least_edits(x, text) <= k for x, k in zip(bench.texts, bench.budget)):
                want[key].add(item)
    got = {key: set() for key, _ in rows}
    known = [x for x in items if x[0] is not None and x[1]]
    step = 25 if block == D.BLOCK else 4
    for a in range(0, len(known), step):
        own = known[a : a + step]
        bench = D.Benchmark([[i] for i, x in own if len(D.plain(x)) >= D.Q for _ in D.pieces(D.plain(x))], [p for _, x in own if len(D.plain(x)) >= D.Q for p in D.pieces(D.plain(x))], [(i, D.plain(x)) for i, x in own if 0 < len(D.plain(x)) < D.Q], D.Q, D.EDITS)
        for (key, _), found in zip(rows, bench.search([D.plain(x) for _, x in rows], segment)):
            got[key] |= found
    assert got == want and sum(map(bool, want.values())) > 30


def test_tables(spark):
    items, rows = corpus()
    documents = spark.createDataFrame([(a, b, "c", 1) for a, b in rows] + [(2, "the zq here", "c", 1)], "doc_id long, text string, items string, row int")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = D.contaminated(documents, benchmark).collect()
    few = list(D.benchmarks(benchmark, D.Q, D.EDITS, 300))
    assert len(few) > 3 and sum(len({i for y in x.items for i in y}) + len(x.short) for x in few) == 27
    kept = D.clean(documents, benchmark)
    assert kept.columns == documents.columns and kept.count() + len(found) == len(rows) + 1
    assert sorted(r["doc_id"] for r in found if r["items"] == "52") == [2, 2]
    assert D.contaminated(documents, benchmark.limit(0)).count() == 0 and D.contaminated(documents.limit(0), benchmark).count() == 0
    assert sorted(D.contaminated(documents, benchmark, block=300).collect()) == sorted(found)
    assert sorted(r["doc_id"] for r in D.clean(documents, benchmark, block=300).collect()) == sorted(r["doc_id"] for r in kept.collect())


def test_every_excerpt_of_the_stated_length_is_found():
    draw = random.Random(6)
    item = " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 8))) for _ in range(60))
    other = " ".join("".join(draw.choice("klmnop") for _ in range(5)) for _ in range(60))
    bench = D.Benchmark([[7] for _ in D.pieces(item)], D.pieces(item), [], D.Q, D.EDITS)
    n = sum(D.SCALES[-1])
    assert n == 80
    texts = [f"{other} {item[a : a + n]}{other}" for a in range(len(item) - n + 1)]
    assert all(x == {7} for x in bench.search(texts)) and bench.search([other, item[:30] + other]) == [set(), set()]


def test_a_phrase_that_many_items_share_costs_little():
    import time
    import tracemalloc

    draw = random.Random(7)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(6))
    phrase = "what is the meaning of a"
    items = [f"{word()} {word()} {phrase} {word()} {word()} {word()}" for _ in range(2000)]
    bench = D.Benchmark([[i] for i in range(len(items))], items, [], D.Q, D.EDITS)
    text = " ".join(f"{phrase} {word()} {word()}" for _ in range(400)) + " " + items[77]
    began = time.time()
    tracemalloc.start()
    assert bench.search([text]) == [{77}]
    assert time.time() - began < 20 and tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
