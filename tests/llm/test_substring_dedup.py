import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import substring_dedup as S


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    for key, b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        yield key, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=60), st.integers(1, 9))
def test_first_smallest_in_each_window(values, width):
    h = np.array(values, dtype=np.uint64)
    if len(h) >= width:
        assert S.smallest(h, width).tolist() == [i + int(h[i : i + width].argmin()) for i in range(len(h) - width + 1)]


def corpus():
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 6)))
    passage = [" ".join(word() for _ in range(n)) for n in (3, 12, 40)]
    out = [None, "", "a", "é" * 200, "a" * 300, "ab" * 90, passage[2], passage[2]]
    for _ in range(60):
        parts = [" ".join(word() for _ in range(draw.randint(1, 12))) if draw.random() < 0.6 else draw.choice(passage) for _ in range(draw.randint(1, 5))]
        out.append(" ".join(parts))
    for _ in range(15):
        text = list(out[-1])
        text[draw.randrange(len(text))] = "X"
        out.append("".join(text))
    return [*enumerate(out), (3, "é" * 200), (6, passage[1]), (None, passage[2])]


@pytest.mark.parametrize("length,gram,more", [(20, 4, {}), (20, 4, {"hot": 1}), (33, 8, {"segment": 64}), (200, 32, {})])
def test_equals_brute_force(spark, length, gram, more):
    rows = corpus()
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, kd int, th string")
    got = [tuple(r) for r in S.deduplicated(frame, length, gram, **more).collect()]
    order = lambda r: tuple(map(str, r))
    assert sorted(got, key=order) == sorted(brute(rows, length), key=order)


def test_empty_table(spark):
    assert S.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0
