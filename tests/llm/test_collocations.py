import random
import re
from collections import Counter, defaultdict

import pytest

from sluice.llm.collocations import _bitmap, _word_slots, collocations, frequent_phrases

SCHEMA = "doc_id bigint, text string, lang string"


def brute(rows, most, least, percent, first):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, most + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, of in counts.items():
        candidates = {p: a for p, a in of.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            holds = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and 100 * f >= percent * a and holds(q) for q, f in candidates.items()):
                continue
            score, k = min((1000 * a * totals[lang] // (of[p[:k]] * of[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), of[p[:k]], of[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def texts(seed, n=300):
    rng = random.Random(seed)
    vocabulary = ["New", "york", "city", "the", "of", "état", "x y", "été", " ", "#", "日本", "a'b", "Ünï"]
    out = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.6:
            words += ["new", "York", "city", "council", "hall"] * rng.randrange(1, 4)
        out.append((i % 290, "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b"]) for w in words), rng.choice(["en", "en", "en", "de", "und", None, ""])))
    return out + [(0, None, "en"), (1, "", None), (2, " \t .,", "en"), (3, "york", None), (None, "new york city council hall", "en")]


@pytest.mark.parametrize(("most", "least", "percent", "first"), [(5, 20, 100, 2000), (4, 5, 80, 7), (2, 3, 100, 50), (1, 1, 100, 5)])
def test_equals_brute_force(spark, most, least, percent, first):
    rows = texts(most * 10 + least)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(tuple(r) for r in collocations(frame, most, least, percent, first).collect())
    assert got == brute(rows, most, least, percent, first)


def test_size_of_the_bitmap_changes_nothing(spark):
    frame = spark.createDataFrame(texts(3), SCHEMA)
    exact, totals = frequent_phrases(frame, 4, 10)
    crowded, _ = frequent_phrases(frame, 4, 10, bits=6)  # nearly every bit is set
    assert sorted(exact.collect()) == sorted(crowded.collect())
    assert bin(int(_bitmap(_word_slots(exact.filter("words = 1"), 6), 6).value[0])).count("1") > 10


def test_counts_past_64_bits(spark):
    from sluice.llm.collocations import scored

    phrases = spark.createDataFrame([("en", "a", 1, 3 * 10**12), ("en", "b", 1, 10**12), ("en", "a b", 2, 9 * 10**11)], "lang string, phrase string, words int, n bigint")
    totals = spark.createDataFrame([("en", 10**13)], "lang string, total bigint")
    assert [r["score"] for r in scored(phrases, totals).collect()] == [1000 * 9 * 10**11 * 10**13 // (3 * 10**24)]


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert collocations(empty).collect() == []
    frame = spark.createDataFrame([(1, "a b " * 50, "en", "p", 1, 2, 3)] * 2, "doc_id bigint, text string, lang string, phrase string, n int, words int, rank int")
    assert [tuple(r) for r in collocations(frame, 2, 90, 100, 5).collect()] == [("en", 1, "a b", 100, 100, 100, 200, 2000), ("en", 2, "b a", 98, 100, 100, 200, 1960)]


def test_overlaps_count_and_pieces_part(spark):
    frame = spark.createDataFrame([(1, "a a a a. a a", "en")], SCHEMA)
    assert [(r["phrase"], r["a"], r["n"]) for r in collocations(frame, 3, 1, 100, 9).collect()] == [("a a", 4, 6), ("a a a", 2, 6)]
