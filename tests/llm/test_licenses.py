import random
import re

import pytest
import regex

from sluice.llm.licenses import NOTICES, PHRASES, allowed, chosen, licenses, matches, plain, scan, windows

SCHEMA = "doc_id bigint, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def damaged(rng, text, edits):
    for _ in range(edits):
        at = rng.randrange(len(text))
        text = rng.choice([text[:at] + text[at + 1 :], text[:at] + rng.choice("abcxyz9 ") + text[at:], text[:at] + rng.choice("abcxyz") + text[at + 1 :]])
    return text


def texts(seed, n=120):
    rng = random.Random(seed)
    fill = ["the", "mit", "license", "under", "Licensed", "released", "été", "public", "日本", "cc", "by", "gnu", "general", "2", "0", "sub-mit", "x" * 30]
    out = []
    for i in range(n):
        words = [rng.choice(fill) for _ in range(rng.randrange(0, 80))]
        for _ in range(rng.randrange(0, 4)):
            notice = rng.choice(NOTICES)[0]
            words.insert(rng.randrange(len(words) + 1), damaged(rng, notice, rng.randrange(0, allowed(notice, 10) + 2)).title())
        out.append((i, "".join(w + rng.choice([" ", " ", "  ", "\n", ", ", "-", "\x00"]) for w in words)))
    return out


def base(text):
    words = WORD.findall(lower(text))
    places = [(i, label) for phrase, label in PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(places)


def without_seeds(words):
    """The library over the whole text, no automaton."""
    found = []
    for i, (notice, _) in enumerate(NOTICES):
        pattern = regex.compile(f"(?e)(?:{regex.escape(notice)}){{e<={allowed(notice, 10)}}}")
        found += [(m.start(), m.end(), i, sum(m.fuzzy_counts)) for m in pattern.finditer(words) if m.end() > m.start()]
    return found


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("seed", range(3))
def test_seeds_lose_no_match(seed):
    for _, text in texts(seed):
        words = plain(text)
        assert words == " ".join(WORD.findall(lower(text)))
        want = without_seeds(words)
        got = matches(words, NOTICES, 10, windows(words, NOTICES, 10))
        assert sorted(got) == sorted(want)
        for a, b, i, edits in got:
            assert distance(words[a:b], NOTICES[i][0]) <= edits <= allowed(NOTICES[i][0], 10)


def test_query_equals_brute_force(spark):
    rows = texts(7) + [(900, None), (901, ""), (902, "MIT License MIT license"), (902, "MIT License MIT license"), (None, "cc by cc by")]
    got = sorted(map(tuple, licenses(spark.createDataFrame(rows, SCHEMA).repartition(3)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans").collect()), key=repr)
    want = []
    for doc_id, text in rows:
        n, places = base(text)
        words = plain(text or "")
        found = chosen(without_seeds(words), NOTICES)
        names = {x for _, x in places}
        spans = scanned_spans(text or "", words, found)
        score = 1.0 if places else max([1 - e / len(NOTICES[i][0]) for _, _, i, e in found], default=0.0)
        want.append((doc_id, n, len(places), places[0][0] if places else None, max(i for i, _ in places) if places else None, ",".join(sorted(names)), ",".join(sorted(names | {NOTICES[i][1] for _, _, i, _ in found})), score, spans))
    assert got == sorted(want, key=repr)


def scanned_spans(text, words, found):
    """The place in the text of each character of its words."""
    place, last = [], None
    for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text):
        if last is not None:
            place.append(None)
        place += range(m.start(), m.end())
        last = m.end()
    out = []
    for a, b, i, _ in found:
        own = [x for x in place[a:b] if x is not None]
        out.append(f"{NOTICES[i][1]}:{own[0]}:{own[-1] + 1}")
    return ",".join(out)


def test_spans_and_edits(spark):
    text = "Intro.\nRelaesed  under the MIT lisense!  More; Licensed under CC BY-NC 4.0."
    row = scan(spark.createDataFrame([(1, text, "x")], SCHEMA + ", found string")).first()
    assert [(f["label"], f["text"], f["edits"]) for f in row["found"]] == [("mit", "Relaesed  under the MIT lisense", 3), ("cc-by-nc", "Licensed under CC BY-NC 4.0", 0)]
    assert [text[f["start"] : f["end"]] for f in row["found"]] == [f["text"] for f in row["found"]]
    assert [(f["first_word"], f["last_word"]) for f in row["found"]] == [(1, 5), (7, 13)]
    assert [tuple(b) for b in row["base"]] == [("cc-by", 9)]


def test_plain_words_are_no_notices(spark):
    texts = ["I submit licenses to the public in general under this version.", "The city council released a report under the direction of the minister.", "Permission was granted to build."]
    got = licenses(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    assert [(r["labels"], r["score"], r["spans"]) for r in got] == [("", 0.0, "")] * 3


def test_long_text_of_seeds_and_empty_table(spark):
    text = "licensed under the " * 20_000 + "released under the mit licence"
    row = licenses(spark.createDataFrame([(1, text)], SCHEMA)).first()
    assert row["labels"] == "mit" and row["n_words"] == 60_005 and row["n_base"] == 0
    assert licenses(spark.createDataFrame([], SCHEMA)).collect() == []
