"""Licence notices: phrases that stand word by word, and short notices with a bounded share of edits.

A notice that may have k edits is split into k + 1 parts; one of them stands unchanged wherever the notice does (pigeonhole), so an
automaton of all parts finds every place that can hold one. Around these places, and only there, the regex library matches the notice with at
most k edits, improves each match and says how many edits it took. Of matches that overlap, the one with the least edits for its length stays, then the
longer one, then the first. Texts are compared as their words, lower-cased in A-Z, with one space between; spans are places in the text itself.

Null texts are empty: no words, no places, score 0. Texts are read whole, a very long one as a block of its own; memory is in proportion to one block.
Repeated rows give a row each. Empty tables give no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import blocks

#: Edits that a notice may have, in percent of its characters.
PERCENT = 10
#: The phrases that are looked up word by word, with their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: The notices that are looked up with edits, with their labels.
NOTICES = (
    ("licensed under the gnu general public license", "gpl"),
    ("gnu general public license version", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("gnu free documentation license", "gfdl"),
    ("licensed under the apache license", "apache"),
    ("apache license version 2 0", "apache"),
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("licensed under the bsd license", "bsd"),
    ("mozilla public license version", "mpl"),
    ("eclipse public license version", "epl"),
    ("boost software license version", "bsl"),
    ("licensed under the isc license", "isc"),
    ("this is free and unencumbered software", "unlicense"),
    ("released into the public domain", "public-domain"),
    ("creative commons attribution license", "cc-by"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution noderivatives", "cc-by-nd"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
)

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_KEPT = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz")
_WORDS_ONLY = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or x in _KEPT else 32 for x in range(256))
_SCANNED = (
    "doc_id bigint, n_words bigint, base array<struct<label:string,word:bigint>>,"
    "found array<struct<label:string,start:bigint,end:bigint,first_word:bigint,last_word:bigint,edits:int,similarity:double,text:string>>"
)
_PLACE = pa.struct([("label", pa.string()), ("word", pa.int64())])
_SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("similarity", pa.float64()), ("text", pa.string())])


def plain(text: str) -> str:
    """The words of a text, lower-cased in A-Z, with one space between."""
    return b" ".join(text.encode("utf-8", "replace").translate(_WORDS_ONLY).split()).decode("utf-8")


def allowed(notice: str, percent: int) -> int:
    return len(notice) * percent // 100


@lru_cache(maxsize=8)
def _prepared(notices: tuple, percent: int):
    """The automaton of all parts, part -> (notice, offset), and each notice's pattern and number of edits."""
    import ahocorasick
    import regex

    parts: dict[str, list[tuple[int, int]]] = {}
    patterns = []
    for i, (notice, _) in enumerate(notices):
        k = allowed(notice, percent)
        cuts = [len(notice) * j // (k + 1) for j in range(k + 2)]
        for a, b in zip(cuts, cuts[1:]):
            parts.setdefault(notice[a:b], []).append((i, a))
        patterns.append((regex.compile(f"(?e)(?:{regex.escape(notice)}){{e<={k}}}"), k))
    automaton = ahocorasick.Automaton()
    for part, of in parts.items():
        automaton.add_word(part, (len(part), of))
    if parts:
        automaton.make_automaton()
    return automaton if parts else None, patterns


def windows(words: str, notices: tuple, percent: int) -> dict[int, list[list[int]]]:
    """For each notice the ranges of the text, apart from each other, in which all its matches lie."""
    automaton, patterns = _prepared(notices, percent)
    found: dict[int, list[list[int]]] = {}
    for end, (size, of) in automaton.iter(words) if automaton else ():
        for i, offset in of:
            found.setdefault(i, []).append([end + 1 - size - offset, i])
    out = {}
    for i, starts in found.items():
        length, margin = len(notices[i][0]), 2 * patterns[i][1] + 1
        merged: list[list[int]] = []
        for start, _ in sorted(starts):
            a, b = max(0, start - margin), min(len(words), start + length + margin)
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out[i] = merged
    return out


def matches(words: str, notices: tuple, percent: int, ranges: dict[int, list[list[int]]]) -> list[tuple]:
    """(start, end, notice, edits) of every match in the ranges."""
    _, patterns = _prepared(notices, percent)
    return [(m.start(), m.end(), i, sum(m.fuzzy_counts)) for i, own in ranges.items() for a, b in own for m in patterns[i][0].finditer(words, a, b) if m.end() > m.start()]


def chosen(found: list[tuple], notices: tuple) -> list[tuple]:
    """Of matches that overlap the best one, in the order of the text."""
    kept: list[tuple] = []
    for m in sorted(found, key=lambda m: (m[3] / len(notices[m[2]][0]), m[0] - m[1], m[0], notices[m[2]])):
        at = bisect_right(kept, m)
        if (at == 0 or kept[at - 1][1] <= m[0]) and (at == len(kept) or m[1] <= kept[at][0]):
            kept.insert(at, m)
    return kept


def _spans(text: str, words: str, found: list[tuple], notices: tuple) -> list[dict]:
    """The matches as places in the text."""
    own = [m.span() for m in _WORD.finditer(text)]
    starts, at = [], 0
    for a, b in own:
        starts.append(at)
        at += b - a + 1
    out = []
    for a, b, i, edits in found:
        a, b = a + (words[a] == " "), b - (words[b - 1] == " ")
        first, last = bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1
        start, end = own[first][0] + a - starts[first], own[last][0] + b - starts[last]
        out.append({"label": notices[i][1], "start": start, "end": end, "first_word": first, "last_word": last, "edits": edits, "similarity": 1 - edits / len(notices[i][0]), "text": text[start:end]})
    return out


def _base(words: str, phrases: tuple) -> list[dict]:
    """Every place where the words of a phrase stand one after another."""
    around, out = f" {words} ", []
    for phrase, label in phrases:
        at, seen, word = around.find(f" {phrase} "), 0, 0
        while at >= 0:
            word, seen = word + around.count(" ", seen, at), at
            out.append({"label": label, "word": word})
            at = around.find(f" {phrase} ", at + 1)
    return out


def scan(documents: DataFrame, phrases: tuple = PHRASES, notices: tuple = NOTICES, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_words, base (label, word) and found (label, start, end, first_word, last_word, edits, similarity, text) of each document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                n, base, found = [], [], []
                for text in block.column("text").to_pylist():
                    words = plain(text)
                    n.append(words.count(" ") + 1 if words else 0)
                    base.append(_base(words, phrases))
                    own = chosen(matches(words, notices, percent, windows(words, notices, percent)), notices)
                    found.append(_spans(text, words, own, notices) if own else [])
                yield pa.record_batch([block.column("doc_id"), pa.array(n, pa.int64()), pa.array(base, pa.list_(_PLACE)), pa.array(found, pa.list_(_SPAN))], ["doc_id", "n_words", "base", "found"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(rows, _SCANNED)


def licenses(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (1 for a phrase, else the best notice's similarity) and spans (label:start:end)."""
    place, label = F.col("base.word"), lambda c: F.col(f"{c}.label")
    joined = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    spans = F.transform("found", lambda x: F.concat_ws(":", x["label"], x["start"].cast("string"), x["end"].cast("string")))
    return scan(documents).select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"), F.array_min(place).alias("first_word"), F.array_max(place).alias("last_word"),
        joined(label("base")).alias("base_labels"), joined(F.concat(label("base"), label("found"))).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.col("found.similarity")), F.lit(0.0))).alias("score"), F.array_join(spans, ",").alias("spans"),
    )
