"""Phrase collocations: n-grams as rows, counted per language, scored by the weakest cut, without phrases that a longer one explains.

Words, pairs and longer phrases become rows (lang, phrase, words, n), counted within a block of texts before they leave
the worker, and are added up by hash aggregation. Three scans make them: words; hashes of the pairs of words that are both frequent; phrases of
two and more words all of whose pairs have a frequent hash. A phrase stands at most as often as each part of it, so a phrase that is not made could not reach `least`.
What is frequent goes to the workers as a bitmap of a fixed size: a wrong hit in it only makes rows that the exact count drops again,
so the result does not depend on its size.
Counts of the first and the last part of each cut are joined (they are at least as frequent as the phrase, so they are in the table),
scores are Decimal, one-word extensions with as high a count are an anti-join, and the first phrases of each language are ranked.

Null texts are empty; null languages count as `und`. Repeated rows count each time. Texts are read whole, in blocks, a very long one as a
block of its own. Ties are ranked by phrase, in UTF-8 byte order. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import FEW, Prefix, blocks, durable, mix

#: Log2 of the bits that tell the workers what is frequent: 8 MB.
BITS = 26
#: Bits of a pair's hash by which pairs are counted before those that may be frequent are counted as texts.
PAIR_BITS = 40
#: Bytes of text counted at once in a worker.
BLOCK = 8 << 20
#: Groups in which each language's phrases are ranked before the ranks of what is left are taken.
GROUPS = 32

_ROWS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())])
_SPARK_ROWS = "lang string, phrase string, words int, n bigint"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_KIND = np.zeros(256, np.uint8)  # 0 a byte of a word, 1 between words, 2 between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_PAIR = np.uint64(0xD6E8FEB86659FD93)
_GAP = pa.scalar(" ", pa.large_string())


def _hashes(strings: pa.Array, lang: str) -> np.ndarray:
    """A 64-bit hash of each string in its language."""
    strings = strings.cast(pa.large_string())
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    raw = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(strings) else np.zeros(0, np.uint8)
    own = np.frombuffer(lang.encode() or b"\0", np.uint8)
    return Prefix(raw)(offsets[:-1] - offsets[0], offsets[1:] - offsets[0]) ^ Prefix(own)(np.array([0]), np.array([len(own)]))


def _pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * _PAIR + second)


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _held(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    slots = _slots(hashes, bits)
    return (bitmap[slots >> 6] >> (slots & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _tokens(texts: list[str]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of the words in order, the word of each code, and whether the next word follows in the same piece."""
    raw = np.frombuffer("\n".join(texts).encode().translate(_LOWER), np.uint8)
    kind = _KIND[raw]
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = kind == 0
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.zeros(0, np.int64), pa.array([], pa.large_string()), np.zeros(0, bool)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    named = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw[kind == 0].tobytes())).dictionary_encode()
    pieces = np.concatenate([[0], np.cumsum(kind == 2, dtype=np.int32)])
    joined = np.zeros(len(starts), bool)
    joined[:-1] = pieces[ends[:-1]] == pieces[starts[1:]]
    return named.indices.to_numpy(zero_copy_only=False).astype(np.int64), named.dictionary, joined


def _counted(lang: str, phrases: pa.Array, words: int, n: np.ndarray) -> pa.RecordBatch:
    size = len(phrases)
    return pa.record_batch([pa.array([lang]).take(pa.array(np.zeros(size, np.int64))), phrases.cast(pa.string()), pa.array(np.full(size, words, np.int32)), pa.array(n, pa.int64())], schema=_ROWS)


def _words(lang: str, codes: np.ndarray, names: pa.Array, joined: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each word with its count; a null phrase stands for all words."""
    yield _counted(lang, names, 1, np.bincount(codes, minlength=len(names)))
    yield _counted(lang, pa.array([None], pa.string()), 0, np.array([len(codes)]))


def _two(lang: str, codes: np.ndarray, names: pa.Array, joined: np.ndarray, bitmap: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Hashes of the pairs of frequent words."""
    own = _hashes(names, lang)
    often = _held(bitmap, own, bits)[codes]
    at = np.flatnonzero(joined[:-1] & often[:-1] & often[1:])
    found, n = np.unique(_pairs(own[codes[at]], own[codes[at + 1]]) >> np.uint64(64 - PAIR_BITS), return_counts=True)
    if len(found):
        yield pa.record_batch([pa.array(found.astype(np.int64)), pa.array(n, pa.int64())], ["h", "n"])


def _more(lang: str, codes: np.ndarray, names: pa.Array, joined: np.ndarray, bitmap: np.ndarray, bits: int, most: int) -> Iterator[pa.RecordBatch]:
    """Phrases of two to `most` words all of whose pairs are frequent."""
    own = _hashes(names, lang)
    runs = np.zeros(len(codes), bool)
    runs[:-1] = joined[:-1]
    at = np.flatnonzero(runs)
    runs[at] = _held(bitmap, _pairs(own[codes[at]], own[codes[at + 1]]), bits)
    at = np.flatnonzero(runs)
    for size in range(2, most + 1):
        at = at[at + size - 2 < len(runs)]
        at = at[runs[at + size - 2]]
        if not len(at):
            return
        found = pc.binary_join_element_wise(*(names.take(pa.array(codes[at + i])) for i in range(size)), _GAP).dictionary_encode()
        yield _counted(lang, found.dictionary, size, np.bincount(found.indices.to_numpy(zero_copy_only=False), minlength=len(found.dictionary)))


def _grams(documents: DataFrame, schema: str, make, *given) -> DataFrame:
    """The rows that `make` gives for each language of each block, added up."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extra = tuple(x.value if hasattr(x, "value") else x for x in given)
        for batch in batches:
            for block in blocks(batch, "text", BLOCK):
                for lang in block.column("lang").unique().to_pylist():
                    texts = block.column("text").filter(pc.equal(block.column("lang"), lang)).to_pylist()
                    codes, names, joined = _tokens(texts)
                    if len(codes):
                        yield from make(lang, codes, names, joined, *extra)

    texts = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    made = texts.mapInArrow(rows, schema)
    return made.groupBy(*(c for c in made.columns if c != "n")).agg(F.sum("n").alias("n"))


def _bitmap(slots: DataFrame, bits: int):
    """Broadcast bits of the slots (slot), set by tasks: at most 2^bits / 64 rows reach the driver, whatever the input."""
    place, mask = F.shiftright("slot", 6).alias("place"), F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")
    set_bits = slots.groupBy(place).agg(F.bit_or(mask).alias("mask")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[set_bits["place"].to_numpy()] = set_bits["mask"].to_numpy().view(np.uint64)
    return slots.sparkSession.sparkContext.broadcast(bitmap)


def _word_slots(words: DataFrame, bits: int) -> DataFrame:
    """The slot of each frequent word (lang, phrase)."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in batch.column("lang").unique().to_pylist():
                own = batch.column("phrase").filter(pc.equal(batch.column("lang"), lang))
                yield pa.record_batch([pa.array(_slots(_hashes(own, lang), bits))], ["slot"])

    return words.select("lang", "phrase").mapInArrow(slots, "slot bigint")


def frequent_phrases(documents: DataFrame, most: int, least: int, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of all phrases of 1 to `most` words that stand `least` times, and (lang, total) words of each language."""
    counted = _grams(documents, _SPARK_ROWS, _words)
    one = durable(counted.filter(F.col("phrase").isNull() | (F.col("n") >= least)))
    found = one.filter("phrase IS NOT NULL")
    if most > 1:
        of_words = _bitmap(_word_slots(found, bits), bits)
        pairs = _grams(documents, "h bigint, n bigint", _two, of_words, bits).filter(F.col("n") >= least)
        of_pairs = _bitmap(pairs.select(F.shiftright("h", PAIR_BITS - bits).alias("slot")), bits)
        more = durable(_grams(documents, _SPARK_ROWS, _more, of_pairs, bits, most).filter(F.col("n") >= least))
        found = found.union(more)
        of_words.unpersist()
        of_pairs.unpersist()
    return found, one.filter("phrase IS NULL").select("lang", F.col("n").alias("total"))


def _head(k: str) -> Column:
    """The first words of a phrase."""
    return F.expr(f"substring_index(phrase, ' ', {k})")


def _tail(head: Column) -> Column:
    """What follows them."""
    return F.col("phrase").substr(F.length(head) + 2, F.length("phrase"))


def scored(phrases: DataFrame, totals: DataFrame, percent: int = 100) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of phrases of two words and more that no one-word extension explains.

    A longer phrase that holds the phrase and stands `percent` % as often has such an extension that does, so one-word extensions are enough.
    """
    several = phrases.filter("words > 1")
    cuts = several.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.expr("sequence(1, words - 1)")).alias("k")).withColumn("first", _head("k")).withColumn("rest", _tail(F.col("first")))
    of = phrases.select("lang", "phrase", "n")
    cuts = cuts.join(of.select(F.col("lang").alias("_a"), F.col("phrase").alias("_b"), F.col("n").alias("l")), F.expr("lang = _a AND first = _b")).drop("_a", "_b")
    cuts = cuts.join(of.select(F.col("lang").alias("_a"), F.col("phrase").alias("_b"), F.col("n").alias("r")), F.expr("lang = _a AND rest = _b")).drop("_a", "_b")
    whole = totals.select(F.col("lang").alias("_a"), F.col("total").alias("n"))
    cuts = cuts.join(F.broadcast(whole) if whole.count() <= FEW else whole, F.expr("lang = _a")).drop("_a")
    exact = F.expr("(1000 * CAST(a AS DECIMAL(17, 0)) * CAST(n AS DECIMAL(17, 0))) div (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))")
    weakest = cuts.withColumn("score", exact).groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "k")).alias("_x")).select("lang", "phrase", "_x.*")
    longer = several.filter("words > 2").select("lang", F.col("n").alias("f"), F.expr("words - 1").alias("w"), "phrase")
    inner = longer.select("lang", "f", _head("w").alias("inner")).union(longer.select("lang", "f", _tail(_head("1")).alias("inner")))
    explained = inner.groupBy("lang", "inner").agg(F.max("f").alias("f")).select(F.col("lang").alias("_a"), F.col("inner").alias("_b"), "f")
    return weakest.join(explained, F.expr(f"lang = _a AND phrase = _b AND 100 * f >= {int(percent)} * a"), "left_anti")


def first_of_each(phrases: DataFrame, first: int) -> DataFrame:
    """The first rows of each language with their rank; groups of a language are cut to so many rows before one task ranks what is left."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    grouped = phrases.withColumn("_g", F.pmod(F.xxhash64("phrase"), F.lit(GROUPS)))
    cut = grouped.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_g").orderBy(*order))).filter(F.col("_r") <= first).drop("_g", "_r")
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(documents: DataFrame, most: int = 5, least: int = 100, percent: int = 100, first: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases of 2 to `most` words that stand `least` times or more."""
    phrases, totals = frequent_phrases(documents, most, least)
    return first_of_each(scored(phrases, totals, percent), first)
