"""Repeated byte strings by prefix-free parsing.

Parse: the trigger of a string of `length` bytes is its gram with the smallest rolling hash, with the bytes on its longer
side that any such string has, and a phrase is the stretch that all neighbouring strings with one trigger cover. So phrases overlap, each string lies whole in exactly one of them, and
equal strings have equal triggers. Phrases whose trigger stands nowhere else hold nothing repeated and go at once. The
dictionary is the distinct phrases; of the parse, the occurrences of each phrase.

Corpus order: the suffixes of the dictionary are sorted on their bytes by prefix doubling to a depth of `length`
(`suffix_ranks`), a suffix array of each part of the dictionary, parts being whole triggers, since only suffixes under
one trigger can agree so far. Since no string reaches beyond its phrase, the suffix array of the parse is asked
for its first symbol only: a suffix stands in the order once for each occurrence of its phrase. Suffixes with equal
rank, or of a phrase that occurs twice, are repeated strings.

A trigger with more than HOT phrases is dealt to parts of at most so many; what stands once in its part is then
counted over the trigger's parts by a hash of the string. Null text is empty and texts shorter than `length` lose
nothing; texts of any length are read whole, in overlapping segments of SEGMENT bytes; repeated rows repeat
each other's strings, with or without doc_id. An empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import Prefix, blocks, dropped, durable, free, keys, mix, stored, text_bytes

LENGTH = 200
GRAM = 32
#: Phrases of one trigger in one part of the dictionary.
HOT = 2_000
SEGMENT = 1 << 19
#: Bytes of dictionary that a task sorts at once, and one part more at most.
SORTED = 1 << 20
_LAST = np.iinfo(np.int64).max


def smallest(h: np.ndarray, width: int) -> np.ndarray:
    """Index of the first smallest value in each window of `width` values."""
    n = len(h)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = h
    place = np.arange(rows * width, dtype=np.int64)
    grid = padded.reshape(rows, width)
    fore = np.minimum.accumulate(grid, axis=1)
    fresh = np.ones_like(grid, dtype=bool)
    fresh[:, 1:] = fore[:, 1:] < fore[:, :-1]
    fore_at = np.maximum.accumulate(np.where(fresh, place.reshape(rows, width), -1), axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]
    back_at = np.minimum.accumulate(np.where(grid == back, place.reshape(rows, width), _LAST)[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(n - width + 1)
    ends = starts + width - 1
    return np.where(back.ravel()[starts] <= fore.ravel()[ends], back_at[starts], fore_at[ends])


def phrases(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text, first and last string start, trigger hash and phrase hash of each phrase.

    What counts as the trigger is the gram with half of the rest of a string before it, or after it where a string has less before.
    """
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if len(raw) < length:
        return none
    prefix = Prefix(raw)
    at = np.arange(len(raw) - gram + 1)
    h = prefix(at, at + gram)
    trigger = smallest(h, length - gram + 1)
    text = np.searchsorted(offsets, np.arange(len(trigger)), "right") - 1
    good = np.flatnonzero(np.arange(len(trigger)) + length <= offsets[text + 1])
    if not len(good):
        return none
    before = (length - gram) // 2
    early = good <= trigger[good] - before  # the string has so many bytes before its trigger
    cut = np.flatnonzero((np.diff(trigger[good]) != 0) | (np.diff(good) != 1) | (np.diff(early) != 0)) + 1
    low, high = good[np.concatenate([[0], cut])], good[np.concatenate([cut - 1, [len(good) - 1]])]
    place = trigger[low]
    core = np.where(low <= place - before, place - before, place)
    key = mix(prefix(core, core + gram + np.where(core < place, before, length - gram - before + 1)) ^ np.uint64(0xA24BAED4963EE407))
    own = mix(prefix(low, high + length) ^ mix((place - low).astype(np.uint64) + np.uint64(1)))
    return text[low], low - offsets[text[low]], high - offsets[text[low]], key, own


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text and the key of the row: kd, th."""
    text = F.coalesce("text", F.lit(""))
    return documents.select("doc_id", text.alias("text"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("kd"), F.xxhash64(text).alias("th"))


PARSED = "rid bigint, kd bigint, th bigint, low array<int>, high array<int>, g array<bigint>, e array<bigint>"


def parse(rows: DataFrame, length: int, gram: int, segment: int = SEGMENT) -> DataFrame:
    """rid, kd, th and the phrases of each text that has any: first and last string start, trigger g and phrase hash e."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in blocks(batch, "text", segment):
                raw, offsets = text_bytes(part.column("text"))
                found = []
                if len(raw) <= 2 * segment:
                    found.append(phrases(raw, offsets, length, gram))
                else:
                    for i in range(len(offsets) - 1):
                        for a in range(offsets[i], offsets[i + 1], segment):
                            piece = raw[a : min(a + segment + length - 1, offsets[i + 1])]
                            _, low, high, g, e = phrases(piece, np.array([0, len(piece)]), length, gram)
                            found.append((np.full(len(low), i), low + (a - offsets[i]), high + (a - offsets[i]), g, e))
                text, low, high, g, e = (np.concatenate(x) for x in zip(*found))
                own = np.flatnonzero(np.bincount(text, minlength=len(offsets) - 1))
                first = np.append(np.searchsorted(text, own), len(text)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(first, x) for x in (low.astype(np.int32), high.astype(np.int32), g.view(np.int64), e.view(np.int64))]
                arrays = [pa.array(rid + np.arange(len(own))), part.column("kd").take(pa.array(own)), part.column("th").take(pa.array(own)), *lists]
                rid += len(own)
                yield pa.RecordBatch.from_arrays(arrays, names=["rid", "kd", "th", "low", "high", "g", "e"])

    return rows.select("kd", "th", "text").mapInArrow(make, PARSED)


def suffix_ranks(raw: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each start its place in the order of the strings of `length` bytes, equal strings having the same; -1 where a string is alone.

    Prefix doubling: places by the first 8 bytes, then by 16, 32 and so on. Suffixes that stand alone keep their place.
    """
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint64)
    depth = min(8, length)
    first = np.zeros(n, dtype=np.uint64)
    for j in range(depth):
        first = (first << np.uint64(8)) | padded[j : j + n]
    order = np.argsort(first, kind="stable")
    _, ranks, open_ = _places(order, first[order], np.zeros(n, np.int64), n)
    while depth < length:
        step = min(depth, length - depth)
        at = np.flatnonzero(open_) if depth + step < length else starts[open_[starts]]
        key = ranks[at] * (n + 1) + np.where(at + step < n, ranks[np.minimum(at + step, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        next_ = ranks.copy()
        _, held, still = _places(at, key, ranks, n)
        next_[at], open_ = held[at], np.zeros(n, bool)
        open_[at] = still[at]
        ranks = next_
        depth += step
    if length <= 8:  # other suffixes than strings were in the order to its end
        _, back, counts = np.unique(ranks[starts], return_inverse=True, return_counts=True)
        return np.where(counts[back] > 1, ranks[starts], -1)
    return np.where(open_[starts], ranks[starts], -1)


def _places(at: np.ndarray, key: np.ndarray, before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted keys at positions `at`: firsts, new place of each position within that before, and whether another has it."""
    ranks, shared = before.copy(), np.zeros(n, bool)
    if not len(at):
        return at, ranks, shared
    index = np.arange(len(at))
    new = np.concatenate([[True], key[1:] != key[:-1]])
    old = np.concatenate([[True], before[at][1:] != before[at][:-1]])
    run = np.maximum.accumulate(np.where(new, index, 0))
    ranks[at] = before[at] + run - np.maximum.accumulate(np.where(old, index, 0))
    same = ~new
    same[:-1] |= ~new[1:]
    shared[at] = same
    return index[new], ranks, shared


#: decided stretches (rid, start, stop), or strings under a dealt trigger that are yet to count: g, h, and rid and start where they may go.
FOUND = "rid bigint, start int, stop int, g bigint, h bigint"
PART = "g bigint, salt int, parts int, rid bigint, low int, single boolean, bytes binary"


def repeated_strings(table: pa.Table, length: int) -> pa.RecordBatch:
    """One part of the dictionary: its suffixes in order, and those of phrases that occur once which another phrase has too."""
    held = pa.concat_arrays(table.column("bytes").cast(pa.large_binary()).chunks)
    offsets = np.frombuffer(held.buffers()[1], dtype=np.int64)[held.offset : held.offset + len(held) + 1]
    raw = np.frombuffer(held.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    many = np.diff(offsets) - length + 1
    phrase = np.repeat(np.arange(len(many)), many)
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    start = (offsets - offsets[0])[phrase] + place
    ranks = suffix_ranks(raw, start, length)
    column = lambda x: table.column(x).to_numpy(zero_copy_only=False)
    single, rid, low, g, dealt = column("single"), column("rid"), column("low"), column("g"), column("parts") > 1
    hit = np.flatnonzero((ranks >= 0) & single[phrase])
    cut = np.flatnonzero((np.diff(phrase[hit]) != 0) | (np.diff(place[hit]) != 1)) + 1
    first, last = (hit[np.concatenate([[0], cut])], hit[np.concatenate([cut - 1, [len(hit) - 1]])]) if len(hit) else (hit, hit)
    own = phrase[first]
    decided = [rid[own], low[own] + place[first], low[own] + place[last] + length, np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)]
    rest = np.flatnonzero(dealt[phrase])
    if len(rest):  # once for each different string
        alone = rest[ranks[rest] < 0]
        shared = rest[ranks[rest] >= 0]
        rest = np.concatenate([alone, shared[np.unique(ranks[shared], return_index=True)[1]]])
        ask = single[phrase[rest]] & (ranks[rest] < 0)
        h = Prefix(raw)(start[rest], start[rest] + length).view(np.int64)
        begin = low[phrase[rest]] + place[rest]
        other = [rid[phrase[rest]], np.where(ask, begin, -1), np.where(ask, begin + length, -1), g[phrase[rest]], h]
        decided = [np.concatenate(x) for x in zip(decided, other)]
        undecided = np.concatenate([np.zeros(len(own), bool), np.ones(len(rest), bool)])
    else:
        undecided = np.zeros(len(own), bool)
    kinds = (np.int64, np.int32, np.int32, np.int64, np.int64)
    arrays = [pa.array(x.astype(k)) for x, k in zip(decided[:3], kinds)] + [pa.array(x.astype(np.int64), mask=~undecided) for x in decided[3:]]
    return pa.RecordBatch.from_arrays(arrays, names=["rid", "start", "stop", "g", "h"])


def sorted_parts(rows: DataFrame, length: int, most: int = SORTED) -> DataFrame:
    """What `repeated_strings` finds: tasks take whole parts, in sorted order, as many at once as make `most` bytes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.column("bytes").nbytes
            if size > most:
                table = pa.Table.from_batches(held)
                g, salt = table.column("g").to_numpy(), table.column("salt").to_numpy()
                other = np.flatnonzero((g != g[-1]) | (salt != salt[-1]))
                end = int(other[-1]) + 1 if len(other) else 0
                if end:
                    yield repeated_strings(table.slice(0, end), length)
                    held = pa.concat_tables([table.slice(end)]).combine_chunks().to_batches()
                    size = sum(x.column("bytes").nbytes for x in held)
        if sum(x.num_rows for x in held):
            yield repeated_strings(pa.Table.from_batches(held), length)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "g", "salt").sortWithinPartitions("g", "salt").mapInArrow(make, FOUND)


def cut_out(documents: DataFrame, parsed: DataFrame, doubtful: DataFrame, length: int) -> DataFrame:
    """The bytes of the doubtful phrases (g, salt, parts, single, rid, low, high), read from the texts."""
    asked = doubtful.groupBy("rid").agg(F.collect_list(F.struct("g", "salt", "parts", "single", "low", "high")).alias("asked"))
    asked = durable(parsed.select("rid", "kd", "th").join(asked, "rid"))
    once = asked.groupBy("kd", "th").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
        for batch in batches:
            for part in blocks(batch, "text"):
                out = []
                for rid, text, found in zip(*(part.column(x).to_pylist() for x in ("rid", "text", "asked"))):
                    data = text.encode()
                    out += [(x["g"], x["salt"], x["parts"], rid, x["low"], x["single"], data[x["low"] : x["high"] + length]) for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 7, kinds)], names=[x.split()[0] for x in PART.split(", ")])

    texts = keyed(documents).select("kd", "th", "text").join(asked, ["kd", "th"]).select("rid", "text", "asked")
    return (texts if once else texts.dropDuplicates(["rid"])).mapInArrow(cut, PART)


def repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, segment: int = SEGMENT) -> DataFrame:
    """kd, th and spans (start, stop) of what is repeated in each text."""
    spark = documents.sparkSession
    parsed, path = stored(parse(keyed(documents), length, gram, segment), "parse")
    each = parsed.select("rid", F.explode(F.arrays_zip("low", "high", "g", "e")).alias("x")).select("rid", "x.*")
    common = keys(parsed.select(F.explode("g").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "g")
    found = durable(each.join(common, "g"))

    dictionary = durable(found.groupBy("g", "e").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("rid", "low", "high")).alias("x")).select("g", "e", "c", "x.*"))
    twice = keys(dictionary.filter("c > 1"), "g", "e")
    whole = free(found, "g", "e").join(twice, ["g", "e"]).select("rid", F.col("low").alias("start"), (F.col("high") + length).cast("int").alias("stop"))
    mixed = dictionary.groupBy("g").agg(F.min("c").alias("least"), F.count(F.lit(1)).alias("phrases")).filter("least = 1 AND phrases > 1").select("g", "phrases")
    parts = F.ceil(F.col("phrases") / hot).cast("int")
    doubtful = free(dictionary, "g").join(keys(mixed, "g", "phrases"), "g").withColumn("parts", parts)
    doubtful = doubtful.select("g", F.pmod(F.xxhash64("e"), F.col("parts")).cast("int").alias("salt"), "parts", (F.col("c") == 1).alias("single"), "rid", "low", "high")
    bytes_, bytes_path = stored(cut_out(documents, parsed, doubtful, length), "phrases")
    ordered = durable(sorted_parts(bytes_, length))
    dropped(spark, bytes_path)

    dealt = ordered.filter("g IS NOT NULL")
    again = keys(dealt.groupBy("g", "h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "g", "h")
    merged = free(dealt.filter("start >= 0"), "g", "h").join(again, ["g", "h"]).select("rid", "start", "stop")
    spans = whole.union(ordered.filter("g IS NULL").select("rid", "start", "stop")).union(merged)
    spans = spans.groupBy("rid").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    spans = durable(parsed.select("rid", "kd", "th").join(spans, "rid").select("kd", "th", "spans"))
    dropped(spark, path)
    return spans


def without(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The bytes outside the spans, and the number of maximal runs that the spans make."""
    kept, at, runs = [], 0, 0
    end = -1
    for start, stop in sorted(spans):
        if start > end:
            kept.append(data[at:start])
            runs += 1
        end = max(end, stop)
        at = max(at, stop)
    kept.append(data[at:])
    return b"".join(kept), runs


def deduplicated(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, segment: int = SEGMENT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256, one row per document."""
    spans = repeats(documents, length, gram, hot, segment)
    if not spans.groupBy("kd", "th").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        spans = durable(spans.dropDuplicates(["kd", "th"]))  # repeated rows have the same spans

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                out = []
                for text, found in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                    data = text.encode()
                    kept, runs = without(data, [(x["start"], x["stop"]) for x in found or ()])
                    out.append((len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = keyed(documents).join(free(spans, "kd", "th"), ["kd", "th"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(remove, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
