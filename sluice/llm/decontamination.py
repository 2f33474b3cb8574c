"""Benchmark decontamination by the q-gram lemma.

A benchmark item is searched whole, or as overlapping pieces where it is longer than a piece and a stride, so that each of its
passages of that many characters (80 on the finer of two scales) holds a whole piece. A stretch of text within k edits of a piece of m characters
shares at least m + 1 - q (k + 1) character q-grams with it on k + 1 neighbouring diagonals. Of a piece's q-grams the
rarest ones are looked up, so many that such a stretch shares PROBED of them at least; they are counted in bands of 2 (k + 1)
diagonals that overlap by half. In bands with PROBED of them all q-grams are counted, and bands that reach the bound
are aligned within the band. So a phrase that many items share costs nothing unless it is most of a piece. Both sides are
lower-cased with white space runs made one space.

Each block of the benchmark of at most BLOCK characters is broadcast and scanned against all documents; further blocks are further
scans, one after another, with one block in a worker's memory. Items shorter than q characters are found as whole words only.
Null and empty texts and items match nothing, nor do items without id; repeated rows count each, with or without doc_id; long
texts are read whole, in overlapping segments; equal items are found all. Without documents or items there are no rows. Other
columns, whatever their names, are ignored by `contaminated` and kept by `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import blocks, by_content, durable, mix, powers

Q = 10
#: Edits allowed for each character of a piece.
EDITS = 0.06
#: Lengths of pieces and strides: long ones allow more edits, short ones find short passages.
SCALES = ((100, 50), (64, 16))
#: Rare q-grams that a band must share before all are counted; fewer where the lemma's bound is lower.
PROBED = 4
#: Characters of benchmark in one broadcast, and of text looked at together.
BLOCK, SEGMENT = 2_000_000, 1 << 18
#: Entries of the index held against a text at once.
ENTRIES = 2_000_000
_BITS = 22
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def plain(text: str | None) -> str:
    return " ".join((text or "").replace("\0", " ").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def gram_hashes(letters: np.ndarray, q: int, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    n = len(letters)
    if n < q:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) * up[:n], out=sums[1:])
    return mix((sums[q:] - sums[: n + 1 - q]) * down[: n + 1 - q])


def pieces(text: str, scales: tuple[tuple[int, int], ...] = SCALES) -> list[str]:
    """The text where it is no longer than piece + step, else pieces at the stride and one at its end, on each scale, each once."""
    found: dict[str, None] = {}
    for piece, step in scales:
        whole = len(text) <= piece + step
        for a in [0] if whole else [*range(0, len(text) - piece, step), len(text) - piece]:
            found[text if whole else text[a : a + piece]] = None
    return [x for x in found if x]


def alignment(pattern: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> int:
    """Least edits between the pattern and a stretch of text on the diagonals low..high, or budget + 1.

    Diagonal d pairs pattern place i with text place i + d; the stretch may start and end anywhere.
    """
    width = high - low + 1
    far = budget + 1
    step = np.arange(width)
    now = np.where((step + low >= 0) & (step + low <= len(text)), 0, far)
    for i, letter in enumerate(pattern):
        place = step + low + i
        inside = (place >= 0) & (place < len(text))
        same = np.full(width, 1)
        same[inside] = text[place[inside]] != letter
        next_ = np.where(inside, now + same, far)
        next_[:-1] = np.minimum(next_[:-1], now[1:] + 1)  # pattern letter left out
        next_ = np.where((place + 1 >= 0) & (place + 1 <= len(text)), next_, far)
        next_ = np.minimum.accumulate(next_ - step) + step  # text letters left out
        now = np.minimum(next_, far)
        if now.min() > budget:
            return far
    return int(now.min())


@dataclass
class Benchmark:
    """Pieces with the items that hold them, their q-grams, and an index of the rare ones: sorted hashes, and for each the places that hold it."""

    items: list[list[int]]
    texts: list[str]
    short: list[tuple[int, str]]
    q: int
    edits: float

    def __post_init__(self):
        longest = max(map(len, self.texts), default=0)
        up, down = powers(_BASE, longest + 1), powers(_INVERSE, longest + 1)
        self.grams = [gram_hashes(codes(x), self.q, up, down) for x in self.texts]
        self.lengths = np.array([len(x) for x in self.texts], dtype=np.int64)
        self.budget = (self.lengths * self.edits).astype(np.int64)
        bound = self.lengths + 1 - self.q * (self.budget + 1)
        while (bound < 1).any():  # short pieces: as many edits as the lemma can tell
            self.budget = np.where(bound < 1, self.budget - 1, self.budget)
            bound = self.lengths + 1 - self.q * (self.budget + 1)
        self.bound = bound
        self.probed = np.minimum(bound, PROBED)
        every = np.concatenate(self.grams) if self.grams else np.zeros(0, np.uint64)
        known, often = np.unique(every, return_counts=True)
        places = []
        for own, missing, least in zip(self.grams, self.q * self.budget, self.probed):  # a match lacks q k of all q-grams at most
            order = np.argsort(often[np.searchsorted(known, own)], kind="stable")
            places.append(np.sort(order[: missing + least]))
        piece = np.repeat(np.arange(len(places)), [len(x) for x in places]) if places else np.zeros(0, np.int64)
        place = np.concatenate(places) if places else np.zeros(0, np.int64)
        rare = np.concatenate([g[x] for g, x in zip(self.grams, places)]) if places else every
        order = np.argsort(rare, kind="stable")
        self.piece, self.place = piece[order].astype(np.int32), place[order].astype(np.int32)
        self.hashes, self.first = np.unique(rare[order], return_index=True)
        self.last = np.append(self.first[1:], len(rare))
        self.held = np.zeros(1 << _BITS, dtype=bool)
        self.held[self.hashes >> np.uint64(64 - _BITS)] = True

    def search(self, texts: list[str], segment: int = SEGMENT) -> list[set[int]]:
        """Items found in each (plain) text."""
        found: list[set[int]] = [set() for _ in texts]
        reach = int((self.lengths + 4 * self.budget + 8).max(initial=0))
        held: list[tuple[int, str]] = []
        size = 0
        for i, text in enumerate(texts):
            for a in range(0, max(1, len(text)), segment):
                part = text[a : a + segment + reach]
                held.append((i, part))
                size += len(part) + 1
                if size > segment:
                    self._scan(held, found)
                    held, size = [], 0
        if held:
            self._scan(held, found)
        for i, text in enumerate(texts):
            padded = f" {text} "
            found[i].update(item for item, short in self.short if f" {short} " in padded)
        return found

    def _scan(self, parts: list[tuple[int, str]], found: list[set[int]]) -> None:
        if not len(self.hashes):
            return
        letters = codes("\0".join(x for _, x in parts))
        starts = np.cumsum([0] + [len(x) + 1 for _, x in parts])
        h = gram_hashes(letters, self.q, powers(_BASE, len(letters) + 1), powers(_INVERSE, len(letters) + 1))
        at = np.flatnonzero(self.held[h >> np.uint64(64 - _BITS)])
        slot = np.searchsorted(self.hashes, h[at])
        slot[slot == len(self.hashes)] = 0
        good = self.hashes[slot] == h[at]
        at, slot = at[good], slot[good]
        many = self.last[slot] - self.first[slot]
        sums = np.concatenate([[0], np.cumsum(many)])
        reach = int((self.lengths + 2 * self.budget + 2).max())
        begin = 0
        while begin < len(at):  # stretches with few entries, which overlap by the length of any match
            end = max(begin + 1, int(np.searchsorted(sums, sums[begin] + ENTRIES, "right")) - 1)
            end = max(end, int(np.searchsorted(at, at[begin] + 2 * reach)))
            self._count(at[begin:end], slot[begin:end], many[begin:end], letters, h, starts, parts, found)
            if end >= len(at):
                break
            begin = max(begin + 1, int(np.searchsorted(at, at[end] - reach)))

    def _count(self, at, slot, many, letters, h, starts, parts, found) -> None:
        text_place = np.repeat(at, many)
        entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.first[slot], many)
        piece = self.piece[entry].astype(np.int64)
        diagonal = text_place - self.place[entry]
        part = np.searchsorted(starts, text_place, "right") - 1
        band = (diagonal + len(letters)) // (self.budget[piece] + 1)
        bands = int(band.max(initial=0)) + 2
        key = (part * len(self.texts) + piece) * bands + band
        key, counts = np.unique(np.concatenate([key, key[band > 0] - 1]), return_counts=True)
        piece = key // bands % len(self.texts)
        for j in np.flatnonzero(counts >= self.probed[piece]):
            self._verify(int(piece[j]), int(key[j] // bands // len(self.texts)), int(key[j] % bands), letters, h, starts, parts, found)

    def _verify(self, p: int, i: int, band: int, letters, h, starts, parts, found) -> None:
        row, text = parts[i]
        if found[row].issuperset(self.items[p]):
            return
        k, grams = int(self.budget[p]), self.grams[p]
        low = band * (k + 1) - len(letters)
        shared = 0
        for d in range(low, low + 2 * (k + 1)):
            a, b = max(0, -d), min(len(grams), len(h) - d)
            shared += int((h[a + d : b + d] == grams[a:b]).sum()) if b > a else 0
        if shared < self.bound[p]:
            return
        low -= int(starts[i])
        high = low + 2 * (k + 1) - 1
        begin = max(0, low - k)
        stretch = text[begin : max(0, high + int(self.lengths[p]) + k)]
        if self.texts[p] in stretch or alignment(codes(self.texts[p]), codes(stretch), low - k - begin, high + k - begin, k) <= k:
            found[row].update(self.items[p])


def benchmarks(benchmark: DataFrame, q: int, edits: float, block: int = BLOCK) -> Iterator[Benchmark]:
    """The benchmark in blocks of bounded size; rows reach the driver one block after another."""
    held: dict[str, list[int]] = {}
    short: list[tuple[int, str]] = []
    size = 0

    def made() -> Benchmark:
        return Benchmark(list(held.values()), list(held), short, q, edits)

    for row in benchmark.select("item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        text = plain(row["text"])
        if len(text) < q:
            short += [(row["item_id"], text)] if text else []
        for x in pieces(text) if len(text) >= q else ():
            held.setdefault(x, []).append(row["item_id"])
        size += len(text)
        if size > block:
            yield made()
            held, short, size = {}, [], 0
    if held or short:
        yield made()


def leaks(documents: DataFrame, own: Benchmark) -> DataFrame:
    """doc_id, h (hash of the text) and items (sorted ids, at least one) of the rows that hold something of one block."""
    held = documents.sparkSession.sparkContext.broadcast(own)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                found = held.value.search([plain(x) for x in part.column("text").to_pylist()])
                rows = pa.array([j for j, x in enumerate(found) if x], pa.int64())
                items = pa.array([sorted(x) for x in found if x], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(rows), part.column("h").take(rows), items], names=["doc_id", "h", "items"])

    return documents.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(find, "doc_id bigint, h bigint, items array<bigint>")


def leaking(documents: DataFrame, benchmark: DataFrame, q: int = Q, edits: float = EDITS, block: int = BLOCK) -> DataFrame | None:
    """The same over all blocks, a row for each row of documents; None without items. The rows of each block but a single one are checkpointed."""
    found: DataFrame | None = None
    blocks_of = benchmarks(benchmark, q, edits, block)
    own = next(blocks_of, None)
    while own is not None:
        now, own = leaks(documents, own), next(blocks_of, None)
        if found is None and own is None:
            return now
        now = durable(now)  # repeated rows hold the same
        found = now if found is None else found.unionByName(now)
    if found is None:
        return None
    each = found.groupBy("doc_id", "h", "items").agg(F.count(F.lit(1)).alias("times"))
    whole = each.groupBy("doc_id", "h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("times").alias("times"))
    return whole.select("doc_id", "h", "items", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("col")


def contaminated(documents: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, contaminated (true), n_items and items (ids, comma-joined) of the documents that hold benchmark passages."""
    found = leaking(documents, benchmark, block=block)
    if found is None:
        found = documents.sparkSession.createDataFrame([], "doc_id bigint, h bigint, items array<bigint>")
    return found.select("doc_id", F.lit(True).alias("contaminated"), F.size("items").cast("bigint").alias("n_items"), F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


def clean(documents: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """The documents that hold no benchmark passage, with their columns."""
    found = leaking(documents, benchmark, block=block)
    return documents if found is None else by_content(documents, durable(found.select("doc_id", "h")), "left_anti")
