"""Near duplicates by bottom-k sketches.

One hash function; the sketch of a text is the SKETCH smallest hashes of its shingles, the whole set where it is no
larger. Equal shingle sets collapse to one representative. Inverted lists are kept not of single retained
values, which common words fill, but of triples of them: the hashes of a sketch fall into segments, and the smallest three
of a segment are one key (`Plan`). Two sets with the asked Jaccard share a key but for a chance of MISS.

1. Overlaps with the leader of each list, the member of the most and largest lists, are counted; each text is held against the
   TRIED leaders that it shares most lists with. Linked texts become one component.
2. Texts in lists that still hold several components are put into lists once more, of single retained values, rarest
   first, only so many that two linked texts must meet in one. The place where they first meet bounds what they can
   share. Pairs are formed there, once, of different components only, and not within a list's largest one.
   A pair is formed only if both full sets have enough in common with texts of other components at all; the smaller one needs more of itself for
   that than the larger one. So texts of one template, however many, form no pairs where the template alone is too little for a link.
3. Where a list of step 2 holds many texts of one component, a text just too far from them would meet them all. There each text stands for the
   values by which it differs from one text of the component, its centre. Two texts differ by what is in one of these sets alone, so those that
   are linked share a part of them that grows with their distance from the centre, and meet in lists of these values, rarest first.

Candidates of either step pass the estimate of J from the sketch of their union, then exact Jaccard on full sets decides. So a
group of thousands of near copies costs about its size, and no list is expanded into all its pairs.

Null texts and texts without words have no shingles and are linked with nothing; texts of any length are read whole; of
equal leaders the largest node number leads; repeated rows are copies of each other; rows without doc_id are never kept by `near_duplicates`.
An empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import ceil, comb, exp, factorial, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import blocks, by_content, durable, free, keys, mix, shingles, text_bytes, word_hashes
from sluice.llm.graph import components

SKETCH = 512
#: Chance that a true pair shares no key, or fewer retained values than the lists ask for.
MISS = 1e-8
#: Retained values in one key.
TUPLE = 3
#: Sets of at most so many shingles have keys of all triples among those that a partner must share.
SMALL = 16
#: Rows of wanted ids (32 bytes each) up to which they are broadcast to the texts; more are joined by shuffling.
BROADCAST = 100_000
#: Leaders that a text is verified against.
TRIED = 3
#: Texts of one component in a list of single values, from which on they are met by what sets them apart from one of them.
CROWD = 8


def least_shared(size: int, percent: int, miss: float = MISS) -> int:
    """The t with P(Binomial(size, percent / 100) < t) <= miss."""
    p, below = percent / 100, 0.0
    for t in range(size + 1):
        below += comb(size, t) * p**t * (1 - p) ** (size - t)
        if below > miss:
            return t
    return size


def _untouched_empty(differing: int, shared: int, segments: int) -> float:
    """Chance that every segment that no differing value falls into is empty."""
    chance = [1.0] + [0.0] * segments  # by number of segments touched
    for _ in range(differing):
        chance = [0.0] + [chance[j] * j / segments + chance[j - 1] * (segments - j + 1) / segments for j in range(1, segments + 1)]
    return sum(c * (j / segments) ** shared for j, c in enumerate(chance))


def _matching(mean: float, p: float) -> float:
    """Chance that a segment of so many values on average has equal and not empty smallest values."""
    return sum(exp(-mean) * mean**x / factorial(x) * p ** min(x, TUPLE) for x in range(1, 60))


@dataclass(frozen=True)
class Plan:
    """How keys are formed, by size of the set: (least size, segments, segmentations).

    Sets of up to SMALL shingles use the exact prefix rule: of the smallest size - shared + 3 values of either, three are
    common. Up to 63 shingles there are about as many segments as shingles that may differ, so some segment is whole and
    equal, over as many segmentations as bring the chance of a miss below MISS. Beyond, segments are so many that
    three smallest values agree in one. Sets of either side of a border have the keys of both.
    """

    percent: int
    levels: tuple[tuple[int, int, int], ...]

    @classmethod
    def of(cls, percent: int) -> Plan:
        p, levels = percent / 100, []
        for low in (SMALL + 1, 2 * SMALL):
            segments = max(2, ceil(2 * low * (1 - p) / p) + (low <= SMALL + 1))
            miss = max(_untouched_empty(int(n * (1 - p) / p + 1e-9), ceil(n * p), segments) for n in range(low, 2 * low))
            levels.append((low, segments, max(1, ceil(log(MISS) / log(min(miss, 0.99))))))
        segments = ceil(log(MISS) / log(1 - p**TUPLE))
        while (1 - _matching(4 * SMALL / segments, p)) ** segments > MISS:
            segments += 1
        return cls(percent, (*levels, (4 * SMALL, segments, 1)))

    def shared(self, n: np.ndarray) -> np.ndarray:
        return -(-n * self.percent // 100)

    def keys(self, sketches: list[np.ndarray], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all sketches, sketch by sketch, and the first key of each (one more at the end)."""
        level = lambda x: np.searchsorted([a for a, _, _ in self.levels], x, "right")
        own, other = level(n), level(self.shared(n))
        found: list[tuple[np.ndarray, np.ndarray]] = [self._small(sketches, n, np.flatnonzero((n > 0) & (other == 0)))]
        for i, (_, segments, times) in enumerate(self.levels, 1):
            rows = np.flatnonzero((own == i) | (other == i))
            if len(rows):
                values = np.concatenate([sketches[r] for r in rows])
                owner = np.repeat(rows, [len(sketches[r]) for r in rows])
                found += [self._segmented(values, owner, segments, 16 * i + t) for t in range(times)]
        owner, out = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(owner, kind="stable")
        return out[order], np.searchsorted(owner[order], np.arange(len(n) + 1))

    @staticmethod
    def _segmented(values: np.ndarray, owner: np.ndarray, segments: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
        group = owner * segments + (mix(values ^ np.uint64(0x9E3779B9 * (salt + 1))) % np.uint64(segments)).astype(np.int64)
        order = np.argsort(group, kind="stable")  # values stay ascending within a segment
        group, values = group[order], values[order]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(first, len(group)))
        out = group[first].astype(np.uint64) % np.uint64(segments) + np.uint64(salt << 16)
        for j in range(TUPLE):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + np.where(size > j, values[np.minimum(first + j, len(values) - 1)], np.uint64(j)))
        return owner[order][first], out

    def _small(self, sketches: list[np.ndarray], n: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        owners, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for size in np.unique(n[rows]).tolist():
            same = rows[n[rows] == size]
            values = np.stack([sketches[r] for r in same])
            prefix = min(size, size - int(self.shared(np.int64(size))) + TUPLE)
            for chosen in combinations(range(prefix), min(TUPLE, prefix)):
                out = np.full(len(same), np.uint64(7))
                for j in chosen:
                    out = mix(out * np.uint64(0x9E3779B97F4A7C15) + values[:, j])
                owners.append(same)
                found.append(out)
        return np.concatenate(owners), np.concatenate(found)


def shingle_sets(part: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than k words are one shingle of their own."""
    raw, offsets = text_bytes(part.column("text"))
    hashes, first = word_hashes(raw, offsets)
    for a, b in zip(first[:-1], first[1:]):
        own = hashes[a:b]
        yield np.unique(shingles(own, k)) if b - a >= k else mix(shingles(own, b - a) + np.uint64(b - a)) if b > a else own[:0]


def _fingerprint(own: np.ndarray) -> tuple[int, int]:
    one, two = mix(own * np.uint64(0x9E3779B97F4A7C15)), mix(own ^ np.uint64(0xC2B2AE3D27D4EB4F))
    return int(one.sum(dtype=np.uint64).astype(np.int64)), int(two.sum(dtype=np.uint64).astype(np.int64))


def _signed(values: np.ndarray) -> np.ndarray:
    """The same order as signed integers."""
    return (values ^ np.uint64(1 << 63)).view(np.int64)


def _keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text and h: rows with equal doc_id and h are repeated rows."""
    return documents.select("doc_id", "text", F.xxhash64("text").alias("h"))


def sketches(documents: DataFrame, k: int, plan: Plan, size: int = SKETCH) -> DataFrame:
    """doc_id, h, n, f1, f2 (a 128-bit hash of the set) and the keys of the sketch."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                low, prints, n = [], [], []
                for x in shingle_sets(part, k):
                    low.append(x[:size].copy())
                    prints.append(_fingerprint(x))
                    n.append(len(x))
                found, first = plan.keys(low, np.array(n, dtype=np.int64))
                arrays = [part.column("doc_id"), part.column("h"), pa.array(n, pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*prints)), pa.ListArray.from_arrays(first.astype(np.int32), found.view(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "h", "n", "f1", "f2", "keys"])

    return _keyed(documents).mapInArrow(make, "doc_id bigint, h bigint, n bigint, f1 bigint, f2 bigint, keys array<bigint>")


def full_sets(documents: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node, n and full shingle set, ascending, of the wanted representatives (node, doc_id, h), once for each row that has both."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                found = [_signed(own) for own in shingle_sets(part, k)]
                arrays = [part.column("node"), pa.array([len(x) for x in found], pa.int64()), pa.array(found, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["node", "n", "own"])

    asked = wanted.select("node", F.col("doc_id").alias("d"), F.col("h").alias("g"))
    rows = _keyed(documents).join(asked, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")))
    return rows.select("node", "text").mapInArrow(make, "node bigint, n bigint, own array<bigint>")


def _alike(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


class Linker:
    """Links between the representatives of one table."""

    def __init__(self, documents: DataFrame, k: int, percent: int, size: int = SKETCH):
        self.documents, self.k, self.percent, self.size = documents, k, percent, size
        self.low = least_shared(size, percent)
        made = durable(sketches(documents, k, Plan.of(percent), size).withColumn("node", F.monotonically_increasing_id()))
        self.rows = made.drop("keys")
        firsts = made.filter("n > 0").groupBy("f1", "f2", "n").agg(F.min(F.struct("node", "doc_id", "h")).alias("x"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys"))
        self.firsts = durable(firsts.select("f1", "f2", "n", "x.node", "x.doc_id", "x.h", "copies", "keys"))

    def lists(self) -> DataFrame:
        """key, node, n, weight: the keys that several representatives have; the weight of a node sums up its lists' lengths."""
        each = self.firsts.select("node", "n", F.explode("keys").alias("key"))
        met = keys(each.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "key", "c")
        out = durable(each.join(met, "key").distinct())
        weights = out.groupBy("node").agg(F.sum("c").alias("weight"))
        return durable(out.drop("c").join(weights, "node"))

    def read_sets(self, nodes: DataFrame) -> None:
        """The full sets of the nodes. Repeated rows of a text would give a set twice."""
        wanted = durable(self.firsts.select("node", "doc_id", "h").join(nodes, "node", "left_semi"))
        count = wanted.count()
        found = durable(full_sets(self.documents, F.broadcast(wanted) if count <= BROADCAST else wanted, self.k))
        self.sets = found if found.count() == count else durable(found.dropDuplicates(["node"]))

    def _both(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs with a and b, what `sets` (node, own) has for u and v; without those that it lacks."""
        one, two = (sets.select(F.col("node").alias(x), F.col("own").alias(y)) for x, y in (("u", "a"), ("v", "b")))
        return free(free(pairs, "u").join(free(one, "u"), "u"), "v").join(free(two, "v"), "v")

    def estimated(self, pairs: DataFrame) -> DataFrame:
        """Pairs (u, v) that the sketch of their union leaves possible; sure, where the sketches are the whole sets and so decide."""
        held = F.slice("own", 1, self.size + 1)  # one more tells a longer set
        both = self._both(pairs, self.sets.select("node", held.alias("own")))
        both = both.withColumn("sure", F.greatest(F.size("a"), F.size("b")) <= self.size)
        a, b = F.slice("a", 1, self.size), F.slice("b", 1, self.size)
        x = F.size(F.array_intersect(F.array_intersect(a, b), F.slice(F.sort_array(F.array_union(a, b)), 1, self.size)))
        linked = (100 + self.percent) * F.size(F.array_intersect("a", "b")) >= self.percent * (F.size("a") + F.size("b"))
        # the union with a longer set fills the sketch
        return durable(both.filter(F.when(F.col("sure"), linked).otherwise(x >= self.low)).select("u", "v", "sure"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Pairs (u, v) whose full sets are as alike as asked."""
        found = self.estimated(durable(pairs))
        long = self.sets.filter(100 * F.col("n") >= self.percent * self.size)  # a partner of a longer set than a sketch
        both = self._both(found.filter("NOT sure").select("u", "v"), long).withColumn("i", F.size(F.array_intersect("a", "b")))
        linked = both.filter(100 * F.col("i") >= self.percent * (F.size("a") + F.size("b") - F.col("i")))
        return durable(found.filter("sure").select("u", "v").union(linked.select("u", "v")))

    def led(self, lists: DataFrame) -> DataFrame:
        """Pairs of each node and the leaders that it shares most lists with."""
        leaders = lists.groupBy("key").agg(F.max(F.struct("weight", F.col("node").alias("v"), F.col("n").alias("m"))).alias("x")).select("key", "x.v", "x.m")
        met = free(lists, "key").join(keys(leaders, "key", "v", "m"), "key").filter((F.col("node") != F.col("v")) & _alike(F.col("n"), F.col("m"), self.percent))
        shared = met.groupBy("node", "v").agg(F.count(F.lit(1)).alias("c"))
        best = shared.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", "v")), False), 1, TRIED).alias("best"))
        return best.select(F.col("node").alias("u"), F.explode("best").alias("x")).select("u", "x.v")

    def need(self, n: Column) -> Column:
        """Retained values that a partner of a set of n shingles shares at least."""
        whole = F.ceil(n * self.percent / 100)
        return F.when(n * 100 <= self.size * self.percent, whole).otherwise(F.least(whole, F.lit(self.low)))

    def rare(self, lists: DataFrame, found: DataFrame) -> DataFrame:
        """Pairs of different components that share a list and, of their rarest retained values, one that they must share."""
        now = durable(free(lists, "node").join(free(found, "node"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("c")))
        kinds = F.min("c").alias("c1"), F.max("c").alias("c2")  # what one component has alone makes no pair
        mixed = now.groupBy("key").agg(*kinds).filter("c1 <> c2")
        open_ = durable(free(now, "key").join(keys(mixed, "key"), "key").select("node", "c").distinct())
        held = durable(free(self.sets, "node").select("node", "n", F.slice("own", 1, self.size).alias("own")).join(free(open_, "node"), "node"))
        each = held.select("node", "c", F.explode("own").alias("value"))
        often = keys(each.groupBy("value").agg(F.count(F.lit(1)).alias("df"), *kinds).filter("c1 <> c2"), "value", "df")
        shared = each.select("node", "value").join(often, "value").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("held"))
        size, n = F.least(F.col("n"), F.lit(self.size)), F.col("n")
        most = (F.size("held") - self.need(n) + 1).cast("int")  # values that no other component's sketch has come first
        values = F.transform(F.slice("held", F.lit(1), F.col("most")), lambda x: x["value"])
        first = held.select("node", "n", "c").join(shared, "node").withColumn("most", most).filter("most > 0")
        first = durable(first.select("node", "n", "c", F.size("held").alias("k"), values.alias("held")))
        known = self._known_to_others(first.select("node", "n", "c", "k"))
        first = free(first, "node").join(keys(known, "node", "known"), "node")
        before = lambda x, i: F.when(i > 0, F.get("held", i - 1))
        places = F.transform("held", lambda x, i: F.struct(x.alias("value"), (F.col("k") - i).cast("bigint").alias("left"), before(x, i).alias("before")))
        small = F.col("known") * (100 + self.percent) >= 2 * self.percent * n  # else it is the smaller of no linked pair
        out = durable(first.select("node", "n", "c", "known", small.alias("small"), F.explode(places).alias("x")).select("node", "n", "c", "known", "small", "x.value", "x.left", "x.before"))
        counted = out.groupBy("value", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("value").agg(F.max(F.struct("k", "c")).alias("top"), F.count(F.lit(1)).alias("kinds"))
        tops = keys(counted.filter("kinds > 1").select("value", F.col("top.c").alias("main"), F.when(F.col("top.k") >= CROWD, F.col("top.c")).alias("crowd")), "value", "main", "crowd")
        out = durable(free(out, "value").join(tops, "value"))
        judged, around = self._around(out.filter("crowd IS NOT NULL").select("node", "n", "c", "crowd").distinct(), lists)
        judged = keys(judged.select("node", F.col("crowd").alias("main"), "near"), "node", "main", "near")
        out = durable(free(out.drop("crowd"), "node", "main").join(judged, ["node", "main"], "left"))
        minor = out.filter("c <> main")
        other = free(out, "value").select("value", F.col("node").alias("v"), F.col("n").alias("m"), F.col("c").alias("d"), F.col("left").alias("rest"), F.col("before").alias("past"), F.col("known").alias("known_too"), F.col("small").alias("small_too"), F.col("near").alias("near_too"))
        m = F.col("m")
        whole = (n <= self.size) & (m <= self.size)
        need = F.when(whole, F.ceil((n + m) * self.percent / (100 + self.percent))).otherwise(F.least(F.ceil(F.greatest(n, m) * self.percent / 100), F.lit(self.low)))
        settled = F.when(F.col("d") == F.col("main"), (F.col("near") + F.col("near_too")).isNotNull()).otherwise(F.coalesce(F.col("near") * F.col("near_too"), F.lit(0)) == 1)
        apart = (F.col("c") != F.col("d")) & ((F.col("d") == F.col("main")) | (F.col("node") < F.col("v"))) & ~settled
        # where they meet again less is left, so all that meet with enough left are those that first meet with enough; a run of meetings is told by its first
        first = F.coalesce(F.col("before") != F.col("past"), F.lit(True))
        enough = F.least("known", "known_too") * (100 + self.percent) >= self.percent * (n + m)
        sound = apart & _alike(n, m, self.percent) & (F.least("left", "rest") >= need) & enough & first
        # the smaller of a pair is small, so of two that are not nothing is formed
        met = [free(minor.filter("small"), "value").join(other, "value").filter(sound), free(minor.filter("NOT small"), "value").join(other.filter("small_too"), "value").filter(sound)]
        return met[0].union(met[1]).select(F.least("node", "v").alias("u"), F.greatest("node", "v").alias("v")).union(around).distinct()

    def _around(self, places: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of nodes (node, n, c) that meet a component, crowd: near, 1 if they can be linked with one of it or are of it and else 0; and the pairs (u, v) of near ones that can be linked.

        With d(u) what u and the centre do not have in common, u and v do not have d(u) ^ d(v) in common,
        so they are linked if |d(u) & d(v)| is half of excess(u) + excess(v) at least; `excess` is |d(u)| less what u adds to the difference allowed.
        """
        places, more, less = durable(places), 100 + self.percent, 100 - self.percent
        weights = free(lists, "node").select("node", "weight").distinct()
        centres = places.filter("c = crowd").join(weights, "node").groupBy("crowd").agg(F.max(F.struct("weight", "node")).alias("x"))
        centred = free(places, "crowd").join(keys(centres.select("crowd", F.col("x.node").alias("v")), "crowd", "v"), "crowd")
        both = self._both(centred.withColumnRenamed("node", "u"), self.sets.select("node", "own"))
        far = both.select(F.col("u").alias("node"), "n", "c", "crowd", F.concat(F.array_except("a", "b"), F.array_except("b", "a")).alias("own"))
        far = durable(far.withColumn("excess", more * F.size("own").cast("bigint") - less * F.col("n")))
        reach = keys(far.filter("c = crowd").groupBy("crowd").agg(F.max(F.col("excess") + 2 * less * F.col("n")).alias("reach")), "crowd", "reach")
        far = durable(free(far, "crowd").join(reach, "crowd").withColumn("near", (F.col("excess") <= F.col("reach")).cast("int")).drop("reach"))
        near = far.filter("near = 1")
        least = near.groupBy("crowd").agg(F.min(F.struct("excess", "node", "c")).alias("x")).select("crowd", F.col("x.excess").alias("least"), F.col("x.node").alias("z"), F.col("x.c").alias("d"))
        least = keys(least, "crowd", "least", "z", "d")
        # two whose excesses make up for each other are linked, and so is either with the one of the least excess
        sure = free(near, "crowd").join(least, "crowd").filter("excess + least <= 0 AND c <> d").select("node", F.col("z").alias("v"))
        each = near.select("node", "crowd", "c", F.explode("own").alias("value"))
        often = each.groupBy("crowd", "value").agg(F.count(F.lit(1)).alias("df"), F.min("c").alias("c1"), F.max("c").alias("c2")).filter("c1 <> c2")
        shared = free(each.select("node", "crowd", "value"), "crowd", "value").join(keys(often, "crowd", "value", "df"), ["crowd", "value"])
        held = shared.groupBy("node", "crowd").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("held"))
        first = free(near.drop("own", "near"), "node", "crowd").join(held, ["node", "crowd"])
        first = free(first, "crowd").join(least.select("crowd", "least"), "crowd")
        most = (F.size("held") - F.greatest(F.lit(1), F.ceil((F.col("excess") + F.col("least")) / (2 * more))) + 1).cast("int")
        first = first.withColumn("most", most).filter("most > 0").withColumn("k", F.size("held").cast("bigint"))
        places = F.transform(F.slice("held", F.lit(1), F.col("most")), lambda x, i: F.struct(x["value"].alias("value"), (F.col("k") - i).alias("left")))
        out = durable(first.select("node", "n", "c", "crowd", "excess", F.explode(places).alias("x")).select("node", "n", "c", "crowd", "excess", "x.value", "x.left"))
        other = out.select("crowd", "value", F.col("node").alias("v"), F.col("n").alias("m"), F.col("c").alias("d"), F.col("excess").alias("excess_too"), F.col("left").alias("rest"))
        apart = (F.col("c") != F.col("d")) & ((F.col("d") == F.col("crowd")) | (F.col("node") < F.col("v")))
        both = F.col("excess") + F.col("excess_too")
        sound = apart & _alike(F.col("n"), F.col("m"), self.percent) & (both > 0) & (2 * more * F.least("left", "rest") >= both)
        met = free(out.filter("c <> crowd"), "crowd", "value").join(free(other, "crowd", "value"), ["crowd", "value"]).filter(sound)
        return far.select("node", "crowd", "near"), durable(sure.union(met.select("node", "v")).select(F.least("node", "v").alias("u"), F.greatest("node", "v").alias("v")).distinct())

    def _known_to_others(self, nodes: DataFrame) -> DataFrame:
        """node and known, the size of what its full set shares with nodes of other components; nodes that can have no link go.

        Of nodes (node, n, c, k) k is that size for sets that the sketch holds whole. Larger ones are counted among those that may be linked with one.
        """
        n, long = F.col("n"), nodes.filter(F.col("n") > self.size)
        known = nodes.filter(n <= self.size).select("node", "n", F.col("k").alias("known"))
        if not long.isEmpty():
            near = nodes.filter(100 * n >= self.percent * self.size).select(F.col("node").alias("w"), "c")
            near = F.broadcast(near) if near.count() <= BROADCAST else free(near, "w")
            each = free(self.sets, "node").join(near, F.col("node") == F.col("w")).select("node", "n", "c", F.explode("own").alias("value"))
            often = keys(each.groupBy("value").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).filter("c1 <> c2"), "value")
            whole = free(each.filter(n > self.size).select("node", "n", "value"), "value").join(often, "value").groupBy("node", "n").agg(F.count(F.lit(1)).alias("known"))
            known = known.union(whole.select("node", "n", "known"))
        return known.filter(F.col("known") * 100 >= self.percent * n).select("node", F.col("known").cast("bigint").alias("known"))

    def classes(self) -> DataFrame:
        """node and component of the representatives that have a link."""
        lists = self.lists()
        self.read_sets(lists.select("node").distinct())
        links = self.verified(self.led(lists))
        found = durable(components(links, "u", "v"))
        more = self.verified(self.rare(lists, found))
        return durable(components(links.union(more), "u", "v"))


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach) and kept, one row per document."""
    rows = grouped(documents, k, percent)
    least = keys(rows.filter("c IS NOT NULL").groupBy("c").agg(F.min("doc_id").alias("least")), "c", "least")
    out = free(rows, "c").join(least, "c", "left").withColumn("component_id", F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("least")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def grouped(documents: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, h (hash of the text), n and c (the group's number, null where a document is alone), one row per document."""
    linker = Linker(documents, k, percent)
    found = linker.classes().withColumnRenamed("node", "member")
    firsts = linker.firsts.select("f1", "f2", "n", "node", "copies")
    classes = firsts.join(found, F.col("node") == F.col("member"), "left").filter("copies > 1 OR component IS NOT NULL")
    classes = keys(classes.withColumn("c", F.coalesce("component", "node")), "f1", "f2", "n", "c")
    return durable(free(linker.rows, "f1", "f2", "n").join(classes, ["f1", "f2", "n"], "left").select("doc_id", "h", "n", "c"))


def one_of_each(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with their columns, of which one of each group of near duplicates stays: that with the smallest doc_id.

    Rows are told apart by doc_id and text, so different texts that share an id, or have none, are different documents; of
    repeated rows of the one that stays, one stays. Rows without doc_id stay only if their group has no other.
    """
    rows = grouped(documents, k, percent).filter("c IS NOT NULL")
    rows = durable(rows.groupBy("c", "doc_id", "h").agg(F.count(F.lit(1)).alias("times")))
    first = keys(rows.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("x")).select("c", F.col("x.doc_id").alias("d"), F.col("x.h").alias("g")), "c", "d", "g")
    kept = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g"))
    judged = durable(free(rows, "c").join(first, "c").select("doc_id", "h", "times", kept.alias("kept")))
    gone, twice = judged.filter("NOT kept"), judged.filter("kept AND times > 1")
    out = by_content(documents, gone, "left_anti")
    if twice.isEmpty():
        return out
    once = by_content(documents, twice, "left_semi").select(F.struct(*documents.columns).alias("_row"), F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_h"))
    return by_content(out, twice, "left_anti").unionByName(once.dropDuplicates(["_d", "_h"]).select("_row.*"))
