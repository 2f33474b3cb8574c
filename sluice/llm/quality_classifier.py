"""Quality classifier from weak labels.

The heuristic labellers of quality_rules overlap; expectation-maximisation over the counts of their vote
patterns, over all documents, estimates their accuracies and gives each document a posterior label. A
linear scorer over hashed words, word shapes and repetitions is trained on the posteriors of at most SAMPLE documents of
at most LONGEST words, those with the smallest hash of doc_id, and scores every whole text. No labelled table is read.

Null text is empty; a text without words has the score of the bias; texts of any length are scored whole. A score of just the
threshold keeps. Repeated rows are scored each, rows without doc_id too, which are not trained on. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import quality_rules as rules
from sluice.llm.common import Prefix, blocks, durable, text_bytes, words

SAMPLE = 6_000
#: Words of a text that is trained on at most, so that the sample is bounded in bytes too.
LONGEST = 5_000
BITS = 18
EPOCHS, RATE, RIDGE = 12, 0.5, 1e-4
KEEP_AT = 0.5
#: Words back in which a word is looked for.
NEAR = 8


def _shapes() -> np.ndarray:
    """Bytes by class: upper case, lower case, digit, end of sentence, letter beyond ASCII; other symbols stay."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91], out[97:123], out[48:58], out[128:] = 65, 97, 48, 97
    out[[33, 63]] = 33
    return out


_SHAPE = _shapes()


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Four buckets for each word, of itself, the shapes of its ends and how near before it stood, and where each text's begin (one more at the end)."""
    raw, offsets = text_bytes(texts)
    starts, ends, first = words(raw, offsets)
    shape = Prefix(_SHAPE[raw])
    shift = np.uint64(64 - BITS)
    size = ends - starts
    own = Prefix(raw, lower=True)(starts, ends)
    tail = shape(np.maximum(starts, ends - 3), ends) * np.uint64(0x9E3779B97F4A7C15) + np.minimum(size, 12).astype(np.uint64)
    front = shape(starts, np.minimum(starts + 2, ends)) * np.uint64(0xC2B2AE3D27D4EB4F)
    text = np.searchsorted(first, np.arange(len(own)), "right")
    near = np.zeros(len(own), dtype=np.uint64)
    for j in range(NEAR, 0, -1):
        near[j:][(own[j:] == own[:-j]) & (text[j:] == text[:-j])] = j
    again = (near + np.uint64(1)) * np.uint64(0xA0761D6478BD642F)
    mixed = np.stack([own, tail * np.uint64(0xD6E8FEB86659FD93), front * np.uint64(0xFF51AFD7ED558CCD), again], axis=1)
    return (mixed >> shift).astype(np.int64).ravel(), 4 * first


def means(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean of each stretch, 0 where it is empty."""
    sums = np.concatenate([[0.0], np.cumsum(values)])
    return (sums[first[1:]] - sums[first[:-1]]) / np.maximum(1, np.diff(first))


def posteriors(documents: DataFrame) -> DataFrame:
    """doc_id, n_words and the posterior probability of good."""
    names = list(rules.rules())
    voted = durable(rules.votes(documents.select("doc_id", "text")).select("doc_id", "n_words", *names))
    prior, ratios = rules.fit(rules.pattern_counts(voted, names), len(names))
    return voted.select("doc_id", "n_words", rules.posterior(names, prior, ratios).alias("label"))


def train(documents: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights by bucket and the bias. At most `sample` documents' buckets reach the driver."""
    chosen = posteriors(documents).filter(F.col("doc_id").isNotNull() & (F.col("n_words") <= LONGEST)).groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                bucket, first = features(part.column("text"))
                rows = [np.unique(bucket[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:])]
                arrays = [part.column("label"), pa.array([k.astype(np.int32) for k, _ in rows], pa.list_(pa.int32())), pa.array([(c / max(1, c.sum())).astype(np.float32) for _, c in rows], pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["label", "bucket", "share"])

    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("text", "label")
    table = rows.mapInArrow(hashed, "label double, bucket array<int>, share array<float>").toArrow()
    weights, bias, seen = np.zeros(1 << BITS), 0.0, np.full(1 << BITS, 1e-8)
    if not table.num_rows:
        return weights, bias
    labels = table.column("label").to_numpy()
    buckets, shares = table.column("bucket").to_pylist(), table.column("share").to_pylist()
    buckets, shares = [np.array(x, dtype=np.int64) for x in buckets], [np.array(x) for x in shares]
    bias_seen = 1e-8
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(labels)):
            p = 1 / (1 + np.exp(-np.clip(weights[buckets[i]] @ shares[i] + bias, -30, 30)))
            slope = p - labels[i]
            step = slope * shares[i] + RIDGE * weights[buckets[i]] * shares[i]
            seen[buckets[i]] += step * step
            weights[buckets[i]] -= RATE * step / np.sqrt(seen[buckets[i]])
            bias_seen += slope * slope
            bias -= RATE * slope / np.sqrt(bias_seen)
    return weights, float(bias)


def score(documents: DataFrame, weights: np.ndarray, bias: float, keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, score (probability of good) and kept."""
    held = documents.sparkSession.sparkContext.broadcast((weights, bias))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, add = held.value
        for batch in batches:
            for part in blocks(batch, "text"):
                bucket, first = features(part.column("text"))
                p = 1 / (1 + np.exp(-np.clip(means(own[bucket], first) + add, -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p), pa.array(p >= keep_at)], names=["doc_id", "score", "kept"])

    return documents.select("doc_id", "text").mapInArrow(scores, "doc_id bigint, score double, kept boolean")


def classified(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return score(documents, *train(documents, sample))
