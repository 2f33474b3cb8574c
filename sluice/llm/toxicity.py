"""Toxic passages by maximum-scoring segment search.

Fit: log odds of words with an informative Dirichlet prior between toxic and clean labelled texts; words
whose log odds stand out by Z standard errors form the lexicon, all others share one small
negative score. Near copies among the labelled texts, told by two minima over hashes of their word pairs, count once. Search: a linear scan finds all
maximal segments of a text. Calibration: lambda and K of the extreme-value law on clean text turn a
segment's score into the number of such segments that chance would bring (E), and a
logistic curve over the best and the summed significant evidence, fitted on a fold that the lexicon has
not seen, gives the probability.

The fit uses at most SAMPLE labelled rows, those with the smallest hash of doc_id, ties by doc_id; the lexicon comes of these
rows' words alone, so its size has their bound and it can be broadcast. Null and empty texts score as texts without a
lexicon word; texts of any length are read whole. Labels without a text, and null labels, are left out of the fit; without
usable labels every score is 0, and without documents there are no rows. Repeated rows are scored each; a row without doc_id is
scored and not held out. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import blocks, durable, mix

SAMPLE = 40_000
#: Standard errors by which log odds must differ from zero, and texts that must hold the word.
Z, LEAST_TEXTS = 3.0, 3
#: The prior: counts seen before, shared out by frequency, and besides for each word.
PRIOR, FLOOR = 500.0, 0.5
#: A segment counts where chance brings fewer such segments to a text.
SIGNIFICANT = 0.05
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1

_PLAIN = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII punctuation parts them."""
    return (text or "").lower().encode().translate(_PLAIN).split()


def segments(hits: list[tuple[int, float]], rest: float) -> list[tuple[int, int, float]]:
    """All maximal segments (first word, last word, score), each word outside the hits scoring `rest` < 0.

    The scan of Ruzzo and Tompa: a stack of candidates with the cumulative scores before and after each.
    """
    stack: list[tuple[int, int, float, float]] = []
    total, at = 0.0, 0
    for i, score in hits:
        total += rest * (i - at)
        at = i + 1
        if score <= 0:
            total += score
            continue
        first, left, right = i, total, total + score
        total = right
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= right:
                stack.append((first, i, left, right))
                break
            first, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, right - left) for a, b, left, right in stack]


@dataclass
class Model:
    weights: dict[bytes, float] = field(default_factory=dict)
    rest: float = -1e-3
    rate: float = 1.0  # lambda
    k: float = 1.0
    curve: tuple[float, float, float] | None = None

    def expected(self, score: float, n: int) -> float:
        """Segments of at least this score that clean text of n words brings by chance."""
        return self.k * n * math.exp(-min(700.0, self.rate * score))

    def passages(self, text: str | None) -> list[tuple[int, int, float, float]]:
        """Significant toxic passages: first word, last word, score and E."""
        words = tokens(text)
        found = segments([(i, self.weights[w]) for i, w in enumerate(words) if w in self.weights], self.rest)
        return [(a, b, s, e) for a, b, s in found if (e := self.expected(s, len(words))) < SIGNIFICANT]

    def evidence(self, text: str | None) -> tuple[float, float, int, int]:
        """-log E of the best segment, log of the summed -log E of significant ones, their number, words."""
        words = tokens(text)
        held = self.weights
        hits = [(i, held[w]) for i, w in enumerate(words) if w in held]
        if not hits:
            return 0.0, 0.0, 0, len(words)
        logs = [-math.log(max(self.expected(s, len(words)), 1e-300)) for _, _, s in segments(hits, self.rest)]
        strong = [x for x in logs if x > -math.log(SIGNIFICANT)]
        return max(0.0, min(40.0, max(logs))), math.log1p(sum(strong)), len(strong), len(words)

    def probability(self, best: float, summed: float) -> float:
        if self.curve is None:
            return 0.0
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, a + b * best + c * summed))))


def fold(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def labelled(documents: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """At most `sample` training rows: text, label and fold. The ids are few enough to broadcast."""
    chosen = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & (fold("doc_id") != HELD_OUT))
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return documents.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").withColumn("fold", fold("doc_id"))


def distinct_words(rows: DataFrame) -> DataFrame:
    """Fold, label and distinct words of each text, one text for each pair of word-pair minima: near copies count once."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, toxic, part in zip(*(batch.column(x).to_pylist() for x in ("text", "toxic", "fold"))):
                words = tokens(text)
                own = list(dict.fromkeys(words))
                h = np.array([xxhash.xxh3_64_intdigest(w) for w in words] or [0], dtype=np.uint64)
                pairs = mix(mix(h[:-1]) * np.uint64(3) + mix(h[1:])) if len(h) > 1 else mix(h)
                out.append((int(pairs.min() >> np.uint64(1)), int(mix(pairs ^ np.uint64(0x5851F42D4C957F2D)).min() >> np.uint64(1)), toxic, part, own))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 5, kinds)], names=["m1", "m2", "toxic", "fold", "words"])

    found = rows.select("text", "toxic", "fold").mapInArrow(sets, "m1 bigint, m2 bigint, toxic int, fold bigint, words array<binary>")
    return found.groupBy("m1", "m2", "toxic").agg(F.min(F.struct("fold", "words")).alias("x")).select("toxic", "x.*")


def log_odds(rows: DataFrame, z: float = Z, prior: float = PRIOR) -> Model:
    """Lexicon and background out of the words of labelled texts (toxic, words)."""
    counts = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    counts = durable(counts)
    t, c = (float(x or 0) for x in counts.agg(F.sum("t"), F.sum("c")).first())
    if not t or not c:
        return Model()
    share = FLOOR + prior * (F.col("t") + F.col("c")) / (t + c)
    y1, y0 = F.col("t") + share, F.col("c") + share
    delta = F.log(y1 / (t + prior - y1)) - F.log(y0 / (c + prior - y0))
    scored = counts.withColumn("delta", delta).withColumn("z", F.col("delta") / F.sqrt(1 / y1 + 1 / y0))
    kept = scored.filter((F.col("t") >= LEAST_TEXTS) & (F.col("z") >= z)).orderBy(F.desc("z"), "word").collect()  # of at most SAMPLE texts
    model = Model({bytes(r["word"]): float(r["delta"]) for r in kept})
    p1 = min(0.5, sum(r["t"] for r in kept) / (t + prior))
    clean = {bytes(r["word"]): (r["c"] + FLOOR + prior * (r["t"] + r["c"]) / (t + c)) / (c + prior) for r in kept}
    p0 = min(0.5, sum(clean.values()))
    model.rest = min(-1e-4, math.log((1 - p1) / (1 - p0)))
    low, high = 1e-6, 50.0  # lambda: sum of p exp(lambda s) over clean words is 1
    for _ in range(100):
        mid = (low + high) / 2
        total = (1 - p0) * math.exp(mid * model.rest) + sum(p * math.exp(min(600.0, mid * model.weights[w])) for w, p in clean.items())
        low, high = (low, mid) if total > 1 else (mid, high)
    model.rate = max(low, 0.05)
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps on the penalised likelihood."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if abs(step).max() < 1e-9:
            break
    return w


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = durable(distinct_words(labelled(documents, labels, sample)))
    model = log_odds(rows.filter(F.col("fold") != CALIBRATION).select("toxic", "words"))
    if not model.weights:
        return model
    held = documents.sparkSession.sparkContext.broadcast(model)
    stats = labelled(documents, labels, sample).filter(F.col("fold") == CALIBRATION)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            out = []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = tokens(text)
                found = segments([(i, own.weights[w]) for i, w in enumerate(words) if w in own.weights], own.rest)
                out.append((toxic, len(words), [s for _, _, s in found]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 3, (pa.int32(), pa.int64(), pa.list_(pa.float64())))], names=["toxic", "n", "scores"])

    seen = stats.select("text", "toxic").mapInArrow(measure, "toxic int, n bigint, scores array<double>").collect()  # at most `sample` rows
    clean = [r for r in seen if not r["toxic"]]
    least = min(model.weights.values())
    chance = sum(s >= least for r in clean for s in r["scores"]) + 0.5
    model.k = chance / max(1.0, sum(r["n"] for r in clean) * math.exp(-model.rate * least))
    x, y = [], []
    for r in seen:
        logs = [-math.log(max(model.expected(s, r["n"]), 1e-300)) for s in r["scores"]]
        x.append((1.0, max(0.0, min(40.0, max(logs, default=0.0))), math.log1p(sum(v for v in logs if v > -math.log(SIGNIFICANT)))))
        y.append(r["toxic"])
    if y:
        model.curve = tuple(logistic(np.array(x), np.array(y, dtype=float)))
    return model


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, n_passages and best (-log E) for each whole text."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            for part in blocks(batch, "text"):
                found = [own.evidence(x) for x in part.column("text").to_pylist()]
                p = [own.probability(a, b) for a, b, _, _ in found]
                columns = [part.column("doc_id"), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32()), pa.array([x[2] for x in found], pa.int32()), pa.array([x[0] for x in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted", "n_passages", "best"])

    return documents.select("doc_id", "text").mapInArrow(scores, "doc_id bigint, score double, predicted int, n_passages int, best double")


def toxicity(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    out = score(documents, fit(documents, labels, sample))
    return out.select("doc_id", F.coalesce(fold("doc_id") == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted", "n_passages", "best")
