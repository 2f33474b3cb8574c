import random

import numpy as np
import pyarrow as pa

from sluice.llm import quality_classifier as C


def test_means():
    assert C.means(np.array([1.0, 3.0, 5.0]), np.array([0, 2, 2, 3])).tolist() == [2.0, 0.0, 5.0]


def test_features_follow_the_words_of_each_text():
    one, first = C.features(pa.array(["a bc", None, "", "Bc!! \n a"]))
    alone = [C.features(pa.array([x]))[0].tolist() for x in ("a bc", "Bc!! \n a")]
    assert first.tolist() == [0, 8, 8, 8, 16] and one.tolist() == alone[0] + alone[1]
    again = C.features(pa.array(["x y x x", "x"]))[0].reshape(-1, 4)[:, 3]
    assert again[0] == again[1] == again[4] and len({*again[[0, 2, 3]].tolist()}) == 3


def corpus(n):
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 8)))
    rows = []
    for i in range(n):
        text = ". ".join(" ".join(word() for _ in range(12)) for _ in range(10)).capitalize() + "."
        kind = i % 10
        rows.append((i, {7: text.upper().replace(" ", "!! "), 8: text.replace(" ", "$$$ "), 9: text.replace(" ", " | ")}.get(kind, text)))
    return rows


def test_junk_is_told_from_prose(spark):
    rows = corpus(400) + [(1000, None), (1001, ""), (1002, "x" * 100_000), (1003, "one"), (1003, "one"), (None, "no id")]
    frame = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    out = C.classified(frame, sample=300).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["kept"] == (r["score"] >= 0.5) for r in out)
    right = [r["kept"] == (r["doc_id"] % 10 < 7) for r in out if r["doc_id"] is not None and r["doc_id"] < 400]
    assert sum(right) == 400


def test_scores_are_the_mean_weight_of_hashed_words(spark):
    frame = spark.createDataFrame(corpus(60) + [(1000, None)], "doc_id long, text string")
    weights, bias = C.train(frame)
    got = {r["doc_id"]: r["score"] for r in C.score(frame, weights, bias).collect()}
    for i, text in [*corpus(60), (1000, "")]:
        words, buckets = text.split(), []
        for j, w in enumerate(words):
            near = next((d for d in range(1, C.NEAR + 1) if j >= d and words[j - d].lower() == w.lower()), 0)
            again = C.features(pa.array([" ".join([w, *(["-"] * (near - 1)), w])]))[0].reshape(-1, 4)[-1, 3] if near else C.features(pa.array([w]))[0][3]
            buckets += [*C.features(pa.array([w]))[0][:3].tolist(), int(again)]
        want = 1 / (1 + np.exp(-(sum(weights[b] for b in buckets) / max(1, len(buckets)) + bias)))
        assert abs(got[i] - want) < 1e-9


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    rows = C.classified(documents).join(labels, "doc_id").join(documents.select("doc_id", "text"), "doc_id").collect()
    rows = [r for r in rows if len(r["text"].split()) >= 50]
    good, bad = [r["kept"] for r in rows if r["quality"]], [r["kept"] for r in rows if not r["quality"]]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.02 * len(bad)


def test_empty_table(spark):
    assert C.classified(spark.createDataFrame([], "doc_id long, text string")).count() == 0
