import re
from collections import Counter

import pytest

from sluice.llm import quality_rules as Q

WORD = r"[^\x20\x09-\x0D]+"
PROSE = " ".join(f"word{i} goes w{i * 7} then{'.' if i % 9 == 0 else ''}" for i in range(60)) + " end."
TEXTS = [
    None, "", " \n\t ", "one", "a b c", "a b c a b c", "x x x x x x", "a\nb\na\n\n \n \nb \r", "#*$%&|<> plain", "é ü \x0b\x0c z", "A B\r\nA B\r\n",
    PROSE, PROSE, PROSE + "\n" + PROSE, "THE WORDS!! " * 40, "we$$$ are*** odd### " * 40, " | ".join(f"cell{i}" for i in range(200)), "spam and eggs now. " * 5000, "ab" * 50_000,
]


def base(text):
    text = text or ""
    w = re.findall(WORD, text)
    seen, covered = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, x, "en", 1) for i, x in enumerate(TEXTS)] + [(100 + i, PROSE.replace("word", f"w{i}"), "xx", 2) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, v_lines int")


def test_base_counts_equal_brute_force(frame):
    got = {r["doc_id"]: r for r in Q.judge(frame).collect()}
    assert len(got) == len(TEXTS) + 60
    for i, text in enumerate(TEXTS):
        want = base(text)
        assert tuple(got[i][x] for x in Q.BASE) == want, repr(text)[:60]
        assert got[i]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (got[i]["base_failed"] and got[i]["kept"])


def test_clean_is_kept_and_junk_is_not(frame):
    kept = {r["doc_id"] for r in Q.judge(frame).filter("kept").collect()}
    assert {11, 12, *range(100, 160)} <= kept and not kept & {14, 15, 17}
    rows = Q.filtered(frame)
    assert rows.columns == frame.columns and {r["doc_id"] for r in rows.collect()} == kept


def test_no_python_on_the_executors(frame):
    plan = Q.votes(frame.select("text"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|MapPartitions", plan)


def test_expectation_maximisation_finds_the_accuracies():
    import random

    draw, counts = random.Random(1), Counter()
    for _ in range(20_000):
        good = draw.random() < 0.8
        counts[tuple(0 if draw.random() < 0.3 else (-1 if draw.random() < (0.02 if good else 0.6) else 1) for _ in range(6))] += 1
    prior, ratios = Q.fit(counts, 6)
    assert abs(prior - 1.386) < 0.1 and all(abs(x[-1] + 3.4) < 0.3 and abs(x[1] - 0.896) < 0.1 and x[0] == 0 for x in ratios)


def votes(text):
    """The rules, read off the text letter by letter."""
    text = text or ""
    n, chars, symbols, dup, repeat = base(text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    closed = sum(x.rstrip(" \t\n\x0b\x0c\r")[-1] in Q.CLOSING for x in lines)
    upper, shouts = sum("A" <= c <= "Z" for c in text), sum(c in "!?" for c in text)
    wordless = sum(not any(c.isalnum() for c in w) for w in re.findall(WORD, text))
    distinct = len(set(re.findall(WORD, text)))
    runs = len(re.findall(r"([#*$%&|<>=~_^!?.-])\1\1", text))
    vote = lambda bad, good: -1 if bad else 1 if good else 0
    return (
        vote(20 * symbols > chars, 200 * symbols <= chars), vote(10 * wordless > n, 50 * wordless <= n), vote(20 * runs > n, 200 * runs <= n),
        vote(2 * closed < len(lines) and len(lines) >= 3, 5 * closed >= 4 * len(lines)), vote(3 * repeat > n, 20 * repeat <= n), vote(distinct**2 < 4 * n and n >= 20, distinct**2 >= 16 * n), vote(dup >= 3 and 3 * dup > len(lines), dup == 0),
        vote(3 * upper > chars, 10 * upper <= chars), vote(5 * shouts > n, 50 * shouts <= n), vote(chars < 2 * n or chars > 14 * n, 3 * n <= chars <= 9 * n),
    )


def brute_verdicts(texts):
    """Expectation-maximisation over documents one by one."""
    import math

    voted = [votes(x) for x in texts]
    m, share = len(voted[0]), Q.SHARE_GOOD
    good, bad = [Q.FALSE_ALARMS[0]] * m, [Q.ALARMS[0]] * m
    for rounds in range(Q.ROUNDS + 1):
        q = []
        for v in voted:
            odds = math.log(share / (1 - share))
            for x, g, b in zip(v, good, bad):
                odds += math.log(g / b) if x < 0 else math.log((1 - g) / (1 - b)) if x > 0 else 0
            q.append(1 / (1 + math.exp(-odds)))
        if rounds == Q.ROUNDS:
            return q
        for rates, (rate, weight), p in ((good, Q.FALSE_ALARMS, q), (bad, Q.ALARMS, [1 - x for x in q])):
            rates[:] = [(rate * weight + sum(x for x, v in zip(p, voted) if v[j] < 0)) / (weight + sum(x for x, v in zip(p, voted) if v[j])) for j in range(m)]
        share = min(0.999, max(0.5, (sum(q) + 9) / (len(q) + 10)))


def test_votes_and_verdict_equal_brute_force(frame):
    rows = frame.select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in Q.judge(frame).collect()}
    for (i, text), q in zip(rows, brute_verdicts([r["text"] for r in rows])):
        assert tuple(got[i][x] for x in Q.rules()) == votes(text), repr(text)[:60]
        assert abs(got[i]["quality"] - q) < 1e-6
        assert got[i]["kept"] == (not got[i]["base_failed"] and q >= 0.5)


def test_labelled_rows(spark):
    folder = "/root/testdata/sf0.01"
    rows = Q.judge(spark.read.parquet(f"{folder}/documents.parquet")).filter("NOT base_failed").join(spark.read.parquet(f"{folder}/labels.parquet").withColumnRenamed("quality", "label"), "doc_id").collect()
    good, bad = [r["kept"] for r in rows if r["label"]], [r["kept"] for r in rows if not r["label"]]
    assert len(good) > 250 and all(good) and len(bad) > 20 and not any(bad)


def test_empty_table(spark):
    assert Q.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0
