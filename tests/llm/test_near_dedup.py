import random
import re

import numpy as np
import pytest

from sluice.llm import near_dedup as N
from sluice.llm.graph import components


def sets(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k):
    s = [(i, sets(t, k)) for i, t in rows]
    par = list(range(len(s)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a in range(len(s)):
        for b in range(a):
            x, y = s[a][1], s[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                par[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(s):
        least[find(a)] = min(least.get(find(a), i), i)
    return sorted((i, len(x), least[find(a)], i == least[find(a)]) for a, (i, x) in enumerate(s))


def corpus():
    draw, out = random.Random(5), []
    vocabulary = [f"w{i}" for i in range(400)]
    for n in (3, 12, 40, 90, 300):
        for _ in range(6):
            base = [draw.choice(vocabulary) for _ in range(n)]
            out.append(" ".join(base))
            for _ in range(5):
                words = list(base)
                for _ in range(draw.randint(0, max(1, n // 14))):
                    words[draw.randrange(len(words))] = draw.choice(vocabulary)
                out.append("  ".join(words).upper() if draw.random() < 0.2 else "\n".join(words))
    group = [f"g{i}" for i in range(120)]
    for _ in range(150):  # near copies of which few pairs with the first are links
        words = list(group)
        for _ in range(draw.randint(1, 9)):
            words[draw.randrange(len(words))] = f"r{draw.randrange(10**6)}"
        out.append(" ".join(words))
    out += [None, "", " \t\n", "One", "one", "one two", "ONE  two", "one one one", "é É", "é é", "x " * 20_000, "x " * 30_000]
    return list(enumerate(out, 10)) + [(12, out[2])]


@pytest.mark.parametrize("k", [2, 5])
def test_equals_brute_force(spark, k):
    rows = corpus()
    frame = spark.createDataFrame([(i, t, 7, "en") for i, t in rows], "doc_id long, text string, n int, node string")
    got = sorted(tuple(r) for r in N.near_duplicates(frame, k=k).collect())
    assert got == brute(rows, k)


def test_shuffled_texts_and_rows_without_id(spark, monkeypatch):
    monkeypatch.setattr(N, "BROADCAST", 0)
    base = " ".join(f"w{i}" for i in range(50))
    frame = spark.createDataFrame([(None, base), (5, base + " x"), (3, base), (9, "other words"), (4, "y " + base)], "doc_id long, text string")
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in N.near_duplicates(frame).collect()}
    assert got == {None: (3, False), 5: (3, False), 3: (3, True), 4: (3, False), 9: (9, True)}


def test_least_shared():
    draws = np.random.default_rng(0).binomial(64, 0.8, 200_000)
    t = N.least_shared(64, 80)
    assert (draws < t).sum() == 0 and N.least_shared(64, 80, 1e-2) > t


@pytest.mark.parametrize("n", [4, 5, 9, 16, 17, 20, 31, 40, 63, 64, 79, 100, 127, 200, 700])
def test_pairs_at_the_threshold_share_a_key(n):
    """Sets of n values and of up to n / 0.8 with just the asked Jaccard, the larger one on either side of a level's border."""
    draw, plan, missed = np.random.default_rng(n), N.Plan.of(80), 0
    for _ in range(400):
        more = int(draw.integers(0, n // 4 + 1))  # values of the other set alone
        values = draw.integers(0, 2**64, n + more, dtype=np.uint64)
        gone = min(n // 4 - more, int(n - 0.8 * (n + more)))
        a, b = np.unique(values[:n]), np.unique(values[max(0, gone) : n + more])
        assert 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
        held, first = plan.keys([a[: N.SKETCH], b[: N.SKETCH]], np.array([len(a), len(b)]))
        missed += not set(held[: first[1]].tolist()) & set(held[first[1] :].tolist())
    assert missed == 0


def test_one_of_each_group_stays_and_nothing_else_goes(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(3, base, "x"), (5, base + " x", "x"), (5, "other text of its own", "x"), (7, "lonely words", None), (None, base + " y", "x")]
    rows += [(None, "no id but two copies " * 3, "x")] * 2 + [(8, "the same row twice here", "x")] * 2 + [(9, None, "x"), (9, "", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _h string")
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in N.one_of_each(frame).collect())
    want = [(3, base), (5, "other text of its own"), (7, "lonely words"), (None, "no id but two copies " * 3), (8, "the same row twice here"), (9, None), (9, "")]
    assert got == sorted((str(a), str(b)) for a, b in want)
    assert N.one_of_each(frame).columns == frame.columns
    assert N.one_of_each(frame.limit(0)).count() == 0


def test_empty_table_and_no_links(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(empty).count() == 0
    two = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l"), (None, "m")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["kept"]) for r in N.near_duplicates(two).collect()) == [(0, False), (1, True), (2, True)]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160))


def template(n, words=1295, shared=1105, linked=0):
    """n texts that share the same words and have the rest of their own; the first `linked` share more, by pairs."""
    draw = random.Random(n)
    out = []
    for i in range(n):
        own = [f"r{draw.randrange(10**9)}" for _ in range(words - shared)]
        if i < linked and i % 2:
            own[: len(own) * 2 // 3] = out[-1][1].split()[shared : shared + len(own) * 2 // 3]
        out.append((i, " ".join([f"t{j}" for j in range(shared)] + own)))
    return out


def test_texts_of_a_template_form_no_pairs(spark):
    """Jaccard 0.74 between all; only those that share more are links. Pairs grow with the texts, not with their square."""
    formed = {}
    for n in (60, 240):
        rows = template(n, linked=n // 6)
        linker = N.Linker(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80)
        lists = linker.lists()
        linker.read_sets(lists.select("node").distinct())
        found = components(linker.verified(linker.led(lists)), "u", "v")
        formed[n] = linker.rare(lists, found).count()
    assert formed[60] <= 60 and formed[240] <= 240
    got = sorted(tuple(r) for r in N.near_duplicates(spark.createDataFrame(template(60, linked=10), "doc_id long, text string"), k=2).collect())
    assert got == brute(template(60, linked=10), 2)
    assert sum(i != c for i, _, c, _ in got) == 5


def test_sets_that_the_sketch_holds_whole_are_decided_by_it(spark):
    """Full sets are joined to pairs once more only where one of the two is longer than the sketch."""
    draw = random.Random(3)
    near = lambda base, k: base[:-k] + [f"r{draw.randrange(10**9)}" for _ in range(k)]
    short, long = [f"s{i}" for i in range(61)], [f"l{i}" for i in range(200)]
    texts = [short, near(short, 6), near(short, 7), long, near(long, 20), near(long, 60)]  # of 60 pairs 54 and 53 are shared, so 54 / 66 and 53 / 67
    linker = N.Linker(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), 2, 80, 64)
    node = {r["doc_id"]: r["node"] for r in linker.firsts.collect()}
    linker.read_sets(linker.firsts.select("node"))
    pairs = spark.createDataFrame([(node[a], node[b]) for a, b in ((0, 1), (0, 2), (3, 4), (3, 5), (0, 3))], "u long, v long")
    sure = {(r["u"], r["v"]) for r in linker.estimated(pairs).collect() if r["sure"]}
    assert sure == {(node[0], node[1])}
    assert {(r["u"], r["v"]) for r in linker.verified(pairs).collect()} == {(node[0], node[1]), (node[3], node[4])}


def test_places_carry_no_sets_and_give_each_pair_once(spark, monkeypatch):
    """What is dealt by value, a row for each place of a text, has a size of its own; a pair that meets at many places is formed once."""
    rows = template(40, words=300, shared=262, linked=20)
    linker = N.Linker(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80)
    lists = linker.lists()
    linker.read_sets(lists.select("node").distinct())
    written, durable = [], N.durable
    monkeypatch.setattr(N, "durable", lambda df: written.append(df) or durable(df))
    alone = linker.firsts.select("node", linker.firsts["node"].alias("component")).limit(0)
    pairs = sorted((r["u"], r["v"]) for r in linker.rare(lists, alone).collect())
    places = [df for df in written if "value" in df.columns and "node" in df.columns]
    assert places and not [t for df in places for _, t in df.dtypes if t.startswith("array")]
    assert len(pairs) == len(set(pairs)) == len({frozenset(x) for x in pairs}) > 0


def crowd(members, strays):
    """Near copies of a text, and texts with too many of the same edits to be linked with it; of the latter one in ten is a near copy of another."""
    draw, out = random.Random(members), []
    base = [f"b{i}" for i in range(120)]
    for i in range(members + strays):
        words = list(out[-1] if i > members and i % 10 == 0 else base)
        for p in draw.sample(range(120), 1 if words != base else draw.randint(1, 4) if i < members else draw.randint(8, 10)):
            words[p] = f"e{p}_{draw.randrange(5)}"
        out.append(words)
    return [(i, " ".join(words)) for i, words in enumerate(out)]


def test_texts_just_too_far_from_a_component_do_not_meet_all_of_it(spark):
    """Pairs grow with the texts, not with the product of near copies and of texts just too far from them."""
    formed = {}
    for n in (60, 240):
        linker = N.Linker(spark.createDataFrame(crowd(n, n // 3), "doc_id long, text string"), 2, 80)
        lists = linker.lists()
        linker.read_sets(lists.select("node").distinct())
        found = components(linker.verified(linker.led(lists)), "u", "v")
        formed[n] = linker.rare(lists, found).count()
    assert formed[60] <= 2 * 80 and formed[240] <= 2 * 320
    rows = crowd(60, 20)
    got = sorted(tuple(r) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect())
    assert got == brute(rows, 2) and len({c for _, _, c, _ in got}) > 5


@pytest.mark.parametrize("few", [1, 3])
def test_sets_around_a_centre_lose_no_link(spark, monkeypatch, few):
    """All lists of two components or more are of crowds; leaders alone link too little."""
    monkeypatch.setattr(N, "CROWD", few)
    monkeypatch.setattr(N, "TRIED", 1)
    rows = corpus() + [(i + 1000, t) for i, t in crowd(80, 60)]
    got = sorted(tuple(r) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect())
    assert got == brute(rows, 2)
