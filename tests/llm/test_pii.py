import hashlib
import random
import re

import pytest

from sluice.llm import pii

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        twice = [x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(digits)))]
        return 14 <= len(digits) <= 19 and sum(twice) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    spans = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(KINDS.items()) for m in re.finditer(p, text or "") if passes(k, m[0])]
    return [sum(x[3] == k for x in spans) for k in KINDS], ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))


def corpus():
    draw = random.Random(4)
    odd = [None, "", "a@b.c_d@e.f", "é🙂 x.y%+-@mail-1.example.com.", "@a.b a@b a@.c a@b..c", "1.2.3.4.5.6.7.8 256.1.1.1 0001.0255.3.4 999.1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112",
           "+1 (017) 555-7713 and +4-9 +12345678901234567 ++1 2345678901", "1-" * 20_000 + "1", "a" * 20_000, "a.b@" * 4_000, "1." * 4_000, "+1" + "-" * 20_000, "a@b" + ".c" * 20_000, "4 " * 16 + "x 4" * 16]
    soup = "a.@1-+ ()45\né"
    return odd + ["".join(draw.choice(soup) for _ in range(draw.randint(1, 60))) for _ in range(300)]


def test_base_equals_brute_force(spark):
    texts = corpus()
    frame = spark.createDataFrame([(i, t, "k", 3) for i, t in enumerate(texts)] + [(2, texts[2], "k", 3)], "doc_id long, text string, key string, base int")
    rows = pii.found(frame).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        counts, spans = brute(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in KINDS] == counts and r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest(), texts[r["doc_id"]][:80]
        assert r["spans"] == spans


@pytest.fixture(scope="module")
def telling(spark):
    near = ["write to quixotic Zanzibar at ann@x.org today", "the Zanzibar office, see ann@x.org now", "ask ann@x.org or Zanzibar directly", "Zanzibar! mail ann@x.org", "plain Zanzibar ann@x.org (zanzibars)"]
    copies = ["one passage with Wombat bob@y.org copied"] * 8
    rest = [f"write to the office number{i} see mail{i}@z{i}.org today" for i in range(40)] + [f"the plain words of text{i}" for i in range(200)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([*near, *copies, *rest])] + [(999, None, "en", "s", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_terms_that_reveal_an_entity_are_sanitised(telling):
    got = {r["doc_id"]: r["spans"] for r in pii.found(telling).collect()}
    terms = {i: re.findall("term:[0-9:]+", s) for i, s in got.items() if "term" in s}
    assert terms == {0: ["term:18:26"], 1: ["term:4:12"], 2: ["term:17:25"], 3: ["term:0:8"], 4: ["term:6:14"]}
    assert {r["doc_id"] for r in pii.found(telling, support=1).filter("spans LIKE '%term%'").collect()} >= {0, 1, 5, 12}


def test_sanitised_texts(telling):
    out = pii.sanitised(telling)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == telling.columns and out.schema["n_chars"] == telling.schema["n_chars"] and len(rows) == telling.count()
    assert rows[4]["text"] == "plain [TERM] [EMAIL] (zanzibars)" and rows[4]["n_chars"] == len(rows[4]["text"])
    assert rows[5]["text"] == "one passage with Wombat [EMAIL] copied" and rows[100]["text"].startswith("the plain words of text") and rows[999]["text"] is None


def test_native_and_empty(telling):
    assert not re.search("Python|Pandas|Arrow|MapPartitions", pii.sanitised(telling)._jdf.queryExecution().toString())
    assert pii.found(telling.limit(0)).count() == 0 and pii.sanitised(telling.limit(0)).count() == 0


def test_terms_of_entities_in_one_or_two_documents(spark):
    one = "Ada Quill signed\nmail ada@x.org once\nthen Quill left, and Quill alone knew"
    two = ["first Borage\nwrote bor@x.org down", "second page\nbor@x.org knew Borage"]
    rows = [one, *two, *["one copied Wombat cat@y.org passage"] * 4, *[f"the plain words of text{i}" for i in range(200)]]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: {rows[r["doc_id"]][a:b] for a, b in ((int(m[1]), int(m[2])) for m in re.finditer(r"term:(\d+):(\d+)", r["spans"]))} for r in pii.found(frame).collect()}
    assert {i: t for i, t in got.items() if t} == {0: {"Quill"}, 1: {"Borage"}, 2: {"Borage"}}


def brute_terms(texts):
    """Terms to sanitise for each text, by the definition."""
    import math

    import regex

    distinct = sorted({t or "" for t in texts})
    n = len(distinct)
    held, around, words = {}, {}, {}
    for t in distinct:
        spans = [(k, m[0]) for k, p in KINDS.items() for m in re.finditer(p, t) if passes(k, m[0])]
        words[t] = set(regex.split(r"[^\p{L}\p{N}]+", t.lower()))
        outside = t
        for p in pii.PATTERNS.values():
            outside = regex.sub(p, " \x01 ", outside)
        if spans:
            held[t] = set(spans)
            line = regex.split(r"[^\p{L}\p{N}\x01]+", outside.lower())
            for i, w in enumerate(line):
                if len(w) >= 3 and regex.match(r"\p{L}", w):
                    around.setdefault((t, w), set()).add((line[i - 1] if i else None, line[i + 1] if i + 1 < len(line) else None))
    c_t = lambda w: sum(w in x for x in words.values())
    out = {t: set() for t in distinct}
    for entity in {e for x in held.values() for e in x}:
        own = [t for t in held if entity in held[t]]
        for w in {w for t, w in around if t in own}:
            with_it = [t for t in own if (t, w) in around]
            support = len(set().union(*(around[t, w] for t in with_it)))
            pmi = math.log2(len(with_it) * n / (c_t(w) * len(own)))
            enough = support >= pii.SUPPORT or len(own) > 1 and len(with_it) >= min(pii.SUPPORT, len(own))
            if enough and pmi > 0 and pmi >= pii.DISCLOSURE * math.log2(n / len(own)) - 1e-12:
                for t in with_it:
                    out[t].add(w)
    return out


@pytest.mark.parametrize("times", [1, 4])
def test_terms_equal_brute_force(spark, times):
    import regex

    draw = random.Random(9)
    names, plain = [f"name{i}" for i in range(12)], [f"plain{i}" for i in range(30)]
    rows = [None, ""]
    for i in range(150):
        line = draw.choices(plain, k=draw.randint(3, 12))
        if i % 2:
            who = draw.randrange(12)
            line += [f"m{who}@x.org", names[who], *(names[who] for _ in range(draw.randint(0, 2))), *draw.choices(names, k=draw.random() < 0.2)]
            line += ["+1 555 123 45%02d" % who] * (draw.random() < 0.3)
        draw.shuffle(line)
        rows.append(" ".join(line))
    want = brute_terms(rows)
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(rows)] * times, "doc_id long, text string")
    got = pii.found(frame).collect()
    assert len(got) == times * len(rows) and sum(map(bool, want.values())) > 20
    for r in got:
        text = rows[r["doc_id"]] or ""
        base = [(int(a), int(b)) for a, b in re.findall(r"(?:email|ip|card|phone):(\d+):(\d+)", r["spans"])]
        places = [m.span() for w in want[text] for m in regex.finditer(rf"(?i)(?<![\p{{L}}\p{{N}}]){w}(?![\p{{L}}\p{{N}}])", text)]
        assert sorted((int(a), int(b)) for a, b in re.findall(r"term:(\d+):(\d+)", r["spans"])) == sorted(x for x in places if not any(x[0] < b and a < x[1] for a, b in base)), text
