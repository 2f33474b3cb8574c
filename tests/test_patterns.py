import random
import re
import time

from sluice.operators.patterns import Globs, glob_hits
from sluice.operators.views import matching_sites


def by_regex(glob, url):
    return re.fullmatch(".*".join(map(re.escape, glob.split("*"))).replace(".*", "[^\n\r\u2028\u2029]*") if "*" in glob else re.escape(glob), url) is not None


def test_equals_regular_expressions():
    rng = random.Random(2)
    letters = "ab/.*"
    globs = tuple({"".join(rng.choice(letters) for _ in range(rng.randrange(0, 7))) for _ in range(400)} | {"*", "**", "", "a*a", "ab*ba"})
    known = Globs(globs)
    for _ in range(400):
        url = "".join(rng.choice("aab/.\n" if rng.random() < 0.1 else "aab/.") for _ in range(rng.randrange(0, 12)))
        assert [globs[i] for i in known.hits(url)] == [g for g in globs if by_regex(g, url)], url


def test_a_hundred_thousand_patterns_in_one_pass():
    globs = tuple(f"https://site{i}.example/*/x*" for i in range(100_000))
    began = time.time()
    known = Globs(globs)
    assert [known.hits(f"https://site{i}.example/a/xy") for i in range(0, 100_000, 50)] == [[i] for i in range(0, 100_000, 50)]
    assert time.time() - began < 20


def test_blocks_and_nulls(spark):
    pages = spark.createDataFrame([(1, "https://a.b/c", "x"), (2, None, "y"), (3, "", "z"), (None, "https://a.b/d", "q")], "page_id long, url string, glob string")
    patterns = spark.createDataFrame([("s", "*a.b*"), ("s", "*c"), ("t", "*"), (None, "https://*"), ("u", None), ("v", ""), ("t", "*")], "site_id string, glob string")
    want = {(1, "s"), (1, "t"), (1, None), (3, "t"), (3, "v"), (None, "s"), (None, "t"), (None, None)}
    for block in (1000, 2):
        got = [(r["page_id"], r["site_id"]) for r in glob_hits(pages, patterns, block).distinct().collect()]
        assert len(got) == len(want) and set(got) == want
    assert glob_hits(pages, patterns.limit(0)).collect() == [] and glob_hits(pages.limit(0), patterns).collect() == []
    sites = spark.createDataFrame([("s", "https://a.b/", None, ["*/c"]), ("n", "https://n.n", None, None)], "id string, url string, configured_url string, match_patterns array<string>")
    assert sorted((str(r["page_id"]), r["site_id"]) for r in matching_sites(pages.select("page_id", "url"), sites).collect()) == [("1", "s"), ("None", "s")]
