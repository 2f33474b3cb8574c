import re

import pytest

from sluice.operators import extension, extract


def numbered():
    """The parser, made within a function, so that it goes to the workers as it is."""

    class Headings:
        """Numbers headings from page to page."""

        def __init__(self):
            self.n = 0

        def parse(self, page):
            for m in re.finditer("<h2>(.*?)</h2>", page["html"]):
                self.n += 1
                yield {"title": f"{self.n} {m[1]}", "url": f"#h{self.n}", "price": float(self.n)}

    return Headings


@pytest.fixture
def pages(spark):
    made = [(i, f"https://x.org/{i}", "".join(f"<h2>A &amp; {j}</h2>" for j in range(i % 3)), f"s{i % 2}") for i in range(10)]
    return spark.createDataFrame(made, "page_id long, url string, html string, site string").repartition(4)


def test_state_over_the_pages_of_a_group(spark, pages):
    extension.register(spark, "headings_by_site", numbered(), by=("site",), order=("page_id",))
    got = sorted((r["page_id"], r["pos"], r["title"], r["url"], r["price"]) for r in extract.extract("headings_by_site", pages).collect())
    want, n = [], {}
    for i in range(10):
        for j in range(i % 3):
            n[i % 2] = n.get(i % 2, 0) + 1
            want.append((i, j, f"{n[i % 2]} A & {j}", f"https://x.org/{i}#h{n[i % 2]}", float(n[i % 2])))
    assert got == want


def test_in_sql_and_errors(spark, pages):
    extension.register(spark, "headings", numbered())
    pages.createOrReplaceTempView("pages_of_test")
    assert spark.sql("SELECT count(*) AS n FROM headings(TABLE(pages_of_test))").first()["n"] == 9
    broken = pages.unionByName(spark.createDataFrame([(99, "https://x.org/", None, "s")], pages.schema))
    extension.register(spark, "headings_skip", numbered(), skip=True)
    assert extract.extract("headings_skip", broken).count() == 9
    with pytest.raises(Exception, match="expected string"):
        extract.extract("headings", broken).collect()
    assert extract.extract("headings", pages.limit(0)).collect() == []
    for name in ("list_links", "no name"):
        with pytest.raises(ValueError):
            extension.register(spark, name, numbered())
