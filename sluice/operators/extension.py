"""Parsers from outside: a Python class becomes a table function that runs in SQL, and an extractor by its name.

A parser has `parse(page)`, which gets a page row as a dict and yields dicts with title and url and any of dedupe_key, preview_image_url, summary, price and
raw_html_snippet. Without `by` each task parses the pages it holds, nothing is shuffled. With `by` the pages with equal values of those columns come to one
instance, in the order of `order`, one at a time, so it may carry state from page to page; a large group streams through and is not held.

Rows are then treated as those of other extractors: titles are cleaned, URLs resolved against the page, rows without either go, pos counts the page's rows.
Null pages are parsed as they are; an error in a parser fails the query, unless `skip` is given: then a page that it cannot parse gives no rows. Empty tables give none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sluice.functions import text, urls
from sluice.operators import extract

#: What a parser may say of a row, after page and place.
FIELDS = ("title", "url", "dedupe_key", "preview_image_url", "summary", "price", "raw_html_snippet")
_ROWS = "page_id bigint, page_url string, pos int, title string, url string, dedupe_key string, preview_image_url string, summary string, price double, raw_html_snippet string"


def table_function(parser: Callable[[], Any], skip: bool = False):
    """The table function of a parser class (or of anything that makes an object with `parse`)."""

    class Parsed:
        def __init__(self) -> None:
            self.own = parser()

        def eval(self, page: Row) -> Iterator[tuple]:
            try:
                found = list(self.own.parse(page.asDict()))
            except Exception:
                if not skip:
                    raise
                found = []
            for pos, row in enumerate(found):
                price = row.get("price")
                yield (page["page_id"], page["url"], pos, *(row.get(c) if c != "price" or price is None else float(price) for c in FIELDS))

    return F.udtf(Parsed, returnType=_ROWS)


def register(spark: SparkSession, name: str, parser: Callable[[], Any], by: tuple[str, ...] = (), order: tuple[str, ...] = (), skip: bool = False) -> None:
    """Make the parser known to SQL, as name(TABLE(pages) ...), and to `extract`. Known extractors keep their names."""
    if not name.isidentifier() or name in extract.REGISTRY and not getattr(extract.REGISTRY[name], "from_outside", False):
        raise ValueError(f"no name for a parser: {name}")
    spark.udtf.register(name, table_function(parser, skip))
    dealt = f" PARTITION BY ({', '.join(by)})" if by else ""
    sorted_by = f" ORDER BY ({', '.join(order)})" if by and order else ""

    def run(pages: DataFrame) -> DataFrame:
        rows = pages.sparkSession.sql(f"SELECT * FROM {name}(TABLE(SELECT * FROM {{pages}}){dealt}{sorted_by})", pages=pages)
        address = lambda c: urls.resolved_url(text.trim_ws(c), "page_url")
        found = rows.withColumns({"title": text.clean_text("title"), "url": address("url"), "preview_image_url": address("preview_image_url")})
        return extract.shaped(found.filter("title <> '' AND url <> ''"))

    run.from_outside = True
    extract.REGISTRY[name] = run
