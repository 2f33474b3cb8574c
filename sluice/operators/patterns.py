"""Many glob patterns at once: one automaton of their longest literals, in blocks of a bounded size.

Only * is special, and it matches no line end, as in a browser's regular expression. A pattern can only match where its longest literal stands; the
automaton finds all literals of a block in one pass over each URL, and what it finds is verified piece by piece. Patterns without any literal are
tried on every URL. A block of patterns is broadcast; beyond BLOCK patterns (or BLOCK_BYTES of them) there are several, each a scan of the URLs.

Null URLs and null patterns match nothing; an empty pattern matches the empty URL. Repeated patterns of a site are one. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Patterns, and bytes of them, that are broadcast at once.
BLOCK, BLOCK_BYTES = 200_000, 16 << 20
_LINE_ENDS = frozenset("\n\r\u2028\u2029")


class Globs:
    """The patterns of a block, ready to match."""

    def __init__(self, globs: tuple[str, ...]):
        import ahocorasick

        self.globs, self.pieces = globs, [g.split("*") for g in globs]
        self.loose, literals = [], {}
        for i, pieces in enumerate(self.pieces):
            longest = max(pieces, key=len)
            if longest:
                literals.setdefault(longest, []).append(i)
            else:
                self.loose.append(i)
        self.automaton = ahocorasick.Automaton()
        for literal, own in literals.items():
            self.automaton.add_word(literal, own)
        if literals:
            self.automaton.make_automaton()
        self.some = bool(literals)

    def _matches(self, i: int, url: str) -> bool:
        first, *rest = self.pieces[i]
        if not rest:
            return url == first
        *middle, last = rest
        if len(url) < len(first) + len(last) or not url.startswith(first) or not url.endswith(last):
            return False
        at, end = len(first), len(url) - len(last)
        for piece in middle:
            found = url.find(piece, at, end)
            if found < 0:
                return False
            at = found + len(piece)
        return True

    def hits(self, url: str) -> list[int]:
        """The patterns that the URL matches, in their order."""
        found = set(self.loose)
        if self.some:
            for _, own in self.automaton.iter(url):
                found.update(own)
        if _LINE_ENDS.isdisjoint(url):
            return sorted(i for i in found if self._matches(i, url))
        gap = "[^\n\r\u2028\u2029]*"
        return sorted(i for i in found if re.fullmatch(gap.join(map(re.escape, self.pieces[i])), url))


@lru_cache(maxsize=2)
def _prepared(globs: tuple[str, ...]) -> Globs:
    return Globs(globs)


def glob_hits(pages: DataFrame, patterns: DataFrame, block: int = BLOCK) -> DataFrame:
    """The pages (with a column url) once for each site_id of which the URL matches a pattern (site_id, glob)."""
    spark = pages.sparkSession
    own = patterns.filter("glob IS NOT NULL").groupBy("glob").agg(F.collect_set("site_id").alias("sites"), F.count_if(F.col("site_id").isNull()).alias("unnamed"))
    size = own.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("glob") + 32 * F.size("sites")).alias("bytes")).first()
    parts = max(1, ceil(size["n"] / block), ceil((size["bytes"] or 0) / BLOCK_BYTES))
    schema = StructType([*pages.schema.fields, *patterns.select("site_id").schema.fields])
    out = spark.createDataFrame([], schema)
    for k in range(parts if size["n"] else 0):
        some = own.filter(F.pmod(F.xxhash64("glob"), F.lit(parts)) == k).collect()
        held = spark.sparkContext.broadcast((tuple(r["glob"] for r in some), [[*r["sites"], *[None] * (r["unnamed"] > 0)] for r in some]))
        out = out.union(pages.filter("url IS NOT NULL").mapInArrow(_scan(held, schema.fieldNames()), schema))
    return out


def _scan(held, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        globs, sites = held.value
        known = _prepared(globs)
        kind = None
        for batch in batches:
            rows, found = [], []
            for n, url in enumerate(batch.column("url").to_pylist()):
                own = dict.fromkeys(site for i in known.hits(url) for site in sites[i])
                rows += [n] * len(own)
                found += own
            taken = batch.take(pa.array(rows, pa.int64()))
            kind = kind or (pa.string() if not found else pa.array(found).type)
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(found, kind)], names=names)

    return run
