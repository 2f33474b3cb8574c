"""Main text of pages by equivalence-class template deduction.

Tokens are container paths (tags with class and id) and text blocks at their paths. Over the pages of a host
each has an occurrence vector; pages with the same longest block have the same main content and count once. Tokens that
occur once in each of their pages and have equal vectors form a class. Of the containers in at least half of the
pages the deepest that holds most of the text is the main slot. A class of at least SIZE tokens in half of the
pages is valid if its members stand in one order in all pages and its texts nest in a container of the class; these
texts are template. Text in an article or main element never is. What is extracted is the text in the
main slot, less boilerplate elements and template text. Vectors are kept as a support count and a
fingerprint, summed up before anything is shuffled, so a host of any size is no hot group.

A page without its host's main slot is judged by itself. Null html is empty. Repeated rows give a row each, with or without
page_id; a null URL is a host of its own; unclosed, cut off or nested wrong markup is read as far as it goes; pages of any length
and depth are read whole, in time that grows with their length. Of slots that are equal the greatest hash is taken. An empty
table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import blocks, durable

#: Share of a host's pages that a template token is on, and pages that a host must have for template text.
SUPPORT, TEXT_PAGES = 0.5, 5
#: Tokens that a valid class has at least.
SIZE = 3
#: Share of a host's remaining text that the main slot holds; an article or main element needs less.
SHARE, NAMED_SHARE = 0.7, 0.3
#: Template tokens up to which they are broadcast to the pages; more are joined by host, a hot host being split.
BROADCAST = 20_000

CONTAINERS = frozenset("html body nav header footer aside article main section div ul ol dl table tbody tr td th form figure details dialog menu fieldset blockquote".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre address hr caption figcaption summary legend thead tfoot center option".split())
DROPPED = frozenset("nav footer aside form dialog menu fieldset".split())
RAW = frozenset("script style noscript template iframe svg select textarea button head title object canvas".split())
ROLES = re.compile(r"""\brole\s*=\s*["']?(navigation|banner|contentinfo|complementary|search|dialog|menu|alert)\b""", re.I)
HIDDEN = re.compile(r"""\bhidden(?=[\s/>=]|$)(?!\s*=\s*["']?until)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
HINTS = re.compile(
    r"(?:^|[\s_-])(ads?|adverts?|advertisements?|adsense|sponsor(?:ed|s)?|promos?|promotions?|banners?|nav|navbar|navigation|menus?|sidebars?|side|widgets?|footer|header|masthead|cookies?|consent|gdpr|"
    r"notices?|alerts?|newsletter|subscribe|subscription|share|sharing|social|related|recommended|breadcrumbs?|comments?|replies|reply|respond|disqus|popup|modal|overlay|login|signup|pagination|pager|toolbar|skip|search)(?:$|[\s_-])",
    re.I,
)
NAMES = re.compile(r"""\b(class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


_NAME = re.compile("[a-z][a-z0-9:-]*")


class Tree:
    """The container paths of a page. A path is told by a hash of its parent's and its own tag, so depth costs nothing."""

    def __init__(self):
        self.ids: list[int] = []
        self.parents: list[int] = []
        self.depths: list[int] = []
        self.named: list[bool] = []  # an article or main element
        self.article: list[bool] = []  # or inside one
        self.opened: list[int] = []
        self.at: dict[int, int] = {}

    def open(self, parent: int, tag: str, key: str) -> int:
        own = token("path", f"{self.ids[parent] if parent >= 0 else ''}/{key}")
        node = self.at.get(own)
        if node is None:
            node = self.at[own] = len(self.ids)
            named = tag in ("article", "main")
            self.ids.append(own)
            self.parents.append(parent)
            self.depths.append(self.depths[parent] + 1 if parent >= 0 else 0)
            self.named.append(named)
            self.article.append(named or parent >= 0 and self.article[parent])
            self.opened.append(0)
        self.opened[node] += 1
        return node

    def inside(self, slot: int) -> list[bool]:
        """For each path whether it is the slot's or below it."""
        out: list[bool] = []
        for own, parent in zip(self.ids, self.parents):  # parents come first
            out.append(own == slot or parent >= 0 and out[parent])
        return out

    def text_token(self, node: int, block: str) -> int:
        return token("text", f"{self.ids[node] if node >= 0 else ''}\0{block}")


def read_page(text: str | None) -> tuple[list[tuple[int, str]], Tree]:
    """Blocks outside boilerplate, as (container or -1, text), and the containers."""
    text = text or ""
    lower = text.encode().lower().decode()  # ASCII letters only, so of one length with the text
    found, tree = [], Tree()
    at, n = 0, len(text)
    stack: list[tuple[str, int, bool]] = []  # tag, container, dropped
    standing: dict[str, int] = {}
    held: list[str] = []

    def flush() -> None:
        if held:
            block = " ".join(markup.unescape("".join(held)).split())
            held.clear()
            if block and not (stack and stack[-1][2]):
                found.append((stack[-1][1] if stack else -1, block))

    while at < n:
        start = text.find("<", at)
        if start < 0:
            held.append(text[at:])
            break
        if start > at:
            held.append(text[at:start])
        after = lower[start + 1 : start + 2]
        if after == "!" or after == "?":
            end = text.find("-->", start + 4) + 2 if lower.startswith("<!--", start) else text.find(">", start)
            at = end + 1 if end >= start + 2 else n
            continue
        closing = after == "/"
        name = _NAME.match(lower, start + 1 + closing)
        if not name:
            held.append("<")
            at = start + 1
            continue
        end = name.end()
        quote = ""
        if lower[end : end + 1] != ">":
            while end < n:  # an end sign inside quotes does not end the tag
                stop = _STOP.search(text, end)
                if not stop:
                    end = n
                    break
                end = stop.start()
                if stop[0] == ">":
                    break
                quote = text.find(stop[0], end + 1)
                if quote < 0:
                    end = text.find(">", end)
                    end = end if end >= 0 else n
                    break
                end = quote + 1
        inside, tag, at = text[name.end() : end], name[0], end + 1
        if tag in RAW:
            if not closing and not inside.endswith("/"):
                close = lower.find(f"</{tag}", at)
                if tag == "head":
                    body = lower.find("<body", at)
                    close = body if body >= 0 and (close < 0 or body < close) else close
                at = close if close >= 0 else (n if tag != "head" else at)
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag not in BLOCKS:
            continue
        flush()
        if tag not in CONTAINERS:
            continue
        if closing:
            if standing.get(tag):
                while True:
                    last = stack.pop()[0]
                    standing[last] -= 1
                    if last == tag:
                        break
            continue
        key, names = tag, ""
        if inside.strip():
            parts = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in NAMES.finditer(inside)]
            names = " ".join(v for _, v in parts)
            key = tag + "".join(("." if k == "class" else "#") + re.sub(r"\d+", "N", " ".join(v.split())) for k, v in parts)
        parent = stack[-1][1] if stack else -1
        article = parent >= 0 and tree.article[parent]
        dropped = bool(stack and stack[-1][2]) or tag in DROPPED or (tag == "header" and not article)
        if not dropped and inside and tag not in ("html", "body", "article", "main"):
            hint = HINTS.search(names)
            dropped = bool(ROLES.search(inside) or HIDDEN.search(inside) or hint and not (article and hint[1].lower() == "header"))
        elif not dropped and tag == "article" and article and HINTS.search(names):
            dropped = True  # a reader's comment as an article in an article
        node = tree.open(parent, tag, key)
        stack.append((tag, node, dropped))
        standing[tag] = standing.get(tag, 0) + 1
    flush()
    return found, tree


_STOP = re.compile("[>\"']")


def token(kind: str, value: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}\0{value}") - (1 << 63)


#: A container that may be the main slot: hash of its path, characters of text in it, whether it is an article or main element, depth.
Slot = tuple[int, int, bool, int]


def best_slot(slots: list[Slot], total: int) -> int | None:
    """The deepest container that holds enough of the text; an article or main element, the outermost, needs less of it."""
    best, order = None, ()
    for own, chars, named, depth in slots:
        if chars >= (NAMED_SHARE if named else SHARE) * max(1, total):
            now = (named, -depth if named else depth, chars, own)
            if now > order:
                best, order = own, now
    return best


def slots_of(found: list[tuple[int, str]], tree: Tree) -> list[Slot]:
    chars = [0] * len(tree.ids)
    for node, text in found:
        if node >= 0:
            chars[node] += len(text)
    for node in range(len(chars) - 1, -1, -1):
        if tree.parents[node] >= 0:
            chars[tree.parents[node]] += chars[node]
    return list(zip(tree.ids, chars, tree.named, tree.depths))


def in_slot(found: list[tuple[int, str]], tree: Tree, slot: int | None) -> list[tuple[int, str]]:
    if slot is None:
        return found
    inside = tree.inside(slot)
    return [(node, block) for node, block in found if node >= 0 and inside[node]]


TOKENS = "host string, kind string, token bigint, named boolean, depth int, pages bigint, total bigint, vector bigint, chars bigint"


_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^@/?#]*@)?([^/?#:]*)"


def with_host(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", "html", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1)).alias("_host"))


def distinct_pages(pages: DataFrame) -> DataFrame:
    """One page of each host and longest block: key, host and html. Only pages with copies are dealt out."""
    rows = with_host(pages).select(F.col("_host").alias("host"), "html", F.xxhash64("_host", "html", "page_id").alias("id"))

    def main(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "html", 8 << 20):
                keys = [token("main", max((b for _, b in read_page(x)[0]), key=lambda b: (len(b), b), default="")) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("host"), part.column("id"), pa.array(keys, pa.int64())], names=["host", "id", "key"])

    each = durable(rows.mapInArrow(main, "host string, id bigint, key bigint"))
    groups = each.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    copied = durable(each.join(groups, ["host", "key"]).select("id", "key").distinct())
    copied = F.broadcast(copied) if copied.count() <= BROADCAST else copied
    one = rows.join(copied, "id").groupBy("host", "key").agg(F.min(F.struct(F.xxhash64("html").alias("h"), "html")).alias("one"))
    return rows.join(copied, "id", "left_anti").select("host", F.col("id").alias("key"), "html").union(durable(one.select("host", "key", "one.html")))


def occurrences(pages: DataFrame) -> DataFrame:
    """Each host's tokens with support, count, fingerprint of the occurrence vector and characters, summed per batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "html", 8 << 20):
                sums: dict[tuple, list] = {}
                for page, host, text in zip(*(part.column(x).to_pylist() for x in ("key", "host", "html"))):
                    found, tree = read_page(text)
                    texts: dict[int, int] = {}
                    for node, block in found:
                        if node < 0 or not tree.article[node]:
                            own = tree.text_token(node, block)
                            texts[own] = texts.get(own, 0) + 1
                    rows = [("page", 0, False, 0, 1, sum(len(x) for _, x in found))]
                    rows += [("path", own, named, depth, c, chars) for (own, chars, named, depth), c in zip(slots_of(found, tree), tree.opened)]
                    rows += [("text", own, False, 0, c, 0) for own, c in texts.items()]
                    for kind, own, named, depth, c, size in rows:
                        x = sums.setdefault((host, kind, own, named, depth), [0, 0, 0, 0])
                        x[0] += 1
                        x[1] += c
                        x[2] ^= xxhash.xxh3_64_intdigest(f"{page}:{c}") >> 1
                        x[3] += size
                rows = [(*k, *v) for k, v in sums.items()]
                kinds = (pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.int32(), *[pa.int64()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 9, kinds)], names=[x.split()[0] for x in TOKENS.split(", ")])

    each = pages.mapInArrow(count, TOKENS)
    return each.groupBy("host", "kind", "token", "named", "depth").agg(F.sum("pages").alias("pages"), F.sum("total").alias("total"), F.bit_xor("vector").alias("vector"), F.sum("chars").alias("chars"))


def of_hosts(rows: DataFrame, known: DataFrame, how: str, small: bool = False) -> DataFrame:
    """The rows with what is known of their hosts. Unless `small`, both sides are dealt anew, so that a hot host may be split."""
    hashed = lambda df: df.withColumn("_k", F.xxhash64("host"))
    return rows.join(F.broadcast(known), "host", how) if small else hashed(rows).join(hashed(known), ["host", "_k"], how).drop("_k")


def is_small(known: DataFrame, size) -> bool:
    return (known.select(size.alias("n")).groupBy().sum("n").first()[0] or 0) <= BROADCAST


ORDER = "host string, vector bigint, low bigint, high bigint, token bigint"


def ordered(pages: DataFrame, classes: DataFrame) -> DataFrame:
    """Least and greatest order hash of each class over the pages, and rows with the text tokens that lie in a container of their class."""

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "html", 8 << 20):
                ends: dict[tuple, list[int]] = {}
                nested: set[tuple] = set()
                for host, text, members in zip(*(part.column(x).to_pylist() for x in ("host", "html", "members"))):
                    of = {m["token"]: m["vector"] for m in members}
                    found, tree = read_page(text)
                    lines: dict[int, list[int]] = {}
                    above: list[frozenset] = []  # classes of a container and of those that it lies in
                    for own, parent in zip(tree.ids, tree.parents):
                        outer = above[parent] if parent >= 0 else frozenset()
                        if own in of:
                            lines.setdefault(of[own], []).append(own)
                            outer = outer if of[own] in outer else outer | {of[own]}
                        above.append(outer)
                    for node, block in found:
                        own = tree.text_token(node, block)
                        if own in of:
                            lines.setdefault(of[own], []).append(own)
                            if node >= 0 and of[own] in above[node]:
                                nested.add((host, of[own], own))
                    for vector, line in lines.items():
                        now = xxhash.xxh3_64_intdigest(repr(line)) >> 1
                        x = ends.setdefault((host, vector), [now, now])
                        x[:] = min(x[0], now), max(x[1], now)
                rows = [(*k, *v, None) for k, v in ends.items()] + [(host, vector, None, None, own) for host, vector, own in nested]
                columns = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), *[pa.int64()] * 4))], names=[x.split()[0] for x in ORDER.split(", ")])

    members = durable(classes.select("host", F.explode("members").alias("m"), "vector").groupBy("host").agg(F.collect_list(F.struct("m.token", "vector")).alias("members")))
    rows = of_hosts(pages.select("host", "html"), members, "inner", is_small(members, F.size("members") + 1))
    return durable(rows.mapInArrow(order, ORDER).groupBy("host", "vector", "token").agg(F.min("low").alias("low"), F.max("high").alias("high")))


def templates(pages: DataFrame) -> DataFrame:
    """For each host the containers that may be its main slot with the text that they hold, and the texts of its valid classes.

    Rows are at most 1 / SUPPORT times a page's containers and texts for each host.
    """
    distinct = distinct_pages(pages)
    tokens = durable(occurrences(distinct))
    hosts = tokens.filter("kind = 'page'").select("host", F.col("pages").alias("n"), F.col("chars").alias("all_chars"))
    once = tokens.filter("kind <> 'page' AND total = pages").withColumnRenamed("chars", "own")
    rows = durable(of_hosts(once, hosts, "inner").filter(F.col("pages") >= SUPPORT * F.col("n")))  # few for each host from here on
    classes = rows.filter(F.col("n") >= TEXT_PAGES).groupBy("host", "vector", "pages").agg(F.collect_list(F.struct("kind", "token")).alias("members"))
    kind = lambda x: F.filter("members", lambda m: m["kind"] == x)
    classes = durable(classes.filter((F.size("members") >= SIZE) & (F.size(kind("path")) > 0) & (F.size(kind("text")) > 0)))
    found = ordered(distinct, classes)
    valid = classes.join(found.filter("token IS NULL AND low = high"), ["host", "vector"], "left_semi")
    texts = found.filter("token IS NOT NULL").join(valid, ["host", "vector"], "left_semi").groupBy("host").agg(F.collect_set("token").alias("texts"))
    slots = rows.filter("kind = 'path'").groupBy("host").agg(F.first("all_chars").alias("all_chars"), F.collect_list(F.struct("token", "own", "named", "depth")).alias("slots"))
    return slots.join(texts, "host", "left").select("host", "all_chars", "slots", F.coalesce("texts", F.array().cast("array<bigint>")).alias("texts"))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    known = durable(templates(pages))
    rows = of_hosts(with_host(pages).withColumnRenamed("_host", "host"), known, "left", is_small(known, F.size("slots") + F.size("texts") + 1))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "html", 8 << 20):
                texts = []
                for text, total, slots, common in zip(*(part.column(x).to_pylist() for x in ("html", "all_chars", "slots", "texts"))):
                    found, tree = read_page(text)
                    own = in_slot(found, tree, best_slot([(x["token"], x["own"], x["named"], x["depth"]) for x in slots or ()], total or 0))
                    if not own:
                        own = in_slot(found, tree, best_slot(slots_of(found, tree), sum(len(b) for _, b in found)))
                    gone = set(common or ())
                    texts.append("\n".join(b for node, b in own if not gone or tree.text_token(node, b) not in gone))
                arrays = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "html", "all_chars", "slots", "texts").mapInArrow(extract, "page_id bigint, url string, text string, n_chars bigint")
