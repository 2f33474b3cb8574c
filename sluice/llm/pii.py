"""Personal data, in DataFrame functions only: patterns, and terms that reveal what the patterns find.

Emails, IP addresses, card and phone numbers are found by pattern. Each distinct match is a protected
entity. Terms are the words of the whole documents that hold a match, outside all matches. Over all documents,
PMI(t; e) = log2(c(t,e) N / (c(t) c(e))) says how strongly term t reveals entity e and
IC(e) = log2(N / c(e)) how much there is to reveal, with document counts in which copies of a text count
once. A term that reaches DISCLOSURE of IC is sanitised wherever it stands in the documents that hold it and
e, kind `term`, if it has the support: SUPPORT different word neighbourhoods in those documents, however few they
are, or SUPPORT documents, or both documents of an entity that has two. `sanitised` puts a general word
for each span, such as [EMAIL] or [TERM].

Patterns use possessive repetition, so long runs neither overflow the stack nor are tried again from
each place. Entities of the same documents are scored as one. Null text is empty; texts of any length are read whole; repeated rows
give a row each, with or without doc_id, and change no count. Spans that start together stand in the order of the kinds, terms
last. An empty table gives no rows. `sanitised` keeps other columns, whatever their names, `found` ignores them.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import durable, free, keys

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
#: Matches begin at a run's start or where the last match ended, and take runs whole: the leftmost greedy matches.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
SUPPORT = 3
DISCLOSURE = 0.8
#: Terms up to which they are broadcast to the documents; more are joined.
BROADCAST = 200_000
_LETTER = r"[\p{L}\p{N}]"


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def weight(i: Column) -> Column:
        d = F.substring(back, i, 1).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + weight(i)) % 10 == 0


def _passes(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.length(digits).between(14, 19) & luhn(digits)
    return F.length(digits).between(10, 15) if kind == "phone" else F.lit(True)


def _passes_span(kind: str, x: Column) -> Column:
    return _passes(kind, x["match"])


def _is(kind: str, x: Column) -> Column:
    return x["kind"] == kind


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _sums_before(lengths: Column) -> Column:
    """For each value the sum of those before it, by blocks of about the square root of their number."""

    def with_block(pair: Column) -> Column:
        v, b = pair["v"], pair["b"]
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / b).cast("int")), lambda i: _total(F.slice(v, i * b + 1, b)))
        offsets = _let(blocks, lambda s: F.transform(s, lambda x, i: _total(F.slice(s, F.lit(1), i))))
        return _let(offsets, lambda o: F.transform(v, lambda x, i: F.get(o, F.floor(i / b).cast("int")) + _total(F.slice(v, (F.floor(i / b) * b + 1).cast("int"), (i % b).cast("int")))))

    pair = _let(lengths, lambda v: F.struct(v.alias("v"), F.greatest(F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int"), F.lit(1)).alias("b")))
    return _let(pair, with_block)


def _placed(text: Column, pattern: Column, order: int, kind: str) -> Column:
    """Start, order, end, kind and text of all matches: places are sums of the lengths around the matches."""

    def place(x: Column) -> Column:
        start = x["before"] + x["piece"]
        return F.struct(start.alias("start"), F.lit(order).alias("kind_order"), (start + F.length(x["match"])).alias("stop"), F.lit(kind).alias("kind"), x["match"].alias("match"))

    def spans(found: Column) -> Column:
        before = _sums_before(F.transform(found, lambda x: x["piece"] + F.length(x["match"])))
        both = F.zip_with(found, before, lambda x, n: F.struct(n.alias("before"), x["piece"].alias("piece"), x["match"].alias("match")))
        return F.transform(both, place)

    matches = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda p, m: F.struct(F.length(p).alias("piece"), m.alias("match")))
    return _let(F.filter(matches, lambda x: x["match"].isNotNull()), spans)


def base_spans(text: Column) -> Column:
    """All passing matches by start, then kind."""
    likely = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    none = F.array().cast("array<struct<start:int,kind_order:int,stop:int,kind:string,match:string>>")
    found = []
    for i, kind in enumerate(KINDS):
        spans = F.filter(_placed(text, F.lit(PATTERNS[kind]), i, kind), partial(_passes_span, kind))
        found.append(F.when(likely.get(kind, text.rlike("[0-9]")) & text.rlike(PATTERNS[kind]), spans).otherwise(none))
    return F.sort_array(F.concat(*found))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def _words(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}\p{N}\x01]+")


def _outside(text: Column) -> Column:
    """The text with a sign for each match of a pattern."""
    for pattern in PATTERNS.values():
        text = F.regexp_replace(text, pattern, " \x01 ")
    return text


def _read(documents: DataFrame) -> DataFrame:
    """The key of each document and its base spans."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", text.alias("text")).withColumn("key", F.xxhash64("text"))
    return rows.withColumn("base", base_spans(F.col("text")))


def _members(texts: DataFrame) -> DataFrame:
    """key, class and c_e: entities that the same texts hold are one class, with the number of those texts."""
    entities = F.array_distinct(F.transform("base", lambda x: F.xxhash64(x["kind"], x["match"])))
    held = durable(texts.select("key", F.explode(entities).alias("entity")))
    classes = held.groupBy("entity").agg(F.count(F.lit(1)).alias("c_e"), F.bit_xor(F.xxhash64("key")).alias("x"), F.sum(F.shiftrightunsigned(F.xxhash64("key", F.lit(1)), 24)).alias("y"))
    classes = classes.select("entity", F.xxhash64("c_e", "x", "y").alias("class"), "c_e")
    classes = keys(classes.withColumnRenamed("class", "own"), "entity", "own", "c_e")
    return durable(free(held, "entity").join(classes, "entity").select("key", F.col("own").alias("class"), "c_e").distinct())


def _near(texts: DataFrame) -> DataFrame:
    """key, term and hashes of the words beside the term at its places outside the matches."""
    each = texts.select("key", _words(_outside(F.col("text"))).alias("words"))
    beside = F.transform("words", lambda x, i: F.struct(x.alias("term"), F.xxhash64(F.get(F.col("words"), i - 1), F.get(F.col("words"), i + 1)).alias("beside")))
    places = each.select("key", F.explode(beside).alias("x")).select("key", "x.*")
    return places.filter((F.length("term") >= 3) & F.col("term").rlike(r"^\p{L}")).groupBy("key", "term").agg(F.collect_set("beside").alias("beside"))


def disclosing(documents: DataFrame, read: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame | None:
    """doc_id, key and terms to sanitise, or None where there are none."""
    texts = read.dropDuplicates(["key"])
    members = _members(texts)
    if members.isEmpty():
        return None
    keyed = documents.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    total = float(keyed.select("key").distinct().count())

    def reach(c_e) -> Column:
        """Texts that a term can be in and still reach the disclosure: c(t,e) is c(e) at most."""
        return (1 - disclosure) * F.log2(F.lit(total)) + disclosure * F.log2(c_e) + 1e-9

    tops = members.groupBy("key").agg(F.max("c_e").alias("top"))
    near = _near(texts).join(tops, "key").filter((F.size("beside") >= support) | (F.col("top") > 1))
    near = durable(near.withColumn("word", F.xxhash64("term")))
    words = keyed.select("key", F.explode(F.array_distinct(F.transform(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: F.xxhash64(x)))).alias("word"))
    counted = lambda rows: rows.distinct().groupBy("word").agg(F.count(F.lit(1)).alias("c_t"))
    # words that a part of the texts shows to be too common need no count over all
    common = counted(words.filter(F.col("key") % 16 == 0)).filter(F.log2("c_t") > reach(F.lit(1.0)))
    asked = near.groupBy("word").agg(F.max("top").alias("top")).join(common, "word", "left")
    asked = durable(asked.filter(F.col("c_t").isNull() | (F.log2("c_t") <= reach(F.col("top")))).select("word"))
    rare = counted(words.join(F.broadcast(asked) if asked.count() <= BROADCAST else asked, "word", "left_semi"))
    near = free(near, "word").join(keys(rare, "word", "c_t"), "word").filter(F.log2("c_t") <= reach(F.col("top"))).select("key", "term", F.explode("beside").alias("beside"), "c_t")
    both = durable(near.join(members, "key").filter(F.log2("c_t") <= reach(F.col("c_e"))))
    counts = both.groupBy("class", "term").agg(F.first("c_e").alias("c_e"), F.first("c_t").alias("c_t"), F.count_distinct("key").alias("c_te"), F.count_distinct("beside").alias("support"))
    pmi = F.log2(F.col("c_te") * F.lit(total) / (F.col("c_t") * F.col("c_e")))
    shared = (F.col("c_e") > 1) & (F.col("c_te") >= F.least(F.lit(support), F.col("c_e")))
    told = counts.filter(((F.col("support") >= support) | shared) & (pmi > 0) & (pmi >= disclosure * F.log2(F.lit(total) / F.col("c_e")))).select("class", "term")
    terms = durable(both.join(told, ["class", "term"], "left_semi").groupBy("key").agg(F.sort_array(F.collect_set("term")).alias("terms")))
    return None if terms.isEmpty() else durable(read.select("doc_id", "key").distinct().join(terms, "key"))


def _all_spans(documents: DataFrame, columns: list[Column | str], support: int, disclosure: float) -> DataFrame:
    """The columns, base and spans (base and terms) of each document."""
    read = _read(documents)
    slim = durable(read.filter(F.size("base") > 0))
    terms = disclosing(documents, slim, support, disclosure)
    rows = documents.select(*columns, "doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    if terms is None:
        return rows.withColumn("spans", F.col("base"))
    terms = terms.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "terms")
    terms = F.broadcast(terms) if terms.select(F.sum(F.size("terms"))).first()[0] <= BROADCAST else terms
    rows = rows.join(terms, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    pattern = F.concat(F.lit(rf"(?iu)(?<!{_LETTER})(?:"), F.array_join(F.transform("terms", lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))), "|"), F.lit(rf")(?!{_LETTER})"))
    base = F.col("base")
    apart = F.filter(_placed(F.col("text"), pattern, len(KINDS), "term"), lambda x: ~F.exists(base, lambda y: (x["start"] < y["stop"]) & (y["start"] < x["stop"])))
    return rows.withColumn("spans", F.when(F.col("terms").isNull(), base).otherwise(F.sort_array(F.concat(base, apart))))


def found(documents: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans."""
    rows = _all_spans(documents.select("doc_id", "text"), [], support, disclosure)
    counts = [F.size(F.filter("base", partial(_is, kind))).cast("bigint").alias(f"n_{kind}") for kind in KINDS]
    return rows.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def sanitised(documents: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """The documents with a general word in place of each span, overlapping spans as one; n_chars follows where it is a column."""
    rows = _all_spans(documents, [F.struct(*documents.columns).alias("_row")], support, disclosure)
    text = F.col("text")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(state: Column, x: Column) -> Column:
        word = F.concat(state["out"], F.substring(text, state["at"] + 1, x["start"] - state["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(state["at"], x["stop"]).alias("at"), F.when(x["start"] >= state["at"], word).otherwise(state["out"]).alias("out"))

    ended = F.aggregate("spans", zero, put, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    new = F.when(F.size("spans") > 0, ended).otherwise(F.col("_row.text"))
    out = rows.select("_row", new.alias("_new"))
    length = F.when(F.col("_new").isNull(), F.col("_row.n_chars")).otherwise(F.length("_new")) if "n_chars" in documents.columns else None
    columns = {"text": F.col("_new"), "n_chars": length.cast(documents.schema["n_chars"].dataType) if length is not None else None}
    return out.select(*((columns[c] if columns.get(c) is not None else F.col(f"_row.`{c}`")).alias(c) for c in documents.columns))
