"""Conversation repair: the cheapest edits that make a damaged conversation take turns, found once for each shared part of it.

A row's signature is one letter: the initial of its role (s, u, a, else x), upper case where its text is cut short, `-` where it must go (blank or
a copy). A conversation's signature is read from its last row, so that what conversations share towards their end is a shared prefix. The distinct signatures are
sorted and dealt by range; each task inserts its own into a trie of which it holds one path, computes a layer (the cost from each state to the end)
once for each node, and at a terminal node walks back over the layers, which reads the conversation from its first row and picks the
ASCII-least of the cheapest edits. Conversations then take the answer of their signature, and their rows, in order, are repaired and hashed.

States: E nothing yet, S after the system row, U after a user row, A after an assistant row; E and A may end.

Nulls: a null conv_id, role or text is one space where it is read or hashed; a null turn comes first and counts in no gap. Rows of one turn are
in the order of role and text (code points). Repeated rows are duplicates. Empty and very long texts are rows like others. Empty tables give no rows.
Other columns, whatever their names, are not read. A conversation is a sequence and its hash is taken over all of it, so one task reads its rows in order; it
holds one batch of them, and of the conversation a letter a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import durable

#: Costs of the edits; an unfinished text that stays costs CUT more.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: Bytes of distinct signatures and answers up to which they are broadcast; beyond, both sides of the join are dealt in SALTS parts of a key.
FEW_BYTES, SALTS = 8 << 20, 16

_NEVER = 1 << 62
_E, _S, _U, _A = range(4)
_FULL = {"u": "user", "a": "assistant"}
_SOLVED = "signature string, cost bigint, audit string"
_HEAD = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32('conv_id:turn') % 20 names, and whether the row is still there (`there`)."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), key.alias("k"))
    text = F.when(F.col("k") == 1, F.lit("")).when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("k") != 0).alias("there"), F.explode(copies).alias("_copy")).drop("_copy")


def _last_sign(text: str) -> Column:
    """The last character that is no white space, else an empty string."""
    return F.right(F.rtrim(text, F.lit(" \t\n\x0b\f\r")), F.lit(1))


def examined(rows: DataFrame) -> DataFrame:
    """The rows in order (seq from 1), each with its fault, its letter, and whether turn and pair of roles are new or illegal.

    Rows are dealt by conv_id once; the windows of a conversation and of its equal rows both rely on that.
    """
    dealt = rows.filter("there").repartition("conv_id")
    same = Window.partitionBy("conv_id", "role", "text").orderBy("seq")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    known = dealt.withColumns({"_i": F.left("role", F.lit(1)), "_sign": _last_sign("text")})
    known = known.withColumns({"seq": F.row_number().over(order).cast("bigint"), "_before": F.lag("_i").over(order), "_turn": F.lag("turn").over(order)})
    known = known.withColumn("_copy", F.row_number().over(same) > 1)
    fault = F.when(F.col("_sign") == "", F.lit("blank")).when(F.col("_copy"), F.lit("duplicate")).when(~F.col("_sign").isin(".", "!", "?"), F.lit("truncated"))
    known = known.withColumn("fault", fault)
    own = F.when(F.col("_i").isin("s", "u", "a"), F.col("_i")).otherwise(F.lit("x"))
    letter = F.when(F.col("fault").isin("blank", "duplicate"), F.lit("-")).when(F.col("fault") == "truncated", F.upper(own)).otherwise(own)
    illegal = F.col("_before").isNotNull() & ~F.concat("_before", "_i").isin("su", "ua", "au")
    return known.select("conv_id", "turn", "seq", "fault", letter.alias("letter"), illegal.alias("illegal"), (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_turn"))).alias("new_turn"))


def summarised(every: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each original conv_id: gaps, counts of faults, and the signature, last row first.

    Letters are joined in blocks of rows first, so that no aggregate holds more than a block or a list of blocks.
    """
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    block = F.floor((F.col("seq") - 1) / 1024).alias("_block")
    ordered = lambda at, x: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(at, x)), asc=False), lambda r: r[x]), "")
    parts = rows.groupBy("conv_id", block).agg(
        F.min("turn").alias("least"), F.max("turn").alias("most"), count(F.col("new_turn")).alias("turns"), count(F.col("illegal")).alias("illegal"),
        *(count(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")), ordered("seq", "letter").alias("letters"),
    )
    gone = every.select("conv_id").distinct().select(
        "conv_id", F.lit(-1).cast("bigint").alias("_block"), F.lit(None).cast("bigint").alias("least"), F.lit(None).cast("bigint").alias("most"),
        *(F.lit(0).cast("bigint").alias(x) for x in ("turns", "illegal", "blank", "duplicate", "truncated")), F.lit("").alias("letters"),
    )
    parts = parts.withColumns({"least": F.col("least").cast("bigint"), "most": F.col("most").cast("bigint")})
    whole = parts.unionByName(gone).groupBy("conv_id").agg(
        F.min("least").alias("least"), F.max("most").alias("most"), *(F.sum(x).alias(x) for x in ("turns", "blank", "duplicate", "truncated", "illegal")), ordered("_block", "letters").alias("signature"),
    )
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0))
    return whole.select("conv_id", gaps.cast("bigint").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "signature")


def layer(after: tuple[int, ...], letter: str) -> tuple[int, ...]:
    """Costs to the end from each state before a row of this letter, given those after it; inserts stand before the row."""
    if letter == "-":
        return _inserted(tuple(x + DELETE for x in after))
    cut, own = (CUT if letter.isupper() else 0), letter.lower()
    out = []
    for state, stay in enumerate(after):
        to = _U if state != _U else _A
        best = min(stay + DELETE, after[to] + REROLE + cut)
        if own == ("u" if state != _U else "a"):
            best = min(best, after[to] + cut)
        if own == "s" and state == _E:
            best = min(best, after[_S] + cut)
        out.append(best)
    return _inserted(tuple(out))


def _inserted(costs: tuple[int, ...]) -> tuple[int, ...]:
    """The same with inserts in front: a user row from E, S and A, an assistant row from U."""
    e, s, u, a = costs
    u, a = min(u, a + INSERT), min(a, u + INSERT)
    return min(e, u + INSERT), min(s, u + INSERT), u, a


#: Costs when no row is left: E and A may end, U needs an assistant row, S both.
END = _inserted((0, _NEVER, _NEVER, 0))


def moves(state: int, letter: str) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of the edits that a row of this letter allows, in ASCII order; I does not consume the row."""
    to = _U if state != _U else _A
    insert = ("I", INSERT, to)
    if letter == "":
        return [insert]
    if letter == "-":
        return [("D", DELETE, state), insert]
    cut, own = (CUT if letter.isupper() else 0), letter.lower()
    keep = [("K", cut, to)] if own == ("u" if state != _U else "a") else [("K", cut, _S)] if own == "s" and state == _E else []
    return [("D", DELETE, state), insert, *keep, ("R", REROLE + cut, to)]


def walk(layers: list[tuple[int, ...]], signature: str) -> str:
    """The ASCII-least of the cheapest edits; layers[i] holds the costs before the i-th letter from the end of the signature."""
    state, out, i = _E, [], len(signature)
    while True:
        letter, left = signature[i - 1] if i else "", layers[i][state]
        if not i and state in (_E, _A) and not left:
            return "".join(out)
        for edit, cost, to in moves(state, letter):
            then = layers[i if edit == "I" else i - 1][to]
            if cost + then == left:
                out.append(edit)
                i, state = (i if edit == "I" else i - 1), to
                break


def solve(signatures: Iterator[str]) -> Iterator[tuple[str, int, str]]:
    """signature, cost and audit of sorted signatures: the path of the trie that leads to the present one is held, a layer a node."""
    path, layers = "", [END]
    for signature in signatures:
        shared = 0
        for a, b in zip(path, signature):
            if a != b:
                break
            shared += 1
        del layers[shared + 1 :]
        for letter in signature[shared:]:
            layers.append(layer(layers[-1], letter))
        path = signature
        yield signature, layers[-1][_E], walk(layers, signature)


def solved(signatures: DataFrame) -> DataFrame:
    """signature, cost and audit of each distinct signature, dealt by range so that equal beginnings meet in one task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = (s for batch in batches for s in batch.column(0).to_pylist())
        held, size = [], 0
        for answer in solve(own):
            held.append(answer)
            size += len(answer[0])
            if size > 1 << 20:
                yield pa.record_batch([pa.array(x) for x in zip(*held)], ["signature", "cost", "audit"])
                held, size = [], 0
        if held:
            yield pa.record_batch([pa.array(x) for x in zip(*held)], ["signature", "cost", "audit"])

    return signatures.select("signature").distinct().repartitionByRange("signature").sortWithinPartitions("signature").mapInArrow(rows, _SOLVED)


def answered(heads: DataFrame) -> DataFrame:
    """The heads with the cost and audit of their signatures. Few answers are broadcast; else a signature's conversations are dealt in parts."""
    answers = durable(solved(heads))
    size = answers.agg(F.sum(F.length("signature") + F.length("audit"))).first()[0] or 0
    if size <= FEW_BYTES:
        return heads.join(F.broadcast(answers), "signature")
    salted = heads.withColumn("_salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int"))
    return salted.join(answers.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["signature", "_salt"])


class _Repair:
    """The rows of one conversation, one after another, repaired by its audit."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, _E

    def _inserts(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._next(), ""

    def _next(self) -> str:
        """The role that follows the present state."""
        self.state = _U if self.state != _U else _A
        return _FULL["u" if self.state == _U else "a"]

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        """The rows that stand for this one and the inserted ones before it."""
        yield from self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield self._next(), text
        elif edit == "K":
            if role[:1] == "s":
                self.state = _S
            else:
                self._next()
            yield role, text

    def end(self) -> Iterator[tuple[str, str]]:
        yield from self._inserts()


def _in_order(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """Each conversation's head and then its rows, dealt by conv_id and in order."""
    heads = heads.select("conv_id", F.struct([c for c in heads.columns if c != "conv_id"]).alias("head"))
    both = heads.unionByName(rows.filter("there").select("conv_id", "turn", "role", "text"), allowMissingColumns=True)
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("head").isNull(), F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.select("conv_id", "head", "role", "text")


def repaired_rows(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """conv_id, place (from 1), role, text: the rows of the repaired conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "place", "role", "text"]
        conv = repair = None
        place = 0
        for batch in batches:
            out = []
            for conv_id, head, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "head", "role", "text"))):
                if head:
                    made = [(conv, x) for x in repair.end()] if repair else []
                    conv, repair, begins = conv_id, _Repair(head["audit"]), True
                else:
                    made, begins = [(conv, x) for x in repair.row(role, text)], False
                for c, (r, t) in made:
                    place += 1
                    out.append((c, place, r, t))
                place = 0 if begins else place
            yield pa.record_batch([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))], names)
        if repair:
            out = [(conv, place + n, r, t) for n, (r, t) in enumerate(repair.end(), 1)]
            yield pa.record_batch([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))], names)

    return _in_order(heads.select("conv_id", "audit"), rows).mapInArrow(run, "conv_id bigint, place bigint, role string, text string")


def hashed(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """The heads with repaired_sha256, the hash of the repaired rows as `role:text` joined by newlines; rows stream through, none is kept."""
    names = [x.split(" ")[0] for x in _HEAD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = repair = digest = None
        some = False

        def add(made) -> None:
            nonlocal some
            for role, text in made:
                digest.update(f"{chr(10) if some else ''}{role}:{text}".encode())
                some = True

        def finished() -> dict:
            add(repair.end())
            return head | {"repaired_sha256": digest.hexdigest()}

        schema = pa.schema([(c, pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c in [*names, "repaired_sha256"]])
        for batch in batches:
            done = []
            for conv_id, own, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "head", "role", "text"))):
                if own:
                    if head is not None:
                        done.append(finished())
                    head, repair, digest, some = {"conv_id": conv_id} | own, _Repair(own["audit"]), hashlib.sha256(), False
                else:
                    add(repair.row(role, text))
            yield pa.RecordBatch.from_pylist(done, schema)
        if head is not None:
            yield pa.RecordBatch.from_pylist([finished()], schema)

    return _in_order(heads.select(*names), rows).mapInArrow(run, _HEAD + ", repaired_sha256 string")


def prepared(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The heads (conv_id, gaps, counts, cost, audit) of every conversation, and all rows after damage."""
    rows = damaged(conversations.withColumns({"conv_id": F.col("conv_id").cast("bigint"), "turn": F.col("turn").cast("bigint")}))
    heads = durable(summarised(rows, examined(rows)))
    return answered(heads).drop("signature", "_salt"), rows


def repaired(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every original conv_id."""
    return hashed(*prepared(conversations))
