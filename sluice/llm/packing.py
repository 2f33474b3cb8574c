"""Best-fit packing by the sum-of-squares rule.

A document is its token ids and an end id. Only documents longer than a sequence are cut, the
shorter rest first. Each piece goes where the squared counts of open sequences per residual gap
become smallest, a new sequence being one of the choices. Pieces are dealt by hash to groups of bounded size; the
pieces of what a group leaves open are packed once more together, in fewer groups, until they fit one group or
little is closed any more. In that last pass a sequence is opened only where none has room, since few are asked for.

Null and empty texts are one piece that holds the end id; texts of any length are cut whole. Repeated rows are packed
each for itself, with or without doc_id. Equal lengths are taken by doc_id, piece and row, equal choices by the smallest
gap. An empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import blocks, durable

CAPACITY = 1024
END_ID = 2
#: Pieces that one task packs at once.
GROUP = 16_000
#: Share of the pieces that a pass may leave; if it leaves more, the next pass is the last.
GAIN = 0.7
#: Distinct words whose ids a Python worker remembers.
REMEMBERED = 400_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLACED = PIECES + ", sequence_id bigint, offset bigint"


#: Words that are one part for either library's splitting rule whatever its Unicode version.
WORD = re.compile("[ ]?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
#: Characters on which both libraries' splitting rules agree.
PLAIN = re.compile("[\x20-\x7e\n\u00c0-\u024f]+")
ODD_SPACE = re.compile(r"[^\S \n]|\0")


def apart(text: str) -> bool:
    """Whether white space is single spaces and line feeds, none beside another or at an end."""
    beside = "  " in text or "\n\n" in text or " \n" in text or "\n " in text
    return not (beside or text[:1] in " \n" or text[-1:] in " \n" or ODD_SPACE.search(text))


class Known(dict):
    """Ids by part, learnt when first asked for. The first parts stay; later ones go whenever too many are held."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.later: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.plain = None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import tiktoken

            with open(ranks, "rb") as lines:
                held = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            rule = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
            encoding = tiktoken.Encoding("ranks", pat_str=rule, mergeable_ranks=held, special_tokens={})
            self.plain, self.piece = encoding.encode_ordinary, encoding._core_bpe.encode_single_piece

    def __missing__(self, part: str) -> bytes:
        found = self.later.get(part)
        if found is not None:
            return found
        if self.plain is not None and WORD.fullmatch(part):
            found = array("I", self.piece(part.encode())).tobytes()
        elif self.plain is not None and PLAIN.fullmatch(part):
            found = array("I", self.plain(part)).tobytes()
        else:
            found = array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()
        if len(self) < REMEMBERED:
            self[part] = found
        else:
            if len(self.later) >= REMEMBERED:
                self.later.clear()
            self.later[part] = found
        return found


class Encoder:
    """Ids as little-endian 32-bit bytes.

    The vocabulary's splitting rule always cuts before a single space that stands between two
    other characters, and around a single line feed there, so the ids of a text are those of such
    parts end to end, and each distinct part needs encoding once. Texts with white space side by side
    or at an end are encoded whole. Parts of plain letters go through the ranks file of the
    same vocabulary where it lies beside the given one, which gives the same ids in less time.
    """

    def __init__(self, path: str):
        self.known = Known(path)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.known.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        get = self.known.__getitem__
        return [b"".join(map(get, x.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0"))) if apart(x) else self.whole([x])[0] for x in texts]


def cut(n: int, capacity: int) -> list[int]:
    """Where the pieces of n ids start."""
    rest = n % capacity if n > capacity else 0
    return [*([0] if rest else []), *range(rest, n, capacity)]


def pieces_of(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    tail = int(end_id).to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path)
        for batch in batches:
            for part in blocks(batch, "text"):
                rows = []
                for key, ids in zip(part.column("doc_id").to_pylist(), encoder([x or "" for x in part.column("text").to_pylist()])):
                    ids += tail
                    n = len(ids) // 4
                    starts = cut(n, capacity)
                    for i, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                        rows.append((key, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
                names = ("doc_id", "piece", "start", "length", "ids_crc32")
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=list(names))

    return documents.select("doc_id", "text").mapInArrow(encode, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int, opening: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, taken in the given order, and the gap that each bin keeps.

    A length s goes into the open bin with gap g >= s, or into a new one, for which the sum over h of N(h)^2 is
    least afterwards, where N(h) bins have gap h and full ones do not count. Ties go to the smallest
    gap. Without `opening` a bin is opened only where none has room.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps: list[int] = []
    where, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    none = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        best = none
        if s < capacity:
            now = counts[s:capacity]
            change = 2 * (counts[: capacity - s] - now + 1)  # a bin of gap s + index gets gap index
            change[0] = 1 - 2 * now[0]
            change[now == 0] = none
            g = int(change.argmin())
            best = change[g]
        if best < none and not (opening and best > 2 * int(counts[capacity - s]) + 1):
            g += s
            b = open_bins[g].pop()
            counts[g] -= 1
        else:
            g, b = capacity, len(gaps)
            gaps.append(capacity)
        where[i], offsets[i] = b, capacity - g
        gaps[b] = g - s
        if g > s:
            open_bins[g - s].append(b)
            counts[g - s] += 1
    return where, offsets, np.array(gaps, dtype=np.int64)


def placer(capacity: int, base: int, last: bool):
    """Packs one group; rows are fixed where their sequence is full, or all in the last pass."""

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "copy"], ascending=[False, True, True, True], ignore_index=True)
        where, offsets, gaps = sum_of_squares(rows["length"].to_numpy(), capacity, opening=not last)
        number = base + (int(rows["dealt"].iloc[0]) << 32)
        keep = np.ones(len(rows), bool) if last else gaps[where] == 0
        return rows.drop(columns=["dealt"]).assign(sequence_id=number + where, offset=offsets, fixed=keep)

    return place


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Pieces with the sequence and the offset of each; pieces hold doc_id, piece, start, length, ids_crc32."""
    todo, done, level = durable(pieces.withColumn("copy", F.monotonically_increasing_id())), [], 0
    left = todo.filter(F.col("length") < capacity).count()
    done.append(todo.filter(F.col("length") == capacity).select(*pieces.columns, F.col("copy").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")))
    todo = todo.filter(F.col("length") < capacity)
    before = None
    while left:
        level += 1
        groups = max(1, -(-left // group))
        last = groups == 1 or (before is not None and left > GAIN * before)
        place = placer(capacity, level << 56, last)
        dealt = todo.withColumn("dealt", F.pmod(F.xxhash64("doc_id", "piece", "copy", F.lit(level)), F.lit(groups)).cast("bigint"))
        placed = durable(dealt.groupBy("dealt").applyInPandas(place, f"{PIECES}, copy bigint, sequence_id bigint, offset bigint, fixed boolean"))
        done.append(placed.filter("fixed").select(*pieces.columns, "sequence_id", "offset"))
        todo = placed.filter("not fixed").select(*pieces.columns, "copy")
        before, left = left, 0 if last else todo.count()
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    return pack(pieces_of(documents, tokenizer_path, capacity), capacity, group)
