"""What several operators share: checkpoints, Arrow batches in small blocks, vectorised word hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once; a longer single text is a block of its own.
BLOCK_BYTES = 2 << 20


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Only a local session has one of its own where that is unset."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="shared")
    return _LOCAL[context.applicationId]


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession):
    """Shuffle files of what is executed inside are deleted at its end: the rows lie in the shared folder then."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


_ENDING: set[str] = set()


def temporary(spark: SparkSession, path: str) -> None:
    """Delete the folder, which is there, when the driver ends."""
    if path not in _ENDING:
        _ENDING.add(path)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)


def durable(df: DataFrame) -> DataFrame:
    """The rows, written to the session's checkpoint folder, which goes with the session; lost executors cost no recomputation of what led here."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(spark))
    temporary(spark, context._jsc.sc().getCheckpointDir().get())
    with cleaned(spark):
        return df.select("*").checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(batch: pa.RecordBatch, column: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in row ranges of at most `most` bytes of one text column, one row at least."""
    if not batch.num_rows:
        return
    sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    ends, first = np.cumsum(sizes), 0
    while first < batch.num_rows:
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(first, last - first)
        first = last


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end and the offsets of each; null is empty."""
    filled = pa.array(texts).fill_null("").cast(pa.large_string())
    filled = filled.combine_chunks() if isinstance(filled, pa.ChunkedArray) else filled
    n = len(filled)
    offsets = np.frombuffer(filled.buffers()[1], dtype=np.int64)[filled.offset : filled.offset + n + 1]
    data = filled.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if n else raw[:0], offsets - offsets[0] if n else np.zeros(1, np.int64)


_MASK = (1 << 64) - 1


def splitmix(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit values."""
    out, x = [], seed
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & _MASK
        z = x
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append(z ^ (z >> 31))
    return np.array(out, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = splitmix(7, 256)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), np.uint64(base & _MASK), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Prefix:
    """Rolling hashes: any substring's 64-bit hash out of prefix sums of random byte values times powers of an odd base."""

    def __init__(self, raw: np.ndarray, lower: bool = False):
        self.sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((_LOWER if lower else _BYTE)[raw] * powers(_BASE, len(raw))[: len(raw)], out=self.sums[1:])
        self.inverse = powers(_INVERSE, len(raw) + 1)

    def __call__(self, starts, ends) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (np.asarray(ends) - starts).astype(np.uint64))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ and the first word of each text (one more at the end)."""
    space = _SPACE[raw]
    edge = np.ones(len(raw) + 1, dtype=bool)
    edge[:-1] = space
    before = np.ones(len(raw) + 1, dtype=bool)
    before[1:-1] = space[:-1]
    cut = offsets[(offsets > 0) & (offsets < len(raw))]
    before[cut] = True
    starts = np.flatnonzero(before[:-1] & ~space)
    after = edge.copy()
    after[cut] = True  # a word ends where the next text begins
    ends = np.flatnonzero(after[1:] & ~space) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word and the first word of each text."""
    starts, ends, first = words(raw, offsets)
    return Prefix(raw, lower)(starts, ends), first


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash for each run of k words."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - k + 1, dtype=np.uint64)
    for i in range(k):
        out = (out ^ hashes[i : i + len(out)]) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x632BE59BD9B4E019)
        out ^= out >> np.uint64(32)
    return mix(out)


def free(df: DataFrame, *columns: str) -> DataFrame:
    """The rows, with integer columns whose partitioning Spark does not rely on: a join on them deals both sides
    anew and may split a hot key, which it could not below an aggregate or on a side that lies partitioned."""
    return df.select(*(F.col(c).bitwiseXOR(F.lit(0)).alias(c) if c in columns else F.col(c) for c in df.columns))


def keys(df: DataFrame, *columns: str) -> DataFrame:
    """Checkpointed integer columns, free of their partitioning."""
    return free(durable(df.select(*columns)), *columns)


#: Rows of 16 bytes up to which they are broadcast to documents; more are joined by shuffling.
FEW = 1_000_000


def by_content(documents: DataFrame, some: DataFrame, how: str) -> DataFrame:
    """left_anti or left_semi: documents without or with those whose doc_id and xxhash64(text) are among `some` (doc_id, h)."""
    own = some.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h")).distinct()
    own = F.broadcast(own) if own.count() <= FEW else own
    rows = documents.select(F.struct(*documents.columns).alias("_row"), F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_text"))
    return rows.join(own, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_text") == F.col("_h")), how).select("_row.*")


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows as a Parquet table in the shared folder, and its path for `dropped`."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with cleaned(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    temporary(df.sparkSession, path)
    return df.sparkSession.read.parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a stored table that is no longer read."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
