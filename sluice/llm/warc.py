"""WARC archives with a two-level capture index.

Writing: one gzip member per record, so a byte range is a record. Of equal payloads of at least
100 bytes the record with the smallest page_id is a response and the others are revisits that name
it; smaller payloads are always responses. Index: lines sorted by reversed-host URL key lie in
compressed blocks, and a sparse directory keeps the first key and the byte range of each block. Each sorted part of the
index has its own directory file, so that the list of parts, which is all that tasks share, has a row for each
partition, whatever the size. Looking up: binary search of the parts, of a part's directory, then of the block's
lines, then range reads of the records. `captures` does so for a whole table of URLs: sorted, so that what lies together is
read once, and with the blocks of a key dealt out, so that a URL of very many captures is no hot task.

Tasks write under names of their own and rename at the end, so a task that runs again leaves no
torn archive, and only the archives that the finished tasks report are read.

Null html is an empty payload and a null URL an empty key; URLs come back letter by letter. Records of any length are written
whole. Repeated rows give a record each; of equal rows that share the smallest page_id each is a response, as is a row
without page_id. An empty table gives no records. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import dropped, durable

LEAST_SHARED = 100
#: Index lines in a compressed block.
BLOCK_LINES = 3000
#: Bytes of payload in one archive.
ARCHIVE_BYTES = 64 << 20
EXACT_URI = "X-Target-URI-Base64"

LINES = "surt string, page_id bigint, url string, file string, offset bigint, length bigint, digest string, record_type string"
READ = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def columns(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64()}
    fields = [x.split() for x in schema.split(", ")]
    held = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(held, fields)], names=[n for n, _ in fields])


def surt(url: str | None) -> str:
    """Reversed-host key: http://www.a.com:80/x?y -> com,a,www)/x?y."""
    found = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?([^/?#]*)([^#]*)", url or "")
    host = re.sub(r"^[^@]*@|:\d*$", "", found[1]).lower()
    return ",".join(reversed(host.split("."))) + ")" + re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", found[2] or "/")


def filesystem(folder: str):
    """A file system that Python workers reach, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(folder))


def one_line(value: str) -> str:
    return re.sub(r"[\x00-\x1f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP head, whose length is that of the full payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}",
    ]
    if url is not None:
        lines.insert(3, f"WARC-Target-URI: {one_line(url)}")
        if one_line(url) != url:  # header lines hold no control characters
            lines.append(f"{EXACT_URI}: {base64.b64encode(url.encode()).decode()}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers, HTTP head and payload of one record; a payload that does not match its digest is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("torn record")
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    n = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if kind == "response":
        digest_read = hashlib.sha256(payload).hexdigest()
        if digest_read != digest or len(payload) != n:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} is not what was written")
    ident = lambda name: int(x) if (x := fields.get(name, "<urn:page:None>")[len("<urn:page:") : -1]) != "None" else None
    url = base64.b64decode(fields[EXACT_URI]).decode() if EXACT_URI in fields else fields.get("WARC-Target-URI")
    return {"page_id": ident("WARC-Record-ID"), "url": url, "payload_bytes": n, "payload_digest": digest, "record_type": kind, "refers_to": ident("WARC-Refers-To"), "payload": payload}


def annotate(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest and refers_to. Only digests and ids are grouped, pre-aggregated; html joins by digest."""
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    base = base.withColumn("digest", F.sha2(F.encode("html", "utf-8"), 256)).withColumn("n", F.octet_length("html"))
    firsts = durable(
        pages.select("page_id", F.coalesce("html", F.lit("")).alias("html"))
        .filter(F.octet_length("html") >= LEAST_SHARED)
        .groupBy(F.sha2(F.encode("html", "utf-8"), 256).alias("digest"))
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
        .select("digest", "first")
    )
    hashed = F.xxhash64("digest")  # a second key: both sides are dealt anew, so that a hot payload may be split
    joined = base.withColumn("k", hashed).join(firsts.withColumn("k", hashed), ["digest", "k"], "left").drop("k")
    return joined.withColumn("refers_to", F.when((F.col("n") >= LEAST_SHARED) & (F.col("first") != F.col("page_id")), F.col("first"))).drop("first", "n")


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Archives under the folder and the lines of their index, not yet sorted."""

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = filesystem(folder)
        out = None
        try:
            for rows in batches:
                lines = []
                for page_id, url, html, digest, refers_to in zip(*(rows.column(x).to_pylist() for x in ("page_id", "url", "html", "digest", "refers_to"))):
                    if out is None:
                        name = f"part-{uuid.uuid4().hex}.warc.gz"
                        out, at = files.open_output_stream(f"{top}/{name}.open", compression=None), 0
                    packed = gzip.compress(record(page_id, url, html.encode(), digest, refers_to), 1, mtime=0)
                    out.write(packed)
                    lines.append((surt(url), page_id, url, name, at, len(packed), digest, "response" if refers_to is None else "revisit"))
                    at += len(packed)
                    if at > ARCHIVE_BYTES:
                        out.close()
                        files.move(f"{top}/{name}.open", f"{top}/{name}")
                        out = None
                yield columns(lines, LINES)
            if out is not None:
                out.close()
                files.move(f"{top}/{name}.open", f"{top}/{name}")
        finally:
            if out is not None:
                out.close()

    files, top = filesystem(folder)
    files.create_dir(top, recursive=True)
    return annotate(pages).mapInArrow(archive, LINES)


PARTS = "first_key string, directory string"


def index(lines: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Compressed blocks of sorted lines with a directory file for each part; the parts: first_key and directory."""

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, top = filesystem(folder)
        name, at, held, found, out = f"index-{uuid.uuid4().hex}.gz", 0, [], [], None

        def flush():
            nonlocal at, out
            if out is None:
                out = files.open_output_stream(f"{top}/{name}.open", compression=None)
            packed = zlib.compress("\n".join("\t".join(map(str, x)) for x in held).encode(), 6)
            out.write(packed)
            found.append((held[0][0], name, at, len(packed)))
            at += len(packed)
            held.clear()

        for rows in batches:
            for row in rows[["surt", "page_id", "file", "offset", "length", "digest", "record_type"]].itertuples(index=False):
                held.append(row)
                if len(held) == block_lines:
                    flush()
        if held:
            flush()
        if out is not None:
            out.close()
            files.move(f"{top}/{name}.open", f"{top}/{name}")
            directory = name.replace("index-", "directory-")
            with files.open_output_stream(f"{top}/{directory}.open", compression=None) as written:
                written.write(zlib.compress("\n".join("\t".join(map(str, x)) for x in found).encode(), 6))
            files.move(f"{top}/{directory}.open", f"{top}/{directory}")
            yield pd.DataFrame([(found[0][0], directory)], columns=["first_key", "directory"])

    parts = max(1, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = lines.repartitionByRange(parts, "surt", "page_id").sortWithinPartitions("surt", "page_id")
    return ordered.mapInPandas(blocks, PARTS)


def read_lines(files, path: str, offset: int = 0, length: int | None = None) -> list[list[str]]:
    with files.open_input_file(path) as source:
        data = source.read_at(source.size() if length is None else length, offset)
    return [x.split("\t") for x in zlib.decompress(data).decode().split("\n")]


def reach(firsts: list[str], key: str) -> range:
    """The sorted stretches, given by their first keys, that may hold the key: binary search, then as long as it goes on."""
    i = max(0, bisect.bisect_left(firsts, key) - 1)
    return range(i, max(i, bisect.bisect_right(firsts, key)))


class Directory:
    """The sorted parts of an index; the directory of the part that was asked last is kept."""

    def __init__(self, parts: list, folder: str):
        self.files, self.top = filesystem(folder)
        self.parts = sorted((x.first_key, x.directory) for x in parts)
        self.firsts = [x for x, _ in self.parts]
        self.held: tuple[int, list, list] = (-1, [], [])

    def blocks(self, key: str) -> Iterator[tuple[str, int, int]]:
        """File, offset and length of the blocks that may hold the key."""
        for i in reach(self.firsts, key):
            if self.held[0] != i:
                entries = read_lines(self.files, f"{self.top}/{self.parts[i][1]}")
                self.held = (i, entries, [x[0] for x in entries])
            for j in reach(self.held[2], key):
                _, file, offset, length = self.held[1][j]
                yield file, int(offset), int(length)


def of_key(lines: list[list[str]], keys: list[str], key: str) -> list[list[str]]:
    """A block's lines with the key; keys are the lines' first fields."""
    return lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]


def lookup(parts: list, folder: str, url: str) -> list[dict]:
    """Captures of one URL."""
    directory, key, out = Directory(parts, folder), surt(url), []
    for file, offset, length in directory.blocks(key):
        lines = read_lines(directory.files, f"{directory.top}/{file}", offset, length)
        for line in of_key(lines, [x[0] for x in lines], key):
            with directory.files.open_input_file(f"{directory.top}/{line[2]}") as source:
                out.append(parse(gzip.decompress(source.read_at(int(line[4]), int(line[3])))))
    return out


BLOCK = "key string, file string, offset bigint, length bigint"
RANGE = "file string, offset bigint, length bigint"


def captures(urls: DataFrame, parts: DataFrame, folder: str) -> DataFrame:
    """All captures of the URLs, each once however often its URL is asked. The parts are one row for each partition of the index."""
    spark = urls.sparkSession
    held = spark.sparkContext.broadcast(parts.collect())
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surt(x) for x in rows.column("url").to_pylist()], pa.string())], names=["key"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory = Directory(held.value, folder)
        for rows in batches:
            yield columns([(key, *block) for key in rows.column("key").to_pylist() for block in directory.blocks(key)], BLOCK)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = filesystem(folder)
        last, found, keys = None, [], []
        for rows in batches:
            out = []
            for key, *block in zip(*(rows.column(x).to_pylist() for x in ("key", "file", "offset", "length"))):
                if block != last:
                    last, found = block, read_lines(files, f"{top}/{block[0]}", block[1], block[2])
                    keys = [x[0] for x in found]
                out += [(x[2], int(x[3]), int(x[4])) for x in of_key(found, keys, key)]
            yield columns(out, RANGE)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = filesystem(folder)
        name, source = None, None
        names = [x.split()[0] for x in READ.split(", ")]
        try:
            for rows in batches:
                found = []
                for file, offset, length in zip(*(rows.column(x).to_pylist() for x in ("file", "offset", "length"))):
                    if file != name:
                        if source is not None:
                            source.close()
                        name, source = file, files.open_input_file(f"{top}/{file}")
                    got = parse(gzip.decompress(source.read_at(length, offset)))
                    found.append(tuple(got[x] for x in names))
                yield columns(found, READ)
        finally:
            if source is not None:
                source.close()

    asked = urls.select("url").mapInArrow(keyed, "key string").distinct()
    blocks = asked.repartitionByRange(n, "key").sortWithinPartitions("key").mapInArrow(search, BLOCK)
    ranges = blocks.repartitionByRange(n, "file", "offset", "key").sortWithinPartitions("file", "offset", "key").mapInArrow(lines, RANGE)
    return ranges.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(records, READ)


def round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """Write, index, look up the URL of every page and read back: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    The folder is deleted at the end.
    """
    parts = durable(index(durable(write(pages, folder)), folder))
    out = durable(captures(pages, parts, folder))
    dropped(pages.sparkSession, folder)
    return out
