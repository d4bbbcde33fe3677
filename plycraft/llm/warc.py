"""WARC archives with an external index merge.

Writing: payloads are hashed in the JVM; only digests that occur more than once are joined
back (their table is as small as the repetition is), so a page is a ``response`` unless a
page with equal payload and a larger id exists; then it is a ``revisit`` that names that
page. A task appends gzip members, one per record, to archives of bounded size and sorts
what it captured by (URL key, timestamp): a run.

Index: runs are range-partitioned by (URL key, timestamp, id); in each range a k-way loser
tree merges the runs' sorted slices, which gives globally ordered capture histories
(range number, position) without a global sort in any one place. A key's history goes on
over range ends: its captures in earlier ranges are added to the numbers of a range's first key.

Reading: archives are read member by member through Spark's binary reader; each record is
located by (file, offset) in the merged index.

Defined results: null html is an empty payload; equal empty payloads are copies like any
other; a null url has the key "-" and target "-"; a null page_id counts as the smallest
id; among rows with the same page_id and payload all are of the type of that id; very long
payloads are one record; an empty table writes no archive; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, pieces_by_bytes, put_file, shuffle_partitions, small_batches, text_of, workspace

ARCHIVE_BYTES = 16 << 20
#: Captures that a range of the index holds, about.
RANGE_ROWS = 500_000
NULL_ID = -(1 << 63)
EPOCH = 1_600_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str) -> str:
    """Host labels reversed, then path and query: captures of a site sort together."""
    try:
        parts = urlsplit(url.strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip().lower() or "-"
    if not host:
        return url.strip().lower() or "-"
    labels = host.removeprefix("www.").split(".")[::-1]
    return ",".join(labels) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def one_line(value: str) -> str:
    return "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in value) or "-"


def record(page_id: int, url: str, stamp: int, payload: bytes, refers_to: int | None) -> bytes:
    """A record as one gzip member. A revisit keeps the digest and the HTTP head (with the
    payload's length) and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{page_id}>", f"WARC-Date: {datetime.fromtimestamp(stamp, UTC):%Y-%m-%dT%H:%M:%SZ}", f"WARC-Target-URI: {one_line(url)}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def parse(member: bytes) -> dict:
    """What a record says; a response's digest and length are taken from its payload."""
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response":
        size, digest = len(payload), base32_sha1(payload)
        if digest != said:
            raise ValueError(f"damaged payload in {fields['WARC-Record-ID']}")
    else:
        size, digest = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"]), said
    number = lambda x: int(x.strip("<>").rpartition(":")[2]) if x else None
    return {"page_id": number(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(fields.get("WARC-Refers-To", ""))}


def members(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the gzip members of an archive."""
    at = 0
    while at < len(data):
        d = zlib.decompressobj(31)
        out = d.decompress(memoryview(data)[at : at + 65536])
        used = at + 65536
        while not d.eof:
            if used >= len(data):
                raise ValueError("an archive ends inside a record")
            out += d.decompress(memoryview(data)[used : used + 1048576])
            used += 1048576
        yield at, out
        at = min(used, len(data)) - len(d.unused_data)


class LoserTree:
    """Merges k sorted sequences: each inner node keeps the loser of its match, so a new
    item plays one match per level. Ties go to the earlier sequence."""

    def __init__(self, runs: list[Iterator]):
        self.runs, k = runs, len(runs)
        self.size = 1 << max(0, (k - 1).bit_length())
        self.heads: list = [next(r, None) for r in runs] + [None] * (self.size - k)
        self.losers = [0] * self.size
        self.winner = self._play(1) if self.size > 1 else 0

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None:
            return y is None and a < b
        return y is None or (x, a) < (y, b)

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, lose = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator:
        while self.heads and self.heads[self.winner] is not None:
            w = self.winner
            yield w, self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            node = (w + self.size) >> 1
            while node:
                if self._beats(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node >>= 1
            self.winner = w


def write_archives(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives; returns the runs: run, key, stamp, page_id, file, offset, length,
    sorted within each run. Captures have no time of their own: the stamp is derived from
    the id."""
    small_batches(pages.sparkSession)
    base = pages.select(F.coalesce(F.col(page_id).cast("long"), F.lit(NULL_ID)).alias("p"), F.coalesce(F.col(url).cast("string"), F.lit("-")).alias("u"), text_of(F.col(html)).alias("h"))
    digested = base.withColumn("dig", F.sha1(F.col("h").cast("binary")))
    again = materialise(digested.groupBy("dig").agg(F.max("p").alias("last"), F.count("*").alias("n")).where("n > 1").select(F.col("dig").alias("_dig"), "last"), "warc-copies")
    typed = digested.join(again, F.col("dig") == F.col("_dig"), "left").select("p", "u", "h", F.when(F.col("last") > F.col("p"), F.col("last")).alias("r"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        parts: list[bytes] = []
        rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            name = f"part-{part:06d}-{number:06d}.warc.gz"
            put_file(f"{folder}/{name}", b"".join(parts))
            rows.sort()
            key, stamp, page, offset, length = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(key), pa.array(stamp, pa.int64()), pa.array(page, pa.int64()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], names=["run", "key", "stamp", "page_id", "offset", "length"])

        for batch in pieces_by_bytes(batches, "h"):
            for p, u, h, r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                stamp = EPOCH + (p % 1_000_000_000 if p != NULL_ID else 0)
                data = record(p, u, stamp, h.encode(), r)
                rows.append((url_key(u), stamp, p, size, len(data)))
                parts.append(data)
                size += len(data)
                if size >= archive_bytes:
                    yield flush()
                    parts, rows, size, number = [], [], 0, number + 1
        if rows:
            yield flush()

    return typed.mapInArrow(work, "run string, key string, stamp bigint, page_id bigint, offset bigint, length bigint")


def merged_index(runs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Globally ordered captures: range, position, key, stamp, page_id, file, offset, length
    and nth, the number of the capture in its key's whole history. A task holds its range
    as Arrow columns; ranges are of about ``RANGE_ROWS`` captures."""
    parts = partitions or max(shuffle_partitions(runs.sparkSession), -(-runs.count() // RANGE_ROWS))
    ranged = runs.repartitionByRange(parts, "key", "stamp", "page_id", "run", "offset").sortWithinPartitions("run", "key", "stamp", "page_id", "offset")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held).combine_chunks()
        run, columns = whole.column(0), whole.columns[1:]
        ends = pc.run_end_encode(run.chunk(0)).run_ends.to_pylist()
        starts = [0, *ends[:-1]]
        names, part = [run[a].as_py() for a in starts], TaskContext.get().partitionId()

        def captures(start: int, end: int) -> Iterator[tuple]:
            for a in range(start, end, 256):
                yield from zip(*(c.slice(a, min(256, end - a)).to_pylist() for c in columns), strict=True)

        out: list[tuple] = []
        place, last, nth = 0, None, 0
        for w, (key, stamp, page, offset, length) in LoserTree([captures(a, b) for a, b in zip(starts, ends, strict=True)]):
            nth = nth + 1 if key == last else 1
            out.append((part, place, key, stamp, page, names[w], offset, length, nth))
            last, place = key, place + 1
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=COLUMNS)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=COLUMNS)

    COLUMNS = ["range", "position", "key", "stamp", "page_id", "file", "offset", "length", "nth"]
    own = materialise(ranged.mapInArrow(work, "range bigint, position bigint, key string, stamp bigint, page_id bigint, file string, offset bigint, length bigint, nth bigint"), "warc-ranges")
    ends = own.groupBy("range").agg(F.min_by("key", "position").alias("head"), F.max_by("key", "position").alias("tail"), F.max_by("nth", "position").alias("n"))  # a row a range
    edges = ends.select("range", F.lit(0).alias("kind"), F.col("head").alias("key"), F.lit(0).cast("long").alias("n")).unionByName(ends.select("range", F.lit(1).alias("kind"), F.col("tail").alias("key"), "n"))
    before = Window.partitionBy("key").orderBy("range", "kind").rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.withColumn("carry", F.sum("n").over(before)).where("kind = 0 and carry > 0").select(F.col("range").alias("_range"), F.col("key").alias("_key"), "carry")
    rows = own.join(F.broadcast(carried), (F.col("range") == F.col("_range")) & (F.col("key") == F.col("_key")), "left")  # at most a row a range
    return rows.select(*COLUMNS[:-1], (F.col("nth") + F.coalesce("carry", F.lit(0).cast("long"))).alias("nth"))


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the folder's archives, as parsed."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
    stored = spark.read.format("binaryFile").schema(schema).option("pathGlobFilter", "*.warc.gz").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                rows = [parse(body) | {"file": name.as_py(), "offset": at} for at, body in members(data.as_buffer().to_pybytes())]
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    ARROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    return stored.mapInArrow(work, "file string, offset bigint, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def archived(pages: DataFrame, **how) -> tuple[str, DataFrame, DataFrame]:
    """Write, merge, read back: (folder, merged index, records with their index entry)."""
    spark = pages.sparkSession
    folder = workspace(spark, "warc")
    runs = materialise(write_archives(pages, folder, **how), "warc-runs")
    index = materialise(merged_index(runs), "warc-index")
    found = read_archives(spark, folder)
    entry = index.select(F.col("file").alias("_f"), F.col("offset").alias("_o"), "key", "range", "position", "nth")
    rows = found.join(entry, (F.col("file") == F.col("_f")) & (F.col("offset") == F.col("_o"))).drop("_f", "_o")
    null = lambda c: F.nullif(F.col(c), F.lit(NULL_ID)).alias(c)
    return folder, index, rows.select(null("page_id"), "payload_bytes", "payload_digest", "record_type", null("refers_to"), "key", "range", "position", "nth", "file", "offset")
