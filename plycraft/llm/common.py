"""What the corpus operators share: shared-folder tables, column helpers and byte-level numpy."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and 0x09-0x0D.
SPACES = " \t\n\x0b\x0c\r"
#: Where checkpoints go when the session names no folder and runs in one process (tests).
LOCAL_SHARED = "/tmp/checkpoints/plycraft"


# ---------------------------------------------------------------- shared folder


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only a one-process session may do without that setting; a cluster without it is
    an error, since a machine-local folder would lose data with its executor."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    os.makedirs(LOCAL_SHARED, exist_ok=True)
    return LOCAL_SHARED


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here, and a lost
    executor costs no recomputation of what came before."""
    path = workspace(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one run of an operator, in one folder of the shared folder. A table is
    dropped once everything that was derived from it has been written: until then a lost
    executor may have to read it again."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.names = spark, workspace(spark, name), {}

    def table(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write and read back; a name may come again, and then means the newer table."""
        self.names[name] = self.names.get(name, -1) + 1
        path = self._path(name, self.names[name])
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _path(self, name: str, version: int) -> str:
        return f"{self.folder}/{name}-{version}"

    def release(self) -> None:
        """Shuffle files of finished writes go when the driver collects its garbage: now."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self._path(name, self.names[name]))

    def drop_older(self, name: str) -> None:
        """The table that ``name`` meant before its last writing."""
        if self.names[name]:
            self._delete(self._path(name, self.names[name] - 1))

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a shared-folder URI, usable in executors' tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def put_file(uri: str, data: bytes) -> None:
    """Write a whole file so that a retried or speculative task never shows half of it:
    an attempt's own name first, then a rename."""
    store, path = filesystem(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, path)


def get_range(uri: str, start: int, length: int) -> bytes:
    store, path = filesystem(uri)
    with store.open_input_file(path) as src:
        return src.read_at(length, start)


#: Bytes of an Arrow batch of texts, and the setting (with its default) that bounds them.
BATCH, BATCH_KEY, BATCH_DEFAULT = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of a few MB: executors hold several at once, in both
    processes and with room to grow. The session's setting is lowered unless it was set."""
    if spark.conf.get(BATCH_KEY, BATCH_DEFAULT) in (BATCH_DEFAULT, BATCH_DEFAULT[:-1]):
        spark.conf.set(BATCH_KEY, str(BATCH))


# ---------------------------------------------------------------- columns


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body`` (a lambda
    variable holds it, so the optimizer cannot inline the expression again)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def text_of(col: Column) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(col.cast("string"), F.lit(""))


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a non-null text."""
    return F.array_remove(F.split(F.translate(text, SPACES[1:], " " * 5), " ", -1), "")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


# ---------------------------------------------------------------- Arrow batches as bytes

_MUL1, _MUL2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit values (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + _STEP
        x = (x ^ (x >> np.uint64(30))) * _MUL1
        x = (x ^ (x >> np.uint64(27))) * _MUL2
    return x ^ (x >> np.uint64(31))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, int64 offsets) of a string or binary column; nulls are empty."""
    column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, pa.scalar("", column.type) if not pa.types.is_binary(column.type) else pa.scalar(b"", column.type))
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces_by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Cut batches so that numpy temporaries stay small: at most ``limit`` bytes of the
    column in a piece, or one row if that row alone is longer, and at most ``rows`` rows."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        row, done = 0, 0
        while row < batch.num_rows:
            to = min(max(row + 1, int(np.searchsorted(ends, done + limit, "right"))), row + rows)
            yield batch.slice(row, to - row)
            row, done = to, int(ends[to - 1])


_rng = np.random.Generator(np.random.PCG64(7))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C55)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and their inverses."""
    if len(_powers["up"]) < n + 1:
        size = max(n + 1, 1 << 20)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for key, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; words never cross rows."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    ink = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, ink[:-1]
    start = np.flatnonzero(ink & (edge[:-1] | ~before))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, ink[1:]
    end = np.flatnonzero(ink & (edge[1:] | ~after)) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, by prefix sums; they depend on the bytes alone."""
    up, down = powers(len(data))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
