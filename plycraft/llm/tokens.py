"""Token ids in binary files: byte-level BPE ids in document order, coded by rANS.

Documents are range-partitioned and sorted by id; a task tokenizes its range, cuts it into
files of about ``file_ids`` ids at document ends, and writes each under a name made of its
partition and number, so a retried task overwrites its own files. Reading back decodes the
files' blocks and needs nothing else than the files.

Words are tokenized once: a space or newline between two other characters always starts a
token, so a text without other white space is a list of pieces whose ids are gathered from
a worker's table of distinct pieces. Any other text, and any that holds the literal of an
added token (an end mark, say), goes through the library whole. Results are those of the
library as it loads the file.

Defined results: null and empty texts have only the end id; repeated ids keep the order of
their texts' hash, and equal rows are equal; a null doc_id sorts first (in the files it is
the smallest long, and is null again when they are read); an empty table writes no file; extra columns are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rans
from .common import mix, pieces_by_bytes, put_file, shuffle_partitions, small_batches, span_hashes, string_bytes, text_of, word_spans, workspace

END_ID = 0
FILE_IDS = 1 << 22
#: A worker's table starts anew when it holds this many pieces (about 32 bytes each); only
#: speed depends on it.
TABLE_PIECES = 3_000_000
NULL_ID = -(1 << 63)
#: What comes before a piece: nothing, a space, a newline, or letters.
BARE, SPACED, LINED, TAIL = range(4)
LEADS = ("", " ", "\n", "")
_PUNCTUATION, _LETTER, _OTHER_SPACE = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum() and b != 39]] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_OTHER_SPACE[[9, 11, 12, 13, *range(0x1C, 0x20)]] = True


def irregular(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows with white space (as any library might define it) beside white space, at an end,
    or of another kind than space and newline: they go through the library whole."""
    n, rows = len(data), len(offsets) - 1
    if not n:
        return np.zeros(rows, bool)
    space = (data == 32) | (data == 10)
    after = lambda k: np.r_[data[k:], np.zeros(min(k, n), np.uint8)]
    one, two = after(1), after(2)
    bad = _OTHER_SPACE[data]
    bad |= (data == 0xC2) & ((one == 0x85) | (one == 0xA0))
    bad |= (data == 0xE2) & (((one == 0x80) & ((two <= 0x8B) | (two == 0xA8) | (two == 0xA9) | (two == 0xAF))) | ((one == 0x81) & (two == 0x9F)))
    bad |= ((data == 0xE1) & (one == 0x9A) & (two == 0x80)) | ((data == 0xE3) & (one == 0x80) & (two == 0x80)) | ((data == 0xEF) & (one == 0xBB) & (two == 0xBF))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    bad |= space & (np.r_[space[1:], False] | edge[1:] | edge[:-1])
    at = np.flatnonzero(bad)
    return np.bincount(np.searchsorted(offsets, at, "right") - 1, minlength=rows) > 0


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PieceTokenizer:
    """The library's ids, with each distinct piece tokenized once.

    A piece is a word with what leads it. ASCII punctuation after ASCII letters is a token
    start of its own, so it is a piece of its own. Pieces are known by 64-bit hashes in a
    sorted table of id spans; a batch looks each distinct piece up once and gathers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as src:
            spec = json.load(src)
        self.added = [x["content"].encode() for x in spec.get("added_tokens") or []]
        pre = spec.get("pre_tokenizer") or {}
        self.split = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.start, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        flat, sizes = [self.flat], []
        for a in range(0, len(pieces), 20_000):
            some = pieces[a : a + 20_000]
            e = self.tk.encode(some, is_pretokenized=True, add_special_tokens=False)
            flat.append(np.array(e.ids, np.uint32))
            sizes.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(some)))
        size = np.concatenate(sizes)
        start = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate(flat)
        all_keys = np.concatenate([self.keys, keys])
        order = np.argsort(all_keys, kind="stable")
        self.keys, self.start, self.size = all_keys[order], np.concatenate([self.start, start])[order], np.concatenate([self.size, size])[order]

    def _added(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows that may hold an added token's literal."""
        text, at = data.tobytes(), []
        for literal in self.added:
            here = text.find(literal)
            while here >= 0:
                at.append(here)
                here = text.find(literal, here + 1)
        return np.bincount(np.searchsorted(offsets, np.array(at, np.int64), "right") - 1, minlength=len(offsets) - 1) > 0

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """start, end, lead and row of pieces, in order."""
        start, end, row = word_spans(data, offsets)
        lead = np.where(start == offsets[row], BARE, np.where(data[start - 1] == 32, SPACED, LINED))
        last = np.maximum.accumulate(np.where(_PUNCTUATION[data], -1, np.arange(len(data))))
        cut = last[end - 1] + 1
        other = np.zeros(len(data) + 1, np.int64)
        np.cumsum(~_LETTER[data], out=other[1:])
        two = (cut > start) & (cut < end)
        two[two] = other[cut[two]] == other[start[two]]
        starts = np.concatenate([start, cut[two]])
        order = np.argsort(starts, kind="stable")
        take = lambda a, b: np.concatenate([a, b])[order]
        return starts[order], take(np.where(two, cut, end), end[two]), take(lead, np.full(two.sum(), TAIL)), take(row, row[two])

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each followed by ``end``, and the number of ids of each."""
        data, offsets = string_bytes(column)
        rows = len(offsets) - 1
        odd = irregular(data, offsets) | self._added(data, offsets) if self.split else np.ones(rows, bool)
        whole = np.flatnonzero(odd & (np.diff(offsets) > 0))
        start, stop, lead, row = self._pieces(data, offsets) if len(data) else (np.zeros(0, np.int64),) * 4
        keep = ~odd[row]
        start, stop, lead, row = start[keep], stop[keep], lead[keep], row[keep]
        with np.errstate(over="ignore"):
            key = mix(span_hashes(data, start, stop) + lead.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) if len(start) else np.zeros(0, np.uint64)
        distinct, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > TABLE_PIECES:
            self._forget()
        at = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != distinct) if len(self.keys) else np.arange(len(distinct))
        if len(new):
            text = data.tobytes()
            where = first[new]
            self._learn(distinct[new], [LEADS[k] + text[a:b].decode() for a, b, k in zip(start[where].tolist(), stop[where].tolist(), lead[where].tolist(), strict=True)])
            at = np.searchsorted(self.keys, distinct)
        begin, size = (self.start[at][inverse], self.size[at][inverse]) if len(key) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        odd_ids = [np.array(e.ids, np.uint32) for e in self.tk.encode_batch([column[int(i)].as_py() for i in whole], add_special_tokens=False)] if len(whole) else []
        lengths = np.bincount(row, size, rows).astype(np.int64) + 1
        lengths[whole] += np.array([len(x) for x in odd_ids], np.int64)
        ends = np.cumsum(lengths)
        out = np.full(int(ends[-1]) if rows else 0, end, np.uint32)
        if len(size):
            before = np.cumsum(size) - size  # places among the gathered ids, then among all
            of_row = np.bincount(row, size, rows).astype(np.int64)
            shift = (ends - lengths) - (np.cumsum(of_row) - of_row)
            within = np.arange(int(size.sum())) - np.repeat(before, size)
            out[np.repeat(before + shift[row], size) + within] = self.flat[np.repeat(begin, size) + within]
        for i, x in zip(whole, odd_ids, strict=True):
            out[ends[i] - lengths[i] : ends[i] - 1] = x
        return out, lengths


_tokenizers: dict[str, PieceTokenizer] = {}


def tokenizer(path: str) -> PieceTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = PieceTokenizer(path)
    return _tokenizers[path]


def write_ids(docs: DataFrame, folder: str, *, doc_id: str = "doc_id", text: str = "text", model: str | None = None, file_ids: int = FILE_IDS, partitions: int | None = None) -> DataFrame:
    """Write the files; returns their list: file, docs, ids. Files in name order hold the
    documents in ascending order of id."""
    model = model or default_tokenizer()
    small_batches(docs.sparkSession)
    source = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("d"), text_of(F.col(text)).alias("t"))
    ranged = source.repartitionByRange(partitions or shuffle_partitions(docs.sparkSession), "d", F.xxhash64("t")).sortWithinPartitions("d", F.xxhash64("t"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part, number = tokenizer(model), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        names: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            name = f"part-{part:06d}-{number:06d}.rans"
            docs = np.concatenate(names)
            put_file(f"{folder}/{name}", rans.encode(np.concatenate(ids), docs, np.concatenate(sizes)))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(docs)], pa.int64()), pa.array([held], pa.int64())], names=["file", "docs", "ids"])

        for batch in pieces_by_bytes(batches, "t", 4 << 20):
            got, lengths = t.encode(batch.column(1), END_ID)
            ids.append(got)
            sizes.append(lengths)
            names.append(batch.column(0).to_numpy())
            held += len(got)
            if held >= file_ids:  # at a document's end
                yield flush()
                ids, sizes, names, held, number = [], [], [], 0, number + 1
        if names:
            yield flush()

    return ranged.mapInArrow(work, "file string, docs bigint, ids bigint")


def read_docs(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32. ``files`` is the
    written list; its running sum (one row a file) gives each file's first position."""
    from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

    schema = StructType([StructField("path", StringType()), StructField("modificationTime", TimestampType()), StructField("length", LongType()), StructField("content", BinaryType())])
    order = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("file", F.coalesce(F.sum("ids").over(order), F.lit(0)).alias("before"))
    stored = spark.read.format("binaryFile").schema(schema).option("pathGlobFilter", "*.rans").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                r = rans.Reader(data.as_buffer().to_pybytes())
                ids, ends = r.all().astype("<u4"), np.cumsum(r.lengths)
                begins = ends - r.lengths
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(crc)), pa.array(r.doc_ids), pa.array(begins), pa.array(r.lengths), pa.array(crc, pa.int64())], names=["file", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = stored.mapInArrow(work, "file string, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(placed, "file").select(F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, **how) -> tuple[str, DataFrame]:
    """Write to a new shared folder: (folder, list of files). The list is written too, so
    files exist before anything reads them."""
    from .common import materialise

    folder = workspace(docs.sparkSession, "token-ids")
    return folder, materialise(write_ids(docs, folder, **how), "token-files")
