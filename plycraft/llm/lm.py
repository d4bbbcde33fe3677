"""Language-model scoring: PPM pretrained on the training fold, beside a unigram base.

All text is read once, in blocks of about ``TEXT`` bytes. Of each block, the distinct words
and the distinct byte grams go out as packed, sorted keys with their counts in the block's
training rows (0 if only held-out rows have them), dealt by hash (words) or by the context's
last three bytes (grams). Each part adds its blocks' counts up, and then answers each block:
the counts of its words, the log10 probabilities of its grams. A block's answers meet its
text again, where they are added up for each document. So keys cross a shuffle once per
block, not once per occurrence, nothing is dropped or capped, and the model grows with the
text. A probability's logarithm is sent with an error of at most 1 in 8,192, which evens out
over a text. Only the contexts of up to two bytes (at most 256**2) are tabulated in one place.

A part that many blocks ask is split by block: counts are first added up per split, and the
sums are sent to every split of the part to answer there.

Words are known by 64-bit hashes. The model predicts lower-cased (A-Z) bytes, spaces
included, and the end of the text.

Defined results: null and empty texts have one token, the end; equal rows are scored each;
a null id hashes as the empty text; without training rows every count is 0 and every byte
is equally likely; texts of any length are scored whole; an empty table stays empty; extra
columns are not read.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ppm
from .common import LOWER, Scratch, crc_mod, filesystem, mix, pieces_by_bytes, put_file, shuffle_partitions, small_batches, span_hashes, string_bytes, text_of, word_spans, workspace

#: Bytes of text in a block, and in the pieces that temporaries are made of.
TEXT, PIECE = 12 << 20, 1 << 20
#: Keys that one split of a part is asked, about.
ASKED = 1 << 23


# ---------------------------------------------------------------- packing


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def expand(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _planes(values: np.ndarray) -> bytes:
    return squeeze(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes())


def _values(blob: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(expand(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as compressed differences, byte by byte."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_values(blob, np.uint64), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    return _planes(np.asarray(counts, np.int64))


def unpack_counts(blob: bytes) -> np.ndarray:
    return _values(blob, np.int64)


def pack_logp(logp: np.ndarray) -> bytes:
    """Probabilities' logarithms with twelve bits of mantissa (an error of 1 in 8,192 at most)."""
    bits = logp.astype(np.float32).view(np.uint32)
    return _planes((bits + np.uint32(1 << 10)) & ~np.uint32((1 << 11) - 1))


def unpack_logp(blob: bytes) -> np.ndarray:
    return _values(blob, np.uint32).view(np.float32)


def _together(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of all blobs, one after the other."""
    keys = [unpack_keys(x) for x in table.column("keys").to_pylist()]
    counts = [unpack_counts(x) for x in table.column("counts").to_pylist()]
    return (np.concatenate(keys), np.concatenate(counts)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


# ---------------------------------------------------------------- blocks


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word; hashing goes piece by piece."""
    start, end, row = word_spans(data, offsets)
    hashes, at = np.empty(len(start), np.uint64), 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + PIECE, "right")))
        low = start[at]
        hashes[at:to] = span_hashes(data[low : end[to - 1]], start[at:to] - low, end[at:to] - low)
        at = to
    return hashes, row


def word_part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (hashes % np.uint64(parts)).astype(np.int64)


def gram_part(grams: np.ndarray, parts: int) -> np.ndarray:
    """The part that holds a gram's context and its suffixes down to three bytes."""
    return (mix(ppm.suffix(grams >> np.uint64(8), ppm.LOW + 1)) % np.uint64(parts)).astype(np.int64)


PART = {"w": word_part, "g": gram_part}


def by_part(kind: str, keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of distinct ascending keys by part, the parts there are, where each begins)."""
    part = PART[kind](keys, parts)
    order = np.argsort(part, kind="stable")
    which, begin = np.unique(part[order], return_index=True)
    return order, which, np.r_[begin, len(order)]


def distinct_counts(own: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All distinct keys, with their counts among the ``own``. Both are sorted in place."""
    own.sort()
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    n, own = np.diff(np.r_[first, len(own)]), own[first]
    held.sort()
    every = ppm.distinct(np.concatenate([own, held[np.r_[True, held[1:] != held[:-1]]] if len(held) else held]))
    counts = np.zeros(len(every), np.int64)
    counts[np.searchsorted(every, own)] = n
    return every, counts


def gram_pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, row after the last, grams) of about PIECE bytes of text; a longer row
    comes in several pieces, each made with the bytes before it."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        begin, end = int(offsets[row]), int(offsets[to])
        if end - begin <= PIECE:
            yield row, to, ppm.gram_keys(data[begin:end], offsets[row : to + 1] - begin)
        else:
            for a in range(begin, end, PIECE):
                b, c = min(a + PIECE, end), max(begin, a - ppm.ORDER)
                keys = ppm.gram_keys(data[c:b], np.array([0, b - c]))
                yield row, to, keys[a - c : len(keys) - (b < end)]
        row = to


def all_grams(data: np.ndarray, offsets: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The grams of the chosen rows, in one array and without large temporaries."""
    sizes = np.diff(offsets) + 1
    out, at = np.empty(int(sizes[chosen].sum()), np.uint64), 0
    for a, b, keys in gram_pieces(data, offsets):
        if not chosen[a:b].all():
            keys = keys[np.repeat(chosen[a:b], sizes[a:b])] if chosen[a:b].any() else keys[:0]
        out[at : at + len(keys)] = keys
        at += len(keys)
    return out


BLOCK = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("row", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary()), ("held", pa.binary()), ("none", pa.binary())])
BLOCK_SQL = "kind string, part int, row bigint, n bigint, keys binary, counts binary, ids binary, held binary, none binary"


def blocks(docs: DataFrame, parts: int) -> DataFrame:
    """``docs``: d, h, t. Rows of a block (``row``): its text in pieces (kind t, ``part`` their
    number, with the sizes, ids, held-out marks and null marks of their documents; n: training
    rows) and its words (w) and grams (g) by part. No value is large, so the JVM needs no room
    for large objects."""

    def block(row: int, batches: list[tuple]) -> pa.RecordBatch:
        data = np.concatenate([b[0] for b in batches])
        sizes, held = np.concatenate([b[1] for b in batches]), np.concatenate([b[2] for b in batches])
        offsets = np.r_[0, np.cumsum(sizes)]
        rows = [("t", k, row, int((~h).sum()), squeeze(text.tobytes()), size.tobytes(), ids, h.tobytes(), none) for k, (text, size, h, ids, none) in enumerate(batches)]
        hashes, owner = _words(data, offsets)
        for kind in ("w", "g"):
            keys, counts = distinct_counts(*((hashes[~held[owner]], hashes[held[owner]]) if kind == "w" else (all_grams(data, offsets, ~held), all_grams(data, offsets, held))))
            order, which, cut = by_part(kind, keys, parts)
            for part, a, b in zip(which.tolist(), cut[:-1], cut[1:], strict=True):
                at = order[a:b]
                rows.append((kind, part, row, len(at), pack_keys(keys[at]), pack_counts(counts[at]), None, None, None))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), BLOCK, strict=True)], schema=BLOCK)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = first = TaskContext.get().partitionId() << 33
        held: list[tuple] = []
        size = 0
        for batch in pieces_by_bytes(batches, "t", 1 << 20):
            data, offsets = string_bytes(batch.column(2))
            if held and size + len(data) > TEXT:
                yield block(first, held)
                held, size, first = [], 0, row
            ids = batch.column(0)
            held.append((LOWER[data], np.diff(offsets), batch.column(1).to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy().tobytes(), ids.is_null().to_numpy(zero_copy_only=False).tobytes()))
            size, row = size + len(data), row + batch.num_rows
        if held:
            yield block(first, held)

    return docs.select("d", "h", "t").mapInArrow(work, BLOCK_SQL)


# ---------------------------------------------------------------- the model

MERGED = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("degree", pa.int32()), ("total", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
MERGED_SQL = "kind string, part int, degree int, total bigint, n bigint, keys binary, counts binary"


def _merged(table: pa.Table, degrees: bool) -> pa.Table:
    kind, part = table.column("kind")[0].as_py(), table.column("part")[0].as_py()
    keys, counts = ppm.counted(*_together(table))
    keys, counts = keys[counts > 0], counts[counts > 0]
    rows = []
    for k in (ppm.ORDER, *range(ppm.LOW, -1, -1)) if degrees and kind == "g" else (ppm.ORDER,):
        if k < ppm.ORDER:
            keys, counts = ppm.counted(ppm.suffix(keys, k + 1), counts)
        rows.append((kind, part, k, int(counts.sum()), len(keys), pack_keys(keys), pack_counts(counts)))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), MERGED, strict=True)], schema=MERGED)


def merged_parts(rows: DataFrame) -> DataFrame:
    """One blob per part (degree ORDER): all words of training, or all grams; and, per low
    order, the grams of that order (which span parts, and are added up when used). ``rows``:
    kind, part, split, keys, counts."""
    some = rows.groupBy("kind", "part", "split").applyInArrow(lambda t: _merged(t, False), MERGED_SQL)
    return some.groupBy("kind", "part").applyInArrow(lambda t: _merged(t, True), MERGED_SQL)


def build_low(merged: DataFrame) -> str:
    """Add up the low orders in one task (at most 256**2 contexts), and put their tables into
    the shared folder, from where each worker loads them once."""
    path = f"{workspace(merged.sparkSession, 'lm-low')}/low.npz"

    def build(table: pa.Table) -> pa.Table:
        degree = table.column("degree").to_numpy()
        low = ppm.build_low({int(k): ppm.counted(*_together(table.filter(pa.array(degree == k)))) for k in np.unique(degree)})
        out = io.BytesIO()
        np.savez(out, logp=low.logp, cls=low.cls, **{f"{name}{k}": x for k, pair in enumerate(low.grams) for name, x in zip("gn", pair, strict=True)})
        put_file(path, out.getvalue())
        return pa.table({"contexts": pa.array([len(low.logp)], pa.int64())})

    rows = merged.where((F.col("kind") == "g") & (F.col("degree") <= ppm.LOW)).select("degree", "keys", "counts")
    return path if rows.groupBy(F.lit(0).alias("all")).applyInArrow(build, "contexts bigint").collect() else ""


_lows: dict[str, ppm.Low] = {}


def load_low(path: str) -> ppm.Low:
    if path not in _lows:
        _lows.clear()  # one model at a time
        if path:
            store, name = filesystem(path)
            with store.open_input_file(name) as src:
                z = np.load(io.BytesIO(src.read()))
                _lows[path] = ppm.Low([(z[f"g{k}"], z[f"n{k}"]) for k in range(ppm.LOW + 1)], z["logp"], z["cls"])
        else:
            _lows[path] = ppm.build_low({})
    return _lows[path]


# ---------------------------------------------------------------- scoring


def _looked_up(keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, counts[at], 0)


def scored(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", folds: int = 10, parts: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "lm")
    small_batches(spark)
    parts = parts or shuffle_partitions(spark)
    base = docs.select(F.col(doc_id).cast("long").alias("d"), (crc_mod(F.col(doc_id), folds) == 0).alias("h"), text_of(F.col(text)).alias("t"))
    read = scratch.table(blocks(base, parts), "blocks")
    asked = read.where("kind <> 't'").select("kind", "part", "row", "n", "keys", "counts")
    splits = asked.groupBy("kind", "part").agg(F.ceil(F.sum("n") / ASKED).alias("splits"))  # a row a part
    asked = asked.join(F.broadcast(splits), ["kind", "part"]).withColumn("split", F.pmod(F.xxhash64("row"), F.col("splits")))
    merged = scratch.table(merged_parts(asked.select("kind", "part", "split", "keys", "counts")), "merged")
    sums = {r["kind"]: r for r in merged.where(F.col("degree") == ppm.ORDER).groupBy("kind").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()}  # two rows
    ends = read.where("kind = 't'").agg(F.sum("n")).first()[0] or 0
    n_all, n_distinct = (sums["w"]["total"] + ends, sums["w"]["n"] + (ends > 0)) if "w" in sums else (ends, int(ends > 0))
    low_path = build_low(merged)
    scratch.release()
    per_token = math.log10(n_all + 0.1 * (n_distinct + 1))

    def answer(asked: pa.Table, have: pa.Table) -> pa.Table:
        """What a split of a part is asked, in the order of its keys: counts of words, or
        log10 probabilities of grams."""
        keys, counts = _together(have)  # one blob: sorted
        wanted = [unpack_keys(x) for x in asked.column("keys").to_pylist()]
        if asked.num_rows and asked.column("kind")[0].as_py() == "g":
            every = ppm.distinct(np.concatenate(wanted))
            value = ppm.answers(keys, counts, load_low(low_path), every)
            blobs = [pack_logp(value[np.searchsorted(every, w)]) for w in wanted]
        else:
            blobs = [pack_counts(_looked_up(keys, counts, w)) for w in wanted]
        return pa.table({c: asked.column(c) for c in ("kind", "part", "row")} | {"values": pa.array(blobs, pa.binary())})

    def add_up(block: pa.Table, got: pa.Table) -> pa.Table:
        """The scores of the documents of a block."""
        block = block.sort_by("part")
        one = {c: b"".join(map(expand, block.column(c).to_pylist()) if c == "keys" else block.column(c).to_pylist()) for c in ("keys", "counts", "ids", "held", "none")}
        data, sizes = np.frombuffer(one["keys"], np.uint8), np.frombuffer(one["counts"], np.int64)
        offsets, rows = np.r_[0, np.cumsum(sizes)], len(sizes)
        got = got.sort_by([("kind", "ascending"), ("part", "ascending")])
        kinds, values = got.column("kind").to_pylist(), got.column("values").to_pylist()

        def placed(kind: str, keys: np.ndarray, unpack) -> np.ndarray:
            found = [unpack(v) for k, v in zip(kinds, values, strict=True) if k == kind]
            out = np.zeros(len(keys), found[0].dtype if found else np.int64)
            out[by_part(kind, keys, parts)[0]] = np.concatenate(found) if found else 0
            return out

        hashes, owner = _words(data, offsets)
        words, inverse = np.unique(hashes, return_inverse=True)
        count = placed("w", words, unpack_counts)
        known = np.bincount(owner, (count > 0)[inverse], rows).astype(np.int64) + (ends > 0)
        total = np.bincount(owner, np.log10(count + 0.1)[inverse], rows) + math.log10(ends + 0.1)
        tokens = np.bincount(owner, minlength=rows) + 1
        del hashes, owner, inverse, words
        every = all_grams(data, offsets, np.ones(rows, bool))
        every.sort()
        every = every[np.r_[True, every[1:] != every[:-1]]]
        logp = placed("g", every, unpack_logp).astype(np.float64)
        score = np.zeros(rows)
        for a, b, grams in gram_pieces(data, offsets):
            keys, inverse = np.unique(grams, return_inverse=True)
            begin = np.r_[0, np.cumsum(sizes[a:b] + 1)[:-1]]
            score[a:b] += np.add.reduceat(logp[np.searchsorted(every, keys)][inverse], begin if b - a > 1 else begin[:1])
        ids = pa.array(np.frombuffer(one["ids"], np.int64), mask=np.frombuffer(one["none"], bool))
        columns = [ids, pa.array(np.frombuffer(one["held"], bool)), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(rows, n_all), pa.int64()), pa.array(total - tokens * per_token), pa.array(score)]
        return pa.Table.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    have = merged.where(F.col("degree") == ppm.ORDER).join(F.broadcast(splits), ["kind", "part"]).withColumn("split", F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits") - 1)))
    key = ["kind", "part", "split"]
    answers = asked.select(*key, "row", "keys").groupBy(*key).cogroup(have.select(*key, "keys", "counts").groupBy(*key)).applyInArrow(answer, "kind string, part int, row bigint, values binary")
    texts = read.where("kind = 't'").select("row", "part", "keys", "counts", "ids", "held", "none")
    return texts.groupBy("row").cogroup(answers.groupBy("row")).applyInArrow(add_up, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
