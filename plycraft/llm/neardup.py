"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded,
verified by weighted Jaccard similarity.

Texts with equal words (A-Z lower-cased) are copies; one of each, the least id, stands for
them. A text's features are its five-word shingles (its words as one, if fewer), weighted
by count times inverse document frequency, 1 + ``gain`` * ln(N / df) / ln N. Frequencies
come from all texts, through a two-row count sketch of fixed size.

ICWS draws a shingle and a level with probability in proportion to its weight, so two
texts draw the same with the probability of their weighted Jaccard similarity. Draws are
binned: a round deals shingles to 16 bins by hash and draws once in each bin (an empty bin
takes another's draw in a fixed order); six rounds give 96 draws, 24 bands of 4. At
similarity 0.8 a pair shares no band with probability about 3e-6.

Every pair of texts that shares a band is verified exactly or is in one class already; no
pair is judged by its draws. Texts are first compared with one other each, the most central
member of their buckets (whose own buckets are the fullest: an original rather than one of
its copies), and verified links are contracted to components. What is left are pairs of
*different* components in a bucket. Buckets of the same members count once. In a bucket, the
members of its largest component are the major side, all others the minor side; only minor
members are compared with anything, in groups of at most ``block`` of either side, so a
group is bounded whatever the bucket's size, and texts that are all in one component are not
copied for it. A group is a run of sorted rows in a task; a text's features cross the
shuffle once for each group that it is in, and only links leave the task.

Defined results: null and empty texts, and texts of white space only, have no words and
form one class; equal rows are copies; a null id counts as the smallest long; of different
texts with the same (or no) id one goes by the id, the others by a number of 2**62 or more
from the hash of their words, so each is compared, classed and kept by itself; very long
texts are used whole; an empty table stays empty; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, Scratch, fresh, materialise, mix, pieces_by_bytes, small_batches, span_hashes, string_bytes, text_of, word_spans
from .components import stars

WORDS, THRESHOLD, IDF_GAIN = 5, 0.8, 0.1
ROUNDS, BINS, BAND = 6, 16, 4
SKETCH_ROWS, SKETCH = 2, 1 << 18
CHUNKS, SPREAD = 64, 1024
#: Bits of the filter of candidate ids (2 MB): a fuller one lets more texts through, no fewer.
FILTER_BITS = 1 << 24
NULL_ID = -(1 << 63)
#: Texts that one side of a group holds.
BLOCK = 256
_FEATURE = np.uint64((1 << 50) - 1)
#: For an empty bin, the order in which the others are asked.
_ASK = np.stack([np.r_[b, np.random.Generator(np.random.PCG64(b)).permutation(np.delete(np.arange(BINS), b))] for b in range(BINS)])


# ---------------------------------------------------------------- features


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, count) of distinct shingles, sorted by row and feature, and a 128-bit
    key of each row's words."""
    rows = len(offsets) - 1
    data = LOWER[data]
    start, end, row = word_spans(data, offsets)
    h = span_hashes(data, start, end)
    n = len(h)
    first = np.searchsorted(row, np.arange(rows + 1))
    count = np.diff(first)
    place = (np.arange(n) - first[row]).astype(np.uint64)
    key = np.zeros((rows, 2), np.uint64)
    have = np.flatnonzero(count)
    with np.errstate(over="ignore"):
        if n:
            for k, salt in enumerate((0x2545F4914F6CDD1D, 0x9E6C63D0876A9A99)):
                key[have, k] = np.add.reduceat(mix(h + place * np.uint64(salt)), first[have])
        key[have, 0] += count[have].astype(np.uint64)
        long = count >= WORDS
        ok = np.flatnonzero(long[row] & (np.arange(n) + WORDS <= first[row + 1])) if n else np.zeros(0, np.int64)
        s = np.zeros(len(ok), np.uint64)
        for j in range(WORDS):
            s = s * np.uint64(0xD6E8FEB86659FD93) + h[ok + j]
        short = np.flatnonzero((count > 0) & ~long)
        s = np.concatenate([mix(s), key[short, 0]])
        owner = np.concatenate([row[ok], short]).astype(np.uint64)
    packed = np.sort((owner << np.uint64(50)) | (s >> np.uint64(14)))
    at = np.flatnonzero(np.r_[True, packed[1:] != packed[:-1]]) if len(packed) else np.zeros(0, np.int64)
    tf = np.diff(np.r_[at, len(packed)])
    packed = packed[at]
    return (packed >> np.uint64(50)).astype(np.int64), packed & _FEATURE, tf, key


def short(feature: np.ndarray) -> np.ndarray:
    """The leading 32 bits of features: what verification compares, sorted as they are."""
    return (feature >> np.uint64(18)).astype(np.uint32)


def _cells(feature: np.ndarray) -> list[np.ndarray]:
    """The sketch's cells of short features."""
    a = mix(feature.astype(np.uint64) + np.uint64(101))
    return [(a & np.uint64(SKETCH - 1)).astype(np.int64), ((a >> np.uint64(32)) & np.uint64(SKETCH - 1)).astype(np.int64)]


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """The sketch (fixed size) and the number of texts with words. Tasks' sketches are added
    up in pieces, in two steps, so that no group grows with the number of tasks squared."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, n = np.zeros((SKETCH_ROWS, SKETCH), np.int64), 0
        for batch in pieces_by_bytes(batches, "t"):
            row, feature, _, _ = features(*string_bytes(batch.column(0)))
            n += len(np.unique(row))
            for r, cell in enumerate(_cells(short(feature))):
                sketch[r] += np.bincount(cell, minlength=SKETCH)
        if n:
            parts = sketch.reshape(CHUNKS, -1)
            spread = TaskContext.get().partitionId() % SPREAD
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CHUNKS, dtype=np.int32)), pa.array([spread] * CHUNKS, pa.int32()), pa.array([n] + [0] * (CHUNKS - 1), pa.int64()), pa.array([x.astype(np.int32).tobytes() for x in parts], pa.binary())], names=["chunk", "spread", "n", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = np.int32 if len(pdf["counts"].iloc[0]) == SKETCH_ROWS * SKETCH // CHUNKS * 4 else np.int64
        total = np.zeros(SKETCH_ROWS * SKETCH // CHUNKS, np.int64)
        for x in pdf["counts"]:
            total += np.frombuffer(x, kind)
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "spread": [pdf["spread"].iloc[0]], "n": [pdf["n"].sum()], "counts": [total.tobytes()]})

    shape = "chunk int, spread int, n bigint, counts binary"
    got = texts.select("t").mapInArrow(work, shape).groupBy("chunk", "spread").applyInPandas(add, shape).groupBy("chunk").applyInPandas(add, shape).toPandas()  # 64 rows of fixed size
    if not len(got):
        return np.zeros((SKETCH_ROWS, SKETCH), np.int64), 0
    return np.frombuffer(b"".join(got.sort_values("chunk")["counts"]), np.int64).reshape(SKETCH_ROWS, SKETCH), int(got["n"].sum())


def narrow(sketch: np.ndarray) -> np.ndarray:
    """The sketch to ship: four bytes a count if they hold it."""
    return sketch.astype(np.uint32 if sketch.max(initial=0) < 1 << 32 else np.int64)


def weights(feature: np.ndarray, tf: np.ndarray, sketch: np.ndarray, n: int, gain: float) -> np.ndarray:
    """Count times inverse document frequency of short features."""
    df = np.minimum.reduce([sketch[r][cell] for r, cell in enumerate(_cells(feature))])
    top = np.log(max(n, 2))
    return tf * (1 + gain * np.clip(1 - np.log(np.maximum(df, 1)) / top, 0, 1))


# ---------------------------------------------------------------- signatures


def draws(row: np.ndarray, feature: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """ICWS draws, (rows, ROUNDS * BINS). For a shingle of weight w with r, c ~ Gamma(2, 1)
    and b ~ U(0, 1) from its hash: t = floor(ln w / r + b); the bin's draw is the (shingle, t)
    with the least ln c - r (t - b) - r."""
    out = np.zeros((rows, ROUNDS * BINS), np.uint64)
    log_w = np.log(weight)
    unit = lambda x, bits: ((x & np.uint64((1 << bits) - 1)).astype(np.float64) + 0.5) / (1 << bits)
    for k in range(ROUNDS):
        h = mix(feature + np.uint64(0xA24BAED4963EE407 * (k + 1) % (1 << 64)))
        g = mix(h)
        cell = row * BINS + (h & np.uint64(BINS - 1)).astype(np.int64)
        r = -np.log(unit(h >> np.uint64(4), 30) * unit(h >> np.uint64(34), 30))
        c = -np.log(unit(g, 21) * unit(g >> np.uint64(21), 21))
        b = unit(g >> np.uint64(42), 21)
        t = np.floor(log_w / r + b)
        a = np.log(c) - r * (t - b) - r
        least = np.full(rows * BINS, np.inf)
        np.minimum.at(least, cell, a)
        hit = a == least[cell]
        token = np.zeros(rows * BINS, np.uint64)
        with np.errstate(over="ignore"):
            token[cell[hit]] = mix(h[hit] ^ (t[hit].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        token, empty = token.reshape(rows, BINS), ~np.isfinite(least).reshape(rows, BINS)
        filled = token.copy()
        need = empty.copy()
        for j in range(1, BINS):
            if not need.any():
                break
            source = _ASK[:, j]
            take = need & ~empty[:, source]
            filled = np.where(take, token[:, source], filled)
            need &= ~take
        out[:, k * BINS : (k + 1) * BINS] = filled
    return out


def bands(drawn: np.ndarray) -> np.ndarray:
    """A hash per band of BAND draws, different for each band's number."""
    groups = drawn.reshape(len(drawn), -1, BAND)
    with np.errstate(over="ignore"):
        h = np.broadcast_to(np.arange(1, groups.shape[1] + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), groups.shape[:2]).copy()
        for j in range(BAND):
            h = mix(h ^ groups[:, :, j])
    return h.view(np.int64)


def _key_columns(key: np.ndarray) -> list[pa.Array]:
    return [pa.array(key[:, k].copy().view(np.int64)) for k in (0, 1)]


def signatures(texts: DataFrame, shipped) -> DataFrame:
    """doc_id, k1, k2 (key of the words), bands (null without words). ``shipped``: the
    broadcast sketch, number of texts and gain."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_by_bytes(batches, "t"):
            row, feature, tf, key = features(*string_bytes(batch.column(1)))
            rows = batch.num_rows
            h = bands(draws(row, feature, weights(short(feature), tf, *shipped.value), rows))
            none = np.bincount(row, minlength=rows) == 0
            lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * h.shape[1]), pa.array(h.reshape(-1)), mask=pa.array(none))
            yield pa.RecordBatch.from_arrays([batch.column(0), *_key_columns(key), lists], names=["doc_id", "k1", "k2", "bands"])

    return texts.select("d", "t").mapInArrow(work, "doc_id bigint, k1 bigint, k2 bigint, bands array<bigint>")


def _filter_places(column: str) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(k), F.col(column)), F.lit(FILTER_BITS)) for k in (1, 2)]


def id_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter (fixed size) of the ids in column ``id``: their distinct places are
    found by Spark, and set in 64 pieces."""
    size = FILTER_BITS // CHUNKS

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(size, np.uint8)
        bits[pdf["place"].to_numpy() % size] = 1
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "bits": [np.packbits(bits).tobytes()]})

    places = ids.select(F.explode(F.array(*_filter_places("id"))).alias("place")).distinct().withColumn("chunk", F.floor(F.col("place") / size).cast("int"))
    out = np.zeros((CHUNKS, size // 8), np.uint8)
    for r in places.groupBy("chunk").applyInPandas(fill, "chunk int, bits binary").collect():  # at most 64 rows
        out[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def packed_features(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """id, k1, k2, f (sorted short features) and x (place and count of those that occur more
    than once) of the candidates, and of a few other texts that the filter lets through.
    Texts stay where they are read; no shuffle carries them. Weights are not sent: whoever
    has the sketch can tell them."""
    shipped = texts.sparkSession.sparkContext.broadcast(id_filter(ids.select("id")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shipped.value
        for batch in pieces_by_bytes(batches, "t"):
            places = [batch.column(i).to_numpy() for i in (2, 3)]
            hit = np.logical_and.reduce([(bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 > 0 for p in places])
            batch = batch.filter(pa.array(hit))
            if not batch.num_rows:
                continue
            row, feature, tf, key = features(*string_bytes(batch.column(1)))
            f, cut = short(feature), np.searchsorted(row, np.arange(batch.num_rows + 1))
            many = np.flatnonzero(tf > 1)
            again = np.stack([many - cut[row[many]], tf[many]], 1).astype(np.uint32)
            edge = np.searchsorted(row[many], np.arange(batch.num_rows + 1))
            blobs = [pa.array([values[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary()) for values, at in ((f, cut), (again, edge))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *_key_columns(key), *blobs], names=["id", "k1", "k2", "f", "x"])

    one, two = _filter_places("d")
    return texts.select("d", "t", one.alias("p1"), two.alias("p2")).mapInArrow(work, "id bigint, k1 bigint, k2 bigint, f binary, x binary")


# ---------------------------------------------------------------- verification


def unpacked(f: pa.Array, x: pa.Array, order: np.ndarray, sketch: np.ndarray, n: int, gain: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, weights, offsets) of the rows ``order`` of packed features."""
    fs, xs = f.take(pa.array(order)), x.take(pa.array(order))
    (flat, cut), (more, edge) = string_bytes(fs), string_bytes(xs)
    feature, cut = np.frombuffer(flat.tobytes(), np.uint32), cut // 4
    tf = np.ones(len(feature), np.int64)
    if len(more):
        place = np.frombuffer(more.tobytes(), np.uint32).reshape(-1, 2).astype(np.int64)
        tf[place[:, 0] + np.repeat(cut[:-1], np.diff(edge // 8))] = place[:, 1]
    return feature, weights(feature, tf, sketch, n, gain), cut


class Group:
    """The texts of a group, those of side 0 first: which pairs are similar enough."""

    def __init__(self, feature: np.ndarray, weight: np.ndarray, cut: np.ndarray, threshold: float, left: int):
        self.weight, self.cut, self.threshold = weight, cut, threshold
        self.total = np.add.reduceat(weight, cut[:-1])
        self.feature, self.dense = feature, left > 2
        if self.dense:
            distinct, self.feature = np.unique(feature, return_inverse=True)
            self.mine = np.zeros(len(distinct))

    def shared(self, a: int, start: int, stop: int) -> np.ndarray:
        """Sums of minima of text a with each of the texts start to stop."""
        s = slice(self.cut[a], self.cut[a + 1])
        t = slice(self.cut[start], self.cut[stop])
        if self.dense:
            self.mine[self.feature[s]] = self.weight[s]
            low = np.minimum(self.mine[self.feature[t]], self.weight[t])
            self.mine[self.feature[s]] = 0
        else:
            own = self.feature[s]
            at = np.minimum(np.searchsorted(own, self.feature[t]), len(own) - 1)
            low = np.where(own[at] == self.feature[t], np.minimum(self.weight[s][at], self.weight[t]), 0)
        return np.add.reduceat(low, self.cut[start:stop] - self.cut[start])

    def similar(self, a: int, start: int, stop: int, wanted: np.ndarray) -> np.ndarray:
        """Which texts from start to stop, among the ``wanted``, are similar enough to text
        a. A sum of minima is at most the lesser total, so most need no look at features."""
        total = self.total[start:stop]
        near = wanted & (np.minimum(total, self.total[a]) >= self.threshold * np.maximum(total, self.total[a]))
        some = np.flatnonzero(near)
        if not len(some):
            return some
        first, last = start + int(some[0]), start + int(some[-1]) + 1
        if 4 * len(some) >= last - first:
            low = self.shared(a, first, last)[some - some[0]]
        else:
            low = np.concatenate([self.shared(a, start + int(b), start + int(b) + 1) for b in some])
        return start + some[low >= self.threshold * (total[some] + self.total[a] - low)]


def runs_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows with equal values in the first ``keys`` columns (longs)."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(keys)], 1)
        cuts = np.r_[0, np.flatnonzero((columns[1:] != columns[:-1]).any(1)) + 1, len(columns)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            key = columns[a].tolist()
            if held and key != last:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.concat_batches(held)


def links(rows: DataFrame, shipped, threshold: float) -> DataFrame:
    """(u, v): the similar pairs of different components in groups. ``rows``: key, i, j (the
    group), side, rep, comp, f, x. Side 0 is compared with side 1 and, in groups with i >= 0
    and j = 0, with itself."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u: list[np.ndarray] = []
        v: list[np.ndarray] = []
        for group in runs_of(batches, 3):
            side = group.column(3).to_numpy()
            order = np.argsort(side, kind="stable")
            rep, comp = group.column(4).to_numpy()[order], group.column(5).to_numpy()[order]
            left, every = int((side == 0).sum()), len(order)
            within = group.column(1)[0].as_py() >= 0 and group.column(2)[0].as_py() == 0
            g = Group(*unpacked(group.column(6), group.column(7), order, *shipped.value), threshold, left)
            for a in range(left):
                start = a + 1 if within else left
                if start < every:
                    found = g.similar(a, start, every, comp[start:] != comp[a])
                    u.append(np.full(len(found), rep[a]))
                    v.append(rep[found])
            if len(u) > 5000:
                yield _pairs(u, v)
                u, v = [], []
        yield _pairs(u, v)

    dealt = rows.select(*[F.col(c).cast("long").alias(c) for c in ("key", "i", "j")], F.col("side").cast("int").alias("side"), "rep", "comp", "f", "x")
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(work, "u bigint, v bigint")


def _pairs(u: list[np.ndarray], v: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (u, v)], names=["u", "v"])


# ---------------------------------------------------------------- classes


def classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, gain: float = IDF_GAIN, block: int = BLOCK) -> DataFrame:
    """doc_id, copy_of (the least id with equal words) and class_id (the least id of the
    class), for every row."""
    return keyed_classes(docs, doc_id=doc_id, text=text, threshold=threshold, gain=gain, block=block).select("doc_id", "copy_of", "class_id")


def _nodes(texts: DataFrame) -> DataFrame:
    """``texts`` (k1, k2, least, ...) with ``rep``, a number for each text: its least id or, if
    another text has that one too, one from its key."""
    clash = texts.groupBy("least").agg(F.count("*").alias("_n"), F.min(F.struct("k1", "k2")).alias("_own")).where("_n > 1").select("least", "_own")
    other = F.xxhash64("k1", "k2").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    return texts.join(clash, "least", "left").withColumn("rep", F.when(F.col("_own") != F.struct("k1", "k2"), other).otherwise(F.col("least"))).drop("_own")


def keyed_classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, gain: float = IDF_GAIN, block: int = BLOCK) -> DataFrame:
    """doc_id, k1, k2 (key of the words), rep (the text's number), copy_of, class_id. Only
    this result stays in the shared folder."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "near")
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("d"), text_of(F.col(text)).alias("t"))
    sketch, n = document_frequencies(texts)
    shipped = spark.sparkContext.broadcast((narrow(sketch), n, gain))
    signed = scratch.table(signatures(texts, shipped), "signed")
    least = signed.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"))
    reps = scratch.table(_nodes(least), "reps")
    placed = reps.where("bands is not null").select("rep", F.posexplode("bands").alias("band", "key"))
    # buckets of one text are dropped before anything is joined
    shared = placed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    full = placed.join(shared, "key")
    central = full.groupBy("rep").agg(F.sum("n").alias("degree"))
    members = scratch.table(full.select("key", "band", "rep").join(central, "rep"), "members")

    # 1. every text against the most central member of its buckets
    first = members.groupBy("key").agg(F.max(F.struct("degree", "rep")).alias("hub"))
    hubs = members.join(first, "key").groupBy("rep").agg(F.max("hub").alias("h")).select("rep", F.col("h.rep").alias("hub")).where("rep <> hub")
    parts = hubs.groupBy("hub").agg(F.ceil(F.count("*") / block).alias("parts"))
    hubs = scratch.table(hubs.join(parts, "hub").select("rep", "hub", F.pmod(F.xxhash64("rep"), F.col("parts")).alias("part")), "hubs")
    ids = reps.select("rep", "k1", "k2", F.col("least").alias("id")).join(members.select("rep").distinct(), "rep", "left_semi").join(hubs, "rep", "left").join(hubs.select(F.col("hub").alias("rep"), F.lit(True).alias("is_hub")).distinct(), "rep", "left")
    ids = scratch.table(ids, "ids")
    feats = scratch.table(packed_features(texts, ids).join(ids, ["id", "k1", "k2"]).dropDuplicates(["id", "k1", "k2"]).select("rep", "hub", "part", "is_hub", "f", "x"), "feats")
    alone = lambda rows, side: rows.select(F.col("hub").alias("key"), F.lit(0).alias("i"), F.col("part").alias("j"), F.lit(side).alias("side"), "rep", F.col("rep").alias("comp"), "f", "x")
    asking = feats.where("is_hub").select("rep", "f", "x").join(hubs.select("hub", "part").distinct(), F.col("rep") == F.col("hub"))
    label = stars(links(alone(asking, 0).unionByName(alone(feats.where("hub is not null"), 1)), shipped, threshold), scratch)  # (u, v): u belongs to v's class
    # 2. buckets that still hold more than one class
    rest = scratch.table(mixed_buckets(_in_class(members.select("key", "band", "rep"), label, "rep", "comp"), block), "rest")
    label = stars(links(rest.join(feats.select("rep", "f", "x"), "rep"), shipped, threshold).unionByName(label), scratch, "classes")

    copies = signed.select("doc_id", "k1", "k2").join(reps.select("k1", "k2", "rep", F.col("least").alias("copy_of")), ["k1", "k2"])
    done = scratch.table(_in_class(copies, label, "rep", "class_id").select("doc_id", "k1", "k2", "rep", "copy_of", "class_id"), "done")
    scratch.drop("signed", "reps", "members", "hubs", "ids", "feats", "edges", "rest", "classes")
    return done


def _in_class(rows: DataFrame, label: DataFrame, node: str, into: str) -> DataFrame:
    """``rows`` with the class of a node so far."""
    return rows.join(label.select(F.col("u").alias(node), F.col("v").alias("_class")), node, "left").withColumn(into, F.coalesce("_class", node)).drop("_class")


def mixed_buckets(named: DataFrame, block: int) -> DataFrame:
    """key, i, j, side, rep, comp: the groups in which buckets of several components are
    compared. ``named``: key, band, rep, comp.

    Of buckets with the same members the one of the lowest band stands for all. Members of
    the largest component (major, D of them) and the others (minor, M) are dealt into blocks
    by hash: group (i, j) has minor block i and major block j, a group with negative i two
    minor blocks. So a row is repeated once per block of the other side."""
    per = named.groupBy("key", "band", "comp").agg(F.count("*").alias("m"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("mark"))
    bucket = per.groupBy("key", "band").agg(F.sum("m").alias("m"), F.sum("mark").alias("mark"), F.max(F.struct("m", "comp")).alias("most"), F.count("*").alias("comps")).where("comps > 1")
    kept = bucket.groupBy("m", "mark").agg(F.min(F.struct("band", "key", "most")).alias("b")).select(F.col("b.key").alias("key"), F.col("b.most.comp").alias("major"), F.ceil((F.col("m") - F.col("b.most.m")) / block).alias("minors"), F.ceil(F.col("b.most.m") / block).alias("majors"))
    rows = named.select("key", "rep", "comp").join(kept, "key")
    large = F.col("comp") == F.col("major")
    here = F.pmod(F.xxhash64("rep"), F.when(large, F.col("majors")).otherwise(F.col("minors")))
    spot = lambda i, j, side: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), F.lit(side).alias("side") if isinstance(side, int) else side.alias("side"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    with_majors = F.transform(upto(F.col("majors")), lambda j: spot(F.col("here"), j, 0))
    others = F.filter(upto(F.col("minors")), lambda o: o != F.col("here"))
    with_minors = F.transform(others, lambda o: spot(-1 - F.least(F.col("here"), o), F.greatest(F.col("here"), o), (o < F.col("here")).cast("int")))
    spots = F.when(large, F.transform(upto(F.col("minors")), lambda i: spot(i, F.col("here"), 1))).otherwise(F.concat(with_majors, with_minors))
    return rows.withColumn("here", here).select("key", "rep", "comp", F.explode(spots).alias("at")).select("key", "at.i", "at.j", "at.side", "rep", "comp")


def split_by_filter(docs: DataFrame, node: Column, doubtful: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose id is surely not in ``doubtful.id``, the others), without moving a row:
    the ids' places in a table of FILTER_BITS bits (at most 262,144 words of 64) are
    broadcast. A fuller table only makes more rows others."""
    place = F.pmod(F.xxhash64(F.lit(3), F.col("id")), F.lit(FILTER_BITS))
    words = doubtful.select(F.shiftright(place, 6).alias("word"), F.pmod(place, F.lit(64)).cast("int").alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    b, p = fresh(docs, "_bits"), fresh(docs, "_place")
    words = F.broadcast(words.select(F.struct("word", "bits").alias(b)))
    placed = docs.withColumn(p, F.pmod(F.xxhash64(F.lit(3), node), F.lit(FILTER_BITS)))
    seen = placed.join(words, F.shiftright(F.col(p), 6) == F.col(f"{b}.word"), "left")
    hit = F.coalesce(F.getbit(F.col(f"{b}.bits"), F.pmod(F.col(p), F.lit(64)).cast("int")) == 1, F.lit(False))
    return seen.where(~hit).select(*docs.columns), seen.where(hit).select(*docs.columns)


def deduplicated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row of each class: the one with the least id. Where several rows have an id, the
    key of their words tells which of them it is.

    Only rows that may go, and those whose id several rows have, are joined with decisions;
    the others are read and passed on where they are."""
    found = keyed_classes(docs, doc_id=doc_id, text=text, **how)
    stays = (F.col("rep") == F.col("class_id")) & (F.col("doc_id") == F.col("copy_of"))
    ids = materialise(found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(stays).alias("stays")).where("n > 1 or not stays"), "near-doubtful")
    node = F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID))
    sure, others = split_by_filter(docs, node, ids.select(F.col("doc_id").alias("id")))
    # an id that one row has: that row goes
    single = others.join(ids.select(F.col("doc_id").alias("_gone")), node == F.col("_gone"), "left_anti")
    again = ids.where("n > 1 and stays").select(F.col("doc_id").alias("_again"))
    if again.isEmpty():
        return sure.unionByName(single)
    d, k1, k2 = (fresh(docs, name) for name in ("_d", "_k1", "_k2"))
    stay = found.where(stays).select("doc_id", "k1", "k2").distinct()
    twice = with_keys(others.join(again, node == F.col("_again"), "left_semi").withColumn(d, node), text, k1, k2)
    one = twice.join(stay, (F.col(d) == stay["doc_id"]) & (F.col(k1) == stay["k1"]) & (F.col(k2) == stay["k2"]), "left_semi").dropDuplicates([d, k1, k2])
    return sure.unionByName(single).unionByName(one.select(*docs.columns))


def with_keys(rows: DataFrame, text: str, k1: str, k2: str) -> DataFrame:
    """``rows`` and the 128-bit key of the words of each."""
    t = fresh(rows, "_t")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_by_bytes(batches, t):
            key = features(*string_bytes(batch.column(batch.num_columns - 1)))[3]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *_key_columns(key)], names=[*batch.schema.names[:-1], k1, k2])

    kinds = T.StructType([*rows.schema.fields, T.StructField(k1, T.LongType()), T.StructField(k2, T.LongType())])
    return rows.withColumn(t, text_of(F.col(text))).mapInArrow(work, kinds)
