"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its byte n-grams (3 to 6, with word-boundary marks) and itself, hashed
into buckets; its vector is the mean of the buckets' embeddings, so an unseen misspelling
shares most of its vector with the word it distorts. A word of more than 48 bytes counts as
several, so text without white space is scored whole. A passage, the mean of ``window``
neighbouring word vectors (of all of a shorter text), goes through a two-class linear
softmax; embeddings and softmax are trained together. A document is scored by its most toxic
passage, of those that begin at any of its words, so a long clean text does not dilute a
short insult, wherever it stands; labels are per document, and training picks the passage
that stands for each one anew in every round.

The classifier is fitted on at most ``per_class`` labelled documents of each class, the
first by a hash of their id (documented bound); everything is scored. Only the text is an
input. Scoring is linear: each distinct word of a batch gets one scalar, once.

Defined results: null and empty texts have no passage and get the score of the bias alone;
equal texts get equal scores; without labels of both classes every score is that class's (about 0 without any); an id with
contradicting labels counts as toxic, and of several texts under one id the least is
learnt from; labels of documents that are not among ``docs`` take no part; extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, crc_mod, mix, pieces_by_bytes, small_batches, span_hashes, string_bytes, text_of, word_spans

BUCKETS, DIM, WINDOW, PER_CLASS = 1 << 17, 8, 8, 2000
GRAMS = (3, 4, 5, 6)
#: A longer word (text without white space, say) counts as consecutive words of this many bytes,
#: which overlap by one byte less than the longest n-gram, so that none is lost.
WORD_BYTES, OVERLAP = 48, max(GRAMS) - 1


@dataclass
class Model:
    theta: np.ndarray  # a bucket's contribution to the logit: embedding times the softmax's weight difference
    bias: float
    window: int = WINDOW


def word_features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket ids, word index) of the n-grams of words, sorted by word."""
    size = end - start  # at most WORD_BYTES
    n = len(start)
    own = (span_hashes(data, start, end) % np.uint64(BUCKETS)).astype(np.int64)
    # words laid out as < bytes > in one row of fixed width
    width = int(size.max()) + 2 if n else 2
    col = np.arange(width)
    at = start[:, None] + np.minimum(np.maximum(col[None, :] - 1, 0), np.maximum(size, 1)[:, None] - 1)
    grid = data[at].astype(np.uint64) + np.uint64(1)
    grid[:, 0] = 300
    grid[np.arange(n), size + 1] = 301
    ids, words = [own], [np.arange(n)]
    for g in GRAMS:
        if width < g:
            continue
        key = np.zeros((n, width - g + 1), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(g):
                key = key * np.uint64(0x100000001B3) + grid[:, j : width - g + 1 + j]
            inside = (np.arange(width - g + 1)[None, :] + g) <= (size + 2)[:, None]
            rows, _ = np.nonzero(inside)
            ids.append((mix(key[inside] + np.uint64(g)) % np.uint64(BUCKETS)).astype(np.int64))
        words.append(rows)
    ids, words = np.concatenate(ids), np.concatenate(words)
    order = np.argsort(words, kind="stable")
    return ids[order], words[order]


def segments(start: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans, with each one longer than WORD_BYTES cut into overlapping ones that cover it."""
    step = WORD_BYTES - OVERLAP
    n = np.maximum(1, -(-(end - start - OVERLAP) // step))
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(start, n) + nth * step
    return start, np.minimum(start + WORD_BYTES, np.repeat(end, n)), np.repeat(row, n)


def unique_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end of a first occurrence of each distinct word, occurrence -> word, row of each occurrence, hashes)."""
    start, end, row = segments(*word_spans(data, offsets))
    hashes = span_hashes(data, start, end)
    distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    return start[first], end[first], inverse, row, distinct


def passages(row: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of passages in the sequence of words: ``window`` words from any word on
    that has so many left in its row; a shorter row is one passage."""
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    size = np.diff(np.r_[new, len(row)])
    begin = np.flatnonzero(np.arange(len(row)) - np.repeat(new, size) <= np.repeat(np.maximum(size - window, 0), size))
    return begin, np.minimum(begin + window, (new + size)[np.searchsorted(new, begin, "right") - 1])


def over_passages(value: np.ndarray, begin: np.ndarray, end: np.ndarray, window: int, fold: np.ufunc, empty: float) -> np.ndarray:
    """``fold`` of the values in each passage, in the order of its words."""
    out = np.full(len(begin), empty)
    for k in range(window):
        inside = begin + k < end
        out[inside] = fold(out[inside], value[begin[inside] + k])
    return out


def word_scalars(theta: np.ndarray, ids: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    count = np.bincount(words, minlength=n)
    return np.bincount(words, theta[ids], minlength=n) / np.maximum(count, 1)


def seed_scores(inverse: np.ndarray, row: np.ndarray, toxic: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A first guess for each distinct word: the mean log-odds of its n-grams, counted over
    the distinct words of toxic and of other documents."""
    pairs = np.unique(row * np.int64(len(first)) + inverse)
    doc, word = pairs // len(first), pairs % len(first)
    counts = np.zeros((2, BUCKETS))
    for a in range(0, len(word), 100_000):
        some = word[a : a + 100_000]
        size = first[some + 1] - first[some]
        at = np.repeat(first[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        label = np.repeat(toxic[doc[a : a + 100_000]], size)
        for k in (0, 1):
            counts[k] += np.bincount(ids[at[label == k]], minlength=BUCKETS)
    docs = np.array([(~toxic).sum(), toxic.sum()])
    odds = np.log((counts[1] + 0.5) / (docs[1] + 1)) - np.log((counts[0] + 0.5) / (docs[0] + 1))
    return np.add.reduceat(odds[ids], first[:-1]) / np.maximum(np.diff(first), 1)


def train(texts: list[str], toxic: np.ndarray, *, seed: int = 3, rounds: int = 14, rate: float = 0.5, decay: float = 1e-4, window: int = WINDOW) -> Model:
    """Fit on whole texts. Stochastic gradient steps (Adagrad) on one passage a document
    and one more random passage of each clean document, chosen anew in each round."""
    toxic = np.asarray(toxic, bool)
    if toxic.all() or not toxic.any():
        return Model(np.zeros(BUCKETS, np.float32), -1e3 if not toxic.any() else 1e3, window)
    rng = np.random.default_rng(seed)
    data, offsets = string_bytes(pa.array(texts, pa.large_string()))
    data = LOWER[data]
    start, end, inverse, row, _ = unique_words(data, offsets)
    ids, words = [], []
    for a in range(0, len(start), 50_000):  # bounds the grid of n-grams
        i, w = word_features(data, start[a : a + 50_000], end[a : a + 50_000])
        ids.append(i.astype(np.int32))
        words.append((w + a).astype(np.int32))
    ids, words = np.concatenate(ids), np.concatenate(words)
    first = np.searchsorted(words, np.arange(len(start) + 1))
    begin, stop = passages(row, window)
    owner = row[begin]
    n_docs = len(texts)
    lo, hi = np.searchsorted(owner, np.arange(n_docs)), np.searchsorted(owner, np.arange(n_docs), "right")
    have = np.flatnonzero(hi > lo)
    emb = (rng.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32)
    w, b = (rng.standard_normal(DIM) * 0.5).astype(np.float32), np.float32(0)
    g_emb, g_w, g_b = np.full((BUCKETS, 1), 1e-3, np.float32), np.full(DIM, 1e-3, np.float32), np.float32(1e-3)
    first_guess = seed_scores(inverse, row, toxic, ids, first)[inverse]
    guess = over_passages(first_guess, begin, stop, window, np.maximum, -np.inf)

    def best_passage(z: np.ndarray) -> np.ndarray:
        order = np.lexsort((-z, owner))
        return order[np.r_[True, owner[order][1:] != owner[order][:-1]]]

    for step in range(rounds):
        any_one = lo[have] + (rng.random(len(have)) * (hi - lo)[have]).astype(np.int64)
        if step < 4:  # the model knows little yet
            top = best_passage(guess)
        else:
            z = over_passages(word_scalars(emb @ w, ids, words, len(start))[inverse], begin, stop, window, np.add, 0.0) / (stop - begin)
            top = best_passage(z)
        picked = np.r_[top, any_one[~toxic[have]]]
        rng.shuffle(picked)
        batch = min(256, max(16, len(picked) // 16))  # few documents still take enough steps
        for a in range(0, len(picked), batch):
            p = picked[a : a + batch]
            y = toxic[owner[p]].astype(np.float32)
            size = stop[p] - begin[p]
            occ = np.repeat(begin[p] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            passage = np.repeat(np.arange(len(p)), size)
            word = inverse[occ]
            count = first[word + 1] - first[word]
            at = np.repeat(first[word] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            feat = ids[at]
            share = np.repeat((1 / (count * size[passage])).astype(np.float32), count)
            of = np.repeat(passage, count)
            x = np.stack([np.bincount(of, emb[feat, d] * share, len(p)) for d in range(DIM)], 1).astype(np.float32)
            logit = x @ w + b
            weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3)).astype(np.float32)
            d = (1 / (1 + np.exp(-logit)) - y) * weight / len(p)
            grad_w, grad_b = d @ x, d.sum()
            flat = np.bincount(feat, d[of] * share, BUCKETS).astype(np.float32)  # times w: the gradient of every embedding
            hit = np.flatnonzero(flat)
            grad = flat[hit, None] * w[None, :] * len(p) + decay * emb[hit]
            g_emb[hit] += (grad**2).mean(1, keepdims=True)
            emb[hit] -= rate * grad / np.sqrt(g_emb[hit])
            g_w += grad_w**2
            w -= 0.1 * grad_w / np.sqrt(g_w)
            g_b += grad_b**2
            b -= np.float32(0.1) * grad_b / np.sqrt(g_b)
    return Model((emb @ w).astype(np.float32), float(b), window)


def score_batch(model: Model, column: pa.Array) -> np.ndarray:
    """The highest passage probability of each text."""
    data, offsets = string_bytes(column)
    best = np.full(len(offsets) - 1, model.bias)
    if len(data):
        data = LOWER[data]
        start, end, inverse, row, _ = unique_words(data, offsets)
        if len(row):
            scalar = np.empty(len(start))
            for a in range(0, len(start), 20_000):
                ids, words = word_features(data, start[a : a + 20_000], end[a : a + 20_000])
                scalar[a : a + 20_000] = word_scalars(model.theta, ids, words, len(start[a : a + 20_000]))
            begin, end = passages(row, model.window)
            z = over_passages(scalar[inverse], begin, end, model.window, np.add, 0.0) / (end - begin) + model.bias
            top = np.full(len(best), -np.inf)
            np.maximum.at(top, row[begin], z)
            best = np.where(np.isfinite(top), top, best)
    return 1 / (1 + np.exp(-np.clip(best, -60, 60)))


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", per_class: int = PER_CLASS, folds: int = 5, **how) -> Model:
    """Fit on labelled documents outside the held-out fold. The ids come first, from the
    narrow tables of labels and of the documents' ids; their texts (at most 2 * per_class) meet in one task, which trains."""
    y = labels.where(F.col("toxic").isNotNull() & (crc_mod(F.col(doc_id), folds) != 0)).groupBy(F.col(doc_id).alias("_id")).agg(F.max("toxic").alias("_y"))
    y = y.join(docs.select(F.col(doc_id).alias("_here")), F.col("_id") == F.col("_here"), "left_semi")
    order = F.xxhash64(F.lit(11), F.col("_id"))
    some = y.where("_y = 1").orderBy(order, "_id").limit(per_class).unionByName(y.where("_y = 0").orderBy(order, "_id").limit(per_class))
    rows = docs.select(F.col(doc_id).alias("_d"), text_of(F.col(text)).alias("_t")).join(F.broadcast(some), F.col("_d") == F.col("_id")).groupBy("_d").agg(F.min("_t").alias("_t"), F.max("_y").alias("_y"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_d")
        model = train(pdf["_t"].tolist(), pdf["_y"].to_numpy() == 1, **how)
        return pd.DataFrame({"theta": [model.theta.astype(np.float32).tobytes()], "bias": [model.bias]})

    got = rows.groupBy(F.lit(0).alias("_all")).applyInPandas(one, "theta binary, bias double").collect()  # one row of fixed size
    if not got:
        return Model(np.zeros(BUCKETS, np.float32), -1e3)
    return Model(np.frombuffer(got[0]["theta"], np.float32), got[0]["bias"], how.get("window", WINDOW))


def scored(docs: DataFrame, model: Model, *, keep: list[str], text: str = "text", into: str = "score") -> DataFrame:
    """``keep`` columns plus the score. The model is a fixed number of buckets (0.5 MB)."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], text_of(F.col(text)).alias("t"))
    kinds = ", ".join(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(source.schema.fields[:-1]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces_by_bytes(batches, "t", 2 << 20):
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(score_batch(shipped.value, part.column(len(keep))))], names=[*part.schema.names[: len(keep)], "s"])

    return source.mapInArrow(work, f"{kinds}, s double").toDF(*keep, into)
