"""TF-IDF over short descriptions: fitted on one part, frozen, applied elsewhere."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StringType

TOKEN = r"\b\w\w+\b"
MAX_TERMS = 512
#: Words that a worker codes at once.
PIECE = 1 << 19


def stop_words() -> list[str]:
    """Spark's English list."""
    return StopWordsRemover.loadDefaultStopWords("english")


@F.pandas_udf(StringType())
def unaccented(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Without combining marks: the compatibility decomposition leaves base letters."""
    for s in texts:
        yield s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def words_of(text: Column, *, stop: list[str] | None = None, pattern: str = TOKEN) -> Column:
    """Words of a lower-cased text, without stop words, apart by spaces; null without any.
    Terms are these words and pairs of neighbours among them, so a pattern's words hold no space."""
    words = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
    if stop:
        words = F.filter(words, lambda w: ~w.isin(stop))
    return F.nullif(F.array_join(words, " "), F.lit(""))


def _pieces(texts: pa.StringArray) -> Iterator[tuple[int, int, pa.Array, np.ndarray]]:
    """Neighbouring rows with at most ``PIECE`` words (or one row): where they begin, how many
    they are, their words, and the row of each word."""
    words = pc.split_pattern(texts, " ")
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
    ends, start = np.cumsum(sizes), 0
    while start < len(words):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] - sizes[start] + PIECE, "right")))
        yield start, stop - start, words.slice(start, stop - start).flatten(), np.repeat(np.arange(stop - start), sizes[start:stop])
        start = stop


def _totals(words: DataFrame) -> DataFrame:
    """term, total of every word in the rows of ``words``."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, values, _ in _pieces(batch.column(0)):
                yield pa.RecordBatch.from_arrays(values.value_counts().flatten(), names=["term", "total"])

    return words.mapInArrow(apply, "term string, total bigint").groupBy("term").agg(F.sum("total").alias("total"))


def _frequent(words: DataFrame, heads: list[str], tails: list[str] | None) -> DataFrame:
    """term, total, df of parts of the rows of ``words``: words among ``heads``, and pairs
    whose first word is one and whose second is among ``tails`` (all words without them)."""
    first, second = pa.array(heads, pa.string()), None if tails is None else pa.array(tails, pa.string())

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, values, row in _pieces(batch.column(0)):
                if not len(values):
                    continue
                coded = values.dictionary_encode()
                names, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
                base = len(names) + 1  # the last place stands for no second word
                may = lambda known: np.ones(len(names), bool) if known is None else pc.is_in(names, value_set=known).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                one = may(first)[code]
                two = one[:-1] & may(second)[code[1:]] & (row[:-1] == row[1:])
                key = np.concatenate([code[one] * base + base - 1, code[:-1][two] * base + code[1:][two]])
                each, tf = np.unique(np.concatenate([row[one], row[:-1][two]]) * base**2 + key, return_counts=True)
                key, at = np.unique(each % base**2, return_inverse=True)
                a, b = np.divmod(key, base)
                pair, head = b < base - 1, names.take(pa.array(a))
                term = pc.if_else(pa.array(pair), pc.binary_join_element_wise(head, names.take(pa.array(np.where(pair, b, 0))), " "), head)
                yield pa.RecordBatch.from_arrays([term, pa.array(np.bincount(at, tf).astype(np.int64)), pa.array(np.bincount(at).astype(np.int64))], names=["term", "total", "df"])

    return words.mapInArrow(apply, "term string, total bigint, df bigint").groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


def fit(docs: DataFrame, key: str, text: str, *, max_terms: int = MAX_TERMS, **how) -> DataFrame:
    """term, idx, idf: the most frequent terms (ties by term), numbered in term order; idf is
    ln((1 + n) / (1 + df)) + 1. No texts or no terms give an empty vocabulary.

    Words are counted first. A pair is no more frequent than either of its words and comes
    after its first one in term order, so only pairs that begin with one of the ``max_terms``
    first words, and end with a word as frequent as the last of these, can be among the first
    terms: the others need no counting. Many words that tie with that last one are not listed;
    then pairs may end with any word."""
    words = docs.select(words_of(F.col(text), **how).alias("words"))
    common = _totals(words).orderBy(F.col("total").desc(), "term").limit(2 * max_terms + 1).collect()
    least = min((r["total"] for r in common[:max_terms]), default=0) if len(common) >= max_terms else 0
    tails = [r["term"] for r in common if r["total"] >= least]
    counted = _frequent(words, [r["term"] for r in common[:max_terms]], tails if len(tails) <= 2 * max_terms else None)
    top = counted.orderBy(F.col("total").desc(), "term").limit(max_terms)
    n = docs.agg(F.count("*").alias("n"))
    return top.crossJoin(F.broadcast(n)).select("term", (F.row_number().over(Window.orderBy("term")) - 1).cast("int").alias("idx"), (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def _hits(rows: DataFrame, model: list[Row]) -> DataFrame:
    """``rows`` (a key and words) as the key and hits (idx, tf): how often a row has a term."""
    parts = sorted({w for r in model for w in r["term"].split(" ")})
    code, size, width = {w: i for i, w in enumerate(parts)}, len(parts), 1 + max((r["idx"] for r in model), default=0)
    alone, pairs = np.full(size + 1, -1, np.int64), {}
    for r in model:
        a, *b = (code[w] for w in r["term"].split(" "))
        if b:
            pairs[a * size + b[0]] = r["idx"]
        else:
            alone[a] = r["idx"]
    keys = np.array(sorted(pairs) or [-1], np.int64)
    names, known = [rows.columns[0], "hits"], pa.array(parts, pa.string())
    ids = np.array([pairs.get(int(k), -1) for k in keys], np.int64)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n, values, row in _pieces(batch.column(1)):
                found = pc.fill_null(pc.index_in(values, value_set=known), -1).to_numpy().astype(np.int64)
                one, near = alone[found], (found[:-1] >= 0) & (found[1:] >= 0) & (row[:-1] == row[1:])
                both = found[:-1][near] * size + found[1:][near]
                at = np.minimum(np.searchsorted(keys, both), len(keys) - 1)
                two = np.where(keys[at] == both, ids[at], -1)
                idx = np.concatenate([one, two])
                each, tf = np.unique((np.concatenate([row, row[:-1][near]]) * width + idx)[idx >= 0], return_counts=True)
                row, idx = np.divmod(each, width)
                offsets = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
                hits = pa.StructArray.from_arrays([pa.array(idx.astype(np.int32)), pa.array(tf.astype(np.int64))], ["idx", "tf"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n), pa.ListArray.from_arrays(pa.array(offsets), hits)], names=names)

    return rows.mapInArrow(apply, T.StructType([rows.schema[0], *T.StructType.fromDDL("hits array<struct<idx int, tf bigint>>")]))


def weights(docs: DataFrame, model: DataFrame, key: str, text: str, **how) -> DataFrame:
    """key, term, idx, weight: (1 + ln tf) * idf, of unit length per text. The vocabulary is
    at most ``max_terms`` rows and comes to the driver once. A text's known terms are counted
    in its row; then counts are dealt by key, and rows of one key are one text."""
    table = model.select("term", "idx", "idf")
    known = table.collect()
    frozen = docs.sparkSession.createDataFrame(known, table.schema)
    dealt = _hits(docs.select(key, words_of(F.col(text), **how).alias("words")), known).where(F.size("hits") > 0).repartition(key)
    counts = dealt.select(key, F.explode("hits").alias("h")).groupBy(key, F.col("h.idx").alias("idx")).agg(F.sum("h.tf").alias("tf"))
    hits = counts.join(F.broadcast(frozen), "idx").withColumn("raw", (1 + F.log("tf")) * F.col("idf"))
    whole = hits.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("length"), F.collect_list(F.struct("term", "idx", "raw")).alias("hits"))  # at most max_terms of a text
    return whole.select(key, "length", F.explode("hits").alias("h")).select(key, "h.term", "h.idx", (F.col("h.raw") / F.col("length")).alias("weight"))


def vectors(docs: DataFrame, model: DataFrame, key: str, text: str, **how) -> DataFrame:
    """key, vector (dense, in the model's order), available: a text without any known term
    has an empty vector and is unavailable."""
    w = weights(docs, model, key, text, **how)
    per = w.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("idx", "weight"))).alias("m"))
    size = model.agg(F.count("*").cast("int").alias("size"))
    joined = docs.select(key).join(per, key, "left").crossJoin(F.broadcast(size))
    dense = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
    return joined.select(key, F.when(F.col("m").isNotNull(), dense).otherwise(F.array().cast("array<double>")).alias("vector"), F.col("m").isNotNull().alias("available"))
