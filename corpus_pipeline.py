"""A training-corpus pipeline: quality rules, toxicity, near-dedup, mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir), works on everything that the stage before it kept,
and returns a table; ``run`` writes each to the shared folder and reads it again. All but
the last return the columns of ``documents``: the first two drop rejected documents, the
third keeps one document of each near-duplicate class, the fourth emits a document once
per copy that the mix takes of it, and the last returns what its ids and their decoding
are. Classifier and thresholds are fitted on labelled documents of the stage's own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plycraft.llm import pieces, toxicity
from plycraft.llm.common import documents, fresh, materialise, table
from plycraft.llm.mixing import mixed
from plycraft.llm.neardup import deduplicated
from plycraft.llm.quality import quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text passes the base rule and the certified cutoffs of its language.

    A null or empty text has no words and goes; a null language is one of its own; equal rows
    share a verdict; without usable labels the base rule alone decides; no rows give none."""
    rows, _, kept = quality_rules(docs, table(spark, sf_dir, "labels"), name="pipeline-quality")
    return rows.where(F.col(kept)).select(*docs.columns)


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored below 0.5 by a classifier fitted on the labels of this stage's documents.

    A null or empty text has the bias's score alone; equal texts share a score; labels of one
    class or none give that class's score (none: nothing goes); very long texts are scored
    whole, passage by passage; no rows give none."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "toxicity_score")
    return toxicity.scored(docs, model, keep=docs.columns, into=score).where(F.col(score) < 0.5).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: that with the least id.

    Texts without words are one class; of equal rows one stays; different texts without an id,
    or with the same one, are told apart by their words; no rows give none."""
    return deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row once per copy that the mix takes (none to three), so sources near their targets.

    A null source is a source of its own; texts without words count as size 0; equal rows share
    a decision; reruns agree; no rows give none."""
    return mixed(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row its id, number of ids and digests of ids and decoded text, as the library has them.

    Null and empty texts have no ids; rows are encoded one by one, repeated ones too; no rows
    give none."""
    return pieces.encoded(docs, keep=["doc_id"], finish=pieces.digests, schema="n_tokens bigint, ids_sha256 string, decoded_sha256 string")


STAGES = [("quality_rules", quality), ("toxicity", non_toxic), ("near_dedup", near_dedup), ("mixing", mix), ("sentencepiece", encode)]

#: No SQL expresses the classifier, the draws of the dedup stage or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
