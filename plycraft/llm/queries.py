"""The thin queries: each applies its operator to its whole table and returns digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, documents, table, workspace
from . import lm, media, pieces, quality, tokens, toxicity, warc
from .mixing import mix_plan
from .neardup import classes
from .quality import quality_rules
from .sharding import ShardStore


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, m, kept = quality_rules(documents(spark, sf_dir), table(spark, sf_dir, "labels"), columns=["doc_id", "lang"], name="op8")
    return rows.select("doc_id", *[F.col(f"{m}.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")], F.col(kept).alias("kept"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(documents(spark, sf_dir))
    per_row = plan.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return per_row.select("doc_id", "size", "source_size", "target", (F.size("shards") * F.col("size")).cast("long").alias("taken"))


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir)).withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(documents(spark, sf_dir))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))[2].select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, files = tokens.token_files(documents(spark, sf_dir))
    return tokens.read_docs(spark, folder, files)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(documents(spark, sf_dir)).drop("tile")


#: The documents arrive in so many parts.
ARRIVALS = 3


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per id, from the live shards after all arrivals and compaction: its rows, the
    characters of their texts, and whether one shard holds them all."""
    docs = documents(spark, sf_dir)
    store = ShardStore(spark, workspace(spark, "shards"))
    for k in range(ARRIVALS):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)) == k))
    store.compact_fully()
    rows = store.located("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("stored_rows"), F.sum("chars").alias("text_chars"), (F.min("shard") == F.max("shard")).alias("one_shard"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.scored(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(documents(spark, sf_dir), keep=["doc_id"], finish=pieces.digests, schema="n_tokens bigint, ids_sha256 string, decoded_sha256 string")


QUERIES = {f.__name__: f for f in (op1_neardup, op2_ppm, op3_warc, op4_token_ids, op5_mixing, op6_media, op7_sharding, op8_quality_rules, op9_toxicity, op10_sentencepiece)}

def _quality_sql() -> str:
    """The base measures by lists and windows, the thresholds by log-gamma binomial sums."""
    ink = "[^\\x20\\x09-\\x0D]"
    grid = ", ".join(f"('{r}', {float(c)!r}::DOUBLE)" for r in quality.RULES for c in quality.GRID[r])
    over = " OR ".join(f"{r} > coalesce(c_{r}, 1e300)" for r in quality.RULES)
    cuts = ", ".join(f"max(CASE WHEN rule = '{r}' THEN cutoff END) AS c_{r}" for r in quality.RULES)
    values = ", ".join(f"{{'rule': '{r}', 'v': {r}}}" for r in quality.RULES)
    alpha, level = quality.RISK / len(quality.RULES), f"{quality.DELTA} / ((SELECT greatest(count(*), 1) FROM counted) * {len(quality.RULES)})"
    return f"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, lang, coalesce(text, '') AS x FROM documents),
w AS (SELECT k, doc_id, lang, x, regexp_extract_all(x, '{ink}+') AS w, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '{ink}')) AS lines FROM t),
g AS (SELECT k, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 3),
c AS (SELECT k, i, count(*) OVER (PARTITION BY k, s) AS n FROM g),
rep AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM c WHERE n > 1) GROUP BY k),
b AS (SELECT w.k, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(x, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(x) - length(translate(x, '{quality.SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(length(x) - length(translate(x, '!?', '')) AS BIGINT) AS shouts, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN rep ON w.k = rep.k),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(CAST(n_symbols AS DOUBLE) / nullif(word_chars, 0), 0) AS symbol_ratio, coalesce(CAST(shouts AS DOUBLE) / nullif(word_chars, 0), 0) AS shout_ratio, coalesce(CAST(n_dup_lines AS DOUBLE) / nullif(n_lines, 0), 0) AS dup_line_ratio, coalesce(CAST(n_repeat_words AS DOUBLE) / nullif(n_words, 0), 0) AS repeat_ratio, coalesce(CAST(word_chars AS DOUBLE) / nullif(n_words, 0), 0) AS mean_word FROM b),
y AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
held AS (SELECT m.*, good FROM m JOIN y USING (doc_id) WHERE NOT base_failed),
counted AS (SELECT lang, count(*) FILTER (good = 1) AS n_good, count(*) FILTER (good = 0) AS n_bad FROM held GROUP BY lang),
steps AS (SELECT lang, n_good, unnest(range(0, CAST(ceil(n_good * {alpha}) AS BIGINT) + 1)) AS j FROM counted),
cdf AS (SELECT lang, j, sum(exp(lgamma(n_good + 1) - lgamma(j + 1) - lgamma(n_good - j + 1) + j * ln({alpha}) + (n_good - j) * ln(1 - {alpha}))) OVER (PARTITION BY lang ORDER BY j) AS p FROM steps),
allow AS (SELECT lang, coalesce(max(CASE WHEN p <= {level} THEN j END), -1) AS allowed FROM cdf GROUP BY lang),
long AS (SELECT lang, good, unnest([{values}]) AS u FROM held),
cells AS (SELECT long.lang, grid.rule, grid.cutoff, count(*) FILTER (good = 1 AND u.v > cutoff) AS good_hit, count(*) FILTER (good = 0 AND u.v > cutoff) AS bad_hit FROM long JOIN (VALUES {grid}) AS grid(rule, cutoff) ON u.rule = grid.rule GROUP BY ALL),
gain AS (SELECT cells.*, coalesce(bad_hit / nullif(n_bad, 0), 0) - coalesce(good_hit / nullif(n_good, 0), 0) AS gain FROM cells JOIN counted ON cells.lang IS NOT DISTINCT FROM counted.lang JOIN allow ON cells.lang IS NOT DISTINCT FROM allow.lang WHERE good_hit <= allowed),
pick AS (SELECT *, row_number() OVER (PARTITION BY lang, rule ORDER BY gain DESC, cutoff DESC) AS nth FROM gain WHERE gain > 0),
cut AS (SELECT lang, {cuts} FROM pick WHERE nth = 1 GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {over}) AS kept FROM m LEFT JOIN cut ON m.lang IS NOT DISTINCT FROM cut.lang"""


#: SHA-1 in base 32: each character is five bits of two neighbouring hexadecimal digits.
_WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
e AS (SELECT page_id, n, h, max(page_id) OVER (PARTITION BY h) AS last FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (((16 * (strpos('0123456789abcdef', substr(h, CAST(5 * i // 4 + 1 AS INTEGER), 1)) - 1) + strpos('0123456789abcdef', substr(h, CAST(5 * i // 4 + 2 AS INTEGER), 1)) - 1) >> CAST(3 - 5 * i % 4 AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest, CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN last > page_id THEN last END AS refers_to FROM e"""


#: Ids of the tables are unique, so an id's rows are in one shard.
_SHARD_SQL = "SELECT doc_id, count(*) AS stored_rows, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS text_chars, true AS one_shard FROM documents GROUP BY doc_id"


ORACLES: dict[str, str] = {"op7_sharding": _SHARD_SQL, "op3_warc": " ".join(_WARC_SQL.split()), "op8_quality_rules": " ".join(_quality_sql().split())}
