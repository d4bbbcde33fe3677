"""Quality rules with risk-controlled thresholds (DataFrame functions only).

Base measures are counted from the whole text. On top of the fixed base rule, cutoffs of
five ratios are *selected*, not guessed: on labelled holdout documents, per stratum
(``lang``), a cutoff is certified when the exact binomial tail shows that it rejects at
most ``risk / rules`` of the good documents, at level ``delta / (strata * rules)``
(Bonferroni over every stratum and rule). False rejections fall as a cutoff is relaxed,
so testing the grid from lenient to strict needs no further correction. Of the certified
cutoffs the one with the largest gain (share of bad documents rejected less share of good
ones) is taken, the most lenient on ties, and none if nothing is gained. A stratum with
too few labels to certify anything rejects nothing beyond the base rule. The guarantee is
about the cutoffs: what the fixed base rule rejects (short or repetitive texts, good ones
among them) is outside it.

Defined results: a null text counts as empty (0 words, base_failed); null ``lang`` is a
stratum of its own; a document without label takes part in no calibration; a document
labelled more than once is good only if every label says so; no labels at all leaves the
base rule alone; equal rows get equal results; an empty table gives an empty result.
Clashing column names are kept: measures live in one struct column with a free name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, materialise, text_of, word_array

SYMBOLS = "#*$%&|<>"
RULES = ("symbol_ratio", "shout_ratio", "dup_line_ratio", "repeat_ratio", "mean_word")
#: Candidate cutoffs, fixed before any label is seen; a document is rejected above one.
GRID = {
    "symbol_ratio": (0.005, 0.01, 0.02, 0.04, 0.08, 0.12, 0.16, 0.24),
    "shout_ratio": (0.005, 0.01, 0.02, 0.04, 0.08, 0.12, 0.16, 0.24),
    "dup_line_ratio": (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5),
    "repeat_ratio": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4),
    "mean_word": (8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0),
}
RISK, DELTA = 0.02, 0.05


def _repeat_words(hashes: Column) -> Column:
    """Positions covered by 3-word windows that occur twice or more.

    ``hashes`` has a 64-bit hash for each window. Sorted by (hash, position), equal
    windows are neighbours; each repeated window at p covers p..p+2."""

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def merged(s: Column) -> Column:
            same = lambda e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
            again = F.filter(s, lambda e, j: same(e, j - 1) | same(e, j + 1))
            starts = F.sort_array(F.transform(again, lambda e: e["i"]))
            return F.aggregate(
                starts,
                F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
                lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
            )["n"]

        return let(pairs, merged)

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def measures(text: Column) -> Column:
    """A struct of the base measures and ratios of a text column, without leaving the JVM."""

    def of(t: Column) -> Column:
        chars = F.length(F.translate(t, " \t\n\x0b\x0c\r", ""))
        symbols = F.length(t) - F.length(F.translate(t, SYMBOLS, ""))
        shouts = F.length(t) - F.length(F.translate(t, "!?", ""))
        lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)

        def of_words(w: Column) -> Column:
            windows = F.when(
                F.size(w) >= 3,
                F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))),
            ).otherwise(F.array().cast("array<bigint>"))
            return F.struct(F.size(w).cast("long").alias("n"), _repeat_words(windows).cast("long").alias("rep"))

        def of_lines(x: Column) -> Column:
            return F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))

        return F.struct(let(word_array(t), of_words).alias("w"), let(lines, of_lines).alias("l"), chars.cast("long").alias("chars"), symbols.cast("long").alias("symbols"), shouts.cast("long").alias("shouts"))

    return let(text_of(text), of)


def measured(docs: DataFrame, text: str = "text", into: str | None = None) -> DataFrame:
    """``docs`` with one struct column (default ``quality``, or a free name) of n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the five ratios."""
    name = into or fresh(docs, "quality")
    raw = fresh(docs, "quality_raw")
    m = F.col(raw)
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    n, rep, chars = m["w"]["n"], m["w"]["rep"], m["chars"]
    return docs.withColumn(raw, measures(docs[text])).withColumn(
        name,
        F.struct(
            n.alias("n_words"), chars.alias("word_chars"), m["symbols"].alias("n_symbols"), m["l"]["dup"].alias("n_dup_lines"), rep.alias("n_repeat_words"),
            ((n < 50) | (100 * rep > 50 * n)).alias("base_failed"),
            ratio(m["symbols"], chars).alias("symbol_ratio"), ratio(m["shouts"], chars).alias("shout_ratio"), ratio(m["l"]["dup"], m["l"]["n"]).alias("dup_line_ratio"), ratio(rep, n).alias("repeat_ratio"), ratio(chars, n).alias("mean_word"),
        ),
    ).drop(raw)


def allowed(n: Column, risk: float, level: Column) -> Column:
    """The largest k with P(Binomial(n, risk) <= k) <= level, or -1: k false rejections
    among n good documents still prove a rate below ``risk``. Terms are kept as logarithms."""
    step = F.log(F.lit(risk)) - F.log1p(F.lit(-risk))
    start = F.struct((n * F.log1p(F.lit(-risk))).alias("lp"), F.lit(0.0).alias("cdf"), F.lit(-1).cast("long").alias("k"))

    def add(a: Column, j: Column) -> Column:
        cdf = a["cdf"] + F.exp(a["lp"])
        more = a["lp"] + F.log(F.greatest((n - j).cast("double"), F.lit(1e-300)) / (j + 1)) + step
        return F.struct(more.alias("lp"), cdf.alias("cdf"), F.when(cdf <= level, j).otherwise(a["k"]).alias("k"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.ceil(n * risk)), start, add)["k"]


def thresholds(rows: DataFrame, labels: DataFrame, *, measure: str = "quality", doc_id: str = "doc_id", stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row per (stratum, rule) with a certified and useful cutoff: stratum, rule,
    cutoff, n_good, n_bad, good_hit, bad_hit, allowed.

    ``rows`` has the measures; only documents that pass the base rule calibrate. The
    label side is aggregated first; counting is one map-side-combined aggregation."""
    y = labels.where(F.col("quality").isNotNull()).groupBy(F.col(doc_id).alias("_y_id")).agg(F.min("quality").alias("_good"))
    m = F.col(measure)
    held = rows.where(~m["base_failed"]).select(F.col(doc_id).alias("_x_id"), F.col(stratum).cast("string").alias("stratum"), *[m[r].alias(r) for r in RULES]).join(y, F.col("_x_id") == F.col("_y_id"))
    hit = [F.count_if((F.col("_good") == g) & (F.col(r) > c)).alias(f"{r}_{i}_{g}") for r in RULES for i, c in enumerate(GRID[r]) for g in (0, 1)]
    counted = held.groupBy("stratum").agg(F.count_if(F.col("_good") == 1).alias("n_good"), F.count_if(F.col("_good") == 0).alias("n_bad"), *hit)
    cells = F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(float(c)).alias("cutoff"), F.col(f"{r}_{i}_1").alias("good_hit"), F.col(f"{r}_{i}_0").alias("bad_hit"))
        for r in RULES for i, c in enumerate(GRID[r])
    ])
    strata = counted.agg(F.greatest(F.count("*"), F.lit(1)).alias("strata"))
    level = F.lit(delta) / (F.col("strata") * len(RULES))
    tested = counted.select("stratum", "n_good", "n_bad", cells.alias("cells")).crossJoin(F.broadcast(strata)).withColumn("allowed", allowed(F.col("n_good"), risk / len(RULES), level))
    cell = tested.select("stratum", "n_good", "n_bad", "allowed", F.explode("cells").alias("c")).select("stratum", "n_good", "n_bad", "allowed", "c.*")
    gain = F.coalesce(F.try_divide(F.col("bad_hit"), F.col("n_bad")), F.lit(0.0)) - F.coalesce(F.try_divide(F.col("good_hit"), F.col("n_good")), F.lit(0.0))
    best = cell.where(F.col("good_hit") <= F.col("allowed")).withColumn("gain", gain).where(F.col("gain") > 0)
    picked = best.groupBy("stratum", "rule").agg(F.max_by(F.struct("cutoff", "n_good", "n_bad", "good_hit", "bad_hit", "allowed"), F.struct("gain", "cutoff")).alias("p"))
    return picked.select("stratum", "rule", "p.*")


def judged(rows: DataFrame, cuts: DataFrame, *, measure: str = "quality", stratum: str = "lang", into: str = "kept") -> DataFrame:
    """``rows`` with a boolean: passes the base rule and every cutoff of its stratum. The
    thresholds have a row per stratum; the written table's size lets Spark decide whether
    to broadcast it."""
    wide = cuts.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_cut_{r}") for r in RULES]).withColumnRenamed("stratum", "_cut_stratum")
    m = F.col(measure)
    over = [F.coalesce(m[r] > F.col(f"_cut_{r}"), F.lit(False)) for r in RULES]
    fails = m["base_failed"]
    for o in over:
        fails = fails | o
    return rows.join(wide, F.col(stratum).cast("string").eqNullSafe(F.col("_cut_stratum")), "left").withColumn(into, ~fails).drop("_cut_stratum", *[f"_cut_{r}" for r in RULES])


def quality_rules(docs: DataFrame, labels: DataFrame, *, columns: list[str] | None = None, risk: float = RISK, delta: float = DELTA, name: str = "quality") -> tuple[DataFrame, str, str]:
    """The whole operator: measure every document once (written to the shared folder, with
    only ``columns`` if given), select cutoffs, judge. Returns (rows, the measures' column
    name, the verdict's column name)."""
    into, verdict = fresh(docs, "quality"), fresh(docs, "kept")
    full = measured(docs, into=into)
    rows = materialise(full if columns is None else full.select(*columns, into), f"{name}-rows")
    cuts = materialise(thresholds(rows, labels, measure=into, risk=risk, delta=delta).coalesce(1), f"{name}-cuts")
    return judged(rows, cuts, measure=into, into=verdict), into, verdict
