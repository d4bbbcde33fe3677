"""Player-level bootstrap: whole players are drawn with replacement.

Replicates work on per-player partial sums, never on decisions. Weights come from seeded
hashes (every engine can recompute them; or Poisson, without a shuffle, for very many
players), or from a numpy generator on the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOW, HIGH = 0.025, 0.975


def numbered_players(players: DataFrame) -> DataFrame:
    """player, i: distinct players numbered from 0, in the order of a hash prefix and, within
    it, of the name. Only the sizes of the 4,096 prefixes meet in one task."""
    listed = players.select("player").distinct().withColumn("_bucket", F.substring(F.sha2("player", 256), 1, 3))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = listed.groupBy("_bucket").agg(F.count("*").alias("_n")).select("_bucket", before.alias("_start"))
    nth = F.row_number().over(Window.partitionBy("_bucket").orderBy("player"))
    return listed.join(F.broadcast(starts), "_bucket").select("player", (F.col("_start") + nth - 1).cast("long").alias("i"))


def hashed_weights(players: DataFrame, replicates: int, seed: int) -> DataFrame:
    """rep, player, w: in each replicate as many draws as there are players, each a hash of
    (seed, rep, draw) modulo the number of players. Draws are rows of a distributed range,
    counted per player before anything is joined."""
    listed = numbered_players(players)
    n = listed.count()
    draws = players.sparkSession.range(replicates * n).select(F.floor(F.col("id") / max(n, 1)).alias("rep"), (F.col("id") % max(n, 1)).alias("j"))
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("rep"), F.lit(":"), F.col("j")), 256), 1, 16)
    hit = (F.conv(head, 16, 10).cast("decimal(20,0)") % F.lit(max(n, 1))).cast("long")
    return draws.select("rep", hit.alias("i")).groupBy("rep", "i").agg(F.count("*").alias("w")).join(listed, "i").select("rep", "player", "w")


def poisson_weights(players: DataFrame, replicates: int, seed: int) -> DataFrame:
    """rep, player, w with w ~ Poisson(1) from a hash of (seed, rep, player): what draws with
    replacement come to with many players. Each player's row makes its own weights, so
    nothing is shuffled, and replicates with weight 0 have no row."""
    steps = [sum(1 / math.factorial(j) for j in range(k + 1)) / math.e for k in range(16)]
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("rep"), F.col("player")), F.lit(1 << 52)).cast("double") / float(1 << 52)
    w = sum((F.col("_u") >= F.lit(x)).cast("long") for x in steps[1:]) + (F.col("_u") >= F.lit(steps[0])).cast("long")
    drawn = players.select("player").distinct().withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long")))).withColumn("_u", u)
    return drawn.select("rep", "player", w.alias("w")).where("w > 0")


def multinomial_weights(spark: SparkSession, players: list[str], replicates: int, seed: int) -> DataFrame:
    """The same from numpy's multinomial, for a player list that fits the driver."""
    if not players:
        return spark.createDataFrame([], "rep bigint, player string, w bigint")
    w = np.random.default_rng(seed).multinomial(len(players), np.full(len(players), 1 / len(players)), size=replicates)
    rep, at = np.nonzero(w)
    return spark.createDataFrame([(int(r), players[i], int(w[r, i])) for r, i in zip(rep, at, strict=True)], "rep bigint, player string, w bigint")


def replicate_sums(partials: DataFrame, weights: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """rep, keys, weighted sums of the per-player partials."""
    joined = partials.join(weights, "player")
    return joined.groupBy("rep", *keys).agg(*[F.sum(F.col("w") * F.col(v)).alias(v) for v in values])


def interval(value: Column) -> tuple[Column, Column]:
    """Bounds over replicates that have a value (nulls drop out; null if none has)."""
    return F.percentile(value, LOW).alias("ci_low"), F.percentile(value, HIGH).alias("ci_high")


def rate_intervals(partials: DataFrame, weights: DataFrame, keys: list[str], part: str, whole: str, per: float = 100.0) -> DataFrame:
    """Per key the interval of ``per * part / whole``."""
    sums = replicate_sums(partials, weights, keys, [part, whole])
    value = F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double")) * per
    return sums.groupBy(*keys).agg(*interval(value))


def adjacent_intervals(partials: DataFrame, weights: DataFrame, part: str, whole: str, *, band: str = "band", width: int = 200, per: float = 100.0) -> DataFrame:
    """band, interval of its rate less the next band's, paired within each replicate."""
    sums = replicate_sums(partials, weights, [band], [part, whole]).select("rep", band, (F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double")) * per).alias("rate"))
    later = sums.select("rep", (F.col(band) - width).alias(band), F.col("rate").alias("next_rate"))
    return sums.join(later, ["rep", band]).groupBy(band).agg(*interval(F.col("rate") - F.col("next_rate")))


def player_partials(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per player and key: decisions, hits among them, and the hits' cost. ``rows`` has a
    boolean ``hit`` and ``loss``."""
    hit = F.coalesce("hit", F.lit(False))
    return rows.groupBy("player", *keys).agg(F.count("*").alias("decisions"), F.sum(F.when(hit, 1).otherwise(0)).alias("hits"), F.sum(F.when(hit, F.col("loss")).otherwise(0.0)).alias("cost"))
