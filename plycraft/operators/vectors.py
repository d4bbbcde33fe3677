"""Vector groups: scaling, centroids, summaries, clustering and routing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import cosine_distance, norm, scaled

TINY = 1e-12
MIN_SUPPORT, MIN_PLAYERS, MIN_POSITIONS = 30, 20, 30
RADIUS_FLOOR = 0.05


def scaler(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """One row: the population deviation of each dimension about its mean as ``scale`` (1
    where it does not vary). Nothing is subtracted: a shared signal must not vanish."""
    flat = rows.select(F.posexplode(vector).alias("dim", "x"))
    per = flat.groupBy("dim").agg(F.stddev_pop("x").alias("sd"))
    return per.select("dim", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0).alias("scale"))


def as_array(per_dim: DataFrame, value: str, *keys: str) -> DataFrame:
    """Rows of (keys, dim, value) as one array per key, in order of dimension."""
    packed = F.transform(F.sort_array(F.collect_list(F.struct("dim", value))), lambda x: x[value])
    return per_dim.groupBy(*keys).agg(packed.alias(value)) if keys else per_dim.agg(packed.alias(value))


def centroids(rows: DataFrame, group: str, vector: str = "vector") -> DataFrame:
    """Mean vector of each group. Dimensions are averaged before the shuffle, so a large
    group is no large task."""
    flat = rows.select(group, F.posexplode(vector).alias("dim", "x"))
    return as_array(flat.groupBy(group, "dim").agg(F.avg("x").alias("centroid")), "centroid", group)


def with_distance(rows: DataFrame, centers: DataFrame, group: str, vector: str = "vector") -> DataFrame:
    return rows.join(centers, group).withColumn("distance", cosine_distance(F.col(vector), F.col("centroid")))


def radius(distance_limit: float, q95: Column) -> Column:
    return F.least(F.lit(distance_limit), F.greatest(F.lit(RADIUS_FLOOR), q95 + 0.05))


def summary(rows: DataFrame, group: str, distance_limit: float, vector: str = "vector") -> DataFrame:
    """Per group: support, distinct players, positions and games, mean and largest distance
    from the centroid, the radius, and whether support is enough."""
    far = with_distance(rows, centroids(rows, group, vector), group, vector)
    out = far.groupBy(group).agg(
        F.count("*").alias("support"), F.countDistinct("player").alias("unique_players"), F.countDistinct("position").alias("unique_positions"), F.countDistinct("game_id").alias("unique_games"),
        F.avg("distance").alias("mean_distance"), F.max("distance").alias("max_distance"), radius(distance_limit, F.percentile("distance", 0.95)).alias("radius"),
    )
    return out.withColumn("supported", supported(F.col("support"), F.col("unique_players"), F.col("unique_positions")))


def supported(support: Column, players: Column, positions: Column) -> Column:
    return (support >= MIN_SUPPORT) & (players >= MIN_PLAYERS) & (positions >= MIN_POSITIONS)


def numbered(rows: DataFrame, group: str, key: str = "decision_id") -> DataFrame:
    """Groups named c001, c002, ... in the order of their least id."""
    least = rows.groupBy(group).agg(F.min(key).alias("_least"))
    named = least.withColumn("cluster_id", F.format_string("c%03d", F.row_number().over(Window.orderBy("_least"))))
    return rows.join(named.drop("_least"), group)


def author_counts(rows: DataFrame, group: str, author: str = "author") -> DataFrame:
    """group -> map of authors to rows; a missing author is ``unspecified``."""
    per = rows.select(group, F.coalesce(author, F.lit("unspecified")).alias("author")).groupBy(group, "author").agg(F.count("*").alias("n"))
    return per.groupBy(group).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("author", "n")))).alias("author_counts"))


def routed(rows: DataFrame, routing: DataFrame, candidates: DataFrame, *, key: str = "decision_id", vector: str = "vector") -> DataFrame:
    """key, cluster_id (null if rejected), distance: the nearest of *all* routing centroids,
    accepted only if it is a candidate and within that candidate's radius. A nearest that is
    no candidate is a rejection; there is no second choice.

    ``routing``: idx, cluster_id, centroid. It is a reviewed taxonomy, tens of rows by
    hand; it is broadcast and each row takes its minimum with first-index ties in one
    aggregate, so rows do not multiply through a sort."""
    model = routing.agg(F.sort_array(F.collect_list(F.struct("idx", "cluster_id", "centroid"))).alias("_routes"))
    usable = F.coalesce(F.col("available") & F.col("informative"), F.lit(False)) if {"available", "informative"} <= set(rows.columns) else F.lit(True)
    near = F.array_min(F.transform("_routes", lambda r: F.struct(cosine_distance(F.col(vector), r["centroid"]).alias("d"), r["idx"].alias("idx"), r["cluster_id"].alias("cluster_id"))))
    found = rows.crossJoin(F.broadcast(model)).withColumn("_near", F.when(usable & (F.size("_routes") > 0) & (norm(F.col(vector)) > TINY), near))
    ok = F.broadcast(candidates.select(F.col("cluster_id").alias("_c"), F.col("radius").alias("_radius")))
    joined = found.join(ok, F.col("_near.cluster_id") == F.col("_c"), "left")
    return joined.select(key, F.when(F.col("_near.d") <= F.col("_radius"), F.col("_c")).alias("cluster_id"), F.col("_near.d").alias("distance"))


def average_linkage(x: np.ndarray, limit: float) -> np.ndarray:
    """Labels of agglomerative clustering by mean pairwise cosine distance: the nearest two
    groups merge while they are nearer than ``limit``."""
    n = len(x)
    if n < 2:
        return np.zeros(n, np.int64)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    d = np.maximum(1 - unit @ unit.T, 0)
    np.fill_diagonal(d, np.inf)
    size, label = np.ones(n), np.arange(n)
    near, at = d.min(1), d.argmin(1)
    while True:
        i = int(near.argmin())
        if not near[i] < limit:
            break
        j = int(at[i])
        i, j = min(i, j), max(i, j)
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        row[[i, j]] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == label[j]] = label[i]
        stale = np.flatnonzero((at == i) | (at == j))
        stale = np.union1d(stale, [i])
        near[stale], at[stale] = d[stale].min(1), d[stale].argmin(1)
        better = d[i] < near
        near[better], at[better] = d[i][better], i
        near[j] = np.inf
    return np.unique(label, return_inverse=True)[1]


def clustered(sample: DataFrame, limit: float, *, key: str = "decision_id", vector: str = "vector") -> DataFrame:
    """key, label. The sample is bounded by construction (a round-robin sample of at most a
    thousand episodes): one task holds its distance matrix."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        return pd.DataFrame({key: pdf[key], "label": average_linkage(np.array(pdf[vector].tolist(), float), limit)})

    kind = sample.schema[key].dataType.simpleString()
    usable = sample.where(norm(F.col(vector)) > TINY).select(key, vector)
    return usable.groupBy(F.lit(0).alias("_all")).applyInPandas(merge, f"{key} {kind}, label bigint")


def scaled_rows(rows: DataFrame, scale: DataFrame, vector: str = "vector") -> DataFrame:
    """``rows`` with their vector divided by the scaler's deviations (one broadcast row)."""
    one = as_array(scale, "scale")
    zero = F.transform("scale", lambda s: F.lit(0.0))
    return rows.crossJoin(F.broadcast(one)).withColumn(vector, scaled(F.col(vector), zero, F.col("scale"))).drop("scale")


def packet_members(members: DataFrame, group: str, *, most: int = 12, ends: int = 4) -> DataFrame:
    """Members to review: the ``ends`` nearest, the ``ends`` farthest (farthest first), then
    the rest by distance; one of each player, at most ``most`` of a group."""
    near = Window.partitionBy(group).orderBy("distance", "decision_id")
    far = Window.partitionBy(group).orderBy(F.col("distance").desc(), F.col("decision_id").desc())
    ranked = members.withColumn("_near", F.row_number().over(near)).withColumn("_far", F.row_number().over(far))
    place = F.when(F.col("_near") <= ends, F.col("_near")).when(F.col("_far") <= ends, ends + F.col("_far")).otherwise(2 * ends + F.col("_near"))
    ranked = ranked.withColumn("_place", place)
    own = F.row_number().over(Window.partitionBy(group, "player").orderBy("_place"))
    one = ranked.withColumn("_own", own).where("_own = 1")
    pick = F.row_number().over(Window.partitionBy(group).orderBy("_place"))
    return one.withColumn("pick", pick).where(F.col("pick") <= most).drop("_near", "_far", "_place", "_own")


def concentration(rows: DataFrame, group: str, value: str) -> DataFrame:
    """How far a group rests on one value: distinct values, the largest one's share, and
    whether that is over half. Counted per value before the group's own aggregation."""
    per = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    out = per.groupBy(group).agg(F.count("*").alias("distinct"), (F.max("n") / F.sum("n")).alias("largest_share"))
    return out.withColumn("concentrated", F.col("largest_share") > 0.5)
