"""Leakage-free parts: players by hash, positions only in the earliest part that has them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import part_of, part_rank


def assigned(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` with the part of their player."""
    return rows.withColumn("partition", part_of(F.col("player"), seed))


def without_history(rows: DataFrame, players: DataFrame | None, positions: DataFrame | None) -> DataFrame:
    """Drop evaluation rows whose player or position an earlier run has used; others stay.
    Each key is an anti join on evaluation rows alone."""
    held = F.col("partition") == "evaluation"
    fresh = rows.where(held)
    for keys, column in ((players, "player"), (positions, "position")):
        if keys is not None:
            fresh = fresh.join(keys.select(column).distinct(), column, "left_anti").select(*rows.columns)
    return rows.where(~held).unionByName(fresh) if players is not None or positions is not None else rows


def split_rows(rows: DataFrame, seed: int, *, prior_players: DataFrame | None = None, prior_positions: DataFrame | None = None, order: str = "ord") -> DataFrame:
    """Rows that keep a part, with ``partition``.

    A position belongs to the earliest part in which it occurs and its rows elsewhere are
    dropped; in evaluation only its first row (by ``order``) stays, after the exclusions of
    earlier runs. A frequent position is aggregated before the shuffle (its least part),
    then joined; only evaluation rows pass through a window."""
    named = assigned(rows, seed).withColumn("_rank", part_rank(F.col("partition")))
    least = named.groupBy("position").agg(F.min("_rank").alias("_least"))
    own = named.join(least, "position").where("_rank = _least").drop("_least", "_rank").select(*rows.columns, "partition")
    own = without_history(own, prior_players, prior_positions)
    held = F.col("partition") == "evaluation"
    first = own.where(held).groupBy("position").agg(F.min(order).alias("_first"))
    kept = own.where(held).join(first, "position").where(F.col(order) == F.col("_first")).select(*own.columns)
    return own.where(~held).unionByName(kept)


def excluded(rows: DataFrame, kept: DataFrame, key: str = "decision_id") -> DataFrame:
    """Rows that no part has (the difference of the two id sets)."""
    return rows.join(kept.select(key), key, "left_anti")


def part_or_excluded(rows: DataFrame, kept: DataFrame, key: str = "decision_id") -> DataFrame:
    return rows.join(kept.select(key, "partition"), key, "left").withColumn("partition", F.coalesce("partition", F.lit("excluded")))


def overlap(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Values that both have; must be empty for an independent evaluation."""
    return a.select(column).intersect(b.select(column))


def set_deltas(old: str, new: str) -> dict[str, Column]:
    """Sizes of what a set column's successor created, removed and retained."""
    return {"created": F.size(F.array_except(new, old)), "removed": F.size(F.array_except(old, new)), "retained": F.size(F.array_intersect(old, new))}


def all_known(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that are missing on either side or repeated on one, with their counts: empty if
    the two tables cover each other one to one."""
    left, right = (x.groupBy(key).agg(F.count("*").alias(n)) for x, n in ((a, "n_left"), (b, "n_right")))
    both = left.join(right, key, "full").select(key, F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))
    return both.where("n_left <> 1 or n_right <> 1")


def repeated(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def numbered_prefix(rows: DataFrame, group: str, order: str, value: str, into: str = "history") -> DataFrame:
    """The values that come before a row in its group, as an array."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(into, F.coalesce(F.collect_list(value).over(w), F.array().cast("array<string>")))
