"""What people hand in, checked by tables of rules.

A rule is a name and a condition over joined rows. All rules of a table are evaluated in one
pass; a condition that is null does not hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Rules = dict[str, Column]


def first_broken(rows: DataFrame, key: str, rules: Rules) -> tuple[str, int, str] | None:
    """(rule, rows that break it, one of their keys) of the earliest rule that some row breaks."""
    names = list(rules)
    place = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(i)) for i, ok in enumerate(rules.values())])
    worst = rows.select(F.col(key).cast("string").alias("key"), place.alias("rule")).where("rule is not null").groupBy("rule").agg(F.count("*").alias("n"), F.min("key").alias("key")).orderBy("rule").first()
    return None if worst is None else (names[worst["rule"]], worst["n"], worst["key"])


def enforce(rows: DataFrame, key: str, rules: Rules, what: str) -> None:
    found = first_broken(rows, key, rules)
    if found is not None:
        raise ValueError(f"{what}: {found[0]} ({found[1]} rows, such as {found[2]})")


def occurrences(key: str) -> Column:
    return F.count("*").over(Window.partitionBy(key))
