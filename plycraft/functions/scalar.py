"""Scalar functions over columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import PARTS

#: Shares of the three parts in a hundred buckets.
CUTS = (60, 80)
#: Chess notation in free text (fixed patterns): coordinate moves, algebraic moves, squares.
COORDINATES = r"(?i)(?<![a-z0-9])[a-h][1-8][a-h][1-8][qrbn]?(?![a-z0-9])"
ALGEBRAIC = r"(?<![a-z0-9])(?:[KQRBN](?:[a-h1-8]{0,2})x?[a-h][1-8]|[a-h]x[a-h][1-8]|[a-h][1-8]|O-O(?:-O)?)(?:=[QRBN])?[+#]?(?![a-z0-9])"
SQUARES = r"(?i)(?<![a-z0-9])[a-h][1-8](?![a-z0-9])"


def bucket(player: Column, seed: int) -> Column:
    """0 to 99: the first 8 bytes of SHA-256 of ``seed:player`` as a big-endian number."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), player), 256), 1, 16)
    return (F.conv(head, 16, 10).cast("decimal(20,0)") % 100).cast("int")


def part_of(player: Column, seed: int) -> Column:
    """The part a player belongs to: all their decisions are in one."""
    b = bucket(player, seed)
    return F.when(b < CUTS[0], PARTS[0]).when(b < CUTS[1], PARTS[1]).otherwise(PARTS[2])


def part_rank(part: Column) -> Column:
    return F.when(part == PARTS[0], 0).when(part == PARTS[1], 1).otherwise(2)


def band_of(rating: Column, width: int = 200) -> Column:
    return (F.floor(rating / width) * width).cast("int")


def band_label(band: Column, low: int, high: int, width: int = 200) -> Column:
    """The band's bounds inside the cohort, joined by an en dash."""
    return F.concat(F.greatest(band, F.lit(low)).cast("string"), F.lit("–"), F.least(band + width - 1, F.lit(high)).cast("string"))


def bound_label(lower: Column, upper: Column) -> Column:
    return F.when(F.coalesce(lower, F.lit(False)), "lower").when(F.coalesce(upper, F.lit(False)), "upper").otherwise("exact")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 less the cosine; a zero vector is at distance 1 from everything."""
    return 1 - F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def scaled(v: Column, mean: Column, scale: Column) -> Column:
    return F.zip_with(F.zip_with(v, mean, lambda x, m: x - m), scale, lambda x, s: x / s)


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def informative(v: Column) -> Column:
    return F.exists(v, lambda x: x != 0)


def drift(before: Column, after: Column, deep_before: Column, deep_after: Column) -> Column:
    return F.greatest(F.abs(deep_before - before), F.abs(deep_after - after))


def per_hundred(part: Column, whole: Column) -> Column:
    """A rate per 100, null over nothing."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * 100


def masked(text: Column) -> Column:
    """Free text without chess notation, in lower case: coordinates go first, then algebraic
    moves, then single squares, each for a space."""
    out = text
    for pattern in (COORDINATES, ALGEBRAIC, SQUARES):
        out = F.regexp_replace(out, pattern, " ")
    return F.lower(out)


def safe_int(text: Column) -> Column:
    return F.coalesce(F.try_to_number(F.trim(text), F.lit("999999999")).cast("int"), text.try_cast("int"), F.lit(0))
