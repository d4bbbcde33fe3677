"""Game archives: scan, eligibility, decisions.

A plain archive is split by Spark at game boundaries; a compressed one is one stream and
one task, so convert it once (``to_games_table``) if it is read often. Games are numbered
in archive order without a global sort: blocks are counted, and a game's number is its
block's start plus its place in the block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import part_of
from ..kernel.board import uci
from ..kernel.notation import read_game
from ..operators.partitioning import without_history
from ..operators.sampling import arrival_key
from ..session import spread

GAME = "file string, block bigint, place bigint, text string"
HEAD = "[Event "


def _plain(spark: SparkSession, path: str) -> DataFrame:
    first = spark.read.text(path, lineSep="\n").first()
    newline = "\r\n" if first is not None and first[0].endswith("\r") else "\n"
    raw = spark.read.text(path, lineSep=f"{newline}{newline}{HEAD}")
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value"))
    body = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^﻿", "")
    text = F.when(F.startswith(body, F.lit(HEAD)), body).otherwise(F.concat(F.lit(HEAD), body))
    return rows.where(F.length(F.trim("value")) > 0).select("file", "block", "place", text.alias("text"))


def _compressed(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a ``.zst`` stream come in order in one task; games are cut as they pass."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[str] = []
        name, place, moves = None, 0, False
        for pdf in frames:
            out = []
            for file, line in zip(pdf["file"], pdf["value"], strict=True):
                line = line.rstrip("\r")
                if (file != name or (moves and line.startswith(HEAD))) and held:
                    out.append((name, 0, place, "\n".join(held)))
                    held, place, moves = [], place + 1, False
                name = file
                moves = moves or not line.strip()
                held.append(line)
            yield pd.DataFrame(out, columns=["file", "block", "place", "text"])
        if any(x.strip() for x in held):
            yield pd.DataFrame([(name, 0, place, "\n".join(held))], columns=["file", "block", "place", "text"])

    return lines.mapInPandas(cut, GAME)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """game_ordinal (from 1, in archive order) and text of every game."""
    games = _compressed(spark, path) if path.endswith(".zst") else _plain(spark, path)
    blocks = games.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    starts = blocks.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("file", "block").orderBy("place"))
    return games.withColumn("nth", nth).join(starts, ["file", "block"]).select((F.col("start") + F.col("nth")).alias("game_ordinal"), "text")


def to_games_table(games: DataFrame, path: str) -> DataFrame:
    games.write.parquet(path)
    return games.sparkSession.read.parquet(path)


def header(name: str) -> Column:
    """A header's value from a game's text, or null."""
    found = F.regexp_extract("text", rf'(?m)^\[{re.escape(name)}\s+"((?:[^"\\]|\\.)*)"\]', 1)
    present = F.regexp_like(F.col("text"), F.lit(rf'(?m)^\[{re.escape(name)}\s+"'))
    return F.when(present, F.regexp_replace(found, r"\\(.)", "$1"))


def eligible(games: DataFrame, fixture: bool = False) -> DataFrame:
    """Standard games; beyond a fixture, rated rapid games between people. Header tests run
    before any move is read."""
    standard = F.coalesce(header("Variant"), F.lit("Standard")) == "Standard"
    event = F.lower(F.coalesce(header("Event"), F.lit("")))
    human = (F.coalesce(header("WhiteTitle"), F.lit("")) != "BOT") & (F.coalesce(header("BlackTitle"), F.lit("")) != "BOT")
    return games.where(standard if fixture else standard & F.startswith(event, F.lit("rated ")) & F.contains(event, F.lit("rapid")) & human)


def plies(games: DataFrame, fixture: bool = False) -> DataFrame:
    """A row per choice of every readable game: who, rating, ply, moves before, move, and
    the position (placement, side, castling, en passant)."""

    def replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for ordinal, text in zip(pdf["game_ordinal"], pdf["text"], strict=True):
                game = read_game(text)
                if game.errors:
                    continue
                h, board, history = game.headers, game.start(), []
                fen, site = board.fen(), h.get("Site", "?").rsplit("/", 1)[-1]
                for ply, move in enumerate(game.moves):
                    side = "White" if board.turn > 0 else "Black"
                    try:
                        rating = int(h.get(f"{side}Elo", "600" if fixture else "0"))
                    except ValueError:
                        rating = 0
                    out.append((int(ordinal), site, h.get(side, "?").casefold(), rating, ply, fen, list(history), uci(move), board.position()))
                    history.append(uci(move))
                    board = board.play(move)
            yield pd.DataFrame(out, columns=["game_ordinal", "site", "player", "rating", "ply", "initial_fen", "history", "move", "position"])

    return games.mapInPandas(replay, "game_ordinal bigint, site string, player string, rating int, ply int, initial_fen string, history array<string>, move string, position string")


def candidates(games: DataFrame, *, seed: int, rating_min: int = 400, rating_max: int = 799, fixture: bool = False, only_partition: str | None = None, prior_players: DataFrame | None = None, prior_positions: DataFrame | None = None) -> DataFrame:
    """Decisions that a sample may take, with game_ordinal, partition and ``ord``.

    Arrival is by game, then by a seeded hash of the decision: reproducible in any order of
    execution. A game without an id is an error, except in a fixture, which numbers it."""
    rows = plies(spread(eligible(games, fixture), "game_ordinal"), fixture).where(F.col("rating").between(rating_min, rating_max) & (F.col("player") != "?"))
    missing = F.concat(F.lit("fixture-"), "game_ordinal") if fixture else F.raise_error(F.lit("missing source game id")).cast("string")
    game_id = F.when(F.col("site") == "?", missing).otherwise(F.col("site"))
    rows = rows.withColumn("game_id", game_id).withColumn("partition", part_of(F.col("player"), seed)).withColumn("decision_id", F.concat("game_id", F.lit(":"), "ply"))
    if only_partition is not None:
        rows = rows.where(F.col("partition") == only_partition)
    rows = without_history(rows, prior_players, prior_positions)
    rows = spread(rows, "game_ordinal")  # and so what is made of decisions, too
    within = F.row_number().over(Window.partitionBy("game_ordinal").orderBy(arrival_key(seed), "decision_id"))
    return rows.withColumn("ord", F.col("game_ordinal") * 100_000 + within).select("decision_id", "game_id", "player", "rating", "ply", "initial_fen", "history", "move", "position", F.col("ord").cast("long").alias("ord"), "game_ordinal", "partition")
