"""Command line: one command per stage."""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile
from pathlib import Path

from .plans import report, stages, taxonomy
from .plans.artifacts import Run
from .session import local_session
from .sources import uci


def doctor(spark, engine: str | None = None) -> dict:
    """What the engine needs, tried out: modules, notation both ways, a compressed archive,
    a table written and counted by SQL and, if an engine is named, whose mate it reports."""
    import duckdb
    import numpy
    import pyarrow
    import zstandard

    from .kernel.board import Board, START_FEN, perft
    from .kernel.notation import read_game, write_game
    from .sources import archive

    text = '[Event "Rated Rapid game"]\n[Site "x/abc"]\n[White "A"]\n[Black "B"]\n[WhiteElo "600"]\n[BlackElo "600"]\n\n1. e4 e5 2. Qh5 Nc6 3. Bc4 Nf6 4. Qxf7# 1-0\n'
    game = read_game(text)
    again = read_game(write_game(game.headers, game.start(), report._chain(game.start(), [stage_uci(m) for m in game.moves]), result="1-0"))
    with tempfile.TemporaryDirectory() as d:
        path = Path(d) / "g.pgn.zst"
        path.write_bytes(zstandard.ZstdCompressor().compress((text + "\n" + text).encode()))
        games = archive.scan(spark, str(path)).count()
        spark.range(3).write.parquet(f"{d}/t")
        counted = spark.sql(f"select count(*) from parquet.`{d}/t`").first()[0]
        other = duckdb.sql(f"select count(*) from read_parquet('{d}/t/*.parquet')").fetchall()[0][0]
    mates: dict[str, bool] = {}
    if engine:
        program = uci.Engine([engine])
        try:  # the mover mates at once, or lets the other side off
            row = {"decision_id": "mate", "initial_fen": "6k1/5ppp/8/8/8/8/8/K3R3 w - - 0 1", "history": [], "move": "e1e8"}
            done = uci.analysis(program, row, 10_000)
            mates = {"engine": done["before_expected"] >= done["after_expected"] - 1e-9 and done["after_expected"] == 1.0 and (done["before_mate"] or 0) >= 0}
        finally:
            program.close()
    return mates | {"spark": spark.version, "numpy": numpy.__version__, "pyarrow": pyarrow.__version__, "perft3": perft(Board.from_fen(START_FEN), 3) == 8902, "notation": again.moves == game.moves, "archive": games == 2, "sql": counted == other == 3}


def stage_uci(move) -> str:
    from .kernel.board import uci

    return uci(move)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plycraft")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args, **options):
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        for o, default in options.items():
            flag = f"--{o.replace('_', '-')}"
            if isinstance(default, bool):
                c.add_argument(flag, action="store_true")
            elif isinstance(default, list):
                c.add_argument(flag, action="append", default=None)
            else:
                c.add_argument(flag, default=default, type=type(default) if default is not None else str)
        return c

    add("doctor", engine=None)
    add("sample", "archive", "run", count=100, seed=20261006, fixture=False, rating_min=400, rating_max=799, stratified=False, prior_run=None, only_partition=None)
    add("analyse", "run", "engine", nodes=100_000, workers=4, batch=1)
    add("import-analyses", "run", "table", nodes=100_000)
    for name in ("features", "discover"):
        add(name, "run")
    add("report", "run", "scores", nodes=1_000_000)
    add("episodes", "run", loss_threshold=0.10, horizon=6)
    add("stable", "run", "scores", min_loss=0.4, max_drift=0.1, deep_nodes=1_000_000, partition=[])
    add("description-packets", "run", partition="discovery")
    add("import-descriptions", "run", "descriptions", model_run=None, stop_words=None)
    add("cluster", "run", max_episodes=200, distance=0.3)
    add("review-packets", "run", partition="discovery")
    add("freeze", "run", "review", "selection_review")
    add("measure", "run", bootstrap=1000, taxonomy_run=None, weights="hashed")
    add("engine-audit", "run", "scores", count=20, nodes=1_000_000)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = local_session()
    if a.command == "doctor":
        found = doctor(spark, a.engine)
        print(json.dumps(found, indent=1))
        return 0 if all(v is not False for v in found.values()) else 1
    run = Run(spark, a.run)
    def scores(path: str) -> tuple:
        """A scorer and its settings: an engine's program, or a table of scores."""
        if Path(path).is_file() and os.access(path, os.X_OK):
            return uci.scorer([path], workers=getattr(a, "workers", None)), uci.settings(path)
        return lambda todo, _: spark.read.parquet(path).join(todo.select("decision_id"), "decision_id", "left_semi"), None

    other = lambda path: Run(spark, path) if path else None
    match a.command:
        case "sample":
            stages.sample(run, a.archive, count=a.count, seed=a.seed, fixture=a.fixture, rating_min=a.rating_min, rating_max=a.rating_max, stratified=a.stratified, prior=other(a.prior_run), only_partition=a.only_partition)
        case "analyse":
            scorer, settings = scores(a.engine)
            print(stages.analyse(run, scorer, nodes=a.nodes, settings=settings, batch=a.batch))
        case "import-analyses":
            stages.import_analyses(run, spark.read.parquet(a.table), {"nodes": a.nodes})
        case "features":
            stages.features(run)
        case "discover":
            stages.discover(run)
        case "report":
            scorer, settings = scores(a.scores)
            report.symbolic_report(run, scorer, nodes=a.nodes, settings=settings)
        case "episodes":
            stages.episodes(run, loss_threshold=a.loss_threshold, horizon=a.horizon)
        case "stable":
            scorer, settings = scores(a.scores)
            stages.stable(run, scorer, settings=settings, min_loss=a.min_loss, max_drift=a.max_drift, deep_nodes=a.deep_nodes, partitions=tuple(a.partition or stages.PARTS))
        case "description-packets":
            print(stages.description_packets(run, a.partition))
        case "import-descriptions":
            words = Path(a.stop_words).read_text(encoding="utf-8").split() if a.stop_words else None
            stages.import_descriptions(run, a.descriptions, other(a.model_run), words)
        case "cluster":
            print(stages.cluster(run, max_episodes=a.max_episodes, distance=a.distance))
        case "review-packets":
            stages.review_packets(run, a.partition)
        case "freeze":
            taxonomy.freeze(run, a.review, a.selection_review)
        case "measure":
            taxonomy.measure(run, replicates=a.bootstrap, source=other(a.taxonomy_run), weights=a.weights)
        case "engine-audit":
            scorer, settings = scores(a.scores)
            stages.engine_audit(run, scorer, count=a.count, nodes=a.nodes, settings=settings)
    return 0


if __name__ == "__main__":
    sys.exit(main())
