"""Scores from an engine process that speaks UCI.

A task starts one process, searches the position before and after each decision with a node
limit, and yields rows of ANALYSES. Expected scores are the engine's own win-draw-loss
estimates (``UCI_ShowWDL``). The process belongs to the task: it ends with it, and a retried
task starts another.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Callable, Iterator
from hashlib import sha256
from pathlib import Path
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernel.board import Board, parse_uci, position_after
from ..schemas import ANALYSES

OPTIONS = {"Threads": "1", "Hash": "128", "UCI_ShowWDL": "true"}
SCORE = re.compile(r" score (cp|mate) (-?\d+)(?: (lower|upper)bound)?")
WDL = re.compile(r" wdl (\d+) (\d+) (\d+)")
DEPTH = re.compile(r" depth (\d+)")
LINE = re.compile(r" pv (.+)$")
OTHER = re.compile(r" multipv (?!1 )\d+ ")


class Found(NamedTuple):
    """A search's last word, as the side to move sees it."""

    cp: int | None
    mate: int | None
    expected: float
    depth: int | None
    bound: str
    line: list[str]

    def turned(self) -> Found:
        """The same as the other side sees it."""
        minus = lambda x: None if x is None else -x
        return self._replace(cp=minus(self.cp), mate=minus(self.mate), expected=1 - self.expected)


class Engine:
    def __init__(self, command: list[str], options: dict[str, str] | None = None):
        self.process = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, bufsize=1)
        self.name = next((x.removeprefix("id name ") for x in self._ask("uci", "uciok") if x.startswith("id name ")), None)
        for key, value in (OPTIONS | (options or {})).items():
            self._say(f"setoption name {key} value {value}")
        self._ask("isready", "readyok")

    def _say(self, text: str) -> None:
        self.process.stdin.write(text + "\n")
        self.process.stdin.flush()

    def _ask(self, text: str, until: str) -> list[str]:
        self._say(text)
        out = []
        for line in self.process.stdout:
            if line.startswith(until):
                return out
            out.append(line.rstrip())
        raise RuntimeError(f"the engine ended while answering {text!r}")

    def search(self, board: Board, fen: str, moves: list[str], nodes: int) -> Found:
        if not board.legal():  # over: there is nothing to search
            lost = board.in_check()
            return Found(None if lost else 0, 0 if lost else None, 0.0 if lost else 0.5, 0, "exact", [])
        self._say("ucinewgame")
        self._say(f"position fen {fen}" + (f" moves {' '.join(moves)}" if moves else ""))
        said = [x for x in self._ask(f"go nodes {nodes}", "bestmove") if SCORE.search(x) and not OTHER.search(x)]
        if not said:
            raise RuntimeError(f"the engine gave no score for {fen} after {len(moves)} moves")
        kind, value, bound = SCORE.search(said[-1]).groups()
        wdl, depth, line = (p.search(said[-1]) for p in (WDL, DEPTH, LINE))
        if kind == "mate":
            expected = float(int(value) > 0)
        elif wdl:
            win, draw, _ = map(int, wdl.groups())
            expected = (win + draw / 2) / 1000
        else:
            raise RuntimeError("the engine reports no win-draw-loss estimates")
        number = int(value)
        return Found(number if kind == "cp" else None, number if kind == "mate" else None, expected, int(depth[1]) if depth else None, bound or "exact", line[1].split() if line else [])

    def close(self) -> None:
        try:
            self._say("quit")
            self.process.wait(5)
        except (OSError, subprocess.TimeoutExpired):
            self.process.kill()
        for pipe in (self.process.stdin, self.process.stdout):
            pipe.close()


def analysis(engine: Engine, row: dict, nodes: int) -> dict:
    """A row of ANALYSES; all scores are as the moving player sees them."""
    fen, history, move = row["initial_fen"], list(row["history"] or ()), row["move"]
    board = position_after(fen, tuple(history))
    if not board.is_legal(parse_uci(move)):
        raise ValueError(f"{row['decision_id']}: {move} is not legal")
    before = engine.search(board, fen, history, nodes)
    after = engine.search(board.play(parse_uci(move)), fen, [*history, move], nodes).turned()
    out = {"decision_id": row["decision_id"], "loss": before.expected - after.expected}
    for name, found in (("before", before), ("after", after)):
        out |= {f"{name}_cp": found.cp, f"{name}_mate": found.mate, f"{name}_expected": found.expected, f"{name}_pv": found.line, f"{name}_depth": found.depth, f"{name}_bound": found.bound}
    return out


def settings(path: str, options: dict[str, str] | None = None) -> dict:
    """What an analysis depends on besides the nodes."""
    used = OPTIONS | (options or {})
    return {"engine_sha256": sha256(Path(path).read_bytes()).hexdigest(), "threads": int(used["Threads"]), "hash_mib": int(used["Hash"]), "expected_score_model": "engine win-draw-loss"}


def scorer(command: list[str], *, workers: int | None = None, options: dict[str, str] | None = None) -> Callable[[DataFrame, dict], DataFrame]:
    """For ``stages.analyse``: a process per task, ``workers`` tasks (by default as many as
    the decisions' table has). The engine must be at the same path on every machine."""
    from pyspark.sql.pandas.types import to_arrow_schema

    def score(todo: DataFrame, config: dict) -> DataFrame:
        schema, nodes = to_arrow_schema(ANALYSES), config["nodes"]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            engine = None
            try:
                for batch in batches:
                    if batch.num_rows and engine is None:
                        engine = Engine(command, options)
                    for k in range(0, batch.num_rows, 32):
                        yield pa.RecordBatch.from_pylist([analysis(engine, r, nodes) for r in batch.slice(k, 32).to_pylist()], schema=schema)
            finally:
                if engine is not None:
                    engine.close()

        rows = todo.select("decision_id", "initial_fen", "history", "move")
        return (rows.repartition(workers, F.xxhash64("decision_id")) if workers else rows).mapInArrow(work, ANALYSES)

    return score
