"""Kernel operators over (initial position, history): continuations, event vectors, relation
counts, evidence packets and context.

Everything starts from a ``Trail``, the positions that a list of moves runs through. What
happens in a trail is read off its positions as arrays: a piece that one side loses was
captured, a new knight to queen was promoted, so event vectors are differences of material
matrices. Relations are numbers (relation, who, whom), phases are set operations on them, and
counts are histograms. Rows are independent: an operator reads its few columns of an Arrow
batch and passes the others through untouched; a worker keeps recently replayed positions.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import combinations_with_replacement
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..kernel.board import Board, Move, parse_uci, played, position_after
from ..kernel.notation import san
from ..schemas import OUTCOMES, PHASES, RELATIONS

# ---------------------------------------------------------------- trails


class Trail(NamedTuple):
    """``boards[i]`` is the position before ``moves[i]``; ``fault`` is the first token that is
    no legal move, where the trail ends."""

    boards: list[Board]
    moves: list[Move]
    fault: str | None

    def sound(self, what: str) -> Trail:
        if self.fault is not None:
            raise ValueError(f"{what}: {self.fault!r} is not legal after {len(self.moves)} moves")
        return self

    def notation(self, most: int | None = None) -> list[str]:
        return [san(b, m) for b, m in zip(self.boards, self.moves[:most], strict=False)]


def follow(board: Board, tokens) -> Trail:
    boards, moves = [board], []
    for token in tokens:
        try:
            move = parse_uci(token)
        except ValueError:
            return Trail(boards, moves, token)
        if not boards[-1].is_legal(move):
            return Trail(boards, moves, token)
        moves.append(move)
        boards.append(boards[-1].play(move))
    return Trail(boards, moves, None)


def start_of(row) -> Board:
    return position_after(row["initial_fen"], tuple(row["history"] or ()))


# ---------------------------------------------------------------- event vectors

#: A step has 19 counts for each actor (material 6, checks, captures 6, promotions 6) and the outcomes.
MATERIAL, CHECKS, CAPTURES, PROMOTIONS, ACTOR = slice(0, 6), 6, slice(7, 13), slice(13, 19), 19
STEP = 2 * ACTOR + len(OUTCOMES)
#: Pieces of the mover, pawn to king, and of the other side.
KINDS = np.array([*range(1, 7), *range(-1, -7, -1)], np.int8)


def result_slot(board: Board, mover: int) -> int | None:
    """Which outcome a position is for the mover; None while play goes on."""
    how = board.outcome()
    return None if how is None else 2 * ACTOR + OUTCOMES.index("draw" if how != "checkmate" else "mover_loss" if board.turn == mover else "mover_win")


def events(trail: Trail, horizon: int) -> tuple[np.ndarray, bool]:
    """Counts of the first ``horizon`` steps, one row a step, and whether the trail fills
    them: it is long enough, or the game has ended by itself. Nothing happens after that."""
    mover = trail.boards[0].turn
    ends = ((i, s) for i, b in enumerate(trail.boards[: horizon + 1]) if (s := result_slot(b, mover)) is not None)
    end, slot = next(ends, (None, None))
    n = min(len(trail.moves), horizon) if end is None else end
    cells = np.array([b.cells for b in trail.boards[: n + 1]], np.int8)
    pieces = np.count_nonzero(cells[:, None] == (mover * KINDS)[:, None], axis=2).reshape(n + 1, 2, 6)
    change = np.diff(pieces, axis=0)  # step, side, kind
    acts = np.arange(n)[:, None] % 2 == (0, 1)
    out, own = np.zeros((horizon, STEP)), np.zeros((horizon, 2, ACTOR))
    own[:n, :, MATERIAL] = change
    own[:n, :, CAPTURES] = np.maximum(-change[:, ::-1], 0) * acts[:, :, None]
    own[:n, :, PROMOTIONS] = np.maximum(change, 0) * acts[:, :, None]
    own[:n, :, CHECKS] = acts & np.array([b.in_check() for b in trail.boards[1 : n + 1]], bool)[:, None]
    out[:, : 2 * ACTOR] = own.reshape(horizon, 2 * ACTOR)
    if slot is not None:
        out[max(end - 1, 0), slot] = 1
    return out, slot is not None or len(trail.moves) >= horizon


def episode_vector(row, horizon: int = 6) -> dict:
    """vector, available, informative: events of the played line, of the preferred one, and
    their difference. An episode whose lines do not fill the horizon has no vector; one
    without lines, or with lines that cannot be played, is an error."""
    found = episode_array(row, horizon)
    return found | {"vector": found["vector"].tolist()}


def episode_array(row, horizon: int = 6) -> dict:
    """``episode_vector`` with its vector as an array, which Arrow takes at once."""
    if horizon < 1:
        raise ValueError("the horizon has at least one step")
    if row["before_pv"] is None or row["after_pv"] is None or not len(row["before_pv"]):
        raise ValueError("an episode needs its preferred line and its answer")
    board = start_of(row)
    preferred = follow(board, row["before_pv"]).sound("preferred line")
    played = follow(board, [row["move"], *row["after_pv"]]).sound("played line")
    if len(played.moves) == 1 and not played.boards[1].over():
        raise ValueError("an episode needs an answer to the played move unless that ends the game")
    (mine, full), (best, both) = events(played, horizon), events(preferred, horizon)
    if not (full and both):
        return {"vector": np.zeros(0), "available": False, "informative": False}
    vector = np.concatenate([mine, best, mine - best]).ravel()
    return {"vector": vector, "available": True, "informative": bool(vector.any())}


#: The names of what can be wrong with continuations.
NO_LINE, BAD_MOVE, BAD_LINE = "missing_deep_pv", "illegal_played_move", {"before": "illegal_before_pv", "after": "illegal_after_pv"}


def pv_problem(row) -> str | None:
    """What is wrong with a row's continuations, or nothing."""
    board, before, after = start_of(row), list(row["before_pv"] or ()), list(row["after_pv"] or ())
    played = follow(board, [row["move"], *after])
    if not before:
        return NO_LINE
    if not played.moves:
        return BAD_MOVE
    if not after and not played.boards[1].over():
        return NO_LINE
    if follow(board, before).fault is not None:
        return BAD_LINE["before"]
    return BAD_LINE["after"] if played.fault is not None else None


# ---------------------------------------------------------------- relations

ATTACK, PROTECT, ENEMY, CAPTURE = RELATIONS.index("attack"), RELATIONS.index("protect"), RELATIONS.index("enemy_attack"), RELATIONS.index("capture_own")
PAIRS = list(combinations_with_replacement(range(len(RELATIONS)), 2))
FIRST, SECOND = np.array(PAIRS).T
SELF = FIRST == SECOND


@lru_cache(maxsize=64)
def _links(board: Board) -> tuple[np.ndarray, int]:
    """Pairs of squares, one a row: who reaches whom, then who can take whom; and how many
    are the former. The position after a move is that before the next one."""
    cells, side = board.cells, board.turn
    reach = [(s, t) for s, p in enumerate(cells) if p for t in board.attacks(s) if cells[t]]
    takes = [(s, t) for s, t in reach if cells[s] * side > 0 > cells[t] * side and board.keeps_king(Move(s, t))]
    passing = [(m.source, m.target - 8 * side) for m in board.passants()]
    return np.array(reach + takes + passing, np.int64).reshape(-1, 2), len(reach)


def relations(board: Board, color: int, own: np.ndarray) -> np.ndarray:
    """Distinct relations of a position as ``color`` sees it, each (relation * 64 + who) * 64
    + whom. ``own[s]``: the square on which the piece on s is known."""
    cells = np.array(board.cells)
    links, n = _links(board)
    who, whom = links.T
    kind = np.where(cells[who] * cells[whom] > 0, PROTECT, ATTACK) + np.where(cells[who] * color > 0, 0, ENEMY)
    kind[n:] = CAPTURE + (board.turn != color)
    return np.unique((kind * 64 + own[who]) * 64 + own[whom])


def _histograms(phases: list[np.ndarray], piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each phase, counts by relation and kinds of both pieces; targets by pair of
    relations on them and their kind (a relation pairs with itself where two pieces have it)."""
    m, n = len(phases), len(RELATIONS)
    found, phase = np.concatenate(phases), np.repeat(np.arange(m), [len(p) for p in phases])
    relation, who, whom = phase * n + (found >> 12), (found >> 6) & 63, found & 63
    single = np.bincount((relation * 6 + piece[who] - 1) * 6 + piece[whom] - 1, minlength=m * n * 36)
    on = np.bincount(relation * 64 + whom, minlength=m * n * 64).reshape(m, n, 64)
    some, several = on > 0, on > 1
    both = np.where(SELF[:, None], several[:, FIRST], some[:, FIRST] & some[:, SECOND])
    target = np.eye(7)[piece][:, 1:]  # square, kind
    return single, (both @ target).astype(np.int64).ravel()


def relation_counts(row) -> list[int]:
    """Counts in the order of ``relation_names``. Pieces are known by the squares, and are of
    the kinds, that they have before the move; a castling rook stays itself."""
    return relation_array(row).tolist()


def relation_array(row) -> np.ndarray:
    """``relation_counts`` as an array, which Arrow takes at once."""
    board, move = start_of(row), parse_uci(row["move"])
    piece, own = np.abs(np.array(board.cells)), np.arange(64)
    later = own.copy()
    later[move.target] = move.source
    if board.is_castling(move):
        short, home = move.target > move.source, move.source & ~7
        later[home + (5 if short else 3)] = home + (7 if short else 0)
    old, new = relations(board, board.turn, own), relations(played(board, move), board.turn, later)
    seen = np.zeros((2, len(RELATIONS) * 64 * 64), bool)
    seen[0, old] = seen[1, new] = True
    stays, known = seen[1, old], seen[0, new]
    phase = {"before": old, "after": new, "created": new[~known], "removed": old[~stays], "retained": old[stays]}
    return np.concatenate(_histograms([phase[p] for p in PHASES], piece)).astype(np.int32)


# ---------------------------------------------------------------- evidence and context


def canonical(value) -> str:
    """SHA-256 of compact JSON with sorted keys; numbers that JSON lacks are an error."""
    return sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()).hexdigest()


SIDES = {1: "White", -1: "Black"}
SCORES = ("before_cp", "before_mate", "after_cp", "after_mate")


def packet(row) -> dict:
    """What a describer may see of an episode (no player, rating or game), and its fingerprint."""
    board, lines = start_of(row), {"played": [row["move"], *row["after_pv"]], "preferred": list(row["before_pv"])}
    shown = {"decision_id": row["decision_id"], "fen": board.fen(), "side": SIDES[board.turn], "human_uci": row["move"], "preferred_uci": row["preferred_move"], "loss": float(row["loss"])}
    shown |= {k: None if row[k] is None else int(row[k]) for k in SCORES}
    for name, line in lines.items():
        if not line:
            raise ValueError(f"{row['decision_id']} has no {name} line")
        shown |= {f"{name}_pv": line, f"{name}_san": follow(board, line).sound(f"{name} line").notation()}
    shown["human_san"] = shown["played_san"][0]
    return shown | {"episode_sha256": canonical(shown)}


def broad_context(row) -> dict:
    """Opening prefix (six moves) and material, own side first: for concentration flags."""
    board = start_of(row)
    return {"opening_prefix": " ".join(row["history"][:6]), "material_configuration": ",".join(str(n) for side in (board.turn, -board.turn) for n in board.material(side)[:5])}


def scene(row) -> dict:
    """Side to move, full position, and whether the game was or became over."""
    board, after = follow(start_of(row), [row["move"]]).sound("played move").boards
    return {"side": SIDES[board.turn], "before_fen": board.fen(), "before_terminal": board.over(), "after_terminal": after.over()}


# ---------------------------------------------------------------- tables

PLACE = ("initial_fen", "history")
LINES = (*PLACE, "move", "before_pv", "after_pv")


def kernel_map(rows: DataFrame, work: Callable[[dict], dict], columns: str, needs: tuple[str, ...] = LINES) -> DataFrame:
    """``rows`` with what ``work`` makes of the columns ``needs`` of each row; ``columns``
    declares the new ones. An error of the kernel fails the query, as it should."""
    from pyspark.sql.pandas.types import to_arrow_type

    made = T.StructType.fromDDL(columns)
    kinds = [to_arrow_type(f.dataType) for f in made]
    names = [*rows.columns, *made.fieldNames()]
    at = {c: rows.columns.index(c) for c in needs}

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = zip(*(batch.column(i).to_pylist() for i in at.values()), strict=True)
            found = [work(dict(zip(at, values, strict=True))) for values in given]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x[n] for x in found], k) for n, k in zip(made.fieldNames(), kinds, strict=True))], names=names)

    return rows.mapInArrow(apply, T.StructType([*rows.schema.fields, *made.fields]))


def encode_episodes(joined: DataFrame, horizon: int = 6) -> DataFrame:
    return kernel_map(joined, lambda r: episode_array(r, horizon), "vector array<double>, available boolean, informative boolean")


def relation_features(decisions: DataFrame) -> DataFrame:
    return kernel_map(decisions.select("decision_id", *PLACE, "move"), lambda r: {"feats": relation_array(r)}, "feats array<int>", (*PLACE, "move")).select("decision_id", "feats")


def with_pv_problem(joined: DataFrame) -> DataFrame:
    return kernel_map(joined, lambda r: {"pv_problem": pv_problem(r)}, "pv_problem string")


def with_scene(rows: DataFrame) -> DataFrame:
    return kernel_map(rows, scene, "side string, before_fen string, before_terminal boolean, after_terminal boolean", (*PLACE, "move"))


def with_context(rows: DataFrame) -> DataFrame:
    return kernel_map(rows, broad_context, "opening_prefix string, material_configuration string", PLACE)


def with_packet(rows: DataFrame) -> DataFrame:
    """``rows`` with their evidence packet as JSON."""
    return kernel_map(rows, lambda r: {"packet": json.dumps(packet(r), ensure_ascii=False, allow_nan=False)}, "packet string", (*LINES, "decision_id", "preferred_move", "loss", *SCORES))


def packets(rows: DataFrame) -> DataFrame:
    """decision_id, packet (JSON): in order of id when it is written."""
    return with_packet(rows).select("decision_id", "packet")
