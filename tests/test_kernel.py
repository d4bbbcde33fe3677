import random

import pytest

from plycraft.kernel.board import START_FEN, Board, Move, parse_uci, perft, position_after, square, uci
from plycraft.kernel.notation import Line, parse_san, read_game, san, write_game
from plycraft.operators import encoding
from plycraft.schemas import relation_names, trajectory_names

TINY = """[Event "First made-up game"]
[Site "?"]
[White "Somebody"]
[Black "Another"]
[Result "0-1"]

1. f3 e5 2. g4 Qh4# {Over at once.} 0-1

[Event "Second made-up game"]
[Site "?"]
[White "Another"]
[Black "Somebody"]
[Result "*"]

1. Nf3 d6 2. g3 *
"""

PERFT = [
    (START_FEN, 3, 8902),
    ("r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1", 2, 2039),
    ("8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - - 0 1", 3, 2812),
    ("r3k2r/Pppp1ppp/1b3nbN/nP6/BBP1P3/q4N2/Pp1P2PP/R2Q1RK1 w kq - 0 1", 2, 264),
    ("rnbq1k1r/pp1Pbppp/2p5/8/2B5/8/PPP1NnPP/RNBQK2R w KQ - 1 8", 2, 1486),
]


@pytest.mark.parametrize("fen,depth,nodes", PERFT)
def test_move_counts(fen, depth, nodes):
    assert perft(Board.from_fen(fen), depth) == nodes
    assert Board.from_fen(fen).fen() == fen


def line(fen, *moves):
    return position_after(fen, tuple(moves))


def test_passant_square_only_if_capture_is_legal():
    assert line(START_FEN, "e2e4").fen().split()[3] == "-"
    assert line(START_FEN, "e2e4", "a7a6", "e4e5", "d7d5").fen().split()[3] == "d6"


def test_endings():
    assert Board.from_fen("k7/2Q5/8/8/8/8/8/K7 b - - 0 1").outcome() == "stalemate"
    assert line("k7/8/1K6/8/8/8/8/2Q5 w - - 0 1", "c1c8").outcome() == "checkmate"
    for piece in ("1", "N", "B", "n"):
        assert Board.from_fen(f"8/2k5/8/8/{piece}7/5K2/8/8 w - - 0 1").outcome() == "insufficient_material"
    assert Board.from_fen("4k3/8/8/8/8/8/R7/4K3 w - - 99 70").outcome() is None
    assert line("4k3/8/8/8/8/8/R7/4K3 w - - 99 70", "a2a3").outcome() is None  # a draw that must be claimed
    assert line("4k3/8/8/8/8/8/R7/4K3 w - - 149 95", "a2a3").outcome() == "seventyfive_moves"
    shuffle = ["b1c3", "b8c6", "c3b1", "c6b8"]
    assert line(START_FEN, *shuffle * 3).outcome() is None
    assert line(START_FEN, *shuffle * 4).outcome() == "fivefold_repetition"


def test_illegal_history_is_an_error():
    with pytest.raises(ValueError):
        line(START_FEN, "d2d5")
    with pytest.raises(ValueError):
        parse_uci("e2e9")


def test_notation_round_trip():
    games = [read_game(t if t.startswith("[Event") else "[Event" + t) for t in TINY.split("\n\n[Event")]
    assert [len(g.moves) for g in games] == [4, 3] and not any(g.errors for g in games)
    for g in games:
        root: list[Line] = []
        at = root
        for m in g.moves:
            at.append(Line(m, "note"))
            at = at[0].next
        back = read_game(write_game(g.headers, g.start(), root, "first", g.result))
        assert back.moves == g.moves and back.result == g.result and not back.errors


def test_variations_comments_and_bad_moves():
    g = read_game('[Event "y"]\n\n1. c4 (1. g3 g6 (1... d5) 2. Bg2) 1... c5 $2 {b (c) d} 2. Nc3 ; until here\n Nf6 *')
    assert [uci(m) for m in g.moves] == ["c2c4", "c7c5", "b1c3", "g8f6"]
    bad = read_game('[Event "y"]\n\n1. c4 c5 2. Qd4 *')
    assert len(bad.moves) == 2 and bad.errors


def test_disambiguation_promotion_and_checks():
    b = Board.from_fen("2k5/8/8/8/8/4K3/8/R6R w - - 0 1")
    assert san(b, parse_uci("h1d1")) == "Rhd1" and parse_san(b, "Rad1") == parse_uci("a1d1")
    p = Board.from_fen("1k6/6P1/8/8/8/8/8/4K3 w - - 0 1")
    assert san(p, parse_uci("g7g8r")) == "g8=R+" and parse_san(p, "g8=R+") == Move(square("g7"), square("g8"), 4)
    c = Board.from_fen("r3k2r/7p/8/8/8/8/P7/R3K2R b KQkq - 0 1")
    assert san(c, parse_uci("e8c8")) == "O-O-O" and parse_san(c, "O-O") == parse_uci("e8g8")


# ---------------------------------------------------------------- encodings


def row(fen, move, before, after, history=()):
    return {"initial_fen": fen, "history": list(history), "move": move, "before_pv": before, "after_pv": after, "decision_id": "g:0"}


def value(vector, name, horizon=6):
    return vector[trajectory_names(horizon).index(name)]


def test_sizes():
    assert len(relation_names()) == 1710 and len(set(relation_names())) == 1710
    assert len(trajectory_names(6)) == 738 and len(trajectory_names(2)) == 246
    with pytest.raises(ValueError):
        trajectory_names(0)


ROOKS = "8/5k2/8/3r4/8/8/3R4/3K4 w - - 0 1"


def test_capture_is_encoded():
    e = encoding.episode_vector(row(ROOKS, "d2d5", ["d2d4"], ["f7e6"]), 1)
    assert e["available"] and e["informative"]
    assert value(e["vector"], "played_step_1_captures_mover_rook", 1) == 1
    assert value(e["vector"], "played_step_1_material_opponent_rook_delta", 1) == -1
    assert value(e["vector"], "preferred_step_1_captures_mover_rook", 1) == 0 and value(e["vector"], "difference_step_1_captures_mover_rook", 1) == 1
    two = encoding.episode_vector(row(ROOKS, "d2d4", ["d2d5", "f7e6"], ["d5d4"]), 2)["vector"]
    assert value(two, "played_step_2_captures_opponent_rook", 2) == 1 and value(two, "played_step_2_checks_opponent", 2) == 1


def mirror(fen):
    board, side, *rest = fen.split()
    return " ".join(["/".join(reversed(board.split("/"))).swapcase(), "b" if side == "w" else "w", *rest])


def flip(move):
    return move[0] + str(9 - int(move[1])) + move[2] + str(9 - int(move[3])) + move[4:]


def test_colour_mirror_invariance():
    lines = (["d2d4", "d5d4"], ["f7e6"])
    a = row(ROOKS, "d2d5", *lines)
    b = row(mirror(ROOKS), flip("d2d5"), *([flip(m) for m in x] for x in lines))
    assert encoding.episode_vector(a, 2) == encoding.episode_vector(b, 2)
    assert encoding.relation_counts(a) == encoding.relation_counts(b)


def test_lines_that_end_early():
    assert not encoding.episode_vector(row(START_FEN, "g1f3", ["b1c3"], ["g8f6"]))["available"]
    back_rank = "6k1/5ppp/8/8/8/8/8/K3R3 w - - 0 1"
    e = encoding.episode_vector(row(back_rank, "e1e8", ["e1e8"], []), 3)
    assert e["available"] and value(e["vector"], "played_step_1_terminal_mover_win", 3) == 1 and value(e["vector"], "played_step_1_checks_mover", 3) == 1
    p = encoding.episode_vector(row("8/1P4k1/8/8/8/8/6K1/8 w - - 0 1", "b7b8q", ["b7b8q", "g7f6"], ["g7f6"]), 2)
    assert value(p["vector"], "played_step_1_promotions_mover_to_queen", 2) == 1 and value(p["vector"], "played_step_1_material_mover_pawn_delta", 2) == -1
    d = encoding.episode_vector(row("5k2/8/8/8/8/2R5/8/2K5 w - - 99 80", "c3c4", ["c3c4", "f8e7"], ["f8e7"]), 2)
    assert d["available"] and value(d["vector"], "played_step_1_terminal_draw", 2) == 0


@pytest.mark.parametrize("move,before,after", [("g1f3", ["g1g5"], ["g8f6"]), ("g1f3", [], ["g8f6"]), ("g1f3", ["g1f3"], []), ("g1f3", None, ["g8f6"]), ("g1g5", ["g1f3"], ["g8f6"]), ("g1f3", ["g1f3"], ["g8f6", "z9"])])
def test_unplayable_lines_are_errors(move, before, after):
    with pytest.raises(ValueError):
        encoding.episode_vector(row(START_FEN, move, before, after))


def relation(fen, move, name):
    return encoding.relation_counts(row(fen, move, [], []))[relation_names().index(name)]


def test_relations_keep_identities():
    assert relation("4k3/8/8/8/8/8/8/R3K3 w Q - 0 1", "e1c1", "after_protect_4_6") == 1
    assert relation("3k4/7P/8/8/8/8/8/4K3 w - - 0 1", "h7h8q", "created_attack_1_6") == 1


def test_continuation_problems():
    assert encoding.pv_problem(row(START_FEN, "e2e4", ["d2d4"], ["e7e5"])) is None
    assert encoding.pv_problem(row(START_FEN, "e2e4", [], ["e7e5"])) == "missing_deep_pv"
    assert encoding.pv_problem(row(START_FEN, "e2e5", ["d2d4"], ["e7e5"])) == "illegal_played_move"
    assert encoding.pv_problem(row(START_FEN, "e2e4", ["d2d5"], ["e7e5"])) == "illegal_before_pv"
    assert encoding.pv_problem(row(START_FEN, "e2e4", ["d2d4"], ["zz"])) == "illegal_after_pv"
    assert encoding.pv_problem(row(START_FEN, "e2e4", ["d2d4"], [])) == "missing_deep_pv"


def test_context():
    c = encoding.broad_context(row(START_FEN, "e2e4", [], [], ["a2a3", "a7a6"]))
    assert c == {"opening_prefix": "a2a3 a7a6", "material_configuration": "8,2,2,2,1,8,2,2,2,1"}


def test_legal_moves_are_those_that_leave_the_king_safe():
    r = random.Random(3)
    for fen in (START_FEN, "r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1", "8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - - 0 1"):
        for _ in range(4):
            board = Board.from_fen(fen)
            while board.number < 15 and board.legal():
                assert board.legal() == tuple(m for m in board._pseudo() if board._safe(m))
                board = board.play(r.choice(board.legal()))


def no_lists(monkeypatch):
    """From here on, positions may be asked about moves, but not for the list of all."""
    position_after.cache_clear()
    monkeypatch.setattr(Board, "legal", lambda board: pytest.fail("a list of all moves"))


def test_relations_and_notation_make_no_list_of_all_moves(monkeypatch):
    r, games = random.Random(5), []
    for fen in (START_FEN, "r3k2r/Pppp1ppp/1b3nbN/nP6/BBP1P3/q4N2/Pp1P2PP/R2Q1RK1 w kq - 0 1", "8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - - 0 1"):
        board, history = Board.from_fen(fen), ()
        while len(history) < 12 and board.legal():
            move = r.choice(board.legal())
            takes = {(m.source, m.target - 8 * board.turn if board.is_passant(m) else m.target) for m in board.legal() if board.is_capture(m)}
            games.append((fen, history, move, board.fen(), set(board.legal()), takes))
            history, board = (*history, uci(move)), board.play(move)
    no_lists(monkeypatch)
    anything = [Move(s, t, k) for s in range(64) for t in range(64) for k in range(7)]
    for fen, history, move, now, legal, takes in games:
        board = Board.from_fen(now)
        assert {m for m in anything if board.is_legal(m)} == legal == set(board.moves()) and parse_san(board, san(board, move)) == move
        found = encoding.relations(board, board.turn, encoding.np.arange(64))
        assert {(int(x) >> 6 & 63, int(x) & 63) for x in found if x >> 12 == encoding.CAPTURE} == takes
        assert len(encoding.relation_counts(row(fen, uci(move), None, None, history))) == 1710


def test_events_make_no_list_of_all_moves(monkeypatch):
    no_lists(monkeypatch)
    e = encoding.episode_vector(row(ROOKS, "d2d4", ["d2d5", "f7e6"], ["d5d4"]), 2)
    assert e["available"] and value(e["vector"], "played_step_2_captures_opponent_rook", 2) == 1 and value(e["vector"], "difference_step_1_captures_mover_rook", 2) == -1
    mate = encoding.episode_vector(row("6k1/5ppp/8/8/8/8/8/K3R3 w - - 0 1", "e1e8", ["e1e8"], []), 3)
    assert mate["available"] and value(mate["vector"], "played_step_1_terminal_mover_win", 3) == 1
    assert encoding.pv_problem(row(START_FEN, "g1f3", ["b1c3", "g8g5"], ["g8f6"])) == "illegal_before_pv"
