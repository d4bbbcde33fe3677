"""Standard algebraic notation, and games in portable notation: reading and writing."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .board import KING, LETTERS, PAWN, START_FEN, Board, Move, square, square_name

_SAN = re.compile(r"^([NBRQK])?([a-h])?([1-8])?x?([a-h][1-8])(?:=?([NBRQ]))?[+#]*[!?]*$")
_TOKEN = re.compile(r"\{[^}]*\}?|;[^\n]*|\(|\)|\$\d+|\d+\.(?:\.\.)?|\.\.\.|1-0|0-1|1/2-1/2|\*|[^\s{}();]+")
_HEADER = re.compile(r'^\[(\w+)\s+"((?:[^"\\]|\\.)*)"\]\s*$')
RESULTS = ("1-0", "0-1", "1/2-1/2", "*")


def san(board: Board, move: Move) -> str:
    kind = abs(board.cells[move.source])
    if board.is_castling(move):
        out = "O-O" if move.target > move.source else "O-O-O"
    else:
        takes, to = board.is_capture(move), square_name(move.target)
        if kind == PAWN:
            out = (square_name(move.source)[0] + "x" if takes else "") + to
        else:
            rivals = [m for s, p in enumerate(board.cells) if p == board.cells[move.source] and s != move.source and board.is_legal(m := Move(s, move.target))]
            mark = ""
            if rivals:
                name = square_name(move.source)
                same_file = any(square_name(m.source)[0] == name[0] for m in rivals)
                same_rank = any(square_name(m.source)[1] == name[1] for m in rivals)
                mark = name[0] if not same_file else name[1] if not same_rank else name
            out = LETTERS[kind].upper() + mark + ("x" if takes else "") + to
        if move.promotion:
            out += "=" + LETTERS[move.promotion].upper()
    after = board.play(move)
    return out + ("" if not after.in_check() else "+" if next(after.moves(), None) else "#")


def parse_san(board: Board, text: str) -> Move:
    """The one legal move that the text names."""
    plain = text.rstrip("+#!?").replace("0", "O") if text[:1] in "O0" else text
    if plain in ("O-O", "O-O-O"):
        fits = [m for m in board.legal() if board.is_castling(m) and (m.target > m.source) == (plain == "O-O")]
    else:
        found = _SAN.match(text)
        if not found:
            raise ValueError(f"not a move: {text!r}")
        piece, file, rank, to, promotion = found.groups()
        kind = LETTERS.index(piece.lower()) if piece else PAWN
        target, want = square(to), LETTERS.index(promotion.lower()) if promotion else 0
        fits = [
            m for s, p in enumerate(board.cells)
            if p == board.turn * kind and (not file or square_name(s)[0] == file) and (not rank or square_name(s)[1] == rank) and board.is_legal(m := Move(s, target, want)) and not (kind == KING and board.is_castling(m))
        ]
    if len(fits) != 1:
        raise ValueError(f"{'ambiguous' if fits else 'illegal'} move: {text!r}")
    return fits[0]


@dataclass
class Game:
    headers: dict[str, str] = field(default_factory=dict)
    moves: list[Move] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    result: str = "*"

    def start(self) -> Board:
        return Board.from_fen(self.headers.get("FEN", START_FEN))


def read_game(text: str) -> Game:
    """One game: headers, then the main line. Comments, variations and annotations are
    passed over; the first move that cannot be read ends the line and is noted."""
    game, body, in_head = Game(), [], True
    for line in text.replace("\r", "").split("\n"):
        found = _HEADER.match(line) if in_head else None
        if found:
            game.headers[found[1]] = re.sub(r"\\(.)", r"\1", found[2])
        elif line.strip() or body:
            in_head = False
            if not line.startswith("%"):
                body.append(line)
    try:
        board = game.start()
    except (ValueError, IndexError) as e:
        game.errors.append(f"bad starting position: {e}")
        return game
    depth = 0
    for token in _TOKEN.findall("\n".join(body)):
        if token[0] in "{;$" or token == "..." or re.fullmatch(r"\d+\.(?:\.\.)?", token) or re.fullmatch(r"[!?]+", token):
            continue
        if token in "()":
            depth = max(0, depth + (1 if token == "(" else -1))
        elif depth:
            continue
        elif token in RESULTS:
            game.result = token
            break
        else:
            try:
                move = parse_san(board, token)
            except ValueError as e:
                game.errors.append(str(e))
                break
            game.moves.append(move)
            board = board.play(move)
    return game


@dataclass
class Line:
    """A move with a comment and what may follow: the first continuation is the main one."""

    move: Move
    comment: str = ""
    next: list[Line] = field(default_factory=list)


def write_game(headers: dict[str, str], start: Board, roots: list[Line], comment: str = "", result: str = "*") -> str:
    """Portable notation of a tree of moves, with comments and variations."""
    head = {"Event": "?", "Site": "?", "Date": "????.??.??", "Round": "?", "White": "?", "Black": "?", "Result": result} | headers
    if start.fen() != START_FEN:
        head |= {"SetUp": "1", "FEN": start.fen()}
    words: list[str] = [f"{{ {comment} }}"] if comment else []

    def number(board: Board, force: bool) -> list[str]:
        return [f"{board.number}."] if board.turn > 0 else [f"{board.number}..."] if force else []

    def emit(board: Board, options: list[Line], force: bool) -> None:
        if not options:
            return
        main, *others = options
        words.extend([*number(board, force), san(board, main.move)])
        if main.comment:
            words.append(f"{{ {main.comment.replace('}', ')')} }}")
        for other in others:
            words.append("(")
            emit(board, [other], True)
            words.append(")")
        emit(board.play(main.move), main.next, bool(main.comment or others))

    emit(start, roots, True)
    lines, now = [], ""
    for w in [*words, result]:
        if len(now) + len(w) + 1 > 80:
            lines.append(now)
            now = w
        else:
            now = f"{now} {w}".strip()
    escape = lambda v: v.replace("\\", "\\\\").replace('"', '\\"')
    return "\n".join(f'[{k} "{escape(v)}"]' for k, v in head.items()) + "\n\n" + "\n".join([*lines, now]).replace("( ", "(").replace(" )", ")") + "\n"
