"""Text for readers: annotated games, review packets, reports and plot-ready tables."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from ..kernel.board import Board, parse_uci
from ..kernel.notation import Line, write_game


def _chain(board: Board, tokens, comment: str = "") -> list[Line]:
    """A line of moves as nested continuations; it stops before the first illegal one."""
    first: list[Line] = []
    at = first
    for n, token in enumerate(tokens):
        move = parse_uci(token)
        if not board.is_legal(move):
            break
        node = Line(move, comment if n == 0 else "")
        at.append(node)
        at, board = node.next, board.play(move)
    return first


def annotated_game(row: dict, comment: str, played: list[str], preferred: list[str], labels: tuple[str, str] = ("Played", "Preferred"), annotator: str = "plycraft") -> str:
    """The game up to a decision, a comment there, and both continuations."""
    start = Board.from_fen(row["initial_fen"])
    board, history = start, list(row["history"])
    for token in history:
        board = board.play(parse_uci(token))
    options = _chain(board, played, labels[0]) + _chain(board, preferred, labels[1])
    roots = options
    if history:
        roots = _chain(start, history)
        node = roots[0]
        while node.next:
            node = node.next[0]
        node.comment, node.next = comment, options
        comment = ""
    return write_game({"Site": row["game_id"], "Annotator": annotator}, start, roots, comment)


def episode_game(row: dict, label: str) -> str:
    said = f"{label}; episode={row['decision_id']}; as the moving player sees it; before cp={row['before_cp']} mate={row['before_mate']}; after cp={row['after_cp']} mate={row['after_mate']}; loss={row['loss']:.4f}"
    return annotated_game(row, said, [row["move"], *row["after_pv"]], list(row["before_pv"]))


def packet_markdown(packet: dict, model: dict) -> str:
    groups = {g["cluster_id"]: g for g in model["clusters"]}
    out = [f"# Review of {packet['partition']} clusters", "", f"Artifact {packet['clusters']}; {packet['rejected']} episodes rejected.", ""]
    for p in packet["packets"]:
        g = groups[p["cluster_id"]]
        out += [f"## {p['cluster_id']}", "", f"Support {g['support']}, players {g['unique_players']}, positions {g['unique_positions']}, radius {g['radius']:.4f}.", ""]
        for e in p["examples"]:
            out += [f"- {e['decision_id']} at distance {e['distance']:.4f}, loss {e['loss']:.4f}: `{e['fen']}`", f"  - played {e['variations']['played']}", f"  - preferred {e['variations']['preferred']}"]
            if e.get("description"):
                out.append(f"  - described as: {e['description']['raw_explanation']}")
        out.append("")
    return "\n".join(out)


def _n(x, digits: int = 3) -> str:
    return "n/a" if x is None else f"{x:.{digits}f}"


def _ci(ci) -> str:
    return "n/a" if not ci else f"{ci[0]:.3f} to {ci[1]:.3f}"


def measurement_markdown(result: dict) -> str:
    out = ["# Measurement on the evaluation part", "", f"Taxonomy {result['taxonomy_id']}; {result['bootstrap']} player-bootstrap replicates; denominator: {result['denominator']}.", "", "## Coverage", "", "| band | decisions | players | qualifying | per 100 | interval | cost per 100 | interval | classified | sparse |", "|-|-|-|-|-|-|-|-|-|-|"]
    for c in result["coverage"]:
        out.append(f"| {c['band']} | {c['decisions']} | {c['players']} | {c['qualifying_mistakes']} | {_n(c['qualifying_incidents_per_100_decisions'])} | {_ci(c['qualifying_rate_ci'])} | {_n(c['qualifying_cost_per_100_decisions'])} | {_ci(c['qualifying_cost_ci'])} | {c['classified']} | {'yes' if c['sparse'] else 'no'} |")
    if not result["families"]:
        out += ["", "No family was accepted: every qualifying decision stays unclassified."]
    for f in result["families"]:
        out += ["", f"## {f['name']} ({f['family_id']})", "", "| band | incidents | per 100 | interval | cost per 100 | interval | share | players | sparse |", "|-|-|-|-|-|-|-|-|-|"]
        for b in f["bands"]:
            out.append(f"| {b['band']} | {b['incidents']} | {_n(b['incidents_per_100_decisions'])} | {_ci(b['rate_ci'])} | {_n(b['cost_per_100_decisions'])} | {_ci(b['cost_ci'])} | {_n(b['qualifying_mistake_share'])} | {b['unique_players']} | {'yes' if b['sparse'] else 'no'} |")
        out += ["", *[f"- {s['from']} to {s['to']}: cost falls by {_n(s['absolute_cost_reduction'])} ({_ci(s['absolute_reduction_ci'])}), relatively {_n(s['relative_cost_reduction'])}" for s in f["adjacent_changes"]]]
    if result["stability"]:
        s = result["stability"]
        out += ["", "## Stability", "", f"{s['confirmed']} of {s['baseline_candidates']} screened decisions confirmed; rejected: {s['rejections']}."]
    return "\n".join([*out, "", "Associations with rating show neither learning nor teachability.", ""])


def error_bars(result: dict) -> list[dict]:
    """Cost per band with interval, as points and whiskers for any plotting tool."""
    return [{"family_id": f["family_id"], "band": b["band"], "cost": b["cost_per_100_decisions"], "low": b["cost_ci"][0] if b["cost_ci"] else None, "high": b["cost_ci"][1] if b["cost_ci"] else None} for f in result["families"] for b in f["bands"]]


def png(pixels: np.ndarray) -> bytes:
    """A grey image, rows by columns, as PNG."""
    rows, columns = pixels.shape
    body = b"".join(b"\0" + line.tobytes() for line in pixels.astype(np.uint8))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", columns, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def error_bar_image(bars: list[dict], rows: int = 240, columns: int = 400, margin: int = 20) -> np.ndarray:
    """A family's points and whiskers over its bands, left to right, from zero up; the frame's
    ticks are bands and quarters of the highest value."""
    image = np.full((rows, columns), 255, np.uint8)
    image[margin : rows - margin, margin] = image[rows - margin, margin : columns - margin] = 0
    top = max([x for b in bars for x in (b["cost"], b["high"]) if x is not None], default=0) or 1
    at = lambda value: rows - margin - round((rows - 2 * margin) * value / top)
    for k in range(5):
        image[at(top * k / 4), margin - 4 : margin] = 0
    for n, b in enumerate(bars):
        x = margin + round((columns - 2 * margin) * (n + 0.5) / len(bars))
        image[rows - margin : rows - margin + 4, x] = 0
        if b["low"] is not None:
            image[at(b["high"]) : at(b["low"]) + 1, x] = 96
            image[[at(b["high"]), at(b["low"])], x - 4 : x + 5] = 96
        if b["cost"] is not None:
            image[max(at(b["cost"]) - 2, 0) : at(b["cost"]) + 3, x - 2 : x + 3] = 0
    return image


def findings_markdown(findings: dict, config: dict, examples: dict[str, list[dict]]) -> str:
    low, high = config["cohort"]
    met = sum(bool(c["supported"]) for c in findings["candidates"])
    out = ["# Symbolic discovery report", "", f"Sample: {config['sampled']} decisions from {config['scanned_games']} games; seed {config['seed']}; cohort {low}–{high}; at most {config['player_cap']} decisions a player.", "", f"Partitions after position exclusion: {findings['partitions']}.", "", findings["target"] + ". Mates stay separate from centipawns.", "", findings["conclusion"], "", f"{met} of {len(findings['candidates'])} candidates met every planned threshold.", ""]
    for c in findings["candidates"]:
        out += [f"## {c['name']}", "", f"Rule: `{c['rule']}`", "", *[f"- {p}: {c[p]}" for p in ("discovery", "selection", "evaluation")], f"- thresholds met: {c['supported']}", ""]
        out += [f"- {e['decision_id']}: loss {e['original_loss']:.4f}, deeper {e['deep_loss']:.4f}" for e in examples.get(str(c["id"]), [])] + [""]
    return "\n".join(out)


def symbolic_report(run, scorer, *, nodes: int = 1_000_000, settings: dict | None = None) -> dict:
    """Deeper scores of the candidates' examples, their sensitivity, annotated games and the
    report."""
    from pyspark.sql import functions as F

    from ..operators import gates
    from . import stages

    findings, config = run.json("findings.json"), run.json("config.json")
    of = {str(c["id"]): list(dict.fromkeys(c["examples"] + c["counterexamples"])) for c in findings["candidates"]}
    wanted = run.spark.createDataFrame([(i,) for ids in of.values() for i in ids], "decision_id string").distinct()
    rows: list[dict] = []
    games: list[str] = []
    if any(of.values()):
        name = stages.analyse(run, scorer, nodes=nodes, ids=wanted, settings=settings)
        deep = stages.analyses(run, name).join(wanted, "decision_id", "left_semi")
        delta = {r["decision_id"]: r.asDict() for r in gates.audit_delta(stages.analyses(run), deep, 0.0).collect()}  # a dozen examples a rule
        full = {r["decision_id"]: r.asDict() for r in run.table("decisions").join(deep, "decision_id").select("*", F.lit(0).alias("_")).collect()}
        for rule, ids in of.items():
            for i in ids:
                r = full[i]
                rows.append({"candidate": int(rule)} | {k: delta[i][k] for k in ("decision_id", "original_loss", "deep_loss", "delta")})
                games.append(annotated_game(r, f"Rule {rule}; rating {r['rating']}; before cp={r['before_cp']} mate={r['before_mate']}", [r["move"]], list(r["before_pv"]), (f"Loss {r['loss']:.4f}; after cp={r['after_cp']} mate={r['after_mate']}", "Preferred")))
    by = {rule: [r for r in rows if str(r["candidate"]) == rule] for rule in of}
    run.write_text("report.md", findings_markdown(findings, config, by))
    run.write_text("examples.pgn", "\n\n".join(games))
    run.write_json("sensitivity.json", rows)
    run.write_json("report.complete.json", {"examples": len(games)})
    return {"examples": len(games), "sensitivity": rows}
