import json
import random

import pandas as pd
import pytest
import zstandard
from pyspark.sql import functions as F

from plycraft.kernel.board import START_FEN, Board, position_after, uci
from plycraft.kernel.notation import Line, write_game
from plycraft.plans import report, stages, taxonomy
from plycraft.plans.artifacts import Run, fingerprint
from plycraft.schemas import ANALYSES
from plycraft.sources import archive
from tests.test_kernel import TINY


def random_game(i, plies=24):
    r, board, root = random.Random(i), Board.from_fen(START_FEN), []
    at = root
    for _ in range(plies):
        if not board.legal():
            break
        m = r.choice(board.legal())
        at.append(Line(m))
        at, board = at[0].next, board.play(m)
    heads = {"Event": "Rated Rapid game", "Site": f"https://games/{i:05d}", "White": f"W{i % 40}", "Black": f"B{i % 37}", "WhiteElo": str(410 + (i * 53) % 390), "BlackElo": str(410 + (i * 31) % 390)}
    return write_game(heads, Board.from_fen(START_FEN), root)


def walk(board, seed, n):
    r, out = random.Random(seed), []
    for _ in range(n):
        if not board.legal():
            break
        m = r.choice(board.legal())
        out.append(uci(m))
        board = board.play(m)
    return out


def score(todo, config):
    """Stands in for an engine: legal lines and scores that depend on the decision alone."""

    def work(frames):
        for pdf in frames:
            rows = []
            for r in pdf.to_dict("records"):
                board = position_after(r["initial_fen"], tuple(r["history"]))
                others = [m for m in board.legal() if uci(m) != r["move"]] or list(board.legal())
                best = random.Random(r["decision_id"]).choice(others)
                played = board.play(next(m for m in board.legal() if uci(m) == r["move"]))
                loss = random.Random(r["decision_id"] + "x").choice([0.05, 0.2, 0.5, 0.6])
                rows.append((r["decision_id"], 100, None, -50, None, 0.9, 0.9 - loss, 0.9 - (0.9 - loss), [uci(best), *walk(board.play(best), r["decision_id"], 7)], walk(played, r["decision_id"], 7), 20, 20, "exact", "exact"))
            yield pd.DataFrame(rows, columns=ANALYSES.fieldNames())

    return todo.mapInPandas(work, ANALYSES)


@pytest.fixture(scope="module")
def games(tmp_path_factory):
    path = tmp_path_factory.mktemp("archive") / "games.pgn"
    path.write_text("\n\n".join(random_game(i).strip() for i in range(120)) + "\n")
    return path


@pytest.fixture(scope="module")
def run(spark, games, tmp_path_factory):
    run = Run(spark, tmp_path_factory.mktemp("run"))
    stages.sample(run, str(games), count=600, seed=7)
    stages.analyse(run, score)
    return run


def test_fixture_archive(spark, tmp_path):
    (tmp_path / "t.pgn").write_text(TINY)
    (tmp_path / "t.pgn.zst").write_bytes(zstandard.ZstdCompressor().compress(TINY.replace("\n", "\r\n").encode()))
    for name in ("t.pgn", "t.pgn.zst"):
        games = archive.scan(spark, str(tmp_path / name))
        assert [r[0] for r in games.orderBy("game_ordinal").select("game_ordinal").collect()] == [1, 2]
        rows = archive.candidates(games, seed=1, fixture=True).collect()
        assert len(rows) == 7 and {r["rating"] for r in rows} == {600} and {r["game_id"] for r in rows} == {"fixture-1", "fixture-2"}
        assert all(list(r["history"]) == [] for r in rows if r["ply"] == 0)


def test_blocks_of_a_large_archive_keep_order(spark, games):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = archive.scan(spark, str(games)).orderBy("game_ordinal").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["game_ordinal"] for r in got] == list(range(1, 121))
    assert all(f"games/{i:05d}" in r["text"] for i, r in enumerate(got))


def test_eligibility(spark, tmp_path):
    def one(event="Rated Rapid game", **more):
        heads = {"Event": event, "Site": "s/a", "White": "A", "Black": "B", "WhiteElo": "600", "BlackElo": "1200"} | more
        return "\n".join(f'[{k} "{v}"]' for k, v in heads.items()) + "\n\n1. e4 *\n"

    (tmp_path / "e.pgn").write_text("\n".join([one(), one("Casual Rapid game"), one("Rated Blitz game"), one(WhiteTitle="BOT"), one(Variant="Chess960")]))
    rows = archive.candidates(archive.scan(spark, str(tmp_path / "e.pgn")), seed=1).collect()
    assert [(r["player"], r["rating"]) for r in rows] == [("a", 600)]


def test_sample_is_reproducible_and_capped(spark, run, games, tmp_path):
    again = stages.sample(Run(spark, tmp_path / "again"), str(games), count=600, seed=7)
    rows = run.table("decisions")
    assert fingerprint(again) == fingerprint(rows) and rows.count() == 600
    assert rows.groupBy("player").count().where("count > 10").isEmpty()
    with pytest.raises(ValueError):
        stages.sample(run, str(games))
    for bad in ({"count": 0}, {"rating_min": 9, "rating_max": 5}, {"only_partition": "x"}):
        with pytest.raises(ValueError):
            stages.sample(Run(spark, tmp_path / "bad"), str(games), **bad)


def test_stratified_sample_excludes_history(spark, run, games, tmp_path):
    fresh = Run(spark, tmp_path / "fresh")
    rows = stages.sample(fresh, str(games), count=60, seed=7, stratified=True, prior=run, only_partition="evaluation")
    old = run.table("decisions")
    assert rows.join(old, "player", "left_semi").isEmpty() and rows.join(old, "position", "left_semi").isEmpty()
    assert fresh.has("historical-players")


def test_analysis_resumes(spark, run, tmp_path):
    name = run.json("active-analysis.json")["path"]
    before = fingerprint(stages.analyses(run))

    def never(todo, config):
        raise AssertionError("everything is scored")

    assert stages.analyse(run, never) == name and fingerprint(stages.analyses(run)) == before


def test_trajectory_study(spark, run, tmp_path):
    rows = stages.episodes(run)
    parts = run.table("partitions")
    assert parts.count() == 600 and rows.where("loss < 0.1").isEmpty()
    assert rows.where("available and size(vector) <> 738").isEmpty() and rows.where("partition = 'excluded'").count() > 0
    assert fingerprint(stages.episodes(run)) == fingerprint(rows)  # the same again
    with pytest.raises(ValueError):
        stages.episodes(run, loss_threshold=0.3)
    audit = stages.engine_audit(run, score, count=5)
    assert audit["count"] == 5 and audit["max_absolute_delta"] == 0
    with pytest.raises(ValueError):
        stages.engine_audit(run, score)
    name = stages.cluster(run, max_episodes=60, distance=0.9)
    assert stages.cluster(run, max_episodes=60, distance=0.9) == name
    model = run.json(name)
    assert [g["cluster_id"] for g in model["clusters"]] == sorted(g["cluster_id"] for g in model["clusters"])
    packet = stages.review_packets(run)
    assert all(len(p["examples"]) <= 12 for p in packet["packets"])
    folder = run.path(f"inspection/{name.removesuffix('.json')}")
    review = json.loads((folder / "review.template.json").read_text())
    stages.review_packets(run, "selection")
    audit = json.loads((folder / "selection-review.template.json").read_text()) | {"reviewer": "r", "assignments": []}
    review["reviewer"] = "r"
    (tmp_path / "audit.json").write_text(json.dumps(audit))
    (tmp_path / "review.json").write_text(json.dumps(review))
    with pytest.raises(ValueError, match="rationale"):
        taxonomy.freeze(run, str(tmp_path / "review.json"), str(tmp_path / "audit.json"))
    for c in review["candidates"]:
        c["reason"] = "mixed"
    (tmp_path / "review.json").write_text(json.dumps(review))
    taxonomy.freeze(run, str(tmp_path / "review.json"), str(tmp_path / "audit.json"))
    for stage in (lambda: stages.episodes(run), lambda: stages.cluster(run), lambda: taxonomy.freeze(run, "", "")):
        with pytest.raises(ValueError):
            stage()
    result = taxonomy.measure(run, replicates=50)
    held = parts.where("partition = 'evaluation'")
    assert sum(c["decisions"] for c in result["coverage"]) == held.count() and result["families"] == []
    assert sum(c["classified"] for c in result["coverage"]) == 0
    qualifying = rows.where("partition = 'evaluation'")
    assert sum(c["qualifying_mistakes"] for c in result["coverage"]) == qualifying.count()
    assert run.path("trajectory-report.md").exists()
    with pytest.raises(ValueError):
        taxonomy.measure(run)


def test_accepted_family_is_measured(spark, run, tmp_path):
    study = Run(spark, tmp_path / "s")
    for name in ("decisions", "partitions", "episodes"):
        study.write_table(name, run.table(name) if run.has(name) else run.table("decisions"))
    rows = study.table("episodes").withColumns({"vector": F.array(F.lit(1.0), F.lit(0.0)), "available": F.lit(True), "informative": F.lit(True)})
    study.write_table("episodes2", rows)
    study.write_table("episodes", study.table("episodes2"))
    for name in ("config.json", "episodes.config.json"):
        study.write_json(name, run.json(name))
    family = {"cluster_id": "c001", "family_id": "family-c001", "name": "n", "centroid": [1.0, 0.0], "radius": 0.1, "supported": True}
    frozen = {"inputs": study.digests("decisions", "episodes"), "candidates": [family], "routing_centroids": [family], "scaler_scale": [1.0, 1.0], "taxonomy_id": "t"}
    study.write_json("taxonomy.json", frozen)
    study.write_json("taxonomy.complete.json", {"taxonomy_sha256": study.digest("taxonomy.json")})
    result = taxonomy.measure(study, replicates=50)
    held = study.table("episodes").where("partition = 'evaluation'")
    assert sum(b["incidents"] for b in result["families"][0]["bands"]) == held.count()
    for b in result["families"][0]["bands"]:
        if b["decisions"]:
            assert b["rate_ci"][0] <= b["incidents_per_100_decisions"] <= b["rate_ci"][1]
            assert b["qualifying_mistake_share"] in (None, 1.0)
    assert report.error_bars(result)
    image = study.path("family-c001.png").read_bytes()
    import struct
    import zlib

    assert image[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", image[16:24]) == (400, 240)
    body = zlib.decompress(image[image.index(b"IDAT") + 4 : -16])
    assert len(body) == 240 * 401 and 0 in body and 96 in body


def test_tampering_is_found(spark, tmp_path):
    r = Run(spark, tmp_path)
    r.write_table("t", spark.range(5))
    want = r.digests("t")
    r.verify(want)
    r.write_table("t", spark.range(5).repartition(3))
    r.verify(want)  # the same rows in another layout
    r.write_table("t", spark.range(6))
    with pytest.raises(ValueError):
        r.verify(want)
    r.write_json("d.json", {"a": 1}, fixed=True)
    r.write_json("d.json", {"a": 1}, fixed=True)
    with pytest.raises(ValueError):
        r.write_json("d.json", {"a": 2}, fixed=True)
    with pytest.raises(ValueError):
        r.write_json("n.json", {"a": float("nan")})


GROUPS = [("c1", True, [f"e{i}" for i in range(9)], 0.2)]


def judged(spark, distances, verdicts, reviews=None):
    """Calibration and acceptance of one cluster by verdicts on selection episodes."""
    groups = spark.createDataFrame(GROUPS, "cluster_id string, supported boolean, episode_ids array<string>, radius double")
    assigned = spark.createDataFrame([(f"s{i}", "c1", float(d)) for i, d in enumerate(distances)], "decision_id string, cluster_id string, distance double")
    entries = [{"decision_id": f"s{i}", "cluster_id": "c1", "correct": v} for i, v in enumerate(verdicts)]
    limits = taxonomy.calibrated(taxonomy.audited(taxonomy.verdict_table(spark, entries), assigned), groups)
    review = {"cluster_id": "c1", "accepted": True, "coherent": True, "name": "n", "reason": "clear", "supporting_episode_ids": ["e1", "e2", "e3"]}
    return [r.asDict() for r in taxonomy.accepted_families(taxonomy.review_table(spark, [review | x for x in reviews or [{}]]), groups, limits).collect()]


def test_calibration(spark):
    assert judged(spark, [0.02] * 5, [True] * 5)[0]["calibrated"] == 0.05
    assert judged(spark, [0.1] * 8 + [0.15], [True] * 8 + [False])[0]["calibrated"] == 0.1
    got = judged(spark, [0.03] * 8 + [0.04], [True] * 8 + [False])[0]
    assert abs(got["calibrated"] - 0.04) < 1e-8 and (got["right"], got["judged"]) == (8, 9)
    for distances, verdicts, rule in (([0.02] * 4, [True] * 4, "5 correct"), ([0.02] * 5 + [0.1] * 2, [True] * 5 + [False] * 2, "80%"), ([0.1] * 8 + [0.05], [True] * 8 + [False], "retains"), ([0.1] * 5, [True] * 4 + [1], "true or false")):
        with pytest.raises(ValueError, match=rule):
            judged(spark, distances, verdicts)


@pytest.mark.parametrize("change,rule", [({"accepted": 1}, "true or false"), ({"reason": "Pending review"}, "rationale"), ({"reason": " "}, "rationale"), ({"supporting_episode_ids": ["e1", "e2", "x"]}, "from the cluster"), ({"supporting_episode_ids": ["e1", "e2", "e2"]}, "3 examples"), ({"name": ""}, "a name"), ({"coherent": False}, "is coherent"), ({"cluster_id": "c9"}, "every cluster is reviewed|of the model")])
def test_reviews_are_checked(spark, change, rule):
    with pytest.raises(ValueError, match=rule):
        judged(spark, [0.02] * 5, [True] * 5, [change])
    with pytest.raises(ValueError, match="reviewed once"):
        judged(spark, [0.02] * 5, [True] * 5, [{}, {}])
    assert judged(spark, [0.02] * 5, [True] * 5, [{"accepted": False, "supporting_episode_ids": []}]) == []


def test_verdicts_must_be_about_actual_assignments(spark):
    assigned = spark.createDataFrame([("s0", "c1", 0.1), ("s1", None, None)], "decision_id string, cluster_id string, distance double")
    for entries, rule in (([("s9", "c1", True)], "selection episode"), ([("s0", "c2", True)], "that was made"), ([("s1", "c1", True)], "that was made"), ([("s0", "c1", True)] * 2, "one verdict")):
        given = taxonomy.verdict_table(spark, [dict(zip(("decision_id", "cluster_id", "correct"), e, strict=True)) for e in entries])
        with pytest.raises(ValueError, match=rule):
            taxonomy.audited(given, assigned)


ENGINE = """#!{python}
import sys
sys.path.insert(0, {root!r})
from plycraft.kernel.board import Board, parse_uci, uci
board = None
for line in sys.stdin:
    words = line.split()
    if words[0] == "uci":
        print("id name Toy\\nuciok", flush=True)
    elif words[0] == "isready":
        print("readyok", flush=True)
    elif words[0] == "position":
        board = Board.from_fen(" ".join(words[2:8]))
        for m in words[9:]:
            board = board.play(parse_uci(m))
    elif words[0] == "go":
        mates = [x for x in board.legal() if board.play(x).outcome() == "checkmate"]
        if mates:
            print("info depth 1 score mate 1 pv", uci(mates[0]), "\\nbestmove", uci(mates[0]), flush=True)
            continue
        m = uci(board.legal()[0])
        print("info string nodes", words[2])
        print("info depth 1 multipv 1 score cp 1 lowerbound wdl 1 1 998 pv", m)
        print("info depth 2 multipv 2 score cp 90 wdl 900 100 0 pv", m)
        print("info depth 2 multipv 1 score cp 30 wdl 500 300 200 nodes 9 pv", m, flush=True)
        print("bestmove", m, flush=True)
    elif words[0] == "quit":
        break
"""


def test_uci_engine(spark, run, tmp_path):
    import sys
    from pathlib import Path

    from plycraft.sources import uci as engine

    path = tmp_path / "toy"
    path.write_text(ENGINE.format(python=sys.executable, root=str(Path(__file__).resolve().parent.parent)))
    path.chmod(0o755)
    some = run.table("decisions").orderBy("ord").limit(12)
    over = spark.createDataFrame([("mate", "6k1/5ppp/8/8/8/8/8/K3R3 w - - 0 1", [], "e1e8")], "decision_id string, initial_fen string, history array<string>, move string")
    todo = some.select("decision_id", "initial_fen", "history", "move").unionByName(over)
    rows = {r["decision_id"]: r for r in engine.scorer([str(path)], workers=2)(todo, {"nodes": 50}).collect()}
    assert len(rows) == 13
    mate = rows.pop("mate")
    assert (mate["after_mate"], mate["after_expected"], mate["after_pv"], mate["before_expected"], mate["before_mate"], mate["loss"]) == (0, 1.0, [], 1.0, 1, 0)
    for r in rows.values():
        assert (r["before_cp"], r["after_cp"], r["before_bound"], r["before_depth"]) == (30, -30, "exact", 2)
        assert abs(r["before_expected"] - 0.65) < 1e-12 and abs(r["loss"] - 0.3) < 1e-12 and len(r["before_pv"]) == 1
    fresh = Run(spark, tmp_path / "engine")
    fresh.write_table("decisions", some)
    name = stages.analyse(fresh, engine.scorer([str(path)]), nodes=50, settings=engine.settings(str(path)))
    from plycraft.cli import doctor

    assert doctor(spark, str(path))["engine"]
    assert stages.analyses(fresh, name).count() == 12 and fresh.json(f"{name}.config.json")["threads"] == 1


def test_sampling_stops_when_it_has_enough(spark, run, games, tmp_path, monkeypatch):
    monkeypatch.setattr(stages, "FIRST_GAMES", 3)
    fresh = Run(spark, tmp_path / "early")
    rows = stages.sample(fresh, str(games), count=100, seed=7)
    whole = Run(spark, tmp_path / "whole")
    monkeypatch.setattr(stages, "FIRST_GAMES", 10**6)
    assert fingerprint(stages.sample(whole, str(games), count=100, seed=7)) == fingerprint(rows)
    assert fresh.table("candidates").agg(F.max("game_ordinal")).first()[0] <= 24 < whole.table("candidates").agg(F.max("game_ordinal")).first()[0]
    assert fresh.json("config.json")["scanned_games"] == whole.json("config.json")["scanned_games"] < 24


def test_semantic_study(spark, games, tmp_path):
    run = Run(spark, tmp_path / "run")
    stages.sample(run, str(games), count=400, seed=9)
    stages.analyse(run, score)
    rows = stages.stable(run, score)
    ledger = run.table("stability")
    assert ledger.where("base.loss < 0.4").isEmpty() and ledger.where("stable").count() == rows.count() > 0
    name = stages.description_packets(run)
    packets = run.json(name)["episodes"]
    assert packets == sorted(packets, key=lambda p: p["decision_id"]) and not {"player", "rating", "game_id"} & set(packets[0])
    selection = run.json(stages.description_packets(run, "selection"))["episodes"]
    records = [{"decision_id": p["decision_id"], "episode_sha256": p["episode_sha256"], "raw_explanation": "x", "normalized": f"loses material e4 variant{n % 3}", "grounded": True} for n, p in enumerate(packets)]
    records += [{"decision_id": p["decision_id"], "episode_sha256": p["episode_sha256"], "raw_explanation": "x", "normalized": "zebra", "grounded": True} for p in selection]
    given = {"prompt_version": stages.PROMPT_VERSION, "prompt_sha256": stages.prompt_sha256(), "provider": "people", "records": records}
    source = tmp_path / "given.json"
    for change in ({"provider": ""}, {"prompt_sha256": "x"}, {"records": records + records[:1]}, {"records": [records[0] | {"grounded": 1}]}, {"records": [records[0] | {"episode_sha256": "x"}]}):
        source.write_text(json.dumps(given | change))
        with pytest.raises((ValueError, TypeError)):
            stages.import_descriptions(run, str(source))
    source.write_text(json.dumps(given))
    done = stages.import_descriptions(run, str(source))
    model = run.json("embedding-model.json")
    assert "loses material" in model["vocabulary"] and "zebra" not in model["vocabulary"] and not any("e4" in t for t in model["vocabulary"])
    assert done.where("partition = 'selection' and available").isEmpty() and done.where("partition = 'discovery' and not available").isEmpty()
    other = Run(spark, tmp_path / "other")
    for name in ("episodes.config.json", "taxonomy.json"):
        other.write_json(name, run.json("episodes.config.json") | {"stable_gate": {"min_loss": 0.5}})
    with pytest.raises(ValueError, match="stability gate"):
        stages.import_descriptions(run, str(source), other)
    config = run.json("episodes.config.json")
    run.write_json("episodes.config.json", config | {"note": "edited"})
    with pytest.raises(ValueError, match="changed: episodes.config.json"):
        stages.cluster(run, distance=0.6)
    run.write_json("episodes.config.json", config)
    name = stages.cluster(run, distance=0.6)
    assert run.json(name)["scaling"] == "identity" and sum(run.json(name)["clusters"][0]["description_author_counts"].values()) > 0
    with pytest.raises(ValueError):
        stages.import_descriptions(run, str(source))


def test_symbolic_study(spark, games, tmp_path):
    run = Run(spark, tmp_path / "run")
    stages.sample(run, str(games), count=260, seed=3)
    stages.analyse(run, score)
    assert stages.features(run).where("size(feats) <> 1710").isEmpty()
    found = stages.discover(run, trees=4, replicates=20)
    assert found["model_fitted"] and sum(found["partitions"].values()) + found["excluded_repeated_positions"] == 260
    with pytest.raises(ValueError):
        stages.discover(run)
    done = report.symbolic_report(run, score)
    assert run.path("report.md").exists() and done["examples"] == len(run.json("sensitivity.json"))


def test_commands():
    from plycraft.cli import parser

    a = parser().parse_args(["sample", "a.pgn", "run", "--count", "5", "--stratified"])
    assert (a.count, a.stratified, a.rating_min, a.seed) == (5, True, 400, 20261006)
    assert parser().parse_args(["cluster", "r"]).distance == 0.3 and parser().parse_args(["measure", "r"]).bootstrap == 1000


def test_doctor(spark):
    from plycraft.cli import doctor

    assert all(v is not False for v in doctor(spark).values())
