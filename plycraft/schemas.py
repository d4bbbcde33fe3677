"""Declared tables, and the column names that are generated from parameters."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import types as T

from .kernel.board import NAMES

PARTS = ("discovery", "selection", "evaluation")


def _struct(spec: str) -> T.StructType:
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType(), "as": T.ArrayType(T.StringType()), "ad": T.ArrayType(T.DoubleType()), "ai": T.ArrayType(T.IntegerType())}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in spec.split())])


#: A recorded choice. ``ord`` is its place in the order of acceptance, which later steps use.
DECISIONS = _struct("decision_id:s game_id:s player:s rating:i ply:i initial_fen:s history:as move:s position:s ord:l")
#: Externally supplied scores of the position before and after the choice. Scores in
#: centipawns and mates are separate and never converted into each other.
ANALYSES = _struct("decision_id:s before_cp:i before_mate:i after_cp:i after_mate:i before_expected:d after_expected:d loss:d before_pv:as after_pv:as before_depth:i after_depth:i before_bound:s after_bound:s")
EPISODES = _struct(
    "episode_id:s decision_id:s game_id:s player:s rating:i ply:i side:s position:s initial_fen:s history:as before_fen:s fen:s move:s preferred_move:s before_cp:i before_mate:i after_cp:i after_mate:i before_expected:d after_expected:d loss:d before_pv:as after_pv:as analysis_config_sha256:s analysis_config_json:s partition:s vector:ad available:b informative:b"
)
#: Relation counts are one packed array, in the order of ``relation_names``.
FEATURES = _struct("decision_id:s feats:ai")

# The names of phases, relations and outcomes, and how column names are made of
# them, are those of the tables that a study exchanges with others.
PHASES = ("before", "after", "created", "removed", "retained")
RELATIONS = ("attack", "protect", "enemy_attack", "enemy_protect", "capture_own", "capture_enemy")
OUTCOMES = ("mover_win", "draw", "mover_loss")


def relation_names() -> list[str]:
    """1,080 counts of single relations by kinds of piece and 630 of shared targets."""
    single = [f"{p}_{r}_{a}_{b}" for p in PHASES for r in RELATIONS for a in range(1, 7) for b in range(1, 7)]
    shared = [f"{p}_same_target_{a}_{b}_{k}" for p in PHASES for a, b in combinations_with_replacement(RELATIONS, 2) for k in range(1, 7)]
    return single + shared


def step_names(step: int) -> list[str]:
    out = []
    for actor in ("mover", "opponent"):
        out += [f"step_{step}_material_{actor}_{NAMES[k]}_delta" for k in range(1, 7)]
        out.append(f"step_{step}_checks_{actor}")
        out += [f"step_{step}_captures_{actor}_{NAMES[k]}" for k in range(1, 7)]
        out += [f"step_{step}_promotions_{actor}_to_{NAMES[k]}" for k in range(1, 7)]
    return out + [f"step_{step}_terminal_{o}" for o in OUTCOMES]


def trajectory_names(horizon: int = 6) -> list[str]:
    """41 counts a step for the played and the preferred line, and their differences."""
    if horizon < 1:
        raise ValueError("horizon must be positive")
    line = [n for s in range(1, horizon + 1) for n in step_names(s)]
    return [f"{kind}_{n}" for kind in ("played", "preferred", "difference") for n in line]


def wide_features(features, names: list[str] | None = None):
    """The packed counts as one column per name (all by default)."""
    from pyspark.sql import functions as F

    at = {n: i for i, n in enumerate(relation_names())}
    return features.select("decision_id", *[F.get("feats", F.lit(at[n])).alias(n) for n in names or at])
