"""Threshold rules from extremely randomised trees, and their evidence."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bootstrap import interval

TREES, DEPTH, LEAF, LEAST_ROWS = 100, 3, 50, 100
SUPPORT, PLAYERS, CHOSEN = 30, 20, 3
Rule = list[tuple[str, str, float]]


# ---------------------------------------------------------------- trees


def _place(tree: dict | None, x: np.ndarray) -> np.ndarray:
    """The open node (numbered like a heap from 1) that each row has reached, 0 if closed."""
    at = np.ones(len(x), np.int64)
    if tree is None:
        return at
    out = np.zeros(len(x), np.int64)

    def go(node: dict | None, number: int, rows: np.ndarray) -> None:
        if node is None or node.get("closed"):
            return
        if "feature" not in node:
            out[rows] = number
            return
        left = x[rows, node["feature"]] <= node["threshold"]
        go(node["left"], 2 * number, rows[left])
        go(node["right"], 2 * number + 1, rows[~left])

    go(tree, 1, np.arange(len(x)))
    return out


def _open_nodes(tree: dict, number: int = 1) -> list[tuple[int, dict]]:
    if tree.get("closed"):
        return []
    if "feature" not in tree:
        return [(number, tree)]
    return _open_nodes(tree["left"], 2 * number) + _open_nodes(tree["right"], 2 * number + 1)


def _frame(frames, feats: str, target: str):
    for pdf in frames:
        if len(pdf):
            yield np.array(pdf[feats].tolist(), np.int64), pdf[target].to_numpy(float)


def grow_forest(rows: DataFrame, width: int, *, feats: str = "feats", target: str = "loss", trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, seed: int = 0) -> list[dict]:
    """Extremely randomised trees, grown level by level over data of any size.

    At an open node one random threshold is drawn for every feature between its least and
    largest value there, and the one that lowers the squared error most is kept if both
    sides have ``leaf`` rows. A level takes two passes (ranges, then sums); a task combines
    its rows before the shuffle, so what moves is trees x nodes x features, not rows."""
    forest: list[dict] = [{} for _ in range(trees)]
    data = rows.select(feats, target)
    for level in range(depth):
        now = [(t, number) for t, tree in enumerate(forest) for number, _ in _open_nodes(tree)]
        if not now:
            break

        def ranges(frames, forest=forest):
            low: dict = {}
            for x, _ in _frame(frames, feats, target):
                for t, tree in enumerate(forest):
                    at = _place(tree or None, x)
                    for number in np.unique(at[at > 0]):
                        part = x[at == number]
                        a, b = low.get((t, number), (part.min(0), part.max(0)))
                        low[t, number] = np.minimum(a, part.min(0)), np.maximum(b, part.max(0))
            yield pd.DataFrame([(t, int(n), a.astype(np.int64).tobytes(), b.astype(np.int64).tobytes()) for (t, n), (a, b) in low.items()], columns=["tree", "node", "a", "b"])

        def widest(pdf):
            a = np.min([np.frombuffer(v, np.int64) for v in pdf["a"]], axis=0)
            b = np.max([np.frombuffer(v, np.int64) for v in pdf["b"]], axis=0)
            return pd.DataFrame([(pdf["tree"].iloc[0], pdf["node"].iloc[0], a.tobytes(), b.tobytes())], columns=["tree", "node", "a", "b"])

        shape = "tree int, node int, a binary, b binary"
        cuts = {}
        for r in data.mapInPandas(ranges, shape).groupBy("tree", "node").applyInPandas(widest, shape).collect():  # a row per open node
            a, b = np.frombuffer(r["a"], np.int64), np.frombuffer(r["b"], np.int64)
            cuts[r["tree"], r["node"]] = a + np.random.default_rng([seed, r["tree"], r["node"]]).random(width) * (b - a), b > a

        def sums(frames, forest=forest, cuts=cuts):
            acc: dict = {}
            for x, y in _frame(frames, feats, target):
                for t, tree in enumerate(forest):
                    at = _place(tree or None, x)
                    for number in np.unique(at[at > 0]):
                        here = at == number
                        left = x[here] <= cuts[t, int(number)][0]
                        add = np.concatenate([[here.sum(), y[here].sum()], left.sum(0), y[here] @ left])
                        acc[t, number] = acc.get((t, number), 0) + add
            yield pd.DataFrame([(t, int(n), v.astype(float).tobytes(), b"") for (t, n), v in acc.items()], columns=["tree", "node", "a", "b"])

        def added(pdf):
            v = np.sum([np.frombuffer(x, float) for x in pdf["a"]], axis=0)
            return pd.DataFrame([(pdf["tree"].iloc[0], pdf["node"].iloc[0], v.tobytes(), b"")], columns=["tree", "node", "a", "b"])

        found = {(r["tree"], r["node"]): np.frombuffer(r["a"], float) for r in data.mapInPandas(sums, shape).groupBy("tree", "node").applyInPandas(added, shape).collect()}
        for t, tree in enumerate(forest):
            for number, node in _open_nodes(tree):
                v = found.get((t, number))
                if v is None:
                    node["closed"] = True
                    continue
                n, total, n_left, s_left = v[0], v[1], v[2 : 2 + width], v[2 + width :]
                ok = cuts[t, number][1] & (n_left >= leaf) & (n - n_left >= leaf)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(ok, s_left**2 / n_left + (total - s_left) ** 2 / (n - n_left), -np.inf)
                best = int(np.argmax(gain))
                if not ok.any():
                    node["closed"] = True
                    continue
                node |= {"feature": best, "threshold": float(cuts[t, number][0][best]), "left": {}, "right": {}}
    return forest


def leaf_rules(tree: dict | None, names: list[str]) -> list[Rule]:
    """A rule per leaf: whole-number bounds per feature, intersected along the path and in
    order of name. Features are whole numbers, so a threshold may be rounded down."""
    out: list[Rule] = []

    def visit(node: dict | None, bounds: dict[str, tuple[float, float]]) -> None:
        if not node or "feature" not in node:
            rule: Rule = []
            for name in sorted(bounds):
                low, high = bounds[name]
                rule += [(name, ">", low)] if math.isfinite(low) else []
                rule += [(name, "<=", high)] if math.isfinite(high) else []
            out.append(rule)
            return
        name, cut = names[node["feature"]], float(math.floor(node["threshold"]))
        low, high = bounds.get(name, (-math.inf, math.inf))
        visit(node["left"], bounds | {name: (low, min(high, cut))})
        visit(node["right"], bounds | {name: (max(low, cut), high)})

    visit(tree, {})
    return out


def fit_rules(rows: DataFrame, names: list[str], *, feats: str = "feats", target: str = "loss", trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, seed: int = 0) -> list[Rule]:
    """Distinct rules of all trees, empty ones left out; none with fewer than 100 rows."""
    if not names or rows.limit(LEAST_ROWS).count() < LEAST_ROWS:
        return []
    forest = grow_forest(rows, len(names), feats=feats, target=target, trees=trees, depth=depth, leaf=leaf, seed=seed)
    unique = {json.dumps(r): r for tree in forest for r in leaf_rules(tree, names)}
    return [r for r in unique.values() if r]


# ---------------------------------------------------------------- evidence


def matches(rule: Rule) -> Column:
    out = F.lit(True)
    for name, op, t in rule:
        out = out & ((F.col(name) > t) if op == ">" else (F.col(name) <= t))
    return out


def evidence(rows: DataFrame, rules: list[Rule], part: str, *, player: str = "player", loss: str = "loss") -> DataFrame:
    """rule, part, support, distinct_players, coverage, excess: one scan for all rules. A
    row is tested against every rule at once and only sums are shuffled."""
    tested = rows.select(part, player, loss, F.array(*[matches(r) for r in rules]).alias("_hits"))
    flat = tested.select(part, player, loss, F.posexplode("_hits").alias("rule", "_hit"))
    per = flat.groupBy("rule", part, player).agg(F.count("*").alias("n"), F.count_if("_hit").alias("h"), F.sum(F.when(F.col("_hit"), F.col(loss))).alias("sh"), F.sum(F.when(~F.col("_hit"), F.col(loss))).alias("sm"))
    out = per.groupBy("rule", part).agg(F.sum("h").alias("support"), F.count_if(F.col("h") > 0).alias("distinct_players"), F.sum("n").alias("_n"), F.sum("sh").alias("_sh"), F.sum("sm").alias("_sm"))
    excess = F.try_divide("_sh", "support") - F.try_divide("_sm", F.col("_n") - F.col("support"))
    return out.select("rule", part, "support", "distinct_players", F.coalesce(F.try_divide("support", "_n"), F.lit(0.0)).alias("coverage"), excess.alias("excess"))


def chosen_rules(found: DataFrame, *, part: str = "partition", most: int = CHOSEN) -> DataFrame:
    """The rules that cost more than their complement in discovery and in selection, with
    support there, best first by coverage times excess (ties: the earlier rule)."""
    of = lambda p: found.where(F.col(part) == p)
    d = of("discovery").where("excess > 0").select("rule")
    s = of("selection").where(f"excess > 0 and support >= {SUPPORT} and distinct_players >= {PLAYERS}")
    return s.join(d, "rule").withColumn("score", F.col("coverage") * F.col("excess")).orderBy(F.col("score").desc(), "rule").limit(most)


def bootstrap_excess(rows: DataFrame, rule: Rule, weights: DataFrame, *, loss: str = "loss") -> DataFrame:
    """One row: interval of the excess over replicates of players; a replicate without hits
    or without misses has no value."""
    hit = matches(rule)
    per = rows.groupBy("player").agg(F.count_if(hit).alias("nh"), F.count_if(~hit).alias("nm"), F.coalesce(F.sum(F.when(hit, F.col(loss))), F.lit(0.0)).alias("sh"), F.coalesce(F.sum(F.when(~hit, F.col(loss))), F.lit(0.0)).alias("sm"))
    reps = per.join(weights, "player").groupBy("rep").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in ("nh", "nm", "sh", "sm")])
    value = F.try_divide("sh", "nh") - F.try_divide("sm", "nm")
    return reps.agg(*interval(value))


def is_supported(evidence_row: dict, low: float | None) -> bool:
    """Whether held-out evidence meets every planned threshold."""
    return evidence_row["support"] >= SUPPORT and evidence_row["distinct_players"] >= PLAYERS and (evidence_row["excess"] or 0) > 0 and low is not None and low > 0


def diverse_examples(hits: DataFrame, most: int = 10) -> DataFrame:
    """Examples across the range of loss: evenly spaced ranks from the costliest down, then
    the costliest that are left; one of each player."""
    ranked = hits.withColumn("_r", F.row_number().over(Window.orderBy(F.col("loss").desc(), "decision_id")) - 1)
    n = hits.agg(F.count("*").alias("_n"))
    k = F.least(F.col("_n"), F.lit(most))
    spots = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.when(k > 1, F.floor(i * (F.col("_n") - 1) / (k - 1))).otherwise(F.lit(0)))
    placed = ranked.crossJoin(F.broadcast(n)).withColumn("_spot", F.array_position(spots, F.col("_r").cast("long")))
    place = F.when(F.col("_spot") > 0, F.col("_spot")).otherwise(F.lit(most) + F.col("_r") + 1)
    own = placed.withColumn("_place", place).withColumn("_own", F.row_number().over(Window.partitionBy("player").orderBy("_place")))
    return own.where("_own = 1").orderBy("_place").limit(most).select("decision_id", "player", "loss")


def counterexamples(hits: DataFrame, most: int = 3) -> DataFrame:
    return hits.orderBy("loss", "decision_id").limit(most).select("decision_id", "player", "loss")


def describe(rule: Rule, words: dict[str, str]) -> str:
    return " AND ".join(f"{words[n]} {op} {t:g}" for n, op, t in rule)


def relation_words() -> dict[str, str]:
    """Plain words for every relation count."""
    from itertools import combinations_with_replacement

    from ..kernel.board import NAMES
    from ..schemas import PHASES, RELATIONS

    verbs = {"attack": "attack", "protect": "protection", "capture_own": "legal capture", "capture_enemy": "legal capture"}
    out = {}
    for phase in PHASES:
        when = f"{phase.capitalize()} move" if phase in ("before", "after") else phase.capitalize()
        for r in RELATIONS:
            actor = "opponent" if "enemy" in r else "mover"
            verb = verbs[r.removeprefix("enemy_")]
            out |= {f"{phase}_{r}_{a}_{b}": f"{when}: {actor} {NAMES[a]} {verb} of {NAMES[b]} count" for a in range(1, 7) for b in range(1, 7)}
        for a, b in combinations_with_replacement(RELATIONS, 2):
            out |= {f"{phase}_same_target_{a}_{b}_{k}": f"{when}: {NAMES[k]} pieces sharing {a} and {b} relationships count" for k in range(1, 7)}
    return out
