import math
import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from plycraft.functions import scalar as S
from plycraft.operators import bootstrap, gates, partitioning, rules, sampling, text, vectors


def part(player, seed):
    n = int.from_bytes(sha256(f"{seed}:{player}".encode()).digest()[:8], "big") % 100
    return "discovery" if n < 60 else "selection" if n < 80 else "evaluation"


def table(spark, n=600, players=60, positions=80, seed=5):
    r = random.Random(seed)
    rows = [(f"g{i}:0", i, f"p{r.randrange(players)}", f"x{r.randrange(positions)}", r.randrange(400, 1200), r.random()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "decision_id string, ord bigint, player string, position string, rating int, loss double")


def test_parts_match_hashlib(spark):
    names = [f"player{i}" for i in range(300)] + ["ß", ""]
    got = spark.createDataFrame([(n,) for n in names], "player string").withColumn("part", S.part_of(F.col("player"), 7)).collect()
    assert all(r["part"] == part(r["player"], 7) for r in got)


def spec_split(rows, seed, players=(), positions=()):
    """The rule, one row after another."""
    out, used = {}, set()
    for name in ("discovery", "selection", "evaluation"):
        mine = [r for r in rows if part(r[2], seed) == name and r[3] not in used]
        used |= {r[3] for r in mine}
        if name == "evaluation":
            seen, kept = set(), []
            for r in mine:
                if r[2] not in players and r[3] not in positions and r[3] not in seen:
                    seen.add(r[3])
                    kept.append(r)
            mine = kept
        out |= {r[0]: name for r in mine}
    return out


def test_split_equals_rule(spark):
    rows, df = table(spark)
    got = {r["decision_id"]: r["partition"] for r in partitioning.split_rows(df, 3).collect()}
    assert got == spec_split(rows, 3)
    prior = spark.createDataFrame([("p1", "x1"), ("p2", "x2"), ("p3", "x3")], "player string, position string")
    got = {r["decision_id"]: r["partition"] for r in partitioning.split_rows(df, 3, prior_players=prior, prior_positions=prior).collect()}
    assert got == spec_split(rows, 3, {"p1", "p2", "p3"}, {"x1", "x2", "x3"})


def test_quota_rounding():
    assert [list(sampling.quotas(n, [600])[600].values()) for n in (1, 2, 7, 20)] == [[1, 0, 0], [1, 1, 0], [4, 2, 1], [12, 4, 4]]
    assert sampling.quotas(2000, [400, 600, 800, 1000], "evaluation") == {b: {"discovery": 0, "selection": 0, "evaluation": 500} for b in (400, 600, 800, 1000)}
    with pytest.raises(ValueError):
        sampling.quotas(0, [600])
    with pytest.raises(ValueError):
        sampling.quotas(5, [600], "other")


@pytest.mark.parametrize("count", [20, 300, 5000])
def test_capped_equals_loop(spark, count):
    rows, df = table(spark, players=25)
    used, out = Counter(), []
    for r in rows:
        if len(out) < count and used[r[2]] < 10:
            used[r[2]] += 1
            out.append(r[0])
    assert sorted(x["decision_id"] for x in sampling.capped(df, count).collect()) == sorted(out)


def test_stratified_equals_loop(spark):
    rows, df = table(spark, players=12)
    df = partitioning.assigned(df, 3)
    quotas = sampling.quotas(90, [400, 600, 800, 1000])
    used, filled, out = Counter(), Counter(), []
    for r in rows:
        band, p = r[4] // 200 * 200, part(r[2], 3)
        if used[r[2]] < 10 and filled[band, p] < quotas[band][p]:
            used[r[2]] += 1
            filled[band, p] += 1
            out.append(r[0])
    assert sorted(x["decision_id"] for x in sampling.stratified(df, quotas).collect()) == sorted(out)


def test_round_robin(spark):
    _, df = table(spark)
    got = sampling.round_robin(df, 30, 1).collect()
    bands = Counter(r["rating"] // 200 * 200 for r in got)
    assert len(got) == 30 and max(bands.values()) - min(bands.values()) <= 1
    assert len({r["position"] for r in got}) == 30
    assert [r["decision_id"] for r in got] == [r["decision_id"] for r in sampling.round_robin(df, 30, 1).collect()]


def gate_row(base=None, deep=None):
    score = {"decision_id": "d", "before_expected": 0.9, "after_expected": 0.3, "loss": 0.6000000000000001, "before_pv": ["d2d4"], "after_pv": ["e7e5"], "before_bound": "exact", "after_bound": "exact", "after_terminal": False, "before_terminal": False, "played_move": "e2e4"}
    return (score | (base or {}), score | (deep or {}))


GATES = [
    (None, None, None),
    ({"after_expected": 0.7, "loss": 0.9 - 0.7}, None, "baseline_loss_below_minimum"),
    (None, {"after_expected": 0.7, "loss": 0.9 - 0.7}, "deep_loss_below_minimum"),
    (None, {"before_expected": 0.75, "loss": 0.75 - 0.3}, "score_drift_exceeds_maximum"),
    (None, {"before_pv": []}, "missing_deep_pv"),
    (None, {"after_pv": []}, "missing_deep_pv"),
    (None, {"after_pv": [], "after_terminal": True, "after_bound": None}, None),
    (None, {"before_pv": ["e2e4"]}, "deep_preferred_move_equals_played_move"),
    (None, {"before_bound": None}, "missing_or_unknown_before_bound"),
    (None, {"after_bound": "upper"}, "after_score_bound_not_exact"),
    ({"loss": float("nan")}, None, "Non-finite loss for d"),
    (None, {"before_expected": 1.5, "loss": 1.2}, "Out-of-range before_expected for d"),
    (None, {"loss": 0.5}, "Inconsistent loss for d"),
]


def test_gate_reasons(spark):
    kind = "struct<decision_id:string,before_expected:double,after_expected:double,loss:double,before_pv:array<string>,after_pv:array<string>,before_bound:string,after_bound:string,after_terminal:boolean,before_terminal:boolean,played_move:string>"
    rows = [(i, *gate_row(b, d)) for i, (b, d, _) in enumerate(GATES)]
    got = gates.gated(spark.createDataFrame(rows, f"i int, base {kind}, deep {kind}")).orderBy("i").collect()
    for r, (_, _, reason) in zip(got, GATES, strict=True):
        assert list(r["rejection_reasons"]) == ([reason] if reason else []) and r["stable"] == (reason is None)


def test_weights_count_rows_of_a_key_together(spark):
    docs = spark.createDataFrame([(1, "rook takes rook"), (2, "king"), (1, "takes rook king"), (3, None), (4, "")], "i int, t string")
    model = spark.createDataFrame([("king", 0, 1.0), ("rook", 1, 2.0), ("takes rook", 2, 3.0)], "term string, idx int, idf double")
    assert text._hits(docs.select("i", text.words_of(F.col("t")).alias("w")), model.collect()).count() == 5  # dealt by text, not by word
    raw = {"king": 1.0, "rook": (1 + math.log(3)) * 2, "takes rook": (1 + math.log(2)) * 3}
    length = math.sqrt(sum(x * x for x in raw.values()))
    got = {(r["i"], r["term"]): r["weight"] for r in text.weights(docs, model, "i", "t").collect()}
    assert got == pytest.approx({(1, t): x / length for t, x in raw.items()} | {(2, "king"): 1.0})


@pytest.mark.parametrize("most", [1, 4, 9, 1000])
def test_fit_counts_pairs_of_frequent_words_only(spark, most):
    r = random.Random(most)
    docs = [" ".join(r.choice(["aa", "bb", "cc", f"x{r.randrange(30)}"]) for _ in range(r.randrange(12))) for _ in range(40)] + [f"once{i} only{i}" for i in range(30)]
    words = [d.split() for d in docs]
    terms = [[*w, *map(" ".join, zip(w, w[1:], strict=False))] for w in words]
    total, df = Counter(t for ts in terms for t in ts), Counter(t for ts in terms for t in set(ts))
    top = sorted(sorted(total, key=lambda t: (-total[t], t))[:most])
    frame = spark.createDataFrame(list(enumerate(docs)), "i int, t string")
    got = {g["term"]: (g["idx"], g["idf"]) for g in text.fit(frame, "i", "t", max_terms=most).collect()}
    assert got == {t: (k, pytest.approx(math.log((1 + len(docs)) / (1 + df[t])) + 1)) for k, t in enumerate(top)}
    counted = text._frequent(frame.select(text.words_of(F.col("t")).alias("w")), ["aa", "bb"], ["aa"]).collect()
    assert {c["term"] for c in counted} == {"aa", "bb", "aa aa", "bb aa"} and all((total[c["term"]], df[c["term"]]) == (c["total"], c["df"]) for c in counted)


def test_loss_gate_refuses_nan(spark):
    df = spark.createDataFrame([(0.1,), (0.5,)], "loss double")
    assert gates.loss_gate(df, 0.5).count() == 1
    with pytest.raises(Exception, match="non-finite"):
        gates.loss_gate(spark.createDataFrame([(math.nan,)], "loss double"), 0.5).collect()


def test_masking(spark):
    words = spark.createDataFrame([("Queen Nxe4+ Qh5 R1e2 fxg8=Q# O-O-O e4 e8=Q# e2e4 wins material",)], "t string").select(S.masked(F.col("t")).alias("t")).first()["t"]
    assert " ".join(words.split()) == "queen wins material"


def test_text_model_is_frozen(spark):
    train = spark.createDataFrame([(1, "loses a rook"), (2, "loses a queen and the rook")], "i int, t string")
    model = text.fit(train, "i", "t", stop=["a", "the", "and"])
    terms = [r["term"] for r in model.orderBy("idx").collect()]
    assert terms == sorted(terms) and "loses rook" in terms and "the" not in terms
    later = text.vectors(spark.createDataFrame([(3, "zebra"), (4, "rook zebra")], "i int, t string"), model, "i", "t", stop=["a", "the", "and"]).orderBy("i").collect()
    assert [r["available"] for r in later] == [False, True] and list(later[0]["vector"]) == []
    assert abs(sum(x * x for x in later[1]["vector"]) - 1) < 1e-12
    assert text.fit(train.where("false"), "i", "t").count() == 0


def brute_linkage(x, limit):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - unit @ unit.T
    groups = [[i] for i in range(len(x))]
    while len(groups) > 1:
        best = min((np.mean([d[i, j] for i in a for j in b]), m, n) for m, a in enumerate(groups) for n, b in enumerate(groups) if m < n)
        if not best[0] < limit:
            break
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


def test_average_linkage_equals_brute_force():
    rng = np.random.default_rng(2)
    for n in (2, 5, 25, 40):
        x = rng.standard_normal((n, 6)) + rng.integers(0, 3, (n, 1)) * 2
        labels = vectors.average_linkage(x, 0.3)
        assert {frozenset(np.flatnonzero(labels == k).tolist()) for k in set(labels)} == brute_linkage(x, 0.3)
    assert len(vectors.average_linkage(np.zeros((0, 3)), 0.3)) == 0 and list(vectors.average_linkage(np.ones((1, 3)), 0.3)) == [0]


def test_routing_has_no_second_choice(spark):
    kind = "decision_id string, vector array<double>, available boolean, informative boolean"
    rows = spark.createDataFrame([("a", [1.0, 0.0], True, True), ("b", [0.0, 1.0], True, True), ("c", [0.0, 0.0], True, True), ("d", [1.0, 0.1], False, False)], kind)
    routing = spark.createDataFrame([(0, "c001", [1.0, 0.0]), (1, "c002", [0.1, 1.0])], "idx int, cluster_id string, centroid array<double>")
    ok = spark.createDataFrame([("c002", 0.3)], "cluster_id string, radius double")
    got = {r["decision_id"]: r["cluster_id"] for r in vectors.routed(rows, routing, ok).collect()}
    assert got == {"a": None, "b": "c002", "c": None, "d": None}  # a's nearest is no accepted family


def test_bootstrap_equals_matrices(spark):
    rows, df = table(spark, n=300, players=9)
    names = sorted({r[2] for r in rows})
    w = bootstrap.multinomial_weights(spark, names, 40, 3)
    dense = np.random.default_rng(3).multinomial(len(names), np.full(len(names), 1 / len(names)), size=40)
    partials = bootstrap.player_partials(df.withColumn("hit", F.col("loss") > 0.5).withColumn("band", F.lit(0)), ["band"])
    hits = np.array([sum(r[5] > 0.5 for r in rows if r[2] == p) for p in names])
    den = np.array([sum(1 for r in rows if r[2] == p) for p in names])
    want = np.quantile(dense @ hits / (dense @ den) * 100, [0.025, 0.975])
    got = bootstrap.rate_intervals(partials, w, ["band"], "hits", "decisions").first()
    assert np.allclose([got["ci_low"], got["ci_high"]], want)
    assert bootstrap.hashed_weights(df, 5, 1).groupBy("rep").agg(F.sum("w").alias("n")).where(f"n <> {len(names)}").isEmpty()


def test_leaves_partition_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 20, (400, 3))
    rows = [(str(i), [int(v) for v in r], float(r[0] > 9)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "decision_id string, feats array<int>, loss double")
    forest = rules.grow_forest(df, 3, trees=3, leaf=30, seed=1)
    for tree in forest:
        found = rules.leaf_rules(tree, ["a", "b", "c"])
        hit = [sum(all((r[{"a": 0, "b": 1, "c": 2}[n]] > t) if op == ">" else (r[{"a": 0, "b": 1, "c": 2}[n]] <= t) for n, op, t in rule) for rule in found) for r in x]
        assert set(hit) == {1} and len(found) > 1
    assert rules.fit_rules(df.limit(99), ["a", "b", "c"]) == []


def test_planted_rule_is_found(spark):
    r = random.Random(1)
    rows = [(f"d{i}", f"p{r.randrange(150)}", f"x{i}", i, [i % 2, r.randrange(3)], 0.3 * (i % 2) + 0.01 * r.random()) for i in range(2400)]
    df = partitioning.split_rows(spark.createDataFrame(rows, "decision_id string, player string, position string, ord bigint, feats array<int>, loss double"), 4)
    found = rules.fit_rules(df.where("partition = 'discovery'"), ["flag", "noise"], trees=10, seed=2)
    wide = df.withColumns({"flag": F.get("feats", F.lit(0)), "noise": F.get("feats", F.lit(1))})
    best = rules.chosen_rules(rules.evidence(wide, found, "partition")).collect()
    assert best and ("flag", ">", 0.0) in [tuple(c) for c in found[best[0]["rule"]]]
    held = wide.where("partition = 'evaluation'")
    ci = rules.bootstrap_excess(held, found[best[0]["rule"]], bootstrap.hashed_weights(held, 200, 1)).first()
    assert ci["ci_low"] > 0.1


def test_examples(spark):
    hits = spark.createDataFrame([(f"d{i:02d}", f"p{i % 7}", float(i)) for i in range(30)], "decision_id string, player string, loss double")
    got = rules.diverse_examples(hits).collect()
    assert got[0]["decision_id"] == "d29" and len({r["player"] for r in got}) == len(got) == 7
    assert [r["decision_id"] for r in rules.counterexamples(hits).collect()] == ["d00", "d01", "d02"]
    assert rules.diverse_examples(hits.limit(0)).count() == 0 and rules.diverse_examples(hits.limit(1)).count() == 1


def test_bootstrap_weights(spark):
    players = spark.createDataFrame([(f"p{i % 40}",) for i in range(100)], "player string")
    numbers = {r["player"]: r["i"] for r in bootstrap.numbered_players(players).collect()}
    from hashlib import sha256

    assert [p for p, _ in sorted(numbers.items(), key=lambda x: x[1])] == sorted(numbers, key=lambda p: (sha256(p.encode()).hexdigest()[:3], p)) and sorted(numbers.values()) == list(range(40))
    exact = bootstrap.hashed_weights(players, 30, 5).groupBy("rep").agg(F.sum("w").alias("n")).collect()
    assert len(exact) == 30 and {r["n"] for r in exact} == {40}
    loose = bootstrap.poisson_weights(players, 500, 5)
    got = loose.agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("w")).alias("s"), F.min("w").alias("least")).first()
    mean = got["n"] / (500 * 40)
    assert abs(mean - 1) < 0.03 and abs(got["s"] / (500 * 40) - mean**2 - 1) < 0.06 and got["least"] == 1
    assert loose.exceptAll(bootstrap.poisson_weights(players.repartition(5), 500, 5)).isEmpty()
    assert bootstrap.hashed_weights(players.limit(0), 3, 5).count() == 0


def test_stratified_reads_in_order_and_skips_full_strata(spark):
    rows = spark.createDataFrame([(str(i), f"p{i % 3}", 400 + 200 * (i % 2), "discovery" if i % 5 else "selection", i) for i in range(400)], "decision_id string, player string, rating int, partition string, ord long").repartition(7)
    table = {400: {"discovery": 7, "selection": 0, "evaluation": 2}, 600: {"discovery": 3, "selection": 12, "evaluation": 2}}
    got = {r[0] for r in sampling.stratified(rows, table, cap=5).collect()}
    left, used, want = {(b, p): n for b, q in table.items() for p, n in q.items()}, {}, set()
    for i in range(400):
        key, player = (400 + 200 * (i % 2), "discovery" if i % 5 else "selection"), (f"p{i % 3}", i % 5 > 0)
        if left[key] and used.get(player, 0) < 5:
            left[key], used[player] = left[key] - 1, used.get(player, 0) + 1
            want.add(str(i))
    assert got == want
