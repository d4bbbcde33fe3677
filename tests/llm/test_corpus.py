"""Corpus operators against brute force, on rows that go wrong easily."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from plycraft.llm import lm, media, neardup, pieces, quality, rans, sharding, tokens, toxicity, warc
from plycraft.llm.common import workspace
from plycraft.llm.mixing import mix_plan, mixed, targets
from plycraft.llm.neardup import classes, deduplicated
from plycraft.llm.quality import measured, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, quality string, size int, shard string"
R = random.Random(4)
VOCABULARY = ["".join(R.choice("abcdeéßü") for _ in range(R.randint(1, 8))) for _ in range(400)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) + r.choice(["", "", ".", ",", "\n", "!!"]) for _ in range(n))


LONG = prose(99, 30_000)
BASE = prose(7, 120)
EDITED = BASE.replace(BASE.split(" ")[60], "changed", 1)
TEXTS = [None, "", " \t\n", "a", "a b c", "x x x x x x x", BASE, BASE, BASE.upper() if BASE.isascii() else BASE, EDITED, LONG, "line one\nline one\n\nline two", "a#$ <b>|& %*", "tab\there  double", *[prose(i, 30 + i) for i in range(20)], "nul \x00 ﬁ ① 日本 😀 '<s>'"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "de", None)[i % 3], ("s1", "s0", None, "s2")[i % 4], 0, "clash", "clash", 1, "clash") for i, t in enumerate(TEXTS)]
    rows += [rows[6], rows[6], (None, "null id", None, "s1", 0, "clash", "clash", 1, "clash")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(len(TEXTS))] + [(None, 1, 0), (3, None, None)], "doc_id bigint, quality int, toxic int")


def low(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


# ---------------------------------------------------------------- quality rules


def base_measures(t):
    t = t or ""
    w = WORD.findall(t)
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if seen[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_measures(docs):
    rows = measured(docs, into="m").select("text", "m.*").collect()
    for r in rows:
        want = base_measures(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_quality_keeps_columns(docs, none, labels):
    rows, m, kept = quality_rules(docs, labels)
    assert set(docs.columns) < set(rows.columns) and kept not in docs.columns and m not in docs.columns
    assert rows.count() == docs.count() and rows.where(f"{kept} is null").isEmpty()
    assert quality_rules(none, labels)[0].count() == 0
    assert quality_rules(docs, labels.limit(0))[0].where(f"{kept} = {m}.base_failed").isEmpty()


@pytest.mark.parametrize("n,risk,level", [(0, 0.1, 0.05), (30, 0.1, 0.05), (500, 0.01, 0.01), (2000, 0.02, 0.001), (100_000, 0.004, 0.003)])
def test_binomial_bound(spark, n, risk, level):
    from pyspark.sql import functions as F

    got = spark.range(1).select(quality.allowed(F.lit(n).cast("long"), risk, F.lit(level)).alias("k")).first()["k"]
    cdf, lp, k = 0.0, n * math.log1p(-risk), -1
    for j in range(n + 1):
        cdf += math.exp(lp)
        if cdf > level:
            break
        k = j
        lp += math.log((n - j) / (j + 1)) + math.log(risk / (1 - risk)) if j < n else 0
    assert got == k


def test_thresholds_are_certified(spark):
    r = random.Random(1)
    rows = [(i, prose(i, 60) + (" ###" * 40 if i % 4 == 0 else ""), "en", int(i % 4 != 0)) for i in range(2400)]
    docs = spark.createDataFrame([x[:3] for x in rows], "doc_id bigint, text string, lang string")
    y = spark.createDataFrame([(x[0], x[3]) for x in rows], "doc_id bigint, quality int")
    out, m, kept = quality_rules(docs, y)
    got = {x["doc_id"]: x[kept] for x in out.select("doc_id", kept).collect()}
    good = [got[x[0]] for x in rows if x[3]]
    assert sum(good) / len(good) > 1 - quality.RISK and not any(got[x[0]] for x in rows if not x[3])


# ---------------------------------------------------------------- mixing


def test_targets(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 300, None: 0, "e": 40}
    got = {r["source"]: r["target"] for r in targets(spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size bigint, source_docs bigint")).collect()}
    order = [*sorted(s for s in sizes if s is not None), None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total = sum(sizes.values())
    want = {s: total * w / sum(weight.values()) for s, w in weight.items()}
    for _ in range(20):
        over = {s for s in want if want[s] >= 3 * sizes[s]}
        extra = sum(want[s] - 3 * sizes[s] for s in over)
        free = sum(weight[s] for s in want if s not in over)
        want = {s: 3.0 * sizes[s] if s in over else want[s] + (extra * weight[s] / free if free else 0) for s in want}
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix(spark, docs, none):
    plan = mix_plan(docs, block_docs=4, shard_blocks=2).collect()
    again = mix_plan(docs.repartition(5), block_docs=4, shard_blocks=2).collect()
    assert sorted(map(str, plan)) == sorted(map(str, again))
    assert sum(r["rows"] for r in plan) == docs.count()
    assert all(len(r["shards"]) <= 3 for r in plan)
    per = collections.defaultdict(lambda: [0, 0.0, 0])
    for r in plan:
        per[r["source"]][0] += r["size"] * r["rows"]
        per[r["source"]][1] = r["target"]
        per[r["source"]][2] += r["size"] * r["rows"] * len(r["shards"])
        assert r["size"] == len(WORD.findall(next(t or "" for i, t in enumerate([*TEXTS]) if i == r["doc_id"]))) if r["doc_id"] is not None else True
    for size, target, taken in per.values():
        assert taken <= target + 1e-6 and taken <= 3 * size
    rows = mixed(docs, block_docs=4, shard_blocks=2)
    assert rows.count() == sum(r["rows"] * len(r["shards"]) for r in plan) and set(docs.columns) < set(rows.columns)
    assert mix_plan(none).count() == 0 and mixed(none).count() == 0


def test_mix_with_many_sources_or_clashing_names(spark, docs, monkeypatch):
    """A shuffled, salted join gives what a broadcast gives, and helper columns are out of the way."""
    from pyspark.sql import functions as F

    from plycraft.llm import mixing

    clash = docs.withColumns({n: F.lit(n) for n in ("shards", "mix_plan", "mix_size", "mix_copy", "_pd", "source_size", "target", "rows", "words", "block")})
    rows = mixed(clash, block_docs=4, shard_blocks=2)
    assert set(clash.columns) < set(rows.columns) and rows.where("shards <> 'shards'").isEmpty()
    want = sorted(map(str, mix_plan(docs, block_docs=4, shard_blocks=2).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(str, mix_plan(docs, block_docs=4, shard_blocks=2).collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 4)
    assert mix_plan(docs, block_docs=1, shard_blocks=2).count() == len(want)


def test_splitting_tree_draws_like_a_hypergeometric(spark):
    """Shards are disjoint, exact in size, and hold each source as draws without replacement do."""
    from plycraft.llm.mixing import _split

    quotas = spark.createDataFrame([("a", 30), ("b", 10)], "source string, n bigint")
    found = []
    for seed in range(40):
        rows = _split(4, quotas, seed).collect()
        per = collections.Counter()
        drawn = collections.defaultdict(list)
        for r in rows:
            per[r["shard"]] += r["n"]
            drawn[r["source"]] += range(r["start"], r["start"] + r["n"])
        assert set(per.values()) == {10} and sorted(drawn["a"]) == list(range(30)) and sorted(drawn["b"]) == list(range(10))
        found += [r["n"] for r in rows if r["source"] == "b" and r["shard"] == 0] or [0]
    mean, var = np.mean(found), np.var(found)
    assert abs(mean - 2.5) < 0.6 and 0.5 < var < 3  # 10 of 40, 10 of them b: mean 2.5, variance 1.44


def test_mix_nears_targets(spark):
    rows = [(i, prose(i % 300, 5 + i % 90), f"s{min(i % 7, 3)}") for i in range(4000)]
    plan = mix_plan(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), block_docs=64, shard_blocks=4).collect()
    per = collections.defaultdict(lambda: [0.0, 0])
    shards = collections.Counter()
    for r in plan:
        per[r["source"]][0] = r["target"]
        per[r["source"]][1] += r["size"] * r["rows"] * len(r["shards"])
        shards.update(r["shards"])
    assert all(abs(t - n) <= 20 for t, n in per.values())
    assert len(shards) > 8 and max(shards.values()) < 3 * min(shards.values())


# ---------------------------------------------------------------- near-dedup


def shingles(t):
    w = WORD.findall(low(t))
    return collections.Counter(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else collections.Counter([tuple(w)])


def weighted(texts, gain):
    """Shingle weights of each text: count times inverse document frequency, from the definition."""
    counts = [shingles(t) for t in texts]
    df = collections.Counter(x for c in counts for x in c)
    top = math.log(max(len(texts), 2))
    return [{x: n * (1 + gain * (1 - math.log(df[x]) / top)) for x, n in c.items()} for c in counts]


def jaccard(a, b):
    return sum(min(a.get(x, 0), b.get(x, 0)) for x in {*a, *b}) / sum(max(a.get(x, 0), b.get(x, 0)) for x in {*a, *b})


def near_texts(seed, groups, most):
    r, texts = random.Random(seed), []
    for g in range(groups):
        words = prose(1000 + 7 * seed + g, r.randint(20, 150)).split(" ")
        for _ in range(r.randint(1, most)):
            copy = list(words)
            for _ in range(r.choice([0, 1, 1, 2, 3, 4, 8, 30])):
                copy[r.randrange(len(copy))] = r.choice(VOCABULARY)
            texts.append(" ".join(copy))
    return list(dict.fromkeys(texts))


@pytest.mark.parametrize("gain,block", [(neardup.IDF_GAIN, 3), (neardup.IDF_GAIN, 256), (5.0, 2)])
def test_near_duplicates_equal_brute_force(spark, gain, block):
    """Classes are the components of all pairs of weighted similarity 0.8 or more, apart from
    pairs that the draws may miss (none here)."""
    texts = near_texts(2, 40, 9)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {x["doc_id"]: x["class_id"] for x in classes(df, gain=gain, block=block).collect()}
    w = weighted(texts, gain)
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    close = 0
    for i in range(len(texts)):
        for j in range(i):
            if abs(len(w[i]) - len(w[j])) < 50 and set(w[i]) & set(w[j]):
                same = jaccard(w[i], w[j])
                close += 0.75 < same < 0.85
                if same >= 0.8:
                    a, b = sorted((root(i), root(j)))
                    parent[b] = a
    assert close > 20
    assert got == {i: root(i) for i in range(len(texts))}


def test_every_pair_of_a_mixed_bucket_is_compared(spark):
    """Groups of a bucket together compare each pair of different components once, in blocks."""
    r = random.Random(9)
    named = [(k, 0, 1000 * k + i, 1000 * k + (0 if r.random() < 0.5 else r.randrange(5))) for k in range(12) for i in range(r.randrange(2, 30))]
    named += [(99, 3, rep, comp) for key, _, rep, comp in named if key == 3]  # the same members again in another band
    table = spark.createDataFrame(named, "key bigint, band int, rep bigint, comp bigint")
    groups = collections.defaultdict(lambda: ([], []))
    for x in neardup.mixed_buckets(table, 4).collect():
        groups[x["key"], x["i"], x["j"]][x["side"]].append((x["rep"], x["comp"]))
    seen = collections.Counter()
    for (_, i, j), (left, right) in groups.items():
        assert max(len(left), len(right)) < 4 * 5  # hashes deal unevenly
        pairs = [(a, b) for a in left for b in right]
        if i >= 0 and j == 0:
            pairs += [(a, b) for n, a in enumerate(left) for b in left[n + 1 :]]
        seen.update(tuple(sorted((a, b))) for (a, ca), (b, cb) in pairs if ca != cb)
    want = {tuple(sorted((a[2], b[2]))) for a in named for b in named if a[0] == b[0] < 99 and a[3] != b[3]}
    assert set(seen) == want and set(seen.values()) == {1}


def test_near_duplicates_edges(docs, none):
    got = classes(docs).collect()
    assert len(got) == docs.count()
    of = {x["doc_id"]: x["class_id"] for x in got}
    assert of[0] == of[1] == of[2] == 0 and of[7] == of[9] == 6 and of[10] == 10
    kept = deduplicated(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 6").count() == 1 and kept.where("doc_id in (1, 2, 7, 9)").isEmpty()
    assert classes(none).count() == 0 and deduplicated(none).count() == 0


def test_texts_with_one_id_stay_apart(spark):
    """Different texts without an id, or with the same one, are neither one class nor dropped."""
    near = prose(501, 200)
    rows = [(None, prose(500, 80)), (None, near), (None, prose(502, 80)), (None, prose(500, 80)), (7, prose(503, 80)), (7, prose(504, 80)), (8, near.replace(near.split(" ")[90], "changed", 1)), (9, prose(505, 80)), (9, prose(505, 80))]
    some = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert classes(some).select("class_id").distinct().count() == 6
    kept = sorted(r["text"] for r in deduplicated(some).collect())
    alone = sorted({t for _, t in rows} - {near, rows[6][1]})
    assert len(kept) == 6 and sorted(set(kept) - {near, rows[6][1]}) == alone


def test_draws_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    feature = np.sort(rng.integers(0, 1 << 50, 400).astype(np.uint64))
    w = rng.uniform(0.5, 4, 400)
    a, b = slice(0, 350), slice(50, 400)
    est = []
    for seed in range(30):
        f = np.sort((feature + np.uint64(seed * 7919)) & np.uint64((1 << 50) - 1))
        x, y = (neardup.draws(np.zeros(350, np.int64), f[k], w[k], 1) for k in (a, b))
        est.append((x == y).mean())
    want = w[50:350].sum() / w.sum()
    assert abs(np.mean(est) - want) < 0.03


# ---------------------------------------------------------------- language model


def test_scores(spark, docs, none):
    got = lm.scored(docs, parts=3).collect()
    rows = docs.collect()
    assert len(got) == len(rows)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    train = [r["text"] for r in rows if not held(r["doc_id"])]
    c = collections.Counter(w for t in train for w in WORD.findall(low(t)))
    n, v = sum(c.values()) + len(train), len(c) + 1
    want = collections.defaultdict(list)
    for r in rows:
        w = WORD.findall(low(r["text"]))
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w) + math.log10((len(train) + 0.1) / (n + 0.1 * (v + 1)))
        want[r["doc_id"]].append((held(r["doc_id"]), len(w) + 1, sum(c[x] > 0 for x in w) + 1, n, base))
    for g in got:
        h, size, known, total, base = want[g["doc_id"]][0]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (h, size, known, total)
        assert math.isclose(g["base_score"], base, rel_tol=1e-9) and g["score"] < 0
    assert lm.scored(none, parts=2).count() == 0


def test_scores_use_every_context(spark, docs, monkeypatch):
    """The scores are those of one trie of all contexts of all training text, however the text is cut."""
    import pyarrow as pa

    from plycraft.llm import ppm
    from plycraft.llm.common import LOWER, string_bytes

    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    bytes_of = lambda texts: string_bytes(pa.array(texts, pa.large_string()))
    data, offsets = bytes_of([t for i, t in rows if not held(i)])
    g, n = ppm.counted(ppm.gram_keys(LOWER[data], offsets))
    assert (n < 4).any()
    trie = ppm.build({k: ppm.counted(ppm.suffix(g, k + 1), n) for k in range(ppm.ORDER + 1)})
    data, offsets = bytes_of([t for _, t in rows])
    want = sorted(zip([-1 if i is None else i for i, _ in rows], ppm.score(trie, LOWER[data], offsets), strict=True))
    for parts, text, piece, asked in ((3, 1 << 24, 1 << 20, 1 << 23), (7, 1000, 300, 2000)):
        for name, value in (("TEXT", text), ("PIECE", piece), ("ASKED", asked)):
            monkeypatch.setattr(lm, name, value)
        got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in lm.scored(docs, parts=parts).select("doc_id", "score").collect())
        assert [i for i, _ in got] == [i for i, _ in want]
        assert np.allclose([x for _, x in got], [x for _, x in want], rtol=1e-4)


def naive_ppm(train, text, order):
    """Escape method D with exclusion, from the definition: one symbol at a time."""
    start, end = -1, -2
    seen = collections.defaultdict(collections.Counter)
    for t in train:
        s = [start] * order + list(t) + [end]
        for i in range(order, len(s)):
            for k in range(order + 1):
                seen[tuple(s[i - k : i])][s[i]] += 1
    s, total = [start] * order + list(text) + [end], 0.0
    for i in range(order, len(s)):
        p, excluded, known = 1.0, set(), False
        for k in range(order, -1, -1):
            here = {x: n - 0.5 for x, n in seen.get(tuple(s[i - k : i]), {}).items() if x not in excluded}
            if not here:
                continue
            whole, escape = sum(here.values()), 0.5 * len(here)
            if s[i] in here:
                p, known = p * here[s[i]] / (whole + escape), True
                break
            p *= escape / (whole + escape)
            excluded |= set(here)
        total += math.log10(p if known else p / (255 - len(excluded)))
    return total


def test_score_equals_the_definition(spark):
    """PPM by looking at every context of every symbol, against the tables and against the query's path."""
    import pyarrow as pa

    from plycraft.llm import ppm
    from plycraft.llm.common import string_bytes

    texts = ["abracadabra abracadabra", "", "the cat sat on the mat", "the cats sat", "abrac", prose(3, 40).lower(), "zq", prose(4, 30).lower()]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    train = [t.encode() for i, t in enumerate(texts) if not held(i)]
    want = [naive_ppm(train, t.encode(), ppm.ORDER) for t in texts]
    data, offsets = string_bytes(pa.array([t.decode() for t in train], pa.large_string()))
    g, n = ppm.counted(ppm.gram_keys(data, offsets))
    trie = ppm.build({k: ppm.counted(ppm.suffix(g, k + 1), n) for k in range(ppm.ORDER + 1)})
    assert np.allclose(ppm.score(trie, *string_bytes(pa.array(texts, pa.large_string()))), want, rtol=1e-4)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["score"] for r in lm.scored(df, parts=3).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], want, rtol=2e-4)


def test_conditional_probabilities_sum_to_one():
    import pyarrow as pa

    from plycraft.llm import ppm
    from plycraft.llm.common import string_bytes

    data, offsets = string_bytes(pa.array([BASE, LONG[:5000], "", "abracadabra"], pa.large_string()))
    g, n = ppm.counted(ppm.gram_keys(data, offsets))
    trie = ppm.build({k: ppm.counted(ppm.suffix(g, k + 1), n) for k in range(ppm.ORDER + 1)})
    p = 10 ** trie.logp.astype(float)
    total = p[:, :-1].sum(1) + p[:, -1] * (ppm.SYMBOLS - trie.logp.shape[1] + 1)
    assert np.allclose(total, 1, atol=1e-4)
    whole = ppm.score(trie, data, offsets)
    one = [ppm.score(trie, data[a:b], np.array([0, b - a]))[0] for a, b in zip(offsets, offsets[1:], strict=False)]
    assert np.allclose(whole, one)


# ---------------------------------------------------------------- archives


def test_archives(spark, none):
    htmls = ["<p>a</p>", "<p>b</p>", "<p>a</p>", None, "", LONG, "<p>a</p>", "é\r\n\r\nx"]
    urls = ["http://b.example.com/x?q=1", "https://a.example.com", None, "not a url", "http://b.example.com/x?q=1", "http://[bad", "HTTP://B.example.com:80/x?q=1", "http://c.org/é b"]
    pages = spark.createDataFrame([(i, u, h, "clash") for i, (u, h) in enumerate(zip(urls, htmls, strict=True))], "page_id bigint, url string, html string, key string").repartition(3)
    folder, index, rows = warc.archived(pages, archive_bytes=300)
    got = {r["page_id"]: r for r in rows.collect()}
    for i, h in enumerate(htmls):
        raw = (h or "").encode()
        last = max(j for j, x in enumerate(htmls) if (x or "") == (h or ""))
        assert got[i]["payload_bytes"] == len(raw) and got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("response", None) if last == i else ("revisit", last))
    order = [(r["key"], r["stamp"]) for r in index.orderBy("range", "position").collect()]
    assert order == sorted(order) and len(order) == len(htmls)
    captures = spark.createDataFrame([(i, f"http://hot.org/{'a' if i % 7 else i}", f"<p>{i}</p>") for i in range(300)], "page_id bigint, url string, html string").repartition(5)
    runs = warc.write_archives(captures, workspace(spark, "warc"), archive_bytes=4000)
    for parts in (1, 4, 9):
        got = warc.merged_index(runs, parts).orderBy("range", "position").collect()
        seen = collections.Counter()
        for r in got:  # a history is numbered through all ranges, in order of time
            seen[r["key"]] += 1
            assert r["nth"] == seen[r["key"]]
        assert [(r["key"], r["stamp"]) for r in got] == sorted((r["key"], r["stamp"]) for r in got) and len(got) == 300
        assert parts == 1 or len({r["range"] for r in got if r["key"].endswith("/a")}) > 1
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.write_archives(empty, workspace(spark, "warc")).count() == 0


def test_loser_tree():
    r = random.Random(3)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(r.randrange(30) for _ in range(r.randrange(12))) for _ in range(k)]
        assert [x for _, x in warc.LoserTree([iter(x) for x in runs])] == sorted(sum(runs, []))


# ---------------------------------------------------------------- token ids


def test_added_tokens_are_the_librarys():
    """An added token's literal in a text is what the library, as loaded, makes of it."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokens.default_tokenizer())
    texts = ["end <|endoftext|> of", "<|endoftext|>", "a<|endoftext|><|endoftext|>b c", "plain text, words", "<|endoftex t|>", "x <|endoftext|", "end <|endoftext|>\n\nof it"]
    ids, sizes = tokens.PieceTokenizer(tokens.default_tokenizer()).encode(pa.array(texts), 7)
    ends = np.cumsum(sizes)
    for t, a, b in zip(texts, ends - sizes, ends, strict=True):
        assert ids[a:b].tolist() == [*tk.encode(t, add_special_tokens=False).ids, 7]
    assert len(tk.encode(texts[0], add_special_tokens=False).ids) == 4


def test_token_files(spark, docs, none):
    from tokenizers import Tokenizer

    folder, files = tokens.token_files(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), file_ids=5000, partitions=3)
    got = tokens.read_docs(spark, folder, files).orderBy("doc_id").collect()
    tk = Tokenizer.from_file(tokens.default_tokenizer())  # as the library loads it
    start = 0
    for r, (i, t) in zip(got, enumerate(TEXTS), strict=True):
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    f, x = tokens.token_files(docs)
    assert tokens.read_docs(spark, f, x).count() == docs.count()
    assert tokens.token_files(none)[1].count() == 0


@pytest.mark.parametrize("n", [0, 1, 100, 65_536, 200_001])
def test_rans_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 50_000).astype(np.uint32)
    data = rans.encode(ids, np.arange(1), np.array([n]))
    reader = rans.Reader(data)
    assert (reader.all() == ids).all() and reader.lengths.tolist() == [n]
    if n > 70_000:
        assert (reader.range(65_000, 140_001) == ids[65_000:140_001]).all()
        assert (rans.Reader(rans.encode(np.full(n, 7, np.uint32), np.arange(1), np.array([n]))).all() == 7).all()
        broken = bytearray(data)
        broken[len(data) // 2] ^= 255
        with pytest.raises(ValueError):
            rans.Reader(bytes(broken)).all()


# ---------------------------------------------------------------- media


def test_image_formats():
    rng = np.random.default_rng(1)
    for shape in ((1, 1), (7, 5), (3, 9, 3), (40, 24)):
        x = rng.integers(0, 256, shape, dtype=np.uint8)
        assert (media.decode(media.write_pnm(x)) == x).all() and (media.decode(media.write_bmp(x)) == x).all()
    assert (media.decode(b"P2\n# c\n2 2\n255\n0 1\n2 3\n") == [[0, 1], [2, 3]]).all()
    assert (media.decode(b"P1\n3 1\n1 0 1\n") == [[0, 255, 0]]).all() and (media.decode(b"P4\n3 1\n\xa0") == [[0, 255, 0]]).all()
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")


def test_area_resize_is_exact():
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 255, (13, 7))
    fine = np.repeat(np.repeat(x, 8 * 3, 0), 9 * 5, 1)  # a common grid of both
    want = fine.reshape(8, fine.shape[0] // 8, 9, fine.shape[1] // 9).mean((1, 3))
    assert np.allclose(media.area_resize(x, 8, 9), want)


def test_media_table(docs, none):
    for r in media.media_features(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        raw = (r["text"] or "").encode()
        pad = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-32:]))
    assert media.media_features(none).count() == 0


def test_odd_media_are_told(spark):
    cells = [b"P5\n2 1\n255\nab", b"GIF89a", None, b"", b"P5\n9 9\n255\nab", b"P5\nx", b"BM", b"BM" + bytes(60), media.write_bmp(np.arange(12, dtype=np.uint8).reshape(2, 2, 3))]
    rows = {r["doc_id"]: r for r in media.tiles(spark.createDataFrame([(i, 1, c) for i, c in enumerate(cells)], "doc_id bigint, n_bytes bigint, media binary")).collect()}
    assert [rows[i]["error"] is None for i in range(9)] == [True, False, True, False, False, False, False, False, True]
    assert rows[0]["payload_bytes"] == 2 and rows[1]["payload_sha256"] is None and rows[1]["media_bytes"] == 6 and rows[8]["feature"] is not None


def test_stored_forms_and_features(spark, docs):
    for form, write in (("pgm", media.write_pnm), ("bmp", media.write_bmp)):
        for r in media.media_features(docs.limit(8), form=form).join(docs.select("doc_id", "text"), "doc_id").collect():
            pixels = media.padded((r["text"] or "").encode())
            stored = write(pixels)
            assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
            x = pixels.astype(float)
            cells = np.array([[np.repeat(np.repeat(x, 8, 0), 9, 1)[i * len(x) : (i + 1) * len(x), j * 24 : (j + 1) * 24].mean() for j in range(9)] for i in range(8)])
            bits = "".join(str(int(b)) for b in (np.round(cells, 6)[:, :-1] > np.round(cells, 6)[:, 1:]).ravel())
            assert int(r["feature"], 16) == int(bits, 2) and len(r["feature"]) == 16


# ---------------------------------------------------------------- sharding


def test_compaction(spark, docs, none):
    store = sharding.ShardStore(spark, workspace(spark, "shards"), target_bytes=200_000)
    for part in (docs, none, docs.limit(5).repartition(4)):
        store.append(part)
    key = lambda df: sorted(map(str, df.collect()))
    want = key(docs.unionByName(docs.limit(5)))
    before = store.manifest().count()
    assert key(store.read()) == want
    version = store.compact_fully()
    assert version == store.versions()[-1] and store.manifest().count() < before and key(store.read()) == want
    assert key(store.read(1)) == key(docs)  # an older version is still whole
    assert store.located("doc_id").count() == len(want) and store.compact() is None
    with pytest.raises(RuntimeError):
        store.commit(store.manifest(), version)
    store.vacuum()
    assert key(store.read()) == want
    empty = sharding.ShardStore(spark, workspace(spark, "shards"))
    assert empty.compact() is None
    empty.append(none)
    assert empty.read().count() == 0 and empty.located("doc_id").count() == 0


def test_dead_and_racing_writers(spark, docs, monkeypatch):
    """Files of a writer that died before its commit are in nobody's way, and an append that
    lost the race commits on the newer version."""
    store = sharding.ShardStore(spark, workspace(spark, "shards"))
    one, two = docs.where("doc_id < 5"), docs.where("doc_id >= 5")
    monkeypatch.setattr(store, "commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        store.append(one)
    monkeypatch.undo()
    assert store.versions() == []
    store.append(one)
    other = sharding.ShardStore(spark, store.folder)
    listed = store._listed

    def late(batch, schema):  # the other writer commits while this one lists its files
        if other.versions() == [1]:
            other.append(two)
        return listed(batch, schema)

    monkeypatch.setattr(store, "_listed", late)
    store.append(one)
    key = lambda df: sorted(map(str, df.collect()))
    assert store.versions() == [1, 2, 3] and key(store.read()) == key(one.unionByName(two).unionByName(one))
    assert store.vacuum() == 1 and key(store.read()) == key(one.unionByName(two).unionByName(one))


def test_tiers_and_sizes(spark, docs):
    """Compaction leaves no tier with runs to halve, and no file far beyond the target."""
    store = sharding.ShardStore(spark, workspace(spark, "shards"), target_bytes=40_000)
    for k in range(6):
        store.append(docs.where(f"doc_id % 6 = {k}").repartition(4))
    store.compact_fully()
    files = store.manifest().collect()
    small = collections.defaultdict(list)
    for f in files:
        if f["bytes"] < 40_000:
            small[f["tier"]].append(f["bytes"])
    assert all(len(x) < 2 or 2 * -(-sum(x) // 40_000) > len(x) for x in small.values())
    assert sum(f["rows"] for f in files) == docs.where("doc_id is not null").count() and len(files) < 24


# ---------------------------------------------------------------- toxicity


def test_unseen_misspellings_are_caught(spark):
    r = random.Random(6)
    rows = []
    for i in range(900):
        words = prose(i, 60).split(" ")
        if i % 3 == 0:
            words[r.randrange(60)] = r.choice(["horribleword", "nastything"]) + ("" if i % 2 else r.choice(["s", "x", "er"]))
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id bigint, text string")
    y = spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, y)
    got = {x["doc_id"]: x["score"] for x in toxicity.scored(docs, model, keep=["doc_id"]).collect()}
    held = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    assert np.mean([(got[x[0]] >= 0.5) == x[2] for x in held]) > 0.95
    new = spark.createDataFrame([(1, prose(5000, 50) + " nastythinggg"), (2, prose(5001, 50))], "doc_id bigint, text string")
    s = {x["doc_id"]: x["score"] for x in toxicity.scored(new, model, keep=["doc_id"]).collect()}
    assert s[1] > 0.5 > s[2]


def test_long_words_are_scored_whole():
    """An insult late in a text without white space is caught, and n-grams of all of it are used."""
    import pyarrow as pa

    from plycraft.llm.common import string_bytes

    r = random.Random(5)
    bad = "摘要蠢货白痴滚开"
    clean = lambda n: "".join(chr(r.randrange(0x5000, 0x5100)) for _ in range(n))
    texts = [clean(120) + (bad if i % 2 else "") + clean(60) for i in range(200)]
    model = toxicity.train(texts, np.arange(200) % 2 == 1)
    new = [clean(2000) + "_" + clean(500), clean(2000) + bad + clean(500)]
    got = toxicity.score_batch(model, pa.array(new))
    assert got[0] < 0.5 < got[1], got
    for n in (1, 47, 48, 49, 91, 92, 500):
        data, offsets = string_bytes(pa.array(["x " + "".join(chr(r.randrange(97, 123)) for _ in range(n))]))
        start, end, _ = toxicity.segments(np.array([2]), np.array([2 + n]), np.array([0]))
        grams = lambda a, b: {bytes(data[i : i + 6]) for i in range(a, b - 5)}
        assert set().union(*(grams(a, b) for a, b in zip(start, end, strict=True))) == grams(2, 2 + n)
        assert (end - start).max() <= toxicity.WORD_BYTES and end.max() == 2 + n and len(start) == (1 if n <= 48 else len(start))


def test_toxicity_edges(docs, none, labels):
    model = toxicity.fit(docs, labels, rounds=2)
    got = toxicity.scored(docs, model, keep=["doc_id", "kept"]).collect()
    assert len(got) == docs.count() and all(0 <= x["score"] <= 1 for x in got)
    by = {x["doc_id"]: x["score"] for x in got}
    assert by[0] == by[1] == by[2] and by[6] == by[7]
    assert toxicity.scored(none, model, keep=["doc_id"]).count() == 0
    assert all(x["score"] < 1e-9 for x in toxicity.scored(docs, toxicity.fit(docs, labels.limit(0)), keep=["doc_id"]).collect())


# ---------------------------------------------------------------- pieces


def test_pieces_equal_the_library(docs, none):
    c = pieces.codec(pieces.default_model())
    r = random.Random(8)
    odd = ["".join(r.choice(" ▁\n\tabé1.<>s") for _ in range(r.randrange(15))) for _ in range(3000)]
    assert c.chunked and c.encode(odd) == c.sp.encode(odd) and c.encode(odd) == c.sp.encode(odd)
    for x in pieces.encoded(docs, keep=["doc_id", "text", "shard"]).collect():
        ids = c.sp.encode(x["text"] or "")
        assert list(x["ids"]) == ids and x["decoded"] == c.sp.decode(ids) and x["shard"] == "clash"
    assert pieces.encoded(none, keep=["doc_id"]).count() == 0


# ---------------------------------------------------------------- queries


def test_queries_equal_sql(spark, small):
    import duckdb
    import pandas as pd

    from plycraft.llm import queries

    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, small).toPandas(), con.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        plain = lambda f: sorted(repr([None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r]) for r in f[sorted(f.columns)].itertuples(index=False))
        assert [x.replace(".0", "") for x in plain(got)] == [x.replace(".0", "") for x in plain(want)]


@pytest.fixture(scope="module")
def odd(spark, docs, labels, tmp_path_factory):
    """A folder of tables whose rows go wrong easily."""
    from pyspark.sql import functions as F

    folder = str(tmp_path_factory.mktemp("odd"))
    clash = {n: F.lit(n) for n in ("shards", "toxicity_score", "rep", "class_id", "mix_plan", "quality_raw", "held_out", "t", "d")}
    docs.withColumns(clash).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "http://a", "<p>x</p>", "k"), (2, None, None, "k"), (3, "http://a", "<p>x</p>", "k")], "page_id bigint, url string, html string, key string").write.parquet(f"{folder}/pages.parquet")
    return folder


def test_every_query_on_odd_tables(spark, odd, docs):
    """The thin queries, called as the driver calls them: columns and values of their contracts."""
    import sentencepiece
    from tokenizers import Tokenizer

    from plycraft.llm import queries

    rows = docs.collect()
    text_of = lambda want: collections.Counter((r["doc_id"], *want(r["text"] or "")) for r in rows)
    found = lambda name, *columns: collections.Counter(tuple(r[c] for c in ("doc_id", *columns)) for r in queries.QUERIES[name](spark, odd).collect())
    crc = lambda i, n: zlib.crc32(("" if i is None else str(i)).encode()) % n == 0
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    tk = Tokenizer.from_file(tokens.default_tokenizer())
    got = queries.QUERIES["op1_neardup"](spark, odd).collect()
    assert len(got) == len(rows) and {"doc_id", "class_id"} <= set(got[0].asDict())
    assert found("op2_ppm", "n_tokens") == text_of(lambda t: (len(WORD.findall(t)) + 1,))
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in queries.QUERIES["op3_warc"](spark, odd).collect()} == {(1, "revisit", 3), (2, "response", None), (3, "response", None)}
    ids = lambda t: np.array([*tk.encode(t, add_special_tokens=False).ids, 0], "<u4")
    assert found("op4_token_ids", "n_tokens", "ids_crc32") == text_of(lambda t: (len(ids(t)), zlib.crc32(ids(t).tobytes())))
    mixed_rows = queries.QUERIES["op5_mixing"](spark, odd).collect()
    assert collections.Counter((r["doc_id"], r["size"]) for r in mixed_rows) == text_of(lambda t: (len(WORD.findall(t)),))
    assert all(r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"] for r in mixed_rows)
    pad = lambda t: t.encode() + b"\xff" * (max(1, -(-len(t.encode()) // 576)) * 576 - len(t.encode()))
    assert found("op6_media", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == text_of(lambda t: (len(t.encode()), len(pad(t)), hashlib.sha256(pad(t)).hexdigest(), zlib.crc32(pad(t)[-32:])))
    stored = {r["doc_id"]: (r["stored_rows"], r["text_chars"]) for r in queries.QUERIES["op7_sharding"](spark, odd).collect()}
    assert stored == {i: (sum(r["doc_id"] == i for r in rows), sum(len(r["text"] or "") for r in rows if r["doc_id"] == i)) for i in {r["doc_id"] for r in rows}}
    assert found("op8_quality_rules", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == text_of(base_measures)
    toxic = queries.QUERIES["op9_toxicity"](spark, odd).collect()
    assert len(toxic) == len(rows) and all(r["held_out"] == crc(r["doc_id"], 5) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in toxic)
    assert found("op10_sentencepiece", "n_tokens", "ids_sha256", "decoded_sha256") == text_of(lambda t: (len(sp.encode(t)), sha(",".join(map(str, sp.encode(t)))), sha(sp.decode(sp.encode(t)))))


# ---------------------------------------------------------------- pipeline


def test_stages_on_odd_tables(spark, odd, docs):
    """Every stage on nulls, ties, repeated rows, very long texts and clashing names, and on
    the empty table; decisions are those of the operators, row for row."""
    import corpus_pipeline as p
    from plycraft.llm.common import documents

    every = documents(spark, odd)
    key = lambda df: collections.Counter(map(str, df.select(*every.columns).collect()))
    stage = dict(p.STAGES)
    whole = key(every)
    kept = stage["quality_rules"](spark, every, odd)
    assert kept.columns == every.columns and not key(kept) - whole
    assert all(not base_failed(r["text"]) for r in kept.select("text").collect())
    assert not key(stage["toxicity"](spark, every, odd)) - whole
    alone = stage["near_dedup"](spark, every, odd)
    assert alone.columns == every.columns and not key(alone) - whole
    texts = [low(" ".join(WORD.findall(r["text"] or ""))) for r in alone.select("text").collect()]
    assert len(texts) == len(set(texts)) and set(texts) <= {low(" ".join(WORD.findall(r["text"] or ""))) for r in docs.collect()}
    mixed_rows = stage["mixing"](spark, every, odd)
    assert mixed_rows.columns == every.columns and set(key(mixed_rows)) <= set(whole)
    last = stage["sentencepiece"](spark, every, odd)
    assert last.count() == every.count()
    for name, f in p.STAGES:
        assert f(spark, every.limit(0), odd).count() == 0, name


def base_failed(t):
    n, _, _, _, repeated = base_measures(t)
    return n < 50 or 100 * repeated > 50 * n


def test_pipeline(spark, small):
    import corpus_pipeline as p
    from plycraft.llm.common import documents, materialise

    docs = documents(spark, small)
    columns, sizes = docs.columns, [docs.count()]
    for n, (_, stage) in enumerate(p.STAGES):
        docs = materialise(stage(spark, docs, small), "test-pipeline")
        if n < 4:
            assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] > 0 and sizes[4] == sizes[5] > 0
