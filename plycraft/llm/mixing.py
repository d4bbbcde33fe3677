"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Sizes (words) and source totals; targets by water-filling under a cap.
2. Each source is dealt into blocks of about ``block_docs`` documents (more if that were
   over ``MOST_BLOCKS`` blocks in all); a seeded hash
   permutes blocks. An epoch over all blocks is a whole pass; the rest of the target is a
   run of whole blocks, then one boundary block of which single documents are taken
   first-fit. This fixes, exactly, how many block draws each source contributes.
3. A binary tree over output shards splits those quotas: at a node, the left child gets an
   exact number of draws, chosen from the node's sources without replacement (selection
   sampling by seeded hashes, which is the multivariate hypergeometric law). A child keeps
   an interval of each source's permuted draws, so shards are disjoint by construction.
4. A document's copies follow its block's draws to their shards, and are ordered within a
   shard by a seeded hash: the shuffle is local.

Only block rows (one in ``block_docs`` documents) and source rows meet in windows; documents
are joined by (source, block), so a source that holds a third of all rows is spread.

Defined results: a null text has size 0; a null source is a source of its own and sorts
last; equal rows (same id, source and size) share a decision and count with their number;
documents of size 0 take 0 words (a whole pass still emits them); an empty table mixes to
an empty table; extra columns are kept, helper columns take free names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, let, materialise, text_of, word_array

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK_DOCS = 1024
#: At most about so many blocks: with more documents blocks grow, so what meets in the
#: windows over blocks and at the tree's root is bounded.
MOST_BLOCKS = 1 << 20
SHARD_BLOCKS = 64
#: A source's row of the per-source table is repeated so often, and its documents dealt so.
SALTS = 16


def targets(sources: DataFrame, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sources`` (source, source_size, source_docs) with target: shares by weight of the
    total, none above ``cap`` times its size. Sorted by cap/weight, the capped sources are a
    prefix; the level is what is left divided by the weights that are left."""
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    room = sources.withColumn("weight", F.element_at(cycle, (nth % len(weights) + 1).cast("int"))).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum(F.col("source_size").cast("double")).over(Window.partitionBy())
    level = (total - before) / left
    ranked = room.withColumn("level", level).withColumn("capped", F.col("most") / F.col("weight") < F.col("level"))
    # The level of the first uncapped source holds for all that follow.
    free = F.min(F.when(~F.col("capped"), F.struct((F.col("most") / F.col("weight")).alias("r"), F.col("level").alias("level")))).over(Window.partitionBy())
    return ranked.withColumn("target", F.when(F.col("capped"), F.col("most")).otherwise(F.least(F.col("most"), F.col("weight") * free["level"]))).select("source", "source_size", "source_docs", "target")


def _uniform(*parts: Column) -> Column:
    """In [0, 1), from a seeded hash: reruns agree."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") / float(1 << 52)


def _split(leaves: int, quotas: DataFrame, seed: int) -> DataFrame:
    """(source, start, n, shard): the tree over ``leaves`` shards. ``quotas``: source, n."""
    level = quotas.where(F.col("n") > 0).select("source", F.lit(0).cast("long").alias("start"), F.col("n").cast("long").alias("n"), F.lit(0).cast("long").alias("lo"), F.lit(leaves).cast("long").alias("hi"))
    for depth in range(max(0, math.ceil(math.log2(leaves))) if leaves > 1 else 0):
        item = F.struct("source", "start", "n")
        node = level.groupBy("lo", "hi").agg(F.sort_array(F.collect_list(item)).alias("items"), F.sum("n").alias("all"))
        mid = F.col("lo") + F.floor((F.col("hi") - F.col("lo")) / 2)
        want = F.when(F.col("hi") - F.col("lo") > 1, F.floor(F.col("all") * (mid - F.col("lo")) / (F.col("hi") - F.col("lo")))).otherwise(F.lit(0)).cast("long")

        def draw(acc: Column, it: Column) -> Column:
            # Of this source's n draws, how many go left: each goes with probability (still
            # wanted) / (still unseen), so the total is exact.
            one = F.aggregate(
                F.sequence(F.lit(1).cast("long"), it["n"]),
                F.struct(acc["want"].alias("want"), acc["seen"].alias("seen")),
                lambda a, j: let(_uniform(F.lit(seed), F.lit(depth), F.col("lo"), it["source"], it["start"] + j) * a["seen"].cast("double") < a["want"].cast("double"), lambda go: F.struct((a["want"] - F.when(go, 1).otherwise(0)).alias("want"), (a["seen"] - 1).alias("seen"))),
            )
            return let(one, lambda o: F.struct(o["want"].alias("want"), o["seen"].alias("seen"), F.array_append(acc["out"], F.struct(it["source"].alias("source"), it["start"].alias("start"), it["n"].alias("n"), (acc["want"] - o["want"]).alias("left"))).alias("out")))

        empty = F.array().cast("array<struct<source:string,start:bigint,n:bigint,left:bigint>>")
        parts = node.withColumn("want", want).withColumn("mid", mid).select("lo", "hi", "mid", F.aggregate("items", F.struct(F.col("want").alias("want"), F.col("all").alias("seen"), empty.alias("out")), draw)["out"].alias("out"))
        flat = parts.select("lo", "hi", "mid", F.explode("out").alias("o")).select("lo", "hi", "mid", "o.*")
        whole = F.col("hi") - F.col("lo") <= 1
        child = F.array(
            F.struct("source", F.col("start").alias("start"), F.when(whole, F.col("n")).otherwise(F.col("left")).alias("n"), F.col("lo").alias("lo"), F.when(whole, F.col("hi")).otherwise(F.col("mid")).alias("hi")),
            F.struct("source", (F.col("start") + F.col("left")).alias("start"), F.when(whole, F.lit(0)).otherwise(F.col("n") - F.col("left")).alias("n"), F.col("mid").alias("lo"), F.col("hi").alias("hi")),
        )
        level = flat.select(F.explode(child).alias("c")).select("c.*").where(F.col("n") > 0)
    return level.select("source", "start", "n", F.col("lo").alias("shard"))


def mix_plan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block_docs: int = BLOCK_DOCS, shard_blocks: int = SHARD_BLOCKS, seed: int = 20) -> DataFrame:
    """One row per distinct (doc_id, source, size): rows (how many documents it stands
    for), source_size, target, and ``shards``, the output shard of each copy."""
    spark = docs.sparkSession
    sized = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.size(word_array(text_of(F.col(text)))).cast("long").alias("size"))
    items = materialise(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")), "mix-items")
    sources = items.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("source_docs"))
    aims = materialise(targets(sources, cap, weights).coalesce(1), "mix-targets")
    block_docs = max(block_docs, math.ceil((aims.agg(F.sum("source_docs")).first()[0] or 0) / MOST_BLOCKS))
    some = aims.agg(F.sum(F.ceil(F.col("source_docs") / block_docs) * F.greatest(F.lit(1), F.ceil(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))))).alias("draws")).first()
    leaves = max(1, math.ceil((some["draws"] or 0) / shard_blocks))

    whole = F.floor(F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0)) + 1e-12)
    blocks_of = F.greatest(F.lit(1), F.ceil(F.col("source_docs") / block_docs))
    aims = aims.withColumn("whole", whole).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - whole * F.col("source_size"))).withColumn("n_blocks", blocks_of)
    salted = items.withColumnRenamed("source", "_s")
    # Spark broadcasts the per-source table if it is small; else salts spread a hot source
    copies = aims.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = salted.withColumn("_k", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS))).join(copies, F.col("_s").eqNullSafe(F.col("source")) & (F.col("_k") == F.col("_salt"))).drop("_k", "_salt")
    dealt = dealt.drop("_s").withColumn("block", F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size")), F.col("n_blocks")))

    of_source = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), F.col("source"), F.col("block")), "block")
    blocks = dealt.groupBy("source", "block").agg(F.sum(F.col("size") * F.col("rows")).alias("words"), F.first("whole").alias("whole"), F.first("rest").alias("rest"))
    blocks = blocks.withColumn("rank", F.row_number().over(of_source) - 1).withColumn("upto", F.sum("words").over(of_source.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.col("upto") - F.col("words")
    # whole blocks while they fit, then the boundary block in part
    blocks = blocks.withColumn("full", F.col("upto") <= F.col("rest")).withColumn("gap", F.when((F.col("upto") > F.col("rest")) & (start < F.col("rest")), F.floor(F.col("rest") - start)))
    blocks = materialise(blocks.withColumn("n_draws", (F.col("whole") + F.when(F.col("full") | F.col("gap").isNotNull(), 1).otherwise(0)).cast("long")), "mix-blocks")

    numbered = Window.partitionBy("source").orderBy("epoch", "rank")
    draws = blocks.where(F.col("n_draws") > 0).select("source", "block", "rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_draws") - 1)).alias("epoch")).withColumn("t", (F.row_number().over(numbered) - 1).cast("long"))
    quotas = draws.groupBy("source").agg(F.count("*").alias("n"))
    places = _split(leaves, quotas, seed + 2).select(F.col("source").alias("_s"), "shard", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("_t"))
    sent = draws.join(places, F.col("source").eqNullSafe(F.col("_s")) & (F.col("t") == F.col("_t"))).groupBy("source", "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("epoch", "shard"))), lambda x: x["shard"]).alias("shards"))

    # first-fit inside the boundary block of each source (at most one block a source)
    edge = blocks.where(F.col("gap").isNotNull()).select(F.col("source").alias("_s"), F.col("block").alias("_b"), "gap")
    inside = dealt.join(edge, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
    listed = inside.groupBy("source", "block").agg(F.first("gap").alias("gap"), F.sort_array(F.collect_list(F.struct(F.xxhash64(F.lit(seed + 3), F.col("doc_id"), F.col("size")).alias("k"), F.col("doc_id"), F.col("size"), (F.col("size") * F.col("rows")).alias("words")))).alias("items"))
    taking = F.aggregate(
        "items",
        F.struct(F.col("gap").cast("long").alias("gap"), F.array().cast("array<struct<doc_id:bigint,size:bigint>>").alias("out")),
        lambda a, it: F.when(it["words"] <= a["gap"], F.struct((a["gap"] - it["words"]).alias("gap"), F.array_append(a["out"], F.struct(it["doc_id"].alias("doc_id"), it["size"].alias("size"))).alias("out"))).otherwise(a),
    )["out"]
    fits = listed.select(F.col("source").alias("_fs"), F.explode(taking).alias("f")).select("_fs", F.col("f.doc_id").alias("_fd"), F.col("f.size").alias("_fz"))

    per_block = blocks.select(F.col("source").alias("_s"), F.col("block").alias("_b"), F.col("gap").isNotNull().alias("partial")).join(
        sent.select(F.col("source").alias("_s2"), F.col("block").alias("_b2"), "shards"), F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_b") == F.col("_b2")), "left"
    ).drop("_s2", "_b2")
    chosen = dealt.join(per_block, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b"))).join(
        fits, F.col("source").eqNullSafe(F.col("_fs")) & F.col("doc_id").eqNullSafe(F.col("_fd")) & (F.col("size") == F.col("_fz")), "left"
    )
    shards = F.coalesce(F.col("shards"), F.array().cast("array<bigint>"))
    shards = F.when(F.col("partial") & F.col("_fz").isNull(), F.slice(shards, 1, F.greatest(F.size(shards) - 1, F.lit(0)))).otherwise(shards)
    return chosen.select("doc_id", "source", "size", "rows", "source_size", "target", shards.alias("shards"))


def mixed(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 20, **how) -> DataFrame:
    """The mixed corpus: every row of ``docs`` once per copy, with free-named columns for
    the shard and the order inside it (sort a shard by that column: the local shuffle)."""
    size, shard, order, copy, p = (fresh(docs, name) for name in ("mix_size", "mix_shard", "mix_order", "mix_copy", "mix_plan"))
    plan = mix_plan(docs, doc_id=doc_id, text=text, source=source, seed=seed, **how).where(F.size("shards") > 0).select(F.struct("doc_id", "source", "size", "shards").alias(p))
    rows = docs.withColumn(size, F.size(word_array(text_of(docs[text]))).cast("long"))
    joined = rows.join(plan, F.col(doc_id).cast("long").eqNullSafe(F.col(f"{p}.doc_id")) & F.col(source).cast("string").eqNullSafe(F.col(f"{p}.source")) & (F.col(size) == F.col(f"{p}.size")))
    out = joined.select(*docs.columns, F.posexplode(F.col(f"{p}.shards")).alias(copy, shard))
    return out.withColumn(order, F.xxhash64(F.lit(seed + 4), F.col(doc_id), F.col(copy))).drop(copy)
