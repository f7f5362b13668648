"""Mixtures of sources at target shares of tokens.

Documents are placed in blocks of their source by a hash, at most `MAX_BLOCKS` a source, so that the
table of block sizes is bounded whatever the corpus is. Planning works on blocks alone: it finds the
largest size at which every share can be met within the allowed repeats, gives each source whole
passes over its blocks and a last pass over some of them in random order, and splits the block counts
of all sources among the output shards down a binary tree of multivariate hypergeometric draws, so
that every shard is a fair sample and the totals are exact. Each shard then takes its blocks from the
sources' permuted lists and shuffles its documents by itself.

Documents are counted once, then only (id, source, block, tokens) moves: one join with the plan and one
window per cell, a cell being a shard's share of one hash range of its documents' order. The number of
shards grows with the tokens, a shard's cells with its documents, so no task ever sorts more than a
bounded number of rows; a document's place in its shard is the size of the cells before its own plus its
place in it. The one block of a pass that is taken in part is cut by a running sum inside that block.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.session import cut

from .tokenize import count_tokens

#: Bounds of the plan: blocks of a source, documents a block has at least on average, rows of the target table, rows of
#: the plan itself (blocks times repeats) and those of them that are broadcast.
MAX_BLOCKS, BLOCK_DOCS, MAX_TARGETS, MAX_PLAN, BROADCAST_PLAN = 1024, 64, 2000, 2_000_000, 100_000
#: Tokens of a shard, shards at least and at most, and documents a cell has on average.
SHARD_TOKENS, SHARDS, MAX_SHARDS, CELL_DOCS = 1 << 27, 16, 4096, 1 << 18
_LIMIT = "mix_name string, source string, block int, copy int, take bigint, shard int"


def split_tree(counts: np.ndarray, sizes: list[int], rng: np.random.Generator) -> list[np.ndarray]:
    """`counts` of each source split among shards of the given sizes (of the same total)."""
    if len(sizes) == 1:
        return [counts]
    half = len(sizes) // 2
    left = rng.multivariate_hypergeometric(counts, sum(sizes[:half]))
    return split_tree(left, sizes[:half], rng) + split_tree(counts - left, sizes[half:], rng)


def amounts(blocks: dict[str, list[tuple[int, int]]], targets: list[tuple[str, float, int]], total: float | None = None) -> list[tuple[str, int, int, float]]:
    """(source, tokens it has, most repeats, tokens wanted of it) of one mixture.

    `blocks` has (block, tokens) by source, `targets` (source, share, most repeats). Sources without
    tokens are left out and the other shares scaled up. Without `total` the mixture is as large as it
    can be with every share met; with a larger one, sources that run out give all they may."""
    own = {s: sum(t for _, t in blocks.get(s, ())) for s, _, _ in targets}
    live = [(s, share, int(most)) for s, share, most in targets if share > 0 and most > 0 and own[s] > 0]
    whole = sum(share for _, share, _ in live)
    size = total if total is not None else min((own[s] * most / (share / whole) for s, share, most in live), default=0)
    return [(s, own[s], most, min(size * share / whole, own[s] * most)) for s, share, most in live]


def plan_mix(blocks: dict[str, list[tuple[int, int]]], targets: list[tuple[str, float, int]], shards: int, rng: np.random.Generator, total: float | None = None) -> list[tuple]:
    """(source, block, copy, take, shard) of one mixture (see `amounts`); take is null for a whole block, else
    the tokens wanted of it."""
    live = amounts(blocks, targets, total)
    if not live:
        return []
    draws: dict[str, list[tuple[int, int, int | None]]] = {}
    for s, own, most, wanted in live:
        passes = min(most, int(wanted / own + 1e-9))
        some = [(b, k, None) for k in range(passes) for b, _ in blocks[s]]
        rest = wanted - passes * own
        for i in rng.permutation(len(blocks[s])) if passes < most and rest >= 1 else ():
            b, t = blocks[s][i]
            some.append((b, passes, None if t <= rest else int(rest)))
            rest -= t
            if rest < 1:
                break
        draws[s] = [some[i] for i in rng.permutation(len(some))]
    order = sorted(draws)
    counts = np.array([len(draws[s]) for s in order])
    n = int(counts.sum())
    sizes = [n * (i + 1) // shards - n * i // shards for i in range(shards)]
    at, out = dict.fromkeys(order, 0), []
    for shard, part in enumerate(split_tree(counts, sizes, rng)):
        for s, k in zip(order, part):
            out += [(s, b, copy, take, shard) for b, copy, take in draws[s][at[s] : at[s] + k]]
            at[s] += int(k)
    return out


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 42, shards: int | None = None, total: float | None = None) -> DataFrame:
    """(mix_name, source, key, copy, n_tokens, shard, pos): the documents of every mixture.

    copy counts a document's uses from 0 on and stays below max_repeats; pos is the place in the shard.
    Without `shards` a mixture has one for every `SHARD_TOKENS` tokens, `SHARDS` at least. A plan of more than `MAX_PLAN` rows
    (blocks times repeats) is refused.
    Documents with a null key or source, and those without tokens (null or empty texts), belong to no
    mixture. A key that occurs more than once is one document (its largest text). Targets that name no
    documents give none; repeated (mix_name, source) targets are added up. The same seed gives the
    same mixtures.
    """
    named = [r for r in targets.select("mix_name", "source", "target_share", "max_repeats").dropna().limit(MAX_TARGETS + 1).collect()]
    if len(named) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    wanted: dict[str, dict[str, tuple[float, int]]] = {}
    for name, s, share, most in named:
        old = wanted.setdefault(name, {}).get(s, (0.0, 0))
        wanted[name][s] = (old[0] + share, max(old[1], most))
    sources = sorted({r[1] for r in named})
    spark = docs.sparkSession
    counted = count_tokens(docs.where(F.col(key).isNotNull() & F.col(source).isin(sources)), key, source, text=text).where("n_tokens > 0")
    once = cut(counted.groupBy(F.col(key).alias("id")).agg(F.max_by(source, "n_tokens").alias("source"), F.max("n_tokens").alias("n_tokens")))
    n_docs = {r[0]: r[1] for r in once.groupBy("source").count().collect()}
    n_blocks = {s: min(MAX_BLOCKS, max(1, math.ceil(n / BLOCK_DOCS))) for s, n in n_docs.items()}
    number = F.coalesce(*(F.when(F.col("source") == s, F.lit(n)) for s, n in sorted(n_blocks.items())), F.lit(1))
    place = F.xxhash64(F.lit(seed), F.col("id"))
    placed = once.withColumns({"block": F.pmod(place, number).cast("int"), "rank": F.xxhash64(F.lit(seed + 1), F.col("id"))})
    blocks: dict[str, list[tuple[int, int]]] = {}
    for s, b, t in placed.groupBy("source", "block").agg(F.sum("n_tokens")).orderBy("source", "block").collect():
        blocks.setdefault(s, []).append((b, t))
    plan, cells = [], {}
    for i, name in enumerate(sorted(wanted)):
        rng = np.random.default_rng([seed, i])
        aims = [(s, *v) for s, v in sorted(wanted[name].items())]
        wanting = amounts(blocks, aims, total)
        if len(plan) + sum(len(blocks[s]) * math.ceil(want / own) for s, own, _, want in wanting) > MAX_PLAN:
            raise ValueError(f"the plan would have more than {MAX_PLAN} rows: lower max_repeats, or give a total")
        n = shards or min(MAX_SHARDS, max(SHARDS, math.ceil(sum(want for *_, want in wanting) / SHARD_TOKENS)))
        rows = plan_mix(blocks, aims, n, rng, total)
        plan += [(name, *r) for r in rows]
        used = sum(n_docs[r[0]] / n_blocks[r[0]] for r in rows)
        cells[name] = max(1, math.ceil(used / n / CELL_DOCS))
    drawn_plan = spark.createDataFrame(plan, _LIMIT)
    drawn = placed.join(F.broadcast(drawn_plan) if len(plan) <= BROADCAST_PLAN else drawn_plan, ["source", "block"])
    within = W.partitionBy("mix_name", "source", "block", "copy").orderBy("rank", "id").rowsBetween(W.unboundedPreceding, W.currentRow)
    part = drawn.where("take is not null and n_tokens <= take").withColumn("sum", F.sum("n_tokens").over(within)).where("sum - n_tokens / 2 <= take").drop("sum")
    order = F.xxhash64(F.lit(seed + 2), F.col("mix_name"), F.col("id"), F.col("copy"))
    many = F.coalesce(*(F.when(F.col("mix_name") == m, F.lit(float(k))) for m, k in sorted(cells.items())), F.lit(1.0))
    # cells are ranges of the order's hash, so that places follow from the sizes of the cells before
    chosen = drawn.where("take is null").unionByName(part).withColumn("order", order)
    chosen = cut(chosen.withColumn("cell", F.least(F.floor((F.col("order") / F.lit(2.0**64) + 0.5) * many), many - 1).cast("int")).drop("take", "rank", "block"))
    before = W.partitionBy("mix_name", "shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    sizes = chosen.groupBy("mix_name", "shard", "cell").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = W.partitionBy("mix_name", "shard", "cell").orderBy("order", "id", "copy")
    ranked = chosen.withColumn("at", F.row_number().over(inside) - 1).join(sizes, ["mix_name", "shard", "cell"])
    return ranked.select("mix_name", "source", F.col("id").alias(key), "copy", "n_tokens", "shard", (F.col("base") + F.col("at")).alias("pos"))


def mix_report(mixed: DataFrame, targets: DataFrame, key: str = "doc_id") -> DataFrame:
    """(mix_name, source, target_share, max_repeats, n_uses, n_docs, most_used, n_tokens, actual_share) of
    every target, those without documents too."""
    used = mixed.groupBy("mix_name", "source").agg(
        F.count(F.lit(1)).alias("n_uses"),
        F.sum((F.col("copy") == 0).cast("bigint")).alias("n_docs"),
        (F.max("copy") + 1).alias("most_used"),
        F.sum("n_tokens").alias("n_tokens"),
    )
    joined = targets.select("mix_name", "source", "target_share", "max_repeats").join(used, ["mix_name", "source"], "left")
    whole = F.sum("n_tokens").over(W.partitionBy("mix_name"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_uses", "n_docs", "most_used", "n_tokens")}
    return joined.withColumns(zero).withColumn("actual_share", F.coalesce(F.round(F.try_divide(F.col("n_tokens"), whole), 6), F.lit(0.0)))
