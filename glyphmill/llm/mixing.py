"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

A mix's total is the most that lets every source hold its share within its repeats. Its blocks go to the sources by highest
quotients share / (2k + 1), a source's blocks to groups of its shards and a group's blocks to its shards likewise by their tokens; a shard's quota is
then filled in seeded order, whole passes first. A source has as many shards as its size asks for, so a large source is no single task, and only one
row a group of shards is ever brought together. What is drawn are texts: copies of one text under several ids or sources of a mix count as one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.session import cut

#: Tokens meant for a shard, shards of a group, and the least blocks of a mix and of a shard.
SHARD_TOKENS, GROUP_SHARDS, MIX_BLOCKS, SHARD_BLOCKS = 1 << 20, 4096, 10_000, 64


def sainte_lague(weights: np.ndarray, seats: int, caps: np.ndarray | None = None) -> np.ndarray:
    """Seats by highest quotients weight / (2k + 1), ties to the earlier entry, none beyond its cap.

    The divisor is found by bisection, so the work does not grow with the seats; the last few go one by one.
    """
    w = np.asarray(weights, float)
    cap = np.full(len(w), np.iinfo(np.int64).max) if caps is None else np.asarray(caps, np.int64)
    cap = np.where(w > 0, cap, 0)
    seats = int(min(seats, sum(int(c) for c in cap)))
    out = np.zeros(len(w), np.int64)
    if seats <= 0:
        return out
    given = lambda d: np.minimum(np.floor(w / d + 0.5), cap.astype(float)).astype(np.int64)
    lo, hi = w[w > 0].min() / (4.0 * seats + 4), 2.0 * w.sum() + 1
    while given(lo).sum() < seats:
        lo /= 2
    for _ in range(200):
        mid = (lo * hi) ** 0.5
        if given(mid).sum() > seats:
            lo = mid
        else:
            hi = mid
    out = given(hi)
    while out.sum() < seats:
        out[int(np.argmax(np.where(out < cap, w / (2 * out + 1), -1.0)))] += 1
    return out


def _group_blocks(groups: dict[tuple[str, str], list[tuple[int, int]]], shards: dict[tuple[str, str], int], targets: list[tuple[str, str, float, int]]) -> list[tuple]:
    """``(mix_name, source, grp, blocks, block, max_repeats)`` for every group of shards, from ``groups``, which has (group, tokens) by mix and source."""
    out = []
    for mix_name in sorted({m for m, *_ in targets}):
        rows = [(s, share, r) for m, s, share, r in sorted(targets) if m == mix_name and (m, s) in groups and share > 0 and r > 0]
        if not rows:
            continue
        have = {s: sum(t for _, t in groups[mix_name, s]) for s, _, _ in rows}
        whole = sum(share for _, share, _ in rows)
        total = int(min(r * have[s] * whole / share for s, share, r in rows))
        least = min(have[s] // shards[mix_name, s] for s, _, _ in rows)
        block = max(1, min(total // MIX_BLOCKS, least // SHARD_BLOCKS))
        blocks = sainte_lague(np.array([share for _, share, _ in rows]), total // block)
        for (s, _, r), n in zip(rows, blocks, strict=True):
            tokens = np.array([t for _, t in groups[mix_name, s]])
            each = sainte_lague(tokens, int(n), -(-tokens * r // block))
            out += [(mix_name, s, g, int(q), block, r) for (g, _), q in zip(groups[mix_name, s], each, strict=True)]
    return out


def _shard_quotas(g: pd.DataFrame) -> pd.DataFrame:
    """A group's blocks among its shards."""
    g = g.sort_values("shard")
    block, r = int(g.block.iloc[0]), int(g.max_repeats.iloc[0])
    tokens = g.shard_tokens.to_numpy()
    return g.assign(quota=sainte_lague(tokens, int(g.blocks.iloc[0]), -(-tokens * r // block)) * block)[["mix_name", "source", "shard", "quota", "shard_tokens", "max_repeats"]]


def mix(sizes: DataFrame, targets: DataFrame, seed: int = 7, shard_tokens: int = SHARD_TOKENS, group_shards: int = GROUP_SHARDS) -> DataFrame:
    """``(mix_name, source, doc_id, copies, tokens)``: the documents drawn for each mix, with how often each is taken.

    ``sizes`` is (doc_id, source, tokens) and, where copies are known, text_key: of the documents of one key in a mix's sources the first by id stands for
    all, so no text is taken more often than its source allows. Sources are compared lower-cased and trimmed. ``targets`` is (mix_name, source, target_share,
    max_repeats) and small. Rows of null source or of null or no tokens are never drawn; a target source without any tokens gets none and the others keep
    their proportions. A document is taken when its middle lies within its shard's quota, so shares err by about one document a shard.
    """
    spark = sizes.sparkSession
    wanted = [(r.mix_name, r.source, float(r.target_share), int(r.max_repeats)) for r in targets.dropna().collect()]
    names = spark.createDataFrame([(m, s) for m, s, *_ in wanted], "mix_name string, source string").distinct()
    rows = sizes.where("tokens > 0").select("doc_id", F.lower(F.trim("source")).alias("source"), F.col("tokens").cast("bigint").alias("tokens"), *(["text_key"] if "text_key" in sizes.columns else []))
    rows = rows.join(F.broadcast(names), "source")  # one row a target
    if "text_key" in sizes.columns:
        first = F.min(F.struct("doc_id", "source", "tokens")).alias("f")
        rows = rows.groupBy("mix_name", F.coalesce(F.col("text_key").cast("string"), F.concat(F.lit("id "), F.col("doc_id").cast("string"))).alias("_k")).agg(first).select("mix_name", "f.*")
    rows = cut(rows.select("mix_name", "source", "doc_id", "tokens"))
    have = {(r.mix_name, r.source): r.t for r in rows.groupBy("mix_name", "source").agg(F.sum("tokens").alias("t")).collect()}  # one row a target
    shards = {k: -(-t // shard_tokens) for k, t in have.items()}
    counts = spark.createDataFrame([(*k, int(n)) for k, n in sorted(shards.items())], "mix_name string, source string, shards bigint")
    rows = rows.join(F.broadcast(counts), ["mix_name", "source"]).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.col("shards"))).withColumn("grp", F.floor(F.col("shard") / group_shards)).drop("shards")
    totals = rows.groupBy("mix_name", "source", "grp", "shard").agg(F.sum("tokens").alias("shard_tokens"))
    groups: dict[tuple[str, str], list[tuple[int, int]]] = {}
    for r in sorted(totals.groupBy("mix_name", "source", "grp").agg(F.sum("shard_tokens").alias("t")).collect()):  # one row for group_shards * shard_tokens tokens
        groups.setdefault((r.mix_name, r.source), []).append((r.grp, r.t))
    blocks = spark.createDataFrame(_group_blocks(groups, shards, wanted), "mix_name string, source string, grp bigint, blocks bigint, block bigint, max_repeats int")
    kinds = "mix_name string, source string, shard bigint, quota bigint, shard_tokens bigint, max_repeats int"
    quota = totals.join(F.broadcast(blocks), ["mix_name", "source", "grp"]).groupBy("mix_name", "source", "grp").applyInPandas(_shard_quotas, kinds)  # group_shards rows at most
    keys = ["mix_name", "source", "shard"]
    order = Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("middle", F.sum("tokens").over(order) - F.col("tokens") / 2)
    passes = F.floor((F.col("quota") - F.col("middle")) / F.col("shard_tokens")) + 1
    drawn = placed.join(quota, keys).withColumn("copies", F.least(F.greatest(passes, F.lit(0)), F.col("max_repeats")).cast("int"))
    return drawn.where("copies > 0").select("mix_name", "source", "doc_id", "copies", "tokens")


def mix_shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """``(mix_name, source, target_share, actual_share, tokens, docs, most_copies)`` for every target, also those that got nothing."""
    got = drawn.groupBy("mix_name", "source").agg(
        F.sum(F.col("copies") * F.col("tokens")).alias("tokens"), F.count(F.lit(1)).alias("docs"), F.max("copies").alias("most_copies")
    )
    full = targets.select("mix_name", "source", "target_share").join(got, ["mix_name", "source"], "left").fillna(0, ["tokens", "docs", "most_copies"])
    return full.withColumn("actual_share", F.try_divide(F.col("tokens"), F.sum("tokens").over(Window.partitionBy("mix_name"))))
