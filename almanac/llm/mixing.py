"""Mixing sources to target weights: exact block quotas, dealt to shards by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.tokens import ByteTokenizer, token_counts
from almanac.session import ship, written


@dataclass(frozen=True)
class MixParameters:
    """A shard is some ``shard_tokens / block_tokens`` blocks whatever the size of the data; ``subtree`` shards are dealt at a time."""

    seed: int = 17
    block_tokens: int = 1 << 16
    shard_tokens: int = 1 << 22
    max_targets: int = 10_000
    subtree: int = 1 << 10


def water_fill(weights: dict[str, float], caps: dict[str, float], total: float) -> dict[str, float]:
    """Quotas in proportion to the weights, none above its cap; what a capped source leaves goes to the others."""
    quota = dict.fromkeys(weights, 0.0)
    open_ = {s for s, w in weights.items() if w > 0 and caps.get(s, 0) > 0}
    left = total
    while open_ and left > 1e-9:
        w = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / w >= caps[s]}
        if not full:
            for s in open_:
                quota[s] = left * weights[s] / w
            break
        for s in full:
            quota[s] = caps[s]
        left -= sum(caps[s] for s in full)
        open_ -= full
    return quota


def splitting_tree(counts: list[int], shards: int, seed: list[int], first: int = 0, end: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(shard, begins, units)`` of the shards from ``first`` to before ``end``: of each source the units from place ``begins`` on.

    A node's units are halved among its two halves of shards by one multivariate-hypergeometric draw, so shards differ by at most
    one unit and every deal without regard to sources is equally likely. A node's draw depends on the seed and the node only: any
    part of the tree can be dealt by itself, walking down to it from the root. At most 10^9 units.
    """
    end = shards if end is None else end
    if sum(counts) >= 10**9:
        raise ValueError("10^9 units or more in one mix; enlarge block_tokens")
    stack = [(0, shards, np.array(counts, np.int64), np.zeros(len(counts), np.int64))]
    while stack:
        a, b, units, begins = stack.pop()
        if b <= first or a >= end:
            continue
        if b - a == 1:
            yield a, begins, units
            continue
        total, half = int(units.sum()), (b - a) // 2
        base, more = divmod(total, b - a)
        want = base * half + min(more, half)
        left = np.random.default_rng([*seed, a, b]).multivariate_hypergeometric(units, want, method="marginals") if total else units
        stack.append((a + half, b, units - left, begins + left))
        stack.append((a, a + half, left, begins))


def mix_quotas(targets: list, have: dict[str, int], all_tokens: int) -> list[tuple[int, str, float, int]]:
    """``(mix, source, target share, quota)`` of every target, over the bounded tables of targets and source totals."""
    quotas = []
    for mix in sorted({t["mix_id"] for t in targets}):
        rows = [t for t in targets if t["mix_id"] == mix]
        weight: dict[str, float] = {}
        repeats: dict[str, int] = {}
        for t in rows:
            weight[t["source"]] = weight.get(t["source"], 0.0) + max(0.0, t["weight"] or 0.0)
            n = 1 if t["max_repeats"] is None else max(0, t["max_repeats"])
            repeats[t["source"]] = min(n, repeats.get(t["source"], n))
        total = max(0.0, max((t["total_fraction"] or 0.0) for t in rows)) * all_tokens
        caps = {s: repeats[s] * have.get(s, 0) for s in weight}
        quota = water_fill(weight, caps, total)
        whole = sum(weight.values()) or 1.0
        quotas += [(mix, s, weight[s] / whole, min(round(quota[s]), caps[s])) for s in sorted(weight)]
    return quotas


def _units(blocks: DataFrame, quotas: list[tuple[int, str, float, int]], have: dict[str, int], p: MixParameters) -> DataFrame:
    """``mix_id, source, block, copy, place, keep``: the blocks that meet each quota, in a random order of their own per copy.

    Whole copies take all blocks of a source; the last takes the first ones of its order up to the quota, of the block that passes
    it only ``keep`` tokens. ``place`` runs over a source's units without a gap. Orders and running sums have two levels, buckets and blocks within,
    each about the square root of the number of blocks: no window holds more.
    """
    spark = blocks.sparkSession
    plan = [(m, s, q // have[s], q % have[s], -(-q // have[s]), 1 + isqrt(ceil(have[s] / p.block_tokens))) for m, s, _, q in quotas if q > 0]
    wanted = F.broadcast(spark.createDataFrame(plan, "mix_id int, source string, _full long, _rest long, _copies long, _buckets long"))
    n_blocks = F.broadcast(blocks.groupBy("source").agg(F.count("*").alias("_all")))
    u = blocks.join(wanted, "source").join(n_blocks, "source").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    u = u.withColumn("_want", F.when(F.col("copy") == F.col("_full"), F.col("_rest"))).withColumn("_h", F.xxhash64(F.lit(p.seed), "mix_id", "source", "copy", "block"))
    u = u.withColumn("_b", F.pmod("_h", F.col("_buckets")))
    own = ["mix_id", "source", "copy"]
    before = Window.partitionBy(*own).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = u.groupBy(*own, "_b").agg(F.count("*").alias("_n"), F.sum("tokens").alias("_t"))
    sums = sums.select(*own, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_t0"))
    j = u.join(sums, [*own, "_b"]).where("_want IS NULL OR _t0 < _want")
    w = Window.partitionBy(*own, "_b").orderBy("_h", "block")
    j = j.withColumn("_rank", F.col("_n0") + F.row_number().over(w) - 1).withColumn("_left", F.col("_want") - F.col("_t0") - F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("tokens"))
    return j.where("_want IS NULL OR _left > 0").select(
        *own, "block", (F.col("copy") * F.col("_all") + F.col("_rank")).alias("place"), F.when(F.col("_left") < F.col("tokens"), F.col("_left")).alias("keep")
    )


def _dealt(spark, counts: dict[int, dict[str, int]], shards: dict[int, int], p: MixParameters) -> DataFrame:
    """``mix_id, source, place, shard``: the splitting trees of all mixes, dealt in parts by the executors."""
    roots = spark.createDataFrame(list(shards.items()), "mix_id int, shards long")
    parts = roots.select("mix_id", "shards", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1, F.lit(p.subtree).cast("long"))).alias("first"))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for mix, n, first in batch.itertuples(index=False):
                sources = sorted(counts[mix])
                tree = splitting_tree([counts[mix][s] for s in sources], int(n), [p.seed, int(mix)], int(first), int(min(n, first + p.subtree)))
                rows = [(mix, sources[k], shard, begins[k], units[k]) for shard, begins, units in tree for k in np.flatnonzero(units)]
                yield pd.DataFrame(rows, columns=["mix_id", "source", "shard", "begin", "units"])

    dealt = parts.repartition("mix_id", "first").mapInPandas(deal, "mix_id int, source string, shard int, begin long, units long")
    return dealt.select("mix_id", "source", F.explode(F.sequence("begin", F.col("begin") + F.col("units") - 1)).alias("place"), "shard")


def mix_sizes(sizes: DataFrame, targets: DataFrame, p: MixParameters = MixParameters(), id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``mix`` over documents whose sizes are known: ``_id, source, tokens``, a table that may be read several times."""
    spark = sizes.sparkSession
    ship(spark)
    rows = targets.where("mix_id IS NOT NULL AND source IS NOT NULL").select("mix_id", "source", "weight", "max_repeats", "total_fraction").limit(p.max_targets + 1).collect()
    if len(rows) > p.max_targets:
        raise ValueError(f"more than {p.max_targets} targets")
    sizes = sizes.where("tokens > 0")
    wanted = sorted({r["source"] for r in rows})
    by_target = F.when(F.col("source").isin(wanted), F.col("source")) if wanted else F.lit(None).cast("string")
    totals = {r["s"]: r["n"] for r in sizes.groupBy(by_target.alias("s")).agg(F.sum("tokens").alias("n")).collect()}
    have = {s: n for s, n in totals.items() if s is not None}
    quotas = mix_quotas(rows, have, sum(totals.values()))
    of = F.broadcast(spark.createDataFrame([(s, ceil(n / p.block_tokens)) for s, n in have.items()], "source string, _n long"))
    blocked = sizes.join(of, "source").withColumn("block", F.pmod(F.xxhash64(F.lit(p.seed), "_id"), F.col("_n"))).drop("_n")
    blocks = blocked.groupBy("source", "block").agg(F.sum("tokens").alias("tokens"))
    units = written(_units(blocks, quotas, have, p), "units")
    counts: dict[int, dict[str, int]] = {}
    for r in units.groupBy("mix_id", "source").agg(F.count("*").alias("n")).collect():
        counts.setdefault(r["mix_id"], {})[r["source"]] = r["n"]
    shards = {m: max(1, ceil(sum(q for x, _, _, q in quotas if x == m) / p.shard_tokens)) for m in counts}
    placed = units.join(_dealt(spark, counts, shards, p), ["mix_id", "source", "place"]).drop("place")
    salt = F.xxhash64(F.lit(p.seed + 1), "_id", "copy", "mix_id")
    run = Window.partitionBy("mix_id", "source", "copy", "block").orderBy(salt, "_id")
    part = (  # one unit per target at most
        blocked.join(F.broadcast(placed.where("keep IS NOT NULL")), ["source", "block"]).withColumn("_sum", F.sum("tokens").over(run.rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.col("_sum") - F.col("tokens") / 2 <= F.col("keep")).drop("_sum")
    )
    selection = blocked.join(placed.where("keep IS NULL"), ["source", "block"]).unionByName(part)
    place = F.row_number().over(Window.partitionBy("mix_id", "shard").orderBy(salt, "_id", "copy"))
    selection = selection.select("mix_id", "shard", place.alias("position"), F.col("_id").alias(id_col), "source", F.col("copy").cast("int").alias("copy"), "tokens")

    got = selection.groupBy("mix_id", "source").agg(
        F.sum("tokens").alias("tokens"), F.count("*").alias("n_docs"), (F.max("copy") + 1).alias("max_uses")
    )
    quota_table = spark.createDataFrame(quotas, "mix_id int, source string, target_share double, quota long")
    report = quota_table.join(got, ["mix_id", "source"], "left").na.fill(0, ["tokens", "n_docs", "max_uses"])
    whole = Window.partitionBy("mix_id")
    share = F.when(F.sum("tokens").over(whole) > 0, F.col("tokens") / F.sum("tokens").over(whole)).otherwise(0.0)
    report = report.select("mix_id", "source", "target_share", "quota", "tokens", share.alias("actual_share"), "n_docs", "max_uses")
    return selection, report


def mix(
    docs: DataFrame, targets: DataFrame, tokenizer: ByteTokenizer, p: MixParameters = MixParameters(),
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """The selection and the report.

    Selection: ``mix_id, shard, position, <id_col>, source, copy, tokens``. A shard's documents stand in
    random order. Report: ``mix_id, source, target_share, quota, tokens, actual_share, n_docs, max_uses`` for
    every target.

    A mix has ``total_fraction`` of all documents' tokens. Each source gets its share of it, a source without
    enough documents all that ``max_repeats`` allows; what it leaves goes to the others by weight, so
    shares among sources that aren't exhausted stay as wanted. Quotas are met to within half a document. Copies of
    a source follow each other, so that a document's copies lie far apart where the source fills several shards.

    Defined cases: null and empty texts have no tokens and are never chosen, null sources neither (their
    tokens count for the total); a target without documents is reported with 0; null or negative weights count as 0,
    a null ``max_repeats`` as 1; repeated targets add up, with the least ``max_repeats``; targets with null mix
    or source are ignored; document ids must be unique, else a copy of an id counts as one more document;
    empty tables give an empty selection; other columns are ignored.

    Scale: one pass over the texts gives a narrow table of sizes, written to the shared folder; the
    sizes are summed per block with partial aggregation. Blocks, units and deals are tables; the driver sees a row per target
    only. A source that holds a third of all rows is many blocks; a shard's window and the one partly
    used block per source and mix hold a bounded number of tokens. Shards have some ``shard_tokens`` at every size.
    """
    known = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), F.col(text_col).alias("_t"))
    return mix_sizes(written(token_counts(known, ["_id", "source"], "_t", tokenizer).where("tokens > 0"), "sizes"), targets, p, id_col)
