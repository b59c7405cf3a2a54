"""Keyed state, folded over a batch: a key with a third of all rows is spread over ranges of its sequence.

Each function equals the row-by-row fold over the batch in the order of ``seq`` (unique per key), starting from the prior state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions import predicates as P
from almanac.operators.order import first_rows

#: Width of the ranges of ``seq`` that are folded by themselves.
SEGMENT = 1 << 16


def _since(batch: DataFrame, key: str, seq: str, reset: Column, count: Column, segment: int = SEGMENT) -> DataFrame:
    """Per key: the place of its last reset and how often ``count`` holds after it.

    The rows are shuffled once, by key and range of ``seq``, as place and two flags: a range has at most ``segment`` rows of a key. Each range
    gives one row, and a key's ranges are folded from the last backwards.
    """
    rows = batch.select(F.col(key).alias("_k"), F.col(seq).alias("_q"), F.coalesce(reset, F.lit(False)).alias("_r"), count.alias("_c")).withColumn("_seg", F.floor(F.col("_q") / segment))
    later = Window.partitionBy("_k", "_seg").orderBy(F.desc("_q")).rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.coalesce(F.sum(F.col("_r").cast("int")).over(later), F.lit(0)) == 0
    segments = rows.withColumn("_open", open_).groupBy("_k", "_seg").agg(
        F.max(F.when(F.col("_r"), F.col("_q"))).alias("_last"), F.count_if(F.col("_c") & ~F.col("_r") & F.col("_open")).alias("_n")
    )
    after = Window.partitionBy("_k").orderBy(F.desc("_seg")).rowsBetween(Window.unboundedPreceding, -1)
    counts = F.count("_last").over(after) == 0
    return segments.withColumn("_counts", counts).groupBy(F.col("_k").alias(key)).agg(F.max("_last").alias("_last"), F.sum(F.when(F.col("_counts"), F.col("_n")).otherwise(0)).alias("_n"))


def consecutive_failures(batch: DataFrame, prior: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """``key, failures``: 0 after a result that is fine, else one more per failure. Keys not in the batch keep their counter, never below 0."""
    rows = batch.where(F.length(F.trim(key)) > 0)
    fine = F.col("status").isin(*P.FINE)
    new = _since(rows, key, seq, F.coalesce(fine, F.lit(False)), ~F.coalesce(fine, F.lit(False)))
    old = prior.where(F.col(key).isNotNull()).groupBy(key).agg(F.greatest(F.max("failures"), F.lit(0)).alias("_old"))
    out = new.join(old, key, "full_outer")
    return out.select(key, (F.when(F.col("_last").isNull(), F.coalesce("_old", F.lit(0))).otherwise(0) + F.coalesce("_n", F.lit(0))).cast("long").alias("failures"))


def pruned(counters: DataFrame, recipes: DataFrame, key: str = "key") -> DataFrame:
    dead = recipes.where(P.inactive(F.col("skip"), F.col("status"))).select(F.col("key").alias(key)).distinct()
    return counters.join(dead, key, "left_anti")


def strikes(probes: DataFrame, prior: DataFrame, key: str = "key", seq: str = "seq", limit: int = 2) -> DataFrame:
    """``key, strikes, status, last_result``: unknown hosts count up to a candidate for inactivity, an answer resets, other errors change nothing."""
    result = F.col("result")
    n = _since(probes, key, seq, result == "ok", result == "nxdomain")
    told = result.isin("ok", "nxdomain")
    last = probes.groupBy(key).agg(F.max_by("result", seq).alias("last_result"), F.max_by(F.when(told, result), F.when(told, F.col(seq))).alias("_told"))
    old = prior.select(key, F.col("strikes").alias("_s"), F.col("status").alias("_st"))
    j = n.join(last, key).join(old, key, "left")
    s = F.when(F.col("_last").isNull(), F.coalesce("_s", F.lit(0))).otherwise(0) + F.col("_n")
    status = (
        F.when(F.col("_told") == "ok", "ok").when(F.col("_told").isNotNull() & (s >= limit), "inactive_candidate")
        .when(F.col("_told").isNotNull(), "nxdomain_watch").otherwise(F.coalesce("_st", F.lit("unknown")))
    )
    return j.select(key, s.cast("long").alias("strikes"), status.alias("status"), "last_result")


def confidence(changes: DataFrame, key: str = "key", seq: str = "seq", value: str = "new_url") -> DataFrame:
    """``key, value, confidence``: how many of the latest changes in a row gave the same value."""
    # A run of equal values is a row: the last run's length is the count
    rows = changes.select(F.col(key).alias("_k"), F.col(seq).alias("_q"), F.col(value).alias("_x")).withColumn("_seg", F.floor(F.col("_q") / SEGMENT))
    w = Window.partitionBy("_k", "_seg").orderBy(F.desc("_q"))
    tail = F.first("_x").over(w)
    same = F.coalesce(F.sum(F.when(F.col("_x").eqNullSafe(F.col("_tail")), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) == 0
    segments = rows.withColumn("_tail", tail).withColumn("_same", same).groupBy("_k", "_seg").agg(
        F.max_by("_x", "_q").alias("_tail"), F.count_if("_same").alias("_n"), F.bool_and("_same").alias("_whole")
    )
    back = Window.partitionBy("_k").orderBy(F.desc("_seg"))
    ends = F.max(~(F.col("_whole") & F.col("_tail").eqNullSafe(F.col("_v")))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    last = segments.withColumn("_v", F.first("_tail").over(back)).withColumn("_ended", F.coalesce(ends, F.lit(False)))
    counts = F.when(~F.col("_ended") & F.col("_tail").eqNullSafe(F.col("_v")), F.col("_n")).otherwise(0)
    return last.groupBy(F.col("_k").alias(key)).agg(F.max_by("_v", "_seg").alias(value), F.sum(counts).alias("confidence"))


def upserted_patterns(seen: DataFrame, by: list[str], example: str, seq: str, most: int = 12) -> DataFrame:
    """``by, success_count, examples``: the first distinct examples in order of appearance."""
    counts = seen.groupBy(*by).agg(F.count("*").alias("success_count"))
    first = seen.where(F.col(example).isNotNull()).groupBy(*by, example).agg(F.min(seq).alias("_at"))
    examples = first_rows(first, by, [F.col("_at")], most).groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", example))), lambda x: x[example]).alias("examples")
    )
    return counts.join(examples, by, "left")


def upserted_index(entries: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """The last value written for each key."""
    return entries.groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias(value))


def merged_records(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """New values over old ones; blank ones leave the old."""
    n = new.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_{f}") for f in fields])
    j = old.join(n, old[key] == n["_k"], "full_outer")
    return j.select(F.coalesce(F.col("_k"), F.col(key)).alias(key), *[F.coalesce(F.nullif(F.trim(F.col(f"_{f}").cast("string")), F.lit("")), F.col(f).cast("string")).alias(f) for f in fields])


def first_outcome(attempts: DataFrame, by: list[str], keep: list[str], step: str = "step") -> DataFrame:
    """Outcome of a chain of attempts: the first success, else the last failure."""
    ok = F.col("status").isin("ok", "html_link")
    rank = F.struct(ok.cast("int"), F.when(ok, -F.col(step)).otherwise(F.col(step)))
    return attempts.groupBy(*by).agg(F.max_by(F.struct(*keep), rank).alias("_b")).select(*by, "_b.*")
