"""Global order, running totals and top rows without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.session import written


def with_global_prefix(df: DataFrame, order: list[Column], total_of: str | None = None, rank: str = "rank", total: str = "running", partitions: int | None = None) -> DataFrame:
    """``df`` with its global rank and, of ``total_of``, the running total in that order.

    Rows are range-partitioned by ``order`` (which must be unique, else a tie may fill one task) and
    written sorted; each part's count and sum, one row per part, become its offsets. Windows stay within
    parts, so no task sees all rows.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = written(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "order")
    sums = parts.groupBy("_part").agg(F.count("*").alias("_n"), F.sum(total_of or F.lit(0)).alias("_s"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"))
    w = Window.partitionBy("_part").orderBy(*order)
    out = parts.join(F.broadcast(offsets), "_part").withColumn(rank, F.row_number().over(w) + F.col("_n0"))
    if total_of:
        out = out.withColumn(total, F.sum(total_of).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_s0"))
    return out.drop("_part", "_n0", "_s0")


def priority_order(keys: DataFrame, failures: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """Keys with a counter first, most failures first, then by key; the others after them in input order. Adds ``rank``."""
    counters = failures.where(F.col("failures").isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max("failures").alias("_f"))
    j = keys.join(counters, keys[key] == counters["_k"], "left").drop("_k")
    known = F.col("_f").isNotNull()
    order = [F.when(known, 0).otherwise(1), F.coalesce(-F.col("_f"), F.lit(0)), F.when(known, F.col(key)), F.col(seq)]
    return with_global_prefix(j, order).withColumnRenamed("_f", "failures")


def _beginning(df: DataFrame, coarse: str, descending: bool, size: str, limit: Column) -> DataFrame:
    """The rows of those values of ``coarse``, in their order, before which the sizes add up to less than ``limit``.

    Sizes are summed per value first, with partial aggregation; only the sums, a row per value (a day, say), are ordered.
    """
    sums = df.groupBy(coarse).agg(F.sum(size).alias("_s"))
    first = F.desc_nulls_last(coarse) if descending else F.asc_nulls_first(coarse)
    w = Window.orderBy(first)
    before = F.coalesce(F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = sums.withColumn("_before", before).withColumn("_whole", F.sum("_s").over(Window.partitionBy())).where(F.col("_before") < limit).select(F.col(coarse).alias("_coarse"))
    return df.join(kept, df[coarse].eqNullSafe(kept["_coarse"]), "left_semi")


def byte_budget(df: DataFrame, order: list[Column], size: str, cap: int, coarse: str | None = None, descending: bool = True) -> DataFrame:
    """The longest prefix in ``order`` whose sizes add up to ``cap`` at most.

    With ``coarse``, the column that ``order`` begins with (such as the day, ``descending`` or not), only the rows of the values that the
    cap reaches are sorted; the others are summed only.
    """
    some = _beginning(df, coarse, descending, size, F.lit(cap + 1)) if coarse else df
    return with_global_prefix(some, order, total_of=size).where(F.col("running") <= cap)


def prune_plan(df: DataFrame, order: list[Column], size: str, cap: int, coarse: str | None = None) -> DataFrame:
    """The rows to delete, oldest first, until what is left fits ``cap``. ``coarse`` as in ``byte_budget``, ascending."""
    whole = df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("_all"))
    some = _beginning(df, coarse, False, size, F.col("_whole") - cap) if coarse else df
    out = with_global_prefix(some, order, total_of=size).crossJoin(F.broadcast(whole))
    return out.where(F.col("_all") - (F.col("running") - F.col(size)) > cap).drop("_all", "rank", "running")


def tail(df: DataFrame, seq: list[str], n: int) -> DataFrame:
    """The last n rows in append order."""
    return df.orderBy(*[F.desc(c) for c in seq]).limit(n)


def first_rows(df: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group. Spark filters ranks before the shuffle too, so a hot group sends n rows per task."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def latest(df: DataFrame, by: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """Per group the values of its greatest row, by partial aggregation."""
    best = F.max_by(F.struct(*keep), F.struct(*order))
    return df.groupBy(*by).agg(best.alias("_b")).select(*by, "_b.*")


def ordered_distinct(df: DataFrame, by: list[str], value: str, seq: str) -> DataFrame:
    """Distinct values of each group with the place of their first occurrence."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.min(seq).alias(seq))


def longest(df: DataFrame, by: list[str], text: str, seq: str, n: int = 30) -> DataFrame:
    """Of groups with more than n rows the n longest, of the others all."""
    return first_rows(df, by, [F.desc(F.length(text)), F.col(seq)], n)
