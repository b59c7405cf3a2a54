"""What changed between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanac.session import norm_key


def _value_hash(cols: list[str]):
    """Hash in which nulls equal each other, differ from every value and keep their place."""
    parts = []
    for c in cols:
        parts += [F.col(c).isNull(), F.col(c)]
    return F.xxhash64(*parts)


#: Snapshots up to which the numbering is broadcast (some 60 bytes each), rows from which a key of a group is hot, and the most such keys.
BROADCAST_SNAPSHOTS = 200_000
HOT_ROWS = 1_000_000
MOST_HOT = 10_000


def _measured(rows: DataFrame, numbers: DataFrame, hot_rows: int) -> tuple[int, list[tuple]]:
    """Number of snapshots, and the (group, key) pairs with ``hot_rows`` rows or more, in one job of partial aggregations."""
    hot = rows.groupBy("_g", "_k").agg(F.count("*").alias("_n")).where(F.col("_n") >= hot_rows).orderBy(F.desc("_n")).limit(MOST_HOT)
    count = numbers.agg(F.count("*").alias("_n")).select(F.lit(None).alias("_g"), F.lit(None).cast("string").alias("_k"), "_n")
    got = hot.select("_g", "_k", "_n").unionByName(count).collect()
    return next(r["_n"] for r in got if r["_g"] is None), [(r["_g"], r["_k"]) for r in got if r["_g"] is not None]


def snapshot_changes(
    df: DataFrame,
    group: str,
    snapshot: str,
    key: str,
    values: list[str],
    recency: list[str],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Added, removed and changed keys of every two consecutive snapshots of a group.

    The rows of one (``group``, ``snapshot``) are a full snapshot. A group's snapshots are
    numbered; each key's rows are windowed by that number: a differing lagged hash is a change,
    a gap in the numbers is a removal and, after it, an addition.

    Returns ``group, snapshot, key, change``; ``snapshot`` is the later one.

    Defined cases: rows whose key, group or snapshot is null are ignored; keys are compared
    trimmed and lower-cased, a blank key is a key; of several rows for a key in a snapshot the
    greatest by ``recency`` counts (nulls lowest); repeated rows change nothing; values may be
    null and nulls equal each other; a group's first snapshot gives no rows; an empty table gives
    an empty result; other columns are ignored.

    Scale: the rows are shuffled once, by (group, key), narrowed to hashes; the last row of each key and snapshot and
    the window are found in that partitioning, in one sort order. Keys with ``hot_rows`` rows or more in
    a group (counted first, with partial aggregation; the ``MOST_HOT`` greatest) are reduced to their last rows per snapshot before
    it, also by partial aggregation. The numbering, a row per snapshot, is counted and broadcast up to
    ``BROADCAST_SNAPSHOTS``, beyond that joined as the planner chooses.
    """
    rows = (
        df.select(
            F.col(group).alias("_g"),
            norm_key(key).alias("_k"),
            F.col(snapshot).alias("_s"),
            _value_hash(values).alias("_h"),
            F.struct(*[F.col(c) for c in recency]).alias("_r"),
        )
        .where("_g IS NOT NULL AND _s IS NOT NULL")
    )
    numbers = rows.select("_g", "_s").distinct()
    rows = rows.where("_k IS NOT NULL")
    n_snapshots, hot = _measured(rows, numbers, hot_rows)
    order = Window.partitionBy("_g").orderBy("_s")
    numbers = numbers.select(
        "_g", "_s", F.row_number().over(order).alias("_i"), F.lead("_s").over(order).alias("_next")
    )
    if n_snapshots <= BROADCAST_SNAPSHOTS:
        numbers = F.broadcast(numbers)
    if hot:
        few = F.broadcast(df.sparkSession.createDataFrame(hot, rows.select("_g", "_k").schema))
        reduced = rows.join(few, ["_g", "_k"], "left_semi").groupBy("_g", "_k", "_s").agg(F.max_by("_h", "_r").alias("_h"), F.max("_r").alias("_r"))
        rows = rows.join(few, ["_g", "_k"], "left_anti").unionByName(reduced)
    last = rows.repartition("_g", "_k").groupBy("_g", "_k", "_s").agg(F.max_by("_h", "_r").alias("_h"))
    w = Window.partitionBy("_g", "_k").orderBy("_s")
    marked = last.join(numbers, ["_g", "_s"]).select(
        "_g", "_k", "_s", "_i", "_h", "_next",
        F.lag("_i").over(w).alias("_pi"), F.lag("_h").over(w).alias("_ph"), F.lead("_i").over(w).alias("_ni"),
    )
    came = F.when((F.col("_i") > 1) & (F.col("_pi").isNull() | (F.col("_pi") < F.col("_i") - 1)), F.lit("added")).when(
        (F.col("_pi") == F.col("_i") - 1) & (F.col("_ph") != F.col("_h")), F.lit("changed")
    )
    went = F.when(
        F.col("_next").isNotNull() & (F.col("_ni").isNull() | (F.col("_ni") > F.col("_i") + 1)), F.lit("removed")
    )
    events = F.array(F.struct(F.col("_s").alias("s"), came.alias("c")), F.struct(F.col("_next").alias("s"), went.alias("c")))
    return (
        marked.select("_g", "_k", F.explode(F.filter(events, lambda e: e["c"].isNotNull())).alias("e"))
        .select(
            F.col("_g").alias(group), F.col("e.s").alias(snapshot), F.col("_k").alias(key), F.col("e.c").alias("change")
        )
    )


def change_counts(changes: DataFrame, group: str, snapshot: str) -> DataFrame:
    """Number of added, removed and changed keys per group and snapshot that has any."""
    kinds = ["added", "removed", "changed"]
    return changes.groupBy(group, snapshot).agg(*[F.count_if(F.col("change") == k).alias(k) for k in kinds])
