"""Structured Streaming forms of the weekly counts and of the failure counters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.functions import predicates as P
from almanac.session import new_folder, norm_key, table


def run_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Fetch results as a stream of Parquet files; rows loaded again within the watermark are dropped."""
    schema = spark.read.parquet(path).schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    return s.withWatermark("fetched_at", "7 days").dropDuplicatesWithinWatermark(["result_id"])


def weekly_counts(stream: DataFrame, anchor: str = "3 days") -> DataFrame:
    """Tumbling weeks of event time that begin on Sundays (``anchor`` days after the epoch's Thursday): ``week, total, ok``."""
    g = stream.groupBy(F.window("fetched_at", "7 days", startTime=anchor).alias("w"))
    return g.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "ok").alias("ok")).select(F.col("w.start").alias("week"), "total", "ok")


OUT = T.StructType([T.StructField("key", T.StringType()), T.StructField("failures", T.LongType()), T.StructField("last", T.LongType())])
STATE = T.StructType([T.StructField("failures", T.LongType()), T.StructField("last", T.LongType())])


def fold_failures(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Counter of one key over a micro-batch in the order of ids; ids at or below the last seen are late copies and ignored.

    Each chunk of the batch is reduced to the ids of failures after the last result that is fine; only these, eight bytes each, are held.
    """
    failures, last = state.get if state.exists else (0, -1)
    seen, fine_at, failed = last, -1, np.empty(0, np.int64)
    for b in batches:
        ids, fine = b["result_id"].to_numpy(np.int64), b["status"].isin(P.FINE).to_numpy()
        new = ids > last
        seen = max(seen, int(ids[new].max(initial=-1)))
        fine_at = max(fine_at, int(ids[new & fine].max(initial=-1)))
        failed = np.unique(np.concatenate([failed[failed > fine_at], ids[new & ~fine & (ids > fine_at)]]))
    if seen > last:
        failures = len(failed) + (0 if fine_at >= 0 else failures)
        last = seen
        state.update((failures, last))
    yield pd.DataFrame({"key": [key[0]], "failures": [failures], "last": [last]})


def failure_counters(stream: DataFrame) -> DataFrame:
    """Consecutive failures per key as stateful updates."""
    s = stream.where(F.length(F.trim("key")) > 0).select(norm_key("key").alias("key"), "result_id", "status")
    return s.groupBy("key").applyInPandasWithState(fold_failures, OUT, STATE, "update", "NoTimeout")


def run_to_end(spark: SparkSession, stream: DataFrame, mode: str, label: str) -> DataFrame:
    """Runs all that is available and returns what was written to the shared folder: in complete mode what the last batch wrote, else what all did."""
    at, state = new_folder(spark, label), new_folder(spark, label + "-state")
    w = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", state)
    if mode == "append":
        w.format("parquet").start(at).awaitTermination()
        return spark.read.schema(stream.schema).parquet(at)
    last = [-1]

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/batch={number}")
        last[0] = number

    w.foreachBatch(keep).start().awaitTermination()
    if last[0] < 0:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{at}/batch={last[0]}" if mode == "complete" else f"{at}/batch=*")


def stream_weekly_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly counts of a stream over the whole table, in complete mode: one row per week."""
    df = table(spark, sf, "fetch_results")
    s = spark.readStream.schema(df.schema).parquet(f"{sf}/fetch_results*.parquet") if not _is_dir(spark, f"{sf}/fetch_results.parquet") else spark.readStream.schema(df.schema).parquet(f"{sf}/fetch_results.parquet")
    return run_to_end(spark, weekly_counts(s), "complete", "weekly")


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


QUERIES = {"stream_weekly_counts": stream_weekly_counts}
ORACLE = {
    "stream_weekly_counts": """SELECT to_timestamp(259200 + floor((epoch(fetched_at) - 259200) / 604800) * 604800) AS week, count(*) AS total, count(*) FILTER (status = 'ok') AS ok
 FROM fetch_results WHERE fetched_at IS NOT NULL GROUP BY 1"""
}
