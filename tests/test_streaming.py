import datetime as dt

from pyspark.sql import functions as F

from almanac.operators.state import consecutive_failures
from almanac.session import norm_key
from almanac.streaming import runs

SF = "/root/testdata/sf0.001"


def test_counters_of_a_stream_equal_the_batch(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/fetch_results.parquet")
    for i in range(3):  # three files in the order of ids
        part = df.where(F.col("result_id").between(i * 600, i * 600 + 599))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = df.schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = runs.run_to_end(spark, runs.failure_counters(s), "update", "counters")
    last = {r["key"]: r["failures"] for r in out.groupBy("key").agg(F.max_by("failures", "last").alias("failures")).collect()}
    batch = df.where("result_id < 1800").dropDuplicates(["result_id"]).withColumn("key", norm_key("key")).where("key IS NOT NULL")
    want = consecutive_failures(batch, spark.createDataFrame([], "key string, failures int"), seq="result_id")
    assert last == {r["key"]: r["failures"] for r in want.collect()}


def test_weekly_counts_append_once_the_watermark_has_passed(spark, tmp_path):
    rows = [(i, dt.datetime(2025, 1, 5) + dt.timedelta(days=i), "ok" if i % 2 else "error") for i in range(40)]
    df = spark.createDataFrame(rows + rows[:5], "result_id long, fetched_at timestamp, status string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = runs.run_to_end(spark, runs.weekly_counts(runs.run_stream(spark, str(tmp_path / "in"))), "append", "weekly")
    got = {str(r["week"])[:10]: (r["total"], r["ok"]) for r in out.collect()}
    assert got["2025-01-05"] == (7, 3) and all(v[0] == 7 for v in got.values()) and len(got) >= 4
