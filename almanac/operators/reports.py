"""Reports: buckets, rates, failures, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions import dates as D
from almanac.functions import predicates as P
from almanac.operators.order import latest, prune_plan

WEEK_S = 7 * 86400


def classified(results: DataFrame) -> DataFrame:
    """Results with the bucket of the report they belong to."""
    return results.withColumn("bucket", P.report_bucket(F.col("is_stale"), F.col("status"), F.col("file_exists")))


def bucket_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """All five buckets of each group, zeroes included."""
    return rows.groupBy(*by).agg(*[F.count_if(F.col("bucket") == b).alias(b) for b in P.BUCKETS])


def success_rates(counts: DataFrame) -> DataFrame:
    """Both denominators: with failures only, and with links too. Unrounded percentages, 0 without any."""
    d, f, h = F.col("downloaded"), F.col("failed"), F.col("html_links")
    rate = lambda n: F.when(n > 0, d / n * 100).otherwise(0.0)
    return counts.withColumns({"rate": rate(d + f), "rate_with_links": rate(d + f + h)})


def weekly_rates(log: DataFrame, ts: str, ok: Column, as_of: Column, weeks: int = 8) -> DataFrame:
    """Rolling weeks that end at ``as_of``, the newest longer by a day: ``week, total, ok, rate`` (null rate when empty).

    One partial aggregation over a computed bin; the bins are a table of ``weeks`` rows.
    """
    age = F.unix_seconds(as_of) - F.unix_seconds(F.col(ts))
    binned = log.where((age > -86400) & (age <= weeks * WEEK_S)).select(
        F.least(F.lit(weeks - 1), F.lit(weeks) - F.ceil(age / WEEK_S)).cast("int").alias("week"), ok.alias("_ok")
    )
    counts = binned.groupBy("week").agg(F.count("*").alias("total"), F.count_if("_ok").alias("ok"))
    bins = log.sparkSession.range(weeks).select(F.col("id").cast("int").alias("week"))
    out = bins.join(F.broadcast(counts), "week", "left").na.fill(0, ["total", "ok"])
    return out.withColumn("rate", F.when(F.col("total") > 0, F.col("ok") / F.col("total") * 100))


def top_failures(log: DataFrame, ts: str, seq: str, as_of: Column, n: int = 10, weeks: int = 4) -> DataFrame:
    """Keys with most failures of the last weeks: ``key, failed, total, display_name`` (last) and ``error`` (first)."""
    failed = P.log_status(F.col("status")) == "failed"
    recent = log.where(F.unix_seconds(F.col(ts)) >= F.unix_seconds(as_of) - weeks * WEEK_S)
    said = failed & (F.length(F.coalesce("error", F.lit(""))) > 0)
    out = recent.groupBy("key").agg(
        F.count_if(failed).alias("failed"), F.count("*").alias("total"), F.max_by("display_name", seq).alias("display_name"),
        F.min_by(F.when(said, F.col("error")), F.when(said, F.col(seq))).alias("error"), F.min(seq).alias("_first"),
    )
    return out.where("failed > 0").orderBy(F.desc("failed"), "_first").limit(n).drop("_first")


def reconciled(rows: DataFrame, recipes: DataFrame, by: list[str], key: str = "parish", seq: str = "row_id") -> DataFrame:
    """A report without rows that its own downloads or the recipes have settled.

    Failed rows and links of downloaded keys go. A failed row of an inactive recipe becomes skipped, once
    per key and only if the key isn't skipped already. ``recipes``: ``key, skip, status, reason``.
    """
    done = rows.where("bucket = 'downloaded'").select(*by, key).distinct()
    problem = F.col("bucket").isin("failed", "html_links")
    kept = rows.where(~problem).unionByName(rows.where(problem & ~((F.col("bucket") == "failed") & (F.coalesce(F.trim(key), F.lit("")) == ""))).join(done, [*by, key], "left_anti").select(rows.columns))
    dead = recipes.where(P.inactive(F.col("skip"), F.col("status"))).select(
        F.col("key").alias("_k"), P.first_text(F.col("reason"), F.lit("Marked inactive")).alias("_why")
    ).dropDuplicates(["_k"])
    marked = kept.join(dead, (kept[key] == dead["_k"]) & (kept["bucket"] == "failed"), "left")
    moving = marked.where("_k IS NOT NULL")
    skipped = rows.where("bucket = 'skipped'").select(*by, key).distinct()
    first = latest(moving.withColumn("_n", -F.col(seq)), [*by, key], ["_n"], [c for c in rows.columns if c not in (*by, key)] + ["_why"])
    moved = first.join(skipped, [*by, key], "left_anti").withColumn("bucket", F.lit("skipped")).withColumn("reason", F.col("_why"))
    return marked.where("_k IS NULL").select(rows.columns).unionByName(moved.select(rows.columns))


def patched(rows: DataFrame, patch: DataFrame, by: list[str], key: str = "parish", seq: str = "row_id") -> DataFrame:
    """Rows of the patched keys replaced by each key's last patch row."""
    keys = patch.select(*by, key).distinct()
    last = latest(patch, [*by, key], [seq], [c for c in rows.columns if c not in (*by, key)])
    return rows.join(keys, [*by, key], "left_anti").select(rows.columns).unionByName(last.select(rows.columns))


def one_result_per_key(results: DataFrame, by: list[str], seq: str, keep: list[str]) -> DataFrame:
    """The result that counts: the last that is ok or a link, else the first of the others."""
    good = F.col("status").isin("ok", "html_link")
    rank = F.struct(good.cast("int"), F.when(good, F.col(seq)).otherwise(-F.col(seq)))
    return results.groupBy(*by).agg(F.max_by(F.struct(*keep), rank).alias("_b")).select(*by, "_b.*")


def reliability(keys: DataFrame, results: DataFrame, failures: DataFrame) -> DataFrame:
    """Success rate, tier and last success of every key; without results the rate follows from the failure counter."""
    seen = results.groupBy("key").agg(F.avg((F.col("status") == "ok").cast("double")).alias("_rate"), F.max(F.when(F.col("status") == "ok", F.col("fetched_at"))).alias("_last"))
    fails = failures.groupBy("key").agg(F.max_by("failures", F.struct("as_of", "row_id")).alias("_f"))
    j = keys.join(seen, "key", "left").join(fails, "key", "left")
    rate = F.coalesce(F.col("_rate"), F.when(F.col("_f") <= 0, 1.0).when(F.col("_f") <= 2, 0.5).when(F.col("_f").isNotNull(), 0.0))
    return j.select("key", rate.alias("success_rate"), P.tier(rate, F.col("_f")).alias("tier"), F.left(F.col("_last").cast("string"), F.lit(10)).alias("last_success"))


def problem_rows(rows: DataFrame, dead: DataFrame, failures: DataFrame, by: list[str], key: str = "parish") -> DataFrame:
    """Rows somebody should look at: failed and links, without keys that were downloaded or are dead, with their counters."""
    done = rows.where("bucket = 'downloaded'").select(*by, key).distinct()
    open_ = rows.where(F.col("bucket").isin("failed", "html_links")).join(done, [*by, key], "left_anti")
    gone = dead.select(F.col("key").alias("_k")).distinct()
    counters = failures.groupBy(F.col("key").alias("_c")).agg(F.max("failures").alias("failures"))
    out = open_.join(gone, open_[key] == gone["_k"], "left_anti")
    return out.join(counters, out[key] == counters["_c"], "left").drop("_c").withColumn("failures", F.coalesce("failures", F.lit(0)))


def retention_plan(files: DataFrame, as_of: Column, weeks: int = 8, months: int = 24, cap: int | None = None, merged_weeks: int = 12) -> DataFrame:
    """What happens to each file: ``path, bytes, modified, kind, action, archive``.

    ``kind`` is individual, merged or archive. Individual files older than ``weeks`` and merged ones older than ``merged_weeks`` go into their
    month's archive (or are deleted where that archive exists); archives older than ``months`` are deleted. Where what then is left, zipped
    files included, exceeds ``cap`` bytes, the oldest archives are pruned until it fits or none is left.
    """
    old = F.when(F.col("kind") == "individual", F.col("modified") < as_of - F.expr(f"INTERVAL {weeks * 7} DAYS")).when(F.col("kind") == "merged", F.col("modified") < as_of - F.expr(f"INTERVAL {merged_weeks * 7} DAYS"))
    label = F.concat(F.date_format("modified", "yyyy-MM"), F.when(F.col("kind") == "merged", "-mega-pdfs.zip").otherwise("-individual-pdfs.zip"))
    have = files.where("kind = 'archive'").select(F.regexp_extract("path", "[^/]+$", 0).alias("archive")).distinct().withColumn("_have", F.lit(True))
    out = files.withColumn("archive", F.when(old, label)).join(have, "archive", "left")
    expired = (F.col("kind") == "archive") & (F.col("modified") < F.add_months(as_of, -months).cast("timestamp"))
    action = F.when(F.col("archive").isNotNull() & F.col("_have").isNotNull(), "delete").when(F.col("archive").isNotNull(), "zip").when(expired, "delete").otherwise("keep")
    plan = out.select("path", "bytes", "modified", "kind", action.alias("action"), "archive")
    if cap is None:
        return plan
    left = plan.where("action <> 'delete'").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    if left <= cap:
        return plan
    archives = plan.where("kind = 'archive' AND action = 'keep'").withColumn("_day", F.to_date("modified"))
    kept = archives.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    pruned = prune_plan(archives, [F.col("modified"), F.col("path")], "bytes", kept - (left - cap), "_day").select("path", "modified").distinct().withColumn("_prune", F.lit(True))
    marked = plan.join(pruned, ["path", "modified"], "left")
    return marked.select("path", "bytes", "modified", "kind", F.when(F.col("_prune"), "prune").otherwise(F.col("action")).alias("action"), "archive")


def freshness_gate(results: DataFrame, target: Column, entries: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Results with stale ok ones turned into errors, and the rows to try again with the way to try.

    ``entries``: ``key, pattern, content_type, bulletin_page``; at most one row per key counts. Results that are
    stale already, aren't ok or have no address stay as they are.
    """
    known = entries if entries is not None else results.sparkSession.createDataFrame([], "key string, pattern string, content_type string, bulletin_page string")
    e = known.dropDuplicates(["key"]).select(F.col("key").alias("_k"), F.col("pattern").alias("_p"), F.col("content_type").alias("_c"), F.col("bulletin_page").alias("_b"))
    asked = (F.col("status") == "ok") & ~F.coalesce("is_stale", F.lit(False)) & (F.length("url") > 0)
    j = results.join(e, results["key"] == e["_k"], "left").withColumn("_d", F.when(asked, D.bulletin_date(F.col("url")))).withColumn("_v", D.freshness(F.col("_d"), target))
    stale = asked & (F.col("_v.status") == "stale")
    how = P.retry_strategy(F.col("file_type"), F.col("_p"), F.length(F.trim("_b")) > 0, F.col("_c"))
    said = F.concat(F.lit("Stale edition rejected (dated "), F.col("_d").cast("string"), F.lit(", "), F.col("_v.reason"), F.lit(")"))
    marked = j.withColumn("_s", stale)
    new = {"status": F.lit("error"), "error": said, "is_stale": F.lit(True), "stale_reason": F.col("_v.reason"), "retry_strategy": how}
    out = marked.select(*[F.when(F.col("_s"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in results.columns])
    retry = marked.where("_s").select("key", "display_name", "url", F.col("_d").alias("date"), F.col("_v.reason").alias("reason"), how.alias("strategy"), F.coalesce("_b", F.lit("")).alias("bulletin_page"))
    return out, retry


def first_failures(rows: DataFrame, by: list[str], seq: str, n: int = 5) -> DataFrame:
    """The first n failed rows of each report in their order, with ``place``."""
    w = Window.partitionBy(*by).orderBy(seq)
    return rows.where("bucket = 'failed'").withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def problem_counts(keys: DataFrame, failures: DataFrame, stale: DataFrame, by: list[str], least: int = 2) -> DataFrame:
    """Per group: sources, broken ones (``least`` failures in a row or more), stale ones and those of unknown date.

    ``keys``: ``by, key``; ``failures``: ``key, failures``; ``stale``: ``key, list_name``.
    """
    broken = failures.groupBy("key").agg((F.max("failures") >= least).alias("_b"))
    old = stale.groupBy("key").agg(F.bool_or(F.col("list_name") == "stale").alias("_s"), F.bool_or(F.col("list_name") == "unknown_date").alias("_u"))
    j = keys.select(*by, "key").distinct().join(broken, "key", "left").join(old, "key", "left")
    return j.groupBy(*by).agg(F.count("*").alias("sources"), F.count_if("_b").alias("broken"), F.count_if("_s").alias("stale"), F.count_if("_u").alias("unknown_date"))
