"""Queries on the weekly-harvest tables that use the general operators (problems 4 and 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.operators.orphans import Edge, orphan_cascade
from almanac.operators.snapshots import change_counts, snapshot_changes
from almanac.session import norm_key, table, utc_date

HOST = r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/@?#]*@)?([^/:?#\s]+)"


def url_host(url: Column) -> Column:
    """Host of a url: lower case, without a leading ``www.`` and without port; null where there is none."""
    host = F.regexp_replace(F.regexp_extract(F.lower(F.trim(url)), HOST, 1), r"^www\.", "")
    return F.nullif(host, F.lit(""))


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    report = snapshot_changes(
        table(spark, sf, "report_long"), "station", "target_date", "parish", ["url", "file"], ["delivered_at", "row_id"]
    ).select(F.lit("report_long").alias("table_name"), "station", F.col("target_date").alias("d"), F.col("parish").alias("key"), "change")
    index = snapshot_changes(
        table(spark, sf, "bulletin_index"), "station", "snapshot_date", "key", ["edition"], ["delivered_at", "row_id"]
    ).select(F.lit("bulletin_index").alias("table_name"), "station", F.col("snapshot_date").alias("d"), "key", "change")
    return report.unionByName(index)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _changes(spark, sf).select(
        "table_name", "station", F.date_format("d", "yyyy-MM-dd").alias("snapshot_date"), "key", "change"
    )


def p4_change_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = _changes(spark, sf).withColumn("source", F.concat_ws("/", "table_name", "station"))
    return change_counts(c, "source", "d").select(
        "source", F.date_format("d", "yyyy-MM-dd").alias("snapshot_date"), "added", "removed", "changed"
    )


def _nodes(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    contacts = table(spark, sf, "contacts")
    return {
        "report_long": table(spark, sf, "report_long").select("row_id", "station", norm_key("parish").alias("k"), F.col("target_date").alias("day")),
        "consecutive_failures": table(spark, sf, "consecutive_failures").select("row_id", norm_key("key").alias("k"), F.col("as_of").alias("day")),
        "site_health": table(spark, sf, "site_health").select("row_id", url_host(F.col("url")).alias("k"), utc_date(F.col("last_checked")).alias("day")),
        "contacts": contacts.select(norm_key("key").alias("k"), "added_on", "removed_on"),
        "websites": contacts.select(url_host(F.col("website")).alias("k"), "added_on", "removed_on"),
        "bulletin_index": table(spark, sf, "bulletin_index").select("row_id", "station", norm_key("key").alias("k"), F.col("snapshot_date").alias("day")),
        "stale_bulletins": table(spark, sf, "stale_bulletins").select(
            "row_id", "station", norm_key("key").alias("k"),
            F.date_add(F.next_day(F.date_sub(utc_date(F.col("generated_at")), 7), "SU"), 0).alias("day"),
        ),
    }


_VALID = {"child_day": "day", "valid_from": "added_on", "valid_to": "removed_on"}
REGISTRY_EDGES = [
    Edge("report_long", ["k"], "contacts", ["k"], name="parish", **_VALID),
    Edge("consecutive_failures", ["k"], "contacts", ["k"], name="key", **_VALID),
    Edge("site_health", ["k"], "websites", ["k"], name="host", **_VALID),
]
WEEK_EDGES = [
    Edge("bulletin_index", ["station", "k", "day"], "report_long", ["station", "k", "day"], name="report row"),
    Edge("stale_bulletins", ["station", "k", "day"], "report_long", ["station", "k", "day"], name="report row"),
]


def _orphans(spark: SparkSession, sf: str, edges: list[Edge]) -> DataFrame:
    """Orphans with their period."""
    return orphan_cascade(_nodes(spark, sf), edges, keep=("day",)).withColumn("period", F.date_format("day", "yyyy-MM"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf, REGISTRY_EDGES).where("kind = 'direct'").select("table_name", "period", "row_id")


def p5_orphan_report(spark: SparkSession, sf: str) -> DataFrame:
    """Direct and inherited orphans per table, edge and month, over the whole foreign-key graph."""
    return (
        _orphans(spark, sf, REGISTRY_EDGES + WEEK_EDGES)
        .groupBy("table_name", "edge", "period")
        .agg(
            F.count_if(F.col("kind") == "direct").alias("direct"),
            F.count_if(F.col("kind") == "inherited").alias("inherited"),
            F.max("depth").cast("int").alias("depth"),
        )
    )


_SQL_HOST = r"nullif(regexp_replace(regexp_extract(lower(trim({0})), '^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/@?#]*@)?([^/:?#\s]+)', 1), '^www\.', ''), '')"


def _sql_changes(table_name: str, snap: str, key: str, values: list[str]) -> str:
    diff = " OR ".join(f"{v} IS DISTINCT FROM p_{v}" for v in values)
    lags = ", ".join(f"lag({v}) OVER w AS p_{v}" for v in values)
    return f"""
SELECT '{table_name}' AS table_name, station, strftime(CASE WHEN change = 'removed' THEN nxt ELSE snap END, '%Y-%m-%d') AS snapshot_date, k AS key, change FROM (
 SELECT *, unnest([CASE WHEN i > 1 AND (pi IS NULL OR pi < i - 1) THEN 'added' WHEN pi = i - 1 AND ({diff}) THEN 'changed' END,
                   CASE WHEN nxt IS NOT NULL AND (ni IS NULL OR ni > i + 1) THEN 'removed' END]) AS change
 FROM (SELECT *, lag(i) OVER w AS pi, lead(i) OVER w AS ni, {lags} FROM (
   SELECT r.*, n.i, n.nxt FROM (
     SELECT station, {snap} AS snap, lower(trim({key})) AS k, {', '.join(values)}, row_number() OVER (PARTITION BY station, {snap}, lower(trim({key})) ORDER BY delivered_at DESC, row_id DESC) AS rn
     FROM {table_name} WHERE {key} IS NOT NULL) r
   JOIN (SELECT station, snap, row_number() OVER (PARTITION BY station ORDER BY snap) AS i, lead(snap) OVER (PARTITION BY station ORDER BY snap) AS nxt
         FROM (SELECT DISTINCT station, {snap} AS snap FROM {table_name})) n ON r.station = n.station AND r.snap = n.snap
   WHERE rn = 1) WINDOW w AS (PARTITION BY station, k ORDER BY i))) WHERE change IS NOT NULL"""


_SQL_P4 = _sql_changes("report_long", "target_date", "parish", ["url", "file"]) + "\nUNION ALL" + _sql_changes("bulletin_index", "snapshot_date", "key", ["edition"])

_SQL_P5 = f"""
SELECT 'report_long' AS table_name, strftime(target_date, '%Y-%m') AS period, row_id FROM report_long r WHERE parish IS NOT NULL AND NOT EXISTS
 (SELECT 1 FROM contacts c WHERE lower(trim(c.key)) = lower(trim(r.parish)) AND (c.added_on IS NULL OR r.target_date >= c.added_on) AND (c.removed_on IS NULL OR r.target_date < c.removed_on))
UNION ALL
SELECT 'consecutive_failures', strftime(as_of, '%Y-%m'), row_id FROM consecutive_failures r WHERE key IS NOT NULL AND NOT EXISTS
 (SELECT 1 FROM contacts c WHERE lower(trim(c.key)) = lower(trim(r.key)) AND (c.added_on IS NULL OR r.as_of >= c.added_on) AND (c.removed_on IS NULL OR r.as_of < c.removed_on))
UNION ALL
SELECT 'site_health', strftime(d, '%Y-%m'), row_id FROM (SELECT row_id, {_SQL_HOST.format('url')} AS h, CAST(last_checked AT TIME ZONE 'UTC' AS DATE) AS d FROM site_health) r
WHERE h IS NOT NULL AND NOT EXISTS
 (SELECT 1 FROM contacts c WHERE {_SQL_HOST.format('c.website')} = h AND (c.added_on IS NULL OR d >= c.added_on) AND (c.removed_on IS NULL OR d < c.removed_on))"""

QUERIES = {
    "p4_found": p4_found,
    "p4_change_counts": p4_change_counts,
    "p5_found": p5_found,
    "p5_orphan_report": p5_orphan_report,
}

ORACLE = {
    "p4_found": _SQL_P4,
    "p4_change_counts": f"""SELECT table_name || '/' || station AS source, snapshot_date, CAST(count(*) FILTER (change = 'added') AS BIGINT) AS added,
 CAST(count(*) FILTER (change = 'removed') AS BIGINT) AS removed, CAST(count(*) FILTER (change = 'changed') AS BIGINT) AS changed
 FROM ({_SQL_P4}) GROUP BY ALL""",
    "p5_found": _SQL_P5,
    "p5_orphan_report": f"""
WITH o AS ({_SQL_P5}), rl AS (SELECT r.row_id, station, lower(trim(parish)) AS k, target_date AS day, o.row_id IS NOT NULL AS orphan
  FROM report_long r LEFT JOIN o ON o.table_name = 'report_long' AND o.row_id = r.row_id),
 g AS (SELECT station, k, day, bool_and(orphan) AS orphan FROM rl GROUP BY ALL),
 ch AS (SELECT 'bulletin_index' AS table_name, row_id, station, lower(trim(key)) AS k, snapshot_date AS day FROM bulletin_index
  UNION ALL SELECT 'stale_bulletins', row_id, station, lower(trim(key)), CAST(CAST(generated_at AT TIME ZONE 'UTC' AS DATE) - CAST(extract(dow FROM generated_at AT TIME ZONE 'UTC') AS INTEGER) AS DATE) FROM stale_bulletins),
 s AS (SELECT ch.table_name, ch.day, CASE WHEN g.k IS NULL THEN 'direct' ELSE 'inherited' END AS kind
  FROM ch LEFT JOIN g ON g.station = ch.station AND g.k = ch.k AND g.day = ch.day WHERE ch.k IS NOT NULL AND ch.station IS NOT NULL AND ch.day IS NOT NULL AND (g.k IS NULL OR g.orphan)),
 a AS (SELECT table_name, CASE table_name WHEN 'report_long' THEN 'parish' WHEN 'site_health' THEN 'host' ELSE 'key' END AS edge, period, 'direct' AS kind FROM o
  UNION ALL SELECT table_name, 'report row', strftime(day, '%Y-%m'), kind FROM s)
SELECT table_name, edge, period, CAST(count(*) FILTER (kind = 'direct') AS BIGINT) AS direct, CAST(count(*) FILTER (kind = 'inherited') AS BIGINT) AS inherited,
 CAST(max(CASE kind WHEN 'direct' THEN 0 ELSE 1 END) AS INTEGER) AS depth FROM a GROUP BY ALL""",
}
