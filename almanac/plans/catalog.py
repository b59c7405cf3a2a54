"""Queries over the test tables, one or more per operator, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almanac.functions import arrays as A
from almanac.functions import dates as D
from almanac.functions import pages as G_
from almanac.functions import predicates as P
from almanac.functions import pyudf as Y
from almanac.functions import text as X
from almanac.functions import urls as U
from almanac.operators import calendar, lookups, order, ranking, recipes, reports, sections, state
from almanac.session import norm_key, table, utc_date
from almanac.sinks import writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The moment of every query that looks back from now, and the target of those that look at a week.
AS_OF = "2026-02-01 00:00:00"
TARGET = "2025-06-15"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def as_of() -> Column:
    return F.lit(AS_OF + "+00:00").cast("timestamp")


def target() -> Column:
    return F.lit(TARGET).cast("date")


RESULT_COLUMNS = ["result_id", "run_id", "seq", "key", "display_name", "status", "url", "file_name", "file_exists", "file_type", "error", "is_fallback", "is_stale", "stale_reason", "retry_strategy", "fetched_at"]


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Fetch results without the rows that were loaded again, keys in comparable form.

    Rows loaded again are unchanged, so one row per id is kept; of the other columns only those that a query needs are read and shuffled.
    """
    return table(spark, sf, "fetch_results").select(*RESULT_COLUMNS).dropDuplicates(["result_id"]).withColumn("key", norm_key("key"))


FR = f"(SELECT DISTINCT {', '.join(c if c != 'key' else 'lower(trim(key)) AS key' for c in RESULT_COLUMNS)} FROM fetch_results)"
FAILED = "status NOT IN ('ok', 'html_link', 'skipped')"


@query(f"""WITH a AS (SELECT floor(epoch(TIMESTAMPTZ '{AS_OF}+00:00')) - floor(epoch(fetched_at)) AS age, status FROM {FR}),
 b AS (SELECT CAST(least(7, 8 - ceil(age / 604800)) AS INTEGER) AS week, status FROM a WHERE age > -86400 AND age <= 8 * 604800),
 c AS (SELECT week, count(*) AS total, count(*) FILTER (status = 'ok') AS ok FROM b GROUP BY 1)
 SELECT CAST(w.week AS INTEGER) AS week, coalesce(total, 0) AS total, coalesce(ok, 0) AS ok, CASE WHEN total > 0 THEN ok / total * 100 END AS rate
 FROM range(8) w(week) LEFT JOIN c ON c.week = w.week""")
def weekly_success_rate(spark, sf):
    return reports.weekly_rates(results(spark, sf), "fetched_at", P.log_status(F.col("status")) == "ok", as_of())


@query(f"""SELECT key, count(*) FILTER ({FAILED}) AS failed, count(*) AS total, arg_max(display_name, result_id) AS display_name,
 arg_min(error, result_id) FILTER ({FAILED} AND length(error) > 0) AS error
 FROM {FR} WHERE floor(epoch(fetched_at)) >= epoch(TIMESTAMPTZ '{AS_OF}+00:00') - 4 * 604800 GROUP BY key HAVING failed > 0 ORDER BY failed DESC, min(result_id) LIMIT 10""")
def top_failures(spark, sf):
    return reports.top_failures(results(spark, sf), "fetched_at", "result_id", as_of())


@query(f"""SELECT count(*) FILTER (status IN ('ok', 'html_link')) AS ok, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER ({FAILED}) AS failed
 FROM (SELECT * FROM {FR} ORDER BY result_id DESC LIMIT 20)""")
def tail_summary(spark, sf):
    s = F.col("status")
    t = order.tail(results(spark, sf), ["result_id"], 20)
    return t.agg(F.count_if(s.isin("ok", "html_link")).alias("ok"), F.count_if(s == "skipped").alias("skipped"), F.count_if(P.log_status(s) == "failed").alias("failed"))


BUCKET_SQL = "CASE WHEN is_stale THEN 'stale_rejected' WHEN status = 'ok' AND file_exists THEN 'downloaded' WHEN status = 'html_link' THEN 'html_links' WHEN status = 'skipped' THEN 'skipped' ELSE 'failed' END"
COUNTS_SQL = ", ".join(f"count(*) FILTER (bucket = '{b}') AS {b}" for b in P.BUCKETS)


@query(f"SELECT run_id, {COUNTS_SQL} FROM (SELECT run_id, {BUCKET_SQL} AS bucket FROM {FR}) GROUP BY 1")
def bucket_counts(spark, sf):
    return reports.bucket_counts(reports.classified(results(spark, sf)), ["run_id"])


def report(spark, sf) -> DataFrame:
    """Report rows with the bucket names of reports and comparable keys."""
    return table(spark, sf, "report_long").withColumn("parish", norm_key("parish")).replace({"html_link": "html_links", "stale": "stale_rejected"}, subset=["bucket"])


RL = """(SELECT * REPLACE (lower(trim(parish)) AS parish, CASE bucket WHEN 'html_link' THEN 'html_links' WHEN 'stale' THEN 'stale_rejected' ELSE bucket END AS bucket) FROM report_long)"""
CONTACTS_SQL = "(SELECT DISTINCT diocese, lower(trim(key)) AS parish FROM contacts)"


@query(f"""SELECT diocese, CAST(count(*) FILTER (bucket = 'downloaded') AS BIGINT) AS downloaded, count(*) FILTER (bucket = 'html_links') AS html_links, count(*) FILTER (bucket = 'failed') AS failed,
 CASE WHEN downloaded + failed > 0 THEN downloaded / (downloaded + failed) * 100 ELSE 0 END AS rate,
 CASE WHEN downloaded + failed + html_links > 0 THEN downloaded / (downloaded + failed + html_links) * 100 ELSE 0 END AS rate_with_links
 FROM {RL} r JOIN {CONTACTS_SQL} c USING (parish) GROUP BY diocese""")
def group_success_rate(spark, sf):
    groups = table(spark, sf, "contacts").select("diocese", norm_key("key").alias("parish")).distinct()
    counts = reports.bucket_counts(report(spark, sf).join(groups, "parish"), ["diocese"])
    return reports.success_rates(counts).select("diocese", "downloaded", "html_links", "failed", "rate", "rate_with_links")


@query(f"""SELECT diocese, coalesce(n, 0) AS n FROM (SELECT DISTINCT diocese FROM contacts WHERE diocese IS NOT NULL) LEFT JOIN (SELECT diocese, count(*) AS n FROM
 (SELECT c.diocese, r.parish FROM {RL} r JOIN {CONTACTS_SQL} c USING (parish) WHERE r.bucket = 'failed') GROUP BY 1) USING (diocese)""")
def count_of_keys(spark, sf):
    keys = table(spark, sf, "contacts").select("diocese", norm_key("key").alias("parish")).distinct()
    rows = report(spark, sf).where("bucket = 'failed'").join(keys, "parish")
    return lookups.count_of_keys(rows, keys, ["diocese"], "parish")


CF_LAST = "(SELECT lower(trim(key)) AS key, arg_max(failures, (as_of, row_id)) AS f FROM consecutive_failures GROUP BY 1)"
RELIABLE = f"""WITH k AS (SELECT DISTINCT lower(trim(key)) AS key FROM contacts WHERE key IS NOT NULL),
 s AS (SELECT key, avg(CASE WHEN status = 'ok' THEN 1.0 ELSE 0.0 END) AS r, strftime(max(fetched_at) FILTER (status = 'ok'), '%Y-%m-%d') AS l FROM {FR} GROUP BY 1),
 j AS (SELECT k.key, coalesce(r, CASE WHEN f <= 0 THEN 1.0 WHEN f <= 2 THEN 0.5 WHEN f IS NOT NULL THEN 0.0 END) AS success_rate, f, l FROM k LEFT JOIN s USING (key) LEFT JOIN {CF_LAST} c USING (key)),
 t AS (SELECT key, success_rate, CASE WHEN success_rate >= 0.8 THEN 'green' WHEN success_rate >= 0.5 THEN 'amber' WHEN success_rate IS NOT NULL THEN 'red'
 WHEN f <= 0 THEN 'green' WHEN f <= 2 THEN 'amber' WHEN f IS NOT NULL THEN 'red' ELSE 'grey' END AS tier, l AS last_success FROM j)"""


def _reliability(spark, sf) -> DataFrame:
    keys = table(spark, sf, "contacts").select(norm_key("key").alias("key")).where("key IS NOT NULL").distinct()
    fails = table(spark, sf, "consecutive_failures").withColumn("key", norm_key("key"))
    return reports.reliability(keys, results(spark, sf), fails)


@query(RELIABLE + " SELECT key, CAST(success_rate AS DOUBLE) AS success_rate, tier, last_success FROM t")
def reliability_tiers(spark, sf):
    return _reliability(spark, sf)


@query(RELIABLE + f" SELECT diocese, avg(success_rate) AS mean_rate, count(*) AS n FROM t JOIN {CONTACTS_SQL} c ON c.parish = t.key GROUP BY 1")
def group_mean_reliability(spark, sf):
    groups = table(spark, sf, "contacts").select("diocese", norm_key("key").alias("key")).distinct()
    return _reliability(spark, sf).join(groups, "key").groupBy("diocese").agg(F.avg("success_rate").alias("mean_rate"), F.count("*").alias("n"))


@query("""SELECT source, n, pct, CASE WHEN pct >= 85 THEN 'red' WHEN pct >= 60 THEN 'amber' ELSE 'green' END AS light, repeat('#', CAST(floor(pct / 5) AS INTEGER)) || repeat('.', 20 - CAST(floor(pct / 5) AS INTEGER)) AS bar
 FROM (SELECT source, CAST(sum(n_chars) AS BIGINT) AS n, least(sum(n_chars) / 2000000 * 100, 100.0) AS pct FROM documents WHERE n_chars IS NOT NULL GROUP BY 1)""")
def traffic_light(spark, sf):
    g = table(spark, sf, "documents").where("n_chars IS NOT NULL").groupBy("source").agg(F.sum("n_chars").alias("n"))
    g = g.withColumn("pct", F.least(F.col("n") / 2_000_000 * 100, F.lit(100.0)))
    return g.select("source", "n", "pct", P.traffic_light(F.col("pct")).alias("light"), P.bar(F.col("pct")).alias("bar"))


@query(f"""WITH k AS (SELECT key, min(result_id) AS seq FROM {FR} WHERE key IS NOT NULL GROUP BY 1), f AS (SELECT lower(trim(key)) AS key, max(failures) AS failures FROM consecutive_failures WHERE failures IS NOT NULL GROUP BY 1)
 SELECT key, f.failures, CAST(row_number() OVER (ORDER BY f.failures IS NULL, f.failures DESC, CASE WHEN f.failures IS NOT NULL THEN key END, seq) AS BIGINT) AS rank FROM k LEFT JOIN f USING (key)""")
def priority_order(spark, sf):
    keys = results(spark, sf).where("key IS NOT NULL").groupBy("key").agg(F.min("result_id").alias("seq"))
    fails = table(spark, sf, "consecutive_failures").select(norm_key("key").alias("key"), "failures")
    return order.priority_order(keys, fails).select("key", "failures", F.col("rank").cast("long").alias("rank"))


def _recipes(spark, sf) -> DataFrame:
    """Recipes as the contacts tell them: a source whose rows all ended is inactive."""
    c = table(spark, sf, "contacts").groupBy(norm_key("key").alias("key")).agg(F.max(F.coalesce("removed_on", F.lit("9999-12-31").cast("date"))).alias("last"))
    return c.select("key", F.lit(False).alias("skip"), F.when(F.col("last") < "2026-01-01", "inactive").otherwise("active").alias("status"), F.lit(None).cast("string").alias("reason"))


DEAD = "(SELECT lower(trim(key)) AS key FROM contacts GROUP BY 1 HAVING max(coalesce(removed_on, DATE '9999-12-31')) < DATE '2026-01-01')"


@query(f"""WITH r AS (SELECT * FROM {RL}), done AS (SELECT DISTINCT station, target_date, parish FROM r WHERE bucket = 'downloaded' AND parish IS NOT NULL),
 k AS (SELECT r.* FROM r LEFT JOIN done d ON d.station = r.station AND d.target_date = r.target_date AND d.parish = r.parish
  WHERE NOT (r.bucket IN ('failed', 'html_links') AND d.parish IS NOT NULL) AND NOT (r.bucket = 'failed' AND coalesce(r.parish, '') = '')),
 m AS (SELECT k.*, x.key IS NOT NULL AS dead FROM k LEFT JOIN {DEAD} x ON x.key = k.parish AND k.bucket = 'failed'),
 s AS (SELECT DISTINCT station, target_date, parish FROM r WHERE bucket = 'skipped'),
 v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station, target_date, parish ORDER BY row_id) AS rn FROM m WHERE dead) WHERE rn = 1)
 SELECT station, target_date, parish, row_id, bucket, reason FROM m WHERE NOT dead
 UNION ALL SELECT v.station, v.target_date, v.parish, v.row_id, 'skipped', 'Marked inactive' FROM v WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.station = v.station AND s.target_date = v.target_date AND s.parish = v.parish)""")
def reconcile_report(spark, sf):
    rows = report(spark, sf).select("station", "target_date", "parish", "row_id", "bucket", "reason")
    return reports.reconciled(rows, _recipes(spark, sf), ["station", "target_date"])


LATE = "CAST(delivered_at AT TIME ZONE 'UTC' AS DATE) > target_date + 2"


@query(f"""WITH r AS (SELECT station, target_date, parish, row_id, bucket, url FROM {RL}), p AS (SELECT station, target_date, parish, max(row_id) AS row_id FROM {RL} WHERE {LATE} AND parish IS NOT NULL GROUP BY 1, 2, 3)
 SELECT r.* FROM r WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.station = r.station AND p.target_date = r.target_date AND p.parish = r.parish)
 UNION ALL SELECT r.* FROM r JOIN p ON r.row_id = p.row_id""")
def patch_report(spark, sf):
    cols = ["station", "target_date", "parish", "row_id", "bucket", "url"]
    rows = report(spark, sf)
    patch = rows.where((utc_date(F.col("delivered_at")) > F.date_add("target_date", 2)) & F.col("parish").isNotNull()).select(cols)
    return reports.patched(rows.select(cols), patch, ["station", "target_date"])


@query(f"""SELECT run_id, key, result_id, status FROM (SELECT *, row_number() OVER (PARTITION BY run_id, key ORDER BY status IN ('ok', 'html_link') DESC,
 CASE WHEN status IN ('ok', 'html_link') THEN -result_id ELSE result_id END) AS rn FROM {FR} WHERE status IS NOT NULL) WHERE rn = 1""")
def dedupe_precedence(spark, sf):
    return reports.one_result_per_key(results(spark, sf).where("status IS NOT NULL"), ["run_id", "key"], "result_id", ["result_id", "status"])


PRIOR = "(SELECT lower(trim(key)) AS key, max(failures) AS failures FROM consecutive_failures WHERE as_of < DATE '2025-03-01' GROUP BY 1)"


@query(f"""WITH l AS (SELECT key, max(CASE WHEN status IN ('ok', 'html_link', 'skipped') THEN result_id END) AS last FROM {FR} WHERE length(key) > 0 GROUP BY 1),
 n AS (SELECT f.key, any_value(last) AS last, count(*) FILTER (coalesce(status, '') NOT IN ('ok', 'html_link', 'skipped') AND (last IS NULL OR result_id > last)) AS n FROM {FR} f JOIN l ON l.key = f.key GROUP BY 1)
 SELECT coalesce(n.key, p.key) AS key, CAST(CASE WHEN last IS NULL THEN greatest(coalesce(p.failures, 0), 0) ELSE 0 END + coalesce(n, 0) AS BIGINT) AS failures FROM n FULL JOIN {PRIOR} p ON p.key = n.key""")
def consecutive_failures(spark, sf):
    prior = table(spark, sf, "consecutive_failures").where("as_of < DATE'2025-03-01'").select(norm_key("key").alias("key"), "failures")
    return state.consecutive_failures(results(spark, sf), prior, seq="result_id")


@query(f"""WITH p AS (SELECT station || '/' || key AS key, row_id AS seq, last_result AS result, status, nxdomain_strikes AS s, last_checked >= TIMESTAMPTZ '{TARGET} 00:00:00+00:00' AS new FROM site_health),
 o AS (SELECT key, CAST(arg_max(coalesce(s, 0), seq) AS BIGINT) AS s, arg_max(coalesce(status, 'unknown'), seq) AS st FROM p WHERE NOT new AND key IS NOT NULL GROUP BY 1),
 l AS (SELECT key, max(seq) FILTER (result = 'ok') AS last, arg_max(result, seq) AS last_result, arg_max(result, seq) FILTER (result IN ('ok', 'nxdomain')) AS told FROM p WHERE new AND key IS NOT NULL GROUP BY 1),
 n AS (SELECT p.key, count(*) FILTER (result = 'nxdomain' AND (last IS NULL OR seq > last)) AS n FROM p JOIN l USING (key) WHERE new GROUP BY 1),
 t AS (SELECT l.key, told, last_result, st, n + CASE WHEN last IS NULL THEN coalesce(s, 0) ELSE 0 END AS strikes FROM l JOIN n USING (key) LEFT JOIN o USING (key))
 SELECT key, CAST(strikes AS BIGINT) AS strikes, CASE WHEN told = 'ok' THEN 'ok' WHEN told IS NOT NULL AND strikes >= 2 THEN 'inactive_candidate' WHEN told IS NOT NULL THEN 'nxdomain_watch' ELSE coalesce(st, 'unknown') END AS status, last_result FROM t""")
def strike_state(spark, sf):
    rows = table(spark, sf, "site_health").withColumn("key", F.concat("station", F.lit("/"), "key")).where("key IS NOT NULL")
    new = F.col("last_checked") >= F.lit(TARGET + " 00:00:00+00:00").cast("timestamp")
    prior = rows.where(~new).groupBy("key").agg(
        F.max_by(F.coalesce("nxdomain_strikes", F.lit(0)), "row_id").cast("long").alias("strikes"), F.max_by(F.coalesce("status", F.lit("unknown")), "row_id").alias("status")
    )
    return state.strikes(rows.where(new).select("key", F.col("row_id").alias("seq"), F.col("last_result").alias("result")), prior)


@query(f"""WITH c AS (SELECT key, result_id, url FROM {FR} WHERE status = 'ok' AND key IS NOT NULL AND url IS NOT NULL), v AS (SELECT key, arg_max(url, result_id) AS new_url FROM c GROUP BY 1),
 l AS (SELECT c.key, max(result_id) FILTER (url <> new_url) AS last FROM c JOIN v USING (key) GROUP BY 1)
 SELECT c.key, any_value(new_url) AS new_url, count(*) FILTER (url = new_url AND (last IS NULL OR result_id > last)) AS confidence FROM c JOIN v USING (key) JOIN l USING (key) GROUP BY c.key""")
def pattern_confidence(spark, sf):
    c = results(spark, sf).where("status = 'ok' AND key IS NOT NULL AND url IS NOT NULL").select("key", F.col("result_id").alias("seq"), F.col("url").alias("new_url"))
    return state.confidence(c)


@query(f"""WITH s AS (SELECT status, retry_strategy, key, min(result_id) AS first_at FROM {FR} WHERE key IS NOT NULL GROUP BY 1, 2, 3), c AS (SELECT status, retry_strategy, count(*) AS success_count FROM {FR} GROUP BY 1, 2)
 SELECT c.status, c.retry_strategy, success_count, array_to_string(list_slice(list(key ORDER BY first_at), 1, 12), ',') AS examples FROM c JOIN s ON s.status = c.status AND s.retry_strategy IS NOT DISTINCT FROM c.retry_strategy
 WHERE c.retry_strategy IS NOT NULL GROUP BY 1, 2, 3""")
def pattern_upsert(spark, sf):
    seen = results(spark, sf).where("retry_strategy IS NOT NULL AND status IS NOT NULL")
    return state.upserted_patterns(seen, ["status", "retry_strategy"], "key", "result_id").withColumn("examples", F.array_join("examples", ","))


@query("SELECT station, lower(trim(key)) AS key, arg_max(edition, (snapshot_date, row_id)) FILTER (edition IS NOT NULL) AS edition FROM bulletin_index WHERE key IS NOT NULL GROUP BY 1, 2")
def index_upsert(spark, sf):
    e = table(spark, sf, "bulletin_index").where("key IS NOT NULL").withColumn("key", norm_key("key"))
    some = state.upserted_index(e.where("edition IS NOT NULL"), ["station", "key"], "edition", ["snapshot_date", "row_id"])
    return e.select("station", "key").distinct().join(some, ["station", "key"], "left")


NK = "regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', '', 'g')"


@query(f"""WITH a AS (SELECT unnest(list_distinct([{NK.format('key')}, {NK.format('display_name')}, CASE WHEN lower(display_name) LIKE '% parish' THEN {NK.format("left(display_name, length(display_name) - 7)")} ELSE '' END])) AS alias, key, row_id FROM contacts WHERE key IS NOT NULL),
 m AS (SELECT alias, arg_max(key, (row_id, key)) AS resolved FROM a WHERE length(alias) > 0 GROUP BY 1)
 SELECT row_id, coalesce(resolved, n) AS resolved FROM (SELECT row_id, {NK.format('display_name')} AS n FROM report_long) r LEFT JOIN m ON m.alias = r.n""")
def alias_lookup(spark, sf):
    aliases = lookups.alias_map(table(spark, sf, "contacts"), "key", "display_name", "row_id")
    return lookups.resolved_names(table(spark, sf, "report_long").select("row_id", "display_name"), aliases, "display_name").select("row_id", "resolved")


NT = f"trim(regexp_replace(regexp_replace(replace(translate(lower({{0}}), '{X.MARKED}', '{X.PLAIN}'), '&', ' and '), '[’''`]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
NB = "regexp_replace(regexp_replace(regexp_replace({0}, '\\([^()]*\\)', '', 'g'), '\\([^()]*\\)', '', 'g'), '\\([^()]*\\)', '', 'g')"


def _forms_sql(c: str) -> str:
    base = f"[{NT.format(c)}, {NT.format(NB.format(c))}]"
    return f"list_distinct(list_filter(flatten(list_transform({base}, lambda f: [f, regexp_replace(f, '\\bst\\b', 'saint', 'g'), regexp_replace(f, '\\bsaint\\b', 'st', 'g')])), lambda f: length(f) > 0))"


@query(f"""WITH q AS (SELECT DISTINCT display_name AS query, {_forms_sql('display_name')} AS f FROM stale_bulletins WHERE display_name IS NOT NULL),
 e AS (SELECT DISTINCT display_name AS name, {_forms_sql('display_name')} AS g FROM contacts WHERE display_name IS NOT NULL),
 x AS (SELECT query, count(DISTINCT name) AS n, min(name) AS name FROM q JOIN e ON list_has_any(f, g) GROUP BY 1),
 y AS (SELECT query, count(*) AS n, min(name) AS name FROM q JOIN e ON len(list_filter(flatten(list_transform(f, lambda a: list_transform(g, lambda b: contains(a, b) OR contains(b, a)))), lambda z: z)) > 0 WHERE query NOT IN (SELECT query FROM x) GROUP BY 1),
 h AS (SELECT *, 'exact' AS how FROM x UNION ALL SELECT *, 'partial' FROM y)
 SELECT q.query, CASE WHEN n IS NULL THEN 'none' WHEN n > 1 THEN 'ambiguous' ELSE how END AS outcome, CASE WHEN n = 1 THEN name END AS name, coalesce(n, 0) AS n FROM q LEFT JOIN h USING (query)""")
def name_match(spark, sf):
    q = table(spark, sf, "stale_bulletins").where("display_name IS NOT NULL").select(F.col("display_name").alias("query"))
    e = table(spark, sf, "contacts").where("display_name IS NOT NULL").select(F.col("display_name").alias("name"))
    return lookups.name_match(q, e)


@query("""WITH s AS (SELECT DISTINCT display_name AS section, trim(regexp_replace(replace(regexp_replace(lower(display_name), '\\([^)]*\\)', ' ', 'g'), '&', 'and'), '[^a-z0-9]+', ' ', 'g')) AS n FROM stale_bulletins WHERE display_name IS NOT NULL),
 r AS (SELECT key, lower(display_name) AS d, row_id AS seq FROM contacts WHERE display_name IS NOT NULL),
 x AS (SELECT section, key, seq, CASE WHEN contains(d, n) OR contains(n, split_part(d, ' ', 1)) THEN 3 ELSE 0 END
  + coalesce(list_sum(list_transform(list_filter(string_split(n, ' '), lambda w: length(w) >= 3), lambda w: CASE WHEN contains(d, w) THEN 2 ELSE 0 END + CASE WHEN contains(key, w) THEN 2 ELSE 0 END)), 0) AS score FROM s, r WHERE n <> '')
 SELECT section, arg_max(key, (score, -seq)) AS key, CAST(max(score) AS INTEGER) AS score FROM x WHERE score >= 2 GROUP BY 1""")
def section_score_match(spark, sf):
    s = table(spark, sf, "stale_bulletins").where("display_name IS NOT NULL").select(F.col("display_name").alias("section"))
    r = table(spark, sf, "contacts").where("display_name IS NOT NULL").select("key", F.col("display_name").alias("name"), F.col("row_id").alias("seq"))
    return lookups.section_score_match(s, r)


EDITIONS = "(SELECT lower(trim(parish)) AS parish, edition AS day, min(doc_id) AS doc FROM documents WHERE parish IS NOT NULL AND edition IS NOT NULL GROUP BY 1, 2)"


def _editions(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").where("parish IS NOT NULL AND edition IS NOT NULL")
    return d.groupBy(norm_key("parish").alias("parish"), F.col("edition").alias("day")).agg(F.min("doc_id").alias("doc"))


@query(f"""WITH e AS (SELECT * FROM {EDITIONS}), o AS (SELECT * FROM (VALUES (0, 0), (1, -1), (2, 1), (3, -2), (4, 2), (5, -3), (6, 3)) v(pref, off)),
 h AS (SELECT a.parish, a.day, b.day AS previous_day, b.doc AS previous_doc, row_number() OVER (PARTITION BY a.parish, a.day ORDER BY pref) AS rn FROM e a, o JOIN e b ON b.parish = a.parish AND b.day = a.day - 7 + off)
 SELECT e.parish, e.day, previous_day, previous_doc FROM e LEFT JOIN h ON h.parish = e.parish AND h.day = e.day AND rn = 1""")
def prev_edition_asof(spark, sf):
    return lookups.previous_edition(_editions(spark, sf), ["parish"], "day", "doc")


@query("""SELECT d, CAST(d - CAST(extract(dow FROM d) AS INTEGER) AS DATE) AS target, CAST(d + (7 - CAST(extract(dow FROM d) AS INTEGER)) AS DATE) AS next_sunday,
 CAST(d + (7 - CAST(extract(dow FROM d) AS INTEGER)) % 7 AS DATE) AS coming_sunday, CAST(date_trunc('week', d) AS DATE) AS monday, CAST(date_trunc('week', d) + INTERVAL 6 DAY AS DATE) AS last_day, n
 FROM (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1)""")
def week_window(spark, sf):
    d = table(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(F.count("*").alias("n"))
    c = F.col("d")
    w = D.week_range(c)
    return d.select("d", D.target_sunday(c).alias("target"), D.next_sunday(c).alias("next_sunday"), D.coming_sunday(c).alias("coming_sunday"), w["first"].alias("monday"), w["last"].alias("last_day"), "n")


URLS = "(SELECT DISTINCT url FROM fetch_results WHERE url IS NOT NULL)"


def _td(y: str, m: str, d: str) -> str:
    return f"try_strptime(nullif({y} || '-' || {m} || '-' || {d}, '--'), '%Y-%m-%d')::DATE"


def _rx(p: str, i: int) -> str:
    return f"regexp_extract(url, '{p}', {i})"


G = ("(?:^|[^0-9])", "(?:[^0-9]|$)")
_P = {
    "iso": "([0-9]{4})-([0-9]{2})-([0-9]{2})", "ymd8": G[0] + "([0-9]{4})([0-9]{2})([0-9]{2})" + G[1], "dmy8": G[0] + "([0-9]{2})([0-9]{2})([0-9]{4})" + G[1],
    "dmy6": G[0] + "([0-9]{2})([0-9]{2})([0-9]{2})" + G[1], "dot": G[0] + "([0-9]{2})\\.([0-9]{2})\\.([0-9]{2})" + G[1],
    "slug": "(?i)([0-9]{1,2})(?:st|nd|rd|th)?[_-]([a-z]+)[_-]([0-9]{4})",
    "dmy": G[0] + "(0?[1-9]|[12][0-9]|3[01])[-_/](0?[1-9]|1[0-2])[-_/]((?:19|20)[0-9]{2})" + G[1],
}
DATE_SQL = f"""coalesce({_td(_rx(_P['iso'], 1), _rx(_P['iso'], 2), _rx(_P['iso'], 3))}, {_td(_rx(_P['ymd8'], 1), _rx(_P['ymd8'], 2), _rx(_P['ymd8'], 3))},
 {_td(_rx(_P['dmy8'], 3), _rx(_P['dmy8'], 2), _rx(_P['dmy8'], 1))}, {_td("'20' || " + _rx(_P['dmy6'], 3), _rx(_P['dmy6'], 2), _rx(_P['dmy6'], 1))}, {_td("'20' || " + _rx(_P['dot'], 1), _rx(_P['dot'], 2), _rx(_P['dot'], 3))})"""
MONTH_SQL = "CASE lower(" + _rx(_P["slug"], 2) + ") " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in D.MONTH_NUMBERS.items()) + " END"
SLUG_SQL = _td(_rx(_P["slug"], 3), MONTH_SQL, _rx(_P["slug"], 1))
BULLETIN_SQL = f"coalesce({DATE_SQL}, {_td(_rx(_P['dmy'], 3), _rx(_P['dmy'], 2), _rx(_P['dmy'], 1))})"


def _urls(spark, sf) -> DataFrame:
    return table(spark, sf, "fetch_results").where("url IS NOT NULL").select("url").distinct()


@query(f"SELECT url, {DATE_SQL} AS in_text, {SLUG_SQL} AS in_slug, {BULLETIN_SQL} AS bulletin, coalesce({DATE_SQL}, {SLUG_SQL}) AS candidate FROM {URLS}")
def date_extract(spark, sf):
    u = F.col("url")
    return _urls(spark, sf).select("url", D.date_in_text(u).alias("in_text"), D.date_in_slug(u).alias("in_slug"), D.bulletin_date(u).alias("bulletin"), D.candidate_date(u).alias("candidate"))


def _partial_sql(t: str) -> str:
    """Score of a partial date (year, month and day as one number) in lower-case text."""
    month = "CASE {0} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in D.MONTH_NUMBERS.items() if len(k) == 3) + " END"
    g = lambda p, i: f"try_cast(regexp_extract({t}, '{p}', {i}) AS INTEGER)"
    ymd = lambda p, y, m, d: f"{g(p, y)} * 10000 + {g(p, m)} * 100 + {g(p, d)}"
    named = lambda p: f"{g(p, 3)} * 10000 + {month.format(f'left(regexp_extract({t}, {chr(39)}{p}{chr(39)}, 2), 3)')} * 100 + {g(p, 1)}"
    six, folder, year = "(?:^|/)([0-9]{2})([0-9]{2})([0-9]{2})\\.pdf\\b", "/(20[0-9]{2})/(0[1-9]|1[0-2])/", "\\b(20[0-9]{2})\\b"
    my = "\\b(" + "|".join([*D.MONTHS, *[m[:3] for m in D.MONTHS]]) + ")\\s+(20[0-9]{2})\\b"
    lone = "(?:^|[^0-9])", "(?:[^0-9]|$)"
    return f"""coalesce({ymd("\\b(20[0-9]{2})-(0[1-9]|1[0-2])-([0-2][0-9]|3[01])\\b", 1, 2, 3)}, {ymd("/(20[0-9]{2})/(0[1-9]|1[0-2])/([0-2][0-9]|3[01])/", 1, 2, 3)},
 {named("\\b([0-9]{1,2})(?:st|nd|rd|th)?[-_]([a-z]{3,9})[-_](20[0-9]{2})\\b")}, {named("\\b([0-9]{1,2})(?:st|nd|rd|th)?\\s+([a-z]{3,9})\\s+(20[0-9]{2})\\b")},
 CASE WHEN {g(six, 2)} BETWEEN 1 AND 12 AND {g(six, 1)} BETWEEN 1 AND 31 THEN (2000 + {g(six, 3)}) * 10000 + {g(six, 2)} * 100 + {g(six, 1)} END,
 {ymd(lone[0] + "(20[0-9]{2})(0[1-9]|1[0-2])([0-2][0-9]|3[01])" + lone[1], 1, 2, 3)}, {ymd(lone[0] + "([0-2][0-9]|3[01])(0[1-9]|1[0-2])(20[2-3][0-9])" + lone[1], 3, 2, 1)},
 {g(folder, 1)} * 10000 + {g(folder, 2)} * 100, {g(my, 2)} * 10000 + {month.format(f"left(regexp_extract({t}, '{my}', 1), 3)")} * 100, {g(year, 1)} * 10000)"""


FRESH = f"(SELECT url, {BULLETIN_SQL} AS d, DATE '{TARGET}' AS t FROM {URLS})"


@query(f"""SELECT url, CASE WHEN d IS NULL THEN 'unknown' WHEN d BETWEEN t - 6 AND t OR abs(d - t) <= 8 THEN 'fresh' ELSE 'stale' END AS status,
 CASE WHEN d IS NULL THEN 'no_date_in_url' WHEN d BETWEEN t - 6 AND t THEN 'in_bulletin_week' WHEN abs(d - t) <= 8 THEN 'within_grace_days' WHEN d > t THEN 'date_ahead_of_target' ELSE 'date_behind_of_target' END AS reason,
 d AS "date", CAST(d - t AS INTEGER) AS days FROM {FRESH}""")
def freshness_verdict(spark, sf):
    return _urls(spark, sf).withColumn("d", D.bulletin_date(F.col("url"))).withColumn("v", D.freshness(F.col("d"), target())).select("url", "v.*")


_LOG_YMD = G[0] + "(20[0-9]{2})[-_/](0?[1-9]|1[0-2])[-_/](0?[1-9]|[12][0-9]|3[01])" + G[1]
_LOG_8 = G[0] + "([0-9]{2})([0-9]{2})((?:19|20)[0-9]{2})" + G[1]
LOG_DATE_SQL = f"coalesce({_td(_rx(_LOG_YMD, 1), _rx(_LOG_YMD, 2), _rx(_LOG_YMD, 3))}, {_td(_rx(_P['dmy'], 3), _rx(_P['dmy'], 2), _rx(_P['dmy'], 1))}, {_td(chr(39) + '20' + chr(39) + ' || ' + _rx(_P['dmy6'], 3), _rx(_P['dmy6'], 2), _rx(_P['dmy6'], 1))}, {_td(_rx(_LOG_8, 3), _rx(_LOG_8, 2), _rx(_LOG_8, 1))})"


@query(f"""SELECT result_id, key, url, d AS "date", CAST(DATE '{TARGET}' - d AS INTEGER) AS days_old, CASE WHEN d IS NULL THEN 'unknown_date' ELSE 'stale' END AS list_name
 FROM (SELECT result_id, key, url, {LOG_DATE_SQL} AS d FROM {FR} WHERE status = 'ok' AND length(url) > 0 AND length(key) > 0) WHERE d IS NULL OR DATE '{TARGET}' - d > 8""")
def stale_list(spark, sf):
    d = D.url_date(F.col("url"))
    rows = results(spark, sf).where("status = 'ok' AND length(url) > 0 AND length(key) > 0").select("result_id", "key", "url", d.alias("date"))
    rows = rows.withColumn("days_old", F.datediff(target(), "date"))
    return rows.where("date IS NULL OR days_old > 8").withColumn("list_name", F.when(F.col("date").isNull(), "unknown_date").otherwise("stale"))


ENTRIES_SQL = """(SELECT lower(trim(key)) AS key, CASE WHEN bool_or(facebook IS NOT NULL) THEN 'html_link' ELSE 'A' END AS pattern, CASE WHEN bool_or(facebook IS NOT NULL) THEN 'html_link' ELSE 'pdf' END AS content_type,
 coalesce(min(website), '') AS bulletin_page FROM contacts WHERE key IS NOT NULL GROUP BY 1)"""


def _entries(spark, sf) -> DataFrame:
    """Entries as the contacts tell them: sources with a social page are links, the others files of a dated pattern."""
    c = table(spark, sf, "contacts").where("key IS NOT NULL").groupBy(norm_key("key").alias("key")).agg(
        F.bool_or(F.col("facebook").isNotNull()).alias("_link"), F.coalesce(F.min("website"), F.lit("")).alias("bulletin_page")
    )
    return c.select("key", F.when(F.col("_link"), "html_link").otherwise("A").alias("pattern"), F.when(F.col("_link"), "html_link").otherwise("pdf").alias("content_type"), "bulletin_page")


STRATEGY_SQL = """CASE WHEN contains(coalesce(file_type, ''), 'recipe') OR pattern IN ('learned', 'recipe') THEN 'retrain_recipe' WHEN length(trim(coalesce(bulletin_page, ''))) > 0 AND coalesce(content_type, '') <> 'html_link' THEN 'rescrape_bulletin_page'
 WHEN pattern <> '' AND pattern NOT IN ('html_link', 'F') THEN 'try_date_patterns' ELSE 'manual_review' END"""


@query(f"SELECT result_id, f.key, {STRATEGY_SQL} AS strategy FROM {FR} f LEFT JOIN {ENTRIES_SQL} e ON e.key = f.key")
def retry_strategy(spark, sf):
    r = results(spark, sf).join(_entries(spark, sf), "key", "left")
    s = P.retry_strategy(F.col("file_type"), F.col("pattern"), F.length(F.trim("bulletin_page")) > 0, F.col("content_type"))
    return r.select("result_id", "key", s.alias("strategy"))


@query("""WITH t AS (SELECT DISTINCT target_date AS t FROM report_long WHERE target_date IS NOT NULL)
 SELECT t, array_to_string(flatten(list_transform(range(7), lambda i: [strftime(t - CAST(i AS INTEGER), '%d%m%y'), strftime(t - CAST(i AS INTEGER), '%d%m%Y'), strftime(t - CAST(i AS INTEGER), '%Y-%m-%d'), strftime(t - CAST(i AS INTEGER), '%Y%m%d')])), ',') AS variants,
 array_to_string([strftime(t, '%d%m%y'), strftime(t, '%d%m%Y'), strftime(t, '%Y-%m-%d'), strftime(t, '%Y%m%d'), strftime(t, '%-d-%-m-%y'), lower(strftime(t, '%-d-%B-%Y')), lower(strftime(t, '%-d%B%Y')), lower(strftime(t, '%-d%b%Y')), lower(strftime(t, '%B')), lower(strftime(t, '%b'))], ',') AS tokens FROM t""")
def date_variants(spark, sf):
    t = table(spark, sf, "report_long").where("target_date IS NOT NULL").select(F.col("target_date").alias("t")).distinct()
    return t.select("t", F.array_join(D.date_variants(F.col("t")), ",").alias("variants"), F.array_join(D.link_tokens(F.col("t")), ",").alias("tokens"))


@query("""WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS y FROM orders), a AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y),
 h AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM a), k AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS k FROM h),
 n AS (SELECT *, h + k - 7 * ((a + 11 * h + 22 * k) // 451) + 114 AS n FROM k) SELECT CAST(y AS INTEGER) AS year, make_date(y, n // 31, n % 31 + 1) AS easter FROM n""")
def easter_dates(spark, sf):
    y = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return y.select("year", D.easter(F.col("year")).alias("easter"))


NEWS = "'https://www.parish.example/files/Newsletters/' || o_orderkey || '/' || strftime(CAST(o_orderdate AS DATE), '%-d-%B-%Y')"


@query(f"""SELECT u AS url, CAST(k AS INTEGER) AS number, 'https://www.parish.example/files/Newsletters/' || (k + greatest(0, CAST(floor((DATE '2000-01-02' - d) / 7.0) AS INTEGER))) || '/' AS next_url
 FROM (SELECT {NEWS} AS u, o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def newsletter_number(spark, sf):
    o = table(spark, sf, "orders").select(F.concat(F.lit("https://www.parish.example/files/Newsletters/"), F.col("o_orderkey").cast("string"), F.lit("/"), F.date_format("o_orderdate", "d-MMMM-yyyy")).alias("url"))
    return o.select("url", U.newsletter_number(F.col("url")).alias("number"), U.next_newsletter(F.col("url"), F.lit("2000-01-02").cast("date")).alias("next_url"))


HOST_SQL = "nullif(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1), '')"


@query(f"""SELECT url, h AS host, regexp_replace(h, '^www\\d*\\.', '') AS bare, split_part(regexp_replace(h, '^www\\d*\\.', ''), '.', 1) AS key,
 regexp_replace(h, '^www\\d*\\.', '') || lower(regexp_replace(regexp_extract(replace(trim(url), ' ', '%20'), '^[^:]+://[^/?#]+([^?#]*)', 1), '/+$', '')) AS normal FROM (SELECT url, {HOST_SQL} AS h FROM {URLS})""")
def url_key(spark, sf):
    u = F.col("url")
    return _urls(spark, sf).select("url", U.hostname(u).alias("host"), U.bare_host(u).alias("bare"), U.url_key(u, F.lit("")).alias("key"), U.normal_url(u).alias("normal"))


def _links(spark, sf) -> DataFrame:
    """A week's report of a station as a page of links."""
    r = table(spark, sf, "report_long").where("url IS NOT NULL AND station IS NOT NULL")
    return r.select(F.concat("station", F.lit("/"), F.col("target_date").cast("string")).alias("page"), F.col("row_id").alias("idx"), F.col("url").alias("href"), F.coalesce("display_name", F.lit("")).alias("text"))


LINKS = "(SELECT station || '/' || strftime(target_date, '%Y-%m-%d') AS page, row_id AS idx, url AS href, coalesce(display_name, '') AS text FROM report_long WHERE url IS NOT NULL AND station IS NOT NULL)"
_T = f"DATE '{TARGET}'"
TOKENS_SQL = f"[strftime({_T}, '%d%m%y'), strftime({_T}, '%d%m%Y'), strftime({_T}, '%Y-%m-%d'), strftime({_T}, '%Y%m%d'), strftime({_T}, '%-d-%-m-%y'), lower(strftime({_T}, '%-d-%B-%Y')), lower(strftime({_T}, '%-d%B%Y')), lower(strftime({_T}, '%-d%b%Y')), lower(strftime({_T}, '%B')), lower(strftime({_T}, '%b'))]"


@query(f"""WITH b AS (SELECT page, idx, href, lower(href || ' ' || text) AS url FROM {LINKS}), s AS (SELECT page, idx, href, CAST(len(list_filter({TOKENS_SQL}, lambda t: contains(url, t))) > 0 AS INTEGER) AS token, {DATE_SQL} AS d FROM b),
 w AS (SELECT *, CAST(coalesce(d BETWEEN {_T} - 6 AND {_T}, false) AS INTEGER) AS in_week, CAST(d IS NULL OR d BETWEEN {_T} - 6 AND {_T} AS INTEGER) AS not_stale FROM s)
 SELECT page, idx, href, token, in_week, not_stale FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY token DESC, in_week DESC, not_stale DESC, idx) AS rn FROM w) WHERE rn = 1 AND token + in_week + not_stale > 0""")
def best_link_per_page(spark, sf):
    return ranking.best_listing_link(_links(spark, sf), target()).select("page", "idx", "href", "token", "in_week", "not_stale")


PAGE_TOKENS_SQL = f"[strftime({_T}, '%d%m%y'), strftime({_T}, '%d%m%Y'), strftime({_T}, '%Y-%m-%d'), strftime({_T}, '%Y%m%d'), strftime({_T}, '%-d-%-m-%y'), strftime({_T}, '%-d-%m-%y'), lower(strftime({_T}, '%-d-%B-%Y')), lower(strftime({_T}, '%-d%B%Y')), lower(strftime({_T}, '%-d%b%Y')), strftime({_T}, '%y.%m.%d.pdf'), strftime({_T}, '%y.%m.%d')]"
SCORED = f"""(SELECT page, idx, href, CAST(len(list_filter({PAGE_TOKENS_SQL}, lambda t: contains(url, t))) > 0 AS INTEGER) AS token, CAST(coalesce(d BETWEEN {_T} - 6 AND {_T}, false) AS INTEGER) AS in_week,
 CAST(d IS NULL OR d BETWEEN {_T} - 6 AND {_T} AS INTEGER) AS not_stale, d AS day FROM (SELECT page, idx, href, url, coalesce({DATE_SQL}, {SLUG_SQL}) AS d FROM (SELECT page, idx, href, lower(href || ' ' || text) AS url FROM {LINKS})))"""


@query(f"""SELECT page, idx, token, in_week, not_stale, day FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY token DESC, in_week DESC, not_stale DESC, day DESC NULLS LAST, idx) AS rn FROM {SCORED}) WHERE rn = 1""")
def best_candidate_per_page(spark, sf):
    return ranking.best_candidate(_links(spark, sf), target()).select("page", "idx", "token", "in_week", "not_stale", "day")


_DASHED = "(?:^|[^0-9])([0-9]{1,2}-[0-9]{1,2}-[0-9]{2})(?:[^0-9]|$)"
OTHER_SQL = f"regexp_matches(href, '{P.OTHER_WORDS}') AND NOT regexp_matches(href, '{P.EDITION_WORDS}')"


@query(f"""WITH l AS (SELECT page, idx, href, lower(href) AS url FROM {LINKS} WHERE NOT ({OTHER_SQL})),
 s AS (SELECT page, idx, href, CAST(greatest(coalesce(list_max(list_transform(regexp_extract_all(url, '{_DASHED}', 1), lambda x: (2000 + CAST(split_part(x, '-', 3) AS INTEGER)) * 10000 + CAST(split_part(x, '-', 2) AS INTEGER) * 100 + CAST(split_part(x, '-', 1) AS INTEGER))), 0),
  coalesce((2000 + try_cast({_rx(_P['dmy6'], 3)} AS INTEGER)) * 10000 + try_cast({_rx(_P['dmy6'], 2)} AS INTEGER) * 100 + try_cast({_rx(_P['dmy6'], 1)} AS INTEGER), 0)) AS INTEGER) AS date_score,
  CASE WHEN regexp_matches(url, '\\b(?:bulletin|newsletter)\\b') THEN 10 ELSE 0 END AS bonus FROM l)
 SELECT page, idx, href, date_score, bonus FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY date_score DESC, bonus DESC, idx) AS rn FROM s) WHERE rn = 1""")
def best_document_per_page(spark, sf):
    return ranking.best_document(_links(spark, sf))


DATED = f"(SELECT *, CASE WHEN score % 100 > 0 AND score // 100 % 100 > 0 THEN true ELSE false END AS full_date FROM (SELECT *, {_partial_sql('t')} AS score FROM (SELECT *, lower(href || ' ' || text) AS t, trim(href || ' ' || text) AS blob FROM {LINKS})))"


@query(f"""WITH s AS (SELECT *, (CASE WHEN regexp_matches(blob, '{X.STRONG}') THEN 80 WHEN regexp_matches(blob, '{X.GOOD}') THEN 20 ELSE 0 END) + CASE WHEN regexp_matches(blob, '(?i)\\.pdf(?:\\?|$)') THEN 8 ELSE 0 END AS bonus,
  CASE WHEN regexp_matches(blob, '{X.POOR}') THEN 120 ELSE 0 END AS penalty FROM {DATED}),
 r AS (SELECT page, idx, href, text, penalty >= 120 AND bonus < 40 AS rejected, false AS pinned, full_date, score IS NOT NULL AS dated, coalesce(score, 0) AS date_score, CAST(coalesce(score, 0) AS BIGINT) * 100 + bonus - penalty + idx AS points FROM s)
 SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY page ORDER BY rejected, full_date DESC, dated DESC, CASE WHEN dated THEN date_score END DESC NULLS LAST, CASE WHEN NOT dated THEN points END DESC NULLS LAST, idx) AS INTEGER) AS rank FROM r) WHERE rank <= 4 AND (rank = 1 OR NOT rejected)""")
def link_phrase_rank(spark, sf):
    return ranking.ranked_links(_links(spark, sf))


@query(f"""SELECT page, idx, href, text, full_date, score IS NOT NULL AS dated, coalesce(score, 0) AS date_score FROM
 (SELECT *, row_number() OVER (PARTITION BY page ORDER BY full_date DESC, score IS NOT NULL DESC, score DESC NULLS LAST, idx DESC) AS rn FROM {DATED}) WHERE rn = 1""")
def date_first_link(spark, sf):
    return ranking.date_first(_links(spark, sf))


@query(f"""SELECT s.page, max(s.day) AS newest FROM {SCORED} s JOIN (SELECT page, idx FROM (SELECT page, idx, lower(href) AS url FROM {LINKS}) WHERE coalesce({DATE_SQL}, {SLUG_SQL}) IS NOT NULL) d ON d.page = s.page AND d.idx = s.idx
 GROUP BY s.page HAVING bool_and(day IS NOT NULL) AND NOT bool_or(in_week + token > 0)""")
def stale_pages(spark, sf):
    return ranking.stale_pages(_links(spark, sf).where(D.candidate_date(F.lower("href")).isNotNull()), target())


@query(f"""WITH s AS (SELECT page, idx, href, text, coalesce(score, 0) AS date_score, {OTHER_SQL} AS other FROM {DATED}),
 p AS (SELECT * FROM (SELECT *, bool_and(other) OVER (PARTITION BY page) AS only_other FROM s) WHERE NOT other OR only_other),
 t AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY date_score DESC, idx) AS rn FROM p),
 u AS (SELECT page FROM t WHERE rn <= 3 GROUP BY page HAVING count(*) > 1 AND (max(date_score) FILTER (rn = 1) = 0 OR max(date_score) FILTER (rn = 1) = max(date_score) FILTER (rn = 2)))
 SELECT page, idx, href, text, date_score, other FROM t WHERE rn <= 3 AND page IN (SELECT page FROM u)""")
def ambiguous_pages(spark, sf):
    return ranking.ambiguous_pages(_links(spark, sf))


def _link_pages(spark, sf) -> DataFrame:
    """A week's report of a station as a page of links, written out as HTML."""
    link = F.concat(F.lit('<a href="'), F.col("href"), F.lit('">'), F.col("text"), F.lit("</a>"))
    g = _links(spark, sf).groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", link.alias("l")))), lambda x: x["l"]), "\n").alias("html"))
    return g.select("page", F.concat(F.lit("https://"), "page").alias("url"), "html")


def _pages(spark, sf) -> DataFrame:
    """Documents at the address of their source's last result, and pages of links."""
    urls = results(spark, sf).where("url IS NOT NULL AND key IS NOT NULL").groupBy("key").agg(F.max_by("url", "result_id").alias("url"))
    d = table(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("page"), F.col("text").alias("html"), norm_key("parish").alias("key"))
    return d.join(urls, "key", "left").select("page", "url", "html").unionByName(_link_pages(spark, sf))


PAGES_SQL = f"""(SELECT CAST(doc_id AS VARCHAR) AS page, u.url, text AS html FROM documents d LEFT JOIN (SELECT key, arg_max(url, result_id) AS url FROM {FR} WHERE url IS NOT NULL AND key IS NOT NULL GROUP BY 1) u ON u.key = lower(trim(d.parish)) WHERE text IS NOT NULL
 UNION ALL SELECT page, 'https://' || page, string_agg('<a href="' || href || '">' || text || '</a>', chr(10) ORDER BY idx) FROM {LINKS} GROUP BY page)"""


def _q(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


_CONTENT_SQL = f"regexp_extract(html, {_q(G_.CONTENT)}, 0)"
_IMAGES_SQL = f"list_filter(regexp_extract_all({_CONTENT_SQL}, '(?i)<img[^>]*>', 0), lambda x: coalesce(try_cast(nullif(regexp_extract(x, {_q(G_.WIDTH)}, 1), '') AS INTEGER), 0) >= {{0}} AND NOT regexp_matches(x, {_q(G_.DECORATIVE)}))"
_LENGTH_SQL = f"length(trim(regexp_replace(regexp_replace('<' || {_CONTENT_SQL}, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')))"
_PARAGRAPHS_SQL = f"len(regexp_extract_all({_CONTENT_SQL}, '(?i)<(?:p|li)\\b|wp-block-paragraph', 0))"
TEXT_PAGE_SQL = f"({_LENGTH_SQL} >= 400 AND ({_PARAGRAPHS_SQL} >= 4 OR {_LENGTH_SQL} >= 800) AND (regexp_matches(html, {_q(G_.WP_SIGNS)}) OR regexp_matches(html, {_q(G_.EDITION_SIGNS)})) AND NOT (len({_IMAGES_SQL.replace('{0}', '500')}) = 1 AND {_LENGTH_SQL} < 600))"
IMAGE_PAGE_SQL = f"(len(list_filter({_IMAGES_SQL.replace('{0}', '400')}, lambda x: regexp_matches(x, {_q(P.EDITION_WORDS)}) OR regexp_matches(x, '(?i)/wp-content/uploads/'))) > 0)"


def _rules_sql() -> str:
    parts = []
    for i, r in enumerate(G_.RULE_SETS):
        score = " + ".join(f"CASE WHEN regexp_matches(html, {_q(p)}) THEN {w} ELSE 0 END" for p, w in r.marks)
        held = {"text": TEXT_PAGE_SQL, "image": IMAGE_PAGE_SQL, None: "true"}[r.test]
        parts.append(f"SELECT page, {i} AS i, '{r.name}' AS rule, '{r.kind}' AS kind, CAST({score} AS INTEGER) AS score FROM {PAGES_SQL} WHERE {held} AND {score} >= {r.least}")
    return " UNION ALL ".join(parts)


@query(f"SELECT page, rule, kind, score FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, i) AS rn FROM ({_rules_sql()})) WHERE rn <= 6")
def html_fingerprint(spark, sf):
    return ranking.fingerprints(_pages(spark, sf))


_FOLDER_SQL = "coalesce(regexp_matches(lower(url), 'drive\\.google\\.com.*/folders/|1drv\\.ms'), false)"


@query(f"""WITH b AS (SELECT page, arg_min(kind, (-score, i)) AS kind FROM ({_rules_sql()}) GROUP BY page)
 SELECT p.page, CASE WHEN regexp_matches(lower(coalesce(url, '')), {_q(G_.DIRECT)}) THEN 'direct_pdf' WHEN {_FOLDER_SQL} THEN 'cloud_folder'
 WHEN b.kind IS NOT NULL AND NOT (b.kind = 'cloud_folder' OR (b.kind = 'image' AND (NOT {IMAGE_PAGE_SQL} OR {TEXT_PAGE_SQL}))) THEN b.kind WHEN {TEXT_PAGE_SQL} THEN 'wix_html'
 {' '.join(f"WHEN regexp_matches(html, {_q(x)}){chr(32) + 'AND regexp_matches(html, ' + _q('(?i)onewebstatic|one.com') + ')' if k == 'oneweb_docx' else ''} THEN '{k}'" for k, x in G_.SIGNS)}
 WHEN len(list_filter(regexp_extract_all(html, {_q(G_.DOCUMENT_LINK)}, 1), lambda x: NOT (regexp_matches(x, '{P.OTHER_WORDS}') AND NOT regexp_matches(x, '{P.EDITION_WORDS}')))) > 0 THEN 'pdf_links'
 WHEN regexp_matches(html, {_q(G_.WEEKLY)}) AND regexp_matches(html, {_q(G_.WEEKLY_ROW)}) THEN 'weekly_bulletin_download' WHEN {IMAGE_PAGE_SQL} THEN 'image'
 WHEN regexp_matches(html, {_q(G_.WIX)}) AND regexp_matches(lower(coalesce(url, '')), {_q(G_.DATED_SLUG)}) THEN 'wix_html' WHEN regexp_matches(html, {_q(G_.WIX)}) AND len(regexp_extract_all(html, {_q(G_.DATED_LINK)}, 0)) >= 4 THEN 'wix_date_grid'
 WHEN regexp_matches(html, '(?i)<a[^>]+href|<button') THEN 'html' ELSE 'unknown' END AS kind FROM {PAGES_SQL} p LEFT JOIN b ON b.page = p.page""")
def page_types(spark, sf):
    return _pages(spark, sf).select("page", G_.page_type(F.col("url"), F.col("html")).alias("kind"))


@query(f"""WITH l AS (SELECT * EXCLUDE t, coalesce(r.file_type, '') = 'pdf' AS is_download, lower(d.href || ' ' || text) AS t FROM {DATED} d JOIN (SELECT row_id, file_type FROM report_long) r ON r.row_id = d.idx),
 w AS (SELECT * FROM l WHERE (regexp_matches(lower(href), 'weekly-bulletins|/newsletters/|/files/\\d+/[^/?#]*sunday') OR regexp_matches(lower(trim(href)), '\\.(?:pdf|docx)$') OR regexp_matches(lower(href), '^[^?#]*\\.(?:pdf|docx)(?:[?#]|$)')) AND NOT ({OTHER_SQL}))
 SELECT page, idx, href, text, is_download, full_date, dated, date_score, points FROM (SELECT *, score IS NOT NULL AS dated, coalesce(score, 0) AS date_score, idx + CASE WHEN is_download THEN 25 ELSE 0 END AS points,
 row_number() OVER (PARTITION BY page ORDER BY full_date DESC, score IS NOT NULL DESC, coalesce(score, 0) DESC, idx + CASE WHEN is_download THEN 25 ELSE 0 END DESC, idx DESC) AS rn FROM w) WHERE rn = 1""")
def best_weekly_link(spark, sf):
    kinds = table(spark, sf, "report_long").select(F.col("row_id").alias("idx"), (F.coalesce("file_type", F.lit("")) == "pdf").alias("is_download"))
    return ranking.best_weekly(_links(spark, sf).join(kinds, "idx").select("page", "idx", "href", "text", "is_download"))


KIND_SQL = "CASE " + " ".join(f"WHEN regexp_matches(e, '{p}') THEN '{k}'" for k, p in P.ERROR_KINDS) + " ELSE 'other' END"


@query(f"""SELECT result_id, {KIND_SQL} AS kind, regexp_matches(lower(e), '{P.BLOCK_WORDS}') AS blocked FROM (SELECT result_id, coalesce(error, '') AS e FROM {FR} WHERE {FAILED})""")
def error_category(spark, sf):
    e = results(spark, sf).where(P.log_status(F.col("status")) == "failed").where("status IS NOT NULL")
    return e.select("result_id", P.error_kind(F.col("error")).alias("kind"), P.bot_block(F.col("error")).alias("blocked"))


@query("""SELECT event_type, count(*) AS n, count(k) AS with_k, CAST(sum(k) AS BIGINT) AS sum_k FROM (SELECT event_type, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY 1""")
def event_props_parse(spark, sf):
    k = A.first_int(F.get_json_object("props", "$.k"), F.get_json_object("props", "$.K"))
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(k).alias("with_k"), F.sum(k).alias("sum_k"))


RAW = """'```json' || chr(10) || 'Here you are: [{"title": "Mass ' || row_id || '", "date_iso": "' || strftime(edition, '%Y-%m-%d') || '", "category": "' || CASE WHEN row_id % 2 = 0 THEN 'MASS' ELSE 'party' END || '"}, {"title": " ", "date_iso": "2025-02-31"}]' || chr(10) || '```'"""


@query("""SELECT row_id, 'Mass ' || row_id AS title, strftime(edition, '%Y-%m-%d') AS date_iso, CASE WHEN row_id % 2 = 0 THEN 'mass' ELSE 'other' END AS category FROM bulletin_index WHERE edition IS NOT NULL""")
def event_extract(spark, sf):
    raw = F.format_string('```json\nHere you are: [{"title": "Mass %d", "date_iso": "%s", "category": "%s"}, {"title": " ", "date_iso": "2025-02-31"}]\n```', F.col("row_id"), F.col("edition").cast("string"), F.when(F.col("row_id") % 2 == 0, "MASS").otherwise("party"))
    e = table(spark, sf, "bulletin_index").where("edition IS NOT NULL").select("row_id", F.explode(A.events_of(raw)).alias("e"))
    return e.select("row_id", "e.title", "e.date_iso", "e.category")


LINES_SQL = "list_filter(list_transform(string_split_regex(coalesce(text, ''), '\\r\\n|\\n|\\r'), lambda x: trim(regexp_replace(lower(x), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))), lambda x: length(x) >= 20)"


@query(f"SELECT doc_id, len(l) AS lines, CAST(coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) AS BIGINT) AS chars FROM (SELECT doc_id, {LINES_SQL} AS l FROM documents)")
def line_normalise(spark, sf):
    ls = X.compared_lines(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(ls).cast("long").alias("lines"), F.aggregate(ls, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


def _pairs(spark, sf) -> DataFrame:
    """Editions with their previous edition's text."""
    e = lookups.previous_edition(_editions(spark, sf), ["parish"], "day", "doc").where("previous_doc IS NOT NULL").join(_editions(spark, sf), ["parish", "day"])
    d = table(spark, sf, "documents").select("doc_id", "text")
    new = e.join(d.withColumnsRenamed({"doc_id": "doc", "text": "new"}), "doc")
    return new.join(d.withColumnsRenamed({"doc_id": "previous_doc", "text": "old"}), "previous_doc")


@query(f"""WITH e AS (SELECT * FROM {EDITIONS}), o AS (SELECT * FROM (VALUES (0, 0), (1, -1), (2, 1), (3, -2), (4, 2), (5, -3), (6, 3)) v(pref, off)),
 h AS (SELECT a.doc, b.doc AS previous_doc, row_number() OVER (PARTITION BY a.parish, a.day ORDER BY pref) AS rn FROM e a, o JOIN e b ON b.parish = a.parish AND b.day = a.day - 7 + off),
 l AS (SELECT doc_id, unnest({LINES_SQL}) AS line FROM documents), n AS (SELECT h.doc, line, count(*) AS c FROM h JOIN l ON l.doc_id = h.doc WHERE rn = 1 GROUP BY 1, 2), p AS (SELECT h.doc, line, count(*) AS c FROM h JOIN l ON l.doc_id = h.previous_doc WHERE rn = 1 GROUP BY 1, 2)
 SELECT doc, CAST(sum(greatest(coalesce(n.c, 0) - coalesce(p.c, 0), 0)) AS BIGINT) AS added, CAST(sum(greatest(coalesce(p.c, 0) - coalesce(n.c, 0), 0)) AS BIGINT) AS removed, CAST(sum(least(coalesce(n.c, 0), coalesce(p.c, 0))) AS BIGINT) AS kept
 FROM n FULL JOIN p USING (doc, line) GROUP BY 1""")
def line_bag_diff(spark, sf):
    e = lookups.previous_edition(_editions(spark, sf), ["parish"], "day", "doc").where("previous_doc IS NOT NULL").join(_editions(spark, sf), ["parish", "day"])
    sides = F.array(F.struct(F.col("doc").alias("doc_id"), F.lit(True).alias("is_new")), F.struct(F.col("previous_doc").alias("doc_id"), F.lit(False).alias("is_new")))
    roles = e.select("doc", F.inline(sides))
    texts = table(spark, sf, "documents").select("doc_id", "text").join(roles, "doc_id")
    lines = texts.select("doc", "is_new", F.explode(X.compared_lines(F.col("text"))).alias("line"))
    both = lines.groupBy("doc", "line").agg(F.count_if("is_new").alias("n"), F.count_if(~F.col("is_new")).alias("p"))
    n, p = F.col("n"), F.col("p")
    return both.groupBy("doc").agg(F.sum(F.greatest(n - p, F.lit(0))).alias("added"), F.sum(F.greatest(p - n, F.lit(0))).alias("removed"), F.sum(F.least(n, p)).alias("kept"))


@query()
def line_diff_exact(spark, sf):
    return _pairs(spark, sf).withColumn("d", Y.diff_lines("new", "old")).select("doc", "previous_doc", "d.*")


MARKERS = """WITH nm AS (SELECT DISTINCT key, unnest(list_filter([f, CASE WHEN lower(n) LIKE '% parish' THEN trim(regexp_replace(lower(left(n, length(n) - 7)), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) ELSE '' END,
  trim(regexp_replace(lower(trim(regexp_replace(n, '[ \\t\\n\\x0B\\f\\r]*\\(.*\\)[ \\t\\n\\x0B\\f\\r]*', '', 'g'))), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))], lambda x: length(x) >= 3)) AS form
  FROM (SELECT key, display_name AS n, trim(regexp_replace(lower(display_name), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS f FROM contacts WHERE key IS NOT NULL AND display_name IS NOT NULL)),
 l AS (SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(trim(text), chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
 m AS (SELECT doc_id, key, min(pos) AS pos FROM l JOIN nm ON nm.form = trim(regexp_replace(lower(line), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) GROUP BY 1, 2),
 w AS (SELECT *, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos, key) AS nxt FROM m)"""


@query(MARKERS + """
 SELECT doc_id, key, CAST(w.pos - 1 AS INTEGER) AS first_line, CAST(coalesce(nxt, n + 1) - w.pos AS INTEGER) AS n_lines FROM w JOIN (SELECT doc_id, max(pos) AS n FROM l GROUP BY 1) x USING (doc_id)""")
def marker_spans(spark, sf):
    docs = table(spark, sf, "documents")
    names = table(spark, sf, "contacts").where("key IS NOT NULL AND display_name IS NOT NULL").select("key", "display_name")
    return sections.marker_spans(docs, names).select("doc_id", "key", F.col("pos").alias("first_line"), F.col("length").alias("n_lines"))


@query(MARKERS + """
 SELECT doc_id, key, trim(array_to_string(list_slice(ls, w.pos, coalesce(nxt, len(ls) + 1) - 1), chr(10)), ' ' || chr(9) || chr(10) || chr(13)) AS chunk
 FROM w JOIN (SELECT doc_id, string_split(trim(text), chr(10)) AS ls FROM documents WHERE text IS NOT NULL) d USING (doc_id)""")
def split_by_marker(spark, sf):
    docs = table(spark, sf, "documents")
    names = table(spark, sf, "contacts").where("key IS NOT NULL AND display_name IS NOT NULL").select("key", "display_name")
    return sections.split_by_markers(docs, names)


@query(f"""WITH c AS (SELECT run_id AS chain, seq, url, lag(url) OVER (PARTITION BY run_id ORDER BY seq, result_id) AS p, row_number() OVER (PARTITION BY run_id ORDER BY seq, result_id) AS n FROM {FR}),
 s AS (SELECT chain, n, url, unnest(CASE WHEN url IS NOT NULL AND url IS DISTINCT FROM p THEN ['goto', 'click'] ELSE ['click'] END) AS action FROM c)
 SELECT chain, CAST(row_number() OVER (PARTITION BY chain ORDER BY n, action = 'click') AS INTEGER) AS step, action, url FROM s""")
def goto_insertion(spark, sf):
    r = results(spark, sf).select(F.col("run_id").alias("chain"), "url", F.row_number().over(Window.partitionBy("run_id").orderBy("seq", "result_id")).alias("seq"))
    return sections.with_gotos(r)


@query("""SELECT doc_id, substr(text, greatest(1, p - 75), p + 6 + 75 - greatest(1, p - 75)) AS snippet FROM (SELECT doc_id, text, instr(lower(text), 'parish') AS p FROM documents WHERE contains(lower(text), 'parish'))""")
def search_docs(spark, sf):
    d = table(spark, sf, "documents").where(X.has_text(F.col("text"), " Parish "))
    return d.select("doc_id", X.snippet(F.col("text"), F.lit("parish")).alias("snippet"))


@query("""SELECT doc_id, CAST(rank AS BIGINT) AS rank, CAST(running AS BIGINT) AS running FROM (SELECT doc_id, row_number() OVER (ORDER BY edition DESC, doc_id) AS rank, sum(b) OVER (ORDER BY edition DESC, doc_id ROWS UNBOUNDED PRECEDING) AS running
 FROM (SELECT doc_id, edition, strlen(left(text, 4000)) AS b FROM documents WHERE text IS NOT NULL AND edition IS NOT NULL)) WHERE running <= 200000""")
def search_index_cap(spark, sf):
    d = table(spark, sf, "documents").where("text IS NOT NULL AND edition IS NOT NULL").select("doc_id", "edition", F.octet_length(F.left("text", F.lit(4000))).cast("long").alias("bytes"))
    return order.byte_budget(d, [F.desc("edition"), F.col("doc_id")], "bytes", 200_000).select("doc_id", F.col("rank").cast("long").alias("rank"), "running")


@query("""SELECT source, count(*) AS pages, CAST(coalesce(sum(length(coalesce(text, ''))), 0) AS BIGINT) AS chars, chars / pages AS mean, chars >= 200 AND chars / pages >= 80 AS usable FROM documents GROUP BY 1""")
def text_density(spark, sf):
    return sections.text_density(table(spark, sf, "documents"), ["source"])


PHONE_SQL = "(?:\\+353|0)[ \\t\\n\\r-]?[0-9]{1,3}[ \\t\\n\\r-]?[0-9]{3}[ \\t\\n\\r-]?[0-9]{3,4}"


@query(f"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{X.MAIL}'))), '|') AS mails, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{PHONE_SQL}'))), '|') AS phones FROM documents WHERE text IS NOT NULL""")
def contacts_extract(spark, sf):
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.array_join(F.array_sort(X.mails(F.col("text"))), "|").alias("mails"), F.array_join(F.array_sort(X.phones(F.col("text"))), "|").alias("phones"))


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND length(regexp_replace(text, '[^a-zA-Z]+', '', 'g')) < 30")
def blank_filter(spark, sf):
    return table(spark, sf, "documents").where(P.blank_page(F.col("text"), "[^a-zA-Z]+")).select("doc_id")


def _files(spark, sf) -> DataFrame:
    name = F.when(F.col("o_orderstatus") == "P", F.concat(F.date_format("o_orderdate", "yyyy-MM"), F.lit("-individual-pdfs.zip"))).otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit(".pdf")))
    kind = F.when(F.col("o_orderstatus") == "P", "archive").when(F.col("o_orderstatus") == "O", "merged").otherwise("individual")
    return table(spark, sf, "orders").select(F.concat(F.lit("store/"), name).alias("path"), F.floor("o_totalprice").alias("bytes"), F.col("o_orderdate").cast("timestamp").alias("modified"), kind.alias("kind"), "o_orderkey")


FILES = """(SELECT 'store/' || CASE WHEN o_orderstatus = 'P' THEN strftime(o_orderdate, '%Y-%m') || '-individual-pdfs.zip' ELSE o_orderkey || '.pdf' END AS path, CAST(floor(o_totalprice) AS BIGINT) AS bytes,
 o_orderdate AS modified, CASE o_orderstatus WHEN 'P' THEN 'archive' WHEN 'O' THEN 'merged' ELSE 'individual' END AS kind, o_orderkey FROM orders)"""
#: Bytes that all files may have together after the plan's other steps.
FILES_CAP = 400_000_000


@query(f"""WITH f AS (SELECT * FROM {FILES}), h AS (SELECT DISTINCT regexp_extract(path, '[^/]+$') AS archive FROM f WHERE kind = 'archive'),
 g AS (SELECT f.*, CASE WHEN (kind = 'individual' AND modified < TIMESTAMP '2001-06-01' - INTERVAL 56 DAY) OR (kind = 'merged' AND modified < TIMESTAMP '2001-06-01' - INTERVAL 84 DAY)
  THEN strftime(modified, '%Y-%m') || CASE kind WHEN 'merged' THEN '-mega-pdfs.zip' ELSE '-individual-pdfs.zip' END END AS a FROM f),
 p AS (SELECT path, bytes, modified, kind, a AS archive, CASE WHEN a IS NOT NULL AND h.archive IS NOT NULL THEN 'delete' WHEN a IS NOT NULL THEN 'zip' WHEN kind = 'archive' AND modified < TIMESTAMP '1999-06-01' THEN 'delete' ELSE 'keep' END AS action FROM g LEFT JOIN h ON h.archive = g.a),
 w AS (SELECT coalesce(sum(bytes), 0) AS whole FROM p WHERE action <> 'delete'),
 z AS (SELECT path, modified, sum(bytes) OVER (ORDER BY modified, path ROWS UNBOUNDED PRECEDING) - bytes AS before FROM p WHERE kind = 'archive' AND action = 'keep')
 SELECT path, bytes, modified, kind, CASE WHEN kind = 'archive' AND action = 'keep' AND (path, modified) IN (SELECT (path, modified) FROM z, w WHERE whole - before > {FILES_CAP}) THEN 'prune' ELSE action END AS action, archive FROM p""")
def retention_plan(spark, sf):
    files = _files(spark, sf)
    return reports.retention_plan(files, F.lit("2001-06-01 00:00:00").cast("timestamp"), cap=FILES_CAP).withColumn("modified", F.col("modified").cast("timestamp_ntz"))


@query(f"""SELECT o_orderkey, bytes FROM (SELECT o_orderkey, bytes, sum(bytes) OVER () AS whole, sum(bytes) OVER (ORDER BY modified, o_orderkey ROWS UNBOUNDED PRECEDING) AS run FROM {FILES} WHERE kind = 'archive') WHERE whole - (run - bytes) > whole / 2""")
def prune_oldest(spark, sf):
    files = _files(spark, sf).where("kind = 'archive'")
    cap = (files.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]) / 2
    return order.prune_plan(files, [F.col("modified"), F.col("o_orderkey")], "bytes", cap).select("o_orderkey", "bytes")


@query("SELECT diocese, array_to_string(list(DISTINCT display_name ORDER BY display_name), '|') AS names, count(DISTINCT display_name) AS n FROM contacts WHERE display_name IS NOT NULL AND contains(lower(display_name), 'st ') GROUP BY 1")
def directory_list(spark, sf):
    c = table(spark, sf, "contacts").where(F.contains(F.lower("display_name"), F.lit("st ")))
    return c.groupBy("diocese").agg(F.array_join(F.array_sort(F.collect_set("display_name")), "|").alias("names"), F.count_distinct("display_name").alias("n"))


KEYS_SQL = "SELECT DISTINCT lower(trim({1})) AS key FROM {0} WHERE {1} IS NOT NULL"


@query(f"""WITH c AS ({KEYS_SQL.format('contacts', 'key')}), r AS ({KEYS_SQL.format('report_long', 'parish')}), i AS ({KEYS_SQL.format('bulletin_index', 'key')}), a AS (SELECT key FROM c UNION SELECT key FROM r UNION SELECT key FROM i)
 SELECT key, key IN (SELECT key FROM c) AS in_contacts, key IN (SELECT key FROM r) AS in_report, key IN (SELECT key FROM i) AS in_index FROM a""")
def union_status(spark, sf):
    parts = [("in_contacts", "contacts", "key"), ("in_report", "report_long", "parish"), ("in_index", "bulletin_index", "key")]
    rows = None
    for flag, t, c in parts:
        own = table(spark, sf, t).where(F.col(c).isNotNull()).select(norm_key(c).alias("key"), *[F.lit(flag == f).alias(f) for f, _, _ in parts]).distinct()
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("key").agg(*[F.bool_or(f).alias(f) for f, _, _ in parts])


@query(f"""SELECT station, target_date, parish, arg_min(bucket, (CASE bucket WHEN 'downloaded' THEN 0 WHEN 'failed' THEN 1 ELSE 2 END, bucket)) AS bucket FROM {RL} GROUP BY 1, 2, 3""")
def key_status(spark, sf):
    return lookups.status_of_keys(report(spark, sf), ["station", "target_date"], "parish")


@query(f"""WITH r AS (SELECT * FROM {RL}), f AS (SELECT lower(trim(key)) AS key, max(failures) AS failures FROM consecutive_failures GROUP BY 1)
 SELECT r.row_id, r.bucket, r.parish, coalesce(f.failures, 0) AS failures FROM r LEFT JOIN f ON f.key = r.parish WHERE r.bucket IN ('failed', 'html_links')
 AND NOT EXISTS (SELECT 1 FROM r d WHERE d.bucket = 'downloaded' AND d.station = r.station AND d.target_date = r.target_date AND d.parish = r.parish) AND NOT EXISTS (SELECT 1 FROM {DEAD} x WHERE x.key = r.parish)""")
def problem_rows(spark, sf):
    dead = _recipes(spark, sf).where(P.inactive(F.col("skip"), F.col("status")))
    fails = table(spark, sf, "consecutive_failures").select(norm_key("key").alias("key"), "failures")
    out = reports.problem_rows(report(spark, sf), dead, fails, ["station", "target_date"])
    return out.select("row_id", "bucket", "parish", "failures")


PROFILES = "(SELECT hostname AS host, CAST(max(nxdomain_strikes) AS INTEGER) AS max_retries, CAST(count(*) AS INTEGER) AS wait_ms FROM site_health WHERE hostname IS NOT NULL GROUP BY 1)"


@query(f"""WITH u AS (SELECT url, {HOST_SQL} AS h FROM {URLS}), p AS (SELECT * FROM {PROFILES})
 SELECT url, coalesce(CASE WHEN a.host IS NOT NULL THEN a.max_retries WHEN b.host IS NOT NULL THEN b.max_retries ELSE c.max_retries END, 2) AS max_retries,
 coalesce(CASE WHEN a.host IS NOT NULL THEN a.wait_ms WHEN b.host IS NOT NULL THEN b.wait_ms ELSE c.wait_ms END, 500) AS wait_ms
 FROM u LEFT JOIN p a ON a.host = u.h LEFT JOIN p b ON b.host = regexp_replace(u.h, '^www\\.', '') LEFT JOIN p c ON c.host = 'www.' || regexp_replace(u.h, '^www\\.', '')""")
def host_settings(spark, sf):
    p = table(spark, sf, "site_health").where("hostname IS NOT NULL").groupBy(F.col("hostname").alias("host")).agg(F.max("nxdomain_strikes").alias("max_retries"), F.count("*").cast("int").alias("wait_ms"))
    return lookups.host_settings(_urls(spark, sf), p, "url", {"max_retries": 2, "wait_ms": 500})


@query("""WITH c AS (SELECT diocese, key, website, CAST(row_number() OVER (PARTITION BY diocese ORDER BY row_id) AS INTEGER) AS n FROM contacts WHERE website IS NOT NULL)
 SELECT diocese AS file, n AS section, key, 'Section ' || n AS display_name, CASE WHEN n % 2 = 0 THEN 'C' ELSE 'html_link' END AS pattern, CASE WHEN n % 2 = 0 THEN 'pdf' ELSE 'html_link' END AS content_type, website AS example_url, '' AS bulletin_page FROM c""")
def evidence_entries(spark, sf):
    c = table(spark, sf, "contacts").where("website IS NOT NULL").withColumn("n", F.row_number().over(Window.partitionBy("diocese").orderBy("row_id")))
    block = F.format_string("# ——— Section %d ———\n# key: %s\n%s\n• %s\n* %s/again\n", F.col("n"), F.col("key"), F.when(F.col("n") % 2 == 0, "# Pattern C: dated").otherwise("# html_link: page"), F.col("website"), F.col("website"))
    files = c.groupBy(F.col("diocese").alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", block.alias("b")))), lambda x: x["b"]), "\n").alias("value"))
    return sections.source_entries(sections.numbered_lines(files)).drop("all_urls")


@query()
def url_variants(spark, sf):
    return _urls(spark, sf).select("url", Y.rewrite_date_url("url", target()).alias("moved"), Y.url_variants("url", target()).alias("variants"))


@query(f"""SELECT url, regexp_matches(url, '{P.OTHER_WORDS}') AND NOT regexp_matches(url, '{P.EDITION_WORDS}') AS other,
 regexp_matches(lower(trim(url)), '\\.(?:pdf|docx)$') OR regexp_matches(lower(url), '^[^?#]*\\.(?:pdf|docx)(?:[?#]|$)') AS document, regexp_matches(lower(url), 'drive\\.google\\.com.*/folders/|1drv\\.ms') AS folder FROM {URLS}""")
def url_classes(spark, sf):
    u = F.col("url")
    return _urls(spark, sf).select("url", P.other_document(u).alias("other"), P.document_link(u).alias("document"), P.cloud_folder(u).alias("folder"))


@query(f"""SELECT key, length(key) < 4 OR regexp_matches(key, '^[0-9]{{6,8}}(-pdf)?$|^[0-9]{{2}}\\.[0-9]{{2}}\\.[0-9]{{2}}(-pdf)?$') OR (key LIKE '%-pdf' AND regexp_matches(key, '[0-9]{{5,}}')) AS junk, count(*) AS n FROM (SELECT key FROM {FR} WHERE key IS NOT NULL) GROUP BY 1, 2""")
def junk_keys(spark, sf):
    return results(spark, sf).where("key IS NOT NULL").groupBy("key", P.junk_key(F.col("key")).alias("junk")).agg(F.count("*").alias("n"))


_JSON_FIELDS = ("parish", "display_name", "url", "file", "file_type", "error", "reason", "retry_strategy")
_JSON_ROW = "'{' || concat_ws(',', " + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN '\"{c}\":' || CAST(to_json({c}) AS VARCHAR) END" for c in _JSON_FIELDS) + ") || '}'"


@query(f"""SELECT station, target_date, '{{"summary":{{' || {" || ',' || ".join(f"'{chr(34)}{b}{chr(34)}:' || count(*) FILTER (bucket = '{b}')" for b in P.BUCKETS)} || '}}' ||
 {" || ".join(f"',{chr(34)}{b}{chr(34)}:[' || coalesce(string_agg({_JSON_ROW}, ',' ORDER BY row_id) FILTER (bucket = '{b}'), '') || ']'" for b in P.BUCKETS)} || '}}' AS json FROM {RL} GROUP BY 1, 2""")
def report_json(spark, sf):
    return writers.report_json(report(spark, sf), ["station", "target_date"])


_EVENT = """'BEGIN:VEVENT' || n || 'UID:' || key || '-' || d || '-mass-' || row_id || '@almanac' || n || 'DTSTAMP:20260201T000000Z' || n || 'DTSTART:' || strftime(edition, '%Y%m%d') || 'T093000' || n || 'SUMMARY:Mass\\, ' || row_id || n || 'CATEGORIES:MASS' || n || 'END:VEVENT'"""
_TITLE = "array_to_string(list_transform(string_split(replace(g, '_', ' '), ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"


@query(f"""WITH e AS (SELECT station, lower(trim(key)) AS key, row_id, edition, strftime(edition, '%Y-%m-%d') AS d, chr(13) || chr(10) AS n FROM bulletin_index WHERE edition IS NOT NULL),
 b AS (SELECT station AS g, key, row_id, {_EVENT} AS text FROM e UNION ALL SELECT 'all', key, row_id, {_EVENT} FROM e), g AS (SELECT DISTINCT g FROM b)
 SELECT g AS "group", 1 AS place, key, row_id AS seq, text FROM b
 UNION ALL SELECT g, 0, NULL, NULL, array_to_string(['BEGIN:VCALENDAR', 'VERSION:2.0', 'PRODID:-//almanac//' || g || '//EN', 'X-WR-CALNAME:' || {_TITLE} || ' Events', 'CALSCALE:GREGORIAN', 'METHOD:PUBLISH'], chr(13) || chr(10)) FROM g
 UNION ALL SELECT g, 2, NULL, NULL, 'END:VCALENDAR' FROM g""")
def event_calendars(spark, sf):
    e = table(spark, sf, "bulletin_index").where("edition IS NOT NULL").select(
        F.col("station").alias("group"), norm_key("key").alias("key"), F.col("row_id").alias("seq"), F.format_string("Mass, %d", "row_id").alias("title"), F.col("edition").cast("string").alias("date_iso"),
        F.lit("9:30").alias("time_24h_or_null"), F.lit(None).cast("string").alias("location_or_null"), F.lit("").alias("description"), F.lit("mass").alias("category"),
    )
    return writers.calendars(e, as_of())


@query(f"""WITH g AS (SELECT diocese, count(*) FILTER (bucket = 'downloaded') AS d, count(*) FILTER (bucket = 'failed') AS f FROM {RL} r JOIN {CONTACTS_SQL} c USING (parish) GROUP BY diocese),
 t AS (SELECT diocese AS name, {_TITLE} AS title, 'https://feeds.example/' || diocese || '.pdf' AS link, printf('%.1f%%', CASE WHEN d + f > 0 THEN d / (d + f) * 100 ELSE 0.0 END) AS rate, 'Sun, 01 Feb 2026 00:00:00 +0000' AS stamp FROM (SELECT *, diocese AS g FROM g))
 SELECT name, '<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<rss version="2.0"><channel><title>' || title || ' Bulletins</title><link>' || link || '</link><description>Latest bulletin feed for ' || title || '</description><lastBuildDate>' || stamp
 || '</lastBuildDate><item><title>' || title || ' bulletin for {TARGET}</title><link>' || link || '</link><guid>' || link || '#{TARGET}</guid><pubDate>' || stamp || '</pubDate><description>Latest edition (' || rate || ' success rate)</description></item></channel></rss>' AS xml FROM t""")
def rss_feeds(spark, sf):
    g = group_success_rate(spark, sf)
    return writers.rss(g.select(F.col("diocese").alias("name"), X.display_name(F.col("diocese")).alias("title"), F.concat(F.lit("https://feeds.example/"), "diocese", F.lit(".pdf")).alias("link"), target().alias("day"), F.format_string("%.1f%%", "rate").alias("rate")), as_of())


def _key_results(spark, sf) -> DataFrame:
    action = F.when(F.col("status") == "ok", "download").when(F.col("status") == "html_link", "html").when(F.col("status") == "skipped", "goto").otherwise("click")
    return results(spark, sf).where("key IS NOT NULL").withColumn("action", action)


def _as_recipes(r: DataFrame, *by: str) -> DataFrame:
    step = F.struct("result_id", F.struct("action", "url", F.lit(None).cast("string").alias("selector"), F.col("display_name").alias("text")).alias("s"))
    g = r.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(step)), lambda x: x["s"]).alias("steps"), F.min_by("url", "result_id").alias("start_url"))
    return g.withColumn("status", F.lit("active"))


def _recorded(spark, sf) -> DataFrame:
    """A recipe per source and run: all that its results of that run did, as steps."""
    return _as_recipes(_key_results(spark, sf), "key", "run_id")


STEPS = f"""(SELECT key, run_id, result_id, url, display_name, CASE status WHEN 'ok' THEN 'download' WHEN 'html_link' THEN 'html' WHEN 'skipped' THEN 'goto' ELSE 'click' END AS a FROM {FR} WHERE key IS NOT NULL)"""
CLOUD_SQL = "coalesce(bool_or(regexp_matches(lower(url), 'drive\\.google\\.com.*/folders/|1drv\\.ms')), false)"


@query(f"""SELECT key, run_id, CAST(count(*) AS INTEGER) AS n_steps, CAST(count(*) FILTER (a = 'click') AS INTEGER) AS clicks, bool_or(a = 'download') AS downloads, bool_or(a = 'html') AS captures, {CLOUD_SQL} AS cloud,
 string_agg(a, '>' ORDER BY result_id) AS flow FROM {STEPS} GROUP BY key, run_id""")
def recipe_fingerprints(spark, sf):
    return recipes.fingerprints(_recorded(spark, sf), ["key", "run_id"])


@query()
def recipe_standalone(spark, sf):
    return recipes.redated(recipes.standalone(_recorded(spark, sf)), target())


@query(f"""WITH h AS (SELECT key, max(nxdomain_strikes) AS strikes, arg_max(last_result, row_id) AS last_result FROM site_health GROUP BY 1), k AS (SELECT DISTINCT key FROM {FR} WHERE key IS NOT NULL)
 SELECT key, 'dead_url' AS status, 'host unknown' AS reason FROM k WHERE key IN (SELECT key FROM h WHERE strikes >= 2 AND last_result = 'nxdomain')""")
def dead_recipes(spark, sf):
    h = table(spark, sf, "site_health").groupBy("key").agg(F.max("nxdomain_strikes").alias("strikes"), F.max_by("last_result", "row_id").alias("last_result"))
    return recipes.dead_sources(_recorded(spark, sf).dropDuplicates(["key"]), h)


_NORMAL = "regexp_replace({h}, '^www\\d*\\.', '') || lower(regexp_replace(regexp_extract(replace(trim(url), ' ', '%20'), '^[^:]+://[^/?#]+([^?#]*)', 1), '/+$', ''))".format(h=HOST_SQL)
_SITE = f"regexp_replace({HOST_SQL}, '^www\\d*\\.', '')"


@query(f"""WITH r AS (SELECT lower(trim(key)) AS key, website AS url FROM contacts WHERE website IS NOT NULL), n AS (SELECT {_NORMAL} AS n, min(key) AS k FROM r GROUP BY 1),
 s AS (SELECT {_SITE} AS s, min(key) AS k FROM r GROUP BY 1 HAVING count(DISTINCT key) = 1)
 SELECT u.url, coalesce(n.k, s.k, split_part(u.s, '.', 1)) AS source FROM (SELECT url, {_NORMAL} AS n, {_SITE} AS s FROM {URLS}) u LEFT JOIN n ON n.n = u.n LEFT JOIN s ON s.s = u.s""")
def registry_keys(spark, sf):
    reg = table(spark, sf, "contacts").where("website IS NOT NULL").select(norm_key("key").alias("key"), F.col("website").alias("url"))
    return recipes.registry_keys(_urls(spark, sf), reg, ["social.example"])


@query(f"""WITH g AS (SELECT lower(trim(parish)) AS key, CAST(ceil(max(n_chars) / 3000.0) AS INTEGER) AS n_pages FROM documents WHERE parish IS NOT NULL GROUP BY 1)
 SELECT f.result_id, f.key, lower(f.display_name) AS sort_name, n_pages FROM {FR} f LEFT JOIN g ON g.key = f.key WHERE status = 'ok' AND NOT coalesce(is_fallback, false) AND NOT coalesce(is_stale, false) AND coalesce(n_pages, 1) <= 4
 AND NOT EXISTS (SELECT 1 FROM {DEAD} x WHERE x.key = f.key)""")
def stitch_plan(spark, sf):
    dead = _recipes(spark, sf).where(P.inactive(F.col("skip"), F.col("status"))).select("key")
    pages = table(spark, sf, "documents").where("parish IS NOT NULL").groupBy(norm_key("parish").alias("key")).agg(F.ceil(F.max("n_chars") / 3000).cast("int").alias("n_pages"))
    plan = recipes.stitch_plan(results(spark, sf).join(pages, "key", "left"), dead)
    return plan.select("result_id", "key", "sort_name", "n_pages")


@query("""SELECT source, CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month, count(*) AS files, CAST(sum(n) AS BIGINT) AS chars FROM
 (SELECT source, CAST(collected_at AT TIME ZONE 'UTC' AS DATE) AS d, coalesce(n_chars, 0) AS n FROM documents) GROUP BY 1, 2, 3""")
def files_by_month(spark, sf):
    d = utc_date(F.col("collected_at"))
    return table(spark, sf, "documents").groupBy("source", F.year(d).alias("year"), F.month(d).alias("month")).agg(F.count("*").alias("files"), F.sum(F.coalesce("n_chars", F.lit(0))).alias("chars"))


@query(f"""WITH d AS (SELECT page, idx, CASE WHEN full_date THEN try_strptime(CAST(score AS VARCHAR), '%Y%m%d')::DATE END AS day FROM {DATED}),
 g AS (SELECT page, min(idx) FILTER (abs(day - {_T}) <= 7) AS near, min(idx) AS first, arg_min(day IS NOT NULL, idx) AS dated FROM d GROUP BY 1)
 SELECT page, coalesce(near, CASE WHEN dated THEN first END) AS idx FROM g WHERE coalesce(near, CASE WHEN dated THEN first END) IS NOT NULL""")
def this_week_link(spark, sf):
    return ranking.this_week(_links(spark, sf), target())


@query(f"""SELECT result_id, status, is_stale, stale_reason FROM (SELECT result_id, CASE WHEN s THEN 'error' ELSE status END AS status, CASE WHEN s THEN true ELSE is_stale END AS is_stale,
 CASE WHEN s THEN CASE WHEN d > DATE '{TARGET}' THEN 'date_ahead_of_target' ELSE 'date_behind_of_target' END ELSE stale_reason END AS stale_reason FROM
 (SELECT *, coalesce(status = 'ok' AND NOT coalesce(is_stale, false) AND length(url) > 0 AND d IS NOT NULL AND NOT (d BETWEEN DATE '{TARGET}' - 6 AND DATE '{TARGET}') AND abs(d - DATE '{TARGET}') > 8, false) AS s
 FROM (SELECT *, {BULLETIN_SQL} AS d FROM {FR})))""")
def freshness_gate(spark, sf):
    out, _ = reports.freshness_gate(results(spark, sf), target(), _entries(spark, sf))
    return out.select("result_id", "status", "is_stale", "stale_reason")


@query(f"""SELECT f.key, display_name, url, d AS "date", CASE WHEN d > {_T} THEN 'date_ahead_of_target' ELSE 'date_behind_of_target' END AS reason, {STRATEGY_SQL} AS strategy, coalesce(bulletin_page, '') AS bulletin_page
 FROM (SELECT *, {BULLETIN_SQL} AS d FROM {FR}) f LEFT JOIN {ENTRIES_SQL} e ON e.key = f.key WHERE status = 'ok' AND NOT coalesce(is_stale, false) AND length(url) > 0 AND NOT (d BETWEEN {_T} - 6 AND {_T}) AND abs(d - {_T}) > 8""")
def freshness_retries(spark, sf):
    return reports.freshness_gate(results(spark, sf), target(), _entries(spark, sf))[1]


def _sundays_sql() -> str:
    row = lambda day, name, rank: f"SELECT y, {day} AS day, {name} AS name, {rank} AS r FROM y"
    parts = [row("epiphany", "'Epiphany_of_the_Lord'", 1), row("epiphany + 7", "'Baptism_of_the_Lord'", 2)]
    parts += [row(f"easter + ({o})", f"'{n}'", 4) for o, n in calendar.FROM_EASTER] + [row("easter", "'Easter_Sunday_' || y", 4)]
    parts += [row(f"advent + ({o})", f"'{n}'", 6) for o, n in calendar.FROM_ADVENT]
    parts += [row("CASE WHEN extract(dow FROM make_date(y, 11, 1)) = 0 THEN make_date(y, 11, 1) END", "'All_Saints_Day'", 5), row("make_date(y, 12, 25)", "'Christmas_Day'", 7)]
    parts.append(row("CASE WHEN year(family) = y THEN family ELSE make_date(y, 12, 30) END", "'The_Holy_Family'", 8))
    end = "CASE WHEN w % 100 BETWEEN 11 AND 13 THEN 'th' WHEN w % 10 = 1 THEN 'st' WHEN w % 10 = 2 THEN 'nd' WHEN w % 10 = 3 THEN 'rd' ELSE 'th' END"
    name = f"CASE WHEN w = 6 THEN '{calendar.SIXTH}' ELSE w || {end} || '{calendar.ORDINARY}' END"
    parts.append(f"SELECT y, day, {name}, 3 FROM (SELECT y, epiphany + 14 + 7 * CAST(i AS INTEGER) AS day, i + 2 AS w, easter - 42 AS stop FROM y, range(20) r(i)) WHERE day < stop")
    parts.append(f"SELECT y, day, {name}, 0 FROM (SELECT y, easter + 70 + 7 * CAST(i AS INTEGER) AS day, advent - 7 AS stop, {calendar.LAST_WEEK + 1} - CAST(ceil((advent - 7 - (easter + 70)) / 7.0) AS INTEGER) + i AS w FROM y, range(40) r(i)) WHERE day < stop")
    sunday = lambda m, d: f"CAST(make_date(y, {m}, {d}) + CAST((7 - extract(dow FROM make_date(y, {m}, {d}))) % 7 AS INTEGER) AS DATE)"
    return f"""WITH y0 AS (SELECT DISTINCT CAST(year(target_date) AS BIGINT) AS y FROM report_long WHERE target_date IS NOT NULL), a AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y0),
 h AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM a), k AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS k FROM h),
 n AS (SELECT *, h + k - 7 * ((a + 11 * h + 22 * k) // 451) + 114 AS n FROM k),
 y AS (SELECT CAST(y AS INTEGER) AS y, make_date(y, n // 31, n % 31 + 1) AS easter, {sunday(1, 2)} AS epiphany, {sunday(11, 27)} AS advent, {sunday(12, 26)} AS family FROM n),
 e AS ({' UNION ALL '.join(parts)}) SELECT y AS year, CAST(day AS DATE) AS day, arg_max(name, r) AS name FROM e WHERE day IS NOT NULL GROUP BY 1, 2"""


@query(_sundays_sql())
def named_sundays(spark, sf):
    return calendar.named_sundays(table(spark, sf, "report_long").select(F.year("target_date").alias("year")))


@query(f"""SELECT station, target_date, row_id, parish, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY station, target_date ORDER BY row_id) AS INTEGER) AS place FROM {RL} WHERE bucket = 'failed') WHERE place <= 5""")
def first_failures(spark, sf):
    return reports.first_failures(report(spark, sf), ["station", "target_date"], "row_id").select("station", "target_date", "row_id", "parish", "place")


@query("""WITH k AS (SELECT DISTINCT diocese, lower(trim(key)) AS key FROM contacts), b AS (SELECT lower(trim(key)) AS key, max(failures) >= 2 AS b FROM consecutive_failures GROUP BY 1),
 o AS (SELECT lower(trim(key)) AS key, bool_or(list_name = 'stale') AS s, bool_or(list_name = 'unknown_date') AS u FROM stale_bulletins GROUP BY 1)
 SELECT diocese, count(*) AS sources, count(*) FILTER (b) AS broken, count(*) FILTER (s) AS stale, count(*) FILTER (u) AS unknown_date FROM k LEFT JOIN b ON b.key = k.key LEFT JOIN o ON o.key = k.key GROUP BY 1""")
def problem_counts(spark, sf):
    keyed = lambda t: table(spark, sf, t).withColumn("key", norm_key("key"))
    return reports.problem_counts(keyed("contacts").select("diocese", "key"), keyed("consecutive_failures"), keyed("stale_bulletins"), ["diocese"])


@query(f"SELECT key, error, min(result_id) AS result_id FROM {FR} WHERE error IS NOT NULL GROUP BY 1, 2")
def distinct_errors(spark, sf):
    return order.ordered_distinct(results(spark, sf), ["key"], "error", "result_id")


def _trimmed(c: str) -> str:
    return f"nullif(trim({c}), '')"


@query(f"SELECT result_id, coalesce({_trimmed('error')}, {_trimmed('stale_reason')}, {_trimmed('retry_strategy')}, {_trimmed('status')}) AS answer FROM {FR}")
def first_answer(spark, sf):
    return results(spark, sf).select("result_id", P.first_text(*[F.col(c) for c in ("error", "stale_reason", "retry_strategy", "status")]).alias("answer"))


@query("""WITH m AS (SELECT lower(trim(key)) AS key, arg_max(station, row_id) AS g FROM site_health WHERE key IS NOT NULL AND status = 'inactive_candidate' GROUP BY 1)
 SELECT row_id, coalesce(g, diocese) AS diocese FROM contacts c LEFT JOIN m ON m.key = c.key""")
def regrouped_sources(spark, sf):
    moves = table(spark, sf, "site_health").where("key IS NOT NULL AND status = 'inactive_candidate'").select(norm_key("key").alias("key"), F.col("station").alias("diocese"), F.col("row_id").alias("seq"))
    return recipes.regrouped(table(spark, sf, "contacts").select("row_id", "key", "diocese"), moves, group="diocese").select("row_id", "diocese")


@query("""SELECT row_id, path, CASE WHEN regexp_matches(path, '^[^/_][^/]*\\.json$') THEN 'unknown/' || path ELSE path END AS new_path FROM
 (SELECT row_id, CASE WHEN removed_on IS NOT NULL THEN '_' || key WHEN facebook IS NULL THEN key ELSE diocese || '/' || key END || '.json' AS path FROM contacts)""")
def recipe_layout(spark, sf):
    path = F.concat(F.when(F.col("removed_on").isNotNull(), F.concat(F.lit("_"), "key")).when(F.col("facebook").isNull(), F.col("key")).otherwise(F.concat("diocese", F.lit("/"), "key")), F.lit(".json"))
    return table(spark, sf, "contacts").select("row_id", path.alias("path")).withColumn("new_path", recipes.laid_out(F.col("path")))


FOLDED_SQL = f"translate(lower(display_name), '{X.MARKED}', '{X.PLAIN}')"
_SLUG_SQL = "regexp_replace(regexp_replace({0}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"""SELECT display_name, {_SLUG_SQL.format(FOLDED_SQL)} AS page, left({_SLUG_SQL.format(FOLDED_SQL)}, 40) AS short, coalesce(nullif({_SLUG_SQL.format('lower(display_name)')}, ''), 'source') AS plain
 FROM (SELECT DISTINCT display_name FROM contacts WHERE display_name IS NOT NULL)""")
def slugs(spark, sf):
    n = F.col("display_name")
    d = table(spark, sf, "contacts").where("display_name IS NOT NULL").select("display_name").distinct()
    return d.select("display_name", X.page_slug(n).alias("page"), X.slug(n).alias("short"), X.plain_slug(n, "source").alias("plain"))


@query("""SELECT 'all' AS file, CAST(row_number() OVER (ORDER BY row_id) AS INTEGER) AS section, display_name AS name, key, website AS page_url, CASE WHEN facebook IS NULL THEN '' ELSE facebook || '|' || facebook || '/again' END AS urls, removed_on IS NOT NULL AS disabled
 FROM contacts WHERE display_name IS NOT NULL AND trim(display_name) = display_name AND regexp_matches(display_name, '^[A-Za-z ]+$') AND key IS NOT NULL""")
def declared_sections(spark, sf):
    c = table(spark, sf, "contacts").where("display_name IS NOT NULL AND trim(display_name) = display_name AND key IS NOT NULL").where(F.col("display_name").rlike("^[A-Za-z ]+$"))
    block = F.concat_ws(
        "\n", F.concat(F.lit("# --- "), "display_name", F.lit(" ---")), F.when(F.col("removed_on").isNotNull(), "# DISABLED by hand"), F.concat(F.lit("# key: "), "key"), F.concat(F.lit("# page: "), "website"), F.col("facebook"),
        F.concat("facebook", F.lit("/again")),
    )
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_id", block.alias("b")))), lambda x: x["b"]), "\n\n")
    lines = sections.numbered_lines(c.agg(text.alias("value")).withColumn("file", F.lit("all")))
    return sections.declared_sections(lines).withColumn("urls", F.array_join("urls", "|"))


@query()
def linkified_documents(spark, sf):
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    return d.select("doc_id", X.linkified(F.col("text")).alias("html"))


@query()
def rendered_documents(spark, sf):
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    return d.select("doc_id", X.rendered(F.col("text")).alias("html"))


@query()
def calculated_urls(spark, sf):
    return results(spark, sf).where("url IS NOT NULL").select("key", "url").distinct().join(_entries(spark, sf), "key", "left").select("key", "url", Y.calculated_url(F.coalesce("pattern", F.lit("A")), F.col("url"), target()).alias("new_url"))


@query()
def docx_variants(spark, sf):
    return _urls(spark, sf).where(F.lower("url").contains(".docx")).select("url", Y.docx_variants("url", target()).alias("variants"))
