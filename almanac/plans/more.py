"""Further queries over the test tables: functions and operators that the main catalog does not reach, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almanac.functions import arrays as A
from almanac.functions import dates as D
from almanac.functions import predicates as P
from almanac.functions import text as X
from almanac.functions import urls as U
from almanac.operators import lookups, order, ranking, recipes, sections, state
from almanac.plans.catalog import _P, CF_LAST, DEAD, FR, HOST_SQL, LINKS, SLUG_SQL, TARGET, URLS, _links, _recipes, _rx, results, target
from almanac.session import norm_key, table, utc_date
from almanac.sinks import writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("""SELECT row_id, CASE WHEN regexp_matches(d, '^\\d{4}-\\d{2}-\\d{2}$') THEN strftime(target_date, '%d-%m-%Y') ELSE d END AS shaped, CASE WHEN target_date IS NOT NULL THEN strftime(target_date, '%d-%m-%Y') ELSE d END AS checked,
 strftime(target_date, '%-d %B %Y') AS long, row_id || CASE WHEN row_id % 100 BETWEEN 11 AND 13 THEN 'th' WHEN row_id % 10 = 1 THEN 'st' WHEN row_id % 10 = 2 THEN 'nd' WHEN row_id % 10 = 3 THEN 'rd' ELSE 'th' END AS nth,
 CASE WHEN m > 0 THEN m || ' minute' || CASE WHEN m = 1 THEN '' ELSE 's' END || CASE WHEN s > 0 THEN ' ' || s || ' second' || CASE WHEN s = 1 THEN '' ELSE 's' END ELSE '' END ELSE s || ' second' || CASE WHEN s = 1 THEN '' ELSE 's' END END AS took,
 strftime(target_date, '%y.%m.%d') AS dotted, target_date AS back FROM (SELECT *, strftime(target_date, '%Y-%m-%d') AS d, row_id % 7200 // 60 AS m, row_id % 60 AS s FROM report_long WHERE target_date IS NOT NULL)""")
def date_texts(spark, sf):
    t = F.col("target_date")
    d = t.cast("string")
    return table(spark, sf, "report_long").where("target_date IS NOT NULL").select(
        "row_id", D.day_month_year(d).alias("shaped"), D.day_month_year_checked(d).alias("checked"), D.long_date(t).alias("long"), D.ordinal(F.col("row_id")).alias("nth"), D.duration(F.col("row_id") % 7200).alias("took"),
        D.dotted(t).alias("dotted"), D.dotted_date(D.dotted(t)).alias("back"),
    )


@query("""SELECT doc_id, source = 'bulletin_ocr' AND octet_length(encode('%PDF' || text)) >= 2000 AS pdf FROM documents WHERE text IS NOT NULL AND source IS NOT NULL""")
def pdf_files(spark, sf):
    content = F.encode(F.concat(F.when(F.col("source") == "bulletin_ocr", "%PDF").otherwise("PK"), "text"), "UTF-8")
    return table(spark, sf, "documents").where("text IS NOT NULL AND source IS NOT NULL").select("doc_id", P.pdf_bytes(content, 2000).alias("pdf"))


@query(f"""SELECT page, count(*) AS links, count(*) >= 8 AND regexp_matches(max(href), '(?i)bulletin|newsletter|news|publication|download') AS listing FROM {LINKS} GROUP BY 1""")
def listing_pages(spark, sf):
    g = _links(spark, sf).groupBy("page").agg(F.count("*").alias("links"), F.max("href").alias("_u"))
    return g.select("page", "links", P.listing_page(F.col("_u"), F.col("links")).alias("listing"))


@query(f"""SELECT result_id, CASE WHEN regexp_matches(url, '(?i)^https?://') THEN CASE WHEN k = '' THEN 'download' WHEN k IN ('download', 'html', 'image') THEN k WHEN regexp_matches(p, '\\.(?:jpe?g|png|webp)$') THEN 'image' WHEN regexp_matches(p, '\\.(?:pdf|docx)$') THEN 'download' ELSE 'html' END END AS kind
 FROM (SELECT result_id, url, lower(trim(coalesce(file_type, ''))) AS k, lower(split_part(url, '?', 1)) AS p FROM {FR})""")
def override_types(spark, sf):
    return results(spark, sf).select("result_id", P.override_type(F.col("url"), F.col("file_type")).alias("kind"))


@query(f"""SELECT row_id, CASE WHEN x.key IS NOT NULL THEN 'disabled' WHEN facebook IS NOT NULL THEN 'override' WHEN f >= 3 THEN 'dead' WHEN f = 0 THEN 'ok' WHEN f IS NULL THEN 'none' ELSE 'unchecked' END AS dot, coalesce(f >= 3, false) AS broken
 FROM contacts c LEFT JOIN {DEAD} x ON x.key = lower(trim(c.key)) LEFT JOIN {CF_LAST} l ON l.key = lower(trim(c.key))""")
def status_dots(spark, sf):
    dead = _recipes(spark, sf).where(P.inactive(F.col("skip"), F.col("status"))).select(F.col("key").alias("_d"))
    last = order.latest(table(spark, sf, "consecutive_failures").select(norm_key("key").alias("_c"), "failures", "as_of", "row_id"), ["_c"], ["as_of", "row_id"], ["failures"])
    c = table(spark, sf, "contacts").withColumn("_k", norm_key("key"))
    j = c.join(dead, c["_k"] == dead["_d"], "left").join(last, c["_k"] == last["_c"], "left")
    f = F.col("failures")
    recipe = F.when(f >= 3, "dead").when(f == 0, "ok").when(f.isNull(), "none").otherwise("other")
    return j.select("row_id", P.status_dot(F.col("_d").isNotNull(), F.col("facebook").isNotNull(), recipe).alias("dot"), F.coalesce(f >= 3, F.lit(False)).alias("broken"))


@query("""SELECT row_id, diocese FROM contacts WHERE contains(lower(display_name), 'st') OR contains(lower(trim(key)), 'st')""")
def directory_search(spark, sf):
    hit = F.lower("display_name").contains("st") | norm_key("key").contains("st")
    return table(spark, sf, "contacts").where(hit).select("row_id", "diocese")


@query("""SELECT diocese, row_id, CAST(row_number() OVER (PARTITION BY diocese ORDER BY lower(display_name), row_id) AS INTEGER) AS place FROM contacts WHERE display_name IS NOT NULL""")
def directory_order(spark, sf):
    c = table(spark, sf, "contacts").where("display_name IS NOT NULL").select("diocese", "row_id", F.lower("display_name").alias("_n"))
    ranked = order.first_rows(c, ["diocese"], [F.col("_n"), F.col("row_id")], 1 << 30)
    return ranked.select("diocese", "row_id", F.row_number().over(Window.partitionBy("diocese").orderBy("_n", "row_id")).alias("place"))


@query(f"""WITH p AS (SELECT file_type AS page_type, CASE WHEN is_fallback THEN 'fallback' ELSE 'direct' END AS flow FROM {FR} WHERE file_type IS NOT NULL GROUP BY 1, 2),
 l AS (SELECT file_type AS page_type, status || '/' || coalesce(retry_strategy, '') AS id, CASE WHEN status = 'ok' THEN 'site' ELSE 'pattern' END AS kind, CASE WHEN bool_or(coalesce(is_fallback, false)) THEN 'fallback' ELSE 'direct' END AS flow, count(*) AS n FROM {FR} WHERE status IS NOT NULL AND file_type IS NOT NULL GROUP BY 1, 2, 3),
 s AS (SELECT p.page_type, p.flow, id, CASE WHEN kind = 'site' THEN 50 + CASE WHEN l.flow = p.flow THEN 20 ELSE 0 END ELSE 40 + least(10, n) END AS score FROM p JOIN l USING (page_type))
 SELECT page_type, flow, id, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY page_type, flow ORDER BY score DESC, id) AS rn FROM s) WHERE rn <= 5""")
def similar_patterns(spark, sf):
    r = results(spark, sf).where("file_type IS NOT NULL").withColumn("page_type", F.col("file_type"))
    pattern = r.select("page_type", F.when(F.col("is_fallback"), "fallback").otherwise("direct").alias("flow")).distinct()
    lib = r.where("status IS NOT NULL").groupBy("page_type", F.concat("status", F.lit("/"), F.coalesce("retry_strategy", F.lit(""))).alias("id"), F.when(F.col("status") == "ok", "site").otherwise("pattern").alias("kind")).agg(
        F.when(F.bool_or(F.coalesce("is_fallback", F.lit(False))), "fallback").otherwise("direct").alias("flow"), F.count("*").alias("success_count")
    )
    return lookups.similar_patterns(pattern, lib).select("page_type", "flow", "id", F.col("score").cast("long").alias("score"))


@query(f"""WITH c AS (SELECT lower(trim(key)) AS key, row_id AS seq, website FROM contacts WHERE key IS NOT NULL)
 SELECT key, arg_min(website, seq) FILTER (true) AS website, min(seq) AS seq FROM (SELECT key, seq, coalesce(website, '') AS website FROM c) WHERE key NOT IN (SELECT key FROM {FR} WHERE status = 'ok' AND key IS NOT NULL) GROUP BY 1""")
def seeds(spark, sf):
    c = table(spark, sf, "contacts").where("key IS NOT NULL").select(norm_key("key").alias("key"), F.col("row_id").alias("seq"), F.coalesce("website", F.lit("")).alias("website"))
    known = results(spark, sf).where("status = 'ok' AND key IS NOT NULL").select("key")
    out = recipes.seeds(c.withColumn("at", F.col("seq")), known)
    return out.select("key", "website", F.col("at").alias("seq"))


@query(f"""WITH s AS (SELECT key, run_id, arg_max(url, result_id) FILTER (status IN ('ok', 'html_link') AND regexp_matches(url, '(?i)^https?://')) AS last, arg_min(url, result_id) FILTER (true) AS first FROM {FR} WHERE key IS NOT NULL GROUP BY 1, 2),
 o AS (SELECT lower(trim(key)) AS key, max(facebook) AS o FROM contacts GROUP BY 1)
 SELECT s.key, run_id, coalesce(nullif(trim(o), ''), last, nullif(trim(first), '')) AS start FROM s LEFT JOIN o ON o.key = s.key""")
def effective_starts(spark, sf):
    action = F.when(F.col("status") == "ok", "download").when(F.col("status") == "html_link", "html").otherwise("click")
    step = F.struct("result_id", F.struct(action.alias("action"), "url").alias("s"))
    g = results(spark, sf).where("key IS NOT NULL").groupBy("key", "run_id").agg(F.transform(F.array_sort(F.collect_list(step)), lambda x: x["s"]).alias("steps"), F.min_by("url", F.when(F.col("url").isNotNull(), F.col("result_id"))).alias("start_url"))
    o = table(spark, sf, "contacts").groupBy(norm_key("key").alias("key")).agg(F.max("facebook").alias("override_url"))
    return g.join(o, "key", "left").select("key", "run_id", recipes.effective_start().alias("start"))


@query(f"""WITH a AS (SELECT run_id, key, list(CASE status WHEN 'ok' THEN 'download' WHEN 'html_link' THEN 'html' ELSE 'click' END ORDER BY result_id) AS a FROM {FR} WHERE key IS NOT NULL GROUP BY 1, 2)
 SELECT run_id, key, array_to_string(list_filter(a, lambda x, i: x NOT IN ('download', 'html') OR len(list_filter(a[i + 1:], lambda y: y IN ('download', 'html'))) = 0), '>') AS steps FROM a""")
def last_terminal(spark, sf):
    action = F.when(F.col("status") == "ok", "download").when(F.col("status") == "html_link", "html").otherwise("click")
    g = results(spark, sf).where("key IS NOT NULL").groupBy("run_id", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("result_id", action.alias("a")))), lambda x: x["a"]).alias("a"))
    return g.select("run_id", "key", F.array_join(A.last_terminal_only(F.col("a")), ">").alias("steps"))


@query(f"""SELECT key, coalesce(min(result_id) FILTER (floor(epoch(fetched_at)) >= epoch(TIMESTAMPTZ '{TARGET} 00:00:00+00:00') - 10), min(result_id)) AS result_id FROM {FR} GROUP BY 1""")
def first_after(spark, sf):
    return ranking.first_after(results(spark, sf), ["key"], "fetched_at", F.lit(TARGET + " 00:00:00+00:00").cast("timestamp"), "result_id")


@query("""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS rn FROM documents WHERE text IS NOT NULL) WHERE rn <= 30""")
def longest_documents(spark, sf):
    return order.longest(table(spark, sf, "documents").where("text IS NOT NULL"), ["source"], "text", "doc_id").select("source", "doc_id")


@query(f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\\r\\n|\\n|\\r'), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL)
 SELECT doc_id, CASE WHEN len(l) = 3 THEN array_to_string(list_transform(l, lambda x: CASE WHEN left(x, 1) IN ('-', '*', '•') THEN trim(substr(x, 2), ' ') ELSE x END), '|') END AS bullets FROM l""")
def three_bullets(spark, sf):
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.array_join(A.bullets(F.col("text")), "|").alias("bullets"))


@query(f"""SELECT doc_id, array_to_string(list_slice(list_filter([{", ".join(f"'{w}'" for w in A.SOCIAL)}], lambda w: contains(lower(left(text, 12000)), w)), 1, 8), '|') AS words FROM documents WHERE text IS NOT NULL""")
def social_words(spark, sf):
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.array_join(A.keyword_hits(F.col("text")), "|").alias("words"))


@query(f"""SELECT row_id, coalesce(c, 2) AS retries, coalesce(try_cast(days_old AS INTEGER), 7) AS days, CASE WHEN days_old IS NULL THEN 15000 ELSE least(greatest(days_old * 100, 1000), 120000) END AS timeout, greatest(0, coalesce(days_old, 0)) AS counted
 FROM (SELECT s.*, CASE WHEN reason IS NULL THEN NULL ELSE length(reason) END AS c FROM stale_bulletins s)""")
def settings_over_defaults(spark, sf):
    own = F.when(F.col("reason").isNotNull(), F.create_map(F.lit("retries"), F.length("reason").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    m = A.overlay_defaults(F.create_map(F.lit("retries"), F.lit("2"), F.lit("days"), F.lit("7")), own)
    days = F.col("days_old").cast("string")
    return table(spark, sf, "stale_bulletins").select(
        "row_id", m["retries"].cast("int").alias("retries"), A.first_int(days, m["days"]).alias("days"), A.step_timeout((F.col("days_old") * 100).cast("string"), F.lit(None).cast("string")).alias("timeout"), A.clamped_int(days).alias("counted"),
    )


@query(f"""WITH k AS (SELECT key, list_distinct(list(status ORDER BY status)) AS s FROM (SELECT DISTINCT key, status FROM {FR} WHERE status IS NOT NULL AND key IS NOT NULL) GROUP BY 1)
 SELECT key, array_to_string(list_slice(list_sort(list_distinct(list_append(s, 'added'))), 1, 12), ',') AS names FROM k""")
def capped_names(spark, sf):
    g = results(spark, sf).where("status IS NOT NULL AND key IS NOT NULL").groupBy("key").agg(F.array_sort(F.collect_set("status")).alias("s"))
    return g.select("key", F.array_join(F.array_sort(A.capped_union(F.col("s"), F.lit("added"))), ",").alias("names"))


@query(f"SELECT c.key, c.failures FROM (SELECT lower(trim(key)) AS key, failures, row_id FROM consecutive_failures) c WHERE NOT EXISTS (SELECT 1 FROM {DEAD} x WHERE x.key = c.key)")
def pruned_counters(spark, sf):
    rows = table(spark, sf, "consecutive_failures").select(norm_key("key").alias("key"), "failures")
    return state.pruned(rows, _recipes(spark, sf))


@query(f"""SELECT run_id, key, arg_max(status, (CAST(status IN ('ok', 'html_link') AS INTEGER), CASE WHEN status IN ('ok', 'html_link') THEN -result_id ELSE result_id END)) AS status,
 arg_max(result_id, (CAST(status IN ('ok', 'html_link') AS INTEGER), CASE WHEN status IN ('ok', 'html_link') THEN -result_id ELSE result_id END)) AS result_id FROM {FR} WHERE status IS NOT NULL GROUP BY 1, 2""")
def first_outcome(spark, sf):
    return state.first_outcome(results(spark, sf).where("status IS NOT NULL").withColumn("step", F.col("result_id")), ["run_id", "key"], ["status", "result_id"])


_LAST_RESULT = f"(SELECT key, arg_max(url, result_id) FILTER (url IS NOT NULL) AS website, arg_max(display_name, result_id) FILTER (display_name IS NOT NULL) AS display_name FROM {FR} WHERE key IS NOT NULL GROUP BY 1)"


@query(f"""WITH o AS (SELECT lower(trim(key)) AS key, arg_max(website, row_id) FILTER (website IS NOT NULL) AS website, arg_max(display_name, row_id) FILTER (display_name IS NOT NULL) AS display_name FROM contacts WHERE key IS NOT NULL GROUP BY 1)
 SELECT coalesce(n.key, o.key) AS key, coalesce(nullif(trim(n.website), ''), o.website) AS website, coalesce(nullif(trim(n.display_name), ''), o.display_name) AS display_name FROM o FULL JOIN {_LAST_RESULT} n ON n.key = o.key""")
def merged_records(spark, sf):
    some = lambda c, s: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(s)))
    old = table(spark, sf, "contacts").where("key IS NOT NULL").groupBy(norm_key("key").alias("key")).agg(some("website", "row_id").alias("website"), some("display_name", "row_id").alias("display_name"))
    new = results(spark, sf).where("key IS NOT NULL").groupBy("key").agg(some("url", "result_id").alias("website"), some("display_name", "result_id").alias("display_name"))
    return state.merged_records(old, new, "key", ["website", "display_name"])


@query("""SELECT row_id, coalesce(strftime(delivered_at AT TIME ZONE 'UTC', '%Y-%m-%d') >= strftime(target_date + 3, '%Y-%m-%d'), false) AS pending FROM report_long""")
def retrained_rows(spark, sf):
    return table(spark, sf, "report_long").select("row_id", P.retrained_pending(utc_date(F.col("delivered_at")).cast("string"), F.date_add("target_date", 3).cast("string")).alias("pending"))


_UNDATED = "regexp_replace(t, '(?i)\\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|sept)[a-z]*\\b|\\b\\d{1,4}(?:st|nd|rd|th)?\\b', ' ', 'g')"


@query("""SELECT t AS text, CASE """ + " ".join(f"WHEN contains(lower(t), '{w}') THEN '{w.title()}'" for w in ("bulletin", "newsletter", "download", "weekly", "parish")) + f""" ELSE coalesce(list_filter(string_split_regex({_UNDATED}, '[^a-zA-Z]+'), lambda w: length(w) >= 3)[1], '') END AS word,
 replace(replace(t, '\\', '\\\\'), '''', '\\''') AS escaped FROM (SELECT DISTINCT display_name AS t FROM report_long WHERE display_name IS NOT NULL)""")
def undated_words(spark, sf):
    d = table(spark, sf, "report_long").where("display_name IS NOT NULL").select(F.col("display_name").alias("text")).distinct()
    return d.select("text", X.undated_word(F.col("text")).alias("word"), X.selector_escape(F.col("text")).alias("escaped"))


@query("""SELECT row_id, CASE v WHEN 'north_west' THEN 'northwest' WHEN 'east' THEN 'eastern' ELSE v END AS diocese FROM (SELECT row_id, regexp_replace(lower(trim(diocese)), '[\\s-]+', '_', 'g') AS v FROM contacts)""")
def canonical_groups(spark, sf):
    return table(spark, sf, "contacts").select("row_id", P.renamed(F.col("diocese"), {"north_west": "northwest", "east": "eastern"}).alias("diocese"))


@query(f"""SELECT url, CASE WHEN len(l) > 1 THEN l[-2] ELSE l[1] END AS label FROM (SELECT url, string_split(regexp_replace({HOST_SQL}, '^www\\d*\\.', ''), '.') AS l FROM {URLS})""")
def domain_labels(spark, sf):
    u = table(spark, sf, "fetch_results").where("url IS NOT NULL").select("url").distinct()
    return u.select("url", U.domain_label(F.col("url")).alias("label"))


_SLUGGED = f"""CASE WHEN {SLUG_SQL} IS NOT NULL THEN replace(url, {_rx(_P['slug'], 0)}, strftime(DATE '{TARGET}', '%-d') || s || lower(strftime(DATE '{TARGET}', '%B')) || s || strftime(DATE '{TARGET}', '%Y')) ELSE url END"""


@query(f"""WITH u AS (SELECT url, regexp_extract(url, '(?i)[0-9]{{1,2}}(?:st|nd|rd|th)?([_-])[a-z]+[_-][0-9]{{4}}', 1) AS s FROM {URLS})
 SELECT url, {_SLUGGED} AS slug, regexp_replace({_SLUGGED}, '/(?:{int(TARGET[:4]) - 1}|{TARGET[:4]}|{int(TARGET[:4]) + 1})/[0-9]{{2}}/', '/{TARGET[:4]}/{TARGET[5:7]}/', 'g') AS upload FROM u""")
def predicted_urls(spark, sf):
    u = table(spark, sf, "fetch_results").where("url IS NOT NULL").select("url").distinct()
    return u.select("url", U.slug_url(F.col("url"), target()).alias("slug"), U.upload_url(F.col("url"), target()).alias("upload"))


@query(f"""SELECT url, contains(lower(url), '.pdf') AS pdf, regexp_matches(lower(url), '^.*parish.*[0-9]\\.pdf$') AS shaped FROM {URLS}""")
def pattern_matches(spark, sf):
    u = table(spark, sf, "fetch_results").where("url IS NOT NULL").select("url").distinct()
    hit = U.matches_pattern(F.col("url"), F.lit("*parish*.pdf")) & F.lower("url").rlike(r"[0-9]\.pdf$")
    return u.select("url", U.matches_pattern(F.col("url"), F.lit("*.pdf")).alias("pdf"), hit.alias("shaped"))


@query(f"""WITH p AS (SELECT page, '<html>' || string_agg('<b>' || text || '</b>', ' ' ORDER BY idx) || '</html>' AS html FROM {LINKS} WHERE text <> '' GROUP BY page),
 n AS (SELECT page, html, list_filter(list_transform(regexp_extract_all(html, '<b>([^<]*)</b>', 1), lambda x: trim(x)), lambda x: length(x) > 0) AS l FROM p)
 SELECT page, md5(array_to_string(list_filter(list_transform(string_split(regexp_replace(html, '<[^>]+>', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))), lambda x: length(x) > 0), chr(10))) AS text_md5,
 CAST(len(list_distinct(list_transform(l, lambda x: regexp_replace(lower(x), '[^a-z0-9]+', '', 'g')))) AS INTEGER) AS names FROM n""")
def page_texts(spark, sf):
    item = F.struct("idx", F.concat(F.lit("<b>"), "text", F.lit("</b>")).alias("t"))
    g = _links(spark, sf).where("text <> ''").groupBy("page").agg(F.concat(F.lit("<html>"), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), " "), F.lit("</html>")).alias("html"))
    return g.select("page", F.md5(X.html_text(F.col("html"))).alias("text_md5"), F.size(X.found_names(F.col("html"), "<b>([^<]*)</b>")).alias("names"))


@query("""SELECT row_id, coalesce(CASE WHEN regexp_matches(facebook, '(?i)^https?://') THEN facebook END, CASE WHEN regexp_matches(website, '(?i)^https?://') THEN website END) AS url FROM contacts""")
def effective_urls(spark, sf):
    c = table(spark, sf, "contacts")
    return c.select("row_id", lookups.effective_url(c, "facebook", "website").alias("url"))


@query(f"""SELECT result_id, CASE WHEN {"status NOT IN ('ok', 'html_link', 'skipped')"} THEN coalesce(error, '') ELSE '' END AS error, coalesce(nullif(trim(error), ''), nullif(trim(stale_reason), '')) AS reason FROM {FR} WHERE status IS NOT NULL""")
def log_errors(spark, sf):
    return results(spark, sf).where("status IS NOT NULL").select("result_id", P.log_error(F.col("status"), F.col("error")).alias("error"), P.first_text(F.col("error"), F.col("stale_reason")).alias("reason"))


@query("""WITH c AS (SELECT diocese, CAST(row_number() OVER (PARTITION BY diocese ORDER BY row_id) AS INTEGER) AS n, website FROM contacts WHERE website IS NOT NULL)
 SELECT diocese AS file, n AS section, 'Section ' || n AS name, website AS url FROM c""")
def named_links(spark, sf):
    c = table(spark, sf, "contacts").where("website IS NOT NULL").withColumn("n", F.row_number().over(Window.partitionBy("diocese").orderBy("row_id")))
    block = F.format_string("# --- Section %d ---\n# page: x\n- %s\n%s/again", F.col("n"), F.col("website"), F.col("website"))
    files = c.groupBy(F.col("diocese").alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", block.alias("b")))), lambda x: x["b"]), "\n").alias("value"))
    return sections.name_links(sections.numbered_lines(files))


@query("""WITH d AS (SELECT source || '-' || strftime(edition, '%Y-%m-%d') || '-' || doc_id AS id, coalesce(parish, '') AS parish, source AS diocese, strftime(edition, '%Y-%m-%d') AS date, left(text, 4000) AS text FROM documents WHERE length(text) > 0 AND edition IS NOT NULL AND source IS NOT NULL),
 s AS (SELECT id, date, strlen(CAST(to_json({'id': id, 'parish': parish, 'diocese': diocese, 'date': date, 'text': text}) AS VARCHAR)) + 4 AS bytes FROM d),
 r AS (SELECT id, date, bytes, row_number() OVER (ORDER BY date DESC, id) AS rank, sum(bytes) OVER (ORDER BY date DESC, id ROWS UNBOUNDED PRECEDING) AS running FROM s)
 SELECT id, date, CAST(bytes AS BIGINT) AS bytes, CAST(rank AS BIGINT) AS rank FROM r WHERE running <= 5 * 1024 * 1024 - 64""")
def search_index(spark, sf):
    d = table(spark, sf, "documents").where("edition IS NOT NULL AND source IS NOT NULL").select(
        F.col("source").alias("diocese"), F.col("edition").alias("day"), F.col("doc_id").cast("string").alias("key"), F.coalesce("parish", F.lit("")).alias("parish"), "text"
    )
    return writers.search_index(writers.search_documents(d)).select("id", "date", "bytes", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH b AS (SELECT key, run_id, result_id, url, display_name, CASE status WHEN 'ok' THEN 'download' WHEN 'html_link' THEN 'html' WHEN 'skipped' THEN 'goto' ELSE 'click' END AS action FROM {FR} WHERE key IS NOT NULL),
 g AS (SELECT key, run_id, arg_min(action, result_id) AS first, max(result_id) FILTER (action IN ('download', 'html')) AS last, arg_min(url, result_id) FILTER (url IS NOT NULL) AS start FROM b GROUP BY 1, 2),
 s AS (SELECT key, run_id, -1 AS result_id, start AS url, NULL AS text, 'goto' AS action FROM g WHERE first <> 'goto'
  UNION ALL SELECT b.key, b.run_id, result_id, url, display_name, action FROM b JOIN g ON g.key = b.key AND g.run_id = b.run_id WHERE NOT (action IN ('download', 'html') AND result_id <> last))
 SELECT key, run_id, CAST(row_number() OVER (PARTITION BY key, run_id ORDER BY result_id) - 1 AS INTEGER) AS step, action, url, text FROM s""")
def recipe_steps(spark, sf):
    action = F.when(F.col("status") == "ok", "download").when(F.col("status") == "html_link", "html").when(F.col("status") == "skipped", "goto").otherwise("click")
    step = F.struct("result_id", F.struct(action.alias("action"), "url", F.lit(None).cast("string").alias("selector"), F.col("display_name").alias("text")).alias("s"))
    r = results(spark, sf).where("key IS NOT NULL").groupBy("key", "run_id").agg(
        F.transform(F.array_sort(F.collect_list(step)), lambda x: x["s"]).alias("steps"), F.min_by("url", F.when(F.col("url").isNotNull(), F.col("result_id"))).alias("start_url")
    )
    whole = recipes.standalone(r.withColumn("status", F.lit("active")))
    return whole.select("key", "run_id", F.posexplode("steps").alias("step", "_s")).select("key", "run_id", "step", "_s.action", "_s.url", "_s.text")
