"""Recorded step lists: summaries, normal form, health, edits. A recipe row has ``key, start_url, status, steps``; a step ``action, url, selector, text``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions import dates as D
from almanac.functions import predicates as P
from almanac.functions import text as X
from almanac.functions import urls as U

STEP = "struct<action:string,url:string,selector:string,text:string>"


def fingerprints(recipes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``key`` (or the columns ``by``), ``n_steps, clicks, flow`` and flags; ``flow`` is the ordered list of actions."""
    s = F.coalesce("steps", F.array().cast(f"array<{STEP}>"))
    has = lambda a: F.exists(s, lambda x: x["action"] == a)
    return recipes.select(
        *(by or ["key"]), F.size(s).alias("n_steps"), F.size(F.filter(s, lambda x: x["action"] == "click")).alias("clicks"), has("download").alias("downloads"),
        has("html").alias("captures"), F.exists(s, lambda x: F.coalesce(P.cloud_folder(x["url"]), F.lit(False))).alias("cloud"),
        F.array_join(F.transform(s, lambda x: x["action"]), ">").alias("flow"),
    )


def standalone(recipes: DataFrame) -> DataFrame:
    """Recipes that begin with a step to their start page, with the marks a replay needs: a dated start page, a shared folder; all but the last terminal step dropped."""
    first = F.struct(F.lit("goto").alias("action"), F.col("start_url").alias("url"), F.lit(None).cast("string").alias("selector"), F.lit(None).cast("string").alias("text"))
    s = F.filter(F.coalesce("steps", F.array().cast(f"array<{STEP}>")), lambda x: F.length(F.trim(x["action"])) > 0)
    begun = F.when((F.size(s) > 0) & (F.get(s, F.lit(0))["action"] == "goto"), s).otherwise(F.concat(F.array(first), s))
    end = lambda x: x["action"].isin("download", "html", "image")
    df = recipes.withColumn("steps", begun)
    last = F.size("steps") - F.array_position(F.transform(F.reverse("steps"), end), F.lit(True)) + 1
    df = df.withColumn("_last", last).withColumn("steps", F.filter("steps", lambda x, i: ~end(x) | (i + 1 == F.col("_last")))).drop("_last")
    return df.withColumn("use_target_url", D.date_in_slug(F.col("start_url")).isNotNull()).withColumn("cloud_folder", F.exists("steps", lambda x: F.coalesce(P.cloud_folder(x["url"]), F.lit(False))))


def redated(recipes: DataFrame, target: Column) -> DataFrame:
    """Click steps with a dotted date in their text moved to the target's."""

    def step(x: Column) -> Column:
        dated = (x["action"] == "click") & x["text"].rlike(D.DOTTED)
        return F.when(dated, x.withField("text", F.regexp_replace(x["text"], F.lit(D.DOTTED), D.dotted(target)))).otherwise(x)

    return recipes.withColumn("steps", F.transform("steps", step))


def dead_sources(recipes: DataFrame, health: DataFrame, limit: int = 2) -> DataFrame:
    """``key, status, reason`` of recipes whose host is unknown for good; those somebody marked keep what they were marked."""
    gone = health.where((F.col("strikes") >= limit) & (F.col("last_result") == "nxdomain")).select("key").distinct()
    marked = F.lower(F.trim("status")).isin("dead_url", "inactive", "manual")
    return recipes.join(gone, "key", "left_semi").where(~F.coalesce(marked, F.lit(False))).select("key", F.lit("dead_url").alias("status"), F.lit("host unknown").alias("reason"))


def effective_start(overrides: str = "override_url", start: str = "start_url") -> Column:
    """Override, else the last terminal step's address, else the start page."""
    end = F.filter("steps", lambda x: x["action"].isin("download", "html", "image") & x["url"].rlike("(?i)^https?://"))
    return F.coalesce(F.nullif(F.trim(F.col(overrides)), F.lit("")), F.try_element_at(F.transform(end, lambda x: x["url"]), F.lit(-1)), F.nullif(F.trim(F.col(start)), F.lit("")))


def seeds(entries: DataFrame, existing: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """First entry of each key that has no recipe yet."""
    fresh = entries.join(existing.select(key).distinct(), key, "left_anti")
    return fresh.groupBy(key).agg(F.min_by(F.struct(*[c for c in entries.columns if c not in (key, seq)]), seq).alias("_b")).select(key, "_b.*")


def registry_keys(urls: DataFrame, registry: DataFrame, shared: list[str], url: str = "url") -> DataFrame:
    """``urls`` with ``source``: by the normal url, else by the site if only one source has it, else the url's own key."""
    by_url = registry.select(U.normal_url(F.col("url")).alias("_n"), "key").where("_n IS NOT NULL").groupBy("_n").agg(F.min("key").alias("_by_url"))
    by_site = registry.select(U.site_key(F.col("url"), shared).alias("_s"), "key").where("_s IS NOT NULL").groupBy("_s").agg(F.min("key").alias("_by_site"), F.count_distinct("key").alias("_m"))
    u = urls.withColumn("_n", U.normal_url(F.col(url))).withColumn("_s", U.site_key(F.col(url), shared))
    j = u.join(by_url, "_n", "left").join(by_site.where("_m = 1").drop("_m"), "_s", "left")
    return j.withColumn("source", F.coalesce("_by_url", "_by_site", U.url_key(F.col(url), F.lit("")))).drop("_n", "_s", "_by_url", "_by_site")


def edited_sections(lines: DataFrame, edits: DataFrame, file: str = "file") -> DataFrame:
    """Sectioned lines with the first address of named sections replaced; sections without one get it after their header.

    ``edits``: ``file, name, url``. Places become fractions of the old ones where a line comes in.
    """
    e = edits.select(file, F.col("name").alias("_name"), F.col("url").alias("_url")).dropDuplicates([file, "_name"])
    j = lines.join(e, (lines[file] == e[file]) & (lines["name"] == e["_name"]), "left").drop(e[file])
    is_url = F.col("line").rlike(r"^(?:[-*•]\s+)?https?:")
    first = lines.where(is_url).groupBy(file, "section").agg(F.min("pos").alias("_first"))
    j = j.join(first, [file, "section"], "left")
    swapped = j.withColumn("line", F.when(F.col("_url").isNotNull() & (F.col("pos") == F.col("_first")), F.col("_url")).otherwise(F.col("line")))
    new = j.where(F.col("is_header") & F.col("_url").isNotNull() & F.col("_first").isNull()).withColumn("line", F.col("_url")).withColumn("is_header", F.lit(False))
    cols = [file, "section", "name", "is_header", "line"]
    return swapped.select(*cols, F.col("pos").cast("double").alias("pos")).unionByName(new.select(*cols, (F.col("pos") + 0.5).alias("pos")))


def stitch_plan(results: DataFrame, excluded: DataFrame, pages: str = "n_pages", most_pages: int = 4) -> DataFrame:
    """What goes into a merged edition and in which order: ok results of this week's files, by name; no fallback, stale, excluded or overlong ones."""
    fine = (F.col("status") == "ok") & ~F.coalesce("is_fallback", F.lit(False)) & ~F.coalesce("is_stale", F.lit(False)) & (F.coalesce(pages, F.lit(1)) <= most_pages)
    return results.where(fine).join(excluded.select("key").distinct(), "key", "left_anti").withColumn("sort_name", F.lower("display_name"))


def cloud_selectors(target: Column) -> Column:
    """Selectors of a dated row of a shared folder, the exact ones first (fixed forms)."""
    bare = D.dotted(target)
    pdf = F.concat(bare, F.lit(".pdf"))
    has = lambda head, t: F.concat(F.lit(f'{head}:has-text("'), t, F.lit('")'))
    return F.array(has('[role="row"]', pdf), has('[role="gridcell"]', pdf), has('[role="row"]', bare), has("", pdf), has("", bare))


def cloud_steps(recipes: DataFrame, target: Column) -> DataFrame:
    """Click steps on a dated row of a shared folder moved to the target's: text, selector, and fallbacks before those there are.

    A step has ``action, url, selector, text, fallback_selectors`` and may have others.
    """
    bare = D.dotted(target)

    def step(x: Column) -> Column:
        dated = (x["action"] == "click") & F.concat_ws(" ", x["text"], x["selector"], x["url"]).rlike(D.DOTTED)
        own = F.filter(F.transform(F.coalesce(x["fallback_selectors"], F.array().cast("array<string>")), lambda s: F.trim(s)), lambda s: s != "")
        moved = x.withField("text", F.concat(bare, F.lit(".pdf"))).withField("selector", F.concat(F.lit(':has-text("'), bare, F.lit('")'))).withField(
            "fallback_selectors", F.array_union(cloud_selectors(target), own)
        )
        return F.when(dated, moved).otherwise(x)

    return recipes.withColumn("steps", F.transform("steps", step))


def click_steps(clicks: DataFrame) -> DataFrame:
    """Recorded clicks as steps: ``selector`` and ``fallback_selectors`` that stay right when dates change.

    ``clicks``: ``tag, role, text, href, css_path``. The first of the word that stays, the link's kind and the path; clicks without any of them give no step.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit(""))
    text, href, path = blank("text"), blank("href"), blank("css_path")
    word = X.undated_word(text)
    quoted = F.concat(F.lit(":has-text('"), X.selector_escape(word), F.lit("')"))
    pdf, docx = F.lit("a[href$='.pdf']"), F.lit("a[href$='.docx']")
    selector = (
        F.when((F.lower(blank("tag")) == "a") & (word != ""), F.concat(F.lit("a"), quoted)).when(word != "", quoted)
        .when(href != "", F.when(F.lower(href).contains(".pdf"), pdf).otherwise(docx)).otherwise(path)
    )
    more = F.array(
        F.when((blank("role") != "") & (word != ""), F.concat(F.lit("role="), F.lower("role"), F.lit('[name="'), word, F.lit('"]'))),
        F.when(F.endswith(F.lower(href), F.lit(".docx")), docx).otherwise(pdf), F.lit("a[href*='.pdf']"), F.nullif(path, F.lit("")),
    )
    steps = clicks.where((word != "") | (href != "") | (path != "")).withColumn("selector", selector)
    return steps.withColumn("action", F.lit("click")).withColumn("fallback_selectors", F.array_distinct(F.filter(more, lambda x: x.isNotNull() & (x != F.col("selector")))))


def enriched(recipes: DataFrame, notes: DataFrame) -> DataFrame:
    """Recipes with what is known of their ``page_type``: ``playbook, site_type, auto_direct, operator_notes``; steps to a page go where they are said to be needless and a download is recorded.

    ``notes``: one row per ``page_type`` with these columns and ``skip_goto``. Recipes of other types stay as they are.
    """
    j = recipes.join(notes, "page_type", "left")
    loads = F.exists("steps", lambda x: F.lower(x["action"]) == "download")
    steps = F.when(F.coalesce("skip_goto", F.lit(False)) & loads, F.filter("steps", lambda x: F.lower(x["action"]) != "goto")).otherwise(F.col("steps"))
    return j.withColumn("steps", steps).drop("skip_goto")


def regrouped(rows: DataFrame, moves: DataFrame, key: str = "key", group: str = "group") -> DataFrame:
    """Sources moved to other groups: ``moves`` says which; the last by ``seq`` counts."""
    last = moves.groupBy(F.col(key).alias("_k")).agg(F.max_by(group, "seq").alias("_g"))
    j = rows.join(last, rows[key] == last["_k"], "left")
    return j.withColumn(group, F.coalesce("_g", F.col(group))).drop("_k", "_g")


def laid_out(path: Column, folder: str = "unknown") -> Column:
    """Where a recipe file belongs: flat files go into a folder, those that begin with an underscore and those in folders stay."""
    flat = path.rlike(r"^[^/_][^/]*\.json$")
    return F.when(flat, F.concat(F.lit(folder + "/"), path)).otherwise(path)


def hint(page_type: Column, labels: dict[str, str], tip: Column, names: Column, predicted: Column, most: int = 4) -> Column:
    """What to tell a trainer of a page: what it looks like, the first of a learned tip and the names of similar sources, and this week's address."""
    known = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    similar = F.when(F.size(names) > 0, F.concat(F.lit("Similar sources already solved: "), F.array_join(F.slice(names, 1, most), ", ")))
    return F.concat_ws(
        "\n", F.concat(F.lit("This looks like: "), F.coalesce(F.try_element_at(known, page_type), F.lit(labels.get("unknown", "unknown")))),
        F.coalesce(F.concat(F.lit("Learned tip: "), F.nullif(F.trim(tip), F.lit(""))), similar), F.concat(F.lit("This week's address may be: "), F.nullif(F.trim(predicted), F.lit(""))),
    )
