"""Choosing the best link, document or pattern of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions import dates as D
from almanac.functions import predicates as P
from almanac.functions import text as X
from almanac.functions import urls as U
from almanac.functions.pages import RULE_SETS, RuleSet, rule_scores
from almanac.operators.order import first_rows


def _blob(url: str, label: str) -> Column:
    return F.lower(F.concat_ws(" ", U.decoded(F.col(url)), F.coalesce(label, F.lit(""))))


def _has_token(blob: Column, tokens: Column) -> Column:
    return F.exists(tokens, lambda t: F.contains(blob, t))


def scored_candidates(links: DataFrame, target: Column) -> DataFrame:
    """Links with the keys of their rank: token of the target, in its week, not known stale, day, place.

    ``links``: ``page, idx, href, text``.
    """
    d = F.col("day")
    week = F.coalesce(D.in_week(d, target), F.lit(False))
    dated = links.withColumn("_blob", _blob("href", "text")).withColumn("day", D.candidate_date(F.col("_blob")))
    return dated.withColumns({
        "token": _has_token(F.col("_blob"), D.page_tokens(target)).cast("int"), "in_week": week.cast("int"), "not_stale": (d.isNull() | week).cast("int"),
    }).drop("_blob")


def best_candidate(links: DataFrame, target: Column) -> DataFrame:
    """The first of each page by the five keys."""
    order = [F.desc("token"), F.desc("in_week"), F.desc("not_stale"), F.desc_nulls_last("day"), F.col("idx")]
    return first_rows(scored_candidates(links, target), ["page"], order)


def best_listing_link(links: DataFrame, target: Column) -> DataFrame:
    """The best link of a listing page; none if even the best says nothing for the target or is known to be old."""
    d = F.col("_d")
    week = F.coalesce(D.in_week(d, target), F.lit(False))
    real = links.where(~F.trim("href").rlike("^(?:javascript:|mailto:|#)") & (F.trim("href") != ""))
    dated = real.withColumn("_blob", _blob("href", "text")).withColumn("_d", D.date_in_text(F.col("_blob")))
    scored = dated.withColumns({
        "token": _has_token(F.col("_blob"), D.link_tokens(target)).cast("int"), "in_week": week.cast("int"), "not_stale": (d.isNull() | week).cast("int"),
    }).drop("_blob", "_d")
    best = first_rows(scored, ["page"], [F.desc("token"), F.desc("in_week"), F.desc("not_stale"), F.col("idx")])
    return best.where("token + in_week + not_stale > 0")


def document_score(url: Column) -> Column:
    """``struct<date, bonus>``: the greatest day spelt day first with a two-digit year, 10 for an edition's words."""
    t = F.lower(U.decoded(url))
    dashed = r"(?<!\d)(\d{1,2})-(\d{1,2})-(\d{2})(?!\d)"

    def num(x: Column, p: str) -> Column:
        g = lambda i: F.regexp_extract(x, p, i).cast("int")
        return (g(3) + 2000) * 10000 + g(2) * 100 + g(1)

    dashes = F.transform(F.regexp_extract_all(t, F.lit(dashed), F.lit(0)), lambda x: num(x, dashed))
    six = F.when(t.rlike(D.DMY6), num(F.regexp_extract(t, D.DMY6, 0), r"(\d{2})(\d{2})(\d{2})"))
    best = F.coalesce(F.greatest(F.array_max(dashes), six), F.lit(0))
    return F.struct(best.alias("date"), F.when(t.rlike(P.EDITION_WORDS), 10).otherwise(0).alias("bonus"))


def best_document(links: DataFrame) -> DataFrame:
    """The newest document of each page, an edition's words before others, the first of equals."""
    s = links.where(~P.other_document(F.col("href"))).withColumn("_s", document_score(F.col("href")))
    return first_rows(s, ["page"], [F.desc("_s"), F.col("idx")]).select("page", "idx", "href", F.col("_s.date").alias("date_score"), F.col("_s.bonus").alias("bonus"))


def ranked_links(links: DataFrame, pins: DataFrame | None = None, n: int = 4) -> DataFrame:
    """The best link of each page and its alternatives: pinned, fully dated, dated, each by date, undated ones by points; of equals the first on the page.

    A rejected link can only be the best, where a page has no other. Adds ``rank``.
    """
    d, p = F.col("_d"), F.col("_p")
    j = links.withColumn("_d", D.partial_date(F.concat_ws(" ", "href", "text"))).withColumn("_p", X.phrase_points(F.col("href"), F.col("text")))
    if pins is not None:
        j = j.join(pins.select("page", F.lower("text").alias("_pin")), "page", "left")
    pinned = F.coalesce(F.contains(_blob("href", "text"), F.col("_pin")), F.lit(False)) if pins is not None else F.lit(False)
    score = D.date_score(d)
    full = F.coalesce((d["month"] > 0) & (d["day"] > 0), F.lit(False))
    j = j.withColumns({
        "rejected": (p["penalty"] >= 120) & (p["bonus"] < 40), "pinned": pinned, "full_date": full, "dated": d.isNotNull(),
        "date_score": score, "points": score.cast("long") * 100 + p["bonus"] - p["penalty"] + F.when(pinned, 200).otherwise(0) + F.col("idx"),
    }).drop("_pin", "_d", "_p")
    order = [
        F.col("rejected"), F.desc("pinned"), F.desc("full_date"), F.desc("dated"), F.desc(F.when(F.col("dated"), F.col("date_score"))),
        F.desc(F.when(~F.col("dated"), F.col("points"))), F.col("idx"),
    ]
    ranked = j.withColumn("rank", F.row_number().over(Window.partitionBy("page").orderBy(*order))).where(F.col("rank") <= n)
    return ranked.where((F.col("rank") == 1) | ~F.col("rejected"))


def date_first(links: DataFrame) -> DataFrame:
    """Full dates newest first, then partial dates, then the later place on the page."""
    d = F.col("_d")
    full = F.coalesce((d["month"] > 0) & (d["day"] > 0), F.lit(False))
    order = [F.desc("full_date"), F.desc("dated"), F.desc(F.when(F.col("dated"), F.col("date_score"))), F.desc("idx")]
    dated = links.withColumn("_d", D.partial_date(F.concat_ws(" ", "href", "text")))
    return first_rows(dated.withColumns({"full_date": full, "dated": d.isNotNull(), "date_score": D.date_score(d)}).drop("_d"), ["page"], order)


def stale_pages(links: DataFrame, target: Column) -> DataFrame:
    """Pages all of whose links are dated and none of whose is of the target's week."""
    s = scored_candidates(links, target)
    g = s.groupBy("page").agg(
        F.bool_or(F.col("day").isNotNull()).alias("dated"), F.bool_or(F.col("day").isNull()).alias("undated"),
        F.bool_or((F.col("in_week") + F.col("token")) > 0).alias("current"), F.max("day").alias("newest"),
    )
    return g.where("dated AND NOT undated AND NOT current").select("page", "newest")


def ambiguous_pages(links: DataFrame, n: int = 3) -> DataFrame:
    """Candidates of pages where the choice isn't clear: nothing dated, or the two newest dates equal. Links to other documents go unless nothing else is left."""
    d = D.date_score(D.partial_date(F.concat_ws(" ", "href", "text")))
    s = links.withColumns({"date_score": d, "other": P.other_document(F.col("href"))})
    only = s.groupBy("page").agg(F.bool_and("other").alias("_only"))
    pool = s.join(only, "page").where("NOT other OR _only").drop("_only")
    top = first_rows(pool, ["page"], [F.desc("date_score"), F.col("idx")], max(n, 2))
    unclear = top.groupBy("page").agg(F.array_sort(F.collect_list("date_score"), lambda a, b: b - a).alias("_d")).where("size(_d) > 1 AND (_d[0] = 0 OR _d[0] = _d[1])")
    return first_rows(top.join(unclear.select("page"), "page", "left_semi"), ["page"], [F.desc("date_score"), F.col("idx")], n)


def fingerprints(pages: DataFrame, rule_sets: tuple[RuleSet, ...] = RULE_SETS, n: int = 6) -> DataFrame:
    """``page, rule, kind, score``: the best rule sets that hold for a page. ``pages``: ``page, html``; each is scanned once per mark, without a join."""
    return pages.select("page", F.inline(F.slice(rule_scores(F.coalesce("html", F.lit("")), rule_sets), 1, n)))


def best_weekly(links: DataFrame) -> DataFrame:
    """The best weekly edition of each page, among links that look like one: full dates newest first, partial dates, then the later place; download buttons (``is_download``) have 25 places more."""
    d = F.col("_d")
    full = F.coalesce((d["month"] > 0) & (d["day"] > 0), F.lit(False))
    weekly = F.lower("href").rlike(r"weekly-bulletins|/newsletters/|/files/\d+/[^/?#]*sunday") | P.document_link(F.col("href"))
    fit = links.where(F.coalesce(weekly, F.lit(False)) & ~P.other_document(F.col("href"))).withColumn("_d", D.partial_date(F.concat_ws(" ", "href", "text")))
    scored = fit.withColumns({"full_date": full, "dated": d.isNotNull(), "date_score": D.date_score(d), "points": F.col("idx") + F.when(F.col("is_download"), 25).otherwise(0)}).drop("_d")
    return first_rows(scored, ["page"], [F.desc("full_date"), F.desc("dated"), F.desc("date_score"), F.desc("points"), F.desc("idx")])


def best_images(images: DataFrame, n: int = 30) -> DataFrame:
    """Page-sized images of each page, an edition's words and the main part first. ``images``: ``page, idx, src, alt, width, height, in_main``."""
    s = images.where(P.edition_image(F.col("src"), F.col("width"), F.col("height"))).withColumn("score", P.image_score(F.col("src"), F.col("alt"), F.col("in_main")))
    return first_rows(s, ["page"], [F.desc("score"), F.col("idx")], n)


def this_week(links: DataFrame, today: Column, days: int = 7) -> DataFrame:
    """The first link dated within so many days of today, else the first if it has a full date."""
    d = D.partial_date(F.concat_ws(" ", "href", "text"))
    dated = links.withColumn("_d", d).withColumn("_day", D.valid_date(F.col("_d.year"), F.col("_d.month"), F.col("_d.day")))
    near = F.coalesce(F.abs(F.datediff("_day", today)) <= days, F.lit(False))
    g = dated.groupBy("page").agg(
        F.min_by("idx", F.when(near, F.col("idx"))).alias("near"), F.min_by(F.struct("idx", "_day"), "idx").alias("first")
    )
    return g.select("page", F.coalesce("near", F.when(F.col("first._day").isNotNull(), F.col("first.idx"))).alias("idx")).where("idx IS NOT NULL")


def first_after(rows: DataFrame, by: list[str], ts: str, moment: Column, seq: str, slack_s: int = 10) -> DataFrame:
    """The first row created after a moment less some slack, else the first row."""
    late = F.unix_seconds(F.col(ts)) >= F.unix_seconds(moment) - slack_s
    return rows.groupBy(*by).agg(F.coalesce(F.min(F.when(late, F.col(seq))), F.min(seq)).alias(seq))
