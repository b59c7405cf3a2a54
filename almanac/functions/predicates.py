"""Classifiers and predicates: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from almanac.functions import urls as U

#: Statuses that count as no failure, and the buckets of a report.
FINE = ("ok", "html_link", "skipped")
BUCKETS = ("downloaded", "html_links", "skipped", "failed", "stale_rejected")
#: Words of links that lead to an edition, and of links to something else.
EDITION_WORDS = r"(?i)\b(?:bulletin|newsletter)\b"
OTHER_WORDS = (
    r"(?i)dataentry|giftaid|standingorder|donation|prayer|safeguarding|privacy|gdpr|diocese|sitemap|application|registration|volunteer|"
    r"finances|financial|parishdraw|mcn\s*media"
)
#: Words of a server that turns robots away.
BLOCK_WORDS = r"403|forbidden|access denied|captcha|cloudflare|bot detection|err_aborted|blocked|challenge"
#: Shared document hosts.
CLOUD_DOCUMENTS = ("drive.google.com/", "docs.google.com/viewer", "docs.google.com/gview", "1drv.ms/", "onedrive.live.com/", "sharepoint.com/", "officeapps.live.com/op/")
#: Kinds of errors by what they say, in the order in which they are tried.
ERROR_KINDS = (
    ("dns", r"(?i)getaddrinfo|Name or service not known|ENOTFOUND|Could not resolve host"),
    ("ssl", r"(?i)SSL|certificate"),
    ("timeout", r"(?i)timeout"),
    ("recipe_drift", r"(?i)Recipe download step did not find|Recipe finished without downloading"),
    ("no_pdf", r"(?i)no PDF|html_link"),
)


def report_bucket(is_stale: Column, status: Column, file_exists: Column) -> Column:
    """An ok result without its file is a failure."""
    return (
        F.when(F.coalesce(is_stale, F.lit(False)), "stale_rejected").when((status == "ok") & F.coalesce(file_exists, F.lit(False)), "downloaded")
        .when(status == "html_link", "html_links").when(status == "skipped", "skipped").otherwise("failed")
    )


def log_status(status: Column) -> Column:
    return F.when(status.isin(*FINE), status).otherwise("failed")


def log_error(status: Column, error: Column) -> Column:
    return F.when(log_status(status) == "failed", F.coalesce(error, F.lit(""))).otherwise("")


def inactive(skip: Column, status: Column) -> Column:
    return F.coalesce(skip, F.lit(False)) | F.coalesce(F.lower(F.trim(status)).isin("dead_url", "inactive"), F.lit(False))


def first_text(*values: Column) -> Column:
    """First value that is neither null nor blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])


def other_document(url: Column) -> Column:
    """A link to something else than an edition; words of an edition come first."""
    t = U.decoded(F.coalesce(url, F.lit("")))
    return ~t.rlike(EDITION_WORDS) & t.rlike(OTHER_WORDS)


def document_link(url: Column) -> Column:
    """Ends like a document or leads to a shared one. The address that is downloaded in the end is worked out once, in a lambda."""
    path = F.lower(F.coalesce(U.part(url, "PATH"), F.lit("")))

    def leads(u: Column) -> Column:
        hit = F.endswith(u, F.lit(".pdf")) | F.endswith(u, F.lit(".docx"))
        for m in CLOUD_DOCUMENTS:
            hit = hit | u.contains(m)
        return hit

    target = F.transform(F.array(url), lambda x: F.lower(U.direct_download(x)))
    return F.endswith(path, F.lit(".pdf")) | F.endswith(path, F.lit(".docx")) | F.exists(target, leads)


def cloud_folder(url: Column) -> Column:
    u = F.lower(F.coalesce(url, F.lit("")))
    return (
        (u.contains("drive.google.com") & u.contains("/folders/")) | (u.contains("onedrive.live.com") & (u.contains("?id=") | u.contains("/redir")))
        | (u.contains("sharepoint.com") & u.rlike("/documents|/shared|folder|/forms/allitems\\.aspx")) | u.contains("1drv.ms")
    )


def cloud_file(url: Column) -> Column:
    u = F.lower(F.coalesce(url, F.lit("")))
    return u.contains("drive.google.com/file/d/") | (u.contains("onedrive.live.com") & u.contains("download"))


def pdf_bytes(content: Column, least: int = 20_000) -> Column:
    return (F.substring(content, 1, 4) == F.unhex(F.lit("25504446"))) & (F.length(content) >= least)


def blank_page(text: Column, filler: str = r"[\s\d\W_]+", least: int = 30) -> Column:
    """A page with too little text once filler is taken out; an unread page counts as full."""
    return F.coalesce(F.length(F.regexp_replace(text, filler, "")) < least, F.lit(False))


def bot_block(error: Column) -> Column:
    return F.coalesce(F.lower(error).rlike(BLOCK_WORDS), F.lit(False))


def error_kind(error: Column, retrained: Column | None = None) -> Column:
    e = F.coalesce(error, F.lit(""))
    out = F.when(retrained, "retrained") if retrained is not None else F.when(F.lit(False), "")
    for kind, p in ERROR_KINDS:
        out = out.when(e.rlike(p), kind)
    return out.otherwise("other")


def junk_key(key: Column) -> Column:
    k = F.lower(F.trim(F.coalesce(key, F.lit(""))))
    return (F.length(k) < 4) | k.rlike(r"^\d{6,8}(-pdf)?$|^\d{2}\.\d{2}\.\d{2}(-pdf)?$") | (k.rlike("-pdf$") & k.rlike(r"\d{5,}"))


def override_type(url: Column, kind: Column) -> Column:
    """``download`` where nothing is said, the suffix's type where what is said is unknown; null for urls that aren't web addresses."""
    k, path = F.lower(F.trim(F.coalesce(kind, F.lit("")))), F.lower(F.split_part(url, F.lit("?"), F.lit(1)))
    by_suffix = F.when(path.rlike(r"\.(?:jpe?g|png|webp)$"), "image").when(path.rlike(r"\.(?:pdf|docx)$"), "download").otherwise("html")
    return F.when(url.rlike("(?i)^https?://"), F.when(k == "", "download").when(k.isin("download", "html", "image"), k).otherwise(by_suffix))


def listing_page(url: Column, links: Column, hints: str = r"(?i)bulletin|newsletter|news|publication|download") -> Column:
    return (links >= 8) & F.coalesce(url, F.lit("")).rlike(hints)


def schedule_ok(text: Column) -> Column:
    return text.rlike(r"(?i)^\s*(?:mon|tues|wednes|thurs|fri|satur|sun)day\s+([01]?\d|2[0-3]):[0-5]\d\s*$")


def tier(rate: Column, failures: Column) -> Column:
    """By the success rate, without one by the failures, without either grey."""
    return (
        F.when(rate >= 0.8, "green").when(rate >= 0.5, "amber").when(rate.isNotNull(), "red")
        .when(failures <= 0, "green").when(failures <= 2, "amber").when(failures.isNotNull(), "red").otherwise("grey")
    )


def traffic_light(pct: Column) -> Column:
    return F.when(pct >= 85, "red").when(pct >= 60, "amber").otherwise("green")


def bar(pct: Column) -> Column:
    full = F.floor(pct / 5).cast("int")
    return F.concat(F.repeat(F.lit("#"), full), F.repeat(F.lit("."), F.lit(20) - full))


def retry_strategy(file_type: Column, pattern: Column, has_page: Column, content_type: Column) -> Column:
    p = F.coalesce(pattern, F.lit(""))
    return (
        F.when(F.coalesce(file_type, F.lit("")).contains("recipe") | p.isin("learned", "recipe"), "retrain_recipe")
        .when(F.coalesce(has_page, F.lit(False)) & (F.coalesce(content_type, F.lit("")) != "html_link"), "rescrape_bulletin_page")
        .when((p != "") & ~p.isin("html_link", "F"), "try_date_patterns").otherwise("manual_review")
    )


def status_dot(disabled: Column, override: Column, recipe: Column) -> Column:
    """Precedence of a source's marks."""
    return (
        F.when(disabled, "disabled").when(override, "override").when(recipe == "dead", "dead").when(recipe == "ok", "ok")
        .when(recipe == "none", "none").otherwise("unchecked")
    )


def edition_image(src: Column, width: Column, height: Column) -> Column:
    """Images large enough to be a page."""
    s = F.lower(F.coalesce(src, F.lit("")))
    return ~s.rlike(r"^data:|\.svg(?:[?#]|$)") & (F.greatest(width, height) >= 800) & (F.least(width, height) >= 600)


def image_score(src: Column, alt: Column, in_main: Column) -> Column:
    return F.when(F.concat_ws(" ", src, alt).rlike(EDITION_WORDS), 2).otherwise(0) + F.coalesce(in_main.cast("int"), F.lit(0))


def renamed(value: Column, aliases: dict[str, str]) -> Column:
    """The alias's name, else the value itself, both in lower case with underscores."""
    v = F.regexp_replace(F.lower(F.trim(value)), r"[\s-]+", "_")
    if not aliases:
        return v
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(table, v), v)


def retrained_pending(recorded: Column, report_day: Column) -> Column:
    """Recorded on the report's day or later, compared as text; never without a record."""
    return F.coalesce(recorded >= report_day, F.lit(False))
