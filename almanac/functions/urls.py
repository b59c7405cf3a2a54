"""Urls: keys, normal forms, unwrapping, predictions. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from almanac.functions import dates as D

_WWW = r"^www\d*\."
#: Hosts whose first label names no source.
SHARED_CDN = ("filesafe.space", "google.com")
#: Shapes of shared file links, with the file's id.
DRIVE_ID = (r"drive\.google\.com/file/d/([^/?#]+)", r"drive\.google\.com/open\?[^#]*\bid=([^&#]+)", r"drive\.google\.com/uc\?[^#]*\bid=([^&#]+)")
DOWNLOAD = "https://drive.usercontent.google.com/download?id={0}&export=download"
NUMBERED = r"(/(?:Newsletters|Weekly-Bulletins)/)(\d+)/"


def decoded(url: Column) -> Column:
    """Percent escapes undone, a plus sign kept; text with broken escapes unchanged."""
    return F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)


def part(url: Column, name: str) -> Column:
    """``HOST``, ``PATH`` or ``QUERY`` of a url that may contain blanks; null if it has none."""
    return F.try_parse_url(F.replace(F.trim(url), F.lit(" "), F.lit("%20")), F.lit(name))


def hostname(url: Column) -> Column:
    return F.nullif(F.lower(part(url, "HOST")), F.lit(""))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(hostname(url), _WWW, "")


def domain_label(url: Column) -> Column:
    """The label before the last."""
    labels = F.split(bare_host(url), r"\.")
    return F.when(F.size(labels) > 1, F.element_at(labels, -2)).otherwise(F.get(labels, F.lit(0)))


def url_key(url: Column, header: Column) -> Column:
    """A source's key: first label of the host; behind an image proxy that of the first path piece; on shared hosts the header's name before a bracket."""
    host = bare_host(url)
    real = F.split(F.regexp_replace(F.lower(F.split_part(F.regexp_replace(part(url, "PATH"), "^/+", ""), F.lit("/"), F.lit(1))), _WWW, ""), r"\.")
    shared = D.any_of([host.contains(h) for h in SHARED_CDN])
    first = F.split_part(host, F.lit("."), F.lit(1))
    by_name = F.regexp_replace(F.split_part(F.lower(header), F.lit("("), F.lit(1)), "[^a-z0-9]", "")
    return (
        F.when(host.rlike(r"\bi\d+\.wp\.com\b") & (F.size(real) >= 2), F.get(real, F.lit(0)))
        .when(shared & (F.length(header) > 0), by_name)
        .when(shared, F.regexp_replace(first, "[^a-z0-9]", ""))
        .otherwise(first)
    )


def normal_url(url: Column) -> Column:
    """Host without ``www`` and path without trailing slashes, lower case; query dropped."""
    return F.concat(bare_host(url), F.lower(F.regexp_replace(F.coalesce(part(url, "PATH"), F.lit("")), "/+$", "")))


def site_key(url: Column, shared_hosts: list[str]) -> Column:
    return F.when(bare_host(url).isin(shared_hosts), normal_url(url)).otherwise(bare_host(url))


def path_slug(url: Column, skip: list[str]) -> Column:
    """Last path piece that says something, as a slug."""
    pieces = F.filter(F.split(F.lower(part(url, "PATH")), "/"), lambda x: (F.length(x) >= 3) & ~x.isin(skip))
    return F.regexp_replace(F.regexp_replace(F.try_element_at(pieces, F.lit(-1)), "[^a-z0-9_-]+", "-"), "^-+|-+$", "")


def unwrapped(url: Column, with_gview: bool = True) -> Column:
    """The address inside a document viewer's address."""
    viewer = "viewer|gview" if with_gview else "viewer"
    inner = F.nullif(F.trim(decoded(F.try_parse_url(F.replace(url, F.lit(" "), F.lit("%20")), F.lit("QUERY"), F.lit("url")))), F.lit(""))
    return F.when(hostname(url).contains("docs.google.com") & part(url, "PATH").rlike(viewer), F.coalesce(decoded(inner), url)).otherwise(url)


def direct_download(url: Column) -> Column:
    t = unwrapped(F.trim(url))
    ids = F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in DRIVE_ID])
    return F.when(ids.isNotNull(), F.replace(F.lit(DOWNLOAD), F.lit("{0}"), ids)).otherwise(t)


def seed_urls(target_url: Column, example: Column, html_link: Column) -> Column:
    """Pages to look for links on: the urls, their roots and parents; each once, in order."""

    def root(u: Column) -> Column:
        return F.nullif(F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1), F.lit(""))

    def parent(u: Column) -> Column:
        path = F.regexp_extract(u, r"^[^:]+://[^/?#]+(/[^?#]*)", 1)
        return F.when(F.trim(path, F.lit("/")).contains("/"), F.concat(root(u), F.regexp_replace(path, "/[^/]*$", "/")))

    first = F.when(html_link, F.array(example)).otherwise(F.array(target_url, example))
    more = F.array(*[x for u in (target_url, example) for x in (F.concat(root(u), F.lit("/")), parent(u))])
    return F.array_distinct(F.filter(F.transform(F.concat(first, more), lambda x: F.trim(x)), lambda x: F.length(x) > 0))


def newsletter_number(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, NUMBERED, 2), F.lit("")).cast("int")


def next_newsletter(url: Column, target: Column) -> Column:
    """The number moved on by the whole weeks since the url's own date, by one without a date; what follows the number is dropped."""
    slug = F.element_at(F.split(decoded(part(url, "PATH")), "/"), -1)
    since = F.get(F.transform(F.array(slug), lambda x: F.coalesce(D.date_in_slug(x), D.date_in_text(x))), F.lit(0))  # in a lambda, else the generated code is too large
    weeks = F.when(since.isNull(), F.lit(1)).otherwise(F.greatest(F.lit(0), F.floor(F.datediff(target, since) / 7)).cast("int"))
    stem = F.regexp_extract(url, r"^(.*?/(?:Newsletters|Weekly-Bulletins)/)\d+/", 1)
    return F.when(newsletter_number(url).isNotNull(), F.concat(stem, (newsletter_number(url) + weeks).cast("string"), F.lit("/"))).otherwise(url)


def slug_url(url: Column, target: Column) -> Column:
    """The first date slug replaced by the target's, with its own separator and the month in lower case."""
    old = D.date_in_slug(url)
    hit = F.regexp_extract(url, D.SLUG, 0)
    sep = F.regexp_extract(url, r"(?i)\d{1,2}(?:st|nd|rd|th)?([_-])[a-z]+[_-]\d{4}", 1)
    new = F.concat(F.dayofmonth(target).cast("string"), sep, F.lower(F.date_format(target, "MMMM")), sep, F.year(target).cast("string"))
    return F.when(old.isNotNull(), F.overlay(url, new, F.instr(url, hit), F.length(hit))).otherwise(url)


def upload_url(url: Column, target: Column) -> Column:
    """``slug_url``, then every year and month folder within a year of the target moved to the target's."""
    years = [-1, 0, 1]
    out = slug_url(url, target)
    new = F.concat(F.lit("/"), F.date_format(target, "yyyy/MM"), F.lit("/"))
    near = F.concat_ws("|", *[(F.year(target) + y).cast("string") for y in years])
    return F.regexp_replace(out, F.concat(F.lit("/(?:"), near, F.lit(r")/\d{2}/")), new)


def matches_pattern(url: Column, pattern: Column) -> Column:
    """Shell pattern on the decoded lower-case url; the two bare suffix patterns also match anywhere."""
    u = F.lower(decoded(url))
    p = F.coalesce(F.nullif(F.lower(F.trim(pattern)), F.lit("")), F.lit("*.pdf"))
    quoted = F.regexp_replace(p, r"([.\\+^$(){}|\[\]])", r"\\$1")
    regex = F.concat(F.lit("(?s)^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))
    return F.regexp_like(u, regex) | ((p == "*.pdf") & u.contains(".pdf")) | ((p == "*.docx") & u.contains(".docx"))
