"""What a page's source text says about it: rule sets, content tests, kind of page. Column in, Column out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from almanac.functions import predicates as P


@dataclass(frozen=True)
class RuleSet:
    """Marks of a kind of site with their weights. It holds from ``least`` points on; ``test`` names a test of the content without which it does not hold at all (``must``), or with 0.35 of its points."""

    name: str
    kind: str
    least: int
    marks: tuple[tuple[str, int], ...]
    test: str | None = None
    must: bool = False


#: Marks of the site builders that sources use, with their weights and least scores.
RULE_SETS = (
    RuleSet("joomla_dropfiles_weekly", "weekly_bulletin_download", 35, ((r"(?i)mod_dropfiles_latest|mod_dropfiles_list", 20), (r"(?i)com_dropfiles", 12), (r"(?i)mod_downloadlink|zmdi-cloud-download", 18), (r"(?i)weekly-bulletins", 15))),
    RuleSet("oneweb_newsletter_docx", "oneweb_docx", 30, ((r"(?i)onewebmedia/.*newsletter.*\.docx", 25), (r"(?i)onewebstatic|one\.com", 10), (r"(?i)docs\.google\.com/viewer", 8))),
    RuleSet("wordpress_pdfemb", "pdfemb", 28, ((r"(?i)pdfemb-viewer|pdf-embedder|pdfemb-embed", 22), (r"(?i)wp-content/plugins/pdf-embedder", 15))),
    RuleSet("parish_messenger_widget", "parish_messenger", 25, ((r"(?i)theparishmessenger\.com", 25), (r"(?i)parishservices\.co", 10))),
    RuleSet("wix_html_bulletin", "wix_html", 28, ((r"(?i)static\.wixstatic\.com|wix\.com", 15), (r"(?i)#SITE_CONTAINER|wixBiSession", 18), (r"(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[_-]\d{4}", 8))),
    RuleSet("wix_pdf_viewer", "wix_viewer", 30, ((r"(?i)wixlabs-pdf", 28),)),
    RuleSet("google_drive_folder", "cloud_folder", 30, ((r"(?i)drive\.google\.com/drive/folders", 30), (r"\d{2}\.\d{2}\.\d{2}", 10))),
    RuleSet("iframe_google_viewer", "iframe_maybe", 22, ((r"(?i)docs\.google\.com/viewer|docs\.google\.com/gview", 22),)),
    RuleSet("wp_uploads_pdf_list", "pdf_link_list", 22, ((r"(?i)wp-content/uploads/.*\.pdf", 18), (r"(?i)wordpress|wp-json", 8))),
    RuleSet("sequential_weekly_bulletins", "weekly_bulletin_download", 20, ((r"(?i)weekly-bulletins/\d+/", 22), (r"(?i)sunday\s+\d", 8))),
    RuleSet("wordpress_html_post", "wix_html", 30, ((r"(?i)wp-block-paragraph|class=\"entry-content", 14), (r"(?i)wordpress|wp-json|wp-content/themes", 10), (r"(?i)newsletter|bulletin|pastoral area", 12), (r"(?i)category-newsletter|tag-newsletter", 8)), "text", True),
    RuleSet("image_bulletin_wp", "image", 24, ((r"(?i)wp-content/uploads/.*\.(jpg|jpeg|png|webp)", 14), (r"(?i)bulletin|newsletter|notice", 10)), "image", True),
)
#: Where an article's content begins, images that are none of its, and signs of a text edition.
CONTENT = r"(?is)class=\"[^\"]*(?:entry-content|post-content)[^\"]*\".*|<article\b.*"
DECORATIVE = r"(?i)logo|icon|avatar|gravatar|emoji|spinner|badge|social|wp-smiley"
WP_SIGNS = r"(?i)wp-block-paragraph|wp-content|wordpress|wp-json"
EDITION_SIGNS = r"(?i)category-newsletter|tag-newsletter|<title>[^<]*(?:newsletter|bulletin|pastoral area)"
#: Elements that tell the kind of page, in the order in which they are tried.
FRAME = r"(?i)<iframe[^>]+src=[\"'][^\"']*"
SIGNS = (
    ("parish_messenger", r"(?i)<script[^>]+src=[\"'][^\"']*theparishmessenger\.com"),
    ("pdfemb", r"(?i)<a[^>]+class=[\"'][^\"']*pdfemb|id=[\"']pdfemb-embed-|class=[\"'][^\"']*pdfemb-embed"),
    ("wix_viewer", r"(?i)<iframe[^>]+src=[\"'](?:https?:)?//wixlabs-pdf"),
    ("oneweb_docx", FRAME + r"onewebmedia[^\"']*newsletter[^\"']*\.docx"),
    ("iframe", FRAME + r"(?:\.pdf[\"'?]|docs\.google\.com/(?:viewer|gview)|drive\.google\.com/file)"),
    ("iframe_maybe", FRAME + r"(?:pdf|doc|bulletin|newsletter|viewer|drive\.google|dropbox|filesafe|amazonaws|blob\.core)"),
    ("embed", r"(?i)<(?:embed|object)[^>]+(?:\.pdf|application/pdf)"),
)
DOCUMENT_LINK = r"(?i)<a[^>]+href=[\"']([^\"']*(?:\.pdf|\.docx|/wp-content/uploads/)[^\"']*)[\"']"
WEEKLY = r"(?i)mod_dropfiles_(?:latest|list)|mod_downloadlink|weekly\s+bulletins|href=[\"'][^\"']*(?:weekly-bulletins|/newsletters/)"
WEEKLY_ROW = r"(?i)mod_downloadlink|weekly\s+bulletin|sunday\s+\d"
WIX = r"(?i)wixstatic|wix\.com"
DATED_SLUG = r"(?i)(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[_-]\d{4}"
DATED_LINK = r"(?i)href=[\"'][^\"']*(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[_-]\d{4}"
WIDTH = r"(?i)\bwidth=[\"']?(\d{1,6})"
DIRECT = r"\.pdf(?:\?|$)|/pdf/"


def _content(html: Column) -> Column:
    return F.regexp_extract(html, CONTENT, 0)


def _images(html: Column, least: int) -> Column:
    """Image elements of the content that are as wide as said, the decorative ones left out."""
    tags = F.regexp_extract_all(_content(html), F.lit("(?i)<img[^>]*>"), F.lit(0))
    wide = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, WIDTH, 1), F.lit("")).cast("int"), F.lit(0)) >= least
    return F.filter(tags, lambda x: wide(x) & ~x.rlike(DECORATIVE))


def text_edition(html: Column) -> Column:
    """An edition written out on the page: 400 characters of content, four paragraphs or 800 characters, signs of it, not one large image with little text."""
    inner = _content(html)
    length = F.length(F.trim(F.regexp_replace(F.regexp_replace(F.concat(F.lit("<"), inner), r"<[^>]*>", " "), r"\s+", " ")))
    paragraphs = F.regexp_count(inner, F.lit(r"(?i)<(?:p|li)\b|wp-block-paragraph"))
    enough = (length >= 400) & ((paragraphs >= 4) | (length >= 800)) & (html.rlike(WP_SIGNS) | html.rlike(EDITION_SIGNS))
    return F.coalesce(enough & ~((F.size(_images(html, 500)) == 1) & (length < 600)), F.lit(False))


def image_edition(html: Column, least: int = 400) -> Column:
    """A large image of an edition in the content."""
    return F.coalesce(F.exists(_images(html, least), lambda x: x.rlike(P.EDITION_WORDS) | x.rlike("(?i)/wp-content/uploads/")), F.lit(False))


def rule_scores(html: Column, rule_sets: tuple[RuleSet, ...] = RULE_SETS) -> Column:
    """``array<struct<rule, kind, score>>`` of the rule sets that hold, best first, of equals in their order."""
    tests = {"text": text_edition(html), "image": image_edition(html)}
    out = []
    for i, r in enumerate(rule_sets):
        score = sum((F.when(html.rlike(p), w).otherwise(0) for p, w in r.marks), F.lit(0))
        if r.test:
            score = F.when(tests[r.test], score).otherwise(F.lit(0) if r.must else F.floor(score * 0.35))
        out.append(F.struct((-score).cast("int").alias("_s"), F.lit(i).alias("_i"), F.lit(r.name).alias("rule"), F.lit(r.kind).alias("kind"), F.lit(r.least).alias("least")))
    held = F.filter(F.array_sort(F.array(*out)), lambda x: (-x["_s"] >= x["least"]) & (x["_s"] < 0))
    return F.transform(held, lambda x: F.struct(x["rule"].alias("rule"), x["kind"].alias("kind"), (-x["_s"]).alias("score")))


def page_type(url: Column, html: Column) -> Column:
    """Kind of page by the first sign that fits, from its address and source text."""
    h, u = F.coalesce(html, F.lit("")), F.lower(F.coalesce(url, F.lit("")))
    best = F.get(rule_scores(h), F.lit(0))["kind"]
    veto = ((best == "cloud_folder") & ~P.cloud_folder(u)) | ((best == "image") & (~image_edition(h) | text_edition(h)))
    documents = F.filter(F.regexp_extract_all(h, F.lit(DOCUMENT_LINK), F.lit(1)), lambda x: ~P.other_document(x))
    out = F.when(u.rlike(DIRECT), "direct_pdf").when(P.cloud_folder(u), "cloud_folder").when(best.isNotNull() & ~veto, best).when(text_edition(h), "wix_html")
    for kind, sign in SIGNS:
        out = out.when(h.rlike(sign) & h.rlike("(?i)onewebstatic|one\\.com") if kind == "oneweb_docx" else h.rlike(sign), kind)
    return (
        out.when(F.size(documents) > 0, "pdf_links").when(h.rlike(WEEKLY) & h.rlike(WEEKLY_ROW), "weekly_bulletin_download").when(image_edition(h), "image")
        .when(h.rlike(WIX) & u.rlike(DATED_SLUG), "wix_html").when(h.rlike(WIX) & (F.regexp_count(h, F.lit(DATED_LINK)) >= 4), "wix_date_grid")
        .when(h.rlike(r"(?i)<a[^>]+href|<button"), "html").otherwise("unknown")
    )
